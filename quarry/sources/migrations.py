"""Ordered changes of tables' schemas, each applied once, without rewriting files.

A migration is a number, a name and steps. The ledger, a table of the store itself, says
which have been applied and what their steps were. A folder of data remembers the number up
to which its writer knew the schema; readers take it through the later steps, so that old and
new files read as one schema.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import Store

LEDGER = "schema_migrations"


@dataclass(frozen=True)
class Add:
    """A column with a type, filled by an SQL expression over the old ones; nothing happens where there is one."""

    table: str
    column: str
    type: str
    fill: str = "null"

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows if self.column in rows.columns else rows.withColumn(self.column, F.expr(self.fill).cast(self.type))


@dataclass(frozen=True)
class Rename:
    table: str
    old: str
    new: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed(self.old, self.new) if self.new not in rows.columns else rows


@dataclass(frozen=True)
class Retype:
    """Another type, by an SQL expression or a cast."""

    table: str
    column: str
    type: str
    by: str | None = None

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.column, F.expr(self.by or self.column).cast(self.type)) if self.column in rows.columns else rows


@dataclass(frozen=True)
class Drop:
    table: str
    column: str

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.drop(self.column)


@dataclass(frozen=True)
class Migration:
    number: int
    name: str
    steps: tuple[Add | Rename | Retype | Drop, ...]

    @property
    def checksum(self) -> str:
        return hashlib.sha256(repr(self.steps).encode()).hexdigest()


class MigratedStore(Store):
    """A store whose tables are read in the schema of the newest migration that has been applied."""

    def __init__(self, spark: SparkSession, folder: str, migrations: list[Migration]):
        super().__init__(spark, folder)
        self.level = 0
        self.migrations = sorted(migrations, key=lambda m: m.number)
        if len({m.number for m in migrations}) < len(migrations):
            raise ValueError("two migrations have one number")
        self.level = max(self._applied(), default=0)

    def _applied(self) -> dict[int, str]:
        rows = super().read(LEDGER)
        return {} if rows is None else {r.version_id: r.checksum for r in rows.collect()}  # a row for each migration

    def migrate(self) -> list[int]:
        """Applies, in order, what the ledger lacks; returns the numbers. Once more changes nothing.

        A migration that was changed after it had been applied, or that comes late with a
        number below applied ones, is refused.
        """
        applied = self._applied()
        for m in self.migrations:
            if m.number in applied and applied[m.number] != m.checksum:
                raise ValueError(f"migration {m.number} ({m.name}) has been changed since it was applied")
        left = [m for m in self.migrations if m.number not in applied]
        if late := [m.number for m in left if m.number < max(applied, default=0)]:
            raise ValueError(f"migrations {late} come before others that have been applied")
        for m in left:
            row = self.spark.createDataFrame([(m.number, m.name, m.checksum)], "version_id long, name string, checksum string")
            self.commit(m.number, {LEDGER: row})
            self.level = m.number
        return [m.number for m in left]

    def _stamp(self) -> dict:
        return {"level": self.level}

    def _adapted(self, table: str, rows: DataFrame, part: dict) -> DataFrame:
        for m in self.migrations:
            if part.get("level", 0) < m.number <= self.level:
                for step in m.steps:
                    if step.table == table:
                        rows = step.apply(rows)
        return rows
