"""Roles, sessions, uploads and new assets: who may do what, and what is taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state

#: Older names of roles; endings of files by the kind of asset; states of a version; lengths of an asset's fields.
ALIASES = {"user": "viewer", "general": "viewer", "viewer": "viewer", "operator": "uploader", "uploader": "uploader", "thanos": "admin", "admin": "admin"}
EXTENSIONS = {
    "document": (".pdf", ".pptx", ".docx", ".txt", ".md"), "incident": (".txt", ".md"), "error_trace": (".log", ".txt"),
    "source_code": (".py", ".java", ".jar", ".sql", ".js", ".sh", ".yml", ".yaml"),
}
LIFECYCLE = ("draft", "approved", "obsolete")
LENGTHS = {"subtype": (1, 100), "title": (1, 300), "security_level": (1, 50)} | {c: (0, 200) for c in ("vendor", "product", "system_name", "service_name", "component", "owner_org")}
DEFAULTS = {"subtype": "general", "security_level": "internal"}
MOST_BYTES = 10 * 1024 * 1024


def roles(held: Column) -> Column:
    """Roles under their present names, each once; a name that no alias has stays as it is, in lower case. Null: none."""
    table = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.array_distinct(F.transform(F.coalesce(held, F.array().cast("array<string>")), lambda r: F.coalesce(F.try_element_at(table, F.lower(r)), F.lower(r))))


def may(held: Column, *allowed: str) -> Column:
    """Whether one of the roles is among those that are allowed; never null."""
    return F.coalesce(F.arrays_overlap(F.array_compact(roles(held)), F.array(*map(F.lit, allowed))), F.lit(False))


def resolved(employee_id: Column, stored: Column, first_admins: tuple[str, ...] = ()) -> Column:
    """A person's role: the first administrators' before the stored one, and uploader without any."""
    return F.when(F.upper(F.trim(employee_id)).isin(*[a.strip().upper() for a in first_admins]), "admin").otherwise(F.coalesce(stored, F.lit("uploader")))


def _guarded(roles_now: DataFrame, falls: DataFrame, first_admins: tuple[str, ...]) -> DataFrame:
    """Changes of administrators' roles, but for those that would leave none."""
    if first_admins:
        return falls
    left = roles_now.filter("role = 'admin'").select("employee_id").join(falls.select("employee_id"), "employee_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return falls.filter(left.scalar() > 0)


def change_roles(roles_now: DataFrame, sessions: DataFrame, changes: DataFrame, now: Column, first_admins: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles and sessions after ``changes`` (employee_id, role; null: the role goes), and the changes that were refused.

    Of all changes that take an administrator's role none is made if no administrator would be
    left. Whose role is set or goes loses the open sessions; a role that nobody holds can't go.
    """
    held = roles_now.select("employee_id", F.col("role").alias("_now"))
    asked = changes.join(held, "employee_id", "left").filter(F.col("role").isNotNull() | F.col("_now").isNotNull())
    falls = (F.col("_now") == "admin") & ~F.coalesce(F.col("role") == "admin", F.lit(False))
    falls = F.coalesce(falls, F.lit(False))
    down, rest = asked.filter(falls), asked.filter(~falls)
    new_admins = roles_now.select("employee_id", "role").unionByName(rest.filter("role = 'admin'").select("employee_id", "role"))
    done = rest.unionByName(_guarded(new_admins, down, first_admins)).select("employee_id", "role")
    after = state.replace_rows(roles_now.join(done.filter("role is null").select("employee_id"), "employee_id", "left_anti").select("employee_id", "role"), done.filter("role is not null"), ["employee_id"])
    ended = sessions.join(done.select("employee_id", F.lit(True).alias("_changed")).distinct(), "employee_id", "left")
    ended = ended.withColumn("revoked_at", F.when(F.col("_changed") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).select(*sessions.columns)
    return after, ended, down.select("employee_id", "role").join(done, "employee_id", "left_anti")


def open_sessions(sessions: DataFrame, new: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Sessions after new ones (of the same columns) have come; those that ended or were revoked more than ``days`` days ago go first."""
    old = now - F.expr(f"interval '{days}' day")
    gone = F.coalesce(F.col("expires_at") < old, F.lit(False)) | F.coalesce(F.col("revoked_at") < old, F.lit(False))
    return sessions.filter(~gone).unionByName(new.select(*sessions.columns))


def revoke(sessions: DataFrame, hit: Column, now: Column) -> DataFrame:
    return sessions.withColumn("revoked_at", F.when(F.coalesce(hit, F.lit(False)) & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at")))


def active(now: Column) -> Column:
    return F.col("revoked_at").isNull() & F.coalesce(F.col("expires_at") > now, F.lit(False))


def safe_path(path: Column) -> Column:
    """Whether a path is relative and stays below where it starts; an empty or null one is fine."""
    parts = F.split(path, "/")
    return F.coalesce(~path.startswith("/") & ~F.contains(path, F.lit("\\")) & ~F.array_contains(parts, ".."), F.lit(True))


def upload_refusal(asset_type: Column, filename: Column, lifecycle: Column, repository: Column, path: Column, n_bytes: Column, most_bytes: int = MOST_BYTES) -> Column:
    """Why an upload is refused, by the first reason in order; null if it is taken."""
    name = F.element_at(F.split(F.coalesce(filename, F.lit("")), "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    matrix = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    allowed = F.coalesce(F.array_contains(F.try_element_at(matrix, asset_type), ending), F.lit(False))
    return (
        F.when(~allowed, "extension").when(~F.coalesce(lifecycle.isin(*LIFECYCLE), F.lit(False)), "lifecycle")
        .when((asset_type == "source_code") & (F.trim(F.coalesce(repository, F.lit(""))) == ""), "repository").when(~safe_path(path), "path")
        .when((name == "") | name.startswith("."), "filename").when(n_bytes > most_bytes, "size").when(F.coalesce(n_bytes, F.lit(0)) == 0, "empty")
    )


def insert_assets(assets: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Assets with new ones, and the new ones that are refused with a ``reason``.

    Fields that are missing get their defaults; ids are there already or come twice: refused too
    (of rows with one new id all are). Other columns of ``assets`` that ``new`` lacks are null.
    """
    filled = new.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in new.columns else F.lit(v) for c, v in DEFAULTS.items()})
    known = assets.select("asset_id", F.lit(True).alias("_known")).distinct()
    twice = new.groupBy("asset_id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    filled = filled.join(known, "asset_id", "left").join(twice, "asset_id", "left")
    reason = F.when(F.col("asset_id").isNull() | F.coalesce("_known", F.lit(False)) | F.coalesce("_twice", F.lit(False)), "asset_id")
    reason = reason.when(~F.coalesce(F.col("asset_type").isin(*EXTENSIONS), F.lit(False)), "asset_type")
    for c, (least, most) in LENGTHS.items():
        if c in filled.columns:
            size = F.length(c)
            reason = reason.when(F.coalesce(~size.between(least, most), F.lit(least > 0)), c)
    judged = filled.withColumn("reason", reason)
    taken = judged.filter("reason is null").withColumns({"created_at": now, "deleted_at": F.lit(None).cast(assets.schema["deleted_at"].dataType)})
    made = taken.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in taken.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in assets.schema])
    return assets.unionByName(made), judged.filter("reason is not null").select(*new.columns, "reason")
