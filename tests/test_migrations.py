"""Migrations in order, once, with old and new files read as one."""

import pytest

from quarry.sources.migrations import Add, Drop, Migration, MigratedStore, Rename, Retype

FIRST = Migration(1, "kinds", (Add("chunks", "kind", "string", "'text'"), Rename("chunks", "body", "content")))
SECOND = Migration(2, "sizes", (Retype("chunks", "seq", "long"), Add("chunks", "size", "int", "length(content)"), Drop("chunks", "old")))


def test_old_and_new_files_are_one_schema(spark, tmp_path):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    store = MigratedStore(spark, str(tmp_path), [])
    store.commit(1, {"chunks": rows([(1, 1, "abc", 9)], "version_id long, seq int, body string, old int"), "jobs": rows([(1, "x")], "version_id long, status string")})
    store = MigratedStore(spark, str(tmp_path), [FIRST])
    assert store.read("chunks").columns == ["version_id", "seq", "body", "old"]  # not applied yet
    assert store.migrate() == [1] and store.migrate() == []
    store.commit(2, {"chunks": rows([(2, 1, "de", 8, "table")], "version_id long, seq int, content string, old int, kind string")})
    store = MigratedStore(spark, str(tmp_path), [SECOND, FIRST])
    number = store.manifest().number
    assert store.migrate() == [2] and store.migrate() == [] and store.manifest().number == number + 1
    store.commit(3, {"chunks": rows([(3, 5, "f", "text", 77)], "version_id long, seq long, content string, kind string, size int")})
    expected = [(1, 1, "abc", "text", 3), (2, 1, "de", "table", 2), (3, 5, "f", "text", 77)]
    read = lambda s: sorted(tuple(r) for r in s.read("chunks").select("version_id", "seq", "content", "kind", "size").collect())
    assert read(store) == expected and dict(store.read("chunks").dtypes)["seq"] == "bigint" and "old" not in store.read("chunks").columns
    store.compact("chunks")
    again = MigratedStore(spark, str(tmp_path), [FIRST, SECOND])
    assert len(again.manifest().tables["chunks"]) == 1 and read(again) == expected and again.read("jobs").count() == 1


def test_changed_and_late_migrations_are_refused(spark, tmp_path):
    MigratedStore(spark, str(tmp_path), [SECOND]).migrate()
    with pytest.raises(ValueError, match="come before"):
        MigratedStore(spark, str(tmp_path), [FIRST, SECOND]).migrate()
    with pytest.raises(ValueError, match="changed"):
        MigratedStore(spark, str(tmp_path), [Migration(2, "sizes", (Drop("chunks", "kind"),))]).migrate()
    with pytest.raises(ValueError, match="one number"):
        MigratedStore(spark, str(tmp_path), [FIRST, Migration(1, "other", ())])
