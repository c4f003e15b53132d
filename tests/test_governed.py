"""Constraints, vectors of services, roles, sessions, uploads, new assets and merged rows."""

import datetime

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators import access as A
from quarry.operators import embedding as E
from quarry.operators import state
from quarry.sources import schemas

DAY = datetime.timedelta(days=1)
NOON = datetime.datetime(2024, 1, 31, 12)


def now():
    return F.expr("timestamp_ntz '2024-01-31 12:00:00'")


def test_every_rule_counts_its_rows(spark):
    t = schemas.Table("id STRING NOT NULL, kind STRING, up STRING", (("id",),), {"kind": "kind IN ('a', 'b')"}, ((("up",), "t", ("id",)),), ((("kind",), "up IS NULL"),))
    rows = spark.createDataFrame([("1", "a", None), ("1", "a", None), (None, "c", "1"), (None, None, "9")], "id string, kind string, up string")
    got = {r.rule: r.n for r in schemas.violations({"t": rows}, {"t": t}).collect()}
    assert got == {"not null id": 2, "check kind": 1, "unique id": 1, "reference up to t": 1, "unique kind where up IS NULL": 1}


def test_partial_keys_and_missing_columns(spark):
    rows = spark.createDataFrame([("1", "a", True), ("2", "a", True), ("3", "a", False)], "version_id string, asset_id string, is_current boolean")
    got = {r.rule: r.n for r in schemas.violations({"asset_versions": rows}).collect()}
    assert got["unique asset_id where is_current"] == 1
    assert not any("sha256" in rule or "lifecycle" in rule or "to assets" in rule for rule in got)
    assert {r.n for r in schemas.violations({"asset_versions": rows.limit(0)}).collect()} == {0}


def test_sixteen_tables_load_with_their_columns(spark, tmp_path):
    assert len(schemas.TABLES) == 16
    for name, t in schemas.TABLES.items():
        spark.createDataFrame([], t.columns.replace(" NOT NULL", "")).write.parquet(f"{tmp_path}/{name}.parquet")
        assert schemas.load(spark, str(tmp_path), name).columns == [c.split()[0] for c in t.columns.split(", ")]
        assert set(schemas.required(t)) >= {c for key in t.keys[:1] for c in key} - {"chunk_id"} or name == "error_events"


def texts(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "k long, t string").coalesce(1)


def test_vectors_come_in_batches_and_cut(spark, tmp_path):
    log = tmp_path / "asked"

    def embed(batch):
        with open(log, "a") as f:
            f.write(repr(batch) + "\n")
        return [[float(len(t)), 1.0] for t in batch]

    got = {r.k: r.embedding for r in E.embedded(texts(spark, "a", "bbb", None, "cccccc", "a"), embed, 2, "k", "t", batch=2, most_characters=4).collect()}
    assert got == {0: [1.0, 1.0], 1: [3.0, 1.0], 2: [0.0, 1.0], 3: [4.0, 1.0], 4: [1.0, 1.0]}
    assert log.read_text().splitlines() == ["['a', 'bbb']", "['', 'cccc']"]


@pytest.mark.parametrize("vectors_of, said", [(lambda b: [[1.0]] * len(b), "2 finite numbers"), (lambda b: [[1.0, float("nan")]] * len(b), "2 finite numbers"), (lambda b: [], "0 vectors for 1 texts")])
def test_wrong_vectors_end_the_job(spark, vectors_of, said):
    with pytest.raises(PythonException, match=said):
        E.embedded(texts(spark, "a"), vectors_of, 2, "k", "t").collect()


def test_attempts(spark, tmp_path):
    log = tmp_path / "tries"

    def embed(batch):
        with open(log, "a") as f:
            f.write("x")
        if log.stat().st_size < 3:
            raise E.Retryable("busy", after=0.0)
        return [[1.0]] * len(batch)

    assert E.embedded(texts(spark, "a"), embed, 1, "k", "t").first().embedding == [1.0]
    assert log.read_text() == "xxx"

    def never(batch):
        raise E.Retryable("busy")

    with pytest.raises(PythonException, match="busy"):
        E.embedded(texts(spark, "a"), never, 1, "k", "t", attempts=2, base=0.0).collect()


def test_only_new_texts_are_asked_for(spark):
    hashed = lambda df: df.select("k", F.sha2(F.coalesce("t", F.lit("")), 256).alias("content_hash"), F.array(F.lit(7.0).cast("float")).alias("embedding"))
    old = hashed(texts(spark, "same", "was", "gone").filter("k < 3"))
    got = {r.k: r.embedding for r in E.again(texts(spark, "same", "is"), old, lambda b: [[1.0]] * len(b), 1, "k", "t").collect()}
    assert got == {0: [7.0], 1: [1.0]}


def test_stub_has_every_coordinate(spark):
    import hashlib

    raw = [b / 255 * 2 - 1 for b in hashlib.sha256(b"x").digest()]
    raw = [raw[i % 32] for i in range(40)]
    length = sum(x * x for x in raw) ** 0.5
    got = spark.range(1).select(vectors.stub(F.lit("x"), 40).alias("v")).first().v
    assert got == pytest.approx([x / length for x in raw])


def test_aliases(spark):
    rows = spark.createDataFrame([(1, ["Thanos", "USER"]), (2, ["operator", "other", None]), (3, None), (4, [])], "k int, held array<string>")
    got = {r.k: (r.roles, r.admin, r.upload) for r in rows.select("k", A.roles(F.col("held")).alias("roles"), A.may(F.col("held"), "admin").alias("admin"), A.may(F.col("held"), "admin", "uploader").alias("upload")).collect()}
    assert got == {1: (["admin", "viewer"], True, True), 2: (["uploader", "other", None], False, True), 3: ([], False, False), 4: ([], False, False)}


SESSIONS = "token_hash string, employee_id string, expires_at timestamp_ntz, revoked_at timestamp_ntz"


def test_roles_change_and_the_last_admin_stays(spark):
    held = spark.createDataFrame([("a", "admin"), ("b", "viewer")], "employee_id string, role string")
    sessions = spark.createDataFrame([("1", "a", NOON + DAY, None), ("2", "b", NOON + DAY, None), ("3", "b", NOON + DAY, NOON - DAY)], SESSIONS)
    changes = lambda *rows: spark.createDataFrame(list(rows), "employee_id string, role string")
    after, ended, refused = A.change_roles(held, sessions, changes(("a", "viewer"), ("b", None), ("nobody", None)), now())
    assert sorted(after.collect()) == [("a", "admin")]
    assert [r.employee_id for r in refused.collect()] == ["a"]
    assert {r.token_hash: r.revoked_at for r in ended.collect()} == {"1": None, "2": NOON, "3": NOON - DAY}
    # another administrator comes with the same changes, or one is named elsewhere
    assert sorted(A.change_roles(held, sessions, changes(("a", "viewer"), ("c", "admin")), now())[0].collect()) == [("a", "viewer"), ("b", "viewer"), ("c", "admin")]
    assert A.change_roles(held, sessions, changes(("a", None)), now(), first_admins=("Z",))[0].collect() == [("b", "viewer")]
    role = lambda e, r: spark.range(1).select(A.resolved(F.lit(e), F.lit(r).cast("string"), (" x1 ",)).alias("r")).first().r
    assert (role("X1", "viewer"), role("b", "viewer"), role("b", None)) == ("admin", "viewer", "uploader")


def test_sessions_are_purged_revoked_and_active(spark):
    old = spark.createDataFrame([("1", "a", NOON - 8 * DAY, None), ("2", "a", NOON + DAY, NOON - 8 * DAY), ("3", "a", NOON - DAY, None), ("4", "a", NOON + DAY, NOON - DAY)], SESSIONS)
    after = A.open_sessions(old, spark.createDataFrame([("5", "b", NOON + DAY, None)], SESSIONS), now())
    assert sorted(r.token_hash for r in after.collect()) == ["3", "4", "5"]
    assert [r.token_hash for r in after.filter(A.active(now())).collect()] == ["5"]
    ended = {r.token_hash: r.revoked_at for r in A.revoke(after, F.col("token_hash").isin("4", "5"), now()).collect()}
    assert ended == {"3": None, "4": NOON - DAY, "5": NOON}


def test_upload_refusals(spark):
    cases = [
        ("document", "a.PDF", "draft", None, None, 1, None), ("incident", "a.pdf", "draft", None, None, 1, "extension"), ("other", "a.md", "draft", None, None, 1, "extension"), ("document", ".md", "draft", None, None, 1, "extension"),
        ("document", "a.md", "gone", None, None, 1, "lifecycle"), ("source_code", "x/a.java", "draft", " ", None, 1, "repository"), ("source_code", "a.java", "draft", "r", "a/../b", 1, "path"), ("document", "a.md", "draft", None, "/a", 1, "path"),
        ("document", "a.md", "draft", None, "a\\b", 1, "path"), ("document", "x/.a.md", "draft", None, "a", 1, "filename"), ("document", "a.md", "draft", None, "a..b/c", A.MOST_BYTES + 1, "size"), ("document", "a.md", "draft", None, "", 0, "empty"),
    ]
    df = spark.createDataFrame(cases, "kind string, name string, life string, repo string, path string, n long, want string")
    got = df.select("want", A.upload_refusal(*[F.col(c) for c in ("kind", "name", "life", "repo", "path", "n")]).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_new_assets_are_checked(spark):
    old = spark.createDataFrame([("1", "document", "T", "general", "internal", NOON, None)], "asset_id string, asset_type string, title string, subtype string, security_level string, created_at timestamp_ntz, deleted_at timestamp_ntz")
    new = spark.createDataFrame([("2", "incident", "T", None), ("1", "incident", "T", None), ("3", "other", "T", None), ("4", "document", "", None), ("5", "document", "T", "x" * 201), ("6", "document", "T", None), ("6", "document", "U", None)], "asset_id string, asset_type string, title string, vendor string")
    after, refused = A.insert_assets(old, new, now())
    assert sorted(tuple(r)[:6] for r in after.collect()) == [("1", "document", "T", "general", "internal", NOON), ("2", "incident", "T", "general", "internal", NOON)]
    assert sorted((r.asset_id, r.reason) for r in refused.collect()) == [("1", "asset_id"), ("3", "asset_type"), ("4", "title"), ("5", "vendor"), ("6", "asset_id"), ("6", "asset_id")]


def test_requeued_jobs_start_anew(spark):
    jobs = spark.createDataFrame([(1, "failed", 3, "w", NOON, '{"a": "1", "total_items": 9}'), (2, "completed", 1, "w", NOON, None)], "job_id int, status string, attempts int, worker_id string, completed_at timestamp_ntz, report string")
    got = {r.job_id: tuple(r)[1:] for r in state.requeue(jobs, "report", now()).collect()}
    assert got[1][:4] == ("queued", 0, None, None) and got[2] == ("completed", 1, "w", NOON, None)
    import json

    assert json.loads(got[1][4]) == {"a": "1", "processing_stage": "queued", "processed_items": None, "total_items": None}


def test_rows_merge_as_if_they_came_one_by_one(spark):
    schema = "kind string, name string, said string, sure double, props map<string,string>"
    old = spark.createDataFrame([("t", "old", "told", 0.9, {"a": "1", "b": "1"}), ("u", "only", "", 0.1, None)], schema)
    new = spark.createDataFrame([("t", "new", "", 0.2, {"b": "2"}, 1), ("t", None, "later", 0.3, {"c": "3"}, 2), (None, "n", None, None, {"z": None}, 3)], schema + ", seq long")
    got = {r.kind: tuple(r)[1:] for r in state.merge_rows(old, new, ["kind"], ["name"], ["said"], ["sure"], "props").collect()}
    assert got == {"t": (None, "later", 0.9, {"a": "1", "b": "2", "c": "3"}), "u": ("only", "", 0.1, {}), None: ("n", "", None, {"z": None})}
