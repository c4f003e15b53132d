"""Joins and indexes whose work must not grow with the square of a group, against SQL and by their plans."""

import os

import duckdb
import pytest
from compare import duck, rows

from quarry.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(tmp_path):
    """A folder with the given tables, of which some are replaced by SQL over them."""
    def make(**changed):
        for file in os.listdir(SF):
            os.symlink(f"{SF}/{file}", tmp_path / file)
        for name, sql in changed.items():
            os.unlink(tmp_path / f"{name}.parquet")
            duckdb.sql(f"COPY ({sql.format(t=f'{SF}/{name}.parquet')}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return make


def same(spark, folder, name):
    ours, theirs = rows(catalog.QUERIES[name](spark, folder).toPandas()), rows(duck(folder).sql(catalog.ORACLE_SQL[name]).df())
    return len(theirs) > 0 and ours.equals(theirs)


def test_owners_by_the_order_of_the_sql(spark, tables):
    """Ids above a million outweigh a line of length; repeated symbols own each other's lines, not their own."""
    ids = "(SELECT range::BIGINT AS k FROM range(1, 1500) UNION ALL SELECT range FROM range(2001500, 2003000) UNION ALL SELECT range FROM range(1, 40))"
    folder = tables(part=f"SELECT p.* REPLACE (k AS p_partkey) FROM {ids}, (SELECT * FROM '{{t}}' LIMIT 1) p")
    assert same(spark, folder, "range_owner_innermost")


def test_symbols_with_repeated_rows(spark, tables):
    """Pairs come as often as symbols do, and are not brought together again after the join."""
    folder = tables(part="SELECT * FROM '{t}' UNION ALL SELECT * FROM '{t}'")
    assert same(spark, folder, "stack_symbol_lane")
    plan = catalog.QUERIES["stack_symbol_lane"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_frames_meet_lists_of_symbols(spark, tables):
    """A join makes a row for each list of a key, not for each symbol; the pairs are made behind it."""
    folder = tables(part="SELECT * FROM '{t}' UNION ALL SELECT * FROM '{t}'")
    assert same(spark, folder, "trace_to_symbol")
    plan = catalog.QUERIES["trace_to_symbol"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(symbol_ids") < plan.index("Join Inner") < plan.index("Aggregate")


def test_items_of_tables_are_numbered_once(spark):
    from quarry.plans import content

    assert content._cells(spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_hybrid_search_reads_texts_once(spark):
    """Both sets of lanes rank hits that are made once; no lane reads a document again, and the last step only those of ten chunks."""
    from quarry.plans import analysis

    plan = catalog.QUERIES["hybrid_all_lanes"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "split(" not in plan and "text#" not in plan and "Generate explode(tokens" in plan
    full = catalog.QUERIES["hybrid_search_full"](spark, SF)
    scan = full._jdf.queryExecution().executedPlan().toString().split("documents.parquet")[0]
    assert full.count() == 10 and "PushedFilters: [In(doc_id" in full._jdf.queryExecution().executedPlan().toString(), scan
    whole = analysis._hits(spark, SF, dense=True).seen
    assert whole.filter("n > 0").count() > 40 and whole.columns == ["chunk_id", "asset_id", "created_at", "vec_id", "tokens", "n"]


@pytest.mark.parametrize("name", ["stack_symbol_lane", "trace_to_symbol"])
def test_frames_are_shuffled_by_numbers(spark, name):
    """Names are made behind the shuffle that numbers frames, and frames meet symbols by a number; repeated line numbers, parts and rows count as in the SQL."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert moved and all("hashpartitioning(l_orderkey" in line or "hashpartitioning(_name" in line for line in moved)
    assert "l_suppkey" not in plan


@pytest.mark.parametrize("name", ["stack_symbol_lane", "trace_to_symbol"])
def test_pairs_of_repeated_frames(spark, tables, name):
    """Lines that share order, number and part are as many frames as the SQL counts, and no order of them is open."""
    lines = "SELECT * FROM '{t}' UNION ALL SELECT * REPLACE (l_suppkey + 1 AS l_suppkey) FROM '{t}' UNION ALL SELECT * REPLACE (1 AS l_linenumber, 7 AS l_extendedprice) FROM '{t}' WHERE l_orderkey % 5 = 0"
    assert same(spark, tables(lineitem=lines, part="SELECT * FROM '{t}' UNION ALL SELECT * FROM '{t}' WHERE p_partkey % 3 = 0"), name)


def test_frames_of_a_name_come_list_by_list(spark):
    """Whatever the join, a list of frames meets one list of symbols before the next; short lists, and more names than may be broadcast, give the same pairs."""
    from quarry.operators import symbols as Y

    frames = spark.range(0, 300, 1, 2).selectExpr("id AS trace_id", "IF(id % 10 = 0, 'rare', IF(id % 10 = 1, 'none', 'common')) AS name", "IF(id % 10 = 2, null, id) AS frame_seq")
    symbols = spark.range(0, 100, 1, 3).selectExpr("IF(id = 7, 6, id) AS symbol_id", "IF(id % 10 = 0, 'rare', IF(id % 10 = 1, null, 'common')) AS name")
    expected = sorted(map(str, frames.join(symbols, "name").select("trace_id", "frame_seq", "symbol_id").collect()))
    for options in ({}, {"held": 40, "size": 8}, {"broadcast_limit": 0}, {"held": 1, "size": 1}):
        assert sorted(map(str, Y.meant(frames, symbols, "name", **options).collect())) == expected, options
    runs = []  # a frame's ids that come in one go
    for p in Y.meant(frames, symbols, "name", size=8).collect():
        if not runs or runs[-1][0] != p.trace_id:
            runs.append((p.trace_id, []))
        runs[-1][1].append(p.symbol_id)
    assert max(len(ids) for _, ids in runs) <= 8
    assert sum(a[1] != b[1] for a, b in zip(runs, runs[1:])) < len(runs) / 10
