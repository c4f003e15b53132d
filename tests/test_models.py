"""Document models with odd fields, and links that break, cross and lead elsewhere."""

import json

from quarry.operators import docmodel as M
from quarry.operators import links


def test_blocks_of_models(spark):
    model = {
        "texts": [
            {"text": "제2관 보험금", "prov": [{"page_no": 3}]}, {"text": " 제1조 (목적) ", "prov": [{"page_no": 3}, {"page_no": 9}]}, {"text": "", "orig": "본문"}, {"text": " \n "}, {"label": "none"}, "no object", 7, None,
            {"text": "제2조"}, {"text": "[별표40-1] 표", "prov": []}, {"text": "끝", "prov": "odd"},
        ],
        "groups": {"not": "a list"},
        "key_value_items": [{"orig": "key: value", "prov": [{"page_no": 5, "bbox": [1, 2]}]}],
    }
    rows = [(1, json.dumps(model)), (2, "{broken"), (3, None), (4, "[]"), (5, json.dumps({"texts": []})), (6, json.dumps({"texts": [{"text": "only"}]}))]
    got = {}
    for r in M.blocks(spark.createDataFrame(rows, "doc_id long, payload string")).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.block, r.text, r.page, r.heading_type, list(r.heading_path)))
    assert got == {
        1: [
            (0, "제2관 보험금", 3, "section", ["제2관 보험금"]), (1, "제1조 (목적)", 3, "article", ["제2관 보험금", "제1조 (목적)"]), (2, "본문", 1, None, ["제2관 보험금", "제1조 (목적)"]),
            (4, "제2조", 1, "article", ["제2관 보험금", "제1조 (목적)", "제2조"]), (5, "[별표40-1] 표", 1, "appendix", ["[별표40-1] 표"]), (6, "끝", 1, None, ["[별표40-1] 표"]), (7, "key: value", 5, None, ["[별표40-1] 표"]),
        ],
        6: [(0, "only", 1, None, [])],
    }


def test_tables_of_models(spark):
    new = {"prov": [{"page_no": 4}], "data": {"num_rows": 2, "num_cols": 2, "table_cells": [
        {"text": "head", "start_row_offset_idx": 0, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "end_col_offset_idx": 2, "column_header": True},
        {"text": 5, "start_row_offset_idx": 1, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "prov": [{"page_no": 6}], "row_header": True},
    ]}}
    old = {"data": {}, "table_data": {"n_rows": 1, "cells": [{"row": 0, "col": 1}]}}
    rows = [(1, json.dumps({"tables": [new, old, {}, {"data": None}]})), (2, "no json"), (3, json.dumps({"tables": 3}))]
    docs = spark.createDataFrame(rows, "doc_id long, payload string")
    cells = sorted(tuple(r)[1:] for r in M.cells(docs).collect())
    assert cells == [(0, 0, 0, 1, 2, "head", False, True, 4), (0, 1, 0, 1, 1, "5", True, False, 6), (1, 0, 1, 1, 1, "", False, False, 1)]
    found = sorted((r.table_no, r.n_rows, r.n_cols, list(r.pages)) for r in M.tables(docs).collect())
    assert found == [(0, 2, 2, [4, 6]), (1, 1, 0, [1]), (2, 0, 0, []), (3, 0, 0, [])]


def follow_by_hand(rows, hit, window):
    by_id = {i: (p, n) for i, p, n in rows}
    out = []
    for side, step in ((0, -1), (1, 1)):
        at = by_id[hit][side]
        path = []
        for _ in range(window):
            if at is None or at not in by_id:
                break
            path.append(at)
            at = by_id[at][side]
        out.append(path)
    return out[0][::-1] + [hit] + out[1]


def test_links_are_followed(spark):
    """A chain, a missing id, a foreign one, two that cross, one that goes round, one to itself."""
    rows = [(f"c{k}", f"c{k - 1}" if k else None, f"c{k + 1}") for k in range(9)]
    rows += [("x", "gone", "c3"), ("y", "x", "z"), ("z", "y", "y"), ("own", "own", "own"), ("lone", None, None), ("cross1", "cross2", "c8"), ("cross2", "cross1", "c0")]
    df = spark.createDataFrame(rows, "chunk_id string, previous_chunk_id string, next_chunk_id string")
    for window in (0, 1, 2, 3, 5, 8, 13):
        got = {r.chunk_id: list(r.context) for r in links.expanded(df, window=window).collect()}
        assert got == {i: follow_by_hand(rows, i, window) for i, _, _ in rows}
    assert [r.chunk_id for r in links.expanded(df, df.chunk_id == "x", 2).collect()] == ["x"]


def test_markdown_blocks(spark):
    """Steps are numbered anew, bullets nest below them, fences hide what is within, text ends a procedure."""
    from quarry.operators import markdown

    page = "## 조치 절차\n1. first\n   - a\n1. second\n\n   - b\n1. third\n   * c\nplain\n- top\n```sql\n# no heading\n1. no step\n\n```\n5) again\n***\n- alone\n```\nopen end"
    lines = [(1, k, x) for k, x in enumerate(page.split("\n"), 1)] + [(2, 1, None), (2, 2, "- x")]
    df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    for span in (3, 1000):
        got = {}
        for r in markdown.blocks(df, span=span).orderBy("doc_id", "line_no").collect():
            got.setdefault(r.doc_id, []).append((r.kind, r.level, r.number, r.nested, r.text))
        assert got == {
            1: [
                ("heading", 2, None, None, "조치 절차"), ("numbered", None, 1, None, "first"), ("bullet", None, None, True, "a"), ("numbered", None, 2, None, "second"), ("blank", None, None, None, ""),
                ("bullet", None, None, True, "b"), ("numbered", None, 3, None, "third"), ("bullet", None, None, True, "c"), ("text", None, None, None, "plain"), ("bullet", None, None, False, "top"),
                ("code", None, None, None, "# no heading\n1. no step\n"), ("numbered", None, 1, None, "again"), ("rule", None, None, None, ""), ("bullet", None, None, False, "alone"), ("code", None, None, None, "open end"),
            ],
            2: [("blank", None, None, None, ""), ("bullet", None, None, False, "x")],
        }
