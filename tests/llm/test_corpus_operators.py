"""The training-data operators on small fixtures: brute force, edge cases, round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import common, decontaminate, html_extract, license_rules, licenses, line_dedup, near_dedup, pairwise_quality, pieces, preferences, quality_rules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, word int"
WORDS = [f"w{k}" for k in range(400)]


def some_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, "clash", 1) for i, t in texts], DOCS)


def prose(rng, n, per_line=12):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) for k in range(0, n, per_line))


ODD = [(1, None), (2, ""), (3, " \n\t\n "), (None, "null id here"), (5, "same"), (5, "same"), (6, "x" * 200_000), (7, "é " * 30_000), (8, "...")]


def test_odd_and_empty_tables(spark):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash; and no rows at all."""
    odd, none = some_docs(spark, ODD), some_docs(spark, [])
    ids = lambda rows: sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))
    every = ids(odd.collect())

    lines = line_dedup.dedup_lines(odd, info="n").collect()
    assert ids(lines) == every and sorted(map(repr, (r.text for r in lines))) == sorted(repr(t) for _, t in ODD) and not any(r.n for r in lines)
    classes = {(r.doc_id, r.class_id) for r in near_dedup.near_classes(odd).collect()}
    # 1 and 2 are equal (null and empty), as are the rows of 5; texts without words are copies of equal texts only
    assert classes == {(1, 1), (2, 1), (3, 3), (None, None), (5, 5), (6, 6), (7, 7), (8, 8)}
    assert ids(near_dedup.keep_one(odd).collect()) == [1, 3, 5, 6, 7, 8, None] and near_dedup.keep_one(odd).columns == odd.columns
    book = {(r.doc_id, r.n_words) for r in quality_rules.ledger(odd).collect()}
    assert book == {(1, 0), (2, 0), (3, 0), (None, 3), (5, 1), (6, 1), (7, 30_000), (8, 1)} and quality_rules.ledger(odd).count() == len(ODD)
    assert quality_rules.keep_good(odd).columns == odd.columns and {r.doc_id for r in quality_rules.keep_good(odd).collect()} <= {7}
    licensed = licenses.scan(odd).collect()
    assert ids(licensed) == every and {(r.doc_id, r.n_words) for r in licensed} == {(1, 0), (2, 0), (3, 0), (None, 3), (5, 1), (6, 1), (7, 30_000), (8, 0)} and not any(r.labels for r in licensed)
    for apply in (line_dedup.dedup_lines, near_dedup.near_classes, near_dedup.keep_one, quality_rules.ledger, quality_rules.keep_good, licenses.scan):
        assert apply(none).count() == 0
    long = "filler " * 60_000 + "GNU LGPL v2.1+ " + "filler " * 3 + "MIT license"
    found = licenses.scan(some_docs(spark, [(1, long)])).first()
    assert (found.n_words, found.labels, found.first_word) == (60_009, ["lgpl-2.1-or-later", "mit"], 60_007)


def test_odd_tables_of_operators_with_two_inputs(spark):
    bench = lambda rows: spark.createDataFrame(rows, "item_id long, text string, _k string")
    items = bench([(1, None, "x"), (2, "", "x"), (None, "null id here", "x"), (3, "same", "x")])
    odd = some_docs(spark, ODD)
    found = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in decontaminate.contamination(odd, items).collect()}
    assert found[5, 1] == (1, ["3"]) and found[1, 0] == (0, []) and found[None, 3][0] == 3
    assert decontaminate.contamination(odd, bench([])).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(some_docs(spark, []), items).count() == 0
    labels = spark.createDataFrame([(5, None), (None, 1), (2, 0)], "doc_id long, quality int")
    scored = pairwise_quality.score(odd, labels)
    assert scored.count() == len(ODD) and scored.filter("score is null or abs(score - 0.5) > 1e-9").count() == 0
    assert pairwise_quality.score(some_docs(spark, []), labels).count() == 0 and pairwise_quality.score(some_docs(spark, []), labels.limit(0)).count() == 0


def lines_left(texts, min_words=4):
    """Every document without the blocks that aligning its stretches with those of its keys' first holders gives: by hand, over all runs."""
    lines = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in texts}
    size = lambda x: len(x.split())
    runs = {}  # of each document: (begin, end) of the shortest runs with enough words that begin or end at a line
    for i, own in lines.items():
        runs[i] = set()
        for k in range(len(own)):
            ahead = next((e for e in range(k + 1, len(own) + 1) if sum(map(size, own[k:e])) >= min_words), None)
            back = next((b for b in range(k, -1, -1) if sum(map(size, own[b : k + 1])) >= min_words), None)
            runs[i] |= ({(k, ahead)} if ahead else set()) | ({(back, k + 1)} if back is not None else set())
    holders = {}
    for i in sorted(runs):
        for b, e in sorted(runs[i]):
            holders.setdefault(tuple(lines[i][b:e]), []).append((i, b))
    shared = {r: at for r, at in holders.items() if len({i for i, _ in at}) > 1}
    stretch = {}  # (document, line) -> the lines around it that lie in shared runs
    for i, own in lines.items():
        inside = {k for b, e in runs[i] if tuple(own[b:e]) in shared for k in range(b, e)}
        for k in inside:
            b, e = k, k + 1
            while b - 1 in inside:
                b -= 1
            while e in inside:
                e += 1
            stretch[i, k] = range(b, e)
    left = {}
    for i, t in texts:
        own, gone = lines[i], set()
        for k in range(len(own)):
            over = [(len(shared[tuple(own[b:e])]), b, e) for b, e in runs[i] if b <= k < e and tuple(own[b:e]) in shared]
            if not over:
                continue
            # of equally frequent runs that begin at one line the first by hash, which a test does not know: all of them
            n, b, _ = min(over)
            for e in [e for m, c, e in over if (m, c) == (n, b)][:1]:
                first, at = shared[tuple(own[b:e])][0]
                if first != i:
                    x, y = list(stretch[first, at]), list(stretch[i, k])
                    gone |= set(line_dedup.align([lines[first][v] for v in x], x, [own[v] for v in y], y, [size(own[v]) for v in y], min_words))
        at = [k for k, x in enumerate(t.split("\n")) if x.strip()]
        rest = [x for k, x in enumerate(t.split("\n")) if k not in {at[g] for g in gone}]
        left[i] = t if not gone else "\n".join(rest) if any(x.strip() for x in rest) else ""
    return left


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(10, 80)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        texts.append((i, "\n".join(parts)))
    texts += [(100, texts[0][1]), (101, "w1"), (102, "w1")]
    # lines of one to three words, of which blocks only exist together; CRLF; copies inside a document
    short = [f"s{k}" + " x" * (k % 3) for k in range(9)]
    texts += [(200 + i, rng.choice(["\n", "\r\n", "\n\n", "  \n\t"]).join(rng.choice(short) for _ in range(rng.randint(1, 14)))) for i in range(120)]
    texts += [(400, "x1 x2\nfoo"), (401, "y1 y2\nbar"), (402, "x1 x2\ny1 y2\nqqq"), (403, "x1 x2\ny1 y2\nrrr"), (404, "a b c d\nz\na b c d\na b c d"), (405, "a b c d\na b c d\nz")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(some_docs(spark, texts)).collect()}
    assert got == lines_left(texts)
    assert got[100] == "" and got[102] == "w1" and got[402] == texts[-4][1] and got[403] == "rrr"


def test_patience_alignment():
    assert line_dedup.patience([1, 2, 3, 4], [0, 1, 2, 9, 4]) == [(0, 1), (1, 2), (3, 4)]
    at = lambda lines: list(range(len(lines)))
    go = lambda a, b, w=4: line_dedup.align(a, at(a), b, at(b), [w] * len(b), 4)
    assert go([1, 2, 3], [3, 1, 2]) == [0, 1, 2] and go([7, 7], [7, 7, 7]) == [0, 1, 2]
    assert go([1, 2, 3, 4], [1, 2, 9, 3, 4], 2) == [0, 1, 3, 4] and go([1, 9, 2], [1, 2], 2) == []


def test_quality_rules_match_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)]
    texts += [(50 + k, f"{prose(rng, 20)}\n" * 3 + prose(rng, 9)) for k in range(5)] + [(60, "a # b $ " * 40)]
    book = quality_rules.apply_policy(quality_rules.ledger(some_docs(spark, texts)), quality_rules.POLICIES[-1])
    got = {r.doc_id: r for r in book.collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 8)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(covered), sum(map(len, w)))
    assert not got[60].kept
    patterns = {(r.version, r.rule): (r.n_failed, r.n_failed_alone) for r in quality_rules.ablation(book).collect()}
    assert patterns["base", "few_words"][0] == sum(r.n_words < 20 for r in got.values())


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 25, 10, 9, 4, 2, 1])]
    texts = []
    for i in range(50):
        t = prose(rng, rng.randint(0, 60)).split()
        if i % 3 == 0:
            w = rng.choice(items)[1].split()
            k = rng.randint(0, max(0, len(w) - 12))
            t[5:5] = w[k : k + rng.randint(8, 14)]
        texts.append((i, " ".join(t).upper()))
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(some_docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=10).collect()}
    for i, t in texts:
        w, hit, ids = t.lower().split(), set(), set()
        for k, item in items:
            v = item.split()
            n = min(10, len(v))
            wanted = {tuple(v[x : x + n]) for x in range(len(v) - n + 1)}
            for x in range(len(w) - n + 1):
                if tuple(w[x : x + n]) in wanted:
                    hit |= set(range(x, x + n))
                    ids.add(str(k))
        assert got[i] == (len(hit), sorted(ids))
    # the other way, and texts of several pieces
    bench = spark.createDataFrame(items, "item_id long, text string")
    long = [(i, " ".join(t for _, t in texts[i : i + 20])) for i in range(30)]
    keyed = some_docs(spark, long).select(F.col("doc_id").alias("_k"), F.col("text").alias("_text"))
    ways = [sorted(map(tuple, decontaminate.matches(keyed, bench, broadcast_limit=n).distinct().collect())) for n in (500_000, 0)]
    expected = set()
    for i, t in long:
        w = t.lower().split()
        for k, item in items:
            v = item.split()
            n = min(10, len(v))
            wanted = {tuple(v[x : x + n]) for x in range(len(v) - n + 1)}
            expected |= {(i, x, n, k) for x in range(len(w) - n + 1) if tuple(w[x : x + n]) in wanted}
    assert ways[0] == ways[1] == sorted(expected)


def test_near_classes_match_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for i in range(25):
        base = prose(rng, rng.randint(30, 120)).split()
        texts.append((len(texts), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append((len(texts), " ".join(copy).upper()))
    # texts that share a long passage, but not enough
    core = prose(rng, 60).split()
    texts += [(200 + k, " ".join(core + [rng.choice(WORDS) for _ in range(14)])) for k in range(90)]
    units = {i: set(near_dedup.units(near_dedup.word_hashes(t)).tolist()) for i, t in texts}
    parent = {i: i for i in units}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in units:
        for b in units:
            s = len(units[a] & units[b])
            if a < b and s >= 0.8 * (len(units[a]) + len(units[b]) - s):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(some_docs(spark, texts)).collect()}
    assert got == {i: find(i) for i in units}


def test_copies_and_case_are_one_class(spark):
    rows = [(3, "One two three"), (1, "one TWO three"), (2, None), (4, ""), (5, "!"), (6, "?"), (None, "one two three")]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(some_docs(spark, rows)).collect()}
    assert got == {3: 1, 1: 1, None: 1, 2: 2, 4: 2, 5: 5, 6: 6}
    assert near_dedup.keep_one(some_docs(spark, rows)).count() == 4


def test_licenses(spark):
    text = "Licensed under the Apache License, Version 2.0. MIT license MIT License; CC BY-NC 4.0. GNU General Public License v3 or later"
    r = licenses.scan(some_docs(spark, [(1, text), (2, None), (3, "nothing here")])).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].base) == (5, 3, ["apache", "cc-by", "gpl", "mit"])
    assert {"apache-2.0", "cc-by-nc-4.0", "gpl-3.0-or-later"} <= set(r[0].labels)
    # "gpl-3.0" lies inside "gpl-3.0-or-later"
    assert "gpl-3.0" not in r[0].labels and r[0].score == 0.75
    assert (r[1].labels, r[1].score, r[2].labels, r[2].n_words) == ([], 0.0, [], 2)
    assert 200 < len(license_rules.RULES) < 300


def test_a_longer_license_of_equal_priority_suppresses(spark):
    cases = {
        "GNU Lesser General Public License": ["lgpl"],
        "GNU Lesser General Public License v3": ["lgpl-3.0"],
        "GNU Affero General Public License version 3 or any later version": ["agpl-3.0-or-later"],
        "Creative Commons Attribution NonCommercial ShareAlike": ["cc-by-nc-sa"],
        "the modified BSD license": ["bsd-3-clause"],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["gpl-2.0-or-later"],
        "SPDX-License-Identifier: LGPL-2.1-only": ["lgpl-2.1"],
        "SPDX-License-Identifier: BSD-3-Clause": ["bsd-3-clause"],
        "Apache-2.0 license": ["apache-2.0"],
        "MPL-2.0 or BSD-3-Clause": ["bsd-3-clause", "mpl-2.0"],
        "LGPL v2.1+": ["lgpl-2.1-or-later"],
        "GPLv3+, GPL 2": ["gpl-2.0", "gpl-3.0-or-later"],
        "version 2 of the GNU GPL": ["gpl"],
        # base labels stay
        "CC BY-NC-SA 4.0": ["cc-by", "cc-by-nc-sa-4.0"],
        # apart from a longer name, a name counts
        "GNU Lesser General Public License, general public license": ["gpl", "lgpl"],
    }
    got = {r.doc_id: r.labels for r in licenses.scan(some_docs(spark, list(enumerate(cases)))).collect()}
    assert got == dict(enumerate(cases.values()))


def license_labels(words):
    """Labels by every rule on the whole line, without pieces and gates."""
    line, found = " " + " ".join(words) + " ", []
    for k, r in enumerate(license_rules.RULES):
        for m in re.finditer(rf"(?<= )(?:{r.regex})(?= )", line):
            start = line[: m.start()].count(" ") - 1
            version = (m[1] or "").replace(" ", ".") if r.versioned else ""
            label = r.label + (f"-{version if '.' in version else version + '.0'}" + ("-or-later" if m[2] else "") if version else "")
            found.append((start, start + len(m[0].split()), 4 if m[0].startswith(license_rules.TAG) else 3 if version else r.priority, k, label))
    holds = lambda a, b: a[0] <= b[0] and a[1] >= b[1] and (a[2] > b[2] or a[2] == b[2] and (a[1] - a[0], -a[3]) > (b[1] - b[0], -b[3]))
    return sorted({d[4] for d in found if not any(holds(x, d) for x in found)})


def test_license_labels_match_brute_force(spark):
    rng = random.Random(17)
    words = "gnu lesser affero general public license gpl v3 or later spdx identifier cc by nc sa 4 0 modified bsd creative commons attribution mpl 2 0 apache mit".split()
    phrases = ["general public license", "cc by nc", "gnu lesser", "or later", "version 2 1", "spdx license identifier", "bsd 3 clause", "in the public domain", "all rights reserved", "filler " * 40]
    texts = []
    for i in range(40):
        n = 40 if i < 36 else 900
        texts.append((i, " ".join(rng.choice(words) if rng.random() < 0.5 else rng.choice(phrases) for _ in range(n))))
    got = {r.doc_id: r for r in licenses.scan(some_docs(spark, texts)).collect()}
    for i, t in texts:
        assert set(got[i].labels) - set(got[i].base) == set(license_labels(t.split())) - set(got[i].base)


def test_every_license_signature_passes_its_gates():
    sample = lambda r: r.regex
    for r in license_rules.RULES:
        # the keyword stands where no alternative can leave it out
        plain = re.sub(r"licen\[cs\]e?", "license", sample(r))
        assert r.keyword.replace("licen", "license").rstrip("e") in plain.replace("licensed", "license") or r.keyword in plain, r
    assert re.search(licenses.GATE, "under the\n mit  license") and not re.search(licenses.GATE, "he comes mit edlyth")


def test_base_scan_matches_brute_force(spark):
    rng = random.Random(13)
    words = "mit license cc by gnu general public apache x é".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for r in licenses.scan(some_docs(spark, texts)).collect():
        w = dict(texts)[r.doc_id].split()
        places = [k for p, _ in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))


def test_preferences(spark):
    schema = "conv_id long, turn long, role string, text string, chosen string"
    rows = [(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", "q", ""), (2, 1, "assistant", "bad", ""), (3, 0, None, None, ""), (1, 1, "assistant", "good", ""), (None, None, "user", "z", "")]
    got = {r.pair_id: r for r in preferences.formatted(preferences.pairs(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 2, 3, None} and got[2].chosen_id == 1 and got[2].n_prompt_turns == 1
    assert got[2].prompt == "<|user|>\nq\n<|end|>\n"
    assert [(x["text"], x["mask"]) for x in got[2].rejected] == [("<|assistant|>\nbad\n<|end|>\n", 1)]
    assert [x["text"] for x in got[1].rejected] == ["<|assistant|>\n\n<|end|>\n"]
    assert preferences.pairs(spark.createDataFrame([], schema)).count() == 0


def test_preferences_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string, pair_id long, mask int"
    long = "word " * 100_000
    rows = [(1, 0, "user", long, "p", 9, 1), (1, 1, "assistant", long, None, None, None), (2, 0, "user", long, "p", 9, 1), (2, 1, "assistant", "x", None, None, None)] + [(3, 0, "user", None, None, None, None)] * 2
    got = {r.pair_id: r for r in preferences.formatted(preferences.pairs(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, 2, 3} and got[2].n_prompt_turns == 1 and got[2].rejected[0]["text"].count("x") >= 1 and len(got[1].chosen[0]["text"]) > 500_000


def test_pieces_are_the_library_s(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(17)
    alphabet = [" ", "  ", "\n", "\t", "▁", "a", "the", "ing", "é", "漢", "🙂", "1", ".", ",", "'s", "<s>", "<0x41>", "\x00", "aaa", "Hello"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [" " * n + "x" for n in range(40)]
    rows = [*enumerate(texts), (-1, None), (-2, ""), (-3, "long text. " * 50_000)]
    coded = pieces.encode(some_docs(spark, rows), path, keep=["doc_id", "text"])
    for r in pieces.decode(coded, path).collect():
        ids = sp.encode(r.text or "") + [sp.eos_id()]
        assert list(r.ids) == ids and r.decoded == sp.decode(ids)


def test_cache_and_slices_do_not_change_ids(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    v = pieces.load(tokenizers.path("piece_bpe_32k.model"))
    whole, small = pieces.Coder(v), pieces.Coder(v)
    texts = [f"Ersh{k} theated onreing. ouwhthe" for k in range(50)]
    a = [whole.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    assert [small.encode(t) for t in texts] == a


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Big &amp; news</h1><p>The first   paragraph tells what happened on the day.<p>A second one follows, and it is as long as the first.</article><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(i, f"http://h/{i}", PAGE.replace("day", f"day {i}"), "clash") for i in range(30)] + [(100, None, None, ""), (101, "u", "", ""), (None, "u", "<p", "")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, schema)).collect()}
    assert got[3] == "Big & news\nThe first paragraph tells what happened on the day 3.\nA second one follows, and it is as long as the first."
    assert got[100] == got[101] == ""
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0


#: Pages written by hand, in layouts that training does not make, with the article's text.
BY_HAND = [
    ("""<body><div id="masthead"><a href=/>The Daily</a></div><div class="nav-menu"><a href=1>World</a> <a href=2>Sport</a></div>
    <div class="story-body"><h1>Bridge opens</h1><p>The bridge opened on Monday after two years of work on its piers.</p><div class="advert-box"><p>Save 20% now!</p></div>
    <p>Engineers said that it would carry <a href=x>more than</a> 9,000 cars a day.</p></div><div class="comments-area"><h3>Comments</h3><p>Great news for all of us who live on the other side.</p></div>
    <div id="footer">&copy; 2024 The Daily</div></body>""", ["Bridge opens", "The bridge opened on Monday after two years of work on its piers.", "Engineers said that it would carry more than 9,000 cars a day."]),
    ("""<main><article><header><h1>Soup</h1></header><p>Cut the onions and let them sweat in butter until they are soft and clear.<ul><li>Two onions and a spoon of flour.<li>A litre of stock, hot.</ul></article></main>
    <aside class=related><h4>More recipes</h4><a href=a>Bread</a></aside><form><label>Search</label><input></form>""",
     ["Soup", "Cut the onions and let them sweat in butter until they are soft and clear.", "Two onions and a spoon of flour.", "A litre of stock, hot."]),
    ("""<table class=layout><tr><td class=sidebar><a href=1>Home</a><a href=2>Archive</a></td><td class=content><h2>Notes on rivers</h2><blockquote>A river is never the same twice, as the old saying has it.</blockquote>
    <p>The water rose by two metres in the night, and the fields on both banks were under it by morning.</p></td></tr></table><p class=copyright>All rights reserved.</p>""",
     ["Notes on rivers", "A river is never the same twice, as the old saying has it.", "The water rose by two metres in the night, and the fields on both banks were under it by morning."]),
]


def test_html_pages_by_hand():
    model = html_extract.train([])
    right = wrong = missed = 0
    for page, expected in BY_HAND:
        got = html_extract.main_text(page, model).split("\n")
        right += len(set(got) & set(expected))
        wrong += len(set(got) - set(expected))
        missed += len(set(expected) - set(got))
    assert 2 * right / (2 * right + wrong + missed) >= 0.9


def test_html_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, features int"
    long = "<article>" + "".join(f"<p>Paragraph {k} has a few words of its own.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", long, "", 1), (2, None, PAGE, None, None), (2, None, PAGE, None, None), (None, None, None, None, None), (3, "u", "<<<>>< p", "x", 1)]
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 5 and texts[1].count("\n") == 19_999 and texts[None] == "" and got[0].page_id == 1


def test_training_keeps_long_pages_whole():
    many = "<body><nav><a href=1>Home</a></nav><article>" + "".join(f"<p>Sentence number {k} of this long article.</p>" for k in range(400)) + "</article><footer>End</footer></body>"
    model = html_extract.train([many], layouts=40)
    assert html_extract.main_text(many, model).count("\n") == 399


def test_html_layouts_held_out():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40))).capitalize() + "." for _ in range(300)]
    pages = [html_extract.laid_out(rng.sample(texts, 6), texts, rng) for _ in range(260)]
    model = html_extract.fit(pages[:200], steps=120)
    wrong = sum(a != b for found, labels in pages[200:] for a, b in zip(model.decode(found), labels))
    assert wrong < 0.03 * sum(len(labels) for _, labels in pages[200:])


def test_ranking_separates_held_out_documents(spark):
    rng = random.Random(19)
    good = [(i, prose(rng, rng.randint(30, 120))) for i in range(150)]
    bad = [(1000 + i, " ".join(f"{rng.choice(WORDS)}###" for _ in range(60))) for i in range(50)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad], "doc_id long, quality int")
    scored = pairwise_quality.score(some_docs(spark, good + bad + [(5000, None)]), labels, held_out=F.col("doc_id") % 4 == 2).collect()
    right = [r.predicted == int(r.doc_id < 1000) for r in scored if r.doc_id < 5000]
    assert len(scored) == 201 and sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in scored)


def test_ranking_is_no_worse_than_any_other():
    import numpy as np

    rng = np.random.default_rng(23)
    x = rng.normal(size=(120, 5)) * [1, 2, 0.5, 3, 1]
    y = (x @ [1.0, -0.7, 2.0, 0.1, 0.0] + rng.normal(size=120) > 0.3).astype(int)
    pairs = lambda w: np.mean([(a - b) @ w > 0 for a in x[y == 1] for b in x[y == 0]])
    loss = lambda w: np.mean([np.log1p(np.exp(-(a - b) @ w)) for a in x[y == 1] for b in x[y == 0]])
    w = np.array(pairwise_quality.fit(x, y).weights)
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in rng.normal(size=(60, 5)) * 0.3)
    assert all(pairs(w) >= pairs(d) for d in rng.normal(size=(40, 5)))


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, key string"
    long, other = "<p>é" + "x" * 1500, "<p>" + "y\r\n\r\n" * 400
    rows = [(1, "http://a.example.com/x?q=1#f", long, ""), (2, "https://user@b.example.com:80/", long, ""), (3, None, None, ""), (4, "http://a.example.com/x?q=1", "short", ""), (5, "u", "short", ""), (6, "\"\n\\", other, ""), (7, "http://a.example.com/x?q=1#f", long, "")]
    rows += [(100 + k, f"http://hot.example.com/{k % 7}", f"page {k}", "") for k in range(900)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    for i, url, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert got[i].url == (url or "")
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 7, 4, 5)] == [("revisit", 7), ("revisit", 7), ("response", None), ("response", None), ("response", None)]
    assert {i: (got[i].html if got[i].record_type == "response" else None) for i, *_ in rows} == {i: (html or "") if i not in (1, 2) else None for i, _, html, _ in rows}
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_odd_rows(spark):
    schema = "page_id long, url string, html string"
    same, big = "s" * 1200, random.Random(4).randbytes(9_000_000).hex()
    rows = [(None, "u", same), (None, "v", same), (5, "u", same), (5, "u", same), (7, "w", big), (8, "w", None), (8, "w", ""), (None, None, "t" * 2000), (None, None, "t" * 2000)]
    got = [tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect()]
    kinds = sorted((r[0] is None, r[0] or 0, r[2], r[4], r[5] is None, r[5] or 0) for r in got)
    assert kinds == sorted([
        (True, 0, 1200, "revisit", False, 5), (True, 0, 1200, "revisit", False, 5), (False, 5, 1200, "revisit", False, 5), (False, 5, 1200, "response", True, 0),
        (False, 7, 18_000_000, "response", True, 0), (False, 8, 0, "response", True, 0), (False, 8, 0, "response", True, 0), (True, 0, 2000, "response", True, 0), (True, 0, 2000, "revisit", True, 0),
    ])
    assert next(r[6] for r in got if r[0] == 7) == big


def test_warc_records_are_valid():
    row = {"page_id": 3, "url": "http://h/a b", "html": "<p>é", "record_type": "response", "payload_digest": "d", "_row": 0, "refers_to": None, "_refers_row": None}
    raw = warc.record(row, "2024-01-01T00:00:00Z")
    head, payload = warc.parse(raw)
    assert payload == "<p>é".encode() and raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= head.keys() and head["WARC-Target-URI"] == "http://h/a%20b"
    block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
    assert len(block) == int(head["Content-Length"]) and block.startswith(b"HTTP/1.1 200 OK\r\n")
    again, empty = warc.parse(warc.record(row | {"record_type": "revisit", "refers_to": 9, "_refers_row": 4}, "2024-01-01T00:00:00Z"))
    assert empty == b"" and again["WARC-Refers-To"] == warc._record_id(9, "d", 4) and again["X-Refers-To-Page-ID"] == "9"


def test_capture_index_finds_keys_that_span_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_ENTRIES", 700)
    rows = [(k % 40, f"http://h.org/{k % 3}", f"page {k}") for k in range(4000)] + [(9000, "http://a.org", "only")]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    index = warc.build_index(spark, path)
    assert len(index.tops) > 3 and index.entries == len(rows)
    wanted = spark.createDataFrame([("org,h)/1", "7"), ("org,a)/", "9000"), ("org,a)/", "1"), ("", ""), ("zzz", "1")], "key string, page string")
    found = warc.read_ranges(warc.look_up(index, wanted)).collect()
    expected = sorted(h for i, u, h in rows if (i, u) == (7, "http://h.org/1") or i == 9000)
    assert sorted(r.html for r in found) == expected


def test_reversed_host_keys(spark):
    keys = spark.createDataFrame([("https://www.Example.com:8080/a?b#c",), ("http://x.org",), (None,)], "url string").select(warc.url_key(F.col("url"))).collect()
    assert [r[0] for r in keys] == ["com,example,www)/a?b", "org,x)/", ")/"]


def test_tables_of_the_shared_folder_are_cleared(spark):
    from quarry.llm import common

    path = common.written(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
    assert open(path, "rb").read(4) == b"PAR1"
    common.clear(spark)
    with pytest.raises(FileNotFoundError):
        open(path, "rb")


def test_row_keys_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", "z", "s", 1), (1, "a b c d e f", "b", "s", 1), (2, None, "x", "s", 0), (3, "", None, None, None), (None, "a b c d e f", "q", "s", 1)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [(1, "a b c d e f", "b", "s", 1), (2, None, "x", "s", 0)]
    keys = spark.createDataFrame([(1, "1"), (11, ""), (None, "-"), (1, None), (1, "")], "i long, t string").select(common.row_key(F.col("i"), F.col("t"))).collect()
    assert len({bytes(k[0]) for k in keys}) == 4


def test_word_hashes_lower_a_to_z_only():
    from quarry.llm import near_dedup

    one = lambda word: int(near_dedup.word_hashes(word)[0])
    assert one("ABCxyz9") == one("abcxyz9") and one("ÉcolE") == one("École") == one("ÉCOLE".replace("COLE", "cole"))
    assert len({one(w) for w in ("École", "école", "Kelvin", "kelvin", "İx", "ix")}) == 6
