"""The manifest, the removal of repeated byte strings and the periodic runs: brute force, SQL, odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import duck, rows
from pyspark.sql import functions as F

from quarry.llm import merkle, oracles, periodic_runs, queries, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, tree string, at int, grp int"


def some_docs(spark, rows):
    return spark.createDataFrame([(i, t, g, None, n, "clash", "x", 1, 1) for i, t, g, n in rows], DOCS)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*(field(x) for x in (r[0], None, r[2], None if r[3] is None else r[3] + add, r[1])))


def tree(nodes, arity):
    """The root, and for each node its place and its siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = nodes[at[k] // arity * arity : at[k] // arity * arity + arity]
            place = at[k] % arity
            paths[k].append((place, run[:place] + run[place + 1 :]))
            at[k] //= arity
        nodes = [H(*nodes[b : b + arity]) for b in range(0, len(nodes), arity)]
    return nodes[0], paths


def manifest_by_hand(docs, arity):
    langs = sorted({r[2] for r in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted((r for r in docs if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (mine, *tree([leaf(r) for r in mine], arity))
    root, above = tree([trees[g][1] for g in langs], arity)
    found = []
    for g, end in zip(langs, above):
        mine, subroot, paths = trees[g]
        for r, path in zip(mine, paths):
            h = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for place, others in path + end:
                h = H(*others[:place], h, *others[place:])
            found.append((r[0], leaf(r), subroot, root, H(*(x for _, others in path + end for x in others)), h, h == root))
    return sorted(found, key=repr)


@pytest.mark.parametrize(("arity", "levels"), [(2, 12), (2, 2), (3, 1), (5, 3)])
def test_manifest_matches_brute_force(spark, arity, levels):
    """Blocks of a few nodes, so that there are many tiers; null and repeated ids, a lone leaf, a null group."""
    rng = random.Random(4)
    docs = [(rng.choice([i, i, None, 7]), rng.choice(["x", "é" * i, None, ""]), rng.choice(["en", "en", "en", "de", "zz", None]), rng.choice([None, i])) for i in range(90)]
    docs.append((900, "lone", "aa", 3))
    more = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.manifest(some_docs(spark, docs), {"n_chars": F.when(more, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, arity=arity, levels=levels)
    got = made.collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == manifest_by_hand(docs, arity)
    for r in got:  # the whole proof leads from the leaf to the root
        assert merkle.fold(bytes.fromhex(r.leaf), merkle.unpacked(bytes(r.proof))).hex() == r.root


def test_manifest_equals_sql(spark):
    ours, theirs = queries.op11_merkle_manifest(spark, SF).toPandas(), duck(SF).sql(oracles.OP11).df()
    assert rows(ours).equals(rows(theirs)) and 0 < ours.verified.sum() < len(ours)


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(some_docs(spark, [])).collect() == []
    one = merkle.manifest(some_docs(spark, [(None, "x" * 300_000, None, None)])).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].verified and one[0].proof_sha256 == H()


def test_time_forward_sweeps():
    """The heap of the upward sweep holds a path; the downward one gives every proof, last leaf first."""
    for n in (1, 2, 3, 7, 8, 9, 31):
        nodes = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        made = merkle.rise(nodes, 5, 2, True)
        root, paths = tree([x.hex() for x in nodes], 2)
        assert made[-1][0].hex() == root
        proofs = list(merkle.sink(made, [], 2))[::-1]
        assert [[(p, [o.hex() for o in others]) for p, others in proof] for proof in proofs] == paths
        assert all(merkle.unpacked(merkle.packed(p)) == p for p in proofs)


# Repeated byte strings


def cut_by_hand(docs, length):
    first, texts = {}, [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in docs]
    for i, b in texts:
        for at in range(len(b) - length + 1):
            w = b[at : at + length]
            first[w] = min(first.get(w, i), i)
    found = []
    for (i, b), (doc_id, *_) in zip(texts, docs):
        gone = bytearray(len(b))
        for at in range(len(b) - length + 1):
            if first[b[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        found.append((doc_id, len(b), sum(gone), tuple(spans), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(found, key=repr)


def cut(spark, docs, **more):
    made = suffix_dedup.cut(some_docs(spark, docs), **more).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in made), key=repr)


def shared_passages(seed, n, letters):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(400)) for _ in range(3)]
    docs = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(5)):
            b, at = rng.choice(base), rng.randrange(300)
            text += b[at : at + rng.randrange(120)] + "".join(rng.choice("abcdefgh ü") for _ in range(rng.randrange(80)))
        docs.append((rng.choice([i, i, i, None, 5]), text, None, None))
    return docs


def test_cut_matches_brute_force(spark):
    """Shared passages, copies, letters of two bytes, a repeated and a null id, one character only, texts around the limit."""
    docs = shared_passages(1, 100, "ab é") + [(1, None, None, None), (2, "", None, None)]
    docs += [(i, "x" * n, None, None) for i, n in ((3, 2000), (4, 49), (6, 50), (6, 50), (300, 3000))] + [(400, "y" * 60 + "\0" * 80, None, None), (401, "\0" * 90, None, None)]
    expected = cut_by_hand(docs, 50)
    assert cut(spark, docs) == expected and sum(r[2] for r in expected) > 1000
    assert cut(spark, docs, hot=0) == expected  # every minimizer's stretches are dealt as single windows
    few = docs[:40]
    assert cut(spark, few, min_length=20, gram=9) == cut_by_hand(few, 20)


def test_cut_in_small_shares(monkeypatch):
    """Bounds of what is sorted and hashed at once change nothing."""
    rng = random.Random(3)
    texts = list({"".join(rng.choice("ab") for _ in range(rng.randrange(12, 40))).encode() for _ in range(60)})
    ids = suffix_dedup.np.array([rng.randrange(50) for _ in texts])
    whole = [f.tolist() for f in suffix_dedup._first_ids(texts, ids, 12)]
    for t, found in zip(texts, whole):
        assert found == [min(i for u, i in zip(texts, ids.tolist()) if t[at : at + 12] in u) for at in range(len(t) - 11)]
    monkeypatch.setattr(suffix_dedup, "SORTED", 20)
    assert [f.tolist() for f in suffix_dedup._shared_out(texts, ids, 12)] == whole
    data = suffix_dedup.np.frombuffer("".join(rng.choice("abc") for _ in range(5000)).encode(), suffix_dedup.np.uint8)
    ends = suffix_dedup.np.array([0, 700, 710, 710, 2500, 5000])

    def windows():
        found = zip(*(x.tolist() for x in suffix_dedup.stretches(data, ends, 50, 24)))
        return sorted((doc, begin + k, h) for doc, begin, count, h in found for k in range(count))

    once = windows()
    assert [w[:2] for w in once] == [(d, at) for d, b, e in ((1, 0, 700), (4, 710, 2500), (5, 2500, 5000)) for at in range(b, e - 49)]
    monkeypatch.setattr(suffix_dedup, "PIECE_BITS", 8)
    assert windows() == once


def test_bounded_prefixes_match_sorted_suffixes():
    rng = random.Random(5)
    for size, length in ((200, 3), (300, 50), (1, 5)):
        text = "".join(rng.choice("ab") for _ in range(size)) * 2
        data = suffix_dedup.np.frombuffer(b"\xff" + text.encode() + b"\xff", suffix_dedup.np.uint8)
        order = suffix_dedup.sorted_suffixes(data, length)
        marks = suffix_dedup.short_prefixes(data[order - 1], length)
        tails = [bytes(data[x:]) + b"\0" * 64 for x in order.tolist()]
        assert all(a[:length] <= b[:length] for a, b in zip(tails, tails[1:]))
        for k in range(1, len(tails)):
            if order[k] + length <= len(data) and order[k - 1] + length <= len(data):
                assert marks[k] == (tails[k][:length] != tails[k - 1][:length])


def test_cut_of_odd_tables(spark):
    assert cut(spark, []) == []
    long = "".join(random.Random(6).choice("abcd ") for _ in range(1_200_000))  # longer than what is hashed at once
    got = {r[0]: r for r in cut(spark, [(1, long, None, None), (2, long[5:] + "q", None, None)])}
    assert got[1][2] == 0 and got[2][1:4] == (len(long) - 4, len(long) - 5, ((0, len(long) - 5),)) and got[2][4] == b"q"


# Periodic runs


def runs_by_hand(w):
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, s = j - i + q, w[i : j + q]
            if j > i and length >= max(6, 4 * q) and not any(s[p:] == s[: length - p] for p in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found)


def collapsed(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_text(rng, most=260):
    letters = rng.choice([1, 2, 3, 10])
    w = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(most))]
    for _ in range(rng.randrange(4)):
        unit, at = [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(1, 20))], rng.randrange(len(w) + 1)
        w[at:at] = (unit * rng.randrange(1, 12))[: rng.randrange(1, 120)]
    return w


def joined(docs):
    """Runs from fragments, stitched by hand."""
    found, runs = defaultdict(set), defaultdict(list)
    for k, q, lo, hi in periodic_runs.fragments([periodic_runs.coded(w) for w in docs]):
        found[k, q].add((lo, hi))
    for (k, q), parts in found.items():
        done = []
        for lo, hi in sorted(parts):
            if done and done[-1][1] >= lo:
                done[-1][1] = max(hi, done[-1][1])
            else:
                done.append([lo, hi])
        runs[k] += [(lo, hi - lo + q, q) for lo, hi in done if hi - lo + q >= max(6, 4 * q)]
    return [sorted(runs[k]) for k in range(len(docs))]


@pytest.mark.parametrize("tile", [4096, 16, 40])
def test_runs_match_brute_force(monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    rng = random.Random(tile)
    docs = [periodic_text(rng) for _ in range(80)]
    assert joined(docs) == [runs_by_hand(w) for w in docs]


def test_z_function():
    rng = random.Random(1)
    for _ in range(50):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        direct = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic_runs.z_function(s, 25) == direct[:25]


def test_runs_of_long_and_odd_documents(spark):
    """Tiles that other tasks solve give the runs of those solved in place; nulls, empty and repeated rows, clashing names."""
    rng = random.Random(2)
    texts = [(k, " ".join(periodic_text(rng)), None, None) for k in range(25)]
    unit = [f"u{k}" for k in range(1500)]
    texts += [(50, " ".join(unit * 9), None, None), (51, "a " * 20_000, None, None), (None, "b b b\tb b\n b", None, None), (60, None, None, None), (61, " \n ", None, None), (62, "c " * 7, None, None), (62, "c " * 7, None, None)]
    expected = []
    for i, t, *_ in texts:
        w = (t or "").split()
        runs = [(0, 13_500, 1500)] if i == 50 else [(0, 20_000, 1)] if i == 51 else runs_by_hand(w)
        expected.append((i, len(w), tuple(runs), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    for spread in (periodic_runs.SPREAD, 200):
        got = periodic_runs.periodic(some_docs(spark, texts), spread=spread).collect()
        assert sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed_sha256) for r in got), key=repr) == sorted(expected, key=repr)
        assert all(r.collapsed is None or hashlib.sha256(r.collapsed.encode()).hexdigest() == r.collapsed_sha256 for r in got)
    assert periodic_runs.periodic(some_docs(spark, [])).collect() == []


def test_runs_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue  # too slow by hand
        runs = runs_by_hand(w)
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2])) if runs else (None,) * 3
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
