"""Ranked search and passages of test items against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import decontamination, ranked_search

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in TERM.findall(text or "")]


def sample(seed=3, docs=400, items=25):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(2_000)] + ["Straße", "ÉCOLE", "école", "A1", "a1"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(n))

    asked = [(i, text(rng.randrange(1, 40))) for i in range(items)]
    asked += [(100, None), (101, "..."), (102, "unheardof"), (103, "w1 w1 w1"), (None, asked[0][1]), (3, asked[3][1])]
    rows = [(i, text(rng.randrange(0, 120))) for i in range(docs)]
    rows += [(1_000 + i, rows[5][1]) for i in range(60)] + [(2_000, text(20_000)), (2_001, None), (2_002, ""), (5, rows[5][1]), (None, rows[9][1])]
    for i in range(0, docs, 9):
        _, passage = asked[i % items]
        rows.append((3_000 + i, f"{text(30)} {passage.upper()} {text(5)} {' '.join(passage.split()[:12])}"))
    return rows, asked


# ---------------------------------------------------------------- ranked search


def brute_ranks(rows, asked, top=10):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in asked:
        scored = []
        for d, c, n in counts:
            m = 25 + 75 * n * n_docs // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def ranks(docs, asked, **options):
    found = ranked_search.rank_documents(docs, asked, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("tree, leaf, pass_terms", [(8192, 32, 500_000), (64, 2, 500_000), (100, 8, 40)])
def test_ranks_against_brute_force(spark, monkeypatch, tree, leaf, pass_terms):
    monkeypatch.setattr(ranked_search, "TREE", tree)
    monkeypatch.setattr(ranked_search, "LEAF", leaf)
    rows, asked = sample()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert ranks(docs, spark.createDataFrame(asked, ITEMS), pass_terms=pass_terms) == brute_ranks(rows, asked)


def test_ranks_of_empty_tables_and_other_columns(spark):
    docs, asked = spark.createDataFrame([(1, "a b"), (2, "b")], DOCS), spark.createDataFrame([(1, "b")], ITEMS)
    assert ranks(docs.limit(0), asked) == [] == ranks(docs, asked.limit(0))
    assert ranks(docs, spark.createDataFrame([(1, "c"), (2, None)], ITEMS)) == []
    odd = spark.createDataFrame([(1, "a b", 3, 4, "x"), (2, "b", 3, 4, "x")], "id long, body string, n int, item int, terms string")
    odd_items = spark.createDataFrame([("q", "a", 1)], "name string, body string, rank int")
    got = ranked_search.rank_documents(odd, odd_items.withColumnRenamed("name", "item_id"), doc_id="id", text="body").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, 1)]


def blocks(seed, n):
    rng = random.Random(seed)
    vectors = [np.array(sorted(rng.sample(range(40), rng.randrange(1, 12))), np.int32) for _ in range(n)]
    return [(i, rng.randrange(25, 400), v, np.array([rng.randrange(1, 6) for _ in v])) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("seed", range(4))
def test_a_tree_leaves_out_only_what_cannot_rank(monkeypatch, seed):
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    rows = blocks(seed, 500) + [(1_000 + i, 99, np.arange(5, dtype=np.int32), np.ones(5, np.int64)) for i in range(50)]
    ids, m, vectors, tfs = zip(*rows, strict=True)
    tree = ranked_search.Tree(np.array(ids), np.array(m), list(vectors), list(tfs))
    leaves = [r for r, (a, b) in zip(tree.ranges, tree.children, strict=True) if a == b]
    assert sorted(i for lo, hi in leaves for i in range(lo, hi)) == list(range(len(rows)))
    asked, weights = np.array([0, 3, 17, 22, 39, 77]), np.array([5, 900, 1200, 0, 2500, 10])
    tree.look_for(asked)
    best, scored = tree.search(asked, weights, 10)
    want = []
    for i, length, v, tf in rows:
        score = sum(int(w) * (10**9 * int(tf[list(v).index(t)]) // (1000 * int(tf[list(v).index(t)]) + 8 * length)) for t, w in zip(asked, weights) if t in v)
        want += [(-score, i)] if score else []
    assert [(-s, i) for s, i in best] == sorted(want)[:10]
    assert scored < len(rows) / 2


# ---------------------------------------------------------------- passages of test items


def brute_hits(rows, asked, window=10):
    grams = {}
    for item, text in asked:
        w = terms(text)
        if w:
            for s in range(max(1, len(w) - window + 1)):
                grams.setdefault(tuple(w[s : s + window]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, items = terms(t), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                g = tuple(w[s : s + n])
                if g in grams:
                    hit |= set(range(s, s + n))
                    items |= grams[g]
        out.append((d, len(w), len(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=str)


def hits(docs, asked, **names):
    found = decontamination.contamination(docs, asked, **names)
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str)


def test_hits_against_brute_force(spark):
    rows, asked = sample(8)
    asked += [(200, "w1"), (201, "w1 w2"), (202, "w3, W1 w1")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert hits(docs, spark.createDataFrame(asked, ITEMS)) == brute_hits(rows, asked)


def test_hits_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rows, asked = sample(9, docs=60, items=6)
    assert hits(spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS)) == brute_hits(rows, asked)


def test_hits_of_empty_tables_and_other_columns(spark):
    docs, asked = spark.createDataFrame([(1, "a b"), (2, None)], DOCS), spark.createDataFrame([(1, "B")], ITEMS)
    assert hits(docs.limit(0), asked) == []
    assert hits(docs, asked.limit(0)) == [(1, 2, 0, []), (2, 0, 0, [])]
    odd = spark.createDataFrame([(1, "a b", 3, 4, "x")], "id long, body string, row int, pos int, term string")
    odd_items = spark.createDataFrame([("q", "b", 1)], "name string, body string, window int")
    assert hits(odd, odd_items, doc_id="id", item_id="name", text="body") == [(1, 2, 1, ["q"])]


def test_repeated_document_rows_stay_apart(spark):
    docs = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (1, "q")], DOCS)
    assert hits(docs, spark.createDataFrame([(4, "y z"), (4, "y z")], ITEMS)) == [(1, 1, 0, []), (1, 3, 2, ["4"]), (1, 3, 2, ["4"])]


@pytest.mark.parametrize("within", [1, 3, 8])
def test_near_matches_against_brute_force(spark, within):
    rng = random.Random(within)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    asked = [(1, "a b c"), (2, "d d"), (3, "e"), (4, "f g h a b"), (5, "h zz")]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ITEMS)
    windows = decontamination.test_windows(items)
    index = decontamination.build_index(docs, windows.terms)
    near = decontamination.near_matches(index, windows, within)
    named = near.join(decontamination.documents(index), "row").join(windows.holders, "window")
    got = sorted((r["item_id"], r["doc_id"], r["pos"]) for r in named.collect())
    seen = Counter(w for _, t in rows for w in t.split())
    want = []
    for item, text in asked:
        w = text.split()
        if any(not seen[t] for t in w):
            continue
        rarest = min(range(len(w)), key=lambda k: (seen[w[k]], k))
        for d, t in rows:
            doc = t.split()
            for p, word in enumerate(doc):
                around = set(doc[max(0, p - within) : p + within + 1])
                if word == w[rarest] and set(w) <= around:
                    want.append((item, d, p + 1))
    assert got == sorted(want)
