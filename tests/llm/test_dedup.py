"""Exact and near duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, paragraph_dedup, simhash
from palimpsest.llm.components import components

DOCS = "doc_id long, text string, lang string"
CASES = [
    (1, "a b", "x"),
    (2, "a b", None),
    (2, "a b", "y"),
    (3, None, "x"),
    (4, "", "x"),
    (None, "a b", "x"),
    (5, "a b ", "x"),
    (None, None, None),
    (6, "long " * 30_000, "x"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for d in ids:
            kept = d == top and first
            first = first and not kept
            out.append((d, top, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)])
def test_exact_duplicates(spark, digest):
    rows = CASES + [(10 + i, f"text {i % 7}", "z") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    found = exact_dedup.exact_duplicates(docs, digest=digest)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()]
    assert sorted(got, key=str) == sorted([r[:4] for r in brute_exact(rows)], key=str)
    kept = exact_dedup.drop_duplicates(docs, digest=digest).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == sorted(
        (d, t) for d, t in {(r[0], r[4]) for r in brute_exact(rows) if r[3]} for d, t in [(d, next(
            x[1] for x in rows if x[0] == d and hashlib.sha256((x[1] or "").encode()).hexdigest() == t))] if d
    )
    assert len(kept) == len({t or "" for _, t, _ in rows})


def test_exact_of_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).columns == empty.columns
    names = ["digest", "keep_id", "kept", "salt", "variants", "top_rows", "row"]
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    assert {r.kept for r in exact_dedup.exact_duplicates(docs).collect()} == {True, False}
    assert [r.asDict() for r in exact_dedup.drop_duplicates(docs).collect()] == [
        {"doc_id": 2, "text": "a"} | dict.fromkeys(names, "mine")
    ]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_fingerprints_and_components_of_documents(spark):
    base = [f"w{i * 7 % 41} x{i * 3 % 17}" for i in range(60)]
    rows = [(i, " ".join(base[: 40 + i % 5] + [f"end{i}"] * (i % 3)), "x") for i in range(1, 30)]
    rows += [(40, None, "x"), (41, "", "x"), (42, "\n\t ", "x"), (43, "One TWO", "x"), (44, "one two", "x"), (44, "one two", "x")]
    rows += [(45, "é É ñ Ñ", "x"), (46, "word " * 40_000, "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "component_id": F.lit("mine"), "cell": F.lit(2)})
    got = simhash.simhash_components(docs).select("doc_id", simhash.hex_of(F.col("fp")).alias("fp"), "component_id").collect()
    prints = {d: brute_fingerprint(t) for d, t, _ in rows}
    assert {(r.doc_id, r.fp) for r in got} == {(d, f"{p:016x}") for d, p in prints.items()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert len(got) == len(rows)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(want.values())


def test_one_row_stays_of_near_duplicates_that_repeat_an_id(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "x"), (1, text, "y"), (2, text, "x"), (3, "other words here now", "x"), (3, "quite something else again", "x")]
    rows += [(None, None, "x"), (None, "", "y"), (7, " ", "z"), (None, "lonely row of its own", "x")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"__first": F.lit(1), "row": F.lit(2), "version": F.lit(3), "first_id": F.lit(4)})
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert found == sorted([(1, text), (3, rows[3][1]), (3, rows[4][1]), (7, " "), (None, "lonely row of its own")], key=str)
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [4096, 8])
def test_links_of_fingerprints_in_balls_and_chains(spark, block):
    import random

    rnd = random.Random(5)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        centre = rnd.getrandbits(64)
        prints |= {centre ^ sum(1 << rnd.randrange(64) for _ in range(0)) for _ in range(1)}
        at = centre
        for _ in range(15):
            for bit in rnd.sample(range(64), rnd.choice([1, 2, 3, 4])):
                at ^= 1 << bit
            prints.add(at)
        prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in [rnd.sample(range(64), 2) for _ in range(20)]}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = components(simhash.similar_links(nodes, block)).collect()
    got = defaultdict(set)
    for r in found:
        got[r.component].add(r.node)
    want = defaultdict(set)
    for node, top in brute_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3).items():
        want[top].add(signed(node))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_paths_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(50)] + [(9, 9), (None, 3), (20, 10), (10, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {300 + i: 7 for i in range(50)} | {7: 7, 10: 10, 20: 10}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def passage(seed, n=60):
    return " ".join(f"p{seed}w{i * 13 % 59}" for i in range(n))


def test_repeated_passages(spark):
    close = passage(1).split()
    close[30] = "other"
    rows = [
        (1, "intro one\n" + passage(1) + "\nend", "x"),
        (2, "intro two\n" + " ".join(close) + "\nend", "x"),
        (3, passage(2) + "\n" + passage(2), "x"),
        (4, passage(3) + "\n" + passage(1) + "\n" + passage(4), "x"),
        (5, passage(3), "x"),
        (6, "short line\nshort line", "x"),
        (7, "short line", "x"),
        (8, None, "x"),
        (9, "", "x"),
        (None, passage(1), "x"),
        (4, passage(3) + "\n" + passage(1) + "\n" + passage(4), "x"),
        (10, " ".join(f"u{i}." for i in range(30_000)), "x"),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"node": F.lit(1), "spans": F.lit(2), "left": F.lit(3), "version": F.lit(4)})
    found = paragraph_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.nth, r.keep_id, r.removed) for r in found} == {
        (1, 0, 1, False), (2, 0, 1, True), (4, 1, 1, True), (4, 0, 4, False), (5, 0, 4, True),
    }
    left = paragraph_dedup.drop_repeated_passages(docs)
    assert left.columns == docs.columns
    texts = defaultdict(list)
    for r in left.collect():
        texts[r.doc_id].append(r.text)
    assert texts[2] == ["intro two\nend"]
    assert texts[4] == [passage(3) + "\n" + passage(4)] * 2
    assert 5 not in texts
    untouched = {1, 3, 6, 7, 8, 9, 10, None}
    assert {d: t for d, t in texts.items() if d in untouched} == {d: [t] for d, t, _ in rows if d in untouched}
    empty = spark.createDataFrame([], DOCS)
    assert paragraph_dedup.drop_repeated_passages(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_similar_paragraphs_against_brute_force(spark, block):
    import random

    rnd = random.Random(3)
    rows = []
    for family in range(4):
        base = [f"f{family}t{i}" for i in range(40)]
        for copy in range(9):
            words = list(base)
            for place in rnd.sample(range(40), copy % 4):
                words[place] = f"c{copy}x{place}"
            rows.append((100 * family + copy, " ".join(words), "x"))
    sets = {d: set(zip(*[t.split()[k:] for k in range(5)])) for d, t, _ in rows}
    want = brute_components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    sizes = defaultdict(int)
    for top in want.values():
        sizes[top] += 1
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, DOCS), block=block).collect()
    assert {(r.doc_id, r.keep_id) for r in found} == {(d, top) for d, top in want.items() if sizes[top] > 1}


def test_bands_are_tuned_for_recall():
    bands, rows = paragraph_dedup.tuned()
    assert bands * rows <= paragraph_dedup.MAX_HASHES
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


def prose(seed, n):
    import random

    rnd = random.Random(seed)
    return [f"s{seed}w{rnd.randrange(4000)}" + ("." if rnd.random() < 0.08 else "") for _ in range(n)]


def test_passages_inside_lines_are_removed(spark):
    shared = {k: " ".join(prose(f"shared{k}", n)) for k, n in enumerate([62, 50, 90, 49])}
    before, after = lambda d: " ".join(prose(f"b{d}", 44)), lambda d: " ".join(prose(f"a{d}", 44))
    rows = []
    for k, body in shared.items():
        broken = body.split()
        broken[20] += "\nx" if k == 3 else "\n"  # across a line end; 49 words are no passage
        for d, text in enumerate([body, body, " ".join(broken)]):
            doc = 10 * k + d
            rows.append((doc, f"{before(doc)} {text} {after(doc)}\nlast line {doc}", "x"))
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    for k in shared:
        for d in range(3):
            doc = 10 * k + d
            whole = d == 0 or k == 3
            want = rows[doc // 10 * 3 + d][1].split() if whole else f"{before(doc)} {after(doc)} last line {doc}".split()
            assert left[doc].split() == want, (k, d)


def test_runs_against_brute_force(spark):
    import random

    from palimpsest.llm import runs

    rnd = random.Random(5)
    base = prose("base", 300)
    bodies = {}
    for doc in range(40):
        words = []
        for part in range(4):
            a = rnd.randrange(200)
            words += prose(f"{doc}own{part}", rnd.randrange(1, 40)) + base[a : a + rnd.choice([30, 49, 50, 51, 70, 100])]
        bodies[doc] = " ".join(words)
    # of every third text a stretch is gone already
    gone = {d: (len(t) // 3, len(t) // 2) if d % 3 == 2 else (0, 0) for d, t in bodies.items()}
    rows = spark.createDataFrame([(d, d, t) for d, t in bodies.items()], "doc_id long, version long, text string")
    spans = spark.createDataFrame(
        [(d, d, [(a, b)]) for d, (a, b) in gone.items() if b], "doc_id long, version long, spans array<struct<start: long, end: long>>"
    )
    got = defaultdict(set)
    for r in runs.repeated_runs(rows, spans).collect():
        first = len(bodies[r.doc_id][: r.start].split())
        assert len(bodies[r.doc_id][r.start : r.end].split()) == r.n_words >= 50
        got[r.doc_id] |= set(range(first, first + r.n_words))
    assert sum(map(len, got.values())) > 1_000
    want = brute_runs(bodies, {d: [span] for d, span in gone.items()})
    assert got == {d: {i + k for i in places for k in range(50)} for d, places in want.items()}


def brute_runs(bodies, gone, size=50):
    """Where the runs of ``size`` words begin that an earlier text holds whole, by id; ``gone`` are spans by id."""
    held, out = {}, {}
    for doc, text in sorted(bodies.items()):
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        words = text.lower().split()
        whole = [not any(a <= s < b for a, b in gone.get(doc, ())) for s in starts]
        kept = []
        for i in range(len(words) - size + 1):
            run = tuple(words[i : i + size])
            if run in held and any(whole[i : i + size]):
                out.setdefault(doc, []).append(i)
            if all(whole[i : i + size]):
                kept.append(run)
        for run in kept:
            held.setdefault(run, doc)
    return out


def test_word_edges_and_rolled_hashes():
    import random

    import numpy as np

    from palimpsest.llm import runs

    rnd = random.Random(9)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "\t", "\x1c", "\u3000", "\u3001", "é", "\U0001d400", "\x85"]) for _ in range(rnd.randrange(30)))
        want = [m.span() for m in re.finditer(r"\S+[^\S\n]*", text)]
        assert [tuple(e) for e in runs.word_edges(text).tolist()] == want and len(want) == len(text.split())
    values = np.array([rnd.getrandbits(64) for _ in range(120)], np.uint64)
    for width in (1, 2, 5, 25, 50, 120):
        want = [sum(int(v) * pow(runs._FACTOR, width - 1 - k, 1 << 64) for k, v in enumerate(values[i : i + width])) % (1 << 64) for i in range(121 - width)]
        assert runs._rolled(values, width).tolist() == want


def test_runs_that_one_text_still_holds_are_not_compared(spark, monkeypatch):
    """All paragraphs but the first document's are gone, so there is no run to look at; texts are cut into words as Python does."""
    from palimpsest.llm import runs

    stored, cut = {}, runs.cut_lineage

    def counted(df, label):
        table = cut(df, label)
        stored[label] = table.count()
        return table

    monkeypatch.setattr(runs, "cut_lineage", counted)
    body = "\n".join(" ".join(prose(f"still{k}", 70)) for k in range(4))
    rows = [(d, body, "x") for d in range(5)]
    found = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.nth, r.removed) for r in found) == [(d, k, d > 0) for d in range(5) for k in range(4)]
    # before, anchors of gone words counted, and each run of the first document was handed on
    assert stored["run-anchors"] > 0 and stored["run-met"] == stored["run-grams"] == 0


def test_words_of_texts_against_python():
    import random

    import numpy as np

    from palimpsest.llm import runs

    rnd = random.Random(4)
    pieces = ["a", "B", "word", "eightchr", "Ninechars", "x" * 70, "x" * 71, " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "é", "İ", "ΑΣ", "\U0001d400", "\0"]
    known = {}
    for _ in range(200):
        texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(25))) for _ in range(rnd.randrange(1, 6))]
        hashes, places, counts = runs.text_words(texts)
        words = [t.lower().split() for t in texts]
        assert counts.tolist() == [len(w) for w in words]
        assert places.tolist() == [m.start() for t in texts for m in re.finditer(r"\S+", t)]
        flat = [w for part in words for w in part]
        assert all(known.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True))
        assert np.array_equal(runs.word_hashes(flat), hashes)
    assert len(set(known.values())) == len(known) > 500


def test_words_that_no_single_document_holds_in_a_row_stay(spark):
    """Two earlier documents hold overlapping pieces of 38 words, none all 50."""
    body = prose("pieces", 50)
    rows = [(1, body[:38]), (2, body[12:]), (3, body)]
    rows = [(d, " ".join([*prose(f"before{d}", 60), *words, *prose(f"after{d}", 60)]), "x") for d, words in rows]
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert left == {d: t for d, t, _ in rows}


def test_passages_inside_long_lines_are_removed(spark):
    rows = []
    for k, n in enumerate([55, 80, 120, 400]):
        for ends in (True, False):
            body = " ".join(prose(f"long{k}{ends}", n))
            for d in range(2):
                doc = 100 * k + 10 * ends + d
                text = " ".join([*prose(f"l{doc}", 250), body, *prose(f"r{doc}", 250)])
                rows.append((doc, text if ends else text.replace(".", ""), "x"))
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    for doc, text, _ in rows:
        words = text.split()
        assert left[doc].split() == (words if doc % 10 == 0 else words[:250] + words[-250:])


def test_passages_in_short_lines_are_removed(spark):
    lines = lambda words, n: "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))
    wrapped, few = lines(prose("wrapped", 96), 12), lines(prose("few", 36), 12)
    rows = []
    for d in range(2):
        rows.append((d, lines(prose(f"h{d}", 30), 11) + "\n" + wrapped + "\n" + lines(prose(f"t{d}", 30), 11), "x"))
        rows.append((10 + d, f"own {d}\n\n" + few + f"\n\nown end {d}", "x"))
    left = {r.doc_id: r.text for r in paragraph_dedup.drop_repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    texts = {d: t for d, t, _ in rows}
    assert left[0] == texts[0] and left[10] == texts[10]
    assert left[1].split() == prose("h1", 30) + prose("t1", 30)
    # two lines make a unit, the third has too few words
    assert left[11].split() == ["own", "1", *prose("few", 36)[24:], "own", "end", "1"]
