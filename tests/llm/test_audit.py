"""The filter audit against a plain count over all orders, and tries against dictionaries."""

import random
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations
from types import SimpleNamespace

import pyarrow as pa
import pytest

from palimpsest.llm import filter_audit, work

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Rows of the audit as plain Python counts them."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    fails = []
    for d, t, s in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        f = set()
        if len(words) < 50:
            f.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            f.add("C")
        if any(c in "#$%&*|" for c in t):
            f.add("D")
        if d is not None and d > least[t]:
            f.add("E")
        fails.append((s or "", d, f))
    out, shapley = {}, Counter()
    for part in {s for s, _, _ in fails}:
        mine = [(d, f) for s, d, f in fails if s == part]
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d, f in mine if letter in f and not f & before]
                shapley[part, letter] += len(gone)
                out[part, order, step] = (
                    sum(not f & (before | {letter}) for _, f in mine),
                    len(gone),
                    sum(letter in f and bool(f & before) for _, f in mine),
                    sum(f == {letter} for _, f in mine),
                    sum(d in good for d in gone),
                    sum(d in toxic for d in gone),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(docs, labels, **names):
    rows = filter_audit.audit(docs, labels, **names).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def sample(n=300, seed=5):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["Ab", "c", "dé", "#", "word%d" % rng.randrange(400)]) for _ in range(rng.randrange(0, 140))) for _ in range(40)]
    texts += ["same beginning " * 20 + str(i) for i in range(10)] + ["", None, "ﬁ  x\x1cy", "lone"]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None])) for i in range(n)]
    return rows + [(7, rows[7][1], "a"), (None, rows[8][1], "b"), (None, None, None), (900, "w " * 20_000, ""), (901, "w " * 20_000, "")]


def test_against_brute_force(spark):
    rows = sample()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(docs, spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], LABELS)) == brute(rows, labels)


def test_hot_prefixes_and_hot_texts_give_the_same(spark, monkeypatch):
    """With small tries every prefix is extended and frequent texts are merged in parts first."""
    rows = sample(200) + [(1000 - i, "copied text of a third of all", "a") for i in range(120)]
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    labels = spark.createDataFrame([], LABELS)
    want = brute(rows, [])
    monkeypatch.setattr(filter_audit, "HOT_BYTES", 300)
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 2_000)
    assert found(docs, labels) == want


def test_texts_of_many_batches_give_the_same(spark, monkeypatch):
    """Blocks go over batches, and a text may have more bytes than a batch or a block."""
    long = "".join(chr(97 + i % 23) for i in range(40_000))
    rows = sample(200) + [(500 + i, long + " z" * (i % 3), "a") for i in range(7)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    want = brute(rows, [])
    for name, most in (("BATCH_BYTES", 5_000), ("BLOCK_BYTES", 30_000), ("HOT_BYTES", 20_000)):
        monkeypatch.setattr(filter_audit, name, most)
    assert found(docs, spark.createDataFrame([], LABELS)) == want


def texts_apart(n, length=4_000):
    """Texts without a common beginning, and each tenth twice."""
    rng = random.Random(11)
    texts = [f"{rng.random()} {i} ".encode() + rng.randbytes(length // 2).hex().encode() for i in range(n)]
    return [texts[i - 1] if i % 10 == 9 else t for i, t in enumerate(texts)]


def peak_and_batches(fn, batches):
    """Most bytes that Python held, and what came of the batches, as bytes and classes."""
    tracemalloc.start()
    try:
        sizes, classes, whole = [], [], 0
        for out in fn(iter(batches)):
            sizes.append(out.nbytes)
            classes += out["cls"].to_pylist()
            whole += out["text"].null_count
        return tracemalloc.get_traced_memory()[1], sizes, classes, whole
    finally:
        tracemalloc.stop()


def test_a_task_holds_and_returns_few_bytes_at_once(monkeypatch):
    monkeypatch.setattr(filter_audit, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    bodies = texts_apart(6_000)
    rows = pa.record_batch([pa.array(range(6_000), pa.int64()), pa.array(["s"] * 6_000), pa.array(bodies, pa.binary()).cast(pa.string())], ["doc_id", "part", "text"])
    peak, sizes, classes, without = peak_and_batches(filter_audit._judge, [rows])
    assert len(classes) == 6_000
    assert len(set(classes)) == 6_000 - without >= 5_400
    assert peak < 32_000_000
    assert max(sizes) < 4_000_000


def test_a_merge_of_rare_texts_holds_few_bytes_at_once():
    """Many keys of few texts each, and a frequent text whose parts are passed on."""
    bodies = sorted(texts_apart(6_000))
    zeros, ids = pa.array([0] * 6_000, pa.int64()), pa.array(range(6_000), pa.int64())
    columns = [pa.array([b[:16] for b in bodies], pa.binary()), zeros, zeros, pa.array([1] * 6_000, pa.int64()), ids, ids, pa.array(bodies, pa.binary())]
    rows = pa.record_batch(columns, [*filter_audit._KEY, "cls", "least", "text"])
    peak, sizes, classes, without = peak_and_batches(filter_audit._merge, [rows])
    assert sorted(classes) == list(range(6_000))
    assert 6_000 - without == len(set(bodies))
    assert peak < 32_000_000
    assert max(sizes) < 4_000_000


def test_small_batches_end_with_what_is_run_inside(spark, conf):
    """The session's own size holds where it has one, and nothing stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def largest():
        docs = spark.createDataFrame([(i, "x" * 1_000) for i in range(400)], "doc_id long, text string").coalesce(1)
        counted = work.map_arrow(docs, lambda bs: (pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"]) for b in bs), "n long")
        return max(r.n for r in work.cut_lineage(counted, "batches").collect())

    with pytest.raises(ZeroDivisionError), work.arrow_batches(spark, 50_000):
        assert largest() < 100
        raise ZeroDivisionError
    assert spark.conf.get(name, None) is None
    assert largest() == 400
    conf(execution_arrow_maxBytesPerBatch="100000000")
    with work.arrow_batches(spark, 50_000):
        assert largest() == 400
    assert spark.conf.get(name) == "100000000"


def test_empty_tables_and_other_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    empty = spark.createDataFrame([], DOCS)
    assert found(empty, labels) == {}
    odd = spark.createDataFrame(
        [(1, "x", "s", 5, 6, 7), (2, "x", "s", 5, 6, 7)], "id long, body string, host string, part int, mask int, cls int"
    )
    got = found(odd, labels, doc_id="id", text="body", part="host")
    assert got == brute([(1, "x", "s"), (2, "x", "s")], [(1, 1, 0)])


@pytest.mark.parametrize("seed", range(3))
def test_tries_know_texts_from_each_other(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))).encode() for _ in range(2_000)]
    trie, ends = filter_audit.Trie(), defaultdict(set)
    for text in texts:
        ends[text].add(id(trie.terminal(text)))
    assert all(len(e) == 1 for e in ends.values())
    assert len({e for s in ends.values() for e in s}) == len(set(texts))
    assert {t: {id(trie.terminal(t))} for t in ends} == ends
