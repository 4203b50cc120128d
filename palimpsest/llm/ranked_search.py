"""Ranked search of items in documents, by branch and bound over trees of term vectors.

A document comes down to the terms that some item holds, most frequent first, with their counts. In
that order vectors share beginnings, and a tree over them has a node for every shared one. A node knows
the largest count of each term and the smallest length factor among the documents below it; the score of
that imaginary document is a bound for all of them. For each item a tree is descended depth first, the
most promising branch before others, and what cannot reach the item's best ten is left out. Trees are
built of blocks of documents that are neighbours in the order of their vectors; each gives its best, and
the best of all trees are the result.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; of letters only A-Z are
lower-cased. A NULL or empty text has no terms and is in no result. Every document row counts as a
document of its own, rows of one id too; a NULL id ranks behind the others of its score. Every item row
is searched for, repeated ones apart; an item without known terms has no rows. Other columns of both
tables are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import files
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, scratch_path, texts

TOP = 10
# Documents of a tree, and documents below which a branch is scored one by one.
TREE = 8192
LEAF = 32
# Distinct terms that are searched for in one pass; more items than that are searched in several passes.
PASS_TERMS = 500_000
# Items that a task holds at a time.
ITEMS_AT_A_TIME = 64
# Leading terms of a vector that it is dealt by.
HEAD = 8
_NO_ID = np.iinfo(np.int64).max

# Fixed values of the score: how much of the length factor follows the length, in percent, and scales.
LENGTH_PERCENT = 75
SCALE = 1_000_000_000
COUNT_SCALE = 1000
LENGTH_SCALE = 8

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes.maketrans(_SEPARATORS + _CAPITALS, b" " * len(_SEPARATORS) + _CAPITALS.lower())


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_PLAIN).split() if text else []


# ---------------------------------------------------------------- tables that tasks read


def _stored(df: DataFrame, label: str, **options: int) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return path


def _parts(path: str) -> Iterator[pa.Table]:
    """A stored table file by file, in the order of their names."""
    for name, _ in files.listed(path, ".parquet"):
        with files.opened(f"{path}/{name}") as source:
            yield pq.read_table(source)


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> dict[bytes, int]:
    words = (w for part in _parts(path) for w in part.column("word").to_pylist())
    return {w: i for i, w in enumerate(words)}


@lru_cache(maxsize=1)
def _ranks(path: str) -> np.ndarray:
    """Rank of every term number, 0 for the most frequent; -1 for terms that no document holds."""
    parts = [p for p in _parts(path) if len(p)]
    if not parts:
        return np.full(0, -1, np.int32)
    whole = pa.concat_tables(parts)
    term, held = (whole.column(c).to_numpy() for c in ("term", "df"))
    ranks = np.full(int(term.max()) + 1, -1, np.int32)
    ranks[term[np.lexsort((term, -held))]] = np.arange(len(term), dtype=np.int32)
    return ranks


# ---------------------------------------------------------------- vectors


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _vectors(rows: DataFrame, key: str, vocabulary: str) -> DataFrame:
    """``key, n, terms, tfs`` of ``key, text``: all terms counted, those of the vocabulary listed."""

    def run(batches: Batches) -> Batches:
        number = _vocabulary(vocabulary).get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms_of(text.as_py())
                known = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                distinct, times = np.unique(known[known >= 0], return_counts=True)
                n.append(len(words))
                terms.append(distinct)
                tfs.append(times)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n, pa.int64()), _lists(terms), _lists(tfs)], [key, "n", "terms", "tfs"]
            )

    return map_arrow(rows.select(key, "text"), run, f"{key} long, n long, terms array<int>, tfs array<int>")


def _by_frequency(vectors: DataFrame, ranks: str) -> DataFrame:
    """Term numbers become ranks, most frequent first, with their counts beside them."""

    def run(batches: Batches) -> Batches:
        rank = _ranks(ranks)
        for batch in batches:
            terms, tfs = batch.column("terms"), batch.column("tfs")
            ends = terms.offsets.to_numpy()
            row = np.repeat(np.arange(len(terms)), np.diff(ends))
            found = rank[terms.values.to_numpy()[ends[0] : ends[-1]]]
            counts = tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[-1].as_py()]
            order = np.lexsort((found, row))
            offsets = pa.array((ends - ends[0]).astype(np.int32))
            new = {
                "terms": pa.ListArray.from_arrays(offsets, pa.array(found[order])),
                "tfs": pa.ListArray.from_arrays(offsets, pa.array(counts[order])),
            }
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return map_arrow(vectors, run, vectors.schema.simpleString()[len("struct<") : -1])


# ---------------------------------------------------------------- trees


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a count is worth at a length factor; grows with the count and falls with the factor."""
    return (SCALE * tf) // (COUNT_SCALE * tf + LENGTH_SCALE * m)


class Tree:
    """A compressed tree over the vectors of a block of documents.

    Documents are sorted by vector, so a node is a range of them. Nodes are numbered level by level: the
    children of a node follow each other. Neighbouring children of few documents share a leaf.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, vectors: list[np.ndarray], tfs: list[np.ndarray]) -> None:
        keys = [v.astype(">u4").tobytes() for v in vectors]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.ids, self.m = ids[order], m[order]
        sizes = np.array([len(vectors[i]) for i in order])
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        ranks = np.concatenate([vectors[i] for i in order])
        self.tf = np.concatenate([tfs[i] for i in order]).astype(np.int64)
        self.present, self.column = np.unique(ranks, return_inverse=True)
        self.entry_m = np.repeat(self.m, sizes)
        shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = vectors[order[i - 1]], vectors[order[i]]
            least = min(len(a), len(b))
            differing = np.flatnonzero(a[:least] != b[:least])
            shared[i] = differing[0] if len(differing) else least
        self._branch(shared)
        self._bound()

    def _branch(self, shared: np.ndarray) -> None:
        """Ranges of all nodes, and where the children of each begin and end; leaves have none."""
        self.ranges, self.children, at = [(0, len(shared))], [], 0
        while at < len(self.ranges):
            lo, hi = self.ranges[at]
            first = len(self.ranges)
            if hi - lo > LEAF:
                within = shared[lo + 1 : hi]
                cuts = np.flatnonzero(within == within.min()) + lo + 1
                # documents of one and the same vector are not told apart by the tree
                if np.diff(self.ends[lo : hi + 1]).max() > within.min():
                    start = lo
                    for a, b in zip([lo, *cuts], [*cuts, hi], strict=True):
                        if b - start > LEAF and a > start:
                            self.ranges.append((start, a))
                            start = a
                    self.ranges.append((start, hi))
            if len(self.ranges) - first == 1:
                del self.ranges[first:]
            self.children.append((first, len(self.ranges)))
            at += 1

    def _bound(self) -> None:
        """Per node the smallest length factor and the smallest id below it."""
        nodes = len(self.ranges)
        self.min_m, self.min_id = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.leaf = np.zeros(len(self.tf), np.int64)
        for k, ((lo, hi), (a, b)) in enumerate(zip(self.ranges, self.children, strict=True)):
            self.min_m[k], self.min_id[k] = self.m[lo:hi].min(), self.ids[lo:hi].min()
            if a == b:
                self.leaf[self.ends[lo] : self.ends[hi]] = k

    def look_for(self, ranks: np.ndarray) -> None:
        """Take up per node the largest count of each of these terms below it."""
        wanted = np.isin(self.present, ranks)
        self.place = np.where(wanted, np.cumsum(wanted) - 1, -1)
        self.max_tf = np.zeros((len(self.ranges), int(wanted.sum())), np.int64)
        held = np.flatnonzero(wanted[self.column])
        np.maximum.at(self.max_tf, (self.leaf[held], self.place[self.column[held]]), self.tf[held])
        for k in range(len(self.ranges) - 1, -1, -1):
            a, b = self.children[k]
            if a < b:
                self.max_tf[k] = self.max_tf[a:b].max(axis=0)

    def _scores(self, k: int, worth: np.ndarray) -> np.ndarray:
        """Exact scores of the documents of a leaf."""
        lo, hi = self.ranges[k]
        part = slice(self.ends[lo], self.ends[hi])
        each = worth[self.column[part]]
        held = np.flatnonzero(each)
        sums = np.zeros(len(each) + 1, np.int64)
        sums[held + 1] = each[held] * saturated(self.tf[part][held], self.entry_m[part][held])
        sums = np.cumsum(sums)
        return np.diff(sums[self.ends[lo : hi + 1] - self.ends[lo]])

    def search(self, ranks: np.ndarray, weights: np.ndarray, top: int) -> tuple[list[tuple[int, int]], int]:
        """The best ``(score, id)`` above 0, best first, and how many documents were scored for it.

        ``look_for`` has named the terms before.
        """
        places = np.minimum(np.searchsorted(self.present, ranks), len(self.present) - 1)
        here = (self.present[places] == ranks) & (weights > 0)
        columns, weights = places[here], weights[here]
        if not len(columns):
            return [], 0
        worth = np.zeros(len(self.present), np.int64)
        worth[columns] = weights
        columns = self.place[columns]

        def bounds(nodes: slice) -> np.ndarray:
            return (weights * saturated(self.max_tf[nodes, columns], self.min_m[nodes, None])).sum(axis=1)

        best: list[tuple[int, int]] = []  # (-score, id), best first
        waiting, scored = [(0, int(bounds(slice(0, 1))[0]))], 0
        while waiting:
            k, bound = waiting.pop()
            if bound <= 0 or (len(best) == top and (-bound, int(self.min_id[k])) > best[-1]):
                continue
            a, b = self.children[k]
            if a < b:
                below = bounds(slice(a, b))
                waiting += [(a + int(i), int(below[i])) for i in np.argsort(below, kind="stable")]
                continue
            lo, hi = self.ranges[k]
            scores = self._scores(k, worth)
            scored += hi - lo
            good = np.flatnonzero(scores >= max(1, -best[-1][0] if len(best) == top else 1))
            best = sorted([*best, *zip((-scores[good]).tolist(), self.ids[lo:hi][good].tolist(), strict=True)])[:top]
        return [(-score, doc) for score, doc in best], scored


def _trees(batches: Batches) -> Iterator[Tree]:
    """Trees of the vectors of a task, a block of documents each."""

    def built(rows: list[tuple]) -> Tree:
        ids, m, vectors, tfs = zip(*rows, strict=True)
        return Tree(np.array(ids, np.int64), np.array(m, np.int64), list(vectors), list(tfs))

    held: list[tuple] = []
    for batch in batches:
        ids = batch.column("doc_id").fill_null(_NO_ID).to_pylist()
        ends, tf_ends = (batch.column(c).offsets.to_numpy() for c in ("terms", "tfs"))
        terms, tfs = (batch.column(c).values.to_numpy() for c in ("terms", "tfs"))
        for i, (doc, m) in enumerate(zip(ids, batch.column("m").to_pylist(), strict=True)):
            held.append((doc, m, terms[ends[i] : ends[i + 1]], tfs[tf_ends[i] : tf_ends[i + 1]]))
            if len(held) == TREE:
                yield built(held)
                held = []
    if held:
        yield built(held)


def _searched(items: str, top: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for tree in _trees(batches):
            for part in _parts(items):
                found = []
                tree.look_for(np.unique(pa.concat_arrays(part.column("terms").chunks).flatten().to_numpy()))
                for item, ranks, weights in zip(*(part.column(c).to_pylist() for c in ("item", "terms", "weights")), strict=True):
                    best, _ = tree.search(np.array(ranks, np.int64), np.array(weights, np.int64), top)
                    found += [(item, None if doc == _NO_ID else doc, score) for score, doc in best]
                columns = list(zip(*found, strict=True)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


# ---------------------------------------------------------------- search


def length_factor(n: Column, documents: int, all_terms: int) -> Column:
    """100 for a document of mean length, in 64-bit integers."""
    scaled = F.lit(LENGTH_PERCENT).cast("long") * n * F.lit(documents).cast("long")
    return F.lit(100 - LENGTH_PERCENT) + F.call_function("div", scaled, F.lit(max(all_terms, 1)).cast("long"))


def _pass(docs: DataFrame, items: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """``item, doc_id, score``: the best of every tree for items whose words are in ``words``."""
    vocabulary = _stored(words, "search-vocabulary")
    vectors = cut_lineage(_vectors(docs.withColumnRenamed("doc_id", "key"), "key", vocabulary), "search-vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    statistics = _stored(held, "search-terms")
    known = docs.sparkSession.read.parquet(statistics)
    odds = F.lit(2.0 * total.documents + 2) / (2 * F.col("df") + 1)
    weight = F.floor(1000 * F.log(odds)).cast("long")

    asked = _by_frequency_of_items(_vectors(items, "item", vocabulary), known.withColumn("weight", weight), statistics)
    wanted = _stored(asked, "search-items", maxRecordsPerFile=ITEMS_AT_A_TIME)
    given = vectors.where(F.size("terms") > 0).select(
        F.col("key").alias("doc_id"), length_factor(F.col("n"), total.documents, total.terms).alias("m"), "terms", "tfs"
    )
    ordered = cut_lineage(_by_frequency(given, statistics), "search-ordered")
    dealt = ordered.repartitionByRange(F.slice("terms", 1, HEAD), F.col("doc_id"))
    return map_arrow(dealt, _searched(wanted, top), "item long, doc_id long, score long")


def _by_frequency_of_items(vectors: DataFrame, known: DataFrame, statistics: str) -> DataFrame:
    """``item, terms, weights``: weights count a term as often as the item repeats it."""
    each = vectors.select("item", F.inline(F.arrays_zip("terms", "tfs"))).toDF("item", "term", "times")
    weighed = each.join(known, "term").groupBy("item").agg(
        F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("weight"))).alias("held")
    )
    rows = weighed.select("item", F.col("held.term").alias("terms"), F.col("held.weight").alias("weights"))

    def run(batches: Batches) -> Batches:
        rank = _ranks(statistics)
        for batch in batches:
            terms = [rank[t].tolist() for t in batch.column("terms").to_pylist()]
            columns = [batch.column("item"), pa.array(terms, pa.list_(pa.int32())), batch.column("weights")]
            yield pa.RecordBatch.from_arrays(columns, ["item", "terms", "weights"])

    return map_arrow(rows, run, "item long, terms array<int>, weights array<bigint>")


def _words(items: DataFrame) -> DataFrame:
    """Distinct terms of the items, as bytes."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = {w for text in batch.column("text").cast(pa.binary()) for w in terms_of(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["word"])

    return map_arrow(items.select("text"), run, "word binary").distinct()


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item, equal scores by id.

    ``item_id`` keeps its type. Items with more distinct terms than ``pass_terms`` together are
    dealt over several passes over the documents.
    """
    rows = items.select(items[item_id].alias("item_id"), items[text].cast("string").alias("text"))
    rows = cut_lineage(rows.withColumn("item", F.monotonically_increasing_id()), "search-asked")
    words = cut_lineage(_words(rows), "search-words")
    passes = max(1, -(-words.count() // pass_terms))
    found = None
    for k in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        part_words = words if passes == 1 else cut_lineage(_words(part), "search-words")
        best = cut_lineage(_pass(texts(docs, doc_id, text), part, part_words, top), "search-best")
        found = best if found is None else found.unionByName(best)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
