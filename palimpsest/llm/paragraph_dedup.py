"""Passages repeated across documents, by MinHash banding of paragraphs.

A paragraph is a line, or so many short lines in a row as have the words of one; a line of very many words is
cut after sentences, chosen by their hash once a part has words enough. Paragraphs of one word sequence are one node. Nodes that share a band of their MinHash
signature meet in a bucket, where each is joined to the smallest, so a bucket of any size makes as many
rows as it has members. Everything these candidate links connect is compared by exact Jaccard similarity
of word shingles, in tasks of bounded size, and links of similar paragraphs are clustered by components.

In a cluster the document with the smallest id keeps its paragraphs, the others lose theirs. A paragraph that
occurs in one document only stays however often it does. In what is left, word runs that an earlier document
has too are removed wherever they stand in lines (``runs``). Rows of one id are one document. Rows without an
id or a text stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.runs import mixed, repeated_runs, word_hashes
from palimpsest.llm.vocab import groups, strings
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, texts
from palimpsest.operators.fetched import possibly_among

SHINGLE = 5
SIMILARITY = 0.8
# Shorter paragraphs are no passages. Longer ones than the second are cut after sentences.
MIN_WORDS = 20
MAX_WORDS = 200
RECALL = 0.999
MAX_HASHES = 64
# Nodes that a task remembers to have seen.
REMEMBERED = 200_000
# Paragraphs that one task compares with as many others.
BLOCK = 2048
_SENTENCE_END = re.compile(r"[.!?]\s+")


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the longest bands that still find similar pairs with this recall."""
    for rows in range(most, 0, -1):
        miss = 1 - similarity**rows
        bands = next((b for b in range(1, most // rows + 1) if 1 - miss**b >= recall), None)
        if bands:
            return bands, rows
    raise ValueError("more hashes are needed for this recall")


def paragraphs(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of the paragraphs of a text, the end behind the line end."""
    at, start, short = 0, 0, []
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        words = line.lower().split()
        if not 0 < len(words) < MIN_WORDS:
            short = []
        if len(words) > MAX_WORDS:
            yield from _parts(text, at, end, words)
        elif len(words) >= MIN_WORDS:
            yield at, end, words
        elif words:
            start = start if short else at
            short = short + words
            if len(short) >= MIN_WORDS:
                yield start, end, short
                short = []
        at = end


def _parts(text: str, at: int, end: int, words: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    # behind each word that ends a sentence, and behind the blanks that follow it
    stops = [i for i, word in enumerate(words, 1) if word[-1] in ".!?"]
    edges = [m.end() for m in _SENTENCE_END.finditer(text, at, end)]
    # the last word may have no blank behind it
    ends = [*zip(stops, edges, strict=False), (len(words), end)]
    start, first, sentence = at, 0, 0
    for stop, edge in ends:
        ends_here = xxhash.xxh3_64_intdigest(" ".join(words[sentence:stop])) % 4 == 0
        sentence, n = stop, stop - first
        if (ends_here and n >= MIN_WORDS) or n >= MAX_WORDS or edge == end:
            if n >= MIN_WORDS:
                yield start, edge, words[first:stop]
            start, first = edge, stop


def node_of(words: list[str]) -> int:
    """The number of a word sequence, signed 64 bits."""
    value = xxhash.xxh3_64_intdigest(" ".join(words))
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of several paragraphs, and where each paragraph's begin."""
    sizes = np.array([len(w) for w in words])
    flat = word_hashes(chain.from_iterable(words))
    n = len(flat) - SHINGLE + 1
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(0x100000001B3) + flat[k : k + n]
    inside = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    return mixed(rolled[inside[:n]]), starts


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key per band and paragraph from the least values of its shingles under random functions."""
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    keys = np.zeros((bands, len(starts)), np.uint64)
    for band in range(bands):
        keys[band] = band + 1
        for p in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(hashes * odd[p] + add[p], starts)
            keys[band] = mixed(keys[band] * np.uint64(0x100000001B3) + least)
    return keys


def _rows(docs: DataFrame) -> DataFrame:
    whole = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return whole.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _occurrences(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, version, nth, start, end, n_words, node, buckets`` of all paragraphs, places in characters.

    A node has its buckets once per task as far as it can be remembered.
    """

    def run(batches: Batches) -> Batches:
        names = ["doc_id", "version", "nth", "start", "end", "n_words", "node"]
        seen: set[int] = set()
        for batch in batches:
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            bodies = strings(batch.column("text"))
            for x, y in groups(bodies):
                found, new, lists = [], [], [0]
                for row in range(x, y):
                    doc, version, text = ids[row], versions[row], bodies[row]
                    for i, (a, b, words) in enumerate(paragraphs(text)):
                        node = node_of(words)
                        found.append((doc, version, i, a, b, len(words), node))
                        if node not in seen:
                            seen.add(node)
                            new.append(words)
                        lists.append(len(new) * bands)
                if len(seen) > REMEMBERED:
                    seen.clear()
                if found:
                    keys = band_keys(*shingle_hashes(new), bands, rows) if new else np.zeros((bands, 0), np.uint64)
                    buckets = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(keys.T.reshape(-1).view(np.int64)))
                    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, buckets], [*names, "buckets"])

    shape = "doc_id long, version long, nth long, start long, end long, n_words long, node long, buckets array<long>"
    return map_arrow(_rows(docs), run, shape)


def _stars(batches: Batches) -> Batches:
    """From rows sorted by ``band, node`` a link from the first node of each bucket to the others."""
    band_at, node_at = None, 0
    for batch in batches:
        band, node = batch.column("band").to_numpy(), batch.column("node").to_numpy()
        if not len(band):
            continue
        new = np.concatenate([[band[0] != band_at], band[1:] != band[:-1]])
        # the row in which each row's bucket began, -1 for a bucket from the batch before
        began = np.maximum.accumulate(np.where(new, np.arange(len(band)), -1))
        first = np.where(began >= 0, node[np.maximum(began, 0)], node_at)
        band_at, node_at = band[-1], first[-1]
        other = first != node
        yield pa.RecordBatch.from_arrays([pa.array(first[other]), pa.array(node[other])], ["u", "v"])


def similar(shingles: list[np.ndarray], least: float) -> Iterator[tuple[int, int]]:
    """Links by place that connect all sets with a Jaccard similarity of ``least`` or more.

    A search that goes on from every set reached to all that are not, over lists of the sets that
    hold a shingle.
    """
    sizes = np.array([len(s) for s in shingles])
    owners = np.repeat(np.arange(len(sizes)), sizes)
    values = np.concatenate(shingles)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    left = np.ones(len(sizes), bool)
    for seed in range(len(sizes)):
        if not left[seed]:
            continue
        left[seed] = False
        front = [seed]
        while front:
            at = front.pop()
            a = np.searchsorted(values, shingles[at], "left")
            b = np.searchsorted(values, shingles[at], "right")
            lists = [owners[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True) if y - x > 1]
            if not lists:
                continue
            common = np.bincount(np.concatenate(lists), minlength=len(sizes))
            near = np.flatnonzero(left & (common >= least * (sizes + sizes[at] - common)))
            left[near] = False
            front += near.tolist()
            yield from ((at, int(x)) for x in near)


def _verified(least: float) -> object:
    """Links of every run of equal ``component, part`` in sorted rows of ``node, text``."""

    def run(batches: Batches) -> Batches:
        def links(nodes: list[int], bodies: list[str]) -> pa.RecordBatch:
            hashes, starts = shingle_hashes([t.lower().split() for t in bodies])
            sets = [np.unique(s) for s in np.split(hashes, starts[1:])]
            found = [(nodes[a], nodes[b]) for a, b in similar(sets, least)]
            u, v = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        group, nodes, bodies = None, [], []
        for batch in batches:
            for component, part, node, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                if (component, part) != group:
                    if len(nodes) > 1:
                        yield links(nodes, bodies)
                    group, nodes, bodies = (component, part), [], []
                nodes.append(node)
                bodies.append(text)
        if len(nodes) > 1:
            yield links(nodes, bodies)

    return run


def _similar_links(docs: DataFrame, occurrences: DataFrame, least: float, block: int) -> DataFrame:
    met = occurrences.select(F.explode("buckets").alias("band"), "node").repartition("band").sortWithinPartitions("band", "node")
    candidates = cut_lineage(components(map_arrow(met, _stars, "u long, v long")), "candidates")
    # one occurrence of every candidate, and its words from its document
    first = F.min(F.struct("doc_id", "version", "start", "end"))
    chosen = occurrences.join(candidates, "node", "left_semi").groupBy("node").agg(first.alias("at")).select("node", "at.*")
    chosen = cut_lineage(chosen, "candidate-places")
    found = possibly_among(_rows(docs), "version", chosen.select("version").distinct()).join(chosen, ["doc_id", "version"])
    body = F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))")
    # rows that repeat an id and text give the same paragraph again
    bodies = cut_lineage(found.select("node", body.alias("text")).dropDuplicates(["node"]), "candidate-texts")
    # a component beyond a block is cut into blocks, every two of which meet in a task
    sizes = candidates.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = bodies.join(candidates, "node").join(sizes, "component")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("at", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
        "component", (F.least("own", "at") * F.col("blocks") + F.greatest("own", "at")).alias("part"), "node", "text"
    )
    dealt = dealt.repartition("component", "part").sortWithinPartitions("component", "part")
    return map_arrow(dealt, _verified(least), "u long, v long")


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """Every paragraph of a cluster that several documents share, also those that stay, and the runs that go.

    ``doc_id, version, nth, start, end, n_words, cluster, keep_id, removed``; ``version`` is a hash of
    the text that the places belong to, ``keep_id`` the document that keeps its paragraphs. A run has -1 for
    ``nth``, its first gram as ``cluster``, and the smallest document that keeps a part of it as ``keep_id``.
    """
    whole = texts(docs, doc_id, text)
    occurrences = cut_lineage(_occurrences(whole, *tuned(similarity)), "paragraphs")
    links = _similar_links(whole, occurrences, similarity, block)
    named = cut_lineage(components(links), "paragraph-clusters")
    own = occurrences.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    of_node = own.join(named, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    clusters = of_node.groupBy("cluster").agg(F.min("least").alias("keep_id"), F.max("most").alias("last_id"))
    shared = clusters.where("keep_id < last_id").drop("last_id")
    # a stored row per node on the right, so that a passage with many occurrences can be split
    labels = cut_lineage(of_node.join(shared, "cluster").select("node", "cluster", "keep_id"), "passages")
    found = occurrences.join(labels, "node").withColumn("removed", F.col("doc_id") != F.col("keep_id"))
    names = ["doc_id", "version", "nth", "start", "end", "n_words", "cluster", "keep_id", "removed"]
    found = cut_lineage(found.select(*names), "paragraphs-shared")
    runs = repeated_runs(_rows(whole), cut_lineage(_spans(found.where("removed")), "paragraphs-gone"))
    return found.union(runs.withColumns({"nth": F.lit(-1).cast("long"), "removed": F.lit(True)}).select(*names))


def _spans(gone: DataFrame) -> DataFrame:
    """``doc_id, version, spans``: where the texts lose something, sorted."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")  # of one document
    return gone.groupBy("doc_id", "version").agg(spans)


def _without(text: Column, spans: Column) -> Column:
    """The text without sorted spans, which may overlap."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def further(done: Column, s: Column) -> Column:
        part = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.array_append(done["parts"], part).alias("parts"))

    def joined(done: Column) -> Column:
        rest = F.substring(text, (done["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(done["parts"], ""), rest)

    return F.aggregate(spans, zero, further, joined)


def drop_repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """All columns of ``docs``, texts without removed paragraphs and runs; documents left without a word go."""
    spans = _spans(repeated_passages(docs, doc_id, text, similarity, block).where("removed"))
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("version"))
    joined = rows.join(spans, ["doc_id", "version"], "left")
    shorter = _without(F.col("row")[text], F.col("spans"))
    kept = joined.withColumn("left", F.when(F.col("spans").isNotNull(), shorter).otherwise(F.col("row")[text]))
    kept = kept.where(F.col("spans").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[(F.col("left") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
