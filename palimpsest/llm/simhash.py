"""Near duplicates by SimHash, found through segment bit counts.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Between two fingerprints the
Manhattan distance of the counts is at most the number of differing bits. Cut into two halves of 16
segments, vectors at a distance of 3 or less have a half in which they differ by 1 at most, so a grid of
half vectors, in which every fingerprint is entered at its own cell and at the cells one step above
it, brings every pair of similar fingerprints together in a cell: if halves differ by a step, the lower
one is entered at the cell of the upper. Inside a cell distances are taken exactly.

Equal fingerprints are one node. A cell returns links that connect what is similar, never all pairs; a
cell with many fingerprints is cut into blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, texts

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
# Fingerprints of a cell that one task compares with as many others.
BLOCK = 4096
_EVEN_BITS = 0x5555555555555555
_SLICE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the hashes of a text's word shingles; 0 without words."""
    words = text.lower().split()  # of bytes: ASCII letters, ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    total, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for start in range(0, total, _SLICE):
        part = words[start : start + _SLICE + shingle - 1]
        shifted = [part[k:] for k in range(shingle)]
        hashes = np.fromiter((digest(b" ".join(t), seed) for t in zip(*shifted, strict=False)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def version(text: Column) -> Column:
    """A number that tells the texts of one id apart; NULL counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, version, fp`` of every row, ``fp`` as a signed long; a NULL text has no words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            bodies = batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint(b.as_py() or b"") for b in bodies], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("version"), pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "fp"])

    rows = texts(docs, doc_id, text).withColumn("version", version(F.col("text")))
    return map_arrow(rows, run, "doc_id long, version long, fp long")


def bit_counts(fp: Column) -> Column:
    """Bit counts of all two-bit segments, each in the place of its segment."""
    low = fp.bitwiseAND(F.lit(_EVEN_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _cells(fp: Column) -> Column:
    """The cells of both halves: of the half vector and of all that are one step above it."""
    counts = bit_counts(fp)
    cells = []
    for half in (0, 1):
        own = F.shiftrightunsigned(counts, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        name = own + F.lit(half << 32)
        steps = [
            # a segment of two bits counts to 2 at most: there is no cell above
            F.when(F.shiftrightunsigned(own, 2 * k).bitwiseAND(F.lit(2)) == 0, name + F.lit(1 << (2 * k)))
            for k in range(16)
        ]
        cells += [name, *steps]
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def connect(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links that connect what lies within ``most`` bits, fewer than there are fingerprints.

    A search that goes on from every fingerprint reached to all that are not.
    """
    left = np.unique(fps)
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= most
            if near.any():
                front.extend(left[near])
                yield from ((int(at), int(r)) for r in left[near])
                left = left[~near]


def _links_of_cells(batches: Batches) -> Batches:
    """Links of every run of equal ``cell, part`` in sorted rows, which may span batches."""
    rest_cell, rest_part, rest_fp = (np.zeros(0, np.int64) for _ in range(3))

    def links(cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(cell)]])
        several = ends - starts > 1
        found = []
        for a, b in zip(starts[several], ends[several], strict=True):
            found += connect(fp[a:b].view(np.uint64), MAX_DISTANCE)
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    for batch in batches:
        cell, part, fp = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in (
            (rest_cell, "cell"), (rest_part, "part"), (rest_fp, "fp")))
        if not len(cell):
            continue
        last = np.flatnonzero((cell != cell[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield links(cell[:cut], part[:cut], fp[:cut])
        rest_cell, rest_part, rest_fp = cell[cut:], part[cut:], fp[cut:]
    if len(rest_cell):
        yield links(rest_cell, rest_part, rest_fp)


def similar_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` that connect all of ``fp`` (distinct) within ``MAX_DISTANCE`` bits.

    Not every similar pair is returned, but every two similar ones are connected by what is.
    """
    entered = nodes.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    # a block of a full cell meets every other block; parts are numbered a * blocks + b with a <= b
    full = entered.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    full = cut_lineage(full.withColumn("blocks", F.ceil(F.col("n") / block)), "full-cells")
    if full.isEmpty():
        dealt = entered.withColumn("part", F.lit(0).cast("long"))
    else:
        joined = entered.join(full, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        joined = joined.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        dealt = joined.withColumn("at", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(
            "cell", "fp", (F.least("own", "at") * F.col("blocks") + F.greatest("own", "at")).alias("part")
        )
    dealt = dealt.select("cell", "part", "fp").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return map_arrow(dealt, _links_of_cells, "u long, v long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, version, fp, component_id`` per row; a component is the smallest id that can be reached.

    Documents without words share the fingerprint 0 and are linked like others. NULL ids are in
    components but never their name, unless nothing else is there.
    """
    stored = cut_lineage(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = cut_lineage(stored.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    found = components(similar_links(nodes, block))
    members = found.join(nodes, found["node"] == nodes["fp"]).select("component", "node", "first_id")
    least = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = members.join(least, "component").select(F.col("node").alias("fp"), "component_id")
    # one stored row per fingerprint on the right: copies are split where they are many
    labels = nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return stored.join(cut_lineage(labels, "fingerprint-labels"), "fp").select("doc_id", "version", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component, that of the smallest id, with all its columns, whatever their names.

    Of rows that repeat this id one stays for each text. A NULL id stays where a component has no other.
    Empty and NULL texts are one component; an empty table gives no rows.
    """
    firsts = simhash_components(docs, doc_id, text).where("doc_id <=> component_id")
    firsts = firsts.groupBy(F.col("doc_id").alias("first_id"), F.col("version").alias("first_version"))
    firsts = cut_lineage(firsts.agg(F.count(F.lit(1)).alias("n")), "near-firsts")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].cast("long").alias("doc_id"), version(docs[text]).alias("version")
    )
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("version") == F.col("first_version"))
    kept = rows.join(firsts.where("n = 1"), same, "left_semi")
    repeated = firsts.where("n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "version"]))
    return kept.select("row.*")
