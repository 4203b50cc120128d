"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Pieces are sorted by length and numbered inside each length; open sequences are sorted by the gap they
have left and numbered inside each gap. A round sweeps over lengths from long to short: the successor of
a length is the smallest gap that holds it. Which piece gets which gap is settled by rank: the k-th piece
still left of a length meets the k-th gap of its successor. Then gaps are updated, and the next round
begins. A gap takes one length per round, as many pieces of it as fit. Pieces that no gap of the round can
take wait for those that the round has shortened, as far as these have room for them; the others open new
sequences.

Lengths and gaps are whole numbers up to the capacity, so a sweep needs their counts alone, two small
tables; all pieces and gaps stay in Spark, where the sweep's ranges of ranks are joined to them. Each round
places something, and as pieces of one length go in together, few rounds follow the first.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.vocab import encoder, groups, strings
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, row_key, texts

CAPACITY = 1024
END_ID = 2
# Pieces of one length that one task numbers at most, about.
RANK_ROWS = 1000
_PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Every document's pieces, stored: ``key, doc_id, piece, start, length, ids_crc32``.

    ``key`` tells repeated rows apart. A NULL text counts as empty, which leaves the end id.
    """

    def run(batches: Batches) -> Batches:
        part, coder, made = TaskContext.get().partitionId(), encoder(path), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, bodies = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            found = []
            for a, b in groups(bodies):
                for name, ids in zip(names[a:b], coder.encode(bodies[a:b]), strict=True):
                    ids += end
                    for i, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                        found.append((row_key(part, made), name, i, start, n, crc))
                        made += 1
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["key", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut_lineage(map_arrow(texts(docs, doc_id, text), run, _PIECES), "pieces")


def _ranked(short: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Pieces numbered from 0 inside their length, in buckets, so that a frequent length is many tasks' work."""
    rows = [(n, 1 + count // RANK_ROWS) for n, count in lengths.items()]
    dealt = short.join(_small(short, rows, "length long, buckets long"), "length")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets"))).drop("buckets")
    inside = Window.partitionBy("length", "bucket").orderBy("key")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = dealt.withColumn("nth", F.row_number().over(inside)).join(bases, ["length", "bucket"])
    return numbered.withColumn("rank", F.col("base") + F.col("nth") - 1).drop("bucket", "nth", "base")


class Match(NamedTuple):
    """Pieces ``first_piece ..`` of a length, ``each`` per gap, to gaps ``first_gap ..`` of a size.

    ``gap`` is the capacity and ``opens`` set for sequences that begin here; ``first_gap`` is then
    a sequence number.
    """

    length: int
    first_piece: int
    end_piece: int
    each: int
    gap: int
    first_gap: int
    opens: bool


class Move(NamedTuple):
    """Gaps ``first .. end`` of a size become gaps of another size, numbered from ``first_new``."""

    gap: int
    first: int
    end: int
    new_gap: int
    first_new: int
    opens: bool


class Sweeper:
    """Counts of what is left, and the sweep of one round over them."""

    def __init__(self, lengths: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.total = dict(lengths)
        self.left = dict(lengths)
        self.gaps: dict[int, int] = {}
        self.sequences = 0

    def sweep(self) -> tuple[list[Match], list[Move]]:
        """One round; counts are up to date afterwards."""
        taken: dict[int, int] = dict.fromkeys(self.gaps, 0)
        free = sorted(self.gaps)
        matches: list[Match] = []
        # shortened gaps: size, and the range they come from
        shortened: list[tuple[int, int, int, int, bool]] = []
        # the room in them, less what waits for it
        room: dict[int, int] = {}

        def wait(length: int, count: int) -> int:
            """How many of ``count`` pieces find room in shortened gaps, smallest first."""
            found = 0
            for gap in sorted(g for g, n in room.items() if g >= length and n):
                if found == count:
                    break
                each = gap // length
                gaps = min(room[gap], -(-(count - found) // each))
                taking = min(count - found, gaps * each)
                room[gap] -= gaps
                last = taking - each * (gaps - 1)
                add_room(gap - each * length, gaps - 1)
                add_room(gap - last * length, 1)
                found += taking
            return found

        def add_room(gap: int, gaps: int) -> None:
            if gap and gaps:
                room[gap] = room.get(gap, 0) + gaps

        def place(length: int, gap: int, each: int, gaps: int, first_gap: int, count: int, opens: bool) -> None:
            at = self.total[length] - self.left[length]
            matches.append(Match(length, at, at + count, each, gap, first_gap, opens))
            self.left[length] -= count
            rest = count - each * (gaps - 1)  # the last gap may take fewer
            full = gaps if rest == each else gaps - 1
            if full:
                shortened.append((gap - each * length, gap, first_gap, first_gap + full, opens))
                add_room(gap - each * length, full)
            if full < gaps:
                shortened.append((gap - rest * length, gap, first_gap + full, first_gap + gaps, opens))
                add_room(gap - rest * length, 1)

        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            # lengths fall, so gaps below this one stay for later lengths
            while self.left[length]:
                gap = next((g for g in free if g >= length and taken[g] < self.gaps[g]), None)
                if gap is None:
                    break
                each = gap // length
                gaps = min(self.gaps[gap] - taken[gap], -(-self.left[length] // each))
                count = min(self.left[length], gaps * each)
                place(length, gap, each, gaps, taken[gap], count, False)
                taken[gap] += gaps
            count = self.left[length] - wait(length, self.left[length])
            if count:
                each = self.capacity // length
                gaps = -(-count // each)
                first, self.sequences = self.sequences, self.sequences + gaps
                place(length, self.capacity, each, gaps, first, count, True)
        least = min((x for x, n in self.left.items() if n), default=None)
        counts: dict[int, int] = {}
        moves = []
        for gap, n in self.gaps.items():
            shortened.append((gap, gap, taken[gap], n, False))
        for new, gap, first, end, opens in shortened:
            # gaps that hold nothing that is left are closed
            if end > first and least is not None and new >= least:
                moves.append(Move(gap, first, end, new, counts.get(new, 0), opens))
                counts[new] = counts.get(new, 0) + end - first
        self.gaps = counts
        return matches, moves


def _small(df: DataFrame, rows: list, schema: str) -> DataFrame:
    # a few rows per length and gap size, whatever the number of documents
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in rows], schema))


_MATCH = "m_length long, first_piece long, end_piece long, each long, m_gap long, first_gap long, opens boolean"
_MOVE = "m_gap long, first long, end long, new_gap long, first_new long, opens boolean"
_OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and place of every piece of ``pieces``; offsets in a sequence leave no hole.

    Sequences of one whole piece have negative numbers. No pieces give no rows.
    """
    whole = found.where(F.col("length") == capacity)
    whole = whole.withColumns({"sequence_id": -F.col("key") - 1, "offset": F.lit(0).cast("long")})
    short = found.where(F.col("length") < capacity)
    lengths = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = cut_lineage(_ranked(short, lengths), "ranked-pieces")
    sweeper, gaps = Sweeper(lengths, capacity), None
    parts = [whole.select(*_OUT)]
    while any(sweeper.left.values()):
        matches, moves = sweeper.sweep()
        plan = _small(ranked, matches, _MATCH)
        here = (F.col("length") == F.col("m_length")) & (F.col("rank") >= F.col("first_piece"))
        met = ranked.join(plan, here & (F.col("rank") < F.col("end_piece")))
        turn = F.col("rank") - F.col("first_piece")
        met = met.withColumn("gap_rank", F.col("first_gap") + F.floor(turn / F.col("each")))
        met = met.withColumn("nth", turn % F.col("each"))
        new = met.where("opens").withColumn("sequence_id", F.col("gap_rank"))
        placed = new
        if gaps is not None:
            old = met.where("NOT opens").join(
                gaps, (F.col("m_gap") == F.col("gap")) & (F.col("gap_rank") == F.col("g_rank"))
            )
            placed = new.unionByName(old.select(*new.columns))
        placed = placed.withColumn("offset", F.lit(capacity) - F.col("m_gap") + F.col("nth") * F.col("length"))
        # the first piece of a new sequence tells what its round leaves of it
        begun = F.col("sequence_id") - F.col("first_gap")
        filled = F.least("each", F.col("end_piece") - F.col("first_piece") - begun * F.col("each")) * F.col("length")
        rest = F.when(F.col("opens") & (F.col("nth") == 0), capacity - filled)
        placed = cut_lineage(placed.select(*_OUT, rest.alias("rest")), "placed-pieces")
        parts.append(placed.select(*_OUT))
        steps = _small(ranked, moves, _MOVE)
        inside = lambda rank: (rank >= F.col("first")) & (rank < F.col("end"))
        began = placed.where("rest IS NOT NULL").select("sequence_id", "rest").join(
            steps.where("opens"), (F.col("rest") == F.col("new_gap")) & inside(F.col("sequence_id"))
        )
        shape = ["sequence_id", F.col("new_gap").alias("gap")]
        after = began.select(*shape, (F.col("first_new") + F.col("sequence_id") - F.col("first")).alias("g_rank"))
        if gaps is not None:
            kept = gaps.join(
                steps.where("NOT opens").withColumnRenamed("opens", "s_opens"),
                (F.col("gap") == F.col("m_gap")) & inside(F.col("g_rank")),
            )
            kept = kept.select(
                "sequence_id", "new_gap", (F.col("first_new") + F.col("g_rank") - F.col("first")).alias("g_rank")
            )
            after = after.union(kept)
        gaps = cut_lineage(after, "gaps")
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, cut and pack documents: a row per piece."""
    return pack(pieces(docs, path, capacity, end_id, doc_id, text), capacity)
