"""Token counts of documents from flat files of ids that have no index.

Files hold unsigned 16-bit or 32-bit ids and nothing else; a reserved id ends each document. They are cut
into blocks that tasks read and search on their own, as vectors. What a block cannot know - how many
documents ended before it and where the last of them did - comes from running totals over the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.files import listed, opened, whole_file
from palimpsest.llm.vocab import encoder, groups, strings
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, texts

# Bytes of a file that one task reads at a time.
BLOCK_BYTES = 8 << 20
ENDING = ".ids"


def write_flat_files(
    docs: DataFrame, folder: str, path: str, end_id: int, id_bytes: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write a flat file per task; ``shard, ordinal, doc_id`` of the documents in them, stored.

    Special tokens in texts are ordinary text, so ``end_id`` must be one of them. Empty and NULL
    texts are documents without ids.
    """

    def run(batches: Batches) -> Batches:
        part, coder, ordinal = TaskContext.get().partitionId(), encoder(path, True), 0
        kind = {2: "<u2", 4: "<u4"}[id_bytes]
        end = np.array([end_id], kind).tobytes()
        with whole_file(f"{folder.rstrip('/')}/{part:08d}{ENDING}") as out:
            for batch in batches:
                bodies = strings(batch.column("text"))
                for a, b in groups(bodies):
                    for ids in coder.encode(bodies[a:b]):
                        values = np.frombuffer(ids, "<u4")
                        if len(values) and values.max() >= 1 << (8 * id_bytes):
                            raise ValueError("the vocabulary needs wider ids")
                        out.write(values.astype(kind).tobytes() + end)
                n = len(bodies)
                places = pa.array(np.arange(ordinal, ordinal + n, dtype=np.int64))
                ordinal += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), places, batch.column("doc_id")], ["shard", "ordinal", "doc_id"]
                )

    rows = map_arrow(texts(docs, doc_id, text), run, "shard long, ordinal long, doc_id long")
    return cut_lineage(rows, "flat-documents")


def _separators(folder: str, end_id: int, id_bytes: int) -> object:
    def run(batches: Batches) -> Batches:
        kind = {2: "<u2", 4: "<u4"}[id_bytes]
        for batch in batches:
            for row in batch.to_pylist():
                with opened(f"{folder.rstrip('/')}/{row['shard']:08d}{ENDING}") as source:
                    source.seek(row["block"] * row["block_bytes"])
                    ids = np.frombuffer(source.read(row["block_bytes"]), kind)
                ends = np.flatnonzero(ids == end_id) + row["block"] * row["block_bytes"] // id_bytes
                n = len(ends)
                columns = [np.full(n, row["shard"]), np.full(n, row["block"]), np.arange(n), ends]
                before = pa.array(np.concatenate([[-1], ends[:-1]])[:n], mask=np.arange(n) == 0)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns), before], ["shard", "block", "nth", "end", "before"]
                )

    return run


def count_tokens(
    spark: SparkSession, folder: str, end_id: int, id_bytes: int = 2, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``shard, ordinal, start, n_tokens, ended`` of every document in the flat files of a folder.

    ``start`` is the first id's place in the file, ``n_tokens`` leaves the end out. Ids after the last
    end of a file are one more document with ``ended`` false. Files are listed by the driver, a row
    each; an empty folder gives no rows.
    """
    block_bytes -= block_bytes % id_bytes
    files = [(int(name.removesuffix(ENDING)), size) for name, size in listed(folder, ENDING)]
    sizes = spark.createDataFrame(files, "shard long, bytes long")
    last = f"cast(ceil(bytes / {block_bytes}) as long) - 1"
    blocks = sizes.where("bytes > 0").select(
        "shard", F.explode(F.expr(f"sequence(0L, {last})")).alias("block"), F.lit(block_bytes).alias("block_bytes")
    )
    found = map_arrow(
        blocks.repartition("shard", "block"),
        _separators(folder, end_id, id_bytes),
        "shard long, block long, nth long, end long, before long",
    )
    found = cut_lineage(found, "separators")
    # prefix scan over the blocks of each file; blocks without an end have no row and change nothing
    earlier = Window.partitionBy("shard").orderBy("block")
    totals = found.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("last"))
    carried = totals.select(
        "shard",
        "block",
        F.coalesce(F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("last", 1, -1).over(earlier).alias("carried"),
    )
    start = F.coalesce("before", "carried") + 1
    ended = found.join(carried, ["shard", "block"]).select(
        "shard",
        (F.col("base") + F.col("nth")).alias("ordinal"),
        start.alias("start"),
        (F.col("end") - start).alias("n_tokens"),
        F.lit(True).alias("ended"),
    )
    whole = totals.groupBy("shard").agg(F.sum("n").alias("ordinal"), (F.max("last") + 1).alias("start"))
    ids = F.floor(F.col("bytes") / id_bytes)
    rest = sizes.join(whole, "shard", "left").select(
        "shard",
        F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        F.coalesce("start", F.lit(0)).alias("start"),
        (ids - F.coalesce("start", F.lit(0))).alias("n_tokens"),
        F.lit(False).alias("ended"),
    )
    return ended.union(rest.where("n_tokens > 0"))
