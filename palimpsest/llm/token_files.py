"""Documents to compressed token files in the order of their ids, and back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palimpsest.llm import rans
from palimpsest.llm.files import opened, size_of, whole_file
from palimpsest.llm.vocab import encoder, groups, strings
from palimpsest.llm.work import Batches, cut_lineage, map_arrow, running_total, texts

END_ID = 2
# Ids after which a task begins a new file: what it holds in memory at most, and a document.
FILE_IDS = 16_000_000
# Blocks that a task decodes, about.
BLOCKS_PER_TASK = 4
_BLOCKS = "part long, file long, block long, path string, n_ids long, n_docs long"


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write files by ascending id to ``folder``; one stored row per block of what was written.

    Rows are dealt by ranges of ids, so files and blocks ascend with ``part, file, block``. NULL ids
    come first, rows of one id keep together, NULL texts count as empty.
    """

    def run(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        coder = encoder(path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        file, size = 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{folder.rstrip('/')}/part-{part:06d}-{file:04d}.tokens"
            with whole_file(name) as out:
                blocks = rans.write_file(out, held)
            n = len(blocks)
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * n), pa.array([file] * n), pa.array(range(n), pa.int64()), pa.array([name] * n),
                 pa.array([b.ids for b in blocks]), pa.array([b.documents for b in blocks])],
                ["part", "file", "block", "path", "n_ids", "n_docs"],
            )

        for batch in batches:
            names, bodies = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            for a, b in groups(bodies):
                for name, ids in zip(names[a:b], coder.encode(bodies[a:b]), strict=True):
                    held.append((name, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= FILE_IDS:
                        yield flush()
                        held.clear()
                        file, size = file + 1, 0
        if held:
            yield flush()

    ordered = texts(docs, doc_id, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut_lineage(map_arrow(ordered, run, _BLOCKS), "token-blocks")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files that ``blocks`` names.

    ``start`` counts the ids of all documents before. Blocks are decoded in any order by any task; each
    holds whole documents.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as source:
                    file = rans.TokenFile(source, size_of(row["path"]))
                    found = [
                        (doc, row["base"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc, at, ids in file.documents_of(row["block"])
                    ]
                columns = list(zip(*found, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    placed = running_total(blocks, "part", ["file", "block"], "n_ids", "base").select("path", "block", "base")
    # a row stands for megabytes: by their size alone the rows would all go to one task
    dealt = placed.repartition(1 + blocks.count() // BLOCKS_PER_TASK, "path", "block")
    return map_arrow(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
