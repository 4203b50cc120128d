"""What every filter of a set does in every order they can be applied in.

Each document gets a mask with a bit per filter that it fails. Four filters look at the document alone. The
fifth, equality with the text of a smaller id, is answered by radix tries: compressed tries over whole
texts, with the smallest id at each terminal. A task first inserts the texts it reads and passes on one
row per distinct text, so that a group of copies comes down to a row per block of input. These rows are
dealt by ranges of text prefixes: 16 bytes, more where many texts begin alike, and where very many
rows hold one text, that text in parts which are merged first. The tries of a range are walked again to tell
every text the smallest id of its equals. Masks are counted per part, and all orders follow from the
counts.

A NULL text counts as empty, a NULL part as the empty string. A NULL id is smaller than none and no copy
of any. Every row is a document, repeated rows too: rows of one id and text are no copies of each other. A
document has a quality or is toxic if any of its labels says so; one without label does not. An empty
table has no parts and no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import Batches, arrow_batches, cut_lineage, map_arrow, row_key

FILTERS = "ABCDE"
MIN_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Bytes of text in a trie that a task builds over its input. A worker holds the texts of a block twice, as
# they came and in the trie.
BLOCK_BYTES = 8_000_000
# What a row takes in a block besides its text.
ROW_BYTES = 250
# Bytes of text in a batch that goes to a worker or comes from it, one text at least.
BATCH_BYTES = 2_000_000
# Bytes of the prefixes that texts are dealt by, and of all texts with one prefix beyond which
# more of the text is taken.
PREFIXES = (16, 256)
HOT_BYTES = 16_000_000
# Parts into which the rows of one very frequent text are merged first.
SALTS = 16
# Frequent prefixes that are broadcast at most.
BROADCAST_ROWS = 200_000


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails, A lowest."""
    words = text.split()  # of bytes: ASCII white space
    n = len(words)
    few = n < MIN_WORDS
    alike = 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * n
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    loud = 100 * capitals > MOST_CAPITALS_PERCENT * len(text.decode("utf-8", "replace"))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few | alike << 1 | loud << 2 | symbols << 3


# ---------------------------------------------------------------- radix tries


class Node:
    """A place in a trie: edges by their first byte, and what the terminal here holds."""

    __slots__ = ("edges", "least", "first")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.least: int | None = None
        self.first: int | None = None


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of a label stand in the text from ``at`` on; the first does."""
    low, high = 1, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie over whole texts."""

    def __init__(self) -> None:
        self.root = Node()

    def terminal(self, text: bytes) -> Node:
        """The node of a text, put in where it is missing."""
        node, at = self.root, 0
        while at < len(text):
            edge = node.edges.get(text[at])
            if edge is None:
                node.edges[text[at]] = (text[at:], leaf := Node())
                return leaf
            label, below = edge
            if text.startswith(label, at):
                node, at = below, at + len(label)
                continue
            shared = _shared(label, text, at)
            fork = Node()
            fork.edges[label[shared]] = (label[shared:], below)
            node.edges[text[at]] = (label[:shared], fork)
            node, at = fork, at + shared
        return node


def _lower(least: int | None, doc: int | None) -> int | None:
    return least if doc is None else doc if least is None else min(least, doc)


# ---------------------------------------------------------------- masks


_JUDGED = "doc_id long, part string, mask int, cls long, least long, text binary"


def _judge(batches: Batches) -> Batches:
    """Masks of A to D and the class of each row among the texts of its block; one row of a class has its text."""
    counter = 0
    for ids, parts, bodies in _blocks(batches):
        trie, ends = Trie(), []
        for doc, body in zip(ids, bodies, strict=True):
            node = trie.terminal(body)
            node.least = _lower(node.least, doc)
            ends.append(node)
        classes, texts = [], []
        for node, body in zip(ends, bodies, strict=True):
            texts.append(body if node.first is None else None)
            if node.first is None:
                node.first = row_key(TaskContext.get().partitionId(), counter)
                counter += 1
            classes.append(node.first)
        masks = [failures(body) for body in bodies]
        least = [node.least for node in ends]
        for run in _runs(texts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[run], pa.int64()),
                    pa.array(parts[run], pa.string()),
                    pa.array(masks[run], pa.int32()),
                    pa.array(classes[run], pa.int64()),
                    pa.array(least[run], pa.int64()),
                    pa.array(texts[run], pa.binary()),
                ],
                ["doc_id", "part", "mask", "cls", "least", "text"],
            )


def _runs(bodies: list[bytes | None]) -> Iterator[slice]:
    """Rows after each other that have a bounded number of bytes of text, one text at least."""
    begin, held = 0, 0
    for at, body in enumerate(bodies):
        size = len(body or b"")
        if held and held + size > BATCH_BYTES:
            yield slice(begin, at)
            begin, held = at, 0
        held += size
    yield slice(begin, len(bodies))


def _blocks(batches: Batches) -> Iterator[tuple[list, list, list]]:
    """Ids, parts and texts of a bounded number of bytes, one text at least."""
    ids, parts, bodies, held = [], [], [], 0
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        for doc, part, body in zip(batch.column("doc_id"), batch.column("part"), text, strict=True):
            body = body.as_py() or b""
            if held and held + len(body) > BLOCK_BYTES:
                yield ids, parts, bodies
                ids, parts, bodies, held = [], [], [], 0
            ids.append(doc.as_py())
            parts.append(part.as_py())
            bodies.append(body)
            held += len(body) + ROW_BYTES
    if ids:
        yield ids, parts, bodies


# ---------------------------------------------------------------- copies


_KEY = ["head", "more", "whole", "salt"]


def _hot(rows: DataFrame, *key: str) -> DataFrame:
    """Stored keys whose texts have more bytes than a trie should hold."""
    sums = rows.groupBy(*key).agg(F.sum(F.col("bytes") + 64).alias("bytes")).where(F.col("bytes") > HOT_BYTES)
    return cut_lineage(sums.select(*key), "audit-hot")


def _marked(rows: DataFrame, hot: DataFrame, key: str, otherwise: Column, name: str) -> DataFrame:
    """``name`` is filled in where the row's key is hot, 0 elsewhere."""
    few = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    joined = rows.join(few.withColumn("__hot", F.lit(True)), key, "left")
    return joined.withColumn(name, F.when(F.col("__hot"), otherwise).otherwise(F.lit(0).cast("long"))).drop("__hot")


def _dealt(classes: DataFrame) -> DataFrame:
    """Classes with the prefix key that they are dealt by, as long as it has to be."""
    rows = classes.withColumns({name: F.lit(0).cast("long") for name in _KEY[1:]})
    deeper = {
        "head": ("more", F.xxhash64(F.substring("text", 1, PREFIXES[1]))),
        "more": ("whole", F.xxhash64("text")),
        "whole": ("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)) + 1),
    }
    for key, (name, value) in deeper.items():
        in_question = rows if key == "head" else rows.where(F.col(key) != 0)
        hot = _hot(in_question, key)
        if hot.isEmpty():
            break
        rows = _marked(rows.drop(name), hot, key, value, name)
    return rows.drop("bytes")


def _merge(batches: Batches) -> Batches:
    """Per class the first class of its text and the smallest id of all; a new trie where the key changes."""
    key, trie, ends, held, texts = None, Trie(), [], 0, []

    def told() -> Batches:
        for run in _runs(texts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cls for cls, _ in ends[run]], pa.int64()),
                    pa.array([node.first for _, node in ends[run]], pa.int64()),
                    pa.array([node.least for _, node in ends[run]], pa.int64()),
                    pa.array(texts[run], pa.binary()),
                ],
                ["cls", "first", "least", "text"],
            )

    for batch in batches:
        columns = [batch.column(c) for c in (*_KEY, "cls", "least", "text")]
        for *this, cls, least, body in zip(*columns, strict=True):
            this = tuple(v.as_py() for v in this)
            if this != key and held > BLOCK_BYTES:
                yield from told()
                trie, ends, held, texts = Trie(), [], 0, []
            key, body, cls = this, body.as_py(), cls.as_py()
            node = trie.terminal(body)
            # rows of a part of a frequent text go on with it
            texts.append(body if node.first is None and this[-1] else None)
            if node.first is None:
                node.first = cls
                held += len(body) + 200
            held += 100
            node.least = _lower(node.least, least.as_py())
            ends.append((cls, node))
    if ends:
        yield from told()


def _tried(dealt: DataFrame, label: str) -> DataFrame:
    ranges = dealt.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).select(*_KEY, "cls", "least", "text")
    return _stored(map_arrow(ranges, _merge, "cls long, first long, least long, text binary"), label)


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """Rows of tries in a table; batches are small, as an executor's memory beside its heap holds several a task."""
    with arrow_batches(rows.sparkSession, BATCH_BYTES):
        return cut_lineage(rows, label)


def smallest_ids(classes: DataFrame) -> DataFrame:
    """``cls, lowest``: the smallest id of all rows with the text of a class (``cls, least, text, head, bytes``)."""
    dealt = _dealt(classes)
    split = dealt.where("salt > 0")
    if split.isEmpty():
        return _tried(dealt, "audit-tried").select("cls", F.col("least").alias("lowest"))
    parts = _tried(split, "audit-parts")
    own = parts.where("text IS NOT NULL").select("cls", "least", "text")
    again = own.withColumns(
        {
            "head": F.substring("text", 1, PREFIXES[0]),
            "more": F.xxhash64(F.substring("text", 1, PREFIXES[1])),
            "whole": F.xxhash64("text"),
            "salt": F.lit(0).cast("long"),
        }
    )
    whole = _tried(dealt.where("salt = 0").unionByName(again), "audit-tried")
    whole = whole.select("cls", F.col("least").alias("lowest"))
    of_parts = parts.select("cls", "first").join(whole.withColumnRenamed("cls", "first"), "first").select("cls", "lowest")
    return whole.join(parts.select("cls"), "cls", "left_anti").unionByName(of_parts)


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every row: a bit per filter failed, A lowest."""
    rows = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        docs[text].cast("string").alias("text"),
    )
    # the first bytes and the length of texts stand apart, so that counting prefixes reads no texts
    apart = {"head": F.substring("text", 1, PREFIXES[0]), "bytes": F.length("text").cast("long")}
    judged = _stored(map_arrow(rows, _judge, _JUDGED).withColumns(apart), "audit-judged")
    lowest = smallest_ids(judged.where("text IS NOT NULL").select("cls", "least", "text", "head", "bytes"))
    copy = F.coalesce(F.col("doc_id") > F.col("lowest"), F.lit(False)).cast("int") * (1 << 4)
    return judged.select("doc_id", "part", "mask", "cls").join(lowest, "cls").select(
        "doc_id", "part", (F.col("mask") + copy).alias("mask")
    )


# ---------------------------------------------------------------- orders


def _orders() -> Column:
    """All orders and steps, with the step's bit and the bits before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            rows.append({"filter_order": name, "step": step, "bit": 1 << i, "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def _sum(held: Column, value: str, where) -> Column:
    """Sum of a field over the masks that a condition selects."""
    return F.aggregate(F.filter(held, where), F.lit(0).cast("long"), lambda total, m: total + m[value])


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """One row per part, order and step with what the step's filter does there.

    ``kept`` and ``removed`` after and at the step, ``redundant`` what the filter fails and others
    removed before, ``unique_fails`` what fails it alone, ``good_lost`` and ``toxic_lost`` of the removed,
    ``shapley`` the filter's removals summed over all orders.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy(labels["doc_id"].cast("long").alias("doc_id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    counted = (
        masks(docs, doc_id, text, part)
        .join(said, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
    )
    # at most a row per mask meets in a part
    of_part = cut_lineage(counted, "audit-masks").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("held"))
    steps = of_part.select("part", "held", F.inline(_orders()))
    held, bit, before = F.col("held"), F.col("bit"), F.col("before")

    def fails(m: Column) -> Column:
        return m["mask"].bitwiseAND(bit) != 0

    def caught(m: Column) -> Column:
        return m["mask"].bitwiseAND(before) != 0

    def removed(m: Column) -> Column:
        return fails(m) & ~caught(m)

    # of documents that fail k filters each of the k comes first in one of k orders
    orders = F.size(_orders()) / len(FILTERS)
    share = F.aggregate(
        F.filter(held, fails), F.lit(0).cast("long"), lambda s, m: s + m["n"] * (orders / F.bit_count(m["mask"])).cast("long")
    )
    return steps.select(
        "part",
        "filter_order",
        "step",
        _sum(held, "n", lambda m: ~fails(m) & ~caught(m)).alias("kept"),
        _sum(held, "n", removed).alias("removed"),
        _sum(held, "n", lambda m: fails(m) & caught(m)).alias("redundant"),
        _sum(held, "n", lambda m: m["mask"] == bit).alias("unique_fails"),
        _sum(held, "good", removed).alias("good_lost"),
        _sum(held, "bad", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )
