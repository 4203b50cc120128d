"""Word runs that an earlier document has too, wherever they begin and end.

The words of a text are one sequence, line ends included.
Of every window of consecutive grams the one with the least hash is an anchor, so equal runs of ``RUN_WORDS``
words have an anchor in common whatever stands around them. Every run of ``RUN_WORDS`` words that holds an anchor
which several documents share is compared by its hash, as a whole. A word goes if and only if it is in such a run
that a document with a smaller id holds too, in one piece. Given spans of a text are gone already: a run that
reaches into them in one document does not keep that document's words for others, but goes like any other where
it is repeated itself; a run inside a span is not looked at.

Rows without id or text have no runs. Rows that repeat an id are one document; where they repeat its text too,
they give the same run once for each. The smallest id keeps a run, so equal texts of one id keep all of theirs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.vocab import groups, strings
from palimpsest.llm.work import Batches, cut_lineage, map_arrow
from palimpsest.operators.fetched import possibly_among

# Shorter runs are no passages.
RUN_WORDS = 50
GRAM = 25
# Grams in a run of the least length, and so those of a window that holds an anchor.
WINDOW = RUN_WORDS - GRAM + 1
# Runs that are handed on at once.
NEAR_ROWS = 50_000
# Longer words, in bytes, are hashed one by one.
SHORT = 64
_FACTOR = 0x100000001B3
# White space among the first characters; there is none behind them.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
_BLANK_BYTE = np.array([c < 128 and chr(c).isspace() for c in range(256)])
_OTHER_BLANKS = [chr(c) for c in np.flatnonzero(_BLANK).tolist() if c > 127]
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _scan(body: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text in UTF-8 behind one blank, and where its words begin and end there."""
    for c in _OTHER_BLANKS:
        if c in body:
            body = body.replace(c, " ")
    data = f" {body} ".encode()
    blank = _BLANK_BYTE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return data, edges[::2], edges[1::2]


def _hashed(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, eight bytes at a time."""
    sizes = ends - starts
    eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
    values, rest = mixed(sizes.astype(np.uint64)), np.arange(len(sizes))
    for k in range(0, SHORT, 8):
        rest = rest[sizes[rest] > k]
        if not len(rest):
            break
        piece = eights[starts[rest] + k] & _FIRST_BYTES[np.minimum(sizes[rest] - k, 8)]
        values[rest] = mixed(values[rest] ^ piece)
    for row in np.flatnonzero(sizes > SHORT).tolist():
        values[row] = xxhash.xxh3_64_intdigest(data[starts[row] : ends[row]])
    return values


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """A hash of every word, none empty or with white space."""
    return _hashed(*_scan(" ".join(words)))


def text_words(bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts in small letters, where each begins in its text, and how many each text has."""
    body = "\n".join(bodies)
    low = body.lower()
    data, starts, ends = _scan(low)
    hashes = _hashed(data, starts, ends)
    if len(low) != len(body):  # a letter has become two
        data, starts, ends = _scan(body)
    if len(data) > len(body) + 2:
        starts = np.cumsum(np.frombuffer(data, np.int8) >= -64, dtype=np.int32)[starts] - 1
    starts = starts - 1
    first = np.cumsum([0, *(len(t) + 1 for t in bodies)])
    edges = np.searchsorted(starts, first)
    counts = np.diff(edges)
    return hashes, starts - np.repeat(first[:-1], counts), counts


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A polynomial of every ``width`` consecutive values, put together from those of powers of two."""
    out, have, block, size = None, 0, values, 1
    while width:
        factor = np.uint64(pow(_FACTOR, size, 1 << 64))
        if width & 1:
            n = len(values) - have - size + 1
            out = block if out is None else out[:n] * factor + block[have : have + n]
            have += size
        width >>= 1
        if width:
            block, size = block[:-size] * factor + block[size:], 2 * size
    return out


def grams(values: np.ndarray, sizes: np.ndarray, width: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Odd hashes of the runs of ``width`` words of several pieces, which have as many at least, and how many each has."""
    rolled = mixed(_rolled(values, width))
    counts = sizes - width + 1
    first = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    return rolled[at] | np.uint64(1), counts


def word_edges(text: str) -> np.ndarray:
    """Where the words of a text begin, and where each ends with the blanks behind it that are no line end."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = _BLANK[np.minimum(points, len(_BLANK) - 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    lines = np.append(np.flatnonzero(points == ord("\n")), len(points))
    following = np.append(starts[1:], len(points))[: len(starts)]
    return np.stack([starts, np.minimum(following, lines[np.searchsorted(lines, ends)])], axis=1).astype(np.int64)


def _over_windows(values: np.ndarray, least: bool) -> np.ndarray:
    """The least or largest of every ``WINDOW`` consecutive values."""
    pick, width = (np.minimum if least else np.maximum), 1
    while 2 * width <= WINDOW:
        values, width = pick(values[:-width], values[width:]), 2 * width
    rest = WINDOW - width
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the grams that are least, or as little as the least, in a window inside their piece."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    piece = np.repeat(np.arange(len(counts)), counts)
    least = _over_windows(hashes, True)
    # hashes are odd, so that 0 marks windows that reach into the next piece
    least[piece[: len(least)] != piece[WINDOW - 1 :]] = 0
    around = np.zeros(WINDOW - 1, np.uint64)
    return np.flatnonzero(_over_windows(np.concatenate([around, least, around]), False) == hashes)


def _columns(values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64, copy=False)) for v in values], names)


def _anchors(batches: Batches) -> Batches:
    """The anchors of every text of words enough, and where the first and the last word begin of the runs that hold each."""
    names = ["doc_id", "version", "gram", "at", "first", "last"]
    for batch in batches:
        bodies = strings(batch.column("text"))
        for a, b in groups(bodies):
            words, places, sizes = text_words(bodies[a:b])
            long = sizes >= RUN_WORDS
            if not long.any():
                continue
            inside = np.repeat(long, sizes)
            words, places, sizes = words[inside], places[inside], sizes[long]
            hashes, counts = grams(words, sizes)
            chosen = anchors(hashes, counts)
            begins = np.cumsum(counts) - counts
            text = np.searchsorted(begins, chosen, "right") - 1
            at = chosen - begins[text]
            word = (np.cumsum(sizes) - sizes)[text]
            first = places[word + np.maximum(at - WINDOW + 1, 0)]
            last = places[word + np.minimum(at + RUN_WORDS, sizes[text]) - 1]
            offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
            lists = [pa.array(hashes[chosen].view(np.int64)), *(pa.array(v.astype(np.int32)) for v in (at, first, last))]
            rows = pa.array(np.flatnonzero(long) + a)
            ids = [batch.column(c).take(rows) for c in names[:2]]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.ListArray.from_arrays(offsets, v) for v in lists)], names)


def _merged(spans: list[dict[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted spans begin and end, those that touch as one."""
    starts, ends = (np.array([s[k] for s in spans], np.int64) for k in ("start", "end"))
    ends = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(new[1:], True)]


def _live(batches: Batches) -> Batches:
    """A row per anchor, without those that lie in gone words with every run that holds them."""
    names = ["gram", "doc_id", "version", "at"]
    for batch in batches:
        lists = [batch.column(c) for c in ("gram", "at", "first", "last")]
        gram, at, first, last = (v.flatten().to_numpy() for v in lists)
        sizes = lists[0].value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        live = np.ones(len(gram), bool)
        spans = batch.column("spans")
        for row in np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist():
            own, gone = slice(ends[row] - sizes[row], ends[row]), spans[row].as_py()
            if not gone:
                continue
            start, end = _merged(gone)
            found = np.searchsorted(start, first[own], "right") - 1
            live[own] = (found < 0) | (end[found] <= last[own])
        doc, version = (np.repeat(batch.column(c).to_numpy(), sizes)[live] for c in ("doc_id", "version"))
        yield _columns([gram[live], doc, version, at[live]], names)


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def _near(batches: Batches) -> Batches:
    """The runs of ``RUN_WORDS`` words around the anchors of a text that are not gone, with the characters they take.

    ``part`` is 1 for those that reach into a span. The characters include blanks behind.
    """
    names = ["gram", "doc_id", "version", "at", "start", "end", "part"]
    order = ("doc_id", "version", "anchors", "spans", "text")
    for batch in batches:
        found, held_rows = [], 0
        for doc, version, places, spans, body in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
            words, edges = body.lower().split(), word_edges(body)
            count = len(words) - RUN_WORDS + 1
            places = np.array(places)
            around = _covered(np.maximum(places - WINDOW + 1, 0), np.minimum(places + 1, count), count)
            gone = np.zeros(len(words) + 1, np.int64)
            if spans:
                start, end = (np.searchsorted(edges[:, 0], edge) for edge in _merged(spans))
                gone[1:] = np.cumsum(_covered(start, end, len(words)))
            held = gone[RUN_WORDS:] - gone[:-RUN_WORDS]
            at = np.flatnonzero(around & (held < RUN_WORDS))
            # only words of these runs are hashed
            wanted = np.flatnonzero(_covered(at, at + RUN_WORDS, len(words)))
            values = np.zeros(len(words), np.uint64)
            values[wanted] = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in wanted.tolist()), np.uint64, len(wanted))
            hashes = mixed(_rolled(values, RUN_WORDS))[at] | np.uint64(1)
            of_text = np.full((2, len(at)), [[doc], [version]])
            found.append([hashes.view(np.int64), *of_text, at, edges[at, 0], edges[at + RUN_WORDS - 1, 1], held[at] > 0])
            held_rows += len(at)
            if held_rows > NEAR_ROWS:
                yield _columns([np.concatenate(c) for c in zip(*found, strict=True)], names)
                found, held_rows = [], 0
        if found:
            yield _columns([np.concatenate(c) for c in zip(*found, strict=True)], names)


def _stretches(batches: Batches) -> Batches:
    """Runs that follow or overlap each other as one, from rows sorted by ``doc_id, version, at``."""
    names = ["doc_id", "version", "start", "end", "n_words", "cluster", "keep_id"]
    order = ["doc_id", "version", "at", "start", "end", "gram", "keep_id"]
    run: dict[str, int] | None = None

    def ended() -> list[list[int]]:
        if run is None:
            return []
        return [[*run["key"], run["start"], run["end"], run["at"] - run["first"] + RUN_WORDS, run["gram"], run["keep"]]]

    for batch in batches:
        out = []
        for doc, version, at, start, end, gram, keep in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
            # a row that repeats an id and a text gives the same run again
            if run and run["key"] == (doc, version) and at <= run["at"] + RUN_WORDS:
                run |= {"at": at, "end": end, "keep": min(run["keep"], keep)}
            else:
                out += ended()
                run = {"key": (doc, version), "first": at, "at": at, "start": start, "end": end, "gram": gram, "keep": keep}
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 7)], names)
    out = ended()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)


def repeated_runs(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc_id, version, start, end, n_words, cluster, keep_id`` of the runs that go.

    ``rows`` has ``doc_id, version, text``, ``gone`` stored ``doc_id, version, spans``: sorted structs of
    ``start, end`` that are gone. Texts are read twice and shuffled once. Only anchors of runs that are not gone count.
    """
    keys = "gram long, doc_id long, version long, at long"
    lists = "doc_id long, version long, gram array<long>, at array<int>, first array<int>, last array<int>"
    marks = map_arrow(rows, _anchors, lists).join(gone, ["doc_id", "version"], "left")
    marks = cut_lineage(map_arrow(marks, _live, keys), "run-anchors")
    several = F.min("doc_id") < F.max("doc_id")
    met = cut_lineage(marks.groupBy("gram").agg(several.alias("several")).where("several").select("gram"), "run-met")
    shared = marks.join(met, "gram").groupBy("doc_id", "version").agg(F.collect_set("at").alias("anchors"))
    wanted = cut_lineage(shared.join(gone, ["doc_id", "version"], "left"), "run-places")
    near = possibly_among(rows, "version", wanted.select("version").distinct()).join(wanted, ["doc_id", "version"])
    around = map_arrow(near, _near, keys + ", start long, end long, part long")
    around = cut_lineage(around, "run-grams")
    seen = around.groupBy("gram").agg(F.min(F.when(F.col("part") == 0, F.col("doc_id"))).alias("keep_id"), F.max("doc_id").alias("last_id"))
    # a stored row per run on the right, so that a run of many documents can be split
    seen = cut_lineage(seen.where("keep_id < last_id").drop("last_id"), "run-seen")
    later = around.join(seen, "gram").where("doc_id > keep_id")
    later = later.repartition("doc_id", "version").sortWithinPartitions("doc_id", "version", "at")
    shape = "doc_id long, version long, start long, end long, n_words long, cluster long, keep_id long"
    return map_arrow(later, _stretches, shape)
