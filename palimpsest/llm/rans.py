"""Token files by static range asymmetric numeral systems.

A file holds a header with the frequency table that all its blocks share, then blocks of whole documents,
then an index and a trailer. The ids of a block are dealt over interleaved lanes, coded together as one
vector. Every so many steps the lanes' states and the place in the words are noted as a checkpoint, from
which decoding can begin, so the parts of a block are decoded side by side. Checksums cover the table,
the index, each block's payload and its ids.

    header   magic, scale bits, symbols, size of the packed table, its crc32, packed table
    block    packed words (unsigned 32 bits), checkpoints (place, then a state per lane)
    index    packed numbers: blocks, then documents
    trailer  place and size of the index, its crc32, magic

A state stays between 2**32 and 2**64 and gives or takes words of 32 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

MAGIC = b"RANSTOK1"
SCALE_BITS = 20
LANES = 2048
# Steps from one checkpoint to the next, and ids after which a block ends with its document.
CHECKPOINT_STEPS = 256
BLOCK_IDS = 4 * LANES * CHECKPOINT_STEPS
_HEAD = struct.Struct("<8sIIII")
_TRAILER = struct.Struct("<QQI8s")
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


class Table(NamedTuple):
    """Frequencies that sum to ``2**SCALE_BITS``, and what coding looks up in them."""

    freq: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        freq = freq.astype(np.uint64)
        return cls(freq, np.cumsum(freq) - freq)

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        """Counts scaled so that every id that occurs keeps a frequency of 1 at least."""
        counts = counts.astype(np.float64)
        if np.count_nonzero(counts) < 2:  # one id alone would leave no room below the scale
            counts = np.append(counts, [0.0] * max(0, 2 - len(counts)))
            counts[np.flatnonzero(counts == 0)[0]] = 1
        used, total = counts > 0, 1 << SCALE_BITS
        if used.sum() > total // 2:
            raise ValueError("more ids than the scale has room for")
        freq = np.where(used, np.maximum(1, np.floor(counts / counts.sum() * (total - used.sum()))), 0)
        freq[np.argmax(freq)] += total - freq.sum()
        return cls.of(freq)

    def symbols(self) -> np.ndarray:
        """The id of every place below the scale."""
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Words and checkpoints ``(place, states)`` of one block, the first checkpoint at its start."""
    steps = -(-len(ids) // LANES)
    rows = np.concatenate([ids, np.full(steps * LANES - len(ids), ids[-1], ids.dtype)]).reshape(steps, LANES)
    limit = table.freq << np.uint64(64 - SCALE_BITS)
    state = np.full(LANES, 1 << 32, np.uint64)
    pieces, written, marks = [], 0, []
    shift = np.uint64(SCALE_BITS)
    for step in range(steps - 1, -1, -1):
        row = rows[step]
        freq = table.freq[row]
        full = state >= limit[row]
        if full.any():
            words = (state[full] & _LOW).astype(np.uint32)
            state[full] >>= _32
            pieces.append(words)
            written += len(words)
        whole = state // freq
        state = (whole << shift) + (state - whole * freq) + table.start[row]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(pieces[::-1]) if pieces else np.zeros(0, np.uint32)
    return words, [(written - place, states) for place, states in marks[::-1]]


def decode_block(words: np.ndarray, marks: list[tuple[int, np.ndarray]], n: int, table: Table) -> np.ndarray:
    """The ids of one block, its parts between checkpoints decoded side by side."""
    steps = -(-n // LANES)
    symbols, mask, shift = table.symbols(), np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    out = np.empty((steps, LANES), np.uint32)
    state = np.array([s for _, s in marks], np.uint64)
    place = np.array([p for p, _ in marks], np.int64)
    begin = np.arange(len(marks)) * CHECKPOINT_STEPS
    for step in range(min(CHECKPOINT_STEPS, steps)):
        if begin[-1] + step >= steps and len(state) == len(marks):  # the last part is shorter
            state, place, begin = state[:-1], place[:-1], begin[:-1]
            if not len(begin):
                break
        slot = state & mask
        ids = symbols[slot]
        out[begin[: len(state)] + step] = ids
        state = table.freq[ids] * (state >> shift) + slot - table.start[ids]
        low = state <= _LOW
        taken = low.sum(axis=1)
        at = place[:, None] + np.cumsum(low, axis=1) - 1
        state[low] = (state[low] << _32) | words[at[low]]
        place = place + taken
    return out.reshape(-1)[:n]


class Block(NamedTuple):
    """Where a block lies and which documents it holds."""

    offset: int
    size: int
    words: int
    marks: int
    ids: int
    payload_crc: int
    ids_crc: int
    documents: int


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<i8").tobytes(), 1)


def _counts(raws: list[bytes]) -> np.ndarray:
    """How often each id occurs, counted over many documents at a time."""
    counts, held, size = np.zeros(1, np.int64), [], 0
    for i, raw in enumerate(raws):
        held.append(raw)
        size += len(raw) // 4
        if size >= BLOCK_IDS or i == len(raws) - 1:
            found = np.bincount(np.frombuffer(b"".join(held), "<u4"), minlength=len(counts))
            found[: len(counts)] += counts
            counts, held, size = found, [], 0
    return counts


def write_file(out: object, documents: list[tuple[int | None, bytes]]) -> list[Block]:
    """Write documents ``(id, ids)``, in the given order, to an open binary file."""
    table = Table.scaled(_counts([raw for _, raw in documents]))
    packed = zlib.compress(table.freq.astype("<u4").tobytes(), 6)
    head = _HEAD.pack(MAGIC, SCALE_BITS, len(table.freq), len(packed), zlib.crc32(packed))
    out.write(head + packed)
    place, blocks, held, size = len(head) + len(packed), [], [], 0
    for i, (_, raw) in enumerate(documents):
        held.append(raw)
        size += len(raw) // 4
        if size >= BLOCK_IDS or i == len(documents) - 1:
            whole = b"".join(held)
            ids = np.frombuffer(whole, "<u4")
            words, marks = encode_block(ids, table) if len(ids) else (np.zeros(0, np.uint32), [])
            payload = words.astype("<u4").tobytes() + b"".join(
                struct.pack("<Q", at) + states.astype("<u8").tobytes() for at, states in marks
            )
            out.write(payload)
            blocks.append(
                Block(place, len(payload), len(words), len(marks), len(ids), zlib.crc32(payload), zlib.crc32(whole), len(held))
            )
            place, held, size = place + len(payload), [], 0
    lengths = [len(raw) // 4 for _, raw in documents]
    # ids of documents that are NULL are marked in a row of their own
    names = [d for d, _ in documents]
    index = b"".join(
        struct.pack("<I", len(p)) + p
        for p in map(
            _pack,
            (
                np.array(blocks, np.int64).reshape(-1),
                np.array([0 if d is None else d for d in names], np.int64),
                np.array([d is None for d in names], np.int64),
                np.array(lengths, np.int64),
            ),
        )
    )
    out.write(index + _TRAILER.pack(place, len(index), zlib.crc32(index), MAGIC))
    return blocks


class TokenFile:
    """An open token file; ``source`` reads at any place."""

    def __init__(self, source: object, size: int) -> None:
        self.source = source
        place, length, crc, magic = _TRAILER.unpack(self._at(size - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        index = self._checked(place, length, crc, "index")
        parts, at = [], 0
        while at < len(index):
            (n,) = struct.unpack_from("<I", index, at)
            parts.append(np.frombuffer(zlib.decompress(index[at + 4 : at + 4 + n]), "<i8"))
            at += 4 + n
        self.blocks = [Block(*map(int, b)) for b in parts[0].reshape(-1, len(Block._fields))]
        self.names, self.unnamed, self.lengths = parts[1], parts[2].astype(bool), parts[3]
        magic, bits, n, length, crc = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC or bits != SCALE_BITS:
            raise ValueError("not a token file of this version")
        packed = self._checked(_HEAD.size, length, crc, "table")
        self.table = Table.of(np.frombuffer(zlib.decompress(packed), "<u4"))

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _checked(self, place: int, size: int, crc: int, what: str) -> bytes:
        data = self._at(place, size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"the {what} of a token file is damaged")
        return data

    def ids_of(self, number: int) -> np.ndarray:
        """The ids of one block, checked against both checksums."""
        b = self.blocks[number]
        payload = self._checked(b.offset, b.size, b.payload_crc, f"block {number}")
        words = np.frombuffer(payload, "<u4", b.words).astype(np.uint64)
        mark = struct.Struct(f"<Q{8 * LANES}s")
        marks = [(at, np.frombuffer(raw, "<u8")) for at, raw in mark.iter_unpack(payload[4 * b.words :])]
        ids = decode_block(words, marks, b.ids, self.table) if b.ids else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != b.ids_crc:
            raise ValueError(f"block {number} of a token file does not decode to what was written")
        return ids

    def documents_of(self, number: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(id, ids before it in the block, ids)`` of the documents of one block."""
        first = sum(b.documents for b in self.blocks[:number])
        ids, at = self.ids_of(number), 0
        for i in range(first, first + self.blocks[number].documents):
            n = int(self.lengths[i])
            yield (None if self.unnamed[i] else int(self.names[i])), at, ids[at : at + n]
            at += n
