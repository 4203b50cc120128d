"""Byte-level BPE on own code: contiguous rank arrays for encoding, a table of bytes for decoding.

A short word holds its part boundaries and the ranks of adjacent pairs in two arrays. The smallest rank is
sought by scanning, its boundary is deleted and the two ranks beside it are looked up anew. That is
quadratic, so words of many bytes keep their pairs in a heap instead; both merge the leftmost pair of the
smallest rank. The first words and chunks that a worker meets are remembered, up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm.vocab import chunks, groups, strings
from palimpsest.llm.work import Batches, map_arrow, texts

# Fixed value: the pattern that cuts text into words before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Words of more bytes are merged with a heap.
SHORT = 48
REMEMBERED = 400_000
_NONE = 1 << 60


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else from 256 up."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Remembered(dict):
    """Answers by short text, computed when missing; once full, only the first ones are kept."""

    def __init__(self, compute: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, text: str) -> bytes:
        answer = self.compute(text)
        if len(self) < self.most and len(text) <= SHORT:
            self[text] = answer
        return answer


class BytePairs:
    """A vocabulary file's merges, ready for both ways."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.byte_ids = [vocab[x] for x in letters]
        # a merge by its pair of ids: rank above, id of the result below
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank << 32) | vocab[a + b])
        back = {x: b for b, x in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.special_ids.items()}
        names = sorted(self.special_ids, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pattern = regex.compile(PATTERN)
        self.words = Remembered(self._word, remembered)
        self.chunks = Remembered(self._plain, remembered)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank_of = self.merges.get
        ranks = [rank_of(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), _NONE)
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), _NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merges[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            found, i = heapq.heappop(heap)
            j = after[i]
            # entries of pairs that are gone are skipped when they come up
            if parts[i] < 0 or j >= n or self.merges.get((parts[i], parts[j])) != found:
                continue
            parts[i], parts[j], after[i] = found & 0xFFFFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (parts[a], parts[b]) in self.merges:
                    heapq.heappush(heap, (self.merges[parts[a], parts[b]], a))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        return np.array(self.merge(word.encode()), "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.specials and self.specials.search(text):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.special_ids[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return b"".join(map(self.chunks.__getitem__, chunks(text)))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_tables: dict[str, BytePairs] = {}


def table(path: str) -> BytePairs:
    """This worker's table of a vocabulary file, made once."""
    if path not in _tables:
        _tables[path] = BytePairs(path)
    return _tables[path]


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (binary) per row, NULL texts as empty ones."""

    def run(batches: Batches) -> Batches:
        pairs = table(path)
        for batch in batches:
            bodies = strings(batch.column("text"))
            for a, b in groups(bodies):
                ids = pa.array([pairs.encode(t) for t in bodies[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), ids], ["doc_id", "ids"])

    return map_arrow(texts(docs, doc_id, text), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; NULL ids give a NULL text."""

    def run(batches: Batches) -> Batches:
        pairs = table(path)
        for batch in batches:
            found = (
                pairs.decode(np.frombuffer(x, "<u4")) if x is not None else None
                for x in (i.as_py() for i in batch.column("ids"))
            )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both ways in one pass, without carrying ids."""

    def run(batches: Batches) -> Batches:
        pairs = table(path)
        for batch in batches:
            n, coded, decoded = [], [], []
            for body in batch.column("text"):
                ids = pairs.encode(body.as_py() or "")
                back = pairs.decode(np.frombuffer(ids, "<u4"))
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return map_arrow(
        texts(docs, doc_id, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
