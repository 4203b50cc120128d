"""Token ids by the tokenizers library, a chunk of text at a time.

Byte-level BPE splits a text into pieces before it merges anything, and a blank followed by something
else than white space always starts a piece. Texts are cut there, and the library encodes each distinct
chunk once per worker; a bounded store keeps what it answered. A text that holds a special token goes to
the library whole, since there the cut could fall differently.

Texts and chunks of Latin letters, digits and signs are merged by tiktoken with the vocabulary's own ranks, which is four
times as fast and gives the library's ids: see ``merge_ranks``. A vocabulary for which that is not certain,
and all other chunks, stay with the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Chunks a worker remembers, the first that it meets: about 50 MB. Others are encoded each time.
REMEMBERED = 250_000
# Characters of text encoded in one go.
GROUP_CHARS = 4_000_000

_CUT = re.compile(r" (?=\S)")
_BLANK_BEFORE_WHITE = re.compile(r" \s")
_PLAIN = re.compile(r" ?\S+")
# Chunks that the library is handed as one text, a line each.
_LINES = 20_000
# Fixed value: the pattern of pieces of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that are letters, digits or signs in every edition of Unicode.
_LATIN = re.compile(r"[ \n!-~\u00a1-\u024f]+")


def byte_letters() -> dict[str, int]:
    """The byte behind each letter in which byte-level BPE writes bytes: itself if it can be seen, else one beyond 255."""
    seen = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    beyond = iter(range(0x100, 0x200))
    return {chr(b if b in seen else next(beyond)): b for b in range(0x100)}


def merge_ranks(tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """Ids by the bytes of their tokens, if merging by smallest id gives the ids that the tokenizer gives; else None.

    Merging by id joins two neighbours whenever their bytes together are a token, the tokenizer only
    when the pair is on its list. Both agree if the list is in the order of ids and every token, written
    alone, comes out as itself. For then what stands between the ends of a token goes through the same
    states as the token alone, as long as no merge crosses an end, and the last state of two parts is the
    pair on the list.
    """
    settings = json.loads(tokenizer.to_str())
    cutter, model = settings["pre_tokenizer"] or {}, settings["model"]
    plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space")
    odd = ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")
    if settings["normalizer"] or not plain or model["type"] != "BPE" or any(model.get(k) for k in odd):
        return None
    letters, added = byte_letters(), {t["content"] for t in settings["added_tokens"]}
    tokens = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [tokens.get("".join(pair), -1) for pair in pairs]
    in_order = all(a < b for a, b in zip([-1, *made], made, strict=False))
    if not in_order or not letters.keys() <= tokens.keys() or not all(letters.keys() >= set(t) for t in tokens):
        return None
    alone = tokenizer.model.tokenize
    if any([x.id for x in alone(t)] != [i] for t, i in tokens.items()):
        return None
    return {bytes(letters[c] for c in t): i for t, i in tokens.items()}


def chunks(text: str) -> list[str]:
    """The text cut before every blank that starts a piece of its own."""
    parts = _CUT.split(text) if _BLANK_BEFORE_WHITE.search(text) else text.split(" ")
    out = [" " + part for part in parts]
    out[0] = parts[0]
    return out


def groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold a bounded number of characters, one text at least."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > GROUP_CHARS:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class Known(dict):
    """What is remembered, and beside it what the texts at hand need."""

    others: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        return self.others[chunk]


class Encoder:
    """Encodes whole texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, literal_specials: bool = False, remembered: int = REMEMBERED) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = literal_specials
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(map(re.escape, added))) if added and not literal_specials else None
        self.remembered = remembered
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.store = Known({"": b""})
        ranks = merge_ranks(self.tokenizer)
        self.quick = ranks and tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _merged(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.quick.encode_ordinary(t), "<u4") for t in texts]

    def _chunks(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of chunks."""
        latin = {c for c in wanted if _LATIN.fullmatch(c)} if self.quick else set()
        return self._by_lines(list(latin), self._merged) | self._by_lines([c for c in wanted if c not in latin], self._library)

    def _by_lines(self, wanted: list[str], encoded: Callable[[list[str]], list[np.ndarray]]) -> dict[str, bytes]:
        """Ids of chunks; those without white space inside go in as lines, since a line end is a piece."""
        odd = [c for c in wanted if not _PLAIN.fullmatch(c)] if len(self.line_end) == 1 else wanted
        out = {c: ids.tobytes() for c, ids in zip(odd, encoded(odd), strict=True)}
        lines = [c for c in wanted if c not in out]
        for i in range(0, len(lines), _LINES):
            part = lines[i : i + _LINES]
            ids = encoded(["\n".join(part)])[0]
            ends = [*np.flatnonzero(ids == self.line_end[0]).tolist(), len(ids)]
            raw, start = ids.tobytes(), 0
            for chunk, end in zip(part, ends, strict=True):
                out[chunk] = raw[4 * start : 4 * end]
                start = end + 1
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text."""
        for a, b in groups(texts):
            yield from self._encode_group(texts[a:b])

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        latin = [bool(self.quick and _LATIN.fullmatch(t) and not (self.specials and self.specials.search(t))) for t in texts]
        others = iter(self._by_chunks([t for t, quick in zip(texts, latin, strict=True) if not quick]))
        return [self._merged([t])[0].tobytes() if quick else next(others) for t, quick in zip(texts, latin, strict=True)]

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        whole = [t for t in texts if self.specials and self.specials.search(t)]
        answered = {t: ids.tobytes() for t, ids in zip(whole, self._library(whole), strict=True)}
        cut = [chunks(t) if t not in answered else None for t in texts]
        wanted = set().union(*filter(None, cut)) - self.store.keys()
        new = self._chunks(list(wanted))
        known = self.store
        known.others = new
        if len(known) < self.remembered:
            known.update(islice(((c, i) for c, i in new.items() if len(c) <= 64), self.remembered - len(known)))
        get = known.__getitem__
        return [b"".join(map(get, c)) if c is not None else answered[t] for t, c in zip(texts, cut, strict=True)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal_specials: bool = False) -> Encoder:
    """This worker's encoder of a vocabulary file, made once."""
    key = (path, literal_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path, literal_specials)
    return _encoders[key]


def strings(column: object) -> list[str]:
    """Texts of an Arrow column, NULL as empty."""
    return [t or "" for t in column.to_pylist()]
