"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point. An n-gram binds its letters:
their vectors, rotated by their place, are multiplied. A text bundles its n-grams: their vectors are added.
A language's prototype bundles all its texts, each at unit length, and a text belongs to the language whose
prototype has the largest cosine with it.

Texts are read as runs of letters in lower case, with a blank around each. Bundling is a sum, so tasks add up
the texts that they read, and only one vector per language leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import Batches, map_arrow, texts

DIMENSIONS = 512
GRAM = 3
SEED = 20_240
UNKNOWN = "und"
# Characters and texts handled at a time, and n-grams whose vectors a worker remembers.
BLOCK = 1 << 15
TEXTS = 64
REMEMBERED = 20_000
_LETTERS = regex.compile(r"\p{L}+")


class Profiles:
    """Vectors of texts."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, int] = {}
        self.vectors = np.empty((REMEMBERED, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        """The vector of a code point, the same in every worker."""
        if code not in self.letters:
            rng = np.random.default_rng([SEED, code])
            self.letters[code] = rng.choice(np.array([-1, 1], np.int8), self.dimensions)
        return self.letters[code]

    def gram(self, codes: list[int]) -> np.ndarray:
        """Letters bound in their order."""
        bound = np.ones(self.dimensions, np.int8)
        for place, code in enumerate(codes):
            bound = bound * np.roll(self.letter(code), GRAM - 1 - place)
        return bound.astype(np.float32)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct n-grams, each a number of 21 bits per letter."""
        if len(self.grams) + len(codes) > REMEMBERED:
            self.grams.clear()
        if len(codes) > REMEMBERED:
            return np.stack([self.gram(_letters(int(c))) for c in codes])
        rows = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            row = self.grams.get(code)
            if row is None:
                row = self.grams[code] = len(self.grams)
                self.vectors[row] = self.gram(_letters(code))
            rows[i] = row
        return self.vectors[rows]

    def of_texts(self, bodies: list[str]) -> np.ndarray:
        """The vector of every text, zero where there is no letter."""
        out = np.zeros((len(bodies), self.dimensions), np.float32)
        at = 0
        while at < len(bodies):
            end, size = at, 0
            while end < min(len(bodies), at + TEXTS) and (end == at or size + len(bodies[end]) <= BLOCK):
                size += len(bodies[end])
                end += 1
            if end == at + 1 and size > BLOCK:
                body = bodies[at]
                # n-grams over an edge belong to the block that they begin in
                runs = " " + " ".join(_LETTERS.findall(body.lower())) + " "
                for i in range(0, max(1, len(runs) - GRAM + 1), BLOCK):
                    out[at] += self._block([runs[i : i + BLOCK + GRAM - 1]])[0]
            else:
                out[at:end] = self._block([" " + " ".join(_LETTERS.findall(b.lower())) + " " for b in bodies[at:end]])
            at = end
        return out

    def _block(self, runs: list[str]) -> np.ndarray:
        codes, owners = [], []
        for i, run in enumerate(runs):
            points = np.frombuffer(run.encode("utf-32-le"), "<u4").astype(np.int64)
            n = len(points) - GRAM + 1
            if n > 0:
                code = points[:n].copy()
                for k in range(1, GRAM):
                    code = (code << 21) | points[k : k + n]
                codes.append(code)
                owners.append(np.full(n, i))
        if not codes:
            return np.zeros((len(runs), self.dimensions), np.float32)
        distinct, number = np.unique(np.concatenate(codes), return_inverse=True)
        cells = np.concatenate(owners) * len(distinct) + number
        counts = np.bincount(cells, minlength=len(runs) * len(distinct)).reshape(len(runs), -1)
        return counts.astype(np.float32) @ self._rows(distinct)


def _letters(code: int) -> list[int]:
    return [(code >> (21 * k)) & 0x1FFFFF for k in range(GRAM - 1, -1, -1)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A vector per language from all rows of ``text, lang``; rows without either teach nothing."""

    def run(batches: Batches) -> Batches:
        profiles, sums = Profiles(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            vectors = _unit(profiles.of_texts(batch.column("text").to_pylist()))
            for lang in set(langs):
                own = vectors[[i for i, x in enumerate(langs) if x == lang]].sum(axis=0, dtype=np.float64)
                sums[lang] = sums.get(lang, 0) + own
        langs = sorted(sums)
        values = pa.array([sums[x].tolist() for x in langs], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), values], ["lang", "sums"])

    taught = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    sums = map_arrow(taught, run, "lang string, sums array<double>")
    sums = sums.select("lang", F.posexplode("sums").alias("place", "value"))
    total = sums.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    # a row per language and dimension
    found: dict[str, np.ndarray] = {}
    for row in total.collect():
        found.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["place"]] = row["value"]
    return found


def identify(docs: DataFrame, known: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row: the nearest language and its cosine, 0 at least.

    A text that is NULL or has no letter is ``und`` with score 0, as is all if nothing was learned. Of
    languages at the same distance the first by name is taken.
    """
    names = sorted(known)
    table = _unit(np.array([known[n] for n in names], np.float32).reshape(len(names), DIMENSIONS))

    def run(batches: Batches) -> Batches:
        profiles = Profiles()
        for batch in batches:
            vectors = _unit(profiles.of_texts([t or "" for t in batch.column("text").to_pylist()]))
            found = vectors.any(axis=1)
            if len(names):
                near = vectors @ table.T
                best, cosine = near.argmax(axis=1), np.clip(near.max(axis=1), 0, 1)
                langs = [names[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)]
            else:
                langs, cosine = [UNKNOWN] * len(vectors), np.zeros(len(vectors))
            scores = pa.array(np.where(found, cosine, 0.0).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), scores], ["doc_id", "lang_pred", "score"]
            )

    return map_arrow(texts(docs, doc_id, text), run, "doc_id long, lang_pred string, score double")
