"""The pipeline's stages, and its rows against stages written out plainly."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import packing, paragraph_dedup, quality_rules

from .test_dedup import brute_components, brute_fingerprint, brute_runs

SF = "/root/testdata/sf0.001"


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_take_odd_rows(spark):
    """NULLs, empty and very long texts, repeated rows and columns that are named like those inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    whole = docs.orderBy("doc_id").collect()
    odd = [(None, None), (900, None), (901, ""), (902, " \n"), (903, " ".join(f"w{i}" for i in range(20_000))), (None, whole[0].text)]
    odd += [(whole[1].doc_id, whole[1].text), (whole[2].doc_id, whole[3].text)]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in odd]
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    every = every.withColumns({c: F.lit(1) for c in ("row", "__first", "version", "span", "start", "end", "left", "key", "length", "n")})
    ids = {r.doc_id for r in every.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, every, SF)
        found = out.collect()
        assert {r.doc_id for r in found} <= ids and found, name
        if name != "pack":
            assert out.dtypes == every.dtypes, name
            assert len(found) <= every.count(), name


def plainly(spark):
    """All stages but packing: ids and texts that are left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    last = {t: d for d, t in sorted(texts.items())}
    texts = {d: t for t, d in last.items()}
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    tops = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    texts = {d: t for d, t in texts.items() if tops[d] == d}
    found = [(d, a, b, frozenset(zip(*[w[k:] for k in range(5)]))) for d, t in texts.items() for a, b, w in paragraph_dedup.paragraphs(t)]
    sets = [f[3] for f in found]
    tops = brute_components(range(len(sets)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = defaultdict(lambda: 1 << 62)
    for i, (d, *_) in enumerate(found):
        least[tops[i]] = min(least[tops[i]], d)
    gone = defaultdict(list)
    for i, (d, a, b, _) in enumerate(found):
        if d != least[tops[i]]:
            gone[d].append((a, b))
    for d, places in brute_runs(texts, gone).items():
        edges = [m.span() for m in re.finditer(r"\S+[^\S\n]*", texts[d])]
        first = last = None
        for i in places:
            if first is not None and i > last + 50:
                gone[d].append((edges[first][0], edges[last + 49][1]))
                first = None
            first, last = i if first is None else first, i
        gone[d].append((edges[first][0], edges[last + 49][1]))
    left = {}
    for d, t in texts.items():
        lost = {i for a, b in gone[d] for i in range(a, b)}
        t = "".join(c for i, c in enumerate(t) if i not in lost)
        if not lost or t.split():
            left[d] = t
    return left


def test_run_against_plain_stages(spark):
    left = plainly(spark)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for d, t in left.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want |= {(d, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(packing.cut(len(ids), 1024))}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    sequences = defaultdict(int)
    for r in found:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024
