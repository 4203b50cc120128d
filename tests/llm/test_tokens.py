"""Token operators against the tokenizers library and exact round trips."""

import hashlib
import io
import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import bpe, packing, rans, token_counts, token_files, vocab
from palimpsest.llm.work import running_total

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PAIRS = bpe.BytePairs(PATH, remembered=50)
ENCODER = vocab.Encoder(PATH, remembered=50)
ODD = ["<|endoftext|>", " <|endoftext|>", "  ", "   ", "\n", " \n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "a" * 90]
TEXT = st.lists(st.one_of(st.text(max_size=6), st.sampled_from(ODD)), max_size=12).map("".join)


def wanted(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_both_encoders_equal_the_library(text):
    ids = wanted(text)
    assert PAIRS.encode(text) == ids
    assert list(ENCODER.encode([text, text])) == [ids, ids]
    values = np.frombuffer(ids, "<u4")
    assert PAIRS.decode(values) == LIBRARY.decode(values.tolist(), skip_special_tokens=False)


LATIN = st.text(st.sampled_from([*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x250)), " ", "\n", "'", "e", "t", "s"]), max_size=40)


@settings(max_examples=600, deadline=None)
@given(LATIN)
def test_merging_by_rank_equals_the_library(text):
    assert ENCODER.quick and list(ENCODER.encode([text])) == [wanted(text)]


def test_ranks_are_taken_only_where_they_are_sure():
    ranks = vocab.merge_ranks(LIBRARY)
    assert len(ranks) == 50_256 and all(ranks[bytes([b])] >= 0 for b in range(256))
    settings_ = json.loads(LIBRARY.to_str())

    def with_model(**change):
        return Tokenizer.from_str(json.dumps({**settings_, "model": {**settings_["model"], **change}}))

    merges = settings_["model"]["merges"]
    assert vocab.merge_ranks(with_model(merges=[merges[1], merges[0], *merges[2:]])) is None
    assert vocab.merge_ranks(with_model(merges=merges[:-1])) is None  # its token can no longer be reached
    assert vocab.merge_ranks(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None
    plain = Tokenizer.from_str(json.dumps({**settings_, "normalizer": {"type": "Lowercase"}}))
    assert vocab.merge_ranks(plain) is None


def test_bytes_that_are_no_text_decode_as_in_the_library():
    rnd = random.Random(4)
    for _ in range(200):
        ids = [rnd.randrange(256) for _ in range(rnd.randrange(12))]
        assert PAIRS.decode(np.array(ids, "<u4")) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_words_by_heap_and_short_ones_by_scan_agree():
    rnd = random.Random(2)
    for n in (49, 200, 3000):
        word = "".join(rnd.choice("thetionand") for _ in range(n))
        assert PAIRS.encode(word) == wanted(word)


def test_literal_specials():
    coder = vocab.Encoder(PATH, literal_specials=True)
    (ids,) = coder.encode(["a <|endoftext|> b"])
    assert 50256 not in np.frombuffer(ids, "<u4")


ROWS = [
    (7, "seven words are here in this text"),
    (2, ""),
    (3, None),
    (None, "no id # #"),
    (5, "same"),
    (5, "same"),
    (9, "long text " * 4000),
    (1, "x" * 9000),
    (8, "tail <|endoftext|> #"),
]


@pytest.fixture()
def docs(spark):
    made = spark.createDataFrame(ROWS, "doc_id long, text string")
    return made.withColumns({n: F.lit("mine") for n in ("ids", "start", "part", "shard", "key", "length", "rank")}).repartition(3)


def test_round_trip_of_documents(docs):
    got = sorted((tuple(r) for r in bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for d, t in ROWS:
        ids = wanted(t or "")
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {(d, t or "") for d, t in ROWS}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_token_files(docs, folder, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 3000)
    blocks = token_files.write_token_files(docs, f"{folder}/files", PATH)
    got = [tuple(r) for r in token_files.read_token_files(blocks).orderBy("start").collect()]
    at, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = wanted(t or "") + np.array([2], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), f"{folder}/none", PATH)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.integers(0, 700), st.integers(1, 60_000)), max_size=6))
def test_token_file_round_trip(shapes):
    rng = np.random.default_rng(len(shapes))
    documents = [(d, rng.integers(0, most, n).astype("<u4").tobytes()) for d, n, most in shapes]
    out = io.BytesIO()
    blocks = rans.write_file(out, documents)
    file = rans.TokenFile(out, len(out.getvalue()))
    assert [(d, ids.astype("<u4").tobytes()) for b in range(len(blocks)) for d, _, ids in file.documents_of(b)] == documents


def test_token_file_over_checkpoints_and_damage():
    rng = np.random.default_rng(1)
    n = 2 * rans.LANES * rans.CHECKPOINT_STEPS + 77
    documents = [(1, (rng.zipf(1.3, n) % 50_000).astype("<u4").tobytes())]
    out = io.BytesIO()
    (block,) = rans.write_file(out, documents)
    assert block.marks == 3 and block.size < n * 4 / 2
    data = bytearray(out.getvalue())
    data[block.offset + 100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.TokenFile(io.BytesIO(data), len(data)).ids_of(0)


@pytest.mark.parametrize("block_bytes", [2, 10, 1000, 1 << 20])
def test_counts_in_flat_files(spark, docs, folder, block_bytes):
    small = docs.where("coalesce(length(text), 0) < 100") if block_bytes < 1000 else docs
    written = token_counts.write_flat_files(small, folder, PATH, 50256)
    counted = token_counts.count_tokens(spark, folder, 50256, block_bytes=block_bytes)
    got = sorted(((r.doc_id, r.n_tokens) for r in written.join(counted, ["shard", "ordinal"]).collect()), key=str)
    literal = vocab.Encoder(PATH, literal_specials=True)
    want = [(d, len(i) // 4) for (d, t), i in zip(ROWS, literal.encode([t or "" for _, t in ROWS]), strict=True)
            if block_bytes >= 1000 or len(t or "") < 100]
    assert got == sorted(want, key=str)


def test_counts_over_block_edges_and_open_ends(spark, folder):
    rng = np.random.default_rng(3)
    want = set()
    for shard in range(4):
        ids = rng.integers(0, 9, 500 + shard).astype("<u2")
        ids.tofile(f"{folder}/{shard:08d}.ids")
        at = 0
        ends = np.flatnonzero(ids == 5).tolist()
        for i, end in enumerate(ends):
            want.add((shard, i, at, end - at, True))
            at = end + 1
        if at < len(ids):
            want.add((shard, len(ends), at, len(ids) - at, False))
    open(f"{folder}/00000009.ids", "w").close()
    for block_bytes in (2, 6, 64, 4096):
        got = token_counts.count_tokens(spark, folder, 5, block_bytes=block_bytes).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_counts_of_an_empty_folder(spark, folder):
    assert token_counts.count_tokens(spark, f"{folder}/nothing", 5).count() == 0


def best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= n]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - n)
        else:
            opened += 1
            gaps.append(capacity - n)
    return opened


def check_sequences(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("kind", ["mixed", "ones", "halves", "none"])
def test_packing_equals_sequential_best_fit(spark, kind, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    rnd = random.Random(kind)
    lengths = {
        "mixed": [rnd.randint(1, 64) for _ in range(400)],
        "ones": [1] * 300 + [rnd.randint(20, 63) for _ in range(40)],
        "halves": [32] * 51 + [33] * 20 + [31] * 25,
        "none": [],
    }[kind]
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    found = packing.pack(spark.createDataFrame(rows, packing._PIECES), capacity=64).collect()
    assert Counter(r.length for r in found) == Counter(lengths)
    assert sorted(r.doc_id for r in found) == list(range(len(lengths)))
    assert check_sequences(found, 64) <= best_fit(lengths, 64) * 1.01


def test_packing_of_documents(docs):
    found = packing.pack_documents(docs, PATH).collect()
    check_sequences(found, 1024)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {d for d, _ in ROWS}
    for d, t in ROWS:
        ids = wanted(t or "") + np.array([2], "<u4").tobytes()
        copies = sum(1 for x in ROWS if x[0] == d)
        want = Counter()
        for i, (a, n) in enumerate(packing.cut(len(ids) // 4, 1024)):
            want[(i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]))] += copies
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == want
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_running_total_over_groups(spark):
    rows = [(g, i, (g * 7 + i) % 5) for g in [0, 1, 5, 1023, 1024, 3000] for i in range(4)]
    df = spark.createDataFrame(rows, "g long, i long, n long")
    got = {(r.g, r.i): r.base for r in running_total(df, "g", ["i"], "n", "base").collect()}
    at = 0
    for g, i, n in rows:
        assert got[g, i] == at
        at += n
