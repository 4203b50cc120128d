"""Classifiers on held-out rows and on odd ones."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_locates_sentences(spark):
    rnd = random.Random(1)
    words = [f"plain{i}" for i in range(80)]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(8)) + "."
    rows = []
    for i in range(400):
        parts = [sentence() for _ in range(rnd.randint(1, 9))]
        if i % 4 == 0:
            parts[rnd.randrange(len(parts))] = "Such a vile" + rnd.choice(["ness", "st", ""]) + " thing."
        rows.append((i, " ".join(parts), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300] + [(1, None), (None, 1)], "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    odd = [(500, None), (501, ""), (502, "... !"), (None, "plain1"), (503, "İ vile. " + "word " * 50_000), (5, "plain2"), (5, "plain2")]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("mine"))
    found = toxicity.score(both, weights).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    for i, text, toxic in rows[300:]:
        assert (by_id[i].score >= 0.5) == bool(toxic)
        if toxic:
            assert any("vile" in text[s.start : s.end] for s in by_id[i].offending)
    assert by_id[500].score == by_id[501].score == by_id[502].score == 0
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    weights = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not len(weights.names) and toxicity.score(docs, weights).first().score < 0.5


def test_held_out_toxicity_and_language(spark):
    from palimpsest.llm import queries

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.op10_language(spark, SF).join(docs, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = queries.op8_toxicity(spark, SF).join(labels, "doc_id").where("held_out")
    assert scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0] > 0.88


def test_language_of_odd_texts(spark):
    taught = [("the cat and the dog of the house", "en"), ("le chat et le chien de la maison", "fr")] * 5
    known = langid.prototypes(spark.createDataFrame(taught + [(None, "en"), ("x", None), ("12", "fr")], "text string, lang string"))
    assert set(known) == {"en", "fr"}
    rows = [(1, "the house"), (1, "the house"), (2, "la maison et le chien"), (3, None), (4, ""), (5, "12 ?!"), (None, "the dog"),
            (6, "the dog " * 40_000), (7, "\U0001d400中"), (8, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("zz"), "score": F.lit(9)})
    found = langid.identify(docs, known).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    got = {r.doc_id: r.lang_pred for r in found}
    assert (got[1], got[2], got[6], got[None]) == ("en", "fr", "en", "en")
    assert {got[i] for i in (3, 4, 5)} == {"und"} and got[7] in known
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), known).count() == 0


def test_profiles_bundle_bound_letters():
    profiles = langid.Profiles()
    long = "abc déf " * 9000
    (whole,), (short,) = profiles.of_texts([long]), profiles.of_texts(["abc déf"])
    counts = {}
    runs = " " + " ".join(long.split()) + " "
    for i in range(len(runs) - 2):
        counts[runs[i : i + 3]] = counts.get(runs[i : i + 3], 0) + 1
    want = sum(n * profiles.gram([ord(c) for c in g]) for g, n in counts.items())
    assert np.allclose(whole, want) and not np.allclose(short, 0)
    assert profiles.of_texts(["", "12"]) == pytest.approx(0) or np.allclose(profiles.of_texts(["", "12"]), 0)


def test_words_count_behind_their_first_letters():
    lead = "q" * 45
    assert toxicity.features(lead + "clean") != toxicity.features(lead + "vilest")
    assert set(toxicity.features("vilest")) & set(toxicity.features(lead + "_vilest_" + lead))
    # without blanks a clause is one word; what offends stands at its end
    rnd = random.Random(4)
    clause = lambda: "".join(rnd.choice("一二三四五六七八九十") for _ in range(60))
    bodies = [clause() + ("悪口雑言罵詈" if i % 2 else "晴天白雲青空") for i in range(400)]
    scorer = toxicity.Scorer(toxicity.fit(bodies, [i % 2 for i in range(400)]))
    assert scorer.sentences(clause() + "悪口雑言罵詈")[0][2] > 0 > scorer.sentences(clause() + "晴天白雲青空")[0][2]


# ---------------------------------------------------------------- against plain Python


def plain_toxicity(text, model):
    """Noisy-or over sentences of the weights of their distinct words."""
    weights = dict(zip(model.names.tolist(), model.weights.tolist()))
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        if sentence.strip():
            logit = model.bias
            for word in set(re.findall(r"\w+", sentence)):
                marked = f"<{word}>"
                parts = {marked[i : i + n] for n in (4, 5) for i in range(len(marked)) if i + n <= len(marked)} | {marked}
                logit += sum(weights.get(zlib.crc32(p.encode()), 0.0) for p in parts)
            clean *= 1 - 1 / (1 + math.exp(-logit))
    return 1 - clean


def test_toxicity_equals_a_plain_noisy_or(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 400")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.names) > 20
    bodies = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores.keys() == bodies.keys()
    for d, text in bodies.items():
        assert scores[d] == pytest.approx(plain_toxicity(text, model), abs=1e-9), d


def plain_vector(text):
    """Counts of letter trigrams, each the product of its letters' shifted random vectors."""
    runs, total = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ", np.zeros(langid.DIMENSIONS)
    for i in range(len(runs) - 2):
        bound = np.ones(langid.DIMENSIONS)
        for place, letter in enumerate(runs[i : i + 3]):
            vector = np.random.default_rng([langid.SEED, ord(letter)]).choice(np.array([-1, 1], np.int8), langid.DIMENSIONS)
            bound *= np.concatenate([vector[place - 2 :], vector[: place - 2]]) if place < 2 else vector
        total += bound
    return total / np.linalg.norm(total) if total.any() else total


def test_languages_equal_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 300").orderBy("doc_id").limit(40)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    taught, asked = rows[:25], rows[15:]
    known = {}
    for _, text, lang in taught:
        known[lang] = known.get(lang, 0) + plain_vector(text)
    known = {x: v / np.linalg.norm(v) for x, v in known.items()}
    frame = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    found = langid.identify(spark.createDataFrame(asked, frame.schema), langid.prototypes(frame)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found}
    for d, text, _ in asked:
        cosines = {x: float(plain_vector(text) @ v) for x, v in known.items()}
        best = max(cosines, key=cosines.get)
        assert got[d][0] == best and got[d][1] == pytest.approx(cosines[best], abs=1e-4), d
