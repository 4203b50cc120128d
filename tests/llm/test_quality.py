"""Quality rules against plain counting."""

import re

from pyspark.sql import functions as F

from palimpsest.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
    }


TEXTS = [
    None,
    "",
    " \n\t\x0b\x0c\r ",
    "one",
    "one two",
    "a b c a b c",
    "a a a a a",
    "x y z\nx y z\n\n \nx y z",
    "é ü 中文 😀 # * $ % & | < >",
    "a\xa0b c a\xa0b c",
    "the cat sat on the mat the cat sat on the mat " * 9,
    " ".join(f"w{i % 37} v{i % 11}" for i in range(400)),
    "- item\n- item\n* other\n…\nends...\n",
]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r.doc_id: r.asDict() for r in quality_rules.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        want = plain(text)
        assert {k: found[i][k] for k in want} == want, repr(text)
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert found[i]["base_failed"] == failed
        assert not (failed and found[i]["kept"])


def test_long_text_repeated_rows_and_clashing_columns(spark):
    good = " ".join(f"the word{i} of thing{i}" for i in range(30))
    long = " ".join(f"the word{i}" for i in range(40_000))
    rows = [(1, good), (1, good), (None, good), (2, long), (3, None), (4, "### " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {n: F.lit("mine") for n in ("n_words", "found", "row", "words", "kept")}
    )
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1, 2]
    assert quality_rules.judge(docs).count() == len(rows)
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_no_user_function_and_no_shuffle(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
