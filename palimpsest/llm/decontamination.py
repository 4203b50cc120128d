"""Passages of test items in training documents, by a positional inverted index.

The index is a stored table with a row per posting: the term, the document's row and the place of the
word in it. It holds the terms of the test items; no other word can be part of a match. A window of an
item is found by intersecting the lists of its terms, each shifted by the term's offset in the window:
first the list of the term that is rarest in the training data, then that of the second rarest, then the
rest for the few places that are left. Exact phrases and terms near each other are read from the same
index. All of it is DataFrame expressions.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; of letters only A-Z are
lower-cased. A NULL or empty text has no words. Every document row is a document of its own, rows of one
id too; a NULL id stays NULL. Items without words have no window; items without id are searched for, but
not counted or listed. Repeated items count once. Other columns of both tables are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm.work import cut_lineage, texts

WINDOW = 10
# Terms and window places that are broadcast at most; beyond that, joins shuffle both sides.
BROADCAST_ROWS = 1_000_000
# What separates words, the blank aside, which all of it becomes.
_SEPARATORS = "".join(map(chr, [*range(0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# The term of the one posting that every document has, at place 0.
_NO_TERM = 0


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SEPARATORS + _CAPITALS, " " * len(_SEPARATORS) + _CAPITALS.lower())
    return F.array_remove(F.split(plain, " "), "")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class TestWindows:
    """Stored tables of what is searched for.

    ``terms``: ``word, term``; ``places``: ``window, length, at, term``, a row per word of a window, ``at``
    from 0; ``holders``: ``window, item_id``.
    """

    __test__ = False

    terms: DataFrame
    places: DataFrame
    holders: DataFrame


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> TestWindows:
    """Every distinct run of ``window`` words of the items; an item of fewer is one window."""
    given = items.select(items[item_id].alias("item_id"), words(items[text]).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1))
    runs = given.select("item_id", "words", F.explode(starts).alias("start"))
    runs = cut_lineage(runs.select("item_id", F.slice("words", F.col("start"), F.lit(window)).alias("run")), "test-runs")
    distinct = cut_lineage(runs.select("run").distinct().withColumn("window", F.monotonically_increasing_id()), "test-windows")
    holders = cut_lineage(runs.join(distinct, "run").select("window", "item_id").distinct(), "test-holders")
    each = distinct.select("window", F.size("run").alias("length"), F.posexplode("run").alias("at", "word"))
    terms = each.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + (_NO_TERM + 1))
    terms = cut_lineage(terms, "test-terms")
    places = cut_lineage(each.join(terms, "word").select("window", "length", "at", "term"), "test-places")
    return TestWindows(terms, places, holders)


test_windows.__test__ = False


def build_index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``term, row, pos, doc_id, n_words`` of the given terms.

    Places count all words from 1. Every document also has a posting of no term at place 0, so that
    none is missing. The text is read once and never shuffled.
    """
    read = texts(docs, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    each = read.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "word"))
    marker = terms.sparkSession.createDataFrame([("", _NO_TERM)], "word string, term long")
    known = cut_lineage(terms.select("word", "term").union(marker).coalesce(1), "index-terms")
    return cut_lineage(each.join(_small(known), "word").select("term", "row", "pos", "doc_id", "n_words"), "postings")


def documents(index: DataFrame) -> DataFrame:
    """``row, doc_id, n_words`` of every document."""
    return index.where(F.col("term") == _NO_TERM).select("row", "doc_id", "n_words")


def _ranked(index: DataFrame, windows: TestWindows) -> DataFrame:
    """Places of the windows that can occur, numbered from the term rarest in the index."""
    counts = index.where(F.col("term") != _NO_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    placed = windows.places.join(counts, "term")
    of_window = W.partitionBy("window")
    ranked = placed.withColumns(
        {"rank": F.row_number().over(of_window.orderBy("seen", "at")), "there": F.count(F.lit(1)).over(of_window)}
    )
    return cut_lineage(ranked.where("there = length").select("window", "length", "at", "term", "rank"), "test-ranked")


def _lists(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Postings of the terms of some places, as ``term, row, pos``."""
    wanted = cut_lineage(ranked.select("term").distinct(), "wanted-terms")
    return index.join(_small(wanted), "term", "left_semi").select("term", "row", "pos")


def _rarest(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """``window, length, row, pos, start``: where the rarest term of a window stands, and where the window would begin."""
    first = cut_lineage(ranked.where("rank = 1").drop("rank"), "rarest")
    found = index.select("term", "row", "pos").join(_small(first), "term")
    return found.select("window", "length", "row", "pos", (F.col("pos") - F.col("at")).alias("start"))


def phrase_matches(index: DataFrame, windows: TestWindows) -> DataFrame:
    """``window, length, row, start`` of every exact occurrence of a window.

    Lists are met from the rarest term on. What the rarest two leave is looked up for all other
    terms at once; keys are single places of documents, so none is hot.
    """
    ranked = _ranked(index, windows)
    left = _rarest(index, ranked).where("start >= 1").drop("pos")
    second = cut_lineage(ranked.where("rank = 2").select("window", "at", "term"), "second")
    looked = left.join(_small(second), "window").withColumn("pos", F.col("start") + F.col("at")).drop("at")
    short = left.where("length = 1")
    left = cut_lineage(looked.join(_lists(index, second), ["row", "pos", "term"]).drop("pos", "term"), "met-twice")
    rest = cut_lineage(ranked.where("rank > 2").select("window", "at", "term"), "others")
    probes = left.join(_small(rest), "window").withColumn("pos", F.col("start") + F.col("at")).drop("at")
    met = probes.join(_lists(index, rest), ["row", "pos", "term"])
    key = ["window", "length", "row", "start"]
    whole = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met")).where("met = length - 2").select(*key)
    return cut_lineage(whole.unionByName(left.where("length = 2").select(*key)).unionByName(short.select(*key)), "matches")


def near_matches(index: DataFrame, windows: TestWindows, within: int) -> DataFrame:
    """``window, row, pos``: places of a window's rarest term that have all its other terms near.

    Near is at most ``within`` words before or behind, in any order; a term that the window holds
    twice is needed once. Places are met by stretches of ``within`` words, so that a frequent term
    of a long document is never paired with more than three stretches of it.
    """
    if within < 1:
        raise ValueError("within must be at least 1")
    ranked = _ranked(index, windows)
    others = ranked.where("rank > 1").select("window", "term").distinct()
    others = others.join(ranked.where("rank = 1").select("window", "term"), ["window", "term"], "left_anti")
    needed = others.groupBy("window").agg(F.count(F.lit(1)).alias("needed"))
    found = _rarest(index, ranked).select("window", "row", "pos").distinct().join(needed, "window", "left")
    found = cut_lineage(found.withColumn("needed", F.coalesce("needed", F.lit(0))), "rarest-places")
    stretch = F.floor(F.col("pos") / within)
    around = found.select("window", "row", "pos", "needed", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    asked = around.join(_small(cut_lineage(others, "near-terms")), "window")
    there = _lists(index, others).select("term", "row", F.col("pos").alias("there"), F.floor(F.col("pos") / within).alias("stretch"))
    met = asked.join(there, ["row", "term", "stretch"]).where(F.abs(F.col("there") - F.col("pos")) <= within)
    whole = met.groupBy("window", "row", "pos", "needed").agg(F.count_distinct("term").alias("met")).where("met = needed")
    return whole.select("window", "row", "pos").unionByName(found.where("needed = 0").select("window", "row", "pos"))


def _words_hit(matches: DataFrame) -> DataFrame:
    """``row, n_hit``: words inside any match, each counted once."""
    spans = matches.select("row", "start", (F.col("start") + F.col("length") - 1).alias("end")).distinct()
    before = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    known = F.coalesce(F.max("end").over(before), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, known))
    return spans.select("row", new.cast("long").alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))


def _items_met(matches: DataFrame, windows: TestWindows) -> DataFrame:
    """``row, items``: ids of the items that have a window in the document, sorted as text."""
    met = matches.select("row", "window").distinct().join(_small(windows.holders), "window")
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    return met.select("row", "item_id").distinct().groupBy("row").agg(ids.alias("items"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every document row; ``items`` is never NULL."""
    windows = test_windows(items, item_id, text, window)
    index = build_index(docs, windows.terms, doc_id, text)
    matches = phrase_matches(index, windows)
    found = _words_hit(matches).join(_items_met(matches, windows), "row")
    return documents(index).join(found, "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
