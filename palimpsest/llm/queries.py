"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    bpe,
    decontamination,
    exact_dedup,
    filter_audit,
    langid,
    packing,
    paragraph_dedup,
    quality_rules,
    ranked_search,
    simhash,
    token_counts,
    token_files,
    toxicity,
)
from palimpsest.llm.work import held_out, scratch_path, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# The vocabulary's special token ends documents in flat files, where texts cannot hold it.
FLAT_END_ID = 50256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


ORACLE["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules.judge(_documents(spark, sf_dir))


def _rules_sql() -> str:
    bounds = []
    for r in quality_rules.RULES:
        if r.percent_low is not None:
            bounds.append(f"100 * {r.part} >= {r.percent_low} * {r.whole}")
        if r.percent_high is not None:
            bounds.append(f"100 * {r.part} <= {r.percent_high} * {r.whole}")
    return " AND ".join(bounds)


_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
ORACLE["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{quality_rules.WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{quality_rules.WORD}')) AS l
  FROM documents),
w AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
t AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM t WHERE z IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_LIST})))::BIGINT AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
         len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.BULLET}')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '{quality_rules.ELLIPSIS}')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS}
             OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_rules_sql()} AS kept FROM b
"""


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that several documents share, with the document that keeps it."""
    return paragraph_dedup.repeated_passages(_documents(spark, sf_dir)).drop("version")


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found in flat files by their end ids alone."""
    folder = scratch_path(spark, "flat-files")
    written = token_counts.write_flat_files(_documents(spark, sf_dir), folder, VOCABULARY, FLAT_END_ID)
    counted = token_counts.count_tokens(spark, folder, FLAT_END_ID)
    return written.join(counted, ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "start", "n_tokens")


@_query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.round_trip(_documents(spark, sf_dir), VOCABULARY)


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from compressed token files."""
    folder = scratch_path(spark, "token-files")
    return token_files.read_token_files(token_files.write_token_files(_documents(spark, sf_dir), folder, VOCABULARY))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(_documents(spark, sf_dir), VOCABULARY)


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; four fifths of the labelled ones are learned from."""
    docs = texts(_documents(spark, sf_dir))
    apart = held_out(F.col("doc_id"), 5, 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~apart)
    found = toxicity.score(docs, toxicity.train(docs.where(~apart), labels))
    return found.select(
        "doc_id",
        apart.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"),
    )


@_query
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.simhash_components(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; three quarters of them are learned from."""
    docs = _documents(spark, sf_dir)
    apart = held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(docs, langid.prototypes(docs.where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from every source, in every order of them."""
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
bits AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)),
o AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM bits v, bits w, bits x, bits y, bits z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31
    AND v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


@_query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score best for each benchmark item."""
    return ranked_search.rank_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE["op12_ranked_search"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
m AS (SELECT doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, totals WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@_query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that belong to a passage of a benchmark item."""
    found = decontamination.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op13_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS s FROM d),
hits AS (
  SELECT p.doc_id, p.s, g.n, g.item_id FROM (
    SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS gram FROM places, lengths WHERE s + n - 1 <= len(w)) p
  JOIN g USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS place FROM hits) GROUP BY doc_id),
met AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(met.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(met.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""
