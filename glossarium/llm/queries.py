"""Registered queries of this subpackage: (spark, folder of tables) -> DataFrame, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium import sql
from glossarium.llm import frequency, leakage, lookalike, mixing, reading, sampling, truncation
from glossarium.operators.packed import packed_lists
from glossarium.sources.session import spread, table

RARE_BELOW, COMMON_ABOVE = 3, 0.03


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    """All terms, and all n-grams of the lists, up to whole lists, that occur twice or more."""
    words = spread(table(spark, d, "postcutoff_words"))
    lists = packed_lists(words, "row_id", "top_10_words").select(F.lit("top_10_words").alias("field"), F.filter("slots", lambda v: v != "").alias("terms"))
    target = F.lower(F.regexp_replace("target_word", r"^[\s ]+|[\s ]+$", ""))
    targets = words.select(F.lit("target_word").alias("field"), F.array(target).alias("terms")).where(target != "")
    counts = frequency.ngram_frequencies(lists.unionByName(targets), least=2)
    return frequency.mark_frequencies(counts, words.count(), RARE_BELOW, COMMON_ABOVE)


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("field", F.array_join("gram", " | ").alias("term"), "n", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("n = 1 and mark is not null").select("field", F.get("gram", F.lit(0)).alias("term"), "mark")


def _supply(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = table(spark, d, "neighborhood_key")
    records = key.select(sampling.plain_key(F.col("model")).alias("model_key"), sampling.parts_key(F.col("grade")).alias("grade_key"), "is_future", "id")
    records = records.where("id is not null").withColumn("entity", F.concat_ws("@", F.upper(F.trim("id")), "model_key")).drop("id")
    return records, sampling.cell_supply(records, table(spark, d, "sample_targets"))


def _sample_report(spark: SparkSession, d: str) -> DataFrame:
    records, supply = _supply(spark, d)
    return sampling.sample_report(sampling.proportional_sample(records, supply), supply)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells of which the drawn sample has all there is, and still less than is asked for."""
    return _sample_report(spark, d).where("short").select("target_set", "model", "grade", "is_future")


def p2_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _sample_report(spark, d).select("target_set", "model", "grade", "is_future", "share", "min_rows", "wanted", "available", "reached", "reached_share", "off", "short")


def p2_margins(spark: SparkSession, d: str) -> DataFrame:
    return sampling.margin_report(_sample_report(spark, d))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.proportional_sample(*_supply(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = truncation.truncated_texts(spread(table(spark, d, "judge_failures")), "failure_id", "raw")
    return rows.where("lost_end or lost_start").select("failure_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    logs = spread(table(spark, d, "judge_failures"))
    rows = truncation.truncated_texts(logs, "failure_id", "raw").join(logs.select("failure_id", "source"), "failure_id")
    lost = (F.col("lost_end") | F.col("lost_start")).cast("int")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_answers"), F.sum(F.col("lost_end").cast("int")).alias("n_lost_end"), F.sum(F.col("lost_start").cast("int")).alias("n_lost_start"), F.avg(lost).alias("rate"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_fields(spread(table(spark, d, "postcutoff_words")), "row_id", ["text", "top_10_words"]).select("row_id", "field")


def p4_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_fields(spread(table(spark, d, "postcutoff_words")), "row_id", ["text", "top_10_words"])


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_report(spread(table(spark, d, "postcutoff_words")), "row_id", ["text", "top_10_words"])


def _leaks(spark: SparkSession, d: str, window: int, max_edits: int) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", window, max_edits)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages of eight words up to one edit, of which the exact check keeps those without any."""
    return _leaks(spark, d, 8, 1).where("edits = 0").select("doc_id", "item_id").distinct()


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of sixteen words, the length of the shortest items, of which up to three differ."""
    return _leaks(spark, d, 16, 3)


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """For each item the documents with eight of its words in a row, those with as many but for one, and the longest run
    of matching windows."""
    docs = lambda c: F.countDistinct(F.when(c, F.col("doc_id")))
    return _leaks(spark, d, 8, 1).groupBy("item_id").agg(docs(F.col("edits") == 0).alias("n_docs"), docs(F.col("edits") > 0).alias("n_near"), F.max("windows").alias("most_windows"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.document_sizes(table(spark, d, "documents"), "doc_id", "text", "source")
    return sizes, mixing.mixture_plan(sizes, table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_documents(*_mixture(spark, d))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = _mixture(spark, d)
    return mixing.mixture_report(mixing.mixed_documents(sizes, plan), plan)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources of which the mixture has less than their share, repeated as often as is allowed."""
    return p7_report(spark, d).where("short").select("source")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    ratings = table(spark, d, "reading_labels").select(F.col("doc_id").alias("doc"), "level")
    return reading.reading_levels(table(spark, d, "documents"), "doc_id", "text", "lang", ratings)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where("level >= 4 and n_words >= 60").select("doc_id")


def p8_words(spark: SparkSession, d: str) -> DataFrame:
    """The list of familiar words, with the document counts that it comes from."""
    return reading.corpus_words(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p2_found, p2_quotas, p2_margins, p2_sample, p3_found, p3_rates, p4_found, p4_consistent, p4_report, p6_found, p6_passages, p6_items, p7_found, p7_mixture, p7_report, p8_found, p8_levels, p8_words)}
_SUPPLY = f"""WITH c AS (SELECT {sql.plain_key("model")} AS m, {sql.parts_key("grade")} AS g, is_future, count(DISTINCT (upper(trim(id, ' ')), {sql.plain_key("model")})) AS available
 FROM neighborhood_key WHERE id IS NOT NULL AND model IS NOT NULL AND grade IS NOT NULL AND is_future IS NOT NULL GROUP BY ALL),
 s AS (SELECT t.*, share * sample_size AS wanted, coalesce(available, 0) AS available FROM sample_targets t LEFT JOIN c ON c.m = {sql.plain_key("t.model")} AND c.g = {sql.parts_key("t.grade")} AND c.is_future = t.is_future)"""
_TERMS = rf"""WITH {sql.slots("postcutoff_words", "row_id", "top_10_words")}, r AS (SELECT 'top_10_words' AS field, k, list_filter(slots, lambda v: v <> '') AS terms FROM sl
  UNION ALL SELECT 'target_word', row_id, [lower(regexp_replace(regexp_replace(target_word, '^[\s\x{{A0}}]+', ''), '[\s\x{{A0}}]+$', ''))] FROM postcutoff_words WHERE trim(target_word, chr(160) || ' ' || chr(9) || chr(10)) <> ''),
 i AS (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM r), g AS (SELECT field, k, j - i + 1 AS n, terms[i:j] AS gram FROM (SELECT *, unnest(range(i, len(terms) + 1)) AS j FROM i)),
 f AS (SELECT field, gram, CAST(n AS INT) AS n, count(*) AS occurrences, count(DISTINCT k) AS records FROM g GROUP BY ALL),
 m AS (SELECT *, CASE WHEN records < {RARE_BELOW} THEN 'rare' WHEN records > {COMMON_ABOVE} * (SELECT count(*) FROM postcutoff_words) THEN 'common' END AS mark FROM f)"""
_FORMS = " UNION ALL ".join(f"SELECT row_id, '{f}' AS field, {f} AS original, {sql.consistent(f)} AS consistent FROM postcutoff_words WHERE {f} IS NOT NULL" for f in ("text", "top_10_words"))


def _shingles(source: str, key: str) -> str:
    """The eight-word windows of a table's texts, in DuckDB."""
    whole = rf"regexp_replace({sql.consistent('text')}, '(\p{{L}})-[ \t]*\r?\n[ \t]*(\p{{L}})', '\1\2', 'g')"
    words = rf"regexp_extract_all(lower({whole}), '[\p{{L}}\p{{N}}]+')"
    return f"SELECT {key}, unnest([array_to_string(w[i:i + 7], ' ') for i in range(1, len(w) - 6)]) AS gram FROM (SELECT {key}, {words} AS w FROM {source} WHERE text IS NOT NULL)"


#: The others can't be said in SQL (models, walks, tokenizers); they are tested by brute force.
ORACLES: dict[str, str] = {
    "p1_found": _TERMS + " SELECT field, gram[1] AS term, mark FROM m WHERE n = 1 AND mark IS NOT NULL",
    "p1_frequencies": _TERMS + " SELECT field, array_to_string(gram, ' | ') AS term, n, occurrences, records, mark FROM m WHERE n = 1 OR occurrences > 1",
    "p2_found": _SUPPLY + " SELECT target_set, model, grade, is_future FROM s WHERE available < greatest(wanted, min_rows)",
    "p6_found": f"WITH h AS ({_shingles('eval_items', 'item_id')}), g AS ({_shingles('documents', 'doc_id')}) SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)",
    "p4_found": f"SELECT row_id, field FROM ({_FORMS}) WHERE original <> consistent",
    "p4_consistent": f"SELECT * FROM ({_FORMS}) WHERE original <> consistent",
    "p4_report": f"SELECT field, count(*) AS n_values, count(*) FILTER (original <> consistent) AS n_cases FROM ({_FORMS}) GROUP BY field",
}
