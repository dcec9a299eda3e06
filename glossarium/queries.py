"""Registered queries of the core: (spark, folder of tables) -> DataFrame, over the whole tables, with the same query
for DuckDB beside each, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium import sql
from glossarium.functions import stats
from glossarium.functions.spelling import plain_key
from glossarium.functions.text import letter_tokens, norm, prefix_before
from glossarium.operators import decoding, neighborhood, perturbation, predictions, records, sampling, scaffold
from glossarium.operators.packed import unpack_values
from glossarium.sources.session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# ---------------------------------------------------------------- packed fields


_PACKED = (("postcutoff_words", "row_id", "top_10_words", "s1"), ("neighborhood_key", "key_no", "stem_donors", "s2"), ("neighborhood_key", "key_no", "affix_donors", "s3"))


@query("WITH " + ", ".join(sql.slots(*x) for x in _PACKED) + " " + " UNION ALL ".join(sql.unpacked(*x) for x in _PACKED))
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    words, key = spread(table(spark, d, "postcutoff_words")), spread(table(spark, d, "neighborhood_key"))

    def part(df: DataFrame, tab: str, row_id: str, field: str) -> DataFrame:
        return unpack_values(df, row_id, field).select(F.lit(tab).alias("tab"), F.col(row_id).alias("row_id"), F.lit(field).alias("field"), "pos", "value")

    return part(words, "postcutoff_words", "row_id", "top_10_words").unionByName(part(key, "neighborhood_key", "key_no", "stem_donors")).unionByName(part(key, "neighborhood_key", "key_no", "affix_donors"))


# ---------------------------------------------------------------- predictions

_P = sql.slots("postcutoff_words", "row_id", "top_10_words") + r""", p AS (SELECT row_id, w.model, item_id, text, target_word, year, rank, cutoff_year,
  CAST(floor(CASE WHEN isnan(e) THEN NULL ELSE e END) AS INT) AS entry_year,
  list_filter(coalesce(sl.slots, []), lambda v: v <> '') AS words,
  CASE WHEN year > cutoff_year THEN 1 ELSE 0 END AS is_future,
  lower(trim(coalesce(target_word, ''), ' ')) AS target,
  regexp_replace(CASE WHEN trim(coalesce(target_word, ''), ' ') <> '' AND contains(lower(text), lower(trim(target_word, ' ')))
    THEN substring(text, 1, length(lower(text)) - length(string_split(lower(text), lower(trim(target_word, ' ')))[-1]) - length(trim(target_word, ' ')))
    ELSE text END, '\s+$', '') AS prefix
  FROM (SELECT * EXCLUDE text, """ + sql.consistent("text") + """ AS text, TRY_CAST(nullif(trim(entry_start_year), 'None') AS DOUBLE) AS e FROM postcutoff_words) w JOIN models USING (model) LEFT JOIN sl ON sl.k = row_id)"""
_HIT = "CASE WHEN rank BETWEEN 1 AND 100 THEN 1 ELSE 0 END"


@query(f"""WITH {_P} SELECT row_id, model, substring(md5(concat_ws('␟', target, coalesce(prefix, ''))), 1, 12) AS key, CAST(length(prefix) AS INT) AS prefix_chars, CAST(is_future AS INT) AS is_future,
  CAST(CASE WHEN target = '' THEN -1 ELSE coalesce(nullif(list_position(list_transform(words, lambda v: lower(trim(v, ' '))), target), 0), -1) END AS INT) AS list_rank,
  {", ".join(f"CAST(CASE WHEN rank BETWEEN 1 AND {k} THEN 1 ELSE 0 END AS INT) AS correct_{k}" for k in predictions.KS)} FROM p""")
def q01_prediction_details(spark: SparkSession, d: str) -> DataFrame:
    return predictions.prediction_details(predictions.predictions(spark, d))


_SUMMARY = f"""WITH {_P}, l AS (SELECT model, is_future, k, CASE WHEN rank BETWEEN 1 AND k THEN 1 ELSE 0 END AS hit FROM p CROSS JOIN (VALUES (10), (20), (50), (100)) v(k)),
 g AS (SELECT model, k, count(*) FILTER (is_future = 0) AS n_past, count(*) FILTER (is_future = 1) AS n_future, CAST(sum(hit * (1 - is_future)) AS BIGINT) AS past_hits, CAST(sum(hit * is_future) AS BIGINT) AS future_hits FROM l GROUP BY ALL),
 r AS (SELECT *, CASE WHEN n_past > 0 THEN past_hits / n_past ELSE 0.0 END AS recall, CASE WHEN n_future > 0 THEN future_hits / n_future ELSE 0.0 END AS leakage FROM g)
 SELECT model, CAST(k AS INT) AS k, n_past, n_future, past_hits, future_hits, round(CAST(recall AS DOUBLE), 9) AS recall, round(CAST(leakage AS DOUBLE), 9) AS leakage, CASE WHEN recall > 0 THEN round(CAST(leakage / recall AS DOUBLE), 9) ELSE 'infinity'::DOUBLE END AS normalised FROM r"""


@query(_SUMMARY)
def q02_recall_and_leakage(spark: SparkSession, d: str) -> DataFrame:
    r = predictions.recall_and_leakage(predictions.predictions(spark, d))
    return r.withColumns({c: F.round(c, 9) for c in ("recall", "leakage", "normalised")})


@query(f"""SELECT domain AS category, locality AS level, count(*) AS n_samples, count(*) FILTER (rank > 0) AS n_found, round(count(*) FILTER (rank > 0) * 100.0 / count(*), 6) AS pct_found,
 round(coalesce(avg(rank) FILTER (rank > 0), 'infinity'::DOUBLE), 6) AS mean_rank, coalesce(median(rank) FILTER (rank > 0), 'infinity'::DOUBLE) AS median_rank, round(avg({_HIT}), 9) AS recall_100 FROM neighborhood_key GROUP BY ALL""")
def q03_composition_summary(spark: SparkSession, d: str) -> DataFrame:
    found = F.when(F.col("rank") > 0, F.col("rank"))
    g = table(spark, d, "neighborhood_key").groupBy(F.col("domain").alias("category"), F.col("locality").alias("level"))
    inf = F.lit(float("inf"))
    return g.agg(F.count(F.lit(1)).alias("n_samples"), F.count(found).alias("n_found"), F.round(F.count(found) * 100.0 / F.count(F.lit(1)), 6).alias("pct_found"), F.round(F.coalesce(F.avg(found), inf), 6).alias("mean_rank"), F.coalesce(F.median(found), inf).alias("median_rank"), F.round(F.avg(predictions.hit(F.col("rank"), 100)), 9).alias("recall_100"))


_BINS = f"""WITH {_P}, y AS (SELECT model, cutoff_year, min(year) AS first, max(year) AS last FROM p WHERE year IS NOT NULL GROUP BY ALL),
 s AS (SELECT *, unnest(range(first - first % 100, first + 50, 10)) AS start FROM y), t AS (SELECT *, unnest(range(10, 201)) AS width FROM s WHERE start < cutoff_year),
 b AS (SELECT model, first, last, cutoff_year, arg_min(struct_pack(start := start, width := width), (abs(width - 25), start, width)) AS x FROM t WHERE (cutoff_year - start) % width = 0 AND abs(width - 25) <= 15 GROUP BY ALL),
 r AS (SELECT p.model, rank, year, last, b.cutoff_year, x.start AS start, x.width AS width, floor((year - x.start) / x.width) AS bin FROM p JOIN b USING (model) WHERE year >= x.start),
 bins AS (SELECT model, cutoff_year, CAST(start + bin * width AS INT) AS year_bin, CAST(width AS INT) AS width, avg({_HIT}) AS recall, avg(1.0 / CASE WHEN rank > 0 THEN rank ELSE 101 END) AS adj_mrr, count(*) AS n, stddev_samp({_HIT}) / sqrt(count(*)) AS std_err
  FROM r WHERE start + (bin + 1) * width <= start + ceil((last - start) / width) * width GROUP BY ALL)"""


@query(_BINS + " SELECT model, year_bin, width, round(recall, 9) AS recall, round(adj_mrr, 9) AS adj_mrr, n, round(std_err, 9) AS std_err FROM bins")
def q04_year_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions.predictions(spark, d)
    return predictions.year_bins(rows, predictions.bin_plan(rows)).withColumns({c: F.round(c, 9) for c in ("recall", "adj_mrr", "std_err")})


@query(_BINS + """, m AS (SELECT model, sum(recall * n) FILTER (year_bin < cutoff_year) / sum(n) FILTER (year_bin < cutoff_year) AS pre, sum(recall * n) FILTER (year_bin >= cutoff_year) / sum(n) FILTER (year_bin >= cutoff_year) AS post FROM bins GROUP BY ALL)
 SELECT model, round(pre, 9) AS pre, round(post, 9) AS post_mean, CASE WHEN pre > 0 THEN round(post / pre, 9) END AS ratio FROM m""")
def q05_before_and_after(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions.predictions(spark, d)
    r = predictions.before_and_after(predictions.year_bins(rows, predictions.bin_plan(rows)), table(spark, d, "models"))
    return r.withColumns({c: F.round(c, 9) for c in ("pre", "post_mean", "ratio")})


_POST = "year > cutoff_year"
_ANCHORED = "coalesce(entry_year <= cutoff_year, false)"


@query(f"WITH {_P}, s AS ("
 + " UNION ALL ".join(f"SELECT model, '{n}' AS stratum, {_HIT} AS hit FROM p WHERE {c}" for n, c in (("in_cutoff", "year <= cutoff_year"), ("post_cutoff", _POST), ("anchored", f"{_POST} AND {_ANCHORED}"), ("unanchored", f"{_POST} AND NOT {_ANCHORED}"), ("age_000", f"{_POST} AND year - entry_year >= 0 AND year - entry_year < 50"), ("age_050", f"{_POST} AND year - entry_year >= 50 AND year - entry_year < 150"), ("age_150", f"{_POST} AND year - entry_year >= 150 AND year - entry_year < 400"), ("age_400", f"{_POST} AND year - entry_year >= 400 AND year - entry_year < 1000000")))
 + ") SELECT model, stratum, count(*) AS n, CAST(sum(hit) AS BIGINT) AS recalled, round(sum(hit) * 100.0 / count(*), 6) AS rate FROM s GROUP BY ALL")
def q06_population_strata(spark: SparkSession, d: str) -> DataFrame:
    return predictions.population_strata(predictions.predictions(spark, d)).withColumn("rate", F.round("rate", 6))


_HEADWORDS = "v AS (SELECT DISTINCT lower(trim(headword, ' ')) AS word FROM documents WHERE headword IS NOT NULL)"


@query(f"""WITH {_P}, {_HEADWORDS}, x AS (SELECT p.model, CASE WHEN v.word IS NULL THEN 0 ELSE 1 END AS inside, {_HIT} AS hit FROM p LEFT JOIN v ON p.target = v.word),
 g AS (SELECT model, inside, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM x GROUP BY ALL)
 SELECT model, CAST(inside AS INT) AS inside, n, hits, round(hits / n, 9) AS recall, round(n / sum(n) OVER (PARTITION BY model), 9) AS share, round(hits / sum(n) OVER (PARTITION BY model), 9) AS contribution FROM g""")
def q07_subset_contributions(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(norm(F.col("headword")).alias("word")).where("word <> ''")
    r = predictions.subset_contributions(predictions.predictions(spark, d), words)
    return r.withColumns({c: F.round(c, 9) for c in ("recall", "share", "contribution")})


@query(f"""WITH {_P}, l AS (SELECT model, target, year, arg_max(coalesce(rank, -9), row_id) AS rank, max(row_id) AS row_id FROM p WHERE target <> '' GROUP BY ALL), m AS (SELECT * FROM l WHERE NOT rank BETWEEN 1 AND 100)
 SELECT a.target, a.year, a.row_id AS row_a, b.row_id AS row_b FROM m a JOIN m b ON a.target = b.target AND a.year IS NOT DISTINCT FROM b.year WHERE a.model = 'talkie-base' AND b.model = 'talkie-web'""")
def q08_both_missed(spark: SparkSession, d: str) -> DataFrame:
    return predictions.both_missed(predictions.predictions(spark, d), "talkie-base", "talkie-web")


# ---------------------------------------------------------------- neighborhoods

_LEX = r"""t AS (SELECT DISTINCT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w FROM documents)),
 lex AS (SELECT word, count(*) AS n_docs, (SELECT count(DISTINCT doc_id) FROM documents) AS all_docs FROM t GROUP BY word)"""


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """(word, n_docs, all_docs): document frequencies of the corpus."""
    docs = table(spark, d, "documents")
    words = docs.select("doc_id", F.array_distinct(letter_tokens(F.col("text"))).alias("t"))
    return words.select(F.explode_outer("t").alias("word")).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("all_docs", F.lit(docs.count()))




def _one_byte(column: str) -> str:
    """DuckDB's levenshtein() counts bytes: letters outside ASCII stand as one other character each."""
    return f"regexp_replace(translate({column}, 'éèçïñöüåæœàūΔγλ', '!\"#$%&()*+<=>@^'), '[^\\x00-\\x7F]', '~', 'g')"


def _edits(a: str, b: str) -> str:
    return f"levenshtein({_one_byte(a)}, {_one_byte(b)})"


_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(target, '{s}') AND length(target) > {len(s) + 1} THEN '{s}'" for s in sorted(neighborhood.SUFFIXES, key=len, reverse=True)) + " ELSE '' END"
_LABELLED = f"""{_P}, {_LEX}, w AS (SELECT row_id, model, rank, target, CAST(unnest(range(1, len(words) + 1)) AS INT) AS pos, unnest(list_transform(words, lambda v: lower(trim(v, ' ')))) AS word FROM p WHERE target <> ''),
 j AS (SELECT w.*, n_docs, all_docs, {_SUFFIX} AS ending FROM w LEFT JOIN lex USING (word)),
 k AS (SELECT *, CASE WHEN word = '' THEN 'EMPTY' WHEN word = target THEN 'SELF' WHEN coalesce(n_docs > 0.5 * all_docs, false) THEN 'FILLER'
  WHEN length(target) > 5 AND left(target, 5) = left(word, 5) OR {_edits('target', 'word')} / greatest(length(target), length(word), 1) <= 0.34 THEN 'STEM'
  WHEN length(ending) >= 3 AND ends_with(word, ending) THEN 'AFFIX' ELSE 'DISTANT' END AS label FROM j),
 lab AS (SELECT row_id, model, rank, pos, target, word, label, CASE WHEN label IN ('STEM', 'AFFIX') THEN CASE WHEN coalesce(n_docs, 0) >= 3 THEN 'attested' ELSE 'coined' END ELSE '' END AS novelty FROM k)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood.labelled_neighbors(predictions.predictions(spark, d), _lexicon(spark, d))


@query(f"WITH {_LABELLED} SELECT model, label, novelty, count(*) AS n, count(DISTINCT word) AS n_words FROM lab GROUP BY ALL")
def q09_neighbor_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).groupBy("model", "label", "novelty").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("word").alias("n_words"))


@query(f"""WITH {_LABELLED}, g AS (SELECT row_id, model, rank, count(*) FILTER (label = 'STEM') AS n_stem, count(*) FILTER (label = 'AFFIX') AS n_affix, count(*) FILTER (label = 'FILLER') AS n_filler, count(*) FILTER (label = 'DISTANT') AS n_distant,
 count(*) FILTER (novelty = 'coined') AS n_coined, greatest(count(*) FILTER (label NOT IN ('EMPTY', 'SELF')), 1) AS scored FROM lab GROUP BY ALL)
 SELECT row_id, model, rank, n_stem, n_affix, n_filler, n_distant, n_coined, scored, round(n_filler / scored, 9) AS filler_share, CASE WHEN rank BETWEEN 1 AND 100 THEN 'hit' WHEN n_coined > 0 THEN 'comp-near-miss' WHEN n_stem + n_affix > 0 THEN 'retr-near-miss' WHEN n_distant >= n_filler THEN 'distant-miss' ELSE 'filler-miss' END AS outcome FROM g""")
def q10_outcome_profiles(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood.profiles(_labelled(spark, d)).withColumn("filler_share", F.round("filler_share", 9)).withColumn("scored", F.col("scored").cast("long"))


@query(f"""WITH {_LABELLED}, c AS (SELECT DISTINCT target, word FROM lab WHERE novelty = 'coined'),
 b AS (SELECT target, word, CAST(x.s AS VARCHAR) AS base FROM c, (VALUES ('s'), ('es'), ('ed'), ('ing')) x(s) WHERE ends_with(word, x.s) AND length(word) - length(x.s) >= 4),
 f AS (SELECT target, word, left(word, length(word) - length(base)) AS stem FROM b),
 a AS (SELECT DISTINCT f.target, f.word FROM f JOIN lex ON lex.word IN (f.stem, f.stem || 'e') WHERE n_docs >= 3)
 SELECT kind, count(*) AS n, CAST(sum(length(word)) AS BIGINT) AS n_chars FROM (SELECT c.*, CASE WHEN regexp_matches(c.word, '[^\\x00-\\x7F]') OR abs(length(c.word) - length(c.target)) <= 2 AND {_edits('c.word', 'c.target')} <= 2 AND NOT (length(c.word) >= length(c.target) + 2 AND ends_with(c.word, c.target))
  OR length(c.word) >= 5 AND (starts_with(c.word, c.target) OR starts_with(c.target, c.word)) THEN 'ORTHOGRAPHIC' WHEN a.word IS NOT NULL THEN 'INFLECTION' ELSE 'DERIVATIONAL' END AS kind FROM c LEFT JOIN a ON a.target = c.target AND a.word = c.word) GROUP BY kind""")
def q11_flag_kinds(spark: SparkSession, d: str) -> DataFrame:
    lexicon = _lexicon(spark, d)
    c = neighborhood.labelled_neighbors(predictions.predictions(spark, d), lexicon).where("novelty = 'coined'").select("target", "word").distinct()
    stems = [F.when(F.endswith("word", F.lit(s)) & (F.length("word") - len(s) >= 4), F.expr(f"left(word, length(word) - {len(s)})")) for s in ("s", "es", "ed", "ing")]
    bases = F.filter(F.array(*stems, *(F.concat(s, F.lit("e")) for s in stems)), lambda b: b.isNotNull())
    known = lexicon.where("n_docs >= 3").select(F.col("word").alias("base"))
    found = c.select("target", "word", F.explode_outer(bases).alias("base")).where("base is not null").join(known, "base").groupBy("target", "word").agg(F.collect_set("base").alias("bases"))
    x = c.join(found, ["target", "word"], "left")
    kind = neighborhood.flag_kind(F.col("target"), F.col("word"), F.coalesce("bases", F.array().cast("array<string>")))
    return x.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("n_chars"))


_GRAMS = "list_distinct([substring({w}, CAST(i AS INT), 3) for i in range(1, greatest(length({w}) - 1, 1))])"
_RUN = "list_max([CASE WHEN list_bool_or([contains({b}, substring({a}, CAST(i AS INT), CAST(n AS INT))) for i in range(1, length({a}) - n + 2)]) THEN n ELSE 0 END for n in range(1, length({a}) + 1)])"
_PAIRS = f"""w AS (SELECT DISTINCT failure_id AS id, lower(trim(w, ' ')) AS w FROM (SELECT failure_id, unnest(words) AS w FROM judge_failures) WHERE length(trim(w, ' ')) >= 3),
 pr AS (SELECT x.id, x.w AS a, y.w AS b FROM w x JOIN w y ON x.id = y.id AND x.w < y.w),
 rn AS (SELECT a, b, CAST({_RUN.format(a="a", b="b")} AS INT) AS run FROM (SELECT DISTINCT a, b FROM pr) WHERE list_has_any({_GRAMS.format(w="a")}, {_GRAMS.format(w="b")}))"""


@query(f"WITH {_PAIRS} SELECT run, count(*) AS n_pairs, count(DISTINCT id) AS n_lists, min(a) AS first_a FROM pr JOIN rn USING (a, b) GROUP BY run")
def q12_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = neighborhood.overlap_pairs(table(spark, d, "judge_failures").select(F.col("failure_id").alias("id"), "words"))
    return x.groupBy("run").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("id").alias("n_lists"), F.min("a").alias("first_a"))


_GROUPS = f"""WITH RECURSIVE n AS (SELECT id, w, min(pos) AS pos FROM (SELECT failure_id AS id, lower(trim(unnest(words), ' ')) AS w, unnest(range(len(words))) AS pos FROM judge_failures) GROUP BY ALL),
 e AS (SELECT x.id, x.pos AS a, y.pos AS b FROM n x JOIN n y ON x.id = y.id AND x.w <> y.w WHERE length(x.w) >= 3 AND length(y.w) >= 3 AND list_has_any({_GRAMS.format(w="x.w")}, {_GRAMS.format(w="y.w")})),
 r AS (SELECT id, pos AS a, pos AS b FROM n UNION SELECT r.id, r.a, e.b FROM r JOIN e ON r.id = e.id AND r.b = e.a), c AS (SELECT id, a AS pos, min(b) AS comp FROM r GROUP BY ALL), s AS (SELECT id, comp, count(*) AS size FROM c GROUP BY ALL),
 b AS (SELECT id, arg_max(comp, (size, -comp)) AS comp, max(size) AS size FROM s GROUP BY id), m AS (SELECT n.id, n.w FROM c JOIN b ON c.id = b.id AND c.comp = b.comp JOIN n ON n.id = c.id AND n.pos = c.pos WHERE size >= 2),
 i AS (SELECT x.id, CASE WHEN length(x.w) <= length(y.w) THEN x.w ELSE y.w END AS lo, CASE WHEN length(x.w) <= length(y.w) THEN y.w ELSE x.w END AS hi FROM m x JOIN m y ON x.id = y.id AND x.w <> y.w),
 k AS (SELECT DISTINCT id FROM i WHERE NOT (hi IN (lo || 's', lo || 'es', lo || 'ed', lo || 'ing') OR ends_with(lo, 'e') AND hi IN (left(lo, length(lo) - 1) || 's', left(lo, length(lo) - 1) || 'es', left(lo, length(lo) - 1) || 'ed', left(lo, length(lo) - 1) || 'ing'))),
 g AS (SELECT id, count(*) AS form_n, string_agg(w, '|' ORDER BY w) AS members FROM m JOIN k USING (id) GROUP BY id)
 SELECT failure_id AS id, CAST(coalesce(form_n, 0) AS INT) AS form_n, coalesce(members, '') AS members FROM judge_failures LEFT JOIN g ON g.id = failure_id"""


@query(_GROUPS)
def q13_form_groups(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood.form_groups(spread(table(spark, d, "judge_failures").select(F.col("failure_id").alias("id"), "words")))


@query(f"""WITH {_P}, w AS (SELECT DISTINCT lower(trim(w, ' ')) AS w FROM (SELECT unnest(words) AS w FROM p) WHERE regexp_full_match(lower(trim(w, ' ')), '\\p{{L}}{{4,}}')),
 k AS (SELECT w, unnest(range(2, 8)) AS k FROM w), e AS (SELECT '^' || left(w, k) AS gram FROM k WHERE length(w) > k + 1 UNION ALL SELECT right(w, k) || '$' FROM k WHERE length(w) > k + 1)
 SELECT gram, count(*) AS n_words, round(-log2(count(*) / (SELECT count(*) FROM w)), 6) AS surprisal FROM e GROUP BY gram""")
def q14_edge_ngrams(spark: SparkSession, d: str) -> DataFrame:
    words = predictions.predictions(spark, d).select(F.explode_outer("words").alias("word")).where("word is not null")
    return neighborhood.edge_ngrams(words).withColumn("surprisal", F.round("surprisal", 6))


# ---------------------------------------------------------------- prompts

_DONORS = rf"""{_P}, tk AS (SELECT row_id, target, [lower(w) for w in regexp_extract_all(coalesce(prefix, ''), '[A-Za-z]+')] AS tokens FROM p),
 dn AS (SELECT *, [w for w in list_distinct(tokens) if w <> target AND length(w) >= 4] AS ws FROM tk),
 sa AS (SELECT *, list_sort([w for w in ws if length(target) > 5 AND left(target, 5) = left(w, 5) OR length(target) >= 4 AND (contains(target, w) OR contains(w, target))]) AS stems, list_sort([w for w in ws if length(target) > 4 AND right(target, 4) = right(w, 4)]) AS affixes FROM dn)"""


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return predictions.predictions(spark, d).select("row_id", norm(F.col("target_word")).alias("target"), prefix_before(F.col("text"), F.col("target_word")).alias("prefix"), "words")


@query(rf"""WITH {_DONORS}, m AS (SELECT *, coalesce(list_max([CASE WHEN list_contains(stems, tokens[i]) OR list_contains(affixes, tokens[i]) THEN i - 1 ELSE -1 END for i in range(1, len(tokens) + 1)]), -1) AS last FROM sa)
 SELECT row_id, target, array_to_string(stems, '|') AS stem_donors, array_to_string(affixes, '|') AS affix_donors, CAST(CASE WHEN last < 0 THEN -1 ELSE len(tokens) - last END AS INT) AS distance,
 CASE WHEN len(stems) > 0 AND len(affixes) > 0 THEN 'STEM+AFFIX' WHEN len(stems) > 0 THEN 'STEM' WHEN len(affixes) > 0 THEN 'AFFIX' ELSE 'NONE' END AS grade FROM m""")
def q15_donors(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.donors(_prompts(spark, d))


@query(rf"""WITH {_P}, x AS (SELECT DISTINCT row_id, target, lower(w) AS word FROM (SELECT row_id, target, unnest(regexp_extract_all(right(prefix, 320), '[A-Za-z]+')) AS w FROM p WHERE target <> '') WHERE length(w) >= 4 AND lower(w) <> target),
 r AS (SELECT *, CAST({_RUN.format(a="word", b="target")} AS INT) AS run, round({_edits('word', 'target')} / greatest(length(word), length(target)), 9) AS share FROM (SELECT DISTINCT word, target FROM x))
 SELECT row_id, target, word, run, share FROM x JOIN r USING (word, target) WHERE run >= 3 OR share <= 0.34""")
def q16_prompt_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.overlap_table(_prompts(spark, d)).withColumn("share", F.round("share", 9))


@query(rf"""WITH {_P}, tk AS (SELECT row_id, target, [lower(w) for w in regexp_extract_all(coalesce(prefix, ''), '[A-Za-z]+')] AS tokens, list_distinct([lower(trim(v, ' ')) for v in words]) AS ws FROM p),
 f AS (SELECT row_id, tokens, [w for w in ws if w <> target AND length(w) >= 4 AND (length(target) > 5 AND left(target, 5) = left(w, 5) OR {_edits('w', 'target')} / greatest(length(w), length(target), 1) <= 0.34)] AS form FROM tk)
 SELECT row_id, CAST(len([w for w in form if NOT list_contains(tokens, w)]) AS INT) AS n_attempts, array_to_string(list_sort([w for w in form if NOT list_contains(tokens, w)]), '|') AS attempts,
 CAST(len([w for w in form if list_contains(tokens, w)]) AS INT) AS n_echoes, array_to_string(list_sort([w for w in form if list_contains(tokens, w)]), '|') AS echoes FROM f""")
def q17_attempts_and_echoes(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.attempts_and_echoes(_prompts(spark, d))


# the rows of neighborhood_key by the names of models and grades, however they are spelled
_NAMED = f"""nk AS (SELECT k.* EXCLUDE (model, grade), m.model, CASE {sql.parts_key("k.grade")} WHEN 'affix+stem' THEN 'STEM+AFFIX' WHEN 'stem' THEN 'STEM' WHEN 'affix' THEN 'AFFIX' WHEN 'none' THEN 'NONE' ELSE upper(trim(k.grade, ' ')) END AS grade
 FROM neighborhood_key k JOIN models m ON {sql.plain_key("k.model")} = {sql.plain_key("m.model")})"""


@query(f"WITH {_NAMED} SELECT model, grade, is_future, count(*) AS n, CAST(sum({_HIT}) AS BIGINT) AS hits, round(avg({_HIT}), 9) AS rate FROM nk WHERE grade IS NOT NULL AND is_future IS NOT NULL GROUP BY ALL")
def q18_recall_ladder(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.recall_ladder(_decoded(spark, d)).withColumn("rate", F.round("rate", 9))


@query(f"""WITH x AS (SELECT route, locality, CASE WHEN route = 'syntagmatic' THEN ending_rarity END AS rarity, {_HIT} AS hit FROM neighborhood_key)
 SELECT 'route' AS moderator, route AS value, count(*) AS n, round(avg(hit), 9) AS rate FROM x WHERE route IS NOT NULL GROUP BY route UNION ALL SELECT 'locality', locality, count(*), round(avg(hit), 9) FROM x WHERE locality IS NOT NULL GROUP BY locality
 UNION ALL SELECT 'rarity', rarity, count(*), round(avg(hit), 9) FROM x WHERE rarity IS NOT NULL GROUP BY rarity UNION ALL SELECT 'all', NULL, count(*), round(avg(hit), 9) FROM x""")
def q19_moderators(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.moderators(table(spark, d, "neighborhood_key")).withColumn("rate", F.round("rate", 9))


# ---------------------------------------------------------------- association

_CELLS = "count(*) FILTER (cue AND outcome) AS a, count(*) FILTER (NOT cue AND outcome) AS b, count(*) FILTER (cue AND NOT outcome) AS c, count(*) FILTER (NOT cue AND NOT outcome) AS d"
_CUES = f"{_NAMED}, cu AS (SELECT model, is_future, route <> 'none' AS cue, {_HIT} = 1 AS outcome FROM nk WHERE is_future IS NOT NULL AND route IS NOT NULL)"


def _cells(x: DataFrame, *by: str) -> DataFrame:
    one = lambda c: F.count_if(c)
    cue, out = F.col("cue"), F.col("outcome")
    return x.groupBy(*by).agg(one(cue & out).alias("a"), one(~cue & out).alias("b"), one(cue & ~out).alias("c"), one(~cue & ~out).alias("d"))


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """The rows of neighborhood_key whose model is one of `models` under any spelling, with the name it has there."""
    names = table(spark, d, "models").select(plain_key(F.col("model")).alias("_key"), F.col("model").alias("_name"))
    x = spread(table(spark, d, "neighborhood_key")).withColumn("_key", plain_key(F.col("model"))).join(names, "_key")
    return x.withColumn("model", F.col("_name")).drop("_key", "_name")


def _cues(spark: SparkSession, d: str) -> DataFrame:
    x = _decoded(spark, d).where("is_future is not null and route is not null")
    return x.select("model", "is_future", (F.col("route") != "none").alias("cue"), (predictions.hit(F.col("rank"), 100) == 1).alias("outcome"))


_HALDANE = "(CASE WHEN least({0}a, {0}b, {0}c, {0}d) = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END)"
_G2 = "CASE WHEN least((a+b)*(a+c), (a+b)*(b+d), (c+d)*(a+c), (c+d)*(b+d)) > 0 THEN 2 * (" + " + ".join(f"CASE WHEN {o} > 0 THEN {o} * ln({o} * n / ({r} * {c})) ELSE 0 END" for o, r, c in (("a", "(a+b)", "(a+c)"), ("b", "(a+b)", "(b+d)"), ("c", "(c+d)", "(a+c)"), ("d", "(c+d)", "(b+d)"))) + ") ELSE 0 END"


@query(f"""WITH {_CUES}, t AS (SELECT model, {_CELLS} FROM cu GROUP BY model), h AS (SELECT model, a::DOUBLE a, b::DOUBLE b, c::DOUBLE c, d::DOUBLE d, (a+b+c+d)::DOUBLE AS n, {_HALDANE.format("")} AS z FROM t),
 l AS (SELECT *, ln((a+z)*(d+z)/((b+z)*(c+z))) AS lam, sqrt(1/(a+z)+1/(b+z)+1/(c+z)+1/(d+z)) AS se, {_G2} AS g FROM h)
 SELECT model, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(lam, 6) AS lambda, round(exp(lam), 6) AS odds_ratio, round(exp(lam - {stats.Z} * se), 6) AS low, round(exp(lam + {stats.Z} * se), 6) AS high, round(g, 6) AS g_squared,
 round(least((a+b)*(a+c), (a+b)*(b+d), (c+d)*(a+c), (c+d)*(b+d)) / n, 6) AS least_expected, CASE WHEN g >= 10.828 THEN '***' WHEN g >= 6.635 THEN '**' WHEN g >= 3.841 THEN '*' ELSE '' END AS stars FROM l""")
def q20_association(spark: SparkSession, d: str) -> DataFrame:
    t = _cells(_cues(spark, d), "model")
    c = [F.col(x) for x in "abcd"]
    lam, se, g = stats.log_odds_ratio(c), stats.log_odds_error(c), stats.g_squared(c)
    r = lambda x: F.round(x, 6)
    return t.select("model", *"abcd", r(lam).alias("lambda"), r(F.exp(lam)).alias("odds_ratio"), r(F.exp(lam - stats.Z * se)).alias("low"), r(F.exp(lam + stats.Z * se)).alias("high"), r(g).alias("g_squared"), r(stats.least_expected(c)).alias("least_expected"), stats.stars(g).alias("stars"))


_GAP = "ln((pa+({x}))*(pd+({x}))/((pb-({x}))*(pc-({x})))) - ln((qa-({x}))*(qd-({x}))/((qb+({x}))*(qc+({x}))))"


@query(f"""WITH RECURSIVE {_CUES}, t AS (SELECT model, is_future, {_CELLS} FROM cu GROUP BY ALL), h AS (SELECT model, is_future, a + {_HALDANE.format("")} AS a, b + {_HALDANE.format("")} AS b, c + {_HALDANE.format("")} AS c, d + {_HALDANE.format("")} AS d FROM t),
 j AS (SELECT p.model, p.a pa, p.b pb, p.c pc, p.d pd, q.a qa, q.b qb, q.c qc, q.d qd FROM h p JOIN h q USING (model) WHERE p.is_future = 1 AND q.is_future = 0),
 z AS (SELECT j.*, 0 AS step, greatest(-pa, -pd, -qb, -qc) AS low, least(pb, pc, qa, qd) AS high FROM j UNION ALL
  SELECT model, pa, pb, pc, pd, qa, qb, qc, qd, step + 1, CASE WHEN {_GAP.format(x="(low+high)/2")} > 0 THEN low ELSE (low+high)/2 END, CASE WHEN {_GAP.format(x="(low+high)/2")} > 0 THEN (low+high)/2 ELSE high END FROM z WHERE step < 80),
 f AS (SELECT *, (low+high)/2 AS x FROM z WHERE step = 80)
 SELECT model, round(ln(pa*pd/(pb*pc)) - ln(qa*qd/(qb*qc)), 6) AS lambda3, round(2 * (pa*ln(pa/(pa+x)) + pb*ln(pb/(pb-x)) + pc*ln(pc/(pc-x)) + pd*ln(pd/(pd+x)) + qa*ln(qa/(qa-x)) + qb*ln(qb/(qb+x)) + qc*ln(qc/(qc+x)) + qd*ln(qd/(qd-x))), 5) AS g_squared FROM f""")
def q21_three_way(spark: SparkSession, d: str) -> DataFrame:
    t = _cells(_cues(spark, d), "model", "is_future")
    p = t.where("is_future = 1").select("model", *(F.col(x).alias(f"p{x}") for x in "abcd"))
    q = t.where("is_future = 0").select("model", *(F.col(x).alias(f"q{x}") for x in "abcd"))
    x, y = [F.col(f"p{c}") for c in "abcd"], [F.col(f"q{c}") for c in "abcd"]
    return p.join(q, "model").select("model", F.round(stats.log_odds_ratio(x) - stats.log_odds_ratio(y), 6).alias("lambda3"), F.round(stats.three_way_g_squared(x, y), 5).alias("g_squared"))


_PAIRED = f"""pt AS (SELECT item_id, max({_HIT}) FILTER (model = 'talkie-base') AS x, max({_HIT}) FILTER (model = 'talkie-web') AS y FROM postcutoff_words GROUP BY item_id),
 bc AS (SELECT count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c, count(*) AS n FROM pt WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_PAIRED}, k AS (SELECT b, c, n, b + c AS m, least(b, c) AS k FROM bc), s AS (SELECT 0::BIGINT AS i, -m * ln(2.0::DOUBLE) AS term FROM k UNION ALL SELECT i + 1, term + ln((m - (i + 1) + 1) / (i + 1)) FROM s, k WHERE i < k.k)
 SELECT n, b, c, round(ln((b + CASE WHEN least(b, c) = 0 THEN 0.5 ELSE 0 END)::DOUBLE / (c + CASE WHEN least(b, c) = 0 THEN 0.5 ELSE 0 END)), 6) AS lambda,
 round(CASE WHEN m > 0 THEN 2 * (CASE WHEN b > 0 THEN b * ln(2.0 * b / m) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(2.0 * c / m) ELSE 0 END) ELSE 0 END, 6) AS g_squared, round(CASE WHEN m > 0 THEN least(1.0, 2 * (SELECT sum(exp(term)) FROM s)) ELSE 1.0 END, 9) AS p FROM k""")
def q22_paired_models(spark: SparkSession, d: str) -> DataFrame:
    got = lambda m: F.max(F.when(F.col("model") == m, predictions.hit(F.col("rank"), 100)))
    x = table(spark, d, "postcutoff_words").groupBy("item_id").agg(got("talkie-base").alias("x"), got("talkie-web").alias("y")).where("x is not null and y is not null")
    t = x.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"))
    b, c = F.col("b"), F.col("c")
    return t.select("n", "b", "c", F.round(stats.paired_log_ratio(b, c), 6).alias("lambda"), F.round(stats.paired_g_squared(b, c), 6).alias("g_squared"), F.round(stats.exact_binomial(b, c), 9).alias("p"))


def _wilson_sql(sign: str) -> str:
    return f"(k/n + 1.96*1.96/(2*n) {sign} 1.96*sqrt((k/n)*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)"


@query(f"""WITH t AS (SELECT domain, route, count(*)::DOUBLE AS n, sum({_HIT})::DOUBLE AS k FROM neighborhood_key GROUP BY ALL)
 SELECT domain, route, n::BIGINT AS n, k::BIGINT AS k, round(greatest(0.0, {_wilson_sql("-")}), 9) AS low, round(least(1.0, {_wilson_sql("+")}), 9) AS high FROM t""")
def q23_wilson(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "neighborhood_key").groupBy("domain", "route").agg(F.count(F.lit(1)).alias("n"), F.sum(predictions.hit(F.col("rank"), 100)).alias("k"))
    return t.select("domain", "route", "n", "k", F.round(stats.wilson(F.col("k"), F.col("n"), False), 9).alias("low"), F.round(stats.wilson(F.col("k"), F.col("n"), True), 9).alias("high"))


# ---------------------------------------------------------------- agreement

_LAST = "lw AS (SELECT id, arg_max(form, line_no) FILTER (form IS NOT NULL) AS form, arg_max(meaning, line_no) FILTER (meaning IS NOT NULL) AS meaning, arg_max(sheet, line_no) FILTER (sheet IS NOT NULL) AS sheet FROM label_log WHERE id IS NOT NULL GROUP BY id)"


def _last_labels(spark: SparkSession, d: str) -> DataFrame:
    """The last form, meaning and sheet that were given to each id."""
    log = table(spark, d, "label_log").where("id is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return log.groupBy("id").agg(last("form"), last("meaning"), last("sheet"))


@query(f"""WITH {_LAST}, b AS (SELECT * FROM lw WHERE form IS NOT NULL AND meaning IS NOT NULL), s AS (SELECT k, count(*) FILTER (form >= k AND meaning >= k) AS tp, count(*) FILTER (form >= k AND meaning < k) AS fn, count(*) FILTER (form < k AND meaning >= k) AS fp, count(*) FILTER (form < k AND meaning < k) AS tn FROM b, (VALUES (1), (2), (3), (5)) v(k) GROUP BY k)
 SELECT CAST(k AS INT) AS k, tp, fn, fp, tn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) END AS f1 FROM s""")
def q24_agreement_sweep(spark: SparkSession, d: str) -> DataFrame:
    b = _last_labels(spark, d).where("form is not null and meaning is not null").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))))
    x, y = F.col("form") >= F.col("k"), F.col("meaning") >= F.col("k")
    s = b.groupBy("k").agg(F.count_if(x & y).alias("tp"), F.count_if(x & ~y).alias("fn"), F.count_if(~x & y).alias("fp"), F.count_if(~x & ~y).alias("tn"))
    share = lambda a, n: F.when(F.expr(n) > 0, F.round(F.expr(a) / F.expr(n), 9))
    return s.select("k", "tp", "fn", "fp", "tn", share("tp + tn", "tp + tn + fp + fn").alias("accuracy"), share("tp", "tp + fp").alias("precision"), share("tp", "tp + fn").alias("recall"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query(f"WITH {_LAST} SELECT upper(sheet) AS sheet, count(*) AS n, round(corr(form, meaning), 9) AS pearson, round(avg(abs(form - meaning)), 9) AS mad, round(avg(CASE WHEN form = meaning THEN 1 ELSE 0 END), 9) AS exact, round(avg(CASE WHEN abs(form - meaning) <= 1 THEN 1 ELSE 0 END), 9) AS within_1 FROM lw WHERE form IS NOT NULL AND meaning IS NOT NULL GROUP BY upper(sheet)")
def q25_label_correlation(spark: SparkSession, d: str) -> DataFrame:
    b = _last_labels(spark, d).where("form is not null and meaning is not null")
    far = F.abs(F.col("form") - F.col("meaning"))
    r = lambda x, n: F.round(x, 9).alias(n)
    return b.groupBy(F.upper("sheet").alias("sheet")).agg(F.count(F.lit(1)).alias("n"), r(F.corr("form", "meaning"), "pearson"), r(F.avg(far), "mad"), r(F.avg((far == 0).cast("int")), "exact"), r(F.avg((far <= 1).cast("int")), "within_1"))


@query("""WITH f AS (SELECT id, list_distinct(list(form)) AS forms, count(*) AS n, stddev_pop(form) AS sd, count(DISTINCT form) AS n_forms FROM label_log WHERE form IS NOT NULL AND id IS NOT NULL GROUP BY id HAVING count(*) > 1)
 SELECT n, count(*) AS n_ids, round(avg(sd), 9) AS mean_sd, count(*) FILTER (n_forms = 1) AS n_stable FROM f GROUP BY n""")
def q26_relabelling_stability(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "label_log").where("form is not null and id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("form").alias("sd"), F.countDistinct("form").alias("n_forms")).where("n > 1")
    return f.groupBy("n").agg(F.count(F.lit(1)).alias("n_ids"), F.round(F.avg("sd"), 9).alias("mean_sd"), F.count_if(F.col("n_forms") == 1).alias("n_stable"))


@query(f"""WITH {_P}, l AS (SELECT item_id, model, arg_max(words, row_id) AS ws FROM p GROUP BY ALL), s AS (SELECT item_id, model, list_distinct([lower(trim(v, ' ')) for v in ws]) AS ws FROM l), j AS (SELECT a.item_id, len(list_intersect(a.ws, b.ws)) AS n_both, len(list_distinct(list_concat(a.ws, b.ws))) AS n_any FROM s a JOIN s b USING (item_id) WHERE a.model = 'talkie-base' AND b.model = 'talkie-web')
 SELECT item_id, CAST(n_both AS INT) AS n_both, CAST(n_any AS INT) AS n_any, CASE WHEN n_any > 0 THEN round(n_both / n_any, 9) ELSE 1.0 END AS jaccard FROM j""")
def q27_list_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = predictions.predictions(spark, d).groupBy("item_id", "model").agg(F.array_distinct(F.transform(F.max_by("words", "row_id"), norm)).alias("ws"))
    a, b = s.where("model = 'talkie-base'").select("item_id", F.col("ws").alias("x")), s.where("model = 'talkie-web'").select("item_id", F.col("ws").alias("y"))
    j = a.join(b, "item_id").select("item_id", F.size(F.array_intersect("x", "y")).alias("n_both"), F.size(F.array_union("x", "y")).alias("n_any"))
    return j.withColumn("jaccard", F.when(F.col("n_any") > 0, F.round(F.col("n_both") / F.col("n_any"), 9)).otherwise(1.0))


# ---------------------------------------------------------------- samples

_DRAW = "md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


@query(f"SELECT key_no, route, domain FROM (SELECT *, row_number() OVER (PARTITION BY route, domain ORDER BY {_DRAW.format(seed=20260806, key='key_no')}) AS rn FROM neighborhood_key) WHERE rn <= 9")
def q28_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "neighborhood_key").select("key_no", "route", "domain"), ["route", "domain"], "key_no", 9)


@query("""WITH w AS (SELECT route, domain, count(*) AS need FROM neighborhood_key WHERE is_future = 1 GROUP BY ALL), h AS (SELECT route, domain, count(*) AS have FROM neighborhood_key WHERE is_future = 0 GROUP BY ALL)
 SELECT w.route, w.domain, need, coalesce(have, 0) AS have, greatest(need - coalesce(have, 0), 0) AS short FROM w LEFT JOIN h USING (route, domain)""")
def q29_matched_shortfall(spark: SparkSession, d: str) -> DataFrame:
    key = table(spark, d, "neighborhood_key").select("key_no", "route", "domain", "is_future")
    return sampling.matched(key.where("is_future = 0"), key.where("is_future = 1"), ["route", "domain"], "key_no")[1]


@query(f"""WITH w AS (SELECT route, domain, count(*) AS need FROM neighborhood_key WHERE is_future = 1 GROUP BY ALL)
 SELECT key_no, route, domain FROM (SELECT k.*, need, row_number() OVER (PARTITION BY route, domain ORDER BY {_DRAW.format(seed=20260812, key='key_no')}) AS rn FROM neighborhood_key k JOIN w USING (route, domain) WHERE is_future = 0) WHERE rn <= need""")
def q30_matched_draw(spark: SparkSession, d: str) -> DataFrame:
    key = table(spark, d, "neighborhood_key").select("key_no", "route", "domain", "is_future")
    return sampling.matched(key.where("is_future = 0"), key.where("is_future = 1"), ["route", "domain"], "key_no")[0].select("key_no", "route", "domain")


@query("""WITH s AS (SELECT coalesce(theme, 'none') AS theme, count(*) AS n FROM label_log GROUP BY ALL), x AS (SELECT *, 1000 * n / sum(n) OVER () AS e FROM s)
 SELECT theme, CAST(floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, theme) <= 1000 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM x""")
def q31_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    shares = table(spark, d, "label_log").groupBy(F.coalesce("theme", F.lit("none")).alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(shares, "theme", "n", 1000)


@query(f"SELECT failure_id, source, CAST(turn AS INT) AS turn FROM (SELECT failure_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format(seed=20260811, key='failure_id')}) AS turn FROM judge_failures) ORDER BY turn, source LIMIT 80")
def q32_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "judge_failures").select("failure_id", "source"), "source", "failure_id", 80)


@query(rf"""WITH {_P}, o AS (SELECT target, prefix, {_DRAW.format(seed=20260808, key='row_id')} AS draw FROM p), n AS (SELECT target, prefix, coalesce(lead(prefix) OVER (ORDER BY draw), first_value(prefix) OVER (ORDER BY draw)) AS other FROM o),
 t AS (SELECT target, [left(lower(w), 4) for w in regexp_extract_all(coalesce(prefix, ''), '[A-Za-z]+')] AS a, [left(lower(w), 4) for w in regexp_extract_all(coalesce(other, ''), '[A-Za-z]+')] AS b FROM n WHERE target <> '')
 SELECT count(*) AS n, round(avg(CASE WHEN list_contains(a, left(target, 4)) THEN 1 ELSE 0 END), 9) AS real, round(avg(CASE WHEN list_contains(b, left(target, 4)) THEN 1 ELSE 0 END), 9) AS null_share FROM t""")
def q33_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of targets with their own prompts, and with those of other items: the null."""
    x = sampling.permuted_pairs(_prompts(spark, d).drop("words"), "row_id", "prefix")
    share = lambda c: F.round(F.avg(F.coalesce(F.arrays_overlap(F.transform(letter_tokens(F.col(c)), lambda w: F.left(w, F.lit(4))), F.array(F.left("target", F.lit(4)))), F.lit(False)).cast("int")), 9)
    return x.where("target <> ''").agg(F.count(F.lit(1)).alias("n"), share("prefix").alias("real"), share("other").alias("null_share"))


# ---------------------------------------------------------------- records


@query("SELECT id, arg_max(line_no, line_no) AS line_no, arg_max(form, line_no) FILTER (TRUE) AS form, theme, notes FROM (SELECT * FROM label_log WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY line_no DESC) = 1) GROUP BY id, theme, notes")
def q34_last_label(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "label_log").select("line_no", "id", "form", "theme", "notes")
    return records.last_wins(log, "id", "line_no").select("id", "line_no", "form", "theme", "notes")


@query("""WITH b AS (SELECT id, max(line_no) AS line_no FROM label_log WHERE id IS NOT NULL AND upper(sheet) = 'A' GROUP BY id), c AS (SELECT id, max(line_no) AS line_no FROM label_log WHERE id IS NOT NULL AND sheet = 'B' GROUP BY id)
 SELECT id, line_no FROM c UNION ALL SELECT id, line_no FROM b WHERE id NOT IN (SELECT id FROM c)""")
def q35_upsert(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "label_log").select("line_no", "id", F.upper("sheet").alias("sheet"))
    part = lambda s: records.last_wins(log.where(F.col("sheet") == s).select("id", "line_no"), "id", "line_no")
    return records.upsert(part("A"), part("B"), "id")


@query("WITH f AS (SELECT target_word, model, min(row_id) AS row_id FROM postcutoff_words WHERE target_word IS NOT NULL GROUP BY ALL) SELECT row_id, CAST(row_number() OVER (PARTITION BY lower(trim(target_word, ' ')) ORDER BY row_id) - 1 AS INT) AS batch FROM f")
def q36_batches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct spellings of targets per model, so that no target repeats inside a batch."""
    first = table(spark, d, "postcutoff_words").where("target_word is not null").groupBy("target_word", "model").agg(F.min("row_id").alias("row_id"))
    return records.once_per_batch(first, norm(F.col("target_word")), "row_id").select("row_id", "batch")


@query("SELECT failure_id, CAST(floor(coalesce(sum(coalesce(length(raw), 0)) OVER (ORDER BY failure_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 50000) AS INT) AS shard FROM judge_failures")
def q37_shards(spark: SparkSession, d: str) -> DataFrame:
    return records.shards(table(spark, d, "judge_failures").select("failure_id", "raw"), F.length("raw"), "failure_id", 50_000).select("failure_id", "shard")


@query(r"""WITH s AS (SELECT source, raw, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') AS t FROM judge_failures)
 SELECT source, CASE WHEN raw IS NULL OR t = '' THEN 'no text' WHEN NOT regexp_full_match(t, '\{.*\}', 's') THEN 'not an object' """ + " ".join(f"WHEN NOT contains(t, '\"{f}\"') THEN 'missing {f}'" for f in records.REQUIRED) + " ELSE 'ok' END AS status, count(*) AS n FROM s GROUP BY ALL")
def q38_answer_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "judge_failures").groupBy("source", records.answer_status(F.col("raw")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P}, w AS (SELECT DISTINCT target, model, lower(trim(u, ' ')) AS word FROM (SELECT target, model, unnest(words) AS u FROM p) WHERE target <> ''), b AS (SELECT target, word FROM w WHERE model = 'talkie-base'), e AS (SELECT target, word FROM w WHERE model = 'talkie-web'), t AS (SELECT target, word FROM w WHERE model = 'typewriter')
 SELECT 'base - web' AS sets, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM e) UNION ALL SELECT 'web - base', count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM b) UNION ALL SELECT 'base & web', count(*) FROM (SELECT * FROM b INTERSECT SELECT * FROM e) UNION ALL SELECT 'typewriter - base - web', count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM b EXCEPT SELECT * FROM e)""")
def q39_set_readings(spark: SparkSession, d: str) -> DataFrame:
    """Set differences of (target, word) over models: one aggregation by pair instead of a join for each difference."""
    w = predictions.predictions(spark, d).select("model", norm(F.col("target_word")).alias("target"), F.explode_outer("words").alias("u")).where("target <> '' and u is not null")
    has = lambda m: F.max((F.col("model") == m).cast("int")) == 1
    x = w.groupBy("target", norm(F.col("u")).alias("word")).agg(has("talkie-base").alias("b"), has("talkie-web").alias("e"), has("typewriter").alias("t"))
    b, e, t = F.col("b"), F.col("e"), F.col("t")
    sets = {"base - web": b & ~e, "web - base": e & ~b, "base & web": b & e, "typewriter - base - web": t & ~b & ~e}
    g = x.agg(*(F.count_if(c).alias(n) for n, c in sets.items()))
    return g.select(F.explode(F.array(*(F.struct(F.lit(n).alias("sets"), F.col(f"`{n}`").alias("n")) for n in sets))).alias("s")).select("s.*")


@query(f"""WITH {_LAST}, k AS (SELECT id, min(key_no) AS key_no, arg_min(model, key_no) AS model, arg_min(route, key_no) AS route, arg_min(rank, key_no) AS rank FROM neighborhood_key WHERE id IS NOT NULL GROUP BY id), f AS (SELECT nbr_id AS id, count(*) AS n_failures FROM judge_failures GROUP BY ALL)
 SELECT k.id, k.key_no, coalesce(m.family, 'unknown') AS family, k.route, k.rank, lw.form, lw.meaning, coalesce(n_failures, 0) AS n_failures, CAST(CASE WHEN lw.form >= 2 AND k.rank BETWEEN 1 AND 100 THEN 1 ELSE 0 END AS INT) AS formed_hit FROM k LEFT JOIN models m ON {sql.plain_key("m.model")} = {sql.plain_key("k.model")} LEFT JOIN lw ON lw.id = k.id LEFT JOIN f ON f.id = k.id""")
def q40_verification_mart(spark: SparkSession, d: str) -> DataFrame:
    """One row per neighborhood: its first key row, its model's family, its last labels and its failed answers."""
    first = lambda c: F.min_by(c, "key_no").alias(c)
    k = table(spark, d, "neighborhood_key").where("id is not null").groupBy("id").agg(F.min("key_no").alias("key_no"), first("model"), first("route"), first("rank"))
    f = table(spark, d, "judge_failures").groupBy(F.col("nbr_id").alias("id")).agg(F.count(F.lit(1)).alias("n_failures"))
    families = table(spark, d, "models").select(plain_key(F.col("model")).alias("model_key"), "family")
    x = k.withColumn("model_key", plain_key(F.col("model"))).join(families, "model_key", "left").join(_last_labels(spark, d), "id", "left").join(f, "id", "left")
    formed = F.coalesce((F.col("form") >= 2) & F.col("rank").between(1, 100), F.lit(False)).cast("int")
    return x.select("id", "key_no", F.coalesce("family", F.lit("unknown")).alias("family"), "route", "rank", "form", "meaning", F.coalesce("n_failures", F.lit(0).cast("long")).alias("n_failures"), formed.alias("formed_hit"))


# ---------------------------------------------------------------- perturbation


@query(rf"""WITH {_DONORS}, x AS (SELECT sa.row_id, sa.stems[1] AS donor, p.prefix FROM sa JOIN p USING (row_id) WHERE len(stems) > 0), e AS (SELECT *, array_to_string([c for c in regexp_split_to_array(prefix, '[,;]\s*') if NOT contains(lower(c), lower(donor))], ', ') AS after FROM x)
 SELECT row_id, donor, CAST(length(after) AS INT) AS n_after, CASE WHEN contains(lower(after), lower(donor)) THEN 'donor_survives' WHEN regexp_matches(after, '[,;:][A-Za-z]') THEN 'punctuation_artifact' WHEN after = '' THEN 'empty' WHEN length(after) < 40 OR length(after) < 0.6 * length(prefix) THEN 'too_much_removed' ELSE 'ok' END AS status FROM e""")
def q41_verified_deletions(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d)
    x = scaffold.donors(p).where("stem_donors <> ''").select("row_id", F.substring_index("stem_donors", "|", 1).alias("donor")).join(p.select("row_id", "prefix"), "row_id")
    x = x.withColumn("after", perturbation.without_clauses(F.col("prefix"), F.col("donor")))
    return x.select("row_id", "donor", F.length("after").alias("n_after"), perturbation.deletion_status(F.col("prefix"), F.col("after"), F.col("donor")).alias("status"))


_NEAREST = """lc AS (SELECT word, length(word) AS len, CAST(round(log10(n_docs + 1) * 100) AS INT) AS step, left(word, 3) AS head FROM lex),
 tg AS (SELECT DISTINCT lc.* FROM lc JOIN wanted ON wanted.word = lc.word), nf AS (SELECT word, substitute, CAST(gap AS INT) AS gap FROM (SELECT tg.word, lc.word AS substitute, abs(lc.step - tg.step) AS gap, row_number() OVER (PARTITION BY tg.word ORDER BY abs(lc.step - tg.step), lc.word) AS rn FROM tg JOIN lc ON tg.len = lc.len AND tg.head <> lc.head AND abs(lc.step - tg.step) <= 150) WHERE rn = 1)"""
_CAPITAL = "upper(left({0}, 1)) || substring({0}, 2)"


@query(rf"""WITH {_DONORS}, {_LEX}, x AS (SELECT sa.row_id, sa.stems[1] AS word, p.prefix FROM sa JOIN p USING (row_id) WHERE len(stems) > 0), wanted AS (SELECT DISTINCT word FROM x), {_NEAREST}
 SELECT row_id, word, substitute, regexp_replace(regexp_replace(prefix, '\b' || {_CAPITAL.format("word")} || '\b', {_CAPITAL.format("substitute")}, 'g'), '\b' || word || '\b', substitute, 'g') AS edited FROM x JOIN nf USING (word)""")
def q42_substitutions(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their first stem donor replaced by the word nearest to it in corpus frequency."""
    p = _prompts(spark, d)
    x = scaffold.donors(p).where("stem_donors <> ''").select("row_id", F.substring_index("stem_donors", "|", 1).alias("word")).join(p.select("row_id", "prefix"), "row_id")
    counts = _lexicon(spark, d).select("word", F.col("n_docs").alias("n"))
    near = perturbation.nearest_by_frequency(x.select("word").distinct(), counts)
    return x.join(near, "word").select("row_id", "word", "substitute", perturbation.substituted(F.col("prefix"), F.col("word"), F.col("substitute")).alias("edited"))


# ---------------------------------------------------------------- decoding

_BIGRAMS = """bt AS (SELECT doc_id, [lower(w) for w in regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')] AS t FROM documents), bp AS (SELECT unnest(t[:-2]) AS word, unnest(t[2:]) AS next FROM bt WHERE len(t) > 1), bg AS (SELECT word, next, count(*) AS n FROM bp GROUP BY ALL)"""


@query(f"WITH {_BIGRAMS} SELECT word, next, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, next) AS rank FROM bg) WHERE rank <= 10")
def q43_bigram_top_next(spark: SparkSession, d: str) -> DataFrame:
    return decoding.top_next(decoding.word_pairs(table(spark, d, "documents"), "text"), 10)


@query(f"""WITH {_P}, {_BIGRAMS}, rk AS (SELECT word, next, row_number() OVER (PARTITION BY word ORDER BY n DESC, next) AS r FROM bg), it AS (SELECT row_id, model, is_future, target, list_extract([lower(w) for w in regexp_extract_all(coalesce(prefix, ''), '[A-Za-z]+')], -1) AS word FROM p WHERE target <> '')
 SELECT model, is_future, count(*) AS n, count(*) FILTER (r <= 100) AS recalled, round(count(*) FILTER (r <= 100) / count(*), 9) AS recall FROM it LEFT JOIN rk ON rk.word = it.word AND rk.next = it.target GROUP BY ALL""")
def q44_bigram_cloze(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the targets among the 100 words that follow the prompt's last word most often in the corpus."""
    ranked = decoding.top_next(decoding.word_pairs(table(spark, d, "documents"), "text"), 100).select("word", F.col("next").alias("target"), F.lit(1).alias("got"))
    items = predictions.predictions(spark, d).select("model", "is_future", norm(F.col("target_word")).alias("target"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), letter_tokens(prefix_before(F.col("text"), F.col("target_word")))), -1).alias("word")).where("target <> ''")
    g = items.join(ranked, ["word", "target"], "left").groupBy("model", "is_future").agg(F.count(F.lit(1)).alias("n"), F.count("got").alias("recalled"))
    return g.withColumn("recall", F.round(F.col("recalled") / F.col("n"), 9))


@query(f"""WITH {_NAMED}, x AS (SELECT model, route, count(*) AS n, sum({_HIT}) AS k FROM nk GROUP BY ALL)
 SELECT model, round(sum(CASE WHEN k > 0 AND k < n THEN (1 - k / n) / (n * k / n) ELSE 'infinity'::DOUBLE END), 9) AS variance, round(sum(CASE WHEN k > 0 AND k < n THEN (1 - k / n) / (sum_n / 3 * k / n) ELSE 'infinity'::DOUBLE END), 9) AS variance_even FROM (SELECT *, sum(n) OVER (PARTITION BY model) AS sum_n FROM x) GROUP BY model""")
def q45_allocation_variance(spark: SparkSession, d: str) -> DataFrame:
    """Delta-method variance of the log rates of three routes, for the sample as it is and for one of equal parts."""
    from pyspark.sql import Window

    x = _decoded(spark, d).groupBy("model", "route").agg(F.count(F.lit(1)).alias("n"), F.sum(predictions.hit(F.col("rank"), 100)).alias("k"))
    x = x.withColumn("even", F.sum("n").over(Window.partitionBy("model")) / 3).withColumn("p", F.col("k") / F.col("n"))
    var = lambda n: F.sum(F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), (1 - F.col("p")) / (F.col(n) * F.col("p"))).otherwise(F.lit(float("inf"))))
    return x.groupBy("model").agg(F.round(var("n"), 9).alias("variance"), F.round(var("even"), 9).alias("variance_even"))


# ---------------------------------------------------------------- further readings

# Endings that mark a Latinate word, and those that mark a technical one.
_LATINATE = "(tion|sion|ment|ity|ance|ence|ism|ist|ology|osis|itis|oma|ate|ic|ive|ous|al)$"
_TECHNICAL = (
    "ase", "ergic", "tron", "itis", "osis", "oma", "ose", "yl", "ide", "ine", "gen", "cyte", "blast", "plasm", "phyll", "lyte", "mer", "ium", "meter", "scope", "graph", "phore", "stat", "tomy", "ectomy",
    "pathy", "emia", "uria", "oid", "logy", "lysis", "phyte", "sperm", "therm", "valent", "metry", "genic", "ferous", "hydrate", "acid",
)


@query(f"""WITH {_CUES}, r AS (SELECT model, is_future, avg(outcome::INT) FILTER (cue) AS with_cue, avg(outcome::INT) FILTER (NOT cue) AS without, count(*) AS n FROM cu GROUP BY ALL)
 SELECT p.model, p.n AS n_post, q.n AS n_past, round(p.with_cue - p.without, 9) AS post_gap, round(q.with_cue - q.without, 9) AS past_gap, round((p.with_cue - p.without) - (q.with_cue - q.without), 9) AS difference, CASE WHEN q.with_cue > 0 THEN round(p.with_cue / q.with_cue, 9) END AS lift FROM r p JOIN r q USING (model) WHERE p.is_future = 1 AND q.is_future = 0""")
def q46_difference_in_differences(spark: SparkSession, d: str) -> DataFrame:
    """How much more a cue in the prompt helps beyond the cutoff than before it."""
    rate = lambda c: F.avg(F.when(c, F.col("outcome").cast("int")))
    r = _cues(spark, d).groupBy("model", "is_future").agg(rate(F.col("cue")).alias("w"), rate(~F.col("cue")).alias("o"), F.count(F.lit(1)).alias("n"))
    side = lambda v, x: r.where(F.col("is_future") == v).select("model", *(F.col(c).alias(f"{x}{c}") for c in ("w", "o", "n")))
    x = side(1, "p").join(side(0, "q"), "model")
    post, past = F.col("pw") - F.col("po"), F.col("qw") - F.col("qo")
    return x.select("model", F.col("pn").alias("n_post"), F.col("qn").alias("n_past"), F.round(post, 9).alias("post_gap"), F.round(past, 9).alias("past_gap"), F.round(post - past, 9).alias("difference"), F.when(F.col("qw") > 0, F.round(F.col("pw") / F.col("qw"), 9)).alias("lift"))


@query(f"WITH {_P} SELECT model, CAST(is_future AS INT) AS is_future, count(*) AS n, round(avg(CASE WHEN regexp_matches(target, '{_LATINATE}') THEN 1 ELSE 0 END), 9) AS latinate FROM p WHERE target <> '' GROUP BY ALL")
def q47_latinate_share(spark: SparkSession, d: str) -> DataFrame:
    x = predictions.predictions(spark, d).withColumn("target", norm(F.col("target_word"))).where("target <> ''")
    return x.groupBy("model", "is_future").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("target").rlike(_LATINATE).cast("int")), 9).alias("latinate"))


@query(f"WITH {_P} SELECT target AS word, min(entry_year) AS first_year, count(DISTINCT model) AS n_models, count(*) AS n FROM p WHERE target <> '' GROUP BY target")
def q48_dated_lexicon(spark: SparkSession, d: str) -> DataFrame:
    x = predictions.predictions(spark, d).withColumn("word", norm(F.col("target_word"))).where("word <> ''")
    return x.groupBy("word").agg(F.min("entry_year").alias("first_year"), F.countDistinct("model").alias("n_models"), F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, count(*) AS n_rows, min(rank) FILTER (rank > 0) AS best_rank FROM postcutoff_words WHERE model IN (SELECT model FROM models) GROUP BY item_id HAVING count(DISTINCT model) = 3")
def q49_items_of_all_models(spark: SparkSession, d: str) -> DataFrame:
    """The pool of items that all three decoded models share."""
    g = predictions.predictions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best_rank"), F.countDistinct("model").alias("n"))
    return g.where("n = 3").drop("n")


@query(f"""WITH {_P}, {_LEX}, tw AS (SELECT model, target, rank, coalesce(regexp_extract(target, '.*?({"|".join(sorted(_TECHNICAL, key=len, reverse=True))})$', 1), '') AS ending FROM p WHERE length(target) >= 7 AND regexp_full_match(target, '\\p{{L}}+'))
 SELECT model, ending, count(*) AS n, count(*) FILTER (coalesce(n_docs, 0) <= 3) AS n_technical, round(avg({_HIT}) FILTER (coalesce(n_docs, 0) <= 3), 9) AS technical_recall FROM tw LEFT JOIN lex ON lex.word = tw.target WHERE ending <> '' GROUP BY ALL""")
def q50_technical_words(spark: SparkSession, d: str) -> DataFrame:
    """Long targets with a learned ending that few documents know, and how often they are recalled."""
    x = predictions.predictions(spark, d).select("model", norm(F.col("target_word")).alias("word"), "rank").where(F.col("word").rlike(r"^\p{L}{7,}$")).withColumn("ending", neighborhood.longest_of(F.col("word"), _TECHNICAL)).where("ending <> ''")
    rare = F.coalesce("n_docs", F.lit(0)) <= 3
    g = x.join(_lexicon(spark, d), "word", "left").groupBy("model", "ending")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(rare).alias("n_technical"), F.round(F.avg(F.when(rare, predictions.hit(F.col("rank"), 100))), 9).alias("technical_recall"))


@query(f"""WITH {_P}, l AS (SELECT item_id, model, arg_max(words, row_id) AS ws, arg_max(target, row_id) AS t FROM p GROUP BY ALL),
 s AS (SELECT item_id, model, [w for w in list_distinct([lower(trim(v, ' ')) for v in ws]) if w <> t AND length(t) >= 5 AND left(w, 5) = left(t, 5)] AS g FROM l),
 j AS (SELECT a.item_id, len(a.g) AS na, len(b.g) AS nb, len(list_intersect(a.g, b.g)) AS nc FROM s a JOIN s b USING (item_id) WHERE a.model = 'talkie-base' AND b.model = 'talkie-web'),
 k AS (SELECT item_id, na * (na - 1) / 2 AS pa, nb * (nb - 1) / 2 AS pb, nc * (nc - 1) / 2 AS pc FROM j)
 SELECT item_id, CASE WHEN pa = 0 AND pb = 0 THEN 1.0 WHEN pa = 0 OR pb = 0 THEN 0.0 ELSE round(pc / pa, 9) END AS precision, CASE WHEN pa = 0 AND pb = 0 THEN 1.0 WHEN pa = 0 OR pb = 0 THEN 0.0 ELSE round(pc / pb, 9) END AS recall FROM k""")
def q51_pair_membership(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two models on which words belong together, by pairs: words that start like the target."""
    x = predictions.predictions(spark, d).withColumn("t", norm(F.col("target_word"))).groupBy("item_id", "model").agg(F.max_by("words", "row_id").alias("words"), F.max_by("t", "row_id").alias("t"))
    group = F.filter(F.array_distinct(F.transform("words", norm)), lambda w: (w != F.col("t")) & (F.length("t") >= 5) & (F.left(w, F.lit(5)) == F.left("t", F.lit(5))))
    x = x.withColumn("g", group)
    a, b = x.where("model = 'talkie-base'").select("item_id", F.col("g").alias("a")), x.where("model = 'talkie-web'").select("item_id", F.col("g").alias("b"))
    pairs = lambda n: n * (n - 1) / 2
    j = a.join(b, "item_id").select("item_id", pairs(F.size("a")).alias("pa"), pairs(F.size("b")).alias("pb"), pairs(F.size(F.array_intersect("a", "b"))).alias("pc"))
    share = lambda n: F.when((F.col("pa") == 0) & (F.col("pb") == 0), 1.0).when((F.col("pa") == 0) | (F.col("pb") == 0), 0.0).otherwise(F.round(F.col("pc") / F.col(n), 9))
    return j.select("item_id", share("pa").alias("precision"), share("pb").alias("recall"))


@query("""WITH x AS (SELECT TRY_CAST(left(labelled_at, 10) AS DATE) AS day, upper(sheet) AS sheet, form FROM label_log) SELECT strftime(day, '%Y-%m-%d') AS day, sheet, count(*) AS n, count(form) AS n_labelled FROM x GROUP BY ALL""")
def q52_labels_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Labels a day and sheet, whichever of its formats the time is written in."""
    day = F.date_format(F.left("labelled_at", F.lit(10)).try_cast("date"), "yyyy-MM-dd")
    return table(spark, d, "label_log").groupBy(day.alias("day"), F.upper("sheet").alias("sheet")).agg(F.count(F.lit(1)).alias("n"), F.count("form").alias("n_labelled"))
