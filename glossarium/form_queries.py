"""Further registered queries of the core: shared blocks of letters, prompts, samples, screens and readings, each with
the same query for DuckDB beside it, where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.functions import stats
from glossarium.functions.text import letter_tokens, norm
from glossarium.operators import forms, neighborhood, perturbation, predictions, sampling
from glossarium.queries import _BINS, _DRAW, _GROUPS, _HIT, _LAST, _LABELLED, _LEX, _NEAREST, _P, _PAIRED, _PAIRS, _edits, _labelled, _last_labels, _lexicon, _prompts, query
from glossarium.sources.session import spread, table

# ---------------------------------------------------------------- shared blocks

_BLOCKS = r"""bw AS (SELECT DISTINCT failure_id AS id, w FROM (SELECT failure_id, lower(trim(unnest(words), ' ')) AS w FROM judge_failures) WHERE regexp_full_match(w, '\p{L}+')),
 bk AS (SELECT id, w, unnest(range(2, 8)) AS k FROM bw), bg AS (SELECT id, w, '^' || left(w, k) AS gram FROM bk WHERE length(w) > k UNION ALL SELECT id, w, right(w, k) || '$' FROM bk WHERE length(w) > k),
 cb AS (SELECT id, gram, count(*) AS k FROM bg GROUP BY ALL HAVING count(*) >= 2)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "judge_failures").select(F.col("failure_id").alias("id"), "words"))


@query(f"WITH {_BLOCKS} SELECT id, gram, CAST(k AS INT) AS n_carriers FROM cb")
def q53_carried_blocks(spark: SparkSession, d: str) -> DataFrame:
    return forms.carried_blocks(_lists(spark, d)).select("id", "gram", F.size("carriers").alias("n_carriers"))


_INFLECTS = "(x.w <> y.w AND (CASE WHEN length(x.w) <= length(y.w) THEN y.w ELSE x.w END) IN (" + ", ".join(f"(CASE WHEN length(x.w) <= length(y.w) THEN x.w ELSE y.w END) || '{e}'" for e in ("s", "es", "ed", "ing")) + ", " + ", ".join(f"CASE WHEN ends_with(CASE WHEN length(x.w) <= length(y.w) THEN x.w ELSE y.w END, 'e') THEN left(CASE WHEN length(x.w) <= length(y.w) THEN x.w ELSE y.w END, least(length(x.w), length(y.w)) - 1) || '{e}' ELSE '' END" for e in ("s", "es", "ed", "ing")) + "))"


@query(f"""WITH {_P}, ew AS (SELECT DISTINCT lower(trim(w, ' ')) AS w FROM (SELECT unnest(words) AS w FROM p) WHERE regexp_full_match(lower(trim(w, ' ')), '\\p{{L}}{{4,}}')), ek AS (SELECT w, unnest(range(2, 8)) AS k FROM ew),
 rt AS (SELECT gram, count(*) AS n_words FROM (SELECT '^' || left(w, k) AS gram FROM ek WHERE length(w) > k + 1 UNION ALL SELECT right(w, k) || '$' FROM ek WHERE length(w) > k + 1) GROUP BY gram), tn AS (SELECT count(*)::DOUBLE AS total FROM ew),
 {_BLOCKS}, lx AS (SELECT DISTINCT x.id, x.gram FROM bg x JOIN bg y ON x.id = y.id AND x.gram = y.gram AND x.w < y.w WHERE NOT {_INFLECTS}), ln AS (SELECT id, count(*) AS n FROM bw GROUP BY id),
 f AS (SELECT cb.id, cb.gram, cb.k, n, n_words / total AS r FROM cb JOIN lx USING (id, gram) JOIN ln USING (id) JOIN rt USING (gram), tn),
 s AS (SELECT id, gram, k, round(-log2(greatest(CASE WHEN r >= 1 THEN 1.0 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)) * pow(r, i) * pow(1 - r, n - i) for i in range(k, n + 1)]) END, 1e-300)), 6) AS bits FROM f)
 SELECT id, gram, CAST(k AS INT) AS n_carriers, round(bits, 4) AS surprisal FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC, bits DESC, gram) AS rn FROM s WHERE bits >= {forms.MIN_BITS}) WHERE rn = 1""")
def q54_form_blocks(spark: SparkSession, d: str) -> DataFrame:
    words = predictions.predictions(spark, d).select(F.explode_outer("words").alias("word")).where("word is not null")
    n = neighborhood.letter_words(words).count()
    rates = neighborhood.edge_ngrams(words, n=n).select("gram", "n_words")
    return forms.form_blocks(_lists(spark, d), rates, n).withColumn("surprisal", F.round("surprisal", 4))


@query(f"WITH {_PAIRS} SELECT CASE WHEN {_INFLECTS.replace('x.w', 'a').replace('y.w', 'b')} THEN 'INFLECTION' WHEN least(length(a), length(b)) - run < 2 THEN 'SINGLE_STEP' ELSE 'SHARED' END AS kind, count(*) AS n, count(DISTINCT id) AS n_lists FROM pr JOIN rn USING (a, b) GROUP BY kind")
def q55_pair_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = neighborhood.overlap_pairs(_lists(spark, d))
    return x.groupBy(forms.pair_kind(F.col("a"), F.col("b"), F.col("run")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_lists"))


def _longest_sql(parts: tuple[str, ...], test: str) -> str:
    return "CASE " + " ".join(f"WHEN {test}(w, '{p}') AND length(w) > {len(p) + 2} THEN '{p}'" for p in sorted(parts, key=len, reverse=True)) + " ELSE '' END"


@query(f"""WITH {_P}, sw AS (SELECT target AS w, count(*) AS n FROM p WHERE target <> '' GROUP BY target), se AS (SELECT w, n, {_longest_sql(forms.PREFIXES, "starts_with")} AS a, {_longest_sql(tuple(s for s in neighborhood.SUFFIXES if len(s) >= 3), "ends_with")} AS z FROM sw),
 sg AS (SELECT w, n, unnest(list_distinct(list_concat(CASE WHEN a <> '' THEN [a, substring(w, length(a) + 1)] ELSE [] END, CASE WHEN z <> '' THEN [z, left(w, length(w) - length(z))] ELSE [] END))) AS segment FROM se)
 SELECT segment, count(*) AS n_targets, CAST(sum(n) AS BIGINT) AS n_rows FROM sg GROUP BY segment""")
def q56_segments(spark: SparkSession, d: str) -> DataFrame:
    """In how many distinct targets, and rows, each part of a word occurs."""
    w = predictions.predictions(spark, d).groupBy(norm(F.col("target_word")).alias("w")).agg(F.count(F.lit(1)).alias("n")).where("w <> ''")
    return w.select("n", F.explode_outer(forms.segments(F.col("w"))).alias("segment")).where("segment is not null").groupBy("segment").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("n").alias("n_rows"))


@query(f"WITH RECURSIVE {_GROUPS.split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT failure_id AS id', 1)[0].strip()}, {_LEX}, mw AS (SELECT id, form_n, unnest(string_split(members, '|')) AS word FROM g), mc AS (SELECT id, form_n, count(*) FILTER (coalesce(n_docs, 0) < 3) AS n_new FROM mw LEFT JOIN lex USING (word) GROUP BY ALL) SELECT CAST(form_n AS INT) AS form_n, count(*) AS n, count(*) FILTER (n_new > 0) AS n_certified, CAST(sum(n_new) AS BIGINT) AS n_new_words FROM mc GROUP BY form_n")
def q57_certified_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one form with a member that hardly any document knows, by the size of the group."""
    g = neighborhood.form_groups(_lists(spark, d))
    # an outer explode: Spark copies the whole group expression into the filter it derives from an inner one
    m = g.select("id", "form_n", F.explode_outer(F.split("members", r"\|")).alias("word")).where("word <> ''").join(_lexicon(spark, d), "word", "left")
    c = m.groupBy("id", "form_n").agg(F.count_if(F.coalesce("n_docs", F.lit(0)) < 3).alias("n_new"))
    return c.groupBy("form_n").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_new") > 0).alias("n_certified"), F.sum("n_new").alias("n_new_words"))


@query(f"""WITH {_LABELLED}, b AS (SELECT CASE WHEN length(target) < 7 THEN '<7' WHEN length(target) <= 8 THEN '7-8' WHEN length(target) <= 10 THEN '9-10' WHEN length(target) <= 12 THEN '11-12' ELSE '13+' END AS band, label, novelty FROM lab)
 SELECT band, count(*) AS n, count(*) FILTER (label = 'STEM') AS n_stem, count(*) FILTER (label = 'AFFIX') AS n_affix, count(*) FILTER (novelty = 'coined') AS n_coined, round(count(*) FILTER (novelty = 'coined') / count(*), 9) AS coined_share FROM b GROUP BY band""")
def q58_length_bands(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    g = _labelled(spark, d).groupBy(forms.length_band(F.col("target")).alias("band"))
    g = g.agg(F.count(F.lit(1)).alias("n"), is_("label", "STEM").alias("n_stem"), is_("label", "AFFIX").alias("n_affix"), is_("novelty", "coined").alias("n_coined"))
    return g.withColumn("coined_share", F.round(F.col("n_coined") / F.col("n"), 9))


# ---------------------------------------------------------------- prompts


@query(rf"""WITH {_P}, x AS (SELECT row_id, model, is_future, target, [lower(w) for w in regexp_extract_all(coalesce(prefix, ''), '[A-Za-z]+')] AS tokens FROM p WHERE target <> ''),
 y AS (SELECT model, is_future, list_bool_or([w <> target AND length(w) >= 4 AND (length(target) > 3 AND ends_with(w, right(target, 3)) OR list_bool_or([contains(w, substring(target, CAST(i AS INT), 4)) for i in range(1, length(target) - 2)])) for w in tokens]) AS hit FROM x)
 SELECT model, CAST(is_future AS INT) AS is_future, count(*) AS n, count(*) FILTER (hit) AS n_selected FROM y GROUP BY ALL""")
def q59_prompts_like_targets(spark: SparkSession, d: str) -> DataFrame:
    """How many prompts have a word that resembles the target: the first sieve before any closer look."""
    rows = predictions.predictions(spark, d).select("row_id", "model", "is_future")
    x = _prompts(spark, d).where("target <> ''").select("row_id", forms.prompt_like(F.col("target"), letter_tokens(F.col("prefix"))).alias("like"))
    return x.join(rows, "row_id").groupBy("model", "is_future").agg(F.count(F.lit(1)).alias("n"), F.count_if("like").alias("n_selected"))


@query(f"""WITH {_P}, c AS (SELECT md5(prefix) AS h, count(DISTINCT target) AS n_targets, count(*) AS n_rows FROM p WHERE prefix <> '' AND target <> '' GROUP BY h)
 SELECT n_targets, count(*) AS n_prompts, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(CASE WHEN n_targets = 1 THEN 1 ELSE 0 END AS INT) AS cued FROM c GROUP BY n_targets""")
def q60_cued_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts by the number of different targets asked for with them; those with one are cued.  Distinct targets of a
    prompt are found by two map-side aggregations, so a prompt of any size is spread."""
    x = _prompts(spark, d).where("prefix <> '' and target <> ''").groupBy(F.md5("prefix").alias("h"), "target").agg(F.count(F.lit(1)).alias("n"))
    c = x.groupBy("h").agg(F.count(F.lit(1)).alias("n_targets"), F.sum("n").alias("n"))
    return c.groupBy("n_targets").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_rows")).withColumn("cued", (F.col("n_targets") == 1).cast("int"))


_SCREEN = rf"""{_P}, {_LEX}, ca AS (SELECT DISTINCT target, lower(trim(w, ' ')) AS word FROM (SELECT target, unnest(words) AS w FROM p) WHERE target <> ''),
 cg AS (SELECT ca.target, ca.word, a.n_docs AS n, abs(log10(coalesce(a.n_docs, 0) + 1) - log10(coalesce(b.n_docs, 0) + 1)) AS gap FROM ca LEFT JOIN lex a ON a.word = ca.word LEFT JOIN lex b ON b.word = ca.target),
 cr AS (SELECT target, word, round(gap, 9) AS gap, CASE WHEN NOT regexp_full_match(word, '\p{{L}}+') THEN 'not_letters' WHEN target = word OR length(target) > 5 AND left(target, 5) = left(word, 5) THEN 'same_stem'
  WHEN length(target) >= 3 AND length(word) >= 3 AND list_has_any([substring(target, CAST(i AS INT), 3) for i in range(1, length(target) - 1)], [substring(word, CAST(i AS INT), 3) for i in range(1, length(word) - 1)]) THEN 'overlaps_target' WHEN n IS NULL THEN 'not_attested' WHEN round(gap, 9) > 1.5 THEN 'frequency_band' ELSE 'kept' END AS reason FROM cg)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    x = predictions.predictions(spark, d).select(norm(F.col("target_word")).alias("target"), F.explode_outer("words").alias("w")).where("target <> '' and w is not null")
    return perturbation.screened(x.select("target", norm(F.col("w")).alias("word")), _lexicon(spark, d).select("word", F.col("n_docs").alias("n")))


@query(f"WITH {_SCREEN} SELECT reason, count(*) AS n, count(DISTINCT target) AS n_targets FROM cr GROUP BY reason")
def q61_screen_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why predicted words can't stand in for their target, by the first reason."""
    return _judged(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("n_targets"))


@query(f"WITH {_SCREEN} SELECT target, word AS substitute, gap FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY gap, word) AS rn FROM cr WHERE reason = 'kept') WHERE rn = 1")
def q62_substitutes(spark: SparkSession, d: str) -> DataFrame:
    return perturbation.substitutes(_judged(spark, d))


@query(f"WITH {_P}, {_LEX}, wanted AS (SELECT DISTINCT target AS word FROM p WHERE target <> ''), {_NEAREST} SELECT word, substitute, gap FROM nf")
def q63_nearest_in_frequency(spark: SparkSession, d: str) -> DataFrame:
    """For each target that the documents know, the unlike word of its length nearest to it in frequency: a placebo."""
    words = predictions.predictions(spark, d).select(norm(F.col("target_word")).alias("word")).where("word <> ''").distinct()
    return perturbation.nearest_by_frequency(words, _lexicon(spark, d).select("word", F.col("n_docs").alias("n")))


# ---------------------------------------------------------------- samples


@query(f"SELECT failure_id, array_to_string([substring(m, 33) for m in list_sort([md5(concat_ws('|', '20260806', CAST(failure_id AS VARCHAR), w)) || w for w in words])], '|') AS words FROM judge_failures WHERE words IS NOT NULL")
def q64_shuffled_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "judge_failures").where("words is not null")
    return x.select("failure_id", F.array_join(sampling.shuffled(F.col("words"), F.col("failure_id")), "|").alias("words"))


@query(f"WITH k AS (SELECT item_id FROM postcutoff_words WHERE item_id IS NOT NULL GROUP BY item_id ORDER BY {_DRAW.format(seed=20260813, key='item_id')} LIMIT 200) SELECT row_id, model, item_id FROM postcutoff_words WHERE item_id IN (SELECT item_id FROM k)")
def q65_whole_items(spark: SparkSession, d: str) -> DataFrame:
    return sampling.whole_items(table(spark, d, "postcutoff_words").select("row_id", "model", "item_id"), "item_id", 200).select("row_id", "model", "item_id")


@query(f"""WITH f AS (SELECT lower(trim(target_word, ' ')) AS target, arg_min(route, key_no) AS route, min(key_no) AS key_no FROM neighborhood_key WHERE trim(target_word, ' ') <> '' GROUP BY target)
 SELECT key_no, route, CAST(turn AS INT) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {_DRAW.format(seed=20260811, key='key_no')}) AS turn FROM f) ORDER BY turn, route NULLS FIRST LIMIT 30""")
def q66_alternating_targets(spark: SparkSession, d: str) -> DataFrame:
    """Thirty targets, each once, taken in turn from the routes."""
    f = table(spark, d, "neighborhood_key").groupBy(norm(F.col("target_word")).alias("target")).agg(F.min_by("route", "key_no").alias("route"), F.min("key_no").alias("key_no")).where("target <> ''")
    return sampling.round_robin(f.select("key_no", "route"), "route", "key_no", 30).select("key_no", "route", "turn")


_NEEDS = "q AS (SELECT route, count(*) AS n FROM neighborhood_key WHERE is_future = 1 AND route IS NOT NULL GROUP BY route), qq AS (SELECT route, CAST(floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, route) <= 40 - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT *, 40 * n / sum(n) OVER () AS e FROM q))"


@query(f"""WITH {_NEEDS}, d AS (SELECT key_no, domain, k.route, quota, {_DRAW.format(seed=20260814, key='key_no')} AS draw FROM neighborhood_key k LEFT JOIN qq ON qq.route = k.route WHERE is_future = 0),
 r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY domain, route ORDER BY draw) > coalesce(quota, 0) THEN 1 ELSE 0 END AS filled FROM d)
 SELECT key_no, domain, route, CAST(filled AS INT) AS filled FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY filled, draw) AS place FROM r) WHERE place <= 40""")
def q67_backfilled_cells(spark: SparkSession, d: str) -> DataFrame:
    """Forty past rows of each domain, with the routes of the later ones as far as they last."""
    key = table(spark, d, "neighborhood_key")
    need = sampling.largest_remainder(key.where("is_future = 1 and route is not null").groupBy("route").agg(F.count(F.lit(1)).alias("n")), "route", "n", 40)
    return sampling.with_backfill(key.where("is_future = 0").select("key_no", "domain", "route"), ["domain"], "route", "key_no", need, 40)


# ---------------------------------------------------------------- readings


@query("""WITH a AS (SELECT id, count(*) AS n_a FROM label_log WHERE id IS NOT NULL AND upper(sheet) = 'A' GROUP BY id), b AS (SELECT id, count(*) AS n_b FROM label_log WHERE id IS NOT NULL AND upper(sheet) = 'B' GROUP BY id)
 SELECT coalesce(a.id, b.id) AS id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN n_a IS NULL THEN 'B only' WHEN n_b IS NULL THEN 'A only' ELSE 'both' END AS sheets FROM a FULL JOIN b ON a.id = b.id""")
def q68_sheet_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Which ids stand on both sheets of labels: a full outer join, taken as one aggregation."""
    on = lambda s: F.count_if(F.upper("sheet") == s)
    g = table(spark, d, "label_log").where("id is not null").groupBy("id").agg(on("A").alias("n_a"), on("B").alias("n_b")).where("n_a + n_b > 0")
    return g.withColumn("sheets", F.when(F.col("n_a") == 0, "B only").when(F.col("n_b") == 0, "A only").otherwise("both"))


@query(f"""WITH t AS (SELECT id, arg_max(theme, line_no) FILTER (theme IS NOT NULL) AS theme FROM label_log WHERE id IS NOT NULL GROUP BY id), x AS (SELECT coalesce(nullif(theme, ''), 'none') AS theme, {_HIT} AS hit FROM neighborhood_key k JOIN t USING (id))
 SELECT theme, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS rate FROM x GROUP BY theme HAVING count(*) >= 15""")
def q69_rates_by_theme(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates of the themes that raters named, for those with fifteen rows or more."""
    theme = table(spark, d, "label_log").where("id is not null").groupBy("id").agg(F.max_by("theme", F.when(F.col("theme").isNotNull(), F.col("line_no"))).alias("theme"))
    x = table(spark, d, "neighborhood_key").select("id", predictions.hit(F.col("rank"), 100).alias("hit")).join(theme, "id")
    g = x.groupBy(F.coalesce(F.nullif("theme", F.lit("")), F.lit("none")).alias("theme")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 9).alias("rate"))
    return g.where("n >= 15")


@query(f"WITH {_LAST} SELECT id, form, meaning, CAST(abs(form - meaning) AS INT) AS apart FROM lw WHERE form IS NOT NULL AND meaning IS NOT NULL ORDER BY apart DESC, id LIMIT 25")
def q70_widest_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """The 25 ids whose two ratings lie furthest apart."""
    x = _last_labels(spark, d).where("form is not null and meaning is not null")
    return x.select("id", "form", "meaning", F.abs(F.col("form") - F.col("meaning")).alias("apart")).orderBy(F.desc("apart"), "id").limit(25)


@query(_BINS + " SELECT model, year_bin, CASE WHEN year_bin + width <= cutoff_year THEN 'PRE' WHEN year_bin >= cutoff_year THEN 'POST' ELSE 'SPAN' END AS side, n FROM bins")
def q71_bin_sides(spark: SparkSession, d: str) -> DataFrame:
    """Whether each bin of years lies before the cutoff, after it, or spans it."""
    rows = predictions.predictions(spark, d)
    x = predictions.year_bins(rows, predictions.bin_plan(rows)).join(table(spark, d, "models").select("model", "cutoff_year"), "model")
    side = F.when(F.col("year_bin") + F.col("width") <= F.col("cutoff_year"), "PRE").when(F.col("year_bin") >= F.col("cutoff_year"), "POST").otherwise("SPAN")
    return x.select("model", "year_bin", side.alias("side"), "n")


_TAIL = "list_sum([exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * ln(mid) + (m - i) * ln(1 - mid)) for i in range({0}, {1})])"


@query(f"""WITH RECURSIVE {_PAIRED}, k AS (SELECT b, c, b + c AS m FROM bc), lo AS (SELECT b, m, 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS mid FROM k WHERE b > 0 UNION ALL
  SELECT b, m, step + 1, CASE WHEN up THEN low ELSE mid END, CASE WHEN up THEN mid ELSE high END, CASE WHEN up THEN (low + mid) / 2 ELSE (mid + high) / 2 END FROM (SELECT *, {_TAIL.format("b", "m + 1")} > 0.025 AS up FROM lo WHERE step < 50)),
 hi AS (SELECT b, m, 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0.5::DOUBLE AS mid FROM k WHERE c > 0 UNION ALL
  SELECT b, m, step + 1, CASE WHEN up THEN low ELSE mid END, CASE WHEN up THEN mid ELSE high END, CASE WHEN up THEN (low + mid) / 2 ELSE (mid + high) / 2 END FROM (SELECT *, {_TAIL.format("0", "b + 1")} < 0.025 AS up FROM hi WHERE step < 50))
 SELECT b, c, round(coalesce((SELECT mid / (1 - mid) FROM lo WHERE step = 50), 0.0), 6) AS low, round(coalesce((SELECT mid / (1 - mid) FROM hi WHERE step = 50), 'infinity'::DOUBLE), 6) AS high FROM k""")
def q72_paired_interval(spark: SparkSession, d: str) -> DataFrame:
    """The odds that one model alone finds an item against the other alone, with their exact interval."""
    got = lambda m: F.max(F.when(F.col("model") == m, predictions.hit(F.col("rank"), 100)))
    x = table(spark, d, "postcutoff_words").groupBy("item_id").agg(got("talkie-base").alias("x"), got("talkie-web").alias("y")).where("x is not null and y is not null")
    t = x.agg(F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("b"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("c"))
    bound = lambda up: F.round(stats.paired_odds_bound(F.col("b"), F.col("c"), up), 6)
    return t.select("b", "c", bound(False).alias("low"), bound(True).alias("high"))
