"""Further registered queries of the core: answers of the judge and their groups, readings by outcome, edit arms and
sheets, each with the same query for DuckDB beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossarium import sql
from glossarium.functions import stats
from glossarium.functions.spelling import named_parts, plain_key
from glossarium.functions.text import ENDINGS, common_run, inflected, inflection, letter_tokens, norm, prefix_before, run_place, run_text, shares_run
from glossarium.operators import decoding, judged, neighborhood, outcomes, perturbation, predictions, sampling, scaffold
from glossarium.operators.packed import with_slots
from glossarium.form_queries import _SCREEN, _judged
from glossarium.queries import _BIGRAMS, _CELLS, _CUES, _DONORS, _DRAW, _GROUPS, _HALDANE, _HEADWORDS, _HIT, _LABELLED, _LEX, _NAMED, _NEAREST, _P, _PAIRS, _RUN, _cells, _cues, _decoded, _edits, _labelled, _last_labels, _lexicon, query
from glossarium.sources.session import spread, table

# ---------------------------------------------------------------- answers of the judge

_FIELD = "form_group"
_PARSED = rf"""pa AS (SELECT failure_id, source, nbr_id, words, regexp_replace(regexp_replace(coalesce(raw, ''), '^\s+', ''), '\s+$', '') AS t FROM judge_failures),
 pb AS (SELECT *, [CAST(json_extract(TRY_CAST(b AS JSON), '$.{_FIELD}') AS VARCHAR[]) for b in regexp_extract_all(t, '\{{[^{{}}]*\}}') if json_type(json_extract(TRY_CAST(b AS JSON), '$.{_FIELD}')) = 'ARRAY'] AS objects,
  [w for w in [regexp_replace(regexp_replace(w, '^[\s"'']+', ''), '[\s"'']+$', '') for w in string_split(regexp_extract(t, '\[([^\[\]]*)\]', 1), ',')] if regexp_full_match(w, '\p{{L}}+')] AS bare FROM pa),
 pd AS (SELECT failure_id, source, nbr_id, words, CASE WHEN len(objects) > 0 THEN objects[1] WHEN len(bare) > 0 THEN bare END AS members,
  CASE WHEN len(objects) > 0 THEN 'object' WHEN len(bare) > 0 THEN 'list' WHEN t = '' THEN 'empty_text' WHEN contains(t, '{{') AND NOT contains(t, '}}') THEN 'truncated_json' ELSE 'unparseable' END AS how FROM pb)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return judged.parsed_answers(spread(table(spark, d, "judge_failures").select("failure_id", "source", "nbr_id", "words", "raw")), "raw", _FIELD)


@query(f"WITH {_PARSED} SELECT failure_id, how, array_to_string(members, '|') AS members FROM pd")
def q73_parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("failure_id", "how", F.array_join("members", "|").alias("members"))


# components of all words of a list, then the judged members in the largest of them
_JUDGED = rf"""{_GROUPS.rsplit(" SELECT failure_id AS id", 1)[0].split("WITH RECURSIVE ", 1)[1].strip()}, {_PARSED},
 jm AS (SELECT id, w, min(pos) AS pos FROM (SELECT failure_id AS id, lower(trim(unnest(members), ' ')) AS w, unnest(range(len(members))) AS pos FROM pd) GROUP BY ALL),
 jk AS (SELECT jm.id, jm.w, jm.pos, c.comp FROM jm JOIN n ON n.id = jm.id AND n.w = jm.w JOIN c ON c.id = n.id AND c.pos = n.pos),
 jb AS (SELECT id, arg_max(comp, (k, -first)) AS comp FROM (SELECT id, comp, count(*) AS k, min(pos) AS first FROM jk GROUP BY ALL) GROUP BY id),
 jg AS (SELECT jk.id, jk.w FROM jk JOIN jb ON jb.id = jk.id AND jb.comp = jk.comp),
 ji AS (SELECT x.id, CASE WHEN length(x.w) <= length(y.w) THEN x.w ELSE y.w END AS lo, CASE WHEN length(x.w) <= length(y.w) THEN y.w ELSE x.w END AS hi FROM jg x JOIN jg y ON x.id = y.id AND x.w <> y.w),
 jl AS (SELECT DISTINCT id FROM ji WHERE NOT (hi IN (lo || 's', lo || 'es', lo || 'ed', lo || 'ing') OR ends_with(lo, 'e') AND hi IN (left(lo, length(lo) - 1) || 's', left(lo, length(lo) - 1) || 'es', left(lo, length(lo) - 1) || 'ed', left(lo, length(lo) - 1) || 'ing'))),
 jf AS (SELECT id, count(*) AS form_n FROM jg JOIN jl USING (id) GROUP BY id), jn AS (SELECT id, count(*) AS judged_n FROM jk GROUP BY id),
 js AS (SELECT failure_id AS id, nbr_id, how, CAST(coalesce(judged_n, 0) AS INT) AS judged_n, CAST(coalesce(jf.form_n, 0) AS INT) AS form_n, CAST(coalesce(g.form_n, 0) AS INT) AS cheap_n FROM pd LEFT JOIN jn ON jn.id = failure_id LEFT JOIN jf ON jf.id = failure_id LEFT JOIN g ON g.id = failure_id)"""


def _judged_sizes(spark: SparkSession, d: str) -> DataFrame:
    """(id, nbr_id, how, judged_n, form_n, cheap_n): the judge's group as named, what the definition leaves of it, and the
    group that the list's shared runs alone give."""
    x = judged.judged_groups(_answers(spark, d).withColumnRenamed("failure_id", "id"))
    cheap = neighborhood.form_groups(x.select("id", "words")).select(F.col("id").alias("_id"), F.col("form_n").alias("cheap_n"))
    return x.join(cheap, F.col("id") == F.col("_id")).select("id", "nbr_id", "how", "judged_n", "form_n", "cheap_n")


@query(f"WITH RECURSIVE {_JUDGED} SELECT how, judged_n, form_n, count(*) AS n, CAST(sum(judged_n - form_n) AS BIGINT) AS n_trimmed FROM js GROUP BY how, judged_n, form_n")
def q74_judged_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _judged_sizes(spark, d).groupBy("how", "judged_n", "form_n")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("judged_n") - F.col("form_n")).alias("n_trimmed"))


_ANSWERED = "ja AS (SELECT * FROM js WHERE how IN ('object', 'list'))"


@query(f"""WITH RECURSIVE {_JUDGED}, {_ANSWERED} SELECT 'exact' AS measure, round(avg(form_n), 9) AS judge, round(avg(cheap_n), 9) AS cheap, round(avg((form_n = cheap_n)::INT), 9) AS agreement FROM ja UNION ALL SELECT 'within_1', round(avg(form_n), 9), round(avg(cheap_n), 9), round(avg((abs(form_n - cheap_n) <= 1)::INT), 9) FROM ja
 UNION ALL SELECT 'form >= ' || k, round(avg((form_n >= k)::INT), 9), round(avg((cheap_n >= k)::INT), 9), round(avg(((form_n >= k) = (cheap_n >= k))::INT), 9) FROM ja, (VALUES (2), (3), (5)) v(k) GROUP BY k""")
def q75_judge_against_runs(spark: SparkSession, d: str) -> DataFrame:
    """How well the group that the shared runs give stands in for the judge's."""
    r = judged.size_agreement(_judged_sizes(spark, d).where("how in ('object', 'list')"))
    return r.withColumns({c: F.round(c, 9) for c in ("judge", "cheap", "agreement")})


@query(f"""WITH RECURSIVE {_JUDGED}, {_ANSWERED}, kf AS (SELECT id, arg_min(model, key_no) AS model, arg_min(coalesce(route, 'none'), key_no) AS route FROM neighborhood_key WHERE id IS NOT NULL GROUP BY id),
 x AS (SELECT m.model, route <> 'none' AS cued, form_n, cheap_n, k FROM ja JOIN kf ON kf.id = ja.nbr_id JOIN models m ON {sql.plain_key("m.model")} = {sql.plain_key("kf.model")}, (VALUES (2), (3), (5)) v(k)),
 lf AS (SELECT model, k, count(*) FILTER (cued) AS n_with, count(*) FILTER (NOT cued) AS n_without, avg((form_n >= k)::INT) FILTER (cued) AS jw, avg((form_n >= k)::INT) FILTER (NOT cued) AS jo, avg((cheap_n >= k)::INT) FILTER (cued) AS cw, avg((cheap_n >= k)::INT) FILTER (NOT cued) AS co FROM x GROUP BY ALL)
 SELECT model, CAST(k AS INT) AS k, n_with, n_without, round(jw, 9) AS judge_with, round(jo, 9) AS judge_without, CASE WHEN jo > 0 THEN round(jw / jo, 9) END AS judge_lift, CASE WHEN co > 0 THEN round(cw / co, 9) END AS cheap_lift FROM lf""")
def q76_judged_lifts(spark: SparkSession, d: str) -> DataFrame:
    """How much more often a list reaches a size where the prompt has a cue, by the judge and by the shared runs."""
    first = lambda c: F.min_by(c, "key_no")
    key = table(spark, d, "neighborhood_key").where("id is not null").groupBy(F.col("id").alias("nbr_id")).agg(first("model").alias("_m"), F.min_by(F.coalesce("route", F.lit("none")), "key_no").alias("route"))
    names = table(spark, d, "models").select(plain_key(F.col("model")).alias("_key"), "model")
    key = key.withColumn("_key", plain_key(F.col("_m"))).join(names, "_key").select("nbr_id", "model", (F.col("route") != "none").alias("cued"))
    r = judged.size_lifts(_judged_sizes(spark, d).where("how in ('object', 'list')").join(key, "nbr_id"))
    return r.withColumns({c: F.round(c, 9) for c in ("judge_with", "judge_without", "judge_lift", "cheap_lift")})


# ---------------------------------------------------------------- readings by outcome


def _items(spark: SparkSession, d: str) -> DataFrame:
    p = predictions.predictions(spark, d)
    return p.select("row_id", "model", "is_future", predictions.hit(F.col("rank"), 100).alias("hit"), norm(F.col("target_word")).alias("target"), prefix_before(F.col("text"), F.col("target_word")).alias("prefix"), "words")


_COMPOSED = rf"""{_DONORS}, wd AS (SELECT sa.row_id, CASE WHEN len(stems) > 0 AND len(affixes) > 0 THEN 'STEM+AFFIX' WHEN len(stems) > 0 THEN 'STEM' WHEN len(affixes) > 0 THEN 'AFFIX' ELSE 'NONE' END AS grade, tokens, list_distinct([lower(trim(v, ' ')) for v in p.words]) AS ws, sa.target, p.model, CAST(p.is_future AS INT) AS is_future, {_HIT} AS hit FROM sa JOIN p USING (row_id)),
 fo AS (SELECT *, [w for w in ws if w <> target AND length(w) >= 4 AND (length(target) > 5 AND left(target, 5) = left(w, 5) OR {_edits('w', 'target')} / greatest(length(w), length(target), 1) <= 0.34)] AS form FROM wd),
 co AS (SELECT row_id, model, is_future, hit, grade, CASE WHEN len([w for w in form if NOT list_contains(tokens, w)]) > 0 THEN 1 ELSE 0 END AS strict, CASE WHEN len(form) > 0 THEN 1 ELSE 0 END AS loose FROM fo)"""


@query(f"WITH {_COMPOSED} SELECT model, is_future, grade, CAST(NULL AS INT) AS hit, count(*) AS n, round(avg(strict), 9) AS strict, round(avg(loose), 9) AS loose FROM co GROUP BY model, is_future, grade UNION ALL SELECT model, is_future, grade, CAST(hit AS INT), count(*), round(avg(strict), 9), round(avg(loose), 9) FROM co GROUP BY model, is_future, grade, hit")
def q77_composition_cells(spark: SparkSession, d: str) -> DataFrame:
    return scaffold.composition_cells(scaffold.composition(_items(spark, d))).withColumns({c: F.round(c, 9) for c in ("strict", "loose")})


@query(f"""WITH {_COMPOSED}, g AS (SELECT model, count(*) FILTER (is_future = 1 AND hit = 1) AS hits, count(*) FILTER (is_future = 1 AND hit = 1 AND grade <> 'NONE') AS scaffolded, count(*) FILTER (is_future = 1 AND hit = 1 AND grade <> 'NONE' AND strict = 1) AS strict, count(*) FILTER (is_future = 1 AND hit = 1 AND grade <> 'NONE' AND loose = 1) AS loose FROM co GROUP BY model)
 SELECT *, round(strict / greatest(hits, 1), 9) AS strict_share, round(loose / greatest(hits, 1), 9) AS loose_share FROM g""")
def q78_composition_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Of the hits beyond the cutoff, how many a donor in the prompt and a variant among the predictions account for."""
    return scaffold.composition_accounts(scaffold.composition(_items(spark, d))).withColumns({c: F.round(c, 9) for c in ("strict_share", "loose_share")})


_PROFILED = rf"""{_LABELLED}, pq AS (SELECT row_id, model, rank, count(*) FILTER (label = 'STEM') AS n_stem, count(*) FILTER (label = 'AFFIX') AS n_affix, count(*) FILTER (label = 'FILLER') AS n_filler, count(*) FILTER (label = 'DISTANT') AS n_distant, count(*) FILTER (novelty = 'coined') AS n_coined, greatest(count(*) FILTER (label NOT IN ('EMPTY', 'SELF')), 1) AS scored FROM lab GROUP BY ALL),
 pc AS (SELECT md5(prefix) AS h, count(DISTINCT target) AS n_targets FROM p WHERE prefix <> '' AND target <> '' GROUP BY h),
 pr1 AS (SELECT pq.*, n_filler / scored AS filler_share, CASE WHEN pq.rank BETWEEN 1 AND 100 THEN 'hit' WHEN n_coined > 0 THEN 'comp-near-miss' WHEN n_stem + n_affix > 0 THEN 'retr-near-miss' WHEN n_distant >= n_filler THEN 'distant-miss' ELSE 'filler-miss' END AS outcome, p.is_future, p.target, p.year, p.cutoff_year, p.entry_year, coalesce(n_targets = 1, false) AS cued FROM pq JOIN p USING (row_id) LEFT JOIN pc ON pc.h = md5(p.prefix))"""
_MEANS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in outcomes.MEASURES)


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    p = predictions.predictions(spark, d).select("row_id", "is_future", "year", "cutoff_year", "entry_year", norm(F.col("target_word")).alias("target"), F.md5(prefix_before(F.col("text"), F.col("target_word"))).alias("h"))
    asked = p.where(f"h <> '{_EMPTY}' and target <> ''").groupBy("h", "target").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n_targets"))
    return neighborhood.profiles(_labelled(spark, d)).join(p, "row_id").join(asked, "h", "left").withColumn("cued", F.coalesce(F.col("n_targets") == 1, F.lit(False)))


_EMPTY = "d41d8cd98f00b204e9800998ecf8427e"  # the digest of an empty prompt


@query(f"""WITH {_PROFILED}, v AS (SELECT 'outcome' AS view, outcome AS part, * FROM pr1 WHERE is_future = 1 UNION ALL SELECT 'miss', CASE WHEN cued THEN 'cued' ELSE 'shared' END, * FROM pr1 WHERE outcome <> 'hit' UNION ALL SELECT 'reference', 'recalled', * FROM pr1 WHERE is_future = 0 AND outcome = 'hit')
 SELECT view, model, part, count(*) AS n, round(avg((n_stem + n_affix > 0)::INT), 9) AS related, round(avg((n_coined > 0)::INT), 9) AS coined, {_MEANS} FROM v GROUP BY view, model, part""")
def q79_outcome_views(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.outcome_views(_profiled(spark, d)).withColumns({c: F.round(c, 9) for c in ("related", "coined", *outcomes.MEASURES)})


@query(f"""WITH {_PROFILED}, l AS (SELECT * FROM pr1 QUALIFY row_number() OVER (PARTITION BY model, target, year ORDER BY row_id DESC) = 1), mi AS (SELECT * FROM l WHERE NOT coalesce(rank BETWEEN 1 AND 100, false)),
 bm AS (SELECT a.*, {", ".join(f"b.{m} AS {m}_b" for m in outcomes.MEASURES)} FROM mi a JOIN mi b ON a.target = b.target AND a.year IS NOT DISTINCT FROM b.year WHERE a.model = 'talkie-base' AND b.model = 'talkie-web'),
 s AS ({" UNION ALL ".join(f"SELECT '{n}' AS stratum, * FROM bm WHERE {c}" for n, c in (("in_cutoff", "year <= cutoff_year"), ("post_cutoff", "year > cutoff_year"), ("anchored", "year > cutoff_year AND coalesce(entry_year <= cutoff_year, false)"), ("unanchored", "year > cutoff_year AND NOT coalesce(entry_year <= cutoff_year, false)")))})
 SELECT stratum, count(*) AS n, {", ".join(f"round(avg({m}), 9) AS {m}_one, round(avg({m}_b), 9) AS {m}_other" for m in outcomes.MEASURES)} FROM s GROUP BY stratum""")
def q80_shared_misses(spark: SparkSession, d: str) -> DataFrame:
    """What two models predict where both miss the same item."""
    r = outcomes.shared_miss_means(_profiled(spark, d), "talkie-base", "talkie-web")
    return r.withColumns({c: F.round(c, 9) for c in r.columns if c not in ("stratum", "n")})


@query(f"""WITH {_P}, {_HEADWORDS}, x AS (SELECT p.model, CAST(is_future AS INT) AS is_future, CASE WHEN v.word IS NULL THEN 0 ELSE 1 END AS inside, {_HIT} AS hit FROM p LEFT JOIN v ON p.target = v.word), g AS (SELECT model, is_future, inside, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM x GROUP BY ALL)
 SELECT model, is_future, CAST(inside AS INT) AS inside, n, hits, round(hits / n, 9) AS recall, round(n / sum(n) OVER (PARTITION BY model, is_future), 9) AS share_of_stratum, round(n / sum(n) OVER (PARTITION BY model), 9) AS share_of_model, round(hits / sum(n) OVER (PARTITION BY model), 9) AS contribution FROM g""")
def q81_nested_parts(spark: SparkSession, d: str) -> DataFrame:
    """The headwords' part of each stratum and of the whole model."""
    heads = table(spark, d, "documents").select(norm(F.col("headword")).alias("w")).where("w <> ''").distinct().withColumn("_in", F.lit(1))
    x = predictions.predictions(spark, d).withColumn("w", norm(F.col("target_word"))).join(heads, "w", "left")
    r = outcomes.nested_parts(x, F.col("_in").isNotNull())
    return r.withColumns({c: F.round(c, 9) for c in ("recall", "share_of_stratum", "share_of_model", "contribution")})


@query(f"WITH {_P} SELECT row_id, max(row_id) OVER (PARTITION BY text) AS last FROM p")
def q82_last_of_text(spark: SparkSession, d: str) -> DataFrame:
    """The last row of the same prompt: where results are joined on texts, that one counts."""
    return outcomes.last_of_text(predictions.predictions(spark, d).select("row_id", "text"), "text", "row_id")


# ---------------------------------------------------------------- edits

_PLACED = rf"""px AS (SELECT DISTINCT target, lower(w) AS word FROM (SELECT target, unnest(regexp_extract_all(right(prefix, 320), '[A-Za-z]+')) AS w FROM p WHERE target <> '') WHERE length(w) >= 4 AND lower(w) <> target),
 py AS (SELECT *, CAST({_RUN.format(a="target", b="word")} AS INT) AS run FROM px), pz AS (SELECT *, [substring(target, CAST(i AS INT), run) for i in range(1, length(target) - run + 2) if contains(word, substring(target, CAST(i AS INT), run))][1] AS part FROM py WHERE run >= 3)"""


@query(f"WITH {_P}, {_PLACED} SELECT target, word, run, part, CASE WHEN starts_with(target, part) THEN 'start' WHEN ends_with(target, part) THEN 'end' ELSE 'middle' END AS place FROM pz")
def q83_run_places(spark: SparkSession, d: str) -> DataFrame:
    """The run that a prompt's word shares with the target, and where it stands in the target."""
    x = _items(spark, d).where("target <> ''")
    words = scaffold.prompt_words(F.col("prefix"), F.col("target"))
    pairs = x.select("target", F.explode_outer(words).alias("word")).where("word is not null").distinct()
    pairs = pairs.withColumn("run", common_run(F.col("target"), F.col("word"))).where("run >= 3").withColumn("part", run_text(F.col("target"), F.col("word"), F.col("run")))
    return pairs.withColumn("place", run_place(F.col("target"), F.col("part")))


_SHARES = "(length({0}) >= 3 AND length({1}) >= 3 AND list_has_any([substring({0}, CAST(i AS INT), 3) for i in range(1, length({0}) - 1)], [substring({1}, CAST(i AS INT), 3) for i in range(1, length({1}) - 1)]))"
_SWAP = r"regexp_replace(regexp_replace(prefix, '\b' || upper(left({0}, 1)) || substring({0}, 2) || '\b', upper(left({1}, 1)) || substring({1}, 2), 'g'), '\b' || {0} || '\b', {1}, 'g')"
_DOUBLED = "len([i for i in range(1, len({0})) if lower(regexp_extract({0}[i], '[\\p{{L}}\\p{{N}}_]+$')) = lower(regexp_extract({0}[i + 1], '^[\\p{{L}}\\p{{N}}_]+')) AND regexp_extract({0}[i], '[\\p{{L}}\\p{{N}}_]+$') <> '']) > 0"
_ARMS = rf"""{_DONORS}, {_LEX}, dr AS (SELECT sa.row_id, sa.target, coalesce(stems[1], affixes[1]) AS donor, p.prefix FROM sa JOIN p USING (row_id) WHERE sa.target <> '' AND len(stems) + len(affixes) > 0),
 dw AS (SELECT DISTINCT row_id, target, donor, lower(w) AS word FROM (SELECT *, unnest(regexp_extract_all(prefix, '[A-Za-z]+')) AS w FROM dr) WHERE length(w) >= 4 AND lower(w) <> donor),
 dk AS (SELECT row_id, arg_min(dw.word, (round(abs(log10(a.n_docs + 1) - log10(coalesce(b.n_docs, 0) + 1)), 9), dw.word)) AS placebo FROM dw JOIN lex a ON a.word = dw.word LEFT JOIN lex b ON b.word = dw.donor WHERE a.n_docs <= 0.5 * a.all_docs AND NOT {_SHARES.format("dw.word", "dw.target")} AND NOT {_SHARES.format("dw.word", "dw.donor")} GROUP BY row_id),
 dp AS (SELECT dr.*, placebo FROM dr LEFT JOIN dk USING (row_id)), wanted AS (SELECT donor AS word FROM dp UNION SELECT placebo FROM dp WHERE placebo IS NOT NULL), {_NEAREST},
 ds AS (SELECT dp.*, f1.substitute AS for_donor, f2.substitute AS for_placebo FROM dp LEFT JOIN nf f1 ON f1.word = donor LEFT JOIN nf f2 ON f2.word = placebo),
 dt AS (SELECT *, trim(regexp_replace(array_to_string([x for x in string_split(regexp_replace(prefix, '([,;:]|\band\b|\bbut\b)', chr(1) || '\1' || chr(1), 'g'), chr(1)) if NOT regexp_matches(x, '(?i)\b' || donor || '\b')], ''), '\s+', ' ', 'g'), ' ') AS rest, {_SWAP.format("donor", "for_donor")} AS e1, {_SWAP.format("placebo", "for_placebo")} AS e2 FROM ds),
 ar AS (SELECT row_id, target, prefix, 'donor_substituted' AS arm, donor AS word, e1 AS edited, CASE WHEN for_donor IS NULL THEN 'no_substitute' WHEN {_SHARES.format("for_donor", "target")} THEN 'overlaps_target' WHEN {_DOUBLED.format("regexp_split_to_array(e1, '[ ]+')")} THEN 'adjacent_duplicate' ELSE 'ok' END AS status FROM dt
  UNION ALL SELECT row_id, target, prefix, 'donor_deleted', donor, rest, CASE WHEN rest = prefix OR length(rest) < 40 OR length(rest) < 0.6 * length(prefix) THEN 'no_clean_deletion' WHEN contains(lower(rest), donor) THEN 'donor_survives' WHEN regexp_matches(rest, '[,;:][A-Za-z]') THEN 'punctuation_artifact' ELSE 'ok' END FROM dt
  UNION ALL SELECT row_id, target, prefix, 'placebo', placebo, e2, CASE WHEN placebo IS NULL THEN 'no_candidate' WHEN for_placebo IS NULL THEN 'no_substitute' WHEN {_SHARES.format("for_placebo", "target")} THEN 'overlaps_target' WHEN {_DOUBLED.format("regexp_split_to_array(e2, '[ ]+')")} THEN 'adjacent_duplicate' ELSE 'ok' END FROM dt)"""


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = scaffold.with_donors(_items(spark, d).where("target <> ''")).withColumn("donor", F.coalesce(F.get("stems", F.lit(0)), F.get("affixes", F.lit(0))))
    rows = x.where("donor is not null").select("row_id", "target", "donor", "prefix")
    return rows, perturbation.edit_arms(rows, _lexicon(spark, d))


@query(f"WITH {_ARMS} SELECT row_id, arm, word, CASE WHEN status = 'ok' THEN edited END AS edited, status FROM ar")
def q84_edit_arms(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d)[1]


_READ = f"""{_ARMS}, {_BIGRAMS}, rk AS (SELECT word, next FROM bg QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, next) <= 100),
 rd AS (SELECT row_id, arm, target, unnest(list_distinct([lower(w) for w in regexp_extract_all(prefix, '[A-Za-z]+')])) AS w, 1 AS side FROM ar WHERE status = 'ok' UNION ALL SELECT row_id, arm, target, unnest(list_distinct([lower(w) for w in regexp_extract_all(edited, '[A-Za-z]+')])), 2 FROM ar WHERE status = 'ok'),
 rs AS (SELECT row_id, arm, bool_or(side = 1) AS before, bool_or(side = 2) AS after FROM rd JOIN rk ON rk.word = rd.w AND rk.next = rd.target GROUP BY ALL),
 re AS (SELECT row_id, arm, coalesce(before, false) AS before, coalesce(after, false) AS after FROM ar LEFT JOIN rs USING (row_id, arm) WHERE status = 'ok')"""


def _paired_sql(b: str, c: str) -> str:
    return f"""round(ln(({b} + CASE WHEN least({b}, {c}) = 0 THEN 0.5 ELSE 0 END)::DOUBLE / ({c} + CASE WHEN least({b}, {c}) = 0 THEN 0.5 ELSE 0 END)), 6) AS lambda,
 CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum([exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0::DOUBLE)) for i in range(0, least({b}, {c}) + 1)])), 6) END AS p"""


def _read_arms(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, arm, before, after): whether the target is among the hundred words that follow any of the prompt's words
    most often in the corpus, before and after each clean edit."""
    rows, arms = _arms(spark, d)
    clean = arms.where("status = 'ok'").join(rows.select("row_id", "target", "prefix"), "row_id")
    side = lambda c, after: F.transform(F.array_distinct(letter_tokens(F.col(c))), lambda w: F.struct(w.alias("word"), F.lit(after).alias("after")))
    words = clean.select("row_id", "arm", "target", F.explode_outer(F.concat(side("prefix", False), side("edited", True))).alias("x")).select("row_id", "arm", "target", "x.*")
    ranked = decoding.top_next(decoding.word_pairs(table(spark, d, "documents"), "text"), 100).select("word", F.col("next").alias("target"))
    met = words.join(ranked, ["word", "target"]).groupBy("row_id", "arm").agg(F.bool_or(~F.col("after")).alias("before"), F.bool_or("after").alias("after"))
    return clean.select("row_id", "arm").join(met, ["row_id", "arm"], "left").na.fill(False, ["before", "after"])


@query(f"""WITH RECURSIVE {_READ}, rg AS (SELECT arm, count(*) AS n, count(*) FILTER (before) AS before, count(*) FILTER (after) AS after, count(*) FILTER (before AND NOT after) AS lost, count(*) FILTER (after AND NOT before) AS gained FROM re GROUP BY arm)
 SELECT *, {_paired_sql("lost", "gained")} FROM rg""")
def q85_arm_effects(spark: SparkSession, d: str) -> DataFrame:
    """What each arm does to the recall of the targets among the words that follow those of the prompt in the corpus."""
    return perturbation.arm_effects(_read_arms(spark, d)).withColumns({c: F.round(c, 6) for c in ("lambda", "p")})


# ---------------------------------------------------------------- routes, labels, sheets


@query(rf"""WITH {_DONORS}, en AS (SELECT right(target, 4) AS ending, count(DISTINCT target) AS n FROM p WHERE length(target) > 4 GROUP BY ending),
 r AS (SELECT sa.target, CASE WHEN len(stems) > 0 THEN 'paradigmatic' WHEN len(affixes) > 0 THEN 'syntagmatic' ELSE 'none' END AS route, len(stems) = 0 AND len(affixes) > 0 AS alone, {_HIT} AS hit FROM sa JOIN p USING (row_id) WHERE sa.target <> '')
 SELECT route, CASE WHEN NOT alone THEN 'n/a' WHEN n <= 5 THEN 'rare' WHEN n <= 50 THEN 'common' ELSE 'very-common' END AS ending_rarity, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS rate FROM r LEFT JOIN en ON alone AND en.ending = right(target, 4) GROUP BY ALL""")
def q86_routes(spark: SparkSession, d: str) -> DataFrame:
    """Recall by the route that the prompt's donors make, and, where only the ending is shared, by how many targets share it."""
    x = scaffold.with_donors(_items(spark, d).where("target <> ''")).select("target", "route", "hit")
    endings = x.where(F.length("target") > 4).groupBy(F.right("target", F.lit(4)).alias("ending")).agg(F.countDistinct("target").alias("n"))
    x = x.withColumn("ending", F.when(F.col("route") == "syntagmatic", F.right("target", F.lit(4)))).join(endings, "ending", "left")
    rarity = F.when(F.col("ending").isNull(), "n/a").when(F.col("n") <= 5, "rare").when(F.col("n") <= 50, "common").otherwise("very-common")
    return x.groupBy("route", rarity.alias("ending_rarity")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 9).alias("rate"))


@query("""WITH g AS (SELECT id, form, count(*) AS k, min(line_no) AS first FROM label_log WHERE id IS NOT NULL AND form IS NOT NULL GROUP BY ALL)
 SELECT id, CAST(sum(k) AS BIGINT) AS n, arg_max(form, (k, -first)) AS modal, round(max(k) / sum(k), 9) AS share FROM g GROUP BY id""")
def q87_modal_labels(spark: SparkSession, d: str) -> DataFrame:
    return outcomes.modal_values(table(spark, d, "label_log"), "id", "form", "line_no").withColumn("share", F.round("share", 9))


@query(f"WITH {_PAIRS}, t AS (SELECT id, a, b, run, row_number() OVER (PARTITION BY id ORDER BY run DESC, a, b) AS place FROM pr JOIN rn USING (a, b)) SELECT id, CAST(place AS INT) AS place, a, b, run FROM t WHERE place <= 24")
def q88_top_overlaps(spark: SparkSession, d: str) -> DataFrame:
    lists = spread(table(spark, d, "judge_failures").select(F.col("failure_id").alias("id"), "words"))
    return neighborhood.top_overlaps(neighborhood.overlap_pairs(lists))


@query(f"""WITH {_P}, w AS (SELECT DISTINCT lower(trim(w, ' ')) AS w FROM (SELECT unnest(words) AS w FROM p) WHERE regexp_full_match(lower(trim(w, ' ')), '\\p{{L}}{{4,}}')),
 k AS (SELECT w, unnest(range(2, 8)) AS k FROM w), e AS (SELECT DISTINCT w, substring(w, CAST(i AS INT), CAST(k AS INT)) AS g FROM (SELECT *, unnest(range(1, length(w) - k + 2)) AS i FROM k WHERE length(w) >= k)) SELECT '~' || g AS gram, count(*) AS n_words FROM e GROUP BY g""")
def q89_inner_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood.inner_ngrams(predictions.predictions(spark, d).select(F.explode_outer("words").alias("word")).where("word is not null"))


@query(f"""WITH l AS (SELECT id, arg_max(form, line_no) FILTER (form IS NOT NULL) AS form FROM label_log WHERE id IS NOT NULL GROUP BY id)
 SELECT failure_id, nbr_id, CAST(place AS INT) AS place, CAST(list_position(words, w) AS INT) AS list_place, w AS word FROM (SELECT failure_id, nbr_id, words, unnest(range(1, len(s) + 1)) AS place, unnest(s) AS w FROM
 (SELECT failure_id, nbr_id, words, [substring(m, 33) for m in list_sort([md5(concat_ws('|', '20260806', CAST(failure_id AS VARCHAR), w)) || w for w in words])] AS s FROM judge_failures JOIN l ON l.id = nbr_id WHERE form = 0))""")
def q90_blind_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The second sheet: lists whose item was labelled 0 on form, their words shuffled, with the key of where each stood."""
    zero = _last_labels(spark, d).where("form = 0").select(F.col("id").alias("nbr_id"))
    x = table(spark, d, "judge_failures").select("failure_id", "nbr_id", "words").join(zero, "nbr_id", "left_semi")
    x = x.withColumn("s", sampling.shuffled(F.col("words"), F.col("failure_id"))).select("failure_id", "nbr_id", "words", F.posexplode_outer("s").alias("at", "word")).where("word is not null")
    return x.select("failure_id", "nbr_id", (F.col("at") + 1).alias("place"), F.array_position("words", F.col("word")).cast("int").alias("list_place"), "word")


@query(f"""WITH f AS (SELECT id, min(key_no) AS key_no, arg_min(coalesce(route, ''), key_no) AS route, arg_min(coalesce(locality, ''), key_no) AS locality FROM neighborhood_key WHERE id IS NOT NULL AND is_future = 1 GROUP BY id),
 t AS (SELECT *, route || '|' || locality AS cell, row_number() OVER (PARTITION BY route || '|' || locality ORDER BY {_DRAW.format(seed=20260811, key='key_no')}) AS turn FROM f)
 SELECT key_no, cell, CAST(turn AS INT) AS turn FROM t ORDER BY turn, cell LIMIT 40""")
def q91_balanced_blind(spark: SparkSession, d: str) -> DataFrame:
    """Forty later items in equal parts from each cell of route and locality; a missing part of a cell's name is empty."""
    key = table(spark, d, "neighborhood_key").where("id is not null and is_future = 1").groupBy("id").agg(F.min("key_no").alias("key_no"), F.min_by(F.coalesce("route", F.lit("")), "key_no").alias("route"), F.min_by(F.coalesce("locality", F.lit("")), "key_no").alias("locality"))
    return sampling.round_robin(key.select("key_no", F.concat_ws("|", "route", "locality").alias("cell")), "cell", "key_no", 40).select("key_no", "cell", "turn")


@query(f"""WITH o AS (SELECT failure_id, row_number() OVER (ORDER BY {_DRAW.format(seed=20260815, key='failure_id')}) AS place, count(*) OVER () AS n FROM judge_failures) SELECT failure_id, place FROM o WHERE (place - 1) % greatest(n // 50, 1) = 0 ORDER BY place LIMIT 50""")
def q92_stride_pick(spark: SparkSession, d: str) -> DataFrame:
    """Fifty answers, evenly spaced in draw order."""
    return sampling.stride(table(spark, d, "judge_failures").select("failure_id"), "failure_id", 50).select("failure_id", "place")


@query(f"""WITH {_DONORS}, i AS (SELECT sa.row_id, sa.target, len(stems) + len(affixes) > 0 AS scaffolded, CAST(p.is_future AS INT) AS is_future, {_DRAW.format(seed=20260816, key='sa.row_id')} AS draw FROM sa JOIN p USING (row_id) WHERE sa.target <> ''),
 f AS (SELECT target, bool_or(scaffolded) AS scaffolded, min(row_id) AS row_id, min(draw) AS draw FROM i WHERE is_future = 1 GROUP BY target)
 SELECT row_id, target, 'scaffolded' AS kind FROM f WHERE scaffolded UNION ALL SELECT row_id, target, 'control' FROM (SELECT * FROM f WHERE NOT scaffolded ORDER BY draw LIMIT 45)""")
def q93_prompt_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of prompts: every later target that some prompt has a donor for, and 45 controls, or all, of the others."""
    x = scaffold.with_donors(_items(spark, d).where("target <> '' and is_future = 1")).withColumn("_draw", sampling.draw_key(20260816, "row_id"))
    f = x.groupBy("target").agg(F.bool_or(F.col("grade") != "NONE").alias("scaffolded"), F.min("row_id").alias("row_id"), F.min("_draw").alias("_draw"))
    controls = f.where("not scaffolded").orderBy("_draw").limit(45)
    part = lambda df, kind: df.select("row_id", "target", F.lit(kind).alias("kind"))
    return part(f.where("scaffolded"), "scaffolded").unionByName(part(controls, "control"))


@query("SELECT upper(trim(sheet, ' ')) AS sheet, coalesce(nullif(lower(trim(theme, ' ')), ''), 'none') AS theme, form, meaning, count(*) AS n FROM label_log GROUP BY ALL")
def q94_label_audit(spark: SparkSession, d: str) -> DataFrame:
    """How often each combination of labels was given."""
    theme = F.coalesce(F.nullif(F.lower(F.trim("theme")), F.lit("")), F.lit("none"))
    return table(spark, d, "label_log").groupBy(F.upper(F.trim("sheet")).alias("sheet"), theme.alias("theme"), "form", "meaning").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_P} SELECT model, target, md5(text) AS digest, min(row_id) AS row_id, count(*) AS n FROM p WHERE text IS NOT NULL GROUP BY ALL")
def q95_once_per_triple(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each model, target and prompt, and how often these were loaded."""
    p = predictions.predictions(spark, d).where("text is not null")
    return p.groupBy("model", norm(F.col("target_word")).alias("target"), F.md5("text").alias("digest")).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE {_JUDGED}, {_ANSWERED}, la AS (SELECT id, arg_max(form, line_no) FILTER (form IS NOT NULL) AS hand FROM label_log WHERE id IS NOT NULL GROUP BY id), x AS (SELECT hand, form_n, k FROM ja JOIN la ON la.id = ja.nbr_id, (VALUES (1), (2), (3), (5)) v(k) WHERE hand IS NOT NULL)
 SELECT CAST(k AS INT) AS k, count(*) FILTER (hand >= k AND form_n >= k) AS both, count(*) FILTER (hand >= k AND form_n < k) AS hand_only, count(*) FILTER (hand < k AND form_n >= k) AS judge_only, count(*) FILTER (hand < k AND form_n < k) AS neither FROM x GROUP BY k""")
def q96_hand_against_judge(spark: SparkSession, d: str) -> DataFrame:
    """The labels given by hand against the judge's groups, swept over the size that counts."""
    hand = _last_labels(spark, d).select(F.col("id").alias("nbr_id"), F.col("form").alias("hand")).where("hand is not null")
    x = _judged_sizes(spark, d).where("how in ('object', 'list')").join(hand, "nbr_id").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))))
    h, j = F.col("hand") >= F.col("k"), F.col("form_n") >= F.col("k")
    return x.groupBy("k").agg(F.count_if(h & j).alias("both"), F.count_if(h & ~j).alias("hand_only"), F.count_if(~h & j).alias("judge_only"), F.count_if(~h & ~j).alias("neither"))


@query(f"""WITH {_P}, g AS (SELECT model, item_id, arg_min(words, row_id) AS a, arg_max(words, row_id) AS b, count(*) AS n FROM p WHERE item_id IS NOT NULL GROUP BY ALL)
 SELECT model, CASE WHEN n = 1 THEN 'once' WHEN len(a) = 0 OR len(b) = 0 THEN 'missing' WHEN a = b THEN 'ok' ELSE 'bad' END AS status, count(*) AS n_items FROM g GROUP BY ALL""")
def q97_decoded_again(spark: SparkSession, d: str) -> DataFrame:
    """Whether an item that was decoded again gave the same list: the first decoding against the last."""
    g = predictions.predictions(spark, d).where("item_id is not null").groupBy("model", "item_id").agg(F.min_by("words", "row_id").alias("a"), F.max_by("words", "row_id").alias("b"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == 1, "once").when((F.size("a") == 0) | (F.size("b") == 0), "missing").when(F.col("a") == F.col("b"), "ok").otherwise("bad")
    return g.groupBy("model", status.alias("status")).agg(F.count(F.lit(1)).alias("n_items"))


@query(f"""WITH {sql.slots("neighborhood_key", "key_no", "stem_donors", "s2")}, {sql.slots("neighborhood_key", "key_no", "affix_donors", "s3")}, x AS (SELECT coalesce(route, '') AS recruitment, len(list_filter(coalesce(s2.slots, []), lambda v: v <> '')) > 0 AS stem, len(list_filter(coalesce(s3.slots, []), lambda v: v <> '')) > 0 AS affix, {_HIT} AS hit
 FROM neighborhood_key k LEFT JOIN s2 ON s2.k = key_no LEFT JOIN s3 ON s3.k = key_no WHERE is_future IS NOT NULL)
 SELECT CASE WHEN stem AND affix THEN 'both' WHEN stem THEN 'stem' WHEN affix THEN 'affix' ELSE 'none' END AS material, recruitment, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS rate FROM x GROUP BY ALL""")
def q98_material(spark: SparkSession, d: str) -> DataFrame:
    """Recall by what the donors share with the target and how they are recruited; rows without is_future are left out."""
    x = spread(table(spark, d, "neighborhood_key").where("is_future is not null").select("stem_donors", "affix_donors", "route", "rank"))
    for name, field in (("stem", "stem_donors"), ("affix", "affix_donors")):
        x = with_slots(x, field).withColumn(name, F.exists(F.coalesce("slots", F.array().cast("array<string>")), lambda v: v != "")).drop("slots")
    material = F.when(F.col("stem") & F.col("affix"), "both").when(F.col("stem"), "stem").when(F.col("affix"), "affix").otherwise("none")
    hit = predictions.hit(F.col("rank"), 100)
    return x.groupBy(material.alias("material"), F.coalesce("route", F.lit("")).alias("recruitment")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 9).alias("rate"))


@query("""WITH y AS (SELECT 'postcutoff_words' AS source, year FROM postcutoff_words UNION ALL SELECT 'neighborhood_key', year FROM neighborhood_key UNION ALL SELECT 'documents', year FROM documents)
 SELECT source, CAST(floor(year / 10) * 10 AS INT) AS decade, count(*) AS n FROM y WHERE year > 0 GROUP BY ALL""")
def q99_years(spark: SparkSession, d: str) -> DataFrame:
    """The years of all tables put together, by decade."""
    parts = (table(spark, d, t).select(F.lit(t).alias("source"), "year") for t in ("postcutoff_words", "neighborhood_key", "documents"))
    years = reduce(DataFrame.unionByName, parts).where("year > 0")
    return years.groupBy("source", (F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LABELLED}, c AS (SELECT model, word, min(row_id) AS row_id FROM lab WHERE novelty = 'coined' GROUP BY ALL) SELECT model, word, row_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_id, word) AS place FROM c) WHERE place <= 18""")
def q100_exhibits(spark: SparkSession, d: str) -> DataFrame:
    """The first eighteen coined words of each model, each once, in the order in which they came."""
    c = _labelled(spark, d).where("novelty = 'coined'").groupBy("model", "word").agg(F.min("row_id").alias("row_id"))
    w = Window.partitionBy("model").orderBy("row_id", "word")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 18").select("model", "word", "row_id", "place")


@query(rf"""WITH {_DONORS}, t AS (SELECT sa.row_id, list_distinct(list_concat(stems, affixes)) AS donors, [lower(w) for w in regexp_extract_all(right(p.prefix, 320), '[A-Za-z]+')] AS near FROM sa JOIN p USING (row_id) WHERE len(stems) + len(affixes) > 0)
 SELECT row_id, CAST(len(donors) AS INT) AS n_donors, CAST(len([w for w in donors if list_contains(near, w)]) AS INT) AS n_near, CAST(len([w for w in near if list_contains(donors, w)]) AS INT) AS times FROM t""")
def q101_donor_windows(spark: SparkSession, d: str) -> DataFrame:
    """How many of a prompt's donors stand among its last 320 characters, and how often."""
    x = scaffold.with_donors(_items(spark, d)).withColumn("donors", F.array_union("stems", "affixes")).where(F.size("donors") > 0)
    near = letter_tokens(F.right("prefix", F.lit(scaffold.PREFIX_CHARS)))
    x = x.select("row_id", "donors", near.alias("near"))
    return x.select("row_id", F.size("donors").alias("n_donors"), F.size(F.array_intersect("donors", "near")).alias("n_near"), F.size(F.filter("near", lambda w: F.array_contains("donors", w))).alias("times"))


_ENDING_SQL = "CASE " + " ".join(f"WHEN ends_with(word, '{e}') AND length(word) >= {len(e) + 3} THEN '{e}'" for e in ENDINGS) + " ELSE '' END"


@query(f"""WITH {_P}, {_LEX}, wanted AS (SELECT DISTINCT target AS word FROM p WHERE target <> ''), {_NEAREST}, e AS (SELECT word, substitute AS base, {_ENDING_SQL} AS ending FROM nf),
 f AS (SELECT *, list_filter(CASE WHEN ending IN ('ing', 'ings', 'ed', 'er', 'est') THEN [CASE WHEN ends_with(base, 'e') THEN left(base, length(base) - 1) || ending END, base || ending, CASE WHEN regexp_matches(base, '[^aeiou][aeiou][^aeiouwxy]$') THEN base || right(base, 1) || ending END]
  WHEN ending IN ('s', 'es') THEN [base || 's', base || 'es', CASE WHEN regexp_matches(base, '[^aeiou]y$') THEN left(base, length(base) - 1) || 'ies' END] ELSE [base || ending] END, lambda v: v IS NOT NULL) AS forms FROM e WHERE ending <> ''),
 u AS (SELECT word, base, ending, forms, unnest(forms) AS form, unnest(range(len(forms))) AS pos FROM f), a AS (SELECT u.word, arg_min(form, pos) AS form FROM u JOIN lex ON lex.word = u.form GROUP BY u.word)
 SELECT f.word, base, ending, coalesce(a.form, forms[1]) AS form, CAST(CASE WHEN a.form IS NULL THEN 0 ELSE 1 END AS INT) AS attested FROM f LEFT JOIN a ON a.word = f.word""")
def q102_inflected_substitutes(spark: SparkSession, d: str) -> DataFrame:
    """For each inflected target the word nearest in frequency with the same ending, written as the documents write it, or
    in the likeliest way where they don't have it."""
    lexicon = _lexicon(spark, d)
    words = predictions.predictions(spark, d).select(norm(F.col("target_word")).alias("word")).where("word <> ''").distinct()
    near = perturbation.nearest_by_frequency(words, lexicon.select("word", F.col("n_docs").alias("n"))).select("word", F.col("substitute").alias("base"), inflection(F.col("word")).alias("ending")).where("ending <> ''")
    x = near.withColumn("forms", inflected(F.col("base"), F.col("ending")))
    known = x.select("word", F.posexplode("forms").alias("pos", "form")).join(lexicon.select(F.col("word").alias("form")), "form").groupBy("word").agg(F.min_by("form", "pos").alias("known"))
    x = x.join(known, "word", "left")
    return x.select("word", "base", "ending", F.coalesce("known", F.get("forms", F.lit(0))).alias("form"), F.col("known").isNotNull().cast("int").alias("attested"))


# ---------------------------------------------------------------- pairs, coverage, ceilings


@query(f"""WITH RECURSIVE {_READ}, rb AS (SELECT row_id, arm, before, before AND NOT after AS lost FROM re), rg AS (SELECT x.arm, count(*) FILTER (x.before AND y.before) AS n, count(*) FILTER (x.lost AND y.lost) AS both_lost, count(*) FILTER (x.lost AND y.before AND NOT y.lost) AS arm_only, count(*) FILTER (x.before AND NOT x.lost AND y.lost) AS placebo_only FROM rb x JOIN rb y USING (row_id) WHERE x.arm <> 'placebo' AND y.arm = 'placebo' GROUP BY x.arm)
 SELECT *, {_paired_sql("arm_only", "placebo_only")} FROM rg""")
def q103_arms_against_placebo(spark: SparkSession, d: str) -> DataFrame:
    return perturbation.arm_against_placebo(_read_arms(spark, d)).withColumns({c: F.round(c, 6) for c in ("lambda", "p")})


@query(f"""WITH {_P}, g AS (SELECT model, count(*) FILTER (year > cutoff_year) AS n_post, count(*) FILTER (year > cutoff_year AND entry_year IS NOT NULL) AS n_entered, count(*) FILTER (year > cutoff_year AND entry_year <= cutoff_year) AS n_anchored, avg({_HIT}) FILTER (year <= cutoff_year) AS before, avg({_HIT}) FILTER (year > cutoff_year) AS after FROM p GROUP BY model)
 SELECT model, n_post, n_entered, n_anchored, CASE WHEN n_post > 0 THEN round(n_entered / n_post, 9) END AS coverage, round(after - before, 9) AS change, CASE WHEN after > before THEN 'rises' WHEN after < before THEN 'falls' WHEN after = before THEN 'level' END AS direction FROM g""")
def q104_anchoring(spark: SparkSession, d: str) -> DataFrame:
    """How many later items have a year of entry, or one before the cutoff, and where recall goes beyond the cutoff."""
    post, past = F.col("year") > F.col("cutoff_year"), F.col("year") <= F.col("cutoff_year")
    hit = predictions.hit(F.col("rank"), 100)
    g = predictions.predictions(spark, d).groupBy("model").agg(F.count_if(post).alias("n_post"), F.count_if(post & F.col("entry_year").isNotNull()).alias("n_entered"), F.count_if(post & (F.col("entry_year") <= F.col("cutoff_year"))).alias("n_anchored"), F.avg(F.when(past, hit)).alias("before"), F.avg(F.when(post, hit)).alias("after"))
    a, b = F.col("after"), F.col("before")
    return g.select("model", "n_post", "n_entered", "n_anchored", F.when(F.col("n_post") > 0, F.round(F.col("n_entered") / F.col("n_post"), 9)).alias("coverage"), F.round(a - b, 9).alias("change"), F.when(a > b, "rises").when(a < b, "falls").when(a == b, "level").alias("direction"))


@query(f"""WITH {_P}, {_HEADWORDS}, x AS (SELECT p.model, CASE WHEN v.word IS NULL THEN 0 ELSE 1 END AS inside, k, CASE WHEN rank BETWEEN 1 AND k THEN 1 ELSE 0 END AS hit FROM p LEFT JOIN v ON p.target = v.word, (VALUES (10), (20), (50), (100)) w(k) WHERE year > cutoff_year)
 SELECT model, CAST(k AS INT) AS k, CAST(inside AS INT) AS inside, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 9) AS recall FROM x GROUP BY ALL""")
def q105_parts_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Recall at each rank of the later items whose target is a headword of the documents, and of the others."""
    heads = table(spark, d, "documents").select(norm(F.col("headword")).alias("w")).where("w <> ''").distinct().withColumn("_in", F.lit(1))
    x = predictions.predictions(spark, d).where("year > cutoff_year").withColumn("w", norm(F.col("target_word"))).join(heads, "w", "left")
    hits = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), predictions.hit(F.col("rank"), k).alias("hit")) for k in predictions.KS)))
    x = x.select("model", F.col("_in").isNotNull().cast("int").alias("inside"), hits.alias("x")).select("model", "inside", "x.*")
    return x.groupBy("model", "k", "inside").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.round(F.avg("hit"), 9).alias("recall"))


@query(f"WITH {_NAMED} SELECT grade, domain, count(DISTINCT id) AS n_items, count(DISTINCT lower(trim(target_word, ' '))) AS n_targets FROM nk WHERE grade IS NOT NULL GROUP BY grade, domain")
def q106_items_by_grade(spark: SparkSession, d: str) -> DataFrame:
    x = _decoded(spark, d).withColumn("grade", named_parts(F.col("grade"), scaffold.GRADES)).where("grade is not null")
    return x.groupBy("grade", "domain").agg(F.countDistinct("id").alias("n_items"), F.countDistinct(F.lower(F.trim("target_word"))).alias("n_targets"))


@query(f"""WITH {_CUES}, t AS (SELECT model, is_future, {_CELLS} FROM cu GROUP BY ALL), h AS (SELECT model, is_future, a + {_HALDANE.format("")} AS a, b + {_HALDANE.format("")} AS b, c + {_HALDANE.format("")} AS c, d + {_HALDANE.format("")} AS d FROM t),
 l AS (SELECT model, is_future, ln(a * d / (b * c)) AS lam, 1 / a + 1 / b + 1 / c + 1 / d AS v FROM h), j AS (SELECT p.model, p.lam - q.lam AS lam, sqrt(p.v + q.v) AS se FROM l p JOIN l q USING (model) WHERE p.is_future = 1 AND q.is_future = 0)
 SELECT model, round(lam, 6) AS lambda3, round(se, 6) AS error, round(exp(lam), 6) AS ratio, round(exp(lam - {stats.Z} * se), 6) AS low, round(exp(lam + {stats.Z} * se), 6) AS high FROM j""")
def q107_interaction(spark: SparkSession, d: str) -> DataFrame:
    """How much stronger a cue is associated with recall beyond the cutoff than before it, with the combined error."""
    t = _cells(_cues(spark, d), "model", "is_future")
    c = [F.col(x) for x in "abcd"]
    l = t.select("model", "is_future", stats.log_odds_ratio(c).alias("lam"), stats.log_odds_error(c).alias("se"))
    p, q = (l.where(F.col("is_future") == v).select("model", F.col("lam").alias(f"lam{v}"), F.col("se").alias(f"se{v}")) for v in (1, 0))
    lam, se = F.col("lam1") - F.col("lam0"), F.sqrt(F.col("se1") * F.col("se1") + F.col("se0") * F.col("se0"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return p.join(q, "model").select("model", r(lam, "lambda3"), r(se, "error"), r(F.exp(lam), "ratio"), r(F.exp(lam - stats.Z * se), "low"), r(F.exp(lam + stats.Z * se), "high"))


@query(f"""WITH RECURSIVE {_JUDGED}, {_ANSWERED}, hl AS (SELECT id, arg_min(form, line_no) AS a, arg_max(form, line_no) AS b, count(*) AS m FROM label_log WHERE id IS NOT NULL AND form IS NOT NULL GROUP BY id), ks AS (SELECT unnest([1, 2, 3, 5]) AS k),
 cl AS (SELECT k, avg(((a >= k) = (b >= k))::INT) AS ceiling FROM hl, ks WHERE m > 1 GROUP BY k), ac AS (SELECT k, count(*) AS n, avg(((b >= k) = (form_n >= k))::INT) AS accuracy FROM ja JOIN hl ON hl.id = ja.nbr_id, ks GROUP BY k)
 SELECT CAST(k AS INT) AS k, n, round(accuracy, 9) AS accuracy, round(ceiling, 9) AS ceiling, CASE WHEN ceiling > 0 THEN round(accuracy / ceiling, 9) END AS share FROM ac LEFT JOIN cl USING (k)""")
def q108_share_of_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the judge against the last hand label, as a share of how well labels given twice agree."""
    log = table(spark, d, "label_log").where("id is not null and form is not null").groupBy("id").agg(F.min_by("form", "line_no").alias("a"), F.max_by("form", "line_no").alias("b"), F.count(F.lit(1)).alias("m"))
    each = F.explode(F.array(*map(F.lit, (1, 2, 3, 5))))
    same = lambda x, y: F.avg(((F.col(x) >= F.col("k")) == (F.col(y) >= F.col("k"))).cast("int"))
    ceiling = log.where("m > 1").withColumn("k", each).groupBy("k").agg(same("a", "b").alias("ceiling"))
    judged_ = _judged_sizes(spark, d).where("how in ('object', 'list')").join(log.withColumnRenamed("id", "nbr_id"), "nbr_id").withColumn("k", each)
    g = judged_.groupBy("k").agg(F.count(F.lit(1)).alias("n"), same("b", "form_n").alias("accuracy")).join(ceiling, "k", "left")
    return g.select("k", "n", F.round("accuracy", 9).alias("accuracy"), F.round("ceiling", 9).alias("ceiling"), F.when(F.col("ceiling") > 0, F.round(F.col("accuracy") / F.col("ceiling"), 9)).alias("share"))


@query(f"""WITH {_SCREEN}, pw AS (SELECT target, lower(trim(w, ' ')) AS word, min(pos) AS pos FROM (SELECT target, unnest(words) AS w, unnest(range(len(words))) AS pos FROM p WHERE model = 'talkie-base' AND target <> '') GROUP BY ALL),
 f AS (SELECT target, arg_min(struct_pack(w := cr.word, gap := gap), (pos, cr.word)) AS b FROM pw JOIN cr USING (target, word) WHERE reason = 'kept' GROUP BY target),
 r AS (SELECT target, word, gap, row_number() OVER (PARTITION BY target ORDER BY gap, word) AS rn FROM cr WHERE reason = 'kept' AND target NOT IN (SELECT target FROM pw))
 SELECT target, b.w AS substitute, b.gap AS gap FROM f UNION ALL SELECT target, word, gap FROM r WHERE rn = 1""")
def q109_proposed_substitutes(spark: SparkSession, d: str) -> DataFrame:
    """Substitutes by the order in which one model proposes words; by frequency only for targets it has no list for."""
    p = predictions.predictions(spark, d).where("model = 'talkie-base'").select(norm(F.col("target_word")).alias("target"), F.posexplode_outer("words").alias("pos", "w")).where("target <> '' and w is not null")
    proposals = p.groupBy("target", norm(F.col("w")).alias("word")).agg(F.min("pos").alias("pos"))
    return perturbation.substitutes(_judged(spark, d), proposals)


@query(f"""WITH {_NAMED}, x AS (SELECT model, is_future, route <> 'none' AS cued, k, CASE WHEN rank BETWEEN 1 AND k THEN 1 ELSE 0 END AS hit FROM nk, (VALUES (10), (100)) v(k) WHERE is_future IS NOT NULL AND route IS NOT NULL)
 SELECT model, is_future, CAST(cued AS INT) AS cued, CAST(k AS INT) AS k, count(*) AS n, round(avg(hit), 9) AS rate FROM x GROUP BY ALL""")
def q110_ladder_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 and at 100 with and without a cue, before and beyond the cutoff."""
    x = _decoded(spark, d).where("is_future is not null and route is not null").withColumn("k", F.explode(F.array(F.lit(10), F.lit(100))))
    hit = F.coalesce(F.col("rank").between(F.lit(1), F.col("k")), F.lit(False)).cast("int")
    return x.groupBy("model", "is_future", (F.col("route") != "none").cast("int").alias("cued"), "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 9).alias("rate"))


_LIVES = "len(list_filter([substring(target, CAST(i AS INT), 3) for i in range(1, length(target) - 1)], lambda g: contains(w, g))) > 0"


@query(f"""WITH RECURSIVE {_JUDGED}, {_ANSWERED}, tg AS (SELECT failure_id AS id, lower(trim(coalesce(target, ''), ' ')) AS target FROM judge_failures), sv AS (SELECT jk.id, count(*) AS named, count(*) FILTER (NOT (length(target) >= 3 AND length(w) >= 3 AND {_LIVES})) AS left_over FROM jk JOIN tg USING (id) GROUP BY jk.id)
 SELECT CAST(named AS INT) AS named, CAST(left_over AS INT) AS left_over, count(*) AS n FROM ja JOIN sv USING (id) GROUP BY named, left_over""")
def q111_survivors(spark: SparkSession, d: str) -> DataFrame:
    """How many of a judged group's members are left once the words that share a run with the target are taken out."""
    targets = table(spark, d, "judge_failures").select("failure_id", norm(F.col("target")).alias("target"))
    x = _answers(spark, d).where("how in ('object', 'list')").join(targets, "failure_id")
    words = F.transform(F.coalesce("words", F.array().cast("array<string>")), norm)
    x = x.withColumn("m", F.array_intersect(F.transform("members", norm), words)).where(F.size("m") > 0)
    left = F.filter("m", lambda w: ~shares_run(w, F.col("target"), 3))
    return x.groupBy(F.size("m").alias("named"), F.size(left).alias("left_over")).agg(F.count(F.lit(1)).alias("n"))
