"""Words of the prompt that share form with the target, and what they do to recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.spelling import named_parts
from glossarium.functions.text import common_run, edit_share, letter_tokens, norm
from glossarium.operators.predictions import hit

GRADES = ("STEM+AFFIX", "STEM", "AFFIX", "NONE")
STEM_CHARS, AFFIX_CHARS, MIN_DONOR, PREFIX_CHARS = 5, 4, 4, 320


def grade_of(has_stem: Column, has_affix: Column) -> Column:
    return F.when(has_stem & has_affix, "STEM+AFFIX").when(has_stem, "STEM").when(has_affix, "AFFIX").otherwise("NONE")


def with_donors(rows: DataFrame) -> DataFrame:
    """rows (target, prefix, ...) with tokens, the sorted stem and affix donors among the prefix's words (`stems`,
    `affixes`), the distance in words from the last donor to the end (-1: none), grade and route.

    A stem donor has the target's first five letters or is contained in it or holds it; an affix donor has its last
    four.  Words under four letters and the target itself are no donors.  A stem makes the route paradigmatic, an affix
    alone syntagmatic.
    """
    t = F.col("target")
    x = rows.withColumn("tokens", letter_tokens(F.col("prefix"))).withColumn("_words", F.array_distinct(F.filter("tokens", lambda w: (w != t) & (F.length(w) >= MIN_DONOR))))
    stem = lambda w: (F.length(t) > STEM_CHARS) & (F.left(t, F.lit(STEM_CHARS)) == F.left(w, F.lit(STEM_CHARS))) | (F.length(t) >= MIN_DONOR) & (F.contains(t, w) | F.contains(w, t))
    affix = lambda w: (F.length(t) > AFFIX_CHARS) & (F.right(t, F.lit(AFFIX_CHARS)) == F.right(w, F.lit(AFFIX_CHARS)))
    x = x.withColumns({"stems": F.array_sort(F.filter("_words", stem)), "affixes": F.array_sort(F.filter("_words", affix))})
    last = F.array_max(F.transform("tokens", lambda w, i: F.when(F.array_contains("stems", w) | F.array_contains("affixes", w), i).otherwise(-1)))
    x = x.withColumn("distance", F.when(F.coalesce(last, F.lit(-1)) < 0, -1).otherwise(F.size("tokens") - last).cast("int")).drop("_words")
    grade = grade_of(F.size("stems") > 0, F.size("affixes") > 0)
    route = F.when(F.size("stems") > 0, "paradigmatic").when(F.size("affixes") > 0, "syntagmatic").otherwise("none")
    return x.withColumns({"grade": grade, "route": route})


def donors(rows: DataFrame) -> DataFrame:
    """(row_id, target, stem_donors, affix_donors, distance, grade) of rows (row_id, target, prefix); see with_donors()."""
    return with_donors(rows).select("row_id", "target", F.array_join("stems", "|").alias("stem_donors"), F.array_join("affixes", "|").alias("affix_donors"), "distance", "grade")


def locality(distance: Column) -> Column:
    """How far the last donor is from the end of the prompt, in words."""
    return F.when(distance < 0, "none").when(distance <= 5, "<=5").when(distance <= 15, "6-15").otherwise(">15")


def prompt_words(prefix: Column, target: Column) -> Column:
    """ARRAY<STRING>: the distinct words of four letters or more among the prompt's last 320 characters, but the target."""
    return F.array_distinct(F.filter(letter_tokens(F.right(prefix, F.lit(PREFIX_CHARS))), lambda w: (w != target) & (F.length(w) >= MIN_DONOR)))


def overlap_table(rows: DataFrame) -> DataFrame:
    """(row_id, word, run, share): words of the prompt's last 320 characters that share a run of three letters with the
    target or are within the edit share, measured once per distinct pair.  rows: (row_id, target, prefix)."""
    x = rows.select("row_id", "target", F.explode_outer(prompt_words(F.col("prefix"), F.col("target"))).alias("word")).where("word is not null and target <> ''")
    pairs = x.select("target", "word").distinct().withColumn("run", common_run(F.col("word"), F.col("target"))).withColumn("share", edit_share(F.col("word"), F.col("target")))
    return x.join(pairs.where("run >= 3 or share <= 0.34"), ["target", "word"]).select("row_id", "target", "word", "run", "share")


def recall_ladder(key: DataFrame) -> DataFrame:
    """Number, hits and hit rate by model, grade (however it is spelled) and is_future; key: (model, grade, is_future,
    rank).  Rows that lack one of the three are left out."""
    x = key.select("model", named_parts(F.col("grade"), GRADES).alias("grade"), "is_future", hit(F.col("rank"), 100).alias("hit")).dropna()
    return x.groupBy("model", "grade", "is_future").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"))


def moderators(key: DataFrame) -> DataFrame:
    """(moderator, value, n, rate): hit rates by route, locality, ending rarity among syntagmatic items, and overall,
    from one pass by grouping sets."""
    x = key.select("route", "locality", F.when(F.col("route") == "syntagmatic", F.col("ending_rarity")).alias("rarity"), hit(F.col("rank"), 100).alias("hit"))
    g = x.groupingSets([["route"], ["locality"], ["rarity"], []], "route", "locality", "rarity").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("rate"), F.grouping_id().alias("gid"))
    name = F.when(F.col("gid") == 3, "route").when(F.col("gid") == 5, "locality").when(F.col("gid") == 6, "rarity").otherwise("all")
    rows = g.select(name.alias("moderator"), F.coalesce("route", "locality", "rarity").alias("value"), "n", "rate")
    return rows.where("moderator = 'all' or value is not null")


def with_attempts(rows: DataFrame) -> DataFrame:
    """rows (target, prefix, words, ...) with the predicted words that vary the target's form, sorted: `echoes` stand in
    the prompt too, `attempts` don't."""
    t = F.col("target")
    x = rows.withColumn("_tokens", letter_tokens(F.col("prefix"))).withColumn("_w", F.array_distinct(F.transform("words", norm)))
    like = lambda w: (w != t) & (F.length(w) >= MIN_DONOR) & ((F.length(t) > STEM_CHARS) & (F.left(t, F.lit(STEM_CHARS)) == F.left(w, F.lit(STEM_CHARS))) | (edit_share(w, t) <= 0.34))
    x = x.withColumn("_form", F.filter("_w", like))
    echo = F.array_sort(F.filter("_form", lambda w: F.array_contains("_tokens", w)))
    attempt = F.array_sort(F.filter("_form", lambda w: ~F.array_contains("_tokens", w)))
    return x.withColumns({"attempts": attempt, "echoes": echo}).drop("_tokens", "_w", "_form")


def attempts_and_echoes(rows: DataFrame) -> DataFrame:
    """Number and list of attempts and echoes of rows (row_id, target, prefix, words); see with_attempts()."""
    lists = ((f"n_{c}", F.size(c), c, F.array_join(c, "|")) for c in ("attempts", "echoes"))
    return with_attempts(rows).select("row_id", *(x for n, size, c, joined in lists for x in (size.alias(n), joined.alias(c))))


def composition(rows: DataFrame) -> DataFrame:
    """rows (target, prefix, words, ...) with the grade of the prompt, and whether the predictions vary the target's form:
    `strict` by words that the prompt doesn't have, `loose` also by those it has."""
    x = with_attempts(with_donors(rows))
    strict, echoed = F.size("attempts") > 0, F.size("echoes") > 0
    return x.withColumns({"strict": strict.cast("int"), "loose": (strict | echoed).cast("int")})


def composition_cells(rows: DataFrame) -> DataFrame:
    """(model, is_future, grade, hit, n, strict, loose): shares of predictions that vary the target's form, by grade and
    is_future (hit is null) and for hits and misses apart, in one pass by grouping sets."""
    g = rows.groupingSets([["model", "is_future", "grade"], ["model", "is_future", "grade", "hit"]], "model", "is_future", "grade", "hit")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("strict").alias("strict"), F.avg("loose").alias("loose"))


def composition_accounts(rows: DataFrame) -> DataFrame:
    """(model, hits, scaffolded, strict, loose, strict_share, loose_share): of the hits beyond the cutoff, those whose
    prompt has a donor, and those among them whose predictions vary the target's form, also as shares of all hits."""
    post = (F.col("is_future") == 1) & (F.col("hit") == 1)
    scaffolded = post & (F.col("grade") != "NONE")
    g = rows.groupBy("model").agg(F.count_if(post).alias("hits"), F.count_if(scaffolded).alias("scaffolded"), *(F.count_if(scaffolded & (F.col(c) == 1)).alias(c) for c in ("strict", "loose")))
    share = lambda c: (F.col(c) / F.greatest("hits", F.lit(1))).alias(f"{c}_share")
    return g.select("model", "hits", "scaffolded", "strict", "loose", share("strict"), share("loose"))
