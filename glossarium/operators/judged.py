"""Answers of a judge: reading the list of words out of whatever was logged, and holding the group to its definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.text import inflects, norm
from glossarium.operators.neighborhood import component_labels


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def balanced_blocks(text: Column) -> Column:
    """ARRAY<STRING>: for each opening brace the text up to the brace that closes it; braces never closed give nothing.
    The pieces between closing braces are counted, not the characters."""
    parts = F.split(text, r"\{")
    last = F.size(parts) - 1

    def block(k: Column) -> Column:
        rest = F.array_join(F.slice(parts, k + 1, F.greatest(last - k + 1, F.lit(1))), "{")
        pieces = F.split(rest, r"\}")
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("at"))
        step = lambda s, p: F.struct((s["depth"] + _count(p, "{") - 1).alias("depth"), (s["seen"] + 1).alias("seen"), F.when((s["at"] == 0) & (s["depth"] + _count(p, "{") == 1), s["seen"] + 1).otherwise(s["at"]).alias("at"))
        # what follows the last closing brace closes nothing
        at = F.aggregate(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)["at"]
        return F.when(at > 0, F.concat(F.lit("{"), F.array_join(F.slice(pieces, 1, at), "}"), F.lit("}")))

    blocks = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), block)
    return F.when(last > 0, F.filter(blocks, lambda b: b.isNotNull())).otherwise(F.array().cast("array<string>"))


def parsed_answers(log: DataFrame, raw: str, field: str) -> DataFrame:
    """log with `members` ARRAY<STRING> and `how`: the list that an answer holds under `field`.

    how is 'object' where a balanced block is JSON with such a list, also after other words or inside a fence; 'list'
    where only a bare list in square brackets is found, of which the words of letters count; and otherwise, with null
    members, 'empty_text', 'truncated_json' (an opening brace but no closing one) or 'unparseable'."""
    text = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"^\s+|\s+$", "")
    lists = F.transform(balanced_blocks(text), lambda b: F.try_variant_get(F.try_parse_json(b), f"$.{field}", "array<string>"))
    bare = F.regexp_extract(text, r"\[([^\[\]]*)\]", 1)
    words = F.filter(F.transform(F.split(bare, ","), lambda w: F.regexp_replace(w, r"""^[\s"']+|[\s"']+$""", "")), lambda w: w.rlike(r"^\p{L}+$"))
    x = log.withColumn("_text", text).withColumn("_object", F.get(F.filter(lists, lambda v: v.isNotNull()), F.lit(0))).withColumn("_list", words)
    broken = F.when(F.col("_text") == "", "empty_text").when(F.contains("_text", F.lit("{")) & ~F.contains("_text", F.lit("}")), "truncated_json").otherwise("unparseable")
    how = F.when(F.col("_object").isNotNull(), "object").when(F.size("_list") > 0, "list").otherwise(broken)
    members = F.coalesce("_object", F.when(F.size("_list") > 0, F.col("_list")))
    return x.withColumns({"members": members, "how": how}).drop("_text", "_object", "_list")


def judged_groups(lists: DataFrame) -> DataFrame:
    """lists (id, words, members) with `judged_n`, the members that are words of the list, and `form_n`, the size of what
    is left of them: the largest set of them in one component of the list's shared runs, 0 for one word, and 0 where all
    are inflections of one word.  Of equal sets the one named first counts; a member named twice counts once; null lists
    and members give 0."""
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.transform(F.coalesce("words", none), norm))
    members = F.filter(F.array_distinct(F.transform(F.coalesce("members", none), norm)), lambda m: F.array_contains(words, m))
    x = lists.withColumn("_w", words).withColumn("_m", members).withColumn("_labels", component_labels(F.col("_w")))
    x = x.withColumn("_of", F.transform("_m", lambda m: F.get(F.col("_labels"), (F.array_position("_w", m) - 1).cast("int"))))
    sizes = F.transform(F.array_distinct("_of"), lambda l: F.struct(F.size(F.filter("_of", lambda o: o == l)).alias("n"), (-F.array_position("_of", l)).alias("first"), l.alias("label")))
    x = x.withColumn("_best", F.when(F.size("_m") > 0, F.array_max(sizes)))
    x = x.withColumn("_g", F.coalesce(F.filter("_m", lambda m, i: F.get(F.col("_of"), i) == F.col("_best")["label"]), none))
    lexemes = F.exists("_g", lambda a: F.exists("_g", lambda b: (a != b) & ~inflects(a, b)))
    form_n = F.when(lexemes, F.size("_g")).otherwise(0)
    return x.withColumns({"judged_n": F.size("_m"), "form_n": form_n}).drop("_w", "_m", "_labels", "_of", "_best", "_g")


def size_agreement(sizes: DataFrame, bounds: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """(measure, judge, cheap, agreement) of two sizes `form_n` and `cheap_n` of the same lists: equal, within one, mean
    difference, and, for each bound, the shares of lists that reach it and on which both agree."""
    a, b = F.col("form_n"), F.col("cheap_n")
    share = lambda c: F.avg(c.cast("int"))
    rows = [("exact", F.avg(a), F.avg(b), share(a == b)), ("within_1", F.avg(a), F.avg(b), share(F.abs(a - b) <= 1))]
    rows += [(f"form >= {k}", share(a >= k), share(b >= k), share((a >= k) == (b >= k))) for k in bounds]
    g = sizes.agg(F.array(*(F.struct(F.lit(n).alias("measure"), j.alias("judge"), c.alias("cheap"), s.alias("agreement")) for n, j, c, s in rows)).alias("x"))
    return g.select(F.explode("x").alias("x")).select("x.*")


def size_lifts(sizes: DataFrame, bounds: tuple[int, ...] = (2, 3, 5)) -> DataFrame:
    """(model, k, n_with, n_without, judge_with, judge_without, judge_lift, cheap_lift): shares of lists whose size
    reaches k, with and without a cue in the prompt, and the ratio of the two for both sizes; null where nothing reaches
    it without.  sizes: (model, cued BOOLEAN, form_n, cheap_n)."""
    long = sizes.withColumn("k", F.explode(F.array(*map(F.lit, bounds))))
    share = lambda c, cued: F.avg(F.when(F.col("cued") == cued, (F.col(c) >= F.col("k")).cast("int")))
    g = long.groupBy("model", "k").agg(F.count_if("cued").alias("n_with"), F.count_if(~F.col("cued")).alias("n_without"), *(share(c, v).alias(f"{n}_{'with' if v else 'without'}") for c, n in (("form_n", "judge"), ("cheap_n", "cheap")) for v in (True, False)))
    lift = lambda n: F.when(F.col(f"{n}_without") > 0, F.col(f"{n}_with") / F.col(f"{n}_without"))
    return g.select("model", "k", "n_with", "n_without", "judge_with", "judge_without", lift("judge").alias("judge_lift"), lift("cheap").alias("cheap_lift"))
