"""Edits of a prompt: substituting a word, deleting the clauses that hold it, and checking that an edit is clean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.stats import exact_binomial, paired_log_ratio
from glossarium.functions.text import letter_tokens, shares_run

MIN_CHARS, MIN_SHARE = 40, 0.6


def whole_word(word: Column) -> Column:
    """A pattern that finds the word, in any case, not inside another word."""
    return F.concat(F.lit(r"(?iU)\b\Q"), word, F.lit(r"\E\b"))


def substituted(text: Column, word: Column, by: Column) -> Column:
    """The text with each occurrence of the whole word replaced; an initial capital is kept."""
    big, small = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word))), F.lower(word)
    capital = F.concat(F.upper(F.left(by, F.lit(1))), F.substring(by, F.lit(2), F.length(by)))
    at = lambda w: F.concat(F.lit(r"(?U)\b\Q"), w, F.lit(r"\E\b"))
    return F.regexp_replace(F.regexp_replace(text, at(big), capital), at(small), by)


def without_clauses(text: Column, word: Column) -> Column:
    """The text without the clauses, between commas and semicolons, that hold the word."""
    kept = F.filter(F.split(text, r"[,;]\s*"), lambda c: ~F.contains(F.lower(c), F.lower(word)))
    return F.array_join(kept, ", ")


def is_subsequence(inner: Column, outer: Column) -> Column:
    """True if all elements of one array occur in the other in the same order: one walk over the outer array."""
    met = F.aggregate(outer, F.lit(0), lambda i, w: F.when(F.get(inner, i) == w, i + 1).otherwise(i))
    return met == F.size(inner)


def without_evidence(df: DataFrame, text: str, evidence: Column, word: Column) -> DataFrame:
    """df with `deleted` and `how`: the text without what recruits the word, which is the phrase quoted as evidence where
    the text has it verbatim, and otherwise the parts between commas, semicolons, colons, 'and' and 'but' that hold the
    word.  An edit that leaves less than 40 characters or 60 % of the text is none: null and 'no_clean_deletion'.  Null
    evidence is never found."""
    t = F.col(text)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kept = lambda c: F.coalesce((F.length(c) >= MIN_CHARS) & (F.length(c) >= MIN_SHARE * F.length(t)), F.lit(False))
    # each step is a column of its own, so that no expression is copied into the next
    x = df.withColumn("_quote", F.trim(evidence)).withColumn("_at", F.instr(F.lower(t), F.lower("_quote")))
    phrase = F.when((F.col("_quote") != "") & (F.col("_at") > 0), squeeze(F.concat(F.substring(t, F.lit(1), F.col("_at") - 1), F.substring(t, F.col("_at") + F.length("_quote"), F.length(t)))))
    parts = F.split(F.regexp_replace(t, r"([,;:]|\band\b|\bbut\b)", "\u0001$1\u0001"), "\u0001")
    rest = squeeze(F.array_join(F.filter(parts, lambda p: ~F.rlike(p, whole_word(word))), ""))
    x = x.withColumns({"_phrase": phrase, "_rest": rest})
    x = x.withColumn("how", F.when(kept(F.col("_phrase")), "evidence_phrase").when(kept(F.col("_rest")) & (F.col("_rest") != t), "clause_fallback").otherwise("no_clean_deletion"))
    return x.withColumn("deleted", F.when(F.col("how") == "evidence_phrase", F.col("_phrase")).when(F.col("how") == "clause_fallback", F.col("_rest"))).drop("_quote", "_at", "_phrase", "_rest")


def deletion_status(before: Column, after: Column, word: Column) -> Column:
    """The first reason against a deletion: donor_survives, punctuation_artifact, empty, not_a_subsequence (words that
    were put in or moved), too_much_removed; or ok."""
    low = F.contains(F.lower(after), F.lower(word))
    short = (F.length(after) < MIN_CHARS) | (F.length(after) < MIN_SHARE * F.length(before))
    moved = ~is_subsequence(letter_tokens(after), letter_tokens(before))
    return F.when(low, "donor_survives").when(after.rlike("[,;:][A-Za-z]"), "punctuation_artifact").when(after == "", "empty").when(moved, "not_a_subsequence").when(short, "too_much_removed").otherwise("ok")


def doubles_a_word(text: Column) -> Column:
    """True if a word stands twice in a row, in any case."""
    return text.rlike(r"(?iU)\b(\w+)\s+\1\b")


def placebo_words(rows: DataFrame, lexicon: DataFrame, stop_docs: float = 0.5) -> DataFrame:
    """(row_id, placebo): the word of a prompt that an edit beside the donor replaces: a known word of four letters or
    more that is no stop word, isn't the donor and shares no three letters in a row with donor or target; of these the
    one nearest to the donor in log10 frequency, ties by the alphabet.  rows: (row_id, target, donor, prefix);
    lexicon: (word, n_docs, all_docs)."""
    words = F.array_distinct(F.filter(letter_tokens(F.col("prefix")), lambda w: (F.length(w) >= 4) & (w != F.col("donor"))))
    x = rows.select("row_id", "target", "donor", F.explode_outer(words).alias("word")).where("word is not null")
    x = x.where(~shares_run(F.col("word"), F.col("target")) & ~shares_run(F.col("word"), F.col("donor")))
    known = lexicon.select("word", F.col("n_docs").alias("_n")).where(F.col("_n") <= stop_docs * lexicon["all_docs"])
    x = x.join(known, "word").join(lexicon.select(F.col("word").alias("donor"), F.col("n_docs").alias("_d")), "donor", "left")
    gap = F.round(F.abs(F.log10(F.col("_n") + 1) - F.log10(F.coalesce("_d", F.lit(0)) + 1)), 9)
    return x.groupBy("row_id").agg(F.min(F.struct(gap.alias("gap"), "word")).alias("b")).select("row_id", F.col("b.word").alias("placebo"))


def edit_arms(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(row_id, arm, word, edited, status), three rows for each prompt with a donor: the donor substituted by the word
    nearest in frequency, the donor deleted with what holds it, and, as the placebo that tells what any edit does, an
    unrelated word substituted.  Edits that aren't clean have a null text and their reason as status, others 'ok'.

    rows: (row_id, target, donor, prefix); lexicon: (word, n_docs, all_docs)."""
    x = rows.join(placebo_words(rows, lexicon), "row_id", "left")
    words = x.select(F.explode(F.array("donor", "placebo")).alias("word")).where("word is not null").distinct()
    near = nearest_by_frequency(words, lexicon.select("word", F.col("n_docs").alias("n"))).select("word", "substitute")
    for c in ("donor", "placebo"):
        x = x.join(near.select(F.col("word").alias(c), F.col("substitute").alias(f"for_{c}")), c, "left")
    for c in ("donor", "placebo"):
        x = x.withColumn(f"with_{c}", substituted(F.col("prefix"), F.col(c), F.col(f"for_{c}")))
    x = without_evidence(x, "prefix", F.lit(None).cast("string"), F.col("donor"))

    def reason(word: str) -> Column:
        by = F.col(f"for_{word}")
        return F.when(F.col(word).isNull(), "no_candidate").when(by.isNull(), "no_substitute").when(shares_run(by, F.col("target")), "overlaps_target").when(doubles_a_word(F.col(f"with_{word}")), "adjacent_duplicate").otherwise("ok")

    found = F.when(F.col("deleted").isNull(), F.col("how")).otherwise(deletion_status(F.col("prefix"), F.col("deleted"), F.col("donor")))
    x = x.withColumns({"_s": reason("donor"), "_d": found, "_p": reason("placebo")})
    arm = lambda name, word, text, status: F.struct(F.lit(name).alias("arm"), F.col(word).alias("word"), F.when(F.col(status) == "ok", F.col(text)).alias("edited"), F.col(status).alias("status"))
    arms = F.array(arm("donor_substituted", "donor", "with_donor", "_s"), arm("donor_deleted", "donor", "deleted", "_d"), arm("placebo", "placebo", "with_placebo", "_p"))
    return x.select("row_id", F.explode_outer(arms).alias("a")).select("row_id", "a.*")


def arm_effects(read: DataFrame) -> DataFrame:
    """(arm, n, before, after, lost, gained, lambda, p): what the clean edits of each arm do to recall, with the paired
    log ratio and exact test of losses against gains.  read: (arm, before BOOLEAN, after BOOLEAN)."""
    b, a = F.col("before"), F.col("after")
    g = read.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(b).alias("before"), F.count_if(a).alias("after"), F.count_if(b & ~a).alias("lost"), F.count_if(~b & a).alias("gained"))
    return g.withColumn("lambda", paired_log_ratio(F.col("lost"), F.col("gained"))).withColumn("p", exact_binomial(F.col("lost"), F.col("gained")))


def arm_against_placebo(read: DataFrame) -> DataFrame:
    """(arm, n, both_lost, arm_only, placebo_only, lambda, p): prompts that were recalled before, with a clean edit in the
    arm and in the placebo: how many lose the target by both, by the arm alone and by the placebo alone.
    read: (row_id, arm, before BOOLEAN, after BOOLEAN); row_id is unique inside an arm."""
    of = read.groupBy("row_id").agg(F.collect_list(F.struct("arm", "before", (F.col("before") & ~F.col("after")).alias("lost"))).alias("arms"))
    x = of.withColumn("beside", F.get(F.filter("arms", lambda a: a["arm"] == "placebo"), F.lit(0))).where("beside is not null")
    x = x.select("beside", F.explode_outer(F.filter("arms", lambda a: a["arm"] != "placebo")).alias("a")).where("a is not null")
    both, a, b = F.col("a.before") & F.col("beside.before"), F.col("a.lost"), F.col("beside.lost")
    g = x.groupBy("a.arm").agg(F.count_if(both).alias("n"), F.count_if(both & a & b).alias("both_lost"), F.count_if(both & a & ~b).alias("arm_only"), F.count_if(both & ~a & b).alias("placebo_only"))
    return g.withColumn("lambda", paired_log_ratio(F.col("arm_only"), F.col("placebo_only"))).withColumn("p", exact_binomial(F.col("arm_only"), F.col("placebo_only")))


def screened(pairs: DataFrame, lexicon: DataFrame, band: float = 1.5) -> DataFrame:
    """pairs (target, word) with `gap` and `reason`, the first of: not_letters, same_stem, overlaps_target (three letters
    in a row), not_attested, frequency_band (log10 frequencies further apart than band) or kept.

    lexicon: (word, n).  A target that isn't in it counts as 0.  Each pair is judged once; null words give nothing."""
    x = pairs.select("target", "word").where("target is not null and word is not null").distinct()
    x = x.join(lexicon.select("word", F.col("n").alias("_n")), "word", "left").join(lexicon.select(F.col("word").alias("target"), F.col("n").alias("_t")), "target", "left")
    gap = F.round(F.abs(F.log10(F.coalesce("_n", F.lit(0)) + 1) - F.log10(F.coalesce("_t", F.lit(0)) + 1)), 9)
    t, w = F.col("target"), F.col("word")
    stem = (t == w) | (F.length(t) > 5) & (F.left(t, F.lit(5)) == F.left(w, F.lit(5)))
    reason = F.when(~w.rlike(r"^\p{L}+$"), "not_letters").when(stem, "same_stem").when(shares_run(t, w, 3), "overlaps_target").when(F.col("_n").isNull(), "not_attested").when(gap > band, "frequency_band").otherwise("kept")
    return x.select("target", "word", gap.alias("gap"), reason.alias("reason"))


def substitutes(judged: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(target, substitute, gap): the kept word nearest in frequency, ties by the alphabet.

    proposals: (target, word, pos).  A target with proposals takes the first of them that was kept, and none if none
    was: what was proposed in context isn't replaced by what is merely as frequent."""
    kept = judged.where("reason = 'kept'")
    best = kept.groupBy("target").agg(F.min(F.struct("gap", "word")).alias("b")).select("target", F.col("b.word").alias("substitute"), "b.gap")
    if proposals is None:
        return best
    first = proposals.join(kept, ["target", "word"]).groupBy("target").agg(F.min(F.struct("pos", "word", "gap")).alias("b")).select("target", F.col("b.word").alias("substitute"), "b.gap")
    return first.unionByName(best.join(proposals.select("target").distinct(), "target", "left_anti"))


def nearest_by_frequency(words: DataFrame, counts: DataFrame, band: int = 150) -> DataFrame:
    """(word, substitute, gap): for each word the one of the same length nearest to it in log10 frequency, in hundredths
    and within the band, ties by the alphabet; a substitute begins with other three letters than the word.

    Each step of frequency keeps its first word and the first that begins otherwise, so that one of the two serves any
    word; words of the same length, step and beginning are looked up once, over at most 2 x band + 1 steps."""
    level = F.round(F.log10(F.col("n") + 1) * 100).cast("int")
    c = counts.select(F.col("word").alias("cand"), F.length("word").alias("len"), level.alias("step"))
    firsts = c.groupBy("len", "step", F.left("cand", F.lit(3)).alias("head")).agg(F.min("cand").alias("cand"))
    steps = firsts.groupBy("len", "step").agg(F.slice(F.array_sort(F.collect_list("cand")), 1, 2).alias("cands"))
    w = words.join(counts, "word").select("word", F.length("word").alias("len"), level.alias("level"), F.left("word", F.lit(3)).alias("head"))
    # the steps of a length are joined by length and block of steps, so that no key holds all steps of a length
    block = lambda c: F.floor(c / F.lit(band))
    asked = w.select("len", "level", "head").distinct().withColumn("_block", F.explode(F.array(*(block(F.col("level")) + k for k in (-1, 0, 1)))))
    cand = F.get(F.filter("cands", lambda v: F.left(v, F.lit(3)) != F.col("head")), F.lit(0))
    near = asked.join(steps.withColumn("_block", block(F.col("step"))), ["len", "_block"]).where(F.abs(F.col("step") - F.col("level")) <= band)
    near = near.select("len", "level", "head", F.abs(F.col("step") - F.col("level")).alias("gap"), cand.alias("cand")).where("cand is not null")
    best = near.groupBy("len", "level", "head").agg(F.min(F.struct("gap", "cand")).alias("b"))
    return w.join(best, ["len", "level", "head"]).select("word", F.col("b.cand").alias("substitute"), F.col("b.gap").alias("gap"))
