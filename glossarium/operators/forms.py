"""Blocks of letters that the words of a list share at their edges, parts of words, and what survives an edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.stats import upper_tail
from glossarium.functions.text import inflects, norm
from glossarium.operators.neighborhood import SUFFIXES

# Beginnings that count as parts of words, and the bits from which a shared block is no accident.
PREFIXES = ("un", "in", "im", "non", "anti", "de", "dis", "pre", "post", "pro", "re", "sub", "super", "hyper", "hypo", "micro", "macro", "over", "under", "meta", "inter", "intra", "trans", "counter", "semi", "mono", "poly", "tele", "auto", "bio", "geo", "hydro", "electro", "photo")
MIN_BITS = 14.92


def edge_blocks(words: Column, shortest: int = 2, longest: int = 7) -> Column:
    """ARRAY<STRING>, sorted: beginnings ('^') and endings ('$') of each word, which must be longer than the block."""
    lengths = F.array(*(F.lit(k) for k in range(shortest, longest + 1)))
    fit = lambda w: F.filter(lengths, lambda k: k < F.length(w))
    both = F.transform(words, lambda w: F.concat(F.transform(fit(w), lambda k: F.concat(F.lit("^"), F.left(w, k))), F.transform(fit(w), lambda k: F.concat(F.right(w, k), F.lit("$")))))
    return F.array_sort(F.flatten(both))


def carries(word: Column, gram: Column) -> Column:
    begins = F.startswith(gram, F.lit("^")) & F.startswith(word, F.substring(gram, F.lit(2), F.length(gram)))
    ends = F.endswith(gram, F.lit("$")) & F.endswith(word, F.left(gram, F.length(gram) - 1))
    return (F.length(word) >= F.length(gram)) & (begins | ends)


def carried_blocks(lists: DataFrame) -> DataFrame:
    """(id, words, gram, carriers): edge blocks that at least two words of a list carry.  lists: (id, words), ten or so
    words each; only words of letters count, each once.  Found inside the row: equal blocks are neighbours once sorted.
    Null and empty lists, and lists without a shared block, give nothing."""
    words = F.filter(F.array_distinct(F.transform("words", norm)), lambda w: w.rlike(r"^\p{L}+$"))
    x = lists.select("id", words.alias("words")).withColumn("blocks", edge_blocks(F.col("words")))
    shared = F.array_distinct(F.filter("blocks", lambda g, i: g == F.get(F.col("blocks"), i + 1)))
    x = x.select("id", "words", F.explode_outer(shared).alias("gram")).where("gram is not null")
    return x.withColumn("carriers", F.filter("words", lambda w: carries(w, F.col("gram"))))


def form_blocks(lists: DataFrame, rates: DataFrame, n_words: int) -> DataFrame:
    """(id, gram, n_carriers, surprisal): the block of each list that most words carry and that is no accident: by the
    share of all words with that block, so many carriers among the list's words surprise by MIN_BITS or more.  Carriers
    that are inflections of one word don't count.  Ties go to the higher surprisal and the earlier block.

    rates: (gram, n_words) over n_words distinct words.  Tails are computed once per (list length, carriers, rate)."""
    x = carried_blocks(lists).where(F.exists("carriers", lambda a: F.exists("carriers", lambda b: (a != b) & ~inflects(a, b))))
    x = x.select("id", "gram", F.size("words").alias("n"), F.size("carriers").alias("k")).join(rates, "gram")
    cases = x.select("n", "k", "n_words").distinct()
    tail = upper_tail(F.col("k"), F.col("n"), F.col("n_words") / F.lit(float(max(n_words, 1))))
    cases = cases.withColumn("surprisal", F.round(-F.log2(F.greatest(tail, F.lit(1e-300))), 6)).where(F.col("surprisal") >= MIN_BITS)
    best = x.join(cases, ["n", "k", "n_words"]).groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("k"), (-F.col("surprisal")).alias("s"), "gram")).alias("b"))
    return best.select("id", "b.gram", (-F.col("b.k")).alias("n_carriers"), (-F.col("b.s")).alias("surprisal"))


def pair_kind(a: Column, b: Column, run: Column) -> Column:
    """INFLECTION, SINGLE_STEP (all but one letter of the shorter word is shared) or SHARED."""
    return F.when(inflects(a, b), "INFLECTION").when(F.least(F.length(a), F.length(b)) - run < 2, "SINGLE_STEP").otherwise("SHARED")


def _longest(word: Column, parts: tuple[str, ...], test) -> Column:
    out = F.lit("")
    for p in sorted(parts, key=len):
        out = F.when(test(word, F.lit(p)) & (F.length(word) > len(p) + 2), p).otherwise(out)
    return out


def segments(word: Column) -> Column:
    """ARRAY<STRING>, each once: the longest known beginning and what follows it, and the longest known ending of three
    letters or more and what precedes it; empty for words without either."""
    first, last = _longest(word, PREFIXES, F.startswith), _longest(word, tuple(s for s in SUFFIXES if len(s) >= 3), F.endswith)
    none = F.array().cast("array<string>")
    head = F.when(first != "", F.array(first, F.substring(word, F.length(first) + 1, F.length(word)))).otherwise(none)
    tail = F.when(last != "", F.array(last, F.left(word, F.length(word) - F.length(last)))).otherwise(none)
    return F.array_distinct(F.concat(head, tail))


def prompt_like(target: Column, tokens: Column) -> Column:
    """True if a prompt word of four letters or more, other than the target, shares four letters in a row with it or
    its last three."""
    last = lambda w: (F.length(target) > 3) & F.endswith(w, F.right(target, F.lit(3)))
    starts = F.when(F.length(target) >= 4, F.sequence(F.lit(1), F.length(target) - 3)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.substring(target, i, F.lit(4)))
    like = lambda w: (w != target) & (F.length(w) >= 4) & (last(w) | F.exists(grams, lambda g: F.contains(w, g)))
    return F.coalesce(F.exists(tokens, like), F.lit(False))


def length_band(word: Column) -> Column:
    n = F.length(word)
    return F.when(n < 7, "<7").when(n <= 8, "7-8").when(n <= 10, "9-10").when(n <= 12, "11-12").otherwise("13+")
