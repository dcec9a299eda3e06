"""Classifying each predicted word against the target, and groups of words of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.text import common_run, edit_share, inflects, norm, shares_run

# Endings that make a family of words, and edit and affix bounds of the sibling rule.
SUFFIXES = ("ation", "ator", "icity", "ology", "olysis", "ometer", "ometry", "ograph", "ographer", "omorph", "ogen", "osis", "oid", "ase", "ane", "ine", "ite", "ism", "on", "ol")
THETA, MIN_AFFIX, STEM_CHARS = 0.34, 3, 5
MIN_RUN = 3


def longest_of(word: Column, endings: tuple[str, ...], left: int = 0) -> Column:
    """The longest of the endings that the word has and that leaves at least `left` letters; empty if none does."""
    out = F.lit("")
    for s in sorted(endings, key=len):
        out = F.when(F.endswith(word, F.lit(s)) & (F.length(word) >= len(s) + left), s).otherwise(out)
    return out


def longest_suffix(word: Column) -> Column:
    """The longest known ending that leaves at least two letters; empty if none does."""
    return longest_of(word, SUFFIXES, 2)


def neighbor_label(target: Column, word: Column, stop: Column) -> Column:
    """EMPTY, SELF, FILLER (a stop word), STEM (same first letters, or few edits), AFFIX (same ending) or DISTANT."""
    stem = (F.length(target) > STEM_CHARS) & (F.left(target, F.lit(STEM_CHARS)) == F.left(word, F.lit(STEM_CHARS))) | (edit_share(target, word) <= THETA)
    ending = longest_suffix(target)
    affix = (F.length(ending) >= MIN_AFFIX) & F.endswith(word, ending)
    return F.when(word == "", "EMPTY").when(word == target, "SELF").when(stop, "FILLER").when(stem, "STEM").when(affix, "AFFIX").otherwise("DISTANT")


def labelled_neighbors(rows: DataFrame, lexicon: DataFrame, stop_docs: float = 0.5, attested_docs: int = 3) -> DataFrame:
    """(row_id, model, rank, pos, target, word, label, novelty) of each predicted word.

    lexicon: (word, n_docs, all_docs).  Words in more than stop_docs of the documents are stop words; siblings (STEM and
    AFFIX) in at least attested_docs documents are attested, others coined.  Rows without a target or words give nothing.
    """
    target = norm(F.col("target_word"))
    x = rows.select("row_id", "model", "rank", target.alias("target"), F.posexplode_outer("words").alias("pos", "w")).where("target <> '' and w is not null")
    x = x.select("row_id", "model", "rank", "pos", "target", norm(F.col("w")).alias("word")).join(lexicon, "word", "left")
    stop = F.coalesce(F.col("n_docs") > stop_docs * F.col("all_docs"), F.lit(False))
    x = x.withColumn("label", neighbor_label(F.col("target"), F.col("word"), stop))
    novelty = F.when(F.col("label").isin("STEM", "AFFIX"), F.when(F.col("n_docs") >= attested_docs, "attested").otherwise("coined")).otherwise("")
    return x.select("row_id", "model", "rank", (F.col("pos") + 1).alias("pos"), "target", "word", "label", novelty.alias("novelty"))


def profiles(labelled: DataFrame) -> DataFrame:
    """Counts of labels for each list, and its outcome: hit, comp-near-miss (a coined sibling), retr-near-miss (an
    attested one), distant-miss or filler-miss."""
    is_ = lambda v: F.count_if(F.col("label") == v)
    g = labelled.groupBy("row_id", "model", "rank").agg(is_("STEM").alias("n_stem"), is_("AFFIX").alias("n_affix"), is_("FILLER").alias("n_filler"), is_("DISTANT").alias("n_distant"), F.count_if(F.col("novelty") == "coined").alias("n_coined"), F.greatest(F.count_if(~F.col("label").isin("EMPTY", "SELF")), F.lit(1)).alias("scored"))
    outcome = F.when(F.coalesce(F.col("rank").between(1, 100), F.lit(False)), "hit").when(F.col("n_coined") > 0, "comp-near-miss").when(F.col("n_stem") + F.col("n_affix") > 0, "retr-near-miss").when(F.col("n_distant") >= F.col("n_filler"), "distant-miss").otherwise("filler-miss")
    return g.withColumn("filler_share", F.col("n_filler") / F.col("scored")).withColumn("outcome", outcome)


def flag_kind(target: Column, word: Column, attested: Column) -> Column:
    """How an unattested word differs from the target: ORTHOGRAPHIC, INFLECTION or DERIVATIONAL.  attested is an
    ARRAY<STRING> of attested words among the bases that the word's endings leave."""
    far = (F.length(word) >= F.length(target) + 2) & F.endswith(word, target)
    close = (F.abs(F.length(word) - F.length(target)) <= 2) & (F.levenshtein(word, target) <= 2) & ~far
    part = (F.length(word) >= 5) & (F.startswith(word, target) | F.startswith(target, word))
    return F.when(word.rlike(r"[^\x00-\x7F]") | close | part, "ORTHOGRAPHIC").when(F.size(attested) > 0, "INFLECTION").otherwise("DERIVATIONAL")


def overlap_pairs(lists: DataFrame) -> DataFrame:
    """(id, a, b, run): pairs of words of one list that share a run of at least MIN_RUN characters, a before b in the
    alphabet.  lists: (id, words ARRAY<STRING>), ten or so words each; pairs are formed inside the row, and runs are found
    once per distinct pair of words."""
    words = F.array_sort(F.array_distinct(F.filter(F.transform("words", norm), lambda w: F.length(w) >= MIN_RUN)))
    later = lambda i: F.slice("w", i + 2, F.greatest(F.size("w") - i - 1, F.lit(0)))
    linked = F.flatten(F.transform("w", lambda a, i: F.transform(later(i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = lists.select("id", words.alias("w")).select("id", F.explode_outer(linked).alias("p")).where("p is not null").select("id", "p.a", "p.b")
    runs = pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).where(shares_run(F.col("a"), F.col("b"), MIN_RUN)).select("a", "b", common_run(F.col("a"), F.col("b")).alias("run"))
    return pairs.join(runs, ["a", "b"]).select("id", "a", "b", "run")


def component_labels(words: Column) -> Column:
    """ARRAY<INT>: for each word of a short list, the smallest place in its component of the graph whose edges are
    shared runs, found by spreading labels inside the row, as many rounds as a chain of all words takes; words under
    MIN_RUN letters stand alone."""
    n = F.size(words)
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    linked = lambda i, j: (i == j) | (F.length(F.get(words, i)) >= MIN_RUN) & (F.length(F.get(words, j)) >= MIN_RUN) & shares_run(F.get(words, i), F.get(words, j), MIN_RUN)
    near = F.transform(places, lambda i: F.filter(places, lambda j: linked(i, j)))
    spread = lambda acc, _: F.struct(acc["near"].alias("near"), F.transform(acc["near"], lambda js: F.array_min(F.transform(js, lambda j: F.get(acc["labels"], j)))).alias("labels"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.struct(near.alias("near"), places.alias("labels")), spread)["labels"]


def form_groups(lists: DataFrame) -> DataFrame:
    """(id, form_n, members): size and sorted members of the largest component of words that share runs; 0 where no two
    words are linked, or where all are inflections of one word.  Of equal components, the one that starts first counts.
    Null and empty lists give 0."""
    words = F.array_distinct(F.transform(F.coalesce("words", F.array().cast("array<string>")), norm))
    x = lists.select("id", words.alias("words")).withColumn("labels", component_labels(F.col("words")))
    sizes = F.transform(F.array_distinct("labels"), lambda l: F.struct(F.size(F.filter("labels", lambda m: m == l)).alias("n"), (-l).alias("first")))
    x = x.withColumn("best", F.when(F.size("words") > 0, F.array_max(sizes)))
    members = F.filter("words", lambda w, i: F.get(F.col("labels"), i) == -F.col("best")["first"])
    x = x.withColumn("members", F.when(F.col("best")["n"] >= 2, F.array_sort(members)).otherwise(F.array().cast("array<string>")))
    lexemes = F.exists("members", lambda a: F.exists("members", lambda b: (a != b) & ~inflects(a, b)))
    return x.select("id", F.when(lexemes, F.size("members")).otherwise(0).alias("form_n"), F.when(lexemes, F.array_join("members", "|")).otherwise("").alias("members"))


def letter_words(words: DataFrame) -> DataFrame:
    """(w): the distinct words of letters, at least four of them."""
    return words.select(norm(F.col("word")).alias("w")).where(F.col("w").rlike(r"^\p{L}{4,}$")).distinct()


def edge_ngrams(words: DataFrame, shortest: int = 2, longest: int = 7, n: int | None = None) -> DataFrame:
    """(gram, n_words, surprisal): in how many distinct words each ending ('$') and beginning ('^') of 2 to 7 letters
    occurs, and -log2 of its share.  Words of letters with at least four of them count; a word must be two letters
    longer than the part.  n: the number of such words, counted here if it isn't known."""
    w = letter_words(words)
    n = w.count() if n is None else n
    parts = w.withColumn("k", F.explode(F.sequence(F.lit(shortest), F.lit(longest)))).where(F.length("w") > F.col("k") + 1)
    grams = parts.select(F.explode(F.array(F.concat(F.lit("^"), F.left("w", "k")), F.concat(F.right("w", "k"), F.lit("$")))).alias("gram"))
    g = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_words"))
    return g.withColumn("surprisal", -F.log2(F.col("n_words") / F.lit(float(max(n, 1)))))


def inner_ngrams(words: DataFrame, shortest: int = 2, longest: int = 7) -> DataFrame:
    """(gram, n_words): in how many distinct words each part of 2 to 7 letters occurs at any place, the edges included,
    written with '~'; the words of edge_ngrams()."""
    w = letter_words(words)
    parts = lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - k + 1, F.lit(1))), lambda i: F.substring("w", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.flatten(F.array(*(parts(k) for k in range(shortest, longest + 1)))))
    return w.select(F.explode_outer(grams).alias("gram")).where("gram is not null").groupBy(F.concat(F.lit("~"), F.col("gram")).alias("gram")).agg(F.count(F.lit(1)).alias("n_words"))


def top_overlaps(pairs: DataFrame, most: int = 24) -> DataFrame:
    """(id, place, a, b, run): the pairs of overlap_pairs() with the longest runs of each list, `most` at most, ties by
    the alphabet; a list of ten words has 45 pairs at most."""
    best = pairs.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("run")).alias("r"), "a", "b"))), 1, most).alias("x"))
    return best.select("id", F.posexplode("x").alias("at", "x")).select("id", (F.col("at") + 1).alias("place"), "x.a", "x.b", (-F.col("x.r")).alias("run"))
