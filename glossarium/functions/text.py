"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(word: Column) -> Column:
    """The word without outer blanks, in lower case; null becomes the empty text."""
    return F.lower(F.trim(F.coalesce(word, F.lit(""))))


def lenient_int(value: Column) -> Column:
    """INT of a number written as text ('1943', '1943.0'); null for empty, 'None' and other texts."""
    number = F.nullif(F.trim(value), F.lit("None")).try_cast("double")
    return F.when(~F.isnan(number), F.floor(number).try_cast("int"))


def prefix_before(text: Column, target: Column) -> Column:
    """The text before the last occurrence of the target, in any case and also inside a word, without blanks at its end;
    the whole text, if the target doesn't occur or is empty.  Null only for a null text."""
    low, word = F.lower(text), F.lower(F.trim(F.coalesce(target, F.lit(""))))
    tail = F.length(F.call_function("substring_index", low, word, F.lit(-1)))
    cut = F.when((word != "") & F.contains(low, word), F.substring(text, F.lit(1), F.length(low) - tail - F.length(word))).otherwise(text)
    return F.regexp_replace(cut, r"\s+$", "")


def letter_tokens(text: Column) -> Column:
    """ARRAY<STRING>: the runs of ASCII letters, in lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), F.lower)


def char_ngrams(word: Column, n: int) -> Column:
    """ARRAY<STRING> of the distinct character n-grams; empty for shorter words."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
    return F.when(F.length(word) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def shares_run(a: Column, b: Column, n: int = 3) -> Column:
    """True if both words have a run of n characters in common."""
    return F.arrays_overlap(char_ngrams(a, n), char_ngrams(b, n))


def common_run(a: Column, b: Column) -> Column:
    """INT: length of the longest run of characters that both words have.  Lengths are tried from 1 on, and none after
    the first that isn't there."""
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(a) - n + 1, F.lit(1)))
    longer = lambda run, n: F.when((run == n - 1) & (n <= F.length(a)) & F.exists(starts(n), lambda i: F.contains(b, F.substring(a, i, n))), n).otherwise(run)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0), longer)


def run_text(a: Column, b: Column, run: Column) -> Column:
    """The run of that many characters that both words have, of several the one that stands first in a; empty for 0."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(a) - run + 1, F.lit(1)))
    return F.when(run > 0, F.substring(a, F.get(F.filter(starts, lambda i: F.contains(b, F.substring(a, i, run))), F.lit(0)), run)).otherwise("")


def run_place(word: Column, run: Column) -> Column:
    """Where the run stands in the word: start (which wins), end or middle; null for an empty run."""
    return F.when(run == "", None).when(F.startswith(word, run), "start").when(F.endswith(word, run), "end").otherwise("middle")


def edit_share(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty words."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def inflects(a: Column, b: Column) -> Column:
    """True if the longer word is the shorter one with s, es, ed or ing, also after a dropped e."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    stem = F.when(F.endswith(short, F.lit("e")), F.substring(short, F.lit(1), F.length(short) - 1))
    endings = ("s", "es", "ed", "ing")
    forms = [F.concat(short, F.lit(e)) for e in endings] + [F.coalesce(F.concat(stem, F.lit(e)), F.lit("")) for e in endings]
    return (a != b) & long.isin(*forms)


def item_key(*parts: Column) -> Column:
    """A key by content: the first 12 hexadecimal digits of the MD5 of the parts."""
    return F.substring(F.md5(F.concat_ws("␟", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12)


def mask_parts(text: Column, mask: str = "[MASK]") -> tuple[Column, Column]:
    """(what stands before the first mask, what stands after it); both null where there is no mask, or no text."""
    at = F.instr(text, mask)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)), F.when(at > 0, F.substring(text, at + len(mask), F.length(text)))


# Endings of inflected words, in the order in which they are tried.
ENDINGS = ("ings", "ing", "edly", "ed", "es", "s", "ly", "er", "est")


def inflection(word: Column) -> Column:
    """The first of ENDINGS that the word has and that leaves three letters or more; empty if none does."""
    out = F.lit("")
    for e in reversed(ENDINGS):
        out = F.when(F.endswith(word, F.lit(e)) & (F.length(word) >= len(e) + 3), e).otherwise(out)
    return out


def inflected(word: Column, ending: Column) -> Column:
    """ARRAY<STRING>, each once: how the word may look with the ending, the likeliest first: before a vowel without its
    final e, plain, and with its last consonant doubled; with s or es plain, with es, and with ies for a final y."""
    stem = F.substring(word, F.lit(1), F.length(word) - 1)
    dropped = F.when(F.endswith(word, F.lit("e")), F.concat(stem, ending))
    doubled = F.when(word.rlike("[^aeiou][aeiou][^aeiouwxy]$"), F.concat(word, F.right(word, F.lit(1)), ending))
    ies = F.when(word.rlike("[^aeiou]y$"), F.concat(stem, F.lit("ies")))
    vowel = F.array(dropped, F.concat(word, ending), doubled)
    forms = F.when(ending.isin("ing", "ings", "ed", "er", "est"), vowel).when(ending.isin("s", "es"), F.array(F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), ies)).otherwise(F.array(F.concat(word, ending)))
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull()))
