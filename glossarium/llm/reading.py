"""Reading level of documents by a familiar-word formula calibrated on rated documents.

A text is read once.  Its words are stored in a compressed table, and what follows, the list of familiar words and the
formula's terms, is counted from that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_text
from glossarium.sources.session import materialized, spread, stored

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:['-][a-z]+)*")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_STOP = re.compile(r"[.!?…]['\"”’)\]]*\s+|[.!?…]['\"”’)\]]*$")
_ENDS = re.compile(r"[.!?;:,—–-][\"'”’)\]]*\s*$")
_AND_THEN = re.compile(r",?\s+and\s+then\s+")
# Sentences whose share of unfamiliar words is further from the middle one's are no part of the body; weights of the
# terms where no ratings are given.
_APART, UNFITTED = 0.4, (0.3, 3.0, 0.4)
_NUMBERS, _DIGIT = re.compile(r"^[\s0-9.()\-]+|[0-9]+"), re.compile("[0-9]")


def _line(text: str) -> str:
    return text if text[:1].isalpha() and not _DIGIT.search(text) else _NUMBERS.sub("", text).strip()


def sentences(text: str, boilerplate: frozenset[str] = frozenset()) -> list[list[str]]:
    """The words of each sentence, in lower case, without the lines of boilerplate.  A line that starts with a capital
    after one without an end mark is a sentence of its own, and main clauses strung together with 'and then' are counted
    apart, as a rater would."""
    return _parsed(text, boilerplate)[0]


def _parsed(text: str, boilerplate: frozenset[str]) -> tuple[list[list[str]], int]:
    """The sentences, and the number of words in the lines left out."""
    out, joined, dropped = [], "", 0
    if "-" in text:
        text = _BROKEN.sub("", text)
    find = (_ASCII_WORD if text.isascii() else _WORD).findall
    for line in [*text.replace("\r\n", "\n").split("\n"), ""]:
        line = line.strip()
        if line and boilerplate and _line(line) in boilerplate:
            dropped += len(find(line.lower()))
            line = ""
        if line:
            joined += (". " if joined and line[0].isupper() and not _ENDS.search(joined[-8:]) else " ") + line
        elif joined:
            for s in _STOP.split(joined.lower()):
                for clause in _AND_THEN.split(s) if " then " in s else (s,):
                    if words := find(clause):
                        out.append(words)
            joined = ""
    return out, dropped


def _lines(plain: Column) -> Column:
    """ARRAY<STRING>: the distinct lines of a text, without blanks around them and empty ones."""
    return F.filter(F.array_distinct(F.transform(F.split(plain, r"\s*\n\s*"), lambda v: F.trim(v))), lambda v: v != "")


def repeated_lines(texts: DataFrame, above: float = 0.004) -> DataFrame:
    """(line): lines, digits and numbering apart, that more than `above` of the distinct texts, and at least two, have:
    boilerplate.  Texts that differ in digits only are one.  Their number is bounded by the mean number of lines per text
    divided by `above`.

    A text of which such lines make up more than half is a copy of others with a line or two changed; it says nothing on
    what is boilerplate, and the lines are counted again without these texts."""
    rows = texts.select("doc", F.regexp_replace("text", r"(?m)^[\s0-9.()\-]+|[0-9]+", "").alias("plain"))
    rows = rows.select("doc", F.xxhash64("plain").alias("key"), _lines(F.col("plain")).alias("lines"))
    rows = rows.select("doc", "key", F.transform("lines", lambda v: F.struct(F.xxhash64(v).alias("id"), F.length(v).alias("chars"))).alias("ids"))
    once = materialized(rows).groupBy("key").agg(F.min_by(F.struct("doc", "ids"), "doc").alias("x")).select("key", "x.*")
    least = max(1.0, above * once.count())
    each = once.select("doc", "key", F.aggregate("ids", F.lit(0), lambda n, x: n + x["chars"]).alias("whole"), F.explode_outer("ids").alias("x")).select("doc", "key", "whole", "x.*")
    often = each.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select("id")
    held = each.join(F.broadcast(often), "id").groupBy("key", "whole", "doc").agg(F.sum("chars").alias("chars"), F.collect_list("id").alias("ids"))
    apart = held.where("2 * chars <= whole").select("doc", F.explode("ids").alias("id"))
    found = apart.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")).where(F.col("n") > least)
    found = materialized(found.select("id", "doc"))
    # one text that has each line, to read it from
    read = texts.join(F.broadcast(found.select("doc").distinct()), "doc", "left_semi").select(F.regexp_replace("text", r"(?m)^[\s0-9.()\-]+|[0-9]+", "").alias("plain"))
    line = read.select(F.explode_outer(_lines(F.col("plain"))).alias("line")).where("line is not null")
    return line.withColumn("id", F.xxhash64("line")).join(F.broadcast(found.select("id")), "id", "left_semi").select("line").distinct()


def parsed_texts(texts: DataFrame, boilerplate: set[str]) -> DataFrame:
    """(doc, n_words, length, words, sizes): the number of words of the whole text, and, of its body, the mean number of
    words in a sentence, all words, and the number of words of each sentence.  A text of boilerplate only is its body."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(boilerplate))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boiler = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                n_words, words, sizes, ends, cuts = [], [], [], [0], [0]
                for t in batch.column(1).to_pylist():
                    t = canonical_text(t)
                    body, dropped = _parsed(t, boiler)
                    n_words.append(dropped + sum(map(len, body)))
                    for s in body or _parsed(t, frozenset())[0]:
                        words += s
                        sizes.append(len(s))
                    ends.append(len(words))
                    cuts.append(len(sizes))
                count, sentences = np.diff(ends), np.diff(cuts)
                length = pa.array(count / np.maximum(sentences, 1), mask=sentences == 0)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string())), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(sizes, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), length, *lists], names=["doc", "n_words", "length", "words", "sizes"])

    return texts.mapInArrow(parse, f"doc {texts.schema['doc'].dataType.simpleString()}, n_words long, length double, words array<string>, sizes array<int>")


def word_frequencies(parsed: DataFrame, short: float, long: float) -> DataFrame:
    """(word, n_docs, n_short, n_long): in how many documents a word is, and in how many whose mean sentence has `short`
    words at most, or `long` at least.  Documents are counted by batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, length = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            words = pc.dictionary_encode(lists.flatten())
            if not len(words):
                continue
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            pair = np.unique(doc * len(words.dictionary) + words.indices.to_numpy())
            doc, word = pair // len(words.dictionary), pair % len(words.dictionary)
            n = [np.bincount(word, w, len(words.dictionary)).astype(np.int64) for w in (None, (length <= short)[doc], (length >= long)[doc])]
            yield pa.RecordBatch.from_arrays([words.dictionary, *map(pa.array, n)], names=["word", "n_docs", "n_short", "n_long"])

    counts = parsed.where("length is not null").select("length", "words").mapInArrow(count, "word string, n_docs long, n_short long, n_long long")
    return counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_short", "n_long")))


def familiar_words(parsed: DataFrame, share: float = 0.01) -> DataFrame:
    """(word, n_docs, n_short, n_long): the high-frequency list: words in at least `share` of all documents that are at
    least as frequent in the quarter with the shortest sentences as in that with the longest.  So terms that are frequent
    only because much of the corpus is learned stay out, whoever rated what.  The list has as many words at most as a
    document has different ones on average, divided by `share`."""
    with_words = parsed.where("length is not null")
    short, long = with_words.agg(F.percentile_approx("length", [0.25, 0.75], 10_000)).first()[0] or (0.0, 0.0)
    n = with_words.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("length") <= short).alias("short"), F.count_if(F.col("length") >= long).alias("long")).first()
    counts = word_frequencies(parsed, short, long).where(F.col("n_docs") >= share * n.docs)
    return counts.where(F.col("n_short") * F.lit(max(n.long, 1)) >= F.col("n_long") * F.lit(max(n.short, 1)))


def reading_features(parsed: DataFrame, familiar: set[str]) -> DataFrame:
    """(doc, n_words, unfamiliar, length): words of the whole text, and, of its body without inserted passages, the share
    of words outside the list and the mean number of words in a sentence.

    Inserted passages are told by being unlike the rest: sentences whose share of unfamiliar words is more than 0.4
    away from that of the middle word's sentence are left out.  Documents without words have nulls."""
    shared = parsed.sparkSession.sparkContext.broadcast(pa.array(sorted(familiar), pa.string()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = batch.column(2).flatten(), batch.column(3).flatten().to_numpy().astype(float)
            per_doc = pc.list_value_length(batch.column(3)).to_numpy()
            unfamiliar, length = np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            if len(sizes):
                new = pc.is_null(pc.index_in(words, value_set=shared.value)).to_numpy(zero_copy_only=False).astype(float)
                share = np.add.reduceat(new, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)) / sizes
                doc = np.repeat(np.arange(batch.num_rows), per_doc)
                order = np.lexsort((share, doc))
                total = np.bincount(doc, sizes, batch.num_rows)
                middle = np.searchsorted(np.cumsum(sizes[order]), np.cumsum(total) - total / 2)
                keep = (np.abs(share - share[order][np.minimum(middle, len(order) - 1)][doc]) <= _APART).astype(float)
                kept = np.bincount(doc, keep * sizes, batch.num_rows)
                with np.errstate(invalid="ignore", divide="ignore"):
                    unfamiliar, length = np.bincount(doc, keep * sizes * share, batch.num_rows) / kept, kept / np.bincount(doc, keep, batch.num_rows)
            none = per_doc == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unfamiliar, mask=none), pa.array(length, mask=none)], names=["doc", "n_words", "unfamiliar", "length"])

    kind = parsed.schema["doc"].dataType.simpleString()
    return parsed.select("doc", "n_words", "words", "sizes").mapInArrow(features, f"doc {kind}, n_words long, unfamiliar double, length double")


def _terms() -> list:
    """The formula's terms: 1, the share of unfamiliar words, and the logarithm of the mean sentence length."""
    return [F.lit(1.0), F.col("unfamiliar"), F.ln("length")]


def fitted_weights(features: DataFrame, ratings: DataFrame) -> list[float]:
    """Weights of _terms() by least squares over all rated documents; the sums are made on Spark, and only they reach the
    driver.  Where the ratings can't tell the terms apart, as without any, the weights are UNFITTED."""
    x = features.where("unfamiliar is not null").join(ratings, "doc")
    cols = [*_terms(), F.col("level")]
    s = iter(x.agg(*(F.coalesce(F.sum(p * q), F.lit(0.0)) for i, p in enumerate(cols) for q in cols[i:])).first())
    n = len(cols)
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            m[i, j] = m[j, i] = next(s)
    if np.linalg.matrix_rank(m[:-1, :-1]) < n - 1:
        return list(UNFITTED)
    return [float(w) for w in np.linalg.solve(m[:-1, :-1], m[:-1, -1])]


def _corpus(docs: DataFrame, key: str, text: str, lang: str, language: str) -> DataFrame:
    """parsed_texts() of the documents of a language, stored."""
    rows = docs.where(F.lower(docs[lang]).startswith(language))
    texts = spread(rows.select(rows[key].alias("doc"), rows[text].alias("text")).where("doc is not null and text is not null"))
    return stored(parsed_texts(texts, {canonical_text(r.line) for r in repeated_lines(texts).collect()}))


def corpus_words(docs: DataFrame, key: str, text: str, lang: str, language: str = "en") -> DataFrame:
    """familiar_words() of the documents of a language."""
    return familiar_words(_corpus(docs, key, text, lang, language))


def reading_levels(docs: DataFrame, key: str, text: str, lang: str, ratings: DataFrame, language: str = "en") -> DataFrame:
    """(key, n_words, unfamiliar, length, score, level) of each document whose lang starts with `language` in any case.

    The score is a weighted sum of the share of unfamiliar words and the logarithm of the mean sentence length, and level
    is the score rounded to 1..5.  Boilerplate and the list of familiar words come from document frequencies over all
    documents of the language, the weights from all ratings: (doc, level), several ratings of a document being averaged.
    Null keys and texts give no row; a text without words has a null score and level; repeated keys each give their rows;
    further columns are ignored.
    """
    parsed = _corpus(docs, key, text, lang, language)
    mean = ratings.select("doc", "level").dropna().groupBy("doc").agg(F.avg("level").alias("level"))
    features = materialized(reading_features(parsed, {r.word for r in familiar_words(parsed).collect()}))
    score = sum((F.lit(w) * t for w, t in zip(fitted_weights(features, mean), _terms())), F.lit(0.0))
    level = F.when(F.col("score").isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), F.round("score").cast("int"))))
    return features.withColumn("score", score).withColumn("level", level).withColumnRenamed("doc", key)
