"""Mixtures of sources by target weights, in tokens, with weighted sampling inside each source."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from glossarium.functions.canonical import canonical_form
from glossarium.plans.prefix import hashed_order, running_totals
from glossarium.sources.session import materialized, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """BIGINT: tokens of the text by a public tokenizer file; 0 for null and empty texts."""

    def count(texts: pd.Series) -> pd.Series:
        t = _tokenizer(tokenizer)
        out: list[int] = []
        values = texts.fillna("").tolist()
        for start in range(0, len(values), 256):
            out += [len(e.ids) for e in t.encode_batch_fast(values[start : start + 256], add_special_tokens=False)]
        return pd.Series(out)

    return F.pandas_udf(count, LongType())(text)


def source_key(text: Column) -> Column:
    """A source's name under any spelling: consistent characters, lower case, without blanks."""
    return F.regexp_replace(F.lower(canonical_form(text)), r"\s+", "")


def letter_share(text: Column) -> Column:
    """A quality weight in (0, 1]: the share of letters and blanks among the characters, 0.05 at least."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(kept / F.greatest(F.length(text), F.lit(1)), F.lit(0.05)))


def document_sizes(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens, quality), one row per document, computed once.  A null source stays null."""
    slim = spread(docs.select(docs[key].alias("doc"), docs[source].alias("source"), docs[text].alias("text")))
    sizes = slim.select("doc", source_key(F.col("source")).alias("source"), token_count(F.col("text"), tokenizer).alias("tokens"), letter_share(F.col("text")).alias("quality"))
    return materialized(sizes)


def mixture_plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(name, source, weight, max_repeat, tokens, budget, epochs, rest, short) for each target source.

    budget is weight x total, total being the tokens of all documents unless given.  epochs is the number of whole
    passes over the source, at most max_repeat; rest the tokens to take from one more pass where max_repeat allows it;
    short is true if the budget exceeds max_repeat passes.  A source without documents has 0 tokens and is short if its
    weight is above 0.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    if total is None:
        total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    t = targets.select(targets["source"].alias("name"), "weight", "max_repeat").withColumn("source", source_key(F.col("name")))
    plan = t.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long"))).withColumn("budget", F.col("weight") * F.lit(float(total)))
    most = F.col("max_repeat") * F.col("tokens")
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.col("max_repeat").cast("long"))).otherwise(F.lit(0).cast("long"))
    plan = plan.withColumns({"epochs": whole, "short": F.col("budget") > most})
    rest = F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens"))
    return plan.select("name", "source", "weight", "max_repeat", "tokens", "budget", "epochs", rest.alias("rest"), "short")


def _even_place(keyed: DataFrame) -> DataFrame:
    """keyed with `_place`: the share of the documents of its source that are expected before a document's key, which is
    1 - mean(exp(-key x quality)) over the source; qualities are taken in twenty steps, so that a source has one short
    row of them.  Low qualities, whose keys are large, are spread like others."""
    step = F.greatest(F.ceil(F.col("quality") * 20), F.lit(1)) / 20.0
    shares = keyed.groupBy("source", step.alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("w", "n")).alias("_w"), F.sum("n").alias("_n"))
    after = F.aggregate("_w", F.lit(0.0), lambda total, x: total + x["n"] * F.exp(-F.col("_order") * x["w"]))
    return keyed.join(shares, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_place", F.greatest(F.lit(0.0), 1 - after / F.col("_n"))).drop("_s", "_w", "_n")


def mixed_documents(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc, tokens, copies): how often each document is taken; documents taken no time give no row.

    Whole epochs come first.  The rest of a budget is filled by Efraimidis-Spirakis sampling: each document has an
    exponential key -ln(u) / quality, and documents are taken in the order of their keys as long as the tokens before
    them are fewer than the rest.  Running totals go over buckets of the key, so that a source of any size is spread over
    many tasks.  Documents of no target source, and of weight 0, aren't taken.
    """
    p = plan.select("name", "source", "epochs", "rest")
    chance = F.greatest(hashed_order("doc", seed=seed), F.lit(1e-18))
    keyed = sizes.where("tokens > 0").join(plan.select("source"), "source", "left_semi").withColumn("_order", -F.ln(chance) / F.col("quality"))
    ranked = running_totals(_even_place(keyed).select("source", "doc", "tokens", "_order", "_place"), ["source"], "_order", ["doc"], "tokens", place="_place")
    copies = F.col("epochs") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    rows = ranked.join(p, "source").withColumn("copies", copies).where("copies > 0")
    return rows.select(F.col("name").alias("source"), "doc", "tokens", "copies")


def mixture_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, weight, actual_share, tokens, budget, taken_tokens, short): the shares that the mixture really has, and
    whether what was taken of a source is less than its budget."""
    taken = mixed.groupBy(F.col("source").alias("name")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken_tokens"))
    rows = plan.drop("short").join(taken, "name", "left").withColumn("taken_tokens", F.coalesce("taken_tokens", F.lit(0).cast("long")))
    whole = rows.agg(F.sum("taken_tokens").alias("all_taken"))
    rows = rows.join(F.broadcast(whole))
    share = F.when(F.col("all_taken") > 0, F.col("taken_tokens") / F.col("all_taken")).otherwise(F.lit(0.0))
    return rows.select(F.col("name").alias("source"), "weight", share.alias("actual_share"), "tokens", "budget", "taken_tokens", (F.col("taken_tokens") < F.col("budget")).alias("short"))
