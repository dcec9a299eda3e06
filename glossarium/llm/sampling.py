"""Samples whose category shares match given targets, by swap repair over category signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.functions.spelling import parts_key, plain_key
from glossarium.plans.prefix import hashed_order, running_totals


def _random_start(left: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n records drawn at random from what is left of each signature, however many there are: draws that fall on an
    exhausted signature are drawn again from the others."""
    taken = np.zeros_like(left)
    while n > 0:
        rest = left - taken
        draw = np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        taken, n = taken + draw, n - int(draw.sum())
    return taken


def deviation(taken: np.ndarray, wanted: np.ndarray, targets: np.ndarray) -> float:
    """Sum, over all targets, of how far the records that count for it are from those wanted."""
    return float(np.abs(targets @ (taken - wanted)).sum())


def repaired_counts(available: np.ndarray, low: np.ndarray, wanted: np.ndarray, size: int, targets: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """How many records of each signature the sample has.

    targets: a row for each target and a column for each signature, 1 where the signature's records count for it; by
    default one target for each signature.  Starts from a random sample that satisfies the floors `low`.  Then counts are
    exchanged, records of one signature for as many of another, the exchange that lowers the deviation most first, by
    steps that are halved down to one record, until none lowers it.
    """
    targets = np.eye(len(available)) if targets is None else targets
    low = np.minimum(available, low)
    left = available - low
    taken = low + _random_start(left, int(min(max(size - low.sum(), 0), left.sum())), np.random.default_rng(seed))
    step = 1 << int(max(taken.max(initial=0), 1)).bit_length()
    while step and len(taken):
        gap = targets @ (taken - wanted)
        give, get = np.flatnonzero(taken - low >= step), np.flatnonzero(available - taken >= step)
        best, pair = -1e-9, None
        for a in give:
            after = np.abs((gap - step * targets[:, a])[:, None] + step * targets[:, get]).sum(0) - np.abs(gap).sum()
            after[get == a] = 0
            if len(after) and after.min() < best:
                best, pair = after.min(), (a, get[int(after.argmin())])
        if pair is None:
            step //= 2
        else:
            taken[pair[0]] -= step
            taken[pair[1]] += step
    return taken


def cell_supply(records: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with what each cell needs and has: `wanted` (share x sample_size), `needed` (the greater of wanted and
    min_rows) and `available` (distinct entity keys of the cell).

    records: (entity, model_key, grade_key, is_future); a row that lacks one of the three belongs to no cell.
    """
    cells = records.dropna(subset=["model_key", "grade_key", "is_future"]).groupBy("model_key", "grade_key", "is_future", "entity").count()
    counts = cells.groupBy("model_key", "grade_key", "is_future").agg(F.count(F.lit(1)).alias("available"))
    wanted = F.col("share") * F.col("sample_size")
    t = targets.withColumns({"model_key": plain_key(F.col("model")), "grade_key": parts_key(F.col("grade")), "wanted": wanted, "needed": F.greatest(wanted, F.col("min_rows").cast("double"))})
    t = t.join(counts, ["model_key", "grade_key", "is_future"], "left")
    return t.withColumn("available", F.coalesce("available", F.lit(0).cast("long")))


_CATEGORIES = ["model_key", "grade_key", "is_future"]


def _quota(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(_CATEGORIES, ignore_index=True)
    available, floors = pdf.available.to_numpy(np.int64), pdf.min_rows.fillna(0).to_numpy(np.int64)
    low = np.where(pdf.available < pdf.needed, available, np.minimum(floors, available))
    # a signature counts for its cell and for the share of its model, its grade and its is_future
    targets = np.concatenate([np.eye(len(pdf)), *(pd.get_dummies(pdf[c]).to_numpy(float).T for c in _CATEGORIES)])
    pdf["taken"] = repaired_counts(available, low, pdf.wanted.to_numpy(float), int(pdf.sample_size.iloc[0]), targets)
    return pdf[["target_set", "model", "grade", "is_future", "model_key", "grade_key", "share", "min_rows", "wanted", "needed", "available", "taken"]]


_QUOTA = "target_set string, model string, grade string, is_future int, model_key string, grade_key string, share double, min_rows int, wanted double, needed double, available long, taken long"


def sample_quotas(supply: DataFrame) -> DataFrame:
    """supply with `taken`, the records each cell gives to the sample of its target_set: all it has where that is less
    than it needs, and otherwise as many as keep the cells, and the shares of each model, grade and is_future, nearest to
    what is asked for.  Only counts of cells meet in a group here: as many rows as the target_set has cells."""
    return supply.groupBy("target_set").applyInPandas(_quota, _QUOTA)


def proportional_sample(records: DataFrame, supply: DataFrame, seed: int = 0) -> DataFrame:
    """(target_set, model, grade, is_future, entity): the sample of each target_set, drawn at random inside each cell.

    Records come once per entity and cell.  A cell that cannot supply its share gives all it has, and others fill in;
    quotas and shortfalls are in sample_quotas().  Cells of any size are spread over many tasks.
    """
    cells = records.dropna(subset=["model_key", "grade_key", "is_future"]).groupBy("model_key", "grade_key", "is_future", "entity").agg(F.lit(1).alias("one"))
    quotas = sample_quotas(supply).select("target_set", "model", "grade", "is_future", "model_key", "grade_key", "taken")
    drawn = cells.join(quotas, ["model_key", "grade_key", "is_future"]).withColumn("_order", hashed_order("target_set", "entity", seed=seed))
    ranked = running_totals(drawn, ["target_set", "model_key", "grade_key", "is_future"], "_order", ["entity"], "one")
    return ranked.where("before < taken").select("target_set", "model", "grade", "is_future", "entity")


def sample_report(sample: DataFrame, supply: DataFrame) -> DataFrame:
    """supply with what the sample really has of each cell: `reached` records, their share of the sample, how far that is
    from the share asked for, and `short`, whether the cell gave all it has and that is less than it needs."""
    cell = ["target_set", "model", "grade", "is_future"]
    counts = sample.groupBy(*cell).agg(F.count(F.lit(1)).alias("reached"))
    whole = counts.groupBy("target_set").agg(F.sum("reached").alias("drawn"))
    x = supply.join(counts, cell, "left").join(whole, "target_set", "left").withColumn("reached", F.coalesce("reached", F.lit(0).cast("long")))
    got = F.when(F.col("drawn") > 0, F.col("reached") / F.col("drawn")).otherwise(F.lit(0.0))
    short = (F.col("reached") < F.col("needed")) & (F.col("reached") >= F.col("available"))
    return x.select(*cell, "share", "min_rows", "wanted", "needed", "available", "reached", got.alias("reached_share"), (got - F.col("share")).alias("off"), short.alias("short"))


def margin_report(report: DataFrame) -> DataFrame:
    """(target_set, category, value, share, reached_share, off): the same for each model, grade and is_future."""
    values = F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in ("model", "grade", "is_future")))
    g = report.select("target_set", F.explode(values).alias("v"), "share", "reached_share").groupBy("target_set", "v.category", "v.value")
    return g.agg(F.sum("share").alias("share"), F.sum("reached_share").alias("reached_share")).withColumn("off", F.col("reached_share") - F.col("share"))
