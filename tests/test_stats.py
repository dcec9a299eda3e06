import math

import pytest
from pyspark.sql import functions as F

from glossarium.functions import stats

TABLES = [((27, 96, 94, 2638), (591, 306, 1102, 1388), 1.177, 3.24, 18.70), ((16, 27, 105, 2707), (355, 95, 1338, 1599), 1.230, 3.42, 11.06)]


@pytest.mark.parametrize("post,past,lam,odds,g", TABLES)
def test_three_way_interaction(spark, post, past, lam, odds, g):
    df = spark.createDataFrame([(*post, *past)], "a int, b int, c int, d int, e int, f int, g int, h int")
    p, q = [F.col(c) for c in "abcd"], [F.col(c) for c in "efgh"]
    r = df.select((stats.log_odds_ratio(p) - stats.log_odds_ratio(q)).alias("l"), stats.three_way_g_squared(p, q).alias("g")).first()
    assert r.l == pytest.approx(lam, abs=0.005) and math.exp(r.l) == pytest.approx(odds, abs=0.01) and r.g == pytest.approx(g, abs=0.05)


def test_small_counts(spark):
    df = spark.createDataFrame([(5, 0, 3, 9), (0, 0, 4, 4)], "a int, b int, c int, d int")
    c = [F.col(x) for x in "abcd"]
    rows = df.select(*stats.haldane(c), stats.g_squared(c).alias("g"), stats.log_odds_ratio(c).alias("l")).collect()
    assert tuple(rows[0])[:4] == (5.5, 0.5, 3.5, 9.5) and rows[1].g == 0 and math.isfinite(rows[1].l)


def test_paired_and_intervals(spark):
    df = spark.createDataFrame([(31, 7), (0, 0), (0, 5)], "b long, c long")
    b, c = F.col("b"), F.col("c")
    rows = df.select(stats.paired_log_ratio(b, c).alias("l"), stats.exact_binomial(b, c).alias("p"), stats.wilson(b, b + c, False).alias("lo"), stats.wilson(b, b + c, True).alias("hi")).collect()
    exact = min(1.0, 2 * sum(math.comb(38, i) for i in range(8)) / 2**38)
    assert rows[0].l == pytest.approx(math.log(31 / 7)) and rows[0].p == pytest.approx(exact)
    assert rows[1].p == 1.0 and rows[1].lo is None and rows[2].p == pytest.approx(2 / 32) and 0 <= rows[0].lo < 31 / 38 < rows[0].hi <= 1


def test_stars(spark):
    df = spark.createDataFrame([(0.4,), (4.5,), (7.0,), (18.7,)], "g double")
    assert [r[0] for r in df.select(stats.stars(F.col("g"))).collect()] == ["", "*", "**", "***"]
