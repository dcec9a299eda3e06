"""Shared blocks, parts of words, screens, samples and exact intervals: against brute force and on odd input."""

import math

from pyspark.sql import functions as F

from glossarium.functions import stats
from glossarium.operators import forms, perturbation, records, sampling
from glossarium.plans.prefix import numbered

LISTS = [(1, ["Filter", "filters", "filtration", None, "x9"]), (2, None), (3, []), (4, ["", "a", "a"]), (5, ["chromosis", "thermosis", "thermology"])]


def blocks(words):
    ws = {w.strip().lower() for w in words or [] if w and w.strip().isalpha()}
    grams = {g for w in ws for k in range(2, 8) if k < len(w) for g in ("^" + w[:k], w[-k:] + "$")}
    return {(g, n) for g in grams if (n := sum(w.startswith(g[1:]) if g[0] == "^" else w.endswith(g[:-1]) for w in ws if len(w) >= len(g))) >= 2}


def test_carried_blocks(spark):
    df = spark.createDataFrame(LISTS, "id int, words array<string>").withColumn("gram", F.lit("clash"))
    got = {(r.id, r.gram, len(r.carriers)) for r in forms.carried_blocks(df).collect()}
    assert got == {(i, g, n) for i, ws in LISTS for g, n in blocks(ws)}
    assert forms.carried_blocks(df.limit(0)).count() == 0


def test_form_blocks(spark):
    df = spark.createDataFrame(LISTS, "id int, words array<string>")
    rates = spark.createDataFrame([("^filter", 2), ("^filt", 3), ("^thermo", 4), ("osis$", 5)], "gram string, n_words int")
    got = {r.id: r for r in forms.form_blocks(df, rates, 100_000).collect()}
    tail = lambda p: -math.log2(1 - (1 - p) ** 3)
    assert got[1].gram == "^filt" and got[1].n_carriers == 3 and abs(got[1].surprisal + math.log2(3e-5**3)) < 1e-3
    assert got[5].gram == "^thermo" and got[5].n_carriers == 2 and got[5].surprisal > tail(4e-5)
    assert set(got) == {1, 5}


def test_segments_and_kinds(spark):
    words = spark.createDataFrame([("hyperthermosis",), ("cat",), ("",), (None,), ("osis",)], "w string")
    got = {r.w: r.s for r in words.select("w", forms.segments(F.col("w")).alias("s")).collect()}
    assert set(got["hyperthermosis"]) == {"hyper", "thermosis", "osis", "hypertherm"} and not got["cat"] and not got[""] and not got["osis"]
    pairs = spark.createDataFrame([("filter", "filters", 6), ("cart", "cars", 3), ("chromosis", "thermosis", 5)], "a string, b string, run int")
    assert [r.k for r in pairs.select(forms.pair_kind(F.col("a"), F.col("b"), F.col("run")).alias("k")).collect()] == ["INFLECTION", "SINGLE_STEP", "SHARED"]
    x = spark.createDataFrame([("polygon", ["a", "polygamy"]), ("polygon", ["polygon"]), ("abc", ["xabcd"]), ("", ["word"]), ("polygon", None), ("gate", ["legate"])], "t string, ts array<string>")
    assert [r.k for r in x.select(forms.prompt_like(F.col("t"), F.col("ts")).alias("k")).collect()] == [True, False, False, False, False, True]


def test_screen(spark):
    lexicon = spark.createDataFrame([("engine", 10), ("motor", 12), ("wheel", 2000), ("crank", 9), ("lever", 9)], "word string, n long")
    pairs = spark.createDataFrame([("engine", w) for w in ("engine", "engin3", "engineer", "wagine", "motor", "wheel", "crank", "lever", "unseen", None)] + [(None, "motor")], "target string, word string")
    got = perturbation.screened(pairs.unionByName(pairs), lexicon)
    assert {r.word: r.reason for r in got.collect()} == {"engine": "same_stem", "engin3": "not_letters", "engineer": "same_stem", "wagine": "overlaps_target", "motor": "kept", "wheel": "frequency_band", "crank": "kept", "lever": "kept", "unseen": "not_attested"}
    assert [r.substitute for r in perturbation.substitutes(got).collect()] == ["crank"]


def test_nearest_by_frequency(spark):
    words = [("abcd", 5), ("abce", 5), ("abcf", 6), ("wxyz", 900), ("wxya", 30), ("long", 5_000_000)]
    counts = spark.createDataFrame(words, "word string, n long")
    got = {r.word: (r.substitute, r.gap) for r in perturbation.nearest_by_frequency(counts.select("word"), counts).collect()}
    step = {w: round(math.log10(n + 1) * 100) for w, n in words}
    want = {}
    for w in step:
        near = [(abs(step[c] - step[w]), c) for c in step if c[:3] != w[:3] and abs(step[c] - step[w]) <= 150]
        if near:
            want[w] = min(near)[::-1]
    assert got == want


def test_numbered_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i, i % 7) for i in range(500)], "g string, i long, clash int")
    got = numbered(df, ["g"], ["i"], F.floor(F.col("i") / 16), "n").collect()
    for g in ("hot", None):
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.i)] == list(range(1, sum(r.g == g for r in got) + 1))
    batches = records.once_per_batch(df, F.col("g"), "i", block=10).collect()
    assert len({(r.g, r.batch) for r in batches}) == 500
    assert numbered(df.limit(0), ["g"], ["i"], F.lit(0), "n").count() == 0


def test_item_samples(spark):
    df = spark.createDataFrame([(i, f"k{i % 40}" if i % 11 else None, "a" if i % 5 else "b", "x" if i % 2 else None) for i in range(400)], "id long, item string, cell string, part string")
    got = sampling.whole_items(df, "item", 5).groupBy("item").count().collect()
    full = {r.item: r["count"] for r in df.groupBy("item").count().collect()}
    assert len(got) == 5 and all(r["count"] == full[r.item] for r in got)
    quotas = spark.createDataFrame([("x", 6)], "part string, quota long")
    rows = sampling.with_backfill(df, ["cell"], "part", "id", quotas, 10).collect()
    for c in "ab":
        mine = [r for r in rows if r.cell == c]
        assert len(mine) == 10 and sum(r.filled == 0 and r.part == "x" for r in mine) == 6
    words = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, None), (3, [])], "id int, w array<string>").select(sampling.shuffled(F.col("w"), F.col("id")).alias("w")).collect()
    assert sorted(words[0].w) == ["a", "a", "b", "c"] and words[1].w is None and words[2].w == []


def test_exact_odds(spark):
    def tail(n, k, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))

    for b, c in ((10, 27), (1, 1), (3, 40), (200, 150)):
        low, high = (stats.exact_odds(b, c, up) for up in (False, True))
        assert abs(tail(b + c, b, low / (1 + low)) - 0.025) < 1e-9 and abs(1 - tail(b + c, b + 1, high / (1 + high)) - 0.025) < 1e-9
    assert stats.exact_odds(0, 5, False) == 0 and stats.exact_odds(5, 0, True) == math.inf and stats.exact_odds(0, 0, True) == math.inf
    assert 0.99 < stats.exact_odds(10**6, 10**6, False) < 1 < stats.exact_odds(10**6, 10**6, True) < 1.01
    got = spark.createDataFrame([(10, 27), (None, 3)], "b long, c long").select(stats.paired_odds_bound(F.col("b"), F.col("c"), False).alias("x")).collect()
    assert abs(got[0].x - stats.exact_odds(10, 27, False)) < 1e-12 and got[1].x is None
