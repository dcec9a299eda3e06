import json
import random

import pytest
from pyspark.sql import functions as F

from glossarium.functions import text
from glossarium.operators import neighborhood, perturbation, predictions, records, sampling
from glossarium.plans.prefix import hashed_order, running_totals
from glossarium.streaming.labels import compacted, daily_counts, label_stream, labels_at


def test_recall_and_leakage(spark):
    df = spark.createDataFrame([("m", 0, 1), ("m", 0, -1), ("m", 1, 5), ("z", 0, None), ("z", 1, 3)], "model string, is_future int, rank int")
    r = {x.model: x for x in predictions.recall_and_leakage(df).where("k = 10").collect()}
    assert (r["m"].recall, r["m"].leakage, r["m"].normalised) == (0.5, 1.0, 2.0)
    assert r["z"].recall == 0 and r["z"].normalised == float("inf")


def test_prefix_before(spark):
    cases = [("A cat sat on a cat.", "cat", "A cat sat on a"), ("no hit  ", "x", "no hit"), ("Concat", "CAT", "Con"), ("abc", "", "abc"), ("abc", None, "abc"), (None, "a", None), ("", "a", "")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, w string")
    assert [r[0] for r in df.select(text.prefix_before(F.col("t"), F.col("w"))).collect()] == [c[2] for c in cases]


def test_common_run_against_brute_force(spark):
    random.seed(3)
    pairs = [("".join(random.choices("abc", k=random.randint(0, 8))), "".join(random.choices("abc", k=random.randint(0, 8)))) for _ in range(200)]
    brute = lambda a, b: max([0, *(j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b)])
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.common_run(F.col("a"), F.col("b")).alias("n"), text.shares_run(F.col("a"), F.col("b")).alias("s"))
    assert all(r.n == brute(r.a, r.b) and r.s == (brute(r.a, r.b) >= 3) for r in df.collect())


@pytest.mark.parametrize("words,n", [(["filter", "filters"], 0), (["filter"], 0), ([], 0), (None, 0), (["filter", "filtration", "house"], 2), (["filter", "filters", "filtration"], 3), (["ab", "ab"], 0)])
def test_form_groups(spark, words, n):
    assert neighborhood.form_groups(spark.createDataFrame([(1, words)], "id int, words array<string>")).first().form_n == n


def test_form_groups_against_union_find(spark):
    random.seed(5)
    lists = [["".join(random.choices("abcd", k=random.randint(2, 6))) for _ in range(random.randint(0, 10))] for _ in range(60)]
    got = {r.id: r.members for r in neighborhood.form_groups(spark.createDataFrame(list(enumerate(lists)), "id int, words array<string>")).collect()}
    for i, ws in enumerate(lists):
        ws = list(dict.fromkeys(ws))
        grams = [{w[k : k + 3] for k in range(len(w) - 2)} for w in ws]
        label = list(range(len(ws)))
        for _ in ws:
            label = [min(label[j] for j in range(len(ws)) if j == i_ or grams[i_] & grams[j]) for i_ in range(len(ws))]
        best = max(((label.count(l), -l) for l in set(label)), default=(0, 0))
        members = sorted(w for w, l in zip(ws, label) if l == -best[1]) if best[0] >= 2 else []
        if got[i]:
            assert got[i] == "|".join(members)
        else:
            assert len(members) < 2 or all(a == b or _inflects(a, b) for a in members for b in members)


def _inflects(a, b):
    lo, hi = sorted((a, b), key=len)
    return hi in {lo + e for e in ("s", "es", "ed", "ing")} or lo.endswith("e") and hi in {lo[:-1] + e for e in ("s", "es", "ed", "ing")}


def test_running_totals(spark):
    random.seed(2)
    rows = [(random.choice("ab") if random.random() > 0.2 else None, i, random.choice([None, 1, 5])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, size int").withColumn("o", hashed_order("id"))
    got = running_totals(df, ["g"], "o", ["id"], "size", rows_per_bucket=20).collect()
    assert len(got) == 500
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.id)):
            assert r.before == total
            total += r["size"] or 0
    assert running_totals(df.limit(0), ["g"], "o", ["id"], "size").count() == 0


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("c"))
    got = sampling.stratified(df, ["c"], "id", 7)
    assert {r.c: r["count"] for r in got.groupBy("c").count().collect()} == {"0": 7, "1": 7, "2": 7}
    small = sampling.stratified(df.where("id < 4"), ["c"], "id", 7)
    assert small.count() == 4
    drawn, short = sampling.matched(df.where("c <> '2'"), df.where("id < 30"), ["c"], "id")
    assert drawn.count() == 20 and {r.c: r.short for r in short.collect()} == {"0": 0, "1": 0, "2": 10}
    quota = sampling.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, s double"), "k", "s", 10)
    assert {r.k: r.quota for r in quota.collect()} == {"a": 4, "b": 3, "c": 3}
    pairs = sampling.permuted_pairs(df, "id", "id").collect()
    assert sorted(r.other for r in pairs) == list(range(1000))


def test_records(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 3, "x"), ("b", 2, "y"), (None, 4, "z")], "id string, n int, v string")
    assert {(r.id, r.v) for r in records.last_wins(log, "id", "n").collect()} == {("a", "x"), ("b", "y")}
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert {tuple(r) for r in records.upsert(base, spark.createDataFrame([("b", 9), ("c", 3)], "id string, n int"), "id").collect()} == {("a", 1), ("b", 9), ("c", 3)}
    sizes = [random.Random(1).randint(0, 40) for _ in range(300)]
    got = records.shards(spark.createDataFrame(list(enumerate(sizes)), "id long, s int"), F.col("s"), "id", 100, parts=17).collect()
    assert all(r.shard == sum(sizes[: r.id]) // 100 for r in got)


def test_perturbation(spark):
    df = spark.createDataFrame([("The Éclair, an éclair; eclairs stay.", "éclair", "bun")], "t string, w string, b string")
    r = df.select(perturbation.substituted(F.col("t"), F.col("w"), F.col("b")).alias("s"), perturbation.without_clauses(F.col("t"), F.col("w")).alias("c")).first()
    assert r.s == "The Bun, an bun; eclairs stay." and r.c == "eclairs stay."


def test_masks_and_inflections(spark):
    df = spark.createDataFrame([("a [MASK] b [MASK]",), ("no mask",), (None,)], "t string")
    before, after = text.mask_parts(F.col("t"))
    assert [tuple(r) for r in df.select(before, after).collect()] == [("a ", " b [MASK]"), (None, None), (None, None)]
    words = {"weighings": "ings", "weighing": "ing", "markedly": "edly", "weighed": "ed", "boxes": "es", "acids": "s", "sing": "", "": ""}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.inflection(F.col("w")).alias("e")).collect()
    assert {r.w: r.e for r in got} == words
    cases = [("bake", "ing", ["baking", "bakeing"]), ("stop", "ed", ["stoped", "stopped"]), ("city", "s", ["citys", "cityes", "cities"]), ("acid", "ly", ["acidly"])]
    rows = spark.createDataFrame([(w, e) for w, e, _ in cases], "w string, e string").select(text.inflected(F.col("w"), F.col("e")).alias("f")).collect()
    assert [r.f for r in rows] == [f for *_, f in cases]


def test_label_stream(spark, tmp_path):
    source, target = tmp_path / "log", str(tmp_path / "out")
    source.mkdir()
    line = lambda n, i, f: json.dumps({"line_no": n, "id": i, "form": f})
    (source / "1.json").write_text("\n".join([line(1, "a", 2), line(2, "b", 3), '{"line_no": 3, "id": "c'] ))
    compacted(label_stream(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    (source / "2.json").write_text(line(5, "a", 7))
    compacted(label_stream(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    assert {(r.id, r.form) for r in labels_at(spark, target).collect()} == {("a", 7), ("b", 3)}
    assert {(r.id, r.form) for r in labels_at(spark, target, 1).collect()} == {("a", 2), ("b", 3)}
    versions = {(r.id, r.version) for r in spark.read.parquet(target).collect()}
    assert versions == {("a", 0), ("b", 0), ("a", 1)}  # the bucket of b isn't written again
    counts = daily_counts(spark.sql("select timestamp'2026-03-01 10:00:00' as t union all select timestamp'2026-03-01 12:00:00'"), "t").collect()
    assert [r.n for r in counts] == [2]
