"""Models and grades count however they are spelled."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

MODELS = ["talkie-base", "Talkie-Base", "talkie_base", " talkie-base", "talkie‑base"]
GRADES = ["STEM+AFFIX", "STEM&AFFIX", "affix+stem", "STEM＋AFFIX", "Stem + Affix "]


def test_spellings_count_as_one(spark, tmp_path):
    rows = [(i, f"n{i}", m, g, "stem" if i % 2 else "none", f, i % 3 * 60) for i, (m, g, f) in enumerate((m, g, f) for m in MODELS for g in GRADES for f in (0, 1))]
    d = str(tmp_path)
    spark.createDataFrame(rows, "key_no long, id string, model string, grade string, route string, is_future int, rank int").write.parquet(f"{d}/neighborhood_key.parquet")
    spark.createDataFrame([("talkie-base", "talkie")], "model string, family string").write.parquet(f"{d}/models.parquet")
    spark.createDataFrame([], "line_no long, id string, form int, meaning int, sheet string").write.parquet(f"{d}/label_log.parquet")
    spark.createDataFrame([], "nbr_id string").write.parquet(f"{d}/judge_failures.parquet")
    q = {n.split("_")[0]: f for n, f in entry.queries().items() if n[:1] == "q"}
    assert [(r.model, r.grade, r.n) for r in q["q18"](spark, d).collect()] == [("talkie-base", "STEM+AFFIX", 25)] * 2
    hits = F.expr("a + b + c + d").alias("n")
    assert [tuple(r) for r in q["q20"](spark, d).select("model", hits).collect()] == [("talkie-base", 50)]
    assert [r.model for r in q["q21"](spark, d).collect()] == [r.model for r in q["q45"](spark, d).collect()] == ["talkie-base"]
    assert [(r.n_post, r.n_past) for r in q["q46"](spark, d).collect()] == [(25, 25)]
    assert {r.family for r in q["q40"](spark, d).collect()} == {"talkie"}
