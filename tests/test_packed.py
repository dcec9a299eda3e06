import pytest

from glossarium.operators import predictions
from glossarium.operators.packed import unpack_values

CASES = [
    ("a|b||c", [(1, "a"), (2, "b"), (4, "c")]),
    ('["a", "o\'clock"]', [(1, "a"), (2, "o'clock")]),
    ("['a', \"o'clock\", 'b']", [(1, "a"), (2, "o'clock"), (3, "b")]),
    ("['x', 'the \"ray\"', 'y']", [(1, "x"), (2, 'the "ray"'), (3, "y")]),
    ('"the ""ray"""|x', [(1, 'the "ray"'), (2, "x")]),
    ('a|"salt, common"|b', [(1, "a"), (2, "salt, common"), (3, "b")]),
    ("1. a, 2. b", [(1, "a"), (2, "b")]),
    ('1) "1,000", 2) an', [(1, "1,000"), (2, "an")]),
    ('(1) "rock; hard"\n(2) b', [(1, "rock; hard"), (2, "b")]),
    ("3,3-dimethyl|1,000", [(1, "3,3-dimethyl"), (2, "1,000")]),
    ("to / and/or / x", [(1, "to"), (2, "and/or"), (3, "x")]),
    ("{A,b}", [(1, "a"), (2, "b")]),
    ("ａ｜b​；c", [(1, "a"), (2, "b"), (3, "c")]),
    ("a | b ", [(1, "a"), (2, "b")]),
    ("a\tb\nc\r\nd", [(1, "a"), (2, "b"), (3, "c"), (4, "d")]),
    ('the "ray"|x', [(1, 'the "ray"'), (2, "x")]),
    ('5" pipe|y', [(1, '5" pipe'), (2, "y")]),
    ("p.m.|l'ion|de facto", [(1, "p.m."), (2, "l'ion"), (3, "de facto")]),
    ('["", "a"]', [(2, "a")]),
    ("[]", []), ("", []), ("  ", []), ('""', []), (None, []), ("|||", []),
]


@pytest.fixture(scope="module")
def unpacked(spark):
    df = spark.createDataFrame([(i, t, i, "pos") for i, (t, _) in enumerate(CASES)], "k int, t string, pos int, value string")
    out = {}
    for r in unpack_values(df, "k", "t").collect():
        out.setdefault(r.k, []).append((r.pos, r.value))
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_writing(unpacked, i):
    assert sorted(unpacked.get(i, [])) == CASES[i][1]


def test_empty_table_repeats_and_long_field(spark):
    df = spark.createDataFrame([], "k int, t string")
    assert unpack_values(df, "k", "t").count() == 0 and unpack_values(df, "k", "t").columns == ["k", "pos", "value"]
    long = "|".join(f"v{i}" for i in range(50_000))
    rows = unpack_values(spark.createDataFrame([(1, "a|b"), (1, "a|b"), (2, long)], "k int, t string"), "k", "t")
    assert rows.where("k = 1").count() == 4 and rows.where("k = 2").agg({"pos": "max"}).first()[0] == 50_000


def test_predictions_read_every_list_writing(spark, tmp_path):
    cols = "row_id long, model string, item_id string, text string, target_word string, year int, entry_start_year string, rank int, top_10_words string"
    rows = [(i, "m", f"e{i}", "text", "b", 1950, None, 1, t) for i, (t, _) in enumerate(CASES)]
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/postcutoff_words.parquet")
    spark.createDataFrame([("m", 1930)], "model string, cutoff_year int").write.parquet(f"{tmp_path}/models.parquet")
    p = predictions.predictions(spark, str(tmp_path))
    assert {r.row_id: r.words for r in p.collect()} == {i: [v for _, v in values] for i, (_, values) in enumerate(CASES)}
    values = [[v for _, v in values] for _, values in CASES]
    want = {i: v.index("b") + 1 if "b" in v else -1 for i, v in enumerate(values)}
    assert {r.row_id: r.list_rank for r in predictions.prediction_details(p).collect()} == want
