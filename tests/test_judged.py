"""Judged groups, answers as logged, edits of prompts: the cases that their docstrings define."""

import pytest
from pyspark.sql import functions as F

from glossarium.operators import judged, neighborhood, outcomes, perturbation, records, sampling, scaffold

WORDS = ["filter", "filters", "filtration", "house"]


@pytest.mark.parametrize("members, n", [(["filter", "filters"], 0), (["filter"], 0), ([], 0), (None, 0), (["filter", "filtration"], 2), (["Filter", "filters", "filtration"], 3), (["filter", "filter"], 0), (["filtration", "filter", "unheard"], 2)])
def test_form_size(spark, members, n):
    df = spark.createDataFrame([(1, WORDS, members)], "id int, words array<string>, members array<string>")
    assert judged.judged_groups(df).first().form_n == n


def test_groups_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, [], None), (3, ["abcd", "abce"], ["abcd", "abce"])], "id int, words array<string>, members array<string>")
    assert {r.id: (r.judged_n, r.form_n) for r in judged.judged_groups(df).collect()} == {1: (0, 0), 2: (0, 0), 3: (2, 2)}
    assert judged.judged_groups(df.limit(0)).count() == 0


def test_a_long_chain_is_one_component(spark):
    chain = [chr(97 + i) * 3 + chr(98 + i) * 3 for i in range(20)]
    df = spark.createDataFrame([(chain[::2] + chain[1::2],)], "words array<string>")
    assert df.select(neighborhood.component_labels(F.col("words")).alias("l")).first().l == [0] * 20


ANSWERS = [
    ('{"form_group": ["a", "b"]}', "object", ["a", "b"]),
    ('So here it is:\n```json\n{"form_group": []}\n``` and that is all', "object", []),
    ('{"note": {"x": "}"}, "form_group": ["a"]} {', "list", ["a"]),
    ('{"note": {"x": 1}, "form_group": ["a"]}', "object", ["a"]),
    ('{broken} {"form_group": ["z"]}', "object", ["z"]),
    ("{'form_group': ['ab', 'cd']}", "list", ["ab", "cd"]),
    ("it is [one, 'two', 3]", "list", ["one", "two"]),
    ('{"form_group": ["a", "b', "truncated_json", None),
    ("no answer", "unparseable", None),
    ('{"other": 1}', "unparseable", None),
    ("  ", "empty_text", None),
    (None, "empty_text", None),
]


def test_answers_as_logged(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(ANSWERS)], "id int, raw string")
    got = {r.id: (r.how, r.members) for r in judged.parsed_answers(df, "raw", "form_group").collect()}
    assert got == {i: (how, members) for i, (_, how, members) in enumerate(ANSWERS)}
    assert judged.parsed_answers(df.limit(0), "raw", "form_group").count() == 0


def test_deleting_evidence(spark):
    text = "The oxide was heated slowly, and the chloride was weighed again, although nobody had asked for the nitrate of it"
    rows = [(text, "the chloride was weighed  again", "chloride"), (text, "although nobody", "chloride"), (text, None, "chloride"), ("the chloride", None, "chloride"), (text, None, "copper")]
    df = spark.createDataFrame(rows, "t string, e string, w string")
    got = [(r.deleted, r.how) for r in perturbation.without_evidence(df, "t", F.col("e"), F.col("w")).collect()]
    assert got[0] == got[2]  # the phrase isn't there verbatim
    assert got[1][1] == "evidence_phrase" and "although nobody" not in got[1][0]
    assert got[2][1] == "clause_fallback" and "chloride" not in got[2][0]
    assert got[3] == (None, "no_clean_deletion") and got[4] == (None, "no_clean_deletion")


def test_deletion_status(spark):
    before = "one two three four five six seven eight nine ten eleven"
    cases = {"one two three four five six seven eight nine": "ok", "two one three four five six seven eight nine": "not_a_subsequence", "one two three four five six seven eight ten nine": "not_a_subsequence", "one two three four five six seven,eight nine ten": "punctuation_artifact", "eleven one two": "donor_survives", "one two": "too_much_removed", "": "empty"}
    df = spark.createDataFrame([(before, a, "eleven") for a in cases], "b string, a string, w string")
    got = {r.a: r.s for r in df.select("a", perturbation.deletion_status(F.col("b"), F.col("a"), F.col("w")).alias("s")).collect()}
    assert got == cases


def test_doubled_words(spark):
    df = spark.createDataFrame([("a born born man",), ("born, born",), ("reborn born",), ("Born born",), ("été été",)], "t string")
    assert [r.d for r in df.select(perturbation.doubles_a_word(F.col("t")).alias("d")).collect()] == [True, False, False, True, True]


def test_edit_arms(spark):
    rows = spark.createDataFrame([(1, "photometer", "photograph", "The photograph of the harbour was shown to every sailor there, and they liked it very much indeed"), (2, "xxxx", "yyyy", "yyyy")], "row_id long, target string, donor string, prefix string")
    lexicon = spark.createDataFrame([("photograph", 5, 100), ("harbour", 5, 100), ("village", 6, 100), ("population", 5, 100), ("sailor", 50, 100)], "word string, n_docs long, all_docs long")
    got = {(r.row_id, r.arm): (r.word, r.status, r.edited) for r in perturbation.edit_arms(rows, lexicon).collect()}
    assert got[1, "donor_substituted"][:2] == ("photograph", "ok") and "population" in got[1, "donor_substituted"][2]
    assert got[1, "placebo"][:2] == ("harbour", "ok") and "village" in got[1, "placebo"][2] and "photograph" in got[1, "placebo"][2]
    assert got[1, "donor_deleted"][1] in ("ok", "no_clean_deletion")
    assert got[2, "placebo"] == (None, "no_candidate", None) and got[2, "donor_substituted"][1] == "no_substitute" and len(got) == 6


def test_shards_of_sparse_and_empty_orders(spark):
    ids = [i**3 for i in range(300)]
    df = spark.createDataFrame([(i, 10) for i in ids], "id long, s int")
    got = {r.id: r.shard for r in records.shards(df, F.col("s"), "id", 100, parts=20).collect()}
    assert got == {i: k * 10 // 100 for k, i in enumerate(ids)}
    assert records.shards(df.limit(0), F.col("s"), "id", 100).count() == 0


def test_permuted_pairs_never_keep_their_own(spark):
    for n in (2, 3, 500):
        df = spark.range(n).select(F.col("id").alias("k"), F.col("id").alias("v"))
        rows = sampling.permuted_pairs(df, "k", "v").collect()
        assert sorted(r.other for r in rows) == list(range(n)) and all(r.other != r.v for r in rows)
    assert [r.other for r in sampling.permuted_pairs(spark.range(1).select(F.col("id").alias("k"), F.col("id").alias("v")), "k", "v").collect()] == [0]


def test_stride_and_modal_values(spark):
    assert sampling.stride(spark.range(100), "id", 7).count() == 7 and sampling.stride(spark.range(3), "id", 7).count() == 3
    log = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "a", 3), (4, "b", 5), (5, "b", 4), (6, "b", None), (7, None, 1)], "n int, id string, v int")
    assert {r.id: (r.n, r.modal) for r in outcomes.modal_values(log, "id", "v", "n").collect()} == {"a": (3, 3), "b": (2, 5)}


def test_donor_routes(spark):
    rows = spark.createDataFrame([(1, "quantization", "of quantizing and nation"), (2, "station", "a nation"), (3, "x", "")], "row_id int, target string, prefix string")
    assert [(r.route, r.grade) for r in scaffold.with_donors(rows).orderBy("row_id").collect()] == [("paradigmatic", "STEM+AFFIX"), ("syntagmatic", "AFFIX"), ("none", "NONE")]
