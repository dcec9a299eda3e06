"""Reading and writing of text formats."""

import json

import pytest

from glossarium.sources import files


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', "x"), (2, None, "y")], "id int, t string, part string")
    files.write(df.select("id", "t"), str(tmp_path / "c"), "csv")
    got = files.read_csv(spark, str(tmp_path / "c"), "id int, t string")
    assert {tuple(r) for r in got.collect()} == {(1, 'a "b", c\nd'), (2, None)}
    files.write(df, str(tmp_path / "p"), by=["part"])
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=x", "part=y"]
    (tmp_path / "bad.csv").write_text("id,t\nseven,u\n8,v\n")
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "bad.csv"), "id int, t string").collect()} == {(None, "u"), (8, "v")}


def test_json_lines(spark, tmp_path):
    lines = [{"word": "a", "n": 1}, {"word": "b", "n": 2}, {"word": "a", "n": 3}, {"n": 4}]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, lines)) + '\n{"word": "c", "n"')
    got = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "word string, n int", "word")
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 2)}


def test_ids_and_frozen(spark, tmp_path):
    (tmp_path / "ids.tsv").write_text("# drawn\nid\tmodel\nS1\tm\n\nS2\tm\nS1\tn\n")
    ids = files.read_ids(spark, str(tmp_path / "ids.tsv"))
    assert {r.id for r in ids.collect()} == {"S1", "S2"}
    path = str(tmp_path / "f")
    assert files.frozen(ids, path).count() == 2
    assert files.frozen(ids.limit(0), path).count() == 2
    files.require_all(ids, ids, "id")
    with pytest.raises(ValueError, match="S"):
        files.require_all(ids, ids.limit(0), "id")


def test_proposals_and_summary(spark, tmp_path):
    lines = ['{"key": "k", "payload": ["a", "b"]}', '{"key": "l", "candidates": ["c"]}', '{"key": "m"}', "{torn"]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    got = {r.key: r.candidates for r in files.read_proposals(spark, str(tmp_path / "p.jsonl")).collect()}
    assert got == {"k": ["a", "b"], "l": ["c"], "m": None}
    (tmp_path / "s.json").write_text(json.dumps({"base": {"recall": 0.5, "leakage": 0.25}}, indent=1))
    assert {tuple(r) for r in files.read_summary(spark, str(tmp_path / "s.json")).collect()} == {("base", "recall", 0.5), ("base", "leakage", 0.25)}
