"""The operators of the llm subpackage: brute force on small fixtures, and the edge cases that their docstrings define."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossarium.llm import frequency, leakage, lookalike, mixing, queries, reading, sampling, truncation


def _brute_force(rows):
    occ, rec = Counter(), Counter()
    for f, terms, *_ in rows:
        t = [x for x in terms or [] if x is not None]
        grams = [(f, tuple(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)]
        occ.update(grams)
        rec.update(set(grams))
    return {g: (occ[g], rec[g], len(g[1])) for g in occ}


@pytest.mark.parametrize("least", [1, 2])
def test_ngram_frequencies_against_brute_force(spark, monkeypatch, least):
    random.seed(least)
    monkeypatch.setattr(frequency, "SHORT_CODES", 5)
    words = ["a", "b", "c", "d", "de", "a long term", "a long term of many words", "", "éà", "x" * 100, "b\x1fc"]
    lists = [[random.choice(words) for _ in range(random.randint(0, 9))] for _ in range(200)]
    rows = [("f", r, "x") for r in lists + lists[:5] * 3] + [("g", None, "x"), ("g", [], None), (None, ["x", "x", None], None), ("", ["x"], None), ("f", ["b", "c"], None)]
    rows += [("h", [str(i % 7) for i in range(90)], None)]
    df = spark.createDataFrame(rows, "field string, terms array<string>, gram string")
    got = {(r.field, tuple(r.gram)): (r.occurrences, r.records, r.n) for r in frequency.ngram_frequencies(df, least).collect()}
    assert got == {g: v for g, v in _brute_force(rows).items() if v[2] == 1 or v[0] >= least}


def test_intervals_across_steps_and_partitions(spark):
    random.seed(9)
    rows = [("f", [random.choice("ab") for _ in range(random.randint(1, 6))]) for _ in range(300)]
    df = spark.createDataFrame(rows, "field string, terms array<string>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r.field, tuple(r.gram)): (r.occurrences, r.records, r.n) for r in frequency.ngram_frequencies(df, 2, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {g: v for g, v in _brute_force(rows).items() if v[2] == 1 or v[0] >= 2}


def test_suffixes_of_one_record():
    rng = random.Random(4)
    for n in [*range(1, 12), 200]:
        t = [rng.choice("ab") for _ in range(n)]
        got = frequency.shared_with_before(np.array([ord(c) for c in t]))
        places = sorted(range(n), key=lambda i: t[i:])
        want = [0] * n
        for a, b in zip(places, places[1:]):
            while max(a, b) + want[b] < n and t[a + want[b]] == t[b + want[b]]:
                want[b] += 1
        assert list(got) == want


def test_frequencies_hold_whole_lists(spark, tmp_path):
    words = [f"w{i}" for i in range(10)]
    rows = [(1, "w0", "|".join(words)), (2, "w0", ", ".join(words)), (3, None, "w0|w1")]
    spark.createDataFrame(rows, "row_id long, target_word string, top_10_words string").write.parquet(f"{tmp_path}/postcutoff_words.parquet")
    got = {(r.field, r.term): (r.n, r.occurrences, r.records) for r in queries.p1_frequencies(spark, str(tmp_path)).collect()}
    want = {("top_10_words", " | ".join(words[i:j])): (j - i, 2, 2) for i in range(10) for j in range(i + 1, 11)} | {("target_word", "w0"): (1, 2, 2)}
    assert got == want | {("top_10_words", t): (n, 3, 3) for t, n in (("w0", 1), ("w1", 1), ("w0 | w1", 2))}


def test_ngram_marks_and_empty(spark):
    empty = frequency.ngram_frequencies(spark.createDataFrame([], "field string, terms array<string>"))
    assert empty.count() == 0
    counts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "records long")
    assert [r.mark for r in frequency.mark_frequencies(counts, 100).orderBy("records").collect()] == ["rare", "rare", None, "common"]


def test_swap_repair():
    rng = np.random.default_rng(0)
    for _ in range(50):
        k = int(rng.integers(1, 12))
        available = rng.integers(0, 50, k)
        size = int(rng.integers(0, 200))
        wanted = rng.dirichlet(np.ones(k)) * size
        floors = np.minimum(available, rng.integers(0, 4, k))
        targets = np.concatenate([np.eye(k), rng.integers(0, 2, (3, k)).astype(float)])
        taken = sampling.repaired_counts(available, floors, wanted, size, targets, seed=1)
        assert (taken <= available).all() and (taken >= floors).all()
        assert taken.sum() == max(floors.sum(), min(size, available.sum()))
        for a in np.flatnonzero(taken > floors):
            for b in np.flatnonzero(taken < available):
                other = taken.copy()
                other[a] -= 1
                other[b] += 1
                assert sampling.deviation(other, wanted, targets) >= sampling.deviation(taken, wanted, targets) - 1e-6


def test_swap_repair_of_very_many_records():
    available = np.array([3 * 10**12, 10**10, 5], np.int64)
    taken = sampling.repaired_counts(available, np.zeros(3, np.int64), np.array([6e9, 3e9, 1e9]), 10**10)
    assert taken.sum() == 10**10 and taken[2] == 5 and abs(taken[1] - 3e9) <= 1e9


def test_supply_and_sample(spark):
    rows = [(f"i{k}", m, g, f) for k in range(40) for m, g, f in [("Model_A", " stem&AFFIX", 0)]] + [("i1", "model a", "AFFIX + STEM", 0), ("z", None, "STEM", 0), ("y", "model-b", "none", 1), ("y", "MODEL b", "None ", 1), ("x", "model-b", "NONE", None)]
    df = spark.createDataFrame(rows, "id string, model string, grade string, is_future int")
    rec = df.select(sampling.plain_key(F.col("model")).alias("model_key"), sampling.parts_key(F.col("grade")).alias("grade_key"), "is_future", F.concat_ws("@", "id", sampling.plain_key(F.col("model"))).alias("entity"))
    targets = spark.createDataFrame([("s", "model-a", "STEM+AFFIX", 0, 0.5, 2, 20), ("s", "model-b", "NONE", 1, 0.5, 2, 20)], "target_set string, model string, grade string, is_future int, share double, min_rows int, sample_size long")
    supply = sampling.cell_supply(rec, targets)
    got = {r.model: (r.available, r.needed) for r in supply.collect()}
    assert got == {"model-a": (40, 10.0), "model-b": (1, 10.0)}
    sample = sampling.proportional_sample(rec, supply).collect()
    assert Counter(r.model for r in sample) == {"model-a": 19, "model-b": 1} and len({r.entity for r in sample}) == 20
    report = sampling.sample_report(sampling.proportional_sample(rec, supply), supply)
    assert {r.model: (r.reached, r.short) for r in report.collect()} == {"model-a": (19, False), "model-b": (1, True)}
    margins = {(r.category, r.value): round(r.reached_share, 9) for r in sampling.margin_report(report).collect()}
    assert margins == {("model", "model-a"): 0.95, ("model", "model-b"): 0.05, ("grade", "STEM+AFFIX"): 0.95, ("grade", "NONE"): 0.05, ("is_future", "0"): 0.95, ("is_future", "1"): 0.05}
    assert sampling.cell_supply(rec.limit(0), targets).where("available = 0").count() == 2
    empty = sampling.cell_supply(rec.limit(0), targets)
    assert sampling.sample_report(sampling.proportional_sample(rec.limit(0), empty), empty).where("short and reached = 0").count() == 2


def test_truncated_texts(spark):
    random.seed(4)
    word = lambda: random.choice(["stem", "affix", "letter", "group", "family", "ending"]) + random.choice(["", "s"])
    say = lambda: " ".join(word() for _ in range(random.randint(6, 14)))
    whole = [f'{{"form":"{word()}","why":"The {say()}."}}' for _ in range(300)] + [f"I cannot read the {say()}, please send it again." for _ in range(120)]
    cut = [t[: random.randint(25, len(t) - 6)] for t in whole[:40]]
    marked = [t[:30] + "�" for t in whole[40:50]] + [t[:30] + "..." for t in whole[50:60]]
    headless = [t[20:] for t in whole[60:75]]
    texts = whole + cut + marked + headless + [None, "", "  \n", "x", "y" * 100_000]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "id int, text string, front string")
    got = {r.id: r for r in truncation.truncated_texts(df, "id", "text").collect()}
    n = len(whole)
    assert sum(got[i].lost_end or got[i].lost_start for i in range(n)) == 0
    assert sum(got[i].lost_end for i in range(n, n + 60)) >= 57
    assert sum(got[i].lost_start for i in range(n + 60, n + 75)) >= 14
    assert len(got) == len(texts) - 3
    assert truncation.truncated_texts(df.limit(0), "id", "text").count() == 0


def test_a_cut_text_says_nothing_on_its_own_end(spark):
    random.seed(5)
    whole = [f'{{"form":"{random.choice("abcdefg") * 3}","why":"The stem of {random.choice(["one", "two", "all"])} is {random.choice(["long", "short"])}."}}' for _ in range(200)]
    twice, rare = '{"form":"aaa","why":"The stem of qzx', '```json\n{"form":"bbb","why":"The stem of vkj'
    df = spark.createDataFrame(list(enumerate([*whole, *[twice] * 2, rare])), "id int, text string")
    lost = {r.id for r in truncation.truncated_texts(df, "id", "text").collect() if r.lost_end}
    assert lost == {200, 201, 202}


def test_thresholds_lie_where_few_texts_are(spark):
    scores = [("end", "a", -1.2 - i % 5) for i in range(60)] + [("end", "a", 0.1 + i % 3) for i in range(60)] + [("end", "a", -0.45)] * 3
    scores += [("start", "b", -0.1 - i % 2) for i in range(60)] + [("end", "small", -1.0), ("end", "small", 2.0)]
    got = {(r.side, r.form): r.threshold for r in truncation.edge_thresholds(spark.createDataFrame(scores, "side string, form string, score double")).collect()}
    assert got["end", "small"] == -0.5 and -1.1 < got["start", "b"] < -0.2
    assert -1.1 < got["end", "a"] < -0.5 or -0.4 < got["end", "a"] < 0.1


def test_lookalike_fields(spark):
    df = spark.createDataFrame([(1, "plain", "ａ|b", "k"), (2, None, "", "k"), (2, "o​ne", "c", "k")], "row_id int, text string, tops string, key string")
    got = {(r.row_id, r.field, r.consistent) for r in lookalike.lookalike_fields(df, "row_id", ["text", "tops"]).collect()}
    assert got == {(1, "tops", "a|b"), (2, "text", "one")}
    assert {tuple(r) for r in lookalike.lookalike_report(df, "row_id", ["text", "tops"]).collect()} == {("text", 2, 1), ("tops", 3, 1)}
    assert lookalike.lookalike_fields(df.limit(0), "row_id", ["text"]).count() == 0


def _leak_tables(spark, kinds=(), times=0, sizes=(6, 12, 20), short=6):
    """Items, and documents of which every second holds a passage of one, with so many words replaced, dropped or put in."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.choice(sizes))] for _ in range(40)]
    docs = []
    for i in range(100):
        d = [rng.choice(words) for _ in range(rng.randint(0, 20))]
        if i % 2:
            it = rng.choice(items)
            part = it[: rng.randint(short, len(it))]
            for _ in range(times):
                at, kind = rng.randrange(len(part)), rng.choice(kinds)
                part[at : at + (kind != "put in")] = [] if kind == "dropped" else [rng.choice(["zz", *words])]
            d[len(d) // 2 : len(d) // 2] = part
        docs.append(" ".join(d))
    return items, docs


def _near(items, docs, window, edits):
    """Brute force: (document, item) with windows within so many edits."""
    ids = {}
    arrays = lambda t: np.array([[ids.setdefault(w, len(ids)) for w in t[k : k + window]] for k in range(len(t) - window + 1)])
    held, out = [arrays(t) for t in items], set()
    owner, every = np.concatenate([np.full(len(h), j) for j, h in enumerate(held)]), np.concatenate([h for h in held if len(h)])
    for i, t in enumerate(docs):
        x = arrays(t.split())
        for k in range(0, len(x), 8):
            part = x[k : k + 8]
            d = leakage.edit_distances(np.repeat(part, len(every), 0), np.tile(every, (len(part), 1)))
            out |= {(i, f"e{j}") for j in owner[np.flatnonzero(d.reshape(len(part), -1).min(0) <= edits)]}
    return out


def _found(spark, items, docs, **how):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    it = spark.createDataFrame([(f"e{i}", " ".join(t)) for i, t in enumerate(items)], "item_id string, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaked_passages(d, "doc_id", "text", it, "item_id", "text", **how).collect()}


def test_leaks_equal_brute_force(spark):
    items, docs = _leak_tables(spark)
    d = spark.createDataFrame([*enumerate(docs), (900, None), (901, ""), (902, "W1, _w2_ *w3* w-\n4 " * 3)], "doc_id int, text string")
    it = spark.createDataFrame([(f"e{i}", " ".join(t)) for i, t in enumerate(items)] + [("null", None), ("b", "w1 w2 w3 w4 w1 w2 w3 w4")], "item_id string, text string")
    want = _near(items, docs, 8, 0)
    for edits in (0, 1):
        for chars in (10_000_000, 500):
            rows = leakage.leaked_passages(d, "doc_id", "text", it, "item_id", "text", max_edits=edits, block_chars=chars).where("edits = 0")
            got = {(r.doc_id, r.item_id) for r in rows.collect()}
            assert want <= got and got - want <= {(902, "b")}
    assert leakage.leaked_passages(d.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leakage.leaked_passages(d, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("kinds", [("replaced",), ("dropped",), ("put in",), ("replaced", "dropped", "put in")])
def test_edited_leaks_reach_recall(spark, kinds):
    items, docs = _leak_tables(spark, kinds, 1, sizes=(16, 24, 40), short=15)
    for window, edits in ((8, 1), (16, 3)):
        want, got = _near(items, docs, window, edits), _found(spark, items, docs, window=window, max_edits=edits)
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 10


def test_unreachable_recall_is_an_error():
    windows = np.random.default_rng(0).integers(1, 1000, (200, 8))
    with pytest.raises(ValueError):
        leakage.WindowHash(8, 6, 0.999, windows)


def test_hot_passage_in_many_documents_and_items(spark):
    hot = " ".join(f"h{i}" for i in range(12))
    docs = [f"{i} {hot} end" for i in range(300)] + ["none of it"]
    got = _found(spark, [f"{hot} item{j}".split() for j in range(30)], docs, window=8, max_edits=1)
    assert got == {(i, f"e{j}") for i in range(300) for j in range(30)}


def test_mixture(spark):
    rows = [(i, f"word {i} " * (1 + i % 7), s) for i, s in enumerate(["big"] * 300 + [" BIG"] * 30 + ["smаll"] * 20 + [None] * 5)] + [(999, None, "big"), (998, "", "small")]
    docs = spark.createDataFrame(rows, "doc int, body string, origin string")
    sizes = mixing.document_sizes(docs, "doc", "body", "origin")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 2), ("gone", 0.1, 3)], "source string, weight double, max_repeat int")
    plan = mixing.mixture_plan(sizes, targets)
    got = {r.name: r for r in plan.collect()}
    assert got["small"].short and got["gone"].short and not got["big"].short and got["gone"].tokens == 0
    mixed = mixing.mixed_documents(sizes, plan).collect()
    taken = Counter()
    for r in mixed:
        taken[r.source] += r.tokens * r.copies
    assert taken["small"] == 2 * got["small"].tokens and max(r.copies for r in mixed if r.source == "small") == 2
    assert 0 <= taken["big"] - got["big"].budget <= max(r.tokens for r in mixed)
    report = {r.source: r for r in mixing.mixture_report(mixing.mixed_documents(sizes, plan), plan).collect()}
    assert report["gone"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert mixing.mixed_documents(sizes.limit(0), mixing.mixture_plan(sizes.limit(0), targets)).count() == 0


def test_quality_weights_favour_better_documents(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "1234 5678 !!!! ") * 4, "s") for i in range(400)], "doc int, body string, origin string")
    sizes = mixing.document_sizes(docs, "doc", "body", "origin")
    plan = mixing.mixture_plan(sizes, spark.createDataFrame([("s", 0.3, 1)], "source string, weight double, max_repeat int"))
    kinds = Counter(r.doc % 2 for r in mixing.mixed_documents(sizes, plan).collect())
    assert kinds[1] > 2 * kinds[0]


def test_low_weights_are_spread_and_ordered_by_their_keys(spark):
    keyed = spark.range(40_000).select(F.col("id").alias("doc"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 0.05).otherwise(0.9).alias("quality"))
    keyed = keyed.withColumn("_order", -F.ln(F.rand(3)) / F.col("quality"))
    placed = mixing._even_place(keyed)
    sizes = [r["count"] for r in placed.groupBy(F.floor(F.col("_place") * 20).alias("b")).count().collect()]
    assert len(sizes) in (20, 21) and max(sizes) < 2 * 40_000 / 20
    assert placed.select(F.countDistinct("_order").alias("n")).first().n == 40_000
    rows = placed.orderBy("_order").select("_place").collect()
    assert all(a._place <= b._place for a, b in zip(rows, rows[1:]))


def test_sentences():
    assert [len(s) for s in reading.sentences("A cat sat. It ran!\nThe end")] == [3, 2, 2]
    assert [len(s) for s in reading.sentences("We ran, and then we sat, and then we ate")] == [2, 2, 2]
    assert reading.sentences("transfor-\nmation works") == [["transformation", "works"]]
    assert reading.sentences("") == [] and reading.sentences("Menu 3\nA cat sat.", frozenset({"Menu"})) == [["a", "cat", "sat"]]


def test_boilerplate_is_the_same_share_at_every_size(spark):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(6))
    body = lambda: [line() for _ in range(8)]
    for n in (60, 1200):
        texts = ["\n".join([*body(), *(["Skip to content 3"] if i % 20 == 0 else [])]) for i in range(n)]
        got = reading.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc int, text string")).collect()
        assert [r.line for r in got] == ["Skip to content"]


def test_copies_with_a_differing_line_keep_their_body(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(6))
    hot, exact = [line() for _ in range(8)], [line() for _ in range(8)]
    texts = [[line() for _ in range(8)] + ["Skip to content"] * (i % 10 == 0) for i in range(600)]
    texts += [[*hot[:4], line(), *hot[4:]] for _ in range(60)] + [exact] * 60 + [[*exact[:7], line()]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc int, text string")
    assert [r.line for r in reading.repeated_lines(df).collect()] == ["Skip to content"]


def test_reading_levels(spark):
    rng = random.Random(1)
    easy, hard = [f"cat{i}" for i in range(30)], [f"isomorphic{i}" for i in range(2000)]
    rows, labels = [], []
    for i in range(300):
        hi = i % 2
        sent = lambda: " ".join(rng.choice(hard if hi and rng.random() < 0.5 else easy) for _ in range(20 if hi else 7)).capitalize() + "."
        rows.append((i, " ".join(sent() for _ in range(8)) + "\nMenu " + str(i), "EN-gb" if i % 3 else "en"))
        if i < 200:
            labels.append((i, 5 if hi else 2))
    rows += [(900, None, "en"), (901, "", "en"), (902, "ein Wort", "de"), (903, "cat1", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumn("level", F.lit("clash"))
    ratings = spark.createDataFrame([*labels, labels[0], (None, 3), (5, None)], "doc int, level int")
    got = {r.doc_id: r for r in reading.reading_levels(df, "doc_id", "text", "lang", ratings).collect()}
    assert set(got) == {*range(300), 901} and got[901].level is None and got[901].n_words == 0
    assert all((got[i].level >= 4) == bool(i % 2) for i in range(200, 300))
    none = reading.reading_levels(df, "doc_id", "text", "lang", ratings.limit(0))
    assert none.count() == 301 and reading.reading_levels(df.limit(0), "doc_id", "text", "lang", ratings).count() == 0


def test_null_keys_and_clashing_columns(spark):
    cols = "doc_id long, text string, lang string, key string, id string, item string, windows int, score double, level int, tokens long"
    rows = [(None, "one two three four five six seven eight", "en", *[None] * 7), (2**60 + 1, "One two, three four five six seven eight!", "en", *[None] * 7), (2**60 + 1, "One two, three four five six seven eight!", "en", *[None] * 7)]
    df = spark.createDataFrame(rows, cols)
    items = spark.createDataFrame([("a", "one two three four five six seven eight nine")], "item_id string, text string")
    got = leakage.leaked_passages(df, "doc_id", "text", items, "item_id", "text").collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(2**60 + 1, "a", 0)] * 2
    assert [r.doc_id for r in truncation.truncated_texts(df, "doc_id", "text").collect()] == [2**60 + 1]
    levels = reading.reading_levels(df, "doc_id", "text", "lang", spark.createDataFrame([(1, 2, None)], "doc long, level int, rater string"))
    assert [r.doc_id for r in levels.collect()] == [2**60 + 1] * 2
    sizes = mixing.document_sizes(df, "doc_id", "text", "item")
    assert sizes.count() == 3 and sizes.where("source is null and tokens > 0").count() == 3
