"""Texts that lost their end or their beginning, told by a backward character n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.sources.session import stored

# Lengths of contexts: first over all forms of writing, then inside the form.
PLAIN_ORDERS, ORDERS = (1, 2), (1, 2, 3, 4, 6)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# Bits of the sieve of contexts that stand at an edge (one megabyte), and counts held by a task before it sends them on.
SIEVE_BITS, _BUFFER = 1 << 23, 2_000_000
# What loggers and broken transfers leave at a cut.
_CUT_END = r"(?:\s|\uFFFD|…|\.\.\.|\[(?:truncated|cut|\.\.\.)\])+$"
_CUT_START = r"^(?:\s|\uFFFD|…|\.\.\.|\[(?:truncated|cut|\.\.\.)\])+"


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, front, back): non-blank texts without outer blanks and cut marks.  front is the form in which a text
    starts and back that in which it ends; as a form of writing shapes what may follow it, each has a model of its own."""
    t = F.col("text")
    rows = df.select(df[key].alias("id"), df[text].alias("text")).where("id is not null and text is not null")
    # most texts have no mark at all, which their last and first characters tell without a search
    end = F.when(F.right(t, F.lit(1)).rlike(r"[\s\uFFFD….\]]"), F.regexp_replace(t, _CUT_END, "")).otherwise(t)
    rows = rows.withColumn("text", end).withColumn("text", F.when(F.left(t, F.lit(1)).rlike(r"[\s\uFFFD….\[]"), F.regexp_replace(t, _CUT_START, "")).otherwise(t)).where("text <> ''")
    opened = F.regexp_replace(F.regexp_extract(t, r"^(?:```[a-z]*\s*)?[\[{\s]*", 0), r"\s|[a-z]", "")
    closed = F.regexp_replace(F.regexp_extract(F.right(t, F.lit(64)), r"[\]}\s]*(?:```\s*)?$", 0), r"\s", "")
    inner = lambda mark: F.least(F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit(""))), F.lit(3)).cast("string")
    front = F.when(opened != "", F.concat(opened, inner("{"))).when(t.rlike(r"^\p{Lu}"), "text").otherwise("inside")
    back = F.when(closed != "", F.concat(closed, inner("}"))).otherwise("text")
    return rows.withColumns({"front": F.left(front, F.lit(12)), "back": F.right(back, F.lit(12))})


def _salt(text: str) -> np.uint64:
    h = np.uint64(1469598103934665603)
    with np.errstate(over="ignore"):
        for b in text.encode():
            h = (h ^ np.uint64(b)) * np.uint64(1099511628211)
    return h


class _Contexts:
    """The contexts of a batch of texts: for each order a key of the characters that end at each place."""

    def __init__(self, texts: pa.Array, front: pa.Array, back: pa.Array):
        whole = texts.to_pylist()
        self.lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.place = np.arange(len(codes)) - np.repeat(self.starts, self.lengths)
        self.keys, code, h = {}, codes.astype(np.uint64) + np.uint64(1), np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, max(ORDERS) + 1):
                h = (np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if k > 1 else h) * _MULTIPLIER + code
                if k in ORDERS:
                    self.keys[k] = h * _MULTIPLIER ^ (h >> np.uint64(29)) ^ np.uint64(k)
        chars, self.char = np.unique(codes, return_inverse=True)
        self.n_chars = len(chars)
        self.forms = {}
        for side, column in (("end", front), ("start", back)):
            form = pc.dictionary_encode(column)
            self.forms[side] = form.indices.to_numpy().astype(np.int64), np.array([_salt(side + x) for x in form.dictionary.to_pylist()], np.uint64)

    def at_edges(self, side: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(keys, how often the text itself has them, one array an order, and how many orders each text has)."""
        form, salts = self.forms[side]
        keys, own = [], []
        for k, salt in [*((k, _salt(side)) for k in PLAIN_ORDERS), *((k, salts[form]) for k in ORDERS)]:
            at = np.clip(self.ends - 1 if side == "end" else self.starts + k - 1, 0, len(self.place) - 1)
            edge = self.keys[k][at]
            same = (self.keys[k] == np.repeat(edge, self.lengths)) & (self.place >= k - 1)
            keys.append(edge ^ salt)
            own.append(np.add.reduceat(same.astype(np.int64), self.starts))
        fits = np.array([self.lengths >= max(k, 2) for k in (*PLAIN_ORDERS, *ORDERS)])
        return keys, own, fits

    def counts(self, sieve: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, how often each is seen), of the contexts that pass the sieve."""
        for side, (form, salts) in self.forms.items():
            each = np.repeat(form, self.lengths)
            for k in ORDERS:
                keys, ok = self.keys[k], self.place >= k - 1
                if k <= 2 and self.n_chars**k * len(salts) <= 4_000_000:
                    # short contexts are few: counted by character and form, without sorting
                    dense = self.char if k == 1 else np.concatenate([[0], self.char[:-1]]) * self.n_chars + self.char
                    n = np.bincount(dense[ok] * len(salts) + each[ok], minlength=self.n_chars**k * len(salts)).reshape(-1, len(salts))
                    name = np.zeros(self.n_chars**k, np.uint64)
                    name[dense[ok]] = keys[ok]
                    if k in PLAIN_ORDERS:
                        seen = np.flatnonzero(n.sum(1))
                        yield _sifted(sieve, name[seen] ^ _salt(side), n.sum(1)[seen])
                    at, f = np.nonzero(n)
                    yield _sifted(sieve, name[at] ^ salts[f], n[at, f])
                    continue
                for x in [keys[ok] ^ _salt(side)] * (k in PLAIN_ORDERS) + [keys[ok] ^ salts[each[ok]]]:
                    yield np.unique(x[_passes(sieve, x)], return_counts=True)


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(SIEVE_BITS - 1)
    return (sieve[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _sifted(sieve: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = _passes(sieve, keys)
    return keys[ok], n[ok]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, side, form, last, owns, keys, own) of each text and side: the contexts at its edge, shortest first, and how
    often the text itself has each."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            x = _Contexts(*(batch.column(j) for j in (1, 2, 3)))
            for side, form in (("end", batch.column(2)), ("start", batch.column(3))):
                keys, own, fits = x.at_edges(side)
                pick, width = fits.T, fits.sum(0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                flat, counts = np.array(keys).T[pick].view(np.int64), np.array(own).T[pick]
                last = np.where(width > 0, flat[np.maximum(np.cumsum(width) - 1, 0)] if len(flat) else 0, 0)
                owns, text = np.split(counts, np.cumsum(width)[:-1]), []
                text = [",".join(map(str, o)) for o in (o.tolist() for o in owns)]
                lists = (pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (flat, counts))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([side] * batch.num_rows), form, pa.array(last, pa.int64(), mask=width == 0), pa.array(text), *lists], names=["digest", "side", "form", "last", "owns", "keys", "own"])


def _seen(shared):
    """(key, seen): how often each context that passes the sieve is seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, held, size = shared.value, [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                for part in _Contexts(*(batch.column(j) for j in (0, 1, 2))).counts(sieve):
                    held.append(part)
                    size += len(part[0])
                if size > _BUFFER:
                    key, n = merged()
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "seen"])
                    held, size = [], 0
        if held:
            key, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "seen"])

    return run


def _sieve(edges: DataFrame) -> np.ndarray:
    """One bit for each key of edges; other keys share bits with them, so that the sieve lets some pass in vain."""
    slot = F.col("key").bitwiseAND(F.lit(SIEVE_BITS - 1))
    words = edges.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(SIEVE_BITS >> 6, np.int64)
    for r in words.collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def edge_scores(texts: DataFrame, salts: int) -> DataFrame:
    """(digest, side, form, score): log-odds that the text ends ('end') or starts ('start') where it does against that it goes
    on.  texts: (digest, text, front, back), distinct texts with the forms in which they start and end.

    Two models of character n-grams, one read backward from the end and one forward from the start, are trained on all
    texts: for each context of 1 to 6 characters the number of times it is seen and that a text has its edge there, over
    all forms of writing for 1 and 2 characters, then for 1, 2, 3, 4 and 6 inside the form.  The share of edges is
    interpolated from the first to the last, so that an edge not seen before in its form falls back.  A text says nothing
    on itself: its own counts are taken off before.  Only contexts that stand at some edge are counted; a sieve of them,
    of fixed size, is what is sent to the tasks.  Contexts are joined once each; the scores go back to the texts by
    salted keys, as some context ends a third of them.
    """
    kind = texts.schema["digest"].dataType.simpleString()
    final = stored(texts.select("digest", "text", "front", "back").mapInArrow(_edges, f"digest {kind}, side string, form string, last long, owns string, keys array<long>, own array<long>"))
    cases = final.where("last is not null").groupBy("side", "last", "owns").agg(F.first("keys").alias("keys"), F.first("own").alias("own"), F.count(F.lit(1)).alias("n"))
    cases = cases.select("side", "last", "owns", "n", F.posexplode(F.arrays_zip("keys", "own")).alias("k", "x")).select("side", "last", "owns", "n", "k", F.col("x.keys").alias("key"), F.col("x.own").alias("own"))
    edges = cases.groupBy("key").agg(F.sum("n").alias("edge"))
    shared = texts.sparkSession.sparkContext.broadcast(_sieve(edges))
    seen = texts.select("text", "front", "back").mapInArrow(_seen(shared), "key long, seen long").groupBy("key").agg(F.sum("seen").alias("seen"))
    others = F.struct("k", (F.col("seen") - F.col("own")).alias("seen"), (F.col("edge") - 1).alias("edge"))
    joined = cases.join(edges.join(seen, "key"), "key").groupBy("side", "last", "owns").agg(F.array_sort(F.collect_list(others)).alias("orders"))
    # both shares, as that of the texts that go on vanishes beside 1 where all end
    step = lambda s, o: F.struct(((o["edge"] + 3 * s["ends"]) / (o["seen"] + 3)).alias("ends"), ((o["seen"] - o["edge"] + 3 * s["goes"]) / (o["seen"] + 3)).alias("goes"))
    share = F.aggregate("orders", F.struct(F.lit(0.02).alias("ends"), F.lit(0.98).alias("goes")), step)
    scored = joined.select("side", "last", "owns", (F.ln(share["ends"]) - F.ln(share["goes"])).alias("score"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    back = final.select("digest", "side", "form", "last", "owns").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int"))
    return back.join(scored, ["side", "last", "owns", "salt"], "left").select("digest", "side", "form", "score")


def edge_thresholds(scores: DataFrame, usual: float = -0.5, least: int = 50) -> DataFrame:
    """(side, form, threshold): where the scores of a form of writing part into lost and whole edges: the middle of the
    stretch of 0.4 between -1.5 and 0.5 in which the fewest texts lie, of equally empty ones that nearest to `usual`.
    Forms of fewer than `least` texts have the usual threshold."""
    low, step, bins, wide = -1.5, 0.05, 40, 8
    at = F.floor((F.col("score") - low) / step)
    counted = scores.groupBy("side", "form", F.when(at.between(0, bins - 1), at.cast("int")).otherwise(-1).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    g = counted.groupBy("side", "form").agg(F.sum("n").alias("texts"), F.collect_list(F.struct("bin", "n")).alias("x"))
    inside = lambda b: F.aggregate(F.filter("x", lambda v: v["bin"].between(b, b + wide - 1)), F.lit(0).cast("long"), lambda total, v: total + v["n"])
    middle = lambda b: F.lit(low) + (b + wide / 2) * step
    windows = F.transform(F.sequence(F.lit(0), F.lit(bins - wide)), lambda b: F.struct(inside(b).alias("n"), F.round(F.abs(middle(b) - usual), 6).alias("off"), middle(b).alias("at")))
    return g.select("side", "form", F.when(F.col("texts") >= least, F.array_min(windows)["at"]).otherwise(usual).alias("threshold"))


def truncated_texts(df: DataFrame, key: str, text: str, rows_per_salt: int = 1_000_000) -> DataFrame:
    """(key, lost_end, lost_start, end_score, start_score), a row for each non-blank text.

    An edge is lost where the log-odds of edge_scores() are below the threshold of its form of writing, found for this
    column by edge_thresholds().  An exact check follows: a text whose
    last character is a comma, a colon or an opening bracket has lost its end.  Copies of a text are one text in the
    model and all get its scores.  Null keys and null and blank texts give no row; a text of one character has no context, and only
    the exact check applies.  A frequent text or context is joined in a part for each rows_per_salt rows.  Repeated keys give one row, lost where any of their texts is; further columns are ignored.
    """
    rows = stored(_texts(df, key, text).withColumn("digest", F.sha2("text", 256)))
    once = stored(rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("text", "front", "back"))))
    salts = 1 + rows.count() // rows_per_salt
    salted = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scores = stored(edge_scores(once, salts).withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(salts)).cast("int")))
    marked = scores.join(salted(edge_thresholds(scores.where("score is not null"))), ["side", "form", "salt"], "left").withColumn("lost", F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)))
    of = lambda side: (F.min(F.when(F.col("side") == side, F.col("score"))).alias(f"{side}_score"), F.coalesce(F.bool_or((F.col("side") == side) & F.col("lost")), F.lit(False)).alias(f"lost_{side}"))
    flags = salted(marked.groupBy("digest").agg(*of("end"), *of("start")))
    ids = rows.select("id", "digest", F.col("text").rlike(r"[,:\[{(]$").alias("hangs"), F.pmod(F.hash("id", F.monotonically_increasing_id()), F.lit(salts)).alias("salt"))
    out = ids.join(flags, ["digest", "salt"]).groupBy("id")
    return out.agg(F.bool_or(F.col("lost_end") | F.col("hangs")).alias("lost_end"), F.bool_or("lost_start").alias("lost_start"), F.min("end_score").alias("end_score"), F.min("start_score").alias("start_score")).withColumnRenamed("id", key)
