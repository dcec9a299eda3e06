"""Passages of evaluation texts inside a corpus, by CGK embedding, bit-sampling LSH and edit verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.functions.canonical import canonical_form
from glossarium.sources.session import spread

_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
MOST_REPETITIONS = 256
# Characters of held-out text that are sent to the tasks at once; more of it is taken in further blocks.
BLOCK_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text in consistent form: runs of letters or digits, in lower case; a word broken at a line end is whole."""
    return _WORD.findall(_BROKEN.sub("", text).lower() if "-" in text else text.lower())


class WindowHash:
    """CGK embedding of windows of words, and its bit samples.

    A random walk reads a window: at step j it writes the word under its pointer, and the pointer moves on if a random
    bit of (j, word) says so.  Equal windows walk alike; windows within a few edits stay together on most steps, so that
    their Hamming distance is small.  Each repetition has a walk of its own and takes `bits` of its steps as a key.  The
    number of repetitions is the least with which the wished share of item windows, 5,000 of them at most, meets its
    randomly edited copy; ValueError if MOST_REPETITIONS don't reach it.
    """

    def __init__(self, window: int, max_edits: int, recall: float, sample: np.ndarray, bits: int = 8, seed: int = 7):
        self.window, self.bits, self.steps = window, bits, 3 * window
        self.rng = np.random.default_rng(seed)
        self._draw(1)
        if max_edits and len(sample):
            self._draw(MOST_REPETITIONS)
            sample = sample[self.rng.permutation(len(sample))[:5000]].astype(np.int64)
            edited = self._edited(sample, max_edits)
            met, n = np.zeros(len(sample), bool), 0
            while n < MOST_REPETITIONS and met.mean() < recall:
                met |= self._key(sample, n) == self._key(edited, n)
                n += 1
            if met.mean() < recall:
                raise ValueError(f"{n} repetitions reach a recall of {met.mean():.3f} of {recall}: take fewer bits or edits")
            self._draw(n)

    def _draw(self, n: int) -> None:
        rng = np.random.default_rng(11)
        drawn = [(rng.integers(0, 2**64, self.steps, dtype=np.uint64) | np.uint64(1), np.sort(rng.choice(self.steps, self.bits, replace=False))) for _ in range(n)]
        self.repetitions, self.walks, self.picks = n, np.array([w for w, _ in drawn]), np.array([p for _, p in drawn])

    def _edited(self, windows: np.ndarray, edits: int) -> np.ndarray:
        """Windows with that many differences: replaced words (one each), and words dropped or put in, after which the
        window ends a word later or earlier (two each)."""
        out = windows.copy()
        for i in range(len(out)):
            left = edits
            while left:
                at, fresh, kind = self.rng.integers(self.window), int(self.rng.integers(2**31, 2**40)), self.rng.integers(3)
                if left == 1 or kind == 0:
                    out[i, at], left = fresh, left - 1
                else:
                    out[i], left = (np.append(np.delete(out[i], at), fresh) if kind == 1 else np.insert(out[i], at, fresh)[:-1]), left - 2
        return out

    def _key(self, windows: np.ndarray, r: int) -> np.ndarray:
        n = len(windows)
        padded = np.concatenate([windows, np.zeros((n, 1), windows.dtype)], axis=1)
        at, row, key, picked = np.zeros(n, np.int64), np.arange(n), np.full(n, r + 1, np.uint64), set(self.picks[r])
        with np.errstate(over="ignore"):
            for j in range(max(picked) + 1):
                word = padded[row, at].astype(np.uint64)
                if j in picked:
                    key = (key ^ (word + np.uint64(j + 1))) * _MIX
                    key ^= key >> np.uint64(31)
                move = ((word + _MIX) * self.walks[r, j]) >> np.uint64(63)
                at = np.minimum(at + move.astype(np.int64), self.window)
        return key

    def keys(self, windows: np.ndarray) -> list[np.ndarray]:
        return [self._key(windows, r) for r in range(self.repetitions)]


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(ids, size) if len(ids) >= size else np.empty((0, size), ids.dtype)


def edit_distances(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Words to insert, drop or replace between two windows, for each row of two arrays of windows.  With `most`, only
    places that many words apart are compared, and a distance above it is just some number above it."""
    size = a.shape[1]
    most = size if most is None else min(most, size)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(a.shape[1], most + 1, np.int16)
    row = [np.full(a.shape[1], j, np.int16) if j <= most else far for j in range(size + 1)]
    for i in range(size):
        low, high = max(0, i - most), min(size, i + most + 1)
        last, row[low] = row[low], np.full(a.shape[1], i + 1, np.int16) if low == 0 and i < most else far if low else row[0] + np.int16(1)
        for j in range(low, high):
            here = np.minimum(np.minimum(row[j + 1] if j + 1 <= i + most else far, row[j]) + np.int16(1), last + (a[i] != b[j]))
            last, row[j + 1] = row[j + 1], here
    return row[size].astype(np.int64)


def _pairs_of(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    """(place in found, place in table) of equal values; table is sorted."""
    low, high = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
    width = high - low
    w = np.repeat(np.arange(len(found)), width)
    return np.column_stack([w, np.repeat(low, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)])


class _Index:
    """The windows of a block of held-out texts, with the bit samples of each; built where it is used."""

    def __init__(self, texts: list[tuple[object, str]], window: int, max_edits: int, recall: float):
        self.window, self.max_edits, self.names, self.vocabulary = window, max_edits, [], {}
        spans, owner, pairs = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for name, text in texts:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids) >= window:
                spans.append(_windows(ids, window))
                if name not in self.names[-1:]:
                    self.names.append(name)
                owner.append(np.full(len(spans[-1]), len(self.names) - 1))
                pairs.append(self._bigrams(ids))
        self.windows, self.owners, self.bigrams = np.concatenate(spans), np.concatenate(owner), np.unique(np.concatenate(pairs))
        self.hashing, self.tables = WindowHash(window, max_edits, recall, self.windows), None

    @staticmethod
    def _bigrams(ids: np.ndarray) -> np.ndarray:
        return ids[:-1].astype(np.int64) << 32 | ids[1:]

    def _candidates(self, ids: np.ndarray) -> np.ndarray:
        """Where windows start that have enough pairs of neighbours of the held-out texts: an edit can't change more than
        two of them, so that no window within max_edits is lost."""
        grams = self._bigrams(ids)
        at = np.minimum(np.searchsorted(self.bigrams, grams), len(self.bigrams) - 1)
        sums = np.concatenate([[0], np.cumsum((self.bigrams[at] == grams) & (grams >> 32 > 0))])
        near = sums[self.window - 1 :] - sums[: len(sums) - self.window + 1]
        return np.flatnonzero(near >= max(self.window - 1 - 2 * self.max_edits, 1))

    def matches(self, texts: list[str]) -> pd.DataFrame:
        """(doc, owner, windows, edits): which of the texts match which held-out ones."""
        none = pd.DataFrame({"doc": [], "owner": [], "windows": [], "edits": []})
        if not len(self.windows):
            return none
        get, parts = self.vocabulary.get, []
        gap = np.zeros(self.window, np.int32)
        for t in texts:
            parts += [np.fromiter((get(w, 0) for w in words_of(t)), np.int32), gap]
        ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        at = self._candidates(ids)
        doc = np.searchsorted(ends[1::2], at, "right")
        inside = at + self.window <= ends[::2][doc]
        at, doc = at[inside], doc[inside]
        if not len(at):
            return none
        found, back = np.unique(_windows(ids, self.window)[at], axis=0, return_inverse=True)
        if self.tables is None:
            keys = self.hashing.keys(self.windows)
            orders = [np.argsort(k, kind="stable") for k in keys]
            self.tables = [(k[o], o) for k, o in zip(keys, orders)]
        near = []
        for k, (table, order) in zip(self.hashing.keys(found), self.tables):
            pair = _pairs_of(table, k)
            near.append(pair[:, 0] * len(self.windows) + order[pair[:, 1]])
            if sum(map(len, near)) > 4_000_000:
                near = [np.unique(np.concatenate(near))]
        near = np.unique(np.concatenate(near))
        w, item = near // len(self.windows), near % len(self.windows)
        edits = np.concatenate([np.empty(0, np.int64), *(edit_distances(found[w[i : i + 200_000]], self.windows[item[i : i + 200_000]], self.max_edits) for i in range(0, len(w), 200_000))])
        ok = edits <= self.max_edits
        best = pd.DataFrame({"w": w[ok], "owner": self.owners[item[ok]], "edits": edits[ok]}).groupby(["w", "owner"]).edits.min().reset_index()
        places = pd.DataFrame({"w": back.ravel(), "doc": doc})
        return places.merge(best, on="w").groupby(["doc", "owner"]).agg(windows=("w", "size"), edits=("edits", "min")).reset_index()


def leaked_passages(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = 8, max_edits: int = 1, recall: float = 0.99, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, item_key, windows, edits): each document and item with a passage of `window` words in common, up to
    max_edits words of difference; `windows` of the document's windows match, at best with `edits` differences.  A word
    that is replaced counts one; one that is dropped or put in counts two, as the window then ends at another word.

    Words are compared in the consistent form, in lower case, without punctuation, markup and white space; words broken
    at a line end are whole.  Documents are read once for each block of items, and their text is never shuffled.
    A window can only match if most of its pairs of neighbouring words are pairs of the items, which is checked first and
    loses none; then its bit samples are looked up among those of the items, and each candidate is verified by its edit
    distance.  Windows without a difference agree in every repetition, so that these are found without exception; others
    reach the given recall.

    Items are taken in blocks of block_chars characters, so that what is sent to the tasks is bounded whatever their
    number (an item is never split).  Null keys, and null, empty and shorter texts and items give nothing;
    repeated texts each give their rows; documents without a match give no row; further columns are ignored.
    """
    held = items.select(F.col(item_key).alias("item"), canonical_form(items[item_text]).alias("text")).where("text is not null").distinct()
    chars = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    slim = spread(docs.select(docs[key].alias("key"), docs[text].alias("text")).where("key is not null and text is not null")).withColumn("text", canonical_form(F.col("text")))
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def one(block: int) -> DataFrame:
        rows = held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect() if blocks > 1 else held.collect()
        index = _Index(sorted(((r.item, r.text) for r in rows), key=lambda r: (str(r[0]), r[1])), window, max_edits, recall)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                found = index.matches(batch.text.tolist())
                if len(found):
                    names = [index.names[o] for o in found.owner.astype(int)]
                    yield pd.DataFrame({"key": batch.key.to_numpy()[found.doc.astype(int)], "item": names, "windows": found.windows, "edits": found.edits})

        return slim.mapInPandas(matches, f"key {kinds[0]}, item {kinds[1]}, windows long, edits int")

    found = reduce(DataFrame.unionAll, map(one, range(blocks)))
    return found.toDF(key, item_key, "windows", "edits")
