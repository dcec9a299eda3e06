"""Occurrence and record counts of all n-grams, from a sorted suffix array with common-prefix intervals.

Suffixes are written in units of three bytes: a frequent term is one unit, any other is spelled in as many as it needs.
Nothing is lost, byte order is an order of suffixes, and a suffix of ten terms takes 33 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.sources.session import stored

# Frequent terms that have a short code, and their characters, at most: together they bound what is shipped to tasks.
SHORT_CODES, SHORT_TERM = 65_536, 64
# Sorted suffixes that are looked at in one step, and bytes of suffixes that are held, at most.
STEP_ROWS, _BYTES = 400_000, 32_000_000
_UNIT = 3
# The first byte of a unit: below 128 that of a short code; of a spelled term, how many bytes of it the unit holds,
# with 128 in its first unit and 192 in a further one.
_SPELLED, _FURTHER = 0x80, 0xC0


def _spelled(term: str) -> bytes:
    raw = term.encode("utf-8", "surrogatepass")
    parts = [raw[i : i + 2] for i in range(0, max(len(raw), 1), 2)]
    return b"".join(bytes([(_FURTHER if i else _SPELLED) | len(p)]) + p.ljust(2, b"\0") for i, p in enumerate(parts))


def _codes(terms: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all terms, number of units of each term)."""
    at = pc.index_in(terms, value_set=known)
    short = at.is_valid().to_numpy(zero_copy_only=False)
    ids = at.fill_null(0).to_numpy().astype(np.uint32)
    if short.all():
        return np.stack([ids >> 16, ids >> 8 & 255, ids & 255], 1).astype(np.uint8).ravel(), np.ones(len(ids), np.int64)
    rare = pc.dictionary_encode(terms.filter(pa.array(~short)))
    spelled, which = [np.frombuffer(_spelled(t), np.uint8) for t in rare.dictionary.to_pylist()], rare.indices.to_numpy()
    units = np.ones(len(ids), np.int64)
    units[~short] = np.array([len(s) // _UNIT for s in spelled], np.int64)[which]
    starts = (np.cumsum(units) - units) * _UNIT
    flat = np.zeros(int(units.sum()) * _UNIT, np.uint8)
    for j, shift in enumerate((16, 8, 0)):
        flat[starts[short] + j] = ids[short] >> shift & 255
    for start, w in zip(starts[~short], which):
        flat[start : start + len(spelled[w])] = spelled[w]
    return flat, units


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, each: int = 1) -> pa.Array:
    """BINARY values of `each` pieces of flat, taken from these places."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    whole = offsets[::each].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(whole) - 1, [None, pa.py_buffer(whole), pa.py_buffer(flat[at])]).cast(pa.binary())


def shared_with_before(terms: np.ndarray) -> np.ndarray:
    """For each suffix of one record, the number of terms in common with the one before it in suffix order.  The order is
    found by doubling, the common prefixes from left to right, so that long records take little more than short ones."""
    n, rank, step = len(terms), np.unique(terms, return_inverse=True)[1] + 1, 1
    while True:
        after = np.concatenate([rank[step:], np.zeros(min(step, n), rank.dtype)])[:n]
        order = np.lexsort((after, rank))
        fresh = np.concatenate([[1], (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank.max() == n or step >= n:
            break
        step *= 2
    out, k, values, place = np.zeros(n, np.int64), 0, terms.tolist(), rank - 1
    for i in range(n):
        if place[i] == 0:
            k = 0
            continue
        j = int(order[place[i] - 1])
        while max(i, j) + k < n and values[i + k] == values[j + k]:
            k += 1
        out[i], k = k, max(k - 1, 0)
    return out


def _again(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """shared_with_before() of the suffixes of all records; those of a record without a repeated term share nothing."""
    out, first, record = np.zeros(len(codes), np.int64), np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((codes, record))
    twice = np.flatnonzero((codes[order][1:] == codes[order][:-1]) & (record[order][1:] == record[order][:-1]))
    for r in np.unique(record[order][twice]):
        out[first[r] : first[r] + lengths[r]] = shared_with_before(codes[first[r] : first[r] + lengths[r]])
    return out


def _suffixes(shared):
    """(suffix, again, weight) at each position of a record: the field and the terms from there on.  Equal records of a
    batch are taken together first, which takes the weight off frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            n, terms = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten()
            head, head_units = _codes(batch.column(0), known)
            flat, units = _codes(terms, known)
            both, record, ends = np.concatenate([head, flat]), np.repeat(np.arange(len(n)), n), np.cumsum(units)
            stop, field = ends[np.cumsum(n) - 1], np.cumsum(head_units) - head_units

            def pieces(of: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Where the two pieces of a suffix lie, the field and the rest of the record, and how long they are."""
                return np.stack([field[of], len(head) // _UNIT + begin], 1) * _UNIT, np.stack([head_units[of], stop[of] - begin], 1) * _UNIT

            whole = [x.ravel() for x in pieces(np.arange(len(n)), np.concatenate([[0], stop[:-1]]))]
            once = pa.table({"w": _gathered(both, *whole, 2), "i": np.arange(len(n))}).group_by("w").aggregate([("i", "min"), ("i", "count")])
            weight = np.zeros(len(n), np.int64)
            weight[once["i_min"].to_numpy()] = once["i_count"].to_numpy()
            again, heavy = _again(pc.dictionary_encode(terms).indices.to_numpy(), n), weight[record]
            at = np.flatnonzero(heavy)
            again, heavy, (starts, sizes) = again[at], heavy[at], pieces(record[at], (ends - units)[at])
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes.sum(1)) // _BYTES)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(sizes)]):
                suffix = _gathered(both, starts[low:high].ravel(), sizes[low:high].ravel(), 2)
                yield pa.RecordBatch.from_arrays([suffix, pa.array(again[low:high], pa.int32()), pa.array(heavy[low:high], pa.int64())], names=["suffix", "again", "weight"])

    return run


def _steps(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= most or size >= _BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _intervals(least: int, step_rows: int):
    """(gram, n, occurrences, again) of the intervals of sorted suffixes that have n terms in common, for every n: those
    of n = 1, those with at least `least` occurrences, and those at either end of a step, which others may continue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, step_rows):
            column = step.column("suffix").cast(pa.large_binary()).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[: offsets[-1]]
            again, weight = step.column("again").to_numpy(), step.column("weight").to_numpy()
            base, size = offsets[:-1] // _UNIT, np.diff(offsets) // _UNIT
            units = data.reshape(-1, _UNIT).astype(np.uint32) @ np.array([65536, 256, 1], np.uint32)
            opens = np.flatnonzero(units >> 22 != 3)  # the units at which a term starts
            before = np.searchsorted(opens, np.arange(len(units) + 1))
            depth = before[base + size] - before[base]
            # units in common with the suffix before, one after another as long as any two agree
            same, alive, k = np.zeros(len(size), np.int64), np.arange(1, len(size)), 0
            while len(alive):
                alive = alive[(size[alive] > k) & (size[alive - 1] > k)]
                alive = alive[units[base[alive] + k] == units[base[alive - 1] + k]]
                k += 1
                same[alive] = k
            terms = before[base + same] - before[base]
            partial = np.flatnonzero((same > 0) & (same < size))
            terms[partial[units[base[partial] + same[partial]] >> 22 == 3]] -= 1  # the last term in common goes on
            deep, n = np.flatnonzero(depth > 1), 1
            while len(deep):
                first = terms[deep] <= n  # the field and fewer than n terms in common: an interval starts
                first[0] = True
                first = np.flatnonzero(first)
                count, repeated = np.add.reduceat(weight[deep], first), np.add.reduceat(weight[deep] * (again[deep] >= n), first)
                keep = (count >= least) | (n == 1)
                keep[[0, -1]] = True
                at = deep[first[keep]]
                stop = np.append(opens, len(units))[np.minimum(before[base[at]] + n + 1, len(opens))]
                gram = _gathered(data, offsets[at], (np.minimum(stop, base[at] + size[at]) - base[at]) * _UNIT)
                yield pa.RecordBatch.from_arrays([gram, pa.array(np.full(len(at), n), pa.int32()), pa.array(count[keep], pa.int64()), pa.array(repeated[keep], pa.int64())], names=["code", "n", "occurrences", "again"])
                n += 1
                deep = deep[depth[deep] > n]

    return run


def _read(shared):
    """(field, gram, n, occurrences, records): the codes read back as terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, _UNIT)
            opens = np.flatnonzero(data[:, 0] < _FURTHER)
            short = data[opens, 0] < _SPELLED
            ids = data[opens].astype(np.int64) @ np.array([65536, 256, 1])
            words = np.empty(len(opens), object)
            words[short] = known.take(pa.array(ids[short])).to_numpy(zero_copy_only=False)
            stops = np.append(opens, len(data))[1:]
            for i in np.flatnonzero(~short):
                words[i] = b"".join(bytes(u[1 : 1 + (u[0] & 3)]) for u in data[opens[i] : stops[i]]).decode("utf-8", "surrogatepass")
            n = batch.column(1).to_numpy().astype(np.int64)
            heads = np.cumsum(n + 1) - n - 1
            body = np.ones(len(words), bool)
            body[heads] = False
            fields = pa.array([w[1:] or None if w[:1] != "=" else w[1:] for w in words[heads]], pa.string())
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(words[body], pa.string()))
            yield pa.RecordBatch.from_arrays([fields, grams, batch.column(1), batch.column(2), batch.column(3)], names=["field", "gram", "n", "occurrences", "records"])

    return run


def ngram_frequencies(rows: DataFrame, least: int = 1, step_rows: int = STEP_ROWS) -> DataFrame:
    """(field, gram ARRAY<STRING>, n, occurrences, records) of the n-grams of every length, up to whole records: of each
    term, and of each longer n-gram that occurs `least` times or more.  With least = 2 the result still is whole, as any
    n-gram of a record that isn't listed occurs once.

    rows: (field STRING, terms ARRAY<STRING>), one row per record; repeated rows count as records of their own.  Every
    position gives the suffix of its record.  The suffixes of one record are sorted, and each takes along how many terms
    it shares with the one before it: so many of its n-grams are duplicates inside the record.  All suffixes are then
    sorted by range over the cluster, whatever a frequent term or pair of terms weighs, and the intervals of common
    prefixes give the occurrences of the n-grams of every length, and the records as occurrences less duplicates.  Intervals that cross
    a step or a partition are put together by a last sum.  The most frequent terms, a bounded list, have short codes.

    Null or empty terms lists and null terms give nothing; a null field is a field of its own; an empty table gives no
    rows; further columns are ignored.  Suffixes are whole, so a record of k terms takes k x k / 2 codes.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("field").cast("string")), F.lit(""))
    lists = rows.select(name.alias("field"), F.filter("terms", lambda t: t.isNotNull()).alias("terms"))
    # empty lists go after the writing: a filter before it would have the expressions behind terms copied into it
    lists = stored(lists).where(F.size("terms") > 0)
    each = lists.select(F.explode_outer(F.array_append("terms", F.col("field"))).alias("term")).where(F.length("term") <= SHORT_TERM)
    often = each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(SHORT_CODES)
    shared = rows.sparkSession.sparkContext.broadcast(pa.array([r.term for r in often.collect()], pa.string()))
    suffixes = lists.mapInArrow(_suffixes(shared), "suffix binary, again int, weight long")
    found = suffixes.repartitionByRange("suffix").sortWithinPartitions("suffix").mapInArrow(_intervals(least, step_rows), "code binary, n int, occurrences long, again long")
    total = found.groupBy("code", "n").agg(F.sum("occurrences").alias("occurrences"), (F.sum("occurrences") - F.sum("again")).alias("records"))
    total = total.where((F.col("n") == 1) | (F.col("occurrences") >= least))
    return total.mapInArrow(_read(shared), "field string, gram array<string>, n int, occurrences long, records long")


def mark_frequencies(counts: DataFrame, all_records: int, rare_below: int = 3, common_above: float = 0.03) -> DataFrame:
    """counts with `mark`: 'rare' in fewer than rare_below records, 'common' in more than common_above of all records,
    else null.  Both bounds are strict; a term that is both is rare."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * all_records, "common")
    return counts.withColumn("mark", mark)
