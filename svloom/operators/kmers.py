"""K-mers of DNA as numbers of two bits a base (A 0, C 1, G 2, T 3; k of 31 at most), computed from whole Arrow batches.

K-mers with any other letter are no k-mers. Numbers sort as their strings do, so the canonical k-mer is the smaller of two numbers.
Counts shuffle no k-mers but stretches of sequence: neighbouring k-mers mostly have the same minimizer (the least hash
among their canonical M-mers, alike on both strands), and such a stretch goes, four bases a byte, to the shard of
its minimizer, where its k-mers are cut out and counted. A shard holds about SHARD k-mers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

M, SHARD = 11, 1 << 21
#: Bases that one step takes, so that a long sequence costs no more memory than others.
SLICE = 1 << 18
_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODE[list(_pair)] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)
#: The four letters of a byte, as one number.
_FOUR = np.stack([_LETTER[np.arange(256) >> shift & 3] for shift in (6, 4, 2, 0)], 1).view(np.uint32).ravel()
#: Stretches of which one step takes the k-mers: their arrays stay in a core's cache.
STRETCHES = 1 << 12


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes (4: none) of all texts and the n + 1 offsets of the texts in them; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return _CODE[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]], offsets - offsets[0]


def numbers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, canonical) k-mers from each place on; what other letters or a text's end spoil must be left out with ``spoiled``."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forward = _joined((codes & 3).astype(np.int64), k, True)
    back = _joined(3 - (codes & 3).astype(np.int64), k, False)
    return forward, np.minimum(forward, back)


def _joined(x: np.ndarray, k: int, first_high: bool) -> np.ndarray:
    """Digits to base four of ``k`` neighbours, by doubling."""
    have, out, done = 1, None, 0
    n = len(x) - k + 1
    while True:
        if k & have:
            part = x[done : done + n] if first_high else x[done : done + n]
            if out is None:
                out = part.copy()
            else:
                out = (out << 2 * have | part) if first_high else (part << 2 * done | out)
            done += have
        if 2 * have > k:
            return out
        x = (x[:-have] << 2 * have | x[have:]) if first_high else (x[have:] << 2 * have | x[:-have])
        have *= 2


def spoiled(codes: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether the k letters from each place on hold a letter that is no base, or pass a text's end."""
    n = max(len(codes) - k + 1, 0)
    out = np.zeros(n, bool)
    bad = np.flatnonzero(codes == 4)
    cuts = offsets[1:-1]
    for places, before in ((bad, k - 1), (cuts, k - 1)):
        diff = np.zeros(n + 1, np.int32)
        np.add.at(diff, np.clip(places - before, 0, n), 1)
        np.add.at(diff, np.clip(places + (places is bad), 0, n), -1)
        out |= np.cumsum(diff[:n]) > 0
    return out


def text(kmers: np.ndarray, k: int) -> pa.Array:
    """K-mers as strings."""
    words = -(-k // 4)  # four letters at once, from a table; those before the first are cut off
    letters = np.empty((len(kmers), words), np.uint32)
    for i in range(words):
        letters[:, i] = _FOUR[(kmers >> 8 * (words - 1 - i)) & 255]
    letters = np.ascontiguousarray(letters.view(np.uint8).reshape(len(kmers), 4 * words)[:, 4 * words - k :])
    offsets = np.arange(len(kmers) + 1, dtype=np.int64) * k
    return pa.LargeStringArray.from_buffers(len(kmers), pa.py_buffer(offsets), pa.py_buffer(letters)).cast(pa.string())


def low_complexity(codes: np.ndarray, k: int) -> np.ndarray:
    """For the k bases from each place on: one base in at least 0.8 of the places, or a run of at least 0.6 of them."""
    n = max(len(codes) - k + 1, 0)
    out = np.zeros(n, bool)
    if not n:
        return out
    many, run = -(-8 * k // 10), -(-6 * k // 10)
    for base in range(4):
        total = np.concatenate([[0], np.cumsum(codes == base)])
        out |= total[k:] - total[:-k] >= many
    change = np.concatenate([[True], codes[1:] != codes[:-1]])
    place = np.arange(len(codes))
    length = place - np.maximum.accumulate(np.where(change, place, 0)) + 1
    ends = np.concatenate([[0], np.cumsum(length >= run)])  # a run that ends at i reaches back to i - run + 1 at least
    return out | (ends[k:] - ends[run - 1 : len(ends) - k + run - 1] > 0)


def _pieces(codes: np.ndarray, offsets: np.ndarray, k: int):
    """(first place, codes, offsets) of stretches of about SLICE bases; each k-mer starts in one of them."""
    for low in range(0, max(len(codes) - k + 1, 0), SLICE):
        high = min(low + SLICE + k - 1, len(codes))
        yield low, codes[low:high], np.clip(offsets, low, high) - low


def _row_groups(batch: pa.RecordBatch, at: int):
    """Slices of whole rows of a batch with about SLICE bases in column ``at``, or one longer row."""
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy().astype(np.int64)
    group = np.maximum(np.cumsum(size) - 1, 0) // SLICE
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(size) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def of_rows(rows: DataFrame, sequence: str, k: int, distinct: bool = False, complex_only: bool = False) -> DataFrame:
    """``rows`` with ``kmer`` (long, canonical), one row for each k-mer of the column ``sequence``, which is left out.

    ``distinct``: each once a row; ``complex_only``: none of low complexity. Nothing is shuffled. A batch is taken a few rows at
    a time, so memory is that of SLICE bases or of the longest sequence.
    """
    kept = [c for c in rows.columns if c != sequence]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("kmer", T.LongType())])

    def apply(batches):
        for batch in (part for whole in batches for part in _row_groups(whole, len(kept))):
            codes, offsets = column(batch.column(len(kept)))
            row, kmers = [], []
            for low, part, cuts in _pieces(codes, offsets, k):
                good = ~spoiled(part, cuts, k)
                if complex_only:
                    good &= ~low_complexity(part, k)
                places = np.flatnonzero(good)
                row.append(np.searchsorted(offsets, low + places, "right") - 1)
                kmers.append(numbers(part, k)[1][places])
            row, kmers = np.concatenate([np.zeros(0, np.int64), *row]), np.concatenate([np.zeros(0, np.int64), *kmers])
            if distinct and len(row):
                order = np.lexsort((kmers, row))
                row, kmers = row[order], kmers[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (kmers[1:] != kmers[:-1])])
                row, kmers = row[new], kmers[new]
            for a in range(0, len(row), SLICE):
                of = pa.array(row[a : a + SLICE])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(of) for i in range(len(kept))], pa.array(kmers[a : a + SLICE])], names=schema.names)

    return rows.select(*kept, sequence).mapInArrow(apply, schema)


def complexity(rows: DataFrame, sequence: str, k: int) -> DataFrame:
    """``rows`` with n, their k-mers of ``sequence``, and low, how many of them are of low complexity."""
    kept = [c for c in rows.columns if c != sequence]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("n", T.LongType()), T.StructField("low", T.LongType())])

    def apply(batches):
        for batch in batches:
            codes, offsets = column(batch.column(len(kept)))
            n, low = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, part, cuts in _pieces(codes, offsets, k):
                good = ~spoiled(part, cuts, k)
                for out, which in ((n, good), (low, good & low_complexity(part, k))):
                    row = np.searchsorted(offsets, first + np.flatnonzero(which), "right") - 1
                    out += np.bincount(row, minlength=len(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n), pa.array(low)], names=schema.names)

    return rows.select(*kept, sequence).mapInArrow(apply, schema)


def spelled(rows: DataFrame, k: int, kmer: str = "kmer") -> DataFrame:
    """``rows`` with the number ``kmer`` written out."""
    at = rows.columns.index(kmer)
    schema = T.StructType([T.StructField(kmer, T.StringType()) if f.name == kmer else f for f in rows.schema.fields])

    def apply(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = text(columns[at].to_numpy(), k)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(apply, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def stretches(codes: np.ndarray, offsets: np.ndarray, k: int, m: int = M):
    """(minimizer, first place, number of k-mers) of the stretches of neighbouring k-mers with one minimizer."""
    m = min(m, k)
    hashes = _mixed(numbers(codes, m)[1])
    have, window = 1, k - m + 1
    least = hashes
    while 2 * have <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
    good = ~spoiled(codes, offsets, k)
    new = good.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~good[:-1]
    begins = np.flatnonzero(new)
    stops = np.flatnonzero(np.concatenate([new, [True]]) | np.concatenate([~good, [True]]))
    ends = stops[np.searchsorted(stops, begins, "right")] if len(begins) else begins
    return least[begins], begins, ends - begins


def of_stretches(codes: np.ndarray, starts: np.ndarray, bases: np.ndarray, k: int):
    """Canonical k-mers of stretches of ``bases`` letters that begin at ``starts``, STRETCHES stretches at a time."""
    for low in range(0, len(bases), STRETCHES):
        own, first = bases[low : low + STRETCHES] - k + 1, starts[low : low + STRETCHES]
        begin, end = first[0], first[-1] + bases[min(low + STRETCHES, len(bases)) - 1]
        places = np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield numbers(codes[begin:end], k)[1][places - begin]


def counts(rows: DataFrame, sequence: str, k: int, shards: int) -> DataFrame:
    """(kmer, n): canonical k-mers of all rows and how often they occur."""

    def send(batches):
        for batch in batches:
            codes, offsets = column(batch.column(0))
            for _, part, cuts in _pieces(codes, offsets, k):
                name, begins, size = stretches(part, cuts, k)
                if not len(name):
                    continue
                of = (_mixed(name) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                of, begins, bases = of[order], begins[order], size[order] + k - 1
                packed = (bases + 3) // 4
                # each stretch begins with a byte of its own
                starts = np.cumsum(4 * packed) - 4 * packed
                every = np.repeat(begins - (np.cumsum(bases) - bases), bases) + np.arange(bases.sum())
                wide = np.zeros(4 * packed.sum(), np.uint8)
                wide[np.repeat(starts - (np.cumsum(bases) - bases), bases) + np.arange(bases.sum())] = part[every]
                data = wide[::4] << 6 | wide[1::4] << 4 | wide[2::4] << 2 | wide[3::4]
                cuts_ = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                at = np.concatenate([[0], np.cumsum(packed)])
                rows_ = list(zip(cuts_[:-1], cuts_[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[cuts_[:-1]]), pa.array([bases[a:b].astype("<u4").tobytes() for a, b in rows_], pa.binary()), pa.array([data[at[a] : at[b]].tobytes() for a, b in rows_], pa.binary())],
                    names=["shard", "bases", "data"],
                )

    def count(batches):
        at, held = None, []

        def finished():
            bases = np.frombuffer(b"".join(x[0] for x in held), "<u4").astype(np.int64)
            data = np.frombuffer(b"".join(x[1] for x in held), np.uint8)
            codes = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], 1).ravel()
            starts = np.cumsum(4 * ((bases + 3) // 4)) - 4 * ((bases + 3) // 4)
            kmers, n = np.unique(np.concatenate(list(of_stretches(codes, starts, bases, k))), return_counts=True)
            for a in range(0, len(kmers), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(kmers[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["kmer", "n"])

        for batch in batches:
            for shard, bases, data in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at and held:
                    yield from finished()
                    held = []
                at = shard
                held.append((bases, data))
        if held:
            yield from finished()

    sent = rows.select(sequence).mapInArrow(send, "shard long, bases binary, data binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, "kmer long, n long")
