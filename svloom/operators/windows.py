"""Dense feature windows of nine channels from alignments.

An operation is no row for each base that it covers. It becomes two differences (where it begins and where it ends) for the
counts and length sums, and events of equal place are combined before the shuffle, so what is shuffled grows with the operations.
A window's task turns its events into running sums and a dense array of size x 9 numbers, zeros included.

Channels, in order: mismatches, deletions, clips, insertions, mean and largest insertion, mean and largest deletion,
depth. Lengths are those cut to the window, as the source of these rules has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from svloom.operators import alignment as al, intervals as iv

CHANNELS = ["mismatches", "deletions", "clips", "insertions", "insertion_mean", "insertion_max", "deletion_mean", "deletion_max", "depth"]
MISMATCH, DELETION, CLIP, INSERTION, INSERTION_SUM, INSERTION_MAX, DELETION_SUM, DELETION_MAX, DEPTH = range(9)
COUNTS = [MISMATCH, DELETION, CLIP, INSERTION, DEPTH]


def window_events(reads: DataFrame, windows: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, window_start, channel, place, until, amount): differences of counts and sums, and largest lengths, within each window.

    ``reads``: the columns ``by``, ref_start, cigar, md (null without a tag) and flag (optional); ``windows``: ``by`` and
    window_start. Where ``until`` is null, ``amount`` is added from ``place`` on; else it is the largest so far of places
    ``place`` to ``until`` - 1.
    """
    if "flag" in reads.columns:
        reads = reads.where(F.col("flag").bitwiseAND(al.UNMAPPED) == 0)
    ref_end = F.greatest(al.reference_end(F.col("ref_start"), F.col("cigar")), F.col("ref_start") + 1)  # as long as one base at least
    reads = reads.select(*by, "ref_start", ref_end.alias("ref_end"), "cigar", "md" if "md" in reads.columns else F.lit(None).cast("string").alias("md"))
    key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by])
    left = al.with_moves(reads, {"rp": al.ON_REFERENCE}).withColumns({"key": key, "l_start": F.col("ref_start"), "l_end": F.col("ref_end")})
    right = windows.select(key.alias("key"), F.col("window_start").cast("long").alias("window_start")).distinct()
    right = right.withColumns({"r_start": F.col("window_start"), "r_end": F.col("window_start") + size})
    met = iv.overlap_join(left, right, "key", size, short=True).select(*by, "window_start", "ref_start", "ref_end", "moves", "md")
    start, end = F.col("window_start"), F.col("window_start") + size
    zero, width = F.lit(0).cast("long"), F.lit(size).cast("long")
    event = lambda channel, place, amount, until=None: F.struct(F.lit(channel).alias("channel"), place.cast("long").alias("place"), (F.lit(None) if until is None else until).cast("long").alias("until"), amount.cast("long").alias("amount"))
    one = F.lit(1)

    def step(x: Column) -> Column:
        at = F.col("ref_start") + x["rp"]
        p, q = F.greatest(at, start) - start, F.least(at + x["len"], end) - start
        inside = (at >= start) & (at < end)
        deletion = F.array(event(DELETION, p, one), event(DELETION, q, -one), event(DELETION_SUM, p, q - p), event(DELETION_SUM, q, p - q), event(DELETION_MAX, p, q - p, q))
        insertion = F.array(event(INSERTION, p, one), event(INSERTION, p + 1, -one), event(INSERTION_SUM, p, x["len"]), event(INSERTION_SUM, p + 1, -x["len"]), event(INSERTION_MAX, p, x["len"], p + 1))
        clip = F.array(event(CLIP, p, one), event(CLIP, p + 1, -one))
        return F.when((x["op"] == 2) & (p < q), deletion).when((x["op"] == 1) & inside, insertion).when(x["op"].isin(4, 5) & inside, clip)

    p, q = F.greatest(F.col("ref_start") - start, zero), F.least(F.col("ref_end") - start, width)
    covered = F.array(event(DEPTH, p, one), event(DEPTH, q, -one))
    events = F.flatten(F.concat(F.array(covered), F.filter(F.transform("moves", step), lambda x: x.isNotNull())))
    rows = met.select(*by, "window_start", F.explode(events).alias("x")).select(*by, "window_start", "x.*")
    wrong = al.trim_md(met.where("md is not null").select(*by, "window_start", "ref_start", "ref_end", "md"), start, end).where("kind = 'X' and cut > 0")
    p, q = F.col("at") - start, F.col("at") - start + F.col("cut")
    wrong = wrong.select(*by, "window_start", F.explode(F.array(event(MISMATCH, p, one), event(MISMATCH, q, -one))).alias("x")).select(*by, "window_start", "x.*")
    rows = rows.unionByName(wrong).where((F.col("place") < size))
    return rows.groupBy(*by, "window_start", "channel", "place", "until").agg(F.when(F.col("until").isNull(), F.sum("amount")).otherwise(F.max("amount")).alias("amount")).where("amount <> 0")


def log_normalized(values: np.ndarray) -> np.ndarray:
    return np.sign(values) * np.log1p(np.abs(values))


def window_matrices(reads: DataFrame, windows: DataFrame, by: list[str], size: int = 2000, normalize: bool = True, scale: str | None = None) -> DataFrame:
    """(by, window_start, values): each window's array of size x 9 numbers, base after base, for all windows, also those without reads.

    ``normalize`` takes log1p of all channels; ``scale`` names a column of ``windows``, a positive factor of the counts and the
    depth that is applied to them afterwards as log1p(expm1(x) * factor) (without ``normalize`` as a plain factor); others raise.
    """
    factor = F.lit(1.0) if scale is None else F.col(scale).cast("double")
    spans = windows.select(*by, F.col("window_start").cast("long").alias("window_start"), factor.alias("factor")).distinct()
    bad = F.raise_error(F.lit("a depth scale must be positive"))
    heads = spans.select(*by, "window_start", F.lit(-1).alias("channel"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("amount"), F.when(F.col("factor") > 0, F.col("factor")).otherwise(bad).alias("factor"))
    events = window_events(reads, windows, by, size).withColumn("factor", F.lit(None).cast("double"))
    keys = [*by, "window_start"]
    schema = T.StructType([*spans.select(*keys).schema.fields, T.StructField("values", T.ArrayType(T.DoubleType()))])
    n = len(keys)

    def dense(channel, place, until, amount) -> np.ndarray:
        out = np.zeros((size + 1, 9))
        adds = np.isnan(until)
        np.add.at(out, (place[adds], channel[adds]), amount[adds])
        np.cumsum(out, 0, out=out)
        out = out[:size]
        for total, count in ((INSERTION_SUM, INSERTION), (DELETION_SUM, DELETION)):
            out[:, total] = np.divide(out[:, total], out[:, count], out=np.zeros(size), where=out[:, count] > 0)
        order = np.flatnonzero(~adds)
        for i in order[np.argsort(amount[order], kind="stable")]:  # larger ones over smaller ones
            out[place[i] : int(until[i]), channel[i]] = amount[i]
        return out

    def apply(batches):
        at, head, held, factor = None, None, [], 1.0

        def finished():
            parts = [np.concatenate([h[k] for h in held]) if held else np.zeros(0) for k in range(4)]
            values = dense(parts[0].astype(int), parts[1].astype(int), parts[2], parts[3])
            if normalize:
                values = log_normalized(values)
            if factor != 1:
                values[:, COUNTS] = np.log1p(np.expm1(values[:, COUNTS]) * factor) if normalize else values[:, COUNTS] * factor
            return pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array([0, 9 * size], pa.int32()), pa.array(values.ravel()))], names=schema.names)

        for batch in batches:
            columns = [batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(5)]
            heads_at = np.flatnonzero(columns[0] == -1).tolist()
            for a, b in zip([0, *heads_at], [*heads_at, batch.num_rows]):
                if a < b and columns[0][a] == -1:
                    if head is not None:
                        yield finished()
                    head, held, factor = [batch.column(k).slice(a, 1) for k in range(n)], [], float(columns[4][a])
                    a += 1
                if a < b:
                    held.append([c[a:b].astype(float) for c in columns[:4]])
        if head is not None:
            yield finished()

    met = heads.unionByName(events).select(*keys, "channel", "place", "until", "amount", "factor")
    return met.repartition(*keys).sortWithinPartitions(*keys, "channel").mapInArrow(apply, schema)


def base_rows(matrices: DataFrame, by: list[str], size: int = 2000) -> DataFrame:
    """A row (by, pos, and a column for each channel) for each base of the windows (of ``window_matrices``) with any value."""
    schema = T.StructType([*matrices.select(*by).schema.fields, T.StructField("pos", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in CHANNELS]])

    def apply(batches):
        for batch in batches:
            starts, values = batch.column(len(by)).to_numpy(), batch.column(len(by) + 1)
            dense = values.flatten().to_numpy().reshape(-1, 9)
            rows = np.flatnonzero(dense.any(1))
            window = pa.array(rows // size)
            pos = pa.array(starts[rows // size] + rows % size)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(window) for k in range(len(by))], pos, *[pa.array(dense[rows, k]) for k in range(9)]], names=schema.names)

    return matrices.select(*by, "window_start", "values").mapInArrow(apply, schema)
