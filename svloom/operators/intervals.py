"""Intervals: clusters by gap, merging, complements, tiling and overlap joins.

Running maxima, counts and neighbours along a contig are found range by range: a task sorts the rows of one range
of RANGE bases, and what earlier ranges hand on comes from one small row a range. Overlap joins deal both sides to
bins of several widths and join on (contig, width, bin) with the exact predicate behind it, so that no pair is looked
at outside its bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE = 1 << 20


def ranged(rows: DataFrame, by: list[str], at: str, width: int = RANGE) -> tuple[DataFrame, list[str]]:
    """``rows`` with key columns of their range of the number ``at`` within ``by``, and these columns' names; the last is the range.

    Nulls in ``by`` are a value of their own; rows without ``at`` share a range before all others.
    """
    keys = {}
    for i, c in enumerate(by):
        keys |= {f"__key{i}": F.coalesce(F.col(c).cast("string"), F.lit("")), f"__null{i}": F.col(c).isNull()}
    place = F.coalesce(F.floor(F.col(at) / width).cast("long"), F.lit(-(1 << 62)))
    return rows.withColumns(keys | {"__range": place}), [*keys, "__range"]


def earlier_ranges(keys: list[str]):
    """Window over the ranges before a range's own, one row a range."""
    return Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)


def islands(intervals: DataFrame, by: list[str], order: list[str], start: str, end: str, *, gap: int = 0, closed: bool = True) -> DataFrame:
    """Adds ``island``, counted from 1 within ``by``: a row joins the island before it if its start is at most ``gap`` beyond the running maximum end (closed), or nearer (not closed).

    ``order`` begins with ``start``.
    """
    rows, keys = ranged(intervals, by, start)
    w = Window.partitionBy(*keys).orderBy(*order)
    tops = rows.groupBy(*keys).agg(F.max(end).alias("__top"))
    rows = rows.join(tops.select(*keys, F.max("__top").over(earlier_ranges(keys)).alias("__before")), keys)
    before = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    away = F.col(start) - before
    flagged = rows.withColumn("__new", F.when(before.isNull() | (away > gap if closed else away >= gap), 1).otherwise(0))
    counts = flagged.groupBy(*keys).agg(F.sum("__new").alias("__count"))
    flagged = flagged.withColumn("__seen", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = flagged.join(counts.select(*keys, F.coalesce(F.sum("__count").over(earlier_ranges(keys)), F.lit(0)).alias("__earlier")), keys)
    return met.select(*intervals.columns, (F.col("__earlier") + F.col("__seen")).cast("int").alias("island"))


def gap_clusters(variants: DataFrame, flank: int, order: list[str]) -> DataFrame:
    """Adds ``cluster``: variants of a contig belong together while each starts less than ``flank`` after all ends before it."""
    return islands(variants, ["chrom"], order, "start_pos", "end_pos", gap=flank, closed=False).withColumnRenamed("island", "cluster")


def cluster_bounds(clustered: DataFrame, flank: int, order: list[str], length: Column) -> DataFrame:
    """Per cluster: the first variant's start less the flank, the largest end plus the flank, within the contig."""
    first = F.min_by("start_pos", F.struct(*order))
    return clustered.groupBy("chrom", "cluster").agg(
        F.greatest(F.lit(0).cast("long"), first - flank).alias("bound_start"),
        F.least(F.max("end_pos") + flank, F.max(length)).alias("bound_end"),
        F.count(F.lit(1)).alias("variants"),
    )


def merge(intervals: DataFrame, by: list[str], flank: int, length: Column) -> DataFrame:
    """Non-empty intervals, widened by the flank within 0 and ``length`` and merged where they touch."""
    wide = intervals.where("start_pos < end_pos").select(*by, F.greatest(F.lit(0).cast("long"), F.col("start_pos") - flank).alias("start_pos"), F.least(length, F.col("end_pos") + flank).alias("end_pos"))
    found = islands(wide, by, ["start_pos", "end_pos"], "start_pos", "end_pos")
    return found.groupBy(*by, "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("island")


def complement(clusters: DataFrame, by: str, length: Column) -> DataFrame:
    """Gaps between the clusters (lo, hi) of each contig, with those before the first and after the last if not empty there."""
    rows, keys = ranged(clusters.withColumn("length", length), [by], "lo")
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    ends = rows.groupBy(*keys).agg(F.min("lo").alias("first"), F.max_by("hi", F.struct("lo", "hi")).alias("last"))
    ranges = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    rows = rows.join(ends.select(*keys, F.lag("last").over(ranges).alias("left"), F.lead("first").over(ranges).alias("right")), keys)
    rows = rows.withColumn("before", F.coalesce(F.lag("hi").over(w), "left")).withColumn("after", F.coalesce(F.lead("lo").over(w), "right"))
    left = F.when(F.col("before").isNotNull() | (F.col("lo") != 0), F.struct(F.coalesce("before", F.lit(0).cast("long")).alias("gap_start"), F.col("lo").alias("gap_end")))
    right = F.when(F.col("after").isNull() & (F.col("hi") != F.col("length")), F.struct(F.col("hi").alias("gap_start"), F.col("length").alias("gap_end")))
    return rows.select(by, F.explode(F.array_compact(F.array(left, right))).alias("g")).select(by, "g.*")


#: Bins of a level are FACTOR times as wide as those of the one below; LEVELS levels reach any contig.
FACTOR, LEVELS = 16, 7


def _levelled(rows: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """``rows`` with the level of the narrowest bins that are no shorter than the interval."""
    length, level = F.col(end) - F.col(start), F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        level = F.when(length <= size * FACTOR**k, k).otherwise(level)
    return rows.where(F.col(start) < F.col(end)).withColumn("__own", level)


def _binned(rows: DataFrame, start: str, end: str, size: int, wider: bool = True, levels: Column | None = None) -> DataFrame:
    """A row for each bin (__level, __bin) that an interval meets: one or two of its own level, and with ``wider`` as many of each wider one, or of ``levels``."""
    levels = F.sequence(F.col("__own"), F.lit(LEVELS - 1)) if levels is None else levels
    rows = rows.withColumn("__level", F.explode(levels) if wider else F.col("__own"))
    width = F.element_at(F.array(*[F.lit(size * FACTOR**k).cast("long") for k in range(LEVELS)]), F.col("__level") + 1)
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return rows.withColumn("__width", width).withColumn("__bin", F.explode(bins))


#: Rows of one gathered row at most.
GATHERED = 1024


def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with those equal in ``by`` as one row, the other columns in an array ``members`` of GATHERED structs at most; more rows become several.

    What is joined by ``by`` alone then costs one pair for all members, which are exploded behind the join.
    """
    rest = [c for c in rows.columns if c not in by]
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*by)) / GATHERED)
    part = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*rest))) % parts
    return rows.withColumn("__part", part).groupBy(*by, "__part").agg(F.collect_list(F.struct(*rest)).alias("members")).drop("__part")


def overlap_join(left: DataFrame, right: DataFrame, key: str, bin_size: int, block: int | None = None, short: bool = False, cheap: bool = False) -> DataFrame:
    """Pairs with the same ``key`` and l_start < r_end and l_end > r_start (half-open, not empty).

    Bins have levels, so an interval costs two rows a level at most, however long it is. A pair meets at the wider of
    both intervals' own levels, in the bin of the later start, and nowhere else: rows of an interval's own level (side 0 of
    ``left``) meet all of ``right``, those of wider levels (side 1) only those of ``right`` whose own level it is. With
    ``block``, bins with more rows of ``left`` are dealt to as many parts as that takes; the rows of ``right`` go to each of these.
    If no row of ``right`` is longer than ``bin_size``, as ``short`` says, none is wider than a row of ``left``, and those go to their own level only.
    If ``right`` is ``cheap`` to read twice, its levels are found first, and rows of ``left`` go to no wider level than there are.
    Both sides are shuffled: binned rows are many more than the rows by which Spark judges whether a side is small.
    """
    is_own = F.col("__level") == F.col("__own")
    a, right = _levelled(left, "l_start", "l_end", bin_size), _levelled(right, "r_start", "r_end", bin_size)
    levels = None
    if cheap and not short:
        a = a.crossJoin(F.broadcast(right.agg(F.collect_set("__own").alias("__levels"))))
        levels = F.filter(F.sequence(F.col("__own"), F.lit(LEVELS - 1)), lambda k: (k == F.col("__own")) | F.array_contains("__levels", k))
    a = _binned(a, "l_start", "l_end", bin_size, not short, levels).drop("__levels")
    a = a.withColumn("__side", F.when(is_own, 0).otherwise(1)).drop("__own")
    if short:
        right = right.withColumn("__own", F.when(F.col("__own") == 0, 0).otherwise(F.raise_error(F.lit("a row of the right side is longer than a bin"))))
    b = _binned(right, "r_start", "r_end", bin_size)
    b = b.withColumn("__side", F.explode(F.when(is_own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__own", "__width")
    on = [key, "__level", "__bin", "__side"]
    if block:
        hot = a.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__parts")).where("__parts > 1")
        at = F.pmod(F.xxhash64("l_start", "l_end", *[c for c, t in left.dtypes if c not in (key, "l_start", "l_end") and t in ("bigint", "int", "string")]), F.col("__parts"))
        a = a.join(hot, on, "left").withColumn("__part", F.coalesce(at.cast("int"), F.lit(0))).drop("__parts")
        b = b.join(hot, on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    pairs = a.join(b.hint("merge"), [*on, "__part"] if block else on).where("l_start < r_end and l_end > r_start")
    pairs = pairs.where(F.col("__bin") == F.floor(F.greatest("l_start", "r_start") / F.col("__width")))
    return pairs.drop(*on[1:], "__width", "__part")


def window_starts(groups: DataFrame, size: int, stride: int) -> DataFrame:
    """Start of each window over a group (group_start, group_end, length): one centred window if the group fits, else a tiling that ends with the last place."""
    clamp = lambda x: F.least(F.greatest(F.lit(0).cast("long"), x), F.col("length") - size)
    half = size // 2
    centre = F.floor((F.col("group_start") + F.col("group_end")) / 2)
    first = clamp(F.greatest(F.lit(0).cast("long"), F.col("group_start") - half))
    last = clamp(F.least(F.col("length"), F.col("group_end") + half) - size)
    tiles = F.when(first < last, F.array_distinct(F.concat(F.sequence(first, last - 1, F.lit(stride).cast("long")), F.array(last)))).otherwise(F.array(last))
    starts = F.when(F.col("group_end") - F.col("group_start") <= size, F.array(clamp(centre - half))).otherwise(tiles)
    return groups.where(F.col("length") >= size).select("*", F.explode(starts).alias("window_start"))


def focus(windows: DataFrame, intervals: DataFrame, key: str, size: int, sub: int) -> DataFrame:
    """(key, window_start, sv_id, subwindow_index) of the subwindows that an interval overlaps; a 1-bp interval also takes the one before its first."""
    met = overlap_join(windows.withColumnRenamed("window_start", "l_start").withColumn("l_end", F.col("l_start") + size), intervals.withColumnsRenamed({"start_pos": "r_start", "end_pos": "r_end"}), key, size)
    first = F.greatest(F.floor((F.col("r_start") - F.col("l_start")) / sub), F.lit(0))
    last = F.least(F.floor((F.col("r_end") - 1 - F.col("l_start")) / sub), F.lit(size // sub - 1))
    first = F.when(F.col("r_end") - F.col("r_start") == 1, F.greatest(first - 1, F.lit(0))).otherwise(first)
    return met.select(key, F.col("l_start").alias("window_start"), "sv_id", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("subwindow_index")).distinct()


def tile(positions: DataFrame, by: list[str], size: int, length: Column, value: Column) -> DataFrame:
    """Whole tiles of a per-position table in which some value isn't 0; a partial last tile is dropped."""
    rows = positions.withColumn("tile", F.floor(F.col("pos") / size).cast("long")).where((F.col("tile") + 1) * size <= length)
    return rows.groupBy(*by, "tile").agg(F.sum(F.when(value, 1).otherwise(0)).alias("filled")).where("filled > 0")
