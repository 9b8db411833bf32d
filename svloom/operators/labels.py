"""Training windows: label clusters, negatives, patch labels, label vectors and sample-specific strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from svloom.operators import intervals as iv


def label_clusters(variants: DataFrame, gap: int, order: list[str], length: Column) -> DataFrame:
    """Clusters of variants nearer than ``gap``, padded by it within the contig: lo, hi, first_start, last_end, members."""
    found = iv.islands(variants, ["chrom"], order, "start_pos", "end_pos", gap=gap, closed=False).withColumnRenamed("island", "cluster")
    ends = found.groupBy("chrom", "cluster").agg(F.min("start_pos").alias("first_start"), F.max("end_pos").alias("last_end"), F.count(F.lit(1)).alias("members"))
    return ends.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.col("first_start") - gap)).withColumn("hi", F.least(F.col("last_end") + gap, length))


#: Rounds of ``coprime``: enough for the Euclidean algorithm on 64-bit numbers.
_EUCLID = 93
GOLDEN = 0.6180339887


def _number(seed: int, *of: Column | str) -> Column:
    """A number from 0 to 2^31 - 1 that the seed and the columns give, the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def coprime(n: Column) -> Column:
    """The first number from 0.618 n on that has no divisor in common with n; steps of that length visit all of 0 to n - 1."""
    gcd = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(_EUCLID)), F.struct(n.cast("long").alias("a"), x.alias("b")), lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % F.greatest(acc["b"], F.lit(1))).alias("b"))), lambda acc: acc["a"])
    first = F.floor(n * GOLDEN).cast("long")
    near = F.filter(F.sequence(F.greatest(first, F.lit(1)), F.greatest(first, F.lit(1)) + 64), lambda x: gcd(x) == 1)
    return F.coalesce(F.get(near, F.lit(0)), F.lit(1).cast("long"))


def rooms(gaps: DataFrame, by: str, size: int) -> DataFrame:
    """The gaps of at least ``size`` with ``before`` and ``room``: starts that fit in the contig's earlier gaps, and here."""
    wide = gaps.where(F.col("gap_end") - F.col("gap_start") >= size).withColumn("room", F.col("gap_end") - F.col("gap_start") - size + 1)
    rows, keys = iv.ranged(wide, [by], "gap_start")
    sums = rows.groupBy(*keys).agg(F.sum("room").alias("__sum"))
    rows = rows.join(sums.select(*keys, F.coalesce(F.sum("__sum").over(iv.earlier_ranges(keys)), F.lit(0)).alias("__earlier")), keys)
    here = F.sum("room").over(Window.partitionBy(*keys).orderBy("gap_start").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(by, "gap_start", "gap_end", "room", (F.col("__earlier") + F.coalesce(here, F.lit(0))).alias("before"))


def drawn(roomy: DataFrame, contigs: DataFrame, by: str, size: int) -> DataFrame:
    """(by, k, gap_start, gap_end, window_start, window_end) of the draws ``first`` to ``last`` of ``contigs`` (by, total, step, offset, first, last)."""
    draws = contigs.where("first <= last").select(by, "total", "step", "offset", F.explode(F.sequence("first", "last")).alias("k"))
    at = F.pmod(F.col("offset") + F.pmod(F.col("k") * F.col("step"), F.col("total")), F.col("total"))
    draws = draws.select(by, "k", at.alias("l_start"), (at + 1).alias("l_end"))
    spans = roomy.select(by, "gap_start", "gap_end", "before", F.col("before").alias("r_start"), (F.col("before") + F.col("room")).alias("r_end"))
    met = iv.overlap_join(draws, spans, by, 1 << 12)
    start = F.col("gap_start") + F.col("l_start") - F.col("before")
    return met.select(by, "k", "gap_start", "gap_end", start.alias("window_start"), (start + size).alias("window_end"))


def sample_negatives(gaps: DataFrame, by: str, size: int, count: int, seed: int, keep: Callable[[DataFrame], DataFrame] | None = None, scratch: str | None = None) -> DataFrame:
    """``count`` windows a contig out of all places that its gaps hold, or as many as there are: by, k, gap_start, gap_end, window_start, window_end.

    All starts that fit are numbered gap after gap and visited in steps that have no divisor in common with their number,
    from an offset that the seed gives, so no start comes twice and a gap is drawn in proportion to its room; the same on
    any cluster. ``keep`` gives back those of its windows that may stay (none labelled, none uncovered, say); what it
    rejects is made up for in rounds of growing length, whose tables go to the folder ``scratch``, until each contig has its
    number or no start is left.
    """
    roomy = rooms(gaps, by, size)
    totals = roomy.groupBy(by).agg(F.sum("room").alias("total"))
    contigs = totals.select(by, "total", coprime(F.col("total")).alias("step"), F.pmod(_number(seed, by), F.col("total")).alias("offset"))
    if keep is None:
        first = contigs.withColumns({"first": F.lit(0).cast("long"), "last": F.least(F.lit(count).cast("long"), F.col("total")) - 1})
        return drawn(roomy, first, by, size)
    spark, found, round_, wanted = gaps.sparkSession, None, 0, contigs.withColumns({"first": F.lit(0).cast("long"), "have": F.lit(0).cast("long")})

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{scratch}/{name}-{round_}")
        return spark.read.schema(df.schema).parquet(f"{scratch}/{name}-{round_}")

    roomy = table(roomy, "rooms")
    while True:
        last = F.least(F.col("first") + (count - F.col("have")) * 2**round_, F.col("total")) - 1
        wanted = table(wanted.where((F.col("have") < count) & (F.col("first") < F.col("total"))).withColumn("last", last), "contigs")
        if wanted.isEmpty():
            break
        good = table(keep(drawn(roomy, wanted, by, size)), "windows")
        found = good if found is None else found.unionByName(good)
        more = good.groupBy(by).agg(F.count(F.lit(1)).alias("more"))
        wanted = wanted.join(more, by, "left").select(by, "total", "step", "offset", (F.col("last") + 1).alias("first"), (F.col("have") + F.coalesce("more", F.lit(0))).alias("have"))
        round_ += 1
    if found is None:
        return drawn(roomy, contigs.withColumns({"first": F.lit(1).cast("long"), "last": F.lit(0).cast("long")}), by, size)
    place = F.row_number().over(Window.partitionBy(by).orderBy("k"))  # a contig has fewer than a round's windows too many
    return found.withColumn("place", place).where(F.col("place") <= count).drop("place")


def training_window_starts(clusters: DataFrame, width: int, stride: int, overlap: int, jitter: int = 0, seed: int = 0) -> DataFrame:
    """Starts of strided windows over each cluster, ending with the last place; a cluster too narrow has one.

    With ``jitter`` each of several starts moves by up to so many bases either way, as the seed has it, within lo and hi.
    """
    low = F.greatest(F.col("lo"), F.col("first_start") - width + overlap)
    high = F.least(F.col("hi") - width, F.col("last_end") - overlap)
    tiles = F.array_distinct(F.concat(F.sequence(F.least(low, high), high, F.lit(stride).cast("long")), F.array(high)))
    one = F.array(F.least(F.greatest(low, F.col("lo")), F.col("hi") - width))
    starts = clusters.select("chrom", "cluster", "lo", "hi", (high >= low).alias("several"), F.explode(F.when(high < low, one).otherwise(tiles)).alias("window_start"))
    if jitter:
        moved = F.col("window_start") + F.pmod(_number(seed, "chrom", "cluster", "window_start"), F.lit(2 * jitter + 1)) - jitter
        moved = F.least(F.greatest(moved, F.col("lo")), F.col("hi") - width)
        starts = starts.withColumn("window_start", F.when(F.col("several"), moved).otherwise(F.col("window_start")))
    return starts.select("chrom", "cluster", "window_start")


def usable_negatives(windows: DataFrame, labels: DataFrame, covered: DataFrame, key: str, size: int) -> DataFrame:
    """Windows without a patch labelled 1 (``labels``: key, window_start, label) over which some alignment (``covered``: key, l_start, l_end) lies."""
    bad = labels.where("label = 1").select(key, "window_start").distinct()
    spans = windows.select(key, "window_start", F.col("window_start").alias("r_start"), (F.col("window_start") + size).alias("r_end"))
    good = iv.overlap_join(covered.select(key, "l_start", "l_end"), spans, key, size).select(key, "window_start").distinct()
    return windows.join(bad, [key, "window_start"], "left_anti").join(good, [key, "window_start"], "left_semi")


def patch_labels(windows: DataFrame, variants: DataFrame, noisy: DataFrame, key: str, size: int, patch: int, overlap: int) -> DataFrame:
    """(key, window_start, patch_index, label): 1 if an INS starts in the patch, another type overlaps it by ``overlap``, or else the patch is in ``noisy`` (key, pos)."""
    patches = windows.select(key, "window_start", F.explode(F.sequence(F.lit(0), F.lit(size // patch - 1))).alias("patch_index"))
    patches = patches.withColumn("l_start", F.col("window_start") + F.col("patch_index") * patch).withColumn("l_end", F.col("l_start") + patch)
    sites = variants.select(key, F.col("start_pos").alias("r_start"), F.greatest("end_pos", F.col("start_pos") + 1).alias("r_end"), "end_pos", "sv_type")
    point = (F.col("sv_type") == "INS") & (F.col("r_start") >= F.col("l_start")) & (F.col("r_start") < F.col("l_end"))
    wide = (F.coalesce("sv_type", F.lit("?")) != "INS") & (F.least("l_end", "end_pos") - F.greatest("l_start", "r_start") >= overlap)
    hit = iv.overlap_join(patches, sites, key, size).where(point | wide).select(key, "window_start", "patch_index").distinct().withColumn("by_variant", F.lit(1))
    marked = patches.join(hit, [key, "window_start", "patch_index"], "left").join(noisy.select(key, F.col("pos").alias("l_start")).distinct().withColumn("by_reads", F.lit(1)), [key, "l_start"], "left")
    return marked.select(key, "window_start", "patch_index", F.coalesce("by_variant", "by_reads", F.lit(0)).alias("label"))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """(file_name, label) from lines ``path TAB v0,...,v9``; equal repeats count once, conflicting ones raise."""
    part = F.split(F.trim("value"), "\t")
    bits = F.transform(F.split(F.get(part, F.lit(1)), ","), lambda x: x.cast("int"))
    name = F.regexp_extract(F.get(part, F.lit(0)), r"[^/]*$", 0)
    rows = lines.where(F.length(F.trim("value")) > 0).select(name.alias("file_name"), bits.alias("label"))
    bad = (F.size("label") != 10) | F.exists("label", lambda x: ~x.isin(0, 1))
    rows = rows.withColumn("label", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("a label needs ten values of 0 or 1"))).otherwise(F.col("label")))
    found = rows.groupBy("file_name").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return found.select("file_name", F.when(F.col("label") != F.col("other"), F.raise_error(F.concat(F.lit("conflicting labels of "), F.col("file_name")))).otherwise(F.col("label")).alias("label"))


def thresholded(probabilities: Column, threshold: float = 0.5) -> Column:
    return F.transform(probabilities, lambda p: (p >= threshold).cast("int"))


def false_samples(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Files whose prediction differs from the truth in any place."""
    met = predicted.join(truth, "file_name")
    return met.where(F.exists(F.zip_with("prediction", "label", lambda a, b: a != b), lambda x: x))


def parse_sfs(lines: DataFrame) -> DataFrame:
    """(line_no, read_id, contig, start_pos, end_pos) of sample-specific strings: a block's read name stands on its first line, * on the others.

    The first tuple of a line is the query's; a tuple with a zero or empty value is left out, as in the source format's reader.
    """
    name = F.get(F.split("text", "\t"), F.lit(0))
    filled = F.last(F.when(name != "*", name), ignorenulls=True).over(Window.partitionBy("block").orderBy("line_no"))
    return sfs_tuples(lines.select("line_no", filled.alias("read_id"), "text"))


def fill_names(lines: DataFrame) -> DataFrame:
    """(file, split, line_no, read_id, text) of lines (file, split, line_no, text) whose name is that of the last line before with one.

    A split fills its own lines and takes the last name of the splits before it in the file, which are one small row each.
    """
    name = F.get(F.split("text", "\t"), F.lit(0))
    named = lines.withColumn("__name", F.when((name != "*") & (F.length("text") > 0), name))
    last = named.where("__name is not null").groupBy("file", "split").agg(F.max_by("__name", "line_no").alias("__last"))
    every = named.select("file", "split").distinct().join(last, ["file", "split"], "left")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("file", "split", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    here = F.last("__name", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("line_no"))
    return named.join(carried, ["file", "split"]).select("file", "split", "line_no", F.coalesce(here, "__carried").alias("read_id"), "text")


def sfs_tuples(named: DataFrame) -> DataFrame:
    """(columns of ``named`` but text, contig, start_pos, end_pos): the tuples of each line but the first."""
    kept = [c for c in named.columns if c != "text"]
    rows = named.select(*kept, F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), F.lit(1)).alias("tuples")).where(F.size("tuples") >= 2)
    rows = rows.select(*kept, F.explode(F.slice("tuples", F.lit(2), F.size("tuples"))).alias("t"))
    part = F.transform(F.split("t", ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", ""))
    rows = rows.select(*kept, F.get(part, F.lit(0)).alias("contig"), F.get(part, F.lit(1)).cast("long").alias("start_pos"), F.get(part, F.lit(2)).cast("long").alias("end_pos"))
    return rows.where("contig <> '' and start_pos <> 0 and end_pos <> 0")


def gather_sfs(strings: DataFrame, variants: DataFrame, reads: DataFrame, widen: int = 50, by: str = "variant_id") -> DataFrame:
    """(variant_id, read_id, contig, start_pos, end_pos) of strings (of ``parse_sfs``) at each variant (variant_id, contig, start_pos, end_pos).

    A variant takes the strings of its own ``reads`` (variant_id, read_id: those with a signature there) that lie on its
    contig and meet it, ends included, when it is widened on both sides; a read with several signatures counts once.
    Where groups of variants share their reads, ``by`` names the group, a column of ``variants`` and of ``reads`` (by, read_id), and no row stands for a
    variant and a read.
    """
    group = lambda rows: F.struct(rows[by].alias("by"), rows["contig"].alias("contig"))
    known = reads.select(by, "read_id").distinct().join(variants.select(by).distinct(), by)
    owned = strings.select("read_id", "contig", "start_pos", "end_pos").join(known, "read_id")
    left = owned.select(group(owned).alias("group"), "read_id", "contig", "start_pos", "end_pos", F.col("start_pos").alias("l_start"), (F.col("end_pos") + 1).alias("l_end"))
    right = variants.select("variant_id", group(variants).alias("group"), (F.col("start_pos") - widen).alias("r_start"), (F.col("end_pos") + (widen + 1)).alias("r_end"))
    met = iv.overlap_join(left, iv.gathered(right, ["group", "r_start", "r_end"]), "group", 256, cheap=True)
    return met.select("read_id", "contig", "start_pos", "end_pos", F.inline("members")).select("variant_id", "read_id", "contig", "start_pos", "end_pos")
