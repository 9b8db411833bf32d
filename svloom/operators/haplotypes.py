"""Local haplotypes: genotype choices, combinations, haplotype sets, sequences, projections, pairs and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Clusters with more combinations are left out.
MAX_COMBINATIONS = 1024


def choices(a1: Column, a2: Column, phased: Column) -> Column:
    """Diploid choices of one site: itself and absence; for an unphased heterozygote its mirror image too."""
    pair = lambda a, b: F.struct(a.cast("int").alias("h1"), b.cast("int").alias("h2"))
    none = pair(F.lit(0), F.lit(0))
    return F.when((a1 == a2) | phased, F.array(pair(a1, a2), none)).otherwise(F.array(pair(a1, a2), pair(a2, a1), none))


def guarded(sites: DataFrame, limit: int = MAX_COMBINATIONS) -> DataFrame:
    """One row a cluster (chrom, cluster): its sites in order with their choices, and the number of combinations, at most ``limit``.

    The product is a double, so that a cluster of very many sites overflows to infinity and not to an error; sites
    of clusters over the limit are dropped before they are gathered.
    """
    rows = sites.withColumn("choices", choices(F.col("a1"), F.col("a2"), F.col("phased")))
    total = rows.groupBy("chrom", "cluster").agg(F.product(F.size("choices")).alias("combinations")).where(F.col("combinations") <= limit)
    site = F.struct("start_pos", "end_pos", "event_id", "choices")
    return rows.join(total, ["chrom", "cluster"]).groupBy("chrom", "cluster", "combinations").agg(F.sort_array(F.collect_list(site)).alias("sites"))


def combinations(clusters: DataFrame) -> DataFrame:
    """One row a combination (numbered from 0, first site fastest) with the pairs of states it gives the sites."""
    rows = clusters.select("chrom", "cluster", "sites", F.explode(F.sequence(F.lit(0), F.col("combinations").cast("int") - 1)).alias("combination"))
    # the rest of the number after the sites so far, and the pairs so far
    start = F.struct(F.col("combination").alias("rest"), F.array().cast("array<struct<h1:int,h2:int>>").alias("pairs"))
    step = lambda acc, x: F.struct(F.floor(acc["rest"] / F.size(x["choices"])).cast("int").alias("rest"), F.concat(acc["pairs"], F.array(F.get(x["choices"], acc["rest"] % F.size(x["choices"])))).alias("pairs"))
    return rows.withColumn("pairs", F.aggregate("sites", start, step, lambda acc: acc["pairs"]))


def overlapping(sites: Column, states: Column) -> Column:
    """Whether an active site starts before the end of the active site before it; touching sites do not overlap."""
    both = F.arrays_zip(sites.alias("site"), states.alias("state"))
    start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(False).alias("bad"))

    def step(acc: Column, x: Column) -> Column:
        active = x["state"] != 0
        bad = acc["bad"] | (active & F.coalesce(x["site"]["start_pos"] < acc["end"], F.lit(False)))
        return F.struct(F.when(active, x["site"]["end_pos"]).otherwise(acc["end"]).alias("end"), bad.alias("bad"))

    return F.aggregate(both, start, step, lambda acc: acc["bad"])


def without_overlaps(combined: DataFrame) -> DataFrame:
    """Combinations of which neither haplotype has overlapping active sites; adds states1 and states2."""
    rows = combined.withColumn("states1", F.transform("pairs", lambda p: p["h1"])).withColumn("states2", F.transform("pairs", lambda p: p["h2"]))
    return rows.where(~overlapping(F.col("sites"), F.col("states1")) & ~overlapping(F.col("sites"), F.col("states2")))


def haplotype_set(surviving: DataFrame) -> DataFrame:
    """Distinct state vectors of each cluster, numbered from 1 in their order."""
    rows = surviving.select("chrom", "cluster", F.explode(F.array("states1", "states2")).alias("states")).distinct()
    return rows.withColumn("hap", F.row_number().over(Window.partitionBy("chrom", "cluster").orderBy("states")).cast("int"))


def sequence_of(reference: Column, sites: Column, states: Column) -> Column:
    """The reference with the ALT of each active site in place of its interval (positions from the reference's first base)."""
    both = F.arrays_zip(sites.alias("site"), states.alias("state"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        site = x["site"]
        text = F.concat(acc["text"], F.substring(reference, (acc["at"] + 1).cast("int"), (site["start_pos"] - acc["at"]).cast("int")), site["alt"])
        active = x["state"] != 0
        return F.struct(F.when(active, site["end_pos"]).otherwise(acc["at"]).alias("at"), F.when(active, text).otherwise(acc["text"]).alias("text"))

    return F.aggregate(both, start, step, lambda acc: F.concat(acc["text"], F.substring(reference, (acc["at"] + 1).cast("int"), F.length(reference))))


def mappings(sites: Column, states: Column) -> Column:
    """Active sites with their place on the haplotype: rs, re, hs, he."""
    both = F.arrays_zip(sites.alias("site"), states.alias("state"))
    kind = "array<struct<rs:bigint,re:bigint,hs:bigint,he:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.array().cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        s, e, n = x["site"]["start_pos"], x["site"]["end_pos"], F.length(x["site"]["alt"])
        one = F.struct(s.alias("rs"), e.alias("re"), (s + acc["shift"]).alias("hs"), (s + acc["shift"] + n).alias("he"))
        active = x["state"] != 0
        return F.struct(F.when(active, acc["shift"] + n - (e - s)).otherwise(acc["shift"]).alias("shift"), F.when(active, F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(both, start, step, lambda acc: acc["found"])


def project(position: Column, mapped: Column, is_start: bool) -> Column:
    """A reference position on the haplotype: shifted by the active sites before it; inside one it moves to that end of it which it stands for."""
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(None).cast("long").alias("found"), F.lit(False).alias("done"))

    def step(acc: Column, m: Column) -> Column:
        inside = m["hs"] if is_start else m["he"]
        hit = F.when(position == m["rs"], m["hs"]).when((position > m["rs"]) & (position < m["re"]), inside).when(position == m["re"], m["he"])
        before = position < m["rs"]
        more = acc["shift"] + (m["he"] - m["hs"]) - (m["re"] - m["rs"])
        stop = acc["done"] | before | hit.isNotNull()
        return F.struct(F.when(stop, acc["shift"]).otherwise(more).alias("shift"), F.when(acc["done"], acc["found"]).otherwise(hit).alias("found"), stop.alias("done"))

    return F.aggregate(mapped, start, step, lambda acc: F.coalesce(acc["found"], position + acc["shift"]))


def projected_intervals(sites: Column, states: Column, length: Column) -> Column:
    """For each site its interval on the haplotype: an active one's ALT; else the projected reference interval, one base if that is empty."""
    mapped = mappings(sites, states)
    clamp = lambda x, top: F.least(F.greatest(x, F.lit(0).cast("long")), top)

    def one(x: Column) -> Column:
        own = F.get(F.filter(mapped, lambda m: (m["rs"] == x["site"]["start_pos"]) & (m["re"] == x["site"]["end_pos"])), F.lit(0))
        s = clamp(project(x["site"]["start_pos"], mapped, True), length)
        e = clamp(project(x["site"]["end_pos"], mapped, False), length)
        anchor = clamp(s, length - 1)
        none = e <= s
        plain = F.struct(F.when(none, anchor).otherwise(s).alias("start"), F.when(none, anchor + 1).otherwise(e).alias("end"))
        return F.when(x["state"] != 0, F.struct(own["hs"].alias("start"), own["he"].alias("end"))).otherwise(plain)

    return F.transform(F.arrays_zip(sites.alias("site"), states.alias("state")), one)


def encode_header(ids: Column, intervals: Column, states: Column) -> Column:
    """SVs=<id>:<start>-<end>;..|GT=<state>:<state>.."""
    spans = F.zip_with(ids, intervals, lambda i, x: F.concat(i, F.lit(":"), x.getField("start").cast("string"), F.lit("-"), x.getField("end").cast("string")))
    return F.concat(F.lit("SVs="), F.array_join(spans, ";"), F.lit("|GT="), F.array_join(F.transform(states, lambda s: s.cast("string")), ":"))


def decode_header(header: Column) -> Column:
    """struct(intervals: array of (sv_id, start, end), states) of a header."""
    spans = F.filter(F.split(F.regexp_extract(header, r"^SVs=(.*)\|GT=", 1), ";"), lambda x: x != "")
    part = lambda x, k: F.regexp_extract(x, r"^(.*):(\d+)-(\d+)$", k)
    found = F.transform(spans, lambda x: F.struct(part(x, 1).alias("sv_id"), part(x, 2).cast("int").alias("start"), part(x, 3).cast("int").alias("end")))
    states = F.transform(F.filter(F.split(F.regexp_extract(header, r"\|GT=(.*)$", 1), ":"), lambda x: x != ""), lambda x: x.cast("int"))
    return F.struct(found.alias("intervals"), states.alias("states"))


def pairs(haplotypes: DataFrame) -> DataFrame:
    """Unordered pairs of a cluster's haplotypes (cluster, hap, hap_id, states), each with itself too, numbered in order.

    Both sides grow with the clusters, so they are shuffled, however small Spark takes them to be: no copy passes through the driver.
    """
    a = haplotypes.select("cluster", F.col("hap").alias("hap1"), F.col("hap_id").alias("hap1_id"), F.col("states").alias("states1"))
    b = haplotypes.select("cluster", F.col("hap").alias("hap2"), F.col("hap_id").alias("hap2_id"), F.col("states").alias("states2"))
    both = a.join(b.hint("merge"), "cluster").where("hap1 <= hap2").withColumn("pair_id", F.concat_ws("__", "hap1_id", "hap2_id"))
    return both.withColumn("order", F.row_number().over(Window.partitionBy("cluster").orderBy("hap1", "hap2")).cast("int"))


def pair_genotypes(states1: Column, states2: Column) -> Column:
    return F.zip_with(states1, states2, lambda a, b: F.concat(F.least(a, b).cast("string"), F.lit("/"), F.greatest(a, b).cast("string")))
