"""Variant records: parsing, typing, filtering, numbering and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from svloom.operators import intervals as iv


def parse_vcf_lines(lines: DataFrame) -> DataFrame:
    """Records from the data lines of a VCF text (``line_no``, ``value``): 0-based start, end from INFO END or the reference allele."""
    part = F.col("part")
    info = F.str_to_map(F.get(part, F.lit(7)), F.lit(";"), F.lit("="))
    # a line is split once: Spark moves no filter on its fields before this explode, where each would make and split the line anew
    rows = lines.select("line_no", F.explode(F.array(F.split("value", "\t"))).alias("part"))
    first = F.get(part, F.lit(0))
    rows = rows.where(~F.startswith(first, F.lit("#")) & ((F.length(first) > 0) | (F.size(part) > 1)))
    at = lambda k: F.get(part, F.lit(k))
    start = at(1).cast("long") - 1
    alts = F.when(at(4) == ".", F.array().cast("array<string>")).otherwise(F.split(at(4), ","))
    keys = F.split(at(8), ":")
    gt = F.get(F.split(at(9), ":"), F.array_position(keys, F.lit("GT")).cast("int") - 1)
    stop = F.coalesce(F.try_element_at(info, F.lit("END")).cast("long"), start + F.length(at(3)))
    record = rows.select("line_no", at(0).alias("chrom"), start.alias("start_pos"), stop.alias("end_pos"), at(2).alias("id"), at(3).alias("ref"), alts.alias("alts"), info.alias("info"), gt.alias("gt"))
    return record.withColumn("sv_type", infer_type(F.col("ref"), F.col("alts"), F.try_element_at("info", F.lit("SVTYPE"))))


def infer_type(ref: Column, alts: Column, svtype: Column) -> Column:
    """SVTYPE if given, else the sole symbolic allele, else the sign of the length difference of the sole ALT, else null."""
    symbolic = F.array_distinct(F.transform(F.filter(alts, lambda a: F.startswith(a, F.lit("<")) & F.endswith(a, F.lit(">"))), lambda a: F.upper(F.substring(a, F.lit(2), F.length(a) - 2))))
    only = F.get(alts, F.lit(0))
    by_length = F.when((F.size(alts) == 1) & (F.length(only) > F.length(ref)), "INS").when((F.size(alts) == 1) & (F.length(only) < F.length(ref)), "DEL")
    return F.when(F.length(svtype) > 0, F.upper(svtype)).when(F.size(symbolic) == 1, F.get(symbolic, F.lit(0))).otherwise(by_length)


def tokenize_genotype(gt: Column) -> Column:
    """Alleles and separators in turn; a missing genotype gives null."""
    return F.regexp_extract_all(gt, F.lit(r"([^/|]+|[/|])"), F.lit(1))


def keep_insertions_deletions(variants: DataFrame) -> DataFrame:
    """Records with exactly one ALT that isn't symbolic, of type INS or DEL."""
    alt = F.get("alts", F.lit(0))
    return variants.where((F.size("alts") == 1) & ~(F.startswith(alt, F.lit("<")) & F.endswith(alt, F.lit(">"))) & F.col("sv_type").isin("INS", "DEL"))


def renumber(variants: DataFrame, order: str) -> DataFrame:
    """``variant_id`` <chrom>.<type>.<n>, n counting within chromosome and type by the number ``order``, range by range of it."""
    rows, keys = iv.ranged(variants, ["chrom", "sv_type"], order)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__count"))
    rows = rows.join(counts.select(*keys, F.coalesce(F.sum("__count").over(iv.earlier_ranges(keys)), F.lit(0)).alias("__earlier")), keys)
    n = F.col("__earlier") + F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = rows.withColumn("n", n.cast("int")).select(*variants.columns, "n")
    return rows.withColumn("variant_id", F.concat_ws(".", "chrom", "sv_type", F.col("n").cast("string")))


def kept_and_skipped(variants: DataFrame, kept: Column) -> DataFrame:
    return variants.agg(F.count_if(kept).alias("kept"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("skipped"))


def drop_reference_genotypes(variants: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Without records whose genotype is missing or whose first and last tokens are 0; a missing allele stays and reads as 0."""
    t = F.col(tokens)
    # the tokens stand in the filter once, as Spark puts their whole expression wherever they do
    kept = variants.where(F.exists(F.array(t), lambda t: t.isNotNull() & ~((F.get(t, F.lit(0)) == "0") & (F.get(t, F.size(t) - 1) == "0"))))
    return kept.withColumn(tokens, F.transform(t, lambda x: F.when(x == ".", "0").otherwise(x)))


def export(variants: DataFrame, decisions: DataFrame, keep_absent: bool = False) -> DataFrame:
    """Variants with their decision's genotype and status; ``written`` is false for absent ones that are filtered.

    Of a variant that several clusters decide alike the decision of the last ``cluster`` counts (if there is such a column);
    different genotypes raise.
    """
    met = variants.join(agreed(decisions), "variant_id", "left")
    absent = F.col("final_gt") == "0/0"
    status = F.when(F.col("final_gt").isNull(), "kept_skipped_or_not_evaluated").when(absent & F.lit(not keep_absent), "filtered_absent").when(absent, "kept_absent").otherwise("kept_present")
    met = met.withColumn("status", status)
    return met.withColumn("written", F.col("status") != "filtered_absent").withColumn("final_gt", F.coalesce("final_gt", "original_gt"))


def agreed(decisions: DataFrame) -> DataFrame:
    """One row a variant: that of the last cluster; decisions with different genotypes raise."""
    last = F.struct(*[c for c in ("cluster", "final_gt") if c in decisions.columns])
    rows = decisions.groupBy("variant_id").agg(F.max_by(F.struct(*decisions.columns), last).alias("x"), F.min("final_gt").alias("low"), F.max("final_gt").alias("high"))
    text = F.concat(F.lit("conflicting genotypes of "), F.col("variant_id").cast("string"), F.lit(": "), F.col("low"), F.lit(" and "), F.col("high"))
    checked = F.when(F.col("low") != F.col("high"), F.raise_error(text)).otherwise(F.col("x.final_gt"))
    return rows.select(*[checked.alias(c) if c == "final_gt" else F.col(f"x.{c}").alias(c) for c in decisions.columns])


def conflicts(decisions: DataFrame) -> DataFrame:
    """Variants to which clusters give different genotypes."""
    return decisions.groupBy("variant_id").agg(F.count_distinct("final_gt").alias("genotypes")).where("genotypes > 1")


def set_genotypes(value: Column, genotype: Column) -> Column:
    """A record's line in which all samples have this genotype; other fields stay, and GT comes first where FORMAT lacked it."""
    part = F.split(value, "\t")
    keys = F.split(F.get(part, F.lit(8)), ":")
    at = F.array_position(keys, F.lit("GT")).cast("int")
    samples = F.slice(part, F.lit(10), F.greatest(F.size(part) - 9, F.lit(0)))

    def changed(sample: Column) -> Column:
        fields = F.split(sample, ":")
        placed = F.transform(fields, lambda x, i: F.when(i == at - 1, genotype).otherwise(x))
        return F.array_join(F.when(at > 0, placed).otherwise(F.concat(F.array(genotype), fields)), ":")

    keyed = F.when(at > 0, F.get(part, F.lit(8))).otherwise(F.concat(F.lit("GT:"), F.get(part, F.lit(8))))
    line = F.array_join(F.concat(F.slice(part, 1, 8), F.array(keyed), F.transform(samples, changed)), "\t")
    return F.when(F.size(part) > 9, line).otherwise(value)


def original_genotype(value: Column) -> Column:
    """Alleles of a line's first sample joined by /, NA without samples or GT."""
    part = F.split(value, "\t")
    at = F.array_position(F.split(F.get(part, F.lit(8)), ":"), F.lit("GT")).cast("int")
    gt = F.get(F.split(F.get(part, F.lit(9)), ":"), at - 1)
    return F.when((F.size(part) > 9) & (at > 0), F.replace(F.coalesce(gt, F.lit(".")), F.lit("|"), F.lit("/"))).otherwise("NA")


AUDIT = ["variant_id", "vcf_status", "original_gt", "final_gt", "cluster", "pair", "pair_score", "original_pair_gt", "hap1_score", "hap2_score", "reason"]


def export_lines(lines: DataFrame, decisions: DataFrame, keep_absent: bool = False) -> DataFrame:
    """Each line of a VCF (line_no, value; headers left out) with what becomes of it: value (null if it is filtered) and the columns of AUDIT as text.

    ``decisions``: variant_id, cluster, pair, pair_score, original_pair_gt, final_gt, hap1_score, hap2_score, reason; equal
    ones of several clusters collapse, different genotypes raise. A genotype that isn't diploid raises.
    """
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).withColumn("variant_id", F.get(F.split("value", "\t"), F.lit(2)))
    met = rows.join(agreed(decisions).withColumnRenamed("final_gt", "decided"), "variant_id", "left")
    diploid = F.when(F.col("decided").rlike(r"^[0-9]+[/|][0-9]+$"), F.replace("decided", F.lit("|"), F.lit("/"))).otherwise(F.raise_error(F.concat(F.lit("not a diploid genotype: "), F.col("decided"))))
    found, absent = F.col("decided").isNotNull(), F.col("decided") == "0/0"
    status = F.when(~found, "kept_skipped_or_not_evaluated").when(absent & F.lit(not keep_absent), "filtered_absent").when(absent, "kept_absent").otherwise("kept_present")
    value = F.when(~found, F.col("value")).when(status == "filtered_absent", F.lit(None).cast("string")).otherwise(set_genotypes(F.col("value"), diploid))
    number = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    shown = lambda c: F.when(found, c).otherwise("NA")
    return met.select(
        "line_no", value.alias("value"), "variant_id", status.alias("vcf_status"), original_genotype(F.col("value")).alias("original_gt"),
        F.when(found, F.col("decided")).otherwise(original_genotype(F.col("value"))).alias("final_gt"), shown(F.col("cluster").cast("string")).alias("cluster"), shown(F.col("pair")).alias("pair"), shown(number("pair_score")).alias("pair_score"),
        shown(F.col("original_pair_gt")).alias("original_pair_gt"), shown(number("hap1_score")).alias("hap1_score"), shown(number("hap2_score")).alias("hap2_score"), F.when(found, F.col("reason")).otherwise("not_evaluated").alias("reason"),
    )
