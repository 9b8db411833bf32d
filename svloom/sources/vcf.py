"""VCF and alignment text in, VCF and tables of tab-separated text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from svloom.operators import variants as vs


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF text, plain or gzip; ``line_no`` follows the order of lines in the files."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")
    return vs.parse_vcf_lines(rows)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text: read_id, flag, contig, ref_start (0-based), mapq, cigar (op, len), seq, nm, md, has_sa."""
    part = F.split("value", "\t")
    at = lambda k: F.get(part, F.lit(k))
    codes = F.create_map(*[F.lit(x) for k, c in enumerate("MIDNSHP=XB") for x in (c, k)])
    tokens = F.regexp_extract_all(at(5), F.lit(r"(\d+[MIDNSHP=XB])"), F.lit(1))
    cigar = F.transform(tokens, lambda t: F.struct(F.element_at(codes, F.right(t, F.lit(1))).alias("op"), F.regexp_extract(t, r"(\d+)", 1).cast("long").alias("len")))
    tag = lambda name, kind: F.get(F.transform(F.filter(part, lambda x: F.startswith(x, F.lit(f"{name}:{kind}:"))), lambda x: F.substring(x, F.lit(6), F.length(x))), F.lit(0))
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")))
    return rows.select(
        F.monotonically_increasing_id().alias("record_no"),
        at(0).alias("read_id"),
        at(1).cast("int").alias("flag"),
        at(2).alias("contig"),
        (at(3).cast("long") - 1).alias("ref_start"),
        at(4).cast("int").alias("mapq"),
        cigar.alias("cigar"),
        at(9).alias("seq"),
        tag("NM", "i").cast("int").alias("nm"),
        tag("MD", "Z").alias("md"),
        tag("SA", "Z").isNotNull().alias("has_sa"),
    )


def vcf_lines(records: DataFrame) -> Column:
    """A record's line; records: chrom, start_pos, id, ref, alts, info (map), gt."""
    entries = F.transform(F.array_sort(F.map_entries("info")), lambda x: F.when(x["value"].isNull(), x["key"]).otherwise(F.concat(x["key"], F.lit("="), x["value"])))
    info = F.when(F.size("info") > 0, F.array_join(entries, ";")).otherwise(".")
    alts = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    return F.concat_ws("\t", "chrom", (F.col("start_pos") + 1).cast("string"), F.coalesce("id", F.lit(".")), "ref", alts, F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.coalesce("gt", F.lit("./.")))


def write_vcf(records: DataFrame, path: str, order: list[str]) -> None:
    """Files of one sorted VCF body, split by ranges of the order: concatenated by name they are in order."""
    records.orderBy(*order).select(vcf_lines(records).alias("value")).write.text(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table with a header, all text; missing columns raise."""
    rows = spark.read.csv(path, sep="\t", header=True)
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return rows


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated text with a header line in each file; null is NA, booleans are true or false."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in rows.columns]).write.csv(path, sep="\t", header=True, emptyValue="")
