"""FASTA text: lines, records, fixed chunks of contigs and slices of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from svloom.functions import dna


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence) of a FASTA file of any number of records: each record is one row of text from the reader on."""
    rows = spark.read.text(path, lineSep="\n>")
    body = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(body, r"^(\S*)", 1)
    sequence = F.upper(F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.where(F.length(F.trim(body)) > 0).select(name.alias("name"), sequence.alias("sequence"))


def to_lines(records: DataFrame, width: int = 80) -> DataFrame:
    """(record, line_no, value): a header line and lines of ``width`` for each (name, sequence)."""
    parts = F.regexp_extract_all("sequence", F.lit(f".{{1,{width}}}"), F.lit(0))
    lines = F.concat(F.array(F.concat(F.lit(">"), F.col("name"))), parts)
    return records.select("name", F.posexplode(lines).alias("line_no", "value")).select(F.xxhash64("name").alias("record"), "line_no", "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(name, sequence) from (record, line_no, value); a record is a file or a part of one. Header names end at white space, sequences are upper case."""
    w = Window.partitionBy("record").orderBy("line_no")
    header = F.when(F.startswith("value", F.lit(">")), F.regexp_extract("value", r"^>(\S*)", 1))
    rows = lines.withColumn("name", F.last(header, ignorenulls=True).over(w)).where(~F.startswith("value", F.lit(">")))
    kept = rows.groupBy("record", "name").agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("lines"))
    return kept.select("name", F.upper(F.array_join(F.transform("lines", lambda x: F.trim(x["value"])), "")).alias("sequence"))


def to_chunks(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, piece): each contig cut at multiples of ``size``, so that a slice reads the chunks it needs."""
    return contigs.select("contig", F.posexplode(dna.cut(F.col("seq"), size)).alias("chunk", "piece"))


def slices(chunks: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """(contig, s, e, slice) of regions: an equi-join on (contig, chunk), then the chunks' parts in order.

    A region that its contig doesn't hold, or whose start lies behind its end, raises; an empty one has an empty slice.
    """
    first_chunk, last_chunk = F.floor(F.col("s") / size), F.floor(F.greatest(F.col("e") - 1, F.col("s")) / size)
    wanted = regions.withColumn("chunk", F.explode(F.sequence(first_chunk.cast("int"), last_chunk.cast("int"))))
    met = wanted.join(chunks, ["contig", "chunk"], "left")
    first = F.greatest(F.lit(0).cast("long"), F.col("s") - F.col("chunk") * size)
    last = F.least(F.lit(size).cast("long"), F.col("e") - F.col("chunk") * size)
    part = F.when(last > first, F.substring(F.coalesce("piece", F.lit("")), (first + 1).cast("int"), (last - first).cast("int"))).otherwise("")
    whole = met.withColumn("part", part).groupBy("contig", "s", "e").agg(F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    whole = whole.select("contig", "s", "e", F.upper(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("slice"))
    text = F.concat(F.lit("no bases for "), F.col("contig").cast("string"), F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    bad = (F.col("s") < 0) | (F.col("s") > F.col("e")) | (F.length("slice") != F.col("e") - F.col("s"))
    return whole.withColumn("slice", F.when(bad, F.raise_error(text)).otherwise(F.col("slice")))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Contig lengths and offsets of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="contig string, length long, offset long, line_bases int, line_width int")
