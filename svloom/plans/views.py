"""Deterministic views that give the driver's tables the shape of variants, alignments, sequences and predictions.

Each view exists twice: as a DataFrame, and as text of a DuckDB common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small file dealt to all tasks: long work on each row must not wait for the few splits that the file has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chrom, start_pos, end_pos, sv_type, a1, a2, phased."""
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    size = F.when(F.col("event_type") == "purchase", 0).otherwise(F.floor("value").cast("long"))
    kind = F.when(F.col("event_type") == "purchase", "INS").when(F.col("event_type") == "signup", "DEL").when(F.col("event_type") == "view", "DUP").when(F.col("event_type") == "error", "BND")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("chr"), (F.col("user_id") % 22 + 1).cast("string")).alias("chrom"),
        start.alias("start_pos"),
        (start + 1 + size).alias("end_pos"),
        kind.alias("sv_type"),
        (F.col("event_id") % 2).cast("int").alias("a1"),
        (F.col("event_id") % 3 % 2).cast("int").alias("a2"),
        (F.col("event_id") % 5 == 0).alias("phased"),
    )


VARIANTS = """v_variants as (select event_id, concat('chr', cast(user_id % 22 + 1 as varchar)) as chrom,
 date_diff('second', timestamp '2024-01-01 00:00:00', ts) as start_pos,
 date_diff('second', timestamp '2024-01-01 00:00:00', ts) + 1 + case when event_type='purchase' then 0 else cast(floor(value) as bigint) end as end_pos,
 case event_type when 'purchase' then 'INS' when 'signup' then 'DEL' when 'view' then 'DUP' when 'error' then 'BND' end as sv_type,
 cast(event_id % 2 as int) as a1, cast(event_id % 3 % 2 as int) as a2, event_id % 5 = 0 as phased from events)"""


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, contig, ref_start, idx, op, len: one row a CIGAR operation."""
    rows = table(spark, sf_dir, "lineitem")
    order = "l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate"
    return rows.selectExpr(
        "l_orderkey as read_id",
        "concat('ctg', cast(l_orderkey % 5 as string)) as contig",
        "cast((l_orderkey*37) % 20000 as bigint) as ref_start",
        f"cast(row_number() over (partition by l_orderkey order by {order}) as int) as idx",
        "cast(case l_partkey % 8 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 0 when 4 then 4 when 5 then 0 when 6 then 7 else 8 end as int) as op",
        "cast(floor(l_quantity) as bigint) as len",
    )


CIGARS = """v_cigar as (select l_orderkey as read_id, concat('ctg',cast(l_orderkey % 5 as varchar)) as contig, cast((l_orderkey*37) % 20000 as bigint) as ref_start,
 cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_shipdate) as int) as idx,
 cast(case l_partkey % 8 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 0 when 4 then 4 when 5 then 0 when 6 then 7 else 8 end as int) as op, cast(floor(l_quantity) as bigint) as len from lineitem)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a read: read_id, contig, ref_start and the array of its operations, in order."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct("idx", "op", "len"))), lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len")))
    return cigars(spark, sf_dir).groupBy("read_id", "contig", "ref_start").agg(ops.alias("cigar"))


#: Running positions at each operation: rp on the reference, qp on the query (hard clips advance it).
STEPS = CIGARS + """, v_steps as (select *,
 ref_start + coalesce(sum(case when op in (0,2,3,7,8) then len else 0 end) over w, 0) as rp,
 coalesce(sum(case when op in (0,1,4,5,7,8) then len else 0 end) over w, 0) as qp
 from v_cigar window w as (partition by read_id order by idx rows between unbounded preceding and 1 preceding))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, seq: DNA made of all letters of each document."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    dna = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.coalesce(dna, F.lit("")).alias("seq"))


SEQUENCES = """v_seq as (select doc_id as seq_id, coalesce(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '') as seq from documents)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, sub (0 to 9), prob."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("p", "e"))
    return rows.select("vec_id", "label", F.col("p").cast("int").alias("sub"), (1 / (1 + F.exp(-8 * F.col("e").cast("double")))).alias("prob"))


PREDICTIONS = """v_pred as (select vec_id, label, cast(p-1 as int) as sub, 1/(1+exp(-8*cast(embedding[p] as double))) as prob from embeddings, range(1,11) t(p))"""


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster (one a customer), hap (1-based), hap_id, states: 3 sites for three clusters of five, 2 sites for the others."""
    sites = F.when(F.col("c_custkey") % 5 < 3, 3).otherwise(2)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("cluster"), sites.alias("sites"))
    rows = rows.select("cluster", "sites", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, sites) - 1"))).alias("bits"))
    states = F.transform(F.sequence(F.lit(0), F.col("sites") - 1), lambda i: F.expr("int(0)") + F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)))
    return rows.select("cluster", (F.col("bits") + 1).cast("int").alias("hap"), F.concat(F.lit("H"), (F.col("bits") + 1).cast("string")).alias("hap_id"), states.alias("states"))


HAPLOTYPES = """v_hap as (select cast(c_custkey as int) as cluster, cast(b.bits + 1 as int) as hap, 'H' || (b.bits + 1) as hap_id,
 [cast((b.bits >> i) & 1 as int) for i in range(0, case when c_custkey % 5 < 3 then 3 else 2 end)] as states
 from customer, range(0, 8) b(bits) where b.bits < case when c_custkey % 5 < 3 then 8 else 4 end)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, read_id, sv, st, kmer: distinct votes of reads for the state of a site."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 10 as int) as cluster",
        "l_orderkey as read_id",
        "cast((l_linenumber-1)%3 as int) as sv",
        "cast(case when l_returnflag='R' then 1 else 0 end as int) as st",
        "l_partkey as kmer",
    )


VOTES = """v_votes as (select cast(l_suppkey % 10 as int) as cluster, l_orderkey as read_id, cast((l_linenumber-1)%3 as int) as sv, cast(case when l_returnflag='R' then 1 else 0 end as int) as st, l_partkey as kmer from lineitem)"""
