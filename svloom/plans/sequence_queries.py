"""Queries on sequences and haplotypes (OP-08, 12 to 27, 36, 41, 63)."""

from __future__ import annotations

from pyspark.sql import functions as F

from svloom.functions import dna
from svloom.operators import evidence as ev, haplotypes as hp, kmers as km
from svloom.plans import views as v, variant_queries as vq
from svloom.plans.registry import query
from svloom.sources import fasta, indexed_fasta, storage

K, CHUNK = 21, 500


SLICES = v.SEQUENCES + ", v_reg as (select seq_id, seq, least(seq_id % 100, length(seq)) as s, least(seq_id % 100 + 250 + seq_id % 500, length(seq)) as e from v_seq)"


def regions(spark, sf_dir):
    """One region a sequence, within its bounds."""
    n = F.col("seq_id")
    return v.sequences(spark, sf_dir).select("seq_id", F.least(n % 100, F.length("seq")).alias("s"), F.least(n % 100 + 250 + n % 500, F.length("seq")).alias("e"))


@query(f"with {SLICES} select seq_id, s, e, substring(seq, cast(s + 1 as bigint), cast(e - s as bigint)) as slice from v_reg")
def sv08_reference_slice(spark, sf_dir):
    chunks = fasta.to_chunks(v.sequences(spark, sf_dir).select(F.col("seq_id").alias("contig"), "seq"), CHUNK)
    return fasta.slices(chunks, regions(spark, sf_dir).withColumnRenamed("seq_id", "contig"), CHUNK).withColumnRenamed("contig", "seq_id")


def fasta_parts(spark, sf_dir):
    """The sequences as a folder of indexed FASTA files."""
    path = storage.scratch(spark, "fasta")
    indexed_fasta.write_fasta(v.sequences(spark, sf_dir).select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("name"), F.lower("seq").alias("sequence")), path, 60)
    return path


@query(f"with {SLICES} select 's' || seq_id as contig, s, e, substring(seq, cast(s + 1 as bigint), cast(e - s as bigint)) as slice from v_reg")
def sv08_indexed_slices(spark, sf_dir):
    """Slices read from indexed files by their bytes."""
    wanted = regions(spark, sf_dir).select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("contig"), "s", "e")
    return indexed_fasta.fetch_slices(wanted, fasta_parts(spark, sf_dir), start="s", end="e")


@query(f"with {v.SEQUENCES} select 's' || seq_id as contig, cast(i // 1000 as int) as chunk, i as chunk_start, substring(seq, i + 1, 1000) as piece from (select *, unnest(range(0, length(seq), 1000)) as i from v_seq)")
def sv20_fasta_chunks(spark, sf_dir):
    """Chunks of 1,000 bases from indexed files, in tasks of 100,000."""
    return indexed_fasta.read_chunks(spark, fasta_parts(spark, sf_dir), 1000, split_bases=100_000)


CHOICES = f"""{vq.CLUSTERED}, v_sites as (select *, cast(case when a1 = a2 or phased then 2 else 3 end as int) as nch, row_number() over (partition by chrom, cluster order by start_pos, end_pos, event_id) as ord from v_clustered)"""
COMBOS = f"""{CHOICES}, v_rad as (select *, product(nch) over (partition by chrom, cluster) as tot, coalesce(product(nch) over (partition by chrom, cluster order by ord rows between unbounded preceding and 1 preceding), 1) as rad from v_sites),
v_digit as (select r.*, c.combination, cast(floor(c.combination / rad) as bigint) % nch as d from (select * from v_rad where tot <= 1024) r, range(0, 1024) c(combination) where c.combination < r.tot),
v_combo as (select *, case when d = nch - 1 then 0 when d = 1 then a2 else a1 end as h1, case when d = nch - 1 then 0 when d = 1 then a1 else a2 end as h2 from v_digit),
v_act as (select chrom, cluster, combination, start_pos < lag(end_pos) over (partition by chrom, cluster, combination, h order by ord) as bad from (select *, 1 as h from v_combo where h1 <> 0 union all select *, 2 from v_combo where h2 <> 0)),
v_state as (select c.chrom, c.cluster, c.combination, string_agg(h1, ',' order by ord) as states1, string_agg(h2, ',' order by ord) as states2 from v_combo c group by 1, 2, 3),
v_good as (select s.* from v_state s where not exists (select 1 from v_act a where a.bad and a.chrom = s.chrom and a.cluster = s.cluster and a.combination = s.combination)),
v_set as (select distinct chrom, cluster, unnest([states1, states2]) as states from v_good)"""


@query(f"with {CHOICES} select event_id, case when nch = 3 then a1 || ':' || a2 || ';' || a2 || ':' || a1 || ';0:0' else a1 || ':' || a2 || ';0:0' end as choices from v_sites")
def sv12_genotype_choices(spark, sf_dir):
    text = F.array_join(F.transform(hp.choices(F.col("a1"), F.col("a2"), F.col("phased")), lambda x: F.concat_ws(":", x["h1"], x["h2"])), ";")
    return vq.indels(spark, sf_dir).select("event_id", text.alias("choices"))


@query(f"with {COMBOS} select chrom, cluster, cast(max(tot) as bigint) as combinations, count(*) as sites from v_rad where tot <= 1024 group by 1, 2")
def sv13_combo_guard(spark, sf_dir):
    return hp.guarded(vq.clustered(spark, sf_dir)).select("chrom", "cluster", F.col("combinations").cast("long").alias("combinations"), F.size("sites").cast("long").alias("sites"))


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"with {COMBOS} select chrom, cluster, cast(combination as int) as combination, states1, states2 from v_state")
def sv14_combo_product(spark, sf_dir):
    rows = hp.combinations(hp.guarded(vq.clustered(spark, sf_dir)))
    return rows.select("chrom", "cluster", "combination", joined(F.transform("pairs", lambda p: p["h1"])).alias("states1"), joined(F.transform("pairs", lambda p: p["h2"])).alias("states2"))


def surviving(spark, sf_dir):
    return hp.without_overlaps(hp.combinations(hp.guarded(vq.clustered(spark, sf_dir))))


@query(f"with {COMBOS} select chrom, cluster, cast(combination as int) as combination from v_good")
def sv15_overlap_reject(spark, sf_dir):
    return surviving(spark, sf_dir).select("chrom", "cluster", "combination")


@query(f"with {COMBOS} select chrom, cluster, states, cast(row_number() over (partition by chrom, cluster order by states) as int) as hap from v_set")
def sv16_haplotype_set(spark, sf_dir):
    return hp.haplotype_set(surviving(spark, sf_dir)).select("chrom", "cluster", joined(F.col("states")).alias("states"), "hap")


def edited(spark, sf_dir):
    """Three sites on each sequence of at least 200 bases, and the eight haplotypes of them."""
    n = F.col("seq_id")
    site = lambda s, e, alt: F.struct(F.lit(s).cast("long").alias("start_pos"), e.cast("long").alias("end_pos"), alt.alias("alt")).cast("struct<start_pos:bigint,end_pos:bigint,alt:string>")
    sites = F.array(site(30, 31 + n % 20, F.lit("A")), site(80, F.lit(81), F.concat(F.lit("G"), F.repeat(F.lit("ACGT"), (n % 9).cast("int")))), site(140, 142 + n % 40, F.lit("TT")))
    rows = v.sequences(spark, sf_dir).where("length(seq) >= 200").select("seq_id", "seq", sites.alias("sites"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bits"))
    return rows.withColumn("states", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1))))


EDITED = v.SEQUENCES + """, v_ed as (select seq_id, seq, cast(b.bits as int) as bits, b.bits & 1 as s1, (b.bits >> 1) & 1 as s2, (b.bits >> 2) & 1 as s3, 1 + seq_id % 20 as d1, 1 + 4 * (seq_id % 9) as n2, 2 + seq_id % 40 as d3 from v_seq, range(0, 8) b(bits) where length(seq) >= 200),
v_hs as (select *, substring(seq, 1, 30) || case when s1 = 1 then 'A' else substring(seq, 31, d1) end || substring(seq, 31 + d1, 50 - d1) || case when s2 = 1 then 'G' || repeat('ACGT', cast(seq_id % 9 as bigint)) else substring(seq, 81, 1) end || substring(seq, 82, 59) || case when s3 = 1 then 'TT' else substring(seq, 141, d3) end || substring(seq, 141 + d3) as hap,
 case when s1 = 1 then 1 - d1 else 0 end as f1, case when s2 = 1 then n2 - 1 else 0 end as f2 from v_ed)"""


@query(f"with {EDITED} select seq_id, bits, hap as sequence from v_hs")
def sv17_haplotype_sequence(spark, sf_dir):
    return edited(spark, sf_dir).select("seq_id", "bits", hp.sequence_of(F.col("seq"), F.col("sites"), F.col("states")).alias("sequence"))


@query(f"""with {EDITED}, p as (select seq_id, bits, unnest([0, 1, 2]) as k, unnest([30, 80 + f1, 140 + f1 + f2]) as s, unnest([case when s1 = 1 then 31 else 30 + d1 end, 80 + f1 + case when s2 = 1 then n2 else 1 end, 140 + f1 + f2 + case when s3 = 1 then 2 else d3 end]) as e from v_hs)
select seq_id, bits, cast(k as int) as site, cast(s as bigint) as start_pos, cast(e as bigint) as end_pos from p""")
def sv18_boundary_projection(spark, sf_dir):
    rows = edited(spark, sf_dir)
    rows = rows.withColumn("length", F.length(hp.sequence_of(F.col("seq"), F.col("sites"), F.col("states"))).cast("long"))
    return rows.select("seq_id", "bits", F.posexplode(hp.projected_intervals(F.col("sites"), F.col("states"), F.col("length"))).alias("site", "x")).select("seq_id", "bits", "site", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"))


@query(f"""with {v.HAPLOTYPES} select cluster, hap_id, 'SVs=' || list_aggregate([('c' || cluster || '.' || i || ':' || (10 * i) || '-' || (10 * i + 5)) for i in range(0, len(states))], 'string_agg', ';') || '|GT=' || list_aggregate([cast(x as varchar) for x in states], 'string_agg', ':') as header,
 cast(len(states) as int) as sites, cast(list_sum(states) as bigint) as present from v_hap""")
def sv19_header_codec(spark, sf_dir):
    rows = v.spread(v.haplotypes(spark, sf_dir), "cluster", "hap_id")
    index = F.sequence(F.lit(0), F.size("states") - 1)
    ids = F.transform(index, lambda i: F.concat(F.lit("c"), F.col("cluster").cast("string"), F.lit("."), i.cast("string")))
    spans = F.transform(index, lambda i: F.struct((10 * i).alias("start"), (10 * i + 5).alias("end")))
    rows = rows.select("cluster", "hap_id", hp.encode_header(ids, spans, F.col("states")).alias("header")).withColumn("d", hp.decode_header(F.col("header")))
    again = hp.encode_header(F.transform("d.intervals", lambda x: x.getField("sv_id")), F.col("d.intervals"), F.col("d.states"))
    total = F.aggregate("d.states", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("cluster", "hap_id", again.alias("header"), F.size("d.intervals").alias("sites"), total.alias("present"))


@query(f"with {v.SEQUENCES} select 's' || seq_id as name, seq as sequence from v_seq where seq <> ''")
def sv20_fasta_scan(spark, sf_dir):
    lines = fasta.to_lines(v.sequences(spark, sf_dir).select(F.concat(F.lit("s"), F.col("seq_id").cast("string")).alias("name"), F.lower("seq").alias("sequence")))
    return fasta.parse_lines(lines).where("sequence <> ''")


KMERS = v.SEQUENCES + f", v_kmer as (select seq_id, substring(seq, i, {K}) as kmer from (select seq_id, seq, unnest(range(1, length(seq) - {K} + 2)) as i from v_seq)), v_canon as (select seq_id, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as kmer, kmer as plain from v_kmer)"
RUNS = "list_max(list_transform(regexp_extract_all({0}, 'A+|C+|G+|T+'), lambda x: length(x)))"
MOST = "greatest(" + ", ".join(f"{K} - length(replace(plain, '{b}', ''))" for b in "ACGT") + ")"
LOW = f"({MOST} = {K} or 10 * {MOST} >= {8 * K} or 10 * {RUNS.format('plain')} >= {6 * K})"


@query(f"with {KMERS} select kmer, count(*) as n from v_canon group by 1")
def sv21_canonical_kmers(spark, sf_dir):
    bases = v.table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return km.spelled(km.counts(v.sequences(spark, sf_dir), "seq", K, 1 + bases // km.SHARD), K)


@query(f"with {v.SEQUENCES} select seq_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') as compressed from v_seq")
def sv22_homopolymer_compress(spark, sf_dir):
    return v.sequences(spark, sf_dir).select("seq_id", dna.compress(F.col("seq")).alias("compressed"))


@query(f"with {v.SEQUENCES} select seq_id, cast(coalesce({RUNS.format('seq')}, 0) as int) as longest from v_seq")
def sv23_max_homopolymer_run(spark, sf_dir):
    return v.sequences(spark, sf_dir).select("seq_id", dna.longest_run(F.col("seq")).alias("longest"))


@query(f"with {KMERS} select seq_id, count(*) as n, count(*) filter (where {LOW}) as low from v_canon group by 1")
def sv24_low_complexity(spark, sf_dir):
    return km.complexity(v.sequences(spark, sf_dir).select("seq_id", "seq"), "seq", K).where("n > 0")


@query(f"with {KMERS} select distinct seq_id, kmer from v_canon where not {LOW}")
def sv25_kmers(spark, sf_dir):
    """Each k-mer once a sequence, as a sequence is one row; nothing is shuffled."""
    return km.spelled(km.of_rows(v.sequences(spark, sf_dir).select("seq_id", "seq"), "seq", K, distinct=True, complex_only=True), K)


CONTEXTS = v.SEQUENCES + ", v_ctx as (select seq_id, case when greatest(0, 100 - 60) < least(length(seq), 150 + 60) then substring(seq, 41, least(length(seq), 210) - 40) else '' end as context from v_seq)"


def contexts(spark, sf_dir):
    return v.sequences(spark, sf_dir).select("seq_id", dna.context(F.col("seq"), F.lit(100), F.lit(150), 60).alias("context"))


@query(f"with {CONTEXTS} select * from v_ctx")
def sv26_interval_context(spark, sf_dir):
    return contexts(spark, sf_dir)


@query(f"""with {CONTEXTS}, k as (select cast(seq_id // 4 as bigint) as sv, cast(seq_id % 2 as int) as st, unnest([substring(context, i, {K}) for i in range(1, length(context) - {K} + 2)]) as plain from v_ctx),
s as (select sv, least(plain, reverse(translate(plain, 'ACGT', 'TGCA'))) as kmer, min(st) as lo, max(st) as hi from k group by 1, 2) select sv, kmer, cast(lo as int) as state from s where lo = hi""")
def sv27_state_kmers(spark, sf_dir):
    rows = contexts(spark, sf_dir).select(F.floor(F.col("seq_id") / 4).alias("sv"), (F.col("seq_id") % 2).cast("int").alias("state"), "context")
    return ev.state_kmers(rows, K)


@query(f"with {v.HAPLOTYPES} select a.cluster, a.hap_id || '__' || b.hap_id as pair_id, cast(row_number() over (partition by a.cluster order by a.hap, b.hap) as int) as \"order\" from v_hap a join v_hap b on a.cluster = b.cluster and a.hap <= b.hap")
def sv36_make_pairs(spark, sf_dir):
    return hp.pairs(v.haplotypes(spark, sf_dir)).select("cluster", "pair_id", "order")


@query(f"with {v.HAPLOTYPES}, p as (select a.cluster, a.hap_id || '__' || b.hap_id as pair_id, row_number() over (partition by a.cluster order by a.hap, b.hap) as rank, count(*) over (partition by a.cluster) as total from v_hap a join v_hap b on a.cluster = b.cluster and a.hap <= b.hap) select cluster, pair_id, cast(rank as int) as rank, cast(null as double) as score, 'bypass_total_pairs_le_threshold' as reason from p where total <= 30")
def sv41_bypass_pairs(spark, sf_dir):
    return ev.bypass(hp.pairs(v.haplotypes(spark, sf_dir)), 30).select("cluster", "pair_id", "rank", "score", "reason")


@query(f"with {v.HAPLOTYPES} select a.cluster, a.hap_id || '__' || b.hap_id as pair_id, list_aggregate([least(a.states[i], b.states[i]) || '/' || greatest(a.states[i], b.states[i]) for i in range(1, len(a.states) + 1)], 'string_agg', ';') as genotype from v_hap a join v_hap b on a.cluster = b.cluster and a.hap <= b.hap")
def sv63_pair_genotypes(spark, sf_dir):
    rows = hp.pairs(v.haplotypes(spark, sf_dir))
    return rows.select("cluster", "pair_id", F.array_join(hp.pair_genotypes(F.col("states1"), F.col("states2")), ";").alias("genotype"))
