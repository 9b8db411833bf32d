"""Queries on alignments (OP-29, 30, 32, 47 to 49, 53 to 59, 72, 73, 75 to 77)."""

from __future__ import annotations

from pyspark.sql import functions as F

from svloom.operators import alignment as al, assignment as an, intervals as iv, labels as lb, windows as wn
from svloom.plans import views as v
from svloom.plans.registry import query
from svloom.sources import bam, storage

START, END, LENGTH = 5000, 9000, 25_000
lit = lambda x: F.lit(x).cast("long")


def stepped(spark, sf_dir):
    return al.explode_steps(v.reads(spark, sf_dir))


@query(f"with {v.STEPS} select read_id, cast(min(qp + greatest(rp, {START}) - rp) as bigint) as q_start, cast(max(qp + least(rp + len, {END}) - rp) as bigint) as q_end from v_steps where op in (0,7,8) and greatest(rp, {START}) < least(rp + len, {END}) group by 1")
def sv29_cigar_ref_to_query(spark, sf_dir):
    return al.query_span(stepped(spark, sf_dir), lit(START), lit(END))


@query(f"with {v.STEPS} select read_id, idx, cast(qp as bigint) as q_start, cast(qp + len as bigint) as q_end from v_steps where (op = 1 and len >= 20 and rp between {START} and {END}) or (op = 4 and len >= 20 and (rp between {START} and {END} or abs(rp - {START}) <= 20 or abs(rp - {END}) <= 20))")
def sv30_large_query_segments(spark, sf_dir):
    return al.large_segments(stepped(spark, sf_dir), lit(START), lit(END), 20, 20)


@query("with v_rec as (select l_orderkey as read_id, l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as record_no, cast(case when l_returnflag = 'R' then 1 else 0 end as int) as is_primary, cast(floor(l_quantity) as bigint) as len, cast(l_partkey % 60 as int) as mapq from lineitem), r as (select *, row_number() over (partition by read_id order by is_primary desc, len desc, mapq desc, record_no) as k from v_rec) select read_id, record_no, is_primary, len, mapq from r where k = 1")
def sv32_best_record_per_read(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as read_id", "l_orderkey * 1000000 + l_partkey * 8 + l_linenumber as record_no", "cast(case when l_returnflag = 'R' then 1 else 0 end as int) as is_primary", "cast(floor(l_quantity) as bigint) as len", "cast(l_partkey % 60 as int) as mapq")
    return al.best_record(rows, "read_id", F.struct("is_primary", "len", "mapq"))


SCORES = v.CIGARS + ", v_score as (select read_id, cast(sum(case when op in (0,1,7,8) then len when op in (4,5) then -len else 0 end) - 3 * (read_id % 11) as bigint) as score from v_cigar group by read_id)"


def read_scores(spark, sf_dir):
    return v.reads(spark, sf_dir).select("read_id", al.record_score(F.col("cigar"), F.col("read_id") % 11).alias("score"))


@query(f"with {SCORES} select * from v_score")
def sv47_alignment_score(spark, sf_dir):
    return read_scores(spark, sf_dir).groupBy("read_id").agg(F.sum("score").alias("score"))


def pair_scores(spark, sf_dir):
    """Five pairs: a read's score on each side, missing for some reads, tied for many."""
    rows = read_scores(spark, sf_dir)
    n = F.col("read_id")
    return rows.select((n % 5).alias("pair_id"), "read_id", F.when(n % 7 != 0, F.floor(F.col("score") / 20)).alias("score1"), F.when(n % 11 != 0, F.floor((F.col("score") + n % 13) / 20)).alias("score2"))


def assigned(spark, sf_dir):
    return an.assigned_reads(pair_scores(spark, sf_dir), storage.scratch(spark, "reads"))


PAIR_SCORES = SCORES + ", v_ps as (select read_id % 5 as pair_id, read_id, case when read_id % 7 <> 0 then cast(floor(score / 20.0::double) as bigint) end as s1, case when read_id % 11 <> 0 then cast(floor((score + read_id % 13) / 20.0::double) as bigint) end as s2 from v_score)"
FOLD = PAIR_SCORES + """, v_kind as (select pair_id, list(case when s1 is null and s2 is null then 0 when s2 is null or s1 > s2 then 1 when s1 is null or s2 > s1 then 2 else 3 end order by read_id) as kinds,
 count(*) filter (where s1 > s2) as hap1_better, count(*) filter (where s2 > s1) as hap2_better, count(*) filter (where s1 = s2) as score_ties, count(*) filter (where s1 is not null and s2 is null) as only_hap1, count(*) filter (where s2 is not null and s1 is null) as only_hap2, count(*) filter (where s1 is null and s2 is null) as neither_aligned from v_ps group by 1),
v_fold as (select *, list_reduce(list_prepend(0::bigint, list_transform(kinds, lambda k: k::bigint)), lambda d, k: case k when 1 then d + 1 when 2 then d - 1 when 3 then (case when d <= 0 then d + 1 else d - 1 end) else d end) as diff, len(kinds) - neither_aligned as total from v_kind)"""


@query(f"with {FOLD} select pair_id, cast((total + diff) // 2 as bigint) as n1, cast((total - diff) // 2 as bigint) as n2, hap1_better, hap2_better, score_ties, only_hap1, only_hap2, neither_aligned from v_fold")
def sv48_assign_reads(spark, sf_dir):
    return an.assignment_counts(assigned(spark, sf_dir))


ASSIGNED = PAIR_SCORES + """, v_walk as (select pair_id, list(read_id order by read_id) as ids, list_reduce(list_prepend({'d': 0::bigint, 's': ''}, list({'d': case when s1 is null and s2 is null then 0::bigint when s2 is null or s1 > s2 then 1::bigint when s1 is null or s2 > s1 then 2::bigint else 3::bigint end, 's': ''} order by read_id)),
 lambda a, x: {'d': a.d + case when x.d = 1 or (x.d = 3 and a.d <= 0) then 1 when x.d = 0 then 0 else -1 end, 's': a.s || case when x.d = 1 or (x.d = 3 and a.d <= 0) then '1' when x.d = 0 then '0' else '2' end}) as walk from v_ps group by 1),
v_side as (select pair_id, unnest(ids) as read_id, unnest(string_split(walk.s, '')) as c from v_walk), v_assigned as (select pair_id, read_id, cast(nullif(cast(c as int), 0) as int) as side from v_side)"""


@query(f"with {ASSIGNED} select * from v_assigned")
def sv48_assigned_reads(spark, sf_dir):
    return assigned(spark, sf_dir).select("pair_id", "read_id", "side")


RECORDS = """v_rec as (select 'H' || (l_suppkey % 3) as hap_id, l_orderkey as read_id, cast(floor(l_quantity) - 3 * (l_partkey % 4) - l_linenumber as bigint) as score from lineitem where l_partkey % 17 <> 0 and l_partkey % 19 <> 0 and l_partkey % 23 <> 0),
v_sc as (select hap_id, read_id, sum(score) as s, count(*) as records from v_rec group by 1, 2), v_pairs(pair_id, h1, h2) as (values ('P00', 'H0', 'H0'), ('P01', 'H0', 'H1'), ('P02', 'H0', 'H2'), ('P12', 'H1', 'H2')),
v_names as (select read_id from v_sc union select o_orderkey from orders where o_orderkey % 2 = 0),
v_ps as (select pair_id, n.read_id, a.s as s1, b.s as s2 from v_names n cross join v_pairs p left join v_sc a on a.hap_id = h1 and a.read_id = n.read_id left join v_sc b on b.hap_id = h2 and b.read_id = n.read_id
 where h1 <> h2 and (a.s is not null or b.s is not null or (n.read_id % 2 = 0 and n.read_id in (select o_orderkey from orders))))"""


def two_sided(spark, sf_dir):
    """(pairs, records, assigned reads): records of reads on three haplotypes, some unmapped, secondary or on another contig."""
    pairs = spark.createDataFrame([(f"P{a[1]}{b[1]}", 1, a, b) for a, b in [("H0", "H0"), ("H0", "H1"), ("H0", "H2"), ("H1", "H2")]], "pair_id string, cluster int, hap1_id string, hap2_id string")
    records = v.table(spark, sf_dir, "lineitem").selectExpr(
        "concat('H', cast(l_suppkey % 3 as string)) as hap_id",
        "concat('c', cast(l_suppkey % 3 as string)) as hap_contig",
        "l_orderkey as read_id",
        "case when l_partkey % 17 = 0 then 256 when l_partkey % 19 = 0 then 4 else 0 end as flag",
        "case when l_partkey % 23 = 0 then 'other' else concat('c', cast(l_suppkey % 3 as string)) end as contig",
        "array(struct(0 as op, cast(floor(l_quantity) as bigint) as len), struct(4 as op, cast(l_linenumber as bigint) as len)) as cigar",
        "cast(l_partkey % 4 as int) as nm",
    )
    names = v.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.lit(1).alias("cluster"), F.col("o_orderkey").alias("read_id"))
    scores = an.joined_scores(pairs, an.haplotype_scores(records), names)
    return pairs, records, an.assigned_reads(scores, storage.scratch(spark, "reads"))


#: The fold over the pairs of v_ps: kinds and the running difference, and each read's side.
BOTH_SIDED = RECORDS + FOLD.removeprefix(PAIR_SCORES)


@query(f"""with {BOTH_SIDED} select p.pair_id, case when h1 <> h2 then cast((total + diff) // 2 as bigint) end as n1, case when h1 <> h2 then cast((total - diff) // 2 as bigint) end as n2,
 """ + ", ".join(f"coalesce({c}, 0) as {c}" for c in ("hap1_better", "hap2_better", "score_ties", "only_hap1", "only_hap2", "neither_aligned")) + " from v_pairs p left join v_fold f on f.pair_id = p.pair_id")
def sv48_pair_counts(spark, sf_dir):
    """From records on: scores by haplotype, the outer join by read name, the assignment, and a pair of one haplotype."""
    pairs, _, assigned = two_sided(spark, sf_dir)
    return an.pair_counts(pairs, assigned)


@query(f"""with {RECORDS}{ASSIGNED.removeprefix(PAIR_SCORES)}, r as (select a.pair_id, case when side = 1 then h1 else h2 end as hap_id, read_id from v_assigned a join v_pairs p on p.pair_id = a.pair_id where side is not null union all select pair_id, h1, read_id from v_pairs, v_sc where h1 = h2 and hap_id = h1)
select pair_id, r.hap_id, r.read_id, records from r join v_sc s on s.hap_id = r.hap_id and s.read_id = r.read_id""")
def sv48_assigned_records(spark, sf_dir):
    """Records of each haplotype of each pair; of a pair of one haplotype all."""
    rows = an.assigned_records(*two_sided(spark, sf_dir))
    return rows.groupBy("pair_id", "hap_id", "read_id").agg(F.count(F.lit(1)).alias("records"))


CONTIGS = [(f"ctg{k}", LENGTH) for k in range(5)]


@query(f"""with {v.CIGARS}, r as (select read_id, contig, ref_start, cast(ref_start + sum(case when op in (0,2,3,7,8) then len else 0 end) as bigint) as ref_end, count(*) as operations from v_cigar group by 1,2,3),
t as (select p_partkey as region_id, concat('ctg', p_partkey % 5) as contig, (p_partkey * 53) % 20000 as s, (p_partkey * 53) % 20000 + p_size as e from part)
select region_id, read_id::varchar as read_id, r.contig, ref_start, ref_end, operations from r join t on r.contig = t.contig and ref_start < e and ref_end > s where ref_start < ref_end""")
def sv33_bam_regions(spark, sf_dir):
    """The reads are written as indexed BAM parts, then regions fetch their records by index."""
    path = storage.scratch(spark, "bam")
    reads = v.reads(spark, sf_dir).select(F.col("read_id").cast("string").alias("read_id"), F.lit(0).alias("flag"), "contig", "ref_start", F.lit(60).alias("mapq"), "cigar", F.lit("*").alias("seq"), F.lit(False).alias("has_sa"))
    bam.write_bam(reads, path, CONTIGS)
    met = bam.fetch_regions(sites(spark, sf_dir).withColumnRenamed("variant_id", "region_id"), path)
    return met.select("region_id", "read_id", "contig", "ref_start", "ref_end", F.size("cigar").cast("long").alias("operations"))


@query(f"with {SCORES} select read_id % 5 as pair_id, count(*) as records, cast(null as bigint) as n1, cast(null as bigint) as n2 from v_score group by 1")
def sv49_self_pair_branch(spark, sf_dir):
    none = F.lit(None).cast("long")
    return read_scores(spark, sf_dir).groupBy((F.col("read_id") % 5).alias("pair_id")).agg(F.count(F.lit(1)).alias("records")).select("pair_id", "records", none.alias("n1"), none.alias("n2"))


@query(f"with {FOLD}, n as (select pair_id, (total + diff) // 2 as a, (total - diff) // 2 as b from v_fold) select pair_id, case when a > 0 then (a + b) / a::double else 1.0 end as scale1, case when b > 0 then (a + b) / b::double else 1.0 end as scale2 from n")
def sv53_depth_scale(spark, sf_dir):
    rows = an.assignment_counts(assigned(spark, sf_dir))
    one, two = al.depth_scales(F.col("n1"), F.col("n2"))
    return rows.select("pair_id", one.alias("scale1"), two.alias("scale2"))


#: A record's end is one behind its start at least. Records that do not overlap the region count in no channel; the depth is that of whole records.
SPAN = "v_span as (select read_id, contig, ref_start, cast(greatest(ref_start + 1, max(rp + case when op in (0,2,3,7,8) then len else 0 end)) as bigint) as ref_end from v_steps group by 1, 2, 3)"
PILED = """count(*) filter (where op = -2) as depth, count(*) filter (where op = 2) as deletions, count(*) filter (where op in (4,5)) as clips, count(*) filter (where op = 1) as insertions, coalesce(avg(n) filter (where op = 1), 0.0::double) as insertion_mean,
 cast(coalesce(max(n) filter (where op = 1), 0) as bigint) as insertion_max, coalesce(avg(n) filter (where op = 2), 0.0::double) as deletion_mean, cast(coalesce(max(n) filter (where op = 2), 0) as bigint) as deletion_max"""
TRIM = v.STEPS + f""", {SPAN}, v_trim as (select *, greatest(rp, {START}) as first_, case when op in (0,2,3,7,8) then least(rp + len, {END}) - greatest(rp, {START}) else len end as cut from v_steps where (op in (0,2,3,7,8) and rp + len > {START} and rp < {END}) or (op in (1,4,5) and rp >= {START} and rp < {END})),
v_base as (select t.read_id, t.contig, op, cast(cut as bigint) as n, cast(unnest(case when op in (1,4,5) then [cast(first_ as bigint)] else range(cast(first_ as bigint), cast(first_ + cut as bigint)) end) as bigint) as pos from v_trim t join v_span s on s.read_id = t.read_id where ref_end > {START} and op in (1, 2, 4, 5) and cut > 0
 union all select read_id, contig, -2, 0, unnest(range(greatest(ref_start, {START}), least(ref_end, {END}))) from v_span where ref_end > {START} and ref_start < {END}),
v_pile as (select contig, pos, {PILED} from v_base group by 1, 2)"""


COUNTED = ["depth", "deletions", "clips", "insertions", "insertion_max", "deletion_max", "mismatches"]


def pile(spark, sf_dir, reads=None, by=("contig",)):
    """Channels of the bases from START to END, by the dense window of that width."""
    reads, by = v.reads(spark, sf_dir) if reads is None else reads, list(by)
    windows = reads.select(*by).distinct().withColumn("window_start", lit(START))
    rows = wn.base_rows(wn.window_matrices(reads, windows, by, END - START, normalize=False), by, END - START)
    return rows.withColumns({c: F.col(c).cast("long") for c in COUNTED})


def tagged_reads(spark, sf_dir):
    """Reads with MD tags: the last base of each M or = run differs, and every base of an X run."""
    one = lambda x: F.when(x["op"].isin(0, 7), F.concat((x["len"] - 1).cast("string"), F.lit("T"))).when(x["op"] == 8, F.repeat(F.lit("C"), x["len"].cast("int"))).when(x["op"] == 2, F.concat(F.lit("^"), F.repeat(F.lit("A"), x["len"].cast("int")), F.lit("0"))).otherwise("")
    return v.reads(spark, sf_dir).withColumn("md", F.array_join(F.transform("cigar", one), ""))


@query(f"with {TRIM} select read_id, idx, op, cast(cut as bigint) as len from v_trim")
def sv55_trim_cigar(spark, sf_dir):
    return al.trim(stepped(spark, sf_dir), lit(START), lit(END)).select("read_id", "idx", "op", F.col("cut").alias("len"))


@query("select l_orderkey as read_id, l_partkey as part, cast(l_suppkey + l_quantity + 6 as bigint) as on_reference, cast(3 as bigint) as deleted, cast(3 as bigint) as mismatches from lineitem")
def sv56_parse_md(spark, sf_dir):
    md = F.concat(F.col("l_suppkey").cast("string"), F.lit("A^CGT"), F.lit("0"), F.lit("G"), F.col("l_quantity").cast("long").cast("string"), F.lit("T"))
    tokens = al.parse_md(md)
    total = lambda kinds: F.aggregate(F.filter("t", lambda x: x["kind"].isin(kinds)), lit(0), lambda a, x: a + x["len"])
    rows = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("part"), tokens.alias("t"))
    return rows.select("read_id", "part", total(["=", "X", "D"]).alias("on_reference"), total(["D"]).alias("deleted"), total(["X"]).alias("mismatches"))


def trimmed_md(spark, sf_dir):
    return al.trim_md(tagged_reads(spark, sf_dir).drop("cigar"), lit(START), lit(END))


WRONG_ALL = "v_wrong_all as (select read_id, contig, cast(unnest(case when op = 8 then range(cast(rp as bigint), cast(rp + len as bigint)) else [cast(rp + len - 1 as bigint)] end) as bigint) as pos from v_steps where op in (0,7,8))"
WRONG = f"v_wrong as (select * from (select read_id, contig, cast(unnest(case when op = 8 then range(cast(rp as bigint), cast(rp + len as bigint)) else [cast(rp + len - 1 as bigint)] end) as bigint) as pos from v_steps where op in (0,7,8)) where pos >= {START} and pos < {END})"


@query(f"""with {v.STEPS}, {WRONG}, m as (select read_id, 'X' as kind, cast(1 as bigint) as len from v_wrong union all
select read_id, case when op = 2 then 'D' else '=' end, cast(least(rp + len - case when op = 2 then 0 else 1 end, {END}) - greatest(rp, {START}) as bigint) from v_steps where op in (0,2,7) and rp + len - case when op = 2 then 0 else 1 end > {START} and rp < {END})
select read_id, kind, cast(sum(len) as bigint) as len from m where len > 0 group by 1, 2""")
def sv56_trim_md(spark, sf_dir):
    return trimmed_md(spark, sf_dir).where("cut > 0").groupBy("read_id", "kind").agg(F.sum("cut").alias("len"))


ALL = "v_wrongs as (select contig, pos, count(*) as n from v_wrong group by 1, 2), v_all as (select v_pile.*, coalesce(v_wrongs.n, 0) as mismatches from v_pile left join v_wrongs using (contig, pos))"


@query(f"""with {TRIM}, {WRONG}, {ALL}, s as (select *, case when contig = 'ctg1' then 3.0::double else 1.5::double end as f from v_all)
select contig, pos, """ + ", ".join(f"ln(1 + (exp(ln(1 + {c})) - 1) * f) as {c}" for c in ("mismatches", "deletions", "clips", "insertions", "depth")) + " from s")
def sv54_scale_channels(spark, sf_dir):
    """All five count channels, scaled by a factor of each contig; the others stay."""
    reads = tagged_reads(spark, sf_dir)
    windows = reads.select("contig").distinct().select("contig", lit(START).alias("window_start"), F.when(F.col("contig") == "ctg1", 3.0).otherwise(1.5).alias("factor"))
    matrices = wn.window_matrices(reads, windows, ["contig"], END - START, scale="factor")
    return wn.base_rows(matrices, ["contig"], END - START).select("contig", "pos", *[wn.CHANNELS[k] for k in wn.COUNTS])


@query(f"with {TRIM} select * from v_pile")
def sv57_pileup(spark, sf_dir):
    return pile(spark, sf_dir).drop("mismatches")


@query(f"with {TRIM}, {WRONG}, {ALL} select * from v_all")
def sv57_pileup_channels(spark, sf_dir):
    """All nine channels."""
    return pile(spark, sf_dir, tagged_reads(spark, sf_dir))


#: Windows of 2000 bases, one of them twice over another; lengths are cut to each.
PLACES = [4000, 6000, 8000, 8500]
IN_WINDOWS = v.STEPS + f""", v_win(window_start) as (values {", ".join(f"({p}::bigint)" for p in PLACES)}), {{WRONG}},
{SPAN}, v_cut as (select t.contig, window_start, op, rp, case when op = 2 then least(rp + len, window_start + 2000) - greatest(rp, window_start) else len end as n, greatest(rp, window_start) as first_ from v_steps t join v_span s on s.read_id = t.read_id, v_win
 where ref_end > window_start and ((op = 2 and rp + len > window_start and rp < window_start + 2000) or (op in (1,4,5) and rp >= window_start and rp < window_start + 2000))),
v_px as (select contig, window_start, op, cast(n as bigint) as n, cast(unnest(case when op in (1,4,5) then [cast(first_ as bigint)] else range(cast(first_ as bigint), cast(first_ + n as bigint)) end) as bigint) as pos from v_cut
 union all select contig, window_start, -2, 0, unnest(range(greatest(ref_start, window_start), least(ref_end, window_start + 2000))) from v_span, v_win where ref_end > window_start and ref_start < window_start + 2000),
v_piled as (select contig, window_start, pos, {PILED} from v_px group by 1, 2, 3),
v_chan as (select contig, window_start, pos, unnest([{{{{'c': 1, 'x': deletions::double}}}}, {{{{'c': 2, 'x': clips}}}}, {{{{'c': 3, 'x': insertions}}}}, {{{{'c': 4, 'x': insertion_mean}}}}, {{{{'c': 5, 'x': insertion_max}}}}, {{{{'c': 6, 'x': deletion_mean}}}}, {{{{'c': 7, 'x': deletion_max}}}}, {{{{'c': 8, 'x': depth}}}}]) as u from v_piled),
v_values as (select contig, window_start, pos, u.c as c, u.x::double as x from v_chan where u.x <> 0 union all select contig, window_start, pos, 0, count(*)::double from v_wrong_all join v_win on pos >= window_start and pos < window_start + 2000 group by 1, 2, 3)""".format(WRONG=WRONG_ALL)


@query(f"with {IN_WINDOWS} select contig, window_start, cast((pos - window_start) * 9 + c as int) as place, ln(1 + x) as value from v_values")
def sv57_windows(spark, sf_dir):
    """Numbers of the 2000 x 9 windows that aren't zero, by their place in the dense array."""
    reads = tagged_reads(spark, sf_dir)
    windows = reads.select("contig").distinct().select("contig", F.explode(F.array(*map(lit, PLACES))).alias("window_start"))
    rows = wn.window_matrices(reads, windows, ["contig"]).select("contig", "window_start", F.posexplode("values").alias("place", "value"))
    return rows.where("value <> 0")


@query(f"with {TRIM} select contig, pos, ln(1 + depth::double) as depth, -ln(1 + deletion_mean) as minus_deletion_mean from v_pile")
def sv58_log_normalize(spark, sf_dir):
    return pile(spark, sf_dir).select("contig", "pos", al.log_normalize(F.col("depth").cast("double")).alias("depth"), al.log_normalize(-F.col("deletion_mean")).alias("minus_deletion_mean"))


@query(f"with {TRIM} select contig, pos // 300 as tile, count(*) filter (where depth > 0) as filled from v_pile where (pos // 300 + 1) * 300 <= {END} group by 1, 2 having count(*) filter (where depth > 0) > 0")
def sv59_tile_windows(spark, sf_dir):
    return iv.tile(pile(spark, sf_dir), ["contig"], 300, lit(END), F.col("depth") > 0)


@query(f"with {ASSIGNED}, {TRIM.removeprefix(v.CIGARS + ', ')}, b as (select a.pair_id, a.side, pos, op from v_base t join v_assigned a on a.read_id = t.read_id where a.side is not null) select pair_id, side, pos, count(*) filter (where op = -2) as depth, count(*) filter (where op = 2) as deletions from b group by 1, 2, 3 having count(*) filter (where op = -2) > 0")
def sv57_assigned_pileup(spark, sf_dir):
    """Depth and deletions of each haplotype of a pair, from the reads assigned to it."""
    sides = assigned(spark, sf_dir).where("side is not null").select("read_id", "pair_id", "side")
    reads = v.reads(spark, sf_dir).join(sides, "read_id")
    return pile(spark, sf_dir, reads, ["pair_id", "side"]).where("depth > 0").select("pair_id", "side", "pos", "depth", "deletions")


PATCHES = v.STEPS + """, v_flags as (select distinct read_id, contig, ref_start, case when read_id % 13 = 0 then 4 when read_id % 17 = 0 then 256 when read_id % 19 = 0 then 1024 when read_id % 8 = 0 then 2048 else 0 end as flag, read_id % 8 = 4 as has_sa from v_cigar),
v_end as (select f.read_id, f.contig, f.ref_start, f.flag = 2048 or has_sa as split, max(rp + case when op in (0,2,3,7,8) then len else 0 end) as ref_end from v_flags f join v_steps s on s.read_id = f.read_id where flag in (0, 2048) group by 1, 2, 3, 4),
v_large as (select read_id, op, rp, rp + len as re from v_steps where len >= 50 and op in (1, 2)),
v_patch as (select concat('ctg', c.i) as contig, cast(p.i * 200 as bigint) as pos from range(0, 5) c(i), range(0, 110) p(i)),
v_met as materialized (select p.contig, p.pos, e.read_id, e.split and ((e.ref_start >= pos and e.ref_start < pos + 200) or (e.ref_end >= pos and e.ref_end < pos + 200)) as broken
 from (select *, unnest(range(ref_start // 200, cast((ref_end - 1) // 200 + 1 as bigint))) as k from v_end where ref_start < ref_end) e join v_patch p on e.contig = p.contig and p.pos = e.k * 200),
v_indel as (select distinct m.pos, m.read_id from v_met m join v_large s on s.read_id = m.read_id and ((op = 1 and rp >= pos and rp < pos + 200) or (op = 2 and greatest(pos, rp) < least(pos + 200, re)))),
v_noise as materialized (select contig, m.pos, count(*) as checked, count(*) filter (where broken or i.pos is not null) as suspicious, count(*) filter (where broken or i.pos is not null) > 0.1::double * count(*) as noisy from v_met m left join v_indel i on i.pos = m.pos and i.read_id = m.read_id group by 1, 2)"""


def records(spark, sf_dir):
    """The reads as records: some unmapped, secondary or duplicate, some supplementary or with an SA tag."""
    n = F.col("read_id")
    flag = F.when(n % 13 == 0, 4).when(n % 17 == 0, 256).when(n % 19 == 0, 1024).when(n % 8 == 0, 2048).otherwise(0)
    return v.reads(spark, sf_dir).withColumns({"flag": flag, "has_sa": n % 8 == 4})


def noise(spark, sf_dir):
    """Noise of the 200-base patches of five contigs."""
    patches = spark.range(5).select(F.concat(F.lit("ctg"), F.col("id").cast("string")).alias("contig"), F.explode(F.sequence(lit(0), lit(109))).alias("k"))
    patches = patches.select("contig", (F.col("k") * 200).alias("pos"), (F.col("k") * 200 + 200).alias("end_pos"))
    return al.region_evidence(records(spark, sf_dir), patches)


@query(f"with {PATCHES} select * from v_noise")
def sv72_region_evidence(spark, sf_dir):
    return noise(spark, sf_dir)


ALL_SITES = """v_sites as (select concat('ctg', p_partkey % 5) as contig, (p_partkey * 5309) % 2000000 as s, (p_partkey * 5309) % 2000000 + case when p_partkey % 3 = 0 then 1 else p_size * 6 end as e, case when p_partkey % 3 = 0 then 'INS' when p_partkey % 3 = 1 then 'DEL' end as t from part)"""


@query(f"""with {PATCHES}, {ALL_SITES}, w as (select concat('ctg', c.i) as contig, cast(k.i * 2000 as bigint) as window_start, cast(j.i as int) as patch_index from range(0, 5) c(i), range(0, 1001) k(i), range(0, 10) j(i)),
b as materialized (select contig, s, e, t, unnest(case when t = 'INS' then [s // 200] else range(s // 200, (e - 1) // 200 + 1) end) * 200 as pos from v_sites),
h as (select distinct contig, pos - pos % 2000 as window_start, cast(pos % 2000 // 200 as int) as patch_index from b where t = 'INS' or least(pos + 200, e) - greatest(pos, s) >= 50)
select w.contig, w.window_start, w.patch_index, cast(case when h.contig is not null or n.noisy then 1 else 0 end as int) as label from w left join h on h.contig = w.contig and h.window_start = w.window_start and h.patch_index = w.patch_index left join v_noise n on n.contig = w.contig and n.pos = w.window_start + w.patch_index * 200 and n.noisy""")
def sv73_label_all_patches(spark, sf_dir):
    """All parts as sites, on contigs so long that both labels occur; deletions and other types reach the overlap of 50."""
    windows = spark.range(5).select(F.concat(F.lit("ctg"), F.col("id").cast("string")).alias("contig"), F.explode(F.sequence(lit(0), lit(1000))).alias("k")).select("contig", (F.col("k") * 2000).alias("window_start"))
    sites = v.table(spark, sf_dir, "part").selectExpr("concat('ctg', cast(p_partkey % 5 as string)) as contig", "(p_partkey * 5309) % 2000000 as start_pos", "(p_partkey * 5309) % 2000000 + case when p_partkey % 3 = 0 then 1 else p_size * 6 end as end_pos", "case when p_partkey % 3 = 0 then 'INS' when p_partkey % 3 = 1 then 'DEL' end as sv_type")
    return lb.patch_labels(windows, sites, noise(spark, sf_dir).where("noisy"), "contig", 2000, 200, 50)


RECORD = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"
SEGMENTS = f"""v_seg as (select l_orderkey as read_id, concat('ctg', l_suppkey % 2) as contig, {RECORD} as record_no, l_partkey * 10 as r_start,
 cast(l_partkey * 10 + floor(l_quantity) as bigint) as r_end, cast(l_suppkey * 3 as bigint) as q_start, cast(l_suppkey * 3 + floor(l_quantity) as bigint) as q_end, l_returnflag <> 'R' as forward from lineitem),
v_next as (select *, count(*) over (partition by read_id, contig) as n, lead(contig) over w as nc, lead(r_start) over w as nr, lead(q_start) over w as nq, lead(forward) over w as nf
 from v_seg window w as (partition by read_id order by record_no)),
v_dist as (select *, (nr - r_end) - (nq - q_end) as distance from v_next where n = 2 and forward = nf and contig = nc and r_end - nr < 30)"""


def segments(spark, sf_dir):
    return v.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as read_id",
        "concat('ctg', cast(l_suppkey % 2 as string)) as contig",
        f"{RECORD} as record_no",
        "l_partkey * 10 as r_start",
        "l_partkey * 10 + cast(floor(l_quantity) as bigint) as r_end",
        "l_suppkey * 3 as q_start",
        "l_suppkey * 3 + cast(floor(l_quantity) as bigint) as q_end",
        "l_returnflag <> 'R' as forward",
    )


@query(f"with {SEGMENTS} select read_id, contig, r_end as pos, distance as size, 'DEL' as kind from v_dist where distance between 30 and 100000 union all select read_id, contig, cast(floor((r_end + nr) / 2.0::double) as bigint), -distance, 'INS' from v_dist where distance between -100000 and -30")
def sv75_split_read_signatures(spark, sf_dir):
    return al.split_signatures(segments(spark, sf_dir))


INTRA = v.CIGARS + """, v_in as (select *, ref_start + sum(case when op in (0,1,4,7,8) then len else 0 end) over (partition by read_id) as span_end, ref_start + coalesce(sum(case when op in (0,2) then len else 0 end) over (partition by read_id order by idx rows between unbounded preceding and 1 preceding), 0) as first_ from v_cigar),
v_var as (select p_partkey as variant_id, concat('ctg', p_partkey % 5) as contig, (p_partkey * 53) % 20000 - 50 as lo, (p_partkey * 53) % 20000 + p_size + 50 as hi from part),
v_sigs as (select variant_id, read_id, cast(first_ as bigint) as s, cast(first_ + len as bigint) as e, lo, hi from v_in join v_var on v_in.contig = v_var.contig and greatest(first_, lo) <= least(first_ + len, hi) and greatest(ref_start, lo + 50) <= least(span_end, hi - 50) where op = 2)"""


def sites(spark, sf_dir):
    return v.table(spark, sf_dir, "part").selectExpr("p_partkey as variant_id", "concat('ctg', cast(p_partkey % 5 as string)) as contig", "(p_partkey * 53) % 20000 as start_pos", "(p_partkey * 53) % 20000 + p_size as end_pos")


def intra(spark, sf_dir):
    """Deletions within reads at each variant."""
    return al.variant_signatures(al.intra_steps(v.reads(spark, sf_dir), "DEL"), sites(spark, sf_dir), False).drop("inter")


@query(f"with {INTRA} select variant_id, read_id, s, e from v_sigs")
def sv76_intra_signatures(spark, sf_dir):
    return intra(spark, sf_dir).drop("lo", "hi")


@query(f"""with {INTRA}, b as (select variant_id, read_id, case when read_id % 3 = 0 then 2 else 1 end as bit, greatest(s, lo) as x, least(e, hi) as y from v_sigs), p as (select variant_id, read_id, bit, cast(unnest(range(x, y)) as bigint) as pos from b where x < y),
c as (select variant_id, read_id, pos, bit_or(bit) as code from p group by 1, 2, 3) select variant_id, pos, count(*) filter (where code = 1) as intra, 2 * count(*) filter (where code = 2) as inter from c group by 1, 2""")
def sv77_signature_matrix(spark, sf_dir):
    rows = al.intra_steps(v.reads(spark, sf_dir), "DEL").withColumn("inter", F.col("read_id") % 3 == 0)
    return al.signature_columns(rows, sites(spark, sf_dir))


BOTH = SEGMENTS + ", " + INTRA + """, v_split as (select read_id, contig, r_end as s, r_end + distance as e from v_dist where distance between 30 and 100000),
v_inter as (select variant_id, read_id, cast(s as bigint) as s, cast(e as bigint) as e, lo, hi from v_split join v_var on v_split.contig = v_var.contig and greatest(s, lo) <= least(e, hi)),
v_both as (select *, false as inter from v_sigs union all select *, true from v_inter), v_px as (select variant_id, read_id, case when inter then 2 else 1 end as bit, cast(unnest(range(greatest(s, lo), least(e, hi))) as bigint) as pos from v_both where greatest(s, lo) < least(e, hi)),
v_code as (select variant_id, read_id, pos, bit_or(bit) as code from v_px group by 1, 2, 3)"""


def both(spark, sf_dir, var=None):
    """Deletions within reads and between the records of split reads, at each variant."""
    var = sites(spark, sf_dir) if var is None else var
    dels = al.variant_signatures(al.intra_steps(v.reads(spark, sf_dir), "DEL"), var, False)
    return dels.unionByName(al.inter_signatures(segments(spark, sf_dir), var, "DEL"))


@query(f"with {BOTH} select variant_id, read_id, s, e from v_inter")
def sv77_inter_signatures(spark, sf_dir):
    return both(spark, sf_dir).where("inter").select("variant_id", "read_id", "s", "e")


@query(f"with {BOTH} select variant_id, pos, count(*) filter (where code = 1) as intra, 2 * count(*) filter (where code = 2) as inter from v_code group by 1, 2")
def sv77_split_read_matrix(spark, sf_dir):
    dels = al.intra_steps(v.reads(spark, sf_dir), "DEL").withColumn("inter", F.lit(False))
    split = al.split_places(segments(spark, sf_dir), "DEL").withColumn("inter", F.lit(True))
    return al.signature_columns(dels.unionByName(split, allowMissingColumns=True), sites(spark, sf_dir))


def centred_sql(height: int, width: int) -> str:
    return f"""with {BOTH}, v_first as (select variant_id, read_id, min((case when inter then 1 else 0 end) * 1000000000 + s) as f, min(lo) as lo, min(hi) as hi from v_both group by 1, 2),
v_row as (select *, row_number() over (partition by variant_id order by f, read_id) - 1 as r, {height} - count(*) over (partition by variant_id) as dh, {width} - (hi - lo) as dw from v_first),
v_put as (select variant_id, cast(r + trunc(dh / 2.0::double) as bigint) as "row", cast(pos - lo + trunc(dw / 2.0::double) as bigint) as col, cast(code as int) as code from v_code join v_row using (variant_id, read_id))
select * from v_put where "row" between 0 and {height - 1} and col between 0 and {width - 1}"""


SMALL = (4, 121)


@query(centred_sql(*SMALL))
def sv77_centred_matrix(spark, sf_dir):
    """Padded and cropped to a small size, so that both happen. Variants of one place have one matrix, made once."""
    of = ["contig", "start_pos", "end_pos"]
    places = iv.gathered(sites(spark, sf_dir).distinct(), of).withColumn("place", F.struct(*of, F.array_min("members").alias("first")))
    matrices = al.centred_matrix(both(spark, sf_dir, places.select(*of, F.col("place").alias("variant_id"))), *SMALL)
    rows = matrices.join(places.select(F.col("place").alias("variant_id"), "members").hint("merge"), "variant_id")
    return rows.select("row", "col", "code", F.inline("members")).select("variant_id", "row", "col", "code")
