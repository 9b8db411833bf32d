"""Queries on variants and intervals (OP-01 to OP-11, 31, 33, 50 to 52, 67 to 71, 74)."""

from __future__ import annotations

from pyspark.sql import functions as F

from svloom.operators import intervals as iv, labels as lb, variants as vs
from svloom.plans import views as v
from svloom.plans.registry import query
from svloom.sources import storage, vcf_sink

#: Flank of clusters, windows and their stride and subwindows, merge distance, distance of label clusters.
FLANK, WINDOW, STRIDE, SUB, MERGE, LABEL_GAP = 5000, 2000, 500, 200, 1800, 2000
#: All variants lie on contigs of this length in the views.
LENGTH = 40_000_000


def vcf_text(spark, sf_dir):
    """The variants as lines of a VCF text, in which an event's ALT is written out for INS and symbolic else."""
    rows = v.variants(spark, sf_dir)
    alt = F.when(F.col("sv_type") == "INS", F.lit("NACGT")).when(F.col("sv_type").isNull(), "N,NA").otherwise(F.concat(F.lit("<"), F.col("sv_type"), F.lit(">")))
    info = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SVTYPE="), F.lower("sv_type"), F.lit(";"))).otherwise(""), F.lit("END="), F.col("end_pos").cast("string"))
    info = F.coalesce(info, F.concat(F.lit("END="), F.col("end_pos").cast("string")))
    gt = F.concat(F.when(F.col("event_id") % 7 == 0, ".").otherwise(F.col("a1").cast("string")), F.when(F.col("phased"), "|").otherwise("/"), F.col("a2").cast("string"))
    line = F.concat_ws("\t", "chrom", (F.col("start_pos") + 1).cast("string"), F.lit("."), F.lit("N"), alt, F.lit("."), F.lit("PASS"), info, F.lit("GT:DP"), F.concat(gt, F.lit(":9")))
    return rows.select(F.col("event_id").alias("line_no"), line.alias("value"))


def indels(spark, sf_dir):
    return v.variants(spark, sf_dir).where(F.col("sv_type").isin("INS", "DEL"))


def clustered(spark, sf_dir):
    return iv.gap_clusters(indels(spark, sf_dir), FLANK, ["start_pos", "event_id"])


CLUSTERED = v.VARIANTS + f""", v_flag as (select *, case when start_pos - max(end_pos) over w < {FLANK} then 0 else 1 end as new from v_variants
 where sv_type in ('INS','DEL') window w as (partition by chrom order by start_pos, event_id rows between unbounded preceding and 1 preceding)),
v_clustered as (select *, cast(sum(new) over (partition by chrom order by start_pos, event_id rows between unbounded preceding and current row) as int) as cluster from v_flag)"""


@query(f"""with {v.VARIANTS} select event_id as line_no, chrom, start_pos, end_pos, '.' as id, 'N' as ref, case when sv_type = 'INS' then 'NACGT' when sv_type is null then 'N,NA' else '<' || sv_type || '>' end as alts,
 sv_type, (case when event_id % 7 = 0 then '.' else cast(a1 as varchar) end) || (case when phased then '|' else '/' end) || a2 as gt from v_variants""")
def sv01_vcf_scan(spark, sf_dir):
    return vs.parse_vcf_lines(vcf_text(spark, sf_dir)).withColumn("alts", F.array_join("alts", ",")).drop("info")


@query(f"""with {v.VARIANTS} select event_id, sv_type, coalesce(sv_type, 'none') as shown from v_variants""")
def sv02_type_infer(spark, sf_dir):
    rows = vs.parse_vcf_lines(vcf_text(spark, sf_dir))
    return rows.select(F.col("line_no").alias("event_id"), "sv_type", F.coalesce("sv_type", F.lit("none")).alias("shown"))


@query(f"""with {v.VARIANTS} select event_id, (case when event_id % 7 = 0 then '.' else cast(a1 as varchar) end) || ' ' || (case when phased then '|' else '/' end) || ' ' || a2 as tokens from v_variants""")
def sv03_gt_tokenize(spark, sf_dir):
    rows = vs.parse_vcf_lines(vcf_text(spark, sf_dir))
    return rows.select(F.col("line_no").alias("event_id"), F.array_join(vs.tokenize_genotype(F.col("gt")), " ").alias("tokens"))


@query(f"""with {v.VARIANTS} select event_id, chrom, start_pos, sv_type from v_variants where sv_type = 'INS'""")
def sv04_filter(spark, sf_dir):
    rows = vs.keep_insertions_deletions(vs.parse_vcf_lines(vcf_text(spark, sf_dir)))
    return rows.select(F.col("line_no").alias("event_id"), "chrom", "start_pos", "sv_type")


@query(f"""with {v.VARIANTS} select event_id, chrom || '.' || sv_type || '.' || row_number() over (partition by chrom, sv_type order by event_id) as variant_id from v_variants where sv_type in ('INS','DEL')""")
def sv05_renumber(spark, sf_dir):
    return vs.renumber(indels(spark, sf_dir), "event_id").select("event_id", "variant_id")


@query(f"""with {v.VARIANTS} select count(*) filter (where sv_type in ('INS','DEL')) as kept, count(*) filter (where sv_type is null or sv_type not in ('INS','DEL')) as skipped from v_variants""")
def sv06_keep_skip_counts(spark, sf_dir):
    return vs.kept_and_skipped(v.variants(spark, sf_dir), F.col("sv_type").isin("INS", "DEL"))


@query(f"""with {v.VARIANTS} select chrom, max(end_pos) + 1000 as length, count(*) as records from v_variants group by 1""")
def sv07_contig_bounds(spark, sf_dir):
    return v.variants(spark, sf_dir).groupBy("chrom").agg((F.max("end_pos") + 1000).alias("length"), F.count(F.lit(1)).alias("records"))


@query(f"""with {v.VARIANTS}, t as (select event_id, case when event_id % 7 = 0 then '.' else cast(a1 as varchar) end as x, phased, a2 from v_variants)
select event_id, (case when x = '.' then '0' else x end) || (case when phased then '|' else '/' end) || a2 as gt from t where not (x = '0' and a2 = 0)""")
def sv09_gt_filter(spark, sf_dir):
    rows = vs.parse_vcf_lines(vcf_text(spark, sf_dir)).withColumn("tokens", vs.tokenize_genotype(F.col("gt")))
    return vs.drop_reference_genotypes(rows).select(F.col("line_no").alias("event_id"), F.array_join("tokens", "").alias("gt"))


@query(f"""with {CLUSTERED} select event_id, chrom, cluster from v_clustered""")
def sv10_gap_cluster(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_id", "chrom", "cluster")


@query(f"""with {CLUSTERED} select chrom, cluster, greatest(0, arg_min(start_pos, (start_pos, event_id)) - {FLANK}) as bound_start, least(max(end_pos) + {FLANK}, {LENGTH}) as bound_end, count(*) as variants from v_clustered group by 1, 2""")
def sv11_cluster_bounds(spark, sf_dir):
    return iv.cluster_bounds(clustered(spark, sf_dir), FLANK, ["start_pos", "event_id"], F.lit(LENGTH).cast("long"))


def islands_sql(source: str, by: str, gap: int) -> str:
    return f"""i_flag as (select *, case when start_pos - max(end_pos) over w <= {gap} then 0 else 1 end as new from {source} window w as (partition by {by} order by start_pos, end_pos rows between unbounded preceding and 1 preceding)),
i_isl as (select *, sum(new) over (partition by {by} order by start_pos, end_pos rows between unbounded preceding and current row) as island from i_flag)"""


@query(f"""with {v.VARIANTS}, w as (select chrom, greatest(0, start_pos - 300) as start_pos, least({LENGTH}, end_pos + 300) as end_pos from v_variants where start_pos < end_pos), {islands_sql('w', 'chrom', 0)}
select chrom, min(start_pos) as start_pos, max(end_pos) as end_pos from i_isl group by chrom, island""")
def sv31_merge_intervals(spark, sf_dir):
    return iv.merge(v.variants(spark, sf_dir), ["chrom"], 300, F.lit(LENGTH).cast("long"))


@query(f"""with {v.CIGARS}, r as (select read_id, contig, ref_start, ref_start + sum(case when op in (0,2,3,7,8) then len else 0 end) as ref_end from v_cigar group by 1,2,3),
t as (select p_partkey as region_id, concat('ctg', p_partkey % 5) as contig, (p_partkey * 53) % 20000 as s, (p_partkey * 53) % 20000 + p_size as e from part)
select read_id, region_id, r.contig, cast(ref_end as bigint) as ref_end from r join t on r.contig = t.contig and ref_start < e and ref_end > s where ref_start < ref_end""")
def sv33_region_overlap_join(spark, sf_dir):
    ends = v.cigars(spark, sf_dir).groupBy("read_id", "contig", "ref_start").agg(F.sum(F.when(F.col("op").isin(0, 2, 3, 7, 8), F.col("len")).otherwise(0)).alias("n"))
    left = ends.select("read_id", "contig", F.col("ref_start").alias("l_start"), (F.col("ref_start") + F.col("n")).alias("l_end"))
    regions = v.table(spark, sf_dir, "part").selectExpr("p_partkey as region_id", "concat('ctg', cast(p_partkey % 5 as string)) as contig", "(p_partkey * 53) % 20000 as r_start", "(p_partkey * 53) % 20000 + p_size as r_end")
    met = iv.overlap_join(left, iv.gathered(regions, ["contig", "r_start", "r_end"]), "contig", 256, cheap=True)
    return met.select("read_id", "contig", F.col("l_end").alias("ref_end"), F.inline("members")).select("read_id", "region_id", "contig", "ref_end")


def groups(spark, sf_dir):
    found = iv.islands(v.variants(spark, sf_dir), ["chrom"], ["start_pos", "end_pos", "event_id"], "start_pos", "end_pos", gap=MERGE)
    return found.groupBy("chrom", "island").agg(F.min("start_pos").alias("group_start"), F.max("end_pos").alias("group_end"), F.count(F.lit(1)).alias("members")).withColumn("length", F.lit(LENGTH).cast("long"))


GROUPS = f"""{v.VARIANTS}, g_flag as (select *, case when start_pos - max(end_pos) over w <= {MERGE} then 0 else 1 end as new from v_variants window w as (partition by chrom order by start_pos, end_pos, event_id rows between unbounded preceding and 1 preceding)),
g_isl as (select *, cast(sum(new) over (partition by chrom order by start_pos, end_pos, event_id rows between unbounded preceding and current row) as int) as island from g_flag),
v_groups as (select chrom, island, min(start_pos) as group_start, max(end_pos) as group_end, count(*) as members from g_isl group by 1, 2)"""
STARTS = f"""{GROUPS}, b as (select *, least(greatest(0, greatest(0, group_start - {WINDOW // 2})), {LENGTH} - {WINDOW}) as f, least(greatest(0, least({LENGTH}, group_end + {WINDOW // 2}) - {WINDOW}), {LENGTH} - {WINDOW}) as l from v_groups),
v_starts as (select distinct chrom, island, unnest(case when group_end - group_start <= {WINDOW} then [least(greatest(0, (group_start + group_end) // 2 - {WINDOW // 2}), {LENGTH} - {WINDOW})] when f < l then list_append(range(f, l, {STRIDE}), l) else [l] end) as window_start from b)"""


@query(f"with {GROUPS} select chrom, island, group_start, group_end, members from v_groups")
def sv50_group_intervals(spark, sf_dir):
    return groups(spark, sf_dir).drop("length")


@query(f"with {STARTS} select chrom, island, cast(window_start as bigint) as window_start from v_starts")
def sv51_window_starts(spark, sf_dir):
    return iv.window_starts(groups(spark, sf_dir), WINDOW, STRIDE).select("chrom", "island", "window_start")


@query(f"""with {STARTS}, w as (select distinct chrom, cast(window_start as bigint) as window_start from v_starts),
h as (select w.chrom, window_start, event_id as sv_id, cast(i as int) as i, end_pos - start_pos = 1 as anchor from w join v_variants x on x.chrom = w.chrom and window_start < end_pos and window_start + {WINDOW} > start_pos, range(0, {WINDOW // SUB}) t(i)
 where window_start + i * {SUB} + {SUB} > start_pos and window_start + i * {SUB} < end_pos)
select chrom, window_start, sv_id, i as subwindow_index from h union select chrom, window_start, sv_id, cast(min(i) - 1 as int) from h where anchor group by 1, 2, 3 having min(i) > 0""")
def sv52_focus_mask(spark, sf_dir):
    windows = iv.window_starts(groups(spark, sf_dir), WINDOW, STRIDE).select("chrom", "window_start").distinct()
    sites = v.variants(spark, sf_dir).select("chrom", "start_pos", "end_pos", F.col("event_id").alias("sv_id"))
    return iv.focus(windows, sites, "chrom", WINDOW, SUB)


@query(f"""with {v.VARIANTS} select chrom || '.' || sv_type || '.' || (event_id % 50) as variant_id, count(distinct a1 || '/' || a2) as genotypes from v_variants where sv_type in ('INS','DEL') group by 1 having count(distinct a1 || '/' || a2) > 1""")
def sv67_conflict_detect(spark, sf_dir):
    rows = indels(spark, sf_dir).select(F.concat_ws(".", "chrom", "sv_type", (F.col("event_id") % 50).cast("string")).alias("variant_id"), F.concat_ws("/", "a1", "a2").alias("final_gt"))
    return vs.conflicts(rows)


@query(f"""with {v.VARIANTS}, d as (select event_id, least(a1, a2) || '/' || greatest(a1, a2) as g from v_variants where sv_type in ('INS','DEL'))
select x.event_id as variant_id, a1 || '/' || a2 as original_gt, coalesce(g, a1 || '/' || a2) as final_gt, case when g is null then 'kept_skipped_or_not_evaluated' when g = '0/0' then 'filtered_absent' else 'kept_present' end as status, g is null or g <> '0/0' as written
from v_variants x left join d on d.event_id = x.event_id""")
def sv68_export_join(spark, sf_dir):
    rows = v.variants(spark, sf_dir).select(F.col("event_id").alias("variant_id"), F.concat_ws("/", "a1", "a2").alias("original_gt"))
    decisions = indels(spark, sf_dir).select(F.col("event_id").alias("variant_id"), F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2")).alias("final_gt"))
    return vs.export(rows, decisions)


def label_clusters(spark, sf_dir):
    return lb.label_clusters(v.variants(spark, sf_dir), LABEL_GAP, ["start_pos", "end_pos", "event_id"], F.lit(LENGTH).cast("long"))


LABELS = f"""{v.VARIANTS}, l_flag as (select *, case when start_pos - max(end_pos) over w < {LABEL_GAP} then 0 else 1 end as new from v_variants window w as (partition by chrom order by start_pos, end_pos, event_id rows between unbounded preceding and 1 preceding)),
l_isl as (select *, cast(sum(new) over (partition by chrom order by start_pos, end_pos, event_id rows between unbounded preceding and current row) as int) as cluster from l_flag),
v_labels as (select chrom, cluster, greatest(0, min(start_pos) - {LABEL_GAP}) as lo, least(max(end_pos) + {LABEL_GAP}, {LENGTH}) as hi, min(start_pos) as first_start, max(end_pos) as last_end, count(*) as members from l_isl group by 1, 2)"""
GAPS = f"""{LABELS}, gw as (select *, lag(hi) over (partition by chrom order by lo, hi) as before, lead(lo) over (partition by chrom order by lo, hi) as after from v_labels),
v_gaps as (select chrom, cast(coalesce(before, 0) as bigint) as gap_start, cast(lo as bigint) as gap_end from gw where before is not null or lo <> 0 union all select chrom, cast(hi as bigint), cast({LENGTH} as bigint) from gw where after is null and hi <> {LENGTH})"""


@query(f"with {LABELS} select chrom, cluster, cast(lo as bigint) as lo, cast(hi as bigint) as hi, members from v_labels")
def sv69_label_clusters(spark, sf_dir):
    return label_clusters(spark, sf_dir).select("chrom", "cluster", "lo", "hi", "members")


@query(f"with {GAPS} select * from v_gaps")
def sv70_complement_intervals(spark, sf_dir):
    return iv.complement(label_clusters(spark, sf_dir), "chrom", F.lit(LENGTH).cast("long"))


def number_sql(seed: int, of: str) -> str:
    """The number of labels._number."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {of})), 1, 8))::bigint & 2147483647)"


SEED, NEGATIVES, JITTER = 7, 50, 50
DRAWN = f"""{GAPS}, r as (select chrom, gap_start, gap_end, gap_end - gap_start - {WINDOW} + 1 as room from v_gaps where gap_end - gap_start >= {WINDOW}),
p as (select *, coalesce(sum(room) over (partition by chrom order by gap_start rows between unbounded preceding and 1 preceding), 0) as before from r),
c as (select chrom, sum(room)::bigint as total, greatest(floor(sum(room) * 0.6180339887::double)::bigint, 1) as first_ from r group by 1),
g as (select chrom, total, coalesce(list_filter(range(first_, first_ + 65), lambda x: gcd(x, total) = 1)[1], 1) as step, {number_sql(SEED, "chrom")} % total as offset_ from c),
d as (select chrom, k, (offset_ + k * step % total) % total as at_ from g, range(0, 100000) t(k) where k < total),
v_drawn as (select d.chrom, k, gap_start, gap_end, cast(gap_start + at_ - before as bigint) as window_start, cast(gap_start + at_ - before + {WINDOW} as bigint) as window_end from d join p on p.chrom = d.chrom and at_ >= before and at_ < before + room)"""


@query(f"with {DRAWN} select * from v_drawn where k < {NEGATIVES}")
def sv71_negative_sampling(spark, sf_dir):
    gaps = iv.complement(label_clusters(spark, sf_dir), "chrom", F.lit(LENGTH).cast("long"))
    return lb.sample_negatives(gaps, "chrom", WINDOW, NEGATIVES, SEED)


@query(f"""with {DRAWN.replace("range(0, 100000)", "range(0, 4000)")}, u as (select chrom, k, gap_start, gap_end, window_start, window_end from v_drawn where {number_sql(1, "window_start")} % 4 = 0)
select * from u qualify row_number() over (partition by chrom order by k) <= {NEGATIVES}""")
def sv71_covered_negatives(spark, sf_dir):
    """Windows of which three in four are rejected, made up for round by round."""
    gaps = iv.complement(label_clusters(spark, sf_dir), "chrom", F.lit(LENGTH).cast("long"))
    kept = lambda windows: windows.where(lb._number(1, "window_start") % 4 == 0)
    return lb.sample_negatives(gaps, "chrom", WINDOW, NEGATIVES, SEED, kept, storage.scratch(spark, "negatives"))


@query(f"""with {LABELS}, m as (select *, greatest(lo, first_start - {WINDOW} + 50) as a, least(hi - {WINDOW}, last_end - 50) as b from v_labels),
s as (select chrom, cluster, unnest(case when b < a then [least(greatest(a, lo), hi - {WINDOW})] else list_append(range(a, b + 1, {STRIDE}), b) end) as s from m)
select distinct chrom, cluster, cast(s as bigint) as window_start from s""")
def sv74_training_windows(spark, sf_dir):
    return lb.training_window_starts(label_clusters(spark, sf_dir), WINDOW, STRIDE, 50)


@query(f"""with {LABELS}, m as (select *, greatest(lo, first_start - {WINDOW} + 50) as a, least(hi - {WINDOW}, last_end - 50) as b from v_labels),
s as (select chrom, cluster, lo, hi, b >= a as several, unnest(case when b < a then [least(greatest(a, lo), hi - {WINDOW})] else list_distinct(list_append(range(a, b + 1, {STRIDE}), b)) end) as s from m)
select chrom, cluster, cast(case when several then least(greatest(s + {number_sql(SEED, "chrom, cluster, s")} % {2 * JITTER + 1} - {JITTER}, lo), hi - {WINDOW}) else s end as bigint) as window_start from s""")
def sv74_jittered_windows(spark, sf_dir):
    return lb.training_window_starts(label_clusters(spark, sf_dir), WINDOW, STRIDE, 50, JITTER, SEED)


@query(f"""with {v.VARIANTS} select event_id // 3 as variant_id, max(event_id) as cluster, (event_id // 3 % 2) || '/1' as final_gt from v_variants group by event_id // 3""")
def sv68_agreed_decisions(spark, sf_dir):
    """Decisions of several clusters on one variant: the last cluster's stays."""
    variant = F.floor(F.col("event_id") / 3)
    return vs.agreed(v.variants(spark, sf_dir).select(variant.alias("variant_id"), F.col("event_id").alias("cluster"), F.concat((variant % 2).cast("string"), F.lit("/1")).alias("final_gt")))


@query(f"""with {v.VARIANTS}, d as (select 'v' || event_id as variant_id, least(a1, a2) || '/' || greatest(a1, a2) as g, event_id % 9 as cluster from v_variants where sv_type in ('INS','DEL') and event_id % 3 <> 0),
t as (select event_id, 'v' || event_id as id, chrom, start_pos, case when event_id % 7 = 0 then '.' else cast(a1 as varchar) end || case when phased then '|' else '/' end || a2 as gt, '.|' || a2 as second from v_variants)
select t.event_id as line_no, id as variant_id, case when g is null then 'kept_skipped_or_not_evaluated' when g = '0/0' then 'filtered_absent' else 'kept_present' end as vcf_status, replace(gt, '|', '/') as original_gt, coalesce(g, replace(gt, '|', '/')) as final_gt, coalesce(cluster::varchar, 'NA') as cluster,
 case when g is null then 'NA' else printf('%.6f', t.event_id / 8.0::double) end as pair_score, case when g is null then '7:' || gt || '	5:' || second when g <> '0/0' then '7:' || g || '	5:' || g end as samples from t left join d on d.variant_id = t.id""")
def sv68_export_lines(spark, sf_dir):
    """The whole way: lines, decisions that two clusters share, an indexed VCF with its header, read back and joined to the audit rows."""
    rows = v.variants(spark, sf_dir)
    name, half = F.concat(F.lit("v"), F.col("event_id").cast("string")), (F.col("event_id") / 8).alias("pair_score")
    gt = F.concat(F.when(F.col("event_id") % 7 == 0, ".").otherwise(F.col("a1").cast("string")), F.when(F.col("phased"), "|").otherwise("/"), F.col("a2").cast("string"))
    line = F.concat_ws("\t", "chrom", (F.col("start_pos") + 1).cast("string"), name, F.lit("N"), F.lit("<X>"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), F.concat(F.lit("7:"), gt), F.concat(F.lit("5:.|"), F.col("a2").cast("string")))
    lines = rows.select(F.col("event_id").alias("line_no"), "chrom", "start_pos", line.alias("value"))
    picked = indels(spark, sf_dir).where("event_id % 3 <> 0")
    decisions = picked.select(name.alias("variant_id"), (F.col("event_id") % 9).alias("cluster"), F.lit("H1__H2").alias("pair"), half, F.lit("0/1").alias("original_pair_gt"), F.concat_ws("/", F.least("a1", "a2"), F.greatest("a1", "a2")).alias("final_gt"), half.alias("hap1_score"), half.alias("hap2_score"), F.lit("unchanged").alias("reason"))
    decisions = decisions.unionByName(decisions.withColumn("cluster", F.lit(-1).cast("long")))
    out = vs.export_lines(lines.select("line_no", "value"), decisions)
    path = storage.scratch(spark, "vcf")
    written = out.where("value is not null").join(lines.select("line_no", "chrom", "start_pos"), "line_no")
    vcf_sink.write_vcf(written, path, "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n", ["chrom", "start_pos", "line_no"])
    part = F.split("value", "\t")
    back = spark.read.text(f"{path}/part-*.vcf.gz").where(~F.startswith("value", F.lit("#"))).select(F.get(part, F.lit(2)).alias("variant_id"), F.array_join(F.slice(part, 10, 2), "\t").alias("samples"))
    return out.join(back, "variant_id", "left").select("line_no", "variant_id", "vcf_status", "original_gt", "final_gt", "cluster", "pair_score", "samples")
