"""Rules of the operators on rows written by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.functions import dna
from svloom.operators import aligner as ar, alignment as al, assignment as an, evidence as ev, haplotypes as hp, intervals as iv, labels as lb, scoring as sc, variants as vs
from svloom.sources import fasta, vcf


def test_vcf_text(spark, tmp_path):
    lines = ["##x", "#CHROM", "chr1\t11\t.\tNA\tN\t.\tPASS\tEND=30\tGT\t0/1", "chr1\t21\tv\tN\t<dup>\t.\tPASS\tSVTYPE=del;END=25\tGT\t./1", "chr1\t31\t.\tN\t<INS>\t.\tPASS\t.\tGT\t1|1", "chr1\t41\t.\tN\t<A>,<B>\t.\tPASS\t.\tDP:GT\t3:0/0"]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    rows = vcf.read_vcf(spark, str(tmp_path / "a.vcf")).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.sv_type, r.gt) for r in rows] == [(10, 30, "DEL", "0/1"), (20, 25, "DEL", "./1"), (30, 31, "INS", "1|1"), (40, 41, None, "0/0")]
    kept = vs.drop_reference_genotypes(vcf.read_vcf(spark, str(tmp_path / "a.vcf")).withColumn("tokens", vs.tokenize_genotype(F.col("gt"))))
    assert sorted("".join(r.tokens) for r in kept.collect()) == ["0/1", "0/1", "1|1"]
    vcf.write_vcf(vcf.read_vcf(spark, str(tmp_path / "a.vcf")), str(tmp_path / "out"), ["chrom", "start_pos"])
    again = vcf.read_vcf(spark, str(tmp_path / "out"))
    assert sorted((r.start_pos, r.end_pos, r.sv_type or "") for r in again.collect()) == sorted((r.start_pos, r.end_pos, r.sv_type or "") for r in rows)


def test_gap_is_strict_and_islands_touch(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 110, 120), ("a", 219, 230), ("b", 225, 230)], "chrom string, start_pos long, end_pos long")
    assert [r.cluster for r in iv.gap_clusters(rows, 100, ["start_pos"]).orderBy("chrom", "start_pos").collect()] == [1, 2, 2, 1]
    touching = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("a", 5, 5)], "chrom string, start_pos long, end_pos long")
    assert sorted((r.start_pos, r.end_pos) for r in iv.merge(touching, ["chrom"], 0, F.lit(1000).cast("long")).collect()) == [(0, 20), (21, 30)]


def test_merged_intervals_are_disjoint_and_windows_focus(spark):
    short = spark.createDataFrame([(0, 10, 100)], "group_start long, group_end long, length long")
    assert iv.window_starts(short, 2000, 500).count() == 0
    long_ = spark.createDataFrame([(5000, 8000, 20000)], "group_start long, group_end long, length long")
    assert [r.window_start for r in iv.window_starts(long_, 2000, 500).orderBy("window_start").collect()] == [4000, 4500, 5000, 5500, 6000, 6500, 7000]
    windows = spark.createDataFrame([("c", 1000)], "k string, window_start long")
    sites = spark.createDataFrame([("c", 1000, 1001, "first"), ("c", 1400, 1401, "third"), ("c", 1390, 1410, "two")], "k string, start_pos long, end_pos long, sv_id string")
    got = {(r.sv_id, r.subwindow_index) for r in iv.focus(windows, sites, "k", 2000, 200).collect()}
    assert got == {("first", 0), ("third", 1), ("third", 2), ("two", 1), ("two", 2)}


def test_overlap_join_equals_plain_predicate(spark):
    left = spark.createDataFrame([("a", i * 7 % 90, i * 7 % 90 + i % 40) for i in range(60)], "k string, l_start long, l_end long")
    right = spark.createDataFrame([("a", i * 11 % 100, i * 11 % 100 + i % 25) for i in range(50)], "k string, r_start long, r_end long")
    plain = left.join(right, "k").where("l_start < r_end and l_end > r_start and l_start < l_end and r_start < r_end")
    for size in (1, 16, 1000):
        assert sorted(iv.overlap_join(left, right, "k", size).collect()) == sorted(plain.collect())


def test_dna(spark):
    row = spark.createDataFrame([("AACCCG", "AAAAAAAAAAAAAAAAACGTA", "ACGTACGATTACAGATTACAC")], "a string, b string, c string").select(dna.compress(F.col("a")), dna.longest_run(F.col("a")), dna.low_complexity(F.col("b")), dna.low_complexity(F.col("c")), dna.canonical(F.col("c")) == dna.canonical(dna.reverse_complement(F.col("c"))), F.size(dna.kmers(F.col("a"), 7)), F.size(dna.kmers(F.col("a"), 6))).first()
    assert tuple(row) == ("ACG", 3, True, False, True, 0, 1)


def test_fasta_file(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x y\nacgt\nAC\n>two\n\n>three\nGG\n")
    assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("one", "ACGTAC"), ("three", "GG"), ("two", "")]


def test_combinations_guard_touching_and_overflow(spark):
    sites = spark.createDataFrame([("a", 1, 0, 10, 1, 0, 1, False), ("a", 1, 10, 20, 2, 1, 1, False)] + [("b", 1, i, i + 1, i, 0, 1, False) for i in range(900)], "chrom string, cluster int, start_pos long, end_pos long, event_id long, a1 int, a2 int, phased boolean")
    rows = hp.combinations(hp.guarded(sites))
    assert rows.count() == 6 and hp.without_overlaps(rows).count() == 6
    assert [r.states for r in hp.haplotype_set(hp.without_overlaps(rows)).orderBy("hap").collect()] == [[0, 0], [0, 1], [1, 0], [1, 1]]
    clash = sites.withColumn("start_pos", F.when(F.col("event_id") == 2, 9).otherwise(F.col("start_pos"))).where("chrom = 'a'")
    assert [1, 1] not in [r.states for r in hp.haplotype_set(hp.without_overlaps(hp.combinations(hp.guarded(clash)))).collect()]


def test_projection_inside_an_edited_block(spark):
    row = spark.range(1).select(F.expr("array(named_struct('start_pos', 10L, 'end_pos', 20L, 'alt', 'AC'), named_struct('start_pos', 12L, 'end_pos', 15L, 'alt', 'T'), named_struct('start_pos', 30L, 'end_pos', 31L, 'alt', 'GGGG'))").alias("sites"), F.array(F.lit(1), F.lit(0), F.lit(0)).alias("states"))
    got = row.select(hp.projected_intervals(F.col("sites"), F.col("states"), F.lit(100).cast("long"))).first()[0]
    assert [(x.start, x.end) for x in got] == [(10, 12), (10, 12), (22, 23)]


def test_pairs_of_h_haplotypes(spark):
    haps = spark.createDataFrame([("c", i, f"H{i}", [0]) for i in range(1, 8)], "cluster string, hap int, hap_id string, states array<int>")
    assert hp.pairs(haps).count() == 28 and ev.bypass(hp.pairs(haps), 30).count() == 28 and ev.bypass(hp.pairs(haps), 27).count() == 0


def test_evidence_minimum_and_reads_without_support(spark):
    votes = spark.createDataFrame([(0, r, s, st, k) for r, k, s, st in [(1, "a", 0, 1), (1, "b", 0, 1), (2, "c", 0, 0)]], "cluster int, read_id int, sv int, st int, kmer string")
    index = ev.kmer_index(votes)
    assert [r.read_id for r in ev.read_evidence(votes, index, 2).collect()] == [1]
    states = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 1)], "cluster int, hap int, sv int, state int")
    rows = {(r.read_id, r.hap1, r.hap2): (r.best, r.unexplained_absent) for r in ev.pair_reads(ev.read_evidence(votes, index, 1), states).collect()}
    assert rows == {(1, 1, 2): (4, 0), (1, 2, 2): (4, 0), (2, 1, 1): (1, 0), (2, 1, 2): (1, 0)}


def test_ties_balance_in_read_order(spark, tmp_path):
    rows = spark.createDataFrame([("p", r, a, b) for r, a, b in [("1", 5, 5), ("2", 5, 5), ("3", 9, 5), ("4", None, None), ("5", 1, 1), ("6", None, 2)]], "pair_id string, read_id string, score1 long, score2 long")
    r = an.assignment_counts(an.assigned_reads(rows, str(tmp_path / "reads"))).first()
    assert (r.n1, r.n2, r.hap1_better, r.score_ties, r.only_hap2, r.neither_aligned) == (2, 3, 1, 3, 1, 1) and r.n1 + r.n2 + r.neither_aligned == 6


def test_reads_align_with_gaps_on_both_strands(spark):
    rng = np.random.default_rng(5)
    dna_of = lambda n: "".join(rng.choice(list("ACGT"), n))
    target = dna_of(900)
    read = target[50:350] + target[380:600] + dna_of(25) + target[600:850]
    for forward in (True, False):
        x = read if forward else read.encode().translate(ar.COMPLEMENT)[::-1].decode()
        score, strand, start, end, cigar, aligned, mismatches, nm = ar.align(x, target)
        assert strand == forward and aligned >= 765 and sum(n for o, n in cigar if o != 2) == len(read) and sum(n for o, n in cigar if o in (0, 2)) == end - start
        assert {(o, n) for o, n in cigar if o in (1, 2)} == {(2, 30), (1, 25)} and nm == 55 + mismatches and score == 2 * (aligned - mismatches) - 4 * mismatches - 2 * 8 - 55
    assert ar.align("A" * 30, "C" * 30) is None and ar.align("", target) is None

    def best(a, b):
        top, h, e = 0, [0] * (len(b) + 1), [-(10**6)] * (len(b) + 1)
        for x in a:
            slant, f, h[0] = h[0], -(10**6), 0
            for j, y in enumerate(b, 1):
                e[j] = max(e[j] - 1, h[j] - 9)
                f = max(f - 1, h[j - 1] - 9)
                slant, h[j] = h[j], max(0, e[j], f, slant + (2 if x == y else -4))
                top = max(top, h[j])
        return top

    for _ in range(12):
        target = dna_of(300)
        read = "".join("" if p < 0.01 else c + dna_of(2) if p < 0.02 else dna_of(1) if p < 0.05 else c for c, p in zip(target[20:280], rng.random(260)))
        score, _, start, end, cigar, aligned, mismatches, nm = ar.align(read, target)
        gaps = [n for o, n in cigar if o in (1, 2)]
        assert score == best(read, target) == 2 * (aligned - mismatches) - 4 * mismatches - 8 * len(gaps) - sum(gaps) and nm == mismatches + sum(gaps)
    reads = spark.createDataFrame([(1, "a", read), (1, "b", "CCCC"), (1, "c", None)], "cluster int, read_id string, seq string")
    rows = ar.align_reads(reads, spark.createDataFrame([(1, "h", target)], "cluster int, hap_id string, seq string")).collect()
    assert [(r.read_id, r.score, r.forward, [tuple(x) for x in r.cigar], r.nm) for r in rows] == [("a", score, True, cigar, nm)]


def test_each_read_has_its_side(spark, tmp_path):
    scores = [("1", 5, 5), ("2", 5, 5), ("3", 9, 5), ("4", None, None), ("5", 1, 1), ("6", None, 2), ("7", 3, 3)]
    rows = spark.createDataFrame([(p, r, a, b) for p in "pq" for r, a, b in scores], "pair_id string, read_id string, score1 long, score2 long")
    got = an.assigned_reads(rows, str(tmp_path / "reads")).orderBy("pair_id", "read_id").collect()
    assert [(r.pair_id, r.read_id, r.score1, r.score2, r.side) for r in got] == [(p, *s, side) for p in "pq" for s, side in zip(scores, [1, 2, 1, None, 2, 2, 1])]


def test_cigar_and_md_rules(spark):
    reads = spark.createDataFrame([(1, "c", 100, [(5, 3), (0, 10), (1, 4), (2, 5), (7, 10), (4, 6)])], "read_id int, contig string, ref_start long, cigar array<struct<op:int,len:long>>")
    steps = al.explode_steps(reads)
    assert [(r.op, r.rp, r.qp) for r in steps.orderBy("idx").collect()] == [(5, 100, 0), (0, 100, 3), (1, 110, 13), (2, 110, 17), (7, 115, 17), (4, 125, 27)]
    cut = al.trim(steps, F.lit(108).cast("long"), F.lit(112).cast("long"))
    pile = {r.pos: r for r in al.pileup(cut, ["read_id"]).collect()}
    assert sorted(pile) == [108, 109, 110, 111] and pile[110].deletion_max == 2 and pile[110].insertions == 1 and pile[111].depth == 1
    md = spark.range(1).select(al.parse_md(F.lit("10A0^ACG5"))).first()[0]
    assert [(x.kind, x.len) for x in md] == [("=", 10), ("X", 1), ("=", 0), ("D", 3), ("=", 5)]


def test_mismatches_of_md(spark):
    reads = spark.createDataFrame([(1, 100, "3A0^ACG0T2G", [(0, 4), (2, 3), (0, 4)]), (2, 103, "0C5", [(0, 6)]), (3, 100, None, [(0, 11)])], "read_id int, ref_start long, md string, cigar array<struct<op:int,len:long>>")
    lo, hi = F.lit(103).cast("long"), F.lit(108).cast("long")
    md = al.trim_md(reads.drop("cigar"), lo, hi).withColumn("all", F.lit(1))
    got = [(r.kind, r.cut, r["at"]) for r in md.where("read_id = 1").orderBy("idx").collect()]
    assert got == [("X", 1, 103), ("=", 0, 104), ("D", 3, 104), ("=", 0, 107), ("X", 1, 107)]
    cut = al.trim(al.explode_steps(reads.drop("md")), lo, hi).withColumn("all", F.lit(1))
    pile = {r.pos: (r.mismatches, r.depth, r.deletions) for r in al.pileup(cut, ["all"], md).collect()}
    assert pile == {103: (2, 3, 0), 104: (0, 3, 1), 105: (0, 3, 1), 106: (0, 3, 1), 107: (1, 3, 0)}


def test_moves_of_empty_null_and_long_cigars(spark):
    long = [(k % 3, k % 7) for k in range(40_000)]
    reads = spark.createDataFrame([(1, 5, []), (2, 5, None), (3, 5, long), (4, None, [(0, 3)]), (5, 7, [(2, 4), (0, 1)])], "read_id int, ref_start long, cigar array<struct<op:int,len:long>>")
    got = {}
    for r in al.explode_steps(reads).collect():
        got.setdefault(r.read_id, {})[r.idx] = (r.op, r.len, r.rp, r.qp)
    assert sorted(got) == [3, 4, 5] and got[4] == {1: (0, 3, None, 0)} and got[5] == {1: (2, 4, 7, 0), 2: (0, 1, 11, 0)}
    rp, qp = 5, 0
    for k, (op, n) in enumerate(long):
        assert got[3][k + 1] == (op, n, rp, qp)
        rp, qp = rp + n * (op != 1), qp + n * (op != 2)


def plain_islands(rows, gap):
    out, top, n = {}, None, 0
    for s, e, k in sorted(rows):
        n += top is None or s - top > gap
        top = e if top is None else max(top, e)
        out[k] = n
    return out


def test_islands_numbers_and_gaps_across_ranges(spark):
    width = iv.RANGE
    one = [(0, 10, 1), (width - 5, width + 5, 2), (width + 3, 5 * width, 3), (2 * width, 2 * width + 1, 4), (5 * width + 4, 5 * width + 9, 5), (9 * width, 9 * width + 3, 6), (9 * width, 9 * width + 3, 7)]
    two = [(7, 9, 8), (3 * width, 3 * width + 2, 9)]
    rows = spark.createDataFrame([("a", *r) for r in one] + [(None, *r) for r in two], "chrom string, s long, e long, k long")
    got = {r.k: r.island for r in iv.islands(rows, ["chrom"], ["s", "e", "k"], "s", "e", gap=4).collect()}
    assert got == plain_islands(one, 4) | plain_islands(two, 4)
    named = vs.renumber(rows.withColumn("sv_type", F.lit("DEL")), "s").where("chrom is not null").orderBy("n").collect()
    assert [r.variant_id for r in named] == [f"a.DEL.{n}" for n in range(1, 8)] and [r.s for r in named] == sorted(r[0] for r in one)
    clusters = spark.createDataFrame([("a", 0, 10), ("a", 3 * width, 3 * width + 7), ("a", 3 * width + 9, 8 * width), ("b", 5, 10 * width)], "chrom string, lo long, hi long")
    gaps = iv.complement(clusters, "chrom", F.lit(10 * width).cast("long")).collect()
    assert sorted(map(tuple, gaps)) == [("a", 10, 3 * width), ("a", 3 * width + 7, 3 * width + 9), ("a", 8 * width, 10 * width), ("b", 0, 5)]
    empty = rows.limit(0)
    assert iv.islands(empty, ["chrom"], ["s"], "s", "e").isEmpty() and iv.complement(clusters.limit(0), "chrom", F.lit(1).cast("long")).isEmpty()


def test_pairs_of_many_haplotypes_in_blocks(spark):
    count = ev.BLOCK + 6
    states = spark.createDataFrame([(1, h, sv, (h >> sv) & 1) for h in range(count) for sv in range(7)], "cluster int, hap int, sv int, state int")
    evidence = spark.createDataFrame([(1, 9, 0, 0, 6, 8), (1, 9, 3, 4, 2, 8)], "cluster int, read_id int, sv int, absent long, present long, informative long")
    got = {(r.hap1, r.hap2): (r.best, r.unexplained_present, r.unexplained_absent) for r in ev.pair_reads(evidence, states).collect()}
    own = lambda h: (6 if h & 1 else 0) + (2 if h >> 3 & 1 else 4)
    both = lambda a, b, sv, state: (a >> sv & 1) == state == (b >> sv & 1)
    expected = {}
    for a in range(count):
        for b in range(a, count):
            expected[a, b] = (max(own(a), own(b)), 6 * both(a, b, 0, 0) + 2 * both(a, b, 3, 0), 4 * both(a, b, 3, 1))
    assert got == expected


def test_split_signatures_take_neighbours_among_all_records(spark):
    rows = spark.createDataFrame([(1, "chr1", 1, 0, 50, 0, 50, True), (1, "chr2", 2, 0, 50, 50, 90, True), (1, "chr1", 3, 500, 600, 50, 100, True), (2, "chr1", 1, 0, 50, 0, 50, True), (2, "chr1", 2, 500, 600, 50, 100, True)], "read_id long, contig string, record_no long, r_start long, r_end long, q_start long, q_end long, forward boolean")
    assert [tuple(r) for r in al.split_signatures(rows, "DEL").collect()] == [(2, "chr1", 50, 450)]


def test_kmers_of_long_strings_equal_plain_ones(spark):
    import random

    from svloom.functions import dna
    from svloom.sources import fasta

    rnd = random.Random(2)
    texts = ["", "A", "ACGT" * 5, None] + ["".join(rnd.choice("ACGTN") for _ in range(n)) for n in (20, 21, 22, 255, 256, 257, 275, 276, 277, 511, 512, 513, 5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_id int, seq string")
    for k in (1, 2, 21, 300):
        got = sorted((r.seq_id, r.kmer) for r in dna.kmer_rows(rows, "seq", k).collect())
        assert got == sorted((i, t[j : j + k]) for i, t in enumerate(texts) if t for j in range(len(t) - k + 1))
        back = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
        both = sorted((r.seq_id, r.kmer) for r in dna.kmer_rows(rows, "seq", k, strands=True).collect())
        assert both == sorted((i, min(x, back(x))) for i, x in got)
    chunks = {(r.contig, r.chunk): r.piece for r in fasta.to_chunks(rows.selectExpr("cast(seq_id as string) as contig", "seq"), 100).collect()}
    assert chunks == {(str(i), j // 100): t[j : j + 100] for i, t in enumerate(texts) if t for j in range(0, len(t), 100)}


def test_split_signatures_need_two_records(spark):
    seg = [(1, "c", 1, 0, 100, 0, 100, True), (1, "c", 2, 200, 300, 100, 200, True), (2, "c", 1, 0, 100, 0, 100, True), (2, "c", 2, 200, 300, 100, 200, True), (2, "c", 3, 500, 600, 200, 300, True)]
    rows = spark.createDataFrame(seg, "read_id int, contig string, record_no int, r_start long, r_end long, q_start long, q_end long, forward boolean")
    assert [tuple(r) for r in al.split_signatures(rows, "DEL").collect()] == [(1, "c", 100, 100)]
    assert al.split_signatures(rows, "INS").count() == 0


def test_split_reads_reach_the_matrix(spark):
    seg = [(1, "c", 1, 0, 100, 0, 100, True), (1, "c", 2, 200, 300, 100, 200, True)]
    segments = spark.createDataFrame(seg, "read_id int, contig string, record_no int, r_start long, r_end long, q_start long, q_end long, forward boolean")
    var = spark.createDataFrame([(7, "c", 250, 260), (8, "c", 251, 260), (9, "d", 120, 130)], "variant_id int, contig string, start_pos long, end_pos long")
    inter = al.inter_signatures(segments, var, "DEL")
    assert [tuple(r) for r in inter.collect()] == [(7, 1, 100, 200, 200, 310, True)]
    intra = al.variant_signatures(spark.createDataFrame([(1, "c", 205, 208), (2, "c", 203, 206)], "read_id int, contig string, s long, e long"), var.where("variant_id = 7"), False)
    both = intra.unionByName(inter)
    cells = lambda h, w: sorted((r["row"], r["col"], r.code) for r in al.centred_matrix(both, h, w).collect())
    assert cells(5, 113) == [(1, 4, 1), (1, 5, 1), (1, 6, 1), (2, 6, 1), (2, 7, 1), (2, 8, 1)]
    assert cells(1, 103) == [(0, 0, 1), (0, 1, 1), (0, 2, 1)]


def test_strings_of_a_variants_reads(spark):
    strings = spark.createDataFrame([(0, "a", "c", 10, 50), (1, "a", "c", 10, 49), (2, "a", "d", 90, 120), (3, "b", "c", 100, 110), (4, "a", "c", 160, 170)], "line_no int, read_id string, contig string, start_pos long, end_pos long")
    var = spark.createDataFrame([(1, "c", 100, 110)], "variant_id int, contig string, start_pos long, end_pos long")
    reads = spark.createDataFrame([(1, "a"), (1, "a")], "variant_id int, read_id string")
    assert sorted(map(tuple, lb.gather_sfs(strings, var, reads).collect())) == [(1, "a", "c", 10, 50), (1, "a", "c", 160, 170)]


def test_gates_and_metrics(spark):
    rows = spark.createDataFrame([("x.INS.1", 1, 0.61), ("x.INS.1", 1, 0.6), ("x.DEL.1", 0, 0.95), ("x.DUP.1", 0, 1.0), ("x.DUP.1", 1, 1.0)], "sv string, s int, p double")
    got = rows.select(sc.gate_rescue(F.col("s"), F.col("p"), F.col("sv"), 0.6, 0.7, 0.9, 0.95).alias("g")).collect()
    assert [r.g for r in got] == [0, 1, 1, 1, 1]
    zero = spark.createDataFrame([([0, 0], [0, 0])], "prediction array<int>, label array<int>")
    assert tuple(sc.epoch_metrics(zero).first()) == (0.0,) * 6 + (1.0, 1.0)


def test_window_model_is_the_cnn_transformer(spark):
    rng, model = np.random.default_rng(3), sc.WindowModel.seeded(1)
    w = {k: rng.normal(1 if "normalization" in k and "weight" in k else 0, 0.1, a.shape) for k, a in model.weights.items()}
    x = rng.normal(0, 1, (sc.POSITIONS, sc.CHANNELS))

    def linear(v, name):
        return np.array([sum(a * b for a, b in zip(row, v)) + c for row, c in zip(w[name + ".weight"], w[name + ".bias"])])

    def norm(v, name):
        return (v - v.mean()) / (v.var() + 1e-5) ** 0.5 * w[name + ".weight"] + w[name + ".bias"]

    def encode(part):
        seq = [w["encoder.layers.0.weight"].reshape(128, 9) @ row + w["encoder.layers.0.bias"] for row in part]
        for layer in ("pool", 2, "pool", "relu", 5, "pool", 7, "pool", "relu", 10, "pool", 12, "pool", 14):
            if layer == "pool":
                seq = [np.maximum(a, b) for a, b in zip(seq[::2], seq[1::2])]
            elif layer == "relu":
                seq = [np.maximum(a, 0) for a in seq]
            else:
                kernel = w[f"encoder.layers.{layer}.weight"]
                seq = [np.einsum("oik,ki->o", kernel[..., 0], np.array(seq[i : i + kernel.shape[2]])) + w[f"encoder.layers.{layer}.bias"] for i in range(len(seq) - kernel.shape[2] + 1)]
        assert len(seq) == 1
        return seq[0]

    def gelu(v):
        return np.array([a * 0.5 * (1 + math.erf(a / 2**0.5)) for a in v])

    seq = [linear(encode(x[i * 200 : i * 200 + 200]), "patch_projection") + w["position_embedding"][0, i] for i in range(10)]
    for b in range(3):
        at = f"transformer_blocks.{b}."
        q, k, v = ([linear(norm(s, at + "layer_normalization_1"), f"{at}attention.{p}_projection") for s in seq] for p in ("query", "key", "value"))
        for i, s in enumerate(list(seq)):
            heads = []
            for h in range(0, 128, 32):
                e = np.exp([q[i][h : h + 32] @ k[j][h : h + 32] / 32**0.5 for j in range(10)])
                heads += list(sum(a * v[j][h : h + 32] for j, a in enumerate(e / e.sum())))
            s = s + linear(heads, at + "attention.output_projection")
            seq[i] = s + gelu(linear(gelu(linear(norm(s, at + "layer_normalization_2"), at + "feed_forward_network.0")), at + "feed_forward_network.3"))
    relu = lambda v: np.maximum(v, 0)
    logits = [linear(relu(linear(relu(linear(norm(s, "sequence_normalization"), "classifier.0")), "classifier.3")), "classifier.6")[0] for s in seq]
    assert sc.WindowModel(w).predict(x[None])[0] == pytest.approx(1 / (1 + np.exp(-np.array(logits))), abs=1e-12)
    with pytest.raises(ValueError, match="classifier.6.bias"):
        sc.WindowModel({k: a for k, a in w.items() if k != "classifier.6.bias"})
    short = spark.range(1).select("id", F.array_repeat(F.lit(0.5), 180).alias("features"))
    with pytest.raises(Exception, match="2000 positions"):
        sc.model_scores(short, model, "id", "features").collect()


def test_patches_of_wide_sites(spark, sf):
    from svloom.plans.alignment_queries import sv73_label_all_patches

    label = {(r.contig, r.window_start, r.patch_index): r.label for r in sv73_label_all_patches(spark, sf).where("window_start > 30000").collect()}
    seen = set()
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        start = r.p_partkey * 5309 % 2_000_000
        end, first = start + r.p_size * 6, start // 200
        if r.p_partkey % 3 and start > 40_000 and min(first * 200 + 200, end) - start >= 50:
            seen.add((f"ctg{r.p_partkey % 5}", first // 10 * 2000, first % 10))
    assert seen and all(label[x] == 1 for x in seen) and set(label.values()) == {0, 1}


def test_labels(spark):
    lines = spark.createDataFrame([("d/a.npy\t0,1,0,0,0,0,0,0,0,0",), ("e/a.npy\t0,1,0,0,0,0,0,0,0,0",), ("",)], "value string")
    assert lb.parse_label_lines(lines).count() == 1
    clash = lines.unionAll(spark.createDataFrame([("a.npy\t1,1,0,0,0,0,0,0,0,0",)], "value string"))
    with pytest.raises(Exception, match="conflicting"):
        lb.parse_label_lines(clash).collect()
    sfs = spark.createDataFrame([(0, 0, "r1\t(0, 5)\t('c', 3, 9)\t('c', 0, 4)"), (0, 1, "*\t(0, 5)\t('d', 7, 8)"), (0, 2, "r2\t(1, 2)")], "block int, line_no int, text string")
    assert sorted(map(tuple, lb.parse_sfs(sfs).collect())) == [(0, "r1", "c", 3, 9), (1, "r1", "d", 7, 8)]


def test_streaming_sessions(spark, tmp_path):
    from svloom.streaming import sessions

    rows = spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:05'), ('a', timestamp'2024-01-01 00:01:00'), ('b', timestamp'2024-01-01 01:00:00') t(k, ts)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sessions.session_clusters(stream, "ts", "k", "10 seconds", "1 minute").writeStream.outputMode("append").format("memory").queryName("got").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.members) for r in spark.table("got").collect()) == [("a", 1), ("a", 2)]


def test_the_best_pairs_sites_are_checked(spark):
    ranked = spark.createDataFrame([("c", 2, "a__b", "a", "b"), ("c", 1, "a__a", "a", "a"), ("d", 1, "a__b", "a", "b")], "cluster string, rank int, pair_id string, hap1_id string, hap2_id string")
    haps = [("c", "a", "x.INS.1", 1), ("d", "a", "x.INS.1", 1), ("d", "b", "x.INS.1", 0), ("d", "b", "x.DEL.1", 0), ("d", "a", "x.DEL.1", 0)]
    scores = [(c, h, s, 0.5) for c, h, s, _ in haps]

    def sites(haps, scores):
        return sorted(tuple(r) for r in sc.best_pair_sites(ranked, spark.createDataFrame(haps, "cluster string, hap_id string, sv_id string, state int"), spark.createDataFrame(scores, "cluster string, hap_id string, sv_id string, score double")).select("cluster", "pair_id", "sv_id", "state1", "state2", "score2").collect())

    assert sites(haps, scores) == [("c", "a__a", "x.INS.1", 1, 1, 0.5), ("d", "a__b", "x.DEL.1", 0, 0, 0.5), ("d", "a__b", "x.INS.1", 1, 0, 0.5)]
    for h, s, message in ((haps[:-1], scores, "different sites"), (haps, scores[:-1], "score is missing"), (haps[1:], scores, "unknown haplotypes")):
        with pytest.raises(Exception, match=message):
            sites(h, s)


def test_repeats_seed_nothing():
    repeat, other = b"A" * 100_000, b"ACGTTGCATGCCAGTACGAT"
    seeds = ar._segments(other + repeat + other[::-1], other + repeat[: 50_000] + other[::-1])
    assert len(seeds) < 1000 and (seeds[:, 0] < len(other)).any() and (seeds[:, 0] >= 100_000).any()
