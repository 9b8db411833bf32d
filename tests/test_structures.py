"""Joins, windows, assignments, sums, k-mers and files against plain code."""

import gzip
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from svloom.operators import alignment as al, assignment as an, evidence as ev, intervals as iv, kmers as km, labels as lb, variants as vs, windows as wn
from svloom.sources import bam, bgzf, fasta, indexed_fasta, storage, vcf_sink

READ = "read_id string, flag int, contig string, ref_start long, cigar array<struct<op:int,len:long>>, md string, has_sa boolean"


def intervals(rnd, n, longest):
    out = []
    for i in range(n):
        start = rnd.randrange(0, 100_000)
        out.append((f"{rnd.randrange(2)}", start, start + int(rnd.random() ** 6 * longest), i))
    return out


@pytest.mark.parametrize("block", [None, 3])
def test_overlap_join_of_short_and_long_intervals(spark, block):
    rnd = random.Random(4)
    a, b = intervals(rnd, 150, 300_000), intervals(rnd, 150, 300_000) + [("0", 0, 100_000_000, 900), ("1", 77, 77, 901)]
    left = spark.createDataFrame(a, "k string, l_start long, l_end long, i int")
    right = spark.createDataFrame(b, "k string, r_start long, r_end long, j int")
    got = sorted((r.i, r.j) for r in iv.overlap_join(left, right, "k", 256, block).collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1] and x[1] < x[2] and y[1] < y[2])
    assert got == want and len(want) > 1000
    wide = iv._levelled(right.where("j = 900"), "r_start", "r_end", 256)
    assert iv._binned(wide, "r_start", "r_end", 256).count() <= 2 * iv.LEVELS


def test_a_hot_bin_is_dealt_to_many_parts(spark):
    left = spark.range(20_000).selectExpr("'c' as k", "id % 50 as l_start", "id % 50 + 10 as l_end", "id")
    right = spark.createDataFrame([("c", 0, 100, 1)], "k string, r_start long, r_end long, j int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = iv.overlap_join(left, right, "k", 256, 500)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 20_000 and max(sizes) < 12_000


def random_reads(rnd, n):
    out = []
    for i in range(n):
        ops = [(rnd.choice([0, 0, 1, 2, 3, 4, 5, 7, 8]), rnd.randrange(1, 40)) for _ in range(rnd.randrange(1, 9))]
        md, waiting = "", 0
        for op, length in ops:  # the last base of an M run differs; skips and insertions aren't in a tag
            if op in (0, 7):
                md += f"{length - 1}T"
            elif op == 8:
                md += "C" * length
            elif op == 2:
                md += "^" + "A" * length + "0"
        out.append((f"r{i}", 4 if i % 11 == 0 else 0, f"c{i % 2}", rnd.randrange(0, 500), ops, md if i % 5 else None, False))
    return out


def plain_window(reads, contig, start, size):
    """The matrix by loops over bases."""
    out = np.zeros((size, 9))
    for _, flag, c, ref_start, ops, md, _ in reads:
        covered = sum(n for op, n in ops if op in (0, 2, 3, 7, 8))
        end = ref_start + max(covered, 1)
        if flag & 4 or c != contig or end <= start or ref_start >= start + size:
            continue
        out[max(ref_start - start, 0) : min(end - start, size), 8] += 1
        at = ref_start
        for op, n in ops:
            if op in (0, 2, 3, 7, 8):
                a, b = max(at, start), min(at + n, start + size)
                if op == 2 and a < b:
                    out[a - start : b - start, 1] += 1
                    out[a - start : b - start, 6] += b - a
                    out[a - start : b - start, 7] = np.maximum(out[a - start : b - start, 7], b - a)
                at += n
            elif start <= at < start + size:
                k = at - start
                if op == 1:
                    out[k, 3] += 1
                    out[k, 4] += n
                    out[k, 5] = max(out[k, 5], n)
                elif op in (4, 5):
                    out[k, 2] += 1
        at = ref_start
        for token in __import__("re").findall(r"\d+|\^[A-Z]+|[A-Z]", md or ""):
            n = int(token) if token.isdigit() else len(token) - 1 if token[0] == "^" else 1
            if token.isalpha() and start <= at < start + size:
                out[at - start, 0] += 1
            at += n
    for total, count in ((4, 3), (6, 1)):
        out[:, total] = np.divide(out[:, total], out[:, count], out=np.zeros(size), where=out[:, count] > 0)
    return out


def test_windows_equal_loops_over_bases(spark):
    reads = random_reads(random.Random(8), 120)
    df = spark.createDataFrame(reads, READ)
    places = [("c0", 0, 1.0), ("c0", 130, 2.5), ("c1", 300, 0.5), ("c1", 5000, 1.0)]
    windows = spark.createDataFrame(places, "contig string, window_start int, factor double")
    raw = {(r.contig, r.window_start): np.array(r["values"]).reshape(-1, 9) for r in wn.window_matrices(df, windows, ["contig"], 200, normalize=False).collect()}
    scaled = {(r.contig, r.window_start): np.array(r["values"]).reshape(-1, 9) for r in wn.window_matrices(df, windows, ["contig"], 200, scale="factor").collect()}
    for contig, start, factor in places:
        want = plain_window(reads, contig, start, 200)
        np.testing.assert_allclose(raw[contig, start], want)
        log = np.log1p(want)
        log[:, wn.COUNTS] = np.log1p(np.expm1(log[:, wn.COUNTS]) * factor)
        np.testing.assert_allclose(scaled[contig, start], log, atol=1e-12)
    assert not raw["c1", 5000].any() and raw["c0", 130][:, :8].any(0).all()
    with pytest.raises(Exception, match="must be positive"):
        wn.window_matrices(df, windows.withColumn("factor", F.lit(0.0)), ["contig"], 200, scale="factor").collect()


def test_events_grow_with_operations_not_with_bases(spark):
    reads = [(f"r{i}", 0, "c", 0, [(0, 1900), (2, 50)], None, False) for i in range(30)]
    windows = spark.createDataFrame([("c", 0)], "contig string, window_start long")
    assert wn.window_events(spark.createDataFrame(reads, READ), windows, ["contig"], 2000).count() <= 8


def test_assignment_equals_the_fold(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(pair, f"{rnd.random():.12f}", *rnd.choice([(5, 5), (5, 5), (6, 5), (5, 6), (1, None), (None, 1), (None, None)])) for pair in "abc" for _ in range(2500)]
    df = spark.createDataFrame(rows, "pair_id string, read_id string, score1 long, score2 long").repartition(5)
    got = {(r.pair_id, r.read_id): r.side for r in an.assigned_reads(df, str(tmp_path / "reads"), 64).collect()}
    lead = dict.fromkeys("abc", 0)
    for pair, read, a, b in sorted(rows, key=lambda r: r[:2]):
        first = a is not None and (b is None or a > b or a == b and lead[pair] <= 0)
        side = None if a is None and b is None else 1 if first else 2
        lead[pair] += {None: 0, 1: 1, 2: -1}[side]
        assert got[pair, read] == side


def test_ranges_of_reads_as_functions_of_the_lead():
    rnd = random.Random(2)
    for _ in range(60):
        kinds = np.array(rnd.choices(range(4), [rnd.random() for _ in range(4)], k=rnd.randrange(50)), np.int8)
        before, after = an.steps(kinds)
        assert all(an.through(lead, before, after) == an.walk(kinds, lead)[0] for lead in range(-70, 71))
    assert len(an.steps(np.full(1024, an.TIE, np.int8))[0]) <= 8


def test_many_tied_reads_of_one_pair_spread_over_tasks(spark, tmp_path):
    rows = spark.range(300_000).selectExpr("'p' as pair_id", "lpad(id, 9, '0') as read_id", "3L as score1", "3L as score2")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join tasks as small as these
    try:
        got = an.assigned_reads(rows, str(tmp_path / "reads"))
        assert len([x for x in os.listdir(tmp_path / "reads") if x.startswith("part-")]) == 4
        counts = an.assignment_counts(got).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert (counts.n1, counts.n2, counts.score_ties) == (150_000, 150_000, 300_000)


def test_records_of_both_sides(spark, tmp_path):
    pairs = spark.createDataFrame([("ab", 1, "a", "b"), ("aa", 1, "a", "a"), ("cd", 1, "c", "d")], "pair_id string, cluster int, hap1_id string, hap2_id string")
    rec = [("a", "A", "1", 0, "A", [(0, 9)], 0), ("a", "A", "1", 2048, "A", [(0, 5), (4, 2)], 1), ("b", "B", "1", 0, "B", [(0, 9)], 0), ("b", "B", "2", 0, "B", [(0, 9)], 9), ("b", "B", "3", 256, "B", [(0, 9)], 0), ("b", "B", "4", 4, "B", [], None), ("b", "B", "5", 0, "A", [(0, 9)], 0)]
    records = spark.createDataFrame(rec, "hap_id string, hap_contig string, read_id string, flag int, contig string, cigar array<struct<op:int,len:long>>, nm int")
    names = spark.createDataFrame([(1, "1"), (1, "9")], "cluster int, read_id string")
    scores = an.joined_scores(pairs, an.haplotype_scores(records), names)
    assert {(r.pair_id, r.read_id): (r.score1, r.score2) for r in scores.collect()} == {("ab", "1"): (9 + 5 - 3 - 2, 9), ("ab", "2"): (None, 9 - 27), ("ab", "9"): (None, None), ("cd", "1"): (None, None), ("cd", "9"): (None, None)}
    assigned = an.assigned_reads(scores, str(tmp_path / "reads"))
    counts = {r.pair_id: (r.n1, r.n2, r.score_ties, r.neither_aligned) for r in an.pair_counts(pairs, assigned).collect()}
    assert counts == {"ab": (1, 1, 1, 1), "aa": (None, None, 0, 0), "cd": (0, 0, 0, 2)}
    rows = sorted((r.pair_id, r.hap_id, r.read_id, r.flag) for r in an.assigned_records(pairs, records, assigned).collect())
    assert rows == [("aa", "a", "1", 0), ("aa", "a", "1", 2048), ("ab", "a", "1", 0), ("ab", "a", "1", 2048), ("ab", "b", "2", 0)]


def test_pair_sums_equal_loops(spark):
    rnd = random.Random(9)
    states = {c: {h: [rnd.randrange(2) for _ in range(5)] for h in range(n)} for c, n in ((1, 9), (2, 3))}
    reads = [(rnd.choice([1, 1, 2, 3]), r, {s: (rnd.randrange(3), rnd.randrange(3)) for s in rnd.sample(range(5), rnd.randrange(1, 4))}, rnd.randrange(1, 30)) for r in range(200)]
    evidence = spark.createDataFrame([(c, r, s, a, p, n) for c, r, sites, n in reads for s, (a, p) in sites.items()], "cluster int, read_id int, sv int, absent long, present long, informative long")
    haps = spark.createDataFrame([(c, h, s, x) for c, hs in states.items() for h, xs in hs.items() for s, x in enumerate(xs)], "cluster int, hap int, sv int, state int")
    got = {(r.cluster, r.hap1, r.hap2): tuple(r)[3:] for r in ev.score_pairs(evidence, haps).collect()}
    want = {}
    for c, hs in states.items():
        for i in hs:
            for j in range(i, len(hs)):
                sums = [0, 0, 0, 0, 0]
                for of, _, sites, n in reads:
                    own = lambda h: sum(v[hs[h][s]] for s, v in sites.items())
                    if of == c and (best := max(own(i), own(j))):
                        up = sum(v[1] for s, v in sites.items() if hs[i][s] == hs[j][s] == 0)
                        ua = sum(v[0] for s, v in sites.items() if hs[i][s] == hs[j][s] == 1)
                        for k, x in enumerate((min(n, 20) * best, 1, min(n, 20), min(n, 20) * up, min(n, 20) * ua)):
                            sums[k] += x
                want[c, i, j] = (sums[0] / 40, sums[1], sums[2] / 20, sums[3] / 40, sums[4] / 40)
    assert got == want


def plain_kmers(text, k):
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    words = [text[i : i + k] for i in range(len(text or "") - k + 1)] if text else []
    return [min(w, back(w)) for w in words if set(w) <= set("ACGT")]


def is_low(word):
    n, runs, best = len(word), 1, 1
    for a, b in zip(word, word[1:]):
        runs = runs + 1 if a == b else 1
        best = max(best, runs)
    most = max(word.count(b) for b in "ACGT")
    return most == n or 10 * most >= 8 * n or 10 * best >= 6 * n


@pytest.mark.parametrize("k,step", [(21, 1 << 18), (5, 64), (31, 100), (1, 10)])
def test_kmers_equal_plain_strings(spark, monkeypatch, k, step):
    monkeypatch.setattr(km, "SLICE", step)
    rnd = random.Random(k)
    texts = ["".join(rnd.choice("ACGT") if rnd.random() < 0.9 else rnd.choice("AAAAAAN") for _ in range(rnd.randrange(150))) + "A" * rnd.randrange(60) for _ in range(25)] + ["", None, "ACGT" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string").repartition(3)
    counted = {r.kmer: r.n for r in km.spelled(km.counts(df, "seq", k, 5), k).collect()}
    want = {}
    for text in texts:
        for word in plain_kmers(text, k):
            want[word] = want.get(word, 0) + 1
    assert counted == want
    low = {r.id: (r.n, r.low) for r in km.complexity(df, "seq", k).collect()}
    assert low == {i: (len(w := plain_kmers(t, k)), sum(map(is_low, w))) for i, t in enumerate(texts)}
    rows = sorted((r.id, r.kmer) for r in km.spelled(km.of_rows(df, "seq", k, distinct=True, complex_only=True), k).collect())
    assert rows == sorted({(i, w) for i, t in enumerate(texts) for w in plain_kmers(t, k) if not is_low(w)})


def test_stretches_carry_less_than_kmers():
    rnd = random.Random(1)
    codes, offsets = km.column(pa.array(["".join(rnd.choice("ACGT") for _ in range(20_000))]))
    _, _, sizes = km.stretches(codes, offsets, 21)
    assert sizes.sum() == 19_980 and ((sizes + 20 + 3) // 4 + 4).sum() < 19_980 * 21 / 4


def test_negatives_come_from_the_whole_gap(spark, tmp_path):
    gaps = spark.createDataFrame([("a", 0, 1_000_000), ("b", 0, 2010), ("b", 5000, 6000), ("b", 9000, 11_003), ("c", 0, 1999)], "chrom string, gap_start long, gap_end long")
    found = lb.sample_negatives(gaps, "chrom", 2000, 50, 3).collect()
    of = lambda c: [(r.window_start, r.window_end) for r in found if r.chrom == c]
    assert len(set(of("a"))) == 50 and all(0 <= s and e == s + 2000 <= 1_000_000 for s, e in of("a"))
    assert sorted(s for s, _ in of("b")) == [*range(0, 11), *range(9000, 9004)] and not of("c")
    spread = np.sort([s for s, _ in of("a")])
    assert np.diff(spread).max() < 60_000
    kept = lambda w: w.where("window_start % 10 = 3")
    some = lb.sample_negatives(gaps, "chrom", 2000, 50, 3, kept, str(tmp_path / "rounds")).collect()
    assert sorted(r.chrom for r in some) == ["a"] * 50 + ["b"] * 2
    assert all(r.window_start % 10 == 3 for r in some) and len({(r.chrom, r.window_start) for r in some}) == 52
    nothing = lb.sample_negatives(gaps.where("chrom = 'c'"), "chrom", 2000, 50, 3, kept, str(tmp_path / "none"))
    assert nothing.count() == 0


def test_negatives_without_labels_and_with_coverage(spark):
    windows = spark.createDataFrame([("a", 0), ("a", 2000), ("a", 4000)], "chrom string, window_start long")
    labels = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 2000, 0), ("a", 4000, 0)], "chrom string, window_start long, label int")
    covered = spark.createDataFrame([("a", 0, 2100), ("b", 0, 9999)], "chrom string, l_start long, l_end long")
    assert [r.window_start for r in lb.usable_negatives(windows, labels, covered, "chrom", 2000).collect()] == [2000]


def test_jitter_stays_in_the_cluster(spark):
    clusters = spark.createDataFrame([("a", 1, 0, 9000, 3000, 5000), ("a", 2, 0, 2010, 0, 10)], "chrom string, cluster int, lo long, hi long, first_start long, last_end long")
    plain = [r.window_start for r in lb.training_window_starts(clusters, 2000, 500, 50).orderBy("cluster", "window_start").collect()]
    moved = [r.window_start for r in lb.training_window_starts(clusters, 2000, 500, 50, 50, 1).orderBy("cluster", "window_start").collect()]
    assert len(plain) == len(moved) and plain != moved
    assert all(abs(a - b) <= 50 and 0 <= b <= 7000 for a, b in zip(plain, moved))


def test_evidence_of_a_region(spark):
    ok = [(0, 200)]
    reads = [
        ("plain", 0, "c", 0, ok, None, False), ("unmapped", 4, "c", 0, ok, None, True), ("secondary", 256, "c", 0, ok, None, True), ("duplicate", 1024, "c", 0, ok, None, True),
        ("split starts", 0, "c", 150, ok, None, True), ("supplementary ends", 2048, "c", 0, [(0, 130)], None, False), ("split passes", 0, "c", 0, [(0, 500)], None, True),
        ("inserted", 0, "c", 0, [(0, 199), (1, 50), (0, 9)], None, False), ("inserted behind", 0, "c", 0, [(0, 200), (1, 50), (0, 9)], None, False), ("short", 0, "c", 0, [(0, 150), (1, 49), (0, 9)], None, False),
        ("deleted", 0, "c", 0, [(0, 60), (2, 50), (0, 100)], None, False), ("deleted before", 0, "c", 0, [(0, 50), (2, 50), (0, 100)], None, False),
    ]
    patch = spark.createDataFrame([("c", 100, 200), ("c", 9000, 9200)], "contig string, pos long, end_pos long")
    got = al.region_evidence(spark.createDataFrame(reads, READ), patch).collect()
    assert [tuple(r) for r in got] == [("c", 100, 9, 4, True)]
    few = [(f"r{i}", 0, "c", 0, ok, None, False) for i in range(9)] + [("s", 0, "c", 150, ok, None, True)]
    assert not al.region_evidence(spark.createDataFrame(few, READ), patch).first().noisy  # a tenth is not more than a tenth


def test_intra_signatures_need_the_reads_span(spark):
    """The span counts bases of the sequence from the read's start, soft clips included, and meets the variant before it is widened."""
    variants = spark.createDataFrame([(1, "c", 1000, 1100)], "variant_id int, contig string, start_pos long, end_pos long")
    reads = [("behind", 0, "c", 1110, [(0, 5), (2, 30), (0, 50)], None, False), ("touches", 0, "c", 1100, [(0, 5), (2, 30), (0, 50)], None, False), ("before", 0, "c", 900, [(0, 60), (2, 30), (0, 39)], None, False), ("clipped", 0, "c", 900, [(0, 60), (2, 30), (0, 39), (4, 1)], None, False)]
    found = al.variant_signatures(al.intra_steps(spark.createDataFrame(reads, READ), "DEL"), variants, False).collect()
    assert sorted(r.read_id for r in found) == ["clipped", "touches"]


def test_equal_decisions_collapse_and_others_raise(spark):
    variants = spark.createDataFrame([("v", "0/1"), ("w", "1/1")], "variant_id string, original_gt string")
    same = spark.createDataFrame([("v", "c1", "0/0"), ("v", "c2", "0/0")], "variant_id string, cluster string, final_gt string")
    assert sorted((r.variant_id, r.status, r.written) for r in vs.export(variants, same).collect()) == [("v", "filtered_absent", False), ("w", "kept_skipped_or_not_evaluated", True)]
    assert vs.agreed(same).first().cluster == "c2"
    with pytest.raises(Exception, match="conflicting genotypes of v: 0/0 and 0/1"):
        vs.export(variants, same.unionByName(same.limit(1).withColumn("final_gt", F.lit("0/1")))).collect()


def test_lines_keep_all_but_their_genotypes(spark):
    lines = ["##x", "#CHROM", "c\t1\tv\tN\tA\t9\tq\tX=1\tDP:GT:Z\t3:0/1:z\t4:./.", "c\t2\tw\tN\tA\t.\t.\t.\tDP\t3", "c\t3\t.\tN\tA\t.\t.\t.", "c\t4\tx\tN\tA\t.\t.\t.\tGT\t1|1"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    one = lambda v, g: (v, "c1", "a__b", 0.5, "0/1", g, 0.25, 1.0, "unchanged")
    decisions = spark.createDataFrame([one("v", "1/1"), one("w", "0/1"), one("x", "0/0")], "variant_id string, cluster string, pair string, pair_score double, original_pair_gt string, final_gt string, hap1_score double, hap2_score double, reason string")
    got = {r.line_no: r for r in vs.export_lines(rows, decisions).collect()}
    assert got[2].value == "c\t1\tv\tN\tA\t9\tq\tX=1\tDP:GT:Z\t3:1/1:z\t4:1/1" and got[3].value == "c\t2\tw\tN\tA\t.\t.\t.\tGT:DP\t0/1:3" and got[4].value == lines[4] and got[5].value is None
    assert [(got[i].vcf_status, got[i].original_gt, got[i].final_gt, got[i].pair_score) for i in (2, 3, 4, 5)] == [("kept_present", "0/1", "1/1", "0.500000"), ("kept_present", "NA", "0/1", "0.500000"), ("kept_skipped_or_not_evaluated", "NA", "NA", "NA"), ("filtered_absent", "1/1", "0/0", "0.500000")]
    assert vs.export_lines(rows, decisions, True).where("line_no = 5").first().value.endswith("GT\t0/0")
    with pytest.raises(Exception, match="not a diploid genotype"):
        vs.export_lines(rows, decisions.withColumn("final_gt", F.lit("1"))).collect()


HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


def test_vcf_parts_concatenate(spark, tmp_path):
    path = str(tmp_path / "vcf")
    rows = spark.range(4000).selectExpr("id", "concat('c', id div 2500) as chrom", "id % 2500 * 7 + 1 as pos")
    rows = rows.select("id", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), F.lit("N"), F.lit("<DEL>"), F.lit("."), F.lit("."), F.concat(F.lit("END="), (F.col("pos") + 30).cast("string"))).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it would join parts as small as these
    try:
        vcf_sink.write_vcf(rows, path, HEADER, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = storage.listed(path, ".vcf.gz")
    assert len(parts) > 2
    whole = b"".join(open(p, "rb").read() for p in parts)
    assert whole.endswith(bgzf.END)
    assert gzip.decompress(whole).decode() == HEADER + "".join(r.value + "\n" for r in rows.orderBy("id").collect())
    assert vcf_sink.read_header(spark, f"{path}/part-*.vcf.gz") == HEADER
    raw = gzip.decompress(open(parts[0] + ".tbi", "rb").read())
    assert raw[:4] == b"TBI\1" and raw[36:39] == b"c0\0"
    index = bam.parse_index(b"BAI\1" + raw[4:8] + raw[36 + int.from_bytes(raw[32:36], "little") :])
    reader = bgzf.Reader(storage.open_range(parts[0]))
    (begin, end), *more = index.chunks(0, 700, 714)
    reader.seek(begin)
    assert not more and b"c0\t701\t" in reader.read((end >> 16) + 70_000)
    with pytest.raises(Exception, match="not in order"):
        vcf_sink.write_vcf(rows.withColumn("id", -F.col("id")), str(tmp_path / "bad"), HEADER, ["id"])
    assert not os.path.exists(tmp_path / "bad") or not os.listdir(tmp_path / "bad")
    vcf_sink.write_vcf(rows.limit(0), str(tmp_path / "none"), HEADER, ["id"])
    assert gzip.decompress(b"".join(open(p, "rb").read() for p in storage.listed(str(tmp_path / "none"), ".gz"))).decode() == HEADER


def test_fasta_by_bytes(spark, tmp_path):
    rnd = random.Random(3)
    seqs = {f"s{i}": "".join(rnd.choice("acgtN") for _ in range(n)) for i, n in enumerate((0, 1, 59, 60, 61, 1000, 777))}
    path = str(tmp_path / "fa")
    indexed_fasta.write_fasta(spark.createDataFrame(list(seqs.items()), "name string, sequence string").repartition(3), path, 60)
    chunks = indexed_fasta.read_chunks(spark, path, 50, split_bases=200)
    assert chunks.rdd.getNumPartitions() > 5
    joined = {}
    for r in chunks.orderBy("contig", "chunk").collect():
        assert r.chunk_start == r.chunk * 50
        joined[r.contig] = joined.get(r.contig, "") + r.piece
    assert joined == {k: s.upper() for k, s in seqs.items() if s}
    wanted = [("s5", a, b) for a, b in ((0, 1000), (59, 61), (60, 60), (1000, 1000), (999, None), (119, 121))]
    regions = spark.createDataFrame(wanted, "contig string, start_pos int, end_pos int")
    got = {(r.start_pos, r.end_pos): r.slice for r in indexed_fasta.fetch_slices(regions, path).collect()}
    assert got == {(a, b): seqs["s5"][a:b].upper() for _, a, b in wanted}
    assert {r.contig for r in indexed_fasta.read_chunks(spark, path, 50, "s3").collect()} == {"s3"}
    for region, message in ((("s5", 0, 1001), "beyond s5"), (("s5", 1001, 1001), "s5"), (("s5", 9, 8), "behind the end"), (("x", 0, 1), "no contig x"), (("s5", -1, 8), "outside")):
        with pytest.raises(Exception, match=message):
            indexed_fasta.fetch_slices(spark.createDataFrame([region], regions.schema), path).collect()
    (tmp_path / "crlf.fa").write_bytes(b">a x\r\nACG\r\nTT\r\n")
    (tmp_path / "crlf.fa.fai").write_text("a\t5\t6\t3\t5\n")
    assert [r.piece for r in indexed_fasta.read_chunks(spark, str(tmp_path / "crlf.fa"), 4).collect()] == ["ACGT", "T"]


def test_slices_of_chunks_raise_beyond_their_contig(spark):
    chunks = fasta.to_chunks(spark.createDataFrame([("a", "acgtacgtac")], "contig string, seq string"), 4)
    of = lambda *rows: fasta.slices(chunks, spark.createDataFrame(list(rows), "contig string, s long, e long"), 4)
    assert {(r.s, r.e): r.slice for r in of(("a", 0, 10), ("a", 3, 5), ("a", 10, 10), ("a", 4, 4)).collect()} == {(0, 10): "ACGTACGTAC", (3, 5): "TA", (10, 10): "", (4, 4): ""}
    for row in (("a", 5, 11), ("a", 20, 30), ("b", 0, 1), ("a", 5, 4), ("a", -2, 3)):
        with pytest.raises(Exception, match="no bases for"):
            of(row).collect()
