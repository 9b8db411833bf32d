"""What grows with the input stays out of the driver and off single rows; results equal plain loops."""

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from svloom.operators import aligner as ar, alignment as al, assignment as an, evidence as ev, haplotypes as hp, intervals as iv, kmers as km, labels as lb
from svloom.plans import alignment_queries as aq, scoring_queries as sq, sequence_queries as seq
from svloom.sources import bam, bgzf, indexed_fasta


def final_plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def haplotypes(spark):
    return spark.createDataFrame([(c, h, f"H{h}", [h % 2]) for c in range(20) for h in (1, 2, 3)], "cluster int, hap int, hap_id string, states array<int>")


def test_pairs_are_not_broadcast(spark):
    pairs = hp.pairs(haplotypes(spark))
    assert pairs.count() == 120 and "BroadcastExchange" not in final_plan(pairs)


def test_bypassed_pairs_are_not_broadcast(spark):
    few = ev.bypass(hp.pairs(haplotypes(spark).where("cluster > 0 or hap < 3")), 4)
    assert [tuple(x) for x in few.select("cluster", "pair_id", "rank").orderBy("rank").collect()] == [(0, "H1__H1", 1), (0, "H1__H2", 2), (0, "H2__H2", 3)]
    assert "BroadcastExchange" not in final_plan(few)


def test_overlap_join_is_not_broadcast(spark):
    left = spark.range(50).select(F.lit("c").alias("k"), F.col("id").alias("l_start"), (F.col("id") + 2).alias("l_end"))
    right = spark.range(50).select(F.lit("c").alias("k"), F.col("id").alias("r_start"), (F.col("id") + 1).alias("r_end"))
    met = iv.overlap_join(left, right, "k", 4)
    assert met.count() == 50 + 49 and "BroadcastExchange" not in final_plan(met)


def test_segments_of_twenty_bases_on(spark, sf):
    lengths = [r.q_end - r.q_start for r in aq.sv30_large_query_segments(spark, sf).collect()]
    assert lengths and min(lengths) >= 20 and any(n < 50 for n in lengths)


def test_a_record_becomes_arrow_once_for_all_its_regions(spark, tmp_path, monkeypatch):
    reads = spark.createDataFrame([(str(k), 0, "c", 10 * k, 60, [(0, 15), (2, 10)], "*", False) for k in range(40)], "read_id string, flag int, contig string, ref_start long, mapq int, cigar array<struct<op:int,len:long>>, seq string, has_sa boolean")
    path = str(tmp_path / "bam")
    bam.write_bam(reads, path, [("c", 1000)])
    made, starts = [], [(k * 7) % 390 for k in range(200)]
    monkeypatch.setattr(bam, "arrow_rows", lambda rows, make=bam.arrow_rows: made.append(len(rows)) or make(rows))
    near = bam.Nearby(pa.array(range(200)), np.array(starts), np.array([s + 30 * (k % 5) for k, s in enumerate(starts)]))
    met = []
    for uri in bam.storage.listed(path, ".bam"):
        reader = bgzf.Reader(bam.storage.open_range(uri))
        first = (bam.read_header(reader), reader.tell())[1]
        for keys, rows in near.records(0, reader, ["c"], first, bam.read_index(uri), 0):
            met += zip(keys.to_pylist(), rows.column("read_id").to_pylist())
    assert sorted(met) == sorted((k, str(r)) for k, s in enumerate(starts) for r in range(40) if k % 5 and 10 * r < s + 30 * (k % 5) and 10 * r + 25 > s)
    assert sum(made) == 40 and len(met) > 1000


def test_a_fasta_reader_takes_no_index_along(tmp_path):
    text, lines = "", []
    for k in range(500):
        text += f">c{k}\n"
        lines.append(f"c{k}\t6\t{len(text)}\t4\t5\n")
        text += "ACGT\nAC\n"
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "a.fa.fai").write_text("".join(lines))
    reader = indexed_fasta.FastaReader({"path": str(tmp_path / "a.fa"), "chunk": "4", "split_bases": "40"})
    parts = reader.partitions()
    assert len(pickle.dumps(reader)) < 1000 and max(len(pickle.dumps(p)) for p in parts) < 2000
    rows = [r for p in pickle.loads(pickle.dumps(parts)) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["contig"], r["chunk_start"], r["piece"]) for r in rows] == [(f"c{k}", at, piece) for k in range(500) for at, piece in ((0, "ACGT"), (4, "AC"))]


def test_a_user_meets_a_variant_once(spark, sf):
    plan = sq.sv78_variant_strings(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "Join Inner, (k#" in line)
    assert "Aggregate [k#" in plan.split(joined)[1]


def test_only_reads_that_stay_in_the_matrix_are_spread_over_bases(spark):
    rows = [(1, r, 10 * r, 10 * r + 25, 0, 400, r % 2 == 0) for r in range(20)]
    found = al.centred_matrix(spark.createDataFrame(rows, "variant_id long, read_id long, s long, e long, lo long, hi long, inter boolean"), 3, 101)
    order = sorted(range(20), key=lambda r: (r % 2 == 0, 10 * r))[(20 - 3) // 2 :][:3]
    cells = sorted((k, p - (400 - 101) // 2, 2 if r % 2 == 0 else 1) for k, r in enumerate(order) for p in range(10 * r, 10 * r + 25) if 0 <= p - (400 - 101) // 2 < 101)
    assert cells and sorted((x["row"], x["col"], x["code"]) for x in found.collect()) == cells
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate explode(sequence") < plan.index("Window")


def test_evidence_and_compatibility_equal_loops(spark):
    index = [(c, k, sv, st, st + 1) for c in (1, 2) for k in range(12) for sv in range(3) for st in (0, 1) if (k + 2 * sv + st + c) % 3 == 0]
    kmers = [(c, r, k) for c in (1, 2) for r in range(9) for k in range(15) if (k * r + c) % 4 < 2]
    got = ev.read_evidence(spark.createDataFrame(kmers + kmers[:5], "cluster int, read_id long, kmer long"), spark.createDataFrame(index, "cluster int, kmer long, sv int, st int, halves int"), 5)
    wanted = {}
    for c, r in {(c, r) for c, r, _ in kmers}:
        mine = [x for x in index if x[0] == c and (c, r, x[1]) in set(kmers)]
        if (n := len({x[1] for x in mine})) >= 5:
            for sv in {x[2] for x in mine}:
                wanted[c, r, sv] = tuple(sum(x[4] for x in mine if x[2] == sv and x[3] == st) for st in (0, 1)) + (n,)
    assert wanted and {(x.cluster, x.read_id, x.sv): (x.absent, x.present, x.informative) for x in got.collect()} == wanted
    assert "BroadcastExchange" not in final_plan(got)
    states = [(c, h, sv, h >> sv & 1) for c in (1, 2) for h in range(4) for sv in range(3) if (h, sv) != (3, 0)]
    found = ev.compatibility(got, spark.createDataFrame(states, "cluster int, hap int, sv int, state int"))
    expected = {}
    for (c, r, sv), (a, p, _) in wanted.items():
        for _, h, _, state in (x for x in states if x[0] == c and x[2] == sv):
            expected[c, r, h] = expected.get((c, r, h), 0) + (p if state else a)
    assert {(x.cluster, x.read_id, x.hap): x.compat for x in found.collect()} == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0].count("Aggregate") == 0


SIGNATURE = "read_id long, contig string, s long, e long, inter boolean, span_start long, span_end long"


def test_signature_columns_equal_the_counts_of_codes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for read in range(120):
        a, contig = int(rng.integers(4050, 4150)), f"c{read % 2}"  # around a border of ranges
        for at in rng.integers(a, a + 90, 4).tolist():
            b = a + (30 if read < 100 else int(rng.integers(20, 40)))  # later reads have several spans
            inter = bool(rng.integers(2))
            rows.append((read, contig, at, at + int(rng.integers(0, 30)), inter, *((None, None) if inter and read % 3 else (a, b))))
    rows += [(200, "c0", 0, 9, True, None, None), (200, "c0", 2, 8, False, 0, 9)]
    variants = [(k, f"c{k % 2}", int(p), int(p) + k % 9) for k, p in enumerate(rng.integers(4000, 4250, 60))] + [(99, "c0", 4100, 4105), (98, "c0", 4100, 4105), (97, "c0", 3, 5)]
    rows, variants = spark.createDataFrame(rows, SIGNATURE), spark.createDataFrame(variants, "variant_id long, contig string, start_pos long, end_pos long")
    wanted = al.signature_counts(al.signature_codes(al.variant_signatures(rows, variants, False, 20, flag="inter"))).collect()
    got = al.signature_columns(rows, variants, 20).collect()
    assert len(wanted) > 1000 and any(x.intra == x.inter == 0 for x in wanted)
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))


def test_signature_columns_take_no_row_for_a_read_and_a_variant(spark):
    reads = spark.range(4000).select(F.col("id").alias("read_id"), F.lit("c").alias("contig"), F.lit(0).cast("long").alias("s"), F.lit(9000).cast("long").alias("e"), (F.col("id") % 4 == 0).alias("inter"), F.lit(0).cast("long").alias("span_start"), F.lit(9000).cast("long").alias("span_end"))
    variants = spark.range(4000).select(F.col("id").alias("variant_id"), F.lit("c").alias("contig"), F.col("id").alias("start_pos"), (F.col("id") + 1).alias("end_pos"))
    found = al.signature_columns(reads, variants, 1)
    assert found.groupBy("intra", "inter").count().collect() == [(3000, 2000, 3 * 4000 - 1)]


def banded_score(a, b, whole):
    """The best score in the band by plain loops; with ``whole`` false that of the best place from the first corner on, all rows filled."""
    low, gap = -(10**9), ar.OPEN + ar.EXTEND
    shift = len(b) - len(a) if whole else 0
    h, e, best = {(0, 0): 0}, {}, 0
    for i in range(len(a) + 1):
        f = low
        for j in range(max(0, i + min(0, shift) - ar.BAND), min(len(b), i + max(0, shift) + ar.BAND) + 1):
            e[i, j] = max(e.get((i - 1, j), low) - ar.EXTEND, h.get((i - 1, j), low) - gap)
            f = max(f - ar.EXTEND, h.get((i, j - 1), low) - gap)
            slant = h.get((i - 1, j - 1), low) + (ar.MATCH if i and j and a[i - 1] == b[j - 1] else ar.MISMATCH)
            h[i, j] = max(slant, e[i, j], f) if i or j else 0
            best = max(best, h[i, j])
    return h[len(a), len(b)] if whole else best


def scored(a, b, ops):
    total, i, k, before = 0, 0, 0, None
    for op in ops:
        if op == ar.M:
            total += ar.MATCH if a[i] == b[k] else ar.MISMATCH
        else:
            total -= ar.EXTEND + (ar.OPEN if op != before else 0)
        i, k, before = i + (op != ar.D), k + (op != ar.I), op
    return total, i, k


def test_many_bands_filled_at_once_equal_loops():
    rng = np.random.default_rng(3)
    jobs = []
    for k in range(150):
        a = bytes(rng.choice(list(b"ACGT"), int(rng.integers(0, 40))).tolist())
        b = bytearray(a)
        for _ in range(k % 5):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 9))] = rng.choice(list(b"ACGT"), int(rng.integers(0, 12))).tolist()
        jobs.append((a, bytes(b), k % 3 == 0))
    for (a, b, whole), ops in zip(jobs, ar._fill(jobs)):
        total, i, k = scored(a, b, ops.tolist())
        assert total == banded_score(a, b, whole) and (not whole or (i, k) == (len(a), len(b)))


def test_pairs_are_aligned_together(monkeypatch):
    rng = np.random.default_rng(5)
    target = "".join(rng.choice(list("ACGT"), 900))
    pairs = [(target[k : k + 60] + "ACCA" * 40 + target[k + 60 + k % 7 : k + 200], target) for k in range(200)]
    alone, calls = [ar.align(*p) for p in pairs], []
    monkeypatch.setattr(ar, "_fill_group", lambda jobs, fill=ar._fill_group: calls.append(len(jobs)) or fill(jobs))
    assert ar.align_many(pairs) == alone and max(calls) >= 200 and len(calls) < 10


def test_kmers_take_a_batch_a_few_rows_at_a_time():
    texts = ["ACGT" * n for n in (0, 1, 20_000, 60_000, 0, 70_000, 5, 90_000, 1)] + [None, "ACG"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "seq"])
    parts = list(km._row_groups(batch, 1))
    assert pa.Table.from_batches(parts).column("row").to_pylist() == list(range(len(texts)))
    assert len(parts) >= 3 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()[1:]) <= km.SLICE for p in parts)
    assert not list(km._row_groups(batch.slice(0, 0), 1))


def test_rows_go_to_one_level_if_the_others_are_short(spark, monkeypatch):
    rng = np.random.default_rng(11)
    left = [(k, "c", int(s), int(s + n)) for k, (s, n) in enumerate(zip(rng.integers(-50, 4000, 150), rng.integers(0, 3, 150) * rng.integers(1, 900, 150)))]
    right = [(k, "c", int(s), int(s) + 16) for k, s in enumerate(rng.integers(-50, 4500, 200))]
    a, b = spark.createDataFrame(left, "l long, k string, l_start long, l_end long"), spark.createDataFrame(right, "r long, k string, r_start long, r_end long")
    wanted = sorted((x[0], y[0]) for x in left for y in right if x[2] < y[3] and x[3] > y[2] and x[2] < x[3])
    binned, sizes = iv._binned, []
    monkeypatch.setattr(iv, "_binned", lambda rows, *args: sizes.append(binned(rows, *args).count()) or binned(rows, *args))
    assert len(wanted) > 500 and sorted((x.l, x.r) for x in iv.overlap_join(a, b, "k", 16, short=True).collect()) == wanted
    assert sizes[0] <= 2 * sum(x[2] < x[3] for x in left)


def test_reads_alike_reach_the_matrices_as_one_row(spark):
    rows = [(1, r, s, 1 + r % 2, s, 7) for r in range(600) for s in (0, 1)]
    evidence = spark.createDataFrame(rows, "cluster int, read_id int, sv int, absent long, present long, informative long")
    states = spark.createDataFrame([(1, h, s, h >> s & 1) for h in range(4) for s in (0, 1)], "cluster int, hap int, sv int, state int")
    got = ev.score_pairs(evidence, states)
    assert "count(1) AS reads" in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]
    assert {(r.hap1, r.hap2): (r.score, r.informative_reads, r.total_read_weight) for r in got.collect()} == {
        (i, j): (sum(7 * max(o) for o in sides) / 40, sum(max(o) > 0 for o in sides), sum(7 * (max(o) > 0) for o in sides) / 20)
        for i in range(4) for j in range(i, 4)
        for sides in [[[sum(s if h >> s & 1 else 1 + r % 2 for s in (0, 1)) for h in (i, j)] for r in range(600)]]
    }


def test_reads_of_few_haplotypes_spread_over_tasks_and_are_not_gathered(spark, tmp_path):
    pairs = spark.createDataFrame([("ab", 1, "a", "b"), ("aa", 1, "a", "a")], "pair_id string, cluster int, hap1_id string, hap2_id string")
    scores = spark.range(4000).selectExpr("if(id % 2 = 0, 'a', 'b') as hap_id", "id div 2 as read_id", "id % 3 as score")
    names = spark.range(1500, 3000).selectExpr("1 as cluster", "id as read_id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        reads = an.met(scores, pairs.selectExpr("hap1_id as hap_id", "pair_id").where("pair_id = 'ab'"), "hap_id")
        assert reads.count() == 2000 and len([n for n in reads.rdd.glom().map(len).collect() if n]) > 1
        joined = an.joined_scores(pairs, scores, names)
        got = {(r.pair_id, r.read_id): (r.score1, r.score2) for r in joined.collect()}
        assert got == {("ab", k): (2 * k % 3, (2 * k + 1) % 3) if k < 2000 else (None, None) for k in range(3000)}
        assigned = an.assigned_reads(joined, str(tmp_path / "reads"), 100)
        assert "collect_list" not in assigned._jdf.queryExecution().optimizedPlan().toString()
        sides = {r.read_id: r.side for r in assigned.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    kinds = [{-1: an.SECOND, 0: an.TIE, 1: an.FIRST}[(a > b) - (a < b)] if a is not None else an.NEITHER for a, b in (got["ab", k] for k in range(3000))]
    assert [sides[k] or 0 for k in range(3000)] == an.walk(np.array(kinds), 0)[1].tolist()


def test_kmers_of_stretches_are_taken_in_small_steps_and_spelled(monkeypatch):
    rnd, sizes = np.random.default_rng(5), []
    for k in (1, 3, 4, 5, 21, 31):
        bases = rnd.integers(k, k + 6, 9000)
        starts = np.cumsum(bases) - bases
        codes = rnd.integers(0, 4, bases.sum()).astype(np.uint8)
        with monkeypatch.context() as m:
            m.setattr(km, "numbers", lambda codes, k, whole=km.numbers: sizes.append(len(codes)) or whole(codes, k))
            found = np.concatenate(list(km.of_stretches(codes, starts, bases, k)))
        letters = "".join("ACGT"[c] for c in codes)
        every = [letters[s + i : s + i + k] for s, n in zip(starts, bases) for i in range(n - k + 1)]
        assert km.text(found, k).to_pylist() == [min(x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))) for x in every]
    assert max(sizes) < (1 << 12) * 37


def test_long_work_on_rows_of_a_small_file_is_spread_over_tasks(spark, sf):
    assert seq.sv19_header_codec(spark, sf).rdd.getNumPartitions() == 4


def test_a_line_of_a_vcf_is_made_and_split_once(spark):
    """Filters on a line's fields stay above the split (F28), whatever the line is made of; odd lines read as before."""
    from svloom.operators import variants as vs

    fixed = "chr1\t10\t.\tN\tNA\t.\tPASS\tEND=11\tGT:DP\t"
    values = [None, "", "#x", "\t", "x", "\tx", *[fixed + x for x in ("", "0", "1", ".", "0/0:9", "0|1:9", "./0", "0/./0", "0//0", "1|1|0", "0/", "/0", "00/0")], fixed.replace("GT:DP", "DP") + "1/1"]
    lines = spark.createDataFrame([(i, x and x[:3], x and x[3:]) for i, x in enumerate(values)], "line_no long, a string, b string")
    lines = lines.select("line_no", F.concat("a", "b").alias("value"))
    records = vs.parse_vcf_lines(lines)
    assert sorted(r.line_no for r in records.select("line_no").collect()) == [i for i, x in enumerate(values) if x and x[0] != "#"]
    rows = vs.drop_reference_genotypes(records.withColumn("tokens", vs.tokenize_genotype(F.col("gt"))))
    kept = {r.line_no - 6: "".join(r.tokens) for r in rows.select("line_no", "tokens").collect()}
    assert kept == {2: "1", 3: "0", 5: "0|1", 6: "0/0", 9: "1|1|0", 10: "0/", 11: "/0", 12: "00/0"}
    plan = rows.select("line_no", "tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(a#") == 1 and plan.count("regexp_extract_all") <= 2


def test_split_reads_are_sorted_once(spark):
    """Pairs of neighbouring records equal a plain loop, with one sort of the segments (F30)."""
    rng = np.random.default_rng(7)
    rows = []
    for read in range(400):
        for no in rng.permutation(30)[: rng.integers(1, 6)].tolist():
            a, q, n = (int(x) for x in rng.integers(0, 400, 3))
            rows.append((read, [None, "c0", "c1"][min(2, rng.integers(0, 9))], no, a, a + n, q, q + 20, bool(rng.integers(0, 4))))
    segments = spark.createDataFrame(rows, "read_id long, contig string, record_no int, r_start long, r_end long, q_start long, q_end long, forward boolean")
    expected = {"DEL": [], "INS": []}
    for read in range(400):
        mine = sorted((r for r in rows if r[0] == read), key=lambda r: r[2])
        for x, y in zip(mine, mine[1:]):
            d = (y[3] - x[4]) - (y[5] - x[6])
            if x[1] is not None and x[1] == y[1] and x[7] == y[7] and x[4] - y[3] < 30 and 30 <= abs(d) <= 300 and sum(r[1] == x[1] for r in mine) == 2:
                expected["DEL" if d > 0 else "INS"].append((read, x[1], x[4] if d > 0 else (x[4] + y[3]) // 2, abs(d)))
    for kind, pairs in expected.items():
        found = al.split_signatures(segments, kind, cap=300)
        assert len(pairs) > 2 and sorted(map(tuple, found.collect())) == sorted(pairs)
        assert final_plan(found).count("Sort [") == 1


def test_equal_places_are_joined_once(spark):
    rows = spark.createDataFrame([(i, "c", 10 * (i % 2), 10 * (i % 2) + 5) for i in range(3000)], "id long, k string, r_start long, r_end long")
    places = iv.gathered(rows, ["k", "r_start", "r_end"]).cache()
    found = [(r.r_start, sorted(m.id for m in r.members)) for r in places.collect()]
    assert len(found) == 4 and all(len(ids) <= iv.GATHERED for _, ids in found)
    assert sorted(i for _, ids in found for i in ids) == list(range(3000)) and all(i % 2 * 10 == s for s, ids in found for i in ids)
    left = spark.createDataFrame([(1, "c", 0, 8), (2, "c", 4, 12)], "n long, k string, l_start long, l_end long")
    met = iv.overlap_join(left, places, "k", 4, cheap=True)
    assert met.count() == 6
    assert met.select("n", F.inline("members")).groupBy("n").count().orderBy("n").collect() == [(1, 1500), (2, 3000)]


def test_left_rows_go_to_no_level_that_the_right_side_lacks(spark):
    rng = np.random.default_rng(4)
    make = lambda n, most: [(int(i), "c", int(s), int(s + w)) for i, s, w in zip(range(n), rng.integers(0, 4000, n), rng.integers(1, most, n))]
    a, b = make(200, 300), make(60, 4) + [(60 + i, "c", s, s + 900) for i, s in enumerate((0, 1000, 3500))]
    left, right = spark.createDataFrame(a, "l long, k string, l_start long, l_end long"), spark.createDataFrame(b, "r long, k string, r_start long, r_end long")
    met = iv.overlap_join(left, right, "k", 4, cheap=True)
    assert sorted((x.l, x.r) for x in met.collect()) == sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and x[3] > y[2])
    assert iv.overlap_join(left, right.limit(0), "k", 4, cheap=True).count() == 0
    levels = F.sequence(F.lit(0), F.lit(iv.LEVELS - 1))
    small = right.where("r < 60")
    joined = iv.overlap_join(left, small, "k", 4, cheap=True)
    assert "__levels" in joined._jdf.queryExecution().analyzed().toString() and iv._binned(iv._levelled(left, "l_start", "l_end", 4), "l_start", "l_end", 4, True, F.filter(levels, lambda k: k == F.col("__own"))).count() <= 2 * len(a)


def test_variants_that_share_their_reads(spark):
    rng = np.random.default_rng(6)
    strings = [(f"r{i % 7}", f"c{i % 2}", int(s), int(s) + 5) for i, s in enumerate(rng.integers(0, 200, 80))]
    variants = [(i, f"c{i % 2}", 20 * (i % 5), 20 * (i % 5) + 3, i % 3) for i in range(60)]
    reads = [(k, f"r{n}") for n in range(7) for k in range(3) if (n + k) % 2] * 2
    wanted = sorted((x[0], s[0], *s[1:]) for s in strings for x in variants if s[1] == x[1] and (x[4], s[0]) in reads and max(s[2], x[2] - 4) <= min(s[3], x[3] + 4))
    frames = [spark.createDataFrame(strings, "read_id string, contig string, start_pos long, end_pos long"), spark.createDataFrame(variants, "variant_id long, contig string, start_pos long, end_pos long, k long")]
    shared = lb.gather_sfs(*frames, spark.createDataFrame(reads, "k long, read_id string"), 4, by="k")
    assert len(wanted) > 50 and sorted(map(tuple, shared.collect())) == wanted
    own = [(x[0], r) for x in variants for k, r in reads if k == x[4]]
    assert sorted(map(tuple, lb.gather_sfs(*frames, spark.createDataFrame(own, "variant_id long, read_id string"), 4).collect())) == wanted


def test_matrices_of_one_place_are_made_once(spark, sf, tmp_path, monkeypatch):
    seen, found, plain = [], [], al.centred_matrix
    monkeypatch.setattr(al, "centred_matrix", lambda rows, *size: seen.append(rows.count()) or plain(rows, *size))
    for copies in (1, 3):
        folder = str(tmp_path / str(copies))
        spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{folder}/lineitem.parquet")
        parts = spark.read.parquet(f"{sf}/part.parquet")
        parts.withColumn("p_partkey", F.explode(F.array(*[F.col("p_partkey") + 20_000 * k for k in range(copies)]))).write.parquet(f"{folder}/part.parquet")
        found.append(sorted(map(tuple, aq.sv77_centred_matrix(spark, folder).collect())))
    assert seen[0] == seen[1] > 0  # before: three times as many
    assert found[0] and found[1] == sorted((v + 20_000 * k, *rest) for v, *rest in found[0] for k in range(3))


def test_regions_of_one_place_are_fetched_once_in_many_tasks(spark, tmp_path):
    ops = [(0, 50)]
    reads = spark.createDataFrame([(f"r{i}", 0, "c", 20 * i, 60, ops, "*", False) for i in range(40)], "read_id string, flag int, contig string, ref_start long, mapq int, cigar array<struct<op:int,len:long>>, seq string, has_sa boolean")
    bam.write_bam(reads, str(tmp_path / "reads"), [("c", 1000)])
    regions = [(i, "c", 100 * (i % 5), 100 * (i % 5) + 30) for i in range(50)]
    met = bam.fetch_regions(spark.createDataFrame(regions, "region_id int, contig string, start_pos int, end_pos int"), str(tmp_path / "reads"))
    wanted = sorted((g, f"r{i}") for g, _, s, e in regions for i in range(40) if 20 * i < e and 20 * i + 50 > s)
    assert sorted((r.region_id, r.read_id) for r in met.collect()) == wanted
    assert met.rdd.getNumPartitions() == 4  # before: one, as the regions are few bytes
