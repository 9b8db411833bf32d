"""Assignment of reads to the haplotypes of a pair, from the records of both alignments.

A read goes to the haplotype on which it scores higher, or to the only one on which it aligns; a tie goes to the one
with fewer reads so far (the first if equal), in order of read name. So each tie depends on all reads before it. What
a range of reads does to the lead of the first haplotype is a function of that lead, though, and such functions have few
pieces: two leads of equal parity move together until a tie brings them to the same number, so a range's function
rises in steps, by the same amount beyond all of them. Ranges of RANGE reads are summed up in parallel, one task a pair
passes the lead from range to range, a short row each, and the ranges then deal out their reads in parallel. Reads
travel as rows of their own, sorted by range, so that no task holds more than a batch of them and a range's kinds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from svloom.operators import alignment as al

RANGE = 1024
#: Parts to which the reads of a haplotype or cluster are dealt, so that few haplotypes don't make few tasks.
PARTS = 16
#: What a read does: nothing, go to the first, go to the second, go to whichever is behind.
NEITHER, FIRST, SECOND, TIE = range(4)


def haplotype_scores(records: DataFrame) -> DataFrame:
    """(hap_id, read_id, score) summed over a read's records on its haplotype's contig; ``records``: hap_id, hap_contig, read_id, flag, contig, cigar, nm.

    Unmapped and secondary records, and those on other contigs, are passed over.
    """
    return aligned(records).groupBy("hap_id", "read_id").agg(F.sum(al.record_score(F.col("cigar"), F.col("nm"))).alias("score"))


def aligned(records: DataFrame) -> DataFrame:
    return records.where((F.col("flag").bitwiseAND(al.UNMAPPED | al.SECONDARY) == 0) & (F.col("contig") == F.col("hap_contig")))


def joined_scores(pairs: DataFrame, scores: DataFrame, read_names: DataFrame | None = None) -> DataFrame:
    """(pair_id, read_id, score1, score2) of the pairs (pair_id, hap1_id, hap2_id, and cluster if read_names are given): an outer join by read name.

    ``read_names`` (cluster, read_id) adds the reads that align to neither. Pairs of a haplotype with itself have no row.
    """
    pairs = pairs.where("hap1_id <> hap2_id")
    score = lambda k: F.when(F.col("x.side") == k, F.col("score")).alias(f"score{k}")
    sides = F.explode(F.array(*[F.struct(F.col(f"hap{k}_id").alias("hap_id"), F.lit(k).alias("side")) for k in (1, 2)]))
    by_hap = pairs.select("pair_id", sides.alias("of")).groupBy("of.hap_id").agg(F.collect_list(F.struct("pair_id", "of.side")).alias("pairs"))
    rows = met(scores, by_hap, "hap_id").select("read_id", "score", F.explode("pairs").alias("x")).select("x.pair_id", "read_id", score(1), score(2))
    if read_names is not None:
        by_cluster = pairs.groupBy("cluster").agg(F.collect_list("pair_id").alias("pairs"))
        every = met(read_names.select("cluster", "read_id").distinct(), by_cluster, "cluster").select(F.explode("pairs").alias("pair_id"), "read_id")
        rows = rows.unionByName(every, allowMissingColumns=True)
    # sides meet in the shuffle only, so nothing is summed before it
    return rows.repartition("read_id", "pair_id").groupBy("pair_id", "read_id").agg(F.max("score1").alias("score1"), F.max("score2").alias("score2"))


def met(reads: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """Join by ``key`` of many rows with a read_id and a few ``lists``, one a key: reads are dealt to parts and pass by the lists unsorted."""
    parts = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = reads.withColumn("part", F.pmod(F.xxhash64("read_id"), F.lit(PARTS)).cast("int"))
    return dealt.join(parts.hint("shuffle_hash"), [key, "part"]).drop("part")


def effect(score1: Column, score2: Column) -> Column:
    one, two = score1.isNotNull(), score2.isNotNull()
    first, second = (one & ~two) | (score1 > score2), (two & ~one) | (score2 > score1)
    return F.when(first, FIRST).when(second, SECOND).when(one & two, TIE).otherwise(NEITHER)


def walk(kinds: np.ndarray, lead):
    """(the lead after these reads, sides: 0, 1 or 2) from the lead before, a number or an array of them (then without sides)."""
    if isinstance(lead, np.ndarray):
        for kind in kinds:
            if kind == TIE:
                lead = np.where(lead <= 0, lead + 1, lead - 1)
            elif kind:
                lead = lead + (1 if kind == FIRST else -1)
        return lead
    sides = np.zeros(len(kinds), np.int8)
    for i, kind in enumerate(kinds.tolist()):
        if kind:
            first = kind == FIRST or kind == TIE and lead <= 0
            lead += 1 if first else -1
            sides[i] = 1 if first else 2
    return lead, sides


def steps(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leads before, leads after) at the ends of the pieces of the function of ``kinds``, for both parities in turn.

    Between two neighbours of one parity the lead after is either constant or rises as the lead before; beyond the outer
    ones it rises so.
    """
    n = int((kinds != NEITHER).sum()) + 2
    before, after = [], []
    for parity in (0, 1):
        x = np.arange(-n + (n + parity) % 2, n + 3, 2)
        y = walk(kinds, x)
        rises = np.diff(y) == 2
        ends = np.flatnonzero(rises[1:] != rises[:-1]) + 1
        keep = np.concatenate([[0], ends, [len(x) - 1]])
        before.append(x[keep]), after.append(y[keep])
    return np.concatenate(before), np.concatenate(after)


def through(lead: int, before: np.ndarray, after: np.ndarray) -> int:
    """The lead behind a range, from its ``steps``."""
    mine = before % 2 == lead % 2
    x, y = before[mine], after[mine]
    if lead <= x[0]:
        return int(y[0] - (x[0] - lead))
    if lead >= x[-1]:
        return int(y[-1] + (lead - x[-1]))
    i = int(np.searchsorted(x, lead, "right")) - 1
    return int(y[i] + (lead - x[i]) * (y[i + 1] > y[i]))


def assigned_reads(scores: DataFrame, folder: str, range_size: int = RANGE) -> DataFrame:
    """``scores`` (pair_id, read_id, score1, score2; null where a read isn't aligned) with ``side``: 1, 2, or null for neither.

    The reads in order are a table of the new folder ``folder``, which the result reads: their ranges must not move.
    """
    spark = scores.sparkSession
    rows = scores.select("pair_id", "read_id", "score1", "score2", effect(F.col("score1"), F.col("score2")).cast("byte").alias("kind"))
    rows = rows.repartitionByRange("pair_id", "read_id").sortWithinPartitions("pair_id", "read_id").select("*", F.monotonically_increasing_id().alias("at"))
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder).withColumn("range", F.floor(F.col("at") / range_size).cast("long"))
    key = scores.schema["pair_id"]
    numbers = T.ArrayType(T.LongType())

    def runs(batch):
        """(pair, range, first row, row behind the last) of the batch's stretches of one range."""
        if batch.num_rows:
            pair = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            of = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1]), [True]])).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield batch.column(0)[a].as_py(), int(of[a]), a, b

    def sum_up(batches):
        at, held = None, []

        def finished():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], types[0]), pa.array([at[1]], types[1]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in steps(np.concatenate(held))]], names=["pair_id", "range", "before", "after"])

        for batch in batches:
            types, kinds = (batch.schema.field(0).type, batch.schema.field(1).type), batch.column(3).to_numpy()
            for pair, of, a, b in runs(batch):
                if (pair, of) != at:
                    if held:
                        yield finished()
                    at, held = (pair, of), []
                held.append(kinds[a:b].copy())
        if held:
            yield finished()

    def pass_on(batches):
        at, lead = object(), 0
        for batch in batches:
            leads = []
            for pair, before, after in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if pair != at:
                    at, lead = pair, 0
                leads.append(lead)
                lead = through(lead, np.array(before), np.array(after))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leads, pa.int64())], names=["pair_id", "range", "lead"])

    placed = lambda x: x.repartition("range", "pair_id").sortWithinPartitions("range", "pair_id", F.col("at").asc_nulls_first())
    summed = placed(rows.select("pair_id", "range", "at", "kind"))
    summed = summed.mapInArrow(sum_up, T.StructType([key, T.StructField("range", T.LongType()), T.StructField("before", numbers), T.StructField("after", numbers)]))
    leads = summed.repartition("pair_id").sortWithinPartitions("pair_id", "range").mapInArrow(pass_on, T.StructType([key, T.StructField("range", T.LongType()), T.StructField("lead", T.LongType())]))
    schema = T.StructType([key, scores.schema["read_id"], scores.schema["score1"], scores.schema["score2"], T.StructField("side", T.IntegerType())])

    def deal(batches):
        at, lead = None, 0
        for batch in batches:
            reads, sides = batch.column(2).is_valid().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            kinds, leads = batch.column(3).fill_null(NEITHER).to_numpy(), batch.column(7)
            for pair, of, a, b in runs(batch):
                if (pair, of) != at:  # the row of the lead comes first
                    at, lead = (pair, of), leads[a].as_py()
                lead, sides[a:b] = walk(kinds[a:b], lead)
            sides = pa.array(sides, mask=sides == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(k) for k in (4, 5, 6)], sides], names=schema.names).filter(pa.array(reads))

    columns = ["pair_id", "range", "at", "kind", "read_id", "score1", "score2"]
    dealt = placed(rows.select(*columns, F.lit(None).cast("long").alias("lead")).unionByName(leads, allowMissingColumns=True))
    return dealt.mapInArrow(deal, schema)


def assignment_counts(assigned: DataFrame) -> DataFrame:
    """Reads of each side and kind for each pair."""
    a, b, side = F.col("score1"), F.col("score2"), F.col("side")
    one, two = a.isNotNull(), b.isNotNull()
    counts = {"n1": side == 1, "n2": side == 2, "hap1_better": a > b, "hap2_better": b > a, "score_ties": a == b, "only_hap1": one & ~two, "only_hap2": two & ~one, "neither_aligned": ~one & ~two}
    return assigned.groupBy("pair_id").agg(*[F.count_if(x).alias(n) for n, x in counts.items()])


def pair_counts(pairs: DataFrame, assigned: DataFrame) -> DataFrame:
    """``assignment_counts`` of all pairs: zeros for those without reads; of a haplotype with itself the sides are null, the rest zero."""
    met = pairs.select("pair_id", (F.col("hap1_id") == F.col("hap2_id")).alias("self")).join(assignment_counts(assigned), "pair_id", "left")
    names = [c for c in met.columns if c not in ("pair_id", "self")]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return met.select("pair_id", *[(F.when(~F.col("self"), zero(c)) if c in ("n1", "n2") else zero(c)).alias(c) for c in names])


def assigned_records(pairs: DataFrame, records: DataFrame, assigned: DataFrame) -> DataFrame:
    """(pair_id, columns of ``records``): each record for each pair and haplotype to which its read was assigned; all of the haplotype's records for a pair with itself."""
    rows = aligned(records)
    of = met(assigned.where("side is not null").select("pair_id", "read_id", "side"), pairs.select("pair_id", "hap1_id", "hap2_id"), "pair_id")
    of = of.select("pair_id", "read_id", F.when(F.col("side") == 1, F.col("hap1_id")).otherwise(F.col("hap2_id")).alias("hap_id"))
    own = pairs.where("hap1_id = hap2_id").groupBy(F.col("hap1_id").alias("hap_id")).agg(F.collect_list("pair_id").alias("pairs"))
    columns = ["pair_id", *records.columns]
    both = met(rows, own, "hap_id").withColumn("pair_id", F.explode("pairs"))
    return rows.join(of.hint("merge"), ["read_id", "hap_id"]).select(*columns).unionByName(both.select(*columns))
