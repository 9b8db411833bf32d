"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union-sketch filter, exact Jaccard.

A document's set holds the distinct hashes of its 5-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+).
Documents with equal sets form a class, and only one of a class is compared with others. Two classes are linked
if 100 * intersection >= 75 * union of the full sets.

A sketch keeps the K smallest hashes of a set. Linked sets share at least ``need(n)`` of them (the full sketch
for n <= K; else a count that the hypergeometric law misses with probability under 1e-9). So, with the kept
hashes ordered from rare to common, linked sets meet in the inverted list of one of their first
``len - need + 1`` hashes; hashes that most documents share are not listed. In a list not all pairs are formed:
first every class is compared with one hub of each of its lists, in some rounds, so that large groups of near
copies join at linear cost. Classes of a list that are still in different components then meet by the rare elements of
their full sets, which tells close copies from those a sketch can't tell. Pairs are verified on full sets.

Null and empty texts have an empty set and link with nothing. Repeated rows get the same result. A null doc_id
takes part in grouping; it is never the smallest of a group, and where a group has no id at all, component_id is
null and kept is true. Rows that share a doc_id but not a set are each grouped by their own text. Extra columns
are not read; empty tables give empty results. A text is hashed whole, in memory of some 60 bytes a byte of text
for its batch (a long text is a batch of its own); no other row holds more than a text or its set.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from svloom.llm import bytewords as bw
from svloom.llm.shared import Workspace, connected_components, release_memory, with_small_side

K = 96
#: Linked if SHARE_PERCENT * union <= 100 * intersection.
SHARE_PERCENT = 75
#: Which member of a list is its hub, round by round: that whose values are the most common (of near copies, the
#: original that each of them edits), that with the smallest set, and any.
HUBS = ["-popularity", "n", "xxhash64(cid)"]
#: Members of a hub that are verified together, and listed sets of one value and size that are joined together.
MEMBERS, BLOCK = 64, 1024
#: Sizes of one size class differ by less than this factor.
SIZE_STEP = 1.1
#: Chance that a sketch of a linked pair shares fewer than ``need`` values.
MISS = 1e-9


@lru_cache(1 << 14)
def need(n: int, k: int = K) -> int:
    """Least number of shared sketch values of a set of n and any set linked with it."""
    t = SHARE_PERCENT / 100
    if n <= k:  # a linked set, or their union, has at most n / t elements; a sketch lacks those beyond k
        return max(1, min(math.ceil(t * n), math.ceil(k - (1 - t) * n / t) if n / t > k else n))
    worst = k
    for union in (n, math.floor(n / t)):
        shared = math.ceil(t * union)
        lg = math.lgamma
        choose = lambda a, b: lg(a + 1) - lg(b + 1) - lg(a - b + 1)
        total, x = 0.0, max(0, k - (union - shared))
        while x < k:
            total += math.exp(choose(shared, x) + choose(union - shared, k - x) - choose(union, k))
            if total > MISS:
                break
            x += 1
        worst = min(worst, x)
    return max(1, worst)


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, th, n, d1, d2, sketch) of each document: hash of the text, set size, 128-bit digest of the set, its k smallest hashes."""

    def apply(batches):
        for batch in batches:
            ids, hashes, texts = batch.columns
            for a, b in bw.slices(texts):
                sets = bw.shingles(*bw.words(*bw.column(texts.slice(a, b - a))))
                n = np.array([len(s) for s in sets], np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                every = np.concatenate([np.zeros(0, np.uint64), *sets, np.zeros(1, np.uint64)])
                digest = [np.where(n > 0, np.add.reduceat(bw.mix(every ^ c), at)[:-1], np.uint64(0)) for c in (np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0x0123456789ABCDEF))]
                low = [(s[:k] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]  # signed, in the same order
                cut = np.concatenate([[0], np.cumsum([len(s) for s in low])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.int64), *low])))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), hashes.slice(a, b - a), pa.array(n), *(pa.array(x.view(np.int64)) for x in digest), sketch], names=["doc_id", "th", "n", "d1", "d2", "sketch"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), "text").mapInArrow(apply, "doc_id long, th long, n long, d1 long, d2 long, sketch array<long>")


def text_hash() -> Column:
    """Tells the texts of one doc_id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fetch(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, d1, text) of the classes with an id in ``ids`` (cid): the text of the class's first row."""
    spark, count = docs.sparkSession, ids.count()
    wanted = classes.select("cid", "d1", "id", "th").join(with_small_side(spark, ids, count), "cid", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("at"), "text")
    wanted = with_small_side(spark, wanted, count)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"]) & (texts["at"] == wanted["th"]))
    return found.select("cid", "d1", "text").dropDuplicates(["cid"])  # of repeated rows each task sends one


def verify(ws: Workspace, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b: member and hub) whose full sets are linked; ``texts``: cid, d1, text.

    A hub's text goes once to each block of its members, in front of their texts.
    """
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    hubs = ws.table(hubs, "hubs")
    spark = ws.spark
    block = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block")
    members = pairs.join(with_small_side(spark, hubs, hubs.count()), "b").select("b", block, "a")
    members = members.join(texts.withColumnRenamed("cid", "a"), "a").select("b", "block", "a", "d1", "text")
    first = hubs.join(texts.withColumnRenamed("cid", "b"), "b")
    first = first.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), "d1", "text")

    def apply(batches):
        hub = against = None
        for batch in batches:
            kept = []
            b, block, a, digests, rows = (*(batch.column(k).to_pylist() for k in range(4)), batch.column(4))
            for i in range(batch.num_rows):
                mine = _set(rows.slice(i, 1))
                if _digest(mine) != digests[i]:
                    continue  # a text with the same hash
                if a[i] is None:
                    hub, against = (b[i], block[i]), mine
                elif hub == (b[i], block[i]):
                    both = len(np.intersect1d(mine, against, assume_unique=True))
                    if 100 * both >= SHARE_PERCENT * (len(mine) + len(against) - both):
                        kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept, pa.int64())) for k in (2, 0)], names=["a", "b"])
        release_memory()

    near = first.unionByName(members).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return near.mapInArrow(apply, "a long, b long")


def _set(text: pa.Array) -> np.ndarray:
    return bw.shingles(*bw.words(*bw.column(text)))[0]


def _digest(s: np.ndarray) -> int:
    return int(bw.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum().view(np.int64)) if len(s) else 0


def _overlap(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the share ``est`` of the union sketch, where it doesn't rule out a link."""
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"), F.col("need").alias(f"need{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where((100 * F.least("na", "nb") >= SHARE_PERCENT * F.greatest("na", "nb")))
    both = F.size(F.array_intersect("sa", "sb"))
    met = met.withColumn("shared", both).where(F.col("shared") >= F.greatest("needa", "needb"))
    # sketches of small sets are the sets
    exact = 100 * F.col("shared") >= SHARE_PERCENT * (F.col("na") + F.col("nb") - F.col("shared"))
    met = met.where((F.greatest("na", "nb") > K) | exact)
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    inside = F.size(F.array_intersect(F.array_intersect(union, "sa"), "sb"))
    met = met.withColumn("inside", inside).where("inside >= least(needa, needb)")
    return met.select("a", "b", F.col("inside").alias("est"))


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")


def prefix_pairs(ws: Workspace, sets: DataFrame) -> DataFrame:
    """(a, b) of ``sets`` (cid, component, values: distinct) of different components that may be linked.

    Sets of n and m linked elements share at least c = P (n + m) / (100 + P) of them, P = SHARE_PERCENT. Each set's
    elements are ordered from rare to common; the first one that both have then stands so far in front in each that
    c can still follow. So the smaller set is listed by its first n / 7 elements or so (what follows must be c for
    m = n), the larger one looks them up by its first n / 4, each only for the sizes that what follows allows. A group
    of copies that all differ by edits of their own meets in none of these places. Of a value's listed sets those of
    its commonest component don't meet each other, and what a common value still lists is joined in blocks.
    """
    share, whole = SHARE_PERCENT, 100 + SHARE_PERCENT
    rows = sets.select("cid", "component", F.size("values").alias("n"), F.explode("values").alias("value"))
    common = ws.table(rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequent")
    # hashes of one set alone are the rarest: they come first and list nothing
    mine = Window.partitionBy("cid")
    placed = rows.join(common, "value").select("*", F.count(F.lit(1)).over(mine).alias("size"), F.row_number().over(mine.orderBy("df", "value")).alias("place"))
    rest = (F.col("size") - F.col("place") + 1).alias("rest")
    listed = placed.select("value", "cid", "component", "n", rest).where(f"{100} * rest >= {share} * n")
    listed = ws.table(listed, "prefixes")
    per = listed.groupBy("value", "component").agg(F.count(F.lit(1)).alias("sets"))
    leading = per.groupBy("value").agg(F.max_by("component", F.struct("sets", "component")).alias("leading"), F.count(F.lit(1)).alias("parts"), F.sum("sets").alias("sets"))
    leading = ws.table(leading.where("parts > 1"), "leading")  # other values list one component only
    listed = listed.join(leading.drop("parts", "sets"), "value").withColumn("lead", F.expr("component = leading"))
    index = listed.where(f"{whole} * rest >= {2 * share} * n").select("value", _size_class(F.col("n")).alias("k"), F.col("cid").alias("b"), F.col("component").alias("of"), F.col("n").alias("nb"), F.col("rest").alias("restb"), F.col("lead").alias("leadb"))
    index = ws.table(index, "index")
    least, most = F.ceil(F.col("n") * share / 100), F.least(F.col("n"), F.floor(F.col("rest") * whole / share) - F.col("n"))
    probes = listed.select("value", F.col("cid").alias("a"), "component", F.col("n").alias("na"), F.col("rest").alias("resta"), "lead", least.alias("least"), most.alias("most")).where("least <= most")
    probes = probes.select("*", F.explode(F.sequence(_size_class(F.col("least")), _size_class(F.col("most")))).alias("k"))
    hot = index.groupBy("value", "k").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    hot = ws.table(hot, "hot")
    hot = with_small_side(ws.spark, hot, hot.count())
    index = index.join(hot, ["value", "k"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    probes = probes.join(hot, ["value", "k"], "left").select("*", F.explode(every).alias("block")).drop("blocks")
    fits = f"component <> of and (nb < na or nb = na and b < a) and nb <= most and {whole} * least(resta, restb) >= {share} * (na + nb)"
    met = [probes.where(one).join(index.where(other), ["value", "k", "block"]).where(fits).select("a", "b") for one, other in (("not lead", "true"), ("lead", "not leadb"))]
    return met[0].unionByName(met[1]).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """(cid, values) of ``texts`` (cid, d1, text)."""

    def apply(batches):
        for batch in batches:
            ids, digests, texts_ = batch.columns
            for a, b in bw.slices(texts_):
                sets = bw.shingles(*bw.words(*bw.column(texts_.slice(a, b - a))))
                good = [i for i, s in enumerate(sets) if _digest(s) == digests[a + i].as_py()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([a + i for i in good], pa.int64())), pa.array([sets[i].view(np.int64) for i in good], pa.list_(pa.int64()))], names=["cid", "values"])
        release_memory()

    return texts.mapInArrow(apply, "cid long, values array<long>")


def near_duplicates(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, group) for every row of ``docs`` (doc_id, text).

    ``group`` is one number for all rows that are linked, also where none has an id; null for rows without words.
    The result reads tables of ``ws``, which the caller may clear when it is done with it.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "minhash")
    docs = docs.select("doc_id", "text")
    sigs = ws.table(signatures(docs), "signatures")
    row = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "doc_id", "th")  # an id goes before none
    classes = sigs.where("n > 0").groupBy("d1", "d2").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = ws.table(classes.select("d1", "d2", F.col("row.doc_id").alias("id"), F.col("row.th").alias("th"), "n", "sketch"), "sets")
    # a class is called by its smallest id; one without, or with that of another class, takes a large number of its own, after all usual ids
    shared = ws.table(classes.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("id"), "shared")
    shared = with_small_side(spark, shared.withColumn("taken", F.lit(True)), shared.count())
    own = F.lit(1 << 62) + F.pmod(F.col("d1"), F.lit(1 << 61))
    named = classes.join(shared, "id", "left").withColumn("cid", F.when(F.col("id").isNull() | F.col("taken"), own).otherwise(F.col("id")))
    # the law tends to a binomial one from above: the value for very large sets holds for all beyond the table
    table = F.array(*[F.lit(need(n)) for n in range(1, 513)])
    least = F.when(F.col("n") <= 512, F.get(table, (F.col("n") - 1).cast("int"))).otherwise(F.lit(min(need(513), need(100_000)) - 1))
    named = ws.table(named.select("cid", "id", "th", "d1", "d2", "n", "sketch", least.alias("need")), "classes")
    ws.drop(classes)
    classes = named

    kept = classes.select("cid", "n", "need", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    common = kept.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = ws.table(common, "common")  # as a table of its own, so that the join below can split a hot value
    met = kept.join(common, "value")
    # hashes of one class alone are the rarest of all: they come first and list nothing; a sketch bounds what is collected
    per = met.groupBy("cid", "n", "need", "size").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("have"))
    alone = F.col("size") - F.size("have")
    first = F.greatest(F.col("size") - F.col("need") + 1 - alone, F.lit(0))
    popularity = F.aggregate("have", F.lit(0).cast("long"), lambda acc, x: acc + x["df"]) / F.col("size")
    lists = per.select("cid", "n", popularity.alias("popularity"), F.explode(F.slice("have", F.lit(1), first)).alias("x"))
    lists = ws.table(lists.select("cid", "n", "popularity", F.col("x.value").alias("value")), "lists")
    ws.drop(common)

    links = component = None

    def placed() -> DataFrame:
        if component is None:
            return lists.withColumn("component", F.col("cid"))
        of = component.select(F.col("node").alias("cid"), "component")
        return lists.join(of, "cid", "left").withColumn("component", F.coalesce("component", "cid"))

    for turn in range(len(HUBS) + 1):
        at = placed()
        hub = F.min(F.struct(F.expr(HUBS[min(turn, len(HUBS) - 1)]).alias("order"), F.col("cid").alias("hub"), F.col("component").alias("of"))).alias("h")
        mixed = at.groupBy("value").agg(hub, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        mixed = ws.table(mixed, "mixed")
        if component is not None and mixed.isEmpty():
            break  # every list lies in one component
        if turn < len(HUBS):
            pairs = at.join(mixed.select("value", F.col("h.hub").alias("b"), "h.of"), "value").where("component <> of").select(F.col("cid").alias("a"), "b").distinct()
            good = _overlap(pairs, classes).groupBy("a").agg(F.max_by("b", F.struct("est", "b")).alias("b"))
        else:
            left = ws.table(at.join(mixed.select("value"), "value", "left_semi").select("cid", "component").distinct(), "left")
            full = ws.table(_sets(fetch(docs, classes, left.select("cid"))).join(left, "cid"), "full")
            good = prefix_pairs(ws, full)
        good = ws.table(good, "candidates")
        texts = ws.table(fetch(docs, classes, good.select(F.explode(F.array("a", "b")).alias("cid")).distinct()), "texts")
        found = ws.table(verify(ws, good, texts), "links")
        for done in (mixed, good, texts):
            ws.drop(done)
        links = found if links is None else links.unionByName(found)
        component = connected_components(ws, links)

    ws.drop(lists)
    named = classes.select("d1", "d2", "cid", "id").join(component.select(F.col("node").alias("cid"), "component"), "cid", "left")
    named = ws.table(named.select("d1", "d2", "cid", "id", F.coalesce("component", "cid").alias("group")), "groups")
    # a group's number is its smallest id, unless classes with numbers of their own take part
    odd = named.where(F.col("cid") >= 1 << 62).select("group").distinct()
    odd = ws.table(named.join(odd, "group", "left_semi").groupBy("group").agg(F.min("id").alias("smallest"), F.lit(True).alias("odd")), "odd")
    named = named.select("d1", "d2", "group").join(with_small_side(spark, odd, odd.count()), "group", "left")
    named = named.select("d1", "d2", "group", F.when(F.col("odd"), F.col("smallest")).otherwise(F.col("group")).alias("component"))
    out = sigs.drop("sketch").join(named, ["d1", "d2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("th").alias("text_hash"), "group")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", "group")
