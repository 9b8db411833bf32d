"""Conversation prefix trie, built level by level.

Conversations are sequences of turns (role, text; null counts as empty). Each distinct sequence of the first d turns
is a node of depth d; the root has none. A node is called by the smallest conv_id among its members, the conversations that
start with it; (depth, conv_id) names it. Level d groups the conversations that are still live by (parent node, next
turn) and gives the group its smallest conv_id. A group of one is live no longer: from there its turns are a
chain that nobody shares, written as it stands. So the number of levels is the depth to which any two conversations agree, not the
length of the longest. Then joins from the deepest level upwards add leaves and savings to the parents.

Turns are told apart by SHA-256 of role and text, which travels in place of them. A live conversation carries the
next STEPS turns and fetches more when they are used up. Turns are numbered by ranges of (conv_id, turn), so
a conversation of very many turns is no single task's. Groups are counted before the shuffle, and what goes back to the
conversations is a join that Spark splits where it is skewed. The ids that end at a node are joined in chunks of CHUNK
ids, in order, and hashed as a stream: SHA-256 has no other way for one node.

Turns are ordered by turn (null first), then role and text; rows without conv_id belong to no conversation; repeated
rows are turns as often as they stand there. Extra columns are not read. Long texts are hashed once, in place.
No conversations, no nodes, not even the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from svloom.llm.shared import Workspace, with_small_side

STEPS, CHUNK = 8, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(ws: Workspace, conversations: DataFrame) -> DataFrame:
    """(conv_id, d, key, chars): turn d (from 1) of each conversation, what tells it apart, and its text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    # ranks by ranges: whole texts order only turns of equal number, so their first bytes deal them well enough
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first()).sortWithinPartitions("conv_id", *order)
    dealt = dealt.select("conv_id", "key", F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    dealt = ws.table(dealt, "ordered")
    sizes = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("conv_id", "range", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return dealt.join(sizes, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).cast("long").alias("d"), "key", "chars")


def rebuilt(conversations: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_ids, turns) where conversation c starts with the first h turns of conversation c - c % 100, h = crc32(c) % 6."""
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).alias("h")
    heads = ids.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    first = turns.where("d <= 5").select(F.col("conv_id").alias("base"), "d", "key", "chars")
    borrowed = heads.join(first, "base").where("d <= h").select("conv_id", "d", "key", "chars")
    had = borrowed.groupBy("conv_id").agg(F.max("d").alias("had"))
    own = turns.select("*", h).where("d > h").join(had, "conv_id", "left")
    own = own.select("conv_id", (F.col("d") - F.col("h") + F.coalesce("had", F.lit(0))).alias("d"), "key", "chars")
    return ids, borrowed.unionByName(own)


def _hash_of_members(ws: Workspace, ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of ``ends`` (depth, node, conv_id): members that end at a shared node."""
    chunk = F.floor(F.col("conv_id") / CHUNK)
    parts = ends.groupBy("depth", "node", chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def apply(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
                if at == (depth, node):
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(ids.encode())
            yield _rows(done)
        yield _rows([(*at, state.hexdigest())] if at else [])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "node", "ends_sha256"])

    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "chunk").mapInArrow(apply, "depth long, node long, ends_sha256 string")


def _turn(live: Column, depth: int) -> Column:
    return F.get(live, F.lit((depth - 1) % STEPS))


def trie(ids: DataFrame, turns: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Nodes of the conversations ``ids`` (conv_id: distinct) with ``turns`` (conv_id, d: from 1 without gaps, key, chars).

    The result reads tables of ``ws``, which the caller may clear when it is done with it.
    """
    spark = ids.sparkSession
    ws = ws or Workspace(spark, "trie")
    turns = ws.table(turns.repartition("conv_id").sortWithinPartitions("d"), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("d").alias("size"))
    everyone = ws.table(ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "conversations")
    root = everyone.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), "node", F.lit(None).cast("long").alias("parent"), "n", F.lit(0).cast("long").alias("chars"))
    levels = [ws.table(root, "level")]  # shared nodes of each depth; the root counts as one
    least = F.lit(everyone.agg(F.min("conv_id")).first()[0]).cast("long").alias("node")
    live = everyone.where("size > 0").select("conv_id", "size", least.alias("parent"))
    chains, ends = [], [everyone.where("size = 0").select(F.lit(0).cast("long").alias("depth"), least, "conv_id")]
    depth = 0
    while True:
        depth += 1
        if (depth - 1) % STEPS == 0:  # fetch the next turns
            block = turns.where((F.col("d") >= depth) & (F.col("d") < depth + STEPS)).groupBy("conv_id")
            block = block.agg(F.sort_array(F.collect_list(F.struct("d", "key", "chars"))).alias("next"))
            live = ws.table(live.select("conv_id", "size", "parent").join(block, "conv_id"), "live")
        here = live.select("conv_id", "size", "parent", "next", _turn(F.col("next"), depth)["key"].alias("key"), _turn(F.col("next"), depth)["chars"].alias("chars"))
        groups = here.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min("chars").alias("chars"))
        groups = ws.table(groups, "groups")
        shared = groups.where("n > 1")
        level = ws.table(shared.select(F.lit(depth).cast("long").alias("depth"), "node", "parent", "n", "chars"), "level")
        chains.append(groups.where("n = 1").select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("alone"), "parent"))
        count = level.count()
        if not count:
            break
        levels.append(level)
        members = here.join(with_small_side(spark, shared.select("parent", "key", "node"), count), ["parent", "key"])
        members = ws.table(members.select("conv_id", "size", F.col("node").alias("parent"), "next"), "live")
        ends.append(members.where(F.col("size") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("node"), "conv_id"))
        live = members.where(F.col("size") > depth)

    # chains: every turn from where a conversation goes on alone
    alone = chains[0]
    for more in chains[1:]:
        alone = alone.unionByName(more)
    alone = ws.table(alone, "alone")
    none, last = F.lit(EMPTY), F.sha2(F.col("conv_id").cast("string"), 256)
    tail = turns.select("conv_id", "d").join(alone, "conv_id").where("d >= alone").join(everyone, "conv_id")
    is_last = F.col("d") == F.col("size")
    tail = tail.select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("alone"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(is_last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(is_last, last).otherwise(none).alias("ends_sha256"),
    )

    # shared nodes, the deepest first: each level hands its sums to its parents
    single = ws.table(alone.groupBy((F.col("alone") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("single")), "single")
    below, summed = None, []
    for level in reversed(levels):
        at = level.join(single, ["depth", "node"], "left").withColumn("single", F.coalesce("single", F.lit(0)))
        if below is None:
            at = at.select("*", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        else:
            up = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            at = at.join(up, "node", "left").fillna(0, ["below", "leaves", "saved"])
        children = F.col("single") + F.col("below")
        at = at.select("depth", "node", "parent", "n", children.alias("n_children"), F.greatest(F.col("single") + F.col("leaves"), F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.col("chars") + F.col("saved")).alias("saved_tokens"))
        below = ws.table(at, "summed")
        summed.append(below)
    nodes, finals = summed[0], ends[0]
    for more in summed[1:]:
        nodes = nodes.unionByName(more)
    for more in ends[1:]:
        finals = finals.unionByName(more)
    hashes = ws.table(_hash_of_members(ws, finals), "ends")
    nodes = nodes.join(hashes, ["depth", "node"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
    return nodes.unionByName(tail)


def prefix_trie(conversations: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """Trie of ``conversations`` (conv_id, turn, role, text) as they stand."""
    ws = ws or Workspace(conversations.sparkSession, "trie")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return trie(ids, numbered_turns(ws, conversations), ws)
