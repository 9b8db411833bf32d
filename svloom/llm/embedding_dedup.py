"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors form a class and one of a class is hashed. A hash rotates a vector by HADAMARDS rounds of random
signs and a fast Hadamard transform (after padding to a power of two) and takes the signed axis nearest to it.
A table's bucket is the combination of some hashes; their number grows with the logarithm of the number of
vectors, so that a bucket holds few vectors by chance, and with it grow the probes and tables, so that the recall
stays. In each table a vector stands in its own bucket and in the next best ones: those that replace one or two
axes by the next largest, least loss first. Two vectors meet where these sets have a bucket in common. What is
shuffled is a vector's copies, so their number is kept small: few wide buckets, searched by matrix products.

A copy has the vector's components as 16-bit numbers. The cosine of two such vectors is known but for a bound that
follows from the rounding; pairs within that bound of MIN_COSINE, which are few, are compared by their own vectors in
double precision. Any other pair counts in the first table and bucket in which it meets, which follows from both sides'
probes, so it is never emitted: what leaves a bucket is a count for each vector and a spanning forest of its links.

Buckets are dealt to groups of about CELL rows; a bucket of more rows is a group by itself, one of more than BLOCK
components is cut into blocks, and each pair of blocks is a group, so no task holds an unbounded bucket. A pair at
cosine 0.9 is missed with a probability of about 1e-5 (see PLANS; measured in tests/llm), closer pairs far less.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without vec_id, link with
nothing and keep a row of their own: n_links 0, component_id their own vec_id, kept true. Vectors of different
lengths never link. Repeated rows (the same vec_id and vector) are one vector with as many rows; of one vec_id
with different vectors each row counts its own links. Extra columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from svloom.llm.shared import Workspace, connected_components, with_small_side

HADAMARDS = 3
#: (most vectors, rotations, probes, tables); the latter three make the recall.
PLANS = [(1 << 20, 1, 8, 1), (1 << 27, 2, 24, 2), (1 << 62, 3, 32, 4)]
MIN_COSINE = 0.9
#: Components of a block's vectors; rows of a group of buckets; rows that are compared at once, and with so many others.
BLOCK, CELL, TILE, WIDE = 1 << 22, 2048, 256, 2048
#: Of each rotation so many axes are tried; probes replace at most two axes.
AXES = 8
#: Largest component of a copy.
STEPS = (1 << 15) - 1
#: Rows of one Arrow batch that leave a map task: some tens of MB.
SPREAD = 20_000


def plan(vectors: int) -> tuple[int, int, int]:
    return next(x[1:] for x in PLANS if vectors <= x[0])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probes(x: np.ndarray, rotations: int, count: int, tables: int, seed: int = 17) -> np.ndarray:
    """(vectors, tables, count) bucket numbers of unit vectors, ascending in each table."""
    m, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    tried = min(AXES, width)
    padded = np.zeros((m, width))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, dim])
    changes = [c for c in itertools.product(range(tried), repeat=rotations) if sum(c) < AXES and sum(map(bool, c)) <= 2]
    out = np.empty((m, tables, min(count, len(changes))), np.int64)
    for t in range(tables):
        axes, loss = [], []
        for _ in range(rotations):
            y = padded
            for _ in range(HADAMARDS):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argsort(-size, 1, "stable")[:, :tried]
            best = np.take_along_axis(size, top, 1)
            axes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            loss.append((best[:, :1] - best) ** 2)
        cost = np.stack([sum(x[:, k] for x, k in zip(loss, c)) for c in changes], 1)
        code = np.stack([sum(x[:, k] * (2 * width) ** i for i, (x, k) in enumerate(zip(axes, c))) for c in changes], 1)
        out[:, t] = np.sort(np.take_along_axis(code, np.argsort(cost, 1, "stable")[:, : out.shape[2]], 1), 1)
    return out


def meet(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the two rows of probes have one in common, for each pair of rows."""
    out = np.zeros(len(p), bool)
    for k in range(p.shape[1]):
        left = np.flatnonzero(~out)
        out[left] = (p[left, k, None] == q[left]).any(1)
    return out


def _unit(vectors: pa.Array, rows: np.ndarray) -> np.ndarray:
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _shape(how: tuple[int, int, int], dim: int) -> tuple[int, int, str]:
    """(tables, probes of each, type of a bucket number) for vectors of ``dim`` components."""
    rotations, count, tables = how
    width = 1 << max(1, (dim - 1).bit_length())
    ways = len([c for c in itertools.product(range(min(AXES, width)), repeat=rotations) if sum(c) < AXES and sum(map(bool, c)) <= 2])
    return tables, min(count, ways), next((k for k, bits in (("<i2", 15), ("<i4", 31)) if (2 * width) ** rotations <= 1 << bits), "<i8")


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as whole numbers of 16 bits, the largest component of each being STEPS."""
    return np.rint(x * (STEPS / np.abs(x).max(1, keepdims=True))).astype("<i2")


def restored(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of rounded ones and a bound of each one's distance from the vector it was.

    Half a step of each component lies between them before they get length 1, and at most as much again after it.
    """
    x = q.astype(float)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / size, np.sqrt(x.shape[1]) / size[:, 0]


def _spread(classes: DataFrame, how: tuple[int, int, int], full: bool) -> DataFrame:
    """A row (dim, tab, bucket) for each bucket in which each vector stands; if ``full``, with key, weight, probes and q, the vector ``rounded``.

    ``probes`` are the buckets before this one, in this table and in those before it: all that tells where a pair met first.
    """
    rotations, count, tables = how
    names = ["dim", "tab", "bucket"] + ["key", "weight", "probes", "q"] * full

    def apply(batches):
        for batch in batches:
            keys, weights, vectors = batch.columns
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                _, wide, kind = _shape(how, int(dim))
                each = tables * wide
                for some in np.array_split(at, max(1, len(at) * each // SPREAD)):
                    x = _unit(vectors, some)
                    p = probes(x, rotations, count, tables)
                    n = len(some)
                    flat = p.reshape(n, each)
                    arrays = [pa.array(np.full(n * each, dim, np.int32)), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), p.shape[2]), n)), pa.array(flat.reshape(-1))]
                    if full:
                        who = pa.array(np.repeat(some, each))
                        size = np.dtype(kind).itemsize
                        blobs = [r.tobytes() for r in flat.astype(kind)]
                        seen = pa.array([b[: k * size] for b in blobs for k in range(each)], pa.binary())
                        copies = pa.array([q.tobytes() for q in rounded(x)], pa.binary())
                        arrays += [keys.take(who), weights.take(who), seen, copies.take(pa.array(np.repeat(np.arange(n), each)))]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return classes.select("key", "weight", "v").mapInArrow(apply, "dim int, tab int, bucket long" + ", key long, weight long, probes binary, q binary" * full)


def _seen(blobs: list[bytes], how: tuple[int, int, int], dim: int) -> np.ndarray:
    """(vectors, tables, probes) from their bytes; buckets that a row doesn't carry are the largest number."""
    tables, wide, kind = _shape(how, dim)
    out = np.full((len(blobs), tables * wide), np.iinfo(np.int64).max)
    sizes = np.array([len(b) for b in blobs]) // np.dtype(kind).itemsize
    out[np.arange(tables * wide)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(blobs), kind)
    return out.reshape(len(blobs), tables, wide)


def _tiles(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, end) of runs of ascending ``bucket`` numbers: rows from ``from`` to ``to`` have their buckets' other rows up to ``end``.

    A run is one bucket's TILE rows, or some small buckets of so many rows together.
    """
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
    ends = np.append(starts[1:], len(bucket))
    tiles, at = [], 0
    for k, end in enumerate(ends.tolist()):
        if k + 1 < len(ends) and ends[k + 1] - at <= TILE:
            continue
        tiles += [(a, min(a + TILE, end), end) for a in range(at, end, TILE)]
        at = end
    return tiles


def _compare(how: tuple[int, int, int]):
    def apply(table: pa.Table) -> pa.Table:
        """Counts and a spanning forest of the links first met in the buckets of one group, between its blocks i and j; ``n`` is null for pairs in doubt."""
        table = table.combine_chunks()
        dim, tab, i, j = (table.column(c)[0].as_py() for c in ("dim", "tab", "i", "j"))
        table = table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in ("block", "bucket")])))
        bucket, key, weight, block = (table.column(c).to_numpy() for c in ("bucket", "key", "weight", "block"))
        x, off = restored(np.frombuffer(b"".join(table.column("q").to_pylist()), "<i2").reshape(len(key), dim))
        p = _seen(table.column("probes").to_pylist(), how, dim)
        small, least = x.astype(np.float32), MIN_COSINE - 2 * off.max() - 1e-6 * dim
        links, parent, edges, doubts = np.zeros(len(key), np.int64), {}, [], []

        def find(a: int) -> int:
            while (up := parent.get(a, a)) != a:
                parent[a] = parent.get(up, up)
                a = up
            return a

        def count(a: np.ndarray, b: np.ndarray) -> None:
            fresh = (bucket[a] == bucket[b]) & (key[a] != key[b])
            a, b = a[fresh], b[fresh]
            for t in range(tab):
                fresh = ~meet(p[a, t], p[b, t])
                a, b = a[fresh], b[fresh]
            at = bucket[a][:, None]
            fresh = ~meet(np.where(p[a, tab] < at, p[a, tab], -1), np.where(p[b, tab] < at, p[b, tab], -2))
            a, b = a[fresh], b[fresh]
            over = np.einsum("rd,rd->r", x[a], x[b]) - MIN_COSINE
            doubt = np.abs(over) <= off[a] + off[b] + 1e-12
            doubts.extend(zip(key[a[doubt]].tolist(), key[b[doubt]].tolist()))
            close = (over > 0) & ~doubt
            a, b = a[close], b[close]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            for u, w in zip(key[a].tolist(), key[b].tolist()):
                ru, rw = find(u), find(w)
                if ru != rw:
                    parent[rw] = ru
                    edges.append((u, w))

        middle = len(key) if i == j else int((block == i).sum())  # two blocks are of one bucket, so the rows of i come first
        for first, to, end in _tiles(bucket[:middle]):
            # each row meets those behind it in its bucket, or all of the other block
            start, last = (first, end) if i == j else (middle, len(key))
            for begin in range(start, last, WIDE):
                some = small[begin : min(begin + WIDE, last)]
                near = small[first:to] @ some.T >= least
                if not near.any():
                    continue
                a, b = np.divmod(np.flatnonzero(near), len(some))
                a, b = a + first, b + begin
                if i == j:
                    ahead = a < b
                    a, b = a[ahead], b[ahead]
                for k in range(0, len(a), 1 << 16):
                    count(a[k : k + (1 << 16)], b[k : k + (1 << 16)])
        one = np.flatnonzero(links)
        return pa.table(
            {
                "a": pa.array(key[one].tolist() + [e[0] for e in edges + doubts], pa.int64()),
                "b": pa.array([None] * len(one) + [e[1] for e in edges + doubts], pa.int64()),
                "n": pa.array(links[one].tolist() + [0] * len(edges) + [None] * len(doubts), pa.int64()),
            }
        )

    return apply


def _verified(doubts: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``doubts`` whose vectors have the cosine, by doubles, with their weights wa and wb."""
    v = classes.withColumn("v", F.transform("v", lambda x: x.cast("double"))).withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x))))
    v = v.withColumn("v", F.transform("v", lambda x: x / F.col("most")))  # no square is too large or too small
    of = lambda c: v.select(F.col("key").alias(c), F.col("weight").alias(f"w{c}"), F.col("v").alias(f"v{c}"))
    met = doubts.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, w: u * w), F.lit(0.0), lambda s, u: s + u)
    return met.where(dot("va", "vb") >= MIN_COSINE * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))).select("a", "b", "wa", "wb")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", how: tuple[int, int, int] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; ``how``: rotations, probes and tables, by default those of PLANS."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "embeddings")
    v = F.col(vector_column)
    zero = F.lit(0).cast(vectors.schema[vector_column].dataType.elementType)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != zero) & (F.size(v) > 0)
    same = F.transform(v, lambda x: F.when(x == zero, zero).otherwise(x))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(F.col(id_column).isNotNull() & F.coalesce(finite, F.lit(False)), same).alias("v"))
    rows = rows.withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
    # ids are counted, not rows: a repeated row is no other vector; one shuffle of the vectors serves both groupings
    ids = rows.where("v is not null").repartition("h1", "h2").groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))
    classes = ws.table(ids.groupBy("h1", "h2").agg(F.min("id").alias("key"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "classes")
    count = classes.count()
    how = how or plan(count)
    cells = max(1, count * how[1] // CELL)
    sizes = _spread(classes, how, False).groupBy("dim", "tab", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = ws.table(sizes, "sizes")
    # most buckets share a group with others; those over CELL are groups by themselves
    large = sizes.where(F.col("size") > CELL).withColumn("blocks", F.ceil(F.col("size") * F.col("dim") / BLOCK).cast("int")).drop("size")
    stand = _spread(classes, how, True)
    if how[0] > 1:  # here most buckets hold one vector
        stand = stand.join(sizes.drop("size"), ["dim", "tab", "bucket"], "left_semi")
    stand = stand.join(with_small_side(spark, large, large.count()), ["dim", "tab", "bucket"], "left")
    at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    stand = stand.withColumn("block", F.coalesce(at, F.lit(0)))
    stand = stand.withColumn("cell", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("bucket"), F.lit(cells))).otherwise(-1 - F.col("bucket")))
    other = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    paired = stand.select("*", F.explode(other).alias("g")).select("dim", "tab", "cell", "g.i", "g.j", "bucket", "block", "key", "weight", "probes", "q")
    found = ws.table(paired.groupBy("dim", "tab", "cell", "i", "j").applyInArrow(_compare(how), "a long, b long, n long"), "found")
    verified = ws.table(_verified(found.where("n is null"), classes), "verified")
    more = verified.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("wb").alias("n")), F.struct(F.col("b").alias("key"), F.col("wa").alias("n")))).alias("x")).select("x.*")
    counts = found.where("b is null").select(F.col("a").alias("key"), "n").unionByName(more).groupBy("key").agg(F.sum("n").alias("n"))
    component = connected_components(ws, found.where("n = 0").select("a", "b").unionByName(verified.select("a", "b")))
    named = classes.select("h1", "h2", "key", "weight").join(counts, "key", "left").join(component.withColumnRenamed("node", "key"), "key", "left")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "key").alias("component_id"))
    out = rows.drop("v").join(named, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
