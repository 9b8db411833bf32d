"""Suffix-array dedup: bytes of a document covered by a WIDTH-byte string that also starts in a document with a smaller doc_id.

Suffixes are sorted in two stages. Only suffixes smaller than their successors are sorted directly; all others are induced
by one scan over the buckets of first bytes, since a suffix that is larger than its successor stands in its bucket in the order of
the successors. Adjacent common prefixes then show the groups of equal strings (``suffix_array``, ``common_prefixes``).

A corpus is no single array, so strings are dealt to shards first. Each WIDTH-byte window is called by the least hash among its
KGRAM-byte strings, which depends on nothing but the window; consecutive windows with one hash form a run (RUN windows
at most), and a run's bytes are some 67 for 18 windows. Hashes that only one document holds cannot belong to a repeated
string: hashes of all bundles (some BUNDLE bytes of documents) are counted in shards by value, and only runs whose hash stands in two
documents go on, to the shard of their hash, where they form one text with a suffix array of its own. Equal strings always meet in one
shard. There each group of equal windows finds its smallest doc_id, and what is removed goes back to its bundle as ranges.
A hash that more than HOT runs hold is no shard's: its windows are grouped one by one, by their own bytes, with partial
minima before the shuffle, and joined to the smallest doc_id found; so passages that very many documents share stay spread.

Null texts are empty; documents without doc_id neither remove nor lose anything (null is not smaller). Rows of one doc_id don't remove
from each other; each row is judged by itself. Texts under WIDTH bytes lose nothing. Repeated rows get the same result. A
document is held whole by one task, at some 10 bytes a byte; hashing and sorting work on slices. Extra columns are not read;
empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from svloom.llm import bytewords as bw
from svloom.llm.shared import Workspace, release_memory, with_small_side

U = np.uint64
WIDTH, KGRAM, RUN = 50, 16, 64
#: Bytes of a bundle; anchors of a counting shard; bytes of a sorting shard; runs of one hash in a sorting shard.
BUNDLE, COUNTED, SORTED, HOT = 1 << 20, 1 << 20, 1 << 20, 1 << 15
#: Bytes of a name that travel to its counting shard; a shard is of bounded size, so names of one shard hardly ever agree in them by chance, and if so, runs only travel in vain.
SENT = 4
SLICE = 1 << 16
NOT_SHARED, SHARED, IS_HOT = 0, 1, 2
_CODE = np.random.default_rng(0x5AFE).integers(0, 2**64, 256, dtype=U)


# --- one text ---


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the text."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    for have in (1, 2, 4):
        x = (x[:-have] << U(8 * have)) | x[have:]
    return x[: len(data)]


def suffix_array(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Starts of the suffixes of ``data`` (uint8) in order; with ``depth`` the order of more than ``depth`` equal bytes is open."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    words = _words(data)
    # smaller than its successor: the next byte that differs is larger; the last suffix is larger than the empty one
    change = np.flatnonzero(data[1:] != data[:-1])
    up = np.concatenate([data[change] < data[change + 1], [False]])
    smaller = np.repeat(up, np.diff(np.concatenate([[-1], change, [n - 1]])))
    at = np.int32 if n < 1 << 31 else np.int64

    first = np.flatnonzero(smaller)[::-1].astype(at)  # of equal padded bytes the shorter suffix goes first
    order = first[np.argsort(words[first], kind="stable")]
    same = words[order[1:]] == words[order[:-1]] if len(order) else np.zeros(0, bool)
    offset = 8
    while same.any() and (depth is None or offset < depth) and offset < n:
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        places = np.flatnonzero(tied)
        group = np.cumsum(~np.concatenate([[False], same]))[places]
        rows = order[places]
        key = np.where(rows + offset < n, words[np.minimum(rows + offset, n - 1)], U(0))
        by = np.lexsort((key, group))
        order[places] = rows[by]
        key, group = key[by], group[by]
        still = np.zeros(len(order), bool)
        still[places[1:]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        if depth is None:  # beyond the text's end nothing is open
            still[places] &= order[places] + offset < n
        same = still[1:]
        offset += 8

    # bucket scan: induced suffixes first, then those sorted directly
    sizes = np.bincount(data[order], minlength=256)
    direct = np.split(order, np.cumsum(sizes)[:-1])
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(of: np.ndarray, byte: int) -> np.ndarray:
        """Deals the predecessors that are larger than their successors in ``of``; gives back those of the same byte."""
        before = of[of > 0] - 1
        before = before[~smaller[before]]
        value = data[before]
        later = before[value > byte]
        for b, part in _by_bucket(data[later], later):
            induced[b].append(part)
        return before[value == byte]

    induced[data[n - 1]].append(np.array([n - 1], at))
    for byte in range(256):
        now = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, at)
        while len(now):
            out.append(now)
            now = induce(now, byte)
        if len(direct[byte]):
            out.append(direct[byte])
            induce(direct[byte], byte)
    return np.concatenate(out)


def _by_bucket(byte: np.ndarray, rows: np.ndarray):
    if not len(rows):
        return
    order = np.argsort(byte, kind="stable")
    byte, rows = byte[order], rows[order]
    cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        yield int(byte[a]), rows[a:b]


def common_prefixes(data: np.ndarray, suffixes: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in the order, ``limit`` at most; 0 for the first."""
    n, words = len(data), _words(data)
    out = np.zeros(len(suffixes), np.int64)
    rows = np.arange(1, len(suffixes))
    for offset in range(0, limit, 8):
        a, b = suffixes[rows] + offset, suffixes[rows - 1] + offset
        room = np.minimum(n - np.maximum(a, b), 8)
        inside = room > 0
        rows, a, b, room = rows[inside], a[inside], b[inside], room[inside]
        differ = words[a] ^ words[b]
        equal = np.full(len(rows), 8)
        some = differ != 0
        # leading zero bytes of a 64-bit number: frexp is exact enough for its upper half, then its lower
        high, low = (differ[some] >> U(32)).astype(float), (differ[some] & U(0xFFFFFFFF)).astype(float)
        bits = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])
        equal[some] = (64 - bits) // 8
        equal = np.minimum(equal, room)
        out[rows] += equal
        rows = rows[equal == 8]
    return np.minimum(out, limit)


def smallest_of_equal(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of ``starts`` the least ``owner`` among those whose WIDTH bytes are the same; ``data`` goes on that far."""
    place = np.full(len(data), -1, np.int64)
    place[starts] = np.arange(len(starts))
    suffixes = suffix_array(data, WIDTH)
    rows = place[suffixes]
    suffixes, rows = suffixes[rows >= 0], rows[rows >= 0]
    groups = np.cumsum(common_prefixes(data, suffixes, WIDTH) < WIDTH) - 1
    out = np.empty(len(starts), np.int64)
    if len(rows):
        first = np.flatnonzero(np.diff(groups, prepend=-1))
        least = np.minimum.reduceat(owner[rows], first)
        out[rows] = np.repeat(least, np.diff(np.append(first, len(rows))))
    return out


# --- a bundle of documents ---


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * U(0x9E3779B97F4A7C15) + y * U(0xBF58476D1CE4E5B9)
    return z ^ (z >> U(29))


def window_names(data: np.ndarray) -> np.ndarray:
    """For each WIDTH-byte window a number that its least hash of a KGRAM-byte string gives."""
    if len(data) < WIDTH:
        return np.zeros(0, U)
    x = _CODE[data]
    for have in (1, 2, 4, 8):
        x = _join(x[:-have], x[have:])
    x = bw.mix(x)
    grams, have = WIDTH - KGRAM + 1, 1
    while 2 * have <= grams:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return bw.mix(np.minimum(x[: len(x) - (grams - have)], x[grams - have :]))  # least values are not even, so mixed again


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows) of all runs in the documents of ``data`` that ``offsets`` cut."""
    names, starts, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, max(len(data) - WIDTH + 1, 0), SLICE):
        name = window_names(data[low : low + SLICE + WIDTH - 1])
        at = np.arange(low, low + len(name))
        document = np.searchsorted(offsets, at, "right")
        inside = at + WIDTH <= offsets[np.minimum(document, len(offsets) - 1)]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (document[1:] != document[:-1])
        begins = np.flatnonzero(new & inside)
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(name)]])[np.searchsorted(np.flatnonzero(new), begins)]
        ends = np.minimum(at[0] + ends, offsets[document[begins]] - WIDTH + 1) - at[0]
        long = np.maximum((ends - begins + RUN - 1) // RUN, 1)
        first = np.repeat(begins, long) + RUN * (np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long))
        names.append(name[first]), starts.append(first + low), counts.append(np.minimum(np.repeat(ends, long) - first, RUN))
    return np.concatenate(names), np.concatenate(starts), np.concatenate(counts)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, doc_ids) of a bundle."""
    sizes = np.frombuffer(row["sizes"], "<i8")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["bytes"]), np.uint8) if sizes.sum() else np.zeros(0, np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(row["ids"], "<i8")


def bundles(docs: DataFrame) -> DataFrame:
    """(bundle, bytes, sizes, ids, raw, known): documents of about BUNDLE bytes together, or one longer, compressed.

    ``known``: whether they have ids; those without travel apart, as nothing is compared with them.
    """

    def apply(batches):
        for batch in batches:
            for known in (True, False):
                part = batch.filter(batch.column(0).is_valid() if known else batch.column(0).is_null())
                texts = part.column(1)
                for a, b in bw.slices(texts, BUNDLE):
                    data, offsets = bw.column(texts.slice(a, b - a))
                    packed = zstandard.ZstdCompressor(level=6).compress(data.tobytes()) if len(data) else b""
                    ids = part.column(0).slice(a, b - a).fill_null(0).to_numpy().astype("<i8").tobytes()
                    rows = [[packed], [np.diff(offsets).astype("<i8").tobytes()], [ids], [len(data)], [known]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))], names=["bytes", "sizes", "ids", "raw", "known"])
        release_memory()

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "bytes binary, sizes binary, ids binary, raw long, known boolean")
    return made.select(F.monotonically_increasing_id().alias("bundle"), "*")


def _shards(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)


def _bits(count: int, each: int) -> int:
    return max(0, (-(-count // each) - 1).bit_length())


def _cut(keys: np.ndarray):
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]) if a < b]


def _rows(columns: list[list], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)


def shared_names(bundled: DataFrame, bits: int) -> DataFrame:
    """(bundle, shard, flags): of each distinct name of a bundle, in order, whether other bundles hold it too, and whether it is hot."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets, _ = _unpack(row)
                names, counts = np.unique(runs(data, offsets)[0], return_counts=True)
                of = _shards(names, bits)
                # byte planes of sorted names: the upper ones compress
                sent = (names >> U(max(0, 64 - 8 * SENT - bits))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, SENT - 1 :: -1]
                counts = np.minimum(counts, 255).astype(np.uint8)
                cuts = _cut(of)
                packed = [zstandard.ZstdCompressor(level=1).compress(np.concatenate([sent[a:b].T.ravel(), counts[a:b]]).tobytes()) for a, b in cuts]
                yield _rows([[int(of[a]) for a, _ in cuts], [row["bundle"]] * len(cuts), [b - a for a, b in cuts], packed], ["shard", "bundle", "size", "names"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
        release_memory()

    def count(batches):
        for shard, rows in _grouped(batches):
            ends = np.cumsum([r["size"] for r in rows])
            low, counts = np.zeros((ends[-1], 8), np.uint8), np.empty(ends[-1], np.int64)
            for r, b in zip(rows, ends):
                planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["names"]), np.uint8).reshape(SENT + 1, -1)
                low[b - r["size"] : b, SENT - 1 :: -1], counts[b - r["size"] : b] = planes[:SENT].T, planes[SENT]
            names = low.view("<u8")[:, 0]
            order = np.argsort(names, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]])) if len(order) else order
            sizes = np.diff(np.append(first, len(order)))
            total = np.add.reduceat(counts[order], first) if len(order) else counts
            flag = np.where(total > HOT, IS_HOT, np.where(sizes > 1, SHARED, NOT_SHARED)).astype(np.uint8)
            flags = np.empty(len(order), np.uint8)
            flags[order] = np.repeat(flag, sizes)
            for at in range(0, len(rows), 1000):
                part = range(at, min(at + 1000, len(rows)))
                yield _rows([[rows[i]["bundle"] for i in part], [shard] * len(part), [flags[ends[i] - rows[i]["size"] : ends[i]].tobytes() for i in part]], ["bundle", "shard", "flags"], [pa.int64(), pa.int64(), pa.binary()])
        release_memory()

    sent = bundled.mapInArrow(send, "shard long, bundle long, size long, names binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, "bundle long, shard long, flags binary")


def _grouped(batches):
    """(key, rows) of consecutive rows with one value in the first column."""
    at, rows = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for a, b in _cut(keys):
            if rows and keys[a] != at:
                yield at, rows
                rows = []
            at = int(keys[a])
            rows.extend(batch.slice(a, b - a).to_pylist())
    if rows:
        yield at, rows


RUNS = "shard long, bundle long, runs binary"


def _pack_runs(starts: np.ndarray, counts: np.ndarray, owners: np.ndarray, data: np.ndarray) -> bytes:
    parts = [np.array([len(starts)], "<i8"), starts.astype("<i8"), owners.astype("<i8"), counts.astype(np.uint8), data]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts))


def _unpack_runs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(first windows in the bundle, numbers of windows, doc_ids, bytes) of runs."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    starts, owners = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    return starts, np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(np.int64), owners, raw[8 + 17 * n :]


def shared_runs(bundled: DataFrame, flags: DataFrame, bits: int) -> DataFrame:
    """RUNS: of each bundle and sorting shard the runs whose names two documents hold; hot ones have no shard."""
    texts = bundled.select("bundle", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("flags"), "bytes", "sizes", "ids")
    none = F.lit(None).cast("binary")
    answers = flags.select("bundle", "shard", "flags", none.alias("bytes"), none.alias("sizes"), none.alias("ids"))

    def apply(batches):
        for bundle, rows in _grouped(batches):
            data, offsets, ids = _unpack(rows[0])
            name, start, count = runs(data, offsets)
            flag = np.frombuffer(b"".join(r["flags"] for r in rows[1:]), np.uint8)
            distinct, which = np.unique(name, return_inverse=True)
            document = np.searchsorted(offsets, start, "right") - 1
            low, high = np.full(len(distinct), 1 << 62), np.full(len(distinct), -1)
            np.minimum.at(low, which, document), np.maximum.at(high, which, document)
            flag = np.where((flag == NOT_SHARED) & (low < high), SHARED, flag)[which]
            keep = np.flatnonzero(flag != NOT_SHARED)
            of = np.where(flag[keep] == IS_HOT, -1, _shards(name[keep], bits))
            order = np.argsort(of, kind="stable")
            keep, of = keep[order], of[order]
            out: list[list] = [[], [], []]
            for a, b in _cut(of):
                rows_ = keep[a:b]
                s, c = start[rows_], count[rows_]
                size = c + WIDTH - 1
                every = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
                for column, value in zip(out, [None if of[a] < 0 else int(of[a]), bundle, _pack_runs(s, c, ids[document[rows_]], data[every])]):
                    column.append(value)
            yield _rows(out, ["shard", "bundle", "runs"], [pa.int64(), pa.int64(), pa.binary()])
        release_memory()

    met = texts.unionByName(answers).repartition("bundle").sortWithinPartitions("bundle", "shard")
    return met.mapInArrow(apply, RUNS)


def _ranges(hit: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of the stretches of consecutive ``position`` that are hit."""
    at = position[hit]
    new = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return at[new], at[np.append(new[1:], len(at)) - 1] + 1 if len(at) else at


def _distinct_runs(blobs: list[bytes], counts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Different runs of a shard, and which of them each run is: copies enter the suffix array once."""
    number: dict[bytes, int] = {}
    which, at = np.empty(len(counts), np.int64), 0
    sizes = (counts + WIDTH - 1).tolist()
    for blob in blobs:
        here = 0
        while here < len(blob):
            which[at] = number.setdefault(blob[here : here + sizes[at]], len(number))
            here += sizes[at]
            at += 1
    return list(number), which


def repeated_in_shards(found: DataFrame) -> DataFrame:
    """(bundle, starts, ends): ranges of windows of a bundle that also start in a document with a smaller id."""

    def apply(batches):
        for _, rows in _grouped(batches):
            unpacked = [_unpack_runs(r["runs"]) for r in rows]
            places, counts, owners = (np.concatenate([x[k] for x in unpacked]) for k in range(3))
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            owner = np.repeat(owners, counts)
            distinct, which = _distinct_runs([x[3] for x in unpacked], counts)
            least_owner = np.full(len(distinct), np.iinfo(np.int64).max)
            np.minimum.at(least_owner, which, owners)
            size = np.array([len(x) for x in distinct], np.int64)
            held = size - WIDTH + 1
            at = np.cumsum(held) - held
            start = np.repeat(np.cumsum(size) - size - at, held) + np.arange(held.sum())
            least = smallest_of_equal(np.frombuffer(b"".join(distinct), np.uint8), start, np.repeat(least_owner, held))
            hit = least[np.repeat(at[which], counts) + inner] < owner
            place = np.repeat(places, counts) + inner
            cuts = np.cumsum([0] + [int(x[1].sum()) for x in unpacked])
            out: list[list] = [[], [], []]
            for r, a, b in zip(rows, cuts[:-1], cuts[1:]):
                order = np.argsort(place[a:b], kind="stable")
                begins, ends = _ranges(hit[a:b][order], place[a:b][order])
                if len(begins):
                    out[0].append(r["bundle"]), out[1].append(begins.astype("<i8").tobytes()), out[2].append(ends.astype("<i8").tobytes())
            yield _rows(out, ["bundle", "starts", "ends"], [pa.int64(), pa.binary(), pa.binary()])
            del unpacked, distinct, least, hit, place, inner, owner
            release_memory()

    dealt = found.where("shard is not null").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(apply, "bundle long, starts binary, ends binary")


def repeated_hot(ws: Workspace, found: DataFrame) -> DataFrame:
    """As repeated_in_shards for the runs without a shard: their windows are told by their own bytes."""

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places, counts, owners, blob = _unpack_runs(row["runs"])
                inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                size = counts + WIDTH - 1
                at = np.repeat(np.cumsum(size) - size, counts) + inner
                for a in range(0, len(at), SLICE):
                    part = at[a : a + SLICE]
                    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(blob, np.uint8), WIDTH)[part]
                    offsets = pa.py_buffer((WIDTH * np.arange(len(part) + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(np.ascontiguousarray(windows))]), pa.array(np.repeat(owners, counts)[a : a + SLICE]), pa.array([row["bundle"]] * len(part), pa.int64()), pa.array((np.repeat(places, counts) + inner)[a : a + SLICE])], names=["window", "owner", "bundle", "place"])
        release_memory()

    windows = found.where("shard is null").mapInArrow(spread, "window binary, owner long, bundle long, place long")
    least = ws.table(windows.groupBy("window").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").select("window", "least"), "hot")
    hits = windows.join(with_small_side(ws.spark, least, least.count()), "window").where("least < owner").select("bundle", "place")

    def pack(batches):
        for batch in batches:
            bundle, place = (batch.column(k).to_numpy() for k in (0, 1))
            order = np.lexsort((place, bundle))
            bundle, place, out = bundle[order], place[order], [[], [], []]
            for a, b in _cut(bundle):
                begins, ends = _ranges(np.ones(b - a, bool), place[a:b])
                out[0].append(int(bundle[a])), out[1].append(begins.astype("<i8").tobytes()), out[2].append(ends.astype("<i8").tobytes())
            yield _rows(out, ["bundle", "starts", "ends"], [pa.int64(), pa.binary(), pa.binary()])

    return hits.mapInArrow(pack, "bundle long, starts binary, ends binary")


def cleaned(bundled: DataFrame, marks: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the text that is left if ``with_text``) of each document."""
    none = F.lit(None).cast("binary")
    texts = bundled.select("bundle", F.lit(0).alias("kind"), none.alias("starts"), none.alias("ends"), "bytes", "sizes", "ids", "known")
    marks = marks.select("bundle", F.lit(1).alias("kind"), "starts", "ends", none.alias("bytes"), none.alias("sizes"), none.alias("ids"), F.lit(None).cast("boolean").alias("known"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text

    def apply(batches):
        for _, rows in _grouped(batches):
            data, offsets, ids = _unpack(rows[0])
            depth = np.zeros(len(data) + 1, np.int32)
            for r in rows[1:]:  # windows of a range cover WIDTH - 1 more bytes
                np.add.at(depth, np.frombuffer(r["starts"], "<i8"), 1)
                np.add.at(depth, np.frombuffer(r["ends"], "<i8") + WIDTH - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            out: list[list] = [[] for _ in names]
            for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                mine = gone[a:b]
                left = data[a:b][~mine].tobytes()
                values = [int(ids[k]) if rows[0]["known"] else None, int(b - a), int(mine.sum()), int((mine & ~np.concatenate([[False], mine[:-1]])).sum()) if b > a else 0, hashlib.sha256(left).hexdigest(), left]
                for column, value in zip(out, values):
                    column.append(value)
            yield _rows(out, names, kinds)
        release_memory()

    met = texts.unionByName(marks).repartition("bundle").sortWithinPartitions("bundle", "kind")
    return met.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text)


def repeated_spans(docs: DataFrame, ws: Workspace | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text); kept_text too if ``with_text``.

    The result reads tables of ``ws``, which the caller may clear when it is done with it. kept_text is binary: a
    span may begin or end inside a character.
    """
    ws = ws or Workspace(docs.sparkSession, "suffixes")
    bundled = ws.table(bundles(docs.select("doc_id", "text")), "bundles")
    known = bundled.where("known")
    raw = known.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    flags = shared_names(known, _bits(raw // 18, COUNTED))
    found = ws.table(shared_runs(known, flags, _bits(raw // 4, SORTED)), "runs")
    marks = repeated_in_shards(found)
    if not found.where("shard is null").isEmpty():
        marks = marks.unionByName(repeated_hot(ws, found))
    return cleaned(bundled, marks, with_text)
