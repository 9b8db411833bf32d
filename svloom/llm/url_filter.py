"""URL filters: rules and listed URLs in a sorted digest array.

Keys are 64-bit xxhash digests, sorted in one file that executors memory-map; the full strings stand behind them
in the same order. A batch of URLs is probed by binary search over all its candidates at once, and a candidate
counts only if the stored string at its digest equals it, so that a collision costs a comparison and no verdict.

A rule is a host and a path prefix with an action. It fits its host and all subdomains if the path starts with
its path; the longest rule wins (host and path together; of rules of one length the smaller string). A listed
host path is blocked when no rule fits it. Everything else is allowed.

A null url, or one without ://, has an empty host and path; no rule with a host fits it, and it is allowed. Rows
are judged one by one; repeated rows repeat their verdict, other columns are not read, an empty table is empty. Long
urls count whole; a batch's candidates depend on the rules' label counts and path lengths, not on the urls' lengths.
Rules and listed host paths are parameters that pass through the driver, which sorts them; their bound is its memory.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from svloom.llm.shared import shared_folder


class DigestArray:
    """Strings with a small value each, found by their digests in a memory-mapped file.

    Layout: number of strings; digests (ascending), string ends, values, all little-endian; then the strings.
    """

    def __init__(self, path: str):
        (n,) = struct.unpack("<Q", open(path, "rb").read(8))
        self.n = n
        where = lambda kind, at, size: np.memmap(path, kind, "r", at, size) if size else np.zeros(0, kind)
        self.digests, self.ends, self.values = where("<u8", 8, n), where("<u8", 8 + 8 * n, n), where("u1", 8 + 16 * n, n)
        size = int(self.ends[-1]) if n else 0
        self.strings = where("u1", 8 + 17 * n, size)

    @staticmethod
    def layout(entries: dict[str, int]) -> bytes:
        import xxhash

        rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v) for k, v in entries.items())
        ends = np.cumsum([len(k) for _, k, _ in rows], dtype="<u8") if rows else np.zeros(0, "<u8")
        return b"".join([struct.pack("<Q", len(rows)), np.array([d for d, _, _ in rows], "<u8").tobytes(), ends.tobytes(), bytes(v for _, _, v in rows), *(k for _, k, _ in rows)])

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Value of each string, -1 for those that aren't in the array."""
        import xxhash

        out = np.full(len(strings), -1, np.int64)
        if not self.n or not strings:
            return out
        wanted = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), "<u8", len(strings))
        at = np.searchsorted(self.digests, wanted)
        live = np.flatnonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == wanted))
        for i in live.tolist():
            k = int(at[i])
            while k < self.n and self.digests[k] == wanted[i]:  # several strings may share a digest
                first = int(self.ends[k - 1]) if k else 0
                if self.strings[first : int(self.ends[k])].tobytes() == strings[i]:
                    out[i] = self.values[k]
                    break
                k += 1
        return out


ALLOW, BLOCK, LISTED = 0, 1, 2


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def shapes(rules: list[tuple[str, str, str]]) -> dict[int, list[int]]:
    """Lengths of the rules' paths by the number of labels of their hosts."""
    out: dict[int, set[int]] = {}
    for host, path, _ in rules:
        out.setdefault(host.count(".") + 1, set()).add(len(path))
    return {k: sorted(v) for k, v in sorted(out.items())}


def candidates(host: str, path: str, lengths: dict[int, list[int]]) -> list[str]:
    """Rules that would fit: each parent host of so many labels as rules have, with each prefix of the path of a length that these have.

    Their number is bounded by the rules' shapes, however many labels the host has.
    """
    out = []
    for k, sizes in lengths.items() if host else ():
        labels = host.rsplit(".", k)[-k:]
        if len(labels) == k:
            parent = ".".join(labels)
            out += [parent + path[:n] for n in sizes if n <= len(path)]
    return out


def ship(spark: SparkSession, data: bytes) -> str:
    """Writes a file to the shared folder and has Spark bring it to every executor; returns its name there."""
    name = f"urls-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    for k in range(0, len(data), 1 << 20):
        out.write(bytearray(data[k : k + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(where.toString())
    return name


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: list[str] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict); ``rules``: (host, path prefix starting with /, allow or block), ``listed``: blocked host paths."""
    for host, path, action in rules:
        if not host or not path.startswith("/") or action not in ("allow", "block"):
            raise ValueError(f"not a rule: {host!r}, {path!r}, {action!r}")
    entries = {x: LISTED for x in listed} | {h + p: BLOCK if a == "block" else ALLOW for h, p, a in rules}
    lengths = shapes(rules)
    name = ship(pages.sparkSession, DigestArray.layout(entries))

    def apply(batches):
        from pyspark import SparkFiles

        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            got = [parts(u) for u in batch.column(1).to_pylist()]
            options = [candidates(h, p, lengths) for h, p in got]
            flat = [c for x in options for c in x] + [h + p for h, p in got]
            values = array.find([c.encode() for c in flat]).tolist()
            rule, verdict, at = [], [], 0
            for i, x in enumerate(options):
                found = [(-len(c), c, v) for c, v in zip(x, values[at : at + len(x)]) if v in (ALLOW, BLOCK)]
                at += len(x)
                best = min(found, default=None)
                rule.append(best and best[1])
                hit = best[2] == BLOCK if best else values[len(flat) - len(got) + i] == LISTED
                verdict.append("block" if hit else "allow")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in got], pa.string()), pa.array([p for _, p in got], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(apply, "page_id long, host string, path string, rule string, verdict string")
