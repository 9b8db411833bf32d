"""FASTA files by their index (.fai): chunks of contigs as a data source, slices for a table of regions, and a writer.

A path is a file or a folder of .fa files, each with its index beside it. A place's byte follows from the index's line
lengths, so a task reads the bytes of its own chunks or regions and no record is ever one row. A region beyond its contig
raises, as do an end before the start and an unknown contig.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from svloom.sources import storage

CHUNK, TASK = 1 << 16, 1 << 25
_UPPER = bytes(c - 32 if 97 <= c <= 122 else c for c in range(256))


@dataclass
class Contig:
    uri: str
    length: int
    offset: int
    bases: int
    width: int

    def byte(self, place: int) -> int:
        return self.offset + place // self.bases * self.width + place % self.bases if self.bases else self.offset


def read_index(path: str) -> dict[str, Contig]:
    """Contigs by name in the order of the files; lines that begin with # are left out, a name that comes twice raises."""
    out: dict[str, Contig] = {}
    for uri in storage.listed(path, ".fa"):
        with storage.open_range(f"{uri}.fai") as file:
            lines = file.read().decode().splitlines()
        for row in (line.split("\t") for line in lines if line and not line.startswith("#")):
            if row[0] in out:
                raise ValueError(f"two contigs are called {row[0]}")
            out[row[0]] = Contig(uri, *map(int, row[1:5]))
    return out


class Files:
    """Opens each file once."""

    def __init__(self):
        self.files = {}

    def bases(self, contig: Contig, start: int, end: int) -> str:
        """Upper-case bases of [start, end), which must lie within the contig."""
        if contig.uri not in self.files:
            self.files[contig.uri] = storage.open_range(contig.uri)
        first, last = contig.byte(start), contig.byte(end)
        return self.files[contig.uri].read_at(last - first, first).translate(_UPPER, b"\r\n").decode()


def check(name: str, contig: Contig | None, start: int, end: int) -> Contig:
    if contig is None:
        raise ValueError(f"the index has no contig {name}")
    if end > contig.length:
        raise ValueError(f"the end {end} lies beyond {name}, which has {contig.length} bases")
    if not 0 <= start <= contig.length:
        raise ValueError(f"the start {start} lies outside {name}, which has {contig.length} bases")
    if start > end:
        raise ValueError(f"the start {start} lies behind the end {end}")
    return contig


@dataclass
class Chunks(InputPartition):
    parts: list[tuple[str, Contig, int, int]]  # contig, first and last + 1 of its chunks


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.per_task = max(1, int(options.get("split_bases", TASK)) // self.chunk)
        self.contig = options.get("contig")
        if self.contig is not None:
            check(self.contig, read_index(self.path).get(self.contig), 0, 0)

    def partitions(self):
        """Each takes its own contigs' lines of the index along; the reader, which goes to every task, has none."""
        out, room = [], 0
        for name, contig in read_index(self.path).items():
            if self.contig not in (None, name):
                continue
            at, chunks = 0, -(-contig.length // self.chunk)
            while at < chunks:
                if not room:
                    out.append(Chunks([]))
                    room = self.per_task
                taken = min(room, chunks - at)
                out[-1].parts.append((name, contig, at, at + taken))
                at, room = at + taken, room - taken
        return out or [Chunks([])]

    def read(self, partition: Chunks):
        names = ["contig", "chunk", "chunk_start", "piece"]
        files = Files()
        step = max(1, (1 << 22) // self.chunk)
        for name, contig, first, last in partition.parts:
            for low in range(first, last, step):
                numbers = range(low, min(low + step, last))
                text = files.bases(contig, low * self.chunk, min(numbers[-1] * self.chunk + self.chunk, contig.length))
                pieces = [text[i : i + self.chunk] for i in range(0, len(text), self.chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces)), pa.array(numbers, pa.int32()), pa.array([n * self.chunk for n in numbers], pa.int64()), pa.array(pieces)], names=names)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svloom_fasta"

    def schema(self) -> str:
        return "contig string, chunk int, chunk_start long, piece string"

    def reader(self, schema: T.StructType) -> FastaReader:
        return FastaReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options, overwrite)


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, contig: str | None = None, split_bases: int = TASK) -> DataFrame:
    """(contig, chunk, chunk_start, piece) of an indexed FASTA file, in tasks of about ``split_bases``."""
    spark.dataSource.register(FastaSource)
    read = spark.read.format("svloom_fasta").option("path", path).option("chunk", chunk).option("split_bases", split_bases)
    return (read.option("contig", contig) if contig is not None else read).load()


def fetch_slices(regions: DataFrame, path: str, contig: str = "contig", start: str = "start_pos", end: str = "end_pos", out: str = "slice") -> DataFrame:
    """``regions`` with the bases of [start, end); a null end is the contig's. Each task reads its regions' bytes only."""
    schema = T.StructType([*regions.schema.fields, T.StructField(out, T.StringType())])
    at = [regions.columns.index(c) for c in (contig, start, end)]

    def apply(batches):
        index, files = read_index(path), Files()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in at)))
            done = 0
            while done < len(rows):  # batches of some MB, however long the regions are
                found, size = [], 0
                while done + len(found) < len(rows) and size < 1 << 23:
                    name, first, last = rows[done + len(found)]
                    contig = index.get(name)
                    last = contig.length if last is None and contig else last
                    found.append(files.bases(check(name, contig, first, last), first, last))
                    size += len(found[-1])
                yield pa.RecordBatch.from_arrays([*batch.slice(done, len(found)).columns, pa.array(found, pa.string())], names=schema.names)
                done += len(found)

    return regions.mapInArrow(apply, schema)


@dataclass
class Part(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FastaWriter(DataSourceArrowWriter):
    """Each task writes one file and its index; both get their names at commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.output, self.width = storage.Output(options["path"]), int(options.get("width", 80))
        self.output.create(overwrite)

    def write(self, batches) -> Part:
        from pyspark import TaskContext

        task, index, at = TaskContext.get(), [], 0
        hidden = f"{task.partitionId():05d}-{task.taskAttemptId()}.fa"
        with self.output.write(hidden) as file:
            for batch in batches:
                for name, sequence in zip(*(batch.column(c).to_pylist() for c in ("name", "sequence"))):
                    head = f">{name}\n".encode()
                    lines = [sequence[i : i + self.width].encode() + b"\n" for i in range(0, len(sequence), self.width)]
                    index.append(f"{name}\t{len(sequence)}\t{at + len(head)}\t{self.width}\t{self.width + 1}\n")
                    at += file.write(head + b"".join(lines))
        if not index:
            return Part([])
        with self.output.write(hidden + ".fai") as file:
            file.write("".join(index).encode())
        name = f"part-{task.partitionId():05d}.fa"
        return Part([(hidden, name), (hidden + ".fai", name + ".fai")])

    def commit(self, messages: list[Part]) -> None:
        self.output.commit([move for part in messages if part for move in part.moves])

    def abort(self, messages: list[Part]) -> None:
        self.output.abort()


def write_fasta(records: DataFrame, path: str, width: int = 80, overwrite: bool = False) -> None:
    """A folder of indexed FASTA files from (name, sequence), one for each partition with rows."""
    records.sparkSession.dataSource.register(FastaSource)
    rows = records.select("name", "sequence")
    rows.write.format("svloom_fasta").option("path", path).option("width", width).mode("overwrite" if overwrite else "append").save()
