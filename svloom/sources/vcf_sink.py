"""VCF files out: a folder of BGZF parts that concatenate to one file, each with a tabix index, renamed at commit.

The header stands in the first part only, and the empty block that ends a file is the last part, so
``cat part-*`` is a complete compressed VCF. A task that fails or runs twice leaves no part behind.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from svloom.sources import bgzf, storage
from svloom.sources.bam import IndexBuilder

LAST = "part-end.vcf.gz"


def span(line: str) -> tuple[str, int, int]:
    """(contig, 0-based start, end) of a record's line: its END, or the end of its reference allele."""
    chrom, pos, _, ref, _, _, _, info = line.split("\t", 8)[:8]
    start = int(pos) - 1
    end = next((int(x[4:]) for x in info.split(";") if x.startswith("END=")), start + len(ref))
    return chrom, start, max(end, start + 1)


class Tabix:
    """Index of lines that come in order: contigs in turn, starts ascending within them."""

    def __init__(self):
        self.names: list[str] = []
        self.builder = IndexBuilder(0)

    def add(self, line: str, begin: int, after: int) -> None:
        chrom, start, end = span(line)
        if not self.names or self.names[-1] != chrom:
            if chrom in self.names:
                raise ValueError(f"the records of {chrom} do not stand together")
            self.names.append(chrom)
            self.builder.bins.append({})
            self.builder.linear.append({})
        self.builder.add(len(self.names) - 1, start, end, begin, after)

    def packed(self) -> bytes:
        names = b"".join(n.encode() + b"\0" for n in self.names)
        # VCF; columns of the contig, the start and no end; comments; no lines to skip
        head = struct.pack("<4s8i", b"TBI\1", len(self.names), 2, 1, 2, 0, ord("#"), 0, len(names))
        raw = head + names + self.builder.packed()[8:]
        return b"".join(bgzf.block(raw[i : i + bgzf.LONGEST]) for i in range(0, len(raw), bgzf.LONGEST)) + bgzf.END


@dataclass
class Part(WriterCommitMessage):
    moves: list[tuple[str, str]]


class VcfWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.output, self.header = storage.Output(options["path"]), options["header"]
        self.index = options.get("index", "true") == "true"
        self.output.create(overwrite)

    def write(self, batches) -> Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        hidden = f"{task.partitionId():05d}-{task.taskAttemptId()}.vcf.gz"
        out, index = bgzf.Writer(self.output.write(hidden)), Tabix()
        if task.partitionId() == 0:
            out.write(self.header.encode())
            out.flush()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                begin = out.tell()
                out.write(line.encode() + b"\n")
                if self.index:
                    index.add(line, begin, out.tell())
        out.close(end=False)
        name = f"part-{task.partitionId():05d}.vcf.gz"
        moves = [(hidden, name)]
        if self.index:
            with self.output.write(hidden + ".tbi") as file:
                file.write(index.packed())
            moves.append((hidden + ".tbi", name + ".tbi"))
        return Part(moves)

    def commit(self, messages: list[Part]) -> None:
        if not any(name == "part-00000.vcf.gz" for part in messages if part for _, name in part.moves):
            with self.output.write("header") as file:
                file.write(bgzf.block(self.header.encode()[: bgzf.LONGEST]))
            messages = [*messages, Part([("header", "part-00000.vcf.gz")])]
        with self.output.write("end") as file:
            file.write(bgzf.END)
        self.output.commit([move for part in messages if part for move in part.moves] + [("end", LAST)])

    def abort(self, messages: list[Part]) -> None:
        self.output.abort()


class VcfSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svloom_vcf"

    def writer(self, schema: T.StructType, overwrite: bool) -> VcfWriter:
        return VcfWriter(self.options, overwrite)


def read_header(spark: SparkSession, path: str) -> str:
    """The lines of a VCF that begin with #, which all stand before its records."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value").where(F.startswith("value", F.lit("#")))
    return "".join(row.value + "\n" for row in rows.orderBy("n").collect())


def write_vcf(lines: DataFrame, path: str, header: str, order: list[str], overwrite: bool = False, index: bool = True) -> None:
    """``lines`` (value, and the columns of ``order``) as the records of a VCF, in that order, behind ``header``.

    With ``index`` records out of order raise; a contig may go on in the next part.
    """
    lines.sparkSession.dataSource.register(VcfSink)
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    rows.write.format("svloom_vcf").option("path", path).option("header", header).option("index", str(index).lower()).mode("overwrite" if overwrite else "append").save()
