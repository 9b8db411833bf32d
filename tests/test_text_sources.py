"""Raw string files over splits, and tasks that are done once."""

import os

from pyspark.sql import functions as F

from svloom.operators import labels as lb
from svloom.sources import manifest as mf, sfs


def test_names_fill_down_over_splits(spark, tmp_path):
    lines, expected, name = [], [], None
    for i in range(400):
        if i % 37 == 0:
            name = f"read{i}"
        lines.append(f"{name if i % 37 == 0 else '*'}\t('q', 0, 9, 1)\t('chr1', {i + 1}, {i + 60}, 1) ('chr2', 0, 5, 1)")
        expected.append((name, "chr1", i + 1, i + 60))
    (tmp_path / "a.sfs").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.sfs").write_text("*\t('q', 0, 9, 1)\t('chr3', 1, 2, 1)\n" + lines[0] + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = sfs.read_strings(spark, str(tmp_path / "a.sfs"))
        assert rows.select("split").distinct().count() > 20  # most splits hold no name of their own
        got = sorted((r.read_id, r.contig, r.start_pos, r.end_pos) for r in rows.collect())
        both = sfs.read_strings(spark, str(tmp_path)).where("contig = 'chr3'").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(expected)
    assert both.read_id is None  # a name does not pass from one file to another
    blocks = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "block int, line_no int, text string")
    assert sorted((r.read_id, r.contig, r.start_pos, r.end_pos) for r in lb.parse_sfs(blocks).collect()) == got


def test_tasks_are_done_once(spark, tmp_path):
    inbox, out, log = tmp_path / "in", tmp_path / "out", str(tmp_path / "manifest")
    for name, size in (("c1/a.fa", 3), ("c1/b.fa", 4), ("c2/a.fa", 5), ("c2/x.txt", 1)):
        (inbox / name).parent.mkdir(parents=True, exist_ok=True)
        (inbox / name).write_text("x" * size)
    out.mkdir()
    done = []

    def work(todo):
        names = sorted(r.task_id for r in todo.collect())
        done.append(names)
        for name in names:
            (out / f"{name}.bam").write_text("done " + name)
        return spark.createDataFrame([(name, f"file:{out}/{name}.bam") for name in names], "task_id string, path string")

    def once(batch):
        found = mf.files(spark, str(inbox), "*.fa")
        tasks = mf.tasks(found, F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
        return mf.run(tasks, log, str(out), work, batch)

    assert once(0) == 2 and done == [["c1", "c2"]]
    assert once(1) == 0 and len(done) == 1
    (out / "c1.bam").write_text("cut")  # a cut output
    assert once(2) == 1 and done[-1] == ["c1"] and (out / "c1.bam").read_text() == "done c1"
    (inbox / "c2/a.fa").write_text("x" * 6)  # a changed input
    assert once(3) == 1 and done[-1] == ["c2"]
    os.remove(out / "c2.bam")
    assert once(4) == 1 and done[-1] == ["c2"] and once(5) == 0
    (inbox / "c3").mkdir()
    (inbox / "c3/new.fa").write_text("x")
    assert once(6) == 1 and done[-1] == ["c3"]


def test_a_stream_of_tasks(spark, tmp_path):
    out, log, queue = tmp_path / "out", str(tmp_path / "manifest"), str(tmp_path / "queue")
    out.mkdir()
    seen = []

    def work(todo):
        names = [r.task_id for r in todo.collect()]
        seen.extend(names)
        for name in names:
            (out / name).write_text(name)
        return spark.createDataFrame([(name, f"file:{out}/{name}") for name in names], "task_id string, path string")

    def go():
        stream = spark.readStream.schema("task_id string, fingerprint long").parquet(queue)
        mf.follow(stream, log, str(out), work, str(tmp_path / "checkpoint"))

    spark.createDataFrame([("a", 1), ("b", 1)], "task_id string, fingerprint long").coalesce(1).write.parquet(queue)
    go()
    spark.createDataFrame([("b", 1), ("c", 1), ("a", 2)], "task_id string, fingerprint long").coalesce(1).write.mode("append").parquet(queue)
    go()
    go()
    assert sorted(seen) == ["a", "a", "b", "c"]
