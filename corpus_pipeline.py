"""Corpus pipeline: toxicity, quality rules, MinHash near-dedup, packing; each stage's output is written and read again.

A null text counts as empty in every stage: the classifier gives it its bias, the quality rules reject it for want of
words. Repeated rows are judged alike; near_dedup keeps one. Rows without doc_id are judged by their own texts. Labels without a document
count nowhere; without labels of a kind no row is rejected as toxic. Ties stay in (a score on the threshold is toxic). Texts of
any length are judged whole. An empty table passes as such. Extra columns go along up to packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from svloom.llm import minhash, packing, quality_rules, toxicity
from svloom.llm.queries import table, tokenizer_path, toxicity_model, trusted
from svloom.llm.shared import Workspace, with_small_side


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It is trained as in op9, on the labelled rows of ``docs``."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, score="__toxic").where(F.col("__toxic") < toxicity.THRESHOLD).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the raw corpus is ``docs``, the target its documents labelled as good."""
    judged = quality_rules.quality_rules(docs, trusted(spark, sf_dir))
    return judged.where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id, or of those without any the first by its text's hash.

    A row is told by its doc_id and its text's hash, so two texts under one doc_id are decided apart. Documents
    without words are no copies of each other; of repeated rows (the same doc_id and text) one stays.
    """
    ws = Workspace(spark, "dedup")
    key = ["doc_id", "text_hash"]
    found = ws.table(minhash.near_duplicates(docs, ws), "found")
    # a group has one kept row at least: more share its smallest doc_id, or none of them has an id
    kept = found.where("kept").select(*key, F.col("group"), F.when(F.col("group").isNull(), F.struct(*key)).alias("wordless"))
    again = kept.groupBy("group", "wordless").agg(F.min(F.struct(*key)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = ws.table(again.select("group", "first"), "again")
    more = kept.join(with_small_side(spark, again, again.count()), "group").where(F.struct(*key) != F.col("first"))
    gone = ws.table(found.where("not kept").select(*key).unionByName(more.select(*key)).distinct(), "gone")
    rows = docs.withColumn("__hash", minhash.text_hash())

    def same(side: DataFrame) -> Column:
        return rows["doc_id"].cast("long").eqNullSafe(side["doc_id"]) & (rows["__hash"] == side["text_hash"])

    gone = with_small_side(spark, gone, gone.count())
    left = rows.join(gone, same(gone), "left_anti")
    repeated = again.select("first.*")
    repeated = with_small_side(spark, repeated, repeated.count())
    once = left.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__hash"])
    out = left.join(repeated, same(repeated), "left_anti").unionByName(once).select(*docs.columns)
    out._svloom_tables = ws  # for run(), which writes the rows and then needs these tables no more
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("packing", packing_stage)]

#: Trained models, hashed n-grams and tokenizers have no SQL form; tests/llm checks the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        left = stage(spark, docs, sf_dir)
        before, docs = docs, ws.table(left, name)
        if hasattr(left, "_svloom_tables"):
            left._svloom_tables.clear()
        if k:
            ws.drop(before)
    return docs
