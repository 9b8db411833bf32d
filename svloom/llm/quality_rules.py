"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

DataFrame functions only. A word is a run of characters other than space and \\x09-\\x0D. Every word and every
pair of neighbouring words falls into one of 2^16 buckets. Two multinomials over the buckets are counted: one
over the target's documents, one over all documents, both with one added to each bucket. A document's score is
the mean, over its words and pairs, of the log ratio of its bucket's two probabilities; a document is kept if
its score is at least a fixed threshold, so the same document always meets the same verdict.

Null text counts as a text without words; such a text, like any other of under 50 words, fails the base rules.
Without any target document both multinomials have no evidence and every score is 0 (kept). Rows are judged one
by one: repeated rows give repeated results, and columns of any other name pass through. An empty table gives an empty
result. A text of any length is judged whole, in arrays of some tens of bytes a word in one row. The 2^16 ratios, and
nothing that grows with the corpus, pass through the driver and become a constant of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from svloom.llm.shared import with_small_side

BUCKETS = 1 << 16
#: Mean log ratio below which a document is rejected.
THRESHOLD = -0.15
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words; whatever looks at n-grams works on these and not on strings."""
    return F.transform(words(text), lambda x: F.xxhash64(x))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def _pair(hashes: str, x: Column, i: Column) -> Column:
    return F.xxhash64(F.get(hashes, i - 1), x)


def counts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, raw, target): how often the n-grams of all documents, and of those with an id in ``target``, fall into each bucket.

    ``target`` is broadcast only if it has few rows; counts are combined before the shuffle, so each task
    sends at most one row a bucket.
    """
    ids = target.select("doc_id").where("doc_id is not null").distinct()
    ids = with_small_side(docs.sparkSession, ids, ids.count()).withColumn("__trusted", F.lit(1))
    rows = docs.select("doc_id", word_hashes(F.col("text")).alias("h")).join(ids, "doc_id", "left")
    pairs = F.transform("h", lambda x, i: F.when(i > 0, _pair("h", x, i)))
    one = rows.select("__trusted", F.explode(F.concat("h", pairs)).alias("g")).where("g is not null")
    return one.groupBy(_bucket(F.col("g")).alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("__trusted").alias("target"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """One row with the array of the log ratios of all buckets, 0 everywhere if there is no target."""
    spark = counted.sparkSession
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left").na.fill(0)
    row = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("sr"), F.sum("target").alias("st"))
    ratio = lambda x: F.log((x["target"] + 1) / (F.col("st") + BUCKETS)) - F.log((x["raw"] + 1) / (F.col("sr") + BUCKETS))
    return row.select(F.transform("c", lambda x: F.when(F.col("st") > 0, ratio(x)).otherwise(0.0)).alias("ratios"))


def judge(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the statistics, ``score``, ``base_failed`` and ``kept``; a map over the rows, without a shuffle."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    old = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    own = "__"
    while any(c.startswith(own) for c in docs.columns):  # columns of this operator that clash with none
        own += "_"
    w, lines, h, s, p = (own + c for c in ("w", "lines", "h", "s", "p"))
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<bigint>")
    d = docs.select(*old, word_hashes(F.col("text")).alias(w), F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias(lines))
    n = F.size(w)
    hash3 = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    d = d.withColumn(h, F.when(n >= 3, F.slice(F.transform(w, hash3), F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(none))
    again = F.size(F.array_distinct(h)) < F.size(h)
    d = d.withColumn(s, F.when(again, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn(p, F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"])))
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    # lambdas take no subqueries: the table's fixed number of ratios goes in as a constant, folded once
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios.first()["ratios"])), ",").cast("array<double>")
    gram = lambda x, i: F.get(table, _bucket(x)) + F.when(i > 0, F.get(table, _bucket(_pair(w, x, i)))).otherwise(0.0)
    total = F.aggregate(F.transform(w, gram), F.lit(0.0), lambda a, x: a + x)
    out = d.select(
        *old,
        n.cast("bigint").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        F.when(n > 0, total / (2 * n - 1)).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # A filter on the verdict must not move below the projections: it would take all their arrays into one
    # expression and compute them anew for each word. Spark leaves a filter above a non-deterministic field.
    always = F.monotonically_increasing_id() >= 0
    return out.withColumn("base_failed", failed).withColumn("kept", F.coalesce(always & ~failed & (F.col("score") >= threshold), F.lit(False)))


def quality_rules(docs: DataFrame, target: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` judged against the target documents whose ids ``target`` (doc_id) lists."""
    return judge(docs, log_ratios(counts(docs, target)), threshold)
