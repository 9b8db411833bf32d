"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Nulls and empties: a null text counts as empty; an empty text has no features and gets the bias alone.
Rows are scored one by one, so repeated rows, ties and extra columns need no care; an empty table gives an
empty result. Without any usable label the model is empty and every score is the prior 0. Long texts are learnt from and
scored like others, whole: they are hashed in pieces of PIECE bytes, which take some 60 bytes a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from svloom.llm import bytewords as bw
from svloom.llm.shared import Workspace, release_memory, sample_ids, with_small_side

BITS = 20
#: Bound of the training sample, in labelled rows (a row's distinct features are at most 2^BITS numbers, however long its text); passes over it.
MAX_TRAIN_DOCS, EPOCHS = 6_000, 3
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.5
THRESHOLD = 0.7
SEED = 9


#: Words also count by their first bytes, so that unseen endings of a known stem are told.
STEMS = (4, 5, 6)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, the text of each): words, stems, pairs of neighbours, and pairs with one word between."""
    hashes, offsets, stems = bw.words(*bw.column(texts), ends=bw.NOT_ALNUM, stems=STEMS)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    second = hashes * np.uint64(0x9FB21C651E98DF25)
    parts = [(bw.mix(hashes), of)]
    parts += [(bw.mix(x + np.uint64(k)), of) for k, x in zip(STEMS, stems)]
    for gap in (1, 2):
        same = of[:-gap] == of[gap:]
        parts.append((bw.mix(hashes[:-gap] + second[gap:] + np.uint64(gap))[same], of[:-gap][same]))
    keep = np.uint64((1 << BITS) - 1)
    return np.concatenate([x & keep for x, _ in parts]).astype(np.int64), np.concatenate([x for _, x in parts])


#: Bytes of a long text whose words are hashed at once.
PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of one text; a long one in pieces, each with the two words before it."""
    if text is None or len(text) <= PIECE:
        return np.unique(hashed(pa.array([text], pa.string()))[0])
    seen, keep, before = np.zeros(1 << BITS, bool), np.uint64((1 << BITS) - 1), np.zeros(0, np.uint64)
    for piece in pieces(np.frombuffer(text.encode(), np.uint8)):
        hashes, _, stems = bw.words(piece, np.array([0, len(piece)]), ends=bw.NOT_ALNUM, stems=STEMS)
        row = np.concatenate([before, hashes])
        second, before = row * np.uint64(0x9FB21C651E98DF25), row[-2:]
        parts = [hashes] + [x + np.uint64(k) for k, x in zip(STEMS, stems)] + [row[:-gap] + second[gap:] + np.uint64(gap) for gap in (1, 2)]
        for part in parts:
            seen[bw.mix(part) & keep] = True
    return np.flatnonzero(seen)


def pieces(data: np.ndarray):
    """The bytes in parts of about PIECE that end between words."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        gap = np.flatnonzero(bw.NOT_ALNUM[data[end : end + (1 << 16)]]) if end < len(data) else [0]
        while not len(gap) and end < len(data):
            end = min(end + (1 << 16), len(data))
            gap = np.flatnonzero(bw.NOT_ALNUM[data[end : end + (1 << 16)]]) if end < len(data) else [0]
        end += int(gap[0]) if len(gap) else 0
        yield data[at:end]
        at = end


def margins(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Sum of the weights in ``table`` over the distinct features of each text."""
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > PIECE:
        return table[features(texts[0].as_py())].sum(keepdims=True)
    at, of = hashed(texts)
    live = table[at] != 0
    keys = np.unique((of[live] << BITS) | at[live])
    return np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], len(texts))


class Ftrl:
    """Weights w with one learning rate for each coordinate; L1 leaves most of them at exactly 0."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where((np.abs(z) <= L1) & (at != self.bias), 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        was = self.n[at]
        self.n[at] = was + g * g
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / ALPHA * w

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(numbers, weights) of the coordinates that aren't 0, and the bias."""
        w = self.weights(np.arange(self.bias + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(labelled: DataFrame, epochs: int = EPOCHS):
    """Compact weights from ``labelled`` (id, text, label), a sample as ``labelled`` bounds it.

    It is learnt in the order of a hash of the id, so the same rows give the same model on any cluster.
    Executors make the features; the driver gets numbers only.
    """

    def apply(batches):
        for batch in batches:
            lists = pa.array([features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, *batch.columns[1:]], names=["at", "label", "order", "text"])

    rows = labelled.select("text", F.col("label").cast("double").alias("label"), F.xxhash64(F.col("id"), F.lit(SEED)).alias("order"), F.xxhash64("text").alias("same"))
    table = rows.repartition(16).mapInArrow(apply, "at array<int>, label double, order long, text long").toArrow()
    order = np.lexsort([table.column(c).to_numpy() for c in ("text", "label", "order")])
    at, labels = table.column("at").combine_chunks(), table.column("label").to_numpy()
    ends, flat = at.offsets.to_numpy(), at.values.to_numpy()
    model = Ftrl()
    for _ in range(epochs if labels.any() else 0):
        for i in order.tolist():
            model.learn(flat[ends[i] : ends[i + 1]], float(labels[i]))
    return model.compact()


def scores(docs: DataFrame, model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the model's probability of toxic text in a new last column ``score``."""
    at, w, bias = model

    def apply(batches):
        table = np.zeros(1 << BITS)
        table[at] = w
        for batch in batches:
            texts = batch.column(0)
            got = np.concatenate([np.zeros(0), *(margins(texts.slice(a, b - a), table) for a, b in bw.slices(texts))])
            out = sigmoid(got + bias) if len(at) else np.zeros(len(got))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*batch.schema.names[1:], score])
        release_memory()

    others = [F.col(f"`{c}`") for c in docs.columns if c != score]
    schema = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    return docs.select(F.col(text).alias("__text"), *others).mapInArrow(apply, schema)


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int | None = None, folds: int = 3, limit: int = MAX_TRAIN_DOCS) -> DataFrame:
    """(id, text, label) of at most ``limit`` labelled documents; those whose crc32(doc_id) mod ``folds`` is ``fold`` are left out.

    Ids are chosen first, without texts, among those that have both a label and a document, of whatever length; then
    the chosen few, whose number is bounded, are broadcast to fetch their texts. Of several documents with one id the
    smallest text counts; a document with both labels counts once for each.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if fold is not None:
        known = known.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    known = known.select(F.col("doc_id").alias("id"), F.col(label).cast("double").alias("label"))
    both = docs.select(F.col("doc_id").alias("id")).join(with_small_side(spark, known, known.count()), "id").distinct()
    chosen = sample_ids(Workspace(spark, "labelled").table(both, "ids"), limit, SEED)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "label").agg(F.min("text").alias("text"))
