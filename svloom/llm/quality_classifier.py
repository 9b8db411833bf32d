"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded; FILTERS learned filters of WIDTH bytes run over chunks of CHUNK bytes that
overlap by WIDTH, from the first byte to the last; each filter's responses are max-pooled within a chunk. A
document is the mean and the maximum of its chunks' pooled vectors, which a logistic layer combines into one
probability. Training (Adam, gradients by hand through the pooled maxima) runs on the driver over a bounded
sample of labelled rows; the model has a few thousand numbers and goes out with the task.

A null text counts as empty; an empty text is one chunk of padding. Rows are scored one by one: repeated rows
repeat their score; other columns pass through; an empty table is empty. Without usable labels of both kinds the
score is 0.5 everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from svloom.llm import bytewords as bw

EMBED, WIDTH, FILTERS, STRIDE = 6, 8, 24, 2
CHUNK = 512
#: Bound of the training sample: labelled rows, and chunks of one text; a longer text gives this many chunks, spread evenly from its first to its last.
MAX_TRAIN_DOCS, MAX_TRAIN_CHUNKS = 2_000, 32
EPOCHS, BATCH, RATE = 6, 16, 0.01
THRESHOLD = 0.3
PAD = 0


def parts(data: np.ndarray, offsets: np.ndarray, size: int = 128):
    """(chunks, document of each) in pieces of ``size`` chunks, so that a long text takes no more memory than its bytes."""
    per = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    ends = np.cumsum(per)
    for k in range(0, int(ends[-1]) if len(ends) else 0, size):
        of = np.searchsorted(ends, np.arange(k, min(k + size, int(ends[-1]))), "right")
        first = offsets[of] + CHUNK * (np.arange(k, k + len(of)) - (ends - per)[of])
        at = first[:, None] + np.arange(CHUNK + WIDTH)
        inside = at < offsets[of + 1][:, None]
        padded = data[np.where(inside, at, 0)] if len(data) else np.zeros(at.shape, np.uint8)
        yield np.where(inside, padded, PAD).astype(np.uint8), of


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f4 = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(f4),
            "filters": rng.normal(0, 1 / np.sqrt(EMBED * WIDTH), (WIDTH * EMBED, FILTERS)).astype(f4),
            "bias": np.zeros(FILTERS, f4),
            "out": np.zeros(2 * FILTERS, f4),
            "last": np.zeros(1, f4),
        }
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each chunk, and the window where it lies."""
        e = self.p["embed"][x]
        windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH, 1)[:, :CHUNK:STRIDE]
        y = windows.transpose(0, 1, 3, 2).reshape(-1, WIDTH * EMBED) @ self.p["filters"]
        y = y.reshape(len(x), -1, FILTERS)
        at = y.argmax(1)
        return np.maximum(np.take_along_axis(y, at[:, None], 1)[:, 0] + self.p["bias"], 0), at

    @staticmethod
    def gathered(h: np.ndarray, of: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(of, np.arange(docs))
        n = np.bincount(of, minlength=docs)[:, None]
        return np.concatenate([np.add.reduceat(h, first) / n, np.maximum.reduceat(h, first)], 1), n

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        docs = len(offsets) - 1
        total, top, n = np.zeros((docs, FILTERS)), np.zeros((docs, FILTERS)), np.zeros(docs)
        for x, of in parts(data, offsets):
            h = self.pooled(x)[0]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            who = of[first]
            total[who] += np.add.reduceat(h, first)
            top[who] = np.maximum(top[who], np.maximum.reduceat(h, first))  # pooled values are 0 at least
            n[who] += np.diff(np.append(first, len(of)))
        z = np.concatenate([total / n[:, None], top], 1)
        return 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["last"], -35, 35).astype(float)))

    def step(self, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, rate: float) -> None:
        docs = len(offsets) - 1
        x, of = (np.concatenate(c) for c in zip(*parts(data, offsets)))
        h, at = self.pooled(x)
        z, n = self.gathered(h, of, docs)
        p = 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["last"], -35, 35)))
        d = ((p - labels) / docs).astype(np.float32)
        g = {"out": z.T @ d, "last": d.sum(keepdims=True)}
        dz = d[:, None] * self.p["out"][None]
        top = (h == z[:, FILTERS:][of]).astype(np.float32)
        top /= np.add.reduceat(top, np.searchsorted(of, np.arange(docs)))[of]  # chunks that tie share the gradient
        dh = (dz[:, :FILTERS] / n)[of] + dz[:, FILTERS:][of] * top
        dh = dh * (h > 0)
        g["bias"] = dh.sum(0)
        start = at * STRIDE
        seen = x[np.arange(len(x))[:, None, None], start[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        e = self.p["embed"][seen].reshape(len(x), FILTERS, WIDTH * EMBED)
        g["filters"] = np.einsum("cfk,cf->kf", e, dh)
        de = dh[:, :, None] * self.p["filters"].T[None]
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], seen.reshape(-1), de.reshape(-1, EMBED))
        self.steps += 1
        for k, q in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * q
            self.v[k] = 0.999 * self.v[k] + 0.001 * q * q
            m, v = self.m[k] / (1 - 0.9**self.steps), self.v[k] / (1 - 0.999**self.steps)
            self.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def sampled_bytes(labelled: DataFrame) -> DataFrame:
    """(label, at, bytes) of the sample: whole texts, or of longer ones MAX_TRAIN_CHUNKS chunks spread over all of it."""

    def apply(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                data = (text or "").encode()
                chunks = -(-len(data) // CHUNK)
                if chunks > MAX_TRAIN_CHUNKS:
                    picked = np.linspace(0, chunks - 1, MAX_TRAIN_CHUNKS).round().astype(int)
                    data = b"".join(data[i * CHUNK : i * CHUNK + CHUNK] for i in picked)
                out.append(data)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["label", "at", "bytes"])

    rows = labelled.select(F.col("label").cast("double").alias("label"), F.xxhash64("id", F.lit(6)).alias("at"), "text")
    return rows.mapInArrow(apply, "label double, at long, bytes binary")


def train(labelled: DataFrame) -> dict[str, np.ndarray] | None:
    """Weights from ``labelled`` (id, text, label), a sample bounded by toxicity.labelled; both kinds are needed."""
    rows = sampled_bytes(labelled).toArrow()
    rows = rows.sort_by([("at", "ascending"), ("label", "ascending"), ("bytes", "ascending")])
    texts, labels = rows.column("bytes").to_pylist(), rows.column("label").to_pylist()
    if len(set(labels)) < 2:
        return None
    net, y, rng = Net(), np.array(labels, np.float32), np.random.default_rng(7)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            data = [texts[i] for i in some]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
            net.step(np.frombuffer(b"".join(data), np.uint8), offsets, y[some], RATE * (1 - 0.8 * epoch / EPOCHS))
    return net.p


def scores(docs: DataFrame, weights: dict[str, np.ndarray] | None, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in a new last column ``score``."""

    def apply(batches):
        net = Net()
        if weights:
            net.p = weights
        for batch in batches:
            texts = batch.column(0)
            got = [net.scores(*bw.column(texts.slice(a, b - a))) if weights else np.full(b - a, 0.5) for a, b in bw.slices(texts, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *got]))], names=[*batch.schema.names[1:], score])

    others = [F.col(f"`{c}`") for c in docs.columns if c != score]
    schema = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    return docs.select(F.col(text).alias("__text"), *others).mapInArrow(apply, schema)
