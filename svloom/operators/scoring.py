"""Window model, residual scores, ranking, decisions and metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

POSITIONS, CHANNELS, SUBWINDOWS = 2000, 9, 10
_erf = np.frompyfunc(math.erf, 1, 1)


def _shapes(embedding: int = 100, heads: int = 4, key: int = 32, blocks: int = 3, hidden: int = 128) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all weights, as in the source's state dictionary."""
    out: dict[str, tuple[int, ...]] = {"position_embedding": (1, SUBWINDOWS, embedding)}

    def layer(name: str, *shape: int) -> None:
        out[f"{name}.weight"], out[f"{name}.bias"] = shape, shape[:1]

    layer("encoder.layers.0", 128, 1, 1, CHANNELS)
    for k, (wide, high) in {2: (128, 3), 5: (64, 2), 7: (64, 3), 10: (64, 2), 12: (64, 2), 14: (64, 2)}.items():
        layer(f"encoder.layers.{k}", 64, wide, high, 1)
    layer("patch_projection", embedding, 64)
    for b in range(blocks):
        at = f"transformer_blocks.{b}."
        layer(at + "layer_normalization_1", embedding)
        for x in ("query", "key", "value"):
            layer(at + f"attention.{x}_projection", heads * key, embedding)
        layer(at + "attention.output_projection", embedding, heads * key)
        layer(at + "layer_normalization_2", embedding)
        layer(at + "feed_forward_network.0", embedding, embedding)
        layer(at + "feed_forward_network.3", embedding, embedding)
    layer("sequence_normalization", embedding)
    layer("classifier.0", hidden, embedding)
    layer("classifier.3", hidden, hidden)
    layer("classifier.6", 1, hidden)
    return out


class WindowModel:
    """The source's CNN-Transformer in numpy, without dropout: an encoder of each subwindow, attention blocks over the subwindows, a head.

    ``weights`` holds the arrays of its state dictionary by name, all of them and no others (the user exports a
    checkpoint's ``model_state_dict`` to arrays, such as an npz file, which ``load`` reads).
    """

    HEADS, KEY, BLOCKS = 4, 32, 3

    def __init__(self, weights: dict[str, np.ndarray]):
        wanted, given = _shapes(), {k: np.shape(w) for k, w in weights.items()}
        if given != wanted:
            raise ValueError(f"weights that are missing, unknown or of another shape: {sorted(k for k in wanted.keys() | given.keys() if wanted.get(k) != given.get(k))}")
        self.weights = {k: np.asarray(w, float) for k, w in weights.items()}

    @classmethod
    def load(cls, path: str) -> WindowModel:
        with np.load(path) as arrays:
            return cls({k: arrays[k] for k in arrays.files})

    @classmethod
    def seeded(cls, seed: int = 0) -> WindowModel:
        """Random weights at the usual scale of each layer; norms start as the identity."""
        rng, out, fan = np.random.default_rng(seed), {}, 1
        for name, shape in _shapes().items():
            if name == "position_embedding":
                out[name] = rng.normal(0, 0.1, shape)
            elif "normalization" in name:
                out[name] = np.ones(shape) if name.endswith("weight") else np.zeros(shape)
            else:
                fan = int(np.prod(shape[1:])) if name.endswith("weight") else fan
                out[name] = rng.uniform(-1, 1, shape) / np.sqrt(fan)
        return cls(out)

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.weights[f"{name}.weight"].T + self.weights[f"{name}.bias"]

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        x = x - x.mean(-1, keepdims=True)
        return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-5) * self.weights[f"{name}.weight"] + self.weights[f"{name}.bias"]

    def _conv(self, x: np.ndarray, k: int) -> np.ndarray:
        """Along positions, of (subwindows, positions, channels), without padding."""
        w = self.weights[f"encoder.layers.{k}.weight"][..., 0]
        n = x.shape[1] - w.shape[2] + 1
        return sum(x[:, i : i + n] @ w[:, :, i].T for i in range(w.shape[2])) + self.weights[f"encoder.layers.{k}.bias"]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(subwindows, 64) of (subwindows, 200, channels)."""
        pool = lambda x: np.maximum(x[:, 0 : x.shape[1] // 2 * 2 : 2], x[:, 1::2])
        x = pool(x @ self.weights["encoder.layers.0.weight"][:, 0, 0].T + self.weights["encoder.layers.0.bias"])
        x = np.maximum(pool(self._conv(x, 2)), 0)
        x = np.maximum(pool(self._conv(pool(self._conv(x, 5)), 7)), 0)
        return self._conv(pool(self._conv(pool(self._conv(x, 10)), 12)), 14)[:, 0]

    def attend(self, x: np.ndarray, name: str) -> np.ndarray:
        q, k, v = (self._linear(x, f"{name}.{p}_projection").reshape(*x.shape[:2], self.HEADS, self.KEY).transpose(0, 2, 1, 3) for p in ("query", "key", "value"))
        w = q @ k.transpose(0, 1, 3, 2) / np.sqrt(self.KEY)
        w = np.exp(w - w.max(-1, keepdims=True))
        mixed = (w / w.sum(-1, keepdims=True)) @ v
        return self._linear(mixed.transpose(0, 2, 1, 3).reshape(*x.shape[:2], -1), f"{name}.output_projection")

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(windows, SUBWINDOWS) probabilities of (windows, POSITIONS, CHANNELS) features."""
        if x.shape[1:] != (POSITIONS, CHANNELS):
            raise ValueError(f"windows must be {POSITIONS} positions of {CHANNELS} channels")
        gelu = lambda x: x * 0.5 * (1 + _erf(x / np.sqrt(2)).astype(float))
        x = self.encode(np.asarray(x, float).reshape(len(x) * SUBWINDOWS, POSITIONS // SUBWINDOWS, CHANNELS)).reshape(len(x), SUBWINDOWS, -1)
        x = self._linear(x, "patch_projection") + self.weights["position_embedding"]
        for b in range(self.BLOCKS):
            at = f"transformer_blocks.{b}."
            x = x + self.attend(self._norm(x, at + "layer_normalization_1"), at + "attention")
            y = self._norm(x, at + "layer_normalization_2")
            for k in (0, 3):
                y = gelu(self._linear(y, at + f"feed_forward_network.{k}"))
            x = x + y
        x = self._norm(x, "sequence_normalization")
        for k in (0, 3):
            x = np.maximum(self._linear(x, f"classifier.{k}"), 0)
        return 1 / (1 + np.exp(-self._linear(x, "classifier.6")[..., 0]))


def model_scores(windows: DataFrame, model: WindowModel, key: str, features: str) -> DataFrame:
    """(key, probs) of windows whose ``features`` array holds POSITIONS * CHANNELS numbers, in Arrow batches; other sizes, and nulls, raise."""

    def apply(batches):
        for batch in batches:
            column = batch.column(1)
            if column.null_count or (np.diff(column.offsets.to_numpy()) != POSITIONS * CHANNELS).any():
                raise ValueError(f"a window's features must be {POSITIONS} positions of {CHANNELS} channels")
            flat = column.flatten()
            if flat.null_count:
                raise ValueError("a window's features can't be null")
            x = flat.to_numpy().reshape(-1, POSITIONS, CHANNELS)
            # One by one: results don't depend on how rows are dealt to batches.
            rows = [model.predict(x[i : i + 1])[0].tolist() for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=[key, "probs"])

    kind = windows.schema[key].dataType.simpleString()
    return windows.select(key, features).mapInArrow(apply, f"{key} {kind}, probs array<double>")


def residual_scores(focus: DataFrame, fraction: float = 0.5) -> DataFrame:
    """(pair_id, score) from (pair_id, hap_id, sv_id, sub, prob): repeats are averaged, then the best fraction of a site's subwindows on a haplotype, then haplotypes, then sites."""
    one = focus.groupBy("pair_id", "hap_id", "sv_id", "sub").agg(F.avg("prob").alias("prob"))
    site = ["pair_id", "hap_id", "sv_id"]
    ranked = one.withColumn("k", F.row_number().over(Window.partitionBy(*site).orderBy(F.desc("prob"), "sub"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*site)))
    best = ranked.where(F.col("k") <= F.greatest(F.ceil(F.col("n") * fraction), F.lit(1))).groupBy(*site).agg(F.avg("prob").alias("score"))
    return best.groupBy("pair_id", "sv_id").agg(F.avg("score").alias("score")).groupBy("pair_id").agg(F.avg("score").alias("score"))


def rank_classified(scored: DataFrame, by: str = "cluster") -> DataFrame:
    """Lower residual scores are better; ties go to the earlier prefilter rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("score", "prefilter_rank")).cast("int"))


def gate_rescue(state: Column, score: Column, sv_id: Column, present_ins: float, present_del: float, absent_ins: float, absent_del: float) -> Column:
    """A present allele over its type's limit becomes absent, an absent one at or over its limit present; ids of other types have limits of 1."""
    ins, gone = F.contains(sv_id, F.lit(".INS.")), F.contains(sv_id, F.lit(".DEL."))
    present = F.when(ins, present_ins).when(gone, present_del).otherwise(1.0)
    absent = F.when(ins, absent_ins).when(gone, absent_del).otherwise(1.0)
    return F.when((state == 1) & (score > present), 0).when((state == 0) & (score >= absent), 1).otherwise(state).cast("int")


def best_pair_sites(ranked: DataFrame, haplotypes: DataFrame, scores: DataFrame) -> DataFrame:
    """The sites of each cluster's first pair, for ``cluster_decisions``.

    ``ranked``: cluster, rank, pair_id, hap1_id, hap2_id; ``haplotypes``: cluster, hap_id, sv_id, state; ``scores``: cluster,
    hap_id, sv_id, score. A pair of unknown haplotypes, haplotypes with different sites, and sites without a score raise.
    """
    names = ["pair_id", "hap1_id", "hap2_id"]
    first = ranked.groupBy("cluster").agg(F.min_by(F.struct(*names), F.struct("rank", "pair_id")).alias("p")).select("cluster", "p.*")
    sides = first.select("cluster", *names, F.posexplode(F.array("hap1_id", "hap2_id")).alias("side", "hap_id"))
    met = sides.join(haplotypes.select("cluster", "hap_id", "sv_id", "state"), ["cluster", "hap_id"], "left")
    met = met.join(scores.select("cluster", "hap_id", "sv_id", "score"), ["cluster", "hap_id", "sv_id"], "left")
    at = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    rows = met.groupBy("cluster", *names, "sv_id").agg(*[at(k, c).alias(f"{c}{k + 1}") for c in ("state", "score") for k in (0, 1)])
    where = F.concat(F.col("cluster").cast("string"), F.lit(", pair "), F.col("pair_id"), F.lit(", site "), F.coalesce("sv_id", F.lit("?")))
    fault = lambda text: F.raise_error(F.concat(F.lit(text), where))
    checked = F.when(F.col("sv_id").isNull(), fault("unknown haplotypes in cluster ")).when(F.col("state1").isNull() | F.col("state2").isNull(), fault("haplotypes with different sites in cluster ")).when(F.col("score1").isNull() | F.col("score2").isNull(), fault("a score is missing in cluster "))
    return rows.withColumn("state1", F.coalesce(checked.cast("int"), F.col("state1")))


def cluster_decisions(best: DataFrame, **limits: float) -> DataFrame:
    """Decision of each site of the best pairs: (cluster, pair_id, hap1_id, hap2_id, sv_id, state1, state2, score1, score2) with final genotype and reason."""
    rows = best.withColumn("final1", gate_rescue(F.col("state1"), F.col("score1"), F.col("sv_id"), **limits)).withColumn("final2", gate_rescue(F.col("state2"), F.col("score2"), F.col("sv_id"), **limits))
    change = lambda k: F.when(F.col(f"final{k}") != F.col(f"state{k}"), F.concat(F.col(f"hap{k}_id"), F.lit(":"), F.col(f"state{k}").cast("string"), F.lit("->"), F.col(f"final{k}").cast("string")))
    reasons = F.concat_ws(",", change(1), change(2))
    genotype = lambda a, b: F.concat_ws("/", F.least(a, b), F.greatest(a, b))
    rows = rows.withColumn("original_gt", genotype("state1", "state2")).withColumn("final_gt", genotype("final1", "final2"))
    return rows.withColumn("reason", F.when(reasons == "", "unchanged").otherwise(reasons))


def integrity(focus: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row a rule with the number of rows that break it: predictions must be unique by key, focus rows have one and stay in range."""
    twice = predictions.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("broken")).withColumn("rule", F.lit("unique_prediction"))
    missing = focus.join(predictions.select("key").distinct(), "key", "left_anti").agg(F.count(F.lit(1)).alias("broken")).withColumn("rule", F.lit("has_prediction"))
    outside = focus.where(~F.col("sub").between(0, SUBWINDOWS - 1)).agg(F.count(F.lit(1)).alias("broken")).withColumn("rule", F.lit("subwindow_in_range"))
    return twice.unionByName(missing).unionByName(outside).select("rule", "broken")


def epoch_metrics(samples: DataFrame) -> DataFrame:
    """Precision, recall and F1 by element and for any positive, accuracies and exact matches, of rows (prediction, label: arrays of 0 and 1)."""
    both = F.zip_with("prediction", "label", lambda p, y: F.struct(p.alias("p"), y.alias("y")))
    count = lambda f: F.size(F.filter("b", f)).cast("long")
    rows = samples.withColumn("b", both).select(
        count(lambda x: (x["p"] == 1) & (x["y"] == 1)).alias("tp"),
        count(lambda x: (x["p"] == 1) & (x["y"] == 0)).alias("fp"),
        count(lambda x: (x["p"] == 0) & (x["y"] == 1)).alias("fn"),
        count(lambda x: x["p"] == x["y"]).alias("right"),
        F.size("b").cast("long").alias("n"),
        F.exists("prediction", lambda x: x == 1).alias("ap"),
        F.exists("label", lambda x: x == 1).alias("ay"),
    )
    sums = rows.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "right", "n")], F.count_if(F.col("right") == F.col("n")).alias("exact"), F.count(F.lit(1)).alias("rows"), F.count_if(F.expr("ap and ay")).alias("atp"), F.count_if(F.expr("ap and not ay")).alias("afp"), F.count_if(F.expr("not ap and ay")).alias("afn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = []
    for name, tp, fp, fn in (("element", "tp", "fp", "fn"), ("any_sv", "atp", "afp", "afn")):
        p, r = safe(F.col(tp), F.col(tp) + F.col(fp)), safe(F.col(tp), F.col(tp) + F.col(fn))
        out += [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), safe(2 * p * r, p + r).alias(f"{name}_f1")]
    return sums.select(*out, safe(F.col("right"), F.col("n")).alias("element_accuracy"), safe(F.col("exact"), F.col("rows")).alias("exact_match"))
