"""A classifier over the ordered drugs of an example and its disease: self-attention with masks, trained by synchronous gradients.

Each drug vector, with a code for its place, becomes a hidden row; masked self-attention lets the rows of a set see each other, so a rule on
pairs of drugs can be learned, which a mean of vectors can't hold; the rows are pooled by attention from the disease; a layer over
the pooled row and the disease vector gives the logit. Sets of any size have the same parameters.

Training: every step broadcasts the parameters, whose size depends on the widths alone; each partition returns one gradient summed over its
examples in bounded batches, and partial sums meet in a tree, so the driver adds FAN rows at most. A step is a function of the parameters and
the rows, so lost tasks are repeated without a trace.

Defined results: examples without drugs, or whose disease has no vector, have no features and no score; drugs without a vector are left out, and an
example is left out if none is left; null labels aren't learned from; without rows to learn from the start parameters stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regimen.operators import lookup
from regimen.sources.tables import written

#: Examples in one pass of a task, and numbers a matrix has in a pass over packed examples.
BATCH, CELLS = 256, 1 << 17


def sequence_features(df: DataFrame, drugs: DataFrame, diseases: DataFrame, key: str = "example_key", drug_set: str = "drug_set", condition: str = "condition_id_norm") -> DataFrame:
    """df with drug_vectors (array<array<float>>, in the order of the drugs) and disease_vector (array<float>)."""

    def make(rows: pa.RecordBatch, codes: np.ndarray, sizes: np.ndarray, drug: np.ndarray, disease: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep, codes, sizes = lookup.known(codes, sizes, disease)
        left, at = rows.filter(pa.array(keep)), np.concatenate([[0], np.cumsum(sizes)])
        for i in range(0, len(sizes), BATCH):  # a row has a vector for each of its drugs
            part, own_codes = left.slice(i, BATCH), codes[at[i] : at[min(i + BATCH, len(sizes))]]
            flat, beside = drug[own_codes], own[disease[keep][i : i + BATCH]]
            each = lookup.lists(np.full(len(flat), flat.shape[1]), pa.array(flat.ravel(), pa.float32()))
            other = lookup.lists(np.full(len(beside), beside.shape[1]), pa.array(beside.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lookup.lists(sizes[i : i + BATCH], each), other], [*part.schema.names, "drug_vectors", "disease_vector"])

    vector = T.ArrayType(T.FloatType())
    schema = T.StructType([*df.schema.fields, T.StructField("drug_vectors", T.ArrayType(vector)), T.StructField("disease_vector", vector)])
    return lookup.with_vectors(df, drugs, diseases, make, schema, "float", key, drug_set, condition)


def place_codes(n: int, dim: int) -> np.ndarray:
    """Sines and cosines of the places, as many as there are drugs in the longest set of a batch."""
    angles = np.arange(n)[:, None] / np.power(1000.0, (np.arange(dim) // 2 * 2 / max(1, dim))[None, :])
    return np.where(np.arange(dim) % 2 == 0, np.sin(angles), np.cos(angles))


def start_parameters(dim: int, disease_dim: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    make = lambda *shape: random.normal(0, 1 / math.sqrt(shape[0]), shape)
    return {"w_in": make(dim, hidden), "b_in": np.zeros(hidden), "w_q": make(hidden, hidden), "w_k": make(hidden, hidden), "w_v": make(hidden, hidden), "w_pool": make(disease_dim, hidden), "u_pool": random.normal(0, 1 / math.sqrt(hidden), hidden), "w_out": make(hidden + disease_dim, hidden), "b_out": np.zeros(hidden), "w_last": random.normal(0, 1 / math.sqrt(hidden), hidden), "b_last": np.zeros(1)}


def _softmax(scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
    scores = np.where(mask, scores, -np.inf)
    top = scores.max(axis=-1, keepdims=True)
    e = np.exp(scores - top)
    return e / e.sum(axis=-1, keepdims=True)


def forward(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, disease: np.ndarray, ordered: bool) -> tuple[np.ndarray, dict]:
    """Logits of a batch: x (examples, places, dim), mask (examples, places), disease (examples, disease_dim)."""
    x = x + place_codes(x.shape[1], x.shape[2]) if ordered else x
    h = np.tanh(x @ p["w_in"] + p["b_in"])
    q, k, v = h @ p["w_q"], h @ p["w_k"], h @ p["w_v"]
    a = _softmax(q @ k.transpose(0, 2, 1) / math.sqrt(h.shape[2]), mask[:, None, :])
    y = h + a @ v
    want = disease @ p["w_pool"] + p["u_pool"]
    share = _softmax(np.einsum("bmh,bh->bm", y, want), mask)
    r = np.einsum("bm,bmh->bh", share, y)
    both = np.concatenate([r, disease], axis=1)
    o = np.maximum(both @ p["w_out"] + p["b_out"], 0)
    return o @ p["w_last"] + p["b_last"][0], {"x": x, "h": h, "q": q, "k": k, "v": v, "a": a, "y": y, "want": want, "share": share, "both": both, "o": o}


def gradient(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, disease: np.ndarray, label: np.ndarray, ordered: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """The summed logistic loss of a batch and its gradient."""
    logit, s = forward(p, x, mask, disease, ordered)
    loss = float((np.logaddexp(0, logit) - label * logit).sum())
    g: dict[str, np.ndarray] = {}
    d_logit = 1 / (1 + np.exp(-logit)) - label
    g["b_last"], g["w_last"] = np.array([d_logit.sum()]), s["o"].T @ d_logit
    d_o = d_logit[:, None] * p["w_last"] * (s["o"] > 0)
    g["w_out"], g["b_out"] = s["both"].T @ d_o, d_o.sum(axis=0)
    hidden = len(p["b_in"])
    d_r = (d_o @ p["w_out"].T)[:, :hidden]
    d_share = np.einsum("bh,bmh->bm", d_r, s["y"])
    d_y = s["share"][:, :, None] * d_r[:, None, :]
    d_score = s["share"] * (d_share - (s["share"] * d_share).sum(axis=1, keepdims=True))
    d_want = np.einsum("bm,bmh->bh", d_score, s["y"])
    d_y = d_y + d_score[:, :, None] * s["want"][:, None, :]
    g["w_pool"], g["u_pool"] = disease.T @ d_want, d_want.sum(axis=0)
    d_a, d_v = d_y @ s["v"].transpose(0, 2, 1), s["a"].transpose(0, 2, 1) @ d_y
    d_e = s["a"] * (d_a - (s["a"] * d_a).sum(axis=2, keepdims=True)) / math.sqrt(hidden)
    d_q, d_k = d_e @ s["k"], d_e.transpose(0, 2, 1) @ s["q"]
    d_h = d_y + d_q @ p["w_q"].T + d_k @ p["w_k"].T + d_v @ p["w_v"].T
    flat = lambda t: t.reshape(-1, t.shape[2])
    g["w_q"], g["w_k"], g["w_v"] = flat(s["h"]).T @ flat(d_q), flat(s["h"]).T @ flat(d_k), flat(s["h"]).T @ flat(d_v)
    d_in = d_h * (1 - s["h"] ** 2)
    g["w_in"], g["b_in"] = flat(s["x"]).T @ flat(d_in), d_in.sum(axis=(0, 1))
    return loss, g


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """x, mask, disease and the rows they stand for, sets of like sizes together."""
    vectors, disease = batch.column("drug_vectors"), batch.column("disease_vector")
    for at in range(0, batch.num_rows, BATCH):
        part, own = vectors.slice(at, BATCH), disease.slice(at, BATCH)
        sizes = np.asarray(pc.list_value_length(part), np.int64)
        flat = np.asarray(part.flatten().flatten(), np.float64).reshape(int(sizes.sum()), -1)
        x, mask = np.zeros((len(part), int(sizes.max()), flat.shape[1])), np.arange(int(sizes.max()))[None, :] < sizes[:, None]
        x[mask] = flat
        yield x, mask, np.asarray(own.flatten(), np.float64).reshape(len(part), -1), at, len(part)


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def summed_gradient(rows: DataFrame, p: dict[str, np.ndarray], ordered: bool, fan: int | None = None) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, number of examples and gradient over rows (drug_vectors, disease_vector, label)."""
    shared = rows.sparkSession.sparkContext.broadcast(p)

    def own(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        label = np.asarray(batch.column("label"), np.float64)
        for x, mask, disease, at, n in _batches(batch):
            loss, g = gradient(shared.value, x, mask, disease, label[at : at + n], ordered)
            yield np.concatenate([[loss, n], _flat(g)])

    total = lookup.tree_sum(rows, sum(v.size for v in p.values()) + 2, own, fan)
    shared.unpersist()
    return float(total[0]), int(total[1]), _unflat(total[2:], p)


def packed_gradient(packs: DataFrame, p: dict[str, np.ndarray], ordered: bool, fan: int | None = None) -> tuple[float, int, dict[str, np.ndarray]]:
    """summed_gradient over the rows of lookup.packed: a vector meets the first layer once a part and not once for each example that names it."""
    shared = packs.sparkSession.sparkContext.broadcast(p)

    def own(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for pack in lookup.packs(batch):
            for loss, n, g in _pack_gradients(shared.value, pack, ordered):
                yield np.concatenate([[loss, n], _flat(g)])

    total = lookup.tree_sum(packs, sum(v.size for v in p.values()) + 2, own, fan)
    shared.unpersist()
    return float(total[0]), int(total[1]), _unflat(total[2:], p)


def _by_size(sizes: np.ndarray, hidden: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one size and where their codes are (rows, places), some at a time."""
    firsts, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
        m = int(sizes[rows[0]])
        step = max(1, CELLS // (m * (m + hidden)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, firsts[some][:, None] + np.arange(m)[None, :]


def _projected(p: dict[str, np.ndarray], pack: lookup.Pack, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of the first steps that depend on one drug, one place or one disease."""
    hidden, top = len(p["b_in"]), int(pack.sizes.max(initial=0))
    places = place_codes(top, pack.drugs.shape[1]) if ordered else np.zeros((top, pack.drugs.shape[1]))
    return pack.drugs @ p["w_in"] + p["b_in"], places @ p["w_in"], pack.diseases @ p["w_pool"] + p["u_pool"], pack.diseases @ p["w_out"][hidden:] + p["b_out"]


def _softmaxed(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _attended(p: dict[str, np.ndarray], h: np.ndarray, want: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of examples of one size, from their hidden rows on."""
    b, m, hidden = h.shape
    q, k, v = np.moveaxis((h.reshape(-1, hidden) @ np.concatenate([p["w_q"], p["w_k"], p["w_v"]], axis=1)).reshape(b, m, 3, hidden), 2, 0)
    a = _softmaxed(q @ k.transpose(0, 2, 1) / math.sqrt(hidden))
    y = h + a @ v
    share = _softmaxed((y @ want[:, :, None])[:, :, 0])
    r = (share[:, None, :] @ y)[:, 0]
    o = np.maximum(r @ p["w_out"][:hidden] + beside, 0)
    return o @ p["w_last"] + p["b_last"][0], {"q": q, "k": k, "v": v, "a": a, "y": y, "share": share, "r": r, "o": o}


def _pack_logits(p: dict[str, np.ndarray], pack: lookup.Pack, ordered: bool) -> np.ndarray:
    drugs, places, want, beside = _projected(p, pack, ordered)
    out = np.zeros(len(pack.sizes))
    for rows, at in _by_size(pack.sizes, drugs.shape[1]):
        own = pack.own[rows]
        out[rows] = _attended(p, np.tanh(drugs[pack.codes[at]] + places[: at.shape[1]]), want[own], beside[own])[0]
    return out


def _pack_gradients(p: dict[str, np.ndarray], pack: lookup.Pack, ordered: bool) -> Iterator[tuple[float, int, dict[str, np.ndarray]]]:
    """gradient, of some of the pack's examples at a time."""
    drugs, places, want, beside = _projected(p, pack, ordered)
    hidden, dim = drugs.shape[1], pack.drugs.shape[1]
    for rows, at in _by_size(pack.sizes, hidden):
        codes, own, label, m = pack.codes[at], pack.own[rows], pack.label[rows], at.shape[1]
        h = np.tanh(drugs[codes] + places[:m])
        logit, s = _attended(p, h, want[own], beside[own])
        g: dict[str, np.ndarray] = {}
        d_logit = 1 / (1 + np.exp(-logit)) - label
        g["b_last"], g["w_last"] = np.array([d_logit.sum()]), s["o"].T @ d_logit
        d_o = d_logit[:, None] * p["w_last"] * (s["o"] > 0)
        disease = pack.diseases[own].astype(np.float64)
        g["w_out"], g["b_out"] = np.concatenate([s["r"].T @ d_o, disease.T @ d_o]), d_o.sum(axis=0)
        d_r = d_o @ p["w_out"].T[:, :hidden]
        d_share = (s["y"] @ d_r[:, :, None])[:, :, 0]
        d_score = s["share"] * (d_share - (s["share"] * d_share).sum(axis=1, keepdims=True))
        d_want = (d_score[:, None, :] @ s["y"])[:, 0]
        g["w_pool"], g["u_pool"] = disease.T @ d_want, d_want.sum(axis=0)
        d_y = s["share"][:, :, None] * d_r[:, None, :] + d_score[:, :, None] * want[own][:, None, :]
        d_a, d_v = d_y @ s["v"].transpose(0, 2, 1), s["a"].transpose(0, 2, 1) @ d_y
        d_e = s["a"] * (d_a - (s["a"] * d_a).sum(axis=2, keepdims=True)) / math.sqrt(hidden)
        d_qkv = np.concatenate([d_e @ s["k"], d_e.transpose(0, 2, 1) @ s["q"], d_v], axis=2).reshape(-1, 3 * hidden)
        g["w_q"], g["w_k"], g["w_v"] = np.split(h.reshape(-1, hidden).T @ d_qkv, 3, axis=1)
        d_h = d_y + (d_qkv @ np.concatenate([p["w_q"], p["w_k"], p["w_v"]], axis=1).T).reshape(h.shape)
        d_in = d_h * (1 - h**2)
        g["b_in"] = d_in.sum(axis=(0, 1))
        g["w_in"] = pack.drugs[codes.ravel()].astype(np.float64).T @ d_in.reshape(-1, hidden)
        if ordered:
            g["w_in"] = g["w_in"] + place_codes(m, dim).T @ d_in.sum(axis=0)
        yield float((np.logaddexp(0, logit) - label * logit).sum()), len(rows), g


@dataclass
class AttentionModel:
    parameters: dict[str, np.ndarray]
    ordered: bool
    losses: list[float] = field(default_factory=list)

    def score(self, df: DataFrame, drug_set: str = "drug_set") -> DataFrame:
        """df (with drug_vectors and disease_vector, which go) with prob (of label 1) and length."""
        shared, ordered = df.sparkSession.sparkContext.broadcast(self.parameters), self.ordered
        rest = [c for c in df.columns if c not in ("drug_vectors", "disease_vector", "prob")]
        schema = df.select(rest).schema.add("prob", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, mask, disease, at, n in _batches(batch):
                    logit, _ = forward(shared.value, x, mask, disease, ordered)
                    part = batch.slice(at, n)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(1 / (1 + np.exp(-logit)))], [*rest, "prob"])

        ready = df.where("size(drug_vectors) > 0 and disease_vector is not null")
        return ready.mapInArrow(run, schema).withColumn("length", F.size(drug_set))

    def score_examples(self, df: DataFrame, drugs: DataFrame, diseases: DataFrame, key: str = "example_key", drug_set: str = "drug_set", condition: str = "condition_id_norm") -> DataFrame:
        """score of sequence_features(df, drugs, diseases), without a vector made for every drug of an example."""
        shared, ordered, nothing = df.sparkSession.sparkContext.broadcast(self.parameters), self.ordered, np.zeros(0)

        def make(rows: pa.RecordBatch, codes: np.ndarray, sizes: np.ndarray, drug: np.ndarray, disease: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            keep, codes, sizes = lookup.known(codes, sizes, disease)
            if keep.any():
                left = rows.filter(pa.array(keep))
                logit = _pack_logits(shared.value, lookup.Pack(drug, own, codes, sizes, disease[keep], nothing), ordered)
                yield pa.RecordBatch.from_arrays([*left.columns, pa.array(1 / (1 + np.exp(-logit)))], [*left.schema.names, "prob"])

        schema = T.StructType([*df.schema.fields, T.StructField("prob", T.DoubleType())])
        return lookup.with_vectors(df, drugs, diseases, make, schema, "float", key, drug_set, condition).withColumn("length", F.size(drug_set))


def fit(train: DataFrame, hidden: int = 32, steps: int = 150, rate: float = 0.02, decay: float = 1e-4, ordered: bool = True, seed: int = 13, label: str = "label") -> AttentionModel:
    """Learns from the rows of sequence_features by Adam on the whole gradient. ordered: whether the places of the drugs count."""
    rows = train.where(F.col(label).isNotNull() & (F.size("drug_vectors") > 0) & F.col("disease_vector").isNotNull())
    rows = written(rows.select("drug_vectors", "disease_vector", F.col(label).cast("double").alias("label")), "attention-rows")
    first = rows.select(F.size(F.col("drug_vectors")[0]).alias("dim"), F.size("disease_vector").alias("disease_dim")).first()
    if first is None:
        return AttentionModel(start_parameters(1, 1, hidden, seed), ordered)
    return _fitted(lambda p: summed_gradient(rows, p, ordered), start_parameters(first["dim"], first["disease_dim"], hidden, seed), steps, rate, decay, ordered)


def fit_examples(train: DataFrame, drugs: DataFrame, diseases: DataFrame, hidden: int = 32, steps: int = 150, rate: float = 0.02, decay: float = 1e-4, ordered: bool = True, seed: int = 13, label: str = "label") -> AttentionModel:
    """fit over sequence_features(train, drugs, diseases), from examples that are stored by the codes of their names (lookup.packed)."""
    packs = lookup.packed(train, drugs, diseases, label)
    first = packs.select("dim", "disease_dim").first()
    if first is None:
        return AttentionModel(start_parameters(1, 1, hidden, seed), ordered)
    return _fitted(lambda p: packed_gradient(packs, p, ordered), start_parameters(first["dim"], first["disease_dim"], hidden, seed), steps, rate, decay, ordered)


def _fitted(summed: Callable[[dict[str, np.ndarray]], tuple[float, int, dict[str, np.ndarray]]], p: dict[str, np.ndarray], steps: int, rate: float, decay: float, ordered: bool) -> AttentionModel:
    mean, square, losses = np.zeros_like(_flat(p)), np.zeros_like(_flat(p)), []
    for step in range(1, steps + 1):
        loss, n, g = summed(p)
        losses.append(loss / n)
        flat = _flat(p)
        by = _flat(g) / n + decay * flat
        mean, square = 0.9 * mean + 0.1 * by, 0.99 * square + 0.01 * by * by
        p = _unflat(flat - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8), p)
    return AttentionModel(p, ordered, losses)
