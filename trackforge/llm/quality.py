"""Quality classifier: gated attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes.  Each passage is encoded
from its byte-class bigrams and word statistics; a gated attention layer (Ilse,
Tomczak and Welling, 2018) weighs the encoded passages, and the weighted sum is
scored.  Only document labels are needed: the attention learns which passages
decide.  Encoder, attention and scorer are trained together in numpy on a
bounded sample of labelled rows (``SAMPLE`` per label), each with all its passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import per_class
from .shared import doc_crc, table

PASSAGE = 512
SAMPLE = 1500
HIDDEN, ATTENTION = 24, 12
EPOCHS = 40

_CLASS = np.full(256, 9, np.int32)  # other punctuation and control
for _n, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" ", b"\n\r", b".", b",;:", b"!?", b"|#$%&*@^~=_<>/\\")):
    _CLASS[list(_bytes)] = _n
_CLASS[0x80:] = 10
N_CLASS = 11
N_FEATURES = N_CLASS * N_CLASS + N_CLASS + 4


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and, for each text, where its passages start.

    A null or empty text has one passage without content.
    """
    buf, offs = K.text_bytes(column)
    sizes = np.diff(offs)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    x = np.zeros((n, N_FEATURES), np.float32)
    if len(buf):
        of = np.repeat(first, sizes) + (np.arange(len(buf)) - np.repeat(offs[:-1], sizes)) // PASSAGE
        kind = _CLASS[buf]
        length = np.bincount(of, minlength=n).astype(np.float32)
        x[:, : N_CLASS] = np.bincount(of * N_CLASS + kind, minlength=n * N_CLASS).reshape(n, -1)
        same = of[1:] == of[:-1]
        pair = (of[1:] * (N_CLASS * N_CLASS) + kind[:-1] * N_CLASS + kind[1:])[same]
        x[:, N_CLASS : N_CLASS + N_CLASS * N_CLASS] = np.bincount(pair, minlength=n * N_CLASS * N_CLASS).reshape(n, -1)
        x[:, : N_CLASS * (N_CLASS + 1)] /= np.maximum(length, 1)[:, None]
        starts, ends, rows = K.word_spans(buf, offs, K.NOT_SPACE)
        if len(starts):
            where, h = of[starts], K.word_hashes(buf, starts, ends)
            words = np.maximum(np.bincount(where, minlength=n), 1)
            again = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
            _, at = K.row_sets(h, where, n)
            x[:, -4] = np.bincount(where[1:][again], minlength=n) / words
            x[:, -3] = np.diff(at) / words
            x[:, -2] = np.bincount(where, weights=ends - starts, minlength=n) / words / 10
        x[:, -1] = np.minimum(length / PASSAGE, 1)
    return np.sqrt(x), first


class Model:
    """Parameters and the forward and backward passes over bags of passages."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        new = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "enc": new(N_FEATURES, HIDDEN), "enc0": np.zeros(HIDDEN, np.float32),
            "v": new(HIDDEN, ATTENTION), "v0": np.zeros(ATTENTION, np.float32),
            "u": new(HIDDEN, ATTENTION), "u0": np.zeros(ATTENTION, np.float32),
            "w": new(ATTENTION, 1), "out": new(HIDDEN, 1), "out0": np.zeros(1, np.float32),
        }
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["enc"] + p["enc0"])
        t, s = np.tanh(h @ p["v"] + p["v0"]), _sigmoid(h @ p["u"] + p["u0"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e[:, 0] - np.maximum.reduceat(e[:, 0], first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = _sigmoid((z @ p["out"] + p["out0"])[:, 0])
        if keep is not None:
            keep.update(x=x, h=h, t=t, s=s, a=a, z=z, y=y, bag=bag)
        return y

    def gradients(self, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        k: dict = {}
        y = self.forward(x, first, k)
        p, g = self.p, {}
        dy = ((y - target) / len(target))[:, None]
        g["out"], g["out0"] = k["z"].T @ dy, dy.sum(axis=0)
        dz = (dy @ p["out"].T)[k["bag"]]
        dh = k["a"][:, None] * dz
        da = (dz * k["h"]).sum(axis=1)
        de = (k["a"] * (da - np.add.reduceat(k["a"] * da, first)[k["bag"]]))[:, None]
        g["w"] = (k["t"] * k["s"]).T @ de
        gate = de @ p["w"].T
        dt, ds = gate * k["s"] * (1 - k["t"] ** 2), gate * k["t"] * k["s"] * (1 - k["s"])
        g["v"], g["v0"], g["u"], g["u0"] = k["h"].T @ dt, dt.sum(axis=0), k["h"].T @ ds, ds.sum(axis=0)
        dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (1 - k["h"] ** 2)
        g["enc"], g["enc0"] = k["x"].T @ dh, dh.sum(axis=0)
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(bags: list[np.ndarray], target: np.ndarray, seed: int = 5) -> Model:
    """Adam with weight decay on the mean log loss; one bag per document."""
    model = Model()
    if not bags or len(set(target.tolist())) < 2:
        model.p["out"][:] = 0  # nothing to tell apart: one score for all
        model.p["out0"][:] = 4 if len(bags) and target.all() else -4 if len(bags) else 0
        return model
    every = np.concatenate(bags)
    model.mean, model.scale = every.mean(axis=0), every.std(axis=0) + 0.02
    rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            lens = np.array([len(bags[i]) for i in batch])
            g = model.gradients(np.concatenate([bags[i] for i in batch]), np.cumsum(lens) - lens, target[batch])
            step += 1
            rate = 0.005 * (1 - epoch / EPOCHS)
            for name, d in g.items():
                m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                v[name] = 0.999 * v.get(name, 0) + 0.001 * d**2
                fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model.p[name] = (model.p[name] * (1 - 1e-4) - rate * fix * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)`` of 0 or 1.

    Other labels and null ones do not count; of different labels of one document the
    lower counts; rows without an id have none; several rows of one id all count.  With
    labels of one kind only, or none, all texts get one score.

    The sampled labels are about ``sample`` rows for each of the two, whatever the
    input, and so they are sent to all tasks; texts are not shuffled for them.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(per_class(known, "quality", "doc_id", sample))
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                x, first = passages(batch.column("text"))
                out = [x[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(x)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.binary())], names=["doc_id", "quality", "x"])

    got = rows.selectExpr("cast(doc_id as long) doc_id", "text", "cast(quality as int) quality").mapInArrow(run, "doc_id long, quality int, x binary").toPandas()
    got = got.sort_values(["doc_id", "quality", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, N_FEATURES) for b in got["x"]]
    return fit(bags, (got["quality"].to_numpy() > 0).astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, score``; one row per row.

    Null and empty texts are one passage without content; repeated rows get equal
    scores; a null doc_id stays null; an empty table gives no rows.  Every passage
    of a text counts, however long it is.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
                x, first = passages(batch.column("text"))
                y = shared.value.forward(x, first).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(y)], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` of the whole documents table, learned from labels whose crc32(doc_id)
    mod 3 is not 1; null ids are not held out."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fold = F.pmod(doc_crc(), F.lit(3))
    model = train(docs.where(fold != 1), table(spark, sf_dir, "labels").where(fold != 1))
    return score(docs, model).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
