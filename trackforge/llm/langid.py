"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (letters only,
everything else one space); a linear layer and a softmax give the language.
Embeddings and layer are trained by stochastic gradient descent in numpy on a
bounded sample of rows (``SAMPLE`` texts per language).  Of each the whole text
and shorter snippets count: executors turn them into n-gram counts, of which at
most ``BUCKETS`` are kept, however long the text, and one task learns from them.

A text is rejected for being unlike all that was learned, not for being torn between
languages: its familiarity is the mean log share of its n-grams in the training
texts of all languages together, so a text in two of them is as familiar as its
parts.  A held-back part of the sample sets the temperature, and for each size of
text the familiarity under which only ``REJECT_SHARE`` of its texts lie.

As the text vector is a mean, embedding and layer fold into one table of
n-gram scores, and whole texts are scored by summing table rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from zlib import compress, crc32, decompress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .sampling import per_class
from .shared import doc_crc, table

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
DIM = 16
SAMPLE = 900  # rows per language
MOST_ROWS = 14_400  # of all languages together: beyond 16 languages each has fewer
EPOCHS = 4
REJECT_SHARE = 0.001  # of the calibration texts of a size
UNKNOWN = "und"

_PLAIN = np.full(256, 0x20, np.uint8)
for _b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _PLAIN[_b] = K.FOLD[_b]


def grams(buf: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each n; ``BUCKETS`` (a row
    of zeros) where it would leave the text or is a run of spaces."""
    plain = _PLAIN[buf].astype(np.uint32)
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(buf))
    code = plain.copy()
    for n in range(2, max(GRAMS) + 1):
        code[: max(0, len(buf) - n + 1)] |= plain[n - 1 :] << np.uint32(8 * (n - 1))
        if n in GRAMS:
            part = code.astype(np.uint64) & K.U64((1 << (8 * n)) - 1)
            h = (K.mix(part + K.U64(n << 40)) >> K.U64(49)).astype(np.int64)
            h[(left < n) | ((part & K.U64(0xFFFF)) == K.U64(0x2020))] = BUCKETS
            yield h


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS + 1) x languages
    bias: np.ndarray
    temperature: float
    familiar: np.ndarray  # log share of each bucket in training
    limits: np.ndarray  # least familiarity by the binary logarithm of the number of n-grams

    def measure(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, familiarity and number of n-grams of each text."""
        buf, offs = K.text_bytes(column)
        out = np.zeros((len(column), len(self.languages)), np.float64)
        known, count = np.zeros(len(column)), np.zeros(len(column))
        some = np.flatnonzero(np.diff(offs))
        if len(some):
            for h in grams(buf, offs):
                count[some] += np.add.reduceat((h < BUCKETS).astype(np.int64), offs[some])
                known[some] += np.add.reduceat(self.familiar[h], offs[some], dtype=np.float64)
                for c in range(len(self.languages)):
                    out[some, c] += np.add.reduceat(self.scores[:, c][h], offs[some], dtype=np.float64)
        out /= np.maximum(count, 1)[:, None]
        return (out + self.bias) / self.temperature, known / np.maximum(count, 1), count

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is rejected, for each text."""
        texts = column.to_pylist()
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, known, count = self.measure(column)
        p = softmax(logits)
        best = p.argmax(axis=1)
        score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        strange = (count > 0) & (known < self.limits[sizes(count)])
        return names, score, ~lettered | strange


SIZES = 40


def sizes(count: np.ndarray) -> np.ndarray:
    """Size class of texts by their number of n-grams."""
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), SIZES - 1)


def _limits(known: np.ndarray, count: np.ndarray, least: int = 200) -> np.ndarray:
    """The rejection limit of each size class, from calibration texts of about that size;
    classes with fewer than ``least`` of those take the limit of the class below."""
    out, kind = np.full(SIZES, -np.inf), sizes(count)
    for k in range(SIZES):
        near = known[np.abs(kind - k) <= 1]
        out[k] = np.quantile(near, REJECT_SHARE) if len(near) >= least else out[k - 1] if k else -np.inf
    return out


def _untaught() -> Model:
    return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0, np.zeros(BUCKETS + 1), np.full(SIZES, -np.inf))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _snippets(text: str) -> list[str]:
    """The text and, for training on short ones too, three pieces of it."""
    rng = np.random.default_rng(crc32(text.encode()))
    out = [text]
    for size in (24, 80, 300):
        if len(text) > size:
            at = int(rng.integers(0, len(text) - size + 1))
            out.append(text[at : at + size])
    return out


@dataclass
class Bag:
    """The n-grams of a text: distinct buckets and how often each occurs."""

    cells: np.ndarray
    counts: np.ndarray

    def share(self) -> np.ndarray:
        return (self.counts / self.counts.sum()).astype(np.float32)


def bag(text: str) -> Bag:
    buf, offs = K.text_bytes(pa.array([text]))
    n = np.zeros(BUCKETS + 1, np.int64)
    if len(buf):
        for h in grams(buf, offs):
            n += np.bincount(h, minlength=BUCKETS + 1)
    cells = np.flatnonzero(n[:BUCKETS])
    return Bag(cells.astype(np.uint16), n[cells].astype(np.uint32))


def fit(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Train on three quarters of the texts, calibrate on the rest."""
    return learn([[bag(s) for s in _snippets(t)] for t in texts], labels, seed)


def learn(bags: list[list[Bag]], labels: list[str], seed: int = 7) -> Model:
    """As ``fit``, of the bags of each text and its snippets."""
    languages = sorted(set(labels))
    if not languages:
        return _untaught()
    rng = np.random.default_rng(seed)
    number = {name: i for i, name in enumerate(languages)}
    items, y, held = [], [], []
    for i, (each, name) in enumerate(zip(bags, labels, strict=True)):
        for b in each:
            if len(b.cells):
                items.append(b)
                y.append(number[name])
                held.append(i % 4 == 3)
    y, held = np.array(y, np.int64), np.array(held, bool)
    if not len(y):
        return _untaught()
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    emb = rng.normal(0, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[BUCKETS] = 0
    layer, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, size = 0, 32
    total = EPOCHS * -(-len(train) // size)
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for at in range(0, len(order), size):
            rate = 1.0 * (1 - steps / total)
            batch = order[at : at + size]
            flat = np.concatenate([items[i].cells for i in batch]).astype(np.int64)
            share = np.concatenate([items[i].share() for i in batch])[:, None]
            lens = np.array([len(items[i].cells) for i in batch])
            mean = np.add.reduceat(emb[flat] * share, np.cumsum(lens) - lens, axis=0)
            g = softmax(mean @ layer + bias)
            g[np.arange(len(batch)), y[batch]] -= 1
            back = (g @ layer.T).astype(np.float32)
            layer -= rate * mean.T @ g / len(batch)
            bias -= rate * g.mean(axis=0)
            owner = np.repeat(np.arange(len(batch)), lens)
            place = np.argsort(flat, kind="stable")
            cells, first = np.unique(flat[place], return_index=True)
            emb[cells] -= rate * np.add.reduceat((back[owner] * share)[place], first, axis=0)
            steps += 1
    scores = (emb @ layer).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else train
    raw = np.stack([items[i].share() @ scores[items[i].cells] for i in check]).astype(np.float64) + bias
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    temperature = min(np.geomspace(0.2, 5, 33), key=loss)
    seen = np.zeros(BUCKETS + 1)
    for i in train:
        seen[items[i].cells] += items[i].counts
    familiar = np.log((seen + 1) / (seen.sum() + BUCKETS))
    familiar[BUCKETS] = 0
    known = np.array([items[i].share() @ familiar[items[i].cells] for i in check])
    limits = _limits(known, np.array([items[i].counts.sum() for i in check]))
    return Model(languages, scores, bias.astype(np.float64), float(temperature), familiar, limits)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text: its bag and those of its snippets, pickled."""
    for whole in batches:
        for batch in K.slices(whole, "text"):
            texts = batch.column("text").to_pylist()
            tags = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            bags = [compress(pickle.dumps([bag(s) for s in _snippets(t)])) for t in texts]
            columns = [batch.column("lang"), batch.column("doc_id"), pa.array(tags, pa.string()), pa.array(bags, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "doc_id", "tag", "bags"])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a whole sample, pickled; no row without texts."""
    parts = [b.to_pandas() for b in batches]
    if not parts:
        return
    # in an order of their own; equal rows have equal bags
    found = pd.concat(parts).sort_values(["lang", "doc_id", "tag"], ignore_index=True)
    found = found.iloc[np.random.default_rng(3).permutation(len(found))]
    model = learn([pickle.loads(decompress(b)) for b in found["bags"]], list(found["lang"]))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text, lang)`` where text and lang are not null: about
    ``sample`` rows of each language, ``MOST_ROWS`` of all, whole texts.  Without such
    rows the model knows no language and rejects all texts.  One task learns from the
    sample, so that the driver receives the model only.
    """
    rows = per_class(docs.where("text is not null and lang is not null").select("doc_id", "lang", "text"), "lang", "doc_id", sample, MOST_ROWS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_bags, f"lang string, doc_id {kind}, tag string, bags binary")
    learned = found.repartition(1).mapInArrow(_learned, "model binary").collect()
    return pickle.loads(learned[0]["model"]) if learned else _untaught()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, lang_pred, score, rejected``; one row per row.

    ``und`` with score 0, and rejected, where the text is null, empty or has no letter,
    or where there was nothing to learn from.  A null doc_id stays null, repeated rows
    are judged alike, and of equally likely languages the first by name counts.
    Texts are scored whole, however long; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
                lang, score, rejected = shared.value.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` over the whole documents table, learned from the rows whose
    crc32(doc_id) mod 5 is not 0; null ids are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(doc_crc(), F.lit(5))
    found = identify(docs, train(docs.where(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, whose language is recognised.

    Two models learn from the ``lang`` values of one half of the texts each (by a hash
    of the text, so copies stay together), and each judges the other half.  Null, empty
    and letterless texts go; rows without an id or a language are judged like others,
    and repeated rows stay or go together.  Where a half has nothing to learn from, both
    halves are judged by the other model; where neither has, all rows go.
    """
    names = docs.columns
    half = next(n for i in range(len(names) + 1) if (n := f"half_{i}") not in {c.lower() for c in names})
    parted = docs.withColumn(half, F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))
    with ThreadPoolExecutor(2) as pool:
        started = [pool.submit(inheritable_thread_target(docs.sparkSession)(train), parted.where(F.col(half) != i)) for i in (0, 1)]
    models = [s.result() for s in started]
    models = [m if m.languages else models[1 - i] for i, m in enumerate(models)]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
                mine = batch.column(half).to_numpy()
                keep = np.zeros(batch.num_rows, bool)
                for i, model in enumerate(shared.value):
                    rows = np.flatnonzero(mine == i)
                    if len(rows):
                        keep[rows] = ~model.predict(batch.column("text").take(pa.array(rows)))[2]
                yield batch.select(names).filter(pa.array(keep))

    return parted.mapInArrow(run, docs.schema)
