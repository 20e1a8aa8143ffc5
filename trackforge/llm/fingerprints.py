"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles, so the sketch of several parts is the ``k`` smallest of their sketches
together.  Sketches estimate resemblance, containment and the number of
distinct shingles; below ``k`` shingles all three are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import extended, shuffle_width, table

SIZE = 128
SHINGLE = 5
NULL_ID = -(1 << 63)  # place of rows without an id: after all others


def sketches(column: pa.Array, size: int = SIZE, k: int = SHINGLE) -> list[np.ndarray]:
    """Bottom-k sketch of each text; no values for null, empty and wordless ones."""
    buf, offs = K.text_bytes(column)
    starts, ends, rows = K.word_spans(buf, offs, K.NOT_SPACE)
    own, own_rows = K.shingles(K.word_hashes(buf, starts, ends), rows, len(column), k)
    values, at = K.row_sets(own, own_rows, len(column))
    return [values[a : min(a + size, b)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of common shingles in the union; 1 for two empty sketches."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.ones(len(both), bool)
    first[1:] = ~twice
    n = min(size, int(first.sum()))
    limit = both[first][n - 1]
    return float(np.count_nonzero(twice & (both[1:] <= limit))) / n


def distinct_count(a: np.ndarray, size: int = SIZE) -> float:
    """Number of distinct shingles."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the first part's shingles that the second has too; 1 if it has none."""
    if not len(a):
        return 1.0
    union = distinct_count(merge(a, b, size), size)
    return min(1.0, resemblance(a, b, size) * union / distinct_count(a, size))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``fingerprint``: the sketch of each whole text."""
    names = docs.columns
    taken = {n.lower() for n in names}
    out = next(n for n in ("fingerprint", *(f"fingerprint_{i}" for i in range(len(names) + 1))) if n.lower() not in taken)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, text):
                marks = pa.array([encode(a) for a in sketches(batch.column(text))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*names, out])

    return docs.mapInArrow(run, extended(docs.schema, **{out: "string"}))


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its successor in the part, over sorted parts."""
    held: tuple | None = None  # last row of the slice before
    for whole in batches:
        for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not use:
                continue
            texts = [r[3] or "" for r in rows]
            edited = []
            for i in use:
                n = len(texts[i])
                edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
            own = sketches(pa.array(texts, pa.large_string()))
            new = sketches(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in use], pa.int64()),
                    pa.array([len(texts[i]) for i in use], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([encode(own[i]) for i in use], pa.string()),
                    pa.array([encode(a) for a in new], pa.string()),
                    pa.array([resemblance(own[i], a) for i, a in zip(use, new, strict=True)], pa.float64()),
                    pa.array([resemblance(own[i], own[i + 1]) for i in use], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    In the edited text the last floor(n / 2) code points give way to the first
    as many of the next document, by descending doc_id, the first following the
    last.  One row per row, none for an empty table; whole texts, however long; other
    columns are not read.  Texts move once, to ranges of doc_id; the first document of each range
    is also sent to the range before it, so that every row meets its successor.

    Null texts are empty.  Repeated ids follow each other by descending text;
    rows without an id come last.  A single row follows itself.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("place", F.coalesce("doc_id", F.lit(NULL_ID)))
    parts = shuffle_width(spark)
    cuts = base.agg(F.percentile_approx("place", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def part_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, place.to_numpy(np.int64), side="left").astype(np.int32))

    heads = base.select("place").withColumn("part", part_of("place")).groupBy("part").agg(F.max("place").alias("head")).orderBy("part").collect()
    order = [r["part"] for r in heads]  # at most one row per part
    visits = {int(r["head"]): order[(i + 1) % len(order)] for i, r in enumerate(heads)}

    @F.pandas_udf("array<struct<part:int,guest:boolean>>")
    def places(place: pd.Series) -> pd.Series:
        home = np.searchsorted(cuts, place.to_numpy(np.int64), side="left")
        return pd.Series([[{"part": int(h), "guest": False}] + ([{"part": visits[int(p)], "guest": True}] if int(p) in visits else []) for p, h in zip(place, home, strict=True)])

    dealt = base.select("doc_id", "text", "place", F.explode(places("place")).alias("at")).select("at.part", "at.guest", "doc_id", "place", "text")
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("part"))
    dealt = dealt.sortWithinPartitions("part", "guest", F.desc("place"), F.desc_nulls_last("text")).drop("place")
    return dealt.mapInArrow(_followed, RESULT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edited_likeness`` of the whole documents table; nulls, ties and repeated rows as
    there."""
    return edited_likeness(table(spark, sf_dir, "documents"))
