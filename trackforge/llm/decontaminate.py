"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are reduced to their words with one space around each, so a window of
words is a byte pattern.  Patterns are searched by length class, so one short
item does not spoil the shifts of the long windows.  In a class with shortest
pattern m, blocks of B bytes are hashed into a table of safe shifts; a cursor
reads the block that ends at its position and jumps.  Where the shift is zero
the suffix-hash bucket names the patterns that may end there, and a direct
comparison decides.

The cursors of many text segments advance together as one numpy vector; each
step is a handful of vector operations, and positions that the shifts skip are
never touched.

Windows are places in one buffer of the benchmark's words, and the tables over
them numpy arrays, so a block of items costs a few times its bytes.  The benchmark is
read in blocks of bounded size (``BLOCK_BYTES`` of item text), one at a time; each
is one search over all documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import pin, table

WINDOW = 10
BLOCK_BYTES = 8 << 20
SEGMENT = 2048  # bytes of text per cursor
#: upper ends of the length classes, in bytes; all longer patterns are one class
CLASSES = (4, 8, 12, 20, 32)

_SPACED = bytes(K.FOLD[i] if K.ALNUM[i] else 0x20 for i in range(256))


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all else beyond ASCII."""
    return text.encode().translate(_SPACED).split() if text else []


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_hashes`` takes the hash of any stretch."""
    up, _ = K.powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(K._LETTER[data] * up[: len(data)], out=s[1:])
    return s


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = K.powers(len(sums))
    return K.mix((sums[end] - sums[start]) * down[start])


class WuManber:
    """Finds all occurrences of byte patterns (each at least two bytes), given as
    places ``start`` and ``size`` in the buffer ``book``."""

    def __init__(self, book: bytes, sums: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.book, self.m = book, int(size.min())
        self.b = max(1, min(8, self.m // 2))
        self.bits = min(22, max(12, (8 * len(start) * self.m).bit_length()))
        shift = np.full(1 << self.bits, self.m - self.b + 1, np.uint32)
        words, mask = self._words(book)
        for end in range(self.b, self.m + 1):  # later ends allow smaller shifts
            at = self._hash(words[start + end - self.b] & mask)
            shift[at] = np.minimum(shift[at], self.m - end)
        self.shift = shift
        # suffix buckets: patterns by the last block of their heads and the rest of them
        head = _hashes(sums, start, start + self.m)
        order = np.argsort(head, kind="stable")
        self.head, self.order, self.start, self.size = head[order], order, start[order], size[order]

    def _words(self, text: bytes) -> tuple[np.ndarray, np.uint64]:
        """The eight bytes from each place on, and which of them are a block."""
        padded = text + b"\0" * 8
        return np.ndarray(len(text) + 1, "<u8", buffer=padded, strides=(1,)), K.U64((1 << (8 * self.b)) - 1)

    def _hash(self, block: np.ndarray) -> np.ndarray:
        block = block * K.U64(0x9E3779B97F4A7C15)
        return ((block ^ (block >> K.U64(32))) * K.U64(0xD6E8FEB86659FD93) >> K.U64(64 - self.bits)).astype(np.int64)

    def search(self, text: bytes, sums: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        n = len(text)
        if n < self.m:
            return
        words, mask = self._words(text)
        at = np.arange(self.m, n + 1, SEGMENT)  # end of the head under the cursor
        stop = np.minimum(at + SEGMENT, n + 1)
        while len(at):
            step = self.shift[self._hash(words[at - self.b] & mask)].astype(np.int64)
            ends = at[step == 0]
            if len(ends):
                head = _hashes(sums, ends - self.m, ends)
                lo, hi = np.searchsorted(self.head, head, "left"), np.searchsorted(self.head, head, "right")
                for k in np.flatnonzero(lo < hi).tolist():
                    at_ = int(ends[k]) - self.m
                    for i in range(lo[k], hi[k]):
                        p = int(self.start[i])
                        if text.startswith(self.book[p : p + int(self.size[i])], at_):
                            yield at_, int(self.order[i])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]


class Matcher:
    """Windows of benchmark items, grouped by length class; an item without an id has windows but no name."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.source = items
        self.names = [item for item, _ in items]
        texts = [b" " + b" ".join(words) + b" " if (words := normal_words(t)) else b"" for _, t in items]
        self.book = b"".join(texts)
        data = np.frombuffer(self.book, np.uint8)
        sums = _sums(data)
        spaces = np.flatnonzero(data == 0x20)
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.searchsorted(np.cumsum(sizes), spaces, side="right")
        count = np.bincount(owner, minlength=len(texts))  # spaces of each item: its words and one
        last = np.cumsum(count) - 1
        nth = np.arange(len(spaces)) - (last + 1 - count)[owner] if len(spaces) else spaces
        n_words = np.minimum(window, count[owner] - 1) if len(spaces) else spaces
        opens = np.flatnonzero((nth == 0) | (nth + window < count[owner])) if len(spaces) else spaces
        opens = opens[nth[opens] + n_words[opens] < count[owner[opens]]] if len(spaces) else spaces
        start, words = spaces[opens], n_words[opens]
        size = spaces[opens + words] + 1 - start
        whose = owner[opens]
        # equal windows are one pattern with several owners
        whole = _hashes(sums, start, start + size)
        order = np.lexsort((whose, start, size, whole))
        start, size, words, whose, whole = (x[order] for x in (start, size, words, whose, whole))
        new = np.ones(len(start), bool)
        for i in np.flatnonzero((whole[1:] == whole[:-1]) & (size[1:] == size[:-1])) + 1 if len(start) else ():
            new[i] = self.book[start[i] : start[i] + size[i]] != self.book[start[i - 1] : start[i - 1] + size[i - 1]]
        first = np.flatnonzero(new)
        self.start, self.size, self.words = start[first], size[first], words[first]
        self.owners, self.owner_at = whose, np.append(first, len(start))
        kind = np.searchsorted(np.array(CLASSES), self.size)
        self.searchers = [(pick, WuManber(self.book, sums, self.start[pick], self.size[pick])) for k in np.unique(kind) if len(pick := np.flatnonzero(kind == k))]

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Per text: its word count, the word ranges hit, the items found."""
        parts, sizes = [], []
        for t in texts:
            words = normal_words(t)
            sizes.append(len(words))
            parts.append(b" " + b" ".join(words) + b" " if words else b"")
        whole = b"\0".join(parts)  # no pattern holds a zero byte
        firsts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        spaces: dict[int, np.ndarray] = {}
        sums = _sums(np.frombuffer(whole, np.uint8)) if self.searchers else None
        for pick, s in self.searchers:
            for start, i in s.search(whole, sums):
                row = int(np.searchsorted(firsts, start, side="right")) - 1
                at = start - int(firsts[row])
                if row not in spaces:
                    spaces[row] = np.flatnonzero(np.frombuffer(parts[row], np.uint8) == 0x20)
                word, p = int(np.searchsorted(spaces[row], at)), pick[i]
                found[row][0].append((word, word + int(self.words[p])))
                found[row][1].update(int(o) for o in self.owners[self.owner_at[p] : self.owner_at[p + 1]])
        return [(n, merge(ranges), {self.names[o] for o in items} - {None}) for n, (ranges, items) in zip(sizes, found, strict=True)]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_built: dict[tuple, Matcher] = {}


def _matcher(shared, window: int) -> Matcher:
    """One matcher for each broadcast block and worker."""
    items = shared.value
    key = (id(items), window)
    if key not in _built or _built[key].source is not items:
        _built.clear()
        _built[key] = Matcher(items, window)
    return _built[key]


RESULT = "n_words long, starts array<int>, ends array<int>, items array<string>"


def _searcher(shared, window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for whole in batches:
            for batch in K.slices(whole, "text"):
                matcher = matcher or _matcher(shared, window)
                found = matcher.search(batch.column("text").to_pylist())
                columns = {n: batch.column(n) for n in names}
                columns["n_words"] = pa.array([n for n, _, _ in found], pa.int64())
                columns["starts"] = pa.array([[a for a, _ in r] for _, r, _ in found], pa.list_(pa.int32()))
                columns["ends"] = pa.array([[b for _, b in r] for _, r, _ in found], pa.list_(pa.int32()))
                columns["items"] = pa.array([sorted(i) for _, _, i in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


TAG = "row_tag"


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Items (id as text or null, text, block) and how many blocks of about ``block_bytes`` they are."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    items = items.withColumn("block", F.expr(f"pmod(xxhash64(item, text), {n})"))
    return (pin(items, "items") if n > 1 else items), n


def block(items: DataFrame, i: int = 0) -> list[tuple[str | None, str]]:
    """One block, small by the number of blocks."""
    return [(r["item"], r["text"]) for r in items.where(F.col("block") == i).collect()]


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_words``, hit word ranges and ``items``.

    One row per row of ``docs``, whole texts however long; null, empty and wordless
    texts have no words; repeated rows have equal results; an empty benchmark hits
    nothing.  Items with one id are one item, and hits of an item whose id is null
    count, but add nothing to ``items``.  Columns in ``keep`` may not be called as
    those that are added.
    """
    if clash := {n.lower() for n in keep} & {"n_words", "starts", "ends", "items", TAG}:
        raise ValueError(f"keep has columns that are added: {sorted(clash)}")
    sc = docs.sparkSession.sparkContext
    columns = list(dict.fromkeys([*keep, "text"]))
    src = docs.select(*columns)
    schema = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep) + ", "
    items, n_blocks = benchmark_blocks(benchmark, block_bytes)
    if n_blocks == 1:
        return src.mapInArrow(_searcher(sc.broadcast(block(items)), window, keep), schema + RESULT)
    # several blocks: the hits of each, keyed by the row's content, meet once per row
    keyed = src.withColumn(TAG, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    hits = None
    for i in range(n_blocks):
        shared = sc.broadcast(block(items, i))
        part = keyed.mapInArrow(_searcher(shared, window, [TAG]), f"{TAG} string, {RESULT}")
        part = pin(part.where("size(starts) > 0").dropDuplicates([TAG]), "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionAll(part)
    met = hits.groupBy(TAG).agg(
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    empty = sc.broadcast([])
    counted = keyed.mapInArrow(_searcher(empty, window, [*keep, TAG]), f"{schema}{TAG} string, {RESULT}")
    out = counted.drop("starts", "ends", "items").join(met, TAG, "left").drop(TAG)
    return out.select(
        *keep, "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("starts", "array<int>"), ("ends", "array<int>"), ("items", "array<string>")))
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, items = (batch.column(c).to_pylist() for c in ("starts", "ends", "items"))
        hits = [sum(b - a for a, b in merge(list(zip(s, e, strict=True)))) for s, e in zip(starts, ends, strict=True)]
        sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ``search`` over the whole documents table, for all items
    of the benchmark; nulls, ties and repeated rows as there."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return search(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]).mapInArrow(_digest, DIGEST)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, whole, in whose text no benchmark window occurs.

    Null, empty and wordless texts stay, and repeated rows stay or go together; with an
    empty benchmark all stay.  Columns keep their names.  Several blocks of a large
    benchmark filter one after the other.
    """
    sc = docs.sparkSession.sparkContext

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in K.slices(whole, "text"):
                    found = _matcher(shared, WINDOW).search(batch.column("text").to_pylist())
                    yield batch.filter(pa.array([not ranges for _, ranges, _ in found], pa.bool_()))

        return run

    items, n_blocks = benchmark_blocks(benchmark)
    out = docs
    for i in range(n_blocks):
        out = out.mapInArrow(without(sc.broadcast(block(items, i))), docs.schema)
        if i + 1 < n_blocks:
            out = pin(out, "clean")
    return out
