"""Packing tokenised documents into sequences of a fixed length.

The instance is its histogram: how many pieces have each length from 1 to the
capacity.  That is at most ``capacity`` numbers whatever the corpus, so the
packing is solved once, on the driver, for all pieces together, and described
by runs of equal sequences; pieces then find their places by their rank among
pieces of their length.

Solving follows Martello and Toth: sets of at most three pieces that dominate
every other filling of their sequence are fixed for good, the instance shrinks,
and best-fit decreasing packs the remainder.  Everything is done for all
equal pieces at once.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .shared import extended, pin, table

CAPACITY = 2048
END_ID = 0
SALTS = 512  # counters of ranks per length: a length that most pieces share is ranked by so many tasks
#: fixed value: how byte-level tokenizers split a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts, as a byte-level BPE tokenizer file says.

    Where the file is of the plain kind (ids in the order of the merges, the usual
    splitting pattern), tiktoken applies the same merges several times faster.
    Other files, texts with one of the special strings, and texts whose runs of white
    space are too long for its pattern matcher (about a million) go through tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _plain_bpe(json.loads(self.tokenizer.to_str()))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        """No ids for null and empty texts."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return self._whole(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its matcher's stack is full
            return self._whole(text)


def _plain_bpe(spec: dict):
    """A tiktoken encoding with the merges of a tokenizer file, or None."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model.get("type") != "BPE" or spec.get("normalizer") or any(pre.get(k) != v for k, v in plain.items()):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # such vocabularies spell the printable bytes as themselves, the rest from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    vocab = model["vocab"]
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(spelled[c] for c in token): i for token, i in vocab.items() if token not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)) or len(ranks) != 256 + len(merges):
        return None
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_encoders: dict[str, Encoder] = {}


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only longer ones are cut, and
    what is left over comes first."""
    head = length % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, length, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` to pieces with the crc32 of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or public_tokenizer()
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = np.append(encoder.encode(text), np.uint32(END_ID)).astype("<u4")
                    for piece, (start, n) in enumerate(cut(len(data), capacity)):
                        rows.append((doc, piece, start, n, zlib.crc32(data[start : start + n].tobytes())))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packer:
    """Runs of equal sequences: (lengths in order, how many such sequences)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c}
        self.sizes = sorted(self.left)
        self.runs: list[tuple[tuple[int, ...], int]] = []
        self.fixed = 0

    def _take(self, lengths: tuple[int, ...], times: int) -> None:
        self.runs.append((lengths, times))
        for n in lengths:
            self.left[n] -= times
        for n in set(lengths):
            if not self.left[n]:
                del self.left[n]
                self.sizes.pop(bisect_left(self.sizes, n))

    def _largest(self, most: int, without: int | None = None) -> int | None:
        """Largest length left up to ``most``, one piece of ``without`` set aside."""
        i = bisect_left(self.sizes, most + 1) - 1
        if i >= 0 and self.sizes[i] == without and self.left[without] == 1:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def _smallest(self, k: int, without: int) -> int | None:
        """Sum of the ``k`` smallest pieces left beside one of ``without``."""
        total = 0
        for n in self.sizes:
            use = min(k, self.left[n] - (n == without))
            total, k = total + use * n, k - use
            if not k:
                return total
        return None

    def _best_pair(self, room: int, without: int) -> int:
        """Largest sum of two pieces that fit together beside one of ``without``."""
        best, i, j = 0, 0, bisect_left(self.sizes, room) - 1
        have = lambda n: self.left[n] - (n == without)
        while i <= j:
            a, b = self.sizes[i], self.sizes[j]
            if not have(b) or a + b > room:
                j -= 1
                continue
            if have(a) > (i == j):
                best = max(best, a + b)
            i += 1
        return best

    def _dominating(self, big: int) -> tuple[int, ...] | None:
        """A filling around ``big`` that is as good as any other, or None.

        Removing such fillings only shrinks the choice, so a filling that
        dominates does so as often as its pieces last.
        """
        room = self.capacity - big
        mate = self._largest(room, big)
        if mate is None:
            return (big,)  # nothing fits beside it
        if mate == room:
            return (big, mate)  # it fills the sequence
        two = self._smallest(2, big)
        if two is None or two > room:
            return (big, mate)  # one more piece fits, and this is the largest
        three = self._smallest(3, big)
        if three is not None and three <= room:
            return None
        if self._best_pair(room, big) <= mate:
            return (big, mate)  # it can change places with any two that fit
        i = bisect_left(self.sizes, room - mate + 1) - 1
        while i >= 0 and self.left[self.sizes[i]] <= (self.sizes[i] == big) + (self.sizes[i] == mate):
            i -= 1
        if i >= 0:
            third = self.sizes[i]
            above = [n for n in self.sizes[i + 1 :] for _ in range(min(2, self.left[n] - (n == big)))][:2]
            if len(above) < 2 or sum(above) > room:
                return (big, mate, third)  # of any two that fit, one is at most third, the other at most mate
        return None

    def reduce(self) -> None:
        """Fix dominating fillings, from the largest piece down, until none is left."""
        changed = True
        while changed:
            changed = False
            for big in reversed(self.sizes.copy()):
                while big in self.left and (filling := self._dominating(big)):
                    times = min(self.left[n] // filling.count(n) for n in filling)
                    self.fixed += times
                    self._take(filling, times)
                    changed = True

    def best_fit(self) -> None:
        """Best-fit decreasing: each piece goes where least room stays."""
        rooms: list[int] = []  # rooms of open sequences, sorted
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def add(filled: tuple[int, ...], times: int, room: int) -> None:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((filled, times))

        for n in reversed(self.sizes):
            rest = self.left[n]
            while rest:
                i = bisect_left(rooms, n)
                if i == len(rooms):
                    filled, times, room = (), -(-rest // (self.capacity // n)), self.capacity
                else:
                    room = rooms[i]
                    filled, times = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(i)
                fit = room // n
                full = min(times, rest // fit)
                if full:
                    add((*filled, *[n] * fit), full, room - fit * n)
                    rest, times = rest - full * fit, times - full
                if rest and times:
                    add((*filled, *[n] * rest), 1, room - rest * n)
                    rest, times = 0, times - 1
                if times and filled:
                    add(filled, times, room)
        for groups in open_.values():
            self.runs += groups
        self.left, self.sizes = {}, []

    def solve(self) -> list[tuple[tuple[int, ...], int]]:
        self.reduce()
        self.best_fit()
        return self.runs


def places(runs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: from rank ``first`` on, piece by piece,
    to sequences from ``sequence`` on, at ``offset``.  Sorted by length and rank."""
    out, used, base = [], {}, 0
    for lengths, times in runs:
        at = 0
        for n in lengths:
            out.append((n, used.get(n, 0), base, at))
            used[n] = used.get(n, 0) + times
            at += n
        base += times
    out.sort()
    cols = np.array(out, np.int64).reshape(-1, 4)
    return {"length": cols[:, 0], "first": cols[:, 1], "sequence": cols[:, 2], "offset": cols[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(length, ...)`` with ``sequence_id`` and ``offset``.

    ``pieces`` must not change when it is read again; its rows may repeat.
    """
    sc, names = pieces.sparkSession.sparkContext, pieces.columns
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = salted.groupBy("length", "salt").count().toArrow()  # at most capacity * SALTS rows
    by_salt = np.zeros((capacity + 1, SALTS), np.int64)
    by_salt[counts["length"].to_numpy(), counts["salt"].to_numpy()] = counts["count"].to_numpy()
    histogram = {n: int(c) for n, c in enumerate(by_salt.sum(axis=1)) if c}
    where = sc.broadcast(places(Packer(histogram, capacity).solve()))
    before = sc.broadcast(np.cumsum(by_salt, axis=1) - by_salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ranks0 = where.value, before.value
        # one sorted key of length and rank: a rank is looked up within its length's rows
        lows = np.searchsorted(w["length"], np.arange(capacity + 2))
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = ranks0[n, batch.column("salt").to_numpy()] + batch.column("nth").to_numpy() - 1
            at = np.zeros(len(n), np.int64)
            for value in np.unique(n):
                mine = n == value
                lo, hi = lows[value], lows[value + 1]
                at[mine] = lo + np.searchsorted(w["first"][lo:hi], rank[mine], side="right") - 1
            columns = {c: batch.column(c) for c in names}
            columns["sequence_id"] = pa.array(w["sequence"][at] + rank - w["first"][at])
            columns["offset"] = pa.array(w["offset"][at])
            yield pa.RecordBatch.from_pydict(columns)

    in_order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(in_order).cast("long"))
    return ranked.mapInArrow(run, extended(pieces.schema, sequence_id="long", offset="long"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece of length 1 (the end id); repeated rows are
    packed one by one; a null doc_id stays null; an empty table gives no pieces.
    Texts are tokenised whole, however long.  Of pieces of one length those with
    smaller doc_id, then piece, take earlier places within their counter.  Other
    columns are not read.
    """
    return pack(pin(tokenised_pieces(docs, tokenizer, capacity), "pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack_documents`` of the whole documents table, 2048 tokens a sequence; nulls,
    ties and repeated rows as there."""
    return pack_documents(table(spark, sf_dir, "documents"))
