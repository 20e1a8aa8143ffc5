"""Exact substring deduplication by prefix-free parsing.

A byte is removed where a string of ``LENGTH`` bytes covers it that also starts
earlier in the corpus.  Texts are parsed into phrases by a rolling hash: of all
``TRIGGER``-byte windows inside a string the one with the smallest hash (the
leftmost of equal ones) triggers, and the starts that share a trigger form a
phrase, taken with the ``LENGTH - 1`` bytes that follow so that it holds their
strings whole.  The parse depends on content only, so equal strings lie at equal
places around equal triggers, and the text of repeats shrinks to few phrases.

1. The parse: phrases, as hashes, meet by trigger.  All but the first of equal
   phrases are removed wholesale.  Equal phrases of one batch meet before the
   shuffle, so a passage in a third of all texts is one phrase per batch.
2. Corpus order: only where different phrases share a trigger can their strings
   partly agree.  The first occurrences of those phrases are fetched.  They repeat
   each other for the most part, so a second parse cuts them into words by a rolling
   hash, and the suffix arrays of the dictionary of words and of the parse combine
   into the order of all their strings (``corpus_order``).  Equal strings stand
   together; the first in the corpus stays.
3. Both kinds of starts are gathered per document and its bytes cut.

A trigger that opens far more phrases than others (a common line with different
surroundings) would load one task.  Each batch names those it meets too often; the
few that are so in the whole corpus are dealt by phrase instead, and the strings of
their phrases, like those of a trigger with more than ``CROWDED`` different ones,
go to the tasks their own hashes name, once for each batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import pin, shuffle_width, table, unpin

LENGTH = 100
TRIGGER = 24
CROWDED = 20_000
FLUSH = 250_000  # phrases held by a task before they are sent on
LEAST_BUSY = 64  # phrases of a trigger in a batch that name it, at least
BUSY = 2  # times a task's fair share of a batch: from so many phrases on a trigger is named
PART_BYTES = 48 << 20  # text per task of the first step
DICTIONARY_PARTS = 6  # times as many tasks for suffix arrays
SETTLE_BYTES = 1 << 19  # of phrases ordered at once, or those of one trigger; their suffix arrays need some sixty times as much
WINDOW, WORD = 8, 32  # bytes of a trigger within a phrase, and how far apart they are on average
NULL_ID = -(1 << 63)  # rows without an id come first
U64 = K.U64


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = K.powers(len(buf) + 1)
    s = np.zeros(len(buf) + 1, U64)
    np.cumsum(K._LETTER[buf] * up[: len(buf)], out=s[1:])
    return s


def parse(buf: np.ndarray, offs: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, ...]:
    """Phrases of all rows: first start, number of starts, trigger hash, phrase hash."""
    n = len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    _, down = K.powers(n + 1)
    s = prefix_sums(buf)
    h = K.mix((s[trigger:] - s[:-trigger]) * down[: n - trigger + 1])
    # smallest hash and its place among the windows of each string, by doubling
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    width, span = length - trigger + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offs)
    left = np.repeat(offs[1:], sizes) - np.arange(n)
    p = np.flatnonzero(left[: len(place)] >= length)
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    at = place[p]
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
    i = np.flatnonzero(new)
    first, count, at = p[i], np.diff(np.append(i, len(p))), at[i]
    whole = (s[first + count - 1 + length] - s[first]) * down[first]
    whole = K.mix(whole ^ K.mix((at - first).astype(U64) * U64(512) + count.astype(U64)))
    return first, count, h[at], whole


#: how phrases travel: columns one after the other; a row's place in the corpus is its
#: doc_id and, where ids repeat, a hash of its text
_FIELDS = (("trigger", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("count", "<u2"))


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(columns[n].astype(t)).tobytes() for n, t in _FIELDS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in _FIELDS)
    parts: dict[str, list] = {n: [] for n, _ in _FIELDS}
    for b in blobs:
        n, at = len(b) // size, 0
        for name, t in _FIELDS:
            parts[name].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return {n: np.concatenate(p) if p else np.zeros(0, t) for (n, t), p in zip(_FIELDS, parts.values(), strict=True)}


def _ordered(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Phrases by trigger, phrase and corpus order; which open a group of equal ones;
    and which are the same place as that first (repeated rows)."""
    order = np.lexsort((c["start"], c["tag"], c["doc"], c["phrase"], c["trigger"]))
    c = {n: x[order] for n, x in c.items()}
    head = np.ones(len(order), bool)
    head[1:] = (c["phrase"][1:] != c["phrase"][:-1]) | (c["trigger"][1:] != c["trigger"][:-1])
    group = np.cumsum(head) - 1
    top = np.flatnonzero(head)
    same = np.all([c[n] == c[n][top][group] for n in ("doc", "tag", "start")], axis=0) if len(order) else head
    return c, head, same


FOUND = "kind int, place long, tag long, starts array<long>, triggers array<long>"  # start << 16 | count
KIND_SENT, KIND_REMOVED, KIND_OPEN, KIND_CROWDED = 0, 1, 2, 3
#: rows of the parse that are no blobs: removed starts; a busy trigger and how often; how many phrases in all
PART_REMOVED, PART_BUSY, PART_TOTAL = -1, -2, -3
PARSED = "part int, place long, tag long, starts array<long>, blob binary"


def _blobs(c: dict[str, np.ndarray], part: np.ndarray, parts: int) -> pa.RecordBatch:
    """Phrases packed by the part that each goes to."""
    order = np.lexsort((c["start"], c["tag"], c["doc"], part))
    c, part = {n: x[order] for n, x in c.items()}, part[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(cuts))
    blobs = [_pack({n: x[cuts[i] : cuts[i + 1]] for n, x in c.items()}) for i in used]
    return _parsed(used, blob=pa.array(blobs, pa.binary()))


def _parsed(part: np.ndarray, place=None, tag=None, starts=None, blob=None) -> pa.RecordBatch:
    n = len(part)
    kinds = {"place": pa.int64(), "tag": pa.int64(), "starts": pa.list_(pa.int64()), "blob": pa.binary()}
    given = {"place": place, "tag": tag, "starts": starts, "blob": blob}
    rest = [pa.nulls(n, kind) if given[name] is None else given[name] for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *rest], names=["part", *kinds])


def _by_doc(kind: int, c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (kind, place, tag, list of coded starts with their triggers) per text."""
    order = np.lexsort((c["start"], c["tag"], c["doc"]))
    doc, tag = c["doc"][order], c["tag"][order]
    code = (c["start"][order].astype(np.int64) << 16) | c["count"][order].astype(np.int64)
    edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))) if len(doc) else np.zeros(0, np.int64)
    offs = np.append(edge, len(doc)).astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(offs), pa.array(x, pa.int64()))
    n = len(edge)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(doc[edge], pa.int64()), pa.array(tag[edge], pa.int64()), lists(code), lists(c["trigger"][order].view(np.int64))],
        names=["kind", "place", "tag", "starts", "triggers"],
    )


def _parser(parts: int, length: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            c = {n: np.concatenate([x[n] for x in held]) for n, _ in _FIELDS}
            held.clear()
            c, head, same = _ordered(c)
            gone = _by_doc(KIND_REMOVED, {n: x[~same] for n, x in c.items()})
            if gone.num_rows:
                yield _parsed(np.full(gone.num_rows, PART_REMOVED), gone.column("place"), gone.column("tag"), gone.column("starts"))
            # of repeated rows the first place is sent once
            c = {n: x[head] for n, x in c.items()}
            yield _parsed(np.array([PART_TOTAL]), tag=pa.array([len(c["doc"])], pa.int64()))
            triggers, times = np.unique(c["trigger"], return_counts=True)
            busy = times > max(LEAST_BUSY, BUSY * len(c["doc"]) / parts)
            if busy.any():
                yield _parsed(np.full(int(busy.sum()), PART_BUSY), pa.array(triggers[busy].view(np.int64)), pa.array(times[busy].astype(np.int64)))
            yield _blobs(c, (c["trigger"] % U64(parts)).astype(np.int64), parts)

        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 4):
                buf, offs = K.text_bytes(batch.column("text"))
                first, count, trig, phrase = parse(buf, offs, length, trigger)
                row = np.searchsorted(offs, first, side="right") - 1
                ids, tags = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("place", "tag"))
                held.append({"trigger": trig, "phrase": phrase, "doc": ids[row], "tag": tags[row], "start": (first - offs[row]).astype(np.int64), "count": count})
                if sum(len(x["doc"]) for x in held) >= FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _busy_triggers(parsed: DataFrame, parts: int) -> np.ndarray:
    """Triggers with so many phrases that fewer than ``parts`` can have as many."""
    total = parsed.where(F.col("part") == PART_TOTAL).agg(F.sum("tag")).first()[0] or 0
    named = parsed.where(F.col("part") == PART_BUSY).groupBy("place").agg(F.sum("tag").alias("n"))
    return np.array(sorted(r["place"] for r in named.where(F.col("n") > max(LEAST_BUSY, total / parts)).collect()), np.int64).view(U64)


def _spread(busy: np.ndarray, parts: int):
    """Deals the phrases of busy triggers by phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column("part").to_numpy(), batch.column("blob").to_pylist(), strict=True):
                c = _unpack([blob])
                hot = np.isin(c["trigger"], busy)
                if hot.any():
                    to = np.where(hot, (K.mix(c["phrase"]) % U64(parts)).astype(np.int64), part)
                    yield _blobs(c, to, parts).select(["part", "blob"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"])

    return run


def _meet(crowded: int, busy: np.ndarray):
    """Phrases of a part's triggers: what is removed, and what is still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            blobs += batch.column("blob").to_pylist()
        if not blobs:
            return
        c, head, same = _ordered(_unpack(blobs))
        yield _by_doc(KIND_REMOVED, {n: x[~same] for n, x in c.items()})
        c = {n: x[head] for n, x in c.items()}
        new = np.ones(len(c["doc"]), bool)
        new[1:] = c["trigger"][1:] != c["trigger"][:-1]
        group = np.cumsum(new) - 1
        kinds = np.bincount(group)[group]
        many = (kinds > crowded) | np.isin(c["trigger"], busy)
        for kind, pick in ((KIND_OPEN, (kinds > 1) & ~many), (KIND_CROWDED, many)):
            if pick.any():
                yield _by_doc(kind, {n: x[pick] for n, x in c.items()})

    return run


def _fetch(parts: int, length: int):
    """Bytes of the open phrases; of crowded triggers, their strings one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text", K.SLICE_BYTES // 2):
                out: tuple[list, ...] = ([], [], [], [], [], [])

                def send(key: int, *rest) -> None:
                    for column, value in zip(out, ((key & (2**64 - 1)) % parts, key, *rest), strict=True):  # noqa: B023
                        column.append(value)

                first: dict[bytes, tuple] = {}  # of each string of crowded triggers
                for place, tag, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("place", "tag", "text", "wanted")), strict=True):
                    data = text.encode()
                    for w in wanted:
                        for code, trig in zip(w["starts"], w["triggers"], strict=True):
                            start, count = code >> 16, code & 0xFFFF
                            if w["kind"] == KIND_OPEN:
                                send(trig, place, tag, start, data[start : start + count - 1 + length])
                                continue
                            for i in range(start, start + count):
                                key, mine = data[i : i + length], (place, tag, i)
                                old = first.setdefault(key, mine)
                                if old != mine:
                                    first[key] = min(old, mine)
                                    send(place, *max(old, mine), None)  # removed, whoever else has it
                for key, mine in first.items():
                    send(int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True), *mine, key)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "key", "place", "tag", "start", "phrase"])

    return run


def suffix_ranks(values: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Rank of every suffix by its first ``width`` values; equal ones share it.

    The suffix at i ends before ``ends[i]``, and comes before those it is a prefix of.
    ``values`` are ranks from 1.  Prefix doubling: ranks by twice as many values come
    from pairs of ranks.  It starts from as many values as fit in a number, and ends
    with the longest suffix.
    """
    n = len(values)
    if not n:
        return values.astype(np.int64)
    left = (ends - np.arange(n)).astype(np.int32)
    bits = int(values.max()).bit_length()
    width = min(width, int(left.max()))
    known = min(width, max(63 // bits, 1))
    keys = values.astype(U64)
    for i in range(1, known):
        keys <<= U64(bits)
        keys[: n - i] |= np.where(left[: n - i] > i, values[i:], 0).astype(U64)
    rank = _dense(keys)
    while known < width:
        step = min(known, width - known)
        second = np.where(left[: n - step] > step, rank[step:], 0).astype(U64)
        keys = rank.astype(U64)
        keys *= U64(int(second.max(initial=0)) + 1)
        keys[: n - step] += second
        rank = _dense(keys)
        known += step
    return rank


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del ranked
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def _word_starts(data: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where words begin: at every phrase and at every window whose hash is
    divisible by ``WORD`` and that has a byte behind it in its phrase."""
    cut = np.zeros(len(data), bool)
    for lo in range(0, len(data) - WINDOW + 1, SETTLE_BYTES):
        piece = data[lo : lo + SETTLE_BYTES + WINDOW - 1]
        window = np.zeros(len(piece) - WINDOW + 1, U64)
        for i in range(WINDOW):
            window = (window << U64(8)) | piece[i : i + len(window)]
        cut[lo : lo + len(window)] = K.mix(window) % U64(WORD) == 0
    for i in range(1, WINDOW + 1):
        cut[np.maximum(base + sizes - i, base)] = False
    cut[base] = True
    return np.flatnonzero(cut)


def corpus_order(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """A number for each start of ``length`` bytes within each of the phrases that make
    up ``data``, in their order; equal strings have equal numbers, in the order of
    strings.

    Prefix-free parsing (Boucher et al., 2019): triggers cut the phrases into words that
    overlap by a window.  The suffix array of the dictionary of different words orders
    what is left of a word; the suffix array of the parse, a text of word ranks,
    orders what follows where that is shorter than ``length``.  Both are small where
    the text repeats itself.
    """
    base = np.cumsum(sizes) - sizes
    begin = _word_starts(data, base, sizes)
    owner = np.searchsorted(base, begin, side="right") - 1
    stop = base[owner] + sizes[owner]  # end of the phrase
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end = np.where(last, stop, np.append(begin[1:], 0) + WINDOW)

    # the dictionary, its suffixes and their order
    raw, numbers = data.tobytes(), {}
    word = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
    text = np.frombuffer(b"".join(numbers), np.uint8)
    widths = np.array([len(w) for w in numbers], np.int64)
    at = np.cumsum(widths) - widths
    ends = np.repeat(at + widths, widths)
    in_dictionary = suffix_ranks(text.astype(np.int16) + 1, ends, length)

    # the parse and the order of its suffixes; a word adds a byte at least
    final = np.searchsorted(begin, stop, side="left")
    in_parse = suffix_ranks(in_dictionary[at[word]], final, length)

    # both together, for every start
    count = sizes - length + 1
    first = np.repeat(base, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    j = np.searchsorted(begin, first, side="right") - 1
    offset = at[word[j]] + first - begin[j]
    high = in_dictionary[offset]
    follows = ends[offset] - offset < length
    low = np.zeros(len(first), np.int64)
    low[follows] = in_parse[j[follows] + 1]
    keys = _dense(high.astype(U64) * U64(len(begin) + 2) + low.astype(U64))
    # what follows may differ only beyond the string: neighbours in order are compared
    order = np.argsort(keys)
    ranked = keys[order]
    edge = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    same = high[order[edge]] == high[order[edge - 1]]
    x, y = first[order[edge[same]]], first[order[edge[same] - 1]]
    equal = np.array([raw[a : a + length] == raw[b : b + length] for a, b in zip(x.tolist(), y.tolist(), strict=True)], bool)
    new = np.ones(len(edge), bool)
    new[np.flatnonzero(same)[equal]] = False
    step = np.zeros(len(first), np.int64)
    step[edge[new]] = 1
    out = np.empty(len(first), np.int64)
    out[order] = np.cumsum(step)
    return out


def _settle(length: int):
    """Starts of a dictionary part whose string occurs earlier; rows without a string
    are such starts already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.column("phrase").is_null()
            if known.true_count:
                gone = batch.filter(known)
                c = {name: gone.column(column).to_numpy() for name, column in (("doc", "place"), ("tag", "tag"), ("start", "start"))}
                yield _by_doc(KIND_REMOVED, c | {"count": np.ones(gone.num_rows, np.int64), "trigger": np.zeros(gone.num_rows, U64)})
                batch = batch.filter(pa.compute.invert(known))
            held.append(batch)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        # equal strings have the same key, so keys are ordered apart, as many at once as SETTLE_BYTES hold
        key = rows.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        sizes = pa.compute.binary_length(rows.column("phrase")).to_numpy()[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        ends = np.append(np.cumsum(sizes)[first[1:] - 1], sizes.sum())
        lo, done = 0, 0
        while lo < len(first):
            hi = max(lo + 1, int(np.searchsorted(ends, done + SETTLE_BYTES, side="right")))
            stop = first[hi] if hi < len(first) else len(order)
            yield _settled(rows.take(pa.array(order[first[lo] : stop])), length)
            lo, done = hi, ends[hi - 1]

    return run


def _settled(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Starts whose string occurs earlier in these rows."""
    phrases = rows.column("phrase").to_pylist()
    sizes = np.array([len(p) for p in phrases], np.int64)
    rank = corpus_order(np.frombuffer(b"".join(phrases), np.uint8), sizes, length)
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    doc, tag, start = (rows.column(n).to_numpy()[owner] for n in ("place", "tag", "start"))
    start = start + nth
    order = np.lexsort((start, tag, doc, rank))
    rank, doc, tag, start = rank[order], doc[order], tag[order], start[order]
    head = np.ones(len(rank), bool)
    head[1:] = rank[1:] != rank[:-1]
    group, top = np.cumsum(head) - 1, np.flatnonzero(head)
    later = (doc != doc[top][group]) | (tag != tag[top][group]) | (start != start[top][group])
    doc, tag, start = doc[later], tag[later], start[later]
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order]
    run_ = np.ones(len(doc), bool)
    run_[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != start[:-1] + 1)
    run_[:: 1 << 15] = True  # a run's length must fit in 16 bits
    i = np.flatnonzero(run_)
    lengths = np.diff(np.append(i, len(doc)))
    return _by_doc(KIND_REMOVED, {"doc": doc[i], "tag": tag[i], "start": start[i], "count": lengths, "trigger": np.zeros(len(i), U64)})


def covered(n: int, codes: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings at the coded starts cover."""
    out: list[list[int]] = []
    for code in sorted(codes):
        a = code >> 16
        b = min(n, a + (code & 0xFFFF) - 1 + length)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removal(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, crowded: int = CROWDED) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, text, spans``: the byte runs to remove.

    One row per row, none for an empty table.  Null and empty texts, and texts shorter
    than ``length``, lose nothing; texts are read whole, however long.  Rows without
    an id come before all others in corpus order.  Repeated rows (one doc_id and one
    text) are one place in the corpus: none makes another lose bytes, and all lose
    the same.  Different texts under one id, or without one, follow each other in the
    order of a hash of theirs.  Other columns are not read.
    """
    if not 1 <= trigger <= length <= 60_000:
        raise ValueError("the trigger must fit in the strings, and their length in 16 bits")
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tag", F.xxhash64("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_width(spark), -(-size // PART_BYTES))

    parsed = pin(base.mapInArrow(_parser(parts, length, trigger), PARSED), "phrases")
    early = parsed.where(F.col("part") == PART_REMOVED)
    early = early.select(F.lit(KIND_REMOVED).alias("kind"), "place", "tag", "starts", F.lit(None).cast("array<long>").alias("triggers"))
    busy = _busy_triggers(parsed, parts)
    met = parsed.where("part >= 0").select("part", "blob")
    if len(busy):
        met = met.mapInArrow(_spread(busy, parts), "part int, blob binary")
    met = pin(met.repartitionById(parts, F.col("part")).mapInArrow(_meet(crowded, busy), FOUND).unionAll(early), "met")
    unpin(parsed)

    wanted = met.where(F.col("kind") >= KIND_OPEN).groupBy("place", "tag").agg(F.collect_list(F.struct("kind", "starts", "triggers")).alias("wanted"))
    phrases = base.join(wanted, ["place", "tag"]).mapInArrow(_fetch(DICTIONARY_PARTS * parts, length), "part int, key long, place long, tag long, start long, phrase binary")
    late = phrases.repartitionById(DICTIONARY_PARTS * parts, F.col("part")).mapInArrow(_settle(length), FOUND)

    gone = met.where(F.col("kind") == KIND_REMOVED).select("place", "tag", "starts").unionAll(late.select("place", "tag", "starts"))
    gone = gone.groupBy("place", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return base.join(gone, ["place", "tag"], "left").withColumn("doc_id", F.when(F.col("place") > NULL_ID, F.col("place"))).select("doc_id", "text", "starts")


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                rows = []
                for doc, text, codes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                    data = text.encode()
                    spans = covered(len(data), codes or [], length)
                    kept, at = hashlib.sha256(), 0
                    for a, b in spans:
                        kept.update(data[at:a])
                        at = b
                    kept.update(data[at:])
                    rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ``removal`` over the whole documents table, 100 bytes;
    nulls, repeated ids and ties as there."""
    found = removal(table(spark, sf_dir, "documents"))
    return found.mapInArrow(_digest(LENGTH), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
