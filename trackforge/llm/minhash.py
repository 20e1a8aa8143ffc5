"""MinHash near-duplicate detection with min-max hashing.

Under each of P hash permutations both the smallest and the largest shingle
value are kept, so 2 P signature values cost P evaluations (Ji et al., "Min-Max
Hash for Jaccard Similarity").  Bands of signature values propose candidates;
every link is confirmed on the full shingle sets, and no candidate is dropped on
an estimate.

How the work is kept whole:

* Texts with equal shingle sets fall together first, by an aggregate that
  combines before the shuffle; only one representative goes on.
* In each band bucket all members are first held against one hub (a star, not
  all pairs).  A bucket whose members are then one component is done.
* The members of open buckets meet anew by their rarest shingles (prefix
  filter): two sets that are similar enough share one of them, so texts that
  have only a template in common never meet.  Shingles whose holders are one
  component are done.  Buckets of ``FEW`` members go on as they are.
* Holders of a shingle (members of a small bucket) join the group of the
  smallest of them, once however many shingles they share with it.
* A group is settled by matrix products that count common shingles, in one task
  for each block of members.  Links between components come back, as few as
  join them.  Where there are several blocks, only members outside the group's
  largest component are sent to every block, since that component has nothing
  left to settle within itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .graph import connected_components, roots
from .shared import pin, shuffle_width, table, unpin

ROWS = 4  # signature values in a band
MISS = 1e-8  # chance that no band of a pair just at the threshold agrees
FEW = 8  # members of a bucket that are compared without the prefix filter
BLOCK = 512  # members in a block
BLOCK_SHINGLES = 1 << 20  # and their shingles, about
COLUMNS = 4096  # shingles in one matrix product


def n_bands(threshold: float) -> int:
    n = math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))
    return n + n % 2  # whole permutations


def _permutations(n: int) -> np.ndarray:
    return np.random.default_rng(20141).integers(0, 1 << 63, n, dtype=np.uint64) * K.U64(2) + K.U64(1)


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = K.text_bytes(batch.column("text"))
    starts, ends, rows = K.word_spans(buf, offs, K.NOT_SPACE)
    own, own_rows = K.shingles(K.word_hashes(buf, starts, ends), rows, batch.num_rows, k)
    return K.row_sets(own, own_rows, batch.num_rows)


def set_keys(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """128-bit key of each set: two sums of differently mixed members and its size."""
    out = np.zeros((len(offs) - 1, 2), K.U64)
    sizes = np.diff(offs)
    some = np.flatnonzero(sizes)
    if len(some):
        for j, salt in enumerate((0x1234567890ABCDEF, 0x0FEDCBA987654321)):
            out[some, j] = K.mix(np.add.reduceat(K.mix(values ^ K.U64(salt)), offs[some]) + sizes[some].astype(K.U64))
    return out


def signatures(values: np.ndarray, offs: np.ndarray, bands: int) -> np.ndarray:
    """Rows x (bands * ROWS) values of 32 bits; zeros for empty sets."""
    perms = _permutations(bands * ROWS // 2)
    out = np.zeros((len(offs) - 1, 2 * len(perms)), np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        at = offs[some]
        for j, a in enumerate(perms):
            v = values * a
            v ^= v >> K.U64(29)
            v *= K.U64(0xBF58476D1CE4E5B9)
            out[some, 2 * j] = np.minimum.reduceat(v, at) >> K.U64(32)
            out[some, 2 * j + 1] = np.maximum.reduceat(v, at) >> K.U64(32)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """A band joins values of different permutations: minima and maxima alike."""
    out = np.zeros((len(sig), bands), K.U64)
    order = np.arange(sig.shape[1]).reshape(-1, 2).T.ravel()  # all minima, then all maxima
    for b in range(bands):
        h = np.full(len(sig), b + 1, K.U64)
        for c in order[b * ROWS : (b + 1) * ROWS]:
            h = K.mix(h * K.U64(0xD6E8FEB86659FD93) + sig[:, c].astype(K.U64))
        out[:, b] = h
    return out.view(np.int64)


def _sketcher(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                values, offs = shingle_sets(batch, k)
                sig = signatures(values, offs, bands)
                keys = set_keys(values, offs)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(offs)),
                        K.binary_column(keys.ravel(), np.arange(n + 1) * 2),
                        pa.array(keys[:, 0].view(np.int64)),
                        batch.column("tag"),
                        K.binary_column(sig.ravel(), np.arange(n + 1) * sig.shape[1]),
                    ],
                    names=["doc_id", "n_shingles", "key", "node", "tag", "sig"],
                )

    return run


def _bander(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, -1)
                each = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), bands)) for c in ("node", "n_shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig, bands).ravel()), *each], names=["band", "node", "n_shingles"])

    return run


def _set_reader(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                values, offs = shingle_sets(batch, k)
                keys = K.binary_column(set_keys(values, offs).ravel(), np.arange(batch.num_rows + 1) * 2)
                same = pa.compute.equal(keys, batch.column("key"))
                out = pa.RecordBatch.from_arrays([batch.column("node"), K.binary_column(values, offs)], names=["node", "members"])
                yield out.filter(same)

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(both) - inter)


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            ok = [similar(np.frombuffer(x, K.U64), np.frombuffer(y, K.U64), percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def cross_links(sets: list[np.ndarray], comps: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between components, as pairs of them: enough to join what the similar
    pairs of a ``left`` and a ``right`` member join, never all of them."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) <= 4:
        near = [(i, j) for i in left for j in right if comps[i] != comps[j] and similar(sets[i], sets[j], percent)]
    else:
        tokens, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times > 1
        column = (np.cumsum(shared) - 1)[number]
        row, keep = np.repeat(np.arange(len(sets)), sizes), shared[number]
        row, column = row[keep], column[keep]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24
        for lo in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + COLUMNS))
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[row[a:b], column[a:b] - lo] = 1
            common += has[left] @ has[right].T
        common = common.astype(np.int64)
        ok = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
        ok &= comps[left][:, None] != comps[right][None, :]
        near = [(left[i], right[j]) for i, j in np.argwhere(ok)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    for i, j in near:
        a, b = find(int(comps[i])), find(int(comps[j]))
        if a != b:
            root[a] = b
            links.append((int(comps[i]), int(comps[j])))
    return links


def _task_linker(percent: int):
    """Links of each task, a run of rows with equal ``grp, i, j``."""

    def settle(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        rows = pa.Table.from_batches(parts)
        side, comps = rows.column("side").to_numpy(), rows.column("comp").to_numpy()
        sets = [np.frombuffer(x, K.U64) for x in rows.column("members").to_pylist()]
        own, guests = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return cross_links(sets, comps, own, guests if len(guests) else own, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        links: list[tuple[int, int]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(c).to_numpy() for c in ("grp", "i", "j")]
            edge = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0)))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), batch.num_rows], strict=True):
                name = tuple(int(x[a]) for x in names)
                if held and name != last:
                    links += settle(held)
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            links += settle(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _parts(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / F.lit(BLOCK), size / F.lit(BLOCK_SHINGLES), F.lit(1.0))).cast("int")


def _settled(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``groups(grp, node, comp, n_shingles)`` to links (a, b) between components."""
    by = groups.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    by = by.groupBy("grp").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    others = F.col("n") - F.col("top.n")
    by = by.where(others > 0).select("grp", F.col("top.comp").alias("top"), _parts(F.col("n"), F.col("size")).alias("ni"), _parts(others, F.col("size") * others / F.col("n")).alias("nj"))
    rows = groups.join(by, "grp")

    def deal(n: str) -> Column:
        return F.pmod(F.xxhash64("node", "grp"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = rows.select("grp", "node", "comp", deal("ni").alias("i"), every("nj").alias("j"), F.lit(0).alias("side"))
    guests = rows.where("ni > 1 and comp <> top").select("grp", "node", "comp", every("ni").alias("i"), deal("nj").alias("j"), F.lit(1).alias("side"))
    tasks = own.unionAll(guests).join(sets, "node")
    tasks = tasks.repartition(shuffle_width(groups.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side")
    return tasks.select("grp", "i", "j", "side", "comp", "members").mapInArrow(_task_linker(percent), "a long, b long")


def _spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            sets = [np.frombuffer(x, np.int64) for x in batch.column("members").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], names=["grp", "node"])


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups ``grp, node, comp, n_shingles`` of ``nodes(node, comp, n_shingles)``
    that hold a shingle of their prefixes in common; ``grp`` is their smallest node.
    Also the table that they are read from.

    Two sets with 100 * common >= ``percent`` * union have at least that share of
    either set in common.  So they share one of the first n - ceil(n * percent / 100)
    + 1 shingles of each in any order of all shingles.  Here the rarest come first;
    shingles that nobody else holds take their places, but make no groups.
    """
    each = nodes.select("node").join(sets, "node").mapInArrow(_spell_out, "grp long, node long")
    held = each.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("node")
    shared = each.join(held, "grp").withColumns({"nth": F.row_number().over(own.orderBy("n", "grp")), "shared": F.count(F.lit(1)).over(own)})
    shared = shared.join(nodes, "node")
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    rare = pin(shared.where(F.col("n_shingles") - F.col("shared") + F.col("nth") <= first).select("grp", "node", "comp", "n_shingles"), "rare")
    crossed = rare.groupBy("grp").agg(F.min("node").alias("head"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return rare.join(crossed, "grp").select(F.col("head").alias("grp"), "node", "comp", "n_shingles"), rare


def _labelled(nodes: DataFrame, on: str, labels: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the label of column ``on`` (itself where it has none)."""
    found = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return nodes.join(found, F.col(on) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", on)).drop("_node", "_label")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``doc_id, n_shingles, component_id, kept``.

    One row per row of ``docs``, none for an empty table.  Texts are linked when 100 * intersection >=
    ``percent`` * union of their distinct ``k``-word shingles; ``component_id``
    is the smallest doc_id reachable over links and ``kept`` marks it.

    Null, empty and wordless texts have no shingles and stay by themselves.
    Repeated rows share their component (all copies of its smallest id are
    kept), also where their set is shared by other rows.  Different texts under
    one doc_id are judged one by one.  A row without a doc_id has neither
    component nor mark (null, false).  Very long texts are read whole.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    return _judged(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """As ``near_duplicates``, with ``key`` (of the shingle set) and ``tag`` (of the text)."""
    bands = n_bands(percent / 100)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
    sketch = pin(base.mapInArrow(_sketcher(k, bands), "doc_id long, n_shingles long, key binary, node long, tag long, sig binary"), "sketch")

    # one representative of equal sets
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("key").agg(F.min(F.struct("doc_id", "node", "n_shingles", "sig")).alias("x"))
    reps = pin(reps.select("key", "x.doc_id", "x.node", "x.n_shingles", "x.sig"), "reps")

    # band buckets with two members at least
    banded = reps.mapInArrow(_bander(bands), "band long, node long, n_shingles long")
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1").drop("n")
    members = pin(banded.join(buckets, "band"), "members")

    # the full sets of all candidates, by a second look at their texts
    candidates = members.select("node").distinct().join(reps.select("node", "key", "doc_id"), "node")
    sets = pin(base.drop("tag").join(candidates, "doc_id").mapInArrow(_set_reader(k), "node long, members binary").dropDuplicates(["node"]), "sets")

    # a star around one member of each bucket, the same one for overlapping buckets
    star = members.where("node <> hub").groupBy(F.col("node").alias("a")).agg(F.min("hub").alias("b"))
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    linked = pin(star.join(left, "a").join(right, "b").mapInArrow(_confirmer(percent), "a long, b long"), "star")
    first = roots(linked)

    # what is left between the components of open buckets
    located = pin(_labelled(members, "node", first, "comp"), "located")
    state = located.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_ = located.join(state.where("lo < hi").select("band", (F.col("n") <= FEW).alias("few")), "band")
    many = open_.where("not few").select("node", "comp", "n_shingles").distinct()
    few = open_.where("few").select(F.col("hub").alias("grp"), "node", "comp", "n_shingles")
    more, rare = _by_rare_shingles(many, sets, percent)
    groups = pin(few.unionAll(more).distinct(), "groups")
    links = pin(_settled(groups, sets, percent), "links")
    second = connected_components(links)
    unpin(members, sets, linked, located, rare, groups, links)

    final = _labelled(_labelled(reps.select("key", "node", "doc_id"), "node", first, "c1"), "c1", second, "comp")
    lowest = final.groupBy("comp").agg(F.min("doc_id").alias("found"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    final = final.join(lowest, "comp", "left").select("key", F.coalesce("found", "doc_id").alias("found"))
    out = sketch.drop("sig", "node").join(final, "key", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "key", "tag", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, whole, that represent their group.

    Of rows with one doc_id and equal shingle sets one stays; different texts
    under one doc_id are judged one by one.  Rows without a doc_id, and null, empty and
    wordless texts, stay.
    """
    found = _judged(docs, k, percent).where("kept").groupBy("doc_id", "key").agg(F.min("tag").alias("tag"))
    taken = {c.lower() for c in docs.columns}
    kept_id, kept_tag, tag = (next(n for i in range(len(taken) + 1) if (n := f"{name}_{i}") not in taken) for name in ("kept_id", "kept_tag", "tag"))
    found = found.select(F.col("doc_id").alias(kept_id), F.col("tag").alias(kept_tag))
    named = docs.where("doc_id is not null").withColumn(tag, F.xxhash64("text"))
    kept = named.join(found, (F.col("doc_id") == F.col(kept_id)) & (F.col(tag) == F.col(kept_tag)), "left_semi").dropDuplicates(["doc_id", tag]).drop(tag)
    return kept.unionAll(docs.where("doc_id is null"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of the whole documents table, three words and 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
