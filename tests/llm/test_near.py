import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trackforge.llm import fingerprints as P
from trackforge.llm import graph, minhash
from trackforge.llm import kernels as K


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = minhash.op8_minhash(spark, small).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near_groups(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def families(seed, n=240):
    """Copies of copies with single words changed: links near the threshold, chains
    that no star around one text covers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(40)] for _ in range(3)]
    while len(texts) < n:
        t = rng.choice(texts).copy()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    return [(i * 7 % 1009, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block"), [(1, 384), (2, 16)])
def test_chains(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_dict(minhash.near_duplicates(df, 3, 85)) == brute.near_groups(rows, 3, 85)


@pytest.mark.parametrize("table", ["odd", "crowded"])
def test_odd_rows(request, table):
    got = minhash.near_duplicates(request.getfixturevalue(table)).select("doc_id", "n_shingles", "component_id", "kept")
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert len(rows) == 11
    by_id = {r[0]: r for r in rows}
    assert by_id[1] == (1, 0, 1, True) and by_id[3] == (3, 0, 3, True)
    assert by_id[5][2:] == (4, False) and by_id[4][2:] == (4, True)
    assert by_id[None] == (None, 8, None, False)
    kept = minhash.keep_one_of_each(request.getfixturevalue(table))
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == sorted(map(str, [1, 2, 3, 4, 6, None, 7, 8, 9]))


def test_different_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b + " more"), (9, a.upper()), (5, a), (None, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(5, 26, 5, True), (5, 26, 3, False), (3, 27, 3, True), (9, 26, 5, False), (5, 26, 5, True), (None, 26, None, False), (None, 26, None, False)], key=repr)
    kept = sorted(map(tuple, minhash.keep_one_of_each(df).collect()), key=repr)
    assert kept == sorted([(5, a), (3, b + " more"), (None, c), (None, c)], key=repr)


def test_recall_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for k, percent in ((3, 85), (5, 80)):
        got = as_dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent))
        assert got == brute.near_groups(rows, k, percent)  # recall and precision 1


def test_settling_alone_finds_all_links(spark, monkeypatch):
    """Without the star, by rare shingles and small blocks only."""
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 64)
    star = minhash._confirmer
    monkeypatch.setattr(minhash, "_confirmer", lambda percent: star(101))
    rows = families(3, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_dict(minhash.near_duplicates(df, 3, 85))
    assert got == brute.near_groups(rows, 3, 85)


def test_pins_go(spark):
    import os

    from trackforge.llm import shared

    a = shared.pin(spark.range(3), "x")
    path = a.pinned_at.removeprefix("file:").replace("//", "/")
    assert os.path.isdir(path) and a.count() == 3
    shared.unpin(a)
    assert not os.path.exists(path)


def test_empty_tables(none):
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.keep_one_of_each(none).columns == none.columns
    assert P.edited_likeness(none).count() == 0
    assert P.fingerprint(none).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_bands_hardly_miss():
    for t in (0.8, 0.85, 0.95):
        assert (1 - t**minhash.ROWS) ** minhash.n_bands(t) <= minhash.MISS


def test_min_max_estimate():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(base[:800]), np.sort(base[200:])
    sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 800, 1600]), 64)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.1


def sketch(text):
    return P.sketches(pa.array([text]))[0]


def plain_sketch(text):
    """Shingle hashes one by one, in Python integers; the smallest of them."""
    ones = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ones
        x = (x ^ x >> 27) * 0x94D049BB133111EB & ones
        return x ^ x >> 31

    words = []
    for w in brute.re.findall(r"[^\x20\x09-\x0D]+", brute.lower(text)):
        b = w.encode()
        words.append(mix((sum(int(K._LETTER[c]) * pow(int(K._BASE), i, 1 << 64) for i, c in enumerate(b)) + len(b)) & ones))
    few, out = len(words) < P.SHINGLE, set()
    for i in range(1 if words and few else len(words) - P.SHINGLE + 1):
        h = 0
        for w in words[i : i + P.SHINGLE]:
            h = (h * 0xD6E8FEB86659FD93 + w) & ones
        out.add(mix(h ^ 0xA5A5A5A5A5A5A5A5) if few else mix(h))
    return sorted(out)[: P.SIZE]


def test_sketches_by_a_plain_loop(spark):
    texts = ["", None, "  ", "One two", "one TWO three four five", "a a a a a a a", "été là où va-t-il, dis donc ?\n" * 3]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000").limit(60).collect()]
    assert [a.tolist() for a in P.sketches(pa.array(texts))] == [plain_sketch(t or "") for t in texts]


def test_sketches_merge_and_estimate():
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    x, y = sketch(a), sketch(b)
    sa, sb = brute.shingle_set(a, 5), brute.shingle_set(b, 5)
    assert abs(P.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.15
    assert abs(P.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
    assert abs(P.distinct_count(x) / len(sa) - 1) < 0.3
    assert (P.merge(x, y) == P.merge(y, x)).all() and abs(P.distinct_count(P.merge(x, y)) / len(sa | sb) - 1) < 0.3
    assert (P.decode(P.encode(x)) == x).all()
    few, more = sketch("a b c d e f"), sketch("a b c d e f g")
    assert P.resemblance(few, more) == 2 / 3 and P.containment(few, more) == 1 and P.distinct_count(few) == 2
    assert P.resemblance(sketch(""), sketch(" ")) == 1 and P.resemblance(sketch(""), few) == 0


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        out.append((d, t, new, nxt))
    return out


@pytest.mark.parametrize("table", ["odd", "crowded", "small"])
def test_edited_texts(spark, request, table):
    import hashlib

    df = request.getfixturevalue(table)
    df = spark.read.parquet(f"{df}/documents.parquet") if isinstance(df, str) else df
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in P.edited_likeness(df).collect())
    want = []
    for d, t, new, nxt in edited(rows):
        a, b, c = sketch(t), sketch(new), sketch(nxt)
        want.append((str(d), len(t), hashlib.sha256(new.encode()).hexdigest(), P.encode(a), P.encode(b), P.resemblance(a, b), P.resemblance(a, c)))
    assert got == sorted(want)


def test_fingerprint_keeps_columns(crowded):
    out = P.fingerprint(crowded)
    assert out.columns[:-1] == crowded.columns and out.columns[-1] == "fingerprint_0"
    marks = {r["doc_id"]: r["fingerprint_0"] for r in out.where(F.col("doc_id").isNotNull()).collect()}
    assert marks[1] == marks[2] == "" and marks[4] == marks[5] != ""
