import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackforge.llm import langid, packing, quality, urlrules
from trackforge.llm.sampling import per_class

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---- quality


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op1_quality(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_gradients():
    rng = np.random.default_rng(0)
    model = quality.Model()
    x, first, y = rng.normal(0, 1, (7, quality.N_FEATURES)).astype(np.float32), np.array([0, 3, 4]), np.array([1, 0, 1], np.float32)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    loss = lambda: float(-np.mean(np.where(y > 0, np.log(p := model.forward(x, first)), np.log(1 - p))))
    for name, g in model.gradients(x, first, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = model.p[name][at], 1e-5
        model.p[name][at] = old + eps
        up = loss()
        model.p[name][at] = old - eps
        assert g[at] == pytest.approx((up - loss()) / (2 * eps), rel=1e-3), name
        model.p[name][at] = old


def test_forward_pass_by_a_plain_loop():
    model, rng = quality.Model(), np.random.default_rng(1)
    x, first = passages_of(["short", "A long text. " * 200, "", "x1 y2\n" * 300])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 0.02
    for k in model.p:
        model.p[k] = (model.p[k] + rng.normal(0, 0.1, model.p[k].shape)).astype(np.float32)
    p, got = model.p, model.forward(x, first)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for d, (a, b) in enumerate(zip(first, [*first[1:], len(x)], strict=True)):
        codes, weights = [], []
        for row in x[a:b]:
            z = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(z[i] * p["enc"][i, j] for i in range(len(z))) + p["enc0"][j]) for j in range(quality.HIDDEN)]
            dot = lambda w, w0, j: sum(h[i] * p[w][i, j] for i in range(len(h))) + p[w0][j]
            gated = [math.tanh(dot("v", "v0", j)) * sigmoid(dot("u", "u0", j)) for j in range(quality.ATTENTION)]
            codes.append(h)
            weights.append(math.exp(sum(g * w for g, w in zip(gated, p["w"][:, 0], strict=True))))
        mean = [sum(w * h[j] for w, h in zip(weights, codes, strict=True)) / sum(weights) for j in range(quality.HIDDEN)]
        want = sigmoid(sum(m * w for m, w in zip(mean, p["out"][:, 0], strict=True)) + p["out0"][0])
        assert got[d] == pytest.approx(want, rel=1e-3)


def passages_of(texts):
    return quality.passages(pa.array(texts))


def test_training_sees_every_passage(spark):
    """One bad passage in long texts, at any place, tells the labels."""
    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(160):
        parts = ["some good plain words here and there. " * 13] * 60
        if i % 2:
            parts[rng.integers(60)] = "#$%& 1|2 ## $$ %% 77 && " * 21
        rows.append((i, "".join(parts)))
        labels.append((i, 1 - i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs.where("doc_id < 120"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs.where("doc_id >= 120"), model).collect()}
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in got.items())


def test_quality_odd(spark, odd, crowded, none):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 0), (8, 0), (8, None), (99, 5)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(crowded, model).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(none, model).count() == 0
    for table in (odd, none):
        flat = quality.train(table, labels.limit(0))
        assert {r["score"] for r in quality.score(odd, flat).collect()} == {0.5}


# ---- language


def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = langid.op6_langid(spark, SF).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.01


def test_language_odd(spark, odd, crowded, none):
    model = langid.train(odd.where("doc_id <> 8"))
    rows = {r["doc_id"]: r for r in langid.identify(crowded, model).collect()}
    assert len(rows) == 10
    for i in (1, 2, 3, 8):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert rows[6]["lang_pred"] in ("en", "fr", "de")
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0
    kept = langid.keep_identified(crowded)
    assert kept.columns == crowded.columns and not {1, 2, 3, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.keep_identified(none).count() == 0


def test_language_learns_from_whole_texts(spark):
    """What tells the languages apart stands behind a long common opening."""
    rng = np.random.default_rng(5)
    words = {"a": ["lorem", "dolor", "amet"], "b": ["kvik", "zwyx", "juqh"]}
    row = lambda i, lang: (i, "0 the same opening " * 100 + " ".join(rng.choice(words[lang], 1000)), lang)
    model = langid.train(spark.createDataFrame([row(i, "ab"[i % 2]) for i in range(240)], "doc_id long, text string, lang string"))
    names, score, _ = model.predict(pa.array(["lorem amet dolor lorem", "zwyx kvik juqh zwyx"]))
    assert names == ["a", "b"] and min(score) > 0.8


def test_scores_by_a_plain_loop():
    """One n-gram after the other, from the embedding table's folded scores."""
    texts = ["Le chat dort. ", "the cat sleeps", "il dort, le chat!", "a cat, the cat"] * 30
    model = langid.fit(texts, ["fr", "en", "fr", "en"] * 30)
    for text in ["le cat 7 dort", "the", "été là", "x y"]:
        plain = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in text.encode())
        total, n = [0.0, 0.0], 0
        for size in langid.GRAMS:
            for i in range(len(plain) - size + 1):
                g = plain[i : i + size]
                if g[:2] == b"  ":
                    continue
                code = (int.from_bytes(g, "little") + (size << 40)) & (2**64 - 1)
                cell = int(langid.K.mix(np.array([code], np.uint64))[0]) >> 49
                n += 1
                for c in (0, 1):
                    total[c] += float(model.scores[cell, c])
        z = [(total[c] / n + model.bias[c]) / model.temperature for c in (0, 1)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        names, score, _ = model.predict(pa.array([text]))
        assert names[0] == model.languages[p.index(max(p))] and score[0] == pytest.approx(max(p), rel=1e-5)


def test_strange_texts_are_rejected_and_mixed_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where("lang <> 'de'"))
    rng = np.random.default_rng(3)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 400)) for _ in range(50)]
    text = lambda lang: [r["text"] for r in docs.where(f"lang = '{lang}' and n_chars between 600 and 3000").limit(40).collect()]
    unseen, en, fr = text("de"), text("en"), text("fr")
    assert model.predict(pa.array(noise))[2].all()
    assert model.predict(pa.array(unseen))[2].mean() > 0.9
    mixed = [a[:500] + "\n" + b[:500] for a, b in zip(en, fr, strict=False)]
    assert not model.predict(pa.array(en + fr + mixed))[2].any()


def test_stage_rejects_and_judges_what_it_did_not_learn(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(4)
    noise = [(10_000 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 300)), None, "x", 300) for i in range(20)]
    learned = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda d: learned.append({r["doc_id"] for r in d.collect()}) or train(d))
    kept = {r["doc_id"] for r in langid.keep_identified(docs.unionAll(spark.createDataFrame(noise, docs.schema))).collect()}
    assert not any(i >= 10_000 for i in kept)
    assert len(kept) >= 0.99 * docs.count()
    assert not learned[0] & learned[1] and len(learned[0] | learned[1]) == docs.count() + 20


def test_samples_are_bounded(spark):
    rows = spark.range(4000).selectExpr("id", "cast(id % 4 as string) lang")
    assert 350 < per_class(rows, "lang", "id", 100).count() < 450
    assert 30 < per_class(rows, "lang", "id", 100, 40).count() < 55
    assert per_class(rows, "lang", "id", 1000).count() == 4000
    assert per_class(rows.limit(0), "lang", "id", 10).count() == 0
    with pytest.raises(ValueError, match="different values"):
        per_class(spark.range(5000), "id", "id", 1)


# ---- packing


def fewest(items, capacity):
    n = len(items)
    best = [(99, 0)] * (1 << n)
    best[0] = (0, capacity)
    for m in range(1 << n):
        bins, used = best[m]
        for i in range(n):
            if not m >> i & 1:
                v = (bins, used + items[i]) if bins and used + items[i] <= capacity else (bins + 1, items[i])
                best[m | 1 << i] = min(best[m | 1 << i], v)
    return best[-1][0]


def histogram(items):
    out = {}
    for i in items:
        out[i] = out.get(i, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(150))
def test_reduction_is_safe(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([10, 20, 30]))
    items = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
    p = packing.Packer(histogram(items), capacity)
    p.reduce()
    rest = [n for n, c in p.left.items() for _ in range(c)]
    assert fewest(rest, capacity) + p.fixed == fewest(items, capacity)
    p.best_fit()
    assert sorted(n for lengths, times in p.runs for _ in range(times) for n in lengths) == sorted(items)
    assert all(sum(lengths) <= capacity for lengths, _ in p.runs)
    assert sum(t for _, t in p.runs) <= fewest(items, capacity) + 1


def test_packing_a_huge_histogram():
    runs = packing.Packer({n: 10**9 + n for n in range(1, 2049)}, 2048).solve()
    total = sum(n * (10**9 + n) for n in range(1, 2049))
    assert sum(t for _, t in runs) <= 1.001 * total / 2048


TEXTS = ["", "a", "a  b", "a \n b", "\n\nb", "x <|endoftext|> y", "a b  ", "tab\t x", " \x1c a", "été là ", "don't  stop's 12", "日本 語\u3000x", "\u0085 y"]


def test_encoder_equals_tokenizers(spark):
    e = packing.Encoder(packing.public_tokenizer())
    assert e.fast is not None
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [c.ids for c in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [e.encode(t).tolist() for t in texts] == want


@pytest.mark.parametrize("text", [" " * 3_000_000 + "x", "\n" * 1_100_000, "a b " * 500_000 + "\t" * 1_200_000 + " z"])
def test_encoder_on_long_white_space(text):
    e = packing.Encoder(packing.public_tokenizer())
    assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(rows, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= capacity for v in at.values())
    return len(at)


def test_packing_query(spark):
    rows = packing.op5_packing(spark, "/root/testdata/sf0.001").collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows) <= -(-total // 2048) + 1
    e = packing.Encoder(packing.public_tokenizer())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = [*e.tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        mine = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [a for a, _ in packing.cut(len(ids), 2048)]
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine]
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_packing_odd(odd, crowded, none):
    for table in (odd, crowded):
        rows = packing.pack_documents(table).collect()
        check_packed(rows)
        assert sum(r["doc_id"] == 4 for r in rows) == 2
        assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack_documents(none).count() == 0


# ---- urls

URLS = ["http://net/", "http://A.NET/x", "http://a.net", "x", "", "http://b.example.net/en/", "https://example.com/de/x?y#z", "http://example.com:80/de/", "http://org/fr/", "http://x.org/fr", "http://..net/", "http://net./", "http://notnet/", "http://x.b.example.net/de/", None, "a://b://net/", "http://example.net?/en/", "http://x\ny.net/a\nb?c", "http://example.net/en/", "http://example.net/en/"]


def judged(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_url_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert judged(urlrules.op7_urlrules(spark, SF)) == sorted(con.sql(urlrules.OP7_SQL).fetchall(), key=repr)


def test_url_odd(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (None, "http://q.net/")], "page_id long, url string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [*enumerate(URLS), (None, "http://q.net/")])
    rules = urlrules.rule_table(spark, urlrules.RULES)
    want = sorted(con.sql(urlrules.OP7_SQL).fetchall(), key=repr)
    assert judged(urlrules.judge(pages, rules)) == want
    assert judged(urlrules.judge(pages.withColumns({n: F.lit("z") for n in ("host", "path", "at", "part", "salt", "stack", "rule")}), rules)) == want
    assert judged(urlrules.judge(pages.limit(0), rules)) == []
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def plain_verdict(host, path, rules):
    fit = [(len(h) + len(p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fit)[1] + max(fit)[2], max(fit)[3]) if fit else (None, "allow")


def test_nested_rules(spark):
    rng = np.random.default_rng(5)
    hosts = [".".join(rng.choice(list("ab"), rng.integers(1, 5))) for _ in range(300)]
    rules = sorted({(h, "/" + "x/" * int(n)): "block" if b else "allow" for h, n, b in zip(hosts[:60], rng.integers(0, 3, 60), rng.integers(0, 2, 60), strict=True)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(i, f"http://{h}/" + "x/" * int(n)) for i, (h, n) in enumerate(zip(hosts, rng.integers(0, 4, 300), strict=True))]
    got = urlrules.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == 300
    for r in got:
        assert (r["rule"], r["verdict"]) == plain_verdict(r["host"], r["path"], rules)


@pytest.mark.parametrize("text", ["x", "xy", "xyz", "x " * 40])
def test_language_of_very_short_texts(text):
    model = langid.fit([text, "und der", "the and", text] * 4, ["a", "b", "c", "a"] * 4)
    names, score, _ = model.predict(pa.array([text, "7"]))
    assert names == [names[0], "und"] and names[0] in "abc" and 0 < score[0] <= 1
