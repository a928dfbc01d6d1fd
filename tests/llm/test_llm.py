"""Operators of the llm subpackage on small fixtures, against brute force, the public tokenizer library and round trips."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.names import tod_key
from driftline.llm import encode, garbled, mixing, nearest, percentiles

VOCAB = os.path.exists(encode.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCAB, reason="no vocabulary file")


# nearest in time


def brute_nearest(left, right, tol):
    out = {}
    for k, t, i in left:
        if k is None or t is None or not math.isfinite(t):
            continue
        best = None
        for rk, rt, ri in right:
            if rk != k or rt is None or not math.isfinite(rt) or abs(rt - t) > tol:
                continue
            c = (abs(rt - t), -rt, -ri)
            if best is None or c < best[0]:
                best = (c, ri, rt - t)
        if best:
            out[i] = best[1:]
    return out


@pytest.mark.parametrize("block,batch", [(None, 10000), (7.0, 3), (1000.0, 5)])
def test_nearest_random(spark, block, batch):
    r = random.Random(4)
    key = lambda: r.choice(["a", "b", "hot", "hot", "hot", None])
    time = lambda: r.choice([None, float("nan"), float("inf"), *[round(r.uniform(0, 60) * 2) / 2 for _ in range(40)]])
    left = [(key(), time(), i) for i in range(150)]
    right = [(key(), time(), 1000 + i) for i in range(80)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        a = spark.createDataFrame(left + left[:20], "k string, t double, id long")
        b = spark.createDataFrame(right + right[:20], "k string, t double, id long")
        got = nearest.nearest_in_time(a, b, F.col("k"), F.col("k"), "t", "t", "id", "id", 2.5, block).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len({x["id"] for x in got})
    assert {x["id"]: (x["right_id"], x["lag"]) for x in got} == brute_nearest(left, right, 2.5)


def test_nearest_empty_and_names(spark):
    kind = "tod_name string, ctime double, fit_id long"
    a = spark.createDataFrame([(" x/A.ZIP ", 5.0, 1)], kind)
    b = spark.createDataFrame([("a", 5.5, 7), ("a", 4.5, 8)], "tod_name string, ctime double, reading_id long")
    k = tod_key(F.col("tod_name"))
    f = lambda x, y: [tuple(r) for r in nearest.nearest_in_time(x, y, k, k, "ctime", "ctime", "fit_id", "reading_id", 20.0).collect()]
    assert f(a, b) == [(1, 7, 0.5)]
    assert f(a.limit(0), b) == [] and f(a, b.limit(0)) == []


# percentiles


@pytest.mark.parametrize("shape", ["normal", "long tail", "sorted", "ties"])
def test_sketch_error_stays_below_its_bound(shape):
    r = np.random.default_rng(1)
    n = 400_000
    x = {"normal": r.normal(size=n), "long tail": np.exp(3 * r.normal(size=n)), "sorted": np.arange(n) * 1.0, "ties": r.integers(0, 50, n) * 1.0}[shape]
    parts = [percentiles.Sketch().add(p) for p in np.array_split(x, 37)]
    s = percentiles.Sketch.unpack(parts[0].pack())
    for p in parts[1:]:
        s.merge(percentiles.Sketch.unpack(p.pack()))
    assert s.n == n and len(s.pack()) < 400_000
    v = np.sort(x)
    for q in (0.0001, 0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999, 0.9999):
        got = s.quantiles([q])[0]
        lo, hi = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
        off = max(0.0, lo - math.ceil(q * n), math.ceil(q * n) - hi) / n
        assert off <= s.rank_error(q) + 1 / n, (shape, q, off)


def test_pieces_of_values_make_the_same_sketch():
    v = np.exp(np.random.default_rng(2).normal(size=50_000))
    whole = percentiles.Sketch().take(v).settle().pack()
    for size in (1, 700, 10_001):
        s = percentiles.Sketch()
        for a in range(0, len(v), size):
            s.take(v[a : a + size])
        assert s.settle().pack() == whole and s.n == len(v)


def test_small_sketch_is_exact_and_merges():
    a, b = percentiles.Sketch().add(np.array([3.0, 1.0])), percentiles.Sketch().add(np.array([2.0]))
    assert a.merge(b).quantiles([0.0, 0.34, 0.5, 1.0]) == [1.0, 2.0, 2.0, 3.0] and a.rank_error(0.5) == 0
    assert math.isnan(percentiles.Sketch().quantiles([0.5])[0])
    big = percentiles.Sketch().add(np.arange(5000.0))
    assert percentiles.Sketch().add(np.array([9e9])).merge(big).n == 5001


def test_sketch_columns(spark):
    r = np.random.default_rng(0)
    rows = [(None if i % 50 == 0 else "pa", i % 2, float(v) if i % 9 else None) for i, v in enumerate(r.normal(size=700))]
    rows += [("pa", 0, float("nan")), ("pa", 0, float("inf")), ("none", 0, None)]
    df = spark.createDataFrame(rows, "pa string, n int, x double").repartition(5)
    s = percentiles.sketch_columns(df, ["pa", "n"], ["x"])
    whole = percentiles.read_percentiles(percentiles.merge_sketches(s, ["pa"]), {"p50": 0.5}).collect()
    for row in whole:
        own = sorted(x for p, _, x in rows if p == row["pa"] and x is not None and math.isfinite(x))
        assert row["n_values"] == len(own) and row["p50"] == own[math.ceil(0.5 * len(own)) - 1] and row["p50_error"] == 0
    assert {r["pa"] for r in whole} == {"pa", None}
    assert percentiles.sketch_columns(df.limit(0), ["pa"], ["x"]).count() == 0
    items = percentiles.percentiles_of_items(percentiles.sketch_items(s), ["pa"], {"p50": 0.5})
    assert {tuple(r) for r in items.collect()} == {(r["pa"], r["metric"], r["n_values"], r["p50"]) for r in whole}


def test_large_groups_are_split_and_repeats_count_once(spark):
    r = np.random.default_rng(3)
    v = np.exp(2 * r.normal(size=40_000))
    df = spark.createDataFrame([("hot", i, float(x)) for i, x in enumerate(v)] + [("cold", i, float(i)) for i in range(50)], "pa string, i int, value double")
    df = df.unionByName(df.where("i % 3 = 0")).unionByName(df.where("i < 10").withColumn("value", F.lit(None).cast("double")).withColumn("i", F.lit(-1))).repartition(6)
    qs = {"p01": 0.01, "p50": 0.5, "p999": 0.999}
    for most in (1 << 22, 3000):
        s = percentiles.sketch_columns(df, ["pa"], ["value"], once=[F.col("i")], most=most)
        got = percentiles.read_percentiles(s, qs)
        assert {r["pa"]: r["n_values"] for r in got.collect()} == {"hot": 40_000, "cold": 50}
        again = percentiles.sketch_columns(df.repartition(9), ["pa"], ["value"], once=[F.col("i")], most=most)
        assert {(r["pa"], bytes(r["sketch"])) for r in again.collect()} == {(r["pa"], bytes(r["sketch"])) for r in s.collect()}
        within = percentiles.ranks_within_bounds(got, df.dropDuplicates(["pa", "i"]).select("pa", "value"), ["pa"], qs).collect()
        assert len(within) == 6 and all(x["within"] for x in within)
        items = percentiles.sketch_items(s)
        assert items.where("level > 0").count() > 0 and items.where("pa = 'hot'").count() < 20_000
        assert {r["pa"]: r["n_values"] for r in percentiles.percentiles_of_items(items, ["pa"], qs).collect()} == {"hot": 40_000, "cold": 50}


# encoding


@needs_vocabulary
def test_encoding_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    r = random.Random(3)
    texts = ["", " ", "a", "\n\n  x", "<|endoftext|> it's 12 ÄÖ 東京", "あ" * 4000, "ab" * 3000, "".join(chr(r.randrange(32, 0x3000)) for _ in range(3000)), "".join(r.choice("aeinorst ") for _ in range(20000)), "é" * 257, "!?" * 200]
    rows = [(i, x, i) for i, x in enumerate([*texts, None, *texts[:3]])]
    got = encode.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert len(got) == len(rows)
    for (i, x, _), row in zip(rows, sorted(got, key=lambda g: g["doc_id"])):
        assert row["ids"] == (t.encode(x, add_special_tokens=False).ids if x else [])
    n = encode.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert {g["doc_id"]: g["n_tokens"] for g in n} == {g["doc_id"]: len(g["ids"]) for g in got}
    assert encode.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vocabularies_whose_merges_are_not_in_order(tmp_path):
    """Two merges make the token abc; pieces over LONG bytes must come out as short ones do."""
    letters = encode._byte_letters()
    vocab = {c: i for i, c in enumerate([*letters, "bc", "abc", "ab", "abcd", "dd"])}
    merges = ["b c", "a bc", "abc d", "a b", "ab c", "d d"]
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    t = encode.load_table(str(path))
    assert not t["ordered"] and (not VOCAB or encode.load_table()["ordered"])

    def brute(b):
        ids = [letters[x] for x in b]
        rank = {tuple(m.split()): i for i, m in enumerate(merges)}
        while True:
            r = [rank.get(p, 99) for p in zip(ids, ids[1:])]
            if not r or min(r) == 99:
                return [vocab[x] for x in ids]
            i = r.index(min(r))
            ids[i : i + 2] = [ids[i] + ids[i + 1]]

    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("abcd") for _ in range(n)).encode() for n in (1, 7, 200, 300, 900)]
    ids, off = encode.encode_pieces(t, pieces)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [brute(p) for p in pieces]


# mixing


def test_weights_reach_targets_limits_and_entropy():
    tokens, target, rep = {"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 2}
    w, size, e = mixing.mixture_weights(tokens, target, rep)
    assert e == 0 and size == pytest.approx(100 * 3 / (4 / 9)) and w["b"] == pytest.approx(4 / 9)
    w, size, e = mixing.mixture_weights(tokens, target, rep, budget=1000)
    assert 0 < e < 1 and w["b"] * 1000 == pytest.approx(300, rel=1e-6) and sum(w.values()) == pytest.approx(1)
    w, size, e = mixing.mixture_weights(tokens, target, rep, budget=10_000)
    assert size == 1300 and w["a"] * size == pytest.approx(1000)
    w, _, e = mixing.mixture_weights(tokens, {"a": 0.99, "b": 0.01}, {"a": 100, "b": 100}, entropy=0.2)
    assert -sum(v * math.log(v) for v in w.values()) == pytest.approx(0.2, abs=1e-6)
    assert mixing.mixture_weights({}, target, rep)[0] == {}


@pytest.mark.parametrize("budget", [None, 4000.0])
def test_mix(spark, budget):
    r = random.Random(1)
    docs = [(i, r.choice(["a", "a", "a", "b", None, "x"]), r.choice([None, 0, -1, *range(1, 30)])) for i in range(800)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("gone", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, n int")
    chosen, report = mixing.mix(df, "source", "doc_id", "n", targets, budget, per_block=16)
    got, rep = chosen.collect(), {x["source"]: x for x in report.collect()}
    assert all(1 <= x["copies"] <= {"a": 1, "b": 2}[x["source"]] for x in got) and len({x["doc_id"] for x in got}) == len(got)
    assert set(rep) == {"a", "b", "gone"} and rep["gone"]["tokens"] == 0
    for s in "ab":
        assert rep[s]["tokens"] == sum(x["n_tokens"] * x["copies"] for x in got if x["source"] == s)
    if budget is None:
        total = rep["a"]["tokens"] + rep["b"]["tokens"]
        assert abs(rep["a"]["tokens"] / total - 5 / 9) < 40 / total
    again = {(x["doc_id"], x["copies"]) for x in mixing.mix(df.repartition(7), "source", "doc_id", "n", targets, budget, per_block=16)[0].collect()}
    assert again == {(x["doc_id"], x["copies"]) for x in got}


def test_temperature_meets_the_entropy_or_the_limits():
    tokens, many = {"a": 1000, "b": 100, "c": 10, "d": 0}, {"a": 99, "b": 99, "c": 99}
    for h in (0.3, 0.7, 1.05):
        w, size, t = mixing.temperature_weights(tokens, many, h)
        assert mixing.entropy_of(w) == pytest.approx(h, abs=1e-6) and size == 1110 and set(w) == {"a", "b", "c"}
        assert w["b"] / w["a"] == pytest.approx(0.1**t)
    w, size, t = mixing.temperature_weights(tokens, {"a": 1, "b": 2, "c": 3}, 1.05)
    assert 0 < t < 1 and w["c"] * size == pytest.approx(30, rel=1e-6) and w["b"] * size < 200
    assert mixing.temperature_weights(tokens, many, 9.0)[2] == 0 and mixing.temperature_weights({}, many, 1.0)[0] == {}


def test_blocks_grow_with_the_source(spark):
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), (F.col("id") % 50).alias("n"))
    for per_block, temperature in ((50_000, False), (2, False), (2, True)):
        chosen, report = mixing.mix(df, "source", "doc_id", "n", targets, temperature=temperature, per_block=per_block)
        assert all(r["repeats_kept"] and r["share_reached"] for r in mixing.kept_limits(report).collect())
        assert chosen.count() > 1000


def test_mix_empty(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(spark.createDataFrame([], "doc_id long, source string, n int"), "source", "doc_id", "n", targets)
    assert chosen.count() == 0 and report.count() == 1


# garbled text

GOOD = {
    "fr": "Même après l’été, rien n’a bougé. La qualité est médiocre, très loin de la photo.",
    "de": "Für Körpergröße 180 ausgewählt. Der Verkäufer antwortete erst nach 12 Wochen.",
    "pl": "Za 15 zł naprawdę warto. Jest też wersja żółta i zielona, działa świetnie.",
    "tr": "Satıcı yazdı, kargo uzunluğunda şaşırtıcı. Çok beğendiğim bir ürün.",
    "ru": "Доставили за 18 дней, коробка целая. Очень доволен, всё работает.",
    "el": "Μύριζε στο μπαλκόνι για 16 μέρες. Χάλασε σε 15 μέρες, κρίμα.",
    "ja": "青と緑もあるようです。家族にもすすめました。特ににおいが良いです。",
}


def corpus(n=150):
    r = random.Random(7)
    words = {k: v.split() for k, v in GOOD.items()}
    return [(k, v if k == "ja" else " ".join(r.sample(words[k], len(words[k])))) for k, v in GOOD.items() for _ in range(n)]


SWAPS = [("fr", "utf-8", "cp1252"), ("fr", "utf-8", "mac_roman"), ("de", "utf-8", "cp437"), ("de", "utf-8", "latin-1"), ("pl", "cp1250", "cp1252"), ("tr", "cp1254", "cp1252"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("ru", "utf-8", "cp1251"), ("el", "cp1253", "cp1252"), ("ja", "cp932", "latin-1"), ("ja", "euc_jp", "latin-1")]


def test_garbled_round_trip(spark):
    clean = corpus()
    bad = [(GOOD[k], GOOD[k].encode(w, "ignore").decode(r, "ignore")) for k, w, r in SWAPS]
    # of the bytes a page leaves undefined nothing can come back
    kept = [GOOD[k].encode(w, "ignore").decode(r, "ignore").encode(r, "ignore").decode(w, "ignore") == GOOD[k] for k, w, r in SWAPS]
    twice = GOOD["fr"].encode().decode("latin-1").encode().decode("latin-1")
    lost = "La qualit� est m�diocre"
    odd = ["Ã is printed on the label of size A", "\\u00e9 &eacute; %C3", "plain ascii", "", None, "™ ® ©"]
    marks = ["∩╗┐" + GOOD["fr"], "ï»¿Plain words after the mark", *["∩╗┐The box is here"] * 6]
    rows = [(40_000 + i, t, "s", "x") for i, t in enumerate(marks)] + [(i, t, "s", "x") for i, (_, t) in enumerate(clean)] + [(10_000 + i, g, "s", "x") for i, (_, g) in enumerate(bad)] + [(20_000, twice, None, "x"), (20_001, lost, "S", "x")] + [(30_000 + i, t, "s", "x") for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, restored string")
    got = {x["doc_id"]: x for x in garbled.find_garbled(df, "doc_id", "text", F.lower("source")).collect()}
    assert set(got) == {10_000 + i for i in range(len(bad))} | {20_000, 20_001} | {40_000 + i for i in range(len(marks))}
    assert got[40_000]["restored"].lstrip("\ufeff") == GOOD["fr"]
    for i, (good, _) in enumerate(bad):
        if kept[i]:
            assert got[10_000 + i]["restored"] == good, SWAPS[i]
    assert got[20_000]["restored"] == GOOD["fr"] and "�" not in got[20_001]["restored"]


RUSSIAN = [
    "доставили за неделю и коробка была целая", "очень доволен покупкой всё работает как надо", "цвет совсем другой но качество хорошее", "муж говорит что такой вещи у нас ещё не было",
    "ручка сломалась через месяц пришлось чинить самому", "инструкция только на чужом языке ничего не понял", "шнур короткий зато чехол мягкий и удобный", "взяла для дочери она просто счастлива",
    "съездил в магазин обменяли без вопросов", "эта щётка лучше прежней и стоит дешевле", "юбка села по фигуре ткань приятная", "жаль что нет крышки в остальном отлично",
]


def test_an_unlisted_page_is_learnt(spark):
    """Text of a page that isn't listed (cp855), read as cp1252, in one of the sources."""
    table = {chr(b): bytes([b]).decode("cp855") for b in range(128, 256)}
    read = lambda b: bytes([b]).decode("cp1252", "ignore") or chr(b)
    back = {ord(v): read(ord(k)) for k, v in table.items()}
    r = random.Random(5)
    say = lambda: " ".join(r.choice(RUSSIAN) for _ in range(4))
    clean = [(t, "shop") for _, t in corpus(60)] + [(say(), "shop") for _ in range(300)]
    hidden = [say() for _ in range(150)]
    rows = [(i, t, s) for i, (t, s) in enumerate(clean)] + [(10_000 + i, t.translate(back), "odd") for i, t in enumerate(hidden)] + [(20_000 + i, t, "odd") for i, (_, t) in enumerate(corpus(10))]
    got = {x["doc_id"]: x for x in garbled.find_garbled(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", F.col("source")).collect()}
    assert set(got) == {10_000 + i for i in range(len(hidden))}
    right = sum(a == b for i, t in enumerate(hidden) for a, b in zip(t, got[10_000 + i]["restored"]))
    assert right >= 0.97 * sum(map(len, hidden)), right / sum(map(len, hidden))
    assert any("learnt table" in x["swaps"] for x in got.values())


def test_any_number_of_sources_can_have_a_table(spark, monkeypatch):
    """Two sources with an unlisted page each: their tables are the same whether they are broadcast or joined to the documents."""
    own = sorted(set("".join(RUSSIAN)) - {" "})
    back = {s: {ord(c): first + i for i, c in enumerate(own)} for s, first in (("armenian", 0x561), ("georgian", 0x10D0))}
    r = random.Random(6)
    say = lambda: " ".join(r.choice(RUSSIAN) for _ in range(4))
    clean = [(t, "shop") for _, t in corpus(30)] + [(say(), "shop") for _ in range(300)]
    hidden = [(say(), s) for s in back for _ in range(100)]
    rows = [(i, t, s) for i, (t, s) in enumerate(clean)] + [(10_000 + i, t.translate(back[s]), s) for i, (t, s) in enumerate(hidden)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: sorted((x["doc_id"], x["swaps"], x["restored"], x["log_odds"]) for x in garbled.find_garbled(df, "doc_id", "text", F.col("source")).collect())
    few = run()
    monkeypatch.setattr(garbled, "SOURCES", 1)
    many = run()
    assert [x[0] for x in many] == [10_000 + i for i in range(len(hidden))] and all("learnt table" in x[1] for x in many)
    right = sum(a == b for (t, _), x in zip(hidden, many) for a, b in zip(t, x[2]))
    assert right >= 0.97 * sum(len(t) for t, _ in hidden), right / sum(len(t) for t, _ in hidden)
    assert [x[:3] for x in few] == [x[:3] for x in many] and np.allclose([x[3] for x in few], [x[3] for x in many])


def test_letters_that_stand_for_others_give_away_short_words(spark):
    """A short word is garbled if its odd letter stands for another nearly everywhere, though it would be too short by itself."""
    rows = [(i, t, "s") for i, (_, t) in enumerate(corpus(100))] + [(10_000 + i, GOOD["tr"].encode("cp1254").decode("cp1252"), "s") for i in range(30)]
    rows += [(20_000, "Bu aþ", "s"), (20_001, "la taille è", "s"), (20_002, "Bu aş", "s")]
    got = {x["doc_id"]: x["restored"] for x in garbled.find_garbled(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", F.col("source")).collect()}
    assert set(got) == {*range(10_000, 10_030), 20_000} and got[20_000] == "Bu aş"


def test_many_sources_carry_their_weights(spark, monkeypatch):
    rows = [(i, t, f"s{i % 40}") for i, (_, t) in enumerate(corpus(60))] + [(10_000 + i, GOOD["fr"].encode().decode("cp1252"), f"s{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: sorted((x["doc_id"], x["restored"], x["log_odds"]) for x in garbled.find_garbled(df, "doc_id", "text", F.col("source")).collect())
    few = run()
    monkeypatch.setattr(garbled, "SOURCES", 5)
    many = run()
    assert [x[0] for x in few] == [10_000 + i for i in range(8)] and [x[:2] for x in few] == [x[:2] for x in many]
    assert np.allclose([x[2] for x in few], [x[2] for x in many])


def test_garbled_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert garbled.find_garbled(df, "doc_id", "text").count() == 0
    one = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id long, text string")
    assert garbled.find_garbled(one, "doc_id", "text").count() == 0


# queries


@needs_vocabulary
@pytest.mark.parametrize("name", ["p1_found", "p3_sketches", "p3_percentiles", "p3_season", "p3_bounds", "p3_weekend", "p6_ids", "p7_mixture", "p7_shares", "p7_temperature", "p7_temperature_shares", "p7_limits", "p8_found", "p8_restored"])
def test_queries_run(spark, name):
    from driftline.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    got = QUERIES[name](spark, d)
    rows = got.collect()
    if name in SQL:
        import duckdb

        c = duckdb.connect()
        for t in ("fit_planet_cal", "recal_model", "pathologies", "mix_targets"):
            c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        want = c.execute(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_long_texts_are_read_whole():
    rng = random.Random(0)
    clean = [t for _, t in corpus(30)]
    reader = garbled.Reader(garbled.Model(garbled.bigram_counts(clean)))
    words = " ".join(clean[:60]).split()
    long = " ".join(rng.choice(words) for _ in range(30_000)) + " " + GOOD["fr"].encode().decode("cp1252")
    _, used, now = reader.restore(long, "s", 4.0)
    assert used and now.endswith(GOOD["fr"])
    ja = GOOD["ja"] * 500
    assert reader.restore(ja.encode("euc_jp").decode("latin-1"), "s", 4.0)[2] == ja
    assert all(len(t) <= garbled.KEPT for t in reader.known)


def test_many_stretches_are_all_restored():
    clean = [t for _, t in corpus(30)]
    reader = garbled.Reader(garbled.Model(garbled.bigram_counts(clean)))
    reader.base = {i: -2.0 if s == ("cp1252", "cp1251") else -1000.0 for i, s in enumerate(garbled.swaps())}
    ru = [w.strip(",.") for w in GOOD["ru"].split() if len(w.strip(",.")) > 4]
    accents = [w.strip(",.") for k in ("fr", "de", "tr") for w in GOOD[k].split() if not w.isascii() and "’" not in w]
    other = iter([a + b for a in accents for b in accents])
    # correct words with accents, none of them twice, make each damaged word a stretch of its own
    rows = [(w + x, " ".join(next(other) for _ in range(10))) for x in ("", "ми") for w in ru]
    mixed = lambda read: " ".join(f"{w.encode('cp1251').decode(read)} {rest}" for w, rest in rows)
    odds, used, now = reader.restore(mixed("cp1252"), "s", 0.0)
    assert len(rows) > 6 and now == mixed("cp1251") and len(used) < 20
    assert reader.restore(now, "s", 0.0)[1] == []


def test_percentiles_keep_rows_without_a_key(spark, tmp_path):
    from driftline.llm.queries import QUERIES

    rows = [(None, "a", 1, 86400, float(i)) for i in range(3)] + [("t", "a", None, 86400, 10.0), ("t", "a", None, 86400, 11.0), ("t", "a", None, 86400, 11.0)] + [("t", "a", 1, 86400, 20.0)] * 2
    df = spark.createDataFrame([(t, p, k, c, x, x, x) for t, p, k, c, x in rows], "tod_id string, pa string, det_uid int, ctime long, rms double, gain double, correlation double")
    df.write.parquet(f"{tmp_path}/pathologies.parquet")
    for name in ("p3_percentiles", "p3_season"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert {r["metric"]: (r["n_values"], r["p99"]) for r in got} == {m: (6, 20.0) for m in ("rms", "gain", "correlation")}
