"""Hard negatives, toxicity and fill-in-the-middle against brute force, round trips and held-out rows."""

import hashlib
import itertools
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notewright.llm import fill_in_middle as fim
from notewright.llm import hard_negatives as hn
from notewright.llm import toxicity
from notewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (None, "a null id with a text of some words", "en", "s1", 1),
    (1, None, "en", "s1", None),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", None, 4),
    (4, "same text here for five words and more", "en", "s1", 9),
    (4, "same text here for five words and more", "en", "s1", 9),
    (6, "x é𝄞 " * 60000, "en", "s2", 120000),
    (7, "a <P> inside", "en", "s3", 3),
]


def odd(spark):
    clash = [(*row, "x", 7, "y") for row in ODD]
    return spark.createDataFrame(clash, DOCS + ", output string, form int, score string")


# Fill in the middle.

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(key, text, seed=42, percent=50, spm=80):
    tokens = TOKEN.findall(text)
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = st.text(st.sampled_from(list("ab é  𝄞\n\t\x0b<PSM>")), max_size=60)


@given(st.integers(0, 10**6), TEXTS, st.sampled_from([(100, 80), (100, 0), (50, 80)]))
@settings(max_examples=400, deadline=None)
def test_forms_equal_tokens_put_together(key, text, shares):
    got = fim.cut(text.encode(), str(key), 42, *shares)
    assert (*got[:4], got.output.decode()) == brute_fim(key, text, 42, *shares)
    assert fim.restore(got.output, got.form).decode() == text


@given(st.binary(max_size=40), st.data())
def test_rotations_exchange_and_invert(data, d):
    start, cut, end = sorted(d.draw(st.integers(0, len(data))) for _ in range(3))
    turned = bytearray(data)
    fim.rotate(turned, start, cut, end)
    assert turned == data[:start] + data[cut:end] + data[start:cut] + data[end:]
    fim.rotate(turned, start, start + end - cut, end)
    assert turned == data


def test_swaps_in_small_steps(monkeypatch):
    monkeypatch.setattr(fim, "SWAP_BYTES", 3)
    for n, cut in itertools.product(range(12), range(12)):
        data = bytes(range(n))
        turned = bytearray(data)
        fim.rotate(turned, 0, min(cut, n), n)
        assert turned == data[cut:] + data[:cut]


def test_a_long_text_takes_few_copies():
    text = b"word " * 2_000_000
    tracemalloc.start()
    out = fim.arrange(text, 10, 5_000_000, "spm")
    assert fim.restore(out, "spm") == text
    assert tracemalloc.get_traced_memory()[1] < 5 * len(text)
    tracemalloc.stop()


def test_odd_rows_are_cut_and_restored(spark):
    docs = odd(spark)
    got = fim.restored(fim.fill_in_middle(docs))
    want = sorted(((i, *brute_fim("" if i is None else i, t or ""), t or "") for i, t, *_ in ODD), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert fim.restored(fim.fill_in_middle(docs.limit(0))).count() == 0
    clash = fim.fill_in_middle(docs).withColumn("Restored", F.lit(1))
    assert fim.restored(clash).columns[-2:] == ["Restored", "restored_"]


def test_other_sentinels_and_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marks = fim.Sentinels(b"<|prefix|>", b"<|suffix|>", b"<|middle|>")
    out = fim.fill_in_middle(docs, percent=100, marks=marks)
    back = fim.restored(out, marks).join(docs.select("doc_id", "text"), "doc_id")
    assert back.where("restored <> text").count() == 0 and back.where("form <> 'plain'").count() > 0
    again = fim.fill_in_middle(docs.repartition(7), percent=100, marks=marks)
    assert out.exceptAll(again).count() == 0


# Hard negatives.

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(rows, every, k_pos=5, k_neg=5, low=80, high=100, scale=256):
    ok = [(i, [int(np.floor(float(scale) * float(np.float32(e)))) for e in v], y) for i, v, y in rows if i is not None and y is not None and v and all(e is not None and np.isfinite(e) for e in v)]
    out = []
    anchors = {}
    for i, v, y in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (y, len(v), v)), (y, len(v), v))
    for i, (y, _, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in ok if j != i and len(w) == len(v))
        for s, j in dict.fromkeys([(s, j) for s, j, z in scored if z == y][:k_pos]):
            inside = [(t, m) for t, m, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(inside[:k_neg], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, hn.hard_negatives(df, **options).collect()))


def clustered(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels + 2, dim))
    rows = [(int(i), (centres[rng.integers(len(centres))] + rng.normal(0, 0.15, dim)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]
    rows += [(n + k, rows[5][1], rows[5][2]) for k in range(30)]  # equal vectors
    rows += [(2 * n + k, rows[8][1], k % labels) for k in range(20)]
    return rows


@pytest.mark.parametrize("seed, tree, slice_, block", [(1, 512, 2048, 1 << 20), (2, 4, 16, 1 << 9), (3, 1, 7, 1 << 8)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, tree, slice_, block):
    for name, value in (("TREE", tree), ("ROWS_AT_ONCE", slice_), ("LEAST_BYTES", block), ("FEW_BLOCKS", 5), ("ANCHOR_BYTES", 4 * block)):
        monkeypatch.setattr(hn, name, value)
    rows = clustered(150, 6, seed)
    got = mined(spark.createDataFrame(rows, VECTORS), every=5)
    assert got and got == brute_negatives(rows, 5)


def test_odd_vectors(spark):
    rows = clustered(60, 4, 9)
    rows += [(None, [1.0] * 4, 1), (100, None, 1), (101, [], 1), (102, [1.0, None, 1.0, 1.0], 1), (103, [float("nan")] * 4, 1), (104, [float("inf")] * 4, 1), (105, [0.0] * 4, 1), (106, [1.0] * 4, None), (110, [1.0, 2.0], 1), (115, [1.0, 2.5], 1), (111, [1.0, 2.0], 2), rows[10], rows[10], (10, [9.0] * 4, 0), (120, [-3.0] * 4, 2)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], VECTORS + ", id string, x int, windows int")
    assert mined(df, every=5) == brute_negatives(rows, 5)
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id = 10")) == []


def test_windows_and_counts_are_parameters(spark):
    rows = clustered(90, 5, 4)
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df, every=10, positives=2, negatives=9, low=50, high=95, scale=64) == brute_negatives(rows, 10, 2, 9, 50, 95, 64)


def test_trees_are_least_and_bounds_leave_out():
    rng = np.random.default_rng(0)
    x = np.concatenate([c + rng.integers(-4, 5, (12, 8)) for c in rng.integers(-300, 300, (4, 8))]).astype(np.float64)
    parent, edge = hn.spanning_tree(x)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    joined, total = {0}, 0.0
    while len(joined) < len(x):  # Prim, edge by edge
        d, j = min((far[i, j], j) for i in joined for j in set(range(len(x))) - joined)
        joined.add(j)
        total += d
    assert np.isclose(edge.sum(), total) and sum(parent < 0) == 1
    candidates = rng.integers(-300, 300, (200, 8)).astype(np.float64)
    tree, seen = hn.Tree(x, parent, edge), np.zeros((len(x), 200), bool)
    true = x @ candidates.T

    def wanted(a, lo, hi):
        assert (lo <= true[a]).all() and (true[a] <= hi).all()
        return (hi >= 90000) & (lo <= 100000)

    def take(a, rows, scores):
        assert (scores == true[a, rows]).all()
        seen[a, rows] = True

    scored = hn.walk(tree, candidates, wanted, take)
    assert seen[(true >= 90000) & (true <= 100000)].all()
    assert scored < true.size / 3  # most pairs are left out by bounds


def test_scores_beyond_doubles_are_exact():
    a, c = np.full(7, 2.0**24), np.array([[2.0**24] * 6 + [2.0**24 - 1]])
    assert hn.exact_scores(a, c)[0] == 6 * 2**48 + 2**24 * (2**24 - 1)


# Toxicity.


def brute_grams(text):
    text = "".join(c.lower() if c.isascii() else c for c in text).translate(dict.fromkeys(range(9, 14), " "))
    return {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}


@given(st.lists(st.text(st.sampled_from(list("abAB é𝄞\n\t")), max_size=25), max_size=6), st.sampled_from([3, 8, 1 << 18]))
@settings(max_examples=150, deadline=None)
def test_grams_of_each_text(texts, window):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "WINDOW", window)
        names = {}
        own, hashes = toxicity.grams_by_text(*toxicity.characters(pa.array(texts, pa.string())))
        for i, t in enumerate(texts):
            mine = hashes[own == i]
            assert len(mine) == len(set(mine)) == len(brute_grams(t))
            alone = toxicity.grams_by_text(*toxicity.characters(pa.array([t])))[1]
            assert set(alone) == set(mine)
            for g in brute_grams(t):
                h = toxicity.grams_by_text(*toxicity.characters(pa.array([g])))[1]
                names[g] = next(x for x in h if x in set(mine)) if len(g) == 2 else names.get(g)


def test_scales_and_choice_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("text", "toxic").collect()
    counts = {(r["gram"] & (2**64 - 1)): (r["n0"], r["n1"]) for r in toxicity.label_counts(docs.join(labels, "doc_id"), "text", "toxic").collect()}
    want = {}
    for r in rows:
        for h in set(toxicity.grams_by_text(*toxicity.characters(pa.array([r["text"]])))[1].tolist()):
            n = want.setdefault(h, [0, 0])
            n[r["toxic"]] += 1
    assert counts == {h: tuple(n) for h, n in want.items()}
    assert len(counts) == len(set().union(*(brute_grams(r["text"]) for r in rows)))
    one = spark.createDataFrame([(3.0, 8.0)], "n0 double, n1 double").select(toxicity.log_ratio(F.col("n0"), F.col("n1"), F.lit(90.0), F.lit(10.0)), toxicity.strength(F.col("n0"), F.col("n1"), F.lit(90.0), F.lit(10.0))).first()
    log = np.log
    assert np.isclose(one[0], log(9 / 12) - log(4 / 92))
    assert np.isclose(one[1], 3 * log(3 / 90) + 87 * log(87 / 90) + 8 * log(0.8) + 2 * log(0.2) - 11 * log(0.11) - 89 * log(0.89))


def test_features_are_found_in_windows(monkeypatch):
    grams = np.sort(toxicity.grams_by_text(*toxicity.characters(pa.array(["pathetic"])))[1])
    model = toxicity.Model(grams, np.ones(len(grams)), np.ones(len(grams)))
    texts = pa.array(["x" * 5000 + " Pathetic" + " y" * 4000, None, "", "path"])
    whole = model.features(texts)
    monkeypatch.setattr(toxicity, "WINDOW", 37)
    assert (model.features(texts) == whole).all()
    assert whole[0].all() and not whole[1:3].any() and 0 < whole[3].sum() < len(grams)


def test_held_out_scores(spark):
    """Texts that hold a word of abuse, which all held-out rows with one are labelled for, are told apart."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify_toxicity(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"])
    abuse = got["text"].str.lower().str.contains("trash|pathetic|idiot|disgusting|worthless|stupid|loser|clown|scum|moron")
    assert got[abuse]["predicted"].mean() >= 0.9
    assert got[got["toxic"] == 0]["predicted"].mean() <= 0.02
    assert (got["predicted"] == got["toxic"]).mean() >= 0.9


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.classify_toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (None, 1), (2, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.classify_toxicity(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify_toxicity(odd(spark).limit(0), labels).count() == 0
    none = toxicity.classify_toxicity(odd(spark), labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]


@pytest.mark.parametrize("name", ["op11_anchor_tree_negatives", "op12_ngram_toxicity", "op13_fill_in_middle"])
def test_queries_return_their_columns(spark, name):
    want = {
        "op11_anchor_tree_negatives": "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        "op12_ngram_toxicity": "doc_id long, held_out boolean, score double, predicted int",
        "op13_fill_in_middle": "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    }[name]
    got = QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes).replace("bigint", "long") == want
    assert got.count() == (got.count() if name.startswith("op11") else spark.read.parquet(f"{SF}/documents.parquet").count())
