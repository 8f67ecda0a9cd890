"""Quality classifier, ranked search and run detection: brute force, held-out rows, and the odd tables."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.llm import discriminant, ranked, runs
from hindcast.llm.catalog import QUERIES
from hindcast.llm.common import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- runs ---------------------------------------------------------------------------------------------------------

def plain_runs(words, shortest=6, times=4):
    """(start, end, period) by start and period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if (size := i - s + q) >= max(shortest, times * q) and i > s:
                own = words[s:s + size]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((s, s + size, q))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(rng, n):
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 8))]
        out += unit * rng.randint(1, 9) + unit[:rng.randint(0, len(unit))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_word_ids(seed):
    rng = random.Random(seed)
    docs = [repeating(rng, rng.randint(0, 140)) for _ in range(rng.randint(1, 6))]
    docs += docs[:rng.randint(0, 2)]
    ids = np.array([ord(w) - 97 for d in docs for w in d], dtype=np.int64)
    sizes = [len(d) for d in docs]
    got = sorted(zip(*(c.tolist() for c in runs.runs_of(ids, np.repeat(np.arange(len(docs)), sizes), 3)), strict=True))
    begin = np.cumsum(sizes) - sizes
    assert got == sorted((b + int(o), e + int(o), q) for d, o in zip(docs, begin) for b, e, q in plain_runs(d))


def test_few_periods_at_a_time(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 3)
    test_runs_of_word_ids(99)


def test_long_periods():
    rng = random.Random(1)
    unit = [rng.randrange(500) for _ in range(3000)]
    ids = np.array([*range(500, 600), *(unit * 5)[:13_500], *range(600, 700), *[7] * 40_000], dtype=np.int64)
    got = list(zip(*(c.tolist() for c in runs.runs_of(ids, np.zeros(len(ids), dtype=np.int64), 700)), strict=True))
    assert got == [(100, 13_600, 3000), (13_700, 53_700, 1)]


def test_runs_need_four_periods(spark):
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame([("a",)], "text string"), times=3)


def test_runs_in_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "a b\na\tb a  b a b", "x"), (4, "a b\na\tb a  b a b", "x"), (None, "w " * 7, "x"),
            (5, "é é é é é é é é é é é é", "x"), (6, "z " * 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df).collect()), key=lambda r: r[0])
    assert got == [(0, 7, [(0, 7, 1)], "w"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"),
                   (5, 6, [(0, 6, 1)], "é é"), (6, 5, [], "z z z z z")]
    assert runs.find_runs(df.limit(0)).count() == 0


def test_run_query(spark, tmp_path):
    """The contract, written out."""
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, "one two three four five six seven " * 9 if i % 3 else None) for i in range(40)] + [(None, "a a a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    hexed = lambda s: sha256(s.encode()).hexdigest()
    want, changed = {}, 0
    for k, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(k).encode())
        if k is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, changed = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)], changed + 1
        found = plain_runs(w)
        top = max(((e - s, -s, -q) for s, e, q in found), default=None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < e for s, e, q in found)]
        want[k] = (len(found), *((-top[1], top[0], -top[2], 1000 * top[0] // -top[2]) if top else (None,) * 4),
                   hexed("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), hexed(" ".join(kept)))
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == want and changed > 10 and sum(w[0] > 0 for w in want.values()) > 10


# ---- ranked search ------------------------------------------------------------------------------------------------

def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(c.total() for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = set()
    rows = []
    for q, terms in asked.items():
        df = {t: sum(t in c for _, c in counted) for t in terms}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, c in counted:
            m = 50 + (50 * c.total() * n) // total
            s = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        rows += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(rows, key=repr), out


def search_tables(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", *(f"w{i}" for i in range(120)), "çà", "日本", "É"]
    pick = lambda: rng.choice(vocabulary[:3]) if rng.random() < 0.4 else rng.choice(vocabulary)
    docs = [(i, " ".join(pick() for _ in range(rng.choice([0, 3, 20, 60, 400])))) for i in range(n)]
    docs += [(i + 7, t) for i, t in docs[:20]] + docs[20:25] + [(900, None), (901, ""), (902, "...!?"), (None, "w1 the THE w2")] + [(903 + i, "the " * 90) for i in range(9)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 12))).title()) for i in range(25)] + [(100, None), (101, ""), (102, "- -"), (103, "absent"), (3, "w5,w6")]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_search(spark, seed, monkeypatch):
    docs, items = search_tables(seed)
    if seed == 1:  # many blocks of queries, small bitmaps, shuffled joins
        monkeypatch.setattr(ranked, "QUERY_BYTES", 200)
        monkeypatch.setattr(ranked, "SENT_BYTES", 0)
        monkeypatch.setattr(ranked, "BLOCK_DOCS", 5)
    if seed == 2:  # bitmaps so full that the bounds exclude little
        monkeypatch.setattr(ranked, "BITS_PER_KEY", 1)
        monkeypatch.setattr(ranked, "ROWS_PER_KEY", 1)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, rank string, score int").repartition(5)
    q = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, doc_id string, key string")
    got = sorted((tuple(r) for r in ranked.search(d, q, k=10).collect()), key=repr)
    want, _ = plain_search(docs, items, 10)
    assert got == want and len(got) > 150


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.filter("false"), q.filter("false"))):
        out = ranked.search(x, y)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_bounds_hold_and_exclude(spark):
    """No bound is below the exact score, and the bitmaps name few documents that lack a term."""
    docs, items = search_tables(5, 300)
    docs = [(i, d) for i, (_, d) in enumerate(docs)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    terms = sorted({t for _, x in items for t in ranked.terms_of(x or "")})
    index = ranked.build_index(d, "doc_id", "text", terms).collect()
    key = {r.k: r.doc_id for r in d.select("doc_id", ranked._key("doc_id", "text").alias("k")).collect()}
    text = dict(docs)
    blocks = [r for r in index if r.n_rows]
    corpus = ranked.Corpus(sum(len(r["keys"]) for r in blocks), sum(sum(r.sizes) for r in blocks))
    one = ranked.Queries(list(range(len(terms))), [np.array([i]) for i in range(len(terms))], terms, np.full(len(terms), 1, dtype=np.int64))
    hashes = np.array([ranked.hash_of(t) for t in terms], dtype=np.uint64)
    extra = held = 0
    for r in blocks:
        sizes = np.array(r.sizes, dtype=np.int64)
        for q, bound in one.bounds(np.array(r["keys"]), sizes, r.n_rows, bytes(r.bits), corpus, hashes):
            for k, n, b in zip(r["keys"], sizes, bound.tolist(), strict=True):
                times = ranked.terms_of(text[key[k]]).count(terms[q])
                exact = int(ranked.share(times, corpus.length(n))) if times else 0
                assert b >= exact
                extra += b > 0 and not times
                held += times > 0
    assert extra <= 0.01 * held


# ---- quality classifier -------------------------------------------------------------------------------------------

def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op11_quality_classifier"](spark, sf)
    assert [f.simpleString() for f in out.schema.fields][:4] == ["doc_id:bigint", "held_out:boolean", "score:double", "predicted:int"]
    rows = out.join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.quality is not None]
    assert len(test) > 50 and sum(r.predicted == r.quality for r in test) / len(test) > 0.95
    good, bad = ([r.score for r in test if r.quality == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_held_out_labels_teach_nothing(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(discriminant.fold_of("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in discriminant.quality_scores(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_fit_as_written_down(spark):
    """Means, shrunk covariances and the log-densities against NumPy; weights against folds scored row by row."""
    rng = np.random.default_rng(3)
    width = len(discriminant.STATISTICS)
    y = (rng.random(400) < 0.6).astype(int)
    mix = rng.normal(size=(2, width, width)) / 3
    x = np.array([rng.normal(size=width) @ mix[k] + 1.5 * k for k in y])
    fold = rng.integers(1, 5, 400)
    rows = [(int(a), int(b), c.tolist()) for a, b, c in zip(y, fold, x)]
    rows += [(None, 1, [9.0] * width), (7, 1, [9.0] * width), (1, None, [9.0] * width)]
    df = spark.createDataFrame(rows, "label int, fold int, statistics array<double>").repartition(7)
    model = discriminant.fit(df)

    def gaussians(mask, w):
        cov = [np.cov(x[mask & (y == k)].T, bias=True) for k in (0, 1)]
        n = [(mask & (y == k)).sum() for k in (0, 1)]
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        floor = 1e-3 * np.trace(pooled) / width * np.eye(width)
        mixed = [(1 - w[0]) * c + w[0] * pooled for c in cov]
        return [(x[mask & (y == k)].mean(axis=0), (1 - w[1]) * mixed[k] + w[1] * np.diag(np.diag(pooled)) + floor) for k in (0, 1)]

    def density(row, mean, cov):
        return -0.5 * (row - mean) @ np.linalg.solve(cov, row - mean) - 0.5 * np.linalg.slogdet(cov)[1]

    everything = np.ones(400, dtype=bool)
    gained = {w: sum(density(x[i], *g[y[i]]) for f in range(1, 5) for g in [gaussians(fold != f, w)] for i in np.flatnonzero(fold == f))
              for w in discriminant.WEIGHTS}
    assert model.weights == max(gained, key=gained.get)
    both = gaussians(everything, model.weights)
    want = np.arcsinh([density(r, *both[1]) - density(r, *both[0]) for r in x])
    assert np.allclose(model.difference(x), want, rtol=1e-6, atol=1e-6)
    assert model.slope > 0 and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_quality_of_odd_tables(spark):
    texts = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "no key"), (4, "a " * 50_000), (5, "\n\n"), (6, "ÀÉ 日本 \U0001f600")]
    docs = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, score string, statistics string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (3, 0), (4, 1), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")
    for own, least in ((labels, 0.0), (labels.filter("quality = 1"), 0.9), (labels.limit(0), 0.5)):
        out = discriminant.quality_scores(docs, own).collect()
        assert len(out) == len(texts) and all(least <= r.score <= 1 for r in out)
        assert not any(r.held_out for r in out if r.doc_id is None)
    assert {r.score for r in discriminant.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert discriminant.quality_scores(docs.limit(0), labels).count() == 0
    assert np.isfinite(discriminant.statistics(["", "a", "! ! !", "| | |", "\x00", "a" * 10_000])).all()
