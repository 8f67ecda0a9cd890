import math

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hindcast.llm import langid
from hindcast.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_text_model(table(spark, SF, "documents").filter("doc_id % 2 = 0"))


def test_held_out_text(spark, model):
    """Accuracy on documents that the model was not fitted on."""
    languages, logs = model
    rows = table(spark, SF, "documents").filter("doc_id % 2 = 1 AND n_chars > 100").select("text", "lang").collect()
    right = sum(languages[int(logs[:, langid.trigrams(r.text)].sum(axis=1).argmax())] == r.lang for r in rows)
    assert right / len(rows) > 0.95


def test_pages_by_declared_language(spark, model):
    out = langid.identify(table(spark, SF, "pages"), *model).collect()
    assert sum(r.lang == r.declared for r in out) / len(out) > 0.97


def test_fusion_as_written_down(spark, model):
    languages, logs = model
    text = {c: " ".join(r.text for r in table(spark, SF, "documents").filter(F.col("lang") == c).limit(2).collect())[:300] for c in languages}
    page = lambda lang, body: f'<html lang="{lang}"><body><script>x</script><p>{body}</p></body></html>'
    rows = [(i, f"http://h{i % 3}.d{i % 2}.com/{languages[i % 4]}/x", page(languages[i % 4], text[languages[(i + i // 9) % 4]])) for i in range(24)]
    rows += [(30, None, None), (31, "", ""), (32, "http://[bad", "<html lang=xx>"), (33, "http://h0.d0.com/", "<p>1 2 3"), (33, "http://h0.d0.com/", "<p>1 2 3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = sorted(langid.identify(df, languages, logs).collect(), key=lambda r: r.page_id)
    k = len(languages)
    ev = []
    for i, url, html in sorted(rows, key=lambda r: r[0]):
        s = langid.TEMPER * logs[:, langid.trigrams(langid.visible(html))].sum(axis=1) if html else np.zeros(k)
        p = np.exp(s - s.max())
        ev.append((i, s - s.max(), p / p.sum(), langid.declared(html or ""), *langid.address(url or "")))
    whole = sum(e[2] for e in ev) + 1
    prior = whole / whole.sum()

    def group(at):
        out = {}
        for e in ev:
            if e[at] is not None:
                out[e[at]] = out.get(e[at], 0) + e[2]
        return out

    said, suffix, host, domain = group(3), group(6), group(4), group(5)
    zero = np.zeros(k)
    for r, e in zip(got, ev):
        score = e[1].copy()
        for at, masses in ((3, said), (6, suffix)):
            if e[at] is not None:
                score += np.log((masses[e[at]] + 1) / (sum(masses.values()) + len(masses) + 1))
        by_domain = np.maximum(0, domain[e[5]] - e[2]) if e[5] else zero
        by_domain = (by_domain + 5 * prior) / (by_domain.sum() + 5)
        by_host = np.maximum(0, host[e[4]] - e[2]) if e[4] else zero
        score += np.log((by_host + 5 * by_domain) / (by_host.sum() + 5))
        assert r.page_id == e[0] and r.lang == languages[int(score.argmax())]
        assert math.isclose(r.probability, np.exp(score.max()) / np.exp(score).sum(), rel_tol=1e-6)
    assert langid.identify(df.limit(0), languages, logs).count() == 0


def test_fit_by_counting(spark, monkeypatch):
    """The documents of the smallest hashes of each language and their trigrams, whatever the lanes; odd and no rows."""
    some = table(spark, SF, "documents").select("doc_id", "text", "lang").limit(300)
    odd = spark.createDataFrame([(1, None, "en"), (2, "words", None), (3, "", "xx"), (None, "nothing", "en"), (7, "again", "xx"), (7, "again", "xx")],
                                "doc_id long, text string, lang string")
    rows = some.unionByName(odd).withColumn("h", F.xxhash64("doc_id")).withColumns({"rank": F.lit(9), "__extra": F.lit("x")}).cache()
    taught = {}
    for r in sorted((r for r in rows.collect() if r.text is not None and r.lang is not None), key=lambda r: (r.h, r.doc_id is not None, r.doc_id)):
        taught.setdefault(r.lang, []).append(r)
    for lanes in (1, 5):
        monkeypatch.setattr(langid, "LANES", lanes)
        languages, logs = langid.fit_text_model(rows, per_language=20)
        assert languages == sorted(taught)
        for lang, got in zip(languages, logs):
            counts = np.full(langid.BUCKETS, 0.5)
            for r in taught[lang][:20]:
                if r.doc_id is not None:
                    np.add.at(counts, langid.trigrams(r.text).astype(np.int64), 1)
            assert np.allclose(got, np.log(counts / counts.sum()))
    languages, logs = langid.fit_text_model(rows.limit(0))
    assert languages == []
    pages = spark.createDataFrame([(1, "http://a.b.de/x", "<html lang=de><p>Haus"), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, languages, logs).collect()}
    assert (got[1].lang, got[1].probability, got[1].text_lang, got[1].declared, got[1].suffix, got[1].host) == (None, None, None, "de", ".de", "a.b.de")
    assert got[2].lang is None and got[2].declared is None


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert docs.filter("n_chars <> length(text)").count() == 0
        if k == 1:
            want = brute.dedup_lines(list(before.items()), 2, 20, shorter=True)
            assert after == {i: w[0] for i, w in want.items() if not w[2] + w[3] or any(x.strip(" \t\x0b\f\r") for x in w[0].split("\n"))}
    assert docs.filter("NOT restored OR n_tokens <> size(ids)").count() == 0


def test_pipeline_runs_as_a_whole(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[-3:] == ["n_tokens", "ids", "restored"] and out.filter("NOT restored").count() == 0
