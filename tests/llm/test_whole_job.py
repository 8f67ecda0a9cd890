"""Cases that earlier versions left out of the job."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hindcast.llm import pii
from hindcast.llm.catalog import QUERIES

LICENCE = "Released under the terms of a licence that many documents share."


def test_documents_of_short_lines_stay(spark):
    """The line stage drops no document that still says something."""
    rows = [(1, f"A first text.\n{LICENCE}"), (2, f"roses are red\nviolets blue\n{LICENCE}"), (3, LICENCE), (4, f" \n\n{LICENCE}"), (5, "short"), (6, "")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    texts = {1: rows[0][1], 2: "roses are red\nviolets blue", 5: "short", 6: ""}
    assert out == {k: (t, len(t)) for k, t in texts.items()}


def test_short_lines_take_part(spark, tmp_path):
    """Equal lines go whatever their length, near ones from 20 characters on; blank ones stay."""
    texts = ["Menu\n\nRead more\nA line of some thirty letters", "Menu\n\nMenus\nA line of some thirty betters\n \n ", "Read more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_lines, r.n_same, r.n_near, r.kept_chars) for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == {0: (4, 0, 0, len(texts[0])), 1: (6, 1, 1, len("\nMenus\n \n ")), 2: (1, 1, 0, 0)}


def test_terms_of_entities_of_one_text(spark):
    """Terms tell an entity of one text, from any line and any distance; copies of a text count once."""
    far = "Name: Zebra\n" + "common words here " * 20 + "mail ann@mail.example.com"
    rows = [(1, far), (1, far), (2, far), (3, "mail bob@mail.example.com")] + [(10 + i, f"common words here and mail {'xyz' * i}") for i in range(1, 40)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = sorted((r.doc_id, [(far[t.start:t.end], t.share) for t in r.terms]) for r in out if r.terms)
    assert told == [(k, [("Name", 1.0), ("Zebra", 1.0)]) for k in (1, 1, 2)]


@pytest.mark.parametrize("bits", [27, 7])
def test_disclosure_shares(spark, monkeypatch, bits):
    """Every share against counts over distinct texts, with a filter that lets nothing or nearly everything else pass."""
    monkeypatch.setattr(pii, "FILTER_BITS", bits)
    monkeypatch.setattr(pii, "TASK_TERMS", 20)
    rng = random.Random(6)
    people = [f"user{i}@mail.example.com" for i in range(12)]
    words = ["the", "and", "für", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(500))]
    texts = []
    for i in range(160):
        body = [rng.choice(words[:3]) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            body.insert(rng.randint(0, len(body)), rng.choice(people).title() if rng.random() < 0.3 else rng.choice(people))
        texts.append(" ".join(body))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])] + [(2000, None), (2001, ""), (3, texts[3])]
    distinct = {t for _, t in rows if t}
    found = {t: pii.base_spans(t) for t in distinct}
    terms = {t: {m.group().lower() for m in pii.TERM.finditer(t)} for t in distinct}
    near = {t: {x[0] for x in pii.terms_outside(t, found[t])} for t in distinct}
    who = {t: {pii.entity(k, t[s:e]) for s, k, e in found[t]} for t in distinct}
    total = sum(bool(v) for v in terms.values())

    def share(t, term):
        out = 0.0
        for x in who[t]:
            both = sum(x in who[u] and term in near[u] for u in distinct)
            n_x, n_t = sum(x in who[u] for u in distinct), sum(term in terms[u] for u in distinct)
            out = max(out, math.log2(both * total / (n_t * n_x)) / max(math.log2(total / n_x), 1e-9))
        return out

    limits = pii.Limits()
    want = {(i, t): [(s, e, round(share(t, term), 9)) for term, s, e in pii.terms_outside(t, found[t]) if who[t] and share(t, term) >= limits.generalise]
            for i, t in rows if t}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = pii.find(df)
    assert out.count() == len(rows)
    by_hash = {r.h: r.text for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    got = {(r.doc_id, by_hash[r.text_hash]): [(x.start, x.end, round(x.share, 9)) for x in r.terms] for r in out.collect() if by_hash[r.text_hash]}
    assert got == want and sum(map(len, want.values())) > 50
