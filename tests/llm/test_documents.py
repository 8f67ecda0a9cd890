"""Document operators on small tables with nulls, ties, repeated rows, long texts and clashing names."""

import random
from hashlib import sha256

import brute
import pytest
from pyspark.sql import functions as F

from hindcast.llm import common, decontam, jaccard, lines, pii, quality, repeats
from hindcast.llm.catalog import QUERIES

DOCS = "doc_id long, text string, id string, n_words string, kept string, spans string, gone string"
EXTRA = ("a", "b", "c", "d", "e")


def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture
def joined(monkeypatch):
    """Keys are joined by a shuffle, never sent to the tasks."""
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)


def line_rows(n):
    rng = random.Random(5)

    def variant(line):
        out = list(line)
        for _ in range(rng.randint(0, 3)):
            k, i = rng.randint(0, 2), rng.randint(0, len(out) - 1)
            if k == 0:
                out.insert(i, rng.choice("abcé"))
            elif k == 1:
                out.pop(i)
            else:
                out[i] = rng.choice("abcé")
        return "".join(out)

    bases = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(8, 30))) for _ in range(20)]
    return [(i, "\n".join(variant(rng.choice(bases)) for _ in range(rng.randint(0, 6)))) for i in range(n)] + [(500, None), (501, ""), (502, "\n\n")]


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    rows = line_rows(80)
    got = {r.doc_id: (r.text, r.n_lines, r.n_same, r.n_near) for r in lines.dedup_lines(docs(spark, rows), edits=edits, min_chars=10).collect()}
    assert got == brute.dedup_lines(rows, edits, 10)


def test_lines_as_registered(spark, tmp_path):
    """Near lines of 20 characters or more and equal ones of any length, in the query itself."""
    rng = random.Random(8)
    rows = line_rows(120) + [(200 + i, "\n".join(rng.choice(["ab", "ab ", "x" * 19, "x" * 18 + "y", " \t ", "", "z" * 20 + "q", "z" * 20 + "r", "é" * 20, "é" * 21])
                                                  for _ in range(5))) for i in range(30)]
    spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_same, r.n_near, r.kept_sha256) for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    want = brute.dedup_lines(rows, 2, 20, shorter=True)
    assert got == {k: (*w[1:], sha256((w[0] or "").encode()).hexdigest()) for k, w in want.items()}
    assert sum(w[3] for w in want.values()) > 20 and sum(w[2] for w in want.values()) > 50


def test_lines_joined(spark, joined):
    rows = line_rows(30)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, rows), min_chars=10).collect()}
    assert got == {k: w[0] for k, w in brute.dedup_lines(rows, 2, 10).items()}


@pytest.mark.parametrize("hot", [2, 10**9])
@pytest.mark.parametrize("edits", [1, 2])
def test_lines_of_frequent_segments(spark, edits, hot):
    """Every pair, however often the rests of the lines are divided: lines with a start, an end, or both in common."""
    rng = random.Random(12 + edits)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    made = [word(4).join(ends) for ends in [("2024-01-01 server says ", ""), ("", " and so it ended, they say"), ("the same start ", " the same end")] for _ in range(40)]
    made += [x[:k] + rng.choice(["", "z", x[k:k + 1] + "q"]) + x[k + 1:] for x in made for k in [rng.randrange(len(x))]]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(made)], "id long, text string")
    first = {x: i for i, x in reversed(list(enumerate(made)))}
    got = {(r.later.first["id"], r.earlier.first["id"]) for r in lines.near_lines(frame, edits, 10, hot).collect()}
    want = {(first[x], first[y]) for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= edits and brute.edits(x, y) <= edits}
    assert got == want and len(want) > 100


def test_lines_long_and_repeated(spark):
    rows = [(503, "x" * 30_000), (504, "x" * 30_001 + "\n" + "x" * 30_000)]
    long = {r.doc_id: (r.n_same, r.n_near) for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert long == {503: (0, 0), 504: (1, 1)}
    line = "one line that is long enough to take part"
    twice = lines.dedup_lines(docs(spark, [(1, line), (1, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.n_same) for r in twice) == [(0, 0), (1, 1), (1, 1)]
    empty = lines.dedup_lines(docs(spark, []))
    assert empty.count() == 0 and empty.columns[:7] == docs(spark, []).columns


def test_edit_automaton(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choice("abé🎉") for _ in range(rng.randint(0, 12)))
        b = "".join(c for c in a if rng.random() > 0.15) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (0, 1, 2, 3):
        got = [r[0] for r in df.select(lines.within_edits(F.col("a"), F.col("b"), most)).collect()]
        assert got == [brute.edits(a, b) <= most for a, b in pairs]


@pytest.mark.parametrize(("group", "keys"), [(20_000, 1_000_000), (5, 0)])
def test_repeats(spark, monkeypatch, group, keys):
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefg hij\né") for _ in range(900))
    rows = [(i, base[rng.randint(0, 300):rng.randint(400, 900)] + "x" * rng.randint(0, 450) + base[rng.randint(0, 500):][:rng.randint(0, 400)]) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "ab" * 700), (203, "z" * 199), (204, "z" * 200), (None, base), (205, base[:250]), (206, prose(rng, 300))]
    want = brute.repeats([t for _, t in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs(spark, rows), group=group).collect()}
    assert got == {k: w for (k, _), w in zip(rows, want)}
    twice = repeats.remove_repeats(docs(spark, [(1, base), (1, base), (2, prose(rng, 80))])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, len(base.encode())), (1, len(base.encode())), (2, 0)]
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_anchors_over_blocks(monkeypatch):
    import numpy as np
    data = np.random.default_rng(1).integers(97, 101, 9000).astype(np.uint8)
    whole = repeats.anchors(data, 200)
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    parts = repeats.anchors(data, 200)
    assert all((x == y).all() for x, y in zip(whole, parts)) and np.diff(whole[0]).max() <= 200 - repeats.GRAM + 1


def brute_components(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        words = [w.decode() for w in (t or "").encode().translate(jaccard.LOWER).split()]
        sets.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    top = {k: k for k, _ in rows}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                top[y] = x
    return {k: (len(s), root(k)) for (k, _), s in zip(rows, sets)}


@pytest.mark.parametrize(("group", "keys"), [(64, 1_000_000), (2, 0)])
def test_components(spark, monkeypatch, group, keys):
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(jaccard, "GROUP", group)
    rng = random.Random(8)
    rows, k = [], 0
    for _ in range(12):
        words = prose(rng, rng.randint(3, 120)).split()
        for _ in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((k, " ".join(own)))
            k += rng.randint(1, 3)
    rng.shuffle(rows)
    shared = prose(rng, 60)
    rows += [(900 + i, f"{shared} {prose(rng, 9)}") for i in range(12)]
    rows += [(950, None), (951, ""), (952, " \n"), (953, "one two"), (954, "ONE  two"), (955, "word " * 5_000)]
    want = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs(spark, rows)).collect()}
    assert got == want
    if keys == 0:
        return
    kept = {r.doc_id for r in jaccard.keep_one(docs(spark, [*rows, (None, "one two")])).collect()}
    assert kept == {c for _, c in want.values()} | {None}
    tied = jaccard.similar_components(docs(spark, [(5, "one two"), (5, shared), (7, shared), (3, "one two")])).collect()
    assert {(r.doc_id, r.component_id) for r in tied} == {(5, 3), (7, 3), (3, 3)}
    assert jaccard.similar_components(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("rounds", "keys"), [(0, 1_000_000), (0, 0), (6, 1_000_000)])
def test_components_of_several_texts_under_a_key(spark, monkeypatch, rounds, keys):
    """A key links through each of its texts, also where another of them is a copy of another key's, and where only the
    matrix finds the link."""
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = lambda t: " ".join(t.split()[:-3])
    rows = [(5, a), (5, b), (3, b), (9, near(a)),  # 9 by the text that 5 alone has
            (20, b + " x"), (30, c), (31, d), (40, c), (40, d), (40, near(d)), (41, near(c)), (42, d), (50, prose(rng, 60)), (50, None)]
    got = jaccard.similar_components(docs(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(k, root) for k, (_, root) in want.items()}
    assert want[9][1] == 3 and want[42][1] == 30 and want[41][1] == 30 and want[50][1] == 50


def brute_windows(rows, items, size=10):
    words = lambda t: (t or "").encode().translate(decontam.FOLD).split()
    out = {}
    for k, t in rows:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(size, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[k] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [2_000_000, 3])
def test_contamination(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "MAX_TERMS", limit)
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([0, 3, 10, 12, 25]), "abc")) for i in range(8)] + [(98, None), (99, "Alpha, BETA!"), (100, "alpha beta")]
    rows = [(i, " ".join(rng.choice([prose(rng, 4, "abc"), items[rng.randrange(8)][1], "alpha Beta", "née"]) for _ in range(6))) for i in range(30)]
    rows += [(40, None), (41, ""), (None, items[2][1]), (42, "x " * 30_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.contamination(docs(spark, rows), bench, ["doc_id"]).collect()}
    want = brute_windows(rows, items)
    assert got == want
    clean = {r.doc_id for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert clean == {k for k, (_, n, _) in want.items() if not n}
    assert decontam.contamination(docs(spark, rows), bench.limit(0), ["doc_id"]).filter("contaminated").count() == 0
    assert decontam.contamination(docs(spark, []), bench, ["doc_id"]).count() == 0


def test_proximity(spark):
    rows = docs(spark, [(1, "red x x green x blue"), (2, "blue green red"), (3, "red " + "x " * 20 + "green blue"), (4, "red green")])
    wins = decontam.windows(spark.createDataFrame([(7, "red green blue")], "item_id long, text string"))
    index = decontam.build_index(rows, ["doc_id"])
    hit = decontam.proximity_matches(index, wins, 5).join(index, "row")
    assert {r.doc_id for r in hit.collect()} == {1, 2}


def test_quality(spark):
    good = "This is a line of plain prose that ends well, as it should.\n" * 1 + "Another line follows it here, also plain."
    bar = "Home | News | Sport | Contact | About"
    rows = [(1, good), (2, None), (3, ""), (4, " \n\t "), (5, "spam " * 60), (6, bar + "\n" + good), (7, "\n".join([bar] * 9) + "\n" + good),
            (8, "All rights reserved.\n" + good), (9, " ".join(f"w{i}" for i in range(40))), (10, "a\nb\na\n\n\n" + good), (11, "x" * 100_000), (1, good)]
    got = {r.doc_id: r for r in quality.measure(docs(spark, rows)).collect()}
    assert [k for k, r in got.items() if r.kept] == [1, 6, 8, 10]
    assert got[6].n_navigation == 1 and got[6].cleaned == good and got[8].n_boilerplate == 1 and got[9].n_punctuation == 1
    assert got[10].n_dup_lines == 1 and got[5].n_repeat_words == 60 and got[2].n_words == 0 and got[2].base_failed
    kept = quality.clean(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and kept.count() == 5 and {r.text for r in kept.collect() if r.doc_id != 10} == {good}
    assert {r["kept"] for r in kept.collect()} == {"c"} and quality.clean(docs(spark, [])).count() == 0


def brute_base(text):
    """The contract's patterns, word for word."""
    import re
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                                 r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and pii.luhn(digits),
                  9 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_base_patterns():
    rng = random.Random(4)
    parts = ["@", "a.b", "x@y.z", "1", "23", "255", "256", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "\n", "999", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("9" * 20_000 + "a" * 50_000 + "@") == []


def test_disclosing_terms(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 8, 'klmnop')} Zebra {prose(rng, 4, 'klmnop')} ann@mail.example.com {prose(rng, 5, 'klmnop')}") for i in range(6)]
    rows += [(20 + i, f"{prose(rng, 30, 'klmnop')} common zz.\n{prose(rng, 9, 'klmnop')}") for i in range(60)]
    rows += [(90, None), (91, ""), (92, "common bob@mail.example.com"), (93, "Zebra alone"), (None, "Zebra here ann@mail.example.com")]
    out = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    words = {k: [dict(rows)[k][t.start:t.end] for t in r.terms] for k, r in out.items() if r.terms}
    assert all("Zebra" in words[i] for i in [*range(6), None]) and not {20, 40, 90, 91, 92, 93} & set(words)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows)).collect()}
    assert "ann@" not in clean[0] and "Zebra" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[93] == "Zebra alone" and clean[90] is None and clean[92] == "common [EMAIL]"
    assert pii.find(docs(spark, [])).count() == 0 and pii.sanitise(docs(spark, [])).count() == 0
