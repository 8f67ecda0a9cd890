import json
import pathlib
import re
from datetime import datetime

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schema as S
from hindcast.operators import quality as Q
from hindcast.operators import vectors as VX
from hindcast.sources import pages as X
from hindcast.sources import store
from hindcast.sources.buckets import BucketedTable
from hindcast.streaming import odds as stream

T0, T1, T2, T3 = (datetime(2024, 1, 1, h) for h in (1, 2, 3, 4))


def test_upsert_keeps_created_at(spark):
    cols = "race_id string, race_name string, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("a", "x", T0, T0), ("b", "y", T0, T0)], cols)
    new = spark.createDataFrame([("a", "z", T1, T1), ("c", None, T1, T1)], cols)
    assert rows(store.upsert(old, new, "race_id")) == [("a", "z", T0, T1), ("b", "y", T0, T0), ("c", None, T1, T1)]
    again = store.upsert(store.upsert(old, new, "race_id"), new, "race_id")
    assert rows(again) == rows(store.upsert(old, new, "race_id"))


def test_replace_children(spark):
    old = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "race_id string, combination string")
    new = spark.createDataFrame([("a", "9")], old.schema)
    assert rows(store.replace_children(old, new)) == [("a", "9"), ("b", "1")]
    assert rows(store.replace_children(old, new.limit(0))) == rows(old)


def odds_rows(spark, data):
    return spark.createDataFrame(data, "race_id string, horse_number string, win_odds string, scraped_at timestamp, created_at timestamp")


def test_latest_odds(spark):
    target = spark.createDataFrame([], S.PRE_RACE_ODDS)
    one = store.upsert_latest(target, odds_rows(spark, [("a", "1", "2.5", T1, T1), ("a", "2", "--", T1, T1)]))
    two = store.upsert_latest(one, odds_rows(spark, [("a", "1", "9.9", T0, T2), ("a", "2", "4.0", T2, T2)]))
    got = {r.horse_number: (r.win_odds, r.scraped_at) for r in two.collect()}
    assert float(got["1"][0]) == 2.5 and got["1"][1] == T1  # the older snapshot loses
    assert float(got["2"][0]) == 4.0
    assert {r.horse_number: r.win_odds for r in one.collect()}["2"] is None
    assert two.filter("created_at = timestamp'2024-01-01 01:00:00'").count() == 0


ODDS = "race_id string, horse_number string, win_odds string, scraped_at timestamp, created_at timestamp"


def files_of(path):
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in pathlib.Path(path).rglob("*.parquet")}


def test_odds_stream(spark, tmp_path):
    """Three batches with late and replayed rows; files of buckets without updates stay as they are."""
    src, base, ckpt = (str(tmp_path / n) for n in ("src", "base", "ckpt"))
    table = BucketedTable(base, ("race_id", "horse_number"), S.PRE_RACE_ODDS, 32)
    odds_rows(spark, [(f"r{i}", "1", str(i), T0, T0) for i in range(200)] + [("a", "1", "2.5", T0, T0), ("a", "1", "3.5", T1, T1)]).write.parquet(src)

    def run(checkpoint=ckpt):
        stream.upsert_stream(spark.readStream.schema(ODDS).parquet(src), table, checkpoint).awaitTermination()
        return {(r.race_id, r.horse_number): (r.win_odds and float(r.win_odds), r.created_at) for r in table.read(spark).collect()}

    got = run()
    assert len(got) == 201 and got["a", "1"] == (3.5, T0) and got["r7", "1"] == (7.0, T0)
    before = files_of(base)
    odds_rows(spark, [("a", "1", "1.1", T0, T2), ("a", "2", "7.0", T2, T2)]).write.mode("append").parquet(src)
    got = run()
    assert got["a", "1"] == (3.5, T0) and got["a", "2"] == (7.0, T2) and len(got) == 202
    after = files_of(base)
    changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert 2 <= len(changed) <= 4 and len({p.split("bucket=")[1].split("/")[0] for p in changed}) <= 2
    odds_rows(spark, [("a", "2", "--", T3, T3)]).write.mode("append").parquet(src)
    got = run()
    assert got["a", "2"] == (None, T2) and len(got) == 202
    assert run(ckpt + "-lost") == got  # everything is replayed
    assert len({p.split("/part-")[0] for p in files_of(base)}) == len(files_of(base))  # one file a bucket, nothing left behind


def test_bucketed_tables(spark, tmp_path):
    cols = T.StructType.fromDDL("race_id long, race_name string, created_at timestamp")
    table = BucketedTable(str(tmp_path / "t"), ("race_id",), cols, 8)
    assert table.read(spark).count() == 0 and table.upsert(spark.createDataFrame([], cols)) == []
    table.upsert(spark.createDataFrame([(i, f"n{i}", T0) for i in range(100)] + [(None, "none", T0)], cols))
    new = spark.createDataFrame([(3, "new", T1), (500, "more", T1), (None, "other", T1)], cols)
    touched = table.touched(new)
    assert len(touched) <= 3
    part = table.part(spark, touched)
    read = [r[0] for r in part.select(F.input_file_name()).distinct().collect()]
    assert {f.split("bucket=")[1].split("/")[0] for f in read} <= {str(b) for b in touched}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and table.upsert(new) == touched
    want = store.upsert(spark.createDataFrame([(i, f"n{i}", T0) for i in range(100)] + [(None, "none", T0)], cols), new, "race_id")
    assert rows(table.read(spark)) == rows(want)
    table.upsert(new)
    assert rows(table.read(spark)) == rows(want)


def test_bucketed_children(spark, tmp_path):
    cols = T.StructType.fromDDL("race_id string, combination string")
    table = BucketedTable(str(tmp_path / "t"), ("race_id",), cols, 8)
    table.replace_children(spark.createDataFrame([(f"r{i % 20}", str(i)) for i in range(60)], cols))
    table.replace_children(spark.createDataFrame([("r1", "9"), ("r50", "x"), ("r50", "x")], cols))
    want = [(f"r{i % 20}", str(i)) for i in range(60) if i % 20 != 1] + [("r1", "9"), ("r50", "x"), ("r50", "x")]
    assert rows(table.read(spark)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        BucketedTable("x", ("a", "b"), cols).replace_children(table.read(spark))


def test_keys_months_and_runs(spark, tmp_path):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",)], "k string")
    assert rows(store.missing_keys(a, b, "k")) == [("x",)] and rows(store.existing_keys(a, b, "k")) == [("y",)]
    races = spark.createDataFrame([("2024/02/10",), ("2023/12/31",), (None,)], "date string")
    assert rows(store.latest_month(races)) == [(2024, 2)] and store.latest_month(races.limit(0)).count() == 0
    span = spark.sql("SELECT date'2023-11-15' AS a, date'2024-02-01' AS b")
    assert rows(store.month_range(span, F.col("a"), F.col("b"))) == [(2023, 11), (2023, 12), (2024, 1), (2024, 2)]
    p = spark.createDataFrame([("r2", 1), ("r1", 2), ("r1", 1)], "race_id string, predicted_rank int")
    path = store.save_run(p, str(tmp_path), "20240101_000000")
    assert rows(spark.read.option("header", True).csv(path)) == [("r1", "1"), ("r1", "2"), ("r2", "1")]
    with pytest.raises(Exception):
        store.save_run(p, str(tmp_path), "20240101_000000")


def test_quality(spark):
    res = spark.createDataFrame([("a", "1", "h1", "n1", "2.0"), ("a", "中止", "h2", "n2", None), ("b", "1", "", "n3", "---")],
                                "race_id string, finishing_position string, horse_id string, horse_name string, odds string")
    races = spark.createDataFrame([("a", "A", "2024/01/01"), ("b", "B", "2024/01/02"), ("c", "C", "2024/01/03")], "race_id string, race_name string, date string")
    master = spark.createDataFrame([("h1", "name", " ")], "horse_id string, horse_name string, sire string")
    assert rows(Q.missing_master(res, master, "horse_id", "horse_name")) == [("h2", "n2")]
    assert rows(Q.incomplete_master(res, master, "horse_id", ["horse_name", "sire"])) == [("h1",), ("h2",)]
    assert rows(Q.missing_results(races, res, datetime(2024, 1, 4).date()), "race_id") == [("c",)]
    assert Q.missing_results(races, res, datetime(2024, 1, 3).date()).count() == 0
    pay = spark.createDataFrame([("a",)], "race_id string")
    assert rows(Q.missing_payoffs(races, res, pay), "race_id") == [("b",)]
    assert rows(Q.bad_odds(races, res), "race_id") == [("b",)]
    s = Q.quality_summary({"bad": Q.bad_odds(races, res)}).first()
    assert (s["check"], s.n, s.samples) == ("bad", 1, "b")


def test_vectors(spark):
    v = spark.createDataFrame([("jockey_id", "a", [1.0, 0.0]), ("jockey_id", "b", [0.0, 2.0]), ("jockey_id", "__mean__", [9.0, 9.0]), ("sire", "s", [3.0, 4.0]), ("sire", "u", [1.0, 1.0])],
                              "category string, id string, vec array<float>")
    df = spark.createDataFrame([(1, "a", "t"), (2, "zz", "s"), (3, None, None)], "i int, jockey_id string, sire string")
    got = {r.i: r for r in VX.add_vectors(df, v).collect()}
    assert (got[1].jockey_id_emb_0, got[2].jockey_id_emb_0, got[3].jockey_id_emb_1) == (1.0, 9.0, 9.0)  # the stored mean wins
    assert (got[2].sire_emb_1, got[1].sire_emb_1) == (4.0, 2.5) and "trainer_id_emb_0" not in got[1].asDict()
    assert [r.id for r in VX.cosine_topn(v, "jockey_id", "a", 5).collect()] == ["b"]
    with pytest.raises(KeyError):
        VX.cosine_topn(v, "jockey_id", "nope")
    assert len(VX.pca_vectors(v, 10).filter("category = 'jockey_id'").first().vec) == 2


def test_projection_by_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {"a": 1000 + rng.normal(size=(200, 5)) * [5, 3, 2, 1, 0.1], "b": rng.normal(size=(40, 3)) @ rng.normal(size=(3, 3)), "one": np.ones((1, 2))}
    data = [(c, i, [float(v) for v in x]) for c, xs in sets.items() for i, x in enumerate(xs)] + [("a", 900, None)]
    df = spark.createDataFrame(data, "category string, id int, vec array<double>").repartition(7)
    covs = {r.category: r for r in VX.covariances(df).collect()}
    axes = {r.category: r for r in VX.principal_axes(df, 2).collect()}
    got = {(r.category, r.id): r.vec for r in VX.pca_vectors(df, 2).collect()}
    assert len(got) == len(data) and got["a", 900] is None
    for c, xs in sets.items():
        assert covs[c].n == len(xs) and np.allclose(covs[c].mean, xs.mean(axis=0))
        if len(xs) == 1:
            assert np.allclose(got[c, 0], 0)
            continue
        assert np.allclose(np.array(covs[c].cov, float), np.cov(xs.T), atol=1e-9)
        mine = np.array([got[c, i] for i in range(len(xs))])
        w = np.array(axes[c].axes)
        assert np.allclose(mine, (xs - xs.mean(axis=0)) @ w.T, atol=1e-8) and np.allclose(w @ w.T, np.eye(2), atol=1e-9)
        assert np.allclose(mine.var(axis=0, ddof=1), np.linalg.eigvalsh(np.cov(xs.T))[::-1][:2]) and np.allclose(axes[c].variance, mine.var(axis=0, ddof=1))
        assert all(a[np.abs(a).argmax()] > 0 for a in w)
    assert VX.pca_vectors(df.limit(0), 2).count() == 0


def page(spark, html):
    return spark.createDataFrame([(1, "", html)], "page_id long, url string, html string")


def test_result_table(spark):
    html = """<table class="other"><tr><td>x</td></tr></table>
    <TABLE class='race_table_01 nk'><tr><th>着 順</th><th>枠番</th><th>馬番</th><th>馬名</th><th>騎手</th><th>単勝</th><th>馬体重</th></tr>
    <tr><td>1<td>2</td><td> 3 </td><td><a href="/horse/2019100001/">A&amp;B</a></td><td><a href="/jockey/result/recent/00666/">武</a></td><td>5.2</td><td>480(-2)</td></tr>
    <tr><!-- <td>no</td> --><td>2</td><td>1</td></tr></table>"""
    got = X.result_rows(page(spark, html)).orderBy("row").collect()
    assert len(got) == 2
    r = got[0].rec
    assert (r["着 順"], r["馬番"], r["馬名"], r["馬ID"], r["騎手ID"], r["調教師ID"], r["単勝オッズ"]) == ("1", "3", "A&B", "2019100001", "00666", "", "5.2")
    assert got[1].rec["枠番"] == "1" and "馬番" not in got[1].rec and got[1].rec["単勝オッズ"] == ""
    stored = store.result_record(X.result_rows(page(spark, html)).select(F.col("page_id").alias("race_id"), "rec")).orderBy("horse_number").collect()
    assert (stored[1].horse_weight, stored[1].horse_weight_diff, stored[1].odds) == (480, -2, "5.2")
    assert json.loads(stored[1].raw_data)["馬名"] == "A&B"


def test_headerless_table_and_repeated_headers(spark):
    bare = X.result_rows(page(spark, '<table class="race_table_01"><tr><td>a</td><td>b</td></tr></table>')).first().rec
    assert bare["col_0"] == "a" and bare["col_1"] == "b"
    twice = X.result_rows(page(spark, '<table class="race_table_01"><tr><th>k</th><th>k</th></tr><tr><td>1</td><td>2</td></tr></table>')).first().rec
    assert twice["k"] == "2"
    assert X.result_rows(page(spark, "<p>race_table_01</p>")).count() == 0


@pytest.mark.parametrize("text, want", [
    ("ダ右1200m / 天候 : 晴 / ダート : 稍重 / 発走 : 11:35", ("ダート", "右", "1200", "晴", "稍重", "11:35")),
    ("芝左 外2400m / 天候：曇 / 芝：良 / 15:40発走", ("芝", "左", "2400", "曇", "良", "15:40")),
    ("障芝3000m", ("芝", None, "3000", None, None, None)),
    ("障3000m / 障害 : 重", ("障害", None, "3000", None, "重", None)),
])
def test_course_line(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(*[v.alias(k) for k, v in X.course_facts(F.col("t")).items()]).first()
    assert (r.course_type, r.direction, r.distance, r.weather, r.track_condition, r.start_time) == want


def test_payoffs(spark):
    html = ('<table class="pay_table_01"><tr><th>複勝</th><td>1<br />3</td><td>110<br>1,200</td><td>1</td></tr><tr><th>単勝</th><td>1</td></tr>'
            '<tr><th>馬連</th><td></td><td></td></tr></table>')
    got = rows(X.payoff_rows(page(spark, html)), "bet_type", "combination", "payout", "popularity")
    assert got == [("複勝", "1", "110", "1"), ("複勝", "3", "1,200", ""), ("馬連", "", "", "")]


def test_entry_list(spark):
    html = ('<table><tr class="HorseList" id="tr_07"><td class="Waku4 Txt_C">4</td><td class="HorseInfo"><a href="https://x/horse/201910">N</a></td>'
            '<td class="Barei Txt_C">牝3</td><td class="Txt_C">54.0</td><td class="Jockey"><a href="/jockey/05339/">ル</a></td></tr>'
            '<tr class="HorseList"><td>no number</td></tr></table>')
    got = X.entry_rows(page(spark, html)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.horse_number, r.bracket_number, r.horse_id, r.sex_age, r.weight_carried, r.jockey_id, r.trainer_id) == ("7", "4", "201910", "牝3", "54.0", "05339", None)


@pytest.mark.parametrize("depth", [3, 5])
def test_pedigree_of_any_depth(spark, depth):
    top = 2 ** (depth - 1)
    trs = []
    for r in range(2 * top):
        cells, span = "", top
        while span >= 1:
            if r % span == 0:
                cells += f'<td rowspan="{span}">{"S" if r < top else "D"}{r}_{span}</td>'
            span //= 2
        trs.append(f"<tr>{cells}</tr>")
    r = X.pedigree(page(spark, f'<table class="blood_table">{"".join(trs)}</table>')).first()
    assert (r.sire, r.dam, r.broodmare_sire) == (f"S0_{top}", f"D{top}_{top}", f"D{top}_{top // 2}")


def test_lists(spark):
    links = '<a href="/race/202401010101/">a</a><a href="/race/202401010102">b</a><a href="/race/202401010101/">c</a><a href="/race/2024/">d</a>'
    assert rows(X.link_ids(page(spark, links)), "pos", "id") == [(0, "202401010101"), (1, "202401010102")]
    assert rows(X.link_ids(page(spark, '<a href="../x.html?race_id=202401010103&rf=1">a</a>'), X.RACE_PARAM), "id") == [("202401010103",)]
    count = lambda h: X.page_count(page(spark, h)).first().page_count
    assert count('<div class="pager">1,717件中1~100件目</div>') == 18
    assert count('<div class="pager">100件中1〜100件目</div>') == 1 and count("<p>1,717件中1~100件目</p>") == 1


def test_odds_documents(spark):
    doc = {"status": "middle", "data": {"odds": {"1": {"1": ["2.5", "0", "1", "03"], "2": ["---", "0", "2", "04"], "3": ["7.0"]}, "2": {}}}}
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", json.dumps({**doc, "status": "NG"})), ("c", "not json")], "race_id string, payload string")
    assert rows(X.odds_rows(df)) == [("a", "3", "2.5")]
