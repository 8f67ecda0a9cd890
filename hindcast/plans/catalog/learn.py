"""Model steps. The boosted fits are iterative and have no SQL twin; facts about their predictions, row counts and tests check them."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import learn as L
from hindcast.operators.isotonic import isotonic_blocks
from hindcast.operators.keyed import dense_index
from hindcast.operators.permute import permuted, taken_places
from hindcast.operators.splits import split_by_date
from hindcast.operators.race import relevance_label
from hindcast.operators.ranking import gradients
from hindcast.plans.catalog.base import on_entries, oracle
from hindcast.plans.catalog.history import CUT
from hindcast.session import ensure_checkpoint_dir, stored

FEATURES = ["venue", "course_type", "distance", "horse_number", "bracket_number", "weight_carried", "horse_weight", "odds", "popularity"]
SMALL = {"maxIter": 3, "maxDepth": 3}


def _features(e):
    return e.select(*dict.fromkeys(["race_id", "horse_number", "horse_id", "date", "is_win", "is_placed", "finishing_position", *FEATURES]))


def _fitted(e, half_life=None):
    train, val, test = split_by_date(_features(e))
    return L.train(train, FEATURES, half_life, SMALL), val, test


@on_entries("place_model", store=True)
def _(e):
    train, _, test = split_by_date(_features(e))
    return L.raw_score(L.fit_place(train, FEATURES, None, SMALL), test, "place_prob").select("race_id", "horse_number", "place_prob")


@on_entries("win_model", store=True)
def _(e):
    models, _, test = _fitted(e, 1095.0)
    return L.predict(models, test).select("race_id", "horse_number", "win_prob", "predicted_rank")


@on_entries("rank_gradients", oracle("""
SELECT m.race_id, m.horse_number, coalesce(l, 0) AS gradient, coalesce(h, 0) AS curvature
FROM m LEFT JOIN (
  SELECT race_id, horse_number, sum(sign * rho * change) AS l, sum(rho * (1 - rho) * change) AS h
  FROM (SELECT a.race_id, a.horse_number, sign(a.g - b.g) AS sign, 1 / (1 + exp(sign(a.g - b.g) * (a.s - b.s))) AS rho,
               abs((a.g - b.g) * (a.d - b.d)) / a.best AS change
        FROM m a JOIN m b ON a.race_id = b.race_id AND a.g <> b.g) GROUP BY race_id, horse_number) USING (race_id, horse_number)""", """
placed AS (SELECT race_id, horse_number, CAST(max(finishing_position) OVER (PARTITION BY race_id) - finishing_position AS DOUBLE) AS g, win_prob_b AS s,
  row_number() OVER (PARTITION BY race_id ORDER BY win_prob_b DESC, horse_number) - 1 AS r FROM e)""", """
m AS (SELECT *, 1 / log2(r + 2) AS d,
  sum(g / log2(1 + rank_g)) OVER (PARTITION BY race_id) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY g DESC) AS rank_g FROM placed))""", rounds=["gradient", "curvature"]))
def _(e):
    return gradients(relevance_label(e), "relevance", "win_prob_b", most=None)


@on_entries("rank_model", store=True)
def _(e):
    train, val, test = split_by_date(_features(e))
    models = L.train(train, FEATURES, 1095.0, {"maxIter": 10, "maxDepth": 4, "stepSize": 0.3}, "rank")
    return L.predict(models, test).select("race_id", "horse_number", "win_prob", "predicted_rank")


for _method, _name in (("isotonic", "isotonic_calibrate"), ("sigmoid", "platt_calibrate")):
    def _calibrated(e, method=_method):
        models, val, test = _fitted(e)
        return L.predict(L.calibrate(models, val, method), test).select("race_id", "horse_number", "win_prob", "place_prob")
    on_entries(_name, store=True)(_calibrated)


@on_entries("isotonic_fit", oracle("""
SELECT min(s) AS lo, max(s) AS hi, CAST(sum(n) AS BIGINT) AS n, CAST(sum(t) AS DOUBLE) AS total, fit AS mean FROM (
  SELECT i, any_value(s) AS s, any_value(n) AS n, any_value(t) AS t, max(least) AS fit FROM (
    SELECT k.i, k.s, k.n, k.t, min((k.ct - j.ct + j.t) / (k.cn - j.cn + j.n)) OVER (PARTITION BY j.i ORDER BY k.i DESC) AS least
    FROM c j JOIN c k ON j.i <= k.i) GROUP BY i) GROUP BY fit""", """
c AS (SELECT row_number() OVER (ORDER BY s) AS i, s, n, t, sum(n) OVER (ORDER BY s) AS cn, sum(t) OVER (ORDER BY s) AS ct
  FROM (SELECT finish_time_sec AS s, count(*) AS n, CAST(sum(is_placed) AS DOUBLE) AS t FROM e GROUP BY 1))""", rounds=["lo", "hi", "total", "mean"]))
def _(e):
    """Ranges of 200 scores, so that several rounds take part; SQL has the largest least mean of all spans about a score."""
    return isotonic_blocks(e, "finish_time_sec", "is_placed", range_rows=200).select("lo", "hi", "n", "total", "mean")


METHODS = (None, "isotonic", "sigmoid")


@on_entries("prediction_facts", oracle("""
SELECT method, race_id, count(*) AS n, TRUE AS sums_to_one, TRUE AS ranks_hold, TRUE AS in_range
FROM e, cut, (VALUES ('none'), ('isotonic'), ('sigmoid')) m(method) WHERE date >= test_from GROUP BY ALL""", CUT), store=True)
def _(e):
    """Of each way of calibration and race: all runners are there once, their chances add up to one (or there are none), each rank is
    one more than the number of better runners, and the place chances are from 0 to 1."""
    models, val, test = _fitted(e)

    def facts(method: str | None) -> DataFrame:
        p = L.predict(models if method is None else L.calibrate(models, val, method), test)
        better = Window.partitionBy("race_id").orderBy(F.desc("win_prob"))
        held = F.col("predicted_rank").eqNullSafe(F.when(F.col("win_prob").isNotNull(), F.rank().over(better)).cast("int"))
        return p.withColumn("held", held | F.col("win_prob").isNull()).groupBy(F.lit(method or "none").alias("method"), "race_id").agg(
            F.count_distinct("horse_number").alias("n"), F.coalesce(F.abs(F.sum("win_prob") - 1) < 1e-9, F.lit(True)).alias("sums_to_one"),
            F.min("held").alias("ranks_hold"), F.min(F.col("place_prob").between(0, 1)).alias("in_range"))

    return reduce(DataFrame.unionByName, [facts(m) for m in METHODS])


@on_entries("model_versions", oracle("SELECT race_id, horse_number, TRUE AS same FROM e, cut WHERE date >= test_from", CUT), store=True)
def _(e):
    """Of three saved versions the newest calibrated one is loaded, and it predicts what it did before."""
    models, val, test = _fitted(e)
    fitted = L.calibrate(models, val)
    ensure_checkpoint_dir(e.sparkSession)
    base = f"{e.sparkSession.sparkContext.getCheckpointDir()}/versions-{uuid4().hex}"
    for version, saved in (("20240101_000000", models), ("20240102_000000", fitted), ("20240103_000000", models)):
        L.save_models(saved, base, version)
    back = L.predict(L.load_latest(e.sparkSession, base), test)
    told = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in ("win_prob", "place_prob", "predicted_rank")]
    again = back.select("race_id", "horse_number", *[F.col(c).alias(f"{c}_2") for c in ("win_prob", "place_prob", "predicted_rank")])
    return L.predict(fitted, test).join(again, ["race_id", "horse_number"]).select("race_id", "horse_number", (told[0] & told[1] & told[2]).alias("same"))


@on_entries("importance_rank", store=True)
def _(e):
    models, _, _ = _fitted(e)
    spark = e.sparkSession
    return L.importance_rank(models.win, spark, "win").unionByName(L.importance_rank(models.place, spark, "place"))


@on_entries("permutation_importance", store=True)
def _(e):
    models, val, test = _fitted(e)
    return L.permutation_importance(L.calibrate(models, val), test, FEATURES)


@on_entries("permutations", oracle("""
SELECT CAST(r AS INT) AS repeat, count(*) AS n_rows, count(*) AS n_places, min(1) AS first_place, count(*) AS last_place FROM e, range(20) t(r) GROUP BY r"""))
def _(e):
    """Each of twenty repeats sends the places of all entries onto themselves, one to one."""
    keys = stored(e.select("race_id", "horse_number"))
    n = keys.count()
    places = dense_index(keys.withColumn("k", F.lit(0)), ["k"], ["race_id", "horse_number"], "i")
    places = places.repartition(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i")  # up to two million rows come from one task
    many = places.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("to", permuted(F.col("i") - 1, n, 7, F.col("repeat")))
    return taken_places(many.select("repeat", F.col("to").alias("place"))).select(
        "repeat", F.col("n").alias("n_rows"), F.col("places").alias("n_places"), (F.col("first") + 1).cast("int").alias("first_place"), (F.col("last") + 1).alias("last_place"))


@on_entries("significance_by_fold", store=True)
def _(e):
    return L.significance_by_fold(_features(e), FEATURES, ["popularity", "odds", "weight_carried"], params=SMALL)


@on_entries("sweep", store=True)
def _(e):
    """Every half-life of the experiment, with the operator's own rounds and depth."""
    return L.sweep_half_life(_features(e), FEATURES)


@on_entries("sweep_longshot", store=True)
def _(e):
    return L.sweep_longshot(_features(e), FEATURES, params=SMALL)


@on_entries("sweep_history", store=True)
def _(e):
    recomputed = ["days_since_last_race", "avg_finish_last3", "avg_speed_index_last5", "jockey_win_rate_venue_cond", "trainer_prior_win_rate", "sire_place_rate_cond"]
    return L.sweep_history_at_once(e, [*FEATURES, *recomputed], params=SMALL)


@on_entries("compare_history", store=True)
def _(e):
    return L.compare_history(_features(e), 2, None, lambda df: df, FEATURES, n_boot=100, params=SMALL)


@on_entries("sweep_params", store=True)
def _(e):
    return L.sweep_params(_features(e), FEATURES, [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 3, "half_life": 1095.0}], 2)


@on_entries("walk_forward_fit", store=True)
def _(e):
    return L.run_folds(_features(e), FEATURES, 3, params=SMALL).withColumn("fold", F.col("fold").cast("int"))
