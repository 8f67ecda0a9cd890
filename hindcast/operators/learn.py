"""Model steps on Spark ML: fit, calibrate, score, importance, sweeps.

The win model is either a boosted-tree classifier on ``is_win`` (``objective="binary"``) or boosted trees under the ranking
objective of ``ranking`` on the relevance label (``objective="rank"``); the scores of both are turned into race probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Imputer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hindcast import schema as S
from hindcast.operators.cuts import cut_features, history_cuts, of_cut
from hindcast.operators.evaluate import METRICS, evaluate, longshot_metrics, nll
from hindcast.operators.history import DATE, HORSE, decay_weight
from hindcast.operators.isotonic import isotonic_blocks, step_points
from hindcast.operators.keyed import dense_index
from hindcast.operators.permute import shuffled_repeats
from hindcast.operators.race import ENTRY, RACE, normalise, predicted_rank, relevance_label, softmax
from hindcast.operators.ranking import RankModel, fit_rank, load_rank, save_rank
from hindcast.operators.resample import paired_bootstrap
from hindcast.operators.splits import cut_dates, filter_longshot, split_by_date, truncate_history, walk_forward
from hindcast.session import stored

DEFAULTS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "minInstancesPerNode": 20, "subsamplingRate": 0.8,
            "seed": 7, "maxBins": 64}


def frequent_values(df: DataFrame, cols: Sequence[str], most: int) -> list[list[str]]:
    """The ``most`` most frequent values of each text column, from one pass; ties go by value."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(cols)])).alias("x")).select("x.*")
    counts = each.filter("v IS NOT NULL").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))).filter(F.col("r") <= most)
    out: list[list[str]] = [[] for _ in cols]
    for row in sorted(top.collect(), key=lambda r: (r.c, r.r)):
        out[row.c].append(row.v)
    return out


def _stages(df: DataFrame, features: Sequence[str], most: int) -> tuple[list, DataFrame]:
    """Stages that make the vector ``__x`` of the features, and ``df`` with numbers as doubles.

    A text column keeps its ``most`` most frequent values; all others, nulls and values that first come up in a prediction
    share one more slot. So a column may have any number of values.

    Categories by frequency, numbers with medians for nulls.
    """
    if missing := [f for f in features if f not in df.columns]:
        raise ValueError(f"no such features: {missing}")
    types = {f.name: f.dataType for f in df.schema}
    text = [c for c in features if isinstance(types[c], T.StringType)]
    nums = [c for c in features if c not in text]
    stages: list = []
    if text:
        labels = [x or [""] for x in frequent_values(df, text, most)]
        stages.append(StringIndexerModel.from_arrays_of_labels(labels, inputCols=text, outputCols=[f"{c}__i" for c in text], handleInvalid="keep"))
    if nums:
        stages.append(Imputer(inputCols=nums, outputCols=[f"{c}__n" for c in nums], strategy="median"))
    parts = [f"{c}__i" for c in text] + [f"{c}__n" for c in nums]
    stages.append(VectorAssembler(inputCols=parts, outputCol="__x", handleInvalid="keep"))
    return stages, df.withColumns({c: F.col(c).cast("double") for c in nums})


def _settings(params: dict | None) -> tuple[dict, int]:
    """Tree settings, and the number of categories that a text column keeps: ``maxCategories`` or one less than the bins."""
    settings = {**DEFAULTS, **(params or {})}
    return settings, min(settings.pop("maxCategories", settings["maxBins"] - 1), settings["maxBins"] - 1)


#: Rows of a task of a boosted fit. It holds them as objects, with their binned features, sample and errors: some 300 bytes each.
FIT_ROWS = 500_000


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in more partitions, if one has more than ``FIT_ROWS``: files are split by their size and the number of cores, so that
    a task of the fit would have as much more to read as there are more rows."""
    own = rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    return rows if (own.most or 0) <= FIT_ROWS else rows.repartition(-(-own.total // FIT_ROWS))


def _fits(rows: DataFrame, *fits: Callable[[], object]) -> list:
    """Results of independent fits. Where ``rows`` have fewer parts than there are cores these run at the same time, as the many short jobs
    of one leave cores free; else one after the other, as each holds all rows."""
    spark = rows.sparkSession
    if rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return [fit() for fit in fits]
    with ThreadPoolExecutor(len(fits)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


def _fit(df: DataFrame, label: str, features: Sequence[str], weight: str | None, params: dict | None) -> PipelineModel:
    settings, most = _settings(params)
    stages, data = _stages(df, features, most)
    data = _spread(data).withColumn("__label", F.col(label).cast("double"))
    tree = GBTClassifier(featuresCol="__x", labelCol="__label", predictionCol="__y", **settings)
    if weight:
        tree = tree.setWeightCol(weight)
    return Pipeline(stages=[*stages, tree]).fit(data)


def fit_place(df: DataFrame, features: Sequence[str], weight: str | None = None, params: dict | None = None) -> PipelineModel:
    return _fit(df, "is_placed", features, weight, params)


def fit_win(df: DataFrame, features: Sequence[str], weight: str | None = None, params: dict | None = None) -> PipelineModel:
    return _fit(df, "is_win", features, weight, params)


def fit_win_rank(df: DataFrame, features: Sequence[str], weight: str | None = None, params: dict | None = None) -> RankModel:
    """Ranking model on ``relevance`` (of :func:`race.relevance_label`)."""
    settings, most = _settings(params)
    stages, data = _stages(df, features, most)
    return fit_rank(df, Pipeline(stages=stages).fit(data), "relevance", weight, settings["maxIter"], settings["maxDepth"], settings["stepSize"],
                    least=settings["minInstancesPerNode"], bins=settings["maxBins"], seed=settings["seed"])


def raw_score(model: PipelineModel | RankModel, df: DataFrame, out: str) -> DataFrame:
    if isinstance(model, RankModel):
        return model.score(df, out)
    nums = [c[:-3] for s in model.stages if hasattr(s, "getOutputCols") for c in s.getOutputCols() if c.endswith("__n")]
    data = df.withColumns({c: F.col(c).cast("double") for c in nums})
    scored = model.transform(data).withColumn(out, vector_to_array("probability")[1])
    back = [F.col(c).cast(t).alias(c) if c in nums else F.col(c) for c, t in df.dtypes]
    return scored.select(*back, out)


@dataclass
class Calibrator:
    method: str
    model: IsotonicRegressionModel | LogisticRegressionModel

    def apply(self, df: DataFrame, col: str) -> DataFrame:
        """Replace the raw score by the calibrated probability."""
        keep = df.columns
        if self.method == "isotonic":
            scored = df.withColumn(self.model.getFeaturesCol(), F.col(col))
            return self.model.transform(scored).withColumn(col, F.col("__cal")).select(*keep)
        vec = VectorAssembler(inputCols=[col], outputCol="__s").transform(df)
        return self.model.transform(vec).withColumn(col, vector_to_array("__cp")[1]).select(*keep)


def fit_calibrator(scored: DataFrame, col: str, label: str, method: str = "isotonic") -> Calibrator:
    """Isotonic steps (values outside the fitted range are clipped to its ends) or a logistic curve with C = 1."""
    data = scored.withColumn("__label", F.col(label).cast("double"))
    if method == "isotonic":
        steps = step_points(isotonic_blocks(data, col, "__label"))  # the model gets the ends of the steps, not the rows
        model = IsotonicRegression(featuresCol="score", labelCol="mean", weightCol="weight", predictionCol="__cal").fit(steps).setFeaturesCol(col)
    elif method == "sigmoid":
        n = max(data.count(), 1)
        vec = VectorAssembler(inputCols=[col], outputCol="__s").transform(data)
        model = LogisticRegression(featuresCol="__s", labelCol="__label", predictionCol="__cy", probabilityCol="__cp",
                                   rawPredictionCol="__cr", regParam=1.0 / n, standardization=False).fit(vec)
    else:
        raise ValueError(f"unknown calibration method {method!r}")
    return Calibrator(method, model)


@dataclass
class Models:
    win: PipelineModel | RankModel
    place: PipelineModel
    win_cal: Calibrator | None = None
    place_cal: Calibrator | None = None


def train(df: DataFrame, features: Sequence[str], half_life: float | None = None, params: dict | None = None,
          objective: str = "binary") -> Models:
    """Both models on the same rows. Fitting reads them many times, so the needed columns are held (and recomputed
    if an executor is lost) until both fits are done. ``objective="rank"`` needs ``finishing_position`` as well."""
    if objective not in ("binary", "rank"):
        raise ValueError(f"unknown objective {objective!r}")
    weight = None
    extra = [] if objective == "binary" else [RACE, ENTRY, "relevance"]
    labelled = df if objective == "binary" else relevance_label(df)
    rows = labelled.select(*dict.fromkeys([*features, "is_win", "is_placed", DATE, *extra]))
    if half_life is not None:
        rows = rows.withColumn("__w", decay_weight(F.col(DATE), df.agg(F.max(DATE)).scalar(), half_life))
        weight = "__w"
    rows = _spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        win = fit_win if objective == "binary" else fit_win_rank
        return Models(*_fits(rows, lambda: win(rows, features, weight, params), lambda: fit_place(rows, features, weight, params)))
    finally:
        rows.unpersist()


def calibrate(models: Models, held_out: DataFrame, method: str = "isotonic") -> Models:
    """Fit the calibrators on rows the models have not seen."""
    win = fit_calibrator(raw_score(models.win, held_out, "__sw"), "__sw", "is_win", method)
    place = fit_calibrator(raw_score(models.place, held_out, "__sp"), "__sp", "is_placed", method)
    return Models(models.win, models.place, win, place)


def probabilities(models: Models, df: DataFrame, race: Sequence[str] = (RACE,)) -> DataFrame:
    """``df`` with ``win_prob`` and ``place_prob``: calibrated scores are normalised per race, raw ones pass a softmax. ``race`` has the columns
    that tell races apart."""
    df = df.drop("win_prob", "place_prob")
    scored = raw_score(models.place, raw_score(models.win, df, "win_prob"), "place_prob")
    if models.win_cal is not None:
        scored = models.place_cal.apply(models.win_cal.apply(scored, "win_prob"), "place_prob")
        return normalise(scored, "win_prob", by=race)
    return softmax(scored, "win_prob", "win_prob", by=race)


def predict(models: Models, df: DataFrame) -> DataFrame:
    """Probabilities of both models, ranked per race."""
    scored = probabilities(models, df)
    cols = [RACE, ENTRY, "horse_id", "win_prob", "place_prob", "predicted_rank"]
    cols += [c for c in ("win_odds", "odds", "weight_carried") if c in df.columns]
    return predicted_rank(scored).select(*cols)


# ---- versions -----------------------------------------------------------------------------------------------------

def save_models(models: Models, base: str, version: str) -> str:
    path = f"{base}/{version}"
    if isinstance(models.win, RankModel):
        save_rank(models.win, SparkSession.active(), f"{path}/win_rank")
    else:
        models.win.write().overwrite().save(f"{path}/win")
    models.place.write().overwrite().save(f"{path}/place")
    for name, cal in (("win_cal", models.win_cal), ("place_cal", models.place_cal)):
        if cal is not None:
            cal.model.write().overwrite().save(f"{path}/{name}_{cal.method}")
    return path


def _children(spark, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []


def load_latest(spark, base: str) -> Models:
    """Newest version that has calibrators, else the newest version."""
    versions = _children(spark, base)
    if not versions:
        raise FileNotFoundError(base)
    parts = {v: _children(spark, f"{base}/{v}") for v in versions}
    calibrated = [v for v in versions if any(p.startswith("win_cal_") for p in parts[v])]
    v = (calibrated or versions)[-1]
    cals = {}
    for p in parts[v]:
        if "_cal_" in p:
            side, method = p.split("_cal_")
            loader = IsotonicRegressionModel if method == "isotonic" else LogisticRegressionModel
            cals[side] = Calibrator(method, loader.load(f"{base}/{v}/{p}"))
    win = load_rank(spark, f"{base}/{v}/win_rank") if "win_rank" in parts[v] else PipelineModel.load(f"{base}/{v}/win")
    return Models(win, PipelineModel.load(f"{base}/{v}/place"),
                  cals.get("win"), cals.get("place"))


# ---- importance ---------------------------------------------------------------------------------------------------

def importance_rank(model: PipelineModel, spark, name: str) -> DataFrame:
    """Gain per model input with its rank, largest first. Takes the raw model, not a calibrator."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    gains = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    rows = [(c[:-3], name, g) for c, g in zip(assembler.getInputCols(), gains)]
    df = spark.createDataFrame(rows, "feature string, model string, gain double")
    return df.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.desc("gain"))))


def _indexed(df: DataFrame) -> DataFrame:
    """``df`` with a dense index ``__i``, written once. Indexing up to two million rows is one task's work; what follows multiplies
    the rows, so they are spread over all partitions first."""
    rows = dense_index(df.withColumn("__all", F.lit(0)), ["__all"], [RACE, ENTRY], "__i").drop("__all")
    return stored(rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__i"))


def shuffled(df: DataFrame, col: str, seed: int) -> DataFrame:
    """``col`` permuted over all rows, by a keyed permutation of their index. Exact and repeatable."""
    rows = _indexed(df)
    return shuffled_repeats(rows, "__i", rows.count(), col, 1, seed).select(*df.columns)


def _losses(models: Models, df: DataFrame, by: list[str]) -> DataFrame:
    """Both log-losses of the rows of ``df``, for each value of ``by``."""
    scored = probabilities(models, df, (*by, RACE))
    return scored.groupBy(*by).agg(F.avg(nll("is_win", "win_prob")).alias("win"), F.avg(nll("is_placed", "place_prob")).alias("place"))


def permutation_importance(models: Models, df: DataFrame, features: Sequence[str], n_repeats: int = 20,
                           level: float = 0.95, seed: int = 0) -> DataFrame:
    """Rise of both log-losses when a feature is dealt anew over all rows, with an interval over the repeats.

    All repeats of a feature are scored in one pass: the values that a row is dealt come to it as one array, and the rows stand by race before
    they are taken once for each repeat, so that these are not shuffled. Each feature is a job of its own, of which some numbers for
    each repeat stay. A feature that the models do not use is an error.
    """
    used = {c[:-3] for m in (models.win, models.place) for s in (m.prepare if isinstance(m, RankModel) else m).stages
            if isinstance(s, VectorAssembler) for c in s.getInputCols()}
    if unknown := [f for f in features if f not in used or f not in df.columns]:
        raise ValueError(f"the models do not use {unknown}")
    keep = [c for c in df.columns if c in used or c in (RACE, ENTRY, "is_win", "is_placed")]
    rows = _indexed(df.select(*keep))
    n = rows.count()
    base = _losses(models, rows, []).first()
    parts = []
    for i, feature in enumerate(features):
        many = shuffled_repeats(rows, "__i", n, feature, n_repeats, seed * 1000 + i, near=[RACE])
        parts.append(stored(_losses(models, many, ["repeat"])).select(F.lit(feature).alias("feature"), F.explode(F.array(*[F.struct(
            F.lit(side).alias("model"), F.lit(base[side]).alias("baseline"), (F.col(side) - base[side]).alias("rise")) for side in ("win", "place")])).alias("r")))
    each = _union(parts).select("feature", "r.*").withColumn("metric", F.concat("model", F.lit("_logloss")))
    a = (1 - level) / 2
    q = each.groupBy("feature", "model", "metric").agg(
        F.max("baseline").alias("baseline"), F.avg("rise").alias("mean_increase"), F.count(F.lit(1)).alias("repeats"),
        F.percentile("rise", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return q.select("feature", "model", "metric", "repeats", "baseline", "mean_increase", F.col("q")[0].alias("ci_lower"),
                    F.col("q")[1].alias("ci_upper"), (F.col("q")[0] > 0).alias("significant"))


def significance_by_fold(df: DataFrame, features: Sequence[str], judged: Sequence[str], n_splits: int = 5, n_repeats: int = 20,
                         params: dict | None = None, held_out: float = 0.15) -> DataFrame:
    """Whether each judged feature matters in each walk-forward fold: a row per feature and model, a column per fold."""
    parts = []
    for k, tr, te in walk_forward(df, n_splits):
        fit, _, cal = split_by_date(tr, 0.0, held_out)
        models = calibrate(train(fit, features, None, params), cal)
        parts.append(permutation_importance(models, te, judged, n_repeats, seed=k).withColumn("fold", F.lit(k)))
    rows = _union(parts)
    return rows.groupBy("feature", "model").pivot("fold", list(range(1, n_splits + 1))).agg(F.first("significant"))


# ---- sweeps -------------------------------------------------------------------------------------------------------

def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sweep(options: Sequence[tuple[str, object]], run: Callable[[object], DataFrame], label: str = "option") -> DataFrame:
    """One metric row per option; ``run`` fits and evaluates one option."""
    return _union([run(value).select(F.lit(name).alias(label), "*") for name, value in options])


def sweep_half_life(df: DataFrame, features: Sequence[str], options=tuple(S.HALF_LIVES), params: dict | None = None) -> DataFrame:
    train_df, val, test = split_by_date(df)
    def run(h):
        return evaluate(test, predict(calibrate(train(train_df, features, h, params), val), test))
    return sweep([("none" if h is None else str(int(h)), h) for h in options], run, "half_life_days")


def sweep_longshot(df: DataFrame, features: Sequence[str], half_life: float | None = 1095.0, params: dict | None = None) -> DataFrame:
    """All rows against longshots only, both judged on the longshots of the test period."""
    train_df, val, test = split_by_date(df)
    def run(only: bool):
        keep = filter_longshot if only else (lambda x: x)
        models = calibrate(train(keep(train_df), features, half_life, params), keep(val))
        return longshot_metrics(test, predict(models, test))
    return sweep([("all", False), ("longshot", True)], run, "model")


def history_run(df: DataFrame, years: int | None, features_of: Callable[[DataFrame], DataFrame], features: Sequence[str],
                half_life: float | None = 1095.0, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(test rows, predictions) with history cut to ``years`` before the features are computed."""
    val_from, test_from = cut_dates(df)
    full = features_of(truncate_history(df, years, val_from))
    d = F.col(DATE)
    models = calibrate(train(full.filter(d < val_from), features, half_life, params),
                       full.filter((d >= val_from) & (d < test_from)))
    test = full.filter(d >= test_from)
    return test, predict(models, test)


def sweep_history(df: DataFrame, features_of, features, options=tuple(S.HISTORY_YEARS), half_life: float | None = 1095.0,
                  params: dict | None = None) -> DataFrame:
    def run(years):
        return evaluate(*history_run(df, years, features_of, features, half_life, params))
    return sweep([("all" if y is None else str(y), y) for y in options], run, "years")


def sweep_history_at_once(df: DataFrame, features: Sequence[str], options=tuple(S.HISTORY_YEARS), half_life: float | None = 1095.0,
                          params: dict | None = None) -> DataFrame:
    """:func:`sweep_history` with every feature computed under each cut, all of them in one run of :func:`cuts.cut_features`."""
    val_from, test_from = cut_dates(df)
    cuts = history_cuts(val_from, options)
    every = cut_features(df, cuts)
    read = {RACE, ENTRY, HORSE, DATE, "is_win", "is_placed", "odds", "weight_carried", *features}  # the rest is neither made nor written
    own = {f"{f}__{k}" for f in features for k in cuts}
    wide = stored(every.select(*[c for c in every.columns if c in own or c in read]))
    d = F.col(DATE)

    def run(cut: str):
        rows = of_cut(wide, cut, cuts[cut])
        models = calibrate(train(rows.filter(d < val_from), features, half_life, params), rows.filter((d >= val_from) & (d < test_from)))
        test = rows.filter(d >= test_from)
        return evaluate(test, predict(models, test))
    return sweep([(k, k) for k in cuts], run, "years")


def compare_history(df: DataFrame, years_a, years_b, features_of, features, n_boot: int = 10_000, seed: int = 42,
                    params: dict | None = None) -> DataFrame:
    test, a = history_run(df, years_a, features_of, features, params=params)
    _, b = history_run(df, years_b, features_of, features, params=params)
    return paired_bootstrap(test, a, b, n_boot=n_boot, seed=seed)


def run_folds(df: DataFrame, features: Sequence[str], n_splits: int = 5, half_life: float | None = None,
              params: dict | None = None, held_out: float = 0.15, calibrate_on_test: bool = False) -> DataFrame:
    """Walk-forward metric rows. Calibration uses the newest slice of the training dates unless asked otherwise."""
    parts = []
    for k, tr, te in walk_forward(df, n_splits):
        if calibrate_on_test:
            fit, cal = tr, te
        else:
            fit, _, cal = split_by_date(tr, 0.0, held_out)
        models = calibrate(train(fit, features, half_life, params), cal)
        parts.append(evaluate(te, predict(models, te)).select(F.lit(k).alias("fold"), *METRICS))
    return _union(parts)


def sweep_params(df: DataFrame, features: Sequence[str], grid: Sequence[dict], n_splits: int = 3) -> DataFrame:
    """Parameter sets by mean walk-forward log-loss, best first, with their mean recovery alongside."""
    parts = []
    for i, params in enumerate(grid):
        half = params.get("half_life")
        tree = {k: v for k, v in params.items() if k != "half_life"}
        rows = run_folds(df, features, n_splits, half, tree)
        parts.append(rows.agg(F.avg("win_logloss").alias("win_logloss"), F.avg("recovery_rate").alias("recovery_rate"))
                     .select(F.lit(i).alias("number"), F.lit(str(sorted(params.items()))).alias("params"), "*"))
    return _union(parts).orderBy("win_logloss")
