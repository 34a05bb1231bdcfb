"""Regression around kriging: encoding, splits, learners, search, selection, importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import dense_id, seeded_hash, stratified_sample
from .support import Fits

SEED = 42
TEST_RATIO = 0.2
RIDGE_ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
SVR_GRID = {"C": (3.0, 10.0, 30.0, 100.0), "epsilon": (0.05, 0.1, 0.3), "gamma": ("scale", 0.1, 0.03, 0.01)}
FOREST_DRAWS = {"numTrees": (300, 899), "maxDepth": (6, 30), "minInstancesPerNode": (1, 7), "subset": (0.3, 1.0), "bootstrap": (0, 1)}
SAMPLE_ROWS = 5000  # labelled rows that a dense solver takes at most


def metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """r2 (1 - residual / total squares), rmse and n over rows that have both."""
    rows = df.select(F.col(truth).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).filter("y is not null and p is not null")
    sums = rows.agg(
        F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("res"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("tot"),
        F.count(F.lit(1)).alias("n"),
    )
    return sums.select((1 - F.col("res") / F.nullif("tot", F.lit(0.0))).alias("r2"), F.sqrt(F.col("res") / F.nullif("n", F.lit(0))).alias("rmse"), "n")


def standardise(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """``{c}_z``: centred and divided by the population deviation of ``fit_on`` (0 deviation counts as 1)."""
    stats = (fit_on if fit_on is not None else df).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(stats))  # one row
    z = {f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return joined.withColumns(z).drop(*stats.columns)


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """``{column}_{category}`` of 0 and 1; unknown and null rows are all 0."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("double"), F.lit(0.0)) for c in categories})


def encoder(numeric: list[str], category: str | None, to: str = "features") -> list:
    """Stages that one-hot the category (unseen: all 0) and join it with the numbers."""
    if category is None:
        return [VectorAssembler(inputCols=numeric, outputCol=to, handleInvalid="keep")]
    index = StringIndexer(inputCol=category, outputCol=f"_{category}_i", handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's slot for unseen values comes last and is what dropLast drops
    hot = OneHotEncoder(inputCols=[f"_{category}_i"], outputCols=[f"_{category}_v"], dropLast=True, handleInvalid="error")
    return [index, hot, VectorAssembler(inputCols=[*numeric, f"_{category}_v"], outputCol=to, handleInvalid="keep")]


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    """Names of an assembled vector's slots, from its metadata."""
    attrs = df.schema[features].metadata["ml_attr"]["attrs"]
    return [a["name"] for _, a in sorted((a["idx"], a) for kind in attrs.values() for a in kind)]


def hash_split(df: DataFrame, key: str, ratio: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """``is_test`` by a seeded hash of the key."""
    return df.withColumn("is_test", seeded_hash(key, seed) % 100 < round(100 * ratio))


def spatial_clusters(df: DataFrame, x: str = "x", y: str = "y", low: int = 10, high: int = 80, seed: int = SEED) -> DataFrame:
    """``cluster``: k-means of positions with k = floor(clip(sqrt(n), low, high))."""
    n = df.count()
    k = max(1, min(int(np.clip(np.sqrt(n), low, high)), n))
    data = VectorAssembler(inputCols=[x, y], outputCol="_at").transform(df)
    model = KMeans(k=max(2, k), seed=seed, featuresCol="_at", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_at")


def spatial_split(df: DataFrame, key: str, x: str = "x", y: str = "y", ratio: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """``cluster`` and ``is_test``: a share of every cluster of more than four."""
    return stratified_sample(spatial_clusters(df, x, y, seed=seed), "cluster", key, ratio, 5, seed)


def group_folds(sizes: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """``fold`` of each group: largest first into the fold that has least so far.

    ``sizes`` has one row a group (``n``): spatial clusters, at most a few dozen.
    """
    rows = sizes.orderBy(F.col("n").desc(), group).collect()
    load, out = [0] * max(1, min(n_folds, len(rows))), []
    for r in rows:
        fold = load.index(min(load))
        load[fold] += r["n"]
        out.append((r[group], fold))
    kind = sizes.schema[group].dataType.simpleString()
    return sizes.sparkSession.createDataFrame(out, f"{group} {kind}, fold int")


def forest(numeric: list[str], category: str | None, label: str, trees: int = 400, seed: int = SEED, depth: int = 30, **more) -> Pipeline:
    settings = {"featureSubsetStrategy": "all", "maxBins": 64} | more
    return Pipeline(stages=[*encoder(numeric, category), RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed, maxDepth=depth, predictionCol="pred", **settings)])


def least_squares(numeric: list[str], category: str | None, label: str) -> Pipeline:
    return Pipeline(stages=[*encoder(numeric, category), LinearRegression(labelCol=label, solver="normal", predictionCol="pred")])


def to_numpy(df: DataFrame, columns: list[str], limit: int = SAMPLE_ROWS) -> np.ndarray:
    """The labelled rows for a dense solver; more than ``limit`` are an error."""
    rows = df.select(*[F.col(c).cast("double") for c in columns]).limit(limit + 1).toPandas().to_numpy()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labelled rows; the dense solver takes at most {limit}")
    return rows


class Ridge:
    """Ridge regression on standardised columns; the penalty by leave-one-out error from sums alone."""

    def __init__(self, columns: list[str], alphas: tuple[float, ...] = RIDGE_ALPHAS):
        self.columns, self.alphas = columns, alphas

    def fit(self, df: DataFrame, label: str) -> Ridge:
        """Two passes over all rows: moments, then the leave-one-out errors of each penalty."""
        names = [*self.columns, label]
        rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
        at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        got = rows.agg(F.count(F.lit(1)), *[F.count(f"v{i}") for i in range(len(names))], *[F.avg(f"v{i}") for i in range(len(names))], *[F.covar_pop(f"v{i}", f"v{j}") for i, j in at]).first()
        n, seen, means = got[0], got[1 : 1 + len(names)], got[1 + len(names) : 1 + 2 * len(names)]
        if n == 0 or any(k < n for k in seen):
            raise ValueError(f"ridge regression needs rows without nulls in {names}")
        moments = np.zeros((len(names), len(names)))
        for (i, j), v in zip(at, got[1 + 2 * len(names) :], strict=True):
            moments[i, j] = moments[j, i] = v
        self.mean, self.centre = np.array(means[:-1]), means[-1]
        scale = np.sqrt(np.diag(moments)[:-1])
        self.scale = np.where(scale > 0, scale, 1.0)
        gram = n * moments[:-1, :-1] / np.outer(self.scale, self.scale)
        right = n * moments[:-1, -1] / self.scale
        inverses = [np.linalg.inv(gram + a * np.eye(len(scale))) for a in self.alphas]
        mean, scale, centre = self.mean, self.scale, self.centre

        def errors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = frame.to_numpy(float)
                z, y = (x[:, :-1] - mean) / scale, x[:, -1] - centre
                out = []
                for k in inverses:
                    lever = np.einsum("ij,jk,ik->i", z, k, z, optimize=True) + 1 / n
                    out.append(float((((y - z @ (k @ right)) / (1 - np.minimum(lever, 1 - 1e-9))) ** 2).sum()))
                yield pd.DataFrame([out], columns=[f"e{i}" for i in range(len(out))])

        parts = rows.mapInPandas(errors, ", ".join(f"e{i} double" for i in range(len(self.alphas))))
        scores = parts.agg(*[F.sum(c) for c in parts.columns]).first()
        best = int(np.argmin(scores))
        self.alpha, self.coef = self.alphas[best], inverses[best] @ right
        return self

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> Ridge:
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 0, scale, 1.0)
        z, self.centre = (x - self.mean) / self.scale, y.mean()
        left, s, right = np.linalg.svd(z, full_matrices=False)
        scores = []
        for a in self.alphas:
            part = s * s / (s * s + a)
            fitted = left @ (part * (left.T @ (y - self.centre)))
            lever = (left * left * part).sum(1) + 1 / len(y)
            scores.append(np.mean(((y - self.centre - fitted) / (1 - np.minimum(lever, 1 - 1e-9))) ** 2))
        self.alpha = self.alphas[int(np.argmin(scores))]
        self.coef = right.T @ (s / (s * s + self.alpha) * (left.T @ (y - self.centre)))
        return self

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return self.centre + ((x - self.mean) / self.scale) @ self.coef

    def transform(self, df: DataFrame, to: str = "pred") -> DataFrame:
        """A projection: no Python on the rows."""
        out = F.lit(float(self.centre))
        for c, m, s, b in zip(self.columns, self.mean, self.scale, self.coef, strict=True):
            out = out + (F.col(c).cast("double") - float(m)) * float(b / s)
        return df.withColumn(to, out)


class SVR:
    """Support vector regression with an RBF kernel, by coordinate descent on the dual."""

    def __init__(self, columns: list[str], C: float = 1.0, epsilon: float = 0.1, gamma: float | str = "scale", sweeps: int = 60):
        self.columns, self.C, self.epsilon, self.gamma, self.sweeps = columns, C, epsilon, gamma, sweeps

    def _kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a @ b.T  # in place from here, as it is the largest array of a fit
        d *= -2
        d += (a * a).sum(1)[:, None]
        d += (b * b).sum(1)
        np.maximum(d, 0.0, out=d)
        d *= -self.width
        np.exp(d, out=d)
        d += 1.0  # the added constant is the kernel of a bias
        return d

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> SVR:
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 0, scale, 1.0)
        self.centre, self.spread = y.mean(), y.std() or 1.0
        z, t = (x - self.mean) / self.scale, (y - self.centre) / self.spread
        self.width = 1.0 / (z.shape[1] * (z.var() or 1.0)) if self.gamma == "scale" else float(self.gamma)
        k = self._kernel(z, z)
        beta, fitted = np.zeros(len(t)), np.zeros(len(t))
        for _ in range(self.sweeps):
            most = 0.0
            for i in range(len(t)):
                free = t[i] - fitted[i] + beta[i] * k[i, i]
                new = np.clip(np.sign(free) * max(abs(free) - self.epsilon, 0.0) / k[i, i], -self.C, self.C)
                if (step := new - beta[i]) != 0.0:
                    fitted += step * k[i]
                    beta[i], most = new, max(most, abs(step))
            if most < 1e-4:
                break
        used = np.abs(beta) > 1e-12
        self.support, self.beta = z[used], beta[used]
        return self

    def fit(self, df: DataFrame, label: str) -> SVR:
        x = to_numpy(df, [*self.columns, label])
        return self.fit_arrays(x[:, :-1], x[:, -1])

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return self.centre + self.spread * (self._kernel(z, self.support) @ self.beta if len(self.beta) else np.zeros(len(z)))

    def transform(self, df: DataFrame, to: str = "pred") -> DataFrame:
        model, columns = self, self.columns

        @F.pandas_udf("double")
        def predict(*parts: pd.Series) -> pd.Series:
            return pd.Series(model.predict_arrays(np.column_stack([p.to_numpy(dtype=float) for p in parts])))

        return df.withColumn(to, predict(*[F.col(c).cast("double") for c in columns]))


class WideSVR(SVR):
    """The same regression for any number of rows (``support``); no task and no driver holds them."""

    def fit(self, df: DataFrame, label: str) -> WideSVR:
        setting = {"C": self.C, "epsilon": self.epsilon, "gamma": self.gamma}
        self.basis, self.at, self.centre, self.spread = Fits(df, self.columns, label, [setting]).weights(0)
        return self

    def predict_arrays(self, x: np.ndarray) -> np.ndarray:
        return self.centre + self.spread * (self.basis.features(x) @ self.at)


def support_vectors(df: DataFrame, columns: list[str], label: str, **setting) -> SVR:
    """An SVR fitted to all rows: dense while a task can hold the kernel of all pairs, else over their pivots."""
    few = len(df.select(F.lit(1)).limit(SAMPLE_ROWS + 1).collect()) <= SAMPLE_ROWS
    return (SVR if few else WideSVR)(columns, **setting).fit(df, label)


def score_r2(y: np.ndarray, p: np.ndarray) -> float:
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - p) ** 2).sum() / total) if total > 0 else 0.0


def grid_search(df: DataFrame, columns: list[str], label: str, fold: str, grid: dict | None = None) -> DataFrame:
    """Mean R2 over folds of every SVR setting; settings and folds are spread over the tasks.

    Up to SAMPLE_ROWS labelled rows go to every task; more are fitted where they are, all settings at once.
    """
    spark = df.sparkSession
    if len(df.select(F.lit(1)).limit(SAMPLE_ROWS + 1).collect()) > SAMPLE_ROWS:
        return _wide_search(df, columns, label, fold, grid or SVR_GRID)
    data = to_numpy(df, [*columns, label, fold])
    sent = spark.sparkContext.broadcast(data)
    grid = grid or SVR_GRID
    names = list(grid)
    folds = sorted(set(data[:, -1].astype(int).tolist()))
    settings = [(i, f, *map(str, values)) for i, values in enumerate(product(*grid.values())) for f in folds]
    asked = spark.createDataFrame(settings, ", ".join(["setting int", "fold int", *[f"{n} string" for n in names]])).repartition(len(settings), "setting", "fold")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        for frame in frames:
            scores = []
            for r in frame.itertuples(index=False):
                kept = {n: (v if (v := getattr(r, n)) == "scale" else float(v)) for n in names}
                test = rows[:, -1] == r.fold
                model = SVR(columns, **kept).fit_arrays(rows[~test, :-2], rows[~test, -2])
                scores.append(score_r2(rows[test, -2], model.predict_arrays(rows[test, :-2])))
            yield frame.assign(r2=scores)

    scored = asked.mapInPandas(run, ", ".join(["setting int", "fold int", *[f"{n} string" for n in names], "r2 double"]))
    return scored.groupBy("setting", *names).agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("n_folds"))


def _wide_search(df: DataFrame, columns: list[str], label: str, fold: str, grid: dict) -> DataFrame:
    names = list(grid)
    settings = [dict(zip(names, values, strict=True)) for values in product(*grid.values())]
    fits = Fits(df, columns, label, settings, fold)
    scores = np.reshape(fits.scores(), (len(settings), -1))
    rows = [(i, *[str(s[n]) for n in names], float(r.mean()), len(r)) for i, (s, r) in enumerate(zip(settings, scores, strict=True))]
    return df.sparkSession.createDataFrame(rows, ", ".join(["setting int", *[f"{n} string" for n in names], "mean_r2 double", "n_folds long"]))


def random_search(df: DataFrame, numeric: list[str], category: str | None, label: str, fold: str, draws: int = 30, seed: int = SEED, space: dict | None = None) -> list[dict]:
    """Random forest settings with their mean R2 over folds, best first."""
    rng, space, out = np.random.default_rng(seed), space or FOREST_DRAWS, []
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    for _ in range(draws):
        whole = lambda n: int(rng.integers(space[n][0], space[n][1] + 1))
        setting = {"trees": whole("numTrees"), "depth": whole("maxDepth"), "minInstancesPerNode": whole("minInstancesPerNode"),
                   "featureSubsetStrategy": str(round(float(rng.uniform(*space["subset"])), 3)), "bootstrap": bool(whole("bootstrap"))}
        scores = []
        for f in folds:
            model = forest(numeric, category, label, **setting).fit(df.filter(F.col(fold) != f))
            scores.append(metrics(model.transform(df.filter(F.col(fold) == f)), label, "pred").first().r2)
        out.append(setting | {"mean_r2": float(np.mean([s for s in scores if s is not None] or [0.0]))})
    return sorted(out, key=lambda s: -s["mean_r2"])


def importances(model, transformed: DataFrame) -> list[tuple[str, float]]:
    """Feature names with a forest's importances or the absolute coefficients, largest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return sorted(zip(feature_names(transformed), map(float, values), strict=True), key=lambda p: (-p[1], p[0]))


def iterative_selection(
    df: DataFrame, test: DataFrame, numeric: list[str], category: str | None, label: str, fold: str,
    rounds: int = 5, keep: float = 0.95, least: float = 1e-4, patience: int = 2, draws: int = 30, gain: float = 1e-4, space: dict | None = None,
) -> list[dict]:
    """Search, fit, prune by cumulative importance, again; stops after ``patience`` rounds without gain.

    A record per round; the round to use has the best ``cv_r2``.
    """
    history, best, stale = [], -np.inf, 0
    for number in range(1, rounds + 1):
        found = random_search(df, numeric, category, label, fold, draws, SEED + number, space)[0]
        setting = {k: v for k, v in found.items() if k != "mean_r2"}
        model = forest(numeric, category, label, **setting).fit(df)
        fitted = model.transform(df)
        seen, held = metrics(fitted, label, "pred").first(), metrics(model.transform(test), label, "pred").first()
        history.append({"round": number, "n_num": len(numeric), "n_cat": int(category is not None), "cv_r2": found["mean_r2"], "train_r2": seen.r2,
                        "train_rmse": seen.rmse, "test_r2": held.r2, "test_rmse": held.rmse, "setting": setting, "numeric": list(numeric), "category": category})
        stale = 0 if found["mean_r2"] > best + gain else stale + 1
        best = max(best, found["mean_r2"])
        if stale >= patience:
            break
        ranked, run = importances(model, fitted), 0.0
        total = sum(v for _, v in ranked) or 1.0
        kept = set()
        for name, value in ranked:
            run += value / total
            if run <= keep or value >= least:
                kept.add(name)
        numeric = [n for n in numeric if n in kept] or numeric[:1]
        if category is not None and not any(k.startswith(f"_{category}_v") for k in kept):
            category = None
    return history


def permutation_importance(df: DataFrame, columns: list[str], label: str, predict: Callable[[DataFrame], DataFrame], repeats: int = 10, seed: int = SEED) -> DataFrame:
    """Mean and deviation of the loss in R2 when one raw column is shuffled.

    A column is shuffled by joining it back on the rank of a seeded hash; each
    repeat takes another seed.  All rows count, and no task numbers them all.
    """
    from .. import storage

    spark = df.sparkSession
    hashed = lambda t, to, *of: dense_id(t.withColumn("_h", F.xxhash64(*of)), ["_h"], to).drop("_h")
    rows = storage.table(hashed(df, "_at", *columns, F.lit(seed)), "numbered")
    base = metrics(predict(rows), label, "pred").first().r2 or 0.0
    out = []
    for k, c in enumerate(columns):
        loss = []
        for again in range(repeats):
            moved = hashed(rows.select("_at", F.col(c).alias("_moved")), "_m", "_at", F.lit(seed + 1 + k * repeats + again))
            mixed = rows.join(moved.select(F.col("_m").alias("_at"), "_moved"), "_at").withColumn(c, F.col("_moved"))
            loss.append(base - (metrics(predict(mixed), label, "pred").first().r2 or 0.0))
        out.append((c, float(np.mean(loss)), float(np.std(loss))))
    return spark.createDataFrame(out, "feature string, importance_mean double, importance_std double")
