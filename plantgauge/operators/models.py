"""Fitted models over window means: moments, principal components, Mahalanobis distance, isolation forest, regimes,
residual statistics and a reconstruction network.

Rows stay distributed. What is fitted is small: moments per key (N * N numbers), components, trees, or network
weights; samples for fits have bounds that are parameters.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_percentiles
from ..functions.stats import chi2_quantile
from .windows import KEY


def vectors(means: DataFrame, sensors: list[str], key: str = KEY) -> DataFrame:
    """(key, window_id, x array<double>) of the windows that hold every sensor."""
    x = F.array(*[F.col(s).cast("double") for s in sensors])
    return means.select(key, "window_id", x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def moments(rows: DataFrame, key: str = KEY) -> DataFrame:
    """(key, n, mean array<double>, cov array<double>): sample covariance, row by row, summed map-side.

    Each batch adds up its part about the batch's own mean; a partition combines its batches, and the partitions'
    parts (one row each per key) are combined exactly.
    """

    def add(a: tuple, b: tuple) -> tuple:
        d = b[1] - a[1]
        n = a[0] + b[0]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d).ravel() * (a[0] * b[0] / n)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for k, g in b.groupby(key, sort=False, dropna=False):
                x = np.stack(g["x"].to_numpy())
                mean = x.mean(0)
                one = (len(x), mean, ((x - mean).T @ (x - mean)).ravel())
                held[k] = add(held[k], one) if k in held else one
            if len(held) > 2000:
                yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=[key, "n", "mean", "scatter"])
                held = {}
        if held:
            yield pd.DataFrame([(k, *v) for k, v in held.items()], columns=[key, "n", "mean", "scatter"])

    def whole(g: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = None, None, None
        for r in g.itertuples():
            one = (r.n, np.asarray(r.mean), np.asarray(r.scatter))
            n, mean, scatter = one if n is None else add((n, mean, scatter), one)
        return pd.DataFrame({key: [g[key].iloc[0]], "n": [n], "mean": [mean], "cov": [scatter / max(n - 1, 1)]})

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(key, "x").mapInPandas(part, f"{key} {kind}, n long, mean array<double>, scatter array<double>")
    return parts.groupBy(key).applyInPandas(whole, f"{key} {kind}, n long, mean array<double>, cov array<double>")


def principal_components(stats: DataFrame, variance: float = 0.95, components: int | None = None, key: str = KEY) -> DataFrame:
    """(key, n, mean, k, explained array<double>, basis array<array<double>>): the first k components reaching the
    share of variance (or as many as given); each has its largest loading positive."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        size = len(r["mean"])
        values, vecs = np.linalg.eigh(np.asarray(r["cov"]).reshape(size, size))
        values, vecs = np.clip(values[::-1], 0, None), vecs[:, ::-1].T
        vecs = vecs * np.sign(vecs[np.arange(size), np.abs(vecs).argmax(1)])[:, None]
        share = values / values.sum() if values.sum() > 0 else np.zeros(size)
        k = components or int(min(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1, size))
        return pd.DataFrame({key: [r[key]], "n": [r["n"]], "mean": [r["mean"]], "k": [min(k, size)], "explained": [share], "basis": [list(vecs[: min(k, size)])]})

    kind = stats.schema[key].dataType.simpleString()
    return stats.groupBy(key).applyInPandas(fit, f"{key} {kind}, n long, mean array<double>, k int, explained array<double>, basis array<array<double>>")


def latent_size(stats: DataFrame, variance: float = 0.95, floor: int = 4, key: str = KEY) -> DataFrame:
    """(key, latent): components that reach the share of variance, at least `floor`, at most the sensors."""
    return principal_components(stats, variance, key=key).select(key, F.least(F.size("mean"), F.greatest(F.lit(floor), F.col("k"))).alias("latent"))


def _with(rows: DataFrame, model: DataFrame, key: str, *columns: str) -> DataFrame:
    m = model.select(F.col(key).alias("_key"), *columns)
    return rows.join(m, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def component_scores(rows: DataFrame, model: DataFrame, key: str = KEY) -> DataFrame:
    """`rows` with scores (on each component) and error: the mean squared difference to the reconstruction."""
    centred = _with(rows, model, key, "mean", "basis").withColumn("_d", F.zip_with("x", "mean", lambda x, m: x - m))
    scored = centred.withColumn("scores", F.transform("basis", lambda v: dot(v, F.col("_d"))))
    left = dot(F.col("_d"), F.col("_d")) - dot(F.col("scores"), F.col("scores"))
    return scored.withColumn("error", F.greatest(left, F.lit(0.0)) / F.size("x")).drop("_d", "mean", "basis")


def pca_outliers(rows: DataFrame, variance: float = 0.95, std: float = 3.0, key: str = KEY) -> DataFrame:
    """(key, window_id, error, outlier): errors above their mean by `std` population deviations."""
    scored = component_scores(rows, principal_components(moments(rows, key), variance, key=key), key)
    cut = scored.groupBy(F.col(key).alias("_key")).agg((F.avg("error") + std * F.stddev_pop("error")).alias("_cut"))
    return scored.join(cut, F.col(key).eqNullSafe(F.col("_key"))).select(key, "window_id", "error", (F.col("error") > F.col("_cut")).alias("outlier"))


def mahalanobis_outliers(rows: DataFrame, percentile: float = 97.5, ridge: float = 1e-6, key: str = KEY) -> DataFrame:
    """(key, window_id, distance, outlier): distance above the square root of the chi-squared percentile."""

    def invert(g: pd.DataFrame) -> pd.DataFrame:
        r = g.iloc[0]
        size = len(r["mean"])
        cov = np.asarray(r["cov"]).reshape(size, size) + ridge * np.eye(size)
        try:
            inverse = np.linalg.inv(cov)
        except np.linalg.LinAlgError:
            inverse = np.linalg.pinv(cov)
        return pd.DataFrame({key: [r[key]], "mean": [r["mean"]], "inverse": [list(inverse)], "cut": [math.sqrt(chi2_quantile(percentile / 100, size))]})

    kind = rows.schema[key].dataType.simpleString()
    fitted = moments(rows, key).groupBy(key).applyInPandas(invert, f"{key} {kind}, mean array<double>, inverse array<array<double>>, cut double")
    d = _with(rows, fitted, key, "mean", "inverse", "cut").withColumn("_d", F.zip_with("x", "mean", lambda x, m: x - m))
    distance = F.sqrt(F.greatest(dot(F.col("_d"), F.transform("inverse", lambda v: dot(v, F.col("_d")))), F.lit(0.0)))
    return d.withColumn("distance", distance).select(key, "window_id", "distance", (F.col("distance") > F.col("cut")).alias("outlier"))


def path_length(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int, sample: int, rng: np.random.Generator) -> np.ndarray:
    """Isolation trees as rows (feature, cut, left, right, depth); feature -1 marks a leaf, its cut the path length."""
    out: list[list[float]] = []
    size = min(sample, len(x))
    limit = math.ceil(math.log2(max(size, 2)))
    for _ in range(trees):
        stack = [(x[rng.choice(len(x), size, replace=False)], 0, -1, 0)]
        root = len(out)
        while stack:
            rows, depth, parent, side = stack.pop()
            at = len(out)
            if parent >= 0:
                out[parent][2 + side] = at
            spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
            if depth >= limit or len(rows) <= 1 or not (spread > 0).any():
                out.append([-1, depth + path_length(len(rows)), -1, -1, float(at == root)])
                continue
            f = int(rng.choice(np.flatnonzero(spread > 0)))
            cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
            out.append([f, cut, -1, -1, float(at == root)])
            stack += [(rows[rows[:, f] < cut], depth + 1, at, 0), (rows[rows[:, f] >= cut], depth + 1, at, 1)]
    return np.array(out)


def forest_scores(x: np.ndarray, forest: np.ndarray, sample: int) -> np.ndarray:
    """Isolation score in (0, 1) of each row: high for rows that are cut off early."""
    roots = np.flatnonzero(forest[:, 4] == 1)
    total = np.zeros(len(x))
    for root in roots:
        at = np.full(len(x), root)
        while True:
            f = forest[at, 0].astype(int)
            open_ = f >= 0
            if not open_.any():
                break
            i = np.flatnonzero(open_)
            left = x[i, f[i]] < forest[at[i], 1]
            at[i] = np.where(left, forest[at[i], 2], forest[at[i], 3]).astype(int)
        total += forest[at, 1]
    return 2 ** (-total / len(roots) / max(path_length(sample), 1e-9))


def isolation_outliers(rows: DataFrame, contamination: float = 0.05, trees: int = 200, sample: int = 256, fit_rows: int = 51_200, task_rows: int = 65_536, seed: int = 42, key: str = KEY) -> DataFrame:
    """(key, window_id, score, outlier): the highest `contamination` share of scores, as a linear percentile.

    A key's trees are grown on at most `fit_rows` of its rows, those of smallest hash, by default as many as all trees
    draw together; every row is scored.
    """
    kind = rows.schema[key].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("window_id", F.lit(seed)), "window_id"))
    share = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    # thinned by hash before they are ranked, so that a hot key's rows don't meet in one task
    thin = rows.join(share, F.col(key).eqNullSafe(F.col("_key"))).where(F.pmod(F.xxhash64("window_id", F.lit(seed)), F.lit(1 << 20)) < F.greatest(F.lit(1), F.ceil(F.lit(2.0 * fit_rows * (1 << 20)) / F.col("_n"))))
    chosen = thin.withColumn("_r", place).where(F.col("_r") <= fit_rows).select(key, "_r", "x")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g.sort_values("_r")["x"].to_numpy())
        forest = grow_forest(x, trees, sample, np.random.default_rng(seed))
        return pd.DataFrame({key: [g[key].iloc[0]], "forest": [forest.ravel()], "size": [min(sample, len(x))]})

    model = chosen.groupBy(key).applyInPandas(fit, f"{key} {kind}, forest array<double>, size int")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "window_id": [], "score": []})
        forest = np.asarray(right["forest"].iloc[0]).reshape(-1, 5)
        return pd.DataFrame({key: left[key], "window_id": left["window_id"], "score": forest_scores(np.stack(left["x"].to_numpy()), forest, int(right["size"].iloc[0]))})

    # keys are salted by their size, so that a task holds about `task_rows` rows; each salt of a key gets a copy of its trees
    salts = F.ceil(F.col("_n") / float(task_rows)).cast("long")
    a = _with(rows, share.select(F.col("_key").alias(key), "_n"), key, "_n").withColumn("_salt", F.pmod(F.xxhash64("window_id"), salts)).drop("_n")
    b = _with(model, share.select(F.col("_key").alias(key), "_n"), key, "_n").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_n")
    scored = a.groupBy(key, "_salt").cogroup(b.groupBy(key, "_salt")).applyInPandas(score, f"{key} {kind}, window_id long, score double")
    cut = exact_percentiles(scored, [key], "score", {"_cut": 1 - contamination}).select(F.col(key).alias("_key"), "_cut")
    return scored.join(cut, F.col(key).eqNullSafe(F.col("_key"))).select(key, "window_id", "score", (F.col("score") > F.col("_cut")).alias("outlier"))


def regimes(rows: DataFrame, k: int = 3, seed: int = 42, starts: int = 10, by: str = "x") -> DataFrame:
    """`rows` with regime: clusters of the vectors, the best of `starts` runs, numbered by their first coordinate."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("_v", array_to_vector(by)).cache()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="_c", maxIter=50).fit(data) for i in range(starts)]
    finally:
        data.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = np.argsort([c[0] for c in best.clusterCenters()], kind="stable")
    rank = F.create_map(*[F.lit(int(x)) for c, r in zip(order, range(len(order)), strict=True) for x in (c, r)])
    return best.transform(rows.withColumn("_v", array_to_vector(by))).withColumn("regime", rank[F.col("_c")]).drop("_v", "_c")


def regime_names(k: int) -> list[str]:
    """Low, Medium, High for three; numbered else. -1 is Transient."""
    return ["Low", "Medium", "High"] if k == 3 else [f"Regime {i}" for i in range(k)]


def regimes_by_components(rows: DataFrame, k: int = 3, components: int = 3, key: str = KEY, **options) -> DataFrame:
    """Regimes of the scores on the first components, where no feature column is known."""
    scored = component_scores(rows, principal_components(moments(rows, key), components=components, key=key), key)
    return regimes(scored, k, by="scores", **options).drop("scores", "error")


def residual_statistics(rows: DataFrame, sensors: list[str], reference: Column, key: str = KEY) -> DataFrame:
    """(key, window_id, mse, mean_z2, max_z, top_sensor): residuals (wide columns) against their mean and deviation
    (at least 1e-6) over the rows where `reference` holds; per window the means and the largest |z| of its rows."""
    stats = rows.where(reference).groupBy(F.col(key).alias("_key")).agg(*[F.avg(s).alias(f"_m_{s}") for s in sensors], *[F.greatest(F.stddev_pop(s), F.lit(1e-6)).alias(f"_s_{s}") for s in sensors])
    z = {s: (F.col(s) - F.col(f"_m_{s}")) / F.col(f"_s_{s}") for s in sensors}
    joined = rows.join(stats, F.col(key).eqNullSafe(F.col("_key")))
    from .windows import mean_of

    top = F.array_max(F.array(*[F.struct(F.abs(z[s]).alias("z"), F.lit(s).alias("sensor")) for s in sensors]))
    each = joined.select(key, "window_id", mean_of([F.pow(F.col(s), F.lit(2)) for s in sensors]).alias("_r2"), mean_of([F.pow(z[s], F.lit(2)) for s in sensors]).alias("_z2"), top.alias("_t"))
    return each.groupBy(key, "window_id").agg(F.avg("_r2").alias("mse"), F.avg("_z2").alias("mean_z2"), F.max("_t").alias("_t")).select(key, "window_id", "mse", "mean_z2", F.col("_t.z").alias("max_z"), F.col("_t.sensor").alias("top_sensor"))


def ledoit_wolf(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(shrunk covariance, shrinkage) towards the scaled identity."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min((((x**2).T @ (x**2)) / n - s**2).sum() / n / p, d2)
    a = 0.0 if d2 == 0 else b2 / d2
    return (1 - a) * s + a * mu * np.eye(p), a


def trimmed(rows: DataFrame, error: str, pct: float, key: str = KEY) -> DataFrame:
    """`rows` without the worst `pct` percent by error."""
    cut = exact_percentiles(rows, [key], error, {"_cut": 1 - pct / 100}).select(F.col(key).alias("_key"), "_cut")
    return rows.join(cut, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(error) <= F.col("_cut")).drop("_key", "_cut")


def hidden_widths(sensors: int, latent: int, most: int = 3) -> list[int]:
    """Widths halved from the sensors on, as long as they are above the latent size, `most` of them."""
    out, width = [], sensors // 2
    while width > latent and len(out) < most:
        out.append(width)
        width //= 2
    return out


class Network:
    """A dense encoder and decoder on NumPy: linear, layer norm, ReLU and dropout between, linear ends; Adam."""

    def __init__(self, sensors: int, latent: int, widths: list[int] | None = None, dropout: float = 0.0, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        widths = hidden_widths(sensors, latent) if widths is None else widths
        sizes = [sensors, *widths, latent, *widths[::-1], sensors]
        self.linear_after = {len(widths), len(sizes) - 2}  # the code and the output have no activation
        self.dropout = dropout
        self.w = [self.rng.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def forward(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, list]:
        tape = []
        for i, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            h = x @ w + b
            if i in self.linear_after:
                tape.append((x, None, None, None, None))
            else:
                sd = np.sqrt(h.var(1, keepdims=True) + 1e-5)
                norm = (h - h.mean(1, keepdims=True)) / sd
                keep = (self.rng.random(h.shape) >= self.dropout) / (1 - self.dropout) if train and self.dropout else 1.0
                tape.append((x, norm, sd, norm > 0, keep))
                h = np.maximum(norm, 0) * keep
            x = h
        return x, tape

    def encode(self, x: np.ndarray) -> np.ndarray:
        for i in range(min(self.linear_after) + 1):
            x = x @ self.w[i] + self.b[i]
            if i not in self.linear_after:
                x = np.maximum((x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5), 0)
        return x

    def gradients(self, x: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        y, tape = self.forward(x, True)
        g = 2 * (y - x) / x.size
        gw, gb = [], []
        for w, (inp, norm, sd, on, keep) in zip(self.w[::-1], tape[::-1], strict=True):
            if norm is not None:
                g = g * keep * on
                g = (g - g.mean(1, keepdims=True) - norm * (g * norm).mean(1, keepdims=True)) / sd
            gw.append(inp.T @ g)
            gb.append(g.sum(0))
            g = g @ w.T
        return float(((y - x) ** 2).mean()), gw[::-1], gb[::-1]

    def loss(self, x: np.ndarray) -> float:
        return float(((self.forward(x)[0] - x) ** 2).mean()) if len(x) else float("nan")


class Adam:
    """Adam with L2 over a network's weights; its state can be averaged over partitions like the weights."""

    def __init__(self, net: Network):
        self.m = [np.zeros_like(p) for p in (*net.w, *net.b)]
        self.v = [np.zeros_like(p) for p in (*net.w, *net.b)]
        self.step = 0

    def epoch(self, net: Network, x: np.ndarray, batch: int, rate: float, decay: float, rng: np.random.Generator) -> list[float]:
        """One pass over the rows in mini-batches of random order; the loss before each step."""
        losses, order = [], rng.permutation(len(x))
        for at in range(0, len(order), batch):
            loss, gw, gb = net.gradients(x[order[at : at + batch]])
            losses.append(loss)
            self.step += 1
            for p, g, m, v in zip((*net.w, *net.b), (*gw, *gb), self.m, self.v, strict=True):
                g = g + decay * p
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
        return losses


class Stack:
    """Networks of equal hidden widths with their optimisers, trained side by side on the same mini-batches.

    Arrays are (network, width, row), so one NumPy call does a layer of all networks. A layer's weights have the bias as
    their last column, and inputs a last row of ones. Narrower codes are filled up with zeros, which stay zeros. The mean
    that a layer norm takes off is taken off the weights, and off their gradients, instead of each row's values.
    """

    def __init__(self, nets: list[Network], adams: list[Adam], rates: list[float]):
        self.nets, self.adams, self.step = nets, adams, adams[0].step
        self.linear_after = nets[0].linear_after
        self.shapes = [(len(nets), max(n.w[i].shape[1] for n in nets), max(n.w[i].shape[0] for n in nets) + 1) for i in range(len(nets[0].w))]
        self.ends = np.cumsum([0, *map(math.prod, self.shapes)])
        self.p, self.m, self.v, self.g, self.rate = (np.zeros(self.ends[-1]) for _ in range(5))
        self.w, self.gw = self.layers(self.p), self.layers(self.g)
        for mine, other in self.pairs():
            mine[...] = other
        for r in self.layers(self.rate):
            r[...] = np.reshape(rates, (-1, 1, 1))
        self.dropping = np.flatnonzero([n.dropout for n in nets])
        share = np.array([nets[i].dropout for i in self.dropping]).reshape(-1, 1, 1)
        self.dropped, self.kept = np.round(share * 2**32).astype(np.uint32), 1 / (1 - share)
        self.rooms: dict = {}

    @staticmethod
    def of(nets: list[tuple[int, Network, Adam, float]]) -> list[tuple[list[int], Stack]]:
        """Stacks of the networks with their numbers."""
        alike: dict = {}
        for one in nets:
            widths = tuple(len(b) for i, b in enumerate(one[1].b) if i not in one[1].linear_after)
            alike.setdefault((widths, one[2].step), []).append(one)
        return [([i for i, *_ in some], Stack(*[list(x) for x in list(zip(*some, strict=True))[1:]])) for some in alike.values()]

    def layers(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[a:b].reshape(s) for a, b, s in zip(self.ends, self.ends[1:], self.shapes, strict=False)]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each array of the networks and optimisers, behind the part of the stack that stands for it."""
        for flat, own in ((self.p, [(*n.w, *n.b) for n in self.nets]), (self.m, [a.m for a in self.adams]), (self.v, [a.v for a in self.adams])):
            for i, layer in enumerate(self.layers(flat)):
                for k, arrays in enumerate(own):
                    w, b = arrays[i], arrays[len(self.shapes) + i]
                    yield layer[k, : w.shape[1], : w.shape[0]], w.T
                    yield layer[k, : len(b), -1], b

    def hand_back(self) -> None:
        """Writes weights and optimisers' states into the networks and optimisers."""
        for mine, other in self.pairs():
            other[...] = mine
        for a in self.adams:
            a.step = self.step

    def room(self, name: str, i: int, width: int, rows: int) -> np.ndarray:
        """(network, width, row) memory that is used again by each mini-batch."""
        size = len(self.nets) * width * rows
        if len(self.rooms.get((name, i), ())) < size:
            self.rooms[name, i] = np.empty(size)
        return self.rooms[name, i][:size].reshape(len(self.nets), width, rows)

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """x: (sensor, row), and a last row of ones. Drops out if there is a rng."""
        rows, tape, last = x.shape[1], [], len(self.w) - 1
        for i, w in enumerate(self.w):
            wide = w.shape[1]
            act = self.room("act", i, wide + (i < last), rows)
            if i < last:
                act[:, -1] = 1
            h = act[:, :wide] if i in self.linear_after else self.room("norm", i, wide, rows)
            if i not in self.linear_after:
                w = w - w.mean(1, keepdims=True)
            if i:
                np.matmul(w, x, out=h)
            else:
                h[...] = (w.reshape(-1, len(x)) @ x).reshape(h.shape)
            if i in self.linear_after:
                tape.append((x, w, None, None, None))
            else:
                inv = np.add.reduce(np.multiply(h, h, out=self.room("work", i, wide, rows)), 1, keepdims=True)
                inv /= wide
                inv += 1e-5
                np.sqrt(inv, out=inv)
                np.reciprocal(inv, out=inv)
                h *= inv
                a = np.maximum(h, 0, out=act[:, :wide])
                if rng is not None and len(self.dropping):
                    size = len(self.dropping) * wide * rows
                    drawn = rng.bit_generator.random_raw(size // 2 + 1).view(np.uint32)[:size].reshape(-1, wide, rows)
                    keep = (drawn >= self.dropped) * self.kept
                    for k, j in enumerate(self.dropping):
                        a[j] *= keep[k]
                tape.append((x, w, h, inv, a))
            x = act
        return x, tape

    def off(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, list]:
        """Each network's mean squared error, the errors, and what the way back needs."""
        y, tape = self.forward(x, rng)
        y -= x[:-1]
        flat = y.reshape(len(self.nets), -1)
        return np.einsum("ij,ij->i", flat, flat) / flat.shape[1], y, tape

    def gradients(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        loss, g, tape = self.off(x, rng)
        for i in range(len(tape) - 1, -1, -1):
            inp, w, norm, inv, a = tape[i]
            if norm is not None:
                g *= a > 0
                for k, j in enumerate(self.dropping):
                    g[j] *= self.kept[k, 0, 0]
                along = np.multiply(g, norm, out=self.room("work", i, *g.shape[1:]))
                np.multiply(norm, np.add.reduce(along, 1, keepdims=True) / g.shape[1], out=along)
                g -= along
                g *= inv
            if i:
                np.matmul(g, inp.transpose(0, 2, 1), out=self.gw[i])
            else:
                self.gw[0][...] = (g.reshape(-1, g.shape[2]) @ inp.T).reshape(self.shapes[0])
            if norm is not None:
                self.gw[i] -= self.gw[i].mean(1, keepdims=True)
            if i:
                g = np.matmul(w[:, :, :-1].transpose(0, 2, 1), g, out=self.room("back", i, w.shape[2] - 1, g.shape[2]))
        self.g *= 2 / ((len(x) - 1) * x.shape[1])
        return loss

    def epoch(self, x: np.ndarray, batch: int, decay: float, rng: np.random.Generator) -> np.ndarray:
        """As `Adam.epoch`, of rows as (sensor, row): the mean of the losses before each step, per network."""
        x, losses = np.vstack([x, np.ones(x.shape[1])])[:, rng.permutation(x.shape[1])], []
        p, m, v, g = self.p, self.m, self.v, self.g
        for at in range(0, x.shape[1], batch):
            losses.append(self.gradients(x[:, at : at + batch], rng))
            self.step += 1
            g += decay * p
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            g *= g
            g *= 0.001
            v += g
            np.sqrt(v, out=g)
            g /= math.sqrt(1 - 0.999**self.step)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= self.rate / (1 - 0.9**self.step)
            p -= g
        return np.mean(losses, axis=0)

    def loss(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        """Each network's mean squared error of rows as (sensor, row)."""
        x = np.vstack([x, np.ones(x.shape[1])])
        return sum(self.off(x[:, at : at + batch])[0] * min(batch, x.shape[1] - at) for at in range(0, x.shape[1], batch)) / x.shape[1]


class Progress:
    """Early stop, halved rate on a plateau, and the best weights so far of one network in training."""

    def __init__(self, net: Network, rate: float, patience: int):
        self.net, self.rate, self.patience = net, rate, patience
        self.best, self.kept, self.since, self.history = math.inf, None, 0, []

    def goes_on(self, train_loss: float, val_loss: float) -> bool:
        """Takes in what an epoch came to; False if training is to end."""
        self.history.append({"epoch": len(self.history), "train_loss": train_loss, "val_loss": val_loss, "rate": self.rate})
        if val_loss < self.best - 1e-12:
            self.best, self.kept, self.since = val_loss, [p.copy() for p in (*self.net.w, *self.net.b)], 0
            return True
        self.since += 1
        if self.since % 5 == 0:
            self.rate /= 2
        return self.since < self.patience

    def finish(self) -> list[dict]:
        if self.kept:
            self.net.w, self.net.b = self.kept[: len(self.net.w)], self.kept[len(self.net.w) :]
        return self.history


def train_network(net: Network, train: np.ndarray, val: np.ndarray, epochs: int = 50, batch: int = 256, rate: float = 1e-3, decay: float = 1e-5, patience: int = 10) -> list[dict]:
    """Mini-batches of Adam on arrays in memory; the best epoch's weights are kept. Returns the history."""
    adam, progress = Adam(net), Progress(net, rate, patience)
    for _ in range(epochs):
        losses = adam.epoch(net, train, batch, progress.rate, decay, net.rng)
        if not progress.goes_on(float(np.mean(losses)), net.loss(val)):
            break
    return progress.finish()


def fit_networks(rows: DataFrame, sensors: list[str], nets: list[Network], rates: list[float], split: str = "split", epochs: int = 150, batch: int = 256, decay: float = 1e-5, patience: int = 10, seed: int = 42, least_steps: int = 64) -> list[list[dict]]:
    """Trains networks in place, side by side, on all rows of the splits `train` and `val` that hold every sensor.

    An epoch is one pass: each partition takes its training rows in mini-batches from the common weights on, and the
    partitions' weights and optimiser states are averaged by their rows (iterative parameter mixing). The same pass
    tells the validation loss of the weights that it began with, so the history of an epoch is complete after the
    next. The driver gets one row of weights per partition and network, whatever the number of rows. Few rows are
    put together, so that a partition takes at least `least_steps` mini-batches an epoch.
    """
    spark = rows.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                train = b.column(0).to_numpy(zero_copy_only=False)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), *[pa.array([x[:, m].tobytes()], pa.binary()) for m in (train, ~train)]], names=["n", "train", "val"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Training and validation rows, as (sensor, row), of packs put together up to `least_steps` mini-batches."""
        some: list[list[np.ndarray]] = [[], []]
        for b in batches:
            for r in range(b.num_rows):
                for of, c in zip(some, b.columns[1:], strict=True):
                    of.append(np.frombuffer(c[r].as_buffer()).reshape(len(sensors), -1))
                if sum(x.shape[1] for of in some for x in of) >= least_steps * batch:
                    yield np.hstack(some[0]), np.hstack(some[1])
                    some = [[], []]
        if some[0]:
            yield np.hstack(some[0]), np.hstack(some[1])

    chosen = rows.where(F.col(split).isin("train", "val")).dropna(subset=sensors).select((F.col(split) == "train").alias("_train"), *[F.col(s).cast("double") for s in sensors])
    held = chosen.mapInArrow(pack, "n long, train binary, val binary").persist()
    few = max((held.agg(F.sum("n")).first()[0] or 0) // (least_steps * batch), 1)
    passed = held.coalesce(few) if few < held.rdd.getNumPartitions() else held
    adams = [Adam(n) for n in nets]
    progress = [Progress(n, r, patience) for n, r in zip(nets, rates, strict=True)]
    losses: list[float] = [math.nan] * len(nets)
    live = list(range(len(nets)))
    schema = "i int, n long, loss double, n_val long, val_loss double, step long, state array<double>"
    try:
        for epoch in range(epochs + 1):
            shared = spark.sparkContext.broadcast([(i, nets[i], adams[i], progress[i].rate) for i in live])

            def part(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
                from pyspark import TaskContext

                rng = np.random.default_rng((seed, epoch, TaskContext.get().partitionId()))
                work = copy.deepcopy(shared.value)
                told = {i: [0, 0.0, 0, 0.0] for i, *_ in work}
                stacks = Stack.of(work)
                before = Stack.of(work)
                for train, val in together(batches):
                    for (own, stack), (_, old) in zip(stacks, before, strict=True):
                        if val.size:
                            for i, x in zip(own, old.loss(val), strict=True):
                                told[i][2] += val.shape[1]
                                told[i][3] += x * val.shape[1]
                        if train.size and epoch < epochs:
                            for i, x in zip(own, stack.epoch(train, batch, decay, rng), strict=True):
                                told[i][0] += train.shape[1]
                                told[i][1] += x * train.shape[1]
                for _, stack in stacks:
                    stack.hand_back()
                out = [(i, *told[i], adam.step, np.concatenate([p.ravel() for p in (*net.w, *net.b, *adam.m, *adam.v)])) for i, net, adam, _ in work if told[i][0] or told[i][2]]
                if out:
                    columns = zip(*out, strict=True)
                    kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["i", "n", "loss", "n_val", "val_loss", "step", "state"])

            got = passed.mapInArrow(part, schema).collect()
            shared.unpersist()
            for i in list(live):
                mine = [r for r in got if r.i == i]
                n, n_val = sum(r.n for r in mine), sum(r.n_val for r in mine)
                if epoch and not progress[i].goes_on(losses[i], sum(r.val_loss for r in mine) / n_val if n_val else math.nan):
                    live.remove(i)
                    continue
                if not n:
                    live.remove(i)
                    continue
                losses[i] = sum(r.loss for r in mine) / n
                flat = np.sum([np.asarray(r.state) * (r.n / n) for r in mine if r.n], axis=0)
                adams[i].step = max(r.step for r in mine)
                at = 0
                for p in (*nets[i].w, *nets[i].b, *adams[i].m, *adams[i].v):
                    p[...] = flat[at : at + p.size].reshape(p.shape)
                    at += p.size
            if not live:
                break
    finally:
        held.unpersist()
    return [p.finish() for p in progress]


def fit_network_everywhere(rows: DataFrame, sensors: list[str], latent: int = 3, rate: float = 1e-3, seed: int = 42, **options) -> tuple[Network, list[dict]]:
    """One network trained on all rows; see `fit_networks`."""
    net = Network(len(sensors), latent, seed=seed)
    return net, fit_networks(rows, sensors, [net], [rate], seed=seed, **options)[0]


def network_errors(rows: DataFrame, sensors: list[str], net: Network, key: str = KEY) -> DataFrame:
    """(key, window_id, row_in_window, row_error) of the rows that hold every sensor, by Arrow batches."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[3:]], 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(((net.forward(x)[0] - x) ** 2).mean(1))], names=[key, "window_id", "row_in_window", "row_error"])

    return rows.dropna(subset=sensors).select(key, "window_id", "row_in_window", *sensors).mapInArrow(run, f"{key} {kind}, window_id long, row_in_window int, row_error double")


def network_sensor_errors(rows: DataFrame, sensors: list[str], net: Network, key: str = KEY) -> DataFrame:
    """(key, window_id, sensor, error): mean squared error of each sensor over a window's rows that hold every sensor."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema[key].dataType.simpleString()
    kinds = ", ".join(f"`{s}` double" for s in sensors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[2:]], 1)
                off = (shared.value.forward(x)[0] - x) ** 2
                yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(c) for c in off.T]], names=[key, "window_id", *sensors])

    off = rows.dropna(subset=sensors).select(key, "window_id", *[F.col(s).cast("double") for s in sensors]).mapInArrow(run, f"{key} {kind}, window_id long, {kinds}")
    means = [F.struct(F.lit(s).alias("sensor"), F.avg(s).alias("error")).alias(s) for s in sensors]
    return off.groupBy(key, "window_id").agg(*means).select(key, "window_id", F.inline(F.array(*sensors)))


def grid_search(rows: DataFrame, sensors: list[str], latents: tuple[int, ...] = (2, 3, 4), rates: tuple[float, ...] = (1e-3, 3e-3), dropouts: tuple[float, ...] = (0.0, 0.1), **options) -> DataFrame:
    """(latent, rate, dropout, epochs, val_loss, best): all combinations trained side by side on all rows, each until
    it stops by itself; the first of equal losses is best."""
    combos = [(a, b, c) for a in latents for b in rates for c in dropouts]
    nets = [Network(len(sensors), a, dropout=c) for a, _, c in combos]
    histories = fit_networks(rows, sensors, nets, [b for _, b, _ in combos], **options)
    losses = [min((h["val_loss"] for h in history), default=math.nan) for history in histories]
    first = int(np.nanargmin(losses)) if not np.isnan(losses).all() else -1
    tried = [(*combo, len(h), x, i == first) for i, (combo, h, x) in enumerate(zip(combos, histories, losses, strict=True))]
    return rows.sparkSession.createDataFrame(tried, "latent int, rate double, dropout double, epochs int, val_loss double, best boolean")
