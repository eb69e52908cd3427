"""Chained equations: each variable regressed on the others, in rounds.

Linear predictors need no rows between rounds. A row with a given set of missing
variables is completed by an affine map of its observed values, the same for all
rows with that set, so the cross products every regression needs follow from one
table of moments per set. The data is read once to get those moments, whatever
the number of rounds; the maps, each V × V, are then applied as a join on the set
of missing variables. Moments and maps exist for sets that occur in the data. Up to
``MAX_SETS`` of them are held by the driver; more stay on the executors, in a table that carries each
set's moments and map, and the driver gets one sum a task for every regression (``chained_sets``).
The arithmetic is the same, so the choice changes no result beyond rounding.

The forest predictor cannot be reduced that way: it reads the rows for each forest and writes
each round to the checkpoint folder. Its model is a list of forests, kept apart from
the data it was fitted on. Tables of cells make the forests (``cell_forests``), beyond four variables Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import cell_forests, chained_sets
from .series import unfold


def to_wide(panel: DataFrame, variables, value: str = "value") -> DataFrame:
    """One row per station and step, one column per variable."""
    return panel.groupBy("station_id", "t").pivot("variable", list(variables)).agg(F.first(value))


def to_long(wide: DataFrame, variables, name: str = "value", extra=()) -> DataFrame:
    return unfold(wide, variables, ["station_id", "t", *extra], name)


def _missing_set(variables) -> Column:
    """A letter per variable: 1 where it is missing, else 0."""
    return F.concat(*[F.when(F.col(v).isNull(), "1").otherwise("0") for v in variables]).alias("missing_set")


def _bits(name: str) -> int:
    """The same set as a number: bit i is set where variable i is missing."""
    return int(name[::-1], 2)


def _name(bits: int, k: int) -> str:
    return format(bits, f"0{k}b")[::-1]


#: Sets of missing variables whose maps the driver holds; with 20 variables about 14 MB.
MAX_SETS = 4096


def _occurring(wide: DataFrame, variables) -> list[int] | None:
    """The sets that occur, or None if they are more than the driver should hold."""
    found = wide.select(_missing_set(variables)).distinct().limit(MAX_SETS + 1).collect()
    return sorted(_bits(r[0]) for r in found) if len(found) <= MAX_SETS else None


def moments_by_missing_set(wide: DataFrame, variables, centers: dict[str, float], spreads: dict[str, float]) -> DataFrame:
    """Per set of missing variables: rows, sums and cross products of standardised observed values."""
    z = {v: F.coalesce((F.col(v) - centers[v]) / spreads[v], F.lit(0.0)) for v in variables}
    aggregates = [F.count("*").alias("n")]
    for i, a in enumerate(variables):
        aggregates.append(F.sum(z[a]).alias(f"s_{i}"))
        for j in range(i, len(variables)):
            aggregates.append(F.sum(z[a] * z[variables[j]]).alias(f"p_{i}_{j}"))
    return wide.groupBy(_missing_set(variables)).agg(*aggregates)


@dataclass
class ChainedModel:
    """Fitted regressions in visiting order: round, target, intercept, slopes, noise, spread of the
    slopes, rows they were fitted on and means of the other variables there (standardised units)."""

    variables: tuple[str, ...]
    centers: dict[str, float]
    spreads: dict[str, float]
    steps: list[tuple[int, int, float, list[float], float, list[list[float]], float, list[float]]]
    predictor: str

    def to_frame(self, spark) -> DataFrame:
        """The fitted coefficients as a table, for writing and reading back."""
        rows = []
        for order, (rnd, target, intercept, slopes, noise, spread, n, means) in enumerate(self.steps):
            rows.append(
                (
                    order,
                    int(rnd),
                    self.variables[target],
                    float(intercept),
                    [float(s) for s in slopes],
                    float(noise),
                    [[float(x) for x in row] for row in spread],
                    float(n),
                    [float(x) for x in means],
                    list(self.variables),
                    [float(self.centers[v]) for v in self.variables],
                    [float(self.spreads[v]) for v in self.variables],
                    self.predictor,
                )
            )
        kind = (
            "step int, round int, target string, intercept double, slopes array<double>, noise double, "
            "coef_spread array<array<double>>, n_fitted double, means array<double>, variables array<string>, centers array<double>, "
            "spreads array<double>, predictor string"
        )
        return spark.createDataFrame(rows, kind)

    @classmethod
    def from_frame(cls, frame: DataFrame) -> "ChainedModel":
        """Coefficients are rounds × variables rows, whatever the size of the data."""
        rows = sorted(frame.collect(), key=lambda r: r["step"])
        names = tuple(rows[0]["variables"])
        steps = [
            (r["round"], names.index(r["target"]), r["intercept"], list(r["slopes"]), r["noise"], [list(x) for x in r["coef_spread"]], r["n_fitted"], list(r["means"]))
            for r in rows
        ]
        return cls(names, dict(zip(names, rows[0]["centers"])), dict(zip(names, rows[0]["spreads"])), steps, rows[0]["predictor"])


def _ridge(gram: np.ndarray, cross: np.ndarray, target_square: float, n: float, evidence: bool):
    """Coefficients from centred cross products; with ``evidence`` the ridge strength is
    the one that maximises the marginal likelihood (MacKay 1992), else least squares."""
    if not evidence:
        coef = np.linalg.lstsq(gram, cross, rcond=None)[0]
        residual = max(target_square - 2 * coef @ cross + coef @ gram @ coef, 0.0)
        noise = residual / max(n - len(cross) - 1, 1.0)
        return coef, noise, noise * np.linalg.pinv(gram)
    # Hyperprior and stopping rule of the usual Bayesian ridge defaults.
    prior, rounds, tolerance = 1e-6, 300, 1e-3
    eigenvalues, vectors = np.linalg.eigh(gram)
    eigenvalues = np.clip(eigenvalues, 0.0, None)
    rotated = vectors.T @ cross
    precision, weight = 1.0 / (target_square / n + np.finfo(float).eps), 1.0
    previous, coef = None, np.zeros(len(cross))
    for _ in range(rounds):
        coef = vectors @ (rotated / (eigenvalues + weight / precision))
        residual = max(target_square - 2 * coef @ cross + coef @ gram @ coef, 0.0)
        used = np.sum(precision * eigenvalues / (weight + precision * eigenvalues))
        weight = (used + 2 * prior) / (coef @ coef + 2 * prior)
        precision = (n - used + 2 * prior) / (residual + 2 * prior)
        if previous is not None and np.sum(np.abs(previous - coef)) < tolerance:
            break
        previous = coef.copy()
    coef = vectors @ (rotated / (eigenvalues + weight / precision))
    spread = vectors @ np.diag(1.0 / (weight + precision * eigenvalues)) @ vectors.T
    return coef, 1.0 / precision, spread


def _start_maps(sets, n_variables: int) -> dict[int, np.ndarray]:
    """Map of [1, observed…] to the completed row; missing ones start at the mean (0 standardised)."""
    maps = {}
    for s in sets:
        m = np.zeros((n_variables, n_variables + 1))
        for i in range(n_variables):
            if not s >> i & 1:
                m[i, i + 1] = 1.0
        maps[s] = m
    return maps


def _replay(steps, sets, n_variables: int) -> dict[int, np.ndarray]:
    maps = _start_maps(sets, n_variables)
    for _, target, intercept, slopes, *_ in steps:
        others = [i for i in range(n_variables) if i != target]
        for s, m in maps.items():
            if s >> target & 1:
                row = np.asarray(slopes) @ m[others]
                row[0] += intercept
                m[target] = row
    return maps


def fit_chained(
    wide: DataFrame, variables, rounds: int = 10, predictor: str = "bayesian_ridge", tolerance: float = 1e-3
) -> ChainedModel:
    """Learn the regressions on a wide table; two passes over the rows, or three when
    the stopping rule is checked (``tolerance`` > 0).

    Every variable is visited each round, those with fewer missing cells first.
    """
    variables = tuple(variables)
    if len(variables) < 2:
        raise ValueError("chained equations take two variables or more")
    if predictor not in ("bayesian_ridge", "linear"):
        raise ValueError("predictor must be bayesian_ridge or linear; use fit_forest for forests")
    basic = wide.agg(
        *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(variables)],
        *[F.stddev_samp(v).alias(f"d_{i}") for i, v in enumerate(variables)],
        *[F.count(v).alias(f"c_{i}") for i, v in enumerate(variables)],
        *[F.max(F.abs(v)).alias(f"x_{i}") for i, v in enumerate(variables)],
    ).first()
    empty = [v for i, v in enumerate(variables) if not basic[f"c_{i}"]]
    if empty:
        raise ValueError(f"no observed value for {empty}")
    centers = {v: basic[f"m_{i}"] for i, v in enumerate(variables)}
    spreads = {v: basic[f"d_{i}"] or 1.0 for i, v in enumerate(variables)}
    # V² numbers per set of missing variables that occurs, whatever the number of rows.
    moments = moments_by_missing_set(wide, variables, centers, spreads)
    k = len(variables)
    order = sorted(range(k), key=lambda i: (-basic[f"c_{i}"], i))
    sets = _occurring(wide, variables)
    totals = _DriverTotals(moments, k) if sets is not None else chained_sets.SpreadTotals(moments, k)
    steps = []
    for rnd in range(rounds):
        for target in order:
            others = [i for i in range(k) if i != target]
            total = totals.of(target)
            n = total[0, 0]
            mean = total[0, 1:] / n
            centred = total[1:, 1:] - n * np.outer(mean, mean)
            coef, noise, spread = _ridge(
                centred[np.ix_(others, others)], centred[others, target], centred[target, target], n, predictor == "bayesian_ridge"
            )
            intercept = mean[target] - coef @ mean[others]
            steps.append((rnd, target, float(intercept), list(coef), float(noise), spread.tolist(), float(n), mean[others].tolist()))
            totals.visited(steps[-1])
        totals.end_round()
    model = ChainedModel(variables, centers, spreads, steps, predictor)
    if tolerance > 0:
        largest = max(basic[f"x_{i}"] for i in range(k))
        changes = chained_sets.round_changes(wide, model, rounds)
        for r, change in enumerate(changes):
            if (change or 0.0) < tolerance * largest:
                model.steps = [step for step in model.steps if step[0] <= r]
                break
    return model


class _DriverTotals:
    """Cross products over all rows where a variable is observed, from moments and maps per set."""

    def __init__(self, moments: DataFrame, k: int):
        self.k, self.grams = k, {}
        for row in moments.collect():
            g = np.zeros((k + 1, k + 1))
            g[0, 0] = row["n"]
            for i in range(k):
                g[0, i + 1] = g[i + 1, 0] = row[f"s_{i}"]
                for j in range(i, k):
                    g[i + 1, j + 1] = g[j + 1, i + 1] = row[f"p_{i}_{j}"]
            self.grams[_bits(row["missing_set"])] = g
        self.maps = _start_maps(self.grams, k)

    def of(self, target: int) -> np.ndarray:
        total = np.zeros((self.k + 1, self.k + 1))
        for s, g in self.grams.items():
            if not s >> target & 1:
                full = np.vstack([np.eye(1, self.k + 1), self.maps[s]])
                total += full @ g @ full.T
        return total

    def visited(self, step: tuple) -> None:
        _, target, intercept, slopes, *_ = step
        others = [i for i in range(self.k) if i != target]
        for s, m in self.maps.items():
            if s >> target & 1:
                row = np.asarray(slopes) @ m[others]
                row[0] += intercept
                m[target] = row

    def end_round(self) -> None:
        pass


def _round_changes(wide: DataFrame, model: ChainedModel, rounds: int, sets: list[int]) -> list[float]:
    """The largest change of a row in every round by built-in functions: what ``chained_sets.round_changes`` must equal.

    The change of a row is the sum over its cells; the rounds after the first whose largest change
    stays below the limit are dropped.
    """
    k = len(model.variables)
    per_round = [len([s for s in model.steps if s[0] <= r]) for r in range(rounds)]
    maps = [_start_maps(sets, k)] + [_replay(model.steps[:end], sets, k) for end in per_round]
    tables = []
    for s in sets:
        changes = []
        for before, after in zip(maps, maps[1:]):
            difference = after[s] - before[s]
            changes.append([[float(x) for x in difference[i]] for i in range(k) if s >> i & 1])
        scales = [float(model.spreads[v]) for i, v in enumerate(model.variables) if s >> i & 1]
        tables.append((_name(s, k), changes, scales))
    lookup = wide.sparkSession.createDataFrame(
        tables, "missing_set string, changes array<array<array<double>>>, scales array<double>"
    )
    observed = F.array(F.lit(1.0), *[_standardised(model, v) for v in model.variables])
    moved = wide.select(_missing_set(model.variables), observed.alias("x")).join(lookup, "missing_set")
    size = lambda change: F.aggregate(
        F.zip_with(change, F.col("scales"), lambda row, spread: F.abs(_dot(row, F.col("x"))) * spread),
        F.lit(0.0),
        lambda a, b: a + b,
    )
    sizes = F.transform("changes", size)
    largest = moved.select(sizes.alias("c")).agg(*[F.max(F.get("c", F.lit(r))).alias(f"r{r}") for r in range(rounds)]).first()
    return [largest[f"r{r}"] for r in range(rounds)]


def _standardised(model: ChainedModel, v: str) -> Column:
    return F.coalesce((F.col(v) - model.centers[v]) / model.spreads[v], F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _drawn_steps(model: ChainedModel, n_imputations: int, posterior: bool, seed) -> list[list[tuple]]:
    """The regressions of every imputation, with drawn slopes and intercepts for ``posterior``."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n_imputations):
        steps = model.steps
        if posterior:
            steps = []
            for rnd, target, intercept, slopes, noise, spread, n, means in model.steps:
                drawn = rng.multivariate_normal(slopes, np.asarray(spread), method="svd")
                # The intercept goes with the slopes through the centre of the data, itself uncertain.
                shift = np.dot(np.asarray(slopes) - drawn, means) + rng.normal(0.0, (noise / max(n, 1.0)) ** 0.5)
                steps.append((rnd, target, intercept + shift, drawn, noise, spread, n, means))
        out.append(steps)
    return out


def impute_chained(wide: DataFrame, model: ChainedModel, n_imputations: int = 1, posterior: bool = False, seed=0) -> DataFrame:
    """Completed rows with a key ``imputation``; observed values are kept as they are.

    ``posterior=False`` gives every imputation the same expected values.
    ``posterior=True`` draws slopes and intercepts per imputation, and residuals per row. A
    residual of one visit goes on into the visits after it, so cells that are missing together
    have the joint spread that the chain gives them.
    """
    return chained_sets.completed(wide, model, _drawn_steps(model, n_imputations, posterior, seed), seed if posterior else None)


def impute_samples(wide: DataFrame, model: ChainedModel, n_imputations: int, posterior: bool = True, seed=0) -> DataFrame:
    """The imputations of :func:`impute_chained` side by side: every variable an array with one value each.

    A row stays a row, and is joined with the maps of its set of missing variables once, so neither
    rows nor shuffles grow with the number of imputations. An observed value is an array of that value.
    """
    return chained_sets.samples(wide, model, _drawn_steps(model, n_imputations, posterior, seed), seed if posterior else None)


def mean_imputation(completed: DataFrame, variables, keys=("station_id", "t")) -> DataFrame:
    """Average over the imputations of each cell."""
    return completed.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in variables])


@dataclass
class ForestModel:
    """Forests in visiting order, round by round, and the means that missing values start from."""

    variables: tuple[str, ...]
    means: dict[str, float]
    order: tuple[str, ...]
    rounds: list[list]

    def impute(self, wide: DataFrame) -> DataFrame:
        """Completed rows of any table with these variables; with forests of Spark ML a checkpoint per round keeps the plan short."""
        if cell_forests.fits(len(self.variables)):
            return cell_forests.completed(wide, self.variables, self.means, self.rounds)
        state = _forest_start(wide, self.variables, self.means)
        for forests in self.rounds:
            for target, forest in zip(self.order, forests):
                state = _forest_visit(state, self.variables, target, forest)
            state = checkpointed(state)
        return state.select(*wide.columns)

    def save(self, spark, path: str) -> None:
        """The forests, in a folder each if they are of Spark ML, and a table of what goes with them."""
        means = [float(self.means[v]) for v in self.variables]
        row = (list(self.variables), means, list(self.order), len(self.rounds))
        spark.createDataFrame([row], "variables array<string>, means array<double>, order array<string>, rounds int").write.parquet(f"{path}/chain")
        if cell_forests.fits(len(self.variables)):
            cell_forests.to_frame(spark, self.rounds).write.parquet(f"{path}/forests")
            return
        for r, forests in enumerate(self.rounds):
            for target, forest in zip(self.order, forests):
                forest.save(f"{path}/forests/{r}/{self.order.index(target)}")

    @classmethod
    def load(cls, spark, path: str) -> "ForestModel":
        from pyspark.ml.regression import RandomForestRegressionModel

        row = spark.read.parquet(f"{path}/chain").first()
        if cell_forests.fits(len(row["variables"])):
            rounds = cell_forests.from_frame(spark.read.parquet(f"{path}/forests"))
            return cls(tuple(row["variables"]), dict(zip(row["variables"], row["means"])), tuple(row["order"]), rounds)
        rounds = [
            [RandomForestRegressionModel.load(f"{path}/forests/{r}/{i}") for i in range(len(row["order"]))] for r in range(row["rounds"])
        ]
        return cls(tuple(row["variables"]), dict(zip(row["variables"], row["means"])), tuple(row["order"]), rounds)


def _forest_start(wide: DataFrame, variables, means) -> DataFrame:
    flags = {f"__miss_{v}": F.col(v).isNull() for v in variables}
    return wide.withColumns(flags).withColumns({v: F.coalesce(F.col(v), F.lit(means[v])) for v in variables})


def _with_features(state: DataFrame, variables, target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=[v for v in variables if v != target], outputCol="__features").transform(state)


def _forest_visit(state: DataFrame, variables, target: str, forest) -> DataFrame:
    guess = F.when(F.col(f"__miss_{target}"), F.col("__guess")).otherwise(F.col(target))
    return forest.transform(_with_features(state, variables, target)).withColumn(target, guess).drop("__features", "__guess")


def fit_forest(wide: DataFrame, variables, rounds: int = 10, trees: int = 10, depth: int = 10, seed: int = 0) -> ForestModel:
    """Chained equations with a random forest per variable.

    Every visit trains on the rows where the variable is observed; each round is stored so the plan does
    not grow. Up to four variables, a forest is learned from a table of cells (``cell_forests``), with more by Spark ML.
    """
    return _fitted_forest(wide, variables, rounds, trees, depth, seed)[0]


def _fitted_forest(wide: DataFrame, variables, rounds: int, trees: int, depth: int, seed: int) -> tuple[ForestModel, DataFrame]:
    """The model, and the table it was fitted on as the last round leaves it: completed."""
    variables = tuple(variables)
    basic = wide.agg(*[F.avg(v).alias(f"m_{v}") for v in variables], *[F.count(v).alias(f"c_{v}") for v in variables]).first()
    order = tuple(sorted(variables, key=lambda v: (-basic[f"c_{v}"], variables.index(v))))
    means = {v: basic[f"m_{v}"] for v in variables}
    if cell_forests.fits(len(variables)):
        forests, done = cell_forests.fit(wide, variables, means, order, rounds, trees, depth, seed)
        return ForestModel(variables, means, order, forests), done
    state = checkpointed(_forest_start(wide, variables, means))
    from pyspark.ml.regression import RandomForestRegressor

    fitted = []
    for _ in range(rounds):
        forests = []
        for target in order:
            regressor = RandomForestRegressor(
                featuresCol="__features", labelCol=target, predictionCol="__guess", numTrees=trees, maxDepth=depth, seed=seed
            )
            forest = regressor.fit(_with_features(state.where(~F.col(f"__miss_{target}")), variables, target))
            state = _forest_visit(state, variables, target, forest)
            forests.append(forest)
        fitted.append(forests)
        state = checkpointed(state)
    return ForestModel(variables, means, order, fitted), state.select(*wide.columns)


def forest_chained(wide: DataFrame, variables, rounds: int = 10, trees: int = 10, depth: int = 10, seed: int = 0) -> DataFrame:
    """Fit forests on a table and complete that table with them: the fit's own rounds have done so already."""
    return _fitted_forest(wide, variables, rounds, trees, depth, seed)[1]
