"""One face for every way to fill gaps: fit on a panel, impute any panel, save and load.

``IMPUTERS`` names the built-in ones; a class with the same methods may be added to it, or an
object passed wherever a method is named.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from . import chained, fill

CELL = ["station_id", "t", "variable"]


class Imputer(Protocol):
    def fit(self, panel: DataFrame, variables) -> "Imputer": ...

    def impute(self, panel: DataFrame) -> DataFrame:
        """``panel`` with a column ``filled``: observed values as they are, the others estimated."""
        ...

    def save(self, spark: SparkSession, path: str) -> None: ...


def _settings(spark: SparkSession, path: str, values: dict | None = None) -> dict:
    """Write settings beside a model, or read them."""
    if values is not None:
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.text(f"{path}/settings")
        return values
    return json.loads(spark.read.text(f"{path}/settings").first()["value"])


@dataclass
class AlongTime:
    """Methods that look along each series and have nothing to learn."""

    method: str = "linear"
    max_gap: int | None = None

    def fit(self, panel: DataFrame, variables) -> "AlongTime":
        return self

    def impute(self, panel: DataFrame) -> DataFrame:
        return fill._fill(panel, self.method, self.max_gap, fill.SERIES)

    def save(self, spark: SparkSession, path: str) -> None:
        _settings(spark, path, asdict(self))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AlongTime":
        return cls(**_settings(spark, path))


@dataclass
class Chained:
    """Chained equations; ``predictor`` is bayesian_ridge, linear or forest."""

    predictor: str = "bayesian_ridge"
    options: dict = field(default_factory=dict)
    model: object = None

    def fit(self, panel: DataFrame, variables) -> "Chained":
        wide = checkpointed(chained.to_wide(panel, variables))
        if self.predictor == "forest":
            model = chained.fit_forest(wide, variables, **self.options)
        else:
            model = chained.fit_chained(wide, variables, predictor=self.predictor, **self.options)
        return Chained(self.predictor, self.options, model)

    def impute(self, panel: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit or load before imputing")
        wide = chained.to_wide(panel, self.model.variables)
        done = self.model.impute(wide) if self.predictor == "forest" else chained.impute_chained(wide, self.model).drop("imputation")
        cells = chained.to_long(done, self.model.variables, "__filled")
        # Variables the model does not know keep what was observed.
        return panel.join(cells, CELL, "left").withColumn("filled", F.coalesce("value", "__filled")).select(*panel.columns, "filled")

    def save(self, spark: SparkSession, path: str) -> None:
        _settings(spark, path, {"predictor": self.predictor, "options": self.options})
        if self.predictor == "forest":
            self.model.save(spark, f"{path}/model")
        else:
            self.model.to_frame(spark).write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Chained":
        said = _settings(spark, path)
        if said["predictor"] == "forest":
            model = chained.ForestModel.load(spark, f"{path}/model")
        else:
            model = chained.ChainedModel.from_frame(spark.read.parquet(f"{path}/model"))
        return cls(said["predictor"], said["options"], model)


IMPUTERS = {
    **{name: (lambda name=name, **options: AlongTime(name, **options)) for name in fill.ALONG_TIME},
    "chained": lambda **options: Chained("bayesian_ridge", options),
    "chained_linear": lambda **options: Chained("linear", options),
    "chained_forest": lambda **options: Chained("forest", options),
}
