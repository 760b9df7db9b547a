"""Saved models: trees and networks as tables or a Spark ML model, and small Parquet tables with everything around it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import SparkSession

from cohortlens.operators.boosting import TreeModel
from cohortlens.operators.joint import JointModel
from cohortlens.operators.preprocess import Preprocessing
from cohortlens.operators.scale import Scaling


@dataclass
class ModelBundle:
    """``kind`` is ``binary``, ``type``, ``latent`` or ``joint`` and picks the score function."""

    kind: str
    model: Transformer | TreeModel | JointModel
    preprocessing: Preprocessing
    classes: list[str]
    class_weights: dict[str, float] = field(default_factory=dict)


_FEATURE_SCHEMA = "position int, feature string, log2_offset double, median double, mean double, std double, lowest double"
_TABLES = {"binary": "trees", "type": "trees", "joint": "network"}
_CLASS_SCHEMA = "code int, class string, weight double"


def save_bundle(bundle: ModelBundle, path: str, spark: SparkSession) -> None:
    prep = bundle.preprocessing
    features = [
        (i, c, prep.offsets.get(c), prep.medians.get(c), prep.scaling.means[c], prep.scaling.stds[c], prep.lowest.get(c))
        for i, c in enumerate(prep.features)
    ]
    classes = [(i, c, bundle.class_weights.get(c)) for i, c in enumerate(bundle.classes)]
    if isinstance(bundle.model, (TreeModel, JointModel)):
        bundle.model.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/{_TABLES[bundle.kind]}")
    else:
        PipelineModel(stages=[bundle.model]).write().overwrite().save(f"{path}/model")
    for name, rows, schema in (
        ("features", features, _FEATURE_SCHEMA),
        ("classes", classes, _CLASS_SCHEMA),
        ("kind", [(bundle.kind,)], "kind string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(path: str, spark: SparkSession) -> ModelBundle:
    features = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    classes = spark.read.parquet(f"{path}/classes").orderBy("code").collect()
    prep = Preprocessing(
        [r.feature for r in features],
        {r.feature: r.log2_offset for r in features if r.log2_offset is not None},
        {r.feature: r.median for r in features},
        Scaling({r.feature: r["mean"] for r in features}, {r.feature: r["std"] for r in features}),
        {r.feature: r.lowest for r in features if r.log2_offset is not None},
    )
    kind = spark.read.parquet(f"{path}/kind").first()["kind"]
    if kind == "latent":
        model = PipelineModel.load(f"{path}/model").stages[0]
    else:
        model = (JointModel if kind == "joint" else TreeModel).from_table(spark.read.parquet(f"{path}/{_TABLES[kind]}"))
    return ModelBundle(
        kind,
        model,
        prep,
        [r["class"] for r in classes],
        {r["class"]: r.weight for r in classes if r.weight is not None},
    )
