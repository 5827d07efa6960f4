"""Training, registry and use of the shadow model."""

from __future__ import annotations

import json
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.scoring import FEATURES, THRESHOLD, scored
from claimloom.store import Files


def training_features(claims: DataFrame) -> DataFrame:
    """Features with the weak label of the score."""
    return scored(claims).select("claim_id", *FEATURES, (F.col("fraud_score") >= THRESHOLD).cast("int").alias("label"))


def stratified_split(df: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by a hash of the id within each label, the same on every run."""
    place = F.pmod(F.xxhash64("claim_id", "label", F.lit(seed)), F.lit(1000))
    return df.filter(place < share * 1000), df.filter(place >= share * 1000)


def quality(predicted: DataFrame) -> dict[str, float]:
    """Precision, recall and F1 of ``prediction`` against ``label``; 0 where nothing is divided."""
    hit, p, y = (F.col("prediction") == 1) & (F.col("label") == 1), F.col("prediction") == 1, F.col("label") == 1
    n = predicted.agg(F.count_if(hit).alias("hit"), F.count_if(p).alias("p"), F.count_if(y).alias("y")).first()
    precision, recall = (n["hit"] / n[k] if n[k] else 0.0 for k in ("p", "y"))
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}


def train(df: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42) -> tuple[PipelineModel, dict[str, float]]:
    fit, test = stratified_split(df)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(fit)
    return model, quality(model.transform(test))


def should_retrain(force: bool, bootstrap: bool, drift: bool) -> tuple[bool, str]:
    for asked, reason in ((force, "force"), (bootstrap, "bootstrap"), (drift, "drift")):
        if asked:
            return True, reason
    return False, "none"


def should_promote(challenger: float, champion: float | None) -> bool:
    return champion is None or challenger > champion


class Registry:
    """Model runs in a folder on any file system of the cluster: one numbered record and one saved pipeline per run."""

    def __init__(self, root: str, spark: SparkSession | None = None):
        self.files = Files(spark or SparkSession.active(), root)

    def runs(self) -> list[dict]:
        """All runs in order; a better one became champion and superseded the last, others were rejected."""
        runs: list[dict] = []
        champion = None
        for name in self.files.names("runs"):
            if name.endswith(".json") and name[0] != "_":
                run = json.loads(self.files.read("runs", name))
                if should_promote(run["f1"], champion and champion["f1"]):
                    if champion:
                        champion["state"] = "superseded"
                    run["state"], champion = "champion", run
                else:
                    run["state"] = "rejected"
                runs.append(run)
        return runs

    def champion(self) -> dict | None:
        return next((r for r in reversed(self.runs()) if r["state"] == "champion"), None)

    def record(self, model: PipelineModel, metrics: dict[str, float]) -> dict:
        """Saves a run and gives it with its state. Runs that are recorded at the same time get successive numbers."""
        run = {"id": uuid.uuid4().hex, **metrics}
        model.write().overwrite().save(self.files.at(run["id"]))
        while not self.files.create(json.dumps(run), "runs", f"{len(self.runs()):06d}.json"):
            pass
        return next(r for r in self.runs() if r["id"] == run["id"])

    def load_champion(self) -> PipelineModel | None:
        """Any failure gives None: scoring goes on without shadow scores."""
        run = self.champion()
        try:
            return PipelineModel.load(self.files.at(run["id"])) if run else None
        except Exception:
            return None


def with_shadow_score(gold: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``model_fraud_score`` of the positive class; null without model. Needs the feature columns."""
    if model is None:
        return gold.withColumn("model_fraud_score", F.lit(None).cast("double"))
    from pyspark.ml.functions import vector_to_array

    scored_df = model.transform(gold).withColumn("model_fraud_score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored_df.drop("features", "rawPrediction", "probability", "prediction")
