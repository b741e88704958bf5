"""A trained classifier: hashed character trigrams, IDF and weighted logistic regression, as a pipeline of pyspark.ml.

It keeps the contract of fine-tuning an encoder (fit, probabilities, class weights, persistence), not its model; no deep-learning library is needed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipole.functions.columns import char_ngrams, predicted
from bipole.operators.pools import class_weights, resolve_labels


@dataclass
class TrainedClassifier:
    """fit(df) takes (text, label), predict_proba and predict take (query_id, text)."""

    epochs: int = 30
    features: int = 1 << 15
    regularisation: float = 1e-3
    class_weight: str | dict | None = None
    pos_label: object = None

    def fit(self, df: DataFrame) -> TrainedClassifier:
        self.classes_ = resolve_labels(df, pos_label=self.pos_label)
        weights = class_weights(df, "label", self.class_weight)
        # two rows are sent to the texts; a join by label would send all texts to two tasks
        rows = df.join(F.broadcast(weights), "label").select(char_ngrams(F.col("text")).alias("grams"), F.when(F.col("label") == F.lit(self.classes_[1]), 1.0).otherwise(0.0).alias("target"), "weight")
        stages = [HashingTF(inputCol="grams", outputCol="tf", numFeatures=self.features), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol="target", weightCol="weight", maxIter=self.epochs, regParam=self.regularisation)]
        self.model_ = Pipeline(stages=stages).fit(rows)
        return self

    def predict_proba(self, queries: DataFrame) -> DataFrame:
        out = self.model_.transform(queries.select("query_id", char_ngrams(F.col("text")).alias("grams")))
        p = vector_to_array("probability")
        return out.select("query_id", p[0].alias("p_negative"), p[1].alias("p_positive"))

    def predict(self, queries: DataFrame) -> DataFrame:
        neg, pos = self.classes_
        return self.predict_proba(queries).select("query_id", predicted(F.col("p_positive"), pos, neg).alias("prediction"), "p_positive")

    def save(self, spark: SparkSession, path: str) -> None:
        self.model_.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(json.dumps(list(self.classes_)),)], "classes string").coalesce(1).write.mode("overwrite").text(f"{path}/classes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainedClassifier:
        own = cls()
        own.model_ = PipelineModel.load(f"{path}/model")
        own.classes_ = tuple(json.loads(spark.read.text(f"{path}/classes").first()[0]))
        return own
