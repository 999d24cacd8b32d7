"""Pair classifiers: feature texts, a hashed linear trainer, batch scoring, model files."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import argmax, compact

FEATURES = 1 << 16


def feature_text(mode: str) -> Column:
    """One text from claim, title and response, in one of three templates."""
    claim, title, response = (compact(F.col(c)) for c in ("claim_text", "submission_title", "response_body"))
    if mode == "response":
        return response
    if mode == "pair":
        return F.format_string("claim: %s response: %s", claim, response)
    if mode == "title_pair":
        return F.format_string("title: %s claim: %s response: %s", title, claim, response)
    raise ValueError(f"unknown mode {mode}")


def trainer(text: str = "text", label: str = "label", features: int = FEATURES) -> Pipeline:
    """Words and word pairs, hashed, weighted by rarity, then a regularised logit of one or more classes."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}']+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, maxIter=30, probabilityCol="_p"),
    ])


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds probabilities, score (of class 1), pred and best_class; the row carries its own score."""
    p = vector_to_array(F.col("_p"))
    out = model.transform(df).withColumn("probabilities", p)
    return out.withColumns({"score": F.get("probabilities", F.lit(1)), "best_class": argmax(F.col("probabilities"))}).withColumn("pred", (F.col("score") >= threshold).cast("int")).select(*df.columns, "probabilities", "score", "pred", "best_class")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
