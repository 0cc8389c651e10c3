"""Abusive, hateful or sexual content: scores, spans and rates (problem 9).

A linear-chain CRF tags offending tokens; its forward-backward marginals give
a score per document and the offsets of the offending stretches.  Only the fit
sees a bounded sample of labelled documents; every text is scored whole, with
no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import norm_key
from tidemark.llm import crf

#: Labelled documents that the model is fitted on, at most, per class.
SAMPLE_PER_CLASS = 3000
#: Texts read at once.
TEXTS = 1024

SCORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("abusive", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))),
    ]
)


def majority(labels: DataFrame) -> DataFrame:
    """doc_id, y, sure: what most raters say; documents on which they are split, or with no vote, are left out."""
    votes = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("share"), F.count(F.lit(1)).alias("n"))
    return votes.where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"), ((F.col("n") >= 2) & F.col("share").isin(0.0, 1.0)).alias("sure"))


def fit(documents: DataFrame, labels: DataFrame) -> crf.Model:
    """Model from at most SAMPLE_PER_CLASS labelled documents of each class, chosen by hash of their id.

    Without any labelled document nothing can be told apart and no text is
    called abusive.
    """
    votes = majority(labels).withColumn("h", F.xxhash64("doc_id"))
    picked = votes.where("y = 1").orderBy("h", "doc_id").limit(SAMPLE_PER_CLASS).unionByName(votes.where("y = 0").orderBy("h", "doc_id").limit(SAMPLE_PER_CLASS))
    # At most 2 x SAMPLE_PER_CLASS short rows.
    sample = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    totals = votes.groupBy("y").agg(F.count(F.lit(1)).alias("n_class"))
    sample = sample.join(F.broadcast(totals), "y")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        y = pdf["y"].to_numpy()
        taken = pdf.groupby("y")["y"].transform("size").to_numpy()
        weight = pdf["n_class"].to_numpy() / taken * np.where(pdf["sure"], 1.0, 0.3)
        m = crf.fit_from_documents([t or "" for t in pdf["text"]], y, weight)
        kept = np.nonzero(m.weights)[0].astype("int32")
        state = (kept, m.weights[kept].astype("float32"), m.trans, m.threshold)
        return pd.DataFrame({"state": [pickle.dumps(state)]})

    rows = sample.groupBy().applyInPandas(learn, T.StructType([T.StructField("state", T.BinaryType())])).collect()
    if not rows:
        return crf.Model(trans=np.array([[0.0, -8.0], [0.0, -8.0]]), threshold=2.0)
    kept, w, trans, threshold = pickle.loads(rows[0]["state"])
    weights = np.zeros(crf.FEATURES, dtype="float32")
    weights[kept] = w
    return crf.Model(weights, trans, threshold)


def stretches(p: np.ndarray, offsets: np.ndarray) -> list[dict]:
    """Runs of tokens more likely offending than not, as character offsets with their mean probability."""
    on = np.concatenate([[False], p > 0.5, [False]])
    edge = np.nonzero(on[1:] != on[:-1])[0]
    return [{"start": int(offsets[a][0]), "end": int(offsets[b - 1][1]), "p": float(p[a:b].mean())} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def score(documents: DataFrame, model: crf.Model) -> DataFrame:
    """doc_id, score, abusive, spans of every document; NULL and empty texts score 0."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.threshold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, trans, threshold = shared.value
        m, enc = crf.Model(weights, trans, threshold), crf.Encoder()
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                pdf = whole.iloc[at : at + TEXTS]
                read = [enc.features(t or "") for t in pdf["text"]]
                probs = m.marginals([f for f, _ in read])
                scores = [crf.document_score(p) for p in probs]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": scores, "abusive": [s >= threshold for s in scores], "spans": [stretches(p, o) for p, (_, o) in zip(probs, read, strict=True)]})

    return documents.select("doc_id", "text").mapInPandas(run, SCORED)


def source_rates(scored: DataFrame, documents: DataFrame, source: Column | None = None) -> DataFrame:
    """Documents and share of abusive ones per source; documents without source count as '(none)'."""
    name = F.coalesce(norm_key(F.col("source")) if source is None else source, F.lit("(none)"))
    return (
        documents.select("doc_id", name.alias("source"))
        .join(scored.select("doc_id", "abusive", "score"), "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("abusive").cast("long")).alias("abusive_documents"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
    )
