"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models; each sees the probabilities of the categories before
it. While training, these are out-of-fold predictions, so a later model learns from probabilities as good as those it
will get for texts nobody has labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactlink.llm import linear
from contactlink.llm.linear import Linear, Rows, folds_of
from contactlink.llm.tables import bounded_sample, exact

#: Most labelled rows that train a chain, chosen by a hash of their id.
TRAINING_ROWS = 8_000
FOLDS = 4
#: Bytes of text that are worked on at a time.
SLICE_BYTES = 1 << 20


class Chain:
    """Models of all categories, in order."""

    def __init__(self, models: list[Linear]):
        self.models = models

    @classmethod
    def fit(cls, ids: np.ndarray, rows: Rows, labels: list[np.ndarray], folds: int = FOLDS) -> Chain:
        fold = folds_of(ids, folds)
        models, earlier = [], []
        for y in labels:
            seen = rows.with_dense(*earlier) if earlier else rows
            models.append(Linear().fit(seen, y))
            held_out = np.zeros(len(y))
            for k in range(folds):
                test = fold == k
                if test.any() and not test.all():
                    held_out[test] = Linear().fit(seen.take(~test), y[~test]).predict(seen.take(test))
            earlier.append(held_out)
        return cls(models)

    def predict(self, rows: Rows) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for model in self.models:
            out.append(model.predict(rows.with_dense(*out) if out else rows))
        return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str, text_col: str, rows: int = TRAINING_ROWS) -> Chain:
    """Train on at most ``rows`` labelled documents. Rows with a null label or id are left out; without any labelled
    document every probability is 0."""
    marked = labels.select(exact(id_col).alias("_id"), *(c.cast("int").alias(n) for n, c in categories.items())).dropna()
    sample = bounded_sample(marked, "_id", rows)  # its size is bounded, so it can be broadcast
    joined = docs.select(exact(id_col).alias("_id"), exact(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    ids, features, ys = linear.sampled_features(joined, "_id", "_text", list(categories))
    return Chain.fit(ids, features, list(ys.values())) if len(ids) else Chain([])


def score(df: DataFrame, chain: Chain, categories: list[str], text_col: str = "text") -> DataFrame:
    """Add ``p_<category>`` for every category of the chain. Whole texts are read; a null text counts as empty.
    Columns with the new names are replaced, all others kept. No shuffle."""
    new = [f"p_{c}" for c in categories]
    names = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    at = names.index(text_col)
    flat = df.select(*(exact(c).alias(f"c{i}") for i, c in enumerate(names)))
    schema = T.StructType([*flat.schema.fields, *(T.StructField(n, T.DoubleType()) for n in new)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in linear.in_slices(batch, at, SLICE_BYTES):
                found = chain.predict(linear.rows_of(part.column(at))) if chain.models else [np.zeros(part.num_rows)] * len(new)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(p, pa.float64()) for p in found)], names=schema.names)

    return flat.mapInArrow(add, schema).toDF(*names, *new)


def label_categories() -> dict[str, Column]:
    """The chain over the ``labels`` table: low quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(df: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
             rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """Add the probabilities of all categories, and ``toxic``: whether the last one's is at least ``threshold``."""
    categories = categories or label_categories()
    chain = train(df, labels, categories, id_col, text_col, rows)
    kept = df.select(*(exact(c) for c in df.columns if c.lower() != "toxic"))
    return score(kept, chain, list(categories), text_col).withColumn("toxic", F.col(f"p_{list(categories)[-1]}") >= threshold)
