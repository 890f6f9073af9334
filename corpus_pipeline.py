"""Documents to training sequences in five stages: toxic documents go, one of each group of near copies stays, repeated
passages are cut out, the rest is mixed to target weights and packed.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlink.llm.jaccard_join import jaccard_join
from contactlink.llm.mixing import mix
from contactlink.llm.packing import pack
from contactlink.llm.queries import BYTE_BPE
from contactlink.llm.substring_dedup import substring_dedup
from contactlink.llm.tables import table
from contactlink.llm.toxicity import toxicity
from contactlink.operators.storage import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted probability of being toxic is under one half."""
    return toxicity(docs, table(spark, sf_dir, "labels")).filter("NOT toxic").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word 5-gram Jaccard similarity of 0.75 or more, the one with the smallest id. Documents
    without words or id are in no group and stay."""
    groups = jaccard_join(docs.select("doc_id", "text"))
    copies = materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that start earlier in the corpus; ``n_chars`` follows. A text that loses
    nothing keeps its spacing; a document that loses all its words goes."""
    cut = substring_dedup(docs, verbatim=True).filter("n_removed = 0 OR n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": chars}).select(*docs.columns)


#: Pieces of text a task's token table holds and bytes it works on at a time. Workers go on to the next stage with what they
#: hold, so mixing and packing share one table, smaller than that of an operator by itself.
ROOM, SLICE_BYTES = 100_000, 1 << 20

#: Domains and weights of the mixing stage; toxic documents are gone by then.
WEIGHTS = {"good": 0.9, "poor": 0.1}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rate says, in expectation: those with a rate under one are thinned out, those
    with a rate over one come more than once. The budget is all tokens there are, so rates are one on average."""
    mix_of = mix(docs, table(spark, sf_dir, "labels"), weights=WEIGHTS, tokenizer=BYTE_BPE, room=ROOM, slice_bytes=SLICE_BYTES).filter("copies > 0")
    return mix_of.withColumn("copies", F.explode(F.expr("array_repeat(1, cast(copies AS int))"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs, BYTE_BPE, room=ROOM, slice_bytes=SLICE_BYTES)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifiers of two stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


REGISTRY = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
