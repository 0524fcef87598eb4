"""Training corpus from raw documents: five stages, each over all that the one before kept.

Every stage reads (doc_id, text, lang, source, n_chars) and returns the same columns, but for the last,
which returns token ids. Stages are written to the shared folder and read again, so a lost executor
repeats part of one stage only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweft.llm import bpe, fmindex, neardup, substrings, toxicity
from panelweft.llm.storage import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that score as much are rejected.
TOXIC = 0.5


def _columns(rows: DataFrame, text) -> DataFrame:
    """The columns of documents, from a struct ``rest`` and the text that a stage leaves."""
    out = rows.select(text.alias("text"), *(F.col("rest")[c].alias(c) for c in COLUMNS if c not in ("text", "n_chars")))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, rest=COLUMNS)
    return scored.where(F.col("score") < TOXIC).select("rest.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates; rows without doc_id stay.

    Rows that share a doc_id are documents of their own: one that is nobody's near duplicate stays.
    """
    rows = kept(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    group = neardup.join(rows.where("doc_id is not null"), key="row").select(F.col("doc_id").alias("row"), "group_id")
    first = rows.select("doc_id", "row").join(group, "row").groupBy("group_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    return rows.join(first.select("first.row"), "row").select(*COLUMNS).unionByName(rows.where("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller doc_id has; texts without such passages stay as they are."""
    found = substrings.dedup(docs, rest=COLUMNS)
    return _columns(found, F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("rest.text")))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items."""
    found = fmindex.find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rest=[c for c in COLUMNS if c != "text"], cut=True)
    return _columns(found, F.col("text"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and the digest of what they decode to."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", to_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = kept(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
