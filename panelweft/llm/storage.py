"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweft.session import _checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        _checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lost executors don't undo it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(df: DataFrame, key: str = "doc_id", text: str = "text", rest: list[str] | None = None) -> DataFrame:
    """The key and the text under fixed names; other columns, whatever their names, stay behind or go along in a struct ``rest``."""
    out = [F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]
    return df.select(*out, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []))


def along(ddl: str, df: DataFrame) -> StructType:
    """A schema, with the column ``rest`` if df has it."""
    schema = StructType.fromDDL(ddl)
    return schema.add(df.schema["rest"]) if "rest" in df.columns else schema


def with_rest(batch: pa.RecordBatch, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """A batch of the columns, with the input's ``rest`` if it has one."""
    if "rest" in batch.schema.names:
        columns, names = [*columns, batch.column("rest")], [*names, "rest"]
    return pa.RecordBatch.from_arrays(columns, names=names)
