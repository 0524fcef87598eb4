"""Query registry: each operator query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweft.functions.frames import snap

# Moves exact halves off the rounding boundary, where engines round differently.
NUDGE = 3e-10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles, bigint counts, ISO text dates."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = snap(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def out(ctes: str, body: str, cols: str, digits: int = 6) -> str:
    """Oracle text: ``body`` over ``ctes`` with the casts of :func:`finish`.

    ``cols`` lists ``name:kind`` with kind f double, i bigint, d date,
    t timestamp, a text array, b boolean, s text.
    """
    sel = []
    for item in cols.split():
        name, kind = item.split(":")
        sel.append(
            {
                "f": f"round(CAST({name} AS DOUBLE) + {NUDGE}, {digits}) + 0.0 AS {name}",
                "i": f"CAST({name} AS BIGINT) AS {name}",
                "d": f"strftime(CAST({name} AS DATE), '%Y-%m-%d') AS {name}",
                "t": f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}",
                "a": f"array_to_string({name}, '|') AS {name}",
                "b": f"{name}",
                "s": f"CAST({name} AS VARCHAR) AS {name}",
            }[kind]
        )
    word = "WITH RECURSIVE" if "UNION ALL" in ctes else "WITH"
    head = f"{word} {ctes},\n" if ctes.strip() else "WITH "
    return f"{head}final AS (\n{body}\n)\nSELECT {', '.join(sel)} FROM final"
