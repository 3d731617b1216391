"""Registration of queries and of the SQL they are compared with."""

from __future__ import annotations

import datetime as dt
import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regulith.session import configure
from regulith.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = dt.datetime(2024, 1, 30)  # the event tables end here
ORDERS_AS_OF = dt.datetime(1998, 6, 1)  # inside the order dates

# Shorthands inside the comparison SQL: date, timestamp, list, rounded double, bigint, rounded score.
SQL_SLOTS = [
    (r"<<d:(.*?)>>", r"cast(\1 as varchar)"),
    (r"<<t:(.*?)>>", r"strftime(\1, '%Y-%m-%d %H:%M:%S')"),
    (r"<<a:(.*?)>>", r"array_to_string(\1, ',')"),
    (r"<<r:(.*?)>>", r"round(cast(\1 as double), 6)"),
    (r"<<i:(.*?)>>", r"cast(\1 as bigint)"),
]


class Views:
    """Tables and views of one scale factor, loaded on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return adapters.view(self.spark, self.dir, name)

    def dealt(self, name: str) -> DataFrame:
        """A view whose rows are dealt to all cores: the test tables are files of one row group, which one task would read."""
        return self(name).repartition(self.spark.sparkContext.defaultParallelism)


def plain(df: DataFrame) -> DataFrame:
    """Columns in types that both engines print alike."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.StringType, T.DateType)):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql_text(body: str) -> str:
    text = adapters.oracle(body)
    for pattern, value in SQL_SLOTS:
        text = re.sub(pattern, value, text, flags=re.S)
    return text


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its comparison SQL if there is one."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(fn(Views(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql_text(sql)
        return fn

    return register
