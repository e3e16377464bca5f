"""The incident log: files in, raw schema out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline import schema
from kerbline.constants import NULL_LITERAL
from kerbline.session import pin_utc

# The tokens a CSV export may use for a missing value.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A CSV export with headers, to the raw schema. Every file may have its own column order.

    All columns are read as text (no inference pass over the data). Only the first line of each file is read to find
    its header, and files with one header are read together. Line breaks inside quotes are kept; such files cannot be
    split, so say `multiline=False` for exports without them. A row with too few or too many fields raises when the
    rows are read, instead of being shifted or lost.
    """
    pin_utc(spark)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in spark.read.text(path).inputFiles():
        header = spark.read.option("header", True).option("multiLine", multiline).csv(file).columns
        by_header.setdefault(tuple(header), []).append(file)
    if not by_header:
        return align(spark.createDataFrame([], T.StructType([])))
    parts = [align(_csv_files(spark, files, header, multiline)) for header, files in sorted(by_header.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _csv_files(spark: SparkSession, files: list[str], header: tuple[str, ...], multiline: bool) -> DataFrame:
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = (spark.read.schema(text)
          .option("header", True).option("enforceSchema", False).option("multiLine", multiline)
          .option("mode", "FAILFAST").option("quote", '"').option("escape", '"')
          .csv(files))
    return df.select([F.when(~F.col(c).isin(CSV_NULL_TOKENS), F.col(c)).alias(c) for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    pin_utc(spark)
    return align(spark.read.parquet(path))


def incoming(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Newly reported events, given as literal rows with whichever columns are known."""
    pin_utc(spark)
    values = [tuple(row.get(c) for c in schema.RAW_COLUMNS) for row in rows]
    return spark.createDataFrame(values, schema.RAW)


def null_literals(df: DataFrame) -> DataFrame:
    """The literal text NULL becomes null in every text column."""
    return df.select([
        F.nullif(F.col(f.name), F.lit(NULL_LITERAL)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema
    ])


def align(df: DataFrame) -> DataFrame:
    """Pad missing columns with null and put the rest in raw-schema order and types.

    Columns outside the raw schema are kept after the raw ones.
    """
    have = set(df.columns)
    fitted = []
    for field in schema.RAW:
        if field.name not in have:
            fitted.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif df.schema[field.name].dataType == field.dataType:
            fitted.append(F.col(field.name))
        else:
            fitted.append(F.col(field.name).try_cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in set(schema.RAW_COLUMNS)]
    return df.select(*fitted, *extra)
