"""CSV and Parquet scans of the coupon tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponflow.sources import schemas


#: Column names that the files spell differently.
IN_FILES = {"discount_rate_text": "discount_rate"}


def check_header(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Columns are read by place, so a header with other names or another order is an error."""
    found = [c.strip().lower() for c in spark.read.option("header", True).csv(path).columns]
    for place, (name, wanted) in enumerate(zip(found, schema.names)):
        if name not in (wanted, IN_FILES.get(wanted)):
            raise ValueError(f"column {place + 1} of {path} is {name}, not {wanted}")
    if len(found) != len(schema.names):
        raise ValueError(f"{path} has {len(found)} columns, not {len(schema.names)}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with ``null`` for missing values and ``yyyyMMdd`` dates."""
    check_header(spark, path, schema)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "null")
        .option("dateFormat", "yyyyMMdd")
        .option("mode", "FAILFAST")
        .option("enforceSchema", True)
        .csv(path)
    )


@dataclass
class Ingested:
    """``rows``: the good ones; ``quarantine``: ``file, line`` of the others; ``counts``: ``file, good, bad``."""

    rows: DataFrame
    quarantine: DataFrame
    counts: DataFrame
    total: int
    bad: int


class TooManyBadRows(ValueError):
    pass


_BAD, _FILE = "_bad_line", "_file"


def ingest_csv(
    spark: SparkSession, path: str, schema: T.StructType, folder: str, most_bad: float = 0.001
) -> Ingested:
    """Parse a CSV table once into Parquet under ``folder``; lines that do not fit the schema go to quarantine.

    A line is bad if a value is no number or day, or if it has too few or too many values. The tables ``rows``, ``quarantine`` and
    ``counts`` are written in any case; more than ``most_bad`` of bad lines is an error then, which names the worst file.
    """
    check_header(spark, path, schema)
    parsed = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())]))
        .option("header", True)
        .option("nullValue", "null")
        .option("dateFormat", "yyyyMMdd")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .option("enforceSchema", True)
        .csv(path)
        .withColumn(_FILE, F.input_file_name())
    )
    # One pass over the source; good rows and bad lines end up in folders of their own.
    is_bad = F.col(_BAD).isNotNull()
    parsed.withColumn("bad", is_bad).write.partitionBy("bad").parquet(f"{folder}/parsed")
    everything = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType()), T.StructField(_FILE, T.StringType()), T.StructField("bad", T.BooleanType())])
    table = spark.read.schema(everything).parquet(f"{folder}/parsed")
    counts = table.groupBy(F.col(_FILE).alias("file")).agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    counts.write.parquet(f"{folder}/counts")
    table.where("bad").select(F.col(_FILE).alias("file"), F.col(_BAD).alias("line")).write.parquet(f"{folder}/quarantine")
    counts = spark.read.parquet(f"{folder}/counts")
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if bad > most_bad * (good + bad):
        worst = counts.orderBy(F.desc("bad"), "file").first()
        raise TooManyBadRows(f"{bad} of {good + bad} lines are bad, {worst['bad']} of them in {worst['file']}; see {folder}/quarantine")
    rows = table.where(~F.col("bad")).select(*schema.names)
    return Ingested(rows, spark.read.parquet(f"{folder}/quarantine"), counts, good + bad, bad)


def offline_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.OFFLINE)


def offline_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.OFFLINE_BATCH)


def online_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.ONLINE)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same tables once converted to Parquet, the form to keep them in at scale."""
    return spark.read.schema(schema).parquet(path)
