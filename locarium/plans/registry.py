"""Where queries are registered, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str, table: str = "supplier") -> DataFrame:
    """Place-like rows with coordinates derived from the keys; every 11th has none."""
    p, key = table[0], f"{table[0]}_{'supp' if table == 'supplier' else 'cust'}key"
    k, missing = F.col(key), F.col(key) % 11 == 0
    return load(spark, sf_dir, table).select(
        F.concat(F.lit(p), k.cast("string")).alias("id"),
        F.col(f"{p}_name").alias("name"),
        F.col(f"{p}_nationkey").alias("nation"),
        F.col(f"{p}_acctbal").alias("balance"),
        F.when(~missing, F.lit(25.0) + (k * 37 % 240) / F.lit(10.0)).alias("lat"),
        F.when(~missing, F.lit(-124.0) + (k * 53 % 570) / F.lit(10.0)).alias("lon"),
        k.alias("key"),
    )


def places_sql(table: str = "supplier") -> str:
    p, key = table[0], f"{table[0]}_{'supp' if table == 'supplier' else 'cust'}key"
    return f"""(SELECT '{p}' || {key} AS id, {p}_name AS name, {p}_nationkey AS nation, {p}_acctbal AS balance,
      CASE WHEN {key} % 11 <> 0 THEN 25.0::DOUBLE + ({key} * 37 % 240) / 10.0::DOUBLE END AS lat,
      CASE WHEN {key} % 11 <> 0 THEN -124.0::DOUBLE + ({key} * 53 % 570) / 10.0::DOUBLE END AS lon, {key} AS key FROM {table})"""


def miles_sql(lat: float, lon: float) -> str:
    return f"""CASE WHEN lat IS NULL OR lon IS NULL THEN 'infinity'::DOUBLE ELSE 2 * 3958.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lon - ({lon})) / 2), 2)))) END"""
