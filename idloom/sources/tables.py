"""Reading raw tables: configured relations, Parquet locations, CSV seeds, base views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from idloom.operators.relational import empty, latest, union_aligned


def source(spark: SparkSession, config: dict, name: str, table: str | None = None) -> DataFrame:
    """A raw table by configuration: ``location`` {schema, table, path} overrides; the schema defaults to the source's name
    and the table to 'events'."""
    at = config.get(name, {}).get("location", {})
    if at.get("path"):
        return spark.read.parquet(at["path"])
    return spark.table(f"{at.get('schema', name)}.{table or at.get('table', 'events')}")


def parquet_location(spark: SparkSession, root: str, schema: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{schema}/{table}/*.parquet")


def csv_seed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header whose fields may hold quoted JSON over several lines."""
    r = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return r.schema(schema).csv(path) if schema else r.csv(path)


def base_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def union_calls(parts: dict[str, DataFrame], allowed: dict[str, list[str]] | None, table: str, keys: tuple[str, ...] = ("id", "segment_source"), schema: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """One call table of several web sources: allow-listed ones, aligned by name, with the source each row comes from,
    the latest ``received_at`` of each id. Without a source, a typed empty table of ``schema``."""
    use = {n: d for n, d in parts.items() if allowed is None or table in allowed.get(n, [])}
    if not use:
        if schema is None or spark is None:
            raise ValueError(f"no source has the table {table}, and no schema is given for an empty one")
        return empty(spark, schema)
    u = union_aligned(use, "segment_source")
    return latest(u, list(keys), ["received_at"])


def union_tracks(parts: dict[str, DataFrame]) -> DataFrame:
    """The configured track tables as one, the latest ``received_at`` of each id whatever its source."""
    return union_calls(parts, None, "tracks", ("id",))


def write_partitioned(df: DataFrame, path: str, time: str = "occurred_at", cluster: tuple[str, ...] = ()) -> None:
    """Write by month of a time column, each partition sorted by the cluster keys."""
    from pyspark.sql import functions as F

    out = df.withColumn("occurred_month", F.date_format(time, "yyyy-MM"))
    out = out.repartition("occurred_month", *cluster[:1]).sortWithinPartitions("occurred_month", *cluster)
    out.write.mode("overwrite").partitionBy("occurred_month").parquet(path)
