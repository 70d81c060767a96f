"""Typed readers and writers: area trees, CSV, rasters, scenes, patch shards, saved settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from escarp.operators.patches import with_shard

AREA_SCHEMA = (
    "latitude double, longitude double, name string, "
    "n_boulder bigint, n_winter bigint, n_rock bigint, n_views bigint"
)
TEST_PATCH_SCHEMA = (
    "B array<array<float>>, G array<array<float>>, N array<array<float>>, "
    "R array<array<float>>, S array<array<float>>, cliff_id string"
)
MODEL_PATCH_SCHEMA = (
    "R array<array<float>>, G array<array<float>>, B array<array<float>>, "
    "N array<array<float>>, height float, pixel_count float, mp_score float, cliff_id float"
)
TERRAIN_PATCH_SCHEMA = (
    "R array<array<float>>, G array<array<float>>, B array<array<float>>, "
    "N array<array<float>>, slope float, aspect float"
)


_ROOT_FIELDS = (
    "name string, url string, lat double, long double, gps2 string, "
    "totalViews bigint, types array<string>, children string"
)


def in_reading_order(rows: DataFrame, out: str = "ordinal") -> DataFrame:
    """`rows`, read from files, with their 0-based number by file name, then place in the file.

    A split of a file is read by one task from its start to its end, so a row's number is its place in
    the split plus the rows of the splits before. Only one row per split is summed up; the numbers are
    the same for every size of splits and every order in which tasks take them.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row_at"),
    )
    splits = placed.groupBy("_file", "_block").agg(
        F.min("_row_at").alias("_low"), F.count(F.lit(1)).alias("_n")
    )
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    of_file = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    in_file = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(of_file), F.lit(0)).alias("_before"))
    before = F.col("_before") + F.coalesce(F.sum("_n").over(in_file), F.lit(0))
    shifts = splits.join(files, "_file").select("_file", "_block", (before - F.col("_low")).alias("_shift"))
    numbered = placed.join(shifts, ["_file", "_block"])
    return numbered.select((F.col("_row_at") + F.col("_shift")).alias(out), *rows.columns)


def read_area_tree(spark: SparkSession, path: str, one_list: bool = False) -> DataFrame:
    """Root areas as (ordinal, node VARIANT).

    By default one root area per line, which splits over tasks. `one_list` reads files that hold
    one JSON list each; such a file is one document and is read by one task, its root areas then
    spread. `ordinal` numbers the root areas in reading order, whatever the size of splits.
    """
    if one_list:
        # children stay raw text here, so only single root areas become variants
        roots = spark.read.schema(_ROOT_FIELDS).option("multiLine", True).json(path)
        scalars = F.to_json(F.struct(*[c for c in roots.columns if c != "children"]))
        opened = F.regexp_replace(scalars, r"\}$", ', "children": ')
        whole = F.concat(opened, F.col("children"), F.lit("}"))
        node = F.parse_json(F.coalesce(whole, scalars)).alias("node")
        return in_reading_order(roots).select("ordinal", node)
    return in_reading_order(spark.read.option("singleVariantColumn", "node").json(path))


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header line and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """A stage as Parquet, partitioned for pruning when asked."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_shards(
    rows: DataFrame,
    path: str,
    key: str,
    ties: Sequence[str],
    n_shards: int,
    columns: Sequence[str] | None = None,
    rows_per_file: int = 1_000_000,
) -> None:
    """One folder per shard, with only the chosen columns.

    A shard is written in runs of at most `rows_per_file` rows, so a task never holds more than
    a few files however large a shard is.
    """
    placed = with_shard(rows, key, ties, n_shards)
    run = F.floor(F.col("ordinal") / rows_per_file)
    kept = placed.repartition("shard", run).select("shard", *(columns or rows.columns))
    kept.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All shards a path pattern names, with a fixed schema."""
    return spark.read.schema(schema).parquet(pattern)


def save_settings(best: DataFrame, path: str, run_id: int) -> None:
    """Append the best settings of one run; earlier runs stay."""
    best.withColumn("run_id", F.lit(run_id).cast("bigint")).write.mode("append").parquet(path)
