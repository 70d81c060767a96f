"""Exact deduplication by a stateful stream.

The digests of the texts are streamed into keyed state on disk (RocksDB, no expiry): for each
digest the number of rows, the stable id of the row that stays and the locator of its content (file
and row in it). The state is then read as a table. A digest with more than one row is a hit: the
full bytes of its rows are compared with those at the locator. Rows whose bytes differ under one
digest are grouped anew by their bytes, so a collision costs time, not results.

Everything is built-in functions. Counting and choosing combine before the shuffle, so a text that
a third of all rows share is one state row a task; the comparison is a join that Spark may split.

Defined results: NULL is the empty text. The row with the largest id stays, of equal ids the one
with the largest locator; NULL ids are smallest. Other columns are not read. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from escarp.llm.texts import lower_ascii
from escarp.session import materialize, scratch_dir

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Without this every state partition reserves several MB of disk for its logs.
_RESERVE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"

#: Rows of a group that are compared with their kept text in one place.
GROUP_ROWS = 1024


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame, scratch: str) -> tuple[DataFrame, Column]:
    """The documents as a scan of files, and the locator (file, row) of each row.

    A frame that is no plain scan is written to the shared folder first.
    """
    try:
        scan, metadata = docs, docs.metadataColumn("_metadata")
        scan.select(metadata["file_path"], metadata["row_index"]).schema  # noqa: B018
    except AnalysisException:
        scan = materialize(docs, f"{scratch}/input")
        metadata = scan.metadataColumn("_metadata")
    locator = F.struct(
        metadata["file_path"].alias("file"), metadata["row_index"].alias("row")
    )
    return scan, locator


def remember(feed: DataFrame, checkpoint: str) -> DataFrame:
    """Run a stream of (digest, id, at) to its end; the keyed state as (digest, n, keep).

    A later run with the same checkpoint goes on from the state that is there.
    """
    spark = feed.sparkSession
    state = feed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "at")).alias("keep")
    )
    with _setting(spark, _PROVIDER, _ROCKS), _setting(spark, _RESERVE, "false"):
        run = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        stored = spark.read.format("statestore").load(checkpoint)
    key = stored.schema["key"].dataType.names[0]
    count, keep = stored.schema["value"].dataType.names
    return stored.select(
        F.col("key")[key].alias("digest"),
        F.col("value")[count].alias("n"),
        F.col("value")[keep].alias("keep"),
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_col: str = "at"
) -> tuple[DataFrame, DataFrame]:
    """(verdict, rows): (id, at, digest, n, keep) of every row, and the documents with `at_col` added.

    `at` is the row's locator, `keep` the (id, at) of the row that stays, `n` the group's size.
    """
    spark = docs.sparkSession
    scratch = scratch_dir(spark)
    scan, locator = located(docs, scratch)
    text = lower_ascii(F.col(text_col).cast("string"))
    narrow = scan.select(
        _digest(text).alias("digest"), F.col(id_col).alias("id"), locator.alias("at")
    )
    feed = materialize(narrow, f"{scratch}/feed")
    stream = spark.readStream.schema(feed.schema).parquet(f"{scratch}/feed")
    state = materialize(remember(stream, f"{scratch}/state"), f"{scratch}/remembered")

    # a large group is compared in as many places as it has thousands of rows
    hits = state.filter("n > 1").withColumn("last", F.expr(f"n div {GROUP_ROWS}"))
    texts = scan.select(_digest(text).alias("digest"), locator.alias("at"), text.alias("bytes"))
    members = texts.join(hits, "digest").withColumn("place", F.expr("pmod(xxhash64(at), last + 1)"))
    stays = members.filter(F.col("at") == F.col("keep.at")).select(
        "digest", F.explode(F.expr("sequence(0L, last)")).alias("place"), F.col("bytes").alias("kept_bytes")
    )
    compared = members.join(stays, ["digest", "place"])
    unequal = compared.filter("bytes <> kept_bytes").select("digest").distinct()
    unequal = materialize(unequal, f"{scratch}/unequal")
    if unequal.isEmpty():
        return feed.join(state, "digest"), scan.withColumn(at_col, locator)
    return _regrouped(feed, state, texts, unequal), scan.withColumn(at_col, locator)


def _regrouped(
    feed: DataFrame, state: DataFrame, texts: DataFrame, unequal: DataFrame
) -> DataFrame:
    """The verdict where some digests stand for more than one text: those by their bytes."""
    apart = texts.join(unequal, "digest", "left_semi").join(feed, ["digest", "at"])
    groups = apart.groupBy("digest", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "at")).alias("keep")
    )
    rest = feed.join(unequal, "digest", "left_anti").join(state, "digest")
    return rest.unionByName(apart.join(groups, ["digest", "bytes"]).drop("bytes"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    found, _ = deduplicated(docs, id_col, text_col)
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the rows whose text another row keeps."""
    at_col = "at"
    while at_col in docs.columns:
        at_col += "_"
    found, rows = deduplicated(docs, id_col, text_col, at_col)
    dropped = found.filter(F.col("at") != F.col("keep.at")).select(F.col("at").alias(at_col))
    return rows.join(dropped, at_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
