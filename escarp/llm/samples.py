"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOTS = 1 << 30


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    columns: list[str],
    most: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, text, lot, label columns) of about `most` labelled documents, chosen by a hash of the id.

    Labels without id or value are left out; of a repeated id the largest labels count. The chosen
    labels are broadcast: `most` bounds their number (in expectation, with a spread of its root). An
    id has one row in the sample, of repeated ids the text with the smallest hash, so `most` bounds the
    rows too and no id outweighs the others.
    """
    whole = labels.filter(F.col(id_col).isNotNull())
    whole = whole.groupBy(F.col(id_col).alias("id")).agg(
        *[F.max(c).cast("int").alias(c) for c in columns]
    )
    whole = whole.dropna().withColumn("lot", F.pmod(F.xxhash64("id", F.lit("lot")), F.lit(_LOTS)))
    part = min(1.0, most / max(whole.count(), 1))
    chosen = whole.filter(F.col("lot") < int(part * _LOTS))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col(id_col).alias("id"), text)
    rows = texts.join(F.broadcast(chosen), "id")
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    return rows.groupBy("id", "lot", *columns).agg(one).select("id", "text", *columns, "lot")
