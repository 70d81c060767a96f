"""Quality classifier: logistic regression on hashed word n-grams by FTRL-proximal.

Words and pairs of neighbouring words are hashed into 2^BUCKETS places; a document has each of its
places once, all with the same value, so that its vector has length 1. The model is fitted online:
each row moves the per-coordinate sums that the regularised leader is computed from. Tasks hash the
sample's texts in parallel; the one pass over the rows, which follow-the-leader needs in order, is a
single task over a sample whose size is a parameter. The weights (a fixed number) are broadcast, and
a score is a sparse dot product.

Defined results: NULL and empty texts have only the bias; NULL ids are held out by the split rule
on the empty text; unlabelled rows, NULL labels and labels of unknown ids train nothing; with no
training rows every score is the prior 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escarp.llm.samples import labelled_sample
from escarp.llm.texts import lowered, remainder, slices, words_of

BUCKETS = 18
#: Labelled documents that the model is fitted on, and passes over them.
SAMPLE_ROWS = 12_000
PASSES = 4
ALPHA, BETA, L1, L2 = 10.0, 1.0, 0.0005, 0.0005
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all rows, first of each row): distinct hashed words and word pairs, bias 0."""
    words = words_of(lowered(data), offsets)
    used, codes = np.unique(words.codes, return_inverse=True)
    spelled = words.spellings.take(pa.array(used)).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))
    hashes = known[codes]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.rows))
    pair = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pair ^= pair >> np.uint64(31)
    inside = row[1:] == row[:-1]
    rows = np.concatenate((np.arange(len(offsets) - 1), row, row[1:][inside]))
    size = np.uint64((1 << BUCKETS) - 1)
    places = np.concatenate((hashes % size, pair[inside] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - BUCKETS)))
    places = np.concatenate((np.zeros(len(offsets) - 1, np.int64), 1 + (places % size).astype(np.int64)))
    both = np.unique((rows << BUCKETS) | places)
    starts = np.searchsorted(both, np.arange(len(offsets)) << BUCKETS)
    return both & ((1 << BUCKETS) - 1), starts


class Ftrl:
    """FTRL-proximal for logistic loss, one row at a time."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, label: int) -> None:
        value = 1.0 / np.sqrt(len(places))
        own = self.weights(places)
        p = 1.0 / (1.0 + np.exp(-np.clip(own.sum() * value, -35, 35)))
        g = (p - label) * value
        n = self.n[places]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[places] += g - sigma * own
        self.n[places] = n + g * g


def fit(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int = 5, held_out: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> np.ndarray:
    """Weights, one per place, from labelled rows whose remainder is not `held_out`."""
    allowed = labels.filter(remainder(F.col(id_col), modulus) != held_out)
    sample = labelled_sample(docs, allowed, [label], SAMPLE_ROWS, id_col, text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            places, starts = features(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], lists], ["lot", "label", "places"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(1 << BUCKETS)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("places"))
            offsets, places = lists.offsets.to_numpy(), lists.values.to_numpy()
            marks = batch.column(batch.schema.get_field_index("label")).to_pylist()
            for a, b, mark in zip(offsets[:-1], offsets[1:], marks, strict=True):
                model.learn(places[a:b], mark)
        weights = model.weights()
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(weights[some])], ["place", "weight"])

    rows = sample.select("text", "lot", F.col(label).alias("label")).mapInArrow(
        hashed, "lot long, label int, places array<int>"
    )
    ordered = (
        rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))
        .repartition(1)
        .sortWithinPartitions("turn", F.xxhash64("turn", "lot"), "lot")
        .select("label", "places")
    )
    weights = np.zeros(1 << BUCKETS)
    for row in ordered.mapInArrow(learnt, "place long, weight double").collect():  # <= 2^BUCKETS
        weights[row["place"]] = row["weight"]
    return weights


def scored(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5,
    held_out: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(
        fit(docs, labels, label, modulus, held_out, id_col, text_col)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            places, starts = features(data, offsets)
            sums = np.add.reduceat(weights.value[places], starts[:-1])
            scores = 1.0 / (1.0 + np.exp(-np.clip(sums / np.sqrt(np.diff(starts)), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(scores)], ["id", "held_out", "score"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    apart = (remainder(F.col(id_col), modulus) == held_out).alias("held_out")
    source = docs.select(F.col(id_col).alias("id"), apart, text)
    id_type = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {id_type}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed(
        "id", id_col
    )
