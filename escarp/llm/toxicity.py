"""Toxicity by a classifier chain.

The chain predicts toxicity categories one after another: marked (toxic, with a word that speaks for
toxicity), repeated (toxic, with such words three times or more) and toxic itself. The linear model of
a category sees which lexicon words a text has and the probabilities of the earlier categories. For
training these are out-of-fold: each row gets them from models that have not seen it, so a later
model learns how far the earlier ones can be trusted; for scoring they come from models of all rows.

The labels have one toxicity mark; the other two categories are derived from it and the words.

The lexicon holds whole words and beginnings of words (runs of letters, in lower case), those that
tell toxic and other labelled texts apart best. It and the chain are fitted on a sample whose size is
a parameter; both are of fixed size and broadcast.

Defined results: NULL and empty texts have no words; labels that are NULL or of unknown ids train
nothing; a category without examples has probability 0 and one without others 1; with no training
rows nothing is rejected; repeated rows and ids each keep their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from escarp.llm.samples import labelled_sample
from escarp.llm.texts import gathered, lowered, slices, words_of

CATEGORIES = ("marked", "repeated", "toxic")
SAMPLE_ROWS = 8_000
LEXICON = 192
#: Lexicon words that count as marks, and how often a text must have them to be `repeated`.
MARKS, REPEATED = 64, 3
#: Lengths of the beginnings of words, in characters.
BEGINNINGS = (3, 4, 5)
FOLDS = 5
PENALTY = 0.05
THRESHOLD = 0.5


def _letters(data: np.ndarray) -> np.ndarray:
    """Lower case, with blanks for every ASCII character that is no letter."""
    data = lowered(data)
    return np.where((data < 97) | ((data > 122) & (data < 128)), 0x20, data).astype(np.uint8)


def _terms(spelling: bytes) -> list[str]:
    """The word itself and its beginnings, as lexicon entries."""
    word = spelling.decode(errors="replace")
    return ["=" + word] + [f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n]


def _lexicon(sample: DataFrame) -> tuple[list[str], int]:
    """Entries by how well they tell labels apart, marks first; and how many are marks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            words = words_of(_letters(data), offsets)
            spelled = words.spellings.to_pylist()
            toxic = rows.column(1).to_pylist()
            counts: dict[str, list[int]] = {}
            for row, (a, b) in enumerate(zip(words.rows[:-1], words.rows[1:], strict=True)):
                own = {t for c in np.unique(words.codes[a:b]).tolist() for t in _terms(spelled[c])}
                for term in own:
                    counts.setdefault(term, [0, 0])[toxic[row]] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(counts), pa.string()),
                    pa.array([n[1] for n in counts.values()], pa.int64()),
                    pa.array([n[0] for n in counts.values()], pa.int64()),
                ],
                ["term", "toxic", "other"],
            )

    rows = sample.groupBy("toxic").count().collect()
    sizes = {row["toxic"]: row["count"] for row in rows}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        return [], 0
    counts = sample.select("text", "toxic").mapInArrow(
        counted, "term string, toxic long, other long"
    )
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    counts = counts.filter("t + o >= 3")
    ratio = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_other + 1))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    z = counts.select("term", (ratio / spread).alias("z"))
    best = z.orderBy(F.desc(F.abs("z")), "term").limit(LEXICON).collect()
    marks = [r["term"] for r in best if r["z"] > 3.0][:MARKS]
    others = [r["term"] for r in best if r["term"] not in set(marks)]
    return marks + others, len(marks)


def _presence(data: np.ndarray, offsets: np.ndarray, place: dict[str, int]) -> np.ndarray:
    """How often each row has each lexicon entry."""
    words = words_of(_letters(data), offsets)
    out = np.zeros((len(offsets) - 1, len(place)))
    if not len(words.codes) or not place:
        return out
    found = [
        (code, at)
        for code, word in enumerate(words.spellings.to_pylist())
        for term in _terms(word)
        if (at := place.get(term, -1)) >= 0
    ]
    if not found:
        return out
    code, at = np.array(found, np.int64).T
    starts = np.searchsorted(code, np.arange(len(words.spellings) + 1))
    entries = np.diff(starts)[words.codes]
    row = np.repeat(np.repeat(np.arange(len(out)), np.diff(words.rows)), entries)
    cells = row * len(place) + gathered(at, starts[words.codes], entries)
    return np.bincount(cells, minlength=out.size).reshape(out.shape).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column is the bias."""
    w = np.zeros(x.shape[1])
    if not y.any() or y.all():
        w[-1] = 35.0 if y.any() else -35.0
        return w
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-6
    for _ in range(12):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """One weight vector per category: words, earlier probabilities, bias."""
    chain, given = [], np.zeros((len(x), 0))
    one = np.ones((len(x), 1))
    for k in range(y.shape[1]):
        inputs = np.hstack((x, given, one))
        chain.append(_logistic(inputs, y[:, k]))
        outside = np.zeros(len(x))
        for f in np.unique(fold):
            rest = fold != f
            held = _logistic(inputs[rest], y[rest, k]) if rest.any() else chain[-1]
            outside[~rest] = _sigmoid(inputs[~rest] @ held)
        given = np.hstack((given, outside[:, None]))
    return chain


def run_chain(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all categories."""
    given = np.zeros((len(x), 0))
    for weights in chain:
        inputs = np.hstack((x, given, np.ones((len(x), 1))))
        given = np.hstack((given, _sigmoid(inputs @ weights)[:, None]))
    return given


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[dict[str, int], list[np.ndarray]]:
    """(place of each lexicon entry, weights of the chain) from the column `toxic` of the labels."""
    sample = labelled_sample(docs, labels, ["toxic"], SAMPLE_ROWS, id_col, text_col)
    words, marks = _lexicon(sample)
    place = {term: i for i, term in enumerate(words)}
    if not words:
        return {}, [np.array([0.0] * k + [-35.0]) for k in range(len(CATEGORIES))]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, "text"):
            counts = _presence(data, offsets, place).astype(np.int32)
            cells = pa.FixedSizeListArray.from_arrays(pa.array(counts.reshape(-1)), len(place))
            lists = cells.cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), lists], ["lot", "toxic", "n"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        n = np.concatenate([b.column(2).flatten().to_numpy() for b in rows]).reshape(-1, len(place))
        lot = np.concatenate([b.column(0).to_numpy() for b in rows])
        toxic = np.concatenate([b.column(1).to_numpy() for b in rows]) > 0
        hits = n[:, :marks].sum(axis=1)
        y = np.stack((toxic & (hits > 0), toxic & (hits >= REPEATED), toxic), axis=1).astype(float)
        for k, weights in enumerate(fit_chain((n > 0).astype(float), y, lot % FOLDS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([weights.tolist()], pa.list_(pa.float64()))], ["k", "weights"]
            )

    rows = sample.select("text", "lot", "toxic").mapInArrow(counted, "lot long, toxic int, n array<int>")
    ordered = rows.repartition(1).sortWithinPartitions("lot", "toxic", "n")
    found = ordered.mapInArrow(learnt, "k long, weights array<double>").collect()
    return place, [np.array(r["weights"]) for r in sorted(found, key=lambda r: r["k"])]


def scored(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, p_marked, p_repeated, p_toxic, is_toxic): `row` holds all columns of the document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chain = model.value
        for rows, data, offsets in slices(batches, "text"):
            p = run_chain((_presence(data, offsets, place) > 0).astype(float), chain)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], ["id", *names]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), text)
    schema = source.select("id").schema
    for name in names:
        schema = schema.add(name, "double")
    out = source.mapInArrow(run, schema)
    return out.select(
        F.col("id").alias("row"), *names, (F.col("p_toxic") >= THRESHOLD).alias("is_toxic")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain does not call toxic, unchanged."""
    kept = scored(docs, labels).filter(~F.col("is_toxic"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
