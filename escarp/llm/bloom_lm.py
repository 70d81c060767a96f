"""Bigram language model in a log-frequency Bloom filter.

An n-gram with count c is entered q(c) = 1 + floor(log2 c) times, as (n-gram, 1) .. (n-gram, q).
Its count is read back by probing (n-gram, 1), (n-gram, 2), ... until one is missing: the last level
found names a range of counts, whose middle is the estimate. A false positive must repeat at every
level, so large errors are exponentially rare, and an estimate is never below its range. Conditional
probabilities are smoothed towards the unigram model:

    p(w | h) = (min(c(h w), c(h)) + mu p(w)) / (c(h) + mu),   p(w) = (c(w) + 1) / (N + V + 1)

with every count probed from the filter.

Counting: tasks hash the n-grams of their texts, add equal ones up, and send them, as packed arrays,
to the part of the hash range they belong to. A part merges what it gets and builds its segment of
the filter: all n-grams of a part live there, so nothing larger than a part is ever in one place,
and as an n-gram is one entry per task no frequent one makes a part hot. The number of parts and the
bits grow with the text, BITS_PER_ENTRY for each entry at every size.

A filter of up to MAX_BITS is broadcast. A larger one stays where its parts are: texts become chunks,
each sends its distinct n-grams to ranges of parts, a range probes them in its segments, and the
levels go back to the chunk. Both ways probe the same bits, so scores are the same.

The exact add-one score needs exact counts. The most frequent HEAD words are broadcast with theirs;
words beyond are joined by hash, and none of them is frequent. Words are told apart by 64-bit hashes.

Defined results: NULL and empty texts are the end alone; a NULL id counts as the empty text for the
split; repeated rows and ids each keep their row; other columns are ignored. With no training rows
every count is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escarp.llm.texts import lowered, remainder, slices, words_of
from escarp.session import materialize, scratch_dir

MAX_BITS = 1 << 30
BITS_PER_ENTRY = 10
PROBES = 5
HEAD = 1 << 18
MU = 20.0
#: Text characters for each part of the hash range, most parts, and n-grams that a task adds up at
#: once. A part is one row, of a few MB up to MAX_PARTS x PART_CHARS.
PART_CHARS = 4 << 20
MAX_PARTS = 1 << 16
FLUSH = 3 << 20
#: Bits of the segments that a range holds, and tokens of a chunk, where the filter is not broadcast.
RANGE_BITS = 1 << 27
CHUNK_TOKENS = 1 << 20

END = np.uint64(xxhash.xxh3_64_intdigest(b"\x20end"))  # no word holds a blank
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each row); every row ends with the end token."""
    words = words_of(lowered(data), offsets)
    used, codes = np.unique(words.codes, return_inverse=True)
    spelled = words.spellings.take(pa.array(used)).to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))
    rows = words.rows + np.arange(len(words.rows))
    tokens = np.full(int(rows[-1]), END, np.uint64)
    place = np.ones(len(tokens), bool)
    place[rows[1:] - 1] = False
    if len(codes):
        tokens[place] = known[codes]
    return tokens, rows


def bigrams(tokens: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the context of each token, hash of the bigram); a row starts after an end."""
    before = np.concatenate(([END], tokens[:-1])) if len(tokens) else tokens
    return before, _mixed(before * _M1 + _mixed(tokens))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else []
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of the hash range of each key, by the high 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _text(docs: DataFrame, *columns: Column, text_col: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *columns)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal n-grams of each part and order added up, in 64 bits."""
    held: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        for part, order, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
            own = held.setdefault((part, order), [])
            own.append(new)
            if len(own) >= 16:
                held[part, order] = [_summed(*map(np.concatenate, zip(*own, strict=True)))]
    for (part, order), own in held.items():
        keys, counts = _summed(*map(np.concatenate, zip(*own, strict=True)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([order], pa.int32()),
                pa.array([int(levels(counts).sum())]),
                pa.array([keys.tobytes()], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()),
            ],
            ["part", "order", "entries", "keys", "counts"],
        )


def count_ngrams(texts: DataFrame, parts: int) -> DataFrame:
    """(part, order, entries, keys, counts): n-grams of each part of the hash range.

    Keys are ascending 64-bit hashes, counts 64-bit; both packed.
    `entries` is how many entries the filter gets from them.
    """

    def packed(keys: np.ndarray, counts: np.ndarray, order: int) -> Iterator[list]:
        keys, counts = _summed(keys, counts)
        cuts = np.searchsorted(_part(keys, parts), np.arange(parts + 1))
        for part in range(parts):
            a, b = cuts[part], cuts[part + 1]
            if a < b:
                yield [part, order, keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes()]

    def sent(held: list[list[tuple]]) -> pa.RecordBatch:
        rows = []
        for order, some in enumerate(held, 1):
            keys = np.concatenate([k for k, _ in some])
            counts = np.concatenate([c for _, c in some])
            rows += packed(keys, counts, order)
        columns = list(zip(*rows, strict=True))
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            ["part", "order", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[], []]
        size = 0
        for _, data, offsets in slices(batches, "text"):
            tokens, rows = token_hashes(data, offsets)
            for some, keys in zip(held, (tokens, bigrams(tokens, rows)[1]), strict=True):
                one = np.unique(keys, return_counts=True)
                some.append(one)
                size += len(one[0])
            if size >= FLUSH:
                yield sent(held)
                held, size = [[], []], 0
        if size:
            yield sent(held)

    sent_as = "part int, order int, keys binary, counts binary"
    merged = "part int, order int, entries long, keys binary, counts binary"
    return texts.mapInArrow(run, sent_as).repartition(parts, "part").mapInArrow(_merged, merged)


def levels(counts: np.ndarray) -> np.ndarray:
    """q(c) = 1 + floor(log2 c) for counts of 1 and more."""
    return np.frexp(counts.astype(np.float64))[1]


def _positions(keys: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """Bit of a probe inside the segment of the key's part."""
    step = np.uint64((level * 0x632BE59BD9B4E019 + probe * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    return (_mixed(keys + step) % np.uint64(bits)).astype(np.int64)


class Filter:
    """Segments of bits, one per part of the hash range; counts are probed."""

    def __init__(
        self, segments: np.ndarray, total: int, distinct: int, parts: int | None = None, first: int = 0
    ):
        """`segments` are those of all parts, or of some of `parts` from the part `first` on."""
        self.segments, self.total, self.distinct = segments, total, distinct
        self.parts, self.bits, self.first = parts or len(segments), segments.shape[1] * 8, first

    @staticmethod
    def segment(pairs: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
        out = np.zeros(bits // 8, np.uint8)
        for keys, counts in pairs:
            own = levels(counts)
            for level in range(1, int(own.max(initial=0)) + 1):
                some = keys[own >= level]
                for probe in range(PROBES):
                    at = _positions(some, level, probe, bits)
                    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    def found(self, keys: np.ndarray) -> np.ndarray:
        """The last level that is there of each key; 0 where none is."""
        found = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        base = (_part(keys, self.parts) - self.first) * (self.bits // 8)
        flat = self.segments.reshape(-1)
        level = 1
        while len(left):
            for probe in range(PROBES):
                at = _positions(keys[left], level, probe, self.bits)
                left = left[(flat[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1) > 0]
            found[left] = level
            level += 1
            if level > 62:
                break
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the range of the last level that is there."""
        return middles(self.found(keys))

    def scores(self, tokens: np.ndarray, rows: np.ndarray, mu: float = MU) -> np.ndarray:
        """log10 probability of each row."""
        return log_scores(tokens, rows, self.counts, self.total, self.distinct, mu)


def middles(found: np.ndarray) -> np.ndarray:
    """The middle of the range of counts that each level names; 0 for no level."""
    low = np.exp2(found.astype(np.float64) - 1.0)
    return np.where(found > 0, (low + 2 * low - 1) / 2, 0.0)


def log_scores(
    tokens: np.ndarray,
    rows: np.ndarray,
    counts: Callable[[np.ndarray], np.ndarray],
    total: int,
    distinct: int,
    mu: float = MU,
) -> np.ndarray:
    """log10 probability of each row; `counts` estimates those of distinct n-grams."""
    before, pair = bigrams(tokens, rows)
    words, word_of = np.unique(tokens, return_inverse=True)
    pairs, first, pair_of = np.unique(pair, return_index=True, return_inverse=True)
    own = counts(words)
    alone = (own + 1) / (total + distinct + 1)
    history = np.searchsorted(words, before[first])
    # the first context of a slice, the end, is a token of every row
    context = own[history]
    both = np.minimum(counts(pairs), context)
    logs = np.log10((both + mu * alone[word_of[first]]) / (context + mu))
    return np.add.reduceat(logs[pair_of], rows[:-1])


def _segment_bits(ngrams: DataFrame) -> int:
    """Bits of a segment: those of the part with the most entries."""
    most = ngrams.groupBy("part").agg(F.sum("entries").alias("n")).agg(F.max("n")).first()[0] or 0
    return max(64, most * BITS_PER_ENTRY // 64 * 64)


def _segments(ngrams: DataFrame, bits: int) -> DataFrame:
    """(part, bits): one segment per part and order; the rows of a part are joined by OR."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, keys, counts in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True
            ):
                pair = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)
                segment = Filter.segment([pair], bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([segment.tobytes()], pa.binary())],
                    ["part", "bits"],
                )

    return ngrams.select("part", "keys", "counts").mapInArrow(build, "part int, bits binary")


def _loaded(segments: DataFrame, parts: int, bits: int, total: int, distinct: int) -> Filter:
    """The whole filter, segment by segment, in the driver."""
    out = np.zeros((parts, bits // 8), np.uint8)
    for row in segments.toLocalIterator():
        out[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return Filter(out, total, distinct)


def _chunk(rows: list[pa.RecordBatch], tokens: np.ndarray, number: int, parts: int, wide: int) -> pa.RecordBatch:
    """The row of a chunk, then its n-grams by range: (chunk, range, data, words, codes)."""
    words, codes = np.unique(tokens, return_inverse=True)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        for batch in rows:
            out.write_batch(batch)
    keys = np.unique(np.concatenate((words, bigrams(tokens, np.zeros(0, np.int64))[1])))
    ranges = _part(keys, parts) // wide
    used, first = np.unique(ranges, return_index=True)
    asked = [k.tobytes() for k in np.split(keys, first[1:])]
    none = [None] * len(used)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * (len(used) + 1)),
            pa.array([-1, *used.tolist()], pa.int32()),
            pa.array([sink.getvalue().to_pybytes(), *asked], pa.binary()),
            pa.array([words.tobytes(), *none], pa.binary()),
            pa.array([codes.astype(np.int32).tobytes(), *none], pa.binary()),
        ],
        ["chunk", "range", "data", "words", "codes"],
    )


def _probed(
    asked: DataFrame, segments: DataFrame, parts: int, bits: int, total: int, distinct: int, schema: str
) -> DataFrame:
    """The rows of all chunks with their scores; a task holds the segments of one range."""
    wide = max(1, RANGE_BITS // bits)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:3]]
            for here, chunk, part, data in zip(*columns, batch.column(3), strict=True):
                if here != now:
                    now, held = here, np.zeros((wide, bits // 8), np.uint8)
                if chunk < 0:
                    held[part - here * wide] |= np.frombuffer(data.as_buffer(), np.uint8)
                    continue
                own = Filter(held, total, distinct, parts, here * wide)
                found = own.found(np.frombuffer(data.as_buffer(), np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([here], pa.int32()), pa.array([found.tobytes()], pa.binary())],
                    ["chunk", "range", "data"],
                )

    def finished(rows: tuple, levels: list[bytes]) -> Iterator[pa.RecordBatch]:
        data, words, codes = rows
        tokens = np.frombuffer(words, np.uint64)[np.frombuffer(codes, np.int32)]
        whole = pa.ipc.open_stream(data).read_all().combine_chunks()
        starts = np.concatenate(([0], np.cumsum(whole["n_tokens"].to_numpy())))
        keys = np.unique(np.concatenate((np.unique(tokens), bigrams(tokens, starts)[1])))
        found = np.frombuffer(b"".join(levels), np.uint8)

        def counts(some: np.ndarray) -> np.ndarray:
            return middles(found[np.searchsorted(keys, some)])

        score = pa.array(log_scores(tokens, starts, counts, total, distinct))
        yield from whole.set_column(whole.schema.get_field_index("score"), "score", score).to_batches()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, levels = None, []
        for batch in batches:
            for _, here, *data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here >= 0:
                    levels.append(data[0])
                    continue
                if rows:
                    yield from finished(rows, levels)
                rows, levels = data, []
        if rows:
            yield from finished(rows, levels)

    number = -(-parts // wide)
    none, nothing = F.lit(-1).cast("long").alias("chunk"), F.lit(None).cast("binary")
    held = segments.select((F.col("part") / wide).cast("int").alias("range"), none, "part", F.col("bits").alias("data"))
    found = (
        asked.filter("range >= 0")
        .select("range", "chunk", F.lit(0).alias("part"), "data")
        .unionByName(held)
        .repartition(number, "range")
        .sortWithinPartitions("range", "chunk", "part")
        .mapInArrow(probe, "chunk long, range int, data binary")
    )
    return (
        asked.filter("range < 0")
        .unionByName(found.select("*", nothing.alias("words"), nothing.alias("codes")))
        .repartition(parts, "chunk")
        .sortWithinPartitions("chunk", "range")
        .mapInArrow(gather, schema)
    )


def scored(
    docs: DataFrame,
    modulus: int = 7,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose remainder (`texts.remainder`) is not `held_out`.
    """
    spark = docs.sparkSession
    scratch = scratch_dir(spark)
    apart = remainder(F.col(id_col), modulus) == held_out
    training = _text(docs.filter(~apart), text_col=text_col)
    chars = training.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(MAX_PARTS, 12 + int(chars // PART_CHARS))
    ngrams = materialize(count_ngrams(training, parts), f"{scratch}/ngrams")

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(keys.as_buffer(), np.int64)),
                        pa.array(np.frombuffer(counts.as_buffer(), np.int64)),
                    ],
                    ["hash", "c"],
                )

    words = ngrams.filter("order = 1").select("keys", "counts").mapInArrow(spelled, "hash long, c long")
    words = materialize(words, f"{scratch}/words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    bits = _segment_bits(ngrams)
    segments = _segments(ngrams, bits)
    small = parts * bits <= MAX_BITS
    whole = _loaded(segments, parts, bits, total, distinct) if small else None
    model = spark.sparkContext.broadcast(whole)
    top = words.orderBy(F.desc("c"), "hash").limit(HEAD).toArrow().sort_by("hash")
    head = spark.sparkContext.broadcast((top["hash"].to_numpy(), top["c"].to_numpy()))

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        number = TaskContext.get().partitionId() << 40
        known, known_counts = head.value
        for rows, data, offsets in slices(batches, "text"):
            tokens, starts = token_hashes(data, offsets)
            n = rows.num_rows
            signed = tokens.view(np.int64)
            at = np.minimum(np.searchsorted(known, signed), max(len(known) - 1, 0))
            hit = known[at] == signed if len(known) else np.zeros(len(signed), bool)
            counts = known_counts[at] if len(known) else np.zeros(len(signed), np.int64)
            logs = np.where(hit, np.log10(counts + 1.0), 0.0)
            tails = np.concatenate(([0], np.cumsum(~hit)))[starts]
            rest = pa.ListArray.from_arrays(pa.array(tails, pa.int32()), pa.array(signed[~hit]))
            score = whole.scores(tokens, starts) if (whole := model.value) else np.zeros(n)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(number + np.arange(n)),
                    rows.column(1),
                    rows.column(2),
                    pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(hit.astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(logs, starts[:-1])),
                    pa.array(score),
                    rest,
                ],
                ["rid", "id", "held_out", "n_tokens", "known", "logs", "score", "rest"],
            )
            yield batch, tokens
            number += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in known_words(batches):
            yield batch

    wide = max(1, RANGE_BITS // bits)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        size = 0
        for one in known_words(batches):
            held.append(one)
            size += len(one[1])
            if size >= CHUNK_TOKENS:
                yield _chunk([b for b, _ in held], np.concatenate([t for _, t in held]), number, parts, wide)
                held, size, number = [], 0, number + 1
        if held:
            yield _chunk([b for b, _ in held], np.concatenate([t for _, t in held]), number, parts, wide)

    source = _text(docs, F.col(id_col).alias("id"), apart.alias("held_out"), text_col=text_col)
    id_type = source.schema["id"].dataType.simpleString()
    schema = (
        f"rid long, id {id_type}, held_out boolean, n_tokens long, known long, logs double, "
        "score double, rest array<long>"
    )
    if small:
        found = source.mapInArrow(run, schema)
    else:
        asked = "chunk long, range int, data binary, words binary, codes binary"
        asked = materialize(source.mapInArrow(ask, asked), f"{scratch}/asked")
        found = _probed(asked, segments, parts, bits, total, distinct, schema)
    found = materialize(found, f"{scratch}/scored")
    # words beyond the head: each is rare, so no key of this join is hot
    rare = found.select("rid", F.explode("rest").alias("hash")).join(words, "hash")
    added = rare.groupBy("rid").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("more_logs")
    )
    scale = F.log10(F.lit(float(total + distinct + 1)))
    return found.drop("rest").join(added, "rid", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )
