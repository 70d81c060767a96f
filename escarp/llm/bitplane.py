"""Token ids in bit-plane files.

File format, all integers little endian:

    "BPLANE1\\n"                     8 bytes
    chunks                          each holds `chunk_ids` ids (the last fewer): for every plane of
                                    the id width one zstandard frame, one after another
    document table                  one zstandard frame: int64 number of ids of each document
    chunk index                     one zstandard frame: per chunk int64 offset, int64 number of
                                    ids, then int64 length of each of its planes
    trailer                         int64 offsets of document table and chunk index, int64 number
                                    of documents, chunks, planes, and bits per plane (1 or 8)

A bit plane holds one bit of every id of the chunk, a byte plane one byte of every id: planes of
high bits are nearly constant and shrink to almost nothing. One chunk can be read alone.

Documents are range-partitioned by id, each partition is sorted and becomes one file, so the files
are in ascending id order; a NULL id comes first. A task writes its file under a name of its own
attempt and hands its name over with the task's rows: files of lost or repeated attempts are named
by no row. Memory of a task is a slice of texts and a chunk of ids, never a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from escarp.llm.texts import AFTER_BLANK, chunks_of, gathered, slices, text_bytes
from escarp.session import materialize, scratch_dir

MAGIC = b"BPLANE1\n"
CHUNK_IDS = 1 << 16
#: Text of one file: with some 2.5 characters an id, a file holds about ten million ids.
FILE_CHARS = 24 << 20
#: Bytes of chunk spellings and their ids that a Python worker keeps; emptied when full.
CACHE_BYTES = 24 << 20
#: Text of chunks that are encoded in one call.
JOINED_BYTES = 1 << 16


def to_planes(ids: np.ndarray, planes: int, bits: int) -> list[bytes]:
    """One plane per bit (bits 1) or per byte (bits 8) of the ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(raw[:, p]).tobytes() for p in range(planes)]
    return [
        np.packbits(raw[:, p // 8] >> (p % 8) & 1, bitorder="little").tobytes()
        for p in range(planes)
    ]


def from_planes(planes: list[bytes], count: int, bits: int) -> np.ndarray:
    """The ids of a chunk from its planes."""
    raw = np.zeros((count, 4), np.uint8)
    for p, plane in enumerate(planes):
        data = np.frombuffer(plane, np.uint8)
        if bits == 8:
            raw[:, p] = data
        else:
            raw[:, p // 8] |= np.unpackbits(data, count=count, bitorder="little") << (p % 8)
    return raw.view("<u4").reshape(-1)


class Writer:
    """Writes one file; ids of documents are added one after another."""

    def __init__(self, out, planes: int, bits: int, chunk: int = CHUNK_IDS):
        self.out, self.planes, self.bits, self.chunk = out, planes, bits, chunk
        self.packer = zstandard.ZstdCompressor(level=1)
        self.at = len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.index: list[list[int]] = []
        self.lengths: list[np.ndarray] = []
        out.write(MAGIC)

    def _put(self, data: bytes) -> int:
        frame = self.packer.compress(data)
        self.out.write(frame)
        self.at += len(frame)
        return len(frame)

    def _chunk(self, ids: np.ndarray) -> None:
        start = self.at
        sizes = [self._put(plane) for plane in to_planes(ids, self.planes, self.bits)]
        self.index.append([start, len(ids), *sizes])

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Ids of some documents, and how many each has."""
        if len(ids) and int(ids.max()) >> (self.planes * self.bits):
            raise ValueError("an id is wider than the planes of the file")
        self.lengths.append(lengths.astype("<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.chunk * self.chunk
            for first in range(0, whole, self.chunk):
                self._chunk(ids[first : first + self.chunk])
            self.waiting, self.held = [ids[whole:].copy()], len(ids) - whole

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        table = self.at
        documents = np.concatenate([np.zeros(0, "<i8"), *self.lengths])
        self._put(documents.tobytes())
        index = self.at
        self._put(np.array(self.index, "<i8").tobytes())
        ends = [table, index, len(documents), len(self.index), self.planes, self.bits]
        self.out.write(np.array(ends, "<i8").tobytes())


class Reader:
    """Reads one file by its chunk index."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2) or source.tell()
        source.seek(end - 48)
        table, index, documents, chunks, self.planes, self.bits = np.frombuffer(
            source.read(48), "<i8"
        ).tolist()
        unpack = zstandard.ZstdDecompressor().decompress
        source.seek(table)
        self.lengths = np.frombuffer(unpack(source.read(index - table)), "<i8")
        source.seek(index)
        packed = source.read(end - 48 - index)
        self.index = np.frombuffer(unpack(packed), "<i8").reshape(chunks, 2 + self.planes)
        if len(self.lengths) != documents:
            raise ValueError("the document table and the trailer disagree")

    def chunk(self, number: int) -> np.ndarray:
        """Ids of one chunk."""
        at, count, *sizes = self.index[number].tolist()
        self.source.seek(at)
        unpack = zstandard.ZstdDecompressor().decompress
        return from_planes([unpack(self.source.read(n)) for n in sizes], count, self.bits)

    def documents(self) -> Iterator[tuple[int, int]]:
        """(number of ids, crc32 of them) of each document, chunk by chunk."""
        chunk, at, number = np.zeros(0, "<u4"), 0, 0
        for length in self.lengths.tolist():
            left, crc = length, 0
            while left:
                if at == len(chunk):
                    chunk, at, number = self.chunk(number), 0, number + 1
                part = chunk[at : at + left]
                crc = zlib.crc32(part, crc)
                at += len(part)
                left -= len(part)
            yield length, crc


class _Encoder:
    """The tokenizers library behind a table of chunk spellings; one per Python worker.

    Chunks that are not known yet are encoded many at a time: each begins with a blank before a
    visible character, where pre-tokenization has a border, so one after another they stay apart, and
    the widths of the ids tell which belong to which.
    """

    def __init__(self, content: str):
        self.content = content
        self.tokenizer = None

    def __getstate__(self) -> dict:
        return {"content": self.content, "tokenizer": None}

    def _load(self) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.content)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [token.content.encode() for token in added]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # in a byte-level vocabulary each character stands for a byte
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self.widths[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(one.ids, np.uint32) for one in found]

    def _together(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(ids, number of ids of each chunk) of chunks that lie one after another in `data`."""
        out, counts = [], []
        cuts = np.unique(np.searchsorted(ends, np.arange(JOINED_BYTES, int(ends[-1]), JOINED_BYTES)))
        cuts = np.unique(np.concatenate(([0], cuts + 1, [len(ends)])))
        bounds = np.concatenate(([0], ends))
        texts = [data[bounds[a] : bounds[b]].tobytes().decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for ids, a, b in zip(self._encode(texts), cuts[:-1], cuts[1:], strict=True):
            reached = np.cumsum(self.widths[ids])
            wanted = ends[a:b] - bounds[a]
            at = np.searchsorted(reached, wanted)
            if len(reached) != at[-1] + 1 or not (reached[at] == wanted).all():
                # not the byte-level vocabulary that is expected: chunk by chunk
                pieces = [data[x:y].tobytes().decode() for x, y in zip(bounds[a:b], ends[a:b], strict=True)]
                apart = self._encode(pieces)
                out += apart
                counts.append(np.array([len(one) for one in apart], np.int64))
                continue
            out.append(ids)
            counts.append(np.diff(np.concatenate(([-1], at))))
        return out, np.concatenate(counts)

    def _learn(self, new: pa.Array) -> None:
        """Add chunks and their ids to the table."""
        data, offsets = text_bytes(new)
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes > 1)
        blank = some[(data[offsets[some]] == 0x20) & AFTER_BLANK[data[offsets[some] + 1]]]
        counts = np.zeros(len(new), np.int64)
        flat: list[np.ndarray] = []
        if len(blank):
            joined = gathered(data, offsets[blank], sizes[blank])
            flat, counts[blank] = self._together(joined, np.cumsum(sizes[blank]))
        others = np.setdiff1d(np.arange(len(new)), blank, assume_unique=True)
        apart = self._encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in others])
        counts[others] = [len(one) for one in apart]
        order = np.concatenate((blank, others))
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.known = pa.concat_arrays([self.known, new])
        self.flat = np.concatenate([self.flat, *flat, *apart])
        self.starts = np.concatenate((self.starts, starts))
        self.sizes = np.concatenate((self.sizes, counts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row starts).

        Rows that spell an added token are encoded whole: such a token is cut out before the
        text is split, so their chunks do not stand alone.
        """
        if self.tokenizer is None:
            self._load()
        text = data.tobytes()
        if any(token in text for token in self.special):
            rows = [text[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            encoded = self._encode(rows)
            starts = np.concatenate(([0], np.cumsum([len(one) for one in encoded])))
            return np.concatenate([np.zeros(0, np.uint32), *encoded]), starts
        found = chunks_of(data, offsets)
        if self.known.nbytes + self.flat.nbytes > CACHE_BYTES:
            self._forget()
        at = pc.index_in(found.spellings, value_set=self.known)
        new = found.spellings.filter(at.is_null())
        if len(new):
            before = len(self.known)
            self._learn(new)
            at = at.fill_null(-1).to_numpy().astype(np.int64)
            at[at < 0] = before + np.arange(len(new))
        else:
            at = at.to_numpy().astype(np.int64)
        each = at[found.codes]
        lengths = self.sizes[each]
        ids = gathered(self.flat, self.starts[each], lengths)
        return ids, np.concatenate(([0], np.cumsum(lengths)))[found.rows]


def write_files(
    docs: DataFrame,
    tokenizer_file: str,
    folder: str,
    end_id: int = 0,
    planes: int = 16,
    bits: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_chars: int = FILE_CHARS,
) -> DataFrame:
    """Encode and write; returns one row per document: file, place in it, id. The rows are kept
    as a table beside the files, in the shared folder. `file_chars` is the text of a file: a large
    input wants larger files, as each is a partition of one shuffle."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("tie", F.monotonically_increasing_id())
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    with open(tokenizer_file, encoding="utf-8") as content:
        encoder = spark.sparkContext.broadcast(_Encoder(content.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"{folder}/ids/{part:08d}-{uuid.uuid4().hex}.bpl"
        store, path = fs.FileSystem.from_uri(name)
        out = writer = None
        first = 0
        for rows, data, offsets in slices(batches, "text", 4 << 20):
            if writer is None:
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(path)
                writer = Writer(out, planes, bits)
            ids, starts = encoder.value.encode(data, offsets)
            n = rows.num_rows
            writer.add(
                np.insert(ids, starts[1:], end_id), np.diff(starts) + 1
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int64()),
                    pa.array([name] * n),
                    pa.array(range(first, first + n), pa.int64()),
                    rows.column(0),
                ],
                ["part", "file", "place", "id"],
            )
            first += n
        if writer is not None:
            writer.close()
            out.close()

    # the hash and the place in the table split the rows of a hot id, NULL for one, over files
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    id_type = source.schema["id"].dataType.simpleString()
    written = (
        source.repartitionByRange(max(1, -(-chars // file_chars)), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, f"part long, file string, place long, id {id_type}")
    )
    return materialize(written, f"{folder}/documents")


def read_files(files: DataFrame) -> DataFrame:
    """(file, place, n_tokens, ids_crc32) of every document of the files in column `file`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as source:
                    found = list(Reader(source).documents())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(found), pa.string()),
                        pa.array(range(len(found)), pa.int64()),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.array([crc for _, crc in found], pa.int64()),
                    ],
                    ["file", "place", "n_tokens", "ids_crc32"],
                )

    schema = "file string, place long, n_tokens long, ids_crc32 long"
    return files.select("file").mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents, read the files back: id, start, n_tokens, ids_crc32 of each.

    NULL and empty texts have the end id alone; repeated rows and ids each keep their row, ties in
    the order of a hash of the text; an empty table gives no rows. `start` counts over files by a window on one row per
    file, and within a file by a window on that file's documents.
    """
    folder = scratch_dir(docs.sparkSession)
    documents = write_files(docs, tokenizer_file, folder, id_col=id_col, text_col=text_col)
    files = documents.groupBy("part", "file").agg(F.count(F.lit(1)).alias("rows"))
    files = materialize(files, f"{folder}/files")
    spread = files.repartition(max(1, files.count()), "file")  # a file is a task
    read = materialize(read_files(spread), f"{folder}/read")
    sizes = read.groupBy("file").agg(F.sum("n_tokens").alias("ids")).join(files, "file")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .join(documents.select("file", "place", "id"), ["file", "place"])
        .select(
            F.col("id").alias(id_col),
            (F.col("base") + F.col("inside")).alias("start"),
            "n_tokens",
            "ids_crc32",
        )
    )
