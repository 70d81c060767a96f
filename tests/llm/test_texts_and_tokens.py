"""Byte-level BPE and bit-plane files against the public libraries."""

import base64
import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from escarp.llm import bitplane, byte_bpe
from escarp.llm.texts import WORD, chunks_of, slices, text_bytes, words_of
from tokenizers import Tokenizer

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", " ", "a", "a b", "a  b", "a \n b", "\n  b", "x\n\n y ", "it's  we'll", "\t\tz  ", "né 中 文",
    "a  b", "tail ", " head", "1 2 ! ?", "a\x1c b", "w" * 5000, "ab " * 900, "é" * 300,
]


def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_chunks_cover_the_texts():
    import re

    data, offsets = text_bytes(pa.array(TEXTS))
    words = words_of(data, offsets)
    spelled = words.spellings.to_pylist()
    for i, text in enumerate(TEXTS):
        own = [spelled[c].decode() for c in words.codes[words.rows[i] : words.rows[i + 1]]]
        assert own == re.findall(WORD, text)
    chunks = chunks_of(data, offsets)
    spelled = chunks.spellings.to_pylist()
    for i, text in enumerate(TEXTS):
        own = [spelled[c] for c in chunks.codes[chunks.rows[i] : chunks.rows[i + 1]]]
        assert b"".join(own).decode() == text


def test_slices_bound_bytes_and_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 6, "b", None, "c" * 9, "d"])], ["i", "text"])
    got = [rows.column(0).to_pylist() for rows, _, _ in slices(iter([batch]), "text", 7)]
    assert got == [[0, 1, 2], [3], [4]]


def test_perfect_hash_is_minimal_and_verified():
    entries = byte_bpe.read_ranks(RANKS)
    found = byte_bpe.PerfectHash(entries)
    assert (found.candidates(entries) == np.arange(len(entries))).all()
    assert sorted(found.key_at.tolist()) == list(range(len(entries)))


def test_merges_equal_the_library():
    encoding, own = reference(), byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), P.PATTERN)
    ids, starts = own.encode(*text_bytes(pa.array(TEXTS)))
    for i, text in enumerate(TEXTS):
        assert ids[starts[i] : starts[i + 1]].tolist() == encoding.encode_ordinary(text)
    assert own.decode(ids).tobytes().decode() == "".join(TEXTS)


def test_digests_of_messy_documents(docs, no_docs):
    encoding = reference()
    want = []
    for row in docs.collect():
        ids = encoding.encode_ordinary(row.text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        back = hashlib.sha256((row.text or "").encode()).hexdigest()
        want.append((str(row.doc_id), len(ids), hashlib.sha256(packed).hexdigest(), back))
    got = [(str(r[0]), *r[1:]) for r in byte_bpe.digests(docs, RANKS, P.PATTERN).collect()]
    assert sorted(got) == sorted(want)
    assert byte_bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0
    lists = byte_bpe.encoded(docs.filter("doc_id = 78"), RANKS, P.PATTERN).first()
    assert lists.ids == encoding.encode_ordinary(docs.filter("doc_id = 78").first().text)


@pytest.mark.parametrize(("planes", "bits"), [(16, 1), (20, 1), (2, 8), (4, 8)])
def test_planes_round_trip(planes, bits):
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 7, 1000, 0, 33])
    ids = rng.integers(0, 50257, lengths.sum()).astype(np.uint32)
    out = io.BytesIO()
    writer = bitplane.Writer(out, planes, bits, chunk=64)
    writer.add(ids[:8], lengths[:3])
    writer.add(ids[8:], lengths[3:])
    writer.close()
    reader = bitplane.Reader(io.BytesIO(out.getvalue()))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    want = [(n, zlib.crc32(ids[a : a + n].tobytes())) for a, n in zip(starts, lengths.tolist(), strict=False)]
    assert list(reader.documents()) == want
    assert (reader.chunk(1) == ids[64:128]).all()
    with pytest.raises(ValueError, match="wider"):
        bitplane.Writer(io.BytesIO(), 4, 1).add(np.array([16]), np.array([1]))


def test_files_of_messy_documents(docs, no_docs):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = bitplane.round_trip(docs, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    want = []
    for row in docs.collect():
        one = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 0]
        want.append((str(row.doc_id), len(one), zlib.crc32(struct.pack(f"<{len(one)}I", *one))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for row in got:
        assert row.start == at
        at += row.n_tokens
    assert bitplane.round_trip(no_docs, path).count() == 0


def test_added_tokens_are_cut_out_of_whole_texts(spark):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a  <|endoftext|>  b", "<|endoftext|>", "plain"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bitplane.round_trip(frame, path).collect():
        ids = [*tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids, 0]
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_a_pre_token_is_merged_once_for_all_chunks():
    """Chunks that differ share the ids of their pre-tokens, also in later slices of the text."""
    import public_tokenizers

    from escarp.llm import byte_bpe

    bpe = byte_bpe.ByteBpe(
        byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN
    )
    merged, merge = [], bpe.merge
    bpe.merge = lambda piece: (merged.append(piece), merge(piece))[1]
    first, = bpe.encode_chunks([b" qzxwvkjq,"])
    second, = bpe.encode_chunks([b" qzxwvkjq;"])
    assert merged.count(b" qzxwvkjq") == 1
    assert first[:-4] == second[:-4] and first != second
