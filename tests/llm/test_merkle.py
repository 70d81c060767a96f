"""The Merkle manifest against a tree built and climbed in plain Python."""

import hashlib
import zlib

import pytest
from escarp.llm import merkle
from pyspark.sql import functions as F

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, at, folded):
    proof = ""
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
        proof, folded, at = proof + left + right, digest(left + folded + right), at // 16
    return proof, folded


def proofs(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        crc = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        other = text.translate(LOWER) if text is not None and crc % 5 == 0 else text
        changed = leaf((doc_id, source, lang, n_chars, other))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, changed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        groups[name].sort()
        trees.append(levels([g[2] for g in groups[name]]))
    top = levels([t[-1][0] for t in trees])
    root = top[-1][0]
    for at, name in enumerate(names):
        for i, (known, doc_id, own, changed) in enumerate(groups[name]):
            lower, folded = climb(trees[at], i, changed)
            upper, folded = climb(top, at, folded)
            yield (doc_id if known else None, own, trees[at][-1][0], root, digest(lower + upper), folded, folded == root)


def check(frame):
    found = merkle.proofs(frame, FIELDS, "doc_id", "source", {"text": merkle.lowered_in_every_fifth()})
    got = [tuple(r) for r in found.collect()]
    want = list(proofs([tuple(r) for r in frame.select(*FIELDS).collect()]))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fixture(docs, no_docs):
    check(docs)
    found = merkle.proofs(no_docs, FIELDS, "doc_id", "source", {"text": merkle.lowered_in_every_fifth()})
    assert found.count() == 0


@pytest.mark.parametrize("sources", [1, 2, 40])
def test_trees_of_several_levels(spark, monkeypatch, sources):
    monkeypatch.setattr(merkle, "LANE", 2)  # nodes near the root have many copies
    rows = spark.range(700).select(
        F.expr("if(id < 20, 7, id * 31 % 997)").alias("doc_id"),  # equal ids
        F.expr(f"if(id % 3 = 0, 's0', concat('s', id % {sources}))").alias("source"),
        F.lit("en").alias("lang"),
        F.lit(3).cast("long").alias("n_chars"),
        F.expr("if(id < 10, 'Same', concat('Text ', id))").alias("text"),
        F.lit(1).alias("pos"),
        F.lit("x").alias("tree"),
    )
    check(rows.repartition(3))


def test_one_row_and_null_source(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    check(spark.createDataFrame([(5, None, None, None, None)], schema))
    check(spark.createDataFrame([(5, None, "", 0, ""), (5, "", None, 1, "A"), (6, "b", "x", 2, "é")], schema))
