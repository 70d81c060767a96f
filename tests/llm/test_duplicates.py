"""Exact dedup, SimHash tries and cap filters against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from escarp.llm import cap_filters, exact_dedup, simhash
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(LOWER)


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def test_exact_groups(docs, no_docs):
    groups = {}
    for row in docs.collect():
        groups.setdefault(lower(row.text), []).append(row.doc_id)
    got = exact_dedup.verdicts(docs).collect()
    assert len(got) == docs.count()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for row in got:
        ids = by_digest[row.text_sha256]
        assert row.group_size == len(ids)
        assert row.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(lower(r.text) for r in kept.collect()) == sorted(groups)
    assert {r["at"] for r in kept.select("at").collect()} == {"x"}
    assert exact_dedup.verdicts(no_docs).count() == 0
    derived = docs.filter("doc_id > 4")  # no plain scan of files
    assert exact_dedup.verdicts(derived).count() == derived.count()


def test_state_goes_on_and_collisions_are_regrouped(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_digest", lambda text: F.unhex(F.lit("00")))  # all collide
    groups = {}
    for row in docs.collect():
        groups[lower(row.text)] = groups.get(lower(row.text), 0) + 1
    got = exact_dedup.verdicts(docs).collect()
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(r.group_size for r in got if r.kept) == sorted(groups.values())
    feed = str(tmp_path / "feed")
    schema = "digest binary, id long, at struct<file:string,row:long>"
    for step in range(2):
        data = [(b"a", step, ("f", step)), (bytes([step]), 9, ("g", step))]
        spark.createDataFrame(data, schema).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        state = {bytes(r.digest): (r.n, r.keep.id) for r in exact_dedup.remember(stream, str(tmp_path / "state")).collect()}
    assert state == {b"a": (2, 1), b"\x00": (1, 9), b"\x01": (1, 9)}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(docs, no_docs):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    linked = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2
    ]
    of = components(len(rows), linked)
    least = {}
    for row, c in zip(rows, of, strict=True):
        if row.doc_id is not None:
            least[c] = min(least.get(c, row.doc_id), row.doc_id)
    got = simhash.grouped(docs)
    got = got.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("f"), "component_id").collect()
    want = [(str(r.doc_id), f"{p:016x}", str(least.get(c))) for r, p, c in zip(rows, prints, of, strict=True)]
    assert sorted((str(a), b, str(c)) for a, b, c in got) == sorted(want)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values()))
    assert ids.count(None) == len(set(of)) - len(least)
    assert simhash.grouped(no_docs).count() == 0


def test_one_row_of_each_group_with_or_without_ids(spark):
    one, two, three = ("a b c " * 100, "d e f " * 100, "g h i " * 100)  # one more word changes no bit
    rows = [
        (1, one, "s"), (2, one + "end", "s"), (2, two, "s"),  # unlike texts with one id
        (None, two, "s"), (None, three, "s"), (None, three + "end", "s"),
        (3, "twice", "s"), (3, "twice", "s"), (3, "twice", "t"), (None, None, "s"), (4, "", "s"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, at string").repartition(3)
    linked = [
        (i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if (fingerprint(a[1]) ^ fingerprint(b[1])).bit_count() <= 2
    ]
    of = components(len(rows), linked)
    least = {}
    for (doc_id, _, _), c in sorted(zip(rows, of, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
        least.setdefault(c, doc_id)
    got = simhash.one_of_each_group(frame).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, least.values()))
    assert {r["at"] for r in got} <= {"s", "t"}


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_links_of_crowded_fingerprints(spark, budget):
    rng = np.random.default_rng(budget)
    center = int(rng.integers(0, 1 << 63))
    prints = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5))) for _ in range(300)}
    prints |= {int(x) for x in rng.integers(0, 1 << 63, 100)} | {0, 1, 3, 7, (1 << 64) - 1}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed + signed[:50] + [None]], "fp long")
    got = {(r.a, r.b) for r in simhash.links(frame, budget).collect()}
    want = {
        (min(a, b), max(a, b))
        for i, a in enumerate(signed)
        for b in signed[:i]
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= budget
    }
    assert got == want


def test_cap_filters_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "CHUNK", 40)  # a group over several chunks
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[100:250] = x[100] + 0.08 * rng.standard_normal((150, 64))
    x[250] = x[100]
    x[251:256] = 3 * x[7] + 0.3 * rng.standard_normal((5, 64))
    data = [(i, [float(np.float32(v)) for v in row], i) for i, row in enumerate(x)]
    data += [(400, None, 0), (401, [0.0] * 64, 0), (402, [float("nan")] * 64, 0), (403, [None] * 64, 0), (404, [], 0)]
    data += [(405, [1.0, 2.0], 0), (406, [1.0, 2.0], 0), (None, data[7][1], 0)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links long")
    valid = {i: np.array(v, float) for i, (_, v, _) in enumerate(data) if i not in range(400, 405)}
    unit = {i: v / np.linalg.norm(v) for i, v in valid.items()}
    linked = [(i, j) for i in unit for j in unit if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    of = components(len(data), linked)
    links = [sum(i in pair for pair in linked) for i in range(len(data))]
    least = {}
    for i, c in enumerate(of):
        if data[i][0] is not None:
            least[c] = min(least.get(c, 10**9), data[i][0])
    got = cap_filters.near_duplicates(frame).collect()
    want = [(str(data[i][0]), links[i], least[of[i]]) for i in range(len(data))]
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert cap_filters.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "vectors"), [
    (1, 100), (2, 1000), (2, 10**6), (3, 1000), (3, 10**6), (5, 10**6), (6, 10**6), (8, 1000), (8, 10**6),
    (16, 1000), (16, 10**6), (64, 1000), (64, 10**6), (64, 10**8),
])
def test_cap_filters_miss_few_pairs_at_the_border(dim, vectors):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((300, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal(a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    b = a
    if dim > 1:
        b = 0.95 * a + np.sqrt(1 - 0.95**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    codes = [cap_filters.CapCode(dim, vectors, table) for table in range(cap_filters.TABLES)]

    def directions(x):
        out = [set() for _ in x]
        for code in codes:
            found = [set() for _ in x]
            for row, name in zip(*(v.tolist() for v in code.decode(x)), strict=True):
                found[row].add(name)
            assert all(found)  # each vector has a direction in each code
            for one, two in zip(out, found, strict=True):
                one |= two
        return out

    hit = [not p.isdisjoint(q) for p, q in zip(directions(a), directions(b), strict=True)]
    assert np.mean(hit) >= 0.99


def test_cap_filters_in_few_dimensions(spark):
    for dim in (1, 2, 3):
        rng = np.random.default_rng(dim)
        x = rng.standard_normal((60, dim))
        if dim == 2:
            x[:20] = [[np.cos(t), np.sin(t)] for t in np.arange(20) * 0.1]
        frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        close = unit @ unit.T >= 0.95
        got = {r.vec_id: r.n_links for r in cap_filters.near_duplicates(frame).collect()}
        assert got == {i: int(close[i].sum()) - 1 for i in range(60)}
