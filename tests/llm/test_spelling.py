"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from escarp.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def grouped(counts):
    out = {}
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and edits(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefgh"])
def test_pairs_of_a_sorted_list(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        words = sorted({"".join(rng.choices(letters, k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 50))})
        expected = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if edits(words[i], words[j]) == 1}
        got = list(spelling.near_pairs(words))
        assert len(got) == len(set(got))
        assert set(got) == expected


def corpus(rng):
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(6, 12))) for _ in range(60)]
    base += ["internationally", "internationalle", "internationale", "x" * 200, "ÀÀÀÀÀÀb"]
    rows = []
    for i in range(120):
        words = rng.choices(base, [2000 // (k + 1) for k in range(len(base))], k=60)
        for k in range(0, 60, 7):
            w = words[k]
            at = rng.randrange(len(w))
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1 :]])
        rows.append((i, rng.choice([" ", "-", "1", "中"]).join(words).upper() if i % 3 else " ".join(words)))
    return rows + [(None, " ".join(base)), (7, rows[7][1]), (7, rows[7][1]), (500, None), (501, ""), (502, "1 2 中")]


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    words = spelling.vocabulary(frame.repartition(3))
    counts = counted(rows)
    assert {r.word: r.n for r in words.collect()} == counts
    got = spelling.grouped(words).collect()
    assert len(got) == len(counts)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == grouped(counts)


def test_variants(spark):
    check(spark, corpus(random.Random(1)))


def test_large_blocks_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 3)
    check(spark, corpus(random.Random(2)))


def test_fixture_and_no_rows(spark, docs, no_docs, rows):
    words = spelling.vocabulary(docs)
    assert {r.word: r.n for r in words.collect()} == counted([(r[0], r[1]) for r in rows])
    assert spelling.grouped(spelling.vocabulary(no_docs)).count() == 0
