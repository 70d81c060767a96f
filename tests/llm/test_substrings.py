"""Substring dedup against brute force."""

import random
import re

import pytest
from escarp.llm import substrings

WIDTH = 20


def cleaned(rows):
    """(id, n_words, n_removed, kept) of rows that are in order of document."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - WIDTH + 1):
            window = tuple(words[i : i + WIDTH])
            if window in seen:
                gone[i : i + WIDTH] = [True] * WIDTH
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), kept))
    return out


def corpus(rng, n=150):
    def words(k):
        return [f"w{rng.randrange(5000)}" for _ in range(k)]

    passages = [words(rng.randrange(15, 70)) for _ in range(8)]
    rows = []
    for i in range(n):
        text = words(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "changed"
            text += p + words(rng.randrange(0, 30))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(n, "same " * 90), (n + 1, "same " * 25), (n + 2, "a b c " * 40), (n + 3, rows[0][1])]
    rows += [(n + 4, None), (n + 5, ""), (n + 6, " \n"), (n + 7, "été 中文 \xa0x " * 30), (n + 8, rows[9][1])]
    return rows


def check(spark, rows):
    shuffled = list(rows)
    random.Random(5).shuffle(shuffled)
    data = [(i, t, 3, "x", 1) for i, t in shuffled]
    frame = spark.createDataFrame(data, "doc_id long, text string, block int, ids string, fresh int").repartition(4)
    got = [tuple(r) for r in substrings.deduplicated(frame).collect()]
    assert sorted(got) == sorted(cleaned(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    check(spark, corpus(random.Random(seed)))


def test_frequent_anchors_go_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", 3)
    monkeypatch.setattr(substrings, "BLOCK", 2000)
    monkeypatch.setattr(substrings, "SHARD", 100)
    monkeypatch.setattr(substrings, "HELD", 5000)
    check(spark, corpus(random.Random(3)))


def test_nulls_repeated_rows_and_long_texts(docs, no_docs, rows):
    got = {}
    for r in substrings.deduplicated(docs).collect():
        got.setdefault(r.id, []).append((r.n_words, r.n_removed, r.kept))
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    # rows without an id are ordered by place, which differs; none of them holds a passage
    want = {}
    for doc_id, *rest in cleaned(ordered):
        want.setdefault(doc_id, []).append(tuple(rest))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert substrings.deduplicated(no_docs).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 20))] for _ in range(3)]
        query = [rng.randrange(3) for _ in range(25)]
        automaton = substrings.Automaton()
        for text in texts:
            automaton.add(text)
        known = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        want = []
        for end in range(1, len(query) + 1):
            want.append(max((end - a for a in range(end) if tuple(query[a:end]) in known), default=0))
        assert automaton.matches(query) == want
