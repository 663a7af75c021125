"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from docmill.llm import lexical_rank as lr

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, n_terms = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return out


def frames(spark, docs, items):
    wide = [(*d, 1, "x", ["t"]) for d in docs]
    return spark.createDataFrame(wide, "doc_id long, text string, n int, salt string, terms array<string>"), spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, item int")


def found(spark, docs, items, **more):
    d, i = frames(spark, docs, items)
    return sorted((tuple(r) for r in lr.ranked(d.repartition(3), i, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(8)
    words = ["Ab", "aB", "ñandú", "ÑANDÚ", "7", "x9", "été", "日本", *(f"w{k}" for k in range(60))]
    text = lambda n: rnd.choice([" ", "-", "\n", "_", "'"]).join(rnd.choice(words) for _ in range(n))
    docs = [(k * 3 - 90, text(rnd.randint(0, 60))) for k in range(150)]
    docs += [(500 + k, docs[7][1]) for k in range(45)] + [(7, docs[9][1])] * 3 + [(None, docs[7][1]), (None, "w1 w2"), (900, None), (901, ""), (902, "!?"), (903, "w1 " * 5000 + "unique")]
    items = [(k, text(rnd.randint(1, 12))) for k in range(25)] + [(50, None), (51, ""), (52, "nowhere at all"), (53, "w3 w3 w3 ab"), (54, docs[7][1]), (55, "unique")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"window": 7}, {"block_terms": 9, "window": 50}, {"vocabulary": 3}, {"top": 4, "block_terms": 1}])
def test_ranks(spark, tables, limits):
    docs, items = tables
    assert found(spark, docs, items, **limits) == sorted(plain(docs, items, limits.get("top", 20)), key=repr)


def test_long_texts_are_split_alike(monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("aB9 .ñ本_") for _ in range(5000)) + "z" * 300 + " q"
    monkeypatch.setattr(lr, "PIECE", 37)
    assert lr.counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_repeated_items_and_empty_tables(spark, tables):
    docs, items = tables
    twice = found(spark, docs, [items[0], items[0], (None, "w1")])
    assert twice == sorted(plain(docs, [items[0], items[0], (None, "w1")], 20), key=repr)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
