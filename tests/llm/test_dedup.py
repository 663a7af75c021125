"""Exact, suffix and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.llm import exact_dedup, near_dedup, suffix_dedup, textbatch

WORDS = [f"w{i}" for i in range(300)]
ODD = [(None, "no id"), (900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (905, "a b c"), (905, "a b c"), (905, " ".join(WORDS[:90])), (907, " ".join(WORDS[:89])), (906, "x " * 3000)]


def frame(spark, rows, more=False):
    if not more:
        return spark.createDataFrame(rows, "doc_id long, text string")
    # columns whose names the operators use themselves
    wide = [(*r, None, 1, "k", 2) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, digest string, n int, cls string, bucket int")


def family(rnd, size, edits):
    base = [rnd.choice(WORDS) for _ in range(120)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(len(t))] = rnd.choice(WORDS)
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    texts = family(rnd, 40, 9) + family(rnd, 15, 3) + family(rnd, 1, 0) * 30
    texts += [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    texts += [t.upper() for t in texts[:3]] + [t.replace(" ", "\n") for t in texts[3:6]]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)] + ODD


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def test_exact(spark, rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i or 0, i))
    first = {}  # of rows that are equal in length and id, one stays
    for k, (i, t) in enumerate(rows):
        if (i, -len(t or "")) == (min(groups[norm(t)])[3], min(groups[norm(t)])[0]):
            first.setdefault(norm(t), k)
    want = [(i, min(g := groups[norm(t)])[3], len(g), first[norm(t)] == k, hashlib.sha256(norm(t).encode()).hexdigest()) for k, (i, t) in enumerate(rows)]
    for more in (False, True):
        got = exact_dedup.exact_dedup(frame(spark, rows, more)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    left = exact_dedup.drop_exact_copies(frame(spark, rows, True))
    assert left.columns == frame(spark, rows, True).columns and left.count() == len(groups) == sum(w[3] for w in want)
    assert len({norm(r["text"]) for r in left.collect()}) == len(groups)


def test_equal_rows(spark):
    """Of rows that are equal in everything one stays, and another text under the same id is judged for itself."""
    rows = [(5, "a b"), (5, "a b"), (5, "c d"), (None, "x"), (None, "x"), (None, "y"), (6, "a b")]
    for drop in (exact_dedup.drop_exact_copies, near_dedup.drop_near_copies):
        left = drop(frame(spark, rows, True)).select("doc_id", "text").collect()
        assert sorted(map(tuple, left), key=key) == sorted([(5, "a b"), (5, "c d"), (None, "x"), (None, "y")], key=key)
    assert exact_dedup.exact_dedup(frame(spark, rows)).filter("kept").count() == 4


def test_exact_heavy_groups_are_broadcast(spark):
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(300)]
    table = exact_dedup.digest_table(frame(spark, rows))
    winners = exact_dedup.heavy_winners(table).collect()
    assert [(w["keep_id"], w["group_size"]) for w in winners] == [(1, 200)]


def brute_suffix(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, bucket, part", [(20, 8, 700, 400), (48, 16, 1 << 20, 1 << 20), (33, 16, 2000, 900)])
def test_suffix(spark, rows, length, gram, bucket, part):
    periodic = [(2000, "ab" * 80), (2001, "a" * 150), (2002, "é" * 90), (2003, "xyz" * 50 + "q" + "xyz" * 50)]
    got = suffix_dedup.remove_repeats(frame(spark, rows + periodic, True), length=length, gram=gram, bucket_bytes=bucket, part_bytes=part).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_suffix(rows + periodic, length), key=key)


def test_suffix_hot_passage_spreads():
    """Texts that share a passage: a bucket sends each gram once, and the pairs at the passage's edges go to all parts."""
    rnd = random.Random(1)
    passage = " ".join(rnd.choice(WORDS) for _ in range(120))
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) + passage + "".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(400)]
    b = suffix_dedup.Block(*textbatch.bytes_of(pa.array(texts)), 200, 64)
    runs = suffix_dedup.Runs(b.key, b.stretch, 16)
    hot = Counter(b.key.tolist()).most_common(1)[0]
    assert hot[1] >= 400 and len(set(runs.grams.tolist())) == len(runs.grams)
    edges = runs.pair_part[runs.pair_key == max(set(b.key.tolist()), key=lambda k: len(set(b.stretch[b.key == k].tolist())))]
    assert len(edges) >= 400 and max(np.bincount(edges, minlength=16)) < 2 * len(edges) / 16
    codes = runs.codes(suffix_dedup.pa.concat_tables([suffix_dedup._meet(t) for t in by_part(runs.messages(0))]))
    assert (codes[b.key == hot[0]] != suffix_dedup.UNIQUE).all()


def by_part(messages):
    rows = messages.to_pylist()
    for key in sorted({(r["round"], r["part"]) for r in rows}):
        yield pa.Table.from_pylist([r for r in rows if (r["round"], r["part"]) == key], schema=messages.schema)


def test_suffix_texts(spark):
    got = suffix_dedup.remove_repeats(frame(spark, [(1, "x" * 5 + "shared passage" * 3), (2, "shared passage" * 3 + "tail")]), length=42, gram=8, texts=True).orderBy("doc_id").collect()
    assert [bytes(r["rest"]) for r in got] == [b"xxxxx", b"tail"]


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_near(rows, k):
    sets = [shingle_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    ids = {}
    for a, (i, _) in enumerate(rows):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if v in (x, y) else v for v in comp]
    for a, (i, _) in enumerate(rows):
        if i is not None:
            ids[comp[a]] = min(i, ids.get(comp[a], i))
    return [(i, len(sets[a]), ids.get(comp[a], i) if sets[a] else i) for a, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [4, 5])
def test_near(spark, rows, size):
    got = near_dedup.near_duplicates(frame(spark, rows, True), size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(*w, w[0] == w[2]) for w in brute_near(rows, size)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    left = near_dedup.drop_near_copies(frame(spark, rows, True), size=size)
    assert left.columns == frame(spark, rows, True).columns
    # rows without words are alone; rows that repeat an id are alone unless their texts are near
    assert left.count() == len({(w[2], w[1] and shingle_set(rows[k][1], size)) for k, w in enumerate(want) if w[0] == w[2]})


def test_near_last_round_alone(spark, rows, monkeypatch):
    """Without pairs of leaders the last round finds all links."""
    monkeypatch.setattr(near_dedup, "led_pairs", lambda bands: bands.selectExpr("c AS a", "c AS b").limit(0))
    got = near_dedup.near_duplicates(frame(spark, rows), size=4).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((w[0], w[2]) for w in brute_near(rows, 4)), key=key)


def test_names_of_known_strings_differ(spark):
    """Thue-Morse strings, which share every polynomial name modulo a power of two."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_duplicates(frame(spark, [(1, a[:1024]), (2, b[:1024]), (3, a[:64]), (4, b[:64])]), size=4).collect()
    assert all(r["kept"] for r in got)
    from docmill.llm import quality_rules

    found = quality_rules.measure(*textbatch.bytes_of(pa.array([a + "\n" + b])))
    assert found["n_dup_lines"].tolist() == [0]


#: Strings that shared a name when names were made by steps that can be undone, under a key that stood in the source.
BUILT_WORDS = ("3dgig25uwordword p q r", "k9icafo9r^>2(4y] p q r")
BUILT_STARTS = ("35KWciPWwordword", "kdKYzOTK,)|mciU1")


def test_strings_built_to_collide_are_told_apart(spark):
    got = near_dedup.near_duplicates(frame(spark, list(enumerate(BUILT_WORDS))), size=4).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(0, 0, True), (1, 1, True)]
    rest = "".join(random.Random(2).choice("abcdefgh ") for _ in range(184))
    got = suffix_dedup.remove_repeats(frame(spark, [(k, s + rest) for k, s in enumerate(BUILT_STARTS)])).collect()
    assert [(r["n_bytes"], r["n_removed"]) for r in got] == [(200, 0), (200, 0)]


def test_names_need_their_key():
    """Equal strings share a name under one key; another key gives other names; neither a flip nor a length of any size goes unseen."""
    rnd = random.Random(7)
    texts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 3, 4, 5, 8, 9, 16, 17, 200, 511, 512, 513, 900)]
    texts += [t[:k] + bytes([t[k] ^ 1 << rnd.randrange(8)]) + t[k + 1 :] for t in texts if t for k in {0, len(t) // 2, len(t) - 1}]
    texts += [b"\0" * n for n in range(1, 40)]
    data = np.frombuffer(b"".join(texts * 2), np.uint8)
    ends = np.cumsum([len(t) for t in texts * 2])
    one, two = textbatch.fresh_key(), textbatch.fresh_key()
    start = np.concatenate([[0], ends[:-1]])
    a, b = textbatch.names(data, start, ends, one), textbatch.names(data, start, ends, two)
    n, distinct = len(texts), len(set(texts))
    assert (a[:n] == a[n:]).all() and len(set(a.tolist())) == distinct == len(set(b.tolist())) and not set(a.tolist()) & set(b.tolist())


def test_windows_count_as_equal_by_both_names():
    first = np.array([1, 1, 2, 2, 3, 1], np.uint64)
    second = np.array([7, 8, 9, 9, 9, 7], np.uint64)
    assert suffix_dedup.judge_windows(first, second).tolist() == [True, False, True, True, False, True]
    assert suffix_dedup.judge_windows(first[:0], second[:0]).tolist() == []


@pytest.mark.parametrize("name", [lambda i: f"a-{i}", lambda i: None if i % 3 else f"{i}", lambda i: None])
def test_near_and_exact_stages_take_any_ids(spark, name):
    """Texts and null or textual ids: one row of each group stays, of the least id where there is one."""
    rnd = random.Random(11)
    texts = family(rnd, 12, 2) + family(rnd, 8, 3) + [" ".join(rnd.choice(WORDS) for _ in range(40)) for _ in range(9)]
    texts += [texts[0], texts[-1], "", None, "one"]
    rows = [(name(i), t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id string, text string, component int").repartition(3)
    sets = [shingle_set(t, 5) for _, t in rows]
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if v in (x, y) else v for v in comp]
    groups = {}
    for k, c in enumerate(comp):
        groups.setdefault(c, []).append(k)
    left = near_dedup.drop_near_copies(docs).collect()
    by_text = {}
    for k, (_, t) in enumerate(rows):
        by_text.setdefault(t, set()).add(comp[k])
    worded = [g for c, g in groups.items() if sets[g[0]]]
    kept = [r for r in left if shingle_set(r["text"], 5)]
    assert docs.columns == ["doc_id", "text", "component"] and len(kept) == len(worded)
    for g in worded:
        least = min((rows[k][0] for k in g if rows[k][0] is not None), default=None)
        mine = [r for r in kept if by_text[r["text"]] == {comp[g[0]]}]
        assert [r["doc_id"] for r in mine] == [least]
    assert len(left) - len(kept) == len({rows[k][0] for k in range(len(rows)) if not sets[k]})
    exact = exact_dedup.drop_exact_copies(docs).collect()
    assert len(exact) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts})


def star(rnd, size):
    """Copies of one text with few to many edits: near to it, but often not to one another."""
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rnd.randint(1, 12)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        out.append(" ".join(t))
    return out


def test_pairs_of_a_family_grow_in_proportion(spark, monkeypatch):
    """A family that is twice as large has about twice the pairs whose sets are compared, not four times; no link is lost."""
    counts = []
    plain = near_dedup.verified

    def counting(pairs, *rest):
        counts[-1] += pairs.count()
        return plain(pairs, *rest)

    monkeypatch.setattr(near_dedup, "verified", counting)
    for size in (150, 300):
        counts.append(0)
        rows = list(enumerate(star(random.Random(5), size)))
        got = near_dedup.near_duplicates(frame(spark, rows), size=4).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted((w[0], w[2]) for w in brute_near(rows, 4))
    assert counts[1] < 2.5 * counts[0]


def test_empty(spark):
    none = frame(spark, [], True)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0


def test_plain_prefix_doubling_agrees(spark, rows):
    """The method in its plain form removes the same bytes."""
    from docmill.llm import suffix_ranks

    docs = frame(spark, rows + [(2000, "ab" * 80), (2001, "a" * 150)], True).coalesce(1)
    found = suffix_ranks.repeated_positions(docs, length=33).groupBy("row").agg(F.collect_set("pos").alias("at"))
    per = {r["row"]: len({p + k for p in r["at"] for k in range(33)}) for r in found.collect()}
    texts = [r["text"] or "" for r in docs.collect()]
    want = suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.monotonically_increasing_id()), length=33, gram=16).collect()
    assert len(texts) == len(want)
    assert {r["doc_id"]: r["n_removed"] for r in want if r["n_removed"]} == per
    assert suffix_ranks.repeated_positions(frame(spark, [])).count() == 0
