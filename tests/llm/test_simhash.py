"""Fingerprints and their links against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from docmill.llm import simhash as sh
from docmill.llm import textbatch as tb
from docmill.llm.near_dedup import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, size=3):
    ws = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, pairs):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[top(a)] = top(b)
    groups = {}
    for n in nodes:
        groups.setdefault(top(n), set()).add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def near(nodes):
    x = np.array(nodes, np.int64).view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
    return [(nodes[i], nodes[j]) for i, j in zip(a, b, strict=True) if i < j]


def found(spark, nodes, kind, **limits):
    edges = sh.links(spark.createDataFrame([(n,) for n in nodes[::6]], "node long"), sh.PROJECTIONS[kind], **limits)
    pairs = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 for a, b in pairs)
    label = {r["node"]: r["comp"] for r in components(edges).collect()}
    groups = {}
    for n, c in label.items():
        groups.setdefault(c, set()).add(n)
    return {frozenset(g) for g in groups.values()}, pairs


@pytest.fixture(scope="module")
def nodes():
    """Random nodes, chains of flips, and a dense family."""
    rnd = random.Random(6)
    out = [rnd.getrandbits(64) for _ in range(300)] + [0, 2**64 - 1, 1]
    for _ in range(60):
        x = rnd.choice(out[:300])
        for _ in range(rnd.randint(1, 4)):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            out.append(x)
    for middle, size, flips in ((rnd.getrandbits(64), 260, 7), (rnd.getrandbits(64), 120, 12)):
        out += [middle ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, flips))) for _ in range(size)]
    return sorted({int(np.uint64(x).astype(np.int64)) for x in out})


@pytest.mark.parametrize("kind", ["halves", "blocks"])
def test_every_pair_of_three_flips_meets_at_a_home(kind):
    rnd = random.Random(1)
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
        met = False
        for bits in sh.PROJECTIONS[kind]:
            anchors, home, real = sh.visited(np.array([x, y], np.uint64), bits)
            here = [set(anchors[k][real[k]].tolist()) for k in (0, 1)]
            assert real[:, 0].all() and home[:, 0].all() and not home[:, 1:].any()
            met |= int(anchors[0, 0]) in here[1] and int(anchors[1, 0]) in here[0]
        assert met


@pytest.mark.parametrize("kind,limits", [("halves", {}), ("blocks", {}), ("halves", {"crowd": 1}), ("halves", {"crowd": 1, "near": 5}), ("halves", {"crowd": 2, "near": 4, "levels": 2}), ("blocks", {"crowd": 1, "levels": 1})])
def test_links(spark, nodes, kind, limits):
    groups, pairs = found(spark, nodes, kind, **limits)
    assert groups == joined(nodes, near(nodes))
    if limits.get("crowd") == 1 and kind == "halves":
        assert len(pairs) < 40 * len(nodes)


def test_documents(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(200)] + ["Ärger", "ÑA", "日本語", "A" * 50]
    base = [rnd.choice(words) for _ in range(400)]
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(400)] = rnd.choice(words)
        rows.append((100 - k, rnd.choice([" ", "\n", " \t "]).join(t)))
    rows += [(200 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "ONE"), (305, "one two"), (305, "one  two"), (None, "one"), (None, "none of it is here"), (306, rows[0][1].upper().replace("ÄRGER", "ärger")), (307, "long " * 70_000)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, node int, fingerprint string").repartition(4)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.simhash_duplicates(frame, crowd=3).collect()), key=repr)
    prints = [fingerprint(t) for _, t in rows]
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    group = {n: g for g in joined(set(signed), near(sorted(set(signed)))) for n in g}
    least = lambda n: min((i for (i, _), s in zip(rows, signed, strict=True) if i is not None and s in group.get(n, {n})), default=None)
    assert got == sorted(((i, f"{p:016x}", least(s)) for (i, _), p, s in zip(rows, prints, signed, strict=True)), key=repr)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(3000))
    data, offs = tb.bytes_of(__import__("pyarrow").array(["a b c d", text, None, "x"]))
    monkeypatch.setattr(sh, "COUNTED", 11)
    assert sh.fingerprints_of(data, offs, 3).tolist() == [fingerprint(t) for t in ("a b c d", text, None, "x")]


def test_empty_table(spark):
    none = sh.simhash_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert none.columns == ["doc_id", "fingerprint", "component_id"] and none.count() == 0


def test_tables_that_grow_with_the_input_are_not_broadcast(spark):
    """The driver holds a broadcast; names of 20,000 nodes are shuffled, a few are broadcast."""
    from docmill.llm.near_dedup import bounded
    from docmill.llm.shared import stash

    for n, sent in ((20_000, False), (100, True)):
        plan = spark.range(n).join(bounded(stash(spark.range(n), "names")), "id")._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == sent


def test_no_join_is_broadcast_by_an_estimate(spark, nodes, monkeypatch):
    """Spark takes the anchors of many nodes for a small table, as it knows only the nodes' bytes; no join goes by that."""
    from docmill.llm import near_dedup

    plans = []

    def planned(df, name, plain=sh.stash):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    for module in (sh, near_dedup):
        monkeypatch.setattr(module, "stash", planned)
    table = planned(spark.createDataFrame([(n,) for n in nodes[::6]], "node long"), "nodes")
    found = sh.links(table, sh.PROJECTIONS["halves"], crowd=1, levels=1)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]
