"""Vector codes against plain Lloyd rounds over whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from docmill.llm import vector_codes as vc


def plain(rows, parts, entries, rounds, scale):
    """vec_id, codes, error of every kept row, and the codebooks, by a full search."""
    kept = [(i, label, [math.floor(scale * float(np.float32(x))) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    w = len(kept[0][2]) // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in order] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        codes = [[min((dist(x, e), j) for j, e in enumerate(books[p]))[::-1] for p, x in enumerate(cut(v))] for _, _, v in kept]
        if k < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v)[p] for (_, _, v), c in zip(kept, codes, strict=True) if c[p][0] == j]
                    if own:
                        books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, label, bytes(j for j, _ in c), sum(d for _, d in c)) for (i, label, _), c in zip(kept, codes, strict=True)], books


def frame(spark, rows):
    wide = [(*r, 1, "k", b"x") for r in rows]
    return spark.createDataFrame(wide, "vec_id long, label int, embedding array<float>, id int, codes string, low binary")


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    middle = rnd.normal(0, 0.3, (6, 12))
    out = [(int(i), int(rnd.integers(0, 3)) if i % 7 else None, (middle[i % 6] + rnd.normal(0, 0.05, 12)).astype(np.float32).tolist()) for i in rnd.permutation(400)]
    out += [(3, 1, out[0][2]), (3, 1, out[0][2]), (None, 2, out[5][2]), (-4, 0, [0.0] * 12), (-4, 0, [-0.0] * 12)]
    out += [(500, 1, None), (501, 1, [None] * 12), (502, 1, [float("nan")] * 12), (503, 1, [float("inf")] + [0.0] * 11), (504, None, [0.1] * 11 + [None])]
    return out


@pytest.mark.parametrize("entries,rounds", [(20, 2), (7, 4), (256, 1), (9, 0)])
def test_codes(spark, rows, entries, rounds):
    found = vc.compress(frame(spark, rows).repartition(5), parts=3, entries=entries, rounds=rounds, scale=256)
    want, books = plain(rows, 3, entries, rounds, 256)
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = [(r["id"], r["label"], bytes(r["codes"]), r["error"]) for r in found.rows.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert found.codebooks.tolist() == books
    assert vc.books_digest(found.codebooks) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_restored_vectors_are_the_entries(spark, rows):
    found = vc.compress(frame(spark, rows), parts=3, entries=20)
    codes = {(r["id"], bytes(r["codes"])) for r in found.rows.collect()}
    back = {(r["id"], tuple(r["vector"])) for r in vc.restored(found).collect()}
    assert back == {(i, tuple(x / 256 for p, j in enumerate(c) for x in found.codebooks[p][j].tolist())) for i, c in codes}


def test_bounds_spare_most_of_the_search_and_change_nothing():
    rnd = np.random.default_rng(1)
    x = (rnd.integers(0, 64, (4000, 1)) * 40 + rnd.integers(-6, 7, (4000, 4))).astype(np.int64)
    old = np.arange(64)[:, None] * 40 + rnd.integers(-9, 10, (64, 4))
    group = vc.grouped(old)
    code, _, low = vc.full_search(x, old, group)
    for _ in range(4):
        new = old + rnd.integers(-3, 4, old.shape)
        code, own, low, scanned = vc.bounded_search(x, new, group, code, low.astype(np.uint16), vc.drifts(old, new, group))
        want, near, _ = vc.full_search(x, new, group)
        assert (code == want).all() and (own == near).all() and scanned < 0.25 * x.shape[0] * 64
        true = np.sqrt(np.where(np.arange(64) == code[:, None], 2**60, vc.squares(x, new)).astype(float))
        for g in range(group.max() + 1):
            assert (low[:, g] <= vc.FINE * true[:, group == g].min(1)).all()
        old = new


def test_drifts_that_break_every_bound():
    rnd = np.random.default_rng(2)
    x, old = rnd.integers(-50, 50, (500, 4)), rnd.integers(-50, 50, (40, 4))
    group = vc.grouped(old)
    code, _, low = vc.full_search(x, old, group)
    for k in range(5):
        new = old.copy()
        new[rnd.integers(0, 40, 9)] = rnd.integers(-50, 50, (9, 4))
        new[k] = new[k + 1]  # ties
        code, own, low, _ = vc.bounded_search(x, new, group, code, low, vc.drifts(old, new, group))
        want, near, _ = vc.full_search(x, new, group)
        assert (code == want).all() and (own == near).all()
        old = new


def test_few_and_none(spark, rows):
    few = vc.compress(frame(spark, rows[:2]), parts=3)
    assert few.codebooks.shape == (3, 2, 4) and sorted(r["error"] for r in few.rows.collect()) == [0, 0]
    none = vc.compress(frame(spark, [(1, 1, None)]))
    assert none.rows.columns == ["id", "label", "codes", "error"] and none.rows.count() == 0 and vc.restored(none).count() == 0
    with pytest.raises(ValueError):
        vc.compress(frame(spark, rows), parts=5)
    with pytest.raises(Exception, match="differ in width"):
        vc.compress(frame(spark, [(1, 1, [0.0] * 6), (2, 1, [0.0] * 12)]), parts=3)
