from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.llm import cap_filters, hard_negatives, pivot_codes

ROWS = "vec_id long, embedding array<float>, label int, id long, vec string, class string, code string, home int, n long"
CLASH = (7, "x", "y", "z", 3, 9)


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, *CLASH) for i, v, label in rows], ROWS)

    return make


@pytest.fixture(scope="module")
def cloud():
    """Clusters at many distances, exact copies, scaled copies, a dense group, and rows that take no part."""
    r = np.random.default_rng(3)
    base = r.standard_normal((150, 24))
    rows = [v for v in base]
    for v in base[:40]:
        for spread in (0.02, 0.25, 0.31, 0.33, 0.36):
            rows.append(v + spread * np.linalg.norm(v) / np.sqrt(24) * r.standard_normal(24))
    rows += [base[3]] * 30 + [2 * base[4]] * 3 + [base[5] + 0.01 * r.standard_normal(24) for _ in range(120)]
    out = [(int(i), np.float32(v), int(r.integers(0, 4))) for i, v in zip(r.permutation(len(rows)) + 1, rows, strict=True)]
    odd = [(9001, None, 1), (9002, np.zeros(24), 2), (9003, [None] * 24, 1), (9004, [float("nan")] + [1.0] * 23, None), (9005, [float("inf")] * 24, 3), (9006, [], 0), (None, base[0], 1)]
    return out, odd


def brute_links(rows, least):
    ids = [i for i, _, _ in rows]
    data = np.array([np.asarray(v, np.float32) for _, v, _ in rows], np.float64)
    near = data @ data.T >= least * np.linalg.norm(data, axis=1)[:, None] * np.linalg.norm(data, axis=1)[None, :]
    np.fill_diagonal(near, False)
    label = list(ids)
    while True:
        new = [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
        if new == label:
            return {i: (int(n), c) for i, n, c in zip(ids, near.sum(1), label, strict=True)}
        label = new


def test_links_of_near_vectors(vectors, cloud):
    rows, odd = cloud
    got = cap_filters.near_vectors(vectors(rows + odd)).collect()
    known = [r for r in got if r["vec_id"] is not None]
    want = brute_links(rows, 0.95) | {i: (0, i) for i, _, _ in odd if i is not None}
    assert {r["vec_id"]: (r["n_links"], r["component"]) for r in known} == want
    assert len(got) == len(rows) + len(odd)
    assert all(r["kept"] == (r["vec_id"] == r["component"]) for r in got)
    assert any(n > 100 for n, _ in want.values())


def test_homes_in_blocks(vectors, cloud, monkeypatch):
    rows, _ = cloud
    monkeypatch.setattr(cap_filters, "MEMBERS", 7)
    got = cap_filters.near_vectors(vectors(rows)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component"]) for r in got} == brute_links(rows, 0.95)


@pytest.mark.parametrize("dims", [1, 2, 3, 7, 100])
def test_links_in_other_spaces(vectors, dims):
    r = np.random.default_rng(dims)
    rows = [(i, np.float32(r.standard_normal(dims)), None) for i in range(60)]
    rows += [(100 + i, np.float32(np.asarray(v) * (1 + 0.02 * r.standard_normal(dims))), 1) for i, v, _ in rows[:30]]
    got = cap_filters.near_vectors(vectors(rows)).collect()
    assert {x["vec_id"]: (x["n_links"], x["component"]) for x in got} == brute_links(rows, 0.95)


def test_links_of_few_rows(vectors):
    assert cap_filters.near_vectors(vectors([])).count() == 0
    mixed = [(1, [1, 2], 0), (2, [1, 2, 0], 0), (2, [1, 2], 0), (2, [1, 2], 0)]
    assert sorted(tuple(r) for r in cap_filters.near_vectors(vectors(mixed)).collect()) == [(1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False), (2, 2, 1, False)]
    far = [(1, [1e-30, 0], 0), (2, [1e30, 1e20], 0), (3, [-1, 0], 0)]
    assert sorted(tuple(r)[:3] for r in cap_filters.near_vectors(vectors(far)).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_filters_found_by_decoding():
    """Decoding lists every direction of the product code that exceeds alpha, and no other."""
    turn, code = cap_filters.product_code(9, 6, 2, 5)
    r = np.random.default_rng(1)
    unit = r.standard_normal((20, 9))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    row, number, _ = cap_filters.decoded(unit, turn, code, 0.3)
    turned = np.pad(unit, ((0, 0), (0, 1))) @ turn
    want = {(k, i * 6 + j) for k in range(20) for i in range(6) for j in range(6) if turned[k] @ np.concatenate([code[0, i], code[1, j]]) >= 0.3}
    assert set(zip(row.tolist(), number.tolist(), strict=True)) == want
    assert np.allclose(np.linalg.norm(code, axis=2), np.sqrt(0.5))


def test_share_of_near_pairs_that_meet():
    """At the threshold, pairs share about as many filters as meant, at every size of table."""
    r = np.random.default_rng(2)
    for count in (500, 1_000_000):
        alpha, size = cap_filters.cap_shape(count, 64, 0.95)
        x = r.standard_normal((200, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = r.standard_normal((200, 64))
        side -= (side * x).sum(1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * side / np.linalg.norm(side, axis=1, keepdims=True)
        shared = np.zeros(200)
        for t in range(cap_filters.TABLES):
            code = cap_filters.product_code(64, size, t, 20)
            a, b = (set(zip(*(z.tolist() for z in cap_filters.decoded(v, *code, alpha)[:2]), strict=True)) for v in (x, y))
            for k, _ in a & b:
                shared[k] += 1
        assert 0.6 * cap_filters.SHARED < shared.mean() < 1.6 * cap_filters.SHARED
        assert (shared > 0).all()


def brute_negatives(rows):
    whole = {i: np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64) for i, v, _ in rows}
    label = dict((i, c) for i, _, c in rows)
    out = []
    for a in (i for i in whole if i % 10 == 0):
        score = {i: int(whole[a] @ whole[i]) for i in whole if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:5]:
            fit = [i for i in order if label[i] != label[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:5])]
    return sorted(out)


@pytest.mark.parametrize("anchors", [8192, 3])
def test_hard_negatives(vectors, cloud, monkeypatch, anchors):
    rows, odd = cloud
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "SLICE", 64)
    got = hard_negatives.hard_negatives(vectors(rows + odd).repartition(3), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes)["rank"] == "int"


def test_hard_negatives_of_few_rows(vectors):
    assert hard_negatives.hard_negatives(vectors([]), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(vectors([(1, [1, 2], 0), (2, [1, 2], 1)]), F.col("id") % 10 == 0).count() == 0
    # a zero score: only zero fits; a negative one: nothing fits; two lengths do not meet
    rows = [(0, [1, 0], 0), (1, [0, 1], 0), (2, [-1, 0], 0), (3, [0, -1], 1), (4, [0, 2], 1), (5, [1, 0, 0], 1), (6, [0, 0.5], None)]
    got = hard_negatives.hard_negatives(vectors(rows), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 1, 3, 0, 0), (0, 1, 2, 4, 0, 0)]


def test_intervals_hold_every_score():
    r = np.random.default_rng(4)
    for dims in (1, 3, 64, 70):
        rows = np.concatenate([r.integers(-300, 300, (80, dims)), np.zeros((1, dims), np.int64)])
        queries = hard_negatives.Queries(rows[:30])
        held = hard_negatives.Rows(np.arange(81), np.zeros(81, np.int64), rows)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(81), indexing="ij"))
        score = (rows[i] * rows[j]).sum(1)
        centre, width = np.zeros(len(i)), []
        for level in range(hard_negatives.LEVELS):
            low, high, centre = hard_negatives.intervals(queries, held, i, j, level, centre)
            assert (low <= score).all() and (score <= high).all()
            width.append((high - low).mean())
        if dims == 64:
            assert width[-1] < 0.5 * width[0]


def brute_codes(rows):
    rows = sorted(rows, key=lambda r: r[0])
    whole = np.floor(1024 * np.array([np.asarray(v, np.float32) for _, v, _ in rows], np.float64)).astype(np.int64)
    books = [x.copy() for x in np.split(whole[:256], 4, 1)]
    parts = np.split(whole, 4, 1)

    def assigned():
        gaps = [((x[:, None, :] - b[None, :, :]) ** 2).sum(2) for x, b in zip(parts, books, strict=True)]
        return np.stack([g.argmin(1) for g in gaps], 1), np.stack([g.min(1) for g in gaps], 1)

    for _ in range(4):
        where, _ = assigned()
        for p in range(4):
            for e in set(where[:, p].tolist()):
                some = parts[p][where[:, p] == e]
                books[p][e] = [int(s) // len(some) for s in some.sum(0)]
    where, gap = assigned()
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    error = gap.sum(1)
    of_label = {c: sum(int(e) for e, (_, _, k) in zip(error, rows, strict=True) if k == c) for _, _, c in rows}
    return {i: ("".join(f"{w:02x}" for w in where[k]), int(error[k]), of_label[c], digest) for k, (i, _, c) in enumerate(rows)}


def test_pivot_codes(vectors, cloud):
    rows, odd = cloud
    rows = [(i, v, None if i % 11 == 0 else c) for i, v, c in rows]
    usable = [(i, v, c) for i, v, c in odd if i == 9002]
    got = pivot_codes.pivot_codes(vectors(rows + odd[:6]).repartition(5))
    assert {r["vec_id"]: tuple(r)[1:] for r in got.collect()} == brute_codes(rows + usable)


def test_pivot_codes_of_few_rows(vectors):
    assert pivot_codes.pivot_codes(vectors([])).count() == 0
    rows = [(3, [1, 2, 3, 4], 0), (5, [1, 2, 3, 5], None), (7, [-1, -2, 3, 4], None)]
    more = [(1000, [1, 2, 3], 0), (None, [1, 2, 3, 5], 0)]
    got = {r["vec_id"]: tuple(r)[1:] for r in pivot_codes.pivot_codes(vectors(rows)).collect()}
    assert got == brute_codes(rows)
    assert {r["vec_id"] for r in pivot_codes.pivot_codes(vectors(rows + more)).collect()} == {3, 5, 7, None}
    five = pivot_codes.pivot_codes(vectors([(1, [1, 2, 3, 4, 5], 0), (1, [1, 2, 3, 4, 5], 0)])).collect()
    assert [tuple(r)[:4] for r in five] == [(1, "00000000", 0, 0)] * 2


def test_pivots_leave_entries_out():
    r = np.random.default_rng(8)
    parts, entries = np.repeat(r.integers(-900, 900, (40, 8)), 10, 0) + r.integers(-9, 9, (400, 8)), r.integers(-900, 900, (256, 8))
    pivots = pivot_codes.chosen_pivots(entries)
    where, gap, done = pivot_codes.nearest(parts, pivot_codes.between(parts, pivots), entries, pivots)
    exact = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    assert (where == exact.argmin(1)).all() and (gap == exact.min(1)).all()
    assert done < 0.7 * exact.size
