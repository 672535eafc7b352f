"""Pairs near in time against all pairs, with windows of very different sizes."""

import numpy as np
import pyarrow as pa

from newsloom.operators import boundary


def test_uneven_windows_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(boundary, "BLOCK", 16)
    rng = np.random.default_rng(4)
    # A full window, its neighbours on both sides nearly empty, a lone one far away, and times on the very bounds.
    secs = [int(s) for s in rng.integers(7200, 10800, 90)] + [3600, 7199, 10800, 14399, 14400, 90_000, 90_000]
    x = rng.normal(size=(len(secs), 6))
    rows = [(i, i % 3, [float(v) for v in x[i]], s) for i, s in enumerate(secs)]
    table = spark.createDataFrame(rows, "id long, label int, x array<float>, sec long")
    x = x.astype(np.float32).astype(float)
    cos = lambda a, b: float(x[a] @ x[b] / (np.linalg.norm(x[a]) * np.linalg.norm(x[b]) + 1e-10))
    want = {(a, b) for a in range(len(secs)) for b in range(a + 1, len(secs)) if abs(secs[a] - secs[b]) <= 3600 and round(cos(a, b), 6) >= 0.3}
    got = [(r.a, r.b) for r in boundary.near_in_time(table, 1, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert len(boundary.near_in_time(table, 1).collect()) > len(got)
    assert boundary.near_in_time(table.limit(0), 1).collect() == []


def _uneven(spark):
    rng = np.random.default_rng(7)
    secs = [int(s) for s in rng.integers(7200, 10800, 60)] + [int(s) for s in rng.integers(10800, 14400, 25)] + [3600, 7199, 14400, 90_000, 90_000]
    x = rng.normal(size=(len(secs), 5)).astype(np.float32)
    rows = [(i, None if i == 8 else i * 7 % 3, [float(v) for v in x[i]], s) for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "id long, label int, x array<float>, sec long")


def test_counts_and_links_are_those_of_the_pairs(spark, monkeypatch):
    for name, size in (("BLOCK", 16), ("WIDE", 16), ("STRIP", 5)):
        monkeypatch.setattr(boundary, name, size)
    table = _uneven(spark)
    pairs = [tuple(r) for r in boundary.near_in_time(table, 1).collect()]
    tally = lambda items: {k: items.count(k) for k in set(items)}
    assert {(r.label_a, r.label_b): r.n for r in boundary.near_labels(table, 1).collect()} == tally([(la, lb) for _, _, la, lb, _ in pairs])
    verdict = lambda la, lb: None if la is None or lb is None else la == lb
    reached = lambda cos: sum(cos >= t for t in (-0.2, 0.1, 0.3))
    assert {(r.verdict, r.bin): r.n for r in boundary.near_bins(table, 1, [-0.2, 0.1, 0.3]).collect()} == tally([(verdict(la, lb), reached(c)) for _, _, la, lb, c in pairs])
    for row in boundary.near_stats(table, 1).collect():
        own = [c for _, _, la, lb, c in pairs if verdict(la, lb) == row.verdict]
        assert row.n == len(own) and (row.low, row.high) == (min(own), max(own))
        assert np.allclose([row["mean"], row["median"], row["stdev"]], [np.mean(own), np.median(own), np.std(own, ddof=1)], atol=6e-6)
    assert boundary.near_stats(table.limit(0), 1).collect() == []
    # A dense block gives a link for each vector at most, where the pairs are many more.
    for same in (False, True):
        links = boundary.near_links(table, 1, -0.5, same).collect()
        want = [(a, b) for a, b, la, lb, c in pairs if c >= -0.5 and (not same or verdict(la, lb))]
        assert {(a, b) for a, b in links} and len(links) < len(want)
        groups = lambda edges: {min(g): g for g in _components(edges)}
        assert groups([(r.a, r.b) for r in links]) == groups(want)


def _components(edges):
    of = {}
    for a, b in edges:
        one = of.get(a, {a}) | of.get(b, {b})
        of |= dict.fromkeys(one, one)
    return list({id(g): g for g in of.values()}.values())


def test_pairs_leave_a_block_strip_by_strip(monkeypatch):
    kept = {}
    monkeypatch.setattr(boundary, "_met", lambda rows, hours, least, block, of, schema: kept.update(of=of))
    boundary.near_in_time(None, 48)
    n = 40
    own = pa.table({"id": np.arange(n), "sec": np.zeros(n, int), "own": np.zeros(n, int), "label": pa.array([1] * n, pa.int32()), "x": [[1.0, float(i)] for i in range(n)]})
    side, asked = boundary._Side(own), []
    monkeypatch.setattr(boundary, "STRIP", 8)

    def strips():
        for strip in boundary._strips(side, side, 60, None):
            asked.append(len(strip[0]))
            yield strip

    sizes = []
    for out in kept["of"](side, side, strips()):
        assert len(sizes) + 1 == len(asked)  # handed on before the next strip is made
        sizes.append(out.num_rows)
    assert sum(sizes) == n * (n - 1) // 2 and len(sizes) == n // 8 and max(sizes) <= 8 * n


def _sides(n, seed, labels=True, x=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(2 * n, 6)).astype(np.float32) if x is None else x
    label = pa.array([None if labels and i % 11 == 3 else int(v) for i, v in enumerate(rng.integers(-3, 4, 2 * n))], pa.int32())
    sec = np.r_[np.sort(rng.integers(0, 50, n)), np.sort(rng.integers(50, 100, n))]
    ids = rng.permutation(2 * n)
    t = pa.table({"id": ids, "sec": sec, "label": label, "x": pa.array(x.tolist(), pa.list_(pa.float32()))})
    return boundary._Side(t.slice(0, n)), boundary._Side(t.slice(n))


def _brute(a, b, width):
    """Every pair of two blocks, or of one with itself: indexes, cosine, labels in order of id, verdict."""
    out = []
    for i in range(len(a.id)):
        for j in range(i + 1 if a is b else 0, len(b.id)):
            if abs(a.sec[i] - b.sec[j]) <= width and a.id[i] != b.id[j]:
                cos = round(float(a.x[i] @ b.x[j]) / (np.sqrt(a.x[i] @ a.x[i]) * np.sqrt(b.x[j] @ b.x[j]) + 1e-10), 6)
                labels = [a.label[i].as_py(), b.label[j].as_py()]
                out.append((i, j, cos, tuple(labels if a.id[i] < b.id[j] else labels[::-1]), None if None in labels else labels[0] == labels[1]))
    return out


def _edge_vectors(n):
    """Copies, zero vectors and cosines on the very thresholds."""
    x = np.zeros((2 * n, 6), np.float32)
    x[:, 0] = 1
    x[::3] = [0.3, 0.4, np.sqrt(0.75), 0, 0, 0]
    x[1::7] = [0.6, 0.8, 0, 0, 0, 0]
    x[5::9] = 0
    return x


def test_kernels_equal_every_pair(monkeypatch):
    for name, size in (("STRIP", 7), ("TILE", 16), ("LEAF", 4)):
        monkeypatch.setattr(boundary, name, size)
    edges = [-0.2, 0.1, 0.3]
    tiny = np.random.default_rng(1).normal(size=(80, 6)).astype(np.float32) * 1e-6  # 1e-10 counts in the quotient
    for x in (None, _edge_vectors(40), tiny):
        one, two = _sides(40, 5, x=x)
        assert one.plain == (x is not tiny)
        for a, b, width in ((one, one, 60), (one, two, 50), (one, two, 200)):
            every = _brute(a, b, width)
            tally = lambda items: {k: items.count(k) for k in set(items)}
            got = [(int(i), int(j), float(c)) for p, q, cos in boundary._strips(a, b, width, None) for i, j, c in zip(p, q, cos, strict=True)]
            assert sorted((i, j) for i, j, _ in got) == sorted((i, j) for i, j, *_ in every)
            assert np.allclose([c for *_, c in sorted(got)], [c for _, _, c, *_ in sorted(every, key=lambda e: e[:2])], atol=1.1e-6)
            cosine = {(i, j): c for i, j, c in got}
            every = [(i, j, cosine[i, j], labels, verdict) for i, j, _, labels, verdict in every]
            picked = [(i, j, c) for p, q, cos in boundary._strips(a, b, width, 0.3) for i, j, c in zip(p, q, cos, strict=True)]
            assert sorted((i, j) for i, j, _ in picked) == sorted((i, j) for i, j, c, *_ in every if c >= 0.3)
            rows = lambda tables: [tuple(r.values()) for t in tables for r in t.to_pylist()]
            want = tally([(v, sum(c >= e for e in edges)) for _, _, c, _, v in every])
            assert {(v, k): n for v, k, n in rows(boundary._reached(edges)(a, b, width))} == want
            mil = lambda c: int(np.rint(c * boundary.UNIT))
            coarse = rows(boundary._thousandths(a, b, width))
            assert {(v, k): n for v, k, n, *_ in coarse} == tally([(v, mil(c) // boundary.BIN) for _, _, c, _, v in every])
            for v in (None, False, True):
                own, mine = [mil(c) for _, _, c, _, u in every if u is v], [r for r in coarse if r[0] is v]
                assert sum(r[3] for r in mine) == sum(own) and np.isclose(sum(r[4] for r in mine), sum(o * o for o in own))
                assert {(r[5], r[6]) for r in mine} == ({(min(own), max(own))} if own else set())
            fine = [(True, 0), (False, 0), (False, 300), (None, 999)]
            want = tally([(v, mil(c)) for _, _, c, _, v in every if (v, mil(c) // boundary.BIN) in fine])
            assert {(v, k): n for v, k, n in rows(boundary._single(fine)(a, b, width))} == want
            counts = boundary._LabelCounts(a, b)
            counts.near(width)
            names = [None if c == boundary.NO_LABEL else int(c) for c in counts.codes]
            cells = {(names[c // len(names)], names[c % len(names)]): int(n) for c, n in zip(*counts.sums(), strict=True)}
            assert cells == tally([labels for *_, labels, _ in every])
            ends = list(zip(*boundary._forest(a, b, width, 0.3), strict=True))
            assert _groups(ends) == _groups([(a.id[i], b.id[j]) for i, j, c, *_ in every if c >= 0.3])


def _groups(edges):
    return sorted(sorted(map(int, g)) for g in _components([(int(a), int(b)) for a, b in edges]))


def test_counting_labels_forms_no_pairs():
    """A window of 60,000 vectors holds 1.8 thousand million pairs: a count of them one by one takes minutes."""
    n = 60_000
    t = pa.table({"id": np.arange(n), "sec": np.zeros(n, int), "label": pa.array(np.arange(n) % 2, pa.int32())})
    side = boundary._Side(t)
    counts = boundary._LabelCounts(side, side)
    counts.some = None  # the only step that looks at pairs
    counts.near(60)
    h = n // 2
    assert dict(zip(*(c.tolist() for c in counts.sums()), strict=True)) == {0: h * (h - 1) // 2, 3: h * (h - 1) // 2, 1: h * (h + 1) // 2, 2: h * (h - 1) // 2}


def test_each_two_blocks_meet_once(spark, monkeypatch):
    """Of a window's blocks only one order meets, and there are at most so many of them, in which vectors are copied."""
    monkeypatch.setattr(boundary, "BLOCKS", 3)
    n = 120
    table = spark.createDataFrame([(i, 1, [1.0, float(i)], 7200 + i * 30) for i in range(n)], "id long, label int, x array<float>, sec long")
    def of(a, b, width):
        yield pa.table({"left": [len(a.id)], "right": [len(b.id)], "alone": [a is b]})
    got = boundary._dealt(table, 1, 16, of, "left long, right long, alone boolean").collect()
    assert len(got) == 6 and sum(r.alone for r in got) == 3 and sum(r.left for r in got if r.alone) == n
    pairs = sum(r.left * (r.left - 1) // 2 if r.alone else r.left * r.right for r in got)
    assert pairs == n * (n - 1) // 2
