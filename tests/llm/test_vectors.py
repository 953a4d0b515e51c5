"""Vector searches against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import ann, cover_tree


def rows(seed, n, dims=8, copies=0):
    r = random.Random(seed)
    out = [(i, [round(r.gauss(0, 1), 2) for _ in range(dims)]) for i in range(n)]
    hot = out[0][1]
    return out + [(n + i, hot) for i in range(copies)] + [(10**6, None), (10**6 + 1, [None] * dims), (10**6 + 2, [math.nan] * dims), (10**6 + 3, [1.0]), (None, hot), (10**6 + 4, [0.0] * dims)]


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("rank", F.lit(3))


def brute(data, every, k, ip):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in data if i is not None and v and len(v) == 8 and None not in v and not any(map(math.isnan, v)) and (ip or any(v))]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    x = np.floor(64 * x) if ip else x
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = -(x @ x[i]) if ip else np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, s)) if j != i][:k]
        out += [(int(ids[i]), n + 1, int(ids[j]), float(-s[j] if ip else s[j])) for n, j in enumerate(order)]
    return out


def test_hilbert_curve():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours(spark):
    data = rows(1, 2000, copies=300)
    got = [tuple(x) for x in ann.search(frame(spark, data), every=100).collect()]
    want = brute(data, 100, 10, False)
    hits = {(a, c) for a, _, c, _ in got} & {(a, c) for a, _, c, _ in want}
    assert len(hits) >= 0.9 * len(want) and len(got) == len(want)
    exact = {(a, c): s for a, _, c, s in want}
    assert all(s == exact[a, c] for a, _, c, s in got if (a, c) in exact)
    hot = [x for x in got if x[0] == 2100]
    assert sorted(hot) == sorted(x for x in want if x[0] == 2100)
    few = rows(2, 4)
    assert sorted(map(tuple, ann.op8(frame(spark, few)).collect())) == brute(few, 100, 10, False)
    assert ann.op8(frame(spark, few).limit(0)).count() == 0


@pytest.mark.parametrize("noise", [1e-1, 1e-3, 1e-6, 1e-13])
def test_neighbours_among_near_copies(spark, noise):
    r = np.random.default_rng(6)
    x = r.normal(size=(4500, 32))
    x[3000:] = x[0] + noise * r.normal(size=(1500, 32))
    x = x[r.permutation(len(x))]
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = 0
    for i in range(0, len(x), 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        hits += sum(g.score <= np.sort(d)[9] for g in got if g.query_id == i)
    assert len(got) == 450 and hits >= 0.9 * len(got)


def test_neighbours_of_the_table(spark):
    """Recall at the table's own 64 dimensions, against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    own = {x.vec_id: np.array(x.embedding, float) for x in df.collect() if x.embedding is not None and None not in x.embedding}
    ids, x = np.array(list(own)), np.stack(list(own.values()))
    hits = asked = 0
    got = defaultdict(dict)
    for r in ann.op8(df).collect():
        got[r.query_id][r.vec_id] = r.score
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - own[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        last = np.sort(d)[9]
        hits, asked = hits + sum(s <= last for s in got[q].values()), asked + 10
    assert x.shape[1] == 64 and asked >= 200 and hits >= 0.93 * asked


def test_neighbours_in_groups(spark):
    """Vectors in small groups apart from each other, for which the least windows do."""
    r = np.random.default_rng(12)
    x = (np.repeat(r.normal(size=(300, 16)) * 100, 12, 0) + r.normal(size=(3600, 16)))[r.permutation(3600)]
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    near = {q: set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11]) for q in range(0, 3600, 100)}
    assert len(got) == 360 and sum(g.vec_id in near[g.query_id] for g in got) >= 0.93 * 360


def test_neighbours_in_full_cells(spark):
    """Vectors that no key tells apart are compared one by one."""
    x = np.random.default_rng(7).normal(size=(600, 8))
    x[:400] = 1e9 + np.arange(400)[:, None] * 1e-6
    x[599] = 1e30
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=50).collect()
    for i in range(0, 400, 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [(g.vec_id, g.score) for g in sorted(got, key=lambda g: g.rank) if g.query_id == i] == [(j, d[j]) for j in np.lexsort((np.arange(600), d))[:10]]


def test_products(spark):
    data = rows(3, 1500, copies=200)
    assert sorted(map(tuple, cover_tree.op9(frame(spark, data)).collect())) == sorted(brute(data, 20, 20, True))
    few = rows(4, 3)
    assert sorted(map(tuple, cover_tree.op9(frame(spark, few)).collect())) == sorted(brute(few, 20, 20, True))
    assert cover_tree.op9(frame(spark, few).limit(0)).count() == 0


def test_large_products(spark):
    """Scores beyond 2 ** 53, which doubles would round, against Python's integers; ties and repeated ids among them."""
    r = random.Random(9)
    data = [(i, [float(r.randrange(-(2**22), 2**22)) + r.choice([0, 0.25, 1 / 64]) for _ in range(8)]) for i in range(400)]
    data += [(400 + i, [x + (i % 3 == 0) / 64 for x in data[0][1]]) for i in range(60)] + [data[7]]
    whole = {i: [math.floor(64 * x) for x in v] for i, v in data}
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for x in cover_tree.op9(df).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert len(got) == 23 and max(abs(s) for own in got.values() for *_, s in own) > 2**55
    for q, own in got.items():
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:20]
        assert sorted(own) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_repeated_ids(spark):
    """Rows that repeat an id with another vector count once, at their best; so do those of a query."""
    data = rows(11, 60) + [(0, [float(k) for k in range(8)]), (5, [float(k) for k in range(8)]), (7, rows(11, 60)[7][1]), (7, rows(11, 60)[7][1])]
    for op, ip in ((ann.op8, False), (cover_tree.op9, True)):
        got = [tuple(x) for x in op(frame(spark, data)).collect()]
        assert len({(q, rank) for q, rank, *_ in got}) == len(got) and len({(q, i) for q, _, i, _ in got}) == len(got)
        best = {}
        for q, v in data:
            if q is None or not v or len(v) != 8 or None in v or any(map(math.isnan, v)) or q % (20 if ip else 100) or not (ip or any(v)):
                continue
            for i, w in data:
                if i is not None and i != q and w and len(w) == 8 and None not in w and not any(map(math.isnan, w)) and (ip or any(w)):
                    a, b = (np.array(y, np.float32).astype(float) for y in (v, w))
                    s = float(np.floor(64 * a) @ np.floor(64 * b)) if ip else -float(np.sqrt(((a - b) ** 2).sum()))
                    best[q, i] = max(best.get((q, i), -math.inf), s)
        assert all(abs(abs(s) - abs(best[q, i])) < 1e-12 * max(1, abs(s)) for q, _, i, s in got)


def test_tree_covers():
    x = np.random.default_rng(5).normal(size=(700, 6))
    todo = [cover_tree.cover_tree(x, leaf=16)]
    assert len(todo[0].rows) == 700
    while todo:
        node = todo.pop()
        assert (np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1)) <= node.radius + 1e-9).all()
        assert not node.children or sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        todo += node.children
