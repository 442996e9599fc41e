import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mtree as M

SCHEMA = "vec_id long, embedding array<double>, query long, Score string"


def brute(rows, k=20, every=20):
    """Every query row against every other row with Python integers."""
    use = [(i, [math.floor(64.0 * x) for x in e]) for i, e in rows
           if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (q, v) in enumerate(use):
        if q is None or q % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w, strict=False)), i is None, i or 0, i) for b, (i, w) in enumerate(use) if b != a]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda t: t[:3])[:k])]
    return Counter(out)


def search(spark, rows, k=20, every=20, **how):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)
    got = M.top_k(M.scaled(df), F.col("vec_id") % every == 0, k=k, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return Counter(map(tuple, got.collect()))


def clustered(rng, n, dim):
    heads = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(n)]


def test_many_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 7)
    monkeypatch.setattr(M, "FANOUT", 3)
    rows = clustered(random.Random(1), 500, 5)
    assert search(spark, rows, k=6, shard_rows=90, block_rows=10, max_pivots=3) == brute(rows, k=6)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(rng.choice([3, 3, 2, 0]))]) for i in range(150)]
    rows += [(40, [9.0, 9.0, 9.0])] * 30 + [(i, [9.0, 9.0, 9.0]) for i in range(200, 260)]
    rows += [(1, None), (20, [1.0, None, 2.0]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (None, [1.0, 1.0, 1.0]),
             (None, [1.0, 1.0, 1.0]), (-20, [0.5, 0.5, 0.5]), (20, [0.5, 0.25, 0.0]), (20, [0.5, 0.25, 0.0])]
    assert search(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-2**40, 2**40)) for _ in range(4)]) for i in range(90)]
    want = brute(rows, k=5)
    clipped = Counter()
    for (q, r, i, s), n in want.items():
        clipped[q, r, i, M.clip(s)] += n
    assert search(spark, rows, k=5) == clipped


def test_few_rows(spark):
    assert search(spark, []) == Counter() == search(spark, [(20, [1.0])]) == search(spark, [(1, [1.0]), (2, [2.0])])
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [])]
    assert search(spark, rows) == brute(rows)


def test_pages_hold_their_bounds(monkeypatch):
    v = np.array([e for _, e in clustered(random.Random(4), 3000, 6)]) * 64 // 1
    pages, longest = M.build_pages(v.astype(np.int64))
    x = np.hstack([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]])
    below = [list(p["rows"]) for p in pages]
    for k in range(len(pages) - 1, 0, -1):
        below[pages[k]["parent"]] += below[k]
    assert sorted(below[0]) == list(range(3000)) and len(pages) > 30
    for p, rows in zip(pages, below, strict=True):
        d = np.linalg.norm(x[rows] - x[p["centre"]], axis=1)
        assert d.max() <= p["radius"] + 1e-4
        if p["parent"] >= 0:
            assert abs(np.linalg.norm(x[p["centre"]] - x[pages[p["parent"]]["centre"]]) - p["parent_dist"]) < 1e-4


def test_search_reads_few_vectors_of_clustered_data(monkeypatch):
    """Bounds rule out most distances where the vectors have a structure."""
    v = (np.array([e for _, e in clustered(random.Random(5), 6000, 4)]) * 640).astype(np.int64)
    pages, longest = M.build_pages(v)
    rows = [{"page": i, "parent": p["parent"], "radius": p["radius"], "parent_dist": p["parent_dist"], "longest": longest,
             "centre": np.append(v[p["centre"]].astype(float), 0).tobytes(), "ids": p["rows"], "gaps": p["gaps"].tobytes(),
             "vectors": v[p["rows"]].tobytes()} for i, p in enumerate(pages)]
    tree, read = M.Tree(rows, 4), []
    monkeypatch.setattr(np, "partition", lambda a, *b, _f=np.partition, **c: (read.append(a.shape), _f(a, *b, **c))[1])
    queries = v[::60]
    got = tree.search(queries, 5, [None] * len(queries))
    for q, hits in zip(queries, got, strict=True):
        scores = v @ q
        assert [s for s, _ in hits] == sorted(scores.tolist(), reverse=True)[:5]
        assert all(scores[tree.ids[e]] == s for s, e in hits)
    assert sum(n * (w - 5) for n, w in read) < 0.5 * len(queries) * len(v)


@pytest.mark.parametrize("name", ["op12_mtree"])
def test_query_matches_its_sql(spark, sf_small, name):
    from quarry.llm.queries import ORACLES, QUERIES
    from quarry.plans.verify import digest, duck_connection

    got = QUERIES[name](spark, sf_small)
    rel = duck_connection(sf_small).execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert rows and digest(got.columns, rows) == digest(cols, rel.fetchall())
