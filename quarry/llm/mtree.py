"""Exact top-k search by inner product: best-first search in M-trees.

Vectors have integer components; the score of two is their inner product, exact. Ties go to
the smaller id.

**Method.** With M the largest length in a tree, a vector x is given one more component
``sqrt(M^2 - |x|^2)`` and a query a zero. The distance of query and vector is then
``sqrt(|q|^2 + M^2 - 2 * score)``: the largest scores are the smallest distances, which obey
the triangle inequality. An M-tree is a table of pages. A page has a centre (one of its
vectors), a covering radius and its distance to the parent's centre; a leaf also holds
vectors with their distances to the centre. Queries are searched in blocks, each query best
page first: its nearest unread page is read next, until none can hold a better score. The
distance to a child or a vector is not computed where the stored distance to the parent's
centre already rules it out. Bounds are floating point with slack, scores are integers.

**Scale.** Of rows with equal vectors only the ``k + 1`` smallest ids can be in any result, so
a vector that a third of the rows share keeps that many rows (limited before the shuffle),
and equal queries are searched once. Vectors are dealt to shards by the nearest of at most
``max_pivots`` sampled vectors; a crowded cell is split by hash into several shards, so a
shard has about ``shard_rows`` vectors and its tree is built in one task. The sample only shapes the
shards: every row is indexed. A query first searches the shard that holds its own vector;
its k-th score there bounds the search of the other shards, which are joined with blocks of
``block_rows`` queries and return only what reaches that bound.

**Defined cases.** Vectors that are null or hold a null or non-finite component take no part.
Shorter vectors are read with zeros at the end. Components and scores beyond 64 bits are cut to
64 bits in the output; ranks use the exact scores. A query's own row is one row of its id and
vector; other rows with its id are candidates. Ids are integers; others count as null, which
is never a query and ties last (as does 2^63 - 1). No rows or no queries give no result.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import col, staged

NO_ID = 2**63 - 1
LEAF, FANOUT = 128, 16
RANK_BITS = 22
PAGES = ("shard int, page int, parent int, centre binary, radius double, parent_dist double, longest double, "
         "ids array<bigint>, vectors binary, gaps binary")
HITS = "query long, vec_id long, score long, same boolean, rank_key string"


def scaled(df: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components ``floor(scale * x)`` of the vectors that take part."""
    x = F.transform(col(vec_col), lambda c: c.cast("double"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(col(id_col).try_cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & good)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("v"))


def matrix(column, dim: int) -> np.ndarray:
    """Rows of a list column as integers, zeros at the end of shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def distance(square: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(square, 0.0))


def build_pages(v: np.ndarray):
    """Pages of the M-tree over the rows of ``v``, parents before children.

    A page is a dict with its centre (a row number), radius, distance to the parent's
    centre, parent and, in a leaf, its rows with their distances to the centre.
    """
    x = v.astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)
    longest = float(square.max())
    x = np.hstack([x, distance(longest - square)[:, None]])
    apart = lambda rows, c: distance(2 * longest - 2 * (x[rows] @ x[c].T))
    every = np.arange(len(x))
    root = int(np.argmax(x @ x.mean(axis=0)))
    todo, pages = [(every, root, -1, 0.0)], []
    while todo:
        rows, centre, parent, parent_dist = todo.pop()
        gaps = apart(rows, centre)
        page = {"centre": centre, "radius": float(gaps.max()), "parent": parent, "parent_dist": parent_dist,
                "rows": every[:0], "gaps": gaps[:0]}
        pages.append(page)
        if len(rows) <= LEAF:
            page |= {"rows": rows, "gaps": gaps}
            continue
        # centres far from each other, out of evenly spaced rows
        pick = rows[np.linspace(0, len(rows) - 1, min(len(rows), 256)).astype(int)]
        centres, far = [int(pick[0])], apart(pick, int(pick[0]))
        while len(centres) < FANOUT and far.max() > 0:
            centres.append(int(pick[np.argmax(far)]))
            far = np.minimum(far, apart(pick, centres[-1]))
        near = np.argmin(apart(rows, np.array(centres)), axis=1) if len(centres) > 1 else np.zeros(len(rows), int)
        if np.bincount(near).max() > 0.9 * len(rows):  # no structure: cut by distance
            near = np.empty(len(rows), int)
            near[np.argsort(gaps)] = np.arange(len(rows)) * FANOUT // len(rows)
            centres = [int(rows[near == k][0]) for k in range(FANOUT)]
        at = len(pages) - 1
        for k, c in enumerate(centres):
            own = rows[near == k]
            if len(own):
                todo.append((own, c, at, float(apart(np.array([centre]), c)[0])))
    return pages, longest


class Tree:
    """The pages of one shard, ready to be searched."""

    def __init__(self, pages: list[dict], dim: int):
        pages = sorted(pages, key=lambda p: p["page"])
        self.longest = pages[0]["longest"]
        self.centres = np.array([np.frombuffer(p["centre"]) for p in pages])
        self.radius = np.array([p["radius"] for p in pages])
        self.parent_dist = np.array([p["parent_dist"] for p in pages])
        self.children = [[] for _ in pages]
        for p in pages[1:]:
            self.children[p["parent"]].append(p["page"])
        self.children = [np.array(c, int) for c in self.children]
        self.vectors = np.concatenate([np.frombuffer(p["vectors"], np.int64).reshape(-1, dim) for p in pages])
        ids = np.concatenate([np.array(p["ids"], np.int64) for p in pages])
        self.gaps = np.concatenate([np.frombuffer(p["gaps"]) for p in pages])
        ends = np.cumsum([len(p["ids"]) for p in pages])
        self.slices = [slice(b - len(p["ids"]), b) for p, b in zip(pages, ends, strict=True)]
        # a score and the place of the id in order make one number that ranks rows
        self.ids, self.place = ids, np.empty(len(ids), np.int64)
        self.by_place = np.argsort(ids, kind="stable")
        self.place[self.by_place] = np.arange(len(ids))

    def search(self, queries: np.ndarray, k: int, floor: list) -> list[list[tuple]]:
        """The best ``k`` (score, entry) of every query; scores under its ``floor`` (or None) may be missing."""
        dim = queries.shape[1]
        bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(self.vectors.astype(float)).max()) * max(dim, 1)
        small = bound < 2.0 ** (62 - RANK_BITS)
        exact, entries = (np.float64 if small else object), self.vectors.astype(np.float64 if small else object)
        q, kind = queries.astype(exact), np.int64 if small else object
        qf = queries.astype(np.float64)
        square = np.einsum("ij,ij->i", qf, qf)
        slack = 1e-6 * (np.sqrt(square) + np.sqrt(self.longest)) + 1e-9
        none = -(1 << 62) if small else -(1 << 300)
        best = np.full((len(q), k), none, kind)
        least = np.array([none >> RANK_BITS if f is None else int(f) for f in floor], kind)

        def reach(rows):  # how far a better row may be
            score = np.maximum(best[rows].min(axis=1) >> RANK_BITS, least[rows]).astype(np.float64)
            return distance(square[rows] + self.longest - 2 * score) + slack[rows]

        n = len(self.radius)
        to_centre, bounds = np.full((len(q), n), np.inf), np.full((len(q), n), np.inf)
        to_centre[:, 0] = distance(square + self.longest - 2 * (qf @ self.centres[0, :dim]))
        bounds[:, 0] = np.maximum(to_centre[:, 0] - self.radius[0], 0)
        limit, active = reach(np.arange(len(q))), np.arange(len(q))
        while len(active):
            page = np.argmin(bounds[active], axis=1)
            go = bounds[active, page] <= limit[active]
            active, page = active[go], page[go]
            order = np.argsort(page, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(page[order])) + 1) if len(order) else ():
                at, rows = page[own[0]], active[own]
                here, far = to_centre[rows, at], limit[rows, None]
                bounds[rows, at] = np.inf
                if len(self.children[at]):
                    some = self.children[at]
                    open_ = np.abs(here[:, None] - self.parent_dist[some]) - self.radius[some] <= far
                    some, open_ = some[open_.any(axis=0)], open_[:, open_.any(axis=0)]
                    d = distance(square[rows, None] + self.longest - 2 * (qf[rows] @ self.centres[some, :dim].T))
                    to_centre[np.ix_(rows, some)] = d
                    bounds[np.ix_(rows, some)] = np.where(open_, np.maximum(d - self.radius[some], 0), np.inf)
                    continue
                span = self.slices[at]
                open_ = np.abs(here[:, None] - self.gaps[span]) <= far
                some = np.flatnonzero(open_.any(axis=0)) + span.start
                if not len(some):
                    continue
                score = q[rows] @ entries[some].T
                score = score.astype(np.int64) if small else score
                rank = (score << RANK_BITS) + ((1 << RANK_BITS) - 1 - self.place[some])
                both = np.hstack([best[rows], rank])
                best[rows] = np.sort(both, axis=1)[:, -k:] if not small else np.partition(both, -k, axis=1)[:, -k:]
                limit[rows] = reach(rows)
        out = []
        for row, low in zip(np.sort(best, axis=1)[:, ::-1].tolist(), least.tolist(), strict=True):
            ranked = [(r >> RANK_BITS, int(self.by_place[(1 << RANK_BITS) - 1 - (r & (1 << RANK_BITS) - 1)]))
                      for r in row if r != none]
            out.append([(s, e) for s, e in ranked if s >= low])
        return out


def clip(score: int) -> int:
    return max(-2**63, min(2**63 - 1, score))


def ordered_key(score: int) -> str:
    """Text that sorts as the exact score does, for scores of up to 180 bits."""
    return f"{score + (1 << 180):046x}"


def assign(df: DataFrame, dim: int, shard_rows: int, max_pivots: int) -> DataFrame:
    """Adds ``shard``: the cell of the nearest pivot, split by hash where it is crowded."""
    n = df.count()
    wanted = min(max_pivots, -(-n // shard_rows))
    rows = df.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(wanted).select("v")
    pivots = np.zeros((wanted, dim))
    for i, r in enumerate(rows.collect()):
        pivots[i, :len(r.v)] = r.v
    half = (pivots * pivots).sum(axis=1) / 2

    def nearest(batches):
        for b in batches:
            x = matrix(b.column(1), dim).astype(np.float64)
            cell = np.argmax(x @ pivots.T - half, axis=1) if len(pivots) else np.zeros(len(x), int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "cell"])

    celled = staged(df.select("vec_id", "v").mapInArrow(nearest, "vec_id long, v array<long>, cell int"), "cells")
    sizes = celled.groupBy("cell").count().orderBy("cell")  # at most max_pivots rows
    parts = {r["cell"]: -(-r["count"] // shard_rows) for r in sizes.collect()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    if not parts:
        return celled.withColumn("shard", F.lit(0))
    spread = F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])])
    base = F.create_map(*[F.lit(x) for c in parts for x in (c, first[c])])
    return celled.withColumn("shard", (base[F.col("cell")] + F.pmod(F.xxhash64("v", "vec_id"), spread[F.col("cell")])).cast("int"))


def index(shards: DataFrame, dim: int) -> DataFrame:
    """The pages of the M-tree of every shard."""

    def run(group: pa.Table) -> pa.Table:
        v = matrix(group.column("v"), dim)
        ids = group.column("vec_id").fill_null(NO_ID).to_numpy()
        pages, longest = build_pages(v)
        extra = distance(longest - (v.astype(np.float64) ** 2).sum(axis=1))
        shard = group.column("shard")[0].as_py()
        rows = [{"shard": shard, "page": i, "parent": p["parent"], "radius": p["radius"], "parent_dist": p["parent_dist"],
                 "centre": np.append(v[p["centre"]].astype(np.float64), extra[p["centre"]]).tobytes(), "longest": longest,
                 "ids": ids[p["rows"]].tolist(), "vectors": np.ascontiguousarray(v[p["rows"]], np.int64).tobytes(),
                 "gaps": p["gaps"].astype(np.float64).tobytes()} for i, p in enumerate(pages)]
        schema = pa.schema([("shard", pa.int32()), ("page", pa.int32()), ("parent", pa.int32()), ("centre", pa.binary()),
                            ("radius", pa.float64()), ("parent_dist", pa.float64()), ("longest", pa.float64()),
                            ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("gaps", pa.binary())])
        return pa.Table.from_pylist(rows, schema)

    return staged(shards.select("shard", "vec_id", "v").groupBy("shard").applyInArrow(run, PAGES), "m-tree")


def searched(pages: DataFrame, queries: DataFrame, key: list[str], dim: int, k: int) -> DataFrame:
    """HITS of ``queries`` (query, v, floor) in the trees of ``pages``, joined on ``key``."""

    def run(tree: pa.Table, block: pa.Table) -> pa.Table:
        cols = [[], [], [], [], []]
        if tree.num_rows and block.num_rows:
            t, q = Tree(tree.to_pylist(), dim), matrix(block.column("v"), dim)
            floor = [None if f is None else int(f, 16) - (1 << 180) for f in block.column("floor").to_pylist()]
            for query, vector, hits in zip(block.column("query").to_pylist(), q, t.search(q, k, floor), strict=True):
                for score, entry in hits:
                    found = int(t.ids[entry])
                    same = bool(np.array_equal(vector, t.vectors[entry]))
                    row = query, None if found == NO_ID else found, clip(int(score)), same, ordered_key(int(score))
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                        names=["query", "vec_id", "score", "same", "rank_key"])

    return pages.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(run, HITS)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 16384, block_rows: int = 4096,
          max_pivots: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for every query row.

    ``vectors`` is what ``scaled`` returns, ``is_query`` a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    rows = staged(vectors.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth"), "vectors")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    shards = staged(assign(rows, dim, shard_rows, max_pivots), "shards")
    pages = index(shards, dim)
    wanted = vectors.filter(is_query).select("vec_id", "v")
    distinct = wanted.select("v").distinct()
    home = shards.groupBy("v").agg(F.min("shard").alias("shard"))
    queries = staged(distinct.join(home, "v").withColumn("query", F.monotonically_increasing_id()), "queries")
    first = searched(pages, queries.withColumn("floor", F.lit(None).cast("string")), ["shard"], dim, k + 1)
    first = staged(first, "home-hits")
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    if n_shards > 1:
        # the k+1-th score at home, if there are as many
        floor = first.groupBy("query").agg(F.min("rank_key").alias("floor"), F.count("*").alias("n")).select(
            "query", F.when(F.col("n") > k, F.col("floor")).alias("floor"))
        blocks = -(-queries.count() // block_rows)
        away = (queries.join(floor, "query", "left").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks).cast("long")))
                .withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).filter("to <> shard")
                .select(F.col("to").alias("shard"), "block", "query", "v", "floor"))
        dealt = pages.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
        more = searched(dealt, away, ["shard", "block"], dim, k + 1)
        first = first.unionByName(more)
    best = Window.partitionBy("query").orderBy(F.desc("rank_key"), F.col("vec_id").asc_nulls_last())
    found = (first.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).groupBy("query")
             .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "same"))).alias("hits")))
    lists = queries.join(found, "query").select("v", "hits")
    # a query row leaves its own row out, once
    own = F.expr("array_position(transform(hits, h -> h.same and h.vec_id <=> query_id), true)")
    got = wanted.withColumnRenamed("vec_id", "query_id").join(lists, "v").withColumn("own", own)
    kept = F.expr(f"slice(filter(hits, (h, i) -> i + 1 <> own), 1, {k})")
    got = got.select("query_id", F.posexplode(kept).alias("at", "hit"))
    return got.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
