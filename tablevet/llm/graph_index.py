"""Nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards of bounded size by a hash.  Every shard is a graph: points come in by
batches, a greedy search for each point over the graph so far proposes neighbours, and pruning
keeps a candidate only if no nearer neighbour that was kept is ``slack`` times nearer to it, so
that edges point in different directions.  Edges are made in both directions and pruned again
where a point has too many.  A beam search for each query over each shard gives candidates; the best
of all shards, and a few more, meet the original vectors in a join, and their inner products are taken in
double precision.  Graphs hold single-precision copies, scaled so that the largest component is 1: they
only guide the search, whatever finite size the components have.

The largest inner product becomes the smallest distance by one more coordinate, which gives all
vectors the same length.  Equal vectors are one point of the graph with a list of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablevet.sources.scratch import staged

SHARD_POINTS = 8192
DEGREE = 32
BEAM = 64
SEARCH_BEAM = 96
SLACK = 1.2
QUERY_BLOCK = 2048  # queries that meet a shard at once: each block takes a copy of every shard through the shuffle
MORE = 12  # candidates beyond k that are scored exactly, for the search scores in single precision
_BATCH = 512
_MOST_POINTS = 1 << 15  # point numbers are stored in 16 bits


def _beam_search(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest points met by greedy search, for all queries in step: (numbers, squared distances)."""
    n, rows = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((n, beam), -1, np.int64)
    near = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = start
    near[:, 0] = ((queries - points[start]) ** 2).sum(1)
    open_ = ids >= 0
    seen = np.zeros((n, len(points)), bool)
    seen[:, start] = True
    while True:
        ahead = np.where(open_, near, np.inf)
        best = ahead.argmin(1)
        live = np.flatnonzero(np.isfinite(ahead[np.arange(n), best]))
        if not len(live):
            return ids, near
        at = best[live]
        open_[live, at] = False
        next_ = edges[ids[live, at]]
        new = next_ >= 0
        next_ = np.where(new, next_, 0)
        new &= ~seen[live[:, None], next_]
        # only what is new is marked: a place without an edge stands for point 0, which it must not unmark
        row, place = np.nonzero(new)
        seen[live[row], next_[row, place]] = True
        away = ((points[next_] - queries[live][:, None, :]) ** 2).sum(2)
        away = np.where(new, away, np.inf).astype(np.float32)
        all_near = np.concatenate([near[live], away], axis=1)
        all_ids = np.concatenate([ids[live], np.where(new, next_, -1)], axis=1)
        all_open = np.concatenate([open_[live], new], axis=1)
        keep = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
        line = rows[: len(live)]
        near[live], ids[live], open_[live] = all_near[line, keep], all_ids[line, keep], all_open[line, keep]
        open_[live] &= np.isfinite(near[live])


def _pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Neighbours of each point ``own`` among its row of candidates (-1: none)."""
    m, width = candidates.shape
    line = np.arange(m)[:, None]
    away = ((points[candidates] - points[own][:, None, :]) ** 2).sum(2)
    away = np.where((candidates < 0) | (candidates == own[:, None]), np.inf, away)
    rank = np.argsort(away, axis=1, kind="stable")
    candidates, away = candidates[line, rank], away[line, rank]
    twice = np.zeros(candidates.shape, bool)
    twice[:, 1:] = (candidates[:, 1:] == candidates[:, :-1]) & np.isfinite(away[:, 1:])
    away[twice] = np.inf
    vectors = points[candidates]
    between = np.maximum(0, (vectors**2).sum(2)[:, :, None] + (vectors**2).sum(2)[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1))
    alive = np.isfinite(away)
    out = np.full((m, degree), -1, np.int64)
    for k in range(degree):
        first = alive.argmax(1)
        some = np.flatnonzero(alive[np.arange(m), first])
        if not len(some):
            break
        chosen = first[some]
        out[some, k] = candidates[some, chosen]
        # drop what the chosen one already leads to; distances are squared
        covered = slack * slack * between[some, chosen] <= away[some]
        alive[some] &= ~covered
        alive[some, chosen] = False
    return out


def _with_back_edges(points: np.ndarray, edges: np.ndarray, sources: np.ndarray, degree: int, slack: float) -> None:
    """Add the reverse of the edges of ``sources``; rows that overflow are pruned."""
    targets = edges[sources]
    good = targets >= 0
    to, back = targets[good], np.repeat(sources, good.sum(1))
    rank = np.argsort(to, kind="stable")
    to, back = to[rank], back[rank]
    rows, first, counts = np.unique(to, return_index=True, return_counts=True)
    most = min(int(counts.max(initial=0)), 4 * degree)
    if not len(rows):
        return
    # a point that many lead to takes them over several rounds, so a row stays of bounded width
    for start in range(0, int(counts.max()), most):
        take = np.flatnonzero(counts > start)
        spot = first[take][:, None] + start + np.arange(most)[None, :]
        inside = start + np.arange(most)[None, :] < counts[take][:, None]
        new = np.where(inside, back[np.minimum(spot, len(back) - 1)], -1)
        for i in range(0, len(take), _BATCH):
            own = rows[take[i : i + _BATCH]]
            both = np.concatenate([edges[own], new[i : i + _BATCH]], axis=1)
            edges[own] = _pruned(points, own, both, degree, slack)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, slack: float = SLACK) -> tuple[np.ndarray, int]:
    """(neighbours of every point, -1 where there are fewer; the point at which searches start)."""
    n = len(points)
    edges = np.full((n, degree), -1, np.int64)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(0).permutation(n)
    order = np.r_[start, order[order != start]]
    head = order[: min(n, 4 * degree)]  # the first points know each other
    rows = np.tile(head, (len(head), 1))
    edges[head] = _pruned(points, head, rows, degree, slack)
    done = len(head)
    while done < n:
        batch = order[done : done + min(_BATCH, max(degree, done))]
        found, _ = _beam_search(points, edges, start, points[batch], beam)
        # points of one batch do not see each other in the graph yet: propose some of them as well
        mates = np.tile(batch, (len(batch), 1))[:, :: max(1, len(batch) // degree)]
        edges[batch] = _pruned(points, batch, np.concatenate([found, mates], axis=1), degree, slack)
        _with_back_edges(points, edges, batch, degree, slack)
        done += len(batch)
    for i in range(0, n, _BATCH):  # once more over the whole graph
        batch = order[i : i + _BATCH]
        found, _ = _beam_search(points, edges, start, points[batch], beam)
        edges[batch] = _pruned(points, batch, np.concatenate([found, edges[batch]], axis=1), degree, slack)
        _with_back_edges(points, edges, batch, degree, slack)
    return edges, start


def _graph(group: pd.DataFrame, scale: float, largest: float) -> pd.DataFrame:
    if len(group) > _MOST_POINTS:
        raise ValueError(f"a shard of {len(group)} points: at most {_MOST_POINTS} can be numbered")
    points = (np.stack(group["vector"].to_numpy()).astype(np.float64) / scale).astype(np.float32)
    rest = np.sqrt(np.maximum(0, largest - (points.astype(np.float64) ** 2).sum(1))).astype(np.float32)
    points = np.concatenate([points, rest[:, None]], axis=1)
    edges, start = build_graph(points)
    return pd.DataFrame(
        {
            "dims": [int(group["dims"].iloc[0])], "shard": [int(group["shard"].iloc[0])], "start": [start],
            "points": [points.tobytes()], "edges": [edges.astype(np.int16).tobytes()],
            "classes": [group["class"].to_numpy(np.int64).tobytes()],
        }
    )


def _query_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Queries of one dimension gathered into rows of at most ``size`` vectors."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy()
        vectors = batch.column("vector")
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            for i in range(0, len(rows), size):
                own = rows[i : i + size]
                flat = np.stack(vectors.take(pa.array(own)).to_numpy(zero_copy_only=False)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(d)], pa.int32()), pa.array([ids[own].tobytes()]), pa.array([flat.tobytes()])],
                    names=["dims", "query_ids", "queries"],
                )


def _searched(group: pd.DataFrame, most: int, beam: int) -> pd.DataFrame:
    """The best ``most`` points of a shard for each query of a block; scores compare within a query only."""
    out = []
    for row in group.itertuples():
        dims = row.dims
        points = np.frombuffer(row.points, np.float32).reshape(-1, dims + 1)
        edges = np.frombuffer(row.edges, np.int16).reshape(len(points), -1).astype(np.int64)
        classes = np.frombuffer(row.classes, np.int64)
        ids = np.frombuffer(row.query_ids, np.int64)
        every = np.frombuffer(row.queries, np.float64).reshape(-1, dims)
        every = every / np.abs(every).max(1, keepdims=True)  # the length of a query changes no order
        for i in range(0, len(every), _BATCH):
            queries = every[i : i + _BATCH]
            flat = np.concatenate([queries.astype(np.float32), np.zeros((len(queries), 1), np.float32)], axis=1)
            found, _ = _beam_search(points, edges, row.start, flat, max(beam, most))
            scores = np.einsum("qkd,qd->qk", points[found][:, :, :dims].astype(np.float64), queries)
            scores = np.where(found < 0, -np.inf, scores)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :most]
            line = np.arange(len(queries))[:, None]
            good = found[line, best] >= 0
            own = np.repeat(ids[i : i + _BATCH], good.sum(1))
            out.append(pd.DataFrame({"query_id": own, "class": classes[found[line, best][good]], "score": scores[line, best][good]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "class": [], "score": []})


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, vector, dims`` of the rows whose vector takes part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & some)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("vector"), F.size(x).alias("dims"))


def build_index(vectors: DataFrame, k: int, shard_points: int = SHARD_POINTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, leaders, members): one graph for each shard, each class's vector, and its ``k + 1`` smallest ids.

    A class is a set of equal vectors; its name is its smallest id.  No answer of ``k`` rows can
    need more of its ids.  Two rounds, the first over salted parts, keep a class of any size out
    of one task.
    """
    same = ["dims", "key", "other"]
    keyed = vectors.select("vec_id", "vector", "dims", F.xxhash64("vector").alias("key"), F.hash("vector").alias("other"))
    salted = Window.partitionBy(*same, F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = keyed.withColumn("nth", F.row_number().over(salted)).filter(F.col("nth") <= k + 1)
    whole = Window.partitionBy(*same).orderBy("vec_id")
    few = staged(few.withColumn("nth", F.row_number().over(whole)).filter(F.col("nth") <= k + 1).withColumn("class", F.first("vec_id").over(whole)))
    leaders = few.filter("nth = 1").select("class", "vector", "dims")
    count, scale = leaders.agg(F.count("*"), F.max(F.array_max(F.transform("vector", lambda v: F.abs(v.cast("double")))))).first()
    scale = float(scale or 1)
    squared = F.aggregate("vector", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / scale, F.lit(2.0)))
    largest = leaders.agg(F.max(squared)).first()[0]
    shards = max(1, -(-count // shard_points))
    dealt = leaders.withColumn("shard", F.pmod(F.xxhash64("class"), F.lit(shards)).cast("int"))
    schema = "dims int, shard int, start int, points binary, edges binary, classes binary"
    graphs = dealt.groupBy("dims", "shard").applyInPandas(partial(_graph, scale=scale, largest=float(largest or 0)), schema)
    return staged(graphs), leaders, few.select("class", "vec_id")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM, shard_points: int = SHARD_POINTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query by inner product.

    ``rows`` and ``queries`` have ``vec_id, embedding``; a query's own id is no answer.  Ties go to
    the smaller vec_id; a query with fewer candidates gets all that were found.  Vectors that are
    null, zero or hold null or non-finite components, and null ids, take no part; vectors of other
    dimensions than the query's are no candidates; repeated ids are one row.  Scores are inner products
    of the original vectors in double precision; other columns are left out.
    """
    vectors = usable_vectors(rows).dropDuplicates(["vec_id"])
    graphs, leaders, members = build_index(vectors, k, shard_points)
    asked = staged(usable_vectors(queries).dropDuplicates(["vec_id"]))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    blocks = asked.repartition(parts, "vec_id").mapInArrow(partial(_query_blocks, size=QUERY_BLOCK), "dims int, query_ids binary, queries binary")
    blocks = staged(blocks.withColumn("block", F.monotonically_increasing_id()))
    pairs = blocks.join(graphs, "dims")
    found = pairs.groupBy("block", "shard").applyInPandas(
        partial(_searched, most=k + 1 + MORE, beam=beam), "query_id bigint, class bigint, score double"
    )
    nearness = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    found = staged(found).withColumn("n", F.row_number().over(nearness)).filter(F.col("n") <= k + 1 + MORE)
    exact = "aggregate(zip_with(vector, query, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"
    found = found.select("query_id", "class").join(leaders.select("class", "vector"), "class")
    found = found.join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    found = found.select("query_id", "class", F.expr(exact).alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.join(members, "class").filter("vec_id != query_id").withColumn("rank", F.row_number().over(rank))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
