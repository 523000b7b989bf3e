"""Exact vector search and exact embedding near-duplicates.

`top_k`: columnar branch-and-bound. Queries and candidates are dealt to a grid of blocks. In a block the candidates lie
dimension by dimension; partial scores grow by one group of dimensions at a time, the mass that is left on both sides bounds
what can still come, and candidates that can't reach the k-th best any more are compacted away.

`near_vectors`: cover-tree dual traversal. Equal vectors fall together first. The rest of a label is dealt to nodes around
pivots (the upper level); pairs of nodes are dropped if their centres lie further apart than both covering radii and the
threshold, groups of nodes before the nodes themselves. In a task each node becomes a tree of nested levels with halving
radii, and pairs of tree nodes go down together, pruned by the same bound, until pairs of vectors are left, which are decided
by their cosine. Distances are made for pairs that are still open only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setloom.llm.common import connected_components, discard, lean, local_forest, staged


def whole(embedding: Column) -> Column:
    """The vector is there and all its components are finite."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Vectors of one length as rows; vectors without components make a matrix without columns."""
    flat = np.asarray(column.combine_chunks().flatten()).astype(kind)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def best_of(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, barred: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, scores) that hold the k largest inner products, ties included.

    columns: dimensions x candidates; rest[b]: each candidate's norm over the dimensions from b * step on.
    """
    alive = np.flatnonzero(~barred)
    part = np.zeros(len(alive), np.int64)
    mass = np.sqrt(np.cumsum((query.astype(float) ** 2)[::-1])[::-1])
    for b, d in enumerate(range(0, len(query), step)):
        for j in range(d, min(d + step, len(query))):
            part += columns[j, alive] * query[j]
        if d + step >= len(query) or len(alive) <= k:
            continue
        bound = rest[b + 1][alive] * mass[d + step] * (1 + 1e-9) + 1
        floor = np.partition(part - bound, len(alive) - k)[len(alive) - k]
        keep = part + bound >= floor
        alive, part = alive[keep], part[keep]
    return alive, part


#: Up to this magnitude products of components add up exactly in doubles and 64-bit integers, for up to 8192 dimensions.
NARROW = 1 << 20


def _search(k: int, step: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and candidates.num_rows:
            x, q = matrix(candidates.column("v"), np.int64), matrix(queries.column("v"), np.int64)
            ids, row, own, asked = (np.asarray(c) for c in (candidates.column("vec_id"), candidates.column("rid"), queries.column("rid"), queries.column("vec_id")))
            bounded = lambda m: ((m <= NARROW) & (m >= -NARROW)).all(axis=1) & (m.shape[1] <= 8192)
            slim, wide = np.flatnonzero(bounded(x)), np.flatnonzero(~bounded(x))
            slim_q = bounded(q)
            order = np.argsort(-(x[slim].astype(float) ** 2).sum(axis=0), kind="stable")  # the heaviest dimensions first
            columns, turned = np.ascontiguousarray(x[slim][:, order].T), q[:, order]
            tail = np.cumsum((columns.astype(float) ** 2)[::-1], axis=0)[::-1]
            rest = [np.sqrt(tail[d]) for d in range(0, len(columns), step)]
            for i in range(len(q)):
                at, score = np.zeros(0, np.int64), []
                if slim_q[i]:
                    at, score = best_of(turned[i], columns, rest, row[slim] == own[i], k, step)
                    at, score = slim[at], score.tolist()
                # the few products that may leave 64 bits are added up as Python's integers
                exact = [j for j in (wide if slim_q[i] else range(len(x))) if row[j] != own[i]]
                score += [sum(a * b for a, b in zip(q[i].tolist(), x[j].tolist(), strict=True)) for j in exact]
                at = np.concatenate([at, np.array(exact, np.int64)])
                top = sorted(range(len(at)), key=lambda r: (-score[r], ids[at[r]]))[:k]
                held = [min(max(score[r], -(1 << 63)), (1 << 63) - 1) for r in top]
                rows.append((np.full(len(top), asked[i]), np.full(len(top), own[i]), ids[at[top]] if top else np.zeros(0, np.int64), np.array(held, np.int64)))
        cols = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in range(4)]
        return pa.table({"query_id": cols[0], "rid": cols[1], "vec_id": cols[2], "score": cols[3]})

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, candidate_block: int = 8192, query_block: int = 1024, step: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each row with vec_id % every = 0.

    vectors: vec_id, embedding. Components become floor(scale * x), held to 64 bits, as the scores are. Ties go to the smaller
    vec_id. Rows without a vec_id, with a null vector, or with null or non-finite components take no part; vectors are compared
    with those of equal length only, so those without components score 0 with each other; of the rows only the query itself is
    no candidate, so repeated rows, and rows that share an id, are candidates and queries each; an empty table gives an empty
    result; further columns, whatever their names, are left out.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = vectors.where(F.col("vec_id").isNotNull() & whole(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    usable = staged(usable.withColumn("rid", F.monotonically_increasing_id()), "topk-vectors")
    asked = usable.where(F.col("vec_id") % every == 0)
    across = max(1, math.ceil(usable.count() / candidate_block))
    down = max(1, math.ceil(asked.count() / query_block))
    block = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    q = asked.withColumns({"dim": F.size("v"), "qb": block(down)}).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    c = usable.withColumns({"dim": F.size("v"), "cb": block(across)}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    keys = ["dim", "qb", "cb"]
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_search(k, step), "query_id long, rid long, vec_id long, score long")
    found = staged(found, "topk-found")
    discard(usable)
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.expr("~score").alias("less"), "vec_id", "score"))), 1, k)
    ranked = found.groupBy("query_id", "rid").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


class Distances:
    """Euclidean distances between unit vectors, counted."""

    def __init__(self) -> None:
        self.made = 0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each row of x from the one row y, or from the row of y at its place."""
        self.made += len(x)
        return np.sqrt(np.maximum(2 - 2 * (x @ y if y.ndim == 1 else np.einsum("ij,ij->i", x, y)), 0))

    def table(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each row of x from each row of y."""
        self.made += len(x) * len(y)
        return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


@dataclass(frozen=True)
class Level:
    centre: np.ndarray  # the vector at each node
    parent: np.ndarray  # its node in the level above
    away: np.ndarray  # how far it is from its parent's vector
    cover: np.ndarray  # no vector below the node is further away than this


def cover_levels(x: np.ndarray, least: float, distances: Distances) -> list[Level]:
    """Levels of a cover tree over unit vectors x.

    A level's centres are more than its radius apart, hold all centres of the level above (nesting), and every vector lies
    within reach of one; radii halve from 1 down to `least`, and the last level is the vectors themselves. Each centre is
    only measured against the vectors that its parent covers and that no centre made before it covers.
    """
    n = len(x)
    home, away = np.zeros(n, np.int64), distances(x, x[0])  # each vector's node in the level, and how far it is from its centre
    levels = [Level(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.array([away.max()]))]
    radius = 1.0
    while radius >= least and len(levels[-1].centre) < n:
        centre, parent, apart = [], [], []
        new_home, new_away = np.empty(n, np.int64), np.empty(n)
        order = np.argsort(home, kind="stable")
        edge = np.searchsorted(home[order], np.arange(len(levels[-1].centre) + 1))
        for node, c in enumerate(levels[-1].centre.tolist()):  # the old centres first, then what they leave uncovered
            inside = order[edge[node] : edge[node + 1]]
            d, at = away[inside], 0.0
            while True:
                near = d <= radius
                new_home[inside[near]], new_away[inside[near]] = len(centre), d[near]
                centre.append(c)
                parent.append(node)
                apart.append(at)
                inside = inside[~near]
                if not len(inside):
                    break
                c = int(inside[0])
                at, d = away[c], distances(x[inside], x[c])
                d[0] = 0.0
        home, away = new_home, new_away
        cover = np.zeros(len(centre))
        np.maximum.at(cover, home, away)
        levels.append(Level(np.array(centre), np.array(parent), np.array(apart), cover))
        radius /= 2
    levels.append(Level(np.arange(n), home, away, np.zeros(n)))
    return levels


def _stretched(levels: list[Level], deep: int) -> list[Level]:
    """The same tree with its second-last level repeated, so that both trees have as many levels."""
    last = levels[-2]
    again = Level(last.centre, np.arange(len(last.centre)), np.zeros(len(last.centre)), last.cover)
    return [*levels[:-1], *[again] * (deep - len(levels)), levels[-1]]


def _children(level: Level, above: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(level.parent, kind="stable")
    return order, np.searchsorted(level.parent[order], np.arange(above + 1))


def dual_pairs(x: np.ndarray, y: np.ndarray, reach: float, distances: Distances, many: int = 1 << 12, at_once: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of x and y that may lie within `reach`, by going down both trees together; within one tree (y is x) i < j.

    A pair of nodes goes down if its centres are no further apart than both covering radii and the reach. Distances are made
    for the children of such pairs alone: as one table if two nodes have `many` pairs of children, else pair by pair, where
    the distances to the parents don't rule them out, and not again where both children stand at their parents' vectors.
    """
    one, slack = x is y, 1e-6
    a = cover_levels(x, reach / 2, distances)
    b = a if one else cover_levels(y, reach / 2, distances)
    deep = max(len(a), len(b))
    a, b = _stretched(a, deep), _stretched(b, deep)
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    apart = distances(x[a[0].centre], y[b[0].centre])
    for p, q, up_p, up_q in zip(a[1:], b[1:], a, b, strict=False):
        (kids_p, edge_p), (kids_q, edge_q) = _children(p, len(up_p.centre)), _children(q, len(up_q.centre))
        each = np.diff(edge_p)[left] * np.diff(edge_q)[right]
        found = [(left[:0], right[:0], apart[:0])]
        for k in np.flatnonzero(each >= many).tolist():
            mine, theirs = kids_p[edge_p[left[k]] : edge_p[left[k] + 1]], kids_q[edge_q[right[k]] : edge_q[right[k] + 1]]
            rows = max(at_once // len(theirs), 1)
            for s in range(0, len(mine), rows):
                part = mine[s : s + rows]
                d = distances.table(x[p.centre[part]], y[q.centre[theirs]])
                keep = d <= p.cover[part][:, None] + (q.cover[theirs] + reach + slack)
                if one and left[k] == right[k]:
                    keep &= part[:, None] <= theirs
                i, j = np.nonzero(keep)
                found.append((part[i], theirs[j], d[i, j]))
        few = np.flatnonzero(each < many)
        left, right, apart, each = left[few], right[few], apart[few], each[few]
        edges = np.append(np.searchsorted(np.cumsum(each), np.arange(0, each.sum(), at_once)), len(few))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            pair = np.repeat(np.arange(s, e), each[s:e])
            rank = np.arange(len(pair)) - np.repeat(np.cumsum(each[s:e]) - each[s:e], each[s:e])
            wide = np.diff(edge_q)[right[pair]]
            i, j = kids_p[edge_p[left[pair]] + rank // wide], kids_q[edge_q[right[pair]] + rank % wide]
            bound = p.cover[i] + q.cover[j] + reach + slack
            keep = apart[pair] - p.away[i] - q.away[j] <= bound
            if one:
                keep &= (left[pair] != right[pair]) | (i <= j)
            i, j, bound, pair = i[keep], j[keep], bound[keep], pair[keep]
            d = apart[pair]
            new = np.flatnonzero((p.centre[i] != up_p.centre[left[pair]]) | (q.centre[j] != up_q.centre[right[pair]]))
            d[new] = distances(x[p.centre[i[new]]], y[q.centre[j[new]]])
            keep = d <= bound
            found.append((i[keep], j[keep], d[keep]))
        left, right, apart = (np.concatenate(f) for f in zip(*found, strict=True))
    if one:
        keep = left != right
        left, right = np.minimum(left, right)[keep], np.maximum(left, right)[keep]
    return left, right


def _links(cosine: float):
    reach = math.sqrt(2 - 2 * cosine)

    def run(table: pa.Table) -> pa.Table:
        x = matrix(table.column("embedding"), np.float64)
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        cid, n = np.asarray(table.column("cid")), np.asarray(table.column("n"))
        first = np.asarray(table.column("own")) == np.asarray(table.column("p"))
        if table.column("p")[0] == table.column("q")[0]:
            left = right = np.arange(len(x))
            i, j = dual_pairs(unit, unit, reach, Distances())
        else:
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            if not len(left) or not len(right):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
            i, j = dual_pairs(unit[left], unit[right], reach, Distances())
        i, j = left[i], right[j]
        good = np.zeros(len(i), bool)
        for s in range(0, len(i), 100_000):
            u, v = i[s : s + 100_000], j[s : s + 100_000]
            good[s : s + 100_000] = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
        i, j = i[good], j[good]
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        root = local_forest(len(x), i, j)
        low = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(low, root, cid)
        some = links > 0
        return pa.table({"a": cid[some], "b": low[root][some], "links": links[some].astype(np.int64)})

    return run


def _nearest(shared):
    def run(batches):
        pivots = shared.value
        for batch in batches:
            label, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            values = batch.column(4)
            pivot, far = np.full(batch.num_rows, -1, np.int64), np.full(batch.num_rows, 2.0)
            for key in {*zip(label.tolist(), size.tolist(), strict=True)}:
                if key in pivots:
                    rows = np.flatnonzero((label == key[0]) & (size == key[1]))
                    x = np.asarray(values.take(pa.array(rows)).flatten()).astype(float).reshape(len(rows), -1)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    cos = x @ pivots[key][1].T
                    best = cos.argmax(axis=1)
                    pivot[rows] = pivots[key][0][best]
                    far[rows] = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(rows)), best], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], names=["lab", "dim", "cid", "n", "embedding", "pivot", "far"])

    return run


def pivot_groups(pivots: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """(lab, dim, pivot, centre, group, group's centre, how far the pivot is from it): of n pivots of a label about the root of n lead groups."""
    rows = []
    for (lab, dim), (ids, x) in pivots.items():
        lead = np.arange(math.isqrt(len(ids) - 1) + 1)
        cos = x @ x[lead].T
        best = cos.argmax(axis=1)
        far = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(x)), best], 0))
        rows += [(lab, dim, int(i), v.tolist(), int(g), x[g].tolist(), float(f)) for i, v, g, f in zip(ids, x, best, far, strict=True)]
    return rows


def _apart(a: str, b: str, radii: Column, reach: float) -> Column:
    """Centres a and b are further apart than the radii and the reach; false where there is no centre."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0))) > radii + reach + 1e-6, F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, node: int = 1024, most_pivots: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors link at a cosine of `cosine` or more if their labels are equal and not null. A null, empty or zero vector, or one
    with null or non-finite components, links with nothing, nor do vectors of other lengths. Rows count each, repeated ones and
    those that share a vec_id as well; component_id is the smallest vec_id reachable; a row with a null vec_id is linked, but
    gives no component its name, so component_id is null where only such rows are reached. An empty table gives an empty
    result; further columns, whatever their names, are left out. The pivots that are broadcast are at most `most_pivots`.
    """
    spark, reach = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    some = F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("label").isNotNull() & whole(F.col("embedding")) & some, F.lit(False))
    # by a power of two each, so that squares neither overflow nor vanish; cosines stay what they are, to the last bit
    size = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))))
    # the size is a variable of a function, so that it is found once a vector, not for each component
    scaled = F.get(F.transform(F.array(size), lambda one: F.transform("embedding", lambda x: x.cast("double") / one)), 0)
    own = staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("lab"), F.when(able, scaled).alias("embedding")), "near-vectors")
    classes = own.where("embedding is not null").groupBy("lab", "embedding").agg(F.min("vec_id").alias("named"), F.count("*").alias("n"))
    # a class of equal vectors goes by a number of its own, since ids may be null or shared
    classes = staged(classes.select("lab", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("cid"), "n", "embedding", "named"), "near-classes")
    wanted, total = min(most_pivots, math.ceil((count := classes.count()) / node)), max(count, 1)
    point = F.pmod(F.xxhash64("lab", "embedding"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen: dict[tuple[int, int], list] = {}
    for r in classes.where(point < wanted / total).orderBy(point, "cid").limit(most_pivots).collect():
        v = np.array(r.embedding)
        chosen.setdefault((r.lab, r.dim), []).append((r.cid, v / np.sqrt(v @ v)))
    table = {k: (np.array([i for i, _ in v]), np.stack([x for _, x in v])) for k, v in chosen.items()}
    ddl = "lab long, dim int, cid long, n long, embedding array<double>, pivot long, far double"
    placed = staged(classes.drop("named").mapInArrow(lean(_nearest(spark.sparkContext.broadcast(table))), ddl), "near-placed")
    sizes = placed.groupBy("lab", "dim", "pivot").agg(F.ceil(F.count("*") / node).cast("int").alias("parts"))
    sub = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    dealt = placed.join(sizes, ["lab", "dim", "pivot"]).withColumn("own", F.xxhash64("pivot", sub))
    dealt = staged(dealt.select("lab", "dim", "cid", "n", "embedding", "pivot", "far", "own"), "near-nodes")
    nodes = dealt.groupBy("lab", "dim", "own").agg(F.max("far").alias("radius"), F.first("pivot").alias("pivot"))
    centres = spark.createDataFrame(pivot_groups(table), "lab long, dim int, pivot long, centre array<double>, lead int, middle array<double>, off double")
    nodes = nodes.join(centres, ["lab", "dim", "pivot"], "left").withColumns({"lead": F.coalesce("lead", F.lit(-1)), "off": F.coalesce("off", F.lit(0.0))})
    nodes = staged(nodes, "near-centres")
    # pairs of leads first, then of their nodes: a level above the nodes, pruned by the same bound
    leads = nodes.groupBy("lab", "dim", "lead").agg(F.max(F.col("radius") + F.col("off")).alias("r1"), F.first("middle").alias("m1"))
    leads = staged(leads, "near-leads")
    second = leads.withColumnsRenamed({"lead": "lead2", "r1": "r2", "m1": "m2"})
    lead_pairs = leads.join(second, ["lab", "dim"]).where(~_apart("m1", "m2", F.col("r1") + F.col("r2"), reach)).select("lab", "dim", "lead", "lead2")
    other = nodes.select("lab", "dim", F.col("lead").alias("lead2"), F.col("own").alias("own2"), F.col("radius").alias("radius2"), F.col("centre").alias("centre2"))
    pairs = lead_pairs.join(nodes, ["lab", "dim", "lead"]).join(other, ["lab", "dim", "lead2"]).where("own <= own2")
    pairs = pairs.where(~_apart("centre", "centre2", F.col("radius") + F.col("radius2"), reach)).select("lab", "dim", F.col("own").alias("p"), F.col("own2").alias("q"))
    sides = staged(pairs.select("lab", "dim", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("own")), "near-pairs")
    both = dealt.join(sides, ["lab", "dim", "own"]).select("lab", "dim", "p", "q", "own", "cid", "n", "embedding")
    found = staged(both.groupBy("lab", "dim", "p", "q").applyInArrow(_links(cosine), "a long, b long, links long"), "near-found")
    linked = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = staged(connected_components(found.select("a", "b")).withColumnsRenamed({"node": "cid"}), "near-roots")
    known = classes.select("lab", "embedding", "cid", "n", "named").join(linked, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = classes.select("cid", "named").join(roots, "cid").groupBy("root").agg(F.min("named").alias("least"))
    info = known.join(names, "root", "left").select("lab", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "named").alias("component"))
    info = staged(info.withColumn("linked", F.lit(True)), "near-info")
    discard(classes, placed, dealt, nodes, leads, sides, found, roots)
    out = own.join(info, ["lab", "embedding"], "left")
    component = F.when(F.col("linked"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
