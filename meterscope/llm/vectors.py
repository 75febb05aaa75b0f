"""Nearest neighbours by balanced posting lists.

1. Balanced k-means, split recursively, gives centroids; it is fitted on at most SAMPLE vectors.
2. Every vector goes to the list of its nearest centroid and, near a boundary, to further lists whose
   centroid is at most `1 + REPLICATE` times as far, unless a list that it is in already is nearer to
   that centroid than the vector is (up to COPIES lists).
3. A query walks a neighbour graph of the centroids, held in memory, best first; of the `ef` centroids it
   ends with, distance-ratio pruning keeps those at most `1 + prune` times as far as the nearest (and as
   many as needed to hold enough vectors). Both are calibrated by that very walk: on at most TUNE vectors of
   the sample, the ratio and `ef` that let ASKED of them see RECALL of their true nearest, found by brute
   force. Where the data have no clusters at all, that is most lists: a walk that would measure as many
   distances as there are centroids takes all of them in order instead.
4. Queries meet lists in bundles of neighbouring lists, a 64th of the vectors about (of a long list a block of so many)
   and QBLOCK queries a task. Matrix products leave out what is farther than the nearest found so far, with
   a bound on their rounding; what is left gets exact distances. The nearest of all are ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SAMPLE = 65_536
LIST = 128
MOST_LISTS = 8192
COPIES = 4
REPLICATE = 0.15
DEGREE = 16
RECALL = 0.97
TUNE = 16_384
ASKED = 200
#: Vectors of the lists that a task works on together, about: a 64th of all, at least and at most so many.
BUNDLE, BUNDLE_MOST = 1024, 65_536
#: Queries that a task works on.
QBLOCK = 16_384
#: Vectors, and distances, that a task works on at once.
PIECE, AT_ONCE = 1024, 1 << 18


def valid(v: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0)


def centroids(points: np.ndarray, size: int) -> np.ndarray:
    """Means of groups of about `size` points: k-means with a penalty on large groups, recursively."""
    out: list[np.ndarray] = []
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        x = points[own]
        if len(own) <= size or not np.ptp(x, axis=0).any():
            out.append(x.mean(0))
            continue
        k = min(8, -(-len(own) // size))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].astype(np.float64)
        c += np.random.default_rng(len(own)).normal(0, 1e-9, c.shape)
        weight = np.zeros(k)
        for _ in range(10):
            d = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).clip(0)
            g = (d + weight * d.mean()).argmin(1)
            n = np.bincount(g, minlength=k)
            weight = 0.5 * weight + 0.2 * (n * k / len(x) - 1)
            for j in np.flatnonzero(n):
                c[j] = x[g == j].mean(0)
        parts = [own[g == j] for j in range(k) if (g == j).any()]
        if len(parts) == 1:
            out.append(x.mean(0))
        else:
            stack += parts
    return np.array(out)


def graph(c: np.ndarray, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each centroid, entries). Of its nearest and of as many spread over all, a centroid is
    linked with those that are nearer to it than to any it is linked with already, so links leave its cluster;
    links hold both ways, of very many that lead to one the shortest. Entries are spread over the centroids, and reach all of them."""
    n = len(c)
    near = min(4 * degree, n - 1)
    ends: list[list[int]] = [[] for _ in range(n)]
    back: list[list[tuple[float, int]]] = [[] for _ in range(n)]
    norms, draw = (c * c).sum(1), np.random.default_rng(7)
    for at in range(0, n if near > 0 else 0, 256):
        own = np.arange(at, min(at + 256, n))
        d = (norms[own, None] - 2 * c[own] @ c.T + norms).clip(0)
        d[np.arange(len(own)), own] = np.inf
        some = np.argpartition(d, near - 1, axis=1)[:, :near]
        far = draw.integers(0, n, (len(own), degree))
        some = np.concatenate([some, np.where(far == own[:, None], some[:, :1], far)], axis=1)
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
        to = np.take_along_axis(d, some, 1)
        points = c[some]
        apart = (norms[some][:, :, None] - 2 * points @ points.transpose(0, 2, 1) + norms[some][:, None]).clip(0)
        taken = np.zeros(some.shape, bool)
        for j in range(some.shape[1]):
            taken[:, j] = (taken.sum(1) < degree) & (~taken | (apart[:, :, j] > to[:, j, None])).all(1)
        taken[:, : degree // 2] = True  # and a few nearest, whatever their direction
        for i, row, use, away in zip(own.tolist(), some, taken, to, strict=True):
            for j, r in zip(row[use].tolist(), away[use].tolist(), strict=True):
                ends[i].append(j)
                back[j].append((r, i))
    links = [sorted({*e, *(j for _, j in sorted(b)[: 2 * degree])} - {i}) for i, (e, b) in enumerate(zip(ends, back, strict=True))]
    entries = set(np.linspace(0, n - 1, max(8, int(np.sqrt(n)))).astype(int).tolist())
    seen, stack = set(entries), list(entries)
    for start in range(n):  # what no entry reaches becomes one
        if start not in seen and not stack:
            entries.add(start)
            seen.add(start)
            stack.append(start)
        while stack:
            new = [j for j in links[stack.pop()] if j not in seen]
            seen.update(new)
            stack += new
    width = max(1, max(map(len, links)))
    return np.array([e + [i] * (width - len(e)) for i, e in enumerate(links)]), np.array(sorted(entries))


def walk(q: np.ndarray, c: np.ndarray, links: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) of about the `ef` nearest to each row of q, nearest first, by best-first search
    of all rows side by side, from the entries on: in a step every row that is not at its end opens its nearest
    centroid not opened yet. Places that stay empty have an infinite distance. Where opening ef centroids would measure
    as many distances as there are centroids, all are measured: the nearest ef then."""
    n, ef = len(q), min(ef, len(c))
    if ef * DEGREE >= len(c):
        every = np.empty((n, len(c)))
        for i, one in enumerate(q):
            every[i] = np.sqrt(((c - one) ** 2).sum(1))
        by = np.argsort(every, axis=1, kind="stable")[:, :ef]
        return by, np.take_along_axis(every, by, 1)
    ids = np.repeat(entry[None], n, 0)
    dist = np.sqrt(((c[entry][None] - q[:, None]) ** 2).sum(2))
    opened, seen = np.zeros(ids.shape, bool), np.zeros((n, len(c)), bool)
    seen[:, entry] = True
    rows = np.arange(n)
    while len(rows):
        left = np.where(opened[rows], np.inf, dist[rows])
        at = left.argmin(1)
        best = left[np.arange(len(rows)), at]
        full = np.isfinite(dist[rows]).sum(1) >= ef
        going = np.isfinite(best) & ~(full & (best > np.partition(dist[rows], min(ef, dist.shape[1]) - 1, axis=1)[:, min(ef, dist.shape[1]) - 1]))
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        opened[rows, at] = True
        near = links[ids[rows, at]]
        known = np.take_along_axis(seen[rows], near, 1)
        known[:, 1:] |= near[:, 1:] == near[:, :-1]  # a centroid stands behind its last neighbour, more than once
        seen[rows[:, None], near] = True
        far = np.where(known, np.inf, np.sqrt(((c[near] - q[rows, None]) ** 2).sum(2)))
        # the ef nearest of what was held and what is new
        if dist.shape[1] < ef:
            grow = ef - dist.shape[1]
            dist, ids, opened = np.c_[dist, np.full((n, grow), np.inf)], np.c_[ids, np.zeros((n, grow), int)], np.c_[opened, np.zeros((n, grow), bool)]
        d, i, o = np.c_[dist[rows], far], np.c_[ids[rows], near], np.c_[opened[rows], np.zeros(far.shape, bool)]
        keep = np.argsort(d, axis=1, kind="stable")[:, : dist.shape[1]]
        dist[rows], ids[rows], opened[rows] = (np.take_along_axis(x, keep, 1) for x in (d, i, o))
    by = np.lexsort((ids, dist), axis=1)[:, :ef]
    return np.take_along_axis(ids, by, 1), np.take_along_axis(dist, by, 1)


def _numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, dim)


def lists_of(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of all lists that each row of x is put in, for all rows at once."""
    d = np.sqrt(((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).clip(0))
    k = min(COPIES * 2, len(c))
    order = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(d, order, 1)
    by = np.argsort(near, axis=1, kind="stable")
    order, near = np.take_along_axis(order, by, 1), np.take_along_axis(near, by, 1)
    points = c[order]
    apart = ((points[:, :, None] - points[:, None]) ** 2).sum(3)  # between the candidate centroids of each row
    taken = np.zeros(order.shape, bool)
    taken[:, 0] = True
    for j in range(1, k):
        inside = (near[:, j] <= (1 + REPLICATE) * near[:, 0]) & (taken.sum(1) < COPIES)
        taken[:, j] = inside & (~taken | (apart[:, j] > near[:, j, None] ** 2)).all(1)
    row, at = np.nonzero(taken)
    return row.astype(np.int64), order[row, at].astype(np.int32)


def calibrate(x: np.ndarray, c: np.ndarray, links: np.ndarray, entry: np.ndarray, k: int, need: int) -> tuple[float, int]:
    """(prune, ef) with which RECALL of the k nearest among x of some rows of x lie in the lists that probes_of,
    the very search of the queries, gives. The ratio is first taken from the centroids' exact order; then ef,
    and where ef is all centroids the ratio, goes up until the recall is measured to hold."""
    x = x[:TUNE]
    parts = [lists_of(x[a : a + 1024], c) for a in range(0, len(x), 1024)]
    row = np.concatenate([r + 1024 * i for i, (r, _) in enumerate(parts)])
    lists = np.concatenate([v for _, v in parts])
    sizes = np.bincount(lists, minlength=len(c))
    asked = np.unique(np.linspace(0, len(x) - 1, min(ASKED, len(x))).astype(int))
    if len(x) < 2:
        return 0.0, len(c)
    nears, wanted, within = [], [], []
    for i in asked:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d)) - 1)[:k]
        nears.append(near[near != i])
        to = np.sqrt(((c - x[i]) ** 2).sum(1))
        ratio = to / max(to.min(), 1e-12) - 1
        best = np.full(len(x), np.inf)
        np.minimum.at(best, row, ratio[lists])
        wanted.append(best[nears[-1]])
        within.append(ratio)
    prune = float(np.quantile(np.concatenate(wanted), RECALL))
    ef = min(len(c), int(np.quantile([(r <= prune).sum() for r in within], 0.95) * 1.1) + 8)
    order = np.argsort(row, kind="stable")
    starts = np.searchsorted(row[order], np.arange(len(x) + 1))
    while True:
        who, which = probes_of(x[asked], c, links, entry, sizes, prune, ef, need)
        probed = np.zeros((len(asked), len(c)), bool)
        probed[who, which] = True
        found = [probed[q, lists[order[starts[v] : starts[v + 1]]]].any() for q, near in enumerate(nears) for v in near]
        if np.mean(found) >= RECALL or (ef == len(c) and prune > 1e6):
            return prune, ef
        if ef < len(c):
            ef = min(2 * ef, len(c))
        else:
            prune = 1.25 * prune + 0.01


def _assign(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    c = shared.value[0]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = pa.Table.from_batches([batch.slice(at, 256)])
            row, lists = lists_of(_numbers(part.column("embedding"), c.shape[1]), c)
            part = part.take(pa.array(row))
            yield from part.append_column("list", pa.array(lists)).combine_chunks().to_batches()


def probes_of(x: np.ndarray, c: np.ndarray, links: np.ndarray, entry: np.ndarray, sizes: np.ndarray, prune: float, ef: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each row of x asks for."""
    near, d = walk(x, c, links, entry, ef)
    rows, lists = [], []
    held = np.cumsum(np.where(np.isfinite(d), sizes[near], 0), axis=1)
    enough = held[:, -1] >= need
    asked = np.isfinite(d) & ((d <= (1 + prune) * d[:, :1] + 1e-12) | (np.c_[np.zeros(len(x), int), held[:, :-1]] < need))
    row, at = np.nonzero(asked & enough[:, None])
    rows.append(row)
    lists.append(near[row, at])
    for i in np.flatnonzero(~enough):  # few vectors a list: all centroids in order
        to = np.sqrt(((c - x[i]) ** 2).sum(1))
        order = np.argsort(to, kind="stable")
        before = np.r_[0, np.cumsum(sizes[order])[:-1]]
        some = order[(to[order] <= (1 + prune) * to[order[0]] + 1e-12) | (before < need)]
        rows.append(np.full(len(some), i))
        lists.append(some)
    return np.concatenate(rows).astype(np.int64), np.concatenate(lists).astype(np.int32)


def bundles_of(sizes: np.ndarray) -> np.ndarray:
    """The bundle of each list: lists in order, which is that of the centroids' tree, up to a 64th of the vectors a bundle;
    a longer list is one by itself."""
    most = min(max(BUNDLE, int(sizes.sum()) // 64), BUNDLE_MOST)
    out, bundle, held = np.zeros(len(sizes), np.int32), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            bundle, held = bundle + 1, 0
        out[i] = bundle
        held += n
    return out


def _probe(shared, need: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(vec_id, bundle, lists): the lists of each bundle that a query asks for."""
    c, links, entry, sizes, bundles, prune, ef = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = pa.Table.from_batches([batch.slice(at, 256)])
            row, lists = probes_of(_numbers(part.column("embedding"), c.shape[1]), c, links, entry, sizes, prune, ef, need)
            order = np.lexsort((lists, row))  # bundles are in the order of lists
            row, lists = row[order], lists[order]
            of = bundles[lists]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])][: len(row)])
            grouped = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(lists))
            cols = [part.column("vec_id").combine_chunks().take(pa.array(row[starts])), pa.array(of[starts]), grouped]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "bundle", "lists"])


def _nearest(k: int, vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """The k nearest of each query within the lists that it asks for, exact distances, ties to smaller ids; an id that
    stands more than once counts once, at its nearest.

    A query's bound is its k-th distance so far. Squares of distances come of matrix products; those that exceed the
    bound's by more than the rounding of both cannot be among the k nearest, the others are measured exactly."""
    who, ids, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if vectors.num_rows and queries.num_rows:
        by = np.argsort(vectors.column("list").to_numpy(), kind="stable")
        lists, v_ids, q_ids = vectors.column("list").to_numpy()[by], vectors.column("vec_id").to_numpy()[by], queries.column("vec_id").to_numpy()
        dim = len(vectors.column("embedding").combine_chunks().flatten()) // vectors.num_rows  # of one length
        x, q = _numbers(vectors.column("embedding"), dim)[by], _numbers(queries.column("embedding"), dim)
        xx, qq = (x * x).sum(1), (q * q).sum(1)
        slack = 4 * (dim + 8) * np.finfo(float).eps * (qq + xx.max())
        asked = queries.column("lists").combine_chunks()
        asks, of = np.repeat(np.arange(len(q)), pc.list_value_length(asked).to_numpy(zero_copy_only=False)), asked.flatten().to_numpy()
        order = np.argsort(of, kind="stable")
        asks, of = asks[order], of[order]
        repeats = len(np.unique(v_ids)) < len(v_ids)
        bound = np.full(len(q), np.inf)
        new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            nonlocal who, ids, far
            who, ids, far = (np.concatenate(v) for v in zip((who, ids, far), *new, strict=True))
            new.clear()
            if repeats:
                order = np.lexsort((far, ids, who))
                who, ids, far = who[order], ids[order], far[order]
                first = np.r_[True, (who[1:] != who[:-1]) | (ids[1:] != ids[:-1])][: len(who)]
                who, ids, far = who[first], ids[first], far[first]
            order = np.lexsort((ids, far, who))
            who, ids, far = who[order], ids[order], far[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            bound[who[place == k - 1]] = far[place == k - 1]
            who, ids, far = who[place < k], ids[place < k], far[place < k]

        edges = np.r_[np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]]), len(lists)].tolist()
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            own = asks[np.searchsorted(of, lists[start]) : np.searchsorted(of, lists[start], side="right")]
            for lo in range(start, end if len(own) else start, PIECE):
                some = slice(lo, min(lo + PIECE, end))
                points, apart = x[some], len(np.unique(v_ids[some])) == some.stop - lo
                step = max(1, AT_ONCE // len(points))
                for at in range(0, len(own), step):
                    rows = own[at : at + step]
                    d = q[rows] @ points.T
                    d *= -2
                    d += xx[some]
                    d += qq[rows, None]
                    limit = bound[rows] ** 2
                    open_ = np.flatnonzero(np.isinf(limit))
                    if len(open_) and apart and len(points) > k:  # k others at least, whichever is the query itself
                        limit[open_] = np.partition(d[open_], k, axis=1)[:, k]
                    i, j = np.nonzero(~(d > (limit + 2 * slack[rows])[:, None]))
                    for a in range(0, len(i), 1 << 15):
                        r, p = rows[i[a : a + (1 << 15)]], j[a : a + (1 << 15)]
                        exact = np.sqrt(((points[p] - q[r]) ** 2).sum(1))
                        fine = np.isfinite(exact) & (v_ids[lo + p] != q_ids[r])
                        new.append((r[fine], v_ids[lo + p[fine]], exact[fine]))
                    if sum(len(v[0]) for v in new) > max(2 * k * len(q), 1 << 14):
                        settle()
        settle()
        who = q_ids[who]
    return pa.table({"query_id": pa.array(who, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(far, pa.float64())})


def _ask(posted: DataFrame, probes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest in the lists that probes(vec_id, bundle, lists) name."""
    per = posted.groupBy("bundle").agg(F.count("*").alias("vectors"))
    per = per.join(probes.groupBy("bundle").agg(F.ceil(F.count("*") / QBLOCK).cast("int").alias("qblocks")), "bundle")
    most = F.greatest(F.lit(BUNDLE), F.least(F.sum("vectors").over(Window.partitionBy()) / 64, F.lit(BUNDLE_MOST)))  # as in bundles_of
    per = materialize(per.select("bundle", F.ceil(F.col("vectors") / most).cast("int").alias("blocks"), "qblocks"), "blocks")
    per = F.broadcast(per)  # at most a row a centroid, and one a length of vectors
    each = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    left = posted.join(per, "bundle").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("blocks")).cast("int")).withColumn("qblock", each("qblocks"))
    right = probes.join(per, "bundle").withColumn("qblock", F.pmod(F.xxhash64("vec_id"), F.col("qblocks")).cast("int")).withColumn("block", each("blocks"))
    keys = ["bundle", "block", "qblock"]
    left = left.select(*keys, "list", "vec_id", "embedding")
    right = right.select(*keys, "vec_id", "lists").join(asked, "vec_id")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(_nearest, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of vectors(vec_id, embedding) for each row of
    queries(vec_id, embedding), without a vector of the query's own id; ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part. A vector's candidates
    are those of its own length; lengths other than the most frequent one are searched in whole. Rows that
    repeat a vec_id count once, at the nearest of them; of queries that do so the one that comes first
    by its components is asked. A query whose lists hold fewer than k candidates is asked again of all
    lists, so k rows come wherever k candidates exist. No valid vector: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & valid()).select(F.col("vec_id").cast("long"), "embedding")
    dims = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, n = dims[0]["dim"], dims[0]["n"]
    usual, other = F.size("embedding") == dim, (-F.size("embedding")).alias("list")  # another length is a list of its own
    asked = queries.where(F.col("vec_id").isNotNull() & valid()).select(F.col("vec_id").cast("long"), "embedding")
    asked = materialize(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    main = rows.where(usual)
    sample = main if n <= SAMPLE else main.where(F.xxhash64("vec_id", F.lit("sample")).cast("double") / 2.0**64 + 0.5 <= SAMPLE / n)
    points = sample.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()  # at most SAMPLE vectors
    points = _numbers(points.column("embedding"), dim)
    c = centroids(points, max(LIST * len(points) // max(n, 1), 1) if n <= LIST * MOST_LISTS else max(len(points) // MOST_LISTS, 1))
    context = spark.sparkContext
    kind = rows.schema["embedding"].dataType.simpleString()
    posted = main.mapInArrow(partial(_assign, context.broadcast((c,))), f"vec_id long, embedding {kind}, list int")
    posted = materialize(posted.unionByName(rows.where(~usual).select("vec_id", "embedding", other)), "postings")
    sizes = np.zeros(len(c), np.int64)
    for r in posted.where("list >= 0").groupBy("list").agg(F.count("*").alias("n")).collect():  # as many as centroids
        sizes[r["list"]] = r["n"]
    bundles = bundles_of(sizes)
    named = spark.createDataFrame(pa.table({"list": pa.array(np.arange(len(c), dtype=np.int32)), "bundle": pa.array(bundles)}))
    posted = posted.join(F.broadcast(named), "list", "left").withColumn("bundle", F.coalesce("bundle", "list"))  # another length: a bundle of its own
    spread = asked.where(usual).repartition(max(1, spark.sparkContext.defaultParallelism), "vec_id")
    links, entry = graph(c)
    tuned = calibrate(points, c, links, entry, k, (k + 1) * COPIES)
    probes = spread.mapInArrow(partial(_probe, context.broadcast((c, links, entry, sizes, bundles, *tuned)), (k + 1) * COPIES), "vec_id long, bundle int, lists array<int>")
    probes = materialize(probes.unionByName(asked.where(~usual).select("vec_id", other.alias("bundle"), F.array(other).alias("lists"))), "probes")
    best = materialize(_ask(posted, probes, asked, k), "nearest")
    short = asked.where(usual).join(best.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left").where(F.coalesce("count", F.lit(0)) < k)
    short = materialize(short.select("vec_id", "embedding"), "short")
    if short.isEmpty():
        return best
    # too few candidates, as where many rows repeat one vec_id: the lists that are not asked yet may hold more
    every = short.select("vec_id").crossJoin(F.broadcast(named.groupBy("bundle").agg(F.collect_list("list").alias("lists"))))
    again = _ask(posted.where("list >= 0"), materialize(every, "all-lists"), short, k)
    rest = best.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return rest.select("query_id", "rank", "vec_id", "score").unionByName(again)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))
