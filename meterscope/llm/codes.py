"""Vector codes: every part of a vector as the index of the nearest entry of its codebook.

Vectors become integers (floor(SCALE * x)) and are cut into PARTS equal parts. A codebook of at most ENTRIES
entries a part is begun with the first vectors and moved to the means of what it is nearest to, ROUNDS times.

The nearest entry is found by equal-average search. For parts of dimension d, (sum(x) - sum(y))^2 / d is at most
the squared distance of x and y. Entries are sorted by their sums; from a part's own sum the search goes
outward, the smaller gap first, until the squared gap over d strictly exceeds the best distance: an entry that
far can neither beat nor tie it. All parts of a block search side by side.

All arithmetic is on integers, so that means do not depend on how rows are dealt. Codebooks (ENTRIES vectors)
pass through the driver; sums are added up a task before they are shuffled; no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialize, table
from .textops import release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are searched side by side.
BLOCK = 2048


def usable(v: str) -> Column:
    """Not null, no null or non-finite component."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A row a vector: floor(SCALE * x), zeros behind the shorter ones up to `width`, held within the bound below
    which no distance and no squared gap leaves 64 bits."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    bound = isqrt((1 << 60) // max(width, (width // PARTS) ** 2))
    out[np.arange(width) < lengths[:, None]] = np.clip(np.floor(SCALE * flat), -bound, bound).astype(np.int64)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of x, ties to the lower index."""
    n, d = x.shape
    sums = entries.sum(1)
    order = np.argsort(sums, kind="stable")
    by, sums, k = entries[order], sums[order], len(entries)
    own = x.sum(1)
    above = np.searchsorted(sums, own)
    below = above - 1
    best, index = np.full(n, -1, np.int64), np.full(n, k, np.int64)
    rows = np.arange(n)
    while len(rows):
        lo, hi = below[rows], above[rows]
        gap_lo, gap_hi = own[rows] - sums[lo.clip(0)], sums[hi.clip(None, k - 1)] - own[rows]
        down = (lo >= 0) & ((hi >= k) | (gap_lo <= gap_hi))
        gap = np.where(down, gap_lo, gap_hi)
        going = ((lo >= 0) | (hi < k)) & ((best[rows] < 0) | (gap * gap <= d * best[rows]))
        rows, down = rows[going], down[going]
        at = np.where(down, below[rows], above[rows])
        found, which = ((x[rows] - by[at]) ** 2).sum(1), order[at]
        better = (best[rows] < 0) | (found < best[rows]) | ((found == best[rows]) & (which < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], which[better]
        below[rows] -= down
        above[rows] += ~down
    return index, best


def _blocks(batches: Iterator[pa.RecordBatch], vector: str, width: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = pa.Table.from_batches([batch.slice(at, BLOCK)])
            yield part, integers(part.column(vector), width)
    release()


def _sums(books, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """(part, entry, place, total, n): a task's sums of the parts nearest to each entry."""
    entries = books.value  # part, entry, place
    total, count = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
    d = entries.shape[2]
    for _, x in _blocks(batches, "__vector", PARTS * d):
        for p in range(PARTS):
            own = x[:, p * d : (p + 1) * d]
            index, _ = nearest(own, entries[p])
            np.add.at(total[p], index, own)
            count[p] += np.bincount(index, minlength=entries.shape[1])
    part, entry = np.nonzero(count)
    for at in range(0, len(part), 4096):
        p, e = part[at : at + 4096], entry[at : at + 4096]
        cols = [np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p)), total[p, e].reshape(-1), np.repeat(count[p, e], d)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "entry", "place", "total", "n"])


def _codes(books, kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    entries = books.value
    d = entries.shape[2]
    for part, x in _blocks(batches, "__vector", PARTS * d):
        code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
        for p in range(PARTS):
            index, far = nearest(x[:, p * d : (p + 1) * d], entries[p])
            code[:, p] = index
            error += far
        cols = [*(part.column(c) for c in kept), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)]
        yield from pa.table(cols, names=[*kept, "code", "error"]).combine_chunks().to_batches()


def codebooks(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id") -> np.ndarray | None:
    """The entries (part, entry, place) for all rows of vectors; None where no row can be coded. As many passes
    as ROUNDS over the vectors, and one for their greatest length."""
    rows = vectors.where(usable(vector)).select(F.col(order).alias("__order"), F.col(vector).alias("__vector"))
    longest = rows.agg(F.max(F.size("__vector"))).first()[0]
    if longest is None:
        return None
    width = PARTS * max(-(-longest // PARTS), 1)
    first = rows.orderBy(F.asc_nulls_last("__order"), "__vector").limit(ENTRIES).toArrow()
    x = integers(first.column("__vector"), width)
    entries = np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))
    context = vectors.sparkSession.sparkContext
    for _ in range(ROUNDS):
        sums = rows.select("__vector").mapInArrow(partial(_sums, context.broadcast(entries)), "part long, entry long, place long, total long, n long")
        moved = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # at most a row a number of the codebooks
        p, e, at, total, n = (moved.column(c).to_numpy() for c in ("part", "entry", "place", "total", "n"))
        entries = entries.copy()
        entries[p, e, at] = total // n
    return entries


def checksum(entries: np.ndarray) -> str:
    """Lowercase hex of the entries' decimal numbers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, entries.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, entries: np.ndarray, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """`keep`, code (two hex digits a part) and error (squared distance of a vector's integers to its entries) for
    every row of vectors that can be coded."""
    named = [f"__keep{i}" for i in range(len(keep))]
    rows = vectors.where(usable(vector)).select(*[F.col(c).alias(n) for c, n in zip(keep, named, strict=True)], F.col(vector).alias("__vector"))
    kinds = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in named)
    shared = vectors.sparkSession.sparkContext.broadcast(entries)
    return rows.mapInArrow(partial(_codes, shared, named), f"{kinds}, code string, error long").toDF(*keep, "code", "error")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors(vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite components are left out. Fewer rows than ENTRIES make
    smaller codebooks. Rows that repeat are coded each; among equal vec_ids the least vector comes first, null
    vec_ids come last and stay. Vectors of several lengths count as followed by zeros up to the longest, that up to
    a multiple of PARTS. Components beyond what 64 bits can square (some 10^8 at 64 components) count as that bound.
    label_error is null where it is beyond a long. Ties go to the lower index. No valid vector: no rows. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    entries = codebooks(vectors)
    if entries is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    labelled = vectors.withColumn("__label", F.when(F.col("label").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    coded = materialize(encode(labelled, entries, keep=("vec_id", "__label")), "codes")
    sums = materialize(coded.groupBy("__label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    return join_checked(coded, sums, "__label").select("vec_id", "code", "error", "label_error", F.lit(checksum(entries)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    far = "list_sum(list_transform(range(1, len(x.c) + 1), lambda i: (x.c[i] - b.c[i]) * (x.c[i] - b.c[i])))::BIGINT"
    out = f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x)::BIGINT) AS c, len(embedding) // {PARTS} AS d
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
x AS (SELECT row, p, c[p * d + 1:(p + 1) * d] AS c FROM (SELECT *, unnest(range({PARTS})) AS p FROM v)),
first AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e FROM v QUALIFY e < {ENTRIES}),
b0 AS (SELECT p, e, c FROM x JOIN first USING (row)),"""
    for k in range(ROUNDS):
        out += f"""
a{k} AS (SELECT x.row, x.p, arg_min(b.e, ({far}, b.e)) AS e FROM x JOIN b{k} AS b USING (p) GROUP BY x.row, x.p),
s{k} AS (
  SELECT p, e, place, sum(n)::HUGEINT AS s, count(*)::HUGEINT AS m
  FROM (SELECT x.p, a.e, unnest(x.c) AS n, unnest(range(len(x.c))) AS place FROM x JOIN a{k} AS a USING (row, p))
  GROUP BY p, e, place
),
m{k} AS (SELECT p, e, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY place) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} AS b LEFT JOIN m{k} AS m USING (p, e)),"""
    return (
        out
        + f"""
z AS (SELECT x.row, x.p, arg_min(b.e, ({far}, b.e)) AS e, min({far}) AS err FROM x JOIN b{ROUNDS} AS b USING (p) GROUP BY x.row, x.p),
r AS (SELECT row, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM z GROUP BY row),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.h AS codebooks_sha256
FROM v JOIN r USING (row) CROSS JOIN h
"""
    )


OP11_SQL = _sql()
