"""Source divergence audit: how far the sources of a language differ in their terms.

Kept terms, those in at least SUPPORT documents of a language, are found by iceberg prefix refinement. Terms, closed by a
byte 0, are cut to prefixes of FIRST, 2 FIRST, 4 FIRST ... bytes. A level counts the distinct documents of every prefix and
discards those below SUPPORT; the next one extends what is left, until only whole terms are. As a term
has no more documents than its prefixes, nothing is lost, and rare terms are never counted by themselves.

Texts are read once. The pass adds up, a task, occurrences by source and documents by language. So that
documents of a prefix can be added up too, a document counts for a term from that level on at which the term's prefix
is new in it: its distinct terms are sorted, and a prefix that the term before shares is counted there already.

Pairs of sources are compared in tiles: TILE sources against TILE sources over some BUCKET terms, dense in a task.
Terms that neither side has give every pair the same value, so they are counted and not made.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, materialize, table
from .textops import release, slices

SUPPORT = 10
TOP = 10
#: Sources on either side of a tile, and terms of one, about.
TILE, BUCKET = 32, 8192
#: Bytes of the prefixes of the first level.
FIRST = 4
#: Terms that a task holds before it passes on what it has counted.
HELD = 1_200_000
#: Kept terms and their bytes up to which they are broadcast.
KEPT_ROWS, KEPT_BYTES = 1_000_000, 48 << 20
STRETCH = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term: letters, only A-Z lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _terms(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        to = at + STRETCH
        while to < len(data) and _TABLE[data[to]] != 32:
            to += 1
        yield data[at:to].translate(_TABLE).split()
        at = to


def levels(terms: list[bytes]) -> np.ndarray:
    """For each of some documents' sorted distinct terms (one after the other): the number of levels at which its
    prefix is that of the term before it too."""
    out = np.zeros(len(terms), np.int64)
    if len(terms) < 2:
        return out
    head = np.array(terms, "S32").view(np.uint8).reshape(len(terms), 32)
    same = head[1:] == head[:-1]
    for k in range(4):
        out[1:] += same[:, : FIRST << k].all(1)
    for i in (np.flatnonzero(out == 4)).tolist():  # alike in 32 bytes and more
        a, b = terms[i - 1], terms[i]
        n = min(len(a), len(b))
        differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
        out[i] = ((int(differ[0]) if len(differ) else n) // FIRST).bit_length()
    return out


def _counted(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, level, term, n): occurrences of a source's terms (level null; of a source without terms one row whose
    term is null), and documents of a language's terms by the level from which on they count (source null). A row a
    term: readers take rows by the thousand, and rows of long arrays would be held whole."""
    names = ["lang", "source", "level", "term", "n"]
    used: dict[tuple[str, str], Counter] = {}
    new: dict[tuple[str, int], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in used.items():
            yield from cut(lang, source, None, own)
        for (lang, level), own in new.items():
            yield from cut(lang, None, level, own)
        used.clear()
        new.clear()

    def cut(lang: str, source: str | None, level: int | None, own: Counter) -> Iterator[pa.RecordBatch]:
        terms, counts = list(own) or [None], list(own.values()) or [0]
        for at in range(0, len(terms), 16_384):
            some = pa.array(terms[at : at + 16_384], pa.binary())
            same = [pa.array([v], kind).take(pa.array(np.zeros(len(some), np.int32))) for v, kind in ((lang, pa.string()), (source, pa.string()), (level, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*same, some, pa.array(counts[at : at + 16_384], pa.int64())], names=names)

    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "text"):
            seen: dict[str, list[list[bytes]]] = {}
            texts = part.column("text").cast(pa.large_binary())
            for text, lang, source in zip(texts, part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True):
                distinct: set[bytes] = set()
                count = used.setdefault((lang, source), Counter())
                for terms in _terms(text.as_py()):
                    count.update(terms)
                    distinct.update(terms)
                seen.setdefault(lang, []).append(sorted(distinct))
            for lang, lists in seen.items():
                terms = [t for own in lists for t in own]
                level = levels(terms)
                starts = np.cumsum([0, *map(len, lists)])[:-1]
                level[starts[starts < len(level)]] = 0  # the first term of a document
                which = np.array([*terms, None], object)[:-1]
                for k in np.unique(level).tolist():
                    new.setdefault((lang, k), Counter()).update(which[level == k].tolist())
            if sum(map(len, used.values())) + sum(map(len, new.values())) > most:
                yield from rows()
    yield from rows()
    release()


def kept_terms(documents: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(lang, term, docs) of the terms in at least `support` documents, from rows (lang, level, term, n): n documents
    that count for the term's prefixes from `level` on."""
    closed = documents.select("lang", "level", "n", F.concat("term", F.lit(b"\x00")).alias("closed"))
    kept, alive, k = None, closed, 0
    while True:
        size = FIRST << k
        prefix = F.substring("closed", 1, size).alias("prefix")
        counts = alive.where(F.col("level") <= k).groupBy("lang", prefix).agg(F.sum("n").alias("docs")).where(F.col("docs") >= support)
        counts = materialize(counts.withColumn("whole", F.substring("prefix", -1, 1) == F.lit(b"\x00")), f"prefixes-{size}")
        own = counts.where("whole").select("lang", F.substring("prefix", 1, F.octet_length("prefix") - 1).alias("term"), "docs")
        kept = own if kept is None else kept.unionByName(own)
        left = counts.where("not whole").select("lang", "prefix")
        if left.isEmpty():
            return materialize(kept, "kept-terms")
        # a prefix of twice the length is only of those that are left now, so earlier levels need not be asked again
        longer = closed.where(F.octet_length("closed") > size).withColumn("prefix", prefix)
        alive = longer.join(F.broadcast(left) if fits(left, KEPT_ROWS, KEPT_BYTES) else left, ["lang", "prefix"], "left_semi").drop("prefix")
        k += 1


def _share(count: str, total: str, size: str) -> Column:
    """p: 1 + floor(10^9 (count + 2) / (total + 2 size)), exact; in decimals only where a long would not hold it."""
    exact = f"CAST({count} + 2 AS DECIMAL(19, 0)) * CAST(1000000000 AS DECIMAL(10, 0)) div ({total} + 2 * {size})"
    return F.expr(f"1 + CASE WHEN {count} < 9000000000 THEN 1000000000 * ({count} + 2) div ({total} + 2 * {size}) ELSE {exact} END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


_PAIR = "lang string, source string, other string, value long, terms long"


def _tile(cells: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, other, value, terms): the summed gap of each pair of sources of a tile, names in order, over the
    terms that cells (term, source, p) hold, and the number of these terms. sides (source, side, zero): the
    tile's sources, side by side, and their p of terms that they do not have."""
    left, right = sides[sides.side == 0], sides[sides.side == 1]
    one = len(sides) and sides.a.iloc[0] == sides.b.iloc[0]
    if not len(left) or not len(right):
        return pd.DataFrame({c: np.zeros(0, object if c in ("lang", "source", "other") else np.int64) for c in ("lang", "source", "other", "value", "terms")})
    terms = cells.term.astype("category").cat.codes.to_numpy()
    n = int(terms.max()) + 1 if len(terms) else 0

    def dense(side: pd.DataFrame) -> np.ndarray:
        at = pd.Series(np.arange(len(side)), index=side.source.to_numpy()).reindex(cells.source.to_numpy()).to_numpy()
        own = ~np.isnan(at)
        out = np.repeat(side.zero.to_numpy(np.int64)[:, None], n, 1)
        out[at[own].astype(int), terms[own]] = cells.p.to_numpy(np.int64)[own]
        return out

    a, b = dense(left), dense(right)
    names, others = left.source.to_list(), right.source.to_list()
    met = []
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            if one and names[i] >= others[j]:
                continue  # a tile with itself has each pair twice
            d = p - q
            met.append((*sorted((names[i], others[j])), int((d * d // (p + q)).sum())))
    text = lambda values: np.array([*values, None], object)[:-1]
    return pd.DataFrame({"lang": text([sides.lang.iloc[0]] * len(met)), "source": text(x[0] for x in met), "other": text(x[1] for x in met), "value": np.array([x[2] for x in met], np.int64), "terms": np.full(len(met), n, np.int64)})


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of _tile for every pair of sources of a language: a row a pair and bucket of terms."""
    tile = lambda c: F.pmod(F.xxhash64(c), F.col("tiles")).cast("int")
    sized = groups.withColumn("tiles", F.ceil(F.col("sources") / TILE).cast("int")).withColumn("buckets", F.greatest(F.ceil(F.col("size") / BUCKET), F.lit(1)).cast("int"))
    sized = sized.withColumn("own", tile("source"))
    # tiles (a, b) with a <= b that a source's tile takes part in
    both = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("own", t).alias("a"), F.greatest("own", t).alias("b")))
    sides = F.when(F.col("t.a") == F.col("t.b"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("own") == F.col("t.a"), 0).otherwise(1)))
    right = sized.withColumn("t", F.explode(both)).withColumn("side", F.explode(sides)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    right = right.select("lang", "bucket", "t.a", "t.b", "source", "side", "zero")
    left = cells.join(sized.select("lang", "source", "tiles", "buckets", "own"), ["lang", "source"]).withColumn("t", F.explode(both))
    left = left.select("lang", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "t.a", "t.b", "term", "source", "p")
    keys = ["lang", "bucket", "a", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tile, _PAIR)


def divergence(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every occurring (lang, source): part `pair` for each other source of the
    language, part `term` for the `top` kept terms that the source has more of than its language.

    Null text, lang and source are the empty string; a text without terms is a document all the same; long texts
    are read whole (memory follows a text's distinct terms); rows that repeat are documents each; ties go to the item
    first in UTF-8. A language without kept terms has pairs of value 0; one with one source has none. An
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = materialize(rows.mapInArrow(partial(_counted, HELD), "lang string, source string, level int, term binary, n long"), "counted")
    flat = counted.where("term is not null")
    kept = kept_terms(flat.where("level is not null").select("lang", "level", "term", "n"), support)
    names, used = kept.select("lang", "term"), flat.where("level is null")
    few = fits(names, KEPT_ROWS, KEPT_BYTES)  # then rare terms are not shuffled; else occurrences are added up first, so that no term is hot
    # a task has a term of a source once or twice, so sums before the shuffle would hold nearly all rows to spare few
    used = used.join(F.broadcast(names), ["lang", "term"], "left_semi").repartition("lang", "source", "term") if few else used
    cells = used.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    cells = cells if few else cells.join(names, ["lang", "term"])
    cells = materialize(cells.select("lang", "source", "term", "n"), "cells")
    # sizes of groups and languages
    groups = counted.where("level is null").select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(kept.groupBy("lang").agg(F.count("*").alias("size")), "lang", "left").na.fill(0, ["total", "size"])
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.count("*").alias("sources"))
    zero = F.when(F.col("size") > 0, F.expr("1 + 2000000000 div greatest(total + 2 * size, 1)")).otherwise(F.lit(0)).alias("zero")
    groups = materialize(groups.join(langs, "lang").select("lang", "source", "total", "size", "all", "sources", zero), "group-sizes")
    shares = cells.join(groups.select("lang", "source", "total", "size", "all"), ["lang", "source"]).withColumn("p", _share("n", "total", "size"))
    shares = materialize(shares.withColumn("n_all", F.sum("n").over(Window.partitionBy("lang", "term"))).select("lang", "source", "term", "p", _share("n_all", "`all`", "size").alias("q")), "shares")

    met = _pairs(shares.select("lang", "source", "term", "p"), groups).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    one = groups.select("lang", "source", "zero", "size")
    two = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero2"))
    pairs = one.join(two, "lang").where(F.col("source") < F.col("other")).join(met, ["lang", "source", "other"], "left")
    rest = F.when(F.col("size") > 0, (F.col("size") - F.coalesce("terms", F.lit(0))) * F.expr("(zero - zero2) * (zero - zero2) div greatest(zero + zero2, 1)")).otherwise(F.lit(0))
    pairs = pairs.select("lang", "source", "other", (F.coalesce("value", F.lit(0)) + rest).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", "x.item", "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), _gap("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {SUPPORT}),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, source),
g AS (SELECT lang, source, coalesce(n, 0)::HUGEINT AS total, v FROM groups JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v) AS p
  FROM g JOIN kept USING (lang) LEFT JOIN cells AS c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * v) AS q FROM cells JOIN sizes USING (lang) GROUP BY lang, term, v),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_ AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term' AS part, * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM both_
QUALIFY part = 'pair' OR rank <= {TOP}
"""
