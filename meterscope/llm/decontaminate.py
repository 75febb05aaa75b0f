"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark texts.

A word is a run of WORD after lower-casing A-Z. A window is WINDOW consecutive words of a benchmark text, or
all words of a shorter one. Windows go into one automaton as " word word ... word "; a document, normalised alike,
is run through it once, and every place where a window ends is a hit on the window's words. Hits are
given as word numbers and, mapped back, as places in the original text.

Texts are worked on as UTF-8 bytes (all separators are ASCII) in stretches of about STRETCH bytes, between which the
automaton keeps its state, so memory does not follow the length of a text. The windows' table is made by DataFrame
functions. Its size is counted: each SHARD bytes of it are an automaton, usually one; if there are more, a
batch of texts is run through one after the other, and a worker holds one at a time. No text is shuffled.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, own_names, table
from .textops import release

#: A word after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHARD = 4 << 20
STRETCH = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, every byte that is in no word to a blank.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def windows(benchmark: DataFrame, item: str = "item_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(window, items, n, size): every distinct window, the items that have it (as strings, sorted), its number of words
    and the bytes that it takes. Each of `fields` (a question, an answer) is a text of its own."""
    name = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    words = lambda c: F.regexp_extract_all(F.translate(F.coalesce(F.col(c), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    rows = benchmark.select(name, F.explode(F.array(*[words(c) for c in fields])).alias("words"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("w"))
    rows = rows.groupBy(F.array_join("w", " ").alias("window")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.first(F.size("w")).alias("n"))
    return rows.withColumn("size", F.octet_length("window") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)))


class Automaton:
    """The automaton of some windows: rows (window, items, n)."""

    def __init__(self, rows: list[tuple[str, list[str], int]]) -> None:
        self.items = [r[1] for r in rows]
        self.lengths = [r[2] for r in rows]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, (window, _, _) in enumerate(rows):
            self.trie.add_word(f" {window} ".encode().decode("latin-1"), i)  # a character a byte
        if rows:
            self.trie.make_automaton()

    def run(self, data: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(number of words, (first, last) word of every hit by last, numbers of the windows hit)."""
        n_words, hits, found = 0, [], set()
        search, blanks = None, 0
        for part in stretches(data):
            words = part.translate(_TABLE).split()
            if not words:
                continue
            n_words += len(words)
            if not self.items:
                continue
            text = (b" ".join(words) + b" ").decode("latin-1")
            if search is None:
                text = " " + text
                search, begun = self.trie.iter(text), 0
            else:
                begun = done
                search.set(text, False)  # the state goes on
            at = 0
            for end, i in search:
                end += 1 - begun
                blanks += text.count(" ", at, end)
                at = end
                hits.append((blanks - 1 - self.lengths[i], blanks - 2))
                found.add(i)
            blanks += text.count(" ", at)
            done = begun + len(text)
        return n_words, hits, found


def stretches(data: bytes) -> Iterator[bytes]:
    """data in pieces of about STRETCH bytes, cut behind a byte that is in no word."""
    at = 0
    while at < len(data):
        to = at + STRETCH
        while to < len(data) and _TABLE[data[to]] != 32:
            to += 1
        yield data[at:to]
        at = to


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words that lie in a hit."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(hits):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def places(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of the original text, end exclusive, of runs of words."""
    starts, ends = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    firsts, lasts = [a for a, _ in runs], [b for _, b in runs]
    words = points = 0
    mark = np.frombuffer(_TABLE, np.uint8) != 32
    for part in stretches(data):
        b = np.frombuffer(part, np.uint8)
        edge = np.diff(mark[b].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lead = points + np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
        for wanted, at, out in ((firsts, begin, starts), (lasts, stop, ends)):
            i, j = bisect_left(wanted, words), bisect_left(wanted, words + len(begin))
            out[i:j] = lead[at[np.array(wanted[i:j], np.int64) - words]]
        words += len(begin)
        points = int(lead[-1])
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


_HIT = pa.struct([(c, pa.int64()) for c in ("first_word", "last_word", "start", "end")])
_HITS = "array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint>>"
_held: dict[str, Automaton] = {}


def _automaton(shard) -> Automaton:  # noqa: ANN001
    """The worker's automaton of a shard; one is held at a time."""
    key, rows = shard.value
    if key not in _held:
        _held.clear()
        _held[key] = Automaton(rows)
    return _held[key]


def _scan(shards: list, kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("__text")).cast(pa.large_binary())
        n_words, hits, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
        for shard in shards:
            automaton = _automaton(shard)
            for i, text in enumerate(texts):
                n_words[i], found, which = automaton.run(text.as_py() or b"")
                hits[i] += found
                for w in which:
                    items[i].update(automaton.items[w])
        rows = []
        for text, own in zip(texts, hits, strict=True):
            runs = merged(own)
            at = places(text.as_py(), runs) if runs else []
            rows.append([{"first_word": a, "last_word": b, "start": s, "end": e} for (a, b), (s, e) in zip(runs, at, strict=True)])
        cols = [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(n_words, pa.int64()), pa.array(rows, pa.list_(_HIT)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_words", "hits", "items"])
    release()


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", fields: tuple[str, ...] = ("text",), shard: int = SHARD) -> DataFrame:
    """`keep`, n_words, hits (runs of hit words: first_word, last_word, and start and end in code points of the text) and
    items (identifiers, as strings, of the items with a window in the text, sorted) for every row of docs.

    Null and empty texts have no words and no hits; long texts are run through whole; rows that repeat have the same.
    An item without words has no window; items that share a window are all named; rows of one identifier are one
    item, a null identifier is the empty string. Empty docs: no rows; empty benchmark: no hits. Other columns
    of either table are not read.
    """
    spark = docs.sparkSession
    table_ = materialize(windows(benchmark, item, fields), "windows")
    total = table_.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-total // shard))
    shards = []
    for k in range(n):  # at most about `shard` bytes pass through the driver at a time
        own = table_.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k) if n > 1 else table_
        shards.append(spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["window"], r["items"], r["n"]) for r in own.collect()])))
    named = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, named, strict=True)], F.coalesce("text", F.lit("")).alias("__text"))
    kinds = "".join(f"`{x}` {rows.schema[x].dataType.simpleString()}, " for x in named)
    found = rows.mapInArrow(partial(_scan, shards, named), f"{kinds}n_words long, hits {_HITS}, items array<string>")
    return found.toDF(*keep, "n_words", "hits", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.0) -> DataFrame:
    """The rows of docs of whose words at most the share `most` is hit; all columns stay."""

    def clean(d: DataFrame) -> DataFrame:
        found = contamination(d, benchmark, tuple(d.columns))
        return found.where(n_hit() <= most * F.col("n_words")).select(*d.columns)

    return own_names(docs, ("text",), clean)


def n_hit():  # noqa: ANN201
    """Words in a hit."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["last_word"] - x["first_word"] + 1)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w
  FROM documents
),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w
  FROM benchmark
),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN lengths
  WHERE i + n - 1 <= len(w)
),
hit AS (SELECT row, i, n, item FROM spot JOIN win USING (win, n)),
words AS (SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM hit) GROUP BY row),
items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
"""
