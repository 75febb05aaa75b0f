"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

1. One pass over the texts finds the spans of the fixed patterns and candidate strings that look like an
   identifier of some kind but match no fixed pattern (numbers without a plus, card numbers of other
   checksums, spelled-out addresses, other dotted numbers). Each comes with lexical contexts: the word
   before, the two words before, the word after, and the words on both sides.
2. Seeds are the strings of fixed spans. Contexts and strings form a bipartite graph, which Spark scores
   in rounds. A pattern is a context and a kind; its confidence is the share of known strings of that kind
   among the strings in that context, where known strings of another kind count in full and unknown ones of
   a shape that the kind allows count UNKNOWN. Patterns with at least SUPPORT distinct known
   strings and a confidence of CONFIDENT make the unknown strings in them known; those count in the next
   round, so they bring in patterns that no seed supports. It ends when a round finds no string.
3. Every occurrence of a string so found is added to the spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_checked, materialize, own_names, settled, table
from .textops import slices

KINDS = ("email", "ip", "card", "phone")
#: What an unknown string counts against a pattern, compared with a known one of another kind.
UNKNOWN = 0.2
SUPPORT = 3
CONFIDENT = 0.8

# Each finds the leftmost non-overlapping matches of the plain pattern in linear time: where a start in
# the middle of a run could only match if the run's start does, the run is taken at once.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")

#: Candidates: spelled-out addresses, and runs of digits with signs between them. Runs are taken at once.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]? ?at ?[)\]]? ?[A-Za-z0-9-]++ ?[(\[]? ?dot ?[)\]]? ?[A-Za-z]{2,}+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![A-Za-z0-9])")
_PART = re.compile("[^ ]+")
_WORD = re.compile(r"[^ \t-\r]+")
#: Longer words stand in contexts by a digest of the whole word.
WORD_LENGTH = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        floor = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                floor = m.end()
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def shapes(text: str) -> list[int]:
    """Kinds that a candidate's shape allows."""
    digits = _DIGITS.sub("", text)
    if any(c.isalpha() for c in text):
        return [0]
    return [k for k, ok in ((1, text.count(".") == 3 and len(digits) >= 4), (2, 12 <= len(digits) <= 19), (3, 9 <= len(digits) <= 15)) if ok]


def numbers(text: str) -> list[tuple[int, int]]:
    """Spans of numbers that some kind's shape allows. A run with blanks in it is one number if no part between
    blanks is one by itself; a run that fits no kind is cut into the shortest joined parts that do."""
    out = []
    for m in _NUMBER.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m[0])]
        alone = [(a, b) for a, b in parts if shapes(text[a:b])] if len(parts) > 1 else []
        if alone:
            out += alone
        elif shapes(m[0]):
            out.append(m.span())
        else:
            i = 0
            while i < len(parts):
                for j in range(i + 1, len(parts)):
                    if shapes(text[parts[i][0] : parts[j][1]]):
                        out.append((parts[i][0], parts[j][1]))
                        i = j
                        break
                    if parts[j][1] - parts[i][0] > 60:  # more digits than any kind has
                        break
                i += 1
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of candidate strings that no fixed span overlaps."""
    found = numbers(text)
    if " at " in text or "(at)" in text or "[at]" in text:
        found += [m.span() for m in _SPELLED.finditer(text)]
    found.sort()
    out, i, last = [], 0, 0
    for a, b in found:
        while i < len(base) and base[i][2] <= a:
            i += 1
        if a >= last and (i == len(base) or base[i][0] >= b):
            out.append((a, b))
            last = b
    return out


class Contexts:
    """Lexical contexts of spans of one text, by its whole words: in lower case, runs of digits as 0."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts, self.ends = [], []
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def _norm(self, a: int, b: int) -> str:
        word = re.sub("[0-9]+", "0", self.text[a:b].lower())
        return word if len(word) <= WORD_LENGTH else hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def of(self, start: int, end: int) -> list[str]:
        i, j = bisect_left(self.starts, start), bisect_right(self.ends, end)
        left = [self._norm(self.starts[k], min(self.ends[k], start)) for k in range(max(0, i - 2), i)]
        right = [self._norm(max(self.starts[j], end), self.ends[j])] if j < len(self.ends) else []
        out = []
        if left:
            out.append(f"L {left[-1]}")
        if len(left) == 2:
            out.append(f"LL {left[0]} {left[1]}")
        if right:
            out.append(f"R {right[0]}")
        if left and right:
            out.append(f"LR {left[-1]} {right[0]}")
        return out


_SPAN = pa.struct([("start", pa.int64()), ("kind_no", pa.int32()), ("end", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind_no", pa.int32()), ("string", pa.string()), ("shapes", pa.list_(pa.int32())), ("contexts", pa.list_(pa.string()))])
_SCHEMA = "base array<struct<start:bigint,kind_no:int,end:bigint>>, seen array<struct<start:bigint,end:bigint,kind_no:int,string:string,shapes:array<int>,contexts:array<string>>>"


def scan(text: str) -> tuple[list[dict], list[dict]]:
    base = base_spans(text)
    seen = [(a, b, k) for a, k, b in base] + [(a, b, None) for a, b in candidates(text, base)]
    strings = lambda a, b: re.sub(r"[ ()-]", "", text[a:b].lower())
    if not seen:
        return [], []
    around = Contexts(text)
    return (
        [{"start": a, "kind_no": k, "end": b} for a, k, b in base],
        [{"start": a, "end": b, "kind_no": k, "string": strings(a, b), "shapes": shapes(text[a:b]) if k is None else [k], "contexts": around.of(a, b)} for a, b, k in seen],
    )


def _scan_rows(kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "__text"):
            both = [scan(t) for t in part.column("__text").to_pylist()]
            cols = [*(part.column(c) for c in kept), pa.array([b for b, _ in both], pa.list_(_SPAN)), pa.array([s for _, s in both], pa.list_(_SEEN))]
            yield from pa.table(cols, names=[*kept, "base", "seen"]).combine_chunks().to_batches()


def bootstrap(seen: DataFrame) -> DataFrame:
    """(string, kind_no) of the strings that confident patterns find, from rows (context, string, kind_no:
    of a seed, null: candidate, shapes). Occurrences of a string in a context are one edge, so a frequent
    one is a row; hot contexts and strings are joined as join_checked does."""
    edges = materialize(seen.groupBy("context", "string").agg(F.max("kind_no").alias("seed"), F.first("shapes").alias("shapes")), "edges")
    found = edges.select("string", F.lit(None).cast("int").alias("known")).limit(0)
    while True:
        marked = join_checked(edges, found, "string", "left").withColumn("known", F.coalesce("seed", "known"))
        marked = materialize(marked, "marked")
        count = lambda test: F.count(F.when(test, 1))
        kinds = range(len(KINDS))
        known = [count(F.col("known") == k).alias(f"k{k}") for k in kinds]
        open_ = [count(F.col("known").isNull() & F.array_contains("shapes", k)).alias(f"o{k}") for k in kinds]
        per = marked.groupBy("context").agg(*known, *open_)
        all_known = sum((F.col(f"k{k}") for k in kinds), F.lit(0))
        share = [F.when(F.col(f"k{k}") >= SUPPORT, F.col(f"k{k}") / (all_known + UNKNOWN * F.col(f"o{k}"))) for k in kinds]
        patterns = per.select("context", F.array(*[F.coalesce(x, F.lit(0.0)) for x in share]).alias("confidence")).where(F.array_max("confidence") >= CONFIDENT)
        met = join_checked(marked.where("known is null"), materialize(patterns, "patterns"), "context")
        met = met.select("string", F.explode("shapes").alias("known"), "confidence").select("string", "known", F.element_at("confidence", F.col("known") + 1).alias("c"))
        new = met.where(F.col("c") >= CONFIDENT).groupBy("string").agg(F.max_by("known", F.struct("c", -F.col("known"))).alias("known"))
        new = materialize(new, "found")
        if new.isEmpty():
            return found.withColumnRenamed("known", "kind_no")
        found = materialize(found.unionByName(new), "found-so-far")


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, base and spans (array<struct(start, kind_no, end)>, by start and kind) for every row of docs.

    Places are in code points, ends exclusive; kind_no counts KINDS. Null and empty texts have no spans; texts
    are read whole, however long; repeated rows have the same, and count once for the patterns. A found string
    that confident patterns of several kinds hold is of the most confident one, of ties the first of KINDS.
    Other columns are not read; an empty table gives no rows.
    """
    light = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).withColumn("__uid", F.monotonically_increasing_id())
    kept = [c for c in light.columns if c != "__text"]
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in light.schema if f.name != "__text")
    rows = materialize(light.mapInArrow(partial(_scan_rows, kept), f"{ids}, {_SCHEMA}"), "scanned")
    seen = rows.select("__uid", F.inline("seen"))
    found = settled(lambda: bootstrap(seen.select(F.explode("contexts").alias("context"), "string", "kind_no", "shapes")), "found-strings")
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    if found.isEmpty():
        return rows.select(*keep, "base", F.col("base").alias("spans"))
    open_ = seen.where("kind_no is null").select("__uid", "start", "end", "string")
    taken = join_checked(open_, found, "string")
    more = taken.groupBy("__uid").agg(F.collect_list(F.struct("start", "kind_no", "end")).alias("more"))
    return rows.drop("seen").join(more, "__uid", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", none)))).select(*keep, "base", "spans")


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    return found.select("doc_id", *[count(i) for i in range(4)], F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def mask(text: str, starts: list[int], ends: list[int], kinds: list[int]) -> str:
    """text with every span replaced by its kind; of overlapping spans, in order of their starts, by the first. The
    text is cut once, so time follows its length."""
    out, at = [], 0
    for start, end, kind in zip(starts, ends, kinds, strict=True):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _masked() -> Callable[..., Column]:
    @F.pandas_udf("string")
    def of(text: pd.Series, starts: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        rows = zip(text, starts, ends, kinds, strict=True)
        return pd.Series([None if k is None else mask(t, s.tolist(), e.tolist(), k.tolist()) for t, s, e, k in rows], dtype=object)

    return of


def _redact(docs: DataFrame) -> DataFrame:
    named = docs.columns
    found = personal_data(docs, tuple(named)).withColumn("spans", F.array_sort("spans"))
    some = F.size("spans") > 0
    own = [F.when(some, F.col("text")), *[F.when(some, F.col("spans")[c]) for c in ("start", "end", "kind_no")]]
    out = found.withColumn("__masked", _masked()(*own)).withColumn("text", F.when(some, F.col("__masked")).otherwise(F.col("text")))
    if "n_chars" in named:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*named)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in angle brackets (overlapping spans by the
    first), and n_chars, where there is such a column, counted anew. Null and empty texts stay; long texts with many
    spans are cut once; rows that repeat are masked alike; an empty table stays empty. All rows and columns stay."""
    return own_names(docs, ("doc_id", "text", "n_chars"), _redact)
