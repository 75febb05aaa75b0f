"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Rules read statistics of the whole text and vote good (1), bad (-1) or abstain (0). The votes of all
documents are counted by pattern (at most 3**rules patterns, whatever the corpus), and expectation-
maximisation on the counts estimates the share of good documents and each rule's accuracy. A document
is kept if its posterior probability to be good is at least `threshold` and it passes the base test.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, own_names, table
from .textops import slices, windows, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Least probability of any vote under either class.
LEAST = 0.02
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_alpha long, n_shouts long"


def text_stats(texts: list[bytes]) -> list[np.ndarray]:
    """The columns of STATS for whole texts, vectorised over all of them."""
    hashes, n_words, chars, symbols = words(texts, SYMBOLS)
    n = len(texts)
    doc = np.repeat(np.arange(n), n_words)
    w = windows(hashes, WINDOW)
    same = doc[: len(w)] == doc[WINDOW - 1 :] if len(w) else np.zeros(0, bool)
    at = np.flatnonzero(same)
    key = w[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    k = key[order]
    eq = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= eq
    twice[:-1] |= eq
    hit = at[order[twice]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n) if len(hashes) else np.zeros(n, np.int64)
    dup, lines, upper, letters, alpha, shouts = (np.zeros(n, np.int64) for _ in range(6))
    for i, t in enumerate(texts):
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if line.strip(b" \t\n\v\f\r"):
                lines[i] += 1
                if line in seen:
                    dup[i] += 1
                seen.add(line)
        b = np.frombuffer(t, np.uint8)
        up = int(np.count_nonzero((b >= 65) & (b <= 90)))
        upper[i], letters[i] = up, up + int(np.count_nonzero((b >= 97) & (b <= 122)))
        shouts[i] = t.count(b"!") + t.count(b"?")
        alpha[i] = letters[i] + int(np.count_nonzero(b >= 0xC0))  # letters of other scripts count by their first byte
    return [x.astype(np.int64) for x in (n_words, chars, symbols, dup, repeat, lines, upper, letters, alpha, shouts)]


def with_stats(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols and STATS of each row's whole text (null: empty). The text comes along only if it is one of
    id_cols; names of id_cols are not to be among the statistics (see own_names)."""
    rows = docs.select(*id_cols, *([] if text_col in id_cols else [text_col]))
    kept = list(id_cols)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(partial(_stats_of, kept, text_col), ", ".join([f"`{c}` {fields[c]}" for c in kept] + [STATS]))


def _stats_of(kept: list[str], text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), text_col):
            text = [t or b"" for t in part.column(text_col).cast(pa.binary()).to_pylist()]
            cols = [part.column(c) for c in kept] + [pa.array(x) for x in text_stats(text)]
            yield from pa.table(cols, names=[*kept, *names]).combine_chunks().to_batches()


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes: -1 bad, 1 good, 0 abstain. Rules on one trait each call a text bad or abstain, for a trait
    that is in order says little; the length and the rule on all traits together also vote good."""
    words_ = F.greatest(F.col("n_words"), F.lit(1))
    #: trait: (value, bound of the typical range, bound from which on it is bad)
    high = {
        "repeats": (F.col("n_repeat_words") / words_, 0.1, 0.3),
        "symbols": (F.col("n_symbols") / words_, 0.05, 0.2),
        "lines": (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.3, 0.5),
        "odd_chars": (1 - F.col("n_alpha") / F.greatest(F.col("word_chars"), F.lit(1)), 0.12, 0.25),
        "capitals": (F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)), 0.3, 0.6),
        "shouting": (F.col("n_shouts") / words_, 0.1, 0.3),
        "long_words": (F.col("word_chars") / words_, 12.0, 16.0),
    }
    odd = sum(((v > typical).cast("int") for v, typical, _ in high.values()), F.lit(0))
    out = {k: F.when(v > bad, -1).otherwise(0) for k, (v, _, bad) in high.items()}
    out["length"] = F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 50, 1).otherwise(0)
    out["typical"] = F.when(odd >= 2, -1).when(odd == 0, 1).otherwise(0)
    return out


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good, for each rule P(vote | class)): EM for votes that are independent given the class.

    patterns: votes, one row a distinct pattern; counts: documents with it. Class 1 starts where the
    votes' majority is good. Every rule keeps P(bad vote | good) <= P(bad vote | bad) and the other way
    round, so the classes cannot swap. No probability is below LEAST: one vote alone hardly decides.
    """
    good = np.where(patterns.sum(1) > 0, 0.9, 0.1)
    good[(patterns < 0).any(1)] *= 0.5
    values = np.array([-1, 0, 1])
    is_ = patterns[:, :, None] == values
    for _ in range(rounds):
        table_ = np.stack([((counts * p)[:, None, None] * is_).sum(0) + 0.1 for p in (1 - good, good)])
        table_ /= table_.sum(2, keepdims=True)
        swap = table_[1, :, 0] > table_[0, :, 0]
        table_[:, swap, 0] = table_[:, swap, 0].mean(0)
        swap = table_[1, :, 2] < table_[0, :, 2]
        table_[:, swap, 2] = table_[:, swap, 2].mean(0)
        table_ = np.maximum(table_ / table_.sum(2, keepdims=True), LEAST)
        table_ /= table_.sum(2, keepdims=True)
        share = float(np.clip((counts * good).sum() / max(counts.sum(), 1), 0.05, 0.95))
        log = np.log([1 - share, share])[:, None] + (np.log(table_)[:, None] * is_).sum((2, 3))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return share, table_


def posterior(stats: DataFrame, votes: dict[str, Column] | None = None) -> Column:
    """Probability that a row of `stats` is good, as an expression; fitted on all rows of `stats`."""
    votes = votes or rules()
    rows = stats.groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()  # at most 3**rules rows
    if not rows:
        return F.lit(0.5)
    patterns = np.array([[r[k] for k in votes] for r in rows])
    share, table_ = fit_label_model(patterns, np.array([r["count"] for r in rows], float))
    log = np.log(table_)
    odds = F.lit(float(np.log(share / (1 - share))))
    for j, v in enumerate(votes.values()):
        d = log[1, j] - log[0, j]
        odds = odds + F.when(v == -1, float(d[0])).when(v == 1, float(d[2])).otherwise(float(d[1]))
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, id_cols: list[str], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of docs: id_cols, statistics, votes' posterior `p_good`, base_failed, kept.

    Null and empty texts have no words and fail the base test; repeated rows and ties are judged alike;
    an empty table gives an empty result; further columns of docs are not read.
    """
    stats = materialize(with_stats(docs, id_cols, text_col), "stats")
    return stats.select("*", posterior(stats).alias("p_good"), base_failed().alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, ...) that quality() keeps, with all their columns."""
    return own_names(docs, ("doc_id", "text"), lambda d: quality(d, d.columns).where("kept").select(*d.columns))
