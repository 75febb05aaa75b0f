"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features of a whole text are counts of its character bigrams and trigrams (lower case; all but letters
as one space), hashed to DIM buckets. The family is the most probable under multinomial naive Bayes;
between each two languages of a family a linear support vector machine on the normalised square roots
of the counts decides, and votes are added up. Training takes at most SAMPLE labelled documents a
language, those with the least hashes: the bound of the sample that models are fitted on. Each
machine is trained in a task of its own on the sample of its two languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, table
from .textops import slices

DIM = 1 << 13
SAMPLE = 400
PASSES = 15
COST = 10.0
#: Families of languages by code (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "am", "mt"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = re.compile(r"[^\W\d_]")
#: Characters that are worked on at once.
CHUNK = 1 << 20


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def _letters(text: str) -> np.ndarray:
    """Code points in lower case, all but letters as blanks; both small sigmas are one letter, for which of them
    it is depends on the letters around."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code != 0xD7) & (code != 0xF7))
    return np.where(code == 0x3C2, np.uint64(0x3C3), np.where(letter, code, np.uint64(32)))


def _squeezed(code: np.ndarray) -> np.ndarray:
    """Marks of what is left when runs of blanks are one."""
    return np.r_[True, (code[1:] != 32) | (code[:-1] != 32)]


def _grams(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the bigrams and trigrams from each place on."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    two = (code[:-1] * np.uint64(0x100000001B3) + code[1:]) * mult
    three = (two[:-1] ^ (code[2:] * np.uint64(0xC2B2AE3D27D4EB4F))) * mult + np.uint64(1)
    return (two >> np.uint64(51)).astype(np.int64), (three >> np.uint64(51)).astype(np.int64)


def counts(texts: list[str]) -> np.ndarray:
    """Feature counts, one row a text (float32), of each text with a blank before and after it. A long text is
    counted in pieces of CHUNK characters; the last two letters of a piece go before the next one."""
    out = np.zeros((len(texts), DIM), np.float32)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        code = np.concatenate([c for _, c in held])
        row = np.repeat(np.arange(len(held)), [len(c) for _, c in held])
        keep = _squeezed(code) | np.r_[True, row[1:] != row[:-1]]
        code, row = code[keep], row[keep]
        two, three = _grams(code)
        inside2, inside3 = row[1:] == row[:-1], row[2:] == row[:-2]
        at = np.concatenate([row[:-1][inside2] * DIM + two[inside2], row[:-2][inside3] * DIM + three[inside3]])
        got = np.bincount(at, minlength=len(held) * DIM).reshape(len(held), DIM)
        out[[i for i, _ in held]] = got

    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            before = np.array([32], np.uint64)
            for a in range(0, len(t), CHUNK):
                code = np.concatenate([before, _letters(t[a : a + CHUNK]), np.array([32] if a + CHUNK >= len(t) else [], np.uint64)])
                code = code[_squeezed(code)]
                two, three = _grams(code)
                # what lies within the letters handed over is counted already
                out[i] += np.bincount(two[len(before) - 1 :], minlength=DIM) + np.bincount(three, minlength=DIM)
                before = code[-2:]
            continue
        held.append((i, np.concatenate([np.array([32], np.uint64), _letters(t), np.array([32], np.uint64)])))
        size += len(t)
        if size >= CHUNK or len(held) >= 256:
            flush()
            held, size = [], 0
    if held:
        flush()
    return out


def normalised(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with hinge loss, by dual coordinate descent.
    The two classes weigh alike."""
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float64)
    square = (x * x).sum(1)
    limit = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / square[i], 0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "text"):
            x = counts(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("lang").combine_chunks(), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])


def _matrix(x: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float32) for b in x])


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "x": [_matrix(rows["x"]).astype(np.float64).sum(0).tobytes()]})


def _train_pair(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["lang", "x"])
    y = np.where(rows["lang"] == rows["a"], 1.0, -1.0)
    w = train_svm(normalised(_matrix(rows["x"])), y)
    return pd.DataFrame({"a": [rows["a"].iloc[0]], "b": [rows["b"].iloc[0]], "w": [w.tobytes()]})


class Model:
    """What train() learns: families with the log probabilities of their buckets and their languages, and the
    weights of all pairs of languages as one matrix."""

    def __init__(self, sums: dict[str, np.ndarray], pairs: dict[tuple[str, str], np.ndarray]) -> None:
        self.members: dict[str, list[str]] = {}
        for lang in sorted(sums):
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        # each language counts alike in its family, however much of it there is
        share = [sum(sums[m] / sums[m].sum() for m in self.members[f]) / len(self.members[f]) for f in self.families]
        self.log = np.log(np.stack([s + 0.1 / DIM for s in share]) / 1.1) if share else np.zeros((0, DIM))
        self.own = []  # of each family: rows of the matrix, and which languages its pairs are of
        weights = []
        for f in self.families:
            names = self.members[f]
            duels = list(combinations(range(len(names)), 2))
            self.own.append((np.arange(len(weights), len(weights) + len(duels)), np.array(duels, int).reshape(-1, 2)))
            weights += [pairs[names[a], names[b]] for a, b in duels]
        self.weights = np.array(weights, np.float32).reshape(-1, DIM + 1)

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(languages, scores) of rows of counts: the likeliest family; in it the language with the most duels
        won, of equal ones that with the larger margins, then the last by name."""
        like = x @ self.log.T.astype(np.float32)
        p = np.exp(like - like.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best, unit = p.argmax(1), normalised(x)
        values = unit @ self.weights[:, :-1].T + self.weights[:, -1]
        langs, scores = np.empty(len(x), object), np.zeros(len(x))
        for f in np.unique(best):
            rows, (at, duels) = np.flatnonzero(best == f), self.own[f]
            names = np.array(self.members[self.families[f]], object)
            v = values[np.ix_(rows, at)]
            sides = [np.eye(len(names))[duels[:, k]] for k in (0, 1)]
            votes = (v >= 0) @ sides[0] + (v < 0) @ sides[1]
            margin = v @ (sides[0] - sides[1])
            margin = np.where(votes == votes.max(1, keepdims=True), margin, -np.inf)
            win = len(names) - 1 - (margin == margin.max(1, keepdims=True))[:, ::-1].argmax(1)
            signed = np.where(duels[None, :, 0] == win[:, None], v, np.where(duels[None, :, 1] == win[:, None], -v, np.inf))
            sure = 1 / (1 + np.exp(-np.clip(4 * signed.min(1, initial=np.inf), -30, 30)))
            langs[rows], scores[rows] = names[win], p[rows, f] * np.where(len(names) > 1, sure, 1.0)
        return langs.tolist(), scores.clip(0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for at in range(0, len(todo) if self.families else 0, 256):
            some = todo[at : at + 256]
            for i, lang, score in zip(some, *self.decide(counts([texts[i] for i in some])), strict=True):
                langs[i], scores[i] = lang, float(score)
        return langs, scores


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on rows (doc_id, text, lang); at most `sample` of them a language, by hash of doc_id."""
    known = labelled.where("lang is not null and text is not null")
    light = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit("language")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in light.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as languages
    if not sizes:
        return Model({}, {})
    shares = labelled.sparkSession.createDataFrame([(lang, min(1.0, 2 * sample / n)) for lang, n in sizes.items()], "lang string, share double")
    few = join_checked(light, shares, "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = materialize(few.withColumn("place", place).where(F.col("place") <= sample).select("doc_id").distinct(), "language-sample")
    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")  # at most sample ids a language
    x = materialize(rows.repartition(max(4, len(sizes))).mapInArrow(_features, "lang string, x binary"), "language-features")
    sums = {r["lang"]: np.frombuffer(r["x"], np.float64) for r in x.groupBy("lang").applyInPandas(_mean, "lang string, x binary").collect()}
    sums = {k: v for k, v in sums.items() if v.sum() > 0}
    pairs = [(a, b) for a, b in combinations(sorted(sums), 2) if family_of(a) == family_of(b)]
    weights = {}
    if pairs:
        pair = F.broadcast(labelled.sparkSession.createDataFrame(pairs, "a string, b string"))  # pairs of languages
        both = x.join(pair, (x["lang"] == pair["a"]) | (x["lang"] == pair["b"]))
        weights = {(r["a"], r["b"]): np.frombuffer(r["w"], np.float64) for r in both.groupBy("a", "b").applyInPandas(_train_pair, "a string, b string, w binary").collect()}
    return Model(sums, weights)


def _predict(kept: list[str], model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "__text"):
            langs, scores = model.value.predict(part.column("__text").to_pylist())
            yield from pa.table([*(part.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"]).combine_chunks().to_batches()


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred and score for every row of docs; `und` and 0 for null texts and those without
    a letter. Long texts are counted whole, in pieces that lose nothing at their edges. Repeated rows get the same,
    whatever rows are around them; ties go as Model.decide says. An empty table gives no rows; other columns are
    not read."""
    rows = docs.select(*keep, F.col("text").alias("__text"))
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_predict, list(keep), shared), f"{ids}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return identify(docs, model, ("doc_id", "held_out"))
