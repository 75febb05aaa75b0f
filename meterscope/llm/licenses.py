"""License scan: an exact set-similarity join of text blocks with license templates.

All of it is DataFrame expressions. A block is a run of consecutive words, |T| / threshold of them for a
template T of |T| words, whatever line breaks lie between; every such run is a block. Tokens are
ordered by how many documents of the corpus hold them, rarest first. With need = ceil(threshold * distinct
tokens of T), a block can hold `need` of them only if

* length filter: the document, and the stretch of words around the block, hold `need` of them;
* prefix filter: the block holds one of T's first |T| - need + 1 tokens in that order;
* positional filter: of the tokens from its first shared one on, `need` are held around it.

What passes is verified, so the join is exact. Templates are a fixed table, as are their tokens: the order
and the prefixes are at most a row a template and token, counted on the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

THRESHOLD = 0.8
#: A word after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that name a license wherever they stand (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices and texts of public licenses, and sentences that stand for them, in words (fixed values).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc", "this work is licensed under a creative commons attribution license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strings(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _places() -> Column:
    spots = []
    for phrase, label in PHRASES:
        parts = phrase.split()
        at = F.sequence(F.lit(0), F.greatest(F.size("__words") - len(parts), F.lit(0)))
        spots.append(F.transform(F.filter(at, _stands(parts)), _labelled(label)))
    return F.array_sort(F.concat(*spots))


def _stands(parts: list[str]):  # noqa: ANN202
    def test(i: Column) -> Column:
        out = F.lit(True)
        for j, w in enumerate(parts):
            out = out & F.coalesce(F.get("__words", i + j) == w, F.lit(False))
        return out

    return test


def _labelled(label: str):  # noqa: ANN202
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`keep`, n_words, places (array<struct(start, label)> of PHRASES, sorted), template_labels (sorted)
    and template_score, the best share of a template's distinct tokens that a block holds (0: none), for
    every row of docs.

    Null and empty texts have no words and no labels; long texts are read whole; repeated rows are alike; a block
    matches every template that it holds enough of; templates of one label count once. An empty table gives no
    rows; other columns are not read.
    """
    named = tuple(f"__keep{i}" for i in range(len(keep)))
    found = _licenses(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, named, strict=True)], F.col("text")), named, templates, threshold)
    return found.toDF(*keep, *found.columns[len(keep) :])


def _licenses(docs: DataFrame, keep: tuple[str, ...], templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    spark = docs.sparkSession
    sets = [(i, label, sorted(set(t.split())), math.ceil(threshold * len(set(t.split())) - 1e-9), int(len(t.split()) / threshold + 1e-9)) for i, (label, t) in enumerate(templates)]
    vocabulary = sorted({w for _, _, tokens, _, _ in sets for w in tokens})
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.select(*keep, F.col("__text").rlike("(?i)license").alias("__named"), _words(F.col("__text")).alias("__all"))
    rows = rows.withColumns({"__held": F.array_intersect("__all", _strings(vocabulary)), "__words": F.when(F.col("__named"), F.col("__all")).otherwise(F.array().cast("array<string>"))})
    # the length filter on documents
    near = F.array_compact(F.array(*[F.when(F.size(F.array_intersect("__held", _strings(tokens))) >= need, F.lit(i)) for i, _, tokens, need, _ in sets]))
    near = F.when(F.size("__held") >= min(x[3] for x in sets), near).otherwise(F.array().cast("array<int>"))
    rows = rows.select(*keep, F.monotonically_increasing_id().alias("__uid"), F.size("__all").cast("long").alias("n_words"), _places().alias("places"), "__held", near.alias("near"), "__all")
    rows = materialize(rows.withColumn("__all", F.when(F.size("near") > 0, F.col("__all"))), "license-words")

    counts = {r["w"]: r["n"] for r in rows.select(F.explode("__held").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    ordered = [(i, label, sorted(tokens, key=lambda w: (counts.get(w, 0), w)), need, width) for i, label, tokens, need, width in sets]
    fixed = F.broadcast(spark.createDataFrame(ordered, "template int, label string, tokens array<string>, need int, width int"))  # a row a template
    # hits: a place in the text and the token's place in the global order of the template's tokens, from 1
    hits = F.filter(F.transform("__all", lambda w, i: F.struct(i.alias("at"), F.array_position("tokens", w).cast("int").alias("token"))), lambda x: x["token"] > 0)
    spots = rows.where(F.size("near") > 0).select("__uid", "__all", F.explode("near").alias("template")).join(fixed, "template")
    spots = spots.select("__uid", "template", "width", "need", F.size("tokens").alias("size"), hits.alias("hits"))
    # the prefix filter on documents
    anchored = F.exists("hits", lambda x: x["token"] <= F.col("size") - F.col("need") + 1)
    spots = spots.where(anchored).select("__uid", "template", "width", F.explode("hits").alias("spot"))
    # hits are dealt to stretches of a block's length, each stretch with the next: a block lies in one such group
    own = F.floor(F.col("spot.at") / F.col("width"))
    spots = spots.withColumn("stretch", F.explode(F.array(own, own - 1))).where("stretch >= 0")
    groups = spots.groupBy("__uid", "template", "stretch").agg(F.collect_list("spot").alias("spots")).join(fixed, "template")
    held = F.array_distinct("spots.token")
    groups = groups.where(F.size(held) >= F.col("need"))  # the length filter on stretches
    prefix = F.filter(held, lambda t: t <= F.size("tokens") - F.col("need") + 1)
    groups = groups.where(F.exists(prefix, lambda t: F.size(F.filter(held, lambda u: u >= t)) >= F.col("need")))  # the prefix and the positional filter
    inside = lambda x: F.size(F.array_distinct(F.transform(F.filter("spots", lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + F.col("width"))), lambda y: y["token"])))
    shared = groups.withColumn("shared", F.array_max(F.transform("spots", inside))).where("shared >= need")
    found = shared.groupBy("__uid").agg(F.array_sort(F.collect_set("label")).alias("template_labels"), F.max(F.col("shared") / F.size("tokens")).alias("template_score"))
    out = rows.drop("near", "__all", "__held").join(found, "__uid", "left").drop("__uid")
    return out.withColumn("template_labels", F.coalesce("template_labels", F.array().cast("array<string>"))).withColumn("template_score", F.coalesce("template_score", F.lit(0.0)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(licenses(table(spark, sf_dir, "documents")))


def _scan(rows: DataFrame) -> DataFrame:
    starts, base = F.transform("places", lambda p: p["start"]), F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.col("template_score"))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, "template_labels")), ",").alias("labels"), score.alias("score"))


def _sql() -> str:
    widths = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))}, {int(len(t.split()) / THRESHOLD + 1e-9)})" for i, (label, t) in enumerate(TEMPLATES))
    some = f"SELECT row, w, k, label, tokens, width FROM d CROSS JOIN (VALUES {widths}) AS x(k, label, tokens, width) WHERE len(list_intersect(list_distinct(w), tokens)) >= {THRESHOLD} * len(tokens) - 0.0000001"
    scores = f"SELECT row, label, len(list_intersect(list_distinct(w[i:i + width - 1]), tokens))::DOUBLE / len(tokens)::DOUBLE AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ({some}))"
    places = " UNION ALL ".join(
        f"SELECT row, i - 1 AS start, '{label}' AS label FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase.split())) for phrase, label in PHRASES
    )
    lower = f"translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}')"
    word = WORD
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {lower} AS t, regexp_extract_all({lower}, '{word}') AS w FROM documents),
p AS ({places}),
q AS (SELECT row, count(*) AS n, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM p GROUP BY row),
m AS ({scores}),
g AS (SELECT row, list(DISTINCT label) AS ls, max(s) AS s FROM m WHERE s >= {THRESHOLD}::DOUBLE - 0.0000001::DOUBLE GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(q.n, 0)::BIGINT AS n_base, q.first_word::BIGINT AS first_word, q.last_word::BIGINT AS last_word,
  COALESCE(array_to_string(q.ls, ','), '') AS base_labels,
  COALESCE(array_to_string(list_sort(list_distinct(list_concat(COALESCE(q.ls, []), COALESCE(g.ls, [])))), ','), '') AS labels,
  CASE WHEN q.n > 0 THEN 1.0::DOUBLE ELSE COALESCE(g.s, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN q USING (row) LEFT JOIN g USING (row)
"""


OP8_SQL = _sql()
