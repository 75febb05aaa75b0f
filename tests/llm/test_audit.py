"""Vector codes, decontamination and source divergence against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterscope.llm import codes, decontaminate, divergence

rng = random.Random(11)
DOCS = "doc_id long, text string, lang string, source string"
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("__vector", "__label", "__text", "code", "error", "items", "hits", "term", "level", "n", "p", "prefix", "rank", "part")})


# op11


def plain_codes(rows):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = 16 * max(-(-max(len(r[1]) for r in rows) // 16), 1)
    d = width // 16
    x = [[int(np.floor(256 * float(np.float32(v)))) for v in r[1]] + [0] * (width - len(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:64]
    books = [[x[i][p * d : p * d + d] for i in order] for p in range(16)]

    def best(p, part):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return min(range(len(far)), key=lambda e: (far[e], e)), min(far)

    for _ in range(2):
        for p in range(16):
            held = defaultdict(list)
            for v in x:
                part = v[p * d : p * d + d]
                held[best(p, part)[0]].append(part)
            for e, parts in held.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for r, v in zip(rows, x):
        found = [best(p, v[p * d : p * d + d]) for p in range(16)]
        out.append((r[0], "".join(f"{e:02x}" for e, _ in found), sum(f for _, f in found), r[2]))
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), c, e, total[label], sha) for i, c, e, label in out)


def vectors(n, d, seed):
    own = np.random.default_rng(seed)
    centre = own.normal(size=(12, d))
    return [(i, [float(np.float32(v)) for v in centre[i % 12] / 4 + own.normal(size=d) / 20], None if i % 9 == 0 else 1 if i % 3 else i % 5) for i in range(n)]


@pytest.mark.parametrize(("n", "d"), [(300, 32), (40, 64), (90, 16)])
def test_codes_equal_a_plain_version(spark, n, d):
    rows = vectors(n, d, n)
    got = codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(70, 32, 3) + [(900, None, 1), (901, [1.0] * 31 + [nan], 1), (902, [1.0] * 31 + [inf], 1), (903, [1.0] * 31 + [None], 1)]
    rows += [(904, [0.0] * 32, 1), (904, [0.0] * 32, 1), (None, [0.5] * 32, None), (905, [], 2), (906, [0.25] * 7, 2), (907, [-0.001] * 40, 2)]
    df = clashing(spark.createDataFrame(rows, VECTORS))
    got = codes.vector_codes(df).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows)
    assert codes.vector_codes(df.limit(0)).count() == 0 and codes.vector_codes(df.where("vec_id = 900")).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)], VECTORS)
    assert all(r["error"] == 0 for r in codes.vector_codes(huge).collect())


def test_equal_average_search_is_exact():
    own = np.random.default_rng(5)
    for d, k in ((1, 1), (2, 7), (4, 64), (4, 64), (12, 33)):
        x, entries = own.integers(-9, 9, (500, d)), own.integers(-9, 9, (k, d))  # many ties
        index, far = codes.nearest(x, entries)
        want = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == want.argmin(1)).all() and (far == want.min(1)).all()


# op12

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(len(w), 10)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(own), sorted(hit), sorted(found)


def benchmark_and_texts():
    vocabulary = ["ab", "Ärger", "c3", "7", "x", "ß日本", "the", "Of"]
    prose = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, prose(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for i in range(25)] + [(90, None), (91, " .,"), (3, prose(14)), (92, "rare words stand here")]
    texts = [prose(rng.randint(0, 300)) for _ in range(60)]
    texts += [prose(30) + items[i][1].upper() + prose(9) for i in range(20)] + [None, "", "?!", "Rare WORDS, stand\there!", "rare words stand", "a" * 5000]
    return items, texts


@pytest.mark.parametrize("shard", [decontaminate.SHARD, 150])
@pytest.mark.parametrize("stretch", [decontaminate.STRETCH, 7])
def test_hits_equal_brute_force(spark, shard, stretch, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", stretch)
    items, texts = benchmark_and_texts()
    automaton = decontaminate.Automaton([(r["window"], r["items"], r["n"]) for r in decontaminate.windows(spark.createDataFrame(items, "item_id long, text string")).collect()])
    for t in texts:  # in this process, where the stretch is set
        n, hits, found = automaton.run((t or "").encode())
        want = plain_hits(t, items)
        runs = decontaminate.merged(hits)
        assert (n, [w for a, b in runs for w in range(a, b + 1)], sorted({x for i in found for x in automaton.items[i]})) == want
        for (a, b), (s, e) in zip(runs, decontaminate.places((t or "").encode(), runs)):
            assert words(t[s:e]) == words(t)[a : b + 1] and words(t[:s]) == words(t)[:a]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)
    got = decontaminate.contamination(clashing(docs), spark.createDataFrame(items, "item_id long, text string"), shard=shard).collect()
    for r in got:
        n, hit, found = plain_hits(texts[r["doc_id"]], items)
        assert r["n_words"] == n and r["items"] == found
        assert [w for h in r["hits"] for w in range(h["first_word"], h["last_word"] + 1)] == hit
    assert len(got) == len(texts)


def test_decontamination_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two", None, None), (1, "one two", None, None), (None, None, None, None), (2, "three", "en", "s")], DOCS)
    items = spark.createDataFrame([(5, "ONE", "two"), (None, None, "two"), (5, "one", None)], "item_id long, question string, answer string")
    got = decontaminate.contamination(docs, items, fields=("question", "answer")).collect()
    assert sorted((str(r["doc_id"]), r["items"], len(r["hits"])) for r in got) == [("1", ["", "5"], 1)] * 2 + [("2", [], 0), ("None", [], 0)]
    none = decontaminate.contamination(docs, items.limit(0), fields=("question", "answer")).collect()
    assert all(not r["hits"] for r in none) and len(none) == 4
    assert decontaminate.contamination(docs.limit(0), items, fields=("question",)).count() == 0
    texts = items.select("item_id", F.col("question").alias("text"))
    clean = decontaminate.drop_contaminated(clashing(docs), texts)
    assert clean.columns == clashing(docs).columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["2", "None"]
    assert decontaminate.drop_contaminated(docs, texts, most=0.5).count() == 4


def test_a_long_text_is_run_through_whole(spark):
    text = "filler words " * 400_000 + "one needle in the hay of many more words than ten " * 3
    docs = spark.createDataFrame([(1, text, None, None)], DOCS)
    items = spark.createDataFrame([(7, "One needle in the hay of many more words than ten")], "item_id long, text string")
    (r,) = decontaminate.contamination(docs, items).collect()
    assert r["n_words"] == 800_033 and [(h["first_word"], h["last_word"], h["start"]) for h in r["hits"]] == [(800_000, 800_032, 13 * 400_000)]


# op13

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_divergence(rows, support, top=10):
    terms = [(lang or "", source or "", TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source in rows]
    docs = Counter((lang, t) for lang, _, own in terms for t in set(own))
    kept = defaultdict(set)
    for (lang, t), n in docs.items():
        if n >= support:
            kept[lang].add(t)
    count, per = defaultdict(Counter), defaultdict(Counter)
    for lang, source, own in terms:
        own = [t for t in own if t in kept[lang]]
        count[lang, source].update(own)
        per[lang].update(own)
    share = lambda c, lang, t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept[lang]))
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang, source in count:
        own = {t: share(count[lang, source], lang, t) for t in kept[lang]}
        pairs = []
        for other in {s for x, s in count if x == lang and s != source}:
            pairs.append((other, sum(gap(p, share(count[lang, other], lang, t)) for t, p in own.items())))
        found = [(t, gap(p, share(per[lang], lang, t))) for t, p in own.items() if count[lang, source][t] and p > share(per[lang], lang, t)]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            by = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(by)]
    return sorted(out)


def documents(n):
    stems = ["ab", "abc", "abcd", "ü", "üb", "zoo", "zo", "longer" * 9, "longer" * 9 + "x", "longer" * 9 + "y", "日本", "日"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(stems) + ("" if rng.random() < 0.8 else rng.choice("qrs")) for _ in range(rng.randint(0, 12)))
        rows.append((i, text.upper() if i % 5 == 0 else text.replace(" ", "3-"), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "ä", None, "Z"])))
    return rows


def named(rows):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in rows)


@pytest.mark.parametrize(("held", "tile", "bucket", "most"), [(divergence.HELD, 32, 8192, divergence.KEPT_ROWS), (20, 2, 3, 0)])
def test_divergence_equals_a_plain_version(spark, monkeypatch, held, tile, bucket, most):
    for name, value in (("HELD", held), ("TILE", tile), ("BUCKET", bucket), ("KEPT_ROWS", most)):
        monkeypatch.setattr(divergence, name, value)
    rows = documents(150) + [(1, None, "en", "a"), (2, "", "xx", "a"), (3, "...", "yy", "a"), (3, "...", "yy", "b"), (4, "ab " * 40, "yy", "b")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert named(divergence.divergence(clashing(df), support=4).collect()) == plain_divergence(rows, 4)


def test_divergence_passes_on_a_row_a_term():
    """Rows of long arrays would be held by thousands in a reader's batch."""
    texts = ["b a A", "a", "", "12"]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": ["x", "x", "x", "y"], "source": ["s", "s", "t", "t"]})
    got = [r for b in divergence._counted(divergence.HELD, iter([batch])) for r in b.to_pylist()]
    assert sorted((r["lang"], r["source"], r["term"], r["n"]) for r in got if r["level"] is None) == [("x", "s", b"a", 3), ("x", "s", b"b", 1), ("x", "t", None, 0), ("y", "t", None, 0)]
    assert sorted((r["lang"], r["level"], r["term"], r["n"]) for r in got if r["level"] is not None) == [("x", 0, b"a", 2), ("x", 0, b"b", 1)]
    assert all(r["source"] is None for r in got if r["level"] is not None)
    many = pa.RecordBatch.from_pydict({"text": [" ".join("q" + chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(17_000))], "lang": ["x"], "source": ["s"]})
    assert [b.num_rows for b in divergence._counted(divergence.HELD, iter([many]))] == [16_384, 616, 16_384, 616]


def test_divergence_of_no_documents(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_levels_count_each_document_once_a_prefix():
    terms = sorted({bytes(rng.choices(b"ab", k=rng.randint(1, 70))) for _ in range(400)} | {b"a" * n for n in range(1, 80)})
    level = divergence.levels(terms)
    for k in range(6):
        prefixes = {(t + b"\0")[: divergence.FIRST << k] for t in terms}
        assert sum(level <= k) == len(prefixes)
