"""Every dealt operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty
tables and columns with clashing names."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from meterscope.llm import chat, common, jaccard, language, licenses, mixing, packing, pii, quality, secrets, vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
vocabulary = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 7))) for _ in range(600)]


def prose(n):
    return " ".join(rng.choices(vocabulary, k=n))


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t ", "one", "word " * 3000, "é" * 50_000, prose(40), prose(40)]


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD)
    return df.unionByName(df.where("doc_id = 6")).unionByName(spark.createDataFrame([(None, None, None, None, None)], SCHEMA))


CLASH = ("spans", "base", "n_words", "kept", "__size", "found", "places", "uid", "key", "length")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# op1


def test_mix_targets_and_draws(spark):
    texts = [prose(rng.randint(1, 80)) for _ in range(900)] + [None, ""]
    sources = ["big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None for i in range(902)]
    df = frame(spark, texts, sources)
    rows = mixing.repetitions(df).join(df.select("doc_id", "source"), "doc_id").collect()
    size = defaultdict(int)
    for r in rows:
        assert r["__size"] == len(WORDS.findall(texts[r["doc_id"]] or ""))
        size[r["source"]] += r["__size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while True:  # shares by weight, the excess over caps given to the others
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            free.discard(s)
    target |= share
    taken = defaultdict(int)
    for r in rows:
        assert abs(r["__target"] - target[r["source"]]) < 1e-6 * target[r["source"]] + 1e-9
        assert 0 <= r["__copies"] <= 2
        taken[r["source"]] += r["__size"] * r["__copies"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 160, s
    again = {(r["doc_id"], r["__copies"]) for r in mixing.repetitions(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["__copies"]) for r in rows}
    assert mixing.mix(df).count() == sum(r["__copies"] for r in rows)
    plan = {r["__key"]: r["__rate"] for r in mixing.mixture_plan(df)[1].collect()}
    for s in names:  # a copy is one draw with the probability of the fraction
        own = [r["__copies"] for r in rows if r["source"] == s and r["__size"]]
        rate = plan["n" if s is None else "s" + s]
        assert set(own) <= {int(rate), int(rate) + 1} and abs(np.mean(own) - rate) < 4 * np.sqrt(0.25 / len(own)) + 0.02


def test_mix_odd(spark, odd):
    assert mixing.repetitions(odd).count() == odd.count()
    out = mixing.mix(clashing(odd))
    assert out.columns == clashing(odd).columns
    assert mixing.mix(odd.limit(0)).count() == 0


# op2


def test_base_spans_equal_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k in range(6000):
        t = "".join(rng.choices("ab.@-+ 1205()%x\n" if k % 2 else "0123456789 -.+@a", k=rng.randint(0, 60)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert sorted(want) == pii.base_spans(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    pii.base_spans("1" * 200_000 + "a" * 200_000 + "@")  # in linear time


def test_contexts_find_unseen_numbers(spark):
    seed = [f"please call me on phone +1 555 {200 + i} {1000 + i} today" for i in range(20)]
    new = [f"please call me on phone 555-{300 + i}-{2000 + i} today" for i in range(10)]
    other = [f"part number 777-{300 + i}-{2000 + i} in stock" for i in range(10)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, seed + new + other)).collect()}
    assert all(len(got[i]) == 1 for i in range(30)) and not any(got[i] for i in range(30, 40))
    masked = [r["text"] for r in pii.redact(frame(spark, seed + new + other)).orderBy("doc_id").collect()]
    assert masked[0] == masked[25] == "please call me on phone <phone> today" and masked[35] == other[5]


def spans_by_doc(spark, texts):
    return {r["doc_id"]: [(s["kind_no"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.personal_data(frame(spark, texts)).collect()}


def test_patterns_that_only_found_strings_support(spark):
    """12 seeds and 12 unseen numbers share a context; the unseen ones support a second context, which finds a
    third group. Numbers that mostly stand elsewhere are left alone."""
    number = lambda k, i: f"555-{300 + i}-{1000 * k + i}"
    seeds = [f"{prose(3)} ring mobile +1 555 {300 + i} {1000 + i} {prose(3)}" for i in range(12)]
    unseen = [f"{prose(3)} ring mobile {number(2, i)} {prose(3)}" for i in range(12)]
    second = [f"{prose(3)} reach desk {number(2, i)} {prose(3)}" for i in range(12)] + [f"{prose(3)} reach desk {number(3, i)} {prose(3)}" for i in range(12)]
    parts = [f"{prose(3)} order item {number(4, i)} {prose(3)}" for i in range(40)] + [f"{prose(3)} order item +1 555 {400 + i} {1000 + i} {prose(3)}" for i in range(4)]
    texts = seeds + unseen + second + parts
    got = spans_by_doc(spark, texts)
    assert all(len(got[i]) == 1 and got[i][0][0] == 3 for i in range(48))
    assert got[36] == [(3, number(3, 0))] and not any(got[i] for i in range(48, 88)) and all(len(got[i]) == 1 for i in range(88, 92))


def plain_bootstrap(texts):
    """The method, on dictionaries."""
    edges, shapes = {}, {}
    for t in texts:
        for s in pii.scan(t)[1]:
            shapes[s["string"]] = s["shapes"]
            for c in s["contexts"]:
                edges[c, s["string"]] = max(edges.get((c, s["string"]), -1), -1 if s["kind_no"] is None else s["kind_no"])
    found = {}
    while True:
        known = lambda e: e[1] if e[1] >= 0 else found.get(e[0][1])
        new = {}
        for context in {c for c, _ in edges}:
            own = [e for e in edges.items() if e[0][0] == context]
            of = Counter(known(e) for e in own if known(e) is not None)
            for k, n in of.items():
                unknown = [e[0][1] for e in own if known(e) is None and k in shapes[e[0][1]]]
                c = n / (sum(of.values()) + pii.UNKNOWN * len(unknown))
                if n >= pii.SUPPORT and c >= pii.CONFIDENT:
                    for s in unknown:
                        new[s] = max(new.get(s, (0, 0)), (c, -k))
        if not new:
            return found
        found |= {s: -k for s, (_, k) in new.items()}


def test_bootstrap_equals_a_plain_one(spark):
    words = ["call", "on", "pay", "from", "with", "to", "id"]
    texts = []
    for i in range(400):
        a, b = rng.choice(words), rng.choice(words)
        kind = rng.randrange(5) if a in ("call", "pay") else rng.choice([1, 3, 4])
        n = rng.randint(0, 60)
        texts.append(f"{a} {b} " + ["+1 555 444 %04d" % n, "555-444-%04d" % n, "4111 1111 1111 1111", "999.%d.1.1" % n, "10.0.0.%d" % n][kind] + f" {rng.choice(words)}")
    found = plain_bootstrap(texts)
    got = spans_by_doc(spark, texts)
    want = {}
    for i, t in enumerate(texts):
        base, seen = pii.scan(t)
        more = [(s["start"], found[s["string"]], s["end"]) for s in seen if s["kind_no"] is None and s["string"] in found]
        want[i] = [(k, t[a:b]) for a, k, b in sorted([(s["start"], s["kind_no"], s["end"]) for s in base] + more)]
    assert got == want and len(found) > 5


def test_numbers_side_by_side():
    cut = lambda t: [t[a:b] for a, b in pii.numbers(t)]
    assert cut("555-300-2000 555-300-2001") == ["555-300-2000", "555-300-2001"]
    assert cut("555-300-2000 12 units") == ["555-300-2000"] and cut("call 555 300 2000 now") == ["555 300 2000"]
    assert cut("555 300 2000 555 300 2001") == ["555 300 2000", "555 300 2001"] and cut("4111 1111 1111 1112") == ["4111 1111 1111 1112"]
    assert cut("1 " * 50_000)[:1] == ["1 1 1 1 1 1 1 1 1"]
    around = pii.Contexts("x" * 100_000 + " 5 " + "y")
    assert len(around.of(100_001, 100_002)[0]) == 34 and around.of(100_001, 100_002)[1:2] == ["R y"]


def test_pii_odd(spark, odd):
    assert pii.personal_data(odd).count() == odd.count()
    out = pii.redact(clashing(odd))
    assert out.columns == clashing(odd).columns and sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in odd.collect())
    assert pii.redact(odd.limit(0)).count() == 0


def test_masking_follows_the_length_of_a_text(spark):
    """5 MB with 200,000 spans, as whole and as a plain loop has it."""
    text = " ".join(f"w{i} a{i % 977}@b{i % 13}.com {'x' * (i % 7)}" for i in range(200_000))
    begun = time.time()
    (masked,) = [r["text"] for r in pii.redact(frame(spark, [text])).collect()]
    assert time.time() - begun < 60
    assert masked == re.sub(r"[a-z0-9]+@[a-z0-9]+\.com", "<email>", text) and masked.count("<email>") == 200_000
    for _ in range(300):
        t, spans = prose(9), sorted((a := rng.randint(0, 30), rng.randint(0, 3), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 5)))
        want, at = "", 0
        for a, k, b in spans:
            if a >= at:
                want += t[at:a] + f"<{pii.KINDS[k]}>"
            at = max(at, b)
        assert pii.mask(t, [s[0] for s in spans], [s[2] for s in spans], [s[1] for s in spans]) == want + t[at:]


# op3


def test_language_on_held_out_texts(spark):
    parts = {"en": "the and of ing tion er th wh", "de": "ein und der sch ung keit ver ich", "fr": "eau les tion eux que ment oi ai", "es": "ción os ado la ez que ar mente"}
    rows = []
    for i in range(400):
        lang = list(parts)[i % 4]
        rows.append((i, " ".join("".join(rng.choices(parts[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in language.identify(df.drop("lang"), model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd_rows = language.identify(frame(spark, [None, "", "12 34!", prose(5), "x " * 2_000_000]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd_rows][:3] == ["und"] * 3 and odd_rows[4]["lang_pred"] in parts
    nothing = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_long_text_counts_as_its_pieces():
    texts = [prose(4000), "ΣΑΣ ας " * 300, "x" * 3000, " " * 2500 + "ab" + " " * 1500, "12 a! É" * 700]
    whole = language.counts(texts)
    language.CHUNK, old = 1000, language.CHUNK
    try:
        pieces = language.counts(texts)
    finally:
        language.CHUNK = old
    assert (whole == pieces).all()
    grams = Counter()
    for w in re.findall("[a-z]+", texts[0].lower()):
        grams.update(f" {w} "[i : i + 2] for i in range(len(w) + 1))
    codes = {g: language._grams(np.array([ord(c) for c in g + " "], np.uint64))[0][0] for g in grams}
    assert all(whole[0, codes[g]] >= n for g, n in grams.items())


def test_decisions_equal_a_plain_loop():
    """Family by the sum of log probabilities, then duels of its languages one by one; rows do not depend on each other."""
    g = np.random.default_rng(4)
    langs = ["de", "en", "nl", "es", "fr", "xx"]
    sums = {lang: g.gamma(0.3, 5, language.DIM) + 1e-6 for lang in langs}
    pairs = {(a, b): g.normal(size=language.DIM + 1) for i, a in enumerate(sorted(langs)) for b in sorted(langs)[i + 1 :] if language.family_of(a) == language.family_of(b)}
    model = language.Model(sums, pairs)
    texts = [prose(rng.randint(1, 40)) for _ in range(60)]
    got = model.predict(texts)
    assert got[0] == [model.predict([t])[0][0] for t in texts]
    for t, lang, score in zip(texts, *got, strict=True):
        x = language.counts([t])[0].astype(float)
        logs = {}
        for f in {language.family_of(v) for v in langs}:
            own = [v for v in langs if language.family_of(v) == f]
            logs[f] = float(x @ np.log((sum(sums[v] / sums[v].sum() for v in own) / len(own) + 0.1 / language.DIM) / 1.1))
        family = max(logs, key=logs.get)
        own = sorted(v for v in langs if language.family_of(v) == family)
        unit = np.sqrt(x) / np.linalg.norm(np.sqrt(x))
        duel = {p: float(unit @ pairs[p][:-1] + pairs[p][-1]) for p in pairs if p[0] in own}
        won = Counter(a if v >= 0 else b for (a, b), v in duel.items())
        margin = {m: sum(v for (a, _), v in duel.items() if a == m) - sum(v for (_, b), v in duel.items() if b == m) for m in own}
        assert lang == max(own, key=lambda m: (won[m], margin[m], m)) and 0 <= score <= 1


def test_language_odd(spark, odd):
    model = language.train(spark.createDataFrame([(i, "the and of " * 9 if i % 2 else "der die und " * 9, "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string"))
    rows = clashing(odd).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1)})
    got = language.identify(rows, model).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] == 6} <= {"en", "de"} and language.identify(odd.limit(0), model).count() == 0


# op4


def test_secrets_against_plain_patterns(spark):
    token = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    texts = [prose(20), f"é API_key: '{token(20)}' x", "token=secret:abcdefghijklmnop", "AKIA" + "A1" * 8 + " AKIAXX", "a" * 15 + " " + "abcdef0123456789" * 3, f"zz {token(44)} yy", None, "", "deadbeef" * 20_000]
    assign = re.compile(secrets.ASSIGN)
    random_found = 0
    for r in secrets.secrets(frame(spark, texts)).collect():
        t = texts[r["doc_id"]] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert sorted(want) == [(s["start"], s["kind_no"], s["end"]) for s in r["found"] if s["kind_no"] != 3]
        random_found += sum(s["kind_no"] == 3 for s in r["found"])
        assert not (r["doc_id"] == 0 and r["found"])
    assert random_found == 1


def test_battery_tells_random_from_text(spark):
    rows = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(30)] + ["internationalisation", "getElementsByTagNameFromDocument", "a" * 40, "0123456789abcdef" * 3, "CONSTITUTIONALREPRESENTATIVES"]
    got = {r["token"]: r for r in secrets.with_tests(spark.createDataFrame([(x,) for x in rows], "token string")).collect()}
    assert sum(got[x]["battery"] <= secrets.BATTERY and got[x]["z_ratio"] > 4 for x in rows[:30]) >= 29
    assert not any(got[x]["battery"] <= secrets.BATTERY and max(got[x]["z_ratio"], got[x]["z_battery"]) > 4 for x in rows[30:])


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_battery_equals_plain_statistics(spark):
    """The three tests, and their p-value against text: of texts drawn letter by letter from the text model at
    most that share is so even; of random tokens nearly all are, once long enough."""
    k, q = 64, secrets._text_model(secrets.ENCODINGS["base64"][1])
    order = secrets.ENCODINGS["base64"][1]
    tokens = {"random": ["".join(rng.choices(ALPHABET, k=n)) for n in (24, 64, 200) for _ in range(40)], "text": ["".join(rng.choices(order, q, k=n)) for n in (24, 64, 200) for _ in range(400)]}
    tokens = {kind: [t for t in own if re.search("[A-Z]", t) and re.search("[a-z]", t)] for kind, own in tokens.items()}
    got = {r["token"]: r for r in secrets.with_tests(spark.createDataFrame([(x,) for own in tokens.values() for x in own], "token string")).collect()}
    for t in tokens["random"] + tokens["text"][:40]:
        v, n = [order.index(c) + 1 for c in t], len(t)
        chi = k / n * sum(c * c for c in Counter(v).values()) - n
        z1 = max(0.0, ((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
        up = sum(x > (k + 1) / 2 for x in v)
        runs = 1 + sum((a > (k + 1) / 2) != (b > (k + 1) / 2) for a, b in zip(v, v[1:], strict=False))
        e = 2 * up * (n - up) / n + 1
        var = (e - 1) * (e - 2) / (n - 1)
        z2 = (runs - e) / math.sqrt(var) if var > 0 else math.sqrt(n)
        m = [x - (k + 1) / 2 for x in v]
        z3 = sum(a * b for a, b in zip(m, m[1:], strict=False)) / sum(x * x for x in m) * math.sqrt(n)
        assert abs(got[t]["battery"] - (z1 * z1 + z2 * z2 + z3 * z3)) < 1e-6
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    p = {t: tail(got[t]["z_battery"]) for own in tokens.values() for t in own}
    for level in (0.2, 0.05, 0.01):
        assert np.mean([p[t] <= level for t in tokens["text"]]) <= 1.5 * level + 0.01
    assert np.mean([p[t] < 1e-3 for t in tokens["random"] if len(t) == 200]) > 0.9


def test_false_discovery_control_equals_a_plain_one():
    g = np.random.default_rng(2)
    z = np.r_[g.normal(0, 1, 5000), g.normal(6, 1, 80)]
    bins = Counter(np.floor(z.clip(-1, 40) / secrets.Z_STEP).astype(int).tolist())
    cut = secrets._histogram_cuts([{"stratum": 2, "bin": b, "n": n} for b, n in bins.items()], 0.01)
    at = sorted((b * secrets.Z_STEP for b in bins), reverse=True)
    plain = [v for v in at if len(z) * 2 * 0.5 * math.erfc(v / math.sqrt(2)) <= 0.01 * (z >= v - 1e-9).sum()]
    assert abs(cut[2] - min(plain)) < 1e-9 and cut[0] == math.inf and 60 <= (z[:5000] >= cut[2]).sum() + (z[5000:] >= cut[2]).sum() <= 90


def test_random_tokens_among_words_are_found(spark):
    """Planted tokens of 40 symbols in prose with long words: nearly all are found, hardly a word is."""
    stems = ["inter", "nation", "al", "isation", "counter", "revolution", "ary", "electro", "magnet", "ism", "under", "standing", "micro", "bio", "logical"]
    long_word = lambda: "".join(rng.choices(stems, k=rng.randint(4, 7)))
    texts = [f"{prose(20)} {long_word()} {prose(10)} {long_word()}" for _ in range(300)]
    for i in range(0, 300, 10):
        texts[i] += " " + "".join(rng.choices(ALPHABET[:62], k=40)) + " end"
    got = {r["doc_id"]: [s for s in r[-1] if s["kind_no"] == 3] for r in secrets.secrets(clashing(frame(spark, texts)), ("doc_id", "found", "base", "spans")).collect()}
    assert sum(len(got[i]) == 1 and got[i][0]["end"] - got[i][0]["start"] == 40 for i in range(0, 300, 10)) >= 28
    assert sum(len(got[i]) for i in range(300) if i % 10) <= 1


def test_secrets_odd(spark, odd):
    assert secrets.secrets(odd).count() == odd.count() and secrets.secrets(odd.limit(0)).count() == 0


# op5


def brute_classes(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            common_ = len(sets[a] & sets[b])
            if common_ and common_ >= 0.8 * (len(sets[a]) + len(sets[b]) - common_) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_jaccard_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard._paths, "__defaults__", (limit,))
    shared = prose(60)
    texts = [None, "", "a b", "a b", "a b c", "x y z w v"]
    for _ in range(40):
        base = prose(rng.randint(6, 120))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    hot = prose(150).split()
    for _ in range(60):  # a large group of near copies
        w = list(hot)
        w[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [shared + " " + prose(30) for _ in range(50)] + [texts[10]] * 30
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(frame(spark, texts)).collect()}
    assert got == brute_classes(texts)


def test_drop_near_duplicates_odd(spark, odd):
    out = jaccard.drop_near_duplicates(clashing(odd))
    assert out.columns == clashing(odd).columns
    kept = [r["doc_id"] for r in out.collect()]
    assert Counter(kept)[6] == 1 and None in kept and set(range(8)) == {k for k in kept if k is not None}
    assert jaccard.drop_near_duplicates(odd.limit(0)).count() == 0


def test_drop_goes_by_text_not_by_id(spark):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, a), (None, b), (None, prose(50)), (4, c + " more"), (5, None), (5, None), (6, prose(30)), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), rows[6], (5, None), (5, None), rows[10], (6, None)], key=str)
    twice = docs.unionByName(docs)
    assert Counter(tuple(r) for r in jaccard.drop_near_duplicates(twice).collect()) == Counter(kept + [(5, None), (5, None), (6, None)])


def test_classes_of_null_ids(spark):
    base = prose(100)
    texts = [base, base + " more", prose(40), base]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (None, texts[3])], "doc_id long, text string")
    got = Counter(tuple(r)[:4] for r in jaccard.jaccard_classes(df).collect())
    assert got == {(None, None, 2, 2): 2, (None, None, 2, 1): 1, (7, 7, 0, 1): 1}
    assert jaccard.sketch_loss(0.8) < 1e-6 and jaccard.runs_for(0.999) == 15


def test_joins_beyond_the_bounds(spark):
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 500 + [2] * 20 + [None] * 3 + [3])], "k long, i long")
    small = spark.createDataFrame([(1, "x" * 100), (3, "z"), (4, "w")], "k long, v string")
    for limit, hot in ((10, 50), (0, 50), (0, 10_000)):
        for how, n in (("inner", 501), ("left", 524), ("left_anti", 23), ("left_semi", 501)):
            assert common.join_checked(big, small, "k", how, limit, hot=hot).count() == n
    assert common.fits(small) and not common.fits(small, size=100) and not common.fits(small, rows=2)


def test_settled_keeps_its_result_only(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    root = Path(urlparse(common.shared_dir(spark)).path)
    folders = lambda: {p.name for p in root.glob("meterscope-*")}
    before = folders()

    def steps():
        inner = common.settled(lambda: common.materialize(common.materialize(spark.range(10), "a"), "b"), "c")
        return common.materialize(inner.where("id > 3"), "d")

    out = common.settled(steps, "e")
    assert out.count() == 6 and len(folders() - before) == 1 and not common._SCOPES
    with pytest.raises(ZeroDivisionError):
        common.settled(lambda: common.materialize(spark.range(3), "x").where(str(1 / 0)), "y")
    assert not common._SCOPES and out.count() == 6


def test_no_silent_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, getConf = "spark://somewhere:7077", staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# op6


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "It's WE'RE ''s a²b ǅ İ ΣΑΣ 日本語 <|endoftext|> a_b 12.5! \x1c x", "don't × ÷ Ünïcode", "<|endoftext|>", "a<|startoftext|> b <|ENDOFTEXT|>", prose(5000)] + [prose(rng.randint(1, 300)) for _ in range(120)]
    tokenizer = Tokenizer.from_file(path)
    assert tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids == [49407]
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    rows = packing.pack_documents(frame(spark, texts).repartition(3), path, 512).collect()
    at = defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(piece) and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["start"] == 512 * r["piece"]
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    for spans in at.values():
        place = 0
        for o, n in sorted(spans):
            assert o == place
            place += n
        assert place <= 512
    assert len(at) <= -(-sum(map(len, ids)) // 512) + 2


def test_local_search_empties_bins():
    for seed in range(20):
        sizes = np.random.default_rng(seed).integers(1, 100, 300)
        bins = packing.pack(sizes, 100)
        assert sorted(sum(bins, [])) == list(range(300)) and all(sizes[b].sum() <= 100 for b in bins)
        assert len(bins) <= max(-(-int(sizes.sum()) // 100), int((sizes > 50).sum())) * 1.08 + 2
    start = [[0, 1], [2, 3], [4]]  # 6+2, 5+3 and 4 in bins of 10: an exchange makes room for the last
    assert len(packing.improve(start, np.array([6, 2, 5, 3, 4]), 10)) == 2


def test_exchanges_try_every_pair():
    step = lambda bins, sizes, cap: packing._step(0, [set(b) for b in bins], np.repeat(range(len(bins)), [len(b) for b in bins]), np.array([int(sizes[b].sum()) for b in bins]), sizes, cap)
    sizes = np.array([40] * 8 + [3, 3] + [994, 5])
    give, take, b = step([list(range(10)), [10, 11]], sizes, 1000)
    assert sorted(give) == [8, 9] and take == (11,) and b == 1
    for _ in range(60):
        sizes = np.array([rng.randint(30, 60) for _ in range(12)] + [rng.randint(20, 400) for _ in range(6)])
        bins, cap = [list(range(12)), [12, 13, 14], [15, 16, 17]], 1000
        fill = [int(sizes[b].sum()) for b in bins]
        cap = max(fill) + rng.randint(1, 15)
        gains = [0]
        for k in (1, 2):
            if fill[k] >= max(1, fill[0]):
                for j in bins[k]:
                    for s in [int(sizes[i]) for i in bins[0]] + [int(sizes[i] + sizes[h]) for i in bins[0] for h in bins[0] if i < h]:
                        gains.append(s - int(sizes[j]) if 0 < s - sizes[j] <= cap - fill[k] else 0)
        found = step(bins, sizes, cap)
        if found is None or found[1]:
            assert max(gains) == (0 if found is None else int(sizes[list(found[0])].sum()) - int(sizes[found[1][0]]))


def test_packing_odd(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert {r["doc_id"] for r in packing.pack_documents(clashing(odd), path).collect()} == {None, *range(8)}
    assert packing.pack_documents(odd.limit(0), path).count() == 0


# op7


def test_tool_calls(spark):
    schemas = {"add": {"a": ("BIGINT", True), "note": ("STRING", False)}}
    calls = [(1, "c1", 1, "add", '{"note": "z", "a": 1}', []), (1, "c2", 2, "add", '{"a":"x","b":2}', ["c1"]), (1, "c3", 3, "add", "{bad", ["c2", "nowhere"]), (1, "c4", 4, "other", "[1]", ["c5"]), (1, "c5", 5, "add", '{"a":2}', ["c4"]), (1, "c1", 9, "add", "{}", None), (2, None, 1, "add", "{}", []), (2, "d", 1, "add", None, None)]
    results = [("c1", 2, 'say "hi"\n'), ("c1", 3, "later"), ("gone", 1, "x"), ("c2", 5, None)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    rs = spark.createDataFrame(results, "call_id string, turn long, content string")
    got = {r["call_id"]: r for r in chat.link_tool_calls(df, rs, schemas).collect()}
    assert [got[c]["level"] for c in ("c1", "c2", "c3", "c4", "c5")] == [0, 1, 2, None, None]
    assert got["c1"]["record"] == '{"arguments":{"a":1,"note":"z"},"id":"c1","name":"add","result":"say \\"hi\\"\\n"}' and got["c1"]["valid"] and got["c1"]["n_results"] == 2
    assert got["c2"]["errors"] == ["a: not BIGINT", "unknown: b"] and json.loads(got["c2"]["record"])["result"] is None
    assert got["c3"]["errors"] == ["arguments: not JSON"] and json.loads(got["c3"]["record"])["arguments"] == {"text": "{bad"}
    assert "after: cycle" in got["c4"]["errors"] and "name: no such tool" in got["c4"]["errors"] and not got["d"]["valid"]
    assert chat.link_tool_calls(df.limit(0), rs.limit(0)).count() == 0


def plain_levels(after):
    """Longest paths; null on or behind a cycle."""
    left = {c: {d for d in deps if d in after} for c, deps in after.items()}
    level = {}
    while True:
        free = [c for c in left if c not in level and all(d in level for d in left[c])]
        if not free:
            return {c: level.get(c) for c in after}
        for c in free:
            level[c] = max((level[d] + 1 for d in left[c]), default=0)


@pytest.mark.parametrize("group", [chat.GROUP, 5])
def test_levels_equal_plain_ones(spark, group):
    """Random dependencies: chains, forks, joins, cycles, other conversations, unknown calls, null conversations."""
    rows, after = [], {}
    for conv in range(12):
        n = rng.randint(1, 12)
        for k in range(n):
            deps = [f"{conv}-{k - 1}"] if k and rng.random() < 0.8 else []
            deps += [f"{conv}-{rng.randrange(n)}"] if rng.random() < 0.15 else []
            deps += [f"{rng.randrange(12)}-{rng.randrange(8)}"] if conv > 7 and rng.random() < 0.3 else []
            deps += [None, "nowhere"] if rng.random() < 0.1 else []
            after[f"{conv}-{k}"] = [d for d in deps if d]
            rows.append((None if conv == 3 else conv, f"{conv}-{k}", deps if deps or k % 2 else None))
    df = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")
    assert {r["call_id"]: r["level"] for r in chat.topological_levels(df, group).collect()} == plain_levels(after)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df, name: written.append(name) or keep(df, name))
    n = 300
    rows = [(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(n)] + [(1, "end", ["c7", f"c{n - 1}", "c100"])]
    got = {r["call_id"]: r["level"] for r in chat.topological_levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>"), 50).collect()}
    assert got == {f"c{k}": k for k in range(n)} | {"end": n} and written.count("led") <= 12
    written.clear()
    got = {r["call_id"]: r["level"] for r in chat.topological_levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()}
    assert got["end"] == n and "led" not in written


def test_calls_odd(spark):
    big = "x" * 300_000
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", big), (1, 1, "user", "again"), (1, 2, "assistant", None), (1, None, "user", ""), (None, 4, "user", None), (1, 5, "tool", "left out"), (2, 0, "assistant", "no call before"), (1, 2, "assistant", "so"), (None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("name", "level", "valid", "call_id", "errors", "after", "n")})
    calls, results = chat.calls_of_turns(df)
    got = {r["call_id"]: r for r in chat.link_tool_calls(calls.withColumns({c: F.lit("x") for c in ("level", "place", "record", "__parsed")}), results.withColumn("valid", F.lit("x"))).collect()}
    assert set(got) == {"1-0", "1-1", "1-1.2", "1-", "-4"} and sorted(got[c]["place"] for c in got if got[c]["conv_id"] == 1) == [1, 2, 3, 4]
    assert json.loads(got["1-1.2"]["record"])["arguments"]["text"] == big and got["-4"]["errors"] == ["text: missing"]
    assert sum(r["n_results"] for r in got.values()) == 1 and chat.link_tool_calls(calls.limit(0), results).count() == 0


# op8


def test_licenses_equal_brute_force(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    far = " ".join(["released", *["x"] * 900, "under", *["y"] * 900, "the", *["z"] * 900, "license"])
    texts = [None, "", bsd, far, "a " * 17 + bsd.replace(" ", "\n"), "released under\nthe license", "released under the a b license", "released under the a license"]
    pool = " ".join(t for _, t in licenses.TEMPLATES).split()
    texts += ["\n".join(" ".join(rng.choices(pool, k=rng.randint(5, 40))) for _ in range(4)) for _ in range(60)]
    texts += ["".join(w + rng.choice(" \n") for w in t.split() if rng.random() > 0.12) for _, t in licenses.TEMPLATES for _ in range(6)]
    texts += ["Released under the MIT License.\nmit license émit license", "x LICENSED under the Apache  License, Version 2.0!", "the general public license general public license"]
    word, got = re.compile(licenses.WORD), {}
    for r in licenses.licenses(frame(spark, texts)).collect():
        words, found = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r["doc_id"]] or "")), {}
        places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert [(p["start"], p["label"]) for p in r["places"]] == places
        for label, t in licenses.TEMPLATES:
            own, width = set(t.split()), int(len(t.split()) / licenses.THRESHOLD + 1e-9)
            share = max((len(own & set(words[i : i + width])) / len(own) for i in range(len(words))), default=0)
            if share >= licenses.THRESHOLD - 1e-9:
                found[label] = max(found.get(label, 0), share)
        got[r["doc_id"]] = r["template_labels"]
        assert r["n_words"] == len(words) and r["template_labels"] == sorted(found) and abs(r["template_score"] - max(found.values(), default=0)) < 1e-12
    assert got[2] == got[4] == ["bsd"] and got[3] == got[0] == [] and got[5] == got[7] == ["mit"]


def test_licenses_odd(spark, odd):
    kept = clashing(odd).withColumns({c: F.lit("x") for c in ("lines", "label", "need", "near")})
    assert licenses.licenses(kept, ("doc_id", "n_words", "places", "near")).count() == odd.count()
    assert licenses.licenses(odd).count() == odd.count() and licenses.licenses(odd.limit(0)).count() == 0


def test_a_notice_thousands_of_times_over(spark):
    """Time follows the length of one text: four times the text, and what it holds, in less than seven times the time."""
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 500)
    took = []
    for n in (1, 500, 2000):
        begun = time.time()
        (r,) = licenses.licenses(frame(spark, [" filler\n".join([mit] * n)])).collect()
        took.append(time.time() - begun)
        assert r["template_labels"] == ["mit"] and r["template_score"] == 1.0 and r["n_words"] == n * len(mit.split()) + n - 1
    assert took[2] - took[0] < 7 * max(took[1] - took[0], 3)


# op9


def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(30, 16))
    x = np.concatenate([centres[g.integers(0, 30, 2500)] + 0.3 * g.normal(size=(2500, 16)), np.repeat(centres[:1], 300, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] * 16), (9004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vectors.neighbours(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    asked = [i for i in range(len(x)) if i % 100 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hits += len({i for i, _ in got[q]} & set(best.tolist()))
        assert len(got[q]) == 10 and all(d[i] == s for i, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hits / (10 * len(asked)) >= 0.9


@pytest.mark.parametrize("clusters", [300, 0])
def test_recall_on_many_vectors(spark, clusters):
    """Tight clusters, in which a walk may end at the wrong one, and no clusters at all."""
    g = np.random.default_rng(17)
    x = g.normal(size=(30_000, 32)) * (0.2 if clusters else 1.0)
    if clusters:
        x += g.normal(size=(clusters, 32))[g.integers(0, clusters, len(x))]
    x = x.astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))}))
    got = defaultdict(set)
    for r in vectors.neighbours(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits, x = 0, x.astype(np.float64)
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argpartition(d, 10)[:10].tolist()))
    assert hits / 3000 >= 0.9


def test_vectors_assigned_as_by_a_plain_loop():
    g = np.random.default_rng(8)
    c, x = g.normal(size=(60, 8)), g.normal(size=(300, 8))
    want = []
    for i in range(300):
        d = np.sqrt(((c - x[i]) ** 2).sum(1))
        o = np.argsort(d, kind="stable")[: 2 * vectors.COPIES]
        taken = [o[0]]
        for j in o[1:]:
            if d[j] <= (1 + vectors.REPLICATE) * d[o[0]] and len(taken) < vectors.COPIES and (((c[taken] - c[j]) ** 2).sum(1) > d[j] ** 2).all():
                taken.append(j)
        want += [(i, int(j)) for j in taken]
    assert list(zip(*[v.tolist() for v in vectors.lists_of(x, c)], strict=True)) == want and len(want) > 300


def test_walk_finds_the_nearest_centroids():
    g = np.random.default_rng(5)
    for n in (1, 3, 9, 400):
        c, q = g.normal(size=(n, 6)), g.normal(size=(70, 6))
        ids, d = vectors.walk(q, c, *vectors.graph(c), min(n, 40))
        true = np.sqrt(((c[None] - q[:, None]) ** 2).sum(2))
        best = np.argsort(true, axis=1)[:, :10]
        found = np.isfinite(d)
        assert all(len(set(i[f].tolist())) == f.sum() for i, f in zip(ids, found, strict=True)) and np.allclose(d[found], np.take_along_axis(true, ids, 1)[found])
        assert np.mean([len(set(b.tolist()) & set(i[f].tolist())) / len(b) for b, i, f in zip(best, ids, found, strict=True)]) >= 0.95
        row, lists = vectors.probes_of(q, c, *vectors.graph(c), np.full(n, 3), 0.1, 8, 20)
        assert all((row == i).sum() * 3 >= min(20, 3 * n) for i in range(70))


def test_repeated_ids_and_other_lengths(spark):
    g = np.random.default_rng(9)
    x = g.normal(size=(300, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[0] + 1e-3 * g.normal(size=6)).tolist()) for _ in range(400)]
    rows += [(1000 + i, g.normal(size=3).tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("list", "block", "bundle", "score")})
    got = defaultdict(list)
    for r in vectors.neighbours(df, df.where("vec_id in (0, 1000)")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q, own in ((0, [r for r in rows if len(r[1]) == 6]), (1000, [r for r in rows if len(r[1]) == 3])):
        at = np.array(next(v for i, v in own if i == q))
        best = {}
        for i, v in own:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(v) - at) ** 2).sum())))
        want = sorted(((s, i) for i, s in best.items()))[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [s for s, _ in want])


def test_walk_to_all_centroids_costs_their_distances_once():
    g = np.random.default_rng(6)
    c, q = g.normal(size=(3000, 16)), g.normal(size=(200, 16))
    c[7] = c[8] = q[0]
    links, entry = vectors.graph(c)
    begun = time.time()
    ids, d = vectors.walk(q, c, links, entry, len(c))
    assert time.time() - begun < 10
    true = np.sqrt(((c[None] - q[:, None]) ** 2).sum(2))
    assert (ids == np.argsort(true, axis=1, kind="stable")).all() and (d == np.sort(true, axis=1)).all()
    ids, d = vectors.walk(q, c, links, entry, 100)  # by the graph: fewer are measured
    assert np.mean([len({*i[:10]} & {*t[:10]}) for i, t in zip(ids, np.argsort(true, axis=1), strict=True)]) > 9.5


def test_repeated_ids_do_not_hide_others_of_a_list(spark):
    g = np.random.default_rng(10)
    x = g.normal(size=(40, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, (x[0] + 1e-3 * g.normal(size=4)).tolist()) for _ in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")  # few enough for one list
    got = vectors.neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    near = {i: min(float(np.sqrt(((np.array(v) - x[0]) ** 2).sum())) for j, v in rows if j == i) for i in range(1, 40)}
    want = sorted((s, i) for i, s in near.items())[:10]
    assert [(r["score"], r["vec_id"]) for r in got] == want and [r["rank"] for r in got] == list(range(1, 11))


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_nearest_of_lists_against_brute_force(monkeypatch, far):
    """Ties, copies in several lists, lists not asked for, and vectors far from the origin, in small pieces."""
    monkeypatch.setattr(vectors, "PIECE", 16)
    monkeypatch.setattr(vectors, "AT_ONCE", 64)
    g = np.random.default_rng(11)
    x = far + g.integers(0, 4, (300, 5)) / 64
    lists = g.integers(0, 6, 300).astype(np.int32)
    both = np.r_[np.arange(300), np.arange(0, 300, 5)]
    of = np.r_[lists, (lists[::5] + 1) % 6].astype(np.int32)
    kind = pa.list_(pa.float64())
    held = pa.table({"list": pa.array(of), "vec_id": pa.array(both), "embedding": pa.array(x[both].tolist(), kind)})
    asked = [sorted(g.choice(6, int(g.integers(1, 7)), replace=False).tolist()) for _ in range(30)]
    got = vectors._nearest(10, held, pa.table({"vec_id": pa.array(np.arange(30)), "lists": pa.array(asked, pa.list_(pa.int32())), "embedding": pa.array(x[:30].tolist(), kind)}))
    found = sorted(zip(got["query_id"].to_pylist(), got["score"].to_pylist(), got["vec_id"].to_pylist(), strict=True))
    want = []
    for i, some in enumerate(asked):
        ids = {int(b) for b, v in zip(both, of, strict=True) if v in some} - {i}
        want += [(i, *p) for p in sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in ids)[:10]]
    assert found == want


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [4.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1, 0.0), (0, 2, 3, 3.0)]
    assert vectors.neighbours(df.where("vec_id = 2"), df).count() == 0 and vectors.neighbours(df.limit(0), df).count() == 0


# op10


def test_quality_statistics(spark):
    texts = [prose(rng.randint(0, 60)) + "\n" + " ".join(["la"] * rng.randint(0, 30)) + "\nx | y # z\n\nx | y # z" for _ in range(60)] + ODD
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts), ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        grams = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        count = Counter(grams)
        covered = {j + k for j, g in enumerate(grams) if count[g] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (got[i]["base_failed"] and got[i]["kept"])


def test_junk_goes_and_prose_stays(spark):
    clean = [prose(rng.randint(60, 300)) for _ in range(200)]
    junk = [" ".join(w + rng.choice(["###", "$$$"]) for w in prose(100).split()) for _ in range(12)] + [prose(30).upper() + "!! " * 30 + " ".join(prose(100).upper().split()) for _ in range(8)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(frame(spark, clean + junk), ["doc_id"]).collect()}
    assert all(got[i] for i in range(200)) and sum(not got[i] for i in range(200, 220)) >= 15


def plain_posteriors(votes):
    """Expectation-maximisation document by document: P(good) of each tuple of votes."""
    rules, n = len(votes[0]), len(votes)
    good = [(0.9 if sum(v) > 0 else 0.1) * (0.5 if -1 in v else 1.0) for v in votes]
    for _ in range(200):
        law = {}
        for j in range(rules):
            for side in (0, 1):
                mass = {v: 0.1 for v in (-1, 0, 1)}
                for doc, g in zip(votes, good, strict=True):
                    mass[doc[j]] += g if side else 1 - g
                total = sum(mass.values())
                law[j, side] = {v: m / total for v, m in mass.items()}
            for v, wrong in ((-1, law[j, 1][-1] > law[j, 0][-1]), (1, law[j, 1][1] < law[j, 0][1])):
                if wrong:
                    law[j, 0][v] = law[j, 1][v] = (law[j, 0][v] + law[j, 1][v]) / 2
            for side in (0, 1):
                total = sum(law[j, side].values())
                floored = {v: max(m / total, quality.LEAST) for v, m in law[j, side].items()}
                law[j, side] = {v: m / sum(floored.values()) for v, m in floored.items()}
        share = min(0.95, max(0.05, sum(good) / n))
        new = []
        for doc in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(law[j, 1][v] / law[j, 0][v]) for j, v in enumerate(doc))
            new.append(1 / (1 + math.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        good = new
        if done:
            break
    return good


def test_posteriors_equal_plain_ones(spark):
    texts = [prose(rng.randint(5, 200)) for _ in range(120)] + [" ".join(w + rng.choice(["###", "$", "!!"]) for w in prose(60).split()) for _ in range(25)]
    texts += ["\n".join([prose(3)] * rng.randint(5, 30)) for _ in range(15)] + [prose(30).upper() for _ in range(12)] + [None, ""]
    rows = quality.quality(frame(spark, texts), ["doc_id"])
    rules = quality.rules()
    got = rows.select("doc_id", "p_good", "kept", "base_failed", *[v.alias(k) for k, v in rules.items()]).orderBy("doc_id").collect()
    want = plain_posteriors([tuple(r[k] for k in rules) for r in got])
    assert all(abs(r["p_good"] - w) < 1e-6 for r, w in zip(got, want, strict=True)) and all(r["kept"] == (not r["base_failed"] and w >= 0.5) for r, w in zip(got, want, strict=True))
    assert 10 < sum(not r["kept"] for r in got) < 120


def test_quality_odd(spark, odd):
    out = quality.keep_good(clashing(odd))
    assert out.columns == clashing(odd).columns and sorted(r["doc_id"] for r in out.collect()) == [6, 6, 7]
    assert quality.keep_good(odd.limit(0)).count() == 0


# pipeline


def test_pipeline(spark):
    base = [prose(rng.randint(30, 200)) for _ in range(80)]
    texts = base + base[:10] + [base[20] + " more", "short", None, "write to ann.lee@example.com " + prose(40)]
    docs = frame(spark, texts, [f"s{i % 3}" for i in range(len(texts))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "near_duplicates":
            assert {r["doc_id"] for r in docs.collect()} == {*range(80), 93}
        if name == "personal_data":
            assert docs.where("text like 'write to <email> %'").count() == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == docs.count()


def test_checksums_are_of_the_base(spark, tmp_path):
    frame(spark, ["mail a@b.co now", None]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in pii.op2_personal_data(spark, str(tmp_path)).collect()}
    assert rows[0]["base_sha256"] == hashlib.sha256(b"email:5:11").hexdigest() and rows[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pieces_that_come_again_stay_known(monkeypatch):
    """A full cache lets go of pieces that came once; those that every slice has are encoded once, with the same ids."""
    monkeypatch.setattr(packing, "CACHE", 60)
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    asked = []
    real = own.tokenizer
    own.tokenizer = SimpleNamespace(encode=lambda text, **k: asked.append(text) or real.encode(text, **k))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(12):
        text = " ".join(["house", "garden", *[f"x{letters[k]}{letters[i]}" for i in range(20)]])
        (ids,) = own.ids_of([text])
        assert ids == np.array(real.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(own.known) <= 60
    words = " ".join(asked).split()
    assert words.count("house") == words.count("garden") == 1
