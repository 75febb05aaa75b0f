"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

All of it is DataFrame expressions. Matches of a pattern are found as `regexp_extract_all` with what
`split` leaves between them, so running sums of lengths give their places in code points.

The battery looks at candidate tokens (runs of TOKEN). An encoding is inferred from the symbols (hex,
base32, lower-case letters and digits, base64). Under "random in that alphabet", three statistics are
close to standard normal: chi-squared uniformity (Wilson-Hilferty), the runs test on the upper half of
the alphabet, and lag-1 serial correlation; their squares add up to a chi-squared with 3 degrees of
freedom, and a token beyond BATTERY is not random. Under "ordinary text", the log-likelihood ratio of
the alphabet's uniform law against letter frequencies has a known mean and deviation; its z-value is the
evidence against text. Short tokens have little evidence, so the false-discovery rate is controlled
(Benjamini-Hochberg over distinct tokens, on a histogram of z of fixed size) in strata of length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group of which LEAST is asked, least length). Runs that are too short can be left to
#: the pattern where a shorter start in the same run is shorter still.
BASE = {"assign": (ASSIGN, 2, 12), "access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
KINDS = (*BASE, "random")
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
FDR = 0.001
#: Chi-squared with 3 degrees of freedom, upper 0.1 %.
BATTERY = 16.27
STRATA = (16, 20, 24, 32, 48, 64)
Z_STEP = 0.05
Z_MOST = 40.0
#: Letter frequencies of Latin-script text in percent, a to z (fixed values, rounded).
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding: (pattern of a whole token, alphabet in order)
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef"),
    "base32": (r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    "lower": (r"^[a-z0-9]+$", _LOWER + _DIGITS),
    "base64": (r".", _UPPER + _LOWER + _DIGITS + "+/"),
}


def _text_model(alphabet: str) -> list[float]:
    """Probability of each symbol of an alphabet in ordinary text: letters by frequency, most of them
    lower case where there is a choice, digits and signs seldom."""
    mixed = "a" in alphabet and "A" in alphabet
    weight = []
    for c in alphabet:
        if c.isalpha():
            weight.append(LETTERS[ord(c.lower()) - 97] * (0.06 if mixed and c.isupper() else 1.0))
        else:
            weight.append(0.3)
    return [w / sum(weight) for w in weight]


def evidence(alphabet: str) -> tuple[list[float], float, float]:
    """(log ratio of each symbol, its mean and deviation in ordinary text)."""
    q = _text_model(alphabet)
    log = [math.log(1 / len(alphabet) / x) for x in q]
    mean = sum(x * y for x, y in zip(q, log, strict=True))
    return log, mean, math.sqrt(sum(x * (y - mean) ** 2 for x, y in zip(q, log, strict=True)))


def uniformity_in_text(alphabet: str) -> tuple[float, float, float]:
    """(k, sum of squares, sum of cubes) of the symbols' probabilities in ordinary text, k being their number.
    Of n symbols, equal pairs among them have a mean and variance by these, and with them chi-squared."""
    q = _text_model(alphabet)
    return float(len(q)), sum(x**2 for x in q), sum(x**3 for x in q)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct(gap, len, hit)>: characters before each match, its length, and the asked group."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, p, F.lit(0))
    hits = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    zipped = F.zip_with(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len")), hits, lambda a, b: F.struct(a["gap"].alias("gap"), a["len"].alias("len"), b.alias("hit")))
    none = F.array().cast("array<struct<gap:int,len:int,hit:string>>")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def with_tests(rows: DataFrame) -> DataFrame:
    """rows(token, ...) with `battery`, the sum of squares, and two z-values of evidence against ordinary
    text, large for random tokens: `z_battery` of the battery, `z_ratio` of the likelihood ratio. What it
    needs of memory follows the length of the longest token."""
    names = list(ENCODINGS)
    which = F.lit(names[-1])
    for name in reversed(names[:-1]):
        which = F.when(F.col("token").rlike(ENCODINGS[name][0]), name).otherwise(which)
    body = F.translate(F.rtrim(F.translate("token", "=", " ")), "-_", "+/")
    rows = rows.withColumn("enc", which).withColumn("body", F.when(F.col("enc") == "hex", F.lower(body)).otherwise(body))

    def per(f) -> Column:  # noqa: ANN001
        out = F.lit(f(names[-1]))
        for name in names[:-1]:
            out = F.when(F.col("enc") == name, F.lit(f(name))).otherwise(out)
        return out

    alphabet, k = per(lambda e: ENCODINGS[e][1]), per(lambda e: float(len(ENCODINGS[e][1])))
    rows = rows.withColumn("alphabet", alphabet).withColumn("k", k).withColumn("logs", per_array(names))
    place = lambda c: F.call_function("instr", F.col("alphabet"), c)
    rows = rows.withColumn("v", F.transform(F.filter(F.split("body", ""), lambda c: c != ""), place))
    n = F.size("v").cast("double")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    # counts of all symbols in one pass over the symbols that occur
    squares = total(F.array_distinct("v"), lambda x: F.pow(F.length("body") - F.length(F.replace("body", F.substring("alphabet", x, F.lit(1)), F.lit(""))), F.lit(2.0)))
    middle = (F.col("k") + 1) / 2
    after, before = F.slice("v", F.lit(2), F.size("v")), F.slice("v", F.lit(1), F.size("v") - 1)
    upper = total("v", lambda x: F.when(x > middle, 1.0).otherwise(0.0))
    changes = F.aggregate(F.zip_with(after, before, lambda a, b: ((a > middle) != (b > middle)).cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    lagged = F.aggregate(F.zip_with(after, before, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda acc, x: acc + x)
    spread = total("v", lambda x: (x - middle) * (x - middle))
    rows = rows.select("*", n.alias("n"), squares.alias("sq"), upper.alias("up"), changes.alias("ch"), lagged.alias("lagged"), spread.alias("spread"), total("v", lambda x: F.element_at("logs", x)).alias("llr"))
    df = F.col("k") - 1
    chi = F.col("k") * F.col("sq") / F.col("n") - F.col("n")
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    pairs = 2 * F.col("up") * (F.col("n") - F.col("up"))
    expected = pairs / F.col("n") + 1
    variance = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    z_runs = F.when(variance > 0, (F.col("ch") + 1 - expected) / F.sqrt(variance)).otherwise(F.sqrt("n"))
    z_serial = F.when(F.col("spread") > 0, F.col("lagged") / F.col("spread") * F.sqrt("n")).otherwise(F.sqrt("n"))
    battery = F.pow(F.greatest(z_chi, F.lit(0.0)), F.lit(2)) + z_runs * z_runs + z_serial * z_serial
    z = (F.col("llr") - F.col("n") * per(lambda e: evidence(ENCODINGS[e][1])[1])) / (per(lambda e: evidence(ENCODINGS[e][1])[2]) * F.sqrt("n"))
    # in text, chi-squared is k / n * (n + 2 * equal pairs) - n; the chi-squared whose z is the battery's root
    # bounds the token's own, so the p-value allows for what the other two tests add
    pairs_of, two, three = F.col("n") * (F.col("n") - 1) / 2, per(lambda e: uniformity_in_text(ENCODINGS[e][1])[1]), per(lambda e: uniformity_in_text(ENCODINGS[e][1])[2])
    mean = F.col("k") / F.col("n") * (F.col("n") + 2 * pairs_of * two) - F.col("n")
    spread_of = pairs_of * two * (1 - two) + F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) * (three - two * two)
    deviation = 2 * F.col("k") / F.col("n") * F.sqrt(F.greatest(spread_of, F.lit(1e-9)))
    bound = df * F.pow(1 - 2 / (9 * df) + F.sqrt("battery") * F.sqrt(2 / (9 * df)), F.lit(3.0))
    rows = rows.withColumn("battery", battery)
    return rows.withColumn("z_ratio", z).withColumn("z_battery", (mean - bound) / deviation).drop("enc", "body", "alphabet", "k", "logs", "v", "n", "sq", "up", "ch", "lagged", "spread", "llr")


def per_array(names: list[str]) -> Column:
    arrays = {e: F.array(*[F.lit(x) for x in evidence(ENCODINGS[e][1])[0]]) for e in names}
    out = arrays[names[-1]]
    for e in names[:-1]:
        out = F.when(F.col("enc") == e, arrays[e]).otherwise(out)
    return out


def _histogram_cuts(rows: list, fdr: float = FDR) -> dict[int, float]:
    """Least z that is a discovery in each stratum, from (stratum, bin, n); infinite if there is none."""
    cuts = {}
    for s in range(len(STRATA)):
        own = sorted(((r["bin"], r["n"]) for r in rows if r["stratum"] == s), reverse=True)
        total, so_far, cuts[s] = sum(n for _, n in own), 0, math.inf
        for b, n in own:
            so_far += n
            z = b * Z_STEP
            if total * math.erfc(z / math.sqrt(2)) <= fdr * so_far:  # twice the upper tail: the lesser of two p-values
                cuts[s] = z
    return cuts


def secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """`keep` columns and `found`, array<struct(start, kind_no, end)> by start, for every row of docs.

    kind_no counts KINDS; end is exclusive. Tokens that the battery takes for random are added where no
    fixed pattern has matched. Null and empty texts have none; long texts are read whole; repeated rows have
    the same; tokens count once for the false-discovery rate however often they occur, and of equal z all or
    none are discoveries. An empty table gives no rows; other columns are not read.
    """
    named = [f"__keep{i}" for i in range(len(keep))]
    found = _secrets(docs.select(*[F.col(c).alias(n) for c, n in zip(keep, named, strict=True)], F.col("text")), tuple(named), fdr)
    return found.toDF(*keep, "found")


def _secrets(docs: DataFrame, keep: tuple[str, ...], fdr: float) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    arrays = [matches(text, p, g).alias(f"m{i}") for i, (p, g, _) in enumerate(BASE.values())] + [matches(text, TOKEN).alias("m3")]
    rows = materialize(docs.select(*keep, "text").select(*keep, F.monotonically_increasing_id().alias("__uid"), *arrays), "matches")
    tagged = lambda i: F.transform(f"m{i}", lambda x, j: F.struct(F.lit(i).alias("kind_no"), j.alias("place"), x["gap"].alias("gap"), x["len"].alias("len"), x["hit"].alias("token")))
    one = F.concat(*[tagged(i) for i in range(len(KINDS))])
    each = rows.select("__uid", F.inline(one))
    end = F.sum(F.col("gap").cast("long") + F.col("len")).over(Window.partitionBy("__uid", "kind_no").orderBy("place"))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).drop("gap", "len", "place")
    each = materialize(each.where((F.col("kind_no") != 0) | (F.length("token") >= BASE["assign"][2])), "places")

    size = F.length("token")
    stratum = F.lit(0)
    for i, at in enumerate(STRATA[1:], 1):
        stratum = F.when(size >= at, i).otherwise(stratum)
    tokens = each.where(F.col("kind_no") == 3).groupBy("token").agg(F.lit(1).alias("one"))
    tested = materialize(with_tests(tokens).select("token", F.greatest("z_ratio", "z_battery").alias("z"), "battery", stratum.alias("stratum")), "tested")
    bins = F.floor(F.greatest(F.lit(-1.0), F.least(F.col("z"), F.lit(Z_MOST))) / Z_STEP).cast("int")
    cuts = _histogram_cuts(tested.groupBy("stratum", bins.alias("bin")).agg(F.count("*").alias("n")).collect(), fdr)  # a table of fixed size
    discovery = F.lit(False)
    for i, cut in cuts.items():
        discovery = discovery | ((F.col("stratum") == i) & (F.col("z") >= float(cut))) if cut < math.inf else discovery
    good = materialize(tested.where(discovery & (F.col("battery") <= BATTERY)).select("token"), "random-tokens")
    random = join_checked(each.where(F.col("kind_no") == 3), good, "token", "left_semi")
    spans = each.where(F.col("kind_no") != 3).unionByName(random).groupBy("__uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("all"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint>>")
    out = rows.select(*keep, "__uid").join(spans, "__uid", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda s: s["kind_no"] != 3)
    free = F.filter("all", lambda s: (s["kind_no"] != 3) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return out.withColumn("base", base).withColumn("found", free).select(*keep, "found")


def _said(spans: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    n = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    base = F.filter("found", lambda s: s["kind_no"] != 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(base, KINDS), 256).alias("base_sha256"), _said(F.col("found"), KINDS).alias("spans"))
