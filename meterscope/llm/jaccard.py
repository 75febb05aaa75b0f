"""N-gram Jaccard self-join of documents by chosen paths, and near-duplicate removal built on it.

1. One pass over the texts takes the set of 5-word shingles (hashed to 64 bits) of every document, a
   128-bit fingerprint of the set, a 64-byte sketch, and the set's paths: in each of `runs` runs a
   token is chosen with probability 1 / (threshold * set size), by a hash of token and run; below a
   chosen token the set is split again on tokens chosen by a hash of token and path, to depth 3.
   Two sets of similarity >= threshold choose a shared path of depth d with the probability p(d) of
   `found`; `runs` is the least number with which the recall reaches `recall` at depth 3, what the sketches
   of step 3 may miss (`sketch_loss`) being taken off first.
2. Documents with one fingerprint are one representative with a number of copies.
3. Buckets of sets that share a path: up to SMALL sets are compared by brute force on their sketches;
   larger ones are split on the next level; what is still larger at depth 3 is linked as a whole.
   The links made here only say what has to be compared: components of them are clusters.
4. Within a cluster every pair of sets whose sizes allow it is compared exactly, in blocks of BLOCK sets of
   about one size (g such sets make g/BLOCK squared tasks' work, never rows): each block pair gives, for each
   set, how many documents it links to and a label; components of the labels are the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, join_checked, materialize, own_names, settled, table
from .textops import mix, shingle_sets, slices

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
SMALL = 48
BLOCK = 256
SKETCH = 64
DEPTH = 3
#: Bytes of text, or of sets, that a task holds at once, about.
SLICE = 4 << 20
#: Tokens of the sets of a block, about: sets of long texts are fewer to a block.
BLOCK_TOKENS = 1 << 20
#: A pair whose sketches agree in a lesser share of bins is not compared; of fewer than SKETCH_BINS filled
#: bins no sketch is asked.
SKETCH_LEAST = 0.4
SKETCH_BINS = 32


def found(threshold: float, depth: int) -> float:
    """Least probability that one run puts two sets of similarity >= threshold in one bucket of that depth."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)  # at least one shared chosen token is expected when sizes differ most
    return p


def sketch_loss(threshold: float, bins: int = SKETCH_BINS, least: float = SKETCH_LEAST) -> float:
    """Probability that the sketches of two sets of that similarity agree in less than `least` of `bins`
    bins, each agreeing with the probability `threshold`; more bins or a higher similarity lose less."""
    return sum(math.comb(bins, k) * threshold**k * (1 - threshold) ** (bins - k) for k in range(math.ceil(least * bins)))


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Least number of runs that find a pair of that similarity with probability `recall`, sketches included."""
    lost = 1 - recall - sketch_loss(threshold)
    if lost <= 0:
        raise ValueError("the sketches alone lose more than the recall asked for allows")
    return math.ceil(math.log(lost) / math.log(1 - found(threshold, DEPTH)))


def _odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _limit(p: float) -> np.uint64:
    return np.uint64(min(int(p * 2.0**64), 2**64 - 1))


def _children(tokens: np.ndarray, keys: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(parent's number, child key) for the tokens chosen below each path key."""
    parent, child = [], []
    step = max(1, (1 << 18) // max(len(tokens), 1))  # a matrix of 2 MB, so that it stays in the processor's cache
    for at in range(0, len(keys), step):
        own = keys[at : at + step]
        h = mix(tokens[None, :] ^ own[:, None])
        i, j = np.nonzero(h < limit)
        parent.append(i + at)
        child.append(mix(tokens[j] + own[i] * np.uint64(0xC2B2AE3D27D4EB4F)))
    return (np.concatenate(parent), np.concatenate(child)) if parent else (np.zeros(0, int), np.zeros(0, np.uint64))


def signature(s: np.ndarray, runs: int, threshold: float) -> tuple[bytes, bytes, list[np.ndarray]]:
    """(fingerprint, sketch, [level-1 keys, level-2 parents, level-2 keys, level-3 parents, level-3 keys])."""
    fp = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(s + np.uint64(0x14057B7EF767814F)).sum()], np.uint64).tobytes()
    t = mix(s * np.uint64(0xA24BAED4963EE407))
    bins = (t >> np.uint64(58)).astype(int)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(t, kind="stable")
    first = np.r_[True, np.diff(bins[order]) > 0]
    least[bins[order][first]] = t[order][first]
    sketch = np.where(least == np.iinfo(np.uint64).max, 0, 1 + (mix(least) % np.uint64(255))).astype(np.uint8).tobytes()
    limit = _limit(1 / (threshold * len(s)))
    keys = []
    for r, odd in enumerate(_odd(runs)):
        h = mix(t * odd)
        keys.append(mix(s[h < limit] ^ odd ^ np.uint64(r)))
    one = np.concatenate(keys)
    p2, two = _children(t, one, limit)
    p3, three = _children(t, two, limit)
    return fp, sketch, [one, one[p2], two, two[p3], three]


_LEVELS = "k1 array<long>, p2 array<long>, k2 array<long>, p3 array<long>, k3 array<long>"


def _signatures(runs: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "text", SLICE):
            size, fps, sketches, levels = [], [], [], [[] for _ in range(5)]
            for s in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), SHINGLE):
                size.append(len(s))
                fp, sketch, keys = signature(s, runs, threshold) if len(s) else (None, None, [np.zeros(0, np.uint64)] * 5)
                fps.append(fp)
                sketches.append(sketch)
                for held, k in zip(levels, keys, strict=True):
                    held.append(k.view(np.int64))
            arrays = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in held])], pa.int32()), pa.array(np.concatenate(held) if held else [], pa.int64())) for held in levels]
            columns = [part.column("doc_id"), part.column("key"), pa.array(size, pa.int64()), pa.array(fps, pa.binary()), pa.array(sketches, pa.binary()), *arrays]
            yield from pa.table(columns, names=["doc_id", "key", "size", "fp", "sketch", "k1", "p2", "k2", "p3", "k3"]).combine_chunks().to_batches()


def _paths(reps: DataFrame, hot: list[DataFrame], limit: int = BROADCAST_ROWS) -> DataFrame:
    """(k, uid) of the paths of the next level below those of `hot`, the large buckets of each level so far."""
    if not hot:
        return reps.select(F.explode("k1").alias("k"), "uid")
    parent, child = f"p{len(hot) + 1}", f"k{len(hot) + 1}"
    if hot[-1].limit(limit + 1).count() > limit:
        pairs = F.explode(F.arrays_zip(F.col(parent).alias("p"), F.col(child).alias("k"))).alias("x")
        return reps.select(pairs, "uid").select("x.p", "x.k", "uid").join(hot[-1].withColumnRenamed("k", "p"), "p", "left_semi").select("k", "uid")
    keys = np.sort(np.asarray(hot[-1].toArrow().column("k"), np.int64))  # at most `limit` keys
    shared = reps.sparkSession.sparkContext.broadcast(keys)
    return reps.select("uid", F.col(parent).alias("p"), F.col(child).alias("k")).mapInArrow(partial(_below, shared), "k long, uid long")


def _below(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """Paths whose parent is one of the shared keys."""
    keys = shared.value
    for batch in batches:
        parents, children = batch.column("p"), batch.column("k")
        p, k = np.asarray(parents.flatten(), np.int64), np.asarray(children.flatten(), np.int64)
        uid = np.repeat(np.asarray(batch.column("uid"), np.int64), np.diff(np.asarray(parents.offsets)))
        at = np.searchsorted(keys, p)
        good = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == p) if len(keys) else np.zeros(len(p), bool)
        if good.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[good]), pa.array(uid[good])], names=["k", "uid"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, uid, sketch) come sorted by k; gives a link to the least uid of each part of a bucket
    whose sketches agree."""
    held = None
    for batch in _with_end(batches):
        if batch is not None:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
        if held is None or not held.num_rows:
            continue
        k = held.column("k").to_numpy()
        upto = held.num_rows if batch is None else int(np.searchsorted(k, k[-1]))  # the last bucket may go on
        if not upto:
            continue
        part, held = held.slice(0, upto), held.slice(upto)
        k, uid = k[:upto], part.column("uid").to_numpy()
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        label = uid.copy()
        pairs = []
        for d in range(1, upto):
            i = np.flatnonzero(k[d:] == k[:-d])
            if not len(i):
                break
            a, b = sketch[i], sketch[i + d]
            either = ((a > 0) | (b > 0)).sum(1)
            same = ((a == b) & (a > 0)).sum(1)
            good = i[(same >= SKETCH_LEAST * either) | (either < SKETCH_BINS)]  # small sets have too few bins to tell
            pairs.append(np.c_[good, good + d])
        if pairs:
            p = np.concatenate(pairs)
            while len(p):
                low = np.minimum(label[p[:, 0]], label[p[:, 1]])
                before = label.copy()
                np.minimum.at(label, p[:, 0], low)
                np.minimum.at(label, p[:, 1], low)
                if (label == before).all():
                    break
            apart = label != uid
            if apart.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[apart]), pa.array(label[apart])], names=["u", "v"])


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "text", SLICE):
            sets = shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), SHINGLE)
            fps = [signature_fp(s) if len(s) else None for s in sets]
            yield from pa.table([pa.array(fps, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "tokens"]).combine_chunks().to_batches()


def signature_fp(s: np.ndarray) -> bytes:
    return np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), mix(s + np.uint64(0x14057B7EF767814F)).sum()], np.uint64).tobytes()


def compare(sets: list[np.ndarray], threshold: float, width: int = 1 << 13) -> np.ndarray:
    """Boolean matrix of all pairs with Jaccard similarity >= threshold (a set with itself: no)."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size.astype(int))
    column = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    row, col = row[shared], column[inverse[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float64)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((n, width), np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        both += x @ x.T
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _compare_blocks(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, low, high, part, uid, copies, tokens) come sorted by cluster, low, high."""
    held: list[tuple] = []
    key = None

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        part = np.array([h[0] for h in held])
        uid = np.array([h[1] for h in held], np.int64)
        copies = np.array([h[2] for h in held], np.int64)
        linked = compare([np.frombuffer(h[3], np.uint64) for h in held], threshold)
        if key[1] != key[2]:  # two blocks: pairs across them only, those inside have their own task
            linked &= part[:, None] != part[None, :]
        label = uid.copy()
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(label), pa.array((linked * copies[None, :]).sum(1))], names=["uid", "label", "links"])

    for batch in batches:
        for piece in slices(pa.Table.from_batches([batch]), "tokens", SLICE):
            for r in piece.to_pylist():
                now = (r["cluster"], r["low"], r["high"])
                if now != key:
                    yield from flush()
                    held, key = [], now
                held.append((r["part"], r["uid"], r["copies"], r["tokens"]))
    yield from flush()


def row_key() -> Column:
    """What only rows of one doc_id and text have in common."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string"))


def row_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, class_id, class_key, n_links, n_copies, n_shingles) for every row of docs(doc_id, text).
    key is row_key(), class_key that of the class's least row, null ids being last; null without words."""
    runs = runs_for(recall, threshold)
    light = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", row_key())
    signed = materialize(light.mapInArrow(partial(_signatures, runs, threshold), f"doc_id long, key string, size long, fp binary, sketch binary, {_LEVELS}"), "signatures")
    with_set = signed.where("fp is not null")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal for all copies
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("rep")
    reps = with_set.groupBy("fp").agg(least_row, F.count("*").alias("copies"), *[first(c) for c in ("size", "sketch", "k1", "p2", "k2", "p3", "k3")])
    reps = materialize(reps.withColumn("uid", F.monotonically_increasing_id()), "representatives")

    members, links, hot = [], [], []
    for level in range(DEPTH):
        r = _paths(reps, hot)
        sizes = r.groupBy("k").agg(F.count("*").alias("n"), F.min("uid").alias("least"), F.max("uid").alias("most")).where("least < most")
        sizes = materialize(sizes, f"sizes{level}")
        members.append(r.join(sizes.where(F.col("n") <= SMALL).select("k"), "k"))  # keys are as many as rows: never a broadcast by intent
        large = sizes.where(F.col("n") > SMALL)
        hot.append(large.select("k"))
        if level == DEPTH - 1:
            links.append(join_checked(r, large.select("k", "least"), "k").select(F.col("uid").alias("u"), F.col("least").alias("v")))
    small = members[0].unionByName(members[1]).unionByName(members[2])
    small = small.join(reps.select("uid", "sketch"), "uid").select("k", "uid", "sketch")
    near = small.repartition("k").sortWithinPartitions("k").mapInArrow(_bucket_links, "u long, v long")
    clusters = connected_components(near.union(links[0]), "clusters")

    compared = materialize(_compared(light, reps, clusters, threshold), "compared")
    links_of = compared.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = connected_components(compared.select(F.col("uid").alias("u"), F.col("label").alias("v")), "classes").select(F.col("node").alias("uid"), "component")

    known = reps.select("uid", "fp", "rep", "copies").join(links_of, "uid", "left").join(classes, "uid", "left")
    known = known.withColumn("component", F.coalesce("component", "uid"))
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = join_checked(known, materialize(least.select("component", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("class_key")), "least-rows"), "component")
    known = materialize(known.select("fp", "class_id", "class_key", "copies", F.coalesce("links", F.lit(0)).alias("links")), "classes-of-sets")
    out = join_checked(signed.select("doc_id", "key", "size", "fp").where("fp is not null"), known, "fp")
    out = out.select("doc_id", "key", "class_id", "class_key", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("size").alias("n_shingles"))
    alone = signed.where("fp is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "size")
    return out.union(alone)


def _compared(light: DataFrame, reps: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(uid, label, links) of every block pair: the sets of a cluster are dealt to bands of size, a band being
    1 / threshold wide, and bands to blocks of about BLOCK sets and at most about BLOCK_TOKENS tokens; only sets of the same or the next band can be
    similar enough, so only their blocks meet. Tokens are taken anew from the representatives' texts."""
    in_cluster = clusters.join(reps.select(F.col("uid").alias("node"), "fp", "rep", "copies", "size"), "node")
    band = F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).cast("int")
    in_cluster = materialize(in_cluster.select("component", "node", "fp", F.col("rep.key").alias("key"), "copies", "size", band.alias("band")), "in-cluster")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_TOKENS)).cast("int")
    per = in_cluster.groupBy("component", "band").agg(blocks.alias("blocks"))
    place = F.concat_ws(":", "component", "band")
    beside = per.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = per.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    per = per.join(beside, ["component", "band"], "left").join(below, ["component", "band"], "left")
    per = materialize(per.select(place.alias("place"), "blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("above", "below")]), "cluster-sizes")
    ids = materialize(in_cluster.select("key").distinct(), "cluster-keys")
    sets = join_checked(light, ids, "key", "left_semi").select("text").mapInArrow(_sets, "fp binary, tokens binary")
    sets = in_cluster.join(sets.where("fp is not null").groupBy("fp").agg(F.first("tokens").alias("tokens")), "fp")
    sets = join_checked(sets.withColumn("place", place), per, "place").withColumn("part", F.pmod(F.hash("node"), F.col("blocks")))
    spot = lambda band, part: F.struct(band.cast("int").alias("band"), part.cast("int").alias("part"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    spots_of = lambda n, band: F.transform(upto(n), lambda i: spot(band, i))
    others = [spots_of("blocks", F.col("band")), spots_of("above", F.col("band") + 1), spots_of("below", F.col("band") - 1)]
    own = spot(F.col("band"), F.col("part"))
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.concat(*others)))
    sets = sets.select(F.col("component").alias("cluster"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("first"), F.col("node").alias("uid"), "copies", "tokens")
    sets = sets.select("cluster", F.to_json("low").alias("low"), F.to_json("high").alias("high"), F.col("first").cast("int").alias("part"), "uid", "copies", "tokens")
    keys = ["cluster", "low", "high"]
    return sets.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_compare_blocks, threshold), "uid long, label long, links long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies, n_shingles) for every row of docs(doc_id, text, ...).

    Two documents are linked if their sets of 5-word shingles have a Jaccard similarity >= threshold
    (a text of one to four words has one shingle, all of it). class_id is the least doc_id of those
    connected by links; n_links counts the other rows linked to this one, copies included; n_copies the
    rows with the same set, this one included. Texts that are null or have no word link to none
    and are classes of their own. Repeated rows count as copies. Rows with null ids take part; a class of
    them alone has a null class_id. Texts are read whole, however long; an empty table gives no rows. A
    pair just at the threshold is found with the probability `recall`, a more similar one more surely.
    """
    return row_classes(docs, threshold, recall).drop("key", "class_key")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of every class of near copies the row with the least doc_id (null last), all columns kept.

    Classes are of texts, so rows that share a doc_id but not a text are judged apart. Of rows alike in
    doc_id and text one stays. Rows without words have no copies and all stay.
    """
    return own_names(docs, ("doc_id", "text"), _drop)


def _drop(docs: DataFrame) -> DataFrame:
    rows = settled(lambda: row_classes(docs).select("key", "class_key"), "doc-classes").where("class_key is not null")
    gone = materialize(rows.where("key <> class_key").select("key").distinct(), "dropped")
    again = materialize(rows.where("key = class_key").groupBy("key").count().where("count > 1").select("key"), "repeated-rows")
    keyed = docs.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string")))
    kept = join_checked(keyed, gone, "key", "left_anti")
    if not again.isEmpty():
        once = join_checked(kept, again, "key", "left_semi").dropDuplicates(["key"])
        kept = join_checked(kept, again, "key", "left_anti").unionByName(once)
    return kept.drop("key")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
