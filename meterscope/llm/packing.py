"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Texts are tokenised in one pass that keeps only each piece's length and checksum. A document's ids are
those of the tokenizer and one end id; only longer documents are cut. Full pieces are sequences of
their own. The others are dealt by hash to groups of about GROUP pieces, so that work and memory of a
task do not grow with the corpus (a group wastes less than one sequence against packing all at once);
in a group, best-fit decreasing makes bins, and then items of the least filled bin are moved to other
underfull bins or exchanged for smaller ones there (one for one, two for one). Every step raises the
sum of squared fills, so the search ends; it also ends when the bins are as few as the sizes allow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .textops import slices

CAPACITY = 2048
END = 0
GROUP = 4096
#: Tasks that the groups are dealt to at most.
TASKS = 20_000
#: Pieces whose ids a Python worker keeps at most (some 40 MB); then those go that no later slice of texts has had.
CACHE = 200_000
#: Bytes of text that are tokenised together, about.
SLICE = 2 << 20

#: For lower-cased ASCII and Latin letters, the pieces that the tokenizer's own pattern splits text into.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-z0-9ß-öø-ɏ]+")
#: Text with any other character goes to the tokenizer as it is.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]")


class WordTokenizer:
    """Ids of a tokenizer file as little-endian 32-bit bytes. Pieces between splits are encoded apart
    from each other by such a tokenizer, so their ids are kept by piece; what is kept is the
    tokenizer's own answer, and text beyond ASCII and Latin letters, or with an added token, is encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of special and added tokens in a text are those tokens, as the tokenizer has it
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.met: set[str] = set()  # pieces found known since some last went

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Pieces that are not known yet are encoded together, whichever text they are of."""
        split = [None if _OTHER.search(t) or any(x in t for x in self.added) else _PIECES.findall(t.lower()) for t in texts]
        pieces = set().union(*(p for p in split if p is not None))
        found = self.known.keys() & pieces
        new = list(pieces - found)
        self.met |= found
        if len(self.known) + len(new) > CACHE:
            keep = self.met if len(self.met) <= CACHE // 2 and len(self.met) + len(new) <= CACHE else found
            self.known, self.met = {p: self.known[p] for p in keep}, found
        for at in range(0, len(new), 256):  # one call for many pieces, apart from each other by spaces
            some = new[at : at + 256]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            cut = (4 * np.searchsorted(np.array(encoded.word_ids), np.arange(len(some) + 1))).tolist()
            raw = np.array(encoded.ids, "<u4").tobytes()
            self.known.update(zip(some, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
        get = self.known.__getitem__
        return [self._raw(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, split, strict=True)]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _pieces(path: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _tokenizer(path)
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        for part in slices(pa.Table.from_batches([batch]), "text", SLICE):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(part.column("doc_id").to_pylist(), own.ids_of(part.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    for held, value in zip(out, (doc, k, at, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        held.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, each at most capacity: best-fit decreasing, then local search."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free
    open_ = 0  # bit f: some bin has f free
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = open_ >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            b = room[f].pop()
            if not room[f]:
                open_ ^= 1 << f
            bins[b].append(i)
            left = f - s
        else:
            b, left = len(bins), capacity - s
            bins.append([i])
        if not room[left]:
            open_ |= 1 << left
        room[left].append(b)
    return improve(bins, sizes, capacity)


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty the least filled bins by moves and by one-for-one and two-for-one exchanges."""
    least = -(-int(sizes.sum()) // capacity)
    of = np.zeros(len(sizes), int)
    for b, items in enumerate(bins):
        of[items] = b
    members = [set(b) for b in bins]
    fill = np.array([int(sizes[b].sum()) for b in bins], int)
    alive, stuck = len(bins), np.zeros(len(bins), bool)
    while alive > least:
        order = np.where(stuck | (fill == 0) | (fill == capacity), capacity + 1, fill)
        a = int(order.argmin())
        if order[a] > capacity:
            break
        step = _step(a, members, of, fill, sizes, capacity)
        if step is None:
            stuck[a] = True
            continue
        give, take, b = step
        for i in give:
            members[a].remove(i)
            members[b].add(i)
            of[i] = b
        for i in take:
            members[b].remove(i)
            members[a].add(i)
            of[i] = a
        moved = int(sizes[list(give)].sum()) - int(sizes[list(take)].sum()) if take else int(sizes[list(give)].sum())
        fill[a] -= moved
        fill[b] += moved
        stuck[:] = False
        alive -= fill[a] == 0
    return [sorted(m) for m in members if m]


def _step(a: int, members: list[set[int]], of: np.ndarray, fill: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple | None:
    """(items from a, items to a, bin) with the largest gain for another bin that is not full."""
    free = capacity - fill
    free[a] = 0
    free[fill < max(1, fill[a])] = 0  # into fuller bins only, or the sum of squares would not rise
    own = sorted(members[a], key=lambda i: -sizes[i])
    for i in own:  # move
        fit = np.flatnonzero(free >= sizes[i])
        if len(fit):
            return (i,), (), int(fit[free[fit].argmin()])
    room = free[of]
    most = np.where(room > 0, sizes + room, -1)  # what may come in for each item
    best, found = 0, None
    for sums, gives in (_singles(own, sizes), _pairs(own, sizes)):
        if not len(sums):
            continue
        at = np.searchsorted(sums, most, side="right") - 1
        gain = np.where(at >= 0, sums[at] - sizes, 0)
        j = int(gain.argmax())
        if gain[j] > best:
            best, found = int(gain[j]), (gives(int(at[j])), (j,), int(of[j]))
    return found


def _singles(own: list[int], sizes: np.ndarray) -> tuple:
    """Distinct sizes of own in ascending order, and an item of each."""
    values, first = np.unique(sizes[own], return_index=True)
    return values, lambda k: (own[first[k]],)


def _pairs(own: list[int], sizes: np.ndarray) -> tuple:
    """Distinct sums of all pairs of own in ascending order, and a pair of each. Of equal sizes two count."""
    kinds: dict[int, list[int]] = {}
    for i in own:
        kinds.setdefault(int(sizes[i]), []).append(i)
    of_two = [i for items in kinds.values() for i in items[:2]]
    x, y = np.triu_indices(len(of_two), 1)
    chosen = np.array(of_two, int)
    values, first = np.unique(sizes[chosen[x]] + sizes[chosen[y]], return_index=True)
    return values, lambda k: (of_two[x[first[k]]], of_two[y[first[k]]])


def _pack_group(capacity: int, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = rows["length"].to_numpy()
    sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for b, items in enumerate(pack(sizes, capacity)):
        sequence[items] = b
        offset[items] = np.cumsum(sizes[items]) - sizes[items]
    rows["sequence_id"] = rows["group"].astype(np.int64) * (1 << 32) + sequence
    rows["offset"] = offset
    return rows.drop(columns="group")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows of docs(doc_id, text).

    Null and empty texts are their end id alone. Repeated rows are packed each; equal sizes go by
    doc_id, piece and checksum. Other columns are not read; an empty table gives no rows.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    light = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialize(light.mapInArrow(partial(_pieces, tokenizer_path, capacity), schema), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // GROUP))
    full = pieces.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    dealt = rest.repartitionByRange(min(groups, TASKS), "group")  # groups are alike in size: a task each, or as many each
    packed = dealt.groupBy("group").applyInPandas(partial(_pack_group, capacity), f"{schema}, sequence_id long, offset long")
    return packed.unionByName(full)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
