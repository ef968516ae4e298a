"""Benchmark decontamination by spaced seeds.

A seed is a mask over ``span`` successive tokens; positions marked 0 are
ignored, so that a substituted token under one of them does not hide the
window. Every window of every benchmark item and of every document is hashed
under each mask; equal hashes are hits. A hit fixes the alignment of item and
document; the aligned stretch around it is then compared token by token. It is
accepted, with ``any_run``, if any run of it holds ``min_tokens`` equal tokens (or ``min_identity``
of the item, for shorter items of ``min_item`` tokens and more) and at least
``min_identity`` of the run's tokens are equal. Reported is the best run (+1 for
an equal token, ``-mismatch`` for a different one) if it is such a run, else
the one with most equal tokens. Without ``any_run`` only the best run counts.
Of several overlaps with one item id that with most equal tokens is reported, the
earliest and then the shortest on ties.

Shorter items cannot bear a substitution: one of ``min_phrase`` to ``min_item`` - 1
tokens is found where it stands whole and unchanged, and one of fewer tokens in
a document that holds nothing else (such words are part of every text).

No such run is without a seed (``masks_for``): m replaced tokens leave m + 1
stretches, which at the fixed thresholds have a run of four equal tokens, or,
with 8 of 10, 9 of 11 and 12 of 15 tokens equal, neighbouring runs of two and
three.

Tokens are runs of letters and digits of the lower-cased text; punctuation and
layout play no part. A benchmark of at most ``block_hashes`` seed hashes is
broadcast, and documents are read once. A larger one is never in one place: its
hashes and those of the documents' windows are shuffled and joined (a hot hash's
partition is split by adaptive execution), and the alignments found are dealt to
the documents that hold them in groups of about ``GROUP`` items. Windows that
meet no benchmark hash are dropped before the shuffle by a bitmap of fixed size.

Null and empty texts have no tokens and match nothing, on either side. Repeated
documents are all reported, repeated items once. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.kernels import _ODD, NON_WORD, give_back, mix, runs, word_hashes, words
from staveline.llm.tables import BROADCAST_IDS, small_batches
from staveline.sources.scratch import materialize

#: Every overlap of the thresholds 12 tokens, items of 8 and identity 0.8 holds one of these.
MASKS = ("1111", "1110111", "111011")
#: Items that are compared with one copy of a document's text, where the hashes are joined.
GROUP = 256
#: The benchmark's hashes that a bitmap tells apart, and the partitions that each make one.
BITS, BITMAPS = 25, 16
SCHEMA = "doc_id long, item_id long, doc_start long, doc_tokens long, n_tokens long, n_equal long, identity double"


def token_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """Token hashes of each text."""
    for first, last, data, bounds in runs(pc.utf8_lower(texts.fill_null(""))):
        starts, ends, per_text = words(data, bounds, NON_WORD)
        hashes = word_hashes(data, starts, ends)
        for i in range(last - first):
            yield hashes[per_text[i] : per_text[i + 1]]


def masks_for(min_tokens: int, min_item: int, min_identity: float, min_phrase: int = 4) -> tuple[str, ...]:
    """Masks one of which fits each accepted overlap; below the fixed thresholds the longest run that all must hold."""
    if min_tokens >= 12 and min_item >= 8 and min_identity >= 0.8:
        return MASKS if min_phrase >= 4 else (*MASKS, "1" * max(1, min_phrase))
    least = max(1, math.ceil(min(min_tokens, min_identity * min_item) - 1e-9))
    lost = [math.floor(s * (1 - min_identity) / max(min_identity, 1e-9) + 1e-9) for s in range(least, least + 200)]
    run = min(-(-s // (m + 1)) for s, m in enumerate(lost, least))
    return ("1" * (run if min_phrase >= min_item else max(1, min(run, min_phrase))),)


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of ``len(mask)`` tokens under the mask."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(_ODD[40]) * int(mask, 2) % (1 << 64), np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            total += hashes[j : j + n] * _ODD[j]
    return mix(total)


def best_run(equal: np.ndarray, mismatch: float) -> tuple[int, int]:
    """``first, end`` of the stretch with the highest score; the earliest and shortest on ties."""
    score = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -mismatch))])
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return int(np.flatnonzero(score[: end + 1] == low[end])[-1]), end


def fullest_run(equal: np.ndarray, min_identity: float) -> tuple[int, int]:
    """``first, end`` of the run with most equal tokens that has ``min_identity`` of them; the earliest on ties."""
    at = np.flatnonzero(equal)
    if not len(at):
        return 0, 0
    share = Fraction(min_identity).limit_denominator(1_000_000)
    # Equal tokens i to j fit if (j + 1 - i) * denominator >= (at[j] + 1 - at[i]) * numerator.
    score = np.arange(len(at)) * share.denominator - at * share.numerator
    first = np.searchsorted(-np.minimum.accumulate(score), -(score + share.denominator - share.numerator))
    j = int(np.argmax(np.arange(len(at)) - first))
    return int(at[first[j]]), int(at[j]) + 1


def matches(item: np.ndarray, tokens: np.ndarray, shift: int, min_tokens: int, min_item: int, min_identity: float, mismatch: float, any_run: bool):
    """``start in the document, length, equal tokens`` of an accepted overlap of the item at this shift, else None."""
    lo, hi = max(0, -shift), min(len(item), len(tokens) - shift)
    equal = item[lo:hi] == tokens[lo + shift : hi + shift]
    count = np.count_nonzero(equal)
    if len(item) < min_item:
        return (shift, len(item), len(item)) if count == len(item) else None
    need = max(1, min(min_tokens, min_identity * len(item)))
    if count < need:
        return None
    first, end = best_run(equal, mismatch)
    same = int(equal[first:end].sum())
    if same < need or same < min_identity * (end - first):
        if not any_run:
            return None
        first, end = fullest_run(equal, min_identity)
        same = int(equal[first:end].sum())
    return (lo + first + shift, end - first, same) if same >= need else None


def better(got: tuple[int, int, int], old: tuple[int, int, int] | None) -> bool:
    """More equal tokens; on ties the earlier, then the shorter overlap."""
    return old is None or (-got[2], got[0], got[1]) < (-old[2], old[0], old[1])


class SeedIndex:
    """The items of a benchmark and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int, np.ndarray]], masks: tuple[str, ...] = MASKS, min_item: int = 8, min_phrase: int = 4):
        self.masks, self.min_item, self.min_phrase = masks, min_item, min_phrase
        self.items: list[tuple[int, np.ndarray]] = []
        self.whole: dict[bytes, set[int]] = {}
        known = set()
        for i, tokens in items:
            if len(tokens) and (i, tokens.tobytes()) not in known:
                known.add((i, tokens.tobytes()))
                if len(tokens) < min(min_item, min_phrase):
                    self.whole.setdefault(tokens.tobytes(), set()).add(i)
                else:
                    self.items.append((i, tokens))
        hashes, where = [], []
        for k, (_, tokens) in enumerate(self.items):
            for mask in masks:
                h = seed_hashes(tokens, mask)
                hashes.append(h)
                where.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.where = self.hashes[order], self.where[order]
        bits = 10
        while bits < 24 and (1 << bits) < 16 * len(self.hashes):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.hashes >> self.shift] = True

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """Distinct (item, shift of the item against the document), in order."""
        found = []
        for mask in self.masks:
            h = seed_hashes(tokens, mask)
            at = np.flatnonzero(self.seen[h >> self.shift])
            if len(at):
                lo, hi = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
                n = hi - lo
                here = self.where[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                found.append((here[:, 0] << 40) + (np.repeat(at, n) - here[:, 1]) + (1 << 39))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([both >> 40, (both & ((1 << 40) - 1)) - (1 << 39)], 1)

    def found(self, tokens: np.ndarray, min_tokens: int, min_identity: float, mismatch: float, any_run: bool) -> dict:
        """For each item in the document: start, length and equal tokens of its longest accepted overlap."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.whole and 0 < len(tokens) < self.min_phrase:
            best = {i: (0, len(tokens), len(tokens)) for i in sorted(self.whole.get(tokens.tobytes(), ()))}
        for k, shift in self.hits(tokens).tolist():
            item_id, item = self.items[k]
            got = matches(item, tokens, shift, min_tokens, self.min_item, min_identity, mismatch, any_run)
            if got and better(got, best.get(item_id)):
                best[item_id] = got
        return best


def _table(out: list[tuple]) -> pa.RecordBatch:
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
    cols = list(zip(*out, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 12,
    min_item: int = 8,
    min_phrase: int = 4,
    min_identity: float = 0.8,
    mismatch: float = 1.5,
    any_run: bool = False,
    block_hashes: int = 1 << 20,
) -> DataFrame:
    """The longest verified overlap of each document with each item it holds (``SCHEMA``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    limits = (min_tokens, min_identity, mismatch, any_run)
    items, masks = _items(benchmark, item_col, item_text_col), masks_for(min_tokens, min_item, min_identity, min_phrase)
    index = _index(items, masks, min_item, min_phrase, block_hashes)
    if index is None:
        return _joined(rows, items, masks, min_item, min_phrase, limits).drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, tokens in zip(batch.column(0).to_pylist(), token_hashes(batch.column(1)), strict=True):
                for item, (start, size, same) in index.value.found(tokens, *limits).items():
                    out.append((doc_id, item, start, len(tokens), size, same, same / size))
            yield _table(out)

    return rows.mapInArrow(run, SCHEMA)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 12,
    min_item: int = 8,
    min_phrase: int = 4,
    min_identity: float = 0.8,
    mismatch: float = 1.5,
    any_run: bool = False,
    block_hashes: int = 1 << 20,
) -> DataFrame:
    """The rows of ``docs`` without a verified overlap, with all their columns."""
    at, limits = docs.columns.index(text_col), (min_tokens, min_identity, mismatch, any_run)
    items, masks = _items(benchmark, item_col, item_text_col), masks_for(min_tokens, min_item, min_identity, min_phrase)
    index = _index(items, masks, min_item, min_phrase, block_hashes)
    if index is None:
        rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        held = materialize(_joined(rows, items, masks, min_item, min_phrase, limits).select("h").distinct(), "held")
        held = held.withColumnRenamed("h", "__held")
        key = F.coalesce(F.sha2(docs[text_col].cast("string"), 256), F.lit(""))
        return docs.join(F.broadcast(held) if held.count() <= BROADCAST_IDS // 8 else held, key == held["__held"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not index.value.found(tokens, *limits) for tokens in token_hashes(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return small_batches(benchmark).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).dropna()


def _index(items: DataFrame, masks: tuple[str, ...], min_item: int, min_phrase: int, block_hashes: int):
    """The broadcast index of a benchmark whose text is short enough for ``block_hashes`` hashes; None for others."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(0))).first()[0]
    if len(masks) * size > 2 * block_hashes:  # a token and its separator are two bytes at least
        return None
    rows = sorted(items.collect())  # at most 2 * block_hashes bytes of text
    tokens = token_hashes(pa.array([r.t for r in rows], pa.string()))
    return items.sparkSession.sparkContext.broadcast(SeedIndex([(r.i, t) for r, t in zip(rows, tokens, strict=True)], masks, min_item, min_phrase))


def _joined(rows: DataFrame, items: DataFrame, masks: tuple[str, ...], min_item: int, min_phrase: int, limits: tuple) -> DataFrame:
    """``SCHEMA`` and ``h`` (the text's digest) by a join of seed hashes; ``rows`` is ``doc_id, text``.

    Items of fewer than ``min_phrase`` tokens are posted under a hash of all their tokens, which is compared with that of whole documents.
    """
    least = min(min_item, min_phrase)

    def seeds(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(tokens) < least:
            whole = mix(seed_hashes(tokens, "1" * len(tokens)) + np.uint64(len(tokens))) if len(tokens) else np.zeros(0, np.uint64)
            return whole, np.zeros(len(whole), np.int64)
        parts = [seed_hashes(tokens, m) for m in masks]
        return np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])

    def posts(names: list[str], seen=None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, hashes, places = [], [], []
                for k, tokens in enumerate(token_hashes(batch.column(1))):
                    h, at = seeds(tokens)
                    if seen is not None:
                        use = np.unpackbits(seen.value[h >> np.uint64(64 - BITS + 3)][:, None], axis=1)[np.arange(len(h)), (h >> np.uint64(64 - BITS)) & np.uint64(7)] == 1
                        h, at = h[use], at[use]
                    own.append(np.full(len(h), k))
                    hashes.append(h.view(np.int64))
                    places.append(at)
                if own:
                    ids = batch.column(0).take(pa.array(np.concatenate(own), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places), pa.int64())], names)

        return run

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    items = materialize(items.distinct(), "items")
    bench = materialize(items.withColumn("t2", F.col("t")).select(F.struct("i", F.sha2("t", 256).alias("d")).alias("item"), "t").mapInArrow(
        posts(["item", "hash", "at"]), "item struct<i: long, d: string>, hash long, at long"), "seeds")
    seen = np.zeros(1 << (BITS - 3), np.uint8)
    for row in bench.select("hash").repartition(BITMAPS).mapInArrow(bitmap, "bits binary").toLocalIterator():
        seen |= np.frombuffer(row.bits, np.uint8)
    shared = items.sparkSession.sparkContext.broadcast(seen)
    # Texts of null documents hold no tokens, so that the digest need not tell them from empty ones.
    rows = small_batches(rows).withColumn("h", F.sha2("text", 256)).filter("text is not null")
    windows = rows.select("h", "text").mapInArrow(posts(["h", "hash", "at"], shared), "h string, hash long, at long")
    met = windows.join(bench.withColumnRenamed("at", "place"), "hash").select("h", "item", (F.col("at") - F.col("place")).alias("shift")).distinct()
    met = materialize(met, "alignments")
    texts = items.select(F.struct("i", F.sha2("t", 256).alias("d")).alias("item"), "t")
    shifts = met.groupBy("h", "item").agg(F.collect_list("shift").alias("shifts"))  # at most the tokens of both
    groups = met.select("h", "item.i").distinct().groupBy("h").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    shifts = shifts.join(groups, "h").withColumn("part", F.pmod(F.xxhash64("item.i"), F.col("groups")))
    shifts = shifts.join(texts, "item").groupBy("h", "part").agg(F.collect_list(F.struct(F.col("item.i").alias("i"), "t", "shifts")).alias("found"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], []
            for doc_id, h, tokens, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), token_hashes(batch.column(2)), batch.column(3), strict=True):
                best: dict[int, tuple[int, int, int]] = {}
                found = found.as_py()
                for x, item in zip(found, token_hashes(pa.array([f["t"] for f in found], pa.string())), strict=True):
                    for shift in x["shifts"]:
                        if len(item) < least and len(item) != len(tokens):
                            continue
                        got = matches(item, tokens, shift, limits[0], min_item, *limits[1:])
                        if got and better(got, best.get(x["i"])):
                            best[x["i"]] = got
                for i, (start, size, same) in sorted(best.items()):
                    out.append((doc_id, i, start, len(tokens), size, same, same / size))
                    digests.append(h)
            yield _table(out).append_column("h", pa.array(digests, pa.string()))

    return rows.join(shifts, "h").select("doc_id", "h", "text", "found").mapInArrow(verify, SCHEMA + ", h string")
