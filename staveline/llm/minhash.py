"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its ``shingle``-word shingles; two are linked if their
Jaccard similarity is at least ``per_cent`` / 100, confirmed on the full sets.

1. Signature: ``coordinates`` minima of independent hashes. Documents of equal
   sets (count and two 64-bit sums) become one class; only its smallest id goes on.
2. Postings: a document is posted under each (coordinate, value) pair. A linked
   pair agrees in ``floor`` coordinates or more except with probability
   ``MISS`` (binomial tail), so values that one class alone holds are skipped,
   classes with fewer than ``floor`` shared values are dropped, and of the rest
   only the ``coordinates - floor + 1`` rarest are kept: two classes that agree
   in ``floor`` pairs agree in one of these.
3. Collisions are counted on the signatures of classes that meet in a list and
   pairs below ``floor`` dropped; the rest are confirmed on the full sets.
4. Lists are merged from their most central class outwards: every class is
   compared with its list's leader, and lists whose classes then share a
   component are closed.
5. Classes in lists still open are posted once more, under their rarest
   shingles among such classes (with lengths and positions bounding the overlap
   from above, so that a pair that can reach the threshold meets). What meets
   in different components is counted and confirmed as before. No link between
   components is missed, and no list of copies is spelled out in pairs. (Posting
   under the rarest coordinates again instead makes 20 times the pairs where many
   texts are alike below the threshold, as a third of their shingles is one passage; with
signatures of 256 coordinates there it still makes 16 times the rows for five times the input.)

The component of a document is the smallest id it reaches. Documents without
words have an empty set, no links and are kept. Rows with a null id are dropped;
rows that repeat an id are one document with the smallest of their texts. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.kernels import give_back, shingle_sets
from staveline.llm.tables import BROADCAST_IDS, small_batches
from staveline.operators.components import connected_components
from staveline.sources.scratch import discard, materialize

MISS = 1e-7
_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
FEATURES = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"


def match_floor(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The most agreeing coordinates that a pair of this similarity falls short of with probability ``miss`` at most."""
    tail, k = 0.0, 0
    while k < coordinates:
        tail += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if tail > miss:
            break
        k += 1
    return max(1, k)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima under each hash; the coordinate's number replaces the low byte."""
    low = np.array([(hashes * _MUL[j] + _ADD[j]).min() for j in range(coordinates)], np.uint64)
    return ((low & ~np.uint64(255)) | np.arange(coordinates, dtype=np.uint64)).view(np.int64)


def features(docs: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    names = ["doc_id", "n_shingles", "h1", "h2", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, sig = [], [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int((s * (s | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s, coordinates) if len(s) else np.zeros(0, np.int64))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, h1, h2))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sig, pa.list_(pa.int64()))], names)
        give_back()

    return docs.mapInArrow(run, FEATURES)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets are similar enough; ``texts`` is ``doc_id, text``, ids unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(2).dictionary_encode()
            leaders = list(shingle_sets(a.dictionary, shingle))
            keep = []
            for k, y in zip(a.indices.to_pylist(), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(leaders[k], y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(leaders[k]) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    one = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = one.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _semi(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``ids``; null ids stay."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def _rare_pairs(texts: DataFrame, components: DataFrame, shingle: int, per_cent: int) -> DataFrame:
    """Pairs ``a, b`` of different components that may reach the threshold.

    With shingles in order of their frequency here (then value), two sets that reach it share a shingle among the
    first of either: the smaller set's first 1 + size - 2t/(1+t) size, the larger one's first 1 + size - t size. At
    their first common shingle what is left of both must be enough. A component that holds most rows of a shingle
    stands on one side of the join only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first in range(0, len(ids), 256):
                sets = list(shingle_sets(batch.column(1).slice(first, 256), shingle))
                sizes = [len(s) for s in sets]
                own, of = np.repeat(ids[first : first + 256], sizes), np.repeat(np.array(sizes, np.int64), sizes)
                held = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(of), pa.array(held)], ["doc_id", "size", "held"])

    rows = texts.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, held long")
    rows = materialize(rows, "shingles")
    common = rows.groupBy("held").agg(F.count("*").alias("n")).filter("n > 1")
    posts = rows.join(common, "held").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "held"))).alias("p"))
    # Shingles that one text holds come first and meet nothing.
    reach = F.col("size") - F.ceil(F.col("size") * per_cent / 100) + 1
    alone = F.col("size") - F.size("p")
    posts = posts.select("doc_id", "size", alone.alias("alone"), F.slice("p", 1, F.greatest(F.lit(0), reach - alone).cast("int")).alias("p"))
    posts = posts.select("doc_id", "size", F.posexplode("p").alias("k", "post"), "alone")
    posts = posts.select("doc_id", "size", F.col("post.held").alias("held"), (F.col("k") + 1 + F.col("alone")).alias("rank"))
    short = F.col("size") - F.ceil(F.col("size") * 2 * per_cent / (100 + per_cent)) + 1
    posts = materialize(posts.join(components, "doc_id").withColumn("short", F.col("rank") <= short), "rare")
    groups = posts.groupBy("held", "component").agg(F.count("*").alias("n"))
    most = groups.groupBy("held").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("groups"))
    most = most.filter("groups > 1").select("held", F.col("most.component").alias("big"))
    x = posts.join(most, "held").filter("component != big").alias("x")
    y = posts.alias("y")
    x_first = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    left = 1 + F.least(F.col("x.size") - F.col("x.rank"), F.col("y.size") - F.col("y.rank"))
    met = (
        (F.col("x.held") == F.col("y.held"))
        & (F.col("x.component") != F.col("y.component"))
        & F.when(x_first, F.col("x.short")).otherwise(F.col("y.short"))
        & (left * (100 + per_cent) >= (F.col("x.size") + F.col("y.size")) * per_cent)
    )
    ids = F.col("x.doc_id"), F.col("y.doc_id")
    return x.join(y, met).select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b"))


def _shared(pairs: DataFrame, reps: DataFrame, floor: int, per_cent: int) -> DataFrame:
    """Pairs that agree in ``floor`` coordinates or more and whose sizes don't rule a link out."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = 100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b")
    return pairs.join(right, "b").join(left, "a").filter(near & (same >= floor)).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    per_cent: int = 80,
    coordinates: int = 40,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = small_batches(docs.filter("doc_id is not null"))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").take(1):
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    floor = match_floor(coordinates, per_cent / 100)
    prefix = coordinates - floor + 1
    feats = materialize(features(docs, shingle, coordinates), "features")
    classes = materialize(
        feats.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes"
    )
    own = classes.select(F.col("rep").alias("doc_id"))
    reps = materialize(feats.join(own, "doc_id", "left_semi").select("doc_id", "n_shingles", "sig"), "signatures")
    keys = reps.select("doc_id", F.explode("sig").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = (
        keys.join(common, "key")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("posts"))  # at most one for each coordinate
        .filter(F.size("posts") >= floor)
        .select(
            "doc_id",
            F.aggregate("posts", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("central"),
            F.slice("posts", 1, F.greatest(F.lit(0), prefix - (coordinates - F.size("posts")))).alias("posts"),
        )
    )
    lists = materialize(shared.select("doc_id", "central", F.explode("posts.key").alias("key")), "postings")
    texts = materialize(_semi(docs, lists.select("doc_id").distinct()), "texts")
    edges, labels = None, None
    for last in (False, True):
        if labels is None:
            live = lists.withColumn("component", F.col("doc_id"))
        else:
            live = lists.join(labels, lists.doc_id == labels.node, "left").drop("node")
            live = live.withColumn("component", F.coalesce("component", "doc_id"))
        state = live.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        open_lists = materialize(live.join(state.filter("low < high").select("key"), "key", "left_semi"), "open")
        if open_lists.isEmpty():
            break
        if last:
            members = open_lists.select("doc_id", "component").distinct()
            pairs = _rare_pairs(_semi(texts, members.select("doc_id")), members, shingle, per_cent)
        else:
            leader = open_lists.groupBy("key").agg(F.max(F.struct("central", "doc_id")).alias("lead"))
            pairs = open_lists.join(leader.select("key", F.col("lead.doc_id").alias("a")), "key")
            pairs = pairs.filter("doc_id != a").select("a", F.col("doc_id").alias("b"))
        found = materialize(confirm(_shared(pairs.distinct(), reps, floor, per_cent), texts, shingle, per_cent), "links")
        edges = found if edges is None else edges.union(found)
        stale, labels = labels, materialize(connected_components(edges), "components")
        if stale is not None:
            discard(stale)
        discard(open_lists)
    for done in (lists, texts, reps):
        discard(done)
    whole = feats.join(classes, ["h1", "h2", "n_shingles"], "left")
    if labels is not None:
        whole = whole.join(labels, whole.rep == labels.node, "left")
    else:
        whole = whole.withColumn("component", F.lit(None).cast("long"))
    out = whole.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def first_of_each_group(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and others) whose id is its component's smallest.

    Rows with a null id stay; of rows that repeat an id the one with the smallest text stays.
    """
    repeats = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if repeats.take(1):
        order = F.struct("text", F.struct(*docs.columns).alias("row"))
        one = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min(order).alias("first"))
        docs = one.select("first.row.*").unionByName(docs.filter("doc_id is null"))
    groups = near_duplicates(docs, **parameters)
    dropped = materialize(groups.filter("not kept").select("doc_id"), "dropped")
    return _without(docs, dropped).select(docs.columns)
