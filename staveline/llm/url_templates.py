"""URL filter: explicit rules first, then a tree of path templates for each host.

DataFrame functions only. The tree is grown level by level over the distinct
(host, path shape) pairs, which are counted before anything is joined:

1. Digits become ``#``; each segment of the shape is a tree level, as deep as
   some host has ``min_support`` rows. Deeper segments are alike by definition
   (2 makes them ``*``, 3 merges them) and are written as ``+`` at once.
2. At each node a segment of ``min_support`` rows stays literal if no more than
   ``fan_out`` segments of the node have so many, or if it has ``own_tree``
   rows, or if its share of bad labels differs from that of the rest of the
   node (as in 3); all others are one wildcard ``*``. Other pages of the host
   do not count as a share.
3. From the leaves up, a branch whose share of bad labels does not differ from
   that of its siblings together (two-proportion z below ``merge_z``) is merged
   into their common branch ``+``.
4. A template is rejected if its purity, (bad + smoothing * base rate) /
   (labelled + smoothing), reaches ``reject_at``.

Joins are on (host, prefix) keys between counted tables and rows; a hot host's
partitions are split by adaptive execution. Each level is written before the
next one reads it twice, so that plans stay small and lost executors cost one
level at most.

Null urls and urls without ``://`` have empty host and path, share one template
and are judged like any other. Null labels are unlabelled rows. Repeated rows
count each. Columns of the input are kept apart from the working columns,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staveline.sources.scratch import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are one CASE expression; more are joined by host suffix.
INLINE_RULES = 64


def host_of(url: Column) -> Column:
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, at, start = rule
    return ((host == at) | host.endswith("." + at)) & path.startswith(start)


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) and the ``rule`` and ``rule_verdict`` of the longest rule that fits.

    Of rules of one length the first in text order wins, of equal rules the one that allows.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    if len(ordered) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in reversed(ordered):
            fits = _fits(F.col("host"), F.col("path"), r)
            rule = F.when(fits, F.lit(r[1] + r[2])).otherwise(rule)
            verdict = F.when(fits, F.lit(r[0])).otherwise(verdict)
        return rows.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = rows.sparkSession
    listed = spark.createDataFrame(ordered, "v string, at string, start string")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    pairs = rows.select("host", "path").distinct()
    hits = pairs.withColumn("at", F.explode(suffix)).join(listed, "at").filter(F.col("path").startswith(F.col("start")))
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct(-F.length(F.concat("at", "start")), F.concat("at", "start").alias("rule"), "v")).alias("best")
    )
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.v").alias("rule_verdict"))
    return rows.join(best, ["host", "path"], "left")


def _rate(bad: str, n: str) -> Column:
    return F.col(bad) / F.greatest(F.col(n), F.lit(1))


def _apart(z: float) -> Column:
    """Whether the bad share of ``own_bad`` of ``own_n`` differs from the rest of ``all_bad`` of ``all_n``."""
    rest_n, rest_bad = F.col("all_n") - F.col("own_n"), F.col("all_bad") - F.col("own_bad")
    p = _rate("all_bad", "all_n")
    spread = p * (1 - p) * (1 / F.greatest("own_n", F.lit(1)) + 1 / F.greatest(rest_n, F.lit(1)))
    gap = _rate("own_bad", "own_n") - rest_bad / F.greatest(rest_n, F.lit(1))
    return (F.col("own_n") > 0) & (rest_n > 0) & (gap * gap > z * z * spread)


def _supported_depth(rows: DataFrame, min_support: int) -> int:
    """The deepest level at which some host has ``min_support`` rows; below it no segment can be told apart."""
    sizes = rows.groupBy("host", F.size("parts").alias("size")).agg(F.sum("n").alias("n"))
    deeper = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size")))  # over path lengths only
    return sizes.withColumn("n", deeper).filter(F.col("n") >= min_support).agg(F.max("size")).first()[0] or 0


def path_templates(
    counts: DataFrame, *, min_support: int = 5, fan_out: int = 100, own_tree: int = 1000, merge_z: float = 1.96
) -> DataFrame:
    """``host, shape, template`` from ``host, shape, n, labelled, bad`` (one row for each host and shape)."""
    parts = F.filter(F.split("shape", "/"), lambda s: s != "")
    rows = counts.select(
        "host", "shape", "n", "labelled", "bad", parts.alias("parts"), F.array().cast("array<string>").alias("levels")
    )
    depth = _supported_depth(rows, min_support)
    for k in range(depth):
        prefix = F.concat_ws("/", "levels")
        rows = rows.withColumns({"prefix": prefix, "part": F.get("parts", F.lit(k))})
        last, rows = rows, materialize(rows, "templates")
        discard(last)
        nodes = rows.filter("part is not null").groupBy("host", "prefix", "part").agg(
            F.sum("n").alias("rows"), F.sum("labelled").alias("own_n"), F.sum("bad").alias("own_bad")
        )
        totals = nodes.groupBy("host", "prefix").agg(
            F.count(F.when(F.col("rows") >= min_support, 1)).alias("segments"), F.sum("own_n").alias("all_n"), F.sum("own_bad").alias("all_bad")
        )
        kept = (
            nodes.filter(F.col("rows") >= min_support)
            .join(totals, ["host", "prefix"])
            .filter((F.col("segments") <= fan_out) | (F.col("rows") >= own_tree) | _apart(merge_z))
            .select("host", "prefix", "part", F.lit(True).alias("literal"))
        )
        level = F.when(F.col("literal"), F.col("part")).when(F.col("part").isNotNull(), F.lit("*"))
        grown = rows.join(kept, ["host", "prefix", "part"], "left").select(
            "host", "shape", "n", "labelled", "bad", "parts",
            F.when(level.isNotNull(), F.array_append("levels", level)).otherwise(F.col("levels")).alias("levels"),
        )
        grown._scratch_path, rows = getattr(rows, "_scratch_path", None), grown
    deeper = F.array_repeat(F.lit("+"), F.greatest(F.size("parts") - depth, F.lit(0)))
    grown = rows.select("host", "shape", "labelled", "bad", F.concat("levels", deeper).alias("levels"))
    grown._scratch_path, rows = getattr(rows, "_scratch_path", None), grown
    for k in range(depth, 0, -1):
        # A branch is what stands at level k below its parent; the siblings are all branches of that parent.
        rows = rows.withColumns(
            {"parent": F.concat_ws("/", F.slice("levels", 1, k - 1)), "branch": F.get("levels", F.lit(k - 1))}
        )
        last, rows = rows, materialize(rows, "templates")
        discard(last)
        own = (
            rows.filter("branch is not null")
            .groupBy("host", "parent", "branch")
            .agg(F.sum("labelled").alias("own_n"), F.sum("bad").alias("own_bad"))
        )
        pool = own.groupBy("host", "parent").agg(F.sum("own_n").alias("all_n"), F.sum("own_bad").alias("all_bad"))
        alike = own.join(pool, ["host", "parent"]).select("host", "parent", "branch", (~_apart(merge_z)).alias("alike"))
        merged = F.concat(F.slice("levels", 1, k - 1), F.array(F.lit("+")), F.slice("levels", k + 1, F.size("levels")))
        grown = rows.join(alike, ["host", "parent", "branch"], "left").select(
            "host", "shape", "labelled", "bad", F.when(F.col("alike"), merged).otherwise(F.col("levels")).alias("levels")
        )
        grown._scratch_path, rows = rows._scratch_path, grown
    template = F.concat(F.lit("/"), F.concat_ws("/", "levels")).alias("template")
    out = materialize(rows.select("host", "shape", "labelled", "bad", template), "templates")
    discard(rows)
    return out


def judge_urls(
    urls: DataFrame,
    rules: list[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    bad_col: str = "bad",
    smoothing: float = 4.0,
    reject_at: float = 0.5,
    **tree,
) -> DataFrame:
    """``id, host, path, rule, template, purity, verdict`` for every row of ``urls``.

    ``bad_col`` is a nullable boolean label; ``rules`` are (verdict, host, path start).
    """
    rows = urls.select(
        F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.col(bad_col).cast("boolean").alias("is_bad"),
    ).withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    counts = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("is_bad").alias("labelled"), F.count(F.when(F.col("is_bad"), 1)).alias("bad")
    )
    templates = path_templates(counts, **tree)
    base = templates.agg((F.sum("bad") / F.greatest(F.sum("labelled"), F.lit(1))).alias("base"))
    pure = templates.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pure = pure.join(F.broadcast(base)).select(  # one row: the base rate
        "host", "template",
        ((F.col("bad") + smoothing * F.coalesce("base", F.lit(0.0))) / (F.col("labelled") + smoothing)).alias("purity"),
    )
    by_shape = templates.select("host", "shape", "template").join(pure, ["host", "template"])
    judged = with_rule(rows, rules).join(by_shape, ["host", "shape"])
    method = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        id_col, "host", "path", "rule", "template", "purity", F.coalesce("rule_verdict", method).alias("verdict")
    )
