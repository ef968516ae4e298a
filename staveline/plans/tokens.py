"""Clean-up of decoded symbol tokens: ``page, voice, seq, rhythm, pitch, lift, position`` (and others).

A chord marker joins the symbols on its two sides. Steps are windows and joins under (page, voice); each keeps rows of
the input and their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHORD = "chord"
KEYS = ("page", "voice")


def _w() -> Window:
    return Window.partitionBy(*KEYS).orderBy("seq")


def chords(tokens: DataFrame) -> DataFrame:
    """``tokens`` without markers, with ``chord``: symbols joined by markers share a number.

    A leading marker is swallowed and still joins the symbol after the next one to it.
    """
    before = F.lag("rhythm").over(_w())
    first = F.row_number().over(_w()) == 1
    marked = tokens.withColumns({"__marker": F.col("rhythm") == CHORD, "__first": first, "__joined": before == CHORD})
    # Symbols only, with what stood before each.
    lead = F.max((F.col("__first") & F.col("__marker")).cast("int")).over(Window.partitionBy(*KEYS))
    held = marked.withColumn("__lead", lead).filter(~F.col("__marker"))
    place = F.row_number().over(_w())
    joined = F.coalesce("__joined", F.lit(False))
    held = held.withColumn("__place", place)
    opens = F.when((F.col("__place") == 1) | ~(joined | ((F.col("__lead") == 1) & (F.col("__place") == 2))), 1).otherwise(0)
    held = held.withColumn("__open", opens)
    number = F.sum("__open").over(_w().rowsBetween(Window.unboundedPreceding, 0)) - 1
    return held.withColumn("chord", number).drop("__marker", "__first", "__joined", "__lead", "__place", "__open")


def measures(tokens: DataFrame, is_bar: Column) -> DataFrame:
    """``tokens`` with ``measure``: a bar symbol closes its measure."""
    closed = F.sum(F.when(is_bar, 1).otherwise(0)).over(_w().rowsBetween(Window.unboundedPreceding, -1))
    return tokens.withColumn("measure", F.coalesce(closed, F.lit(0)))


def without_repeated_pitches(tokens: DataFrame) -> DataFrame:
    """Of notes of one chord, pitch and position the first stays; other symbols stay."""
    note = F.col("rhythm").startswith("note")
    w = Window.partitionBy(*KEYS, "chord", "pitch", "position", note).orderBy("seq")
    return tokens.withColumn("__n", F.row_number().over(w)).filter(~note | (F.col("__n") == 1)).drop("__n")


def without_redundant(tokens: DataFrame, kinds: tuple[str, ...] = ("clef", "keySignature", "timeSignature")) -> DataFrame:
    """Drop clefs, keys and metres equal to the last one seen of their kind; clefs count apart for the upper staff and the rest."""
    kind = F.coalesce(*[F.when(F.col("rhythm").startswith(k), F.lit(k)) for k in kinds])
    lane = F.when(kind == "clef", F.coalesce(F.col("position") == "upper", F.lit(False)).cast("string")).otherwise("")
    w = Window.partitionBy(*KEYS, "__kind", "__lane").orderBy("seq")
    marked = tokens.withColumns({"__kind": kind, "__lane": lane})
    same = F.col("rhythm").eqNullSafe(F.lag("rhythm").over(w)) & (F.row_number().over(w) > 1)
    marked = marked.withColumn("__same", F.col("__kind").isNotNull() & same)
    return marked.filter(~F.col("__same")).drop("__kind", "__lane", "__same")


def short_measures(lengths: DataFrame, length: str = "length") -> DataFrame:
    """``page, voice, measure`` of measures shorter than the voice's typical one, its upper median."""
    typical = lengths.groupBy(*KEYS).agg(F.expr(f"percentile_disc(0.5) within group (order by {length} desc)").alias("typical"))
    return lengths.join(typical, [*KEYS]).filter(F.col(length) < F.col("typical")).drop("typical")


def for_single_staff(tokens: DataFrame, is_grand: Column) -> DataFrame:
    """Symbols of the lower staff go where the system has one staff only."""
    return tokens.filter(is_grand | ~F.coalesce(F.col("position") == "lower", F.lit(False)))
