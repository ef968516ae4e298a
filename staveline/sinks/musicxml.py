"""MusicXML documents from note tables, built of JVM-side string expressions.

``notes`` is ``page, part, measure, seq, step, alter, octave, num, den, kind, dots, chord, staff``: a null step is a
rest, ``num / den`` the length as a share of a whole note. Divisions are the least common multiple of all length
denominators of a page (a quarter's at least). Measures are joined in order, then parts; a page is one row of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveline.functions.rounding import gcd, lcm_of

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<score-partwise version="4.0">\n'


def escape(x) -> Column:
    """Text as XML character data."""
    out = F.col(x) if isinstance(x, str) else x
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def leaf(name: str, value: Column, depth: int) -> Column:
    """An indented leaf element; null if the value is."""
    return F.concat(F.lit("  " * depth + f"<{name}>"), value.cast("string"), F.lit(f"</{name}>\n"))


def _joined(items: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["xml"]), "")


def documents(notes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``page, divisions, xml``; ``titles`` is ``page, title``."""
    per_page = notes.groupBy("page").agg(F.collect_set((F.col("den") / gcd("num", "den")).cast("long")).alias("dens"))
    # A quarter must be a whole number of divisions: divide the common denominator of a whole note by four.
    page = per_page.select("page", (lcm_of(F.array_append("dens", F.lit(4).cast("long"))) / 4).cast("long").alias("divisions"))
    rows = notes.join(page, "page")
    length = (F.col("num") * F.col("divisions") * 4 / F.col("den")).cast("long")
    opened = F.when(F.col("chord"), F.lit("        <chord/>\n")).otherwise("")
    alter = F.when(F.coalesce("alter", F.lit(0)) != 0, leaf("alter", F.col("alter"), 5)).otherwise("")
    pitch = F.concat(F.lit("        <pitch>\n"), leaf("step", F.col("step"), 5), alter, leaf("octave", F.col("octave"), 5), F.lit("        </pitch>\n"))
    sound = F.when(F.col("step").isNull(), F.lit("        <rest/>\n")).otherwise(pitch)
    dots = F.repeat(F.lit("        <dot/>\n"), F.coalesce("dots", F.lit(0)))
    staff = F.coalesce(leaf("staff", F.col("staff"), 4), F.lit(""))
    note = F.concat(
        F.lit("      <note>\n"), opened, sound, leaf("duration", length, 4), F.coalesce(leaf("type", F.col("kind"), 4), F.lit("")),
        dots, staff, F.lit("      </note>\n"),
    )
    measures = rows.groupBy("page", "part", "measure", "divisions").agg(F.collect_list(F.struct("seq", note.alias("xml"))).alias("notes"))
    first = F.col("measure") == F.min("measure").over(_part_window())
    attributes = F.when(
        first, F.concat(F.lit("      <attributes>\n"), leaf("divisions", F.col("divisions"), 4), F.lit("      </attributes>\n"))
    ).otherwise("")
    number = F.concat(F.lit('    <measure number="'), F.col("measure").cast("string"), F.lit('">\n'))
    measure = F.concat(number, attributes, _joined("notes"), F.lit("    </measure>\n"))
    measures = measures.select("page", "part", "measure", "divisions", measure.alias("xml"))
    parts = measures.groupBy("page", "part", "divisions").agg(F.collect_list(F.struct("measure", "xml")).alias("measures"))
    name = F.concat(F.lit("P"), F.col("part").cast("string"))
    part = F.concat(F.lit('  <part id="'), name, F.lit('">\n'), _joined("measures"), F.lit("  </part>\n"))
    listed = F.concat(F.lit('    <score-part id="'), name, F.lit('">\n      <part-name></part-name>\n    </score-part>\n'))
    parts = parts.select("page", "part", "divisions", part.alias("body"), listed.alias("head"))
    whole = parts.groupBy("page", "divisions").agg(
        F.collect_list(F.struct("part", F.col("head").alias("xml"))).alias("heads"), F.collect_list(F.struct("part", F.col("body").alias("xml"))).alias("bodies")
    )
    title = F.lit("")
    if titles is not None:
        whole = whole.join(titles, "page", "left")
        title = F.coalesce(F.concat(F.lit("  <work>\n    <work-title>"), escape("title"), F.lit("</work-title>\n  </work>\n")), F.lit(""))
    xml = F.concat(
        F.lit(HEAD), title, F.lit("  <part-list>\n"), _joined("heads"), F.lit("  </part-list>\n"), _joined("bodies"), F.lit("</score-partwise>\n")
    )
    return whole.select("page", "divisions", xml.alias("xml"))


def _part_window():
    from pyspark.sql import Window

    return Window.partitionBy("page", "part")


def write(docs: DataFrame, path: str) -> None:
    """One Parquet-free text row for each page, partitioned by page: ``path/page=.../part-*.txt``."""
    docs.select("page", "xml").write.partitionBy("page").option("lineSep", "").text(path)


def staff_positions(staffs: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """``page, value``: one line for each staff (grand flag, centre and size as shares of the page), in order."""
    def share(x: str, of: str) -> Column:
        return F.format_string("%.6f", F.col(x) / F.col(of))

    line = F.concat_ws(" ", F.col("grand").cast("int").cast("string"), share("cx", width), share("cy", height), share("w", width), share("h", height))
    return staffs.orderBy("page", "cy", "cx").select("page", line.alias("value"))
