"""What a tablature page must tell before it is a tune, what it tells, and what is left to ask.

Tables: ``systems`` (``page, system, lines, read_from, instrument struct<kind, text, confidence>, tuning struct<status, source,
strings, text, confidence>, capo struct<fret, text, confidence>, meter struct<num, den, text>``; null: not on that system),
``events`` and ``barlines`` as in ``plans.tab``, and ``answers`` (``page, instrument, tuning array<string>, capo, num, den,
uniform_ticks``; null: not answered).

A prerequisite is ``struct<status, value, confidence, evidence, source, read>``; its status is ``read``, ``assumed`` or
``missing``. An answer that fits settles it; one that doesn't is named in the evidence of what stays missing. Everything is
one aggregate by page and expressions on its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveline.functions import notation
from staveline.functions.notation import WHOLE
from staveline.plans import tab, tab_text

#: Strings, courses and short strings (string, first fret) of each instrument.
INSTRUMENTS = {"banjo5": (5, 1, ((5, 5),)), "guitar": (6, 1, ()), "mandolin": (4, 2, ()), "tenorBanjo": (4, 1, ())}
#: The order in which needs are asked; the share of notes that must have stems; what stemless notes may be.
FIELDS = ("instrument", "tuning", "capo", "meter", "durations")
MIN_STEMMED = 0.25
UNIFORM = (("eighth", WHOLE // 8), ("quarter", WHOLE // 4))
MUSICIAN = "the musician's answer"


def strings_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(n)) for k, (n, _, _) in INSTRUMENTS.items()])


def _prerequisite(status, value, confidence, evidence, source=None, read=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    parts = {"status": lit(status).cast("string"), "value": value, "confidence": lit(confidence).cast("double"), "evidence": lit(evidence).cast("string"), "source": lit(source).cast("string"), "read": lit(read).cast("string")}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _refused(p: Column, answer: Column, field: str) -> Column:
    """``p`` with the answer that did not fit named in its evidence, if it is missing still."""
    told = F.concat(p["evidence"], F.lit("; the answer "), F.to_json(F.struct(answer.alias("a"))).substr(F.lit(6), F.length(F.to_json(F.struct(answer.alias("a")))) - 6), F.lit(f" does not fit this {field}"))
    return F.when(answer.isNotNull() & (p["status"] == "missing"), p.withField("evidence", told)).otherwise(p)


def _answered(fits: Column, answer: Column, p: Column, field: str) -> Column:
    return F.when(F.coalesce(fits, F.lit(False)), _prerequisite("read", answer, 1.0, MUSICIAN, "musician")).otherwise(_refused(p, answer, field))


def page_facts(systems: DataFrame) -> DataFrame:
    """One row a page: its line count, where texts were read, and the first system's reading of each kind."""
    first = lambda c, ok=None: F.min_by(c, F.when(F.col(c).isNotNull() if ok is None else ok, F.col("system")))
    return systems.groupBy("page").agg(
        F.coalesce(F.min_by("lines", "system"), F.lit(5)).alias("lines"),
        F.when(F.bool_or(F.col("read_from") == "text_layer"), "text_layer").otherwise("page_text").alias("text_source"),
        first("instrument").alias("named"), first("tuning").alias("tuned"), first("tuning", F.col("tuning.status") == "read").alias("spelt"),
        first("capo").alias("capo_read"), first("meter").alias("printed"),
    )


def instrument(answer: Column) -> Column:
    """From a name over as many lines as its strings, else from a fifth string above the fourth; ``value`` is the kind."""
    named, lines, spelt = F.col("named"), F.col("lines"), F.col("spelt")
    own = strings_of(named["kind"])
    quoted = F.concat(F.lit('"'), named["text"], F.lit('"'))
    by_name = _prerequisite("read", named["kind"], named["confidence"], F.concat(quoted, F.lit(" over "), lines, F.lit("-line tab")), F.col("text_source"))
    open_midi = F.transform(spelt["strings"], notation.midi_of_pitch)
    short = (lines == 5) & (F.try_element_at(open_midi, F.lit(5)) > F.try_element_at(open_midi, F.lit(4)))
    why = F.concat(F.lit("5 lines and a tuning whose bottom line, "), F.try_element_at(spelt["strings"], F.lit(5)), F.lit(', is above the line over it ("'), spelt["text"], F.lit("\"): a five-string banjo's short string"))
    by_tuning = _prerequisite("read", F.lit("banjo5"), spelt["confidence"], why, F.col("text_source"))
    nothing = F.when(named.isNull(), F.concat(lines, F.lit(" lines and no instrument named on the page"))).otherwise(
        F.concat(quoted, F.lit(" names a "), own, F.lit("-string instrument over a "), lines, F.lit("-line tab"))
    )
    missing = _prerequisite("missing", F.lit(None).cast("string"), F.coalesce(named["confidence"], F.lit(0.0)), nothing, None, named["text"])
    found = F.when(F.coalesce(own == lines, F.lit(False)), by_name).when(F.coalesce(short, F.lit(False)), by_tuning).otherwise(missing)
    return _answered(strings_of(answer) == lines, answer, found, "instrument")


def tuning(answer: Column) -> Column:
    """The first system's tuning that was read; ``value`` is pitch names, the top line first."""
    t, lines = F.col("tuned"), F.col("lines")
    quoted = F.concat(F.lit('"'), t["text"], F.lit('"'))
    read = _prerequisite("read", t["strings"], t["confidence"], F.concat(quoted, F.when(t["source"] == "named", ", a named tuning").otherwise("")), F.col("text_source"))
    why = F.when(t.isNull(), "no tuning printed").when(t["status"] == "unknown_name", F.concat(quoted, F.lit(" names a tuning the reader does not know"))).otherwise(
        F.concat(quoted, F.lit(" is a "), F.size(t["strings"]), F.lit("-string tuning over a "), lines, F.lit("-line tab"))
    )
    missing = _prerequisite("missing", F.lit(None).cast("array<string>"), F.coalesce(t["confidence"], F.lit(0.0)), why, None, t["text"])
    fits = (F.size(answer) == lines) & ~F.exists(answer, lambda p: notation.midi_of_pitch(p).isNull())
    return _answered(fits, answer, F.when(F.coalesce(t["status"] == "read", F.lit(False)), read).otherwise(missing), "tuning")


def capo(answer: Column) -> Column:
    """The first capo that was read; none is assumed where none is printed, and where an answer is no fret from 0 to 12."""
    c = F.col("capo_read")
    read = _prerequisite("read", c["fret"].cast("int"), c["confidence"], F.concat(F.lit('"'), c["text"], F.lit('"')), F.col("text_source"))
    none = _prerequisite("assumed", F.lit(0), None, "no capo printed")
    return F.when(F.coalesce(answer.between(0, 12), F.lit(False)), _prerequisite("read", answer.cast("int"), 1.0, MUSICIAN, "musician")).otherwise(F.when(c.isNull(), none).otherwise(read))


def meters_of(lengths: DataFrame) -> DataFrame:
    """``page, ranked``: every metre that is tried with the bars that fit it, best first (then in the order of trial), and ``bars``."""
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("num"), F.lit(d).alias("den")) for k, (n, d) in enumerate(tab.METERS)])
    keyed = lengths.withColumn("m", F.explode(tried)).withColumns({"own": F.col("page"), "page": F.struct("page", "m")})
    checked = tab.fit(keyed, (F.lit(WHOLE) * F.col("m.num") / F.col("m.den")).cast("long"))
    counts = checked.groupBy("own", "m").agg(F.count(F.when(F.col("fits"), 1)).alias("fit"), F.count("*").alias("bars"))
    row = F.struct((-F.col("fit")).alias("less"), F.col("m.k").alias("k"), F.col("m.num").alias("num"), F.col("m.den").alias("den"))
    return counts.groupBy(F.col("own").alias("page")).agg(F.array_sort(F.collect_list(row)).alias("ranked"), F.max("bars").alias("bars"))


def meter(num: Column, den: Column) -> Column:
    """The metre printed at the start of a system, else missing with all candidates ranked; ``value`` is ``struct<num, den>``."""
    p = F.col("printed")
    pair = lambda n, d: F.struct(n.cast("int").alias("num"), d.cast("int").alias("den"))
    where = F.when(F.col("text_source") == "text_layer", "text_layer").otherwise("page_marks")
    read = _prerequisite("read", pair(p["num"], p["den"]), 1.0, F.concat(p["text"], F.lit(" printed at the start of a system")), where)
    listed = F.array_join(F.transform("ranked", lambda m: F.concat(m["num"], F.lit("/"), m["den"], F.lit(" "), -m["less"], F.lit("/"), F.col("bars"))), ", ")
    empty = F.array_join(F.array(*[F.lit(f"{n}/{d} 0/0") for n, d in tab.METERS]), ", ")
    missing = _prerequisite("missing", F.lit(None).cast("struct<num:int,den:int>"), 0.0, F.concat(F.lit("no time signature printed; bars that fit: "), F.coalesce(listed, empty)))
    fits = (num > 0) & (den > 0)
    answered = _prerequisite("read", pair(num, den), 1.0, MUSICIAN, "musician")
    return F.when(F.coalesce(fits, F.lit(False)), answered).otherwise(F.when(p.isNotNull(), read).otherwise(missing))


def _trimmed(x: Column) -> Column:
    """A number as text, without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def durations(checks: DataFrame) -> DataFrame:
    """``page, checks, fitting, unfit``: how many bars sum to the metre, and the words for those that do not."""
    stemless = F.when(F.col("open") == 0, "").when(F.col("open") == 1, " and a note with no stem").otherwise(F.concat(F.lit(" and "), F.col("open"), F.lit(" notes with no stem")))
    words = F.concat(F.lit("bar "), F.col("bar") + 1, F.lit(" (system "), F.col("system") + 1, F.lit(") holds "), _trimmed(F.col("held")), F.lit(" of "), _trimmed(F.col("full") / (WHOLE // 4)), F.lit(" quarters"), stemless)
    return checks.groupBy("page").agg(
        F.count("*").alias("checks"), F.count(F.when(F.col("fits"), 1)).alias("fitting"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fits"), F.struct("bar", words.alias("w"))))), lambda x: x["w"]), ", ").alias("unfit"),
    )


def prerequisites(systems: DataFrame, events: DataFrame, barlines: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``page, instrument, tuning, capo, meter, durations`` (a prerequisite each; the value of ``durations`` is how many bars
    were checked), ``candidates`` of the tuning and ``needs``, the fields that are missing, in the order of asking."""
    facts = page_facts(systems)
    if answers is None:
        answers = facts.limit(0).select("page", *[F.lit(None).cast(t).alias(c) for c, t in (("instrument", "string"), ("tuning", "array<string>"), ("capo", "int"), ("num", "int"), ("den", "int"), ("uniform_ticks", "long"))])
    told = answers.select("page", F.struct("instrument", "tuning", "capo", "num", "den", "uniform_ticks").alias("answer"))
    sized = events.join(told.select("page", F.col("answer.uniform_ticks").alias("__uniform")), "page", "left")
    # An answer for all notes leaves grace notes (0 ticks) as they are.
    sized = sized.withColumn("ticks", F.when(F.col("__uniform").isNotNull() & ~F.coalesce(F.col("ticks") == 0, F.lit(False)), F.col("__uniform")).otherwise(F.col("ticks"))).drop("__uniform")
    barred = tab.bars(sized, barlines)
    lengths = tab.bar_lengths(barred).join(barred.groupBy("page", "bar").agg(F.min("system").alias("system")), ["page", "bar"])
    stems = sized.groupBy("page").agg(F.count("*").alias("events"), F.count("ticks").alias("stemmed"))
    row = facts.join(told, "page", "left").join(meters_of(lengths), "page", "left").join(stems, "page", "left")
    row = row.na.fill(0, ["events", "stemmed", "bars"]).withColumn("meter", meter(F.col("answer.num"), F.col("answer.den")))
    settled = row.filter("meter.status <> 'missing'").select("page", (F.lit(WHOLE) * F.col("meter.value.num") / F.col("meter.value.den")).cast("long").alias("bar_ticks"))
    checked = tab.fit(lengths.join(settled, "page"), F.col("bar_ticks"))
    held = (F.col("known") + F.coalesce(F.col("open") * F.col("long"), F.lit(0))) / (WHOLE // 4)
    row = row.join(durations(checked.withColumn("held", held)), "page", "left").na.fill(0, ["checks", "fitting"])
    row = row.withColumn("instrument", instrument(F.col("answer.instrument"))).withColumn("tuning", tuning(F.col("answer.tuning")))
    row = row.withColumn("capo", capo(F.col("answer.capo"))).withColumn("durations", _durations(F.col("answer.uniform_ticks").isNotNull()))
    kind = F.when(F.col("instrument.status") != "missing", F.col("instrument.value"))
    needs = F.filter(F.array(*[F.when(F.col(f"{f}.status") == "missing", f) for f in FIELDS]), lambda f: f.isNotNull())
    return row.select("page", *FIELDS, F.when(F.col("tuning.status") == "missing", tab_text.tuning_candidates(kind, F.col("lines"))).alias("candidates"), needs.alias("needs"))


def _durations(answered: Column) -> Column:
    stems = F.concat(F.lit("stems under "), F.col("stemmed"), F.lit(" of "), F.col("events"), F.lit(" notes"))
    offers = ", or ".join(f"an {name}" for name, _ in UNIFORM)
    none = F.lit(None).cast("long")
    unruled = _prerequisite("missing", none, 0.0, F.concat(stems, F.lit(f": the page draws no rhythm; the candidates give every note {offers}")))
    unmetered = _prerequisite("missing", none, 0.0, "durations are checked against the meter, which is missing", None, stems)
    m = F.col("meter.value")
    sums = F.concat(F.col("fitting"), F.lit(" of "), F.col("checks"), F.lit(" bars sum to "), m["num"], F.lit("/"), m["den"])
    good = _prerequisite("read", F.col("checks"), 1.0, sums, F.when(answered, "musician").otherwise("page_marks"))
    bad = _prerequisite("missing", none, F.col("fitting") / F.greatest(F.col("checks"), F.lit(1)), F.concat(sums, F.lit("; not: "), F.col("unfit")), None, stems)
    return (
        F.when(~answered & (F.col("stemmed") < MIN_STEMMED * F.col("events")), unruled)
        .when(F.col("meter.status") == "missing", unmetered)
        .when(F.col("fitting") == F.col("checks"), good)
        .otherwise(bad)
    )
