"""What tablature pages tell, and what is left to ask."""

from __future__ import annotations

from staveline.plans import tab_needs

SYSTEMS = (
    "page long, system int, lines int, read_from string, instrument struct<kind:string,text:string,confidence:double>, "
    "tuning struct<status:string,source:string,strings:array<string>,text:string,confidence:double>, capo struct<fret:int,text:string,confidence:double>, meter struct<num:int,den:int,text:string>"
)
BANJO = ["D4", "B3", "G3", "D3", "G4"]


def test_prerequisites_and_needs(spark):
    spelt = lambda strings, status="read", source="text": (status, source, strings, "gDGBD", 0.9)
    systems = spark.createDataFrame([
        (1, 0, 5, "page", None, None, None, None), (1, 1, 5, "page", None, spelt(BANJO), (2, "Capo 2", 0.8), (3, 4, "3/4")),
        (2, 0, 6, "text_layer", ("guitar", "Guitar", 0.7), spelt(["E4"] * 6, source="named"), None, (4, 4, "4/4")),
        (3, 0, 6, "page", ("banjo5", "Banjo", 0.6), spelt(BANJO, status="string_count"), None, None),
        (4, 0, 4, "page", None, spelt(None, status="unknown_name", source=None), None, None),
    ], SYSTEMS)
    ev = lambda page, ticks, start=0: [(page, 0, k, float(start + 10 * k), t) for k, t in enumerate(ticks, 1)]
    events = ev(1, [960, 960, 960]) + ev(2, [960, 960, 960, None]) + ev(3, [None] * 8) + ev(4, [960, 0, 960, 960, 960])
    events = spark.createDataFrame(events, "page long, system int, seq int, x double, ticks long")
    lines = spark.createDataFrame([(2, 0, 35.0, False, False)], "page long, system int, x double, repeat_start boolean, repeat_end boolean")
    got = {r.page: r for r in tab_needs.prerequisites(systems, events, lines).collect()}
    one = got[1]
    assert one.needs == [] and one.instrument.value == "banjo5" and "bottom line, G4" in one.instrument.evidence and one.tuning.value == BANJO
    assert (one.capo.status, one.capo.value, one.meter.value.num, one.durations.evidence, one.durations.source) == ("read", 2, 3, "1 of 1 bars sum to 3/4", "page_marks")
    two = got[2]
    assert two.needs == ["durations"] and two.instrument.evidence == '"Guitar" over 6-line tab' and two.tuning.evidence == '"gDGBD", a named tuning' and two.tuning.source == "text_layer"
    assert two.capo.status == "assumed" and two.durations.confidence == 0.5
    assert two.durations.evidence == "1 of 2 bars sum to 4/4; not: bar 1 (system 1) holds 3 of 4 quarters" and two.durations.read == "stems under 3 of 4 notes"
    three = got[3]
    assert three.needs == ["instrument", "tuning", "meter", "durations"] and three.instrument.evidence == '"Banjo" names a 5-string instrument over a 6-line tab' and three.instrument.read == "Banjo"
    assert three.tuning.evidence == '"gDGBD" is a 5-string tuning over a 6-line tab' and len(three.candidates) == 10 and "draws no rhythm" in three.durations.evidence
    four = got[4]
    assert four.needs == ["instrument", "tuning", "meter", "durations"] and "the reader does not know" in four.tuning.evidence and len(four.candidates) == 4
    assert four.meter.evidence.startswith("no time signature printed; bars that fit: 4/4 1/1, 2/2 1/1, 2/4 0/1") and "meter, which is missing" in four.durations.evidence


def test_answers_settle_what_they_fit(spark):
    systems = spark.createDataFrame([(k, 0, 4, "page", None, None, None, None) for k in (1, 2)], SYSTEMS)
    events = spark.createDataFrame([(k, 0, n, float(n), 0 if n == 2 else None) for k in (1, 2) for n in range(5)], "page long, system int, seq int, x double, ticks long")
    lines = spark.createDataFrame([], "page long, system int, x double, repeat_start boolean, repeat_end boolean")
    answers = spark.createDataFrame([(1, "mandolin", ["E5", "A4", "D4", "G3"], 3, 2, 2, 960), (2, "guitar", ["E5", "H4", "D4", "G3"], 13, 0, 4, None)], "page long, instrument string, tuning array<string>, capo int, num int, den int, uniform_ticks long")
    got = {r.page: r for r in tab_needs.prerequisites(systems, events, lines, answers).collect()}
    assert got[1].needs == [] and (got[1].instrument.source, got[1].capo.value, got[1].durations.source) == ("musician", 3, "musician")
    two = got[2]
    assert two.needs == ["instrument", "tuning", "meter", "durations"] and two.capo.status == "assumed"
    assert two.instrument.evidence == '4 lines and no instrument named on the page; the answer "guitar" does not fit this instrument'
    assert two.tuning.evidence == 'no tuning printed; the answer ["E5","H4","D4","G3"] does not fit this tuning'
    assert tab_needs.prerequisites(systems.limit(0), events, lines).count() == 0
