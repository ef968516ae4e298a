"""Tunings, capos and instruments that texts name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from staveline.plans import tab_text

LETTERS = [
    ("gDGBD", "letters", ["G", "D", "G", "B", "D"]), ("g DGBD", "letters", ["G", "D", "G", "B", "D"]), ("Tuning: EADGBE", "letters", list("EADGBE")), ("D A D F♯ A D", "letters", ["D", "A", "D", "F#", "A", "D"]),
    ("accordage: ré la ré sol la ré", "letters", list("DADGAD")), ("a b c", None, None), ("the A B C D song", None, None), ("tuning fancy", "unknown_name", None), ("Accordée f#DF#AD", "letters", ["F#", "D", "F#", "A", "D"]),
]


@pytest.mark.parametrize(("text", "form", "notes"), LETTERS)
def test_letters(text, form, notes):
    got = tab_text.parse(text)
    assert (got["form"], got["notes"]) == (form, notes)


@pytest.mark.parametrize(("text", "fret"), [
    ("Capo 3", 3), ("capo: 2nd fret", 2), ("Capo on the fret 5", 5), ("capodastre case IV", 4), ("capo IIII", None), ("no capo", 0), ("sans capo 3", 0), ("Capo 13", None), ("capo", None), ("capo à la case 2", 2), ("capo 2x", None),
])
def test_capos(text, fret):
    assert tab_text.parse(text)["capo"] == fret


def test_names_need_an_announcement_or_nothing_else():
    assert tab_text.parse("Open G")["name"] == "open g" and tab_text.parse("open g, capo 2") == {"capo": 2, "form": "named", "notes": None, "assigned": None, "name": "open g"}
    assert tab_text.parse("walking in open g")["form"] is None and tab_text.parse("walking, tuning open g")["name"] == "open g"
    assert tab_text.parse("double drop d")["name"] == "double drop d" and tab_text.parse("(6) = D, ①→e")["assigned"] == [{"string": 6, "note": "D"}, {"string": 1, "note": "E"}]


def test_tunings_of_readings(spark):
    rows = [(1, "open g", 5), (2, "open g", 6), (3, "sawmill", 6), (4, "6=D", 6), (5, "EADGBE", 5), (6, "tuning odd", 5), (7, "nothing", 5), (8, None, 5), (9, "5=G#", 4), (10, "1=f 1=F#", 6)]
    df = spark.createDataFrame(rows, "id int, text string, lines int").withColumn("p", tab_text.parsed("text"))
    got = {r.id: (r.t.status, r.t.source, r.t.strings) if r.t else None for r in df.select("id", tab_text.tuning("p", "lines").alias("t")).collect()}
    assert got == {
        1: ("read", "named", ["D4", "B3", "G3", "D3", "G4"]), 2: ("read", "named", ["D4", "B3", "G3", "D3", "G2", "D2"]), 3: ("string_count", "named", ["D4", "C4", "G3", "D3", "G4"]),
        4: ("read", "text", ["E4", "B3", "G3", "D3", "A2", "D2"]), 5: ("string_count", "text", ["E4", "B3", "G3", "D3", "A2", "E2"]), 6: ("unknown_name", None, None), 7: None, 8: None,
        9: ("string_count", "text", ["E4", "B3", "G3", "D3", "G#2", "E2"]), 10: ("read", "text", ["F#4", "B3", "G3", "D3", "A2", "E2"]),
    }
    assert df.limit(0).select(tab_text.tuning("p", "lines")).count() == 0


def test_labels_instruments_and_candidates(spark):
    one = spark.createDataFrame([(["D", "b", " G ", "d", "g"], ["D", "x", "G", "D"], ["D", "G", "B"], "Tenor Banjo in G", "Old-time clawhammer", "Guitare", "violin")], "a array<string>, b array<string>, c array<string>, t1 string, t2 string, t3 string, t4 string")
    got = one.select(*[tab_text.letter_labels(c).alias(c) for c in "abc"], *[tab_text.instrument_kind(c).alias(c) for c in ("t1", "t2", "t3", "t4")]).first()
    assert got.a == ["G", "D", "G", "B", "D"] and got.b is None and got.c is None and (got.t1, got.t2, got.t3, got.t4) == ("tenorBanjo", "banjo5", "guitar", None)
    tunings = one.select(*[tab_text.tuning_candidates(F.lit(k), F.lit(n)).alias(f"c{i}") for i, (k, n) in enumerate([("mandolin", 4), ("tenorBanjo", 4), (None, 4), (None, 5), ("guitar", 6), (None, 7)])]).first()
    assert [len(t or []) for t in tunings] == [2, 2, 4, 7, 10, 0] and tunings[0][0] == ["E5", "A4", "D4", "G3"] and tunings[3][0] == ["D4", "B3", "G3", "D3", "G4"]
