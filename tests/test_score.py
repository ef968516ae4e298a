"""Scores from decoded tokens."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from fractions import Fraction

import pytest

from staveline.sinks import score
from staveline.sinks.score import Token


def _note(rhythm="note_4", pitch="A4", **more):
    return Token(rhythm, pitch, **more)


def _mark(rhythm, **more):
    return Token(rhythm, ".", ".", ".", ".", **more)


def _part(*tokens, title="t"):
    xml, columns = score.score([list(tokens)], title)
    return ET.fromstring(xml.encode()), columns


@pytest.mark.parametrize(("rhythm", "share", "kern", "dots", "tuplet"), [
    ("note_4", Fraction(1, 4), 4, 0, None), ("note_4.", Fraction(3, 8), 4, 1, None), ("note_2..", Fraction(7, 8), 2, 2, None), ("rest_12", Fraction(1, 12), 8, 0, (3, 2)),
    ("note_6", Fraction(1, 6), 4, 0, (3, 2)), ("note_20", Fraction(1, 20), 16, 0, (5, 4)), ("note_0", Fraction(1), 0, 0, None), ("note_8G", Fraction(0), 8, 0, None), ("clef_G2", Fraction(0), 1, 0, None),
])
def test_lengths(rhythm, share, kern, dots, tuplet):
    found = score.length_of(rhythm)
    assert (found.share, found.kern, found.dots, found.tuplet) == (share, kern, dots, tuplet)


def test_chords_of_two_lengths_go_back_and_share_staff_voices():
    root, columns = _part(_note("note_2", "C5", column=3), Token("chord"), _note("note_4", "A4", column=4), _note("note_4", "B4"), _mark("barline"))
    (measure,) = root.iter("measure")
    assert [e.tag for e in measure] == ["attributes", "note", "backup", "note", "backup", "note"]
    assert [n.find("voice").text for n in measure.iter("note")] == ["1", "2", "1"] and columns == [4, 3, None]
    assert [b.find("duration").text for b in measure.iter("backup")] == ["1", "1"]


def test_two_staves_are_written_one_after_the_other():
    root, _ = _part(_note("note_4", "C5"), Token("chord"), _note("note_4", "C3", position="lower"), Token("chord"), _note("note_4", "E3", position="lower"))
    notes = list(root.iter("note"))
    assert [n.find("staff").text for n in notes] == ["1", "2", "2"] and [n.find("voice").text for n in notes] == ["1", "5", "5"]
    assert notes[2].find("chord") is not None and root.find(".//part-symbol").text == "brace" and root.find(".//part-name").text == "Piano"
    assert root.find(".//backup/duration").text == "1"


def test_tuplets_are_marked_in_full_measures_only():
    full, _ = _part(*[_note("note_12")] * 3, _note(), _mark("barline"), *[_note("note_12")] * 2, _mark("barline"))
    marks = [[t.get("type") for t in m.iter("tuplet")] for m in full.iter("measure")]
    assert marks == [["start", "stop"], []] and full.find(".//divisions").text == "3"
    assert {n.findtext("time-modification/actual-notes") for n in full.iter("note")} == {"3", None}


def test_repeats_and_endings():
    root, _ = _part(_note(), _mark("repeatStart"), _mark("voltaStart"), _note(), _mark("voltaStop"), _mark("repeatEnd"), _mark("voltaStart"), _note(), _mark("voltaDiscontinue"), _mark("repeatEndStart"), _note(), _mark("bolddoublebarline"))
    lines = [[(b.get("location"), [(e.tag, dict(e.attrib), e.text) for e in b]) for b in m.iter("barline")] for m in root.iter("measure")]
    assert lines[1] == [
        ("right", [("ending", {"number": "1", "type": "stop"}, None), ("repeat", {"direction": "forward"}, None)]), ("left", [("ending", {"number": "1", "type": "start"}, None)]),
    ]
    assert lines[2][0][1][0][1] == {"number": "2", "type": "start"} and lines[2][1][1][0][1] == {"number": "2", "type": "discontinue"}
    assert lines[3][0][1] == [("bar-style", {}, "heavy-heavy"), ("repeat", {"direction": "forward"}, None)]


def test_attributes_articulations_and_slurs():
    root, _ = _part(
        _mark("clef_F4", position="lower"), _mark("keySignature_-2"), _mark("timeSignature/8"), _note("note_8", "B3", lift="bb", articulation="tremolo_accent_fermata", slur="slurStart_slurStop", position="lower"),
        _note("note_4G", "C4", position="lower"), _note("note_8", "_", articulation="tremolo_tieStop", position="lower"), _mark("barline"), _mark("newline"), Token("rest_3m", "_"), _mark("doublebarline"), title='a < "b" & c',
    )
    first = root.find(".//measure")
    assert [e.tag for e in first.findall("attributes")[1]] == ["key", "time", "clef"] and first.findtext(".//beats") == "2" and first.findtext(".//fifths") == "-2"
    note = first.find("note")
    assert [e.tag for e in note] == ["pitch", "duration", "voice", "type", "staff", "notations"] and note.findtext("pitch/alter") == "-2"
    assert [(e.tag, e.get("type")) for e in note.find("notations")] == [("fermata", None), ("articulations", None), ("ornaments", None), ("slur", "stop"), ("slur", "start")]
    assert [t.get("type") for t in first.iter("tremolo")] == ["start", "stop"] and first.findall("note")[1].find("grace") is not None
    second = root.findall(".//measure")[1]
    assert [e.tag for e in second] == ["print", "attributes", "barline"] and second.findtext(".//multiple-rest") == "3" and root.findtext(".//work-title") == 'a < "b" & c'


SCHEMA = "page long, part int, seq int, rhythm string, pitch string, lift string, articulation string, slur string, position string, column int"


def test_scores_of_pages(spark):
    row = lambda page, part, seq, rhythm, pitch="_", **m: (page, part, seq, rhythm, pitch, "_", m.get("art", "_"), "_", "upper", m.get("col"))
    rows = [row(1, 0, 2, "barline"), row(1, 0, 1, "note_4", "D4", col=5), row(1, 1, 1, "note_4", "E4"), row(2, 0, 1, "note_4", "C4", art="oops"), (None, 0, 1, "note_4", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    titles = spark.createDataFrame([(1, "One"), (2, None)], "page long, title string")
    out = {r.page: r for r in score.scores(df, titles).collect()}
    assert set(out) == {1, 2, None} and out[1].columns == [5, None] and "<work-title>One" in out[1].xml and out[1].xml.count("<part ") == 2
    assert out[2].xml is None and "oops" in out[2].error and "<rest />" in out[None].xml
    assert score.scores(df.limit(0)).count() == 0
    twice = score.scores(df.union(df).filter("page = 1")).first()
    assert twice.xml.count("<note>") == 4
