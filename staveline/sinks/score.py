"""Whole MusicXML scores from decoded tokens: one document a page, with the page columns of its notes.

``tokens`` is ``page, part, seq, rhythm, pitch, lift, articulation, slur, position, column``. What a token means depends on
those before it (open tuplets, endings, tremolos, voices), so that a page is folded in order by one Arrow function;
pages are dealt out by key, and a page is the bound of what a worker holds.

A page that cannot be written has a null ``xml`` and the reason in ``error``; a page without tokens has no row. Null
fields count as empty, a null title as an empty one, rows of one place are taken in the order of their text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable
from fractions import Fraction
from itertools import groupby
from statistics import median
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.operators.sequential import fold_groups

#: What a decoder writes where a head has nothing to say, and where it doesn't apply.
EMPTY, NONOTE = "_", "."
#: Semitones of the written accidentals.
ALTER = {"#": 1, "##": 2, "b": -1, "bb": -2, "N": 0}
#: Note type names by the denominator of the length.
TYPES = {0: "breve", 1: "whole", 2: "half", 4: "quarter", 8: "eighth", 16: "16th", 32: "32nd", 64: "64th", 128: "128th"}
#: Articulations by the element that holds them; the value is the element's name and attributes.
PLAIN = {"fermata": ("fermata", {}), "arpeggiate": ("arpeggiate", {})} | {
    f"{kind}{end}": (name, {"type": end.lower()}) for kind, name in (("slur", "slur"), ("tie", "tied")) for end in ("Start", "Stop")
}
MARKS = {k: k for k in ("accent", "staccato", "staccatissimo", "tenuto", "caesura", "doit")} | {"breathMark": "breath-mark"}
ORNAMENTS = {"trill": "trill-mark", "turn": "inverted-turn"}
SLURS = {"slurStart": ("start",), "slurStop": ("stop",), "slurStart_slurStop": ("stop", "start")}
#: The order in which the schema wants an element's children.
ORDER = {
    "attributes": ("divisions", "key", "time", "staves", "part-symbol", "clef", "measure-style"),
    "barline": ("bar-style", "ending", "repeat"),
    "note": ("grace", "chord", "pitch", "rest", "duration", "voice", "type", "dot", "time-modification", "staff", "notations"),
    "pitch": ("step", "alter", "octave"),
}
#: Name, sound and MIDI program of a part, by whether it has two staves.
INSTRUMENT = {True: ("Piano", "keyboard.piano", 1), False: ("Voice", "voice", 54)}
HEADER = '<?xml version="1.0" encoding="UTF-8" standalone="no"?>\n'
#: Beats of a measure before any metre is read.
BEATS = 64


class ScoreError(ValueError):
    """Tokens that MusicXML has no element for."""


class Element:
    """An XML element; children that the schema orders are written in its order, others as they came."""

    def __init__(self, tag: str, text: object = "", **attributes: object):
        self.tag, self.text, self.children = tag, str(text), []
        self.attributes = {k.replace("_", "-"): str(v) for k, v in attributes.items()}

    def add(self, child: Element) -> Element:
        self.children.append(child)
        return child

    def leaf(self, tag: str, text: object) -> Element:
        return self.add(Element(tag, text))

    def first(self, tag: str, **attributes: str) -> Element | None:
        return next((c for c in self.children if c.tag == tag and attributes.items() <= c.attributes.items()), None)

    def lines(self, depth: int = 0) -> Iterable[str]:
        pad, named = "  " * depth, "".join(f' {k}="{escaped(v, quotes=True)}"' for k, v in self.attributes.items())
        if not self.children:
            yield f"{pad}<{self.tag}{named}>{escaped(self.text)}</{self.tag}>" if self.text else f"{pad}<{self.tag}{named} />"
            return
        yield f"{pad}<{self.tag}{named}>{escaped(self.text)}"
        order = ORDER.get(self.tag)
        for child in sorted(self.children, key=lambda c: order.index(c.tag)) if order else self.children:
            yield from child.lines(depth + 1)
        yield f"{pad}</{self.tag}>"


def escaped(text: str, quotes: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;") if quotes else text


class Token(NamedTuple):
    rhythm: str
    pitch: str = EMPTY
    lift: str = EMPTY
    articulation: str = EMPTY
    slur: str = EMPTY
    position: str = "upper"
    column: int | None = None

    @property
    def sounds(self) -> bool:
        return self.rhythm.startswith(("note", "rest"))

    @property
    def grace(self) -> bool:
        return "G" in self.rhythm

    @property
    def staff(self) -> int:
        return 2 if self.position == "lower" else 1

    def text(self) -> str:
        return " ".join(self[:6])


class Length(NamedTuple):
    """``share`` of a whole note; ``actual`` notes in the time of ``normal``; ``kern``: the denominator that is printed."""

    share: Fraction
    kern: int = 1
    dots: int = 0
    actual: int = 1
    normal: int = 1

    @property
    def tuplet(self) -> tuple[int, int] | None:
        return (self.actual, self.normal) if self.actual != self.normal else None


def length_of(rhythm: str) -> Length:
    """The length that a rhythm such as ``note_8.`` or ``rest_12`` names; other symbols have none."""
    if not rhythm.startswith(("note", "rest")):
        return Length(Fraction(0))
    kern = (rhythm.split("_") + [""])[1]
    digits, dots = re.match(r"[0-9]*", kern)[0], kern.count(".")
    base = int(digits) if digits else 4
    if "G" in kern:
        return Length(Fraction(0), base, dots)
    power = 1 << (base.bit_length() - 1) if base else 1
    time = Fraction(max(base, 1), power)  # e.g. 6: three in the time of two quarters
    share = Fraction(1, power) * (2 - Fraction(1, 2**dots)) / time
    return Length(share, power if base else 0, dots, time.numerator, time.denominator)


class Chord:
    """Symbols at one place, and the tuplet mark that it bears."""

    def __init__(self, symbols: list[Token]):
        self.symbols, self.mark = sorted(symbols, key=Token.text, reverse=True), ""

    @property
    def is_bar(self) -> bool:
        return "barline" in self.symbols[0].rhythm or "repeat" in self.symbols[0].rhythm

    @property
    def share(self) -> Fraction:
        """The shortest of its lengths."""
        return min((length_of(s.rhythm).share for s in self.symbols if s.sounds), default=Fraction(0))

    @property
    def tuplet(self) -> tuple[int, int] | None:
        return next((t for s in self.symbols if s.sounds and (t := length_of(s.rhythm).tuplet)), None)

    def by_staff(self) -> list[list[Token]]:
        """The upper staff's symbols and the others; rests alone on the lower staff go first."""
        upper = [s for s in self.symbols if s.position == "upper"]
        rest = [s for s in self.symbols if s.position != "upper"]
        ordered = [rest, upper] if all(s.rhythm.startswith("rest") for s in rest) else [upper, rest]
        return [x for x in ordered if x]


def chords_of(tokens: Iterable[Token]) -> list[Chord]:
    """Symbols joined by chord markers; a marker before the first symbol joins nothing yet."""
    groups: list[list[Token]] = []
    joined = False
    for t in tokens:
        if t.rhythm == "chord":
            joined = True
        elif joined and groups:
            groups[-1].append(t)
            joined = False
        else:
            groups.append([t])
    return [Chord(g) for g in groups]


def mark_tuplets(chords: list[Chord]) -> None:
    """Opens and closes full tuplets of each measure; a measure with an incomplete one is left unmarked."""
    closed, numbers = 0, []
    for c in chords:
        numbers.append(closed)
        closed += c.is_bar
    for _, pairs in groupby(zip(numbers, chords, strict=True), key=lambda p: p[0]):
        measure, at, marks = [c for _, c in pairs], 0, []
        while at < len(measure):
            kind = measure[at].tuplet
            if kind is None:
                at += 1
                continue
            run = measure[at : at + kind[0]]
            if len(run) < kind[0] or any(c.tuplet != kind for c in run):
                marks = []
                break
            marks += [(run[0], "start"), (run[-1], "stop")]
            at += kind[0]
        for chord, mark in marks:
            chord.mark = mark


def divisions_and_metre(chords: list[Chord]) -> tuple[int, Fraction]:
    """The common denominator of all lengths, and the median length of the measures (1 without any)."""
    dens, measures, now = [4], [], Fraction(0)
    for c in chords:
        if c.is_bar and now:
            measures.append(now)
            now = Fraction(0)
        elif c.share:
            dens.append(c.share.denominator)
            now += c.share
    measures += [now] if now else []
    return math.lcm(*dens), median(measures) if measures else Fraction(1)


def voices_of(items: list[Element]) -> None:
    """Deals a measure's notes to the lowest free voice of their staff, by start, then end."""
    events: list[list] = []  # start, end, staff, notes
    now = chord_start = 0
    for e in items:
        length = int(d.text) if (d := e.first("duration")) else 0
        if e.tag == "backup":
            now -= length
        elif e.tag == "note":
            staff, tone = int(e.first("staff").text), e.first("chord") is not None
            start = chord_start if tone else now
            if tone and events and events[-1][:3] == [start, start + length, staff]:
                events[-1][3].append(e)
                continue
            if not tone:
                chord_start, now = start, now + length
            events.append([start, start + length, staff, [e]])
    busy: dict[int, dict[int, int]] = defaultdict(dict)  # by staff: end of each voice
    for start, end, staff, notes in sorted(events, key=lambda e: (e[0], e[1])):
        free = {v: z for v, z in busy[staff].items() if z > start}
        voice = next(v for v in range(1, len(free) + 2) if v not in free)
        busy[staff] = free | {voice: end}
        for n in notes:
            n.first("voice").text = str((staff - 1) * 4 + voice)


class Part:
    """The measures of one voice, written symbol by symbol."""

    def __init__(self, chords: list[Chord], two_staves: bool):
        self.division, self.metre = divisions_and_metre(chords)
        self.beats, self.tremolo, self.columns = BEATS, False, []
        self.ending, self.ended = 1, -10
        self.measures: list[Element] = []
        self.now = Element("measure", number=1)
        attributes = self.now.add(Element("attributes"))
        attributes.leaf("divisions", self.division // 4)
        if two_staves:
            attributes.leaf("staves", 2)
            attributes.leaf("part-symbol", "brace")
        mark_tuplets(chords)
        for k, chord in enumerate(chords):
            symbol = chord.symbols[0]
            rest_of_many = len(chord.symbols) == 1 and symbol.rhythm.endswith("m")
            if symbol.sounds and not rest_of_many:
                self.notes(chord)
                attributes = None
            elif symbol.sounds or symbol.rhythm.startswith(("clef", "keySignature", "timeSignature")):
                if attributes is None or symbol.rhythm.startswith("clef"):
                    attributes = self.now.add(Element("attributes"))
                self.attribute(chord, attributes)
            else:
                self.structure(symbol.rhythm, last=k == len(chords) - 1)
                attributes = None
        if self.now.children:
            self.close()

    def close(self) -> None:
        voices_of(self.now.children)
        self.measures.append(self.now)
        self.now = Element("measure", number=len(self.measures) + 1)

    def ticks(self, share: Fraction) -> int:
        if (out := int(share * self.division)) <= 0:
            raise ScoreError(f"a length of {out} divisions")
        return out

    def backup(self, share: Fraction) -> None:
        self.now.add(Element("backup")).leaf("duration", self.ticks(share))

    def notes(self, chord: Chord) -> None:
        staffs = chord.by_staff()
        for k, symbols in enumerate(staffs):
            longest = max(length_of(s.rhythm).share for s in symbols)
            layers: dict[Fraction, list[Token]] = defaultdict(list)
            for s in symbols:
                layers[Fraction(0) if s.grace else length_of(s.rhythm).share or longest].append(s)
            ordered = sorted(layers.items())
            for layer, (share, tones) in enumerate(ordered):
                for n, tone in enumerate(tones):
                    self.note(tone, layer, n > 0, chord.mark)
                if layer < len(ordered) - 1 and share:
                    self.backup(share)
            over = ordered[-1][0] - (chord.share if k == len(staffs) - 1 else 0)
            if over > 0:
                self.backup(over)

    def note(self, t: Token, layer: int, tone: bool, mark: str) -> None:
        self.columns.append(t.column)
        note, length = self.now.add(Element("note")), length_of(t.rhythm)
        if tone:
            note.add(Element("chord"))
        note.add(self.pitch(t, length))
        if t.grace:
            note.add(Element("grace"))
        kern = length.kern if t.grace else 0 if not length.share else length.kern or 1
        if kern not in TYPES:
            raise ScoreError(f"no note type for 1/{kern}")
        note.leaf("type", TYPES[kern])
        if not t.grace:
            note.leaf("duration", self.ticks(length.share) if length.share else self.beats)
        note.leaf("staff", t.staff)
        note.leaf("voice", (t.staff - 1) * 4 + layer + 1)
        for _ in range(length.dots):
            note.add(Element("dot"))
        if length.tuplet:
            change = note.add(Element("time-modification"))
            change.leaf("actual-notes", length.actual)
            change.leaf("normal-notes", length.normal)
        note.add(self.notations(t, mark if length.tuplet else ""))

    @staticmethod
    def pitch(t: Token, length: Length) -> Element:
        if t.pitch == EMPTY:
            return Element("rest", **({} if length.share else {"measure": "yes"}))
        if t.pitch == NONOTE:
            return Element("rest")
        out = Element("pitch")
        out.leaf("step", t.pitch[:1])
        out.leaf("octave", int(t.pitch[1:2]) if t.pitch[1:2].isdigit() else "NaN")
        if t.lift not in (EMPTY, NONOTE):
            if t.lift not in ALTER:
                raise ScoreError(f"unknown accidental {t.lift}")
            out.leaf("alter", ALTER[t.lift])
        return out

    def notations(self, t: Token, mark: str) -> Element:
        out, marks, ornaments = Element("notations"), [], []
        for name in t.articulation.split("_"):
            if name in PLAIN:
                tag, attributes = PLAIN[name]
                out.add(Element(tag, **attributes))
            elif name in MARKS:
                marks.append(Element(MARKS[name]))
            elif name in ORNAMENTS:
                ornaments.append(Element(ORNAMENTS[name]))
            elif name == "tremolo":
                self.tremolo = not self.tremolo
                ornaments.append(Element("tremolo", 3, type="start" if self.tremolo else "stop"))
            elif name not in ("", NONOTE):
                raise ScoreError(f"unsupported articulation {t.articulation}")
        if mark:
            out.add(Element("tuplet", type=mark))
        for tag, held in (("articulations", marks), ("ornaments", ornaments)):
            if held:
                out.add(Element(tag)).children += held
        if t.slur not in SLURS and t.slur not in (EMPTY, NONOTE, ""):
            raise ScoreError(f"unsupported slur {t.slur}")
        for kind in SLURS.get(t.slur, ()):
            out.add(Element("slur", number=t.staff, type=kind))
        return out

    def attribute(self, chord: Chord, out: Element) -> None:
        symbol = chord.symbols[0]
        kind, _, value = symbol.rhythm.partition("_")
        if kind == "clef":
            for c in chord.symbols:
                if c.rhythm.startswith("clef"):
                    sign = (c.rhythm.split("_") + [""])[1]
                    clef = out.add(Element("clef", number=c.staff))
                    clef.leaf("sign", sign[:1])
                    clef.leaf("line", sign[1:2])
        elif kind == "keySignature":
            out.add(Element("key")).leaf("fifths", int(value))
        elif kind.startswith("timeSignature"):
            unit = symbol.rhythm.split("/")[1]
            self.beats = max(int(self.metre * int(unit)), 1)
            time = out.add(Element("time"))
            time.leaf("beats", self.beats)
            time.leaf("beat-type", unit)
        elif out.first("measure-style") is None:
            out.add(Element("measure-style")).leaf("multiple-rest", int(value.replace("m", "")))

    def barline(self, place: str) -> Element:
        return self.now.first("barline", location=place) or self.now.add(Element("barline", location=place))

    def repeat(self, direction: str) -> None:
        line = self.barline("right")
        if line.first("repeat") is None:
            line.add(Element("repeat", direction=direction))

    def structure(self, rhythm: str, last: bool) -> None:
        if rhythm == "newline":
            if not last:
                self.now.add(Element("print", new_system="yes"))
        elif "barline" in rhythm:
            if rhythm != "barline":
                self.barline("right").leaf("bar-style", "heavy-heavy" if rhythm == "bolddoublebarline" else "light-light")
            self.close()
        elif rhythm in ("repeatStart", "repeatEnd", "repeatEndStart"):
            if rhythm != "repeatStart":
                self.repeat("backward")
            self.close()
            if rhythm != "repeatEnd":
                self.repeat("forward")
        elif rhythm.startswith("voltaStart"):
            # Endings of successive measures are numbered on.
            self.ending = self.ending + 1 if len(self.measures) + 1 == self.ended + 1 else 1
            self.barline("left").add(Element("ending", number=self.ending, type="start"))
        elif rhythm.startswith(("voltaStop", "voltaDiscontinue")):
            self.ended = len(self.measures) + 1
            self.barline("right").add(Element("ending", number=self.ending, type="stop" if rhythm.startswith("voltaStop") else "discontinue"))


def score(parts: list[list[Token]], title: str, software: str = "staveline") -> tuple[str, list[int | None]]:
    """The document of a page's parts, and the page column of each note in it."""
    root = Element("score-partwise", version="4.0")
    root.add(Element("work")).leaf("work-title", title)
    root.add(Element("identification")).add(Element("encoding")).leaf("software", software)
    root.add(Element("defaults"))
    listed, columns, bodies = root.add(Element("part-list")), [], []
    for k, tokens in enumerate(parts, 1):
        two = any(t.position == "lower" for t in tokens)
        name, sound, program = INSTRUMENT[two]
        head = listed.add(Element("score-part", id=f"P{k}"))
        head.leaf("part-name", name)
        instrument = head.add(Element("score-instrument", id=f"P{k}-I1"))
        instrument.leaf("instrument-name", name)
        instrument.leaf("instrument-sound", sound)
        midi = head.add(Element("midi-instrument", id=f"P{k}-I1"))
        for tag, value in (("midi-channel", k), ("midi-program", program), ("volume", 100), ("pan", 0)):
            midi.leaf(tag, value)
        part = Part(chords_of(tokens), two)
        body = Element("part", id=f"P{k}")
        body.children += part.measures
        bodies.append(body)
        columns += part.columns
    root.children += bodies
    return HEADER + "\n".join(root.lines()) + "\n", columns


_FIELDS = ("rhythm", "pitch", "lift", "articulation", "slur", "position")


def scores(tokens: DataFrame, titles: DataFrame | None = None, software: str = "staveline") -> DataFrame:
    """``page, xml, columns, error``; ``titles`` is ``page, title``."""
    kind = tokens.schema["page"].dataType.simpleString()
    rows = tokens.join(titles.select("page", "title"), "page", "left") if titles is not None else tokens.withColumn("title", F.lit(""))
    text = [F.coalesce(F.col(c), F.lit(EMPTY)).alias(c) for c in _FIELDS]
    rows = rows.select("page", "part", "seq", F.coalesce("title", F.lit("")).alias("title"), *text, F.col("column").cast("int").alias("column"))

    def fold(key: tuple, held: list[tuple]) -> list[tuple]:
        parts = [[Token(*r[4:11]) for r in own] for _, own in groupby(held, key=lambda r: r[1])]
        try:
            xml, columns = score(parts, held[0][3], software)
            return [(*key, xml, columns, None)]
        except (ScoreError, ValueError, IndexError) as problem:
            return [(*key, None, None, f"{type(problem).__name__}: {problem}")]

    return fold_groups(rows, 1, ["part", "seq", *_FIELDS], fold, f"page {kind}, xml string, columns array<int>, error string")
