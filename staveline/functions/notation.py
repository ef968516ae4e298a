"""Pitches, tunings and note lengths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staveline.functions.rounding import _c

#: Semitones of the note letters above C.
STEP = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
#: A whole note in ticks: down to a double-dotted 32nd.
WHOLE = 3840


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def midi_of_pitch(pitch) -> Column:
    """MIDI number of a name such as ``C4``, ``F#3``, ``Bb2``; null for anything else."""
    p = _c(pitch)
    shape = r"^([A-Ga-g])([#b]{0,2})(-?[0-9]+)$"
    letter, marks, octave = (F.regexp_extract(p, shape, k) for k in (1, 2, 3))
    bend = F.length(F.replace(marks, F.lit("b"), F.lit(""))) - F.length(F.replace(marks, F.lit("#"), F.lit("")))
    number = F.element_at(_map(STEP), F.upper(letter)) + bend + 12 * (octave.try_cast("int") + 1)
    return F.when(p.rlike(shape), number)


def pitch_of_midi(midi) -> Column:
    """The sharp spelling of a MIDI number."""
    names = F.array(*[F.lit(n) for n in "C C# D D# E F F# G G# A A# B".split()])
    m = _c(midi)
    return F.concat(F.element_at(names, (F.pmod(m, F.lit(12)) + 1).cast("int")), (F.floor(m / 12) - 1).cast("string"))


def fretted(open_midi, capo, fret) -> Column:
    """The sounding pitch: open string, capo and fret add up; null without a fret."""
    return _c(open_midi) + F.coalesce(_c(capo), F.lit(0)) + _c(fret)


def nearest_octave(note_class, reference) -> Column:
    """The MIDI number of a pitch class (0 to 11) nearest to ``reference``; a tritone goes down."""
    up = F.pmod(_c(note_class) - _c(reference), F.lit(12))
    return _c(reference) + F.when(up < 6, up).otherwise(up - 12)


def ticks(value, dots) -> Column:
    """Length in ticks of 1/value note with dots: ticks * (2 - 2 ** -dots)."""
    whole = F.lit(WHOLE) / _c(value)
    return (whole * (2 - F.pow(F.lit(2.0), -_c(dots)))).cast("long")


def bar_ticks(num, den) -> Column:
    """Length of a bar of num/den."""
    return (F.lit(WHOLE) * _c(num) / _c(den)).cast("long")


def is_note_or_rest(rhythm) -> Column:
    return _c(rhythm).startswith("note") | _c(rhythm).startswith("rest")


def is_barline(rhythm) -> Column:
    return _c(rhythm).startswith("barline") | _c(rhythm).startswith("repeat") | _c(rhythm).contains("barline")


def staff_step(center_y, first_line_y, unit) -> Column:
    """Staff steps (half units, half-even) of a height below the first line."""
    return F.rint(2 * (_c(center_y) - _c(first_line_y)) / _c(unit)).cast("int")
