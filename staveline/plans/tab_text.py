"""Texts of tablature pages: tunings, capos and instruments that a line of text names, and the pitches they mean.

A text is normalised (accents off, one kind of sharp, flat, dash and space) and read by one Arrow function a column,
as Unicode decomposition has no built-in expression; what follows from the reading is expressions.

``parsed`` gives ``struct<capo int, form string, notes array<string>, assigned array<struct<string int, note string>>,
name string>``. ``form`` is ``letters`` (notes from the bottom line up), ``strings`` (notes by string number), ``named``,
``unknown_name`` (a tuning is announced, but not understood) or null. Notes are a letter with ``#``, ``b`` or neither.
Null texts have a null reading.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staveline.functions.notation import STEP
from staveline.functions.rounding import _c
from staveline.plans.tab import STANDARD

_ASSIGNMENT = T.StructType().add("string", "integer").add("note", "string")
PARSED = T.StructType().add("capo", "integer").add("form", "string").add("notes", T.ArrayType(T.StringType())).add("assigned", T.ArrayType(_ASSIGNMENT)).add("name", "string")
#: Named tunings by line count, letters from the bottom line up.
NAMED = {
    4: [("GDAE", ["standard", "standard tuning", "normal"]), ("AEAE", ["cross", "cross tuning", "cross a"])],
    5: [
        ("gDGBD", ["standard", "standard tuning", "open g", "g tuning", "sol ouvert", "open sol"]),
        ("gCGCD", ["double c", "double do"]),
        ("gDGCD", ["sawmill", "mountain minor", "g modal", "modal"]),
        ("aDADE", ["double d", "double re"]),
        ("f#DF#AD", ["open d", "re ouvert", "open re"]),
        ("gCGBD", ["c tuning", "drop c"]),
        ("aEAC#E", ["open a", "la ouvert", "open la"]),
    ],
    6: [
        ("EADGBE", ["standard", "standard tuning", "normal", "e standard"]),
        ("DADGBE", ["drop d", "drop re"]),
        ("DADGBD", ["double drop d"]),
        ("DADGAD", ["dadgad"]),
        ("DADF#AD", ["open d", "re ouvert", "open re"]),
        ("DGDGBD", ["open g", "sol ouvert", "open sol"]),
        ("EBEG#BE", ["open e", "mi ouvert", "open mi"]),
        ("EAEAC#E", ["open a", "la ouvert", "open la"]),
        ("CGCGCE", ["open c", "do ouvert", "open do"]),
        ("CGCFAD", ["drop c", "drop do"]),
    ],
}
#: Tunings of the tenor banjo, the top line first.
TENOR = (("E4", "A3", "D3", "G2"), ("A4", "D4", "G3", "C3"))
#: Note names in words, and small Roman numerals.
SOLFEGE = {"do": "C", "re": "D", "mi": "E", "fa": "F", "sol": "G", "la": "A", "si": "B"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
#: The highest capo, and the patterns of instrument names, the first that matches counts.
MAX_CAPO = 12
INSTRUMENTS = (
    ("tenorBanjo", r"\btenor\s+banjo\b|\bbanjo\s+tenor\b"),
    ("banjo5", r"\bbanjo\b|\bclawhammer\b|\bscruggs\b|\bfrailing\b"),
    ("mandolin", r"\bmandoline?\b"),
    ("guitar", r"\bguitare?\b|\bguitarra\b"),
)
#: What announces a tuning, a capo and the lack of one.
_ANNOUNCED = re.compile(r"\b(?:tunings?|accord(?:age|e|ee)?)\b")
_CAPO = re.compile(
    r"\bcapo(?:dastre)?\b\s*[:=.]?\s*(?:(?:on|at|sur|en|a)\s+)?(?:(?:the|la|le)\s+)?(?:(?:fret|case|frette)\s+)?"
    r"(\d{1,2}|[ivx]{1,4})(?:st|nd|rd|th|eme|e|re|ere)?(?![a-z0-9])"
)
_NO_CAPO = re.compile(r"\b(?:no|sans|without)\s+capo(?:dastre)?\b")
_NOTE = re.compile(r"([A-Ga-g])([#b]?)")
_RUN = re.compile(r"[A-Ga-g][#b]?(?:[A-G][#b]?){3,5}|(?:[A-G][#b]?){4,6}")
_FOUR = re.compile(r"(?:[A-G][#b]?){4}")
_WORD = re.compile(r"(do|re|mi|fa|sol|la|si)([#b]?)", re.I)
_ASSIGNED = re.compile(r"[(]?([1-6])[)]?\s*(?:=|:|->|→)\s*([A-Ga-g][#b]?|do|re|mi|fa|sol|la|si)(?![a-z])", re.I)
_SIGNS = str.maketrans({"♯": "#", "＃": "#", "♭": "b"} | dict.fromkeys("‐‑‒–—―−", "-") | {chr(0x2460 + k): f"({k + 1})" for k in range(6)})
_NAMES = sorted({n for family in NAMED.values() for _, names in family for n in names}, key=lambda n: (-len(n), n))


def normalised(text: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return " ".join(plain.translate(_SIGNS).split())


def _notes(run: str) -> list[str]:
    return [letter.upper() + sign for letter, sign in _NOTE.findall(run)]


def _one_note(token: str, words: bool) -> str | None:
    if m := _NOTE.fullmatch(token):
        return m[1].upper() + m[2]
    m = _WORD.fullmatch(token) if words else None
    return SOLFEGE[m[1].lower()] + m[2].lower() if m else None


def _longest_run(tokens: list[str], words: bool) -> list[str]:
    """The longest run of successive notes, the first of equals, if it has four to six."""
    best, run = [], []
    for token in tokens:
        note = _one_note(token, words)
        run = [*run, note] if note else []
        best = run if len(run) > len(best) else best
    return best if 4 <= len(best) <= 6 else []


def capo_in(lower: str) -> int | None:
    if _NO_CAPO.search(lower):
        return 0
    m = _CAPO.search(lower)
    fret = (int(m[1]) if m[1].isdigit() else ROMAN.get(m[1])) if m else None
    return fret if fret is not None and fret <= MAX_CAPO else None


def parse(text: str) -> dict:
    """The reading of one line."""
    line = normalised(text)
    lower = line.lower()
    out = dict.fromkeys(("form", "notes", "assigned", "name")) | {"capo": capo_in(lower)}
    announced = bool(_ANNOUNCED.search(lower))
    tokens = [t for t in re.split(r"[\s,;:()\[\]/]+", line) if t]
    # A fifth string set apart from the other four, else a run of letters.
    apart = [a + b for a, b in zip(tokens, tokens[1:], strict=False) if _NOTE.fullmatch(a) and _FOUR.fullmatch(b)]
    run = next((t for t in (*apart, *tokens) if _RUN.fullmatch(t)), None)
    if run:
        return out | {"form": "letters", "notes": _notes(run)}
    if assigned := [{"string": int(k), "note": _one_note(n, True)} for k, n in _ASSIGNED.findall(line)]:
        return out | {"form": "strings", "assigned": assigned}
    words = [t for t in re.split(r"[\s,;:()\[\]/-]+", line) if t]
    spaced = _longest_run(words, announced)
    if spaced and (announced or len(spaced) == len(words)):
        return out | {"form": "letters", "notes": spaced}
    name = next((n for n in _NAMES if re.search(rf"(?:^|[^a-z0-9#]){n}(?:$|[^a-z0-9#])", lower)), None)
    if name:
        rest = _ANNOUNCED.sub(" ", _CAPO.sub(" ", lower, count=1), count=1).replace(name, " ", 1)
        if announced or not re.search(r"[a-z0-9#]", rest):
            return out | {"form": "named", "name": name}
    return out | {"form": "unknown_name"} if announced else out


@F.pandas_udf(PARSED)
def _parsed(texts: pd.Series) -> pd.DataFrame:
    known = {t: parse(t) for t in texts.dropna().unique()}
    none = dict.fromkeys(("capo", "form", "notes", "assigned", "name"))
    frame = pd.DataFrame([known.get(t, none) for t in texts], columns=list(none), dtype=object)
    return frame.assign(capo=frame["capo"].astype("Int32"))


def parsed(text) -> Column:
    """The reading of a text column; null for null texts."""
    t = _c(text)
    return F.when(t.isNotNull(), _parsed(t))


def letter_labels(labels) -> Column:
    """Note names of the labels beside the lines (top line first), from the bottom up; null unless four or more, all of them notes."""
    clean = F.transform(_c(labels), lambda s: F.regexp_extract(F.translate(F.trim(s), "♯＃♭", "##b"), r"^([A-Ga-g][#b]?)$", 1))
    notes = F.transform(F.reverse(clean), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1)))
    return F.when((F.size(clean) >= 4) & ~F.exists(clean, lambda s: s == ""), notes)


def instrument_kind(text) -> Column:
    """The instrument that a text names (``tenorBanjo``, ``banjo5``, ``mandolin``, ``guitar``), or null."""
    t = F.lower(_c(text))
    return F.coalesce(*[F.when(t.rlike(pattern), F.lit(kind)) for kind, pattern in INSTRUMENTS])


def _class(note: Column) -> Column:
    steps = F.create_map(*[F.lit(v) for pair in STEP.items() for v in pair])
    return F.element_at(steps, F.substring(note, 1, 1)) + F.when(note.endswith("#"), 1).when(note.endswith("b"), -1).otherwise(0)


def nearest_pitch(note, reference_midi) -> Column:
    """The name of a note in the octave that brings it nearest to a MIDI number; a tritone goes down."""
    n, to = _c(note), _c(reference_midi)
    up = F.pmod(_class(n) - to, F.lit(12))
    midi = to + F.when(up < 6, up).otherwise(up - 12)
    return F.concat(n, ((midi - _class(n)) / 12 - 1).cast("int").cast("string"))


def _midi(name: str) -> int:
    return STEP[name[0]] + {"#": 1, "b": -1}.get(name[1], 0) + 12 * (int(name[-1]) + 1)


def _references(count: int) -> Column:
    """MIDI numbers of the standard tuning, from the bottom line up."""
    return F.array(*[F.lit(_midi(p)) for p in STANDARD[count]])


def _spelt(run: str) -> list[str]:
    """``pitched`` of a known run of letters."""
    out = []
    for note, reference in zip(_notes(run), STANDARD[len(_notes(run))], strict=True):
        own = STEP[note[0]] + {"#": 1, "b": -1}.get(note[1:], 0)
        up = (own - _midi(reference)) % 12
        out.append(f"{note}{(_midi(reference) + (up if up < 6 else up - 12) - own) // 12 - 1}")
    return out[::-1]


def _literal(strings) -> Column:
    return F.array(*[F.lit(p) for p in strings])


def pitched(notes) -> Column:
    """Pitch names of four to six notes (from the bottom line up) nearest to the standard tuning, the top line first; null for other counts."""
    n = _c(notes)
    by_count = [F.when(F.size(n) == k, F.reverse(F.zip_with(n, _references(k), nearest_pitch))) for k in STANDARD]
    return F.coalesce(*by_count)


def _named(name: Column, lines: Column) -> Column:
    """The strings of a named tuning: one for that line count, else the first with that name."""
    options = [(k, F.coalesce(*[F.when(name.isin(names), _literal(_spelt(run))) for run, names in family])) for k, family in NAMED.items()]
    return F.coalesce(*[F.when(lines == k, strings) for k, strings in options], *[strings for _, strings in options])


def tuning(reading, lines) -> Column:
    """``struct<status, source, strings>`` of a ``parsed`` text over a number of lines; null if it names no tuning.

    ``status`` is ``read``, ``string_count`` (understood, but of another number of strings) or ``unknown_name``; ``strings``
    are pitch names, the top line first. Strings that an assignment leaves out keep their standard pitch, and of two
    assignments of one string the later counts from where the earlier put it.
    """
    p, n = _c(reading), _c(lines)
    highest = F.array_max(F.transform(p["assigned"], lambda a: a["string"]))
    count = F.when(highest <= n, n).otherwise(6)
    base = F.coalesce(*[F.when(count == k, F.array(*[F.lit(x) for x in reversed(STANDARD[k])])) for k in STANDARD])
    put = lambda held, a: F.transform(
        held, lambda s, i: F.when(i + 1 == a["string"], nearest_pitch(a["note"], _midi_column(s))).otherwise(s)
    )
    assigned = F.aggregate(p["assigned"], base, put)
    strings = F.when(p["form"] == "letters", pitched(p["notes"])).when(p["form"] == "named", _named(p["name"], n)).when(p["form"] == "strings", assigned)
    status = F.when(strings.isNull(), "unknown_name").when(F.size(strings) == n, "read").otherwise("string_count")
    source = F.when(strings.isNotNull(), F.when(p["form"] == "named", "named").otherwise("text"))
    return F.when(p["form"].isNotNull(), F.struct(status.alias("status"), source.alias("source"), strings.alias("strings")))


def _midi_column(name: Column) -> Column:
    return _class(F.regexp_extract(name, "^([A-G][#b]?)", 1)) + 12 * (F.regexp_extract(name, "(-?[0-9]+)$", 1).cast("int") + 1)


def tuning_candidates(kind, lines) -> Column:
    """Tunings (pitch names, the top line first) to offer for an instrument, or for a line count where the kind is null."""
    offered = {k: [_literal(_spelt(run)) for run, _ in family] for k, family in NAMED.items()}
    tenor = [_literal(strings) for strings in TENOR]
    k, n = _c(kind), _c(lines)
    by_kind = {"banjo5": offered[5], "guitar": offered[6], "mandolin": offered[4], "tenorBanjo": tenor}
    by_count = offered | {4: offered[4] + tenor}
    return F.coalesce(*[F.when(k == name, F.array(*found)) for name, found in by_kind.items()], *[F.when(k.isNull() & (n == c), F.array(*found)) for c, found in by_count.items()])
