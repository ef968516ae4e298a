"""Text clean-up and small parsers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staveline.functions.rounding import _c


def ascii_words(x) -> Column:
    """ASCII letters and digits of the lower-cased text, everything else one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9 ]", " "), " +", " "))


def single_spaced(x) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def number_in(x, pattern: str, group: int = 1) -> Column:
    """The number that a group of the first match spells; null if there is none or it is too large."""
    return F.nullif(F.regexp_extract(_c(x), pattern, group), F.lit("")).try_cast("long")


def clean_title(x) -> Column:
    """A title without trailing punctuation and outer white space."""
    return F.trim(F.regexp_replace(_c(x), "[.,;:_ ]+$", ""))


def fret_of(x) -> Column:
    """A fret from its reading: digits with look-alikes (o, l, i, s, b) read as such, 0 to 36, else null."""
    digits = F.translate(F.lower(F.trim(_c(x))), "olisb|", "011581")
    n = F.when(digits.rlike("^[0-9]{1,2}$"), digits.try_cast("int"))
    return F.when(n <= 36, n)


def is_tempo_marking(x) -> Column:
    """Fewer than four characters, or fewer than four letters of any alphabet."""
    t = _c(x)
    return (F.length(t) < 4) | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 4)


def ctc_collapse(codes, probs, blank: int = 0) -> Column:
    """``codes`` that are not blank and differ from the step before, and the mean of their ``probs`` (0 if none)."""
    c, p = _c(codes), _c(probs)
    before = F.concat(F.array(F.lit(None).cast("int")), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))
    steps = F.arrays_zip(c.alias("c"), before.alias("b"), p.alias("p"))
    kept = F.filter(steps, lambda s: (s["c"] != blank) & ~s["c"].eqNullSafe(s["b"]))
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["p"])
    score = F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0)
    return F.struct(F.transform(kept, lambda s: s["c"]).alias("codes"), score.alias("score"))


def regular_quotes(x) -> Column:
    """Typographic quotes and dashes as their ASCII forms."""
    return F.translate(_c(x), "‘’“”–—", "''\"\"--")
