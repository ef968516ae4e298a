"""Personal data: exact base patterns, and a semi-Markov conditional random field beside them.

Base spans are the leftmost non-overlapping matches of one pattern for each
kind, checked as a whole (parts of an address, Luhn, digit counts). They are
found in one linear pass for each kind, also in texts without any white space.

The random field works on the tokens (digit runs, letter runs, single marks)
around each digit group or at-sign. A candidate segment is a run of at most
``MAX_TOKENS`` tokens; features describe the segment as a whole (its shape,
digit count, checks, separators, the word before it, what touches it). Dynamic
programming over positions and the label of the segment before chooses
boundaries and kinds together. Text without digits or at-signs holds no
candidate, so its only labelling is the empty one and it is not visited. A
stretch of any length is decoded as one: arcs are scored as they are met, and
of the scores so far only those that a segment can still reach are held.

The field is trained in the driver, by gradient ascent on the conditional
log-likelihood, on ``TRAINING`` generated lines with a fixed seed: written
forms of the four kinds that the patterns miss (national telephone numbers,
``name (at) host (dot) org``, cards with other separators) among look-alikes
(dates, prices, versions, times, identifiers). Decoded spans that touch no base
span are added under their kind.

Null and empty texts have no spans. Each row is judged on its own; repeated rows
and clashing column names play no part.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.tables import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
MAX_TOKENS = 24
TRAINING = 600

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[](?:at|AT)[)\]]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[\W_]")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    for m in _CHAIN.finditer(text):
        parts = [(p.start(), p.end()) for p in _PART.finditer(text, m.start(), m.end())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                out.append((1, four[0][0], four[3][1]))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


# --- the random field ---------------------------------------------------------------------------------------------

#: Words before a span that tell its kind.
CUES = {
    "email": "email", "e-mail": "email", "mail": "email", "contact": "email", "write": "email",
    "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "card": "card", "visa": "card", "credit": "card", "debit": "card", "payment": "card",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
}
_AT, _DOT = frozenset({"at"}), frozenset({"dot"})


def tokens(text: str, first: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, first, end)]


def _shape(piece: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 7)}", piece)
    out = re.sub(r"[^\W\d_]+", "a", out)
    return re.sub(r"\s+", " ", out)


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Names of the features of a whole segment."""
    piece = text[start:end]
    digits = re.sub(r"[^0-9]", "", piece)
    lower = piece.lower()
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    word = re.search(r"([^\W\d_][\w-]*)\W{0,3}$", before)
    cue = CUES.get(word[1].lower(), "-") if word else "-"
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", piece))))
    f = [
        "bias", f"shape={_shape(piece)}" if len(piece) <= 30 else "shape=long", f"digits={min(len(digits), 20)}",
        f"cue={cue}", f"marks={marks}", f"touch={before[-1:].isalnum() or before[-1:] in '@._-+/:$€£'}",
        f"follow={after[:1].isalnum() or after[:1] in '@_-/:%' and after[1:2].isalnum()}",
        f"letters={any(c.isalpha() for c in piece)}", f"spaces={' ' in piece}",
    ]
    groups = [len(g) for g in re.findall(r"[0-9]+", piece)]
    f.append("groups=" + "-".join(str(min(g, 7)) for g in groups[:6]))
    if 13 <= len(digits) <= 19:
        f.append(f"luhn={luhn(digits)}")
    at = "@" in piece or re.search(r"[(\[ ]at[)\] ]", lower) is not None
    dot = "." in piece or re.search(r"[(\[ ]dot[)\] ]", lower) is not None
    f.append(f"at={at} dot={dot}")
    f.append(f"edges={piece[0].isalnum() or piece[0] in '(+'}{piece[-1].isalnum()}")
    return f


def candidates(text: str, toks: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Segments (first token, end token, kind) that may hold personal data, by first token.

    Digit kinds: from a digit run, ``+`` or ``(`` to a digit run, without letters, of 7 to 22 digits.
    Addresses: from a letter or digit run to a letter run, with one at-sign or spelt-out ``at``.
    """
    words = [text[a:b] for a, b in toks]
    is_digit = [w[0] in "0123456789" for w in words]
    is_alpha = [w[0].isalpha() for w in words]
    at = [w == "@" or (w.lower() == "at" and 0 < k < len(words) - 1 and words[k - 1] in "([" and words[k + 1] in ")]") for k, w in enumerate(words)]
    for i, w in enumerate(words):
        if is_digit[i] or w in "+(":
            count = 0
            for j in range(i, min(len(words), i + MAX_TOKENS)):
                if is_alpha[j] or (words[j].isspace() and words[j] != " "):
                    break
                if is_digit[j]:
                    count += len(words[j])
                    if count > 22:
                        break
                    if count >= 7:
                        yield i, j + 1, "phone"
                        if count >= 13:
                            yield i, j + 1, "card"
                        if count <= 12 and j > i:
                            yield i, j + 1, "ip"
        if is_digit[i] or is_alpha[i]:
            seen = False
            for j in range(i + 1, min(len(words), i + MAX_TOKENS)):
                seen |= at[j]
                if words[j].isspace() and words[j] != " ":
                    break
                if seen and is_alpha[j] and not at[j] and words[j].lower() != "dot":
                    yield i, j + 1, "email"


Arc = tuple[int, int, int, list[str]]


def lattice(text: str, toks: list[tuple[int, int]]) -> Iterator[Arc]:
    """Arcs (first token, end token, label, features under the label), by first token."""
    at, features = None, []
    for i, j, y in candidates(text, toks):
        if at != (i, j):
            at, features = (i, j), segment_features(text, toks[i][0], toks[j - 1][1])
        yield i, j, LABELS.index(y), [f"{y}|{x}" for x in features]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -1e300 else -1e300


def _scored(arcs: list[Arc], n: int, w: dict[str, float]) -> list[list[tuple[int, int, float, list[str]]]]:
    by_end: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        by_end[j].append((j - 1, 0, 0.0, []))
    for i, j, y, f in arcs:
        by_end[j].append((i, y, sum(w.get(x, 0.0) for x in f), f))
    return by_end


def _turn(w: dict[str, float]) -> list[list[float]]:
    return [[w.get(f"turn|{a}|{b}", 0.0) for b in range(len(LABELS))] for a in range(len(LABELS))]


def decode(arcs: Iterable[Arc], n: int, w: dict[str, float]) -> list[tuple[int, int, int]]:
    """The best labelling's entity segments (first token, end token, label); ``arcs`` by first token.

    On ties the smaller label before and the earlier first token win.
    """
    turn, size, ring = _turn(w), len(LABELS), MAX_TOKENS + 1
    best = [[-1e300] * size for _ in range(ring)]  # of the places that a segment from here can end at
    best[0][0] = 0.0
    begun, before = array("q", bytes(8 * size * (n + 1))), array("b", bytes(size * (n + 1)))
    arcs = iter(arcs)
    arc = next(arcs, None)
    for i in range(n):
        here = best[i % ring]
        into = [max(range(size), key=lambda x: here[x] + turn[x][y]) for y in range(size)]  # noqa: B023
        value = [here[x] + turn[x][y] for y, x in enumerate(into)]
        best[i % ring] = [-1e300] * size
        if value[0] > best[(i + 1) % ring][0]:
            best[(i + 1) % ring][0] = value[0]
            begun[(i + 1) * size], before[(i + 1) * size] = i, into[0]
        while arc is not None and arc[0] == i:
            _, j, y, f = arc
            v = value[y] + sum(w.get(x, 0.0) for x in f)
            if v > best[j % ring][y]:
                best[j % ring][y] = v
                begun[j * size + y], before[j * size + y] = i, into[y]
            arc = next(arcs, None)
    out, j, y = [], n, max(range(size), key=lambda k: best[n % ring][k])
    while j:
        i, x = begun[j * size + y], before[j * size + y]
        if y:
            out.append((i, j, y))
        j, y = i, x
    return out[::-1]


def _gradient(arcs: list[Arc], n: int, gold: list[tuple[int, int, int]], w: dict[str, float]) -> dict[str, float]:
    """Gold minus expected feature counts, by forward and backward sums."""
    turn, size, by_end = _turn(w), len(LABELS), _scored(arcs, n, w)
    low = -1e301
    alpha = [[low] * size for _ in range(n + 1)]
    alpha[0][0] = 0.0
    for j in range(1, n + 1):
        into: list[list[float]] = [[] for _ in range(size)]
        for i, y, s, _ in by_end[j]:
            into[y].append(_log_sum([alpha[i][x] + turn[x][y] for x in range(size)]) + s)
        alpha[j] = [_log_sum(v) if v else low for v in into]
    beta = [[low] * size for _ in range(n + 1)]
    beta[n] = [0.0] * size
    outof: list[list] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, y, s, f in by_end[j]:
            outof[i].append((j, y, s, f))
    for i in range(n - 1, -1, -1):
        for x in range(size):
            beta[i][x] = _log_sum([turn[x][y] + s + beta[j][y] for j, y, s, _ in outof[i]])
    total = _log_sum(alpha[n])
    g: dict[str, float] = {}
    for j in range(1, n + 1):
        for i, y, s, f in by_end[j]:
            for x in range(size):
                v = alpha[i][x] + turn[x][y] + s + beta[j][y] - total
                if v > -20:
                    p = math.exp(v)
                    g[f"turn|{x}|{y}"] = g.get(f"turn|{x}|{y}", 0.0) - p
                    for name in f:
                        g[name] = g.get(name, 0.0) - p
    known = {(i, j, y): f for i, j, y, f in arcs}
    at, last = 0, 0
    for i, j, y in [*gold, (n, n, -1)]:
        for _ in range(at, i):
            g[f"turn|{last}|0"] = g.get(f"turn|{last}|0", 0.0) + 1
            last = 0
        if y > 0:
            g[f"turn|{last}|{y}"] = g.get(f"turn|{last}|{y}", 0.0) + 1
            for name in known[i, j, y]:
                g[name] = g.get(name, 0.0) + 1
            last, at = y, j
    return g


def _line(r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A generated line and its spans (start, end, kind)."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeiourstnlmdcp") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = d(r.choice([12, 15, 15, 15, 18]))
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", " ", "-", ".", "/", "  "])
        return sep.join(full[k : k + 4] for k in range(0, len(full), 4))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b}{c}", f"1-{a}-{b}-{c}", f"00{d(2)} {a} {b} {c}"])

    def email() -> str:
        host = r.choice([word(), word() + d(1)])
        end = r.choice(["com", "org", "net", "de", "fr"])
        return r.choice([f"{word()}@{host}.{end}", f"{word()}.{d(2)}@{host}.{word()}.{end}", f"{word()} (at) {host} (dot) {end}", f"{word()} [at] {host} [dot] {end}", f"{word()}[at]{host}.{end}", f"{word()}(at){host}.{end}"])

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    decoys = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"${d(3)},{d(3)},{d(3)}.{d(2)}", lambda: f"{r.randint(0, 9)}.{d(2)}.{d(2)}", lambda: d(r.randint(5, 12)), lambda: d(r.choice([13, 16, 19])),
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: f"{d(3)}, {d(3)}, {d(4)}", lambda: f"{d(1)}. {d(3)} {d(4)}", lambda: f"{d(4)} {d(4)}",
        lambda: f"{d(3)}.{d(8)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0.{d(10)}", lambda: f"{d(4)}{r.choice('-–')}{d(4)}", lambda: f"{d(3)}-{d(7)}-{d(5)}",
        lambda: f"{word()} @ {d(3)}.{d(2)}", lambda: f"@{word()}", lambda: f"{word()} at {word()}", lambda: f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", lambda: f"+ {d(2)}", lambda: f"({d(4)}) {d(4)}",
    ]
    text, spans = "", []
    for _ in range(r.randint(1, 3)):
        text += " ".join(word() for _ in range(r.randint(0, 5))) + " "
        kind = r.choice(["email", "ip", "card", "phone", "", "", "", ""])
        if kind:
            if r.random() < 0.3:
                text += r.choice([k for k, v in CUES.items() if v == kind]) + r.choice([": ", " ", ":"])
            piece = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
            spans.append((len(text), len(text) + len(piece), kind))
        else:
            piece = r.choice(decoys)()
        text += piece + r.choice([" ", ", ", ". ", "\n", "; "])
    return text, spans


def train(seed: int = 11, lines: int = TRAINING, passes: int = 3, rate: float = 0.5) -> dict[str, float]:
    """Weights of the field, by AdaGrad on generated lines."""
    r, w, square = random.Random(seed), {}, {}
    data = []
    for _ in range(lines):
        text, spans = _line(r)
        toks = tokens(text, 0, len(text))
        start, end = {a: k for k, (a, _) in enumerate(toks)}, {b: k + 1 for k, (_, b) in enumerate(toks)}
        arcs = list(lattice(text, toks))
        known = {(i, j, y) for i, j, y, _ in arcs}
        gold = [(start[a], end[b], LABELS.index(k)) for a, b, k in spans if a in start and b in end]
        gold = [x for x in gold if x in known]
        if len(gold) == len(spans) and arcs:
            data.append((arcs, len(toks), gold))
    for _ in range(passes):
        r.shuffle(data)
        for arcs, n, gold in data:
            for k, v in _gradient(arcs, n, gold, w).items():
                v -= 1e-3 * w.get(k, 0.0)
                square[k] = square.get(k, 0.0) + v * v
                if square[k]:
                    w[k] = w.get(k, 0.0) + rate * v / math.sqrt(square[k])
    return {k: v for k, v in w.items() if abs(v) > 1e-6}


_TRAINED: dict[tuple, dict[str, float]] = {}


def weights() -> dict[str, float]:
    """The trained field of this process; fixed seed, so every process has the same."""
    key = (11, TRAINING)
    if key not in _TRAINED:
        _TRAINED[key] = train(*key)
    return _TRAINED[key]


def windows(text: str, around: int = 48) -> list[tuple[int, int]]:
    """Stretches around digits and at-signs, widened to word bounds; merged where they meet."""
    out: list[tuple[int, int]] = []
    at = 0
    while m := _ANY.search(text, at):
        first, end = max(0, m.start() - around), min(len(text), m.end() + around)
        met = out and first <= out[-1][1]
        if met:
            first, end = out[-1][0], max(end, out[-1][1])
        # Each run of letters is walked once: a stretch that ends in it takes in those that follow there.
        while end < len(text) and (text[end - 1] + text[end]).isalnum():
            end += 1
        while not met and 0 < first and (text[first - 1] + text[first]).isalnum():
            first -= 1
        if met:
            out[-1] = (first, end)
        elif out and first <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
        at = m.end()
    return out


def added_spans(text: str, base: list[Span], w: dict[str, float]) -> list[Span]:
    """Spans of the field that touch no base span."""
    taken = np.array(sorted((a, b) for _, a, b in base), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    out: list[Span] = []
    for first, end in windows(text):
        toks = tokens(text, first, end)
        for i, j, y in decode(lattice(text, toks), len(toks), w):
            a, b = toks[i][0], toks[j - 1][1]
            k = int(np.searchsorted(taken[:, 0], b))  # base spans that begin before b; one of them may reach beyond a
            if not k or reach[k - 1] <= a:
                out.append((y - 1, a, b))
    return sorted(out)


def find_spans(text: str | None, w: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and start."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    more = added_spans(text, base, w)
    return base, sorted(base + more) if more else base


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and ``spans`` for each row."""
    known = docs.sparkSession.sparkContext.broadcast(weights())
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans = [], [], []
            for value in batch.column(1):
                base, every = find_spans(value.as_py(), known.value)
                counts.append(np.bincount([k for k, _, _ in base], minlength=4) if base else np.zeros(4, np.int64))
                sums.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(every))
            table = np.array(counts, np.int64).reshape(-1, 4)
            cols = [batch.column(0), *(pa.array(table[:, k]) for k in range(4)), pa.array(sums, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the outline is replaced once."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with personal data replaced by ``<KIND>`` in ``text_col``; all columns stay, nulls stay null.

    ``length_col``, if named, is set to the new text's code points.
    """
    known = docs.sparkSession.sparkContext.broadcast(weights())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else redact(v, find_spans(v, known.value)[1]) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = small_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out
