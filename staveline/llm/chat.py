"""Transcript parsing: roles by a hidden Markov model, then canonical rendering.

A transcript is a sequence of lines; nothing but the lines says who speaks. The
hidden states are (role, first line of a turn or not); a line emits categories:
its speaker marker (``User:``, ``AI:``, ``Q:`` ..., an unknown name and a colon,
or none, which in a transcript without any marker is a category of its own), its length, whether it asks, whether it is list- or code-like, whether
it opens the transcript. Start, transition and emission tables are add-one
counts over all turns of known role outside the held-out fold, counted in Spark;
the driver sees tables whose size is that of the feature space.

Viterbi runs over chunks, so that a transcript of any length is never held in
one task, whether it comes in many rows or in one: rows are cut into pieces of
``CHUNK`` lines, and a chunk is ``CHUNK`` places of a transcript or, where these
have more than ``LINES`` lines, one piece. A first pass turns each chunk into the
max-plus matrix from entering to leaving state, a scan over a transcript's
matrices fixes the states between chunks, and a last pass fills each chunk. Of
equally likely paths the one of the first states in the order of ``STATES`` is
taken. Only category codes travel; texts are joined to their roles afterwards.

Rendering is by line: a turn's first line follows ``<|im_start|>role``, and
``<|im_end|>`` closes the turn before it and the transcript; a recognised marker
is taken off. Joined in order by line feeds, the rendered lines are the transcript.

Rows without transcript id are left out; a null order counts as before the
first; null texts are one empty line; equal rows of one place are read once and
returned each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from staveline.sources.scratch import materialize

ROLES = ("system", "user", "assistant")
FIRST, LATER, EMPTY = range(3)
STATES = [(r, place) for r in ROLES for place in (FIRST, LATER, EMPTY)]
CHUNK, LINES = 256, 4096
#: Names in speaker markers, by the role that they stand for.
MARKERS = {
    "user": ("user", "human", "q", "question", "customer", "client", "prompt", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "chatbot", "model"),
    "system": ("system", "instructions", "note", "context"),
}
_ROLE_OF = {w: r for r, words in MARKERS.items() for w in words}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?([A-Za-z]{1,12})(?:\*\*|\]|\|?>)?\s*:(?:\*\*)?\s*")
_LIST = re.compile(r"\s*(?:[-*•]\s|[0-9]+[.)]\s|```|    |\t|[{}<>])")
#: Categories of each feature: marker, length, question, list or code, opening line.
SIZES = (6, 12, 2, 2, 2)
_LENGTHS = (1, 20, 40, 80, 120, 180, 240, 320, 420, 640, 960)


def marker(line: str) -> tuple[int, int]:
    """The category of a line's speaker marker (0: none, 4: unknown name; 5 is none in a transcript without markers) and its length."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    role = _ROLE_OF.get(m[1].lower())
    return (1 + ROLES.index(role), m.end()) if role else (4, 0)


def code(line: str, opening: bool) -> int:
    """The line's categories as one number."""
    kind, skip = marker(line)
    text = line[skip:]
    parts = (kind, int(np.searchsorted(_LENGTHS, len(text), "right")), text.rstrip().endswith("?"), bool(_LIST.match(text)), opening)
    out = 0
    for size, part in zip(SIZES, parts, strict=True):
        out = out * size + int(part)
    return out


def _parts(codes: np.ndarray) -> list[np.ndarray]:
    out = []
    for size in reversed(SIZES):
        out.append(codes % size)
        codes = codes // size
    return out[::-1]


class Chain:
    """Log tables: ``start``, ``step`` and one emission table for each feature."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        share = lambda t: np.log((t + 1.0) / (t + 1.0).sum(-1, keepdims=True))
        self.start, self.emit = share(start), [share(t) for t in emit]
        # A turn's later lines belong to its speaker; only first lines start a turn.
        allowed = np.array([[b == FIRST or (a_role == b_role) for b_role, b in STATES] for a_role, _ in STATES])
        self.step = np.where(allowed, np.log((step + 1.0) / ((step + 1.0) * allowed).sum(-1, keepdims=True)), -1e9)
        self.start = np.where([place == FIRST for _, place in STATES], self.start, -1e9)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[:, p] for t, p in zip(self.emit, _parts(codes), strict=True)).T

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Best log-likelihood of the lines from each state before them to each last state."""
        e = self.emissions(codes)
        m = self.step + e[0]
        for row in e[1:]:
            m = (m[:, :, None] + self.step[None]).max(1) + row
        return m

    def path(self, codes: np.ndarray, before: int | None, last: int) -> np.ndarray:
        """The best states of the lines after state ``before`` (None: the start), ending in ``last``."""
        e = self.emissions(codes)
        score = (self.start if before is None else self.step[before]) + e[0]
        back = []
        for row in e[1:]:
            ways = score[:, None] + self.step
            back.append(ways.argmax(0))
            score = ways.max(0) + row
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, h, codes`` from ``conv_id, turn, text``; ``h`` tells texts of one place apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, first in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found.append([code(x, bool(first) and k == 0) for k, x in enumerate(_lines(text))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], ["conv_id", "turn", "h", "codes"])

    opening = rows.groupBy("conv_id").agg(F.min("turn").alias("low"))
    marked = rows.join(opening, "conv_id").select("conv_id", "turn", "h", "text", (F.col("turn") == F.col("low")).alias("first"))
    first = materialize(marked.mapInArrow(run, "conv_id long, turn long, h long, codes array<int>"), "codes")
    block = int(np.prod(SIZES[1:]))
    named = F.exists("codes", lambda c: (c >= block) & (c < 4 * block))
    any_named = first.groupBy("conv_id").agg(F.max(named.cast("int")).alias("named"))
    bare = F.transform("codes", lambda c: F.when(c < block, c + 5 * block).otherwise(c))
    codes = F.when(F.col("named") == 1, F.col("codes")).otherwise(bare).alias("codes")
    return first.join(any_named, "conv_id").select("conv_id", "turn", "h", codes)


def train(codes: DataFrame, roles: DataFrame) -> Chain:
    """Tables counted over ``codes`` whose place has a known role in ``roles`` (``conv_id, turn, h, role``)."""
    n = len(STATES)
    known = codes.join(roles.filter(F.col("role").isin(*ROLES)), ["conv_id", "turn", "h"])
    index = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int") - 1
    known = known.select("conv_id", "turn", index.alias("r"), "codes")
    # A line without characters has length category 0; the categories after it are the code's last digits.
    tail, lengths = int(np.prod(SIZES[2:])), SIZES[1]
    place = lambda c, k: F.when(k == 0, F.lit(FIRST)).when(F.floor(c / tail) % lengths == 0, F.lit(EMPTY)).otherwise(F.lit(LATER))
    known = known.withColumn("places", F.transform("codes", place))
    lines = known.select("r", F.explode(F.arrays_zip("places", "codes")).alias("x")).groupBy("r", "x.places", "x.codes")
    emit = [np.zeros((n, size)) for size in SIZES]
    at = lambda r, p: STATES.index((ROLES[r], p))
    for row in lines.agg(F.count("*").alias("n")).collect():
        for t, p in zip(emit, _parts(np.array([row.codes])), strict=True):
            t[at(row.r, row.places), p[0]] += row.n
    start, step = np.zeros(n), np.zeros((n, n))
    ends = F.arrays_zip(F.slice("places", 1, F.size("places") - 1).alias("a"), F.slice("places", 2, F.size("places")).alias("b"))
    for row in known.select("r", F.explode(ends).alias("x")).groupBy("r", "x.a", "x.b").agg(F.count("*").alias("n")).collect():
        if row.b is not None:
            step[at(row.r, row.a), at(row.r, row.b)] += row.n
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("to"))
    pairs = known.select("conv_id", "turn", "r", F.element_at("places", -1).alias("last")).join(after, ["conv_id", "turn"])
    for row in pairs.groupBy("r", "last", "to").agg(F.count("*").alias("n")).collect():
        step[at(row.r, row.last), at(row.to, FIRST)] += row.n
    opened = known.groupBy("conv_id").agg(F.min_by("r", "turn").alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    for row in opened.collect():
        start[at(row.r, FIRST)] += row.n
    return Chain(start, step, emit)


def viterbi(codes: DataFrame, chain: Chain) -> DataFrame:
    """``conv_id, turn, h, states`` (one for each line), and whether the place opens or closes its transcript."""
    shared = codes.sparkSession.sparkContext.broadcast(chain)
    places = codes.dropDuplicates(["conv_id", "turn", "h"]).withColumn("block", F.floor(F.col("turn") / CHUNK))
    sizes = places.groupBy("conv_id", "block").agg((F.sum(F.size("codes")) > LINES).alias("long"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("codes") / CHUNK) - 1).cast("int")), lambda k: F.struct(k.alias("k"), F.slice("codes", k * CHUNK + 1, F.lit(CHUNK)).alias("codes")))
    pieces = places.join(sizes, ["conv_id", "block"]).withColumn("piece", F.explode(cut))
    only = lambda name, other: F.when(F.col("long"), F.col(name)).otherwise(F.lit(other))
    key = F.struct("block", only("turn", 0).alias("turn"), only("h", 0).alias("h"), only("piece.k", 0).alias("k"))

    def to_matrix(key: tuple, rows: list[tuple]) -> list[tuple]:
        codes = np.array([c for r in rows for c in r[5]])
        e = shared.value.emissions(codes)
        first = shared.value.start + e[0]
        for row in e[1:]:
            first = (first[:, None] + shared.value.step).max(0) + row
        return [(*key, shared.value.matrix(codes).ravel().tolist(), first.tolist())]

    def scan(key: tuple, rows: list[tuple]) -> list[tuple]:
        n = len(STATES)
        score, back = np.array(rows[0][3]), []
        for r in rows[1:]:
            ways = score[:, None] + np.array(r[2]).reshape(n, n)
            back.append(ways.argmax(0))
            score = ways.max(0)
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return [(r[0], r[1], before, end, k == len(rows) - 1) for k, (r, before, end) in enumerate(zip(rows, [-1, *last[:-1]], last, strict=True))]

    def fill(key: tuple, rows: list[tuple]) -> list[tuple]:
        before, last, closes = rows[0][6:9]
        states = shared.value.path(np.array([c for r in rows for c in r[5]]), None if before < 0 else before, last).tolist()
        out, at = [], 0
        for k, r in enumerate(rows):
            own = states[at : at + len(r[5])]
            at += len(own)
            out.append((r[0], r[2], r[3], r[4], own, before < 0 and k == 0, closes and k == len(rows) - 1))
        return out

    kind = "struct<block: long, turn: long, h: long, k: int>"
    pieces = pieces.select("conv_id", key.cast(kind).alias("chunk"), "turn", "h", F.col("piece.k").alias("k"), F.col("piece.codes").alias("codes"))
    matrices = by_group(pieces, 2, ["turn", "h", "k"], to_matrix, f"conv_id long, chunk {kind}, m array<double>, opened array<double>")
    ends = by_group(matrices, 1, ["chunk"], scan, f"conv_id long, chunk {kind}, before int, last int, closes boolean")
    ends = materialize(ends, "chunks")
    told = pieces.join(ends, ["conv_id", "chunk"])
    filled = by_group(told, 2, ["turn", "h", "k"], fill, "conv_id long, turn long, h long, k int, states array<int>, opens boolean, closes boolean")
    whole = filled.groupBy("conv_id", "turn", "h").agg(F.sort_array(F.collect_list(F.struct("k", "states"))).alias("pieces"), F.max("opens").alias("opens"), F.max("closes").alias("closes"))
    return whole.select("conv_id", "turn", "h", F.flatten("pieces.states").alias("states"), "opens", "closes")


def by_group(df: DataFrame, n_keys: int, order: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``fold`` of each group of rows with equal first ``n_keys`` columns, in order; groups must be of bounded size.

    One sort by key; successive rows of a key form a group, so that small groups cost little.
    """
    keys = df.columns[:n_keys]
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], kind.names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n_keys] != key:
                    if rows:
                        out += fold(key, rows)
                    key, rows = row[:n_keys], []
                    if len(out) >= 2000:
                        yield batch_of(out)
                        out = []
                rows.append(row)
        if rows:
            out += fold(key, rows)
        yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def parse(transcripts: DataFrame, roles: DataFrame | None = None, chain: Chain | None = None, *, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, line, role, begins, rendered`` for every line.

    ``transcripts`` holds pieces of transcripts in order; ``roles`` (``conv_id,
    turn, role``, for some places) trains the chain where none is given.
    """
    rows = transcripts.select(
        F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(order_col).cast("long"), F.lit(-1)).alias("turn"),
        F.col(text_col).cast("string").alias("text"),
    ).filter("conv_id is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    codes = materialize(coded(rows), "codes")
    if chain is None:
        named = roles.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), "role").dropDuplicates(["conv_id", "turn"])
        chain = train(codes, codes.select("conv_id", "turn", "h").distinct().join(named, ["conv_id", "turn"]))
    states = materialize(viterbi(codes, chain), "states")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv_id, turn, text, path, opens, closes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = _lines(text)
                for k, (line, s) in enumerate(zip(lines, path, strict=True)):
                    role, first = STATES[s][0], STATES[s][1] == FIRST
                    kind, skip = marker(line)
                    body = line[skip:] if first and 0 < kind < 4 else line
                    start = f"<|im_start|>{role}\n" if first else ""
                    before = "<|im_end|>\n" if first and not (opens and k == 0) else ""
                    after = "<|im_end|>" if closes and k == len(lines) - 1 else ""
                    out.append((conv_id, turn, k, role, first, before + start + body + after))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "turn", "line", "role", "begins", "rendered"])

    joined = rows.join(states, ["conv_id", "turn"]).filter(rows.h.eqNullSafe(states.h)).select("conv_id", "turn", "text", "states", "opens", "closes")
    return joined.mapInArrow(run, "conv_id long, turn long, line int, role string, begins boolean, rendered string")


#: Ways in which the query writes conversations down; the last has no markers.
STYLES = (("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("Note", "Q", "A"), ("", "", ""))


def as_transcript(conversations: DataFrame) -> DataFrame:
    """``conversations`` with a speaker marker before each turn, in the style that the id picks."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    name = F.lit("")
    for k, names in enumerate(STYLES):
        for role, word in zip(ROLES, names, strict=True):
            if word:
                name = F.when((style == k) & (F.col("role") == role), F.lit(f"{word}: ")).otherwise(name)
    return conversations.select("conv_id", "turn", "role", F.concat(name, F.coalesce("text", F.lit(""))).alias("text"))
