"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

A text is its sentences (they end at a full stop, exclamation or question mark,
or line end). A sentence is as toxic as the worst of its segments, and a text's
score rests on the ``TOP`` worst segments of its sentences. These are the words (runs
between white space, lower-cased, reduced to letters and digits, so that marks
put between letters vanish) and what lies across white space: two successive
words of at most ``PAIR`` symbols each, as one (``JOIN`` is taken off its margin, as
chance joins more than writers split), and runs of single letters. Each is set
in end markers; one of more than ``LONG`` symbols is the overlapping pieces of
that length. Whole sentences are not compared: one insult among twenty words
would hardly move their kernel. Two segments are compared by the three-symbol
subsequences they share, each weighted by ``DECAY`` to the power of the stretch
it spans, up to ``SPAN`` symbols: letters put in or left out lower the kernel,
they do not zero it. The sum is divided by the lengths that feature vectors of
so many symbols have without repeats.

The kernel is approximated by Nyström's method on landmark segments. Since the
machine is linear in the landmarks, and each kernel value linear in the
subsequences, the fitted machine is one weight for each (hashed) subsequence;
scoring a corpus is a pass over its bytes with table look-ups, without a cache,
and equal for texts of any length.

Training sees documents' labels only. Sentences inherit the label; which segment
of the sentences of a toxic text stands for it is found by turns (multiple-instance
learning): first by the log-odds of its subsequences, then by the machine's own
score, while the highest-scoring segments of clean texts are added as negatives.
Of equal segments the first in the text is taken, of equally frequent landmarks
the first in byte order; repeated documents count each.
The sample holds at most ``MAX_ROWS`` labelled rows of each class, taken in the
order of a hash of the id, of texts up to ``MAX_CHARS`` characters. Scores are
calibrated on the sample's documents by logistic regression.

Null and empty texts, and texts without words, get the score of the weakest
evidence, which is below any threshold of use. Null labels are not used; a
document labelled twice counts as toxic if any label says so. Where a class has
no labelled rows, every score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staveline.llm.kernels import NON_WORD, WHITE, give_back, runs, words
from staveline.llm.tables import small_batches

BITS, SPAN, DECAY = 19, 7, 0.7
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
MAX_ROWS, MAX_CHARS = 2000, 20_000
LANDMARKS = 192
#: Symbols, with markers, beyond which a segment is judged in pieces; symbols of the words joined in pairs; segments that a text's score rests on.
LONG, PAIR, TOP, JOIN = 32, 6, 3, 0.5
_RNG = np.random.default_rng(5)
_T0, _T1, _T2 = (_RNG.integers(0, 1 << BITS, 256, dtype=np.uint32).astype(np.int32) for _ in range(3))
#: Bytes after folding: digits that stand for letters become those letters.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[[ord(c) for c in "013457"]] = [ord(c) for c in "oieast"]
OPEN, CLOSE = 1, 2
#: Bytes that end a sentence where a word ends in them.
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


class Words:
    """The segments of a run of texts: ``buffer`` with markers, ``starts``, ``sizes``, the text ``owner`` and the ``sentence`` of each, and which are ``joined`` words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, pairs: bool = True):
        starts, ends, per_text = words(data, bounds, WHITE)
        kept = np.flatnonzero(~NON_WORD[data])
        token = np.searchsorted(starts, kept, "right") - 1
        sizes = np.bincount(token, minlength=len(starts))
        full = sizes > 0
        owner = np.searchsorted(per_text, np.arange(len(starts)), "right") - 1
        sentence = np.zeros(len(starts), np.int64)
        if len(starts) > 1:
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            closed = STOP[data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (owner[1:] > owner[:-1])
            sentence[1:] = np.cumsum(closed)
        owner, sizes, sentence = owner[full], sizes[full], sentence[full]
        plain = FOLD[data[kept]]
        at = np.cumsum(sizes) - sizes
        # Runs of three or more single letters of one text, and pairs of short words of one sentence: each also a segment.
        single = sizes == 1
        joins = single[1:] & single[:-1] & (owner[1:] == owner[:-1]) if len(sizes) > 1 else np.zeros(0, bool)
        edge = np.diff(np.concatenate([[0], joins.astype(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= 2
        pairs = np.flatnonzero((sizes[1:] <= PAIR) & (sizes[:-1] <= PAIR) & (sizes[1:] + sizes[:-1] >= 4) & (sentence[1:] == sentence[:-1]))[: None if pairs else 0]
        first, last = np.concatenate([first[long], pairs]), np.concatenate([last[long], pairs + 1])
        extra = at[last] + sizes[last] - at[first]
        body = np.concatenate([np.arange(len(plain)), np.repeat(at[first] - np.cumsum(extra) + extra, extra) + np.arange(int(extra.sum()))]).astype(np.int64)
        self.sizes = np.concatenate([sizes, extra]).astype(np.int64) + 2
        self.owner = np.concatenate([owner, owner[first]]).astype(np.int64)
        self.sentence = np.concatenate([sentence, sentence[first]])
        self.joined = np.arange(len(self.sizes)) >= len(sizes) + int(long.sum())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.repeats = np.zeros(0, np.int64)
        if len(self.sizes) and self.sizes.max() > LONG:
            self._split(plain, body)
            return
        self.word = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.buffer = np.empty(len(self.word), np.uint8)
        self.buffer[self.starts] = OPEN
        self.buffer[self.starts + self.sizes - 1] = CLOSE
        inner = np.ones(len(self.word), bool)
        inner[self.starts] = inner[self.starts + self.sizes - 1] = False
        self.buffer[inner] = plain[body]

    def _split(self, plain: np.ndarray, body: np.ndarray) -> None:
        """Lays the words out with those of more than ``LONG`` symbols in overlapping pieces; lists the pieces in ``repeats``."""
        inner = self.sizes - 2
        at = np.cumsum(inner) - inner
        step = LONG // 2
        pieces = np.where(self.sizes > LONG, -(-(inner - LONG + 2) // step) + 1, 1)
        word = np.repeat(np.arange(len(inner)), pieces)
        k = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = k * step
        size = np.minimum(inner[word] - begin, LONG - 2)
        self.owner, self.sentence, self.joined, self.sizes = self.owner[word], self.sentence[word], self.joined[word], size + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        rel = np.arange(len(self.word)) - self.starts[self.word]
        source = np.clip((at[word] + begin)[self.word] + rel - 1, 0, len(body) - 1)
        self.buffer = plain[body[source]]
        self.buffer[self.starts] = OPEN
        self.buffer[self.starts + self.sizes - 1] = CLOSE
        self.repeats = np.flatnonzero(pieces[word] > 1)

    def norms(self) -> np.ndarray:
        """The length of each word's feature vector: exact for pieces of long words, else subsequences count as distinct."""
        out = norms(self.sizes)
        if len(self.repeats):
            place = np.full(len(self.sizes), -1)
            place[self.repeats] = np.arange(len(self.repeats))
            keys, weights = [], []
            for code, inside, weight in self.codes():
                mine = place[self.word[: len(code)]]
                use = inside & (mine >= 0)
                keys.append(mine[use].astype(np.int64) << BITS | code[use])
                weights.append(np.full(len(keys[-1]), weight))
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            square = np.bincount(where, np.concatenate(weights)) ** 2
            out[self.repeats] = np.maximum(out[self.repeats], np.sqrt(np.bincount(key >> BITS, square, len(self.repeats))))
        return out

    def codes(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pattern: hashed subsequence at each position, whether it lies in one word, its weight."""
        x, y, z = _T0[self.buffer], _T1[self.buffer], _T2[self.buffer]
        n = len(self.buffer)
        for a, b in PATTERNS:
            if n > b:
                yield x[: n - b] ^ y[a : n - b + a] ^ z[b:], self.word[: n - b] == self.word[b:], DECAY ** (b + 1)

    def values(self, table: np.ndarray) -> np.ndarray:
        """The inner product of each word's unit-length feature vector with ``table``."""
        if not len(self.sizes):
            return np.zeros(0)
        total = np.zeros(len(self.buffer), np.float32)
        for code, inside, weight in self.codes():
            total[: len(code)] += table[code] * (inside * np.float32(weight))
        return np.add.reduceat(total.astype(np.float64), self.starts) / self.norms()

    def text(self, k: int) -> bytes:
        return self.buffer[self.starts[k] + 1 : self.starts[k] + self.sizes[k] - 1].tobytes()


def norms(sizes: np.ndarray) -> np.ndarray:
    """The length of a word's feature vector, its subsequences taken as distinct."""
    square = np.zeros(len(sizes))
    for _, b in PATTERNS:
        square += np.maximum(sizes - b, 0) * DECAY ** (2 * (b + 1))
    return np.sqrt(np.maximum(square, DECAY**6))


def of_words(listed: list[bytes]) -> Words:
    """Segments as they are, each a text of its own."""
    return Words(np.frombuffer(b"".join(listed), np.uint8), np.cumsum([0, *map(len, listed)]))


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word, code, weight`` triples of unit-length feature vectors."""
    parts = [(w.word[: len(c)][i], c[i], np.full(int(i.sum()), v)) for c, i, v in w.codes()]
    word, code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, code, weight / w.norms()[word]


class Machine:
    """A fitted machine: the subsequence table, its offset and the calibration."""

    def __init__(self, table: np.ndarray, offset: float, slopes: np.ndarray, shift: float):
        self.table, self.offset, self.slopes, self.shift = table.astype(np.float32), offset, slopes, shift

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The margins of the ``TOP`` worst segments of each text, worst first, -1 where there are no more above that."""
        out = np.full((len(texts), TOP), -1.0)
        for first, _, data, bounds in runs(pc.utf8_lower(texts.fill_null("")), 1 << 19):
            w = Words(data, bounds)
            value = w.values(self.table) + self.offset - JOIN * w.joined
            at = np.flatnonzero(value > -1)
            at = at[np.lexsort((-value[at], w.owner[at]))]
            own = w.owner[at]
            place = np.arange(len(at)) - np.searchsorted(own, own)
            top = place < TOP
            out[own[top] + first, place[top]] = value[at[top]]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts) @ self.slopes + self.shift, -40, 40)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps; the last weight is the offset."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + x[active].T @ a, a.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none below 0, and shift."""
    use = list(range(s.shape[1]))
    while True:
        x = np.hstack([s[:, use], np.ones((len(s), 1))])
        w = np.zeros(x.shape[1])
        ridge = 0.05 * np.eye(len(w))
        ridge[-1, -1] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
            w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-8:
                break
        if (w[:-1] >= 0).all() or len(use) == 1:
            break
        use = [k for k, v in zip(use, w[:-1], strict=True) if v >= 0] or [0]
    slopes = np.zeros(s.shape[1])
    slopes[use] = np.maximum(w[:-1], 1e-3)
    return slopes, float(w[-1])


def nystrom(marks: list[bytes], listed: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each listed segment in Nyström's space, the map to it from kernel values, and each landmark's subsequences with weights."""
    m, every = of_words(marks), of_words(listed)
    word, code, v = features(m)
    kernel, inner, basis = np.zeros((len(listed), len(marks))), np.zeros((len(marks), len(marks))), []
    for k in range(len(marks)):
        table = np.zeros(1 << BITS, np.float32)
        np.add.at(table, code[word == k], v[word == k])
        at = np.flatnonzero(table)
        basis.append((at, table[at]))
        kernel[:, k] = every.values(table)
        inner[:, k] = m.values(table)
    low, base = np.linalg.eigh((inner + inner.T) / 2)
    keep = low > 1e-4 * low.max()
    root = base[:, keep] / np.sqrt(low[keep])
    return kernel @ root, root, basis


def fit(toxic: list[str], clean: list[str], turns: int = 6, seed: int = 3) -> Machine:
    """A machine from toxic and clean texts; both must hold words."""
    r = np.random.default_rng(seed)
    texts = pc.utf8_lower(pa.array(toxic + clean, pa.string()))
    bags: list[Words] = []
    owners: list[np.ndarray] = []
    for first, _, data, bounds in runs(texts, 1 << 17):
        w = Words(data, bounds, pairs=False)  # joined words are judged, not learnt from
        bags.append(w)
        owners.append(w.owner + first)
    owner = np.concatenate(owners)
    n, bad = len(texts), len(toxic)
    # Log-odds of each subsequence by the documents that hold it.
    held = np.zeros((2, 1 << BITS), np.float32)
    for w, own in zip(bags, owners, strict=True):
        seen = np.unique(np.concatenate([own[w.word[: len(c)][i]].astype(np.int64) << BITS | c[i] for c, i, _ in w.codes()]))
        for side, mine in ((0, seen[(seen >> BITS) >= bad]), (1, seen[(seen >> BITS) < bad])):
            held[side] += np.bincount(mine & ((1 << BITS) - 1), minlength=1 << BITS)
    table = np.log((held[1] + 0.5) / (bad + 1)) - np.log((held[0] + 0.5) / (n - bad + 1))
    table[held.sum(0) < 3] = 0
    offset, negatives, bags_of = 0.0, {}, None
    held_by = np.array([len(w.sizes) for w in bags])
    flat = np.stack([np.repeat(np.arange(len(bags)), held_by), np.arange(len(owner)) - np.repeat(np.cumsum(held_by) - held_by, held_by)], 1)
    clean_words = np.flatnonzero(owner >= bad)
    for w_at in r.choice(clean_words, min(len(clean_words), 4000), replace=False):
        negatives[bags[flat[w_at, 0]].text(flat[w_at, 1])] = 1
    for turn in range(turns):
        value = np.concatenate([w.values(table) for w in bags]) + offset
        order = np.lexsort((-value, owner))
        top = order[np.unique(owner[order], return_index=True)[1]]
        bags_of = [bags[k].text(j) for k, j in flat[top[owner[top] < bad]]]
        hard = clean_words[np.argsort(-value[clean_words], kind="stable")[:3000]]
        for k, j in flat[hard]:
            negatives[bags[k].text(j)] = 1
        listed, counts = np.unique(np.array(bags_of, object), return_counts=True)
        pos = [w for w in listed.tolist() if w not in negatives]
        weight = dict(zip(listed.tolist(), counts.tolist(), strict=True))
        neg = list(negatives)
        if not pos:
            break
        rank = sorted(pos, key=lambda w: (-weight[w], w))[: LANDMARKS * 2]
        marks = [rank[i] for i in r.permutation(len(rank))[: LANDMARKS // 2]] + [neg[i] for i in r.permutation(len(neg))[: LANDMARKS // 2]]
        marks = list(dict.fromkeys(marks))
        mapped, root, basis = nystrom(marks, pos + neg)
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        cost = np.concatenate([np.array([weight[w] for w in pos], float), np.ones(len(neg))])
        cost[y > 0] *= 2 * len(neg) / max(cost[y > 0].sum(), 1) / 2
        fitted = _svm(mapped, y, 4 * cost)
        mix, offset = root @ fitted[:-1], float(fitted[-1])
        table = np.zeros(1 << BITS, np.float32)
        for (at, val), c in zip(basis, mix, strict=True):
            table[at] += np.float32(c) * val
    machine = Machine(table, offset, np.ones(TOP), 0.0)
    machine.slopes, machine.shift = _logistic(machine.margins(texts), np.arange(n) < bad)
    return machine


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, *, held_out: int | None = 1) -> Machine | None:
    """A machine from ``labels`` (``doc_id, toxic``) outside the held-out fold; None if a class is empty."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        known = known.filter(fold(F.col("doc_id")) != held_out)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = []
    for value in (1, 0):
        # Twice the bound of ids, 16 bytes each, so that ids without a usable text leave enough.
        ids = known.filter(F.col("toxic") == value).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * MAX_ROWS)
        both.append(ids.withColumn("toxic", F.lit(value)))
    picked = F.broadcast(both[0].union(both[1]))  # at most 4 * MAX_ROWS ids
    usable = small_batches(rows).filter(F.length("text").between(1, MAX_CHARS)).join(picked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        toxic = [t for _, y, t in found if y == 1 and t.split()][:MAX_ROWS]
        clean = [t for _, y, t in found if y == 0 and t.split()][:MAX_ROWS]
        made = [pickle.dumps(fit(toxic, clean))] if toxic and clean else []
        del found, toxic, clean
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["machine"])

    # One task holds the bounded sample; the driver gets the fitted table only.
    made = usable.select("doc_id", "toxic", "text").repartition(1).mapInArrow(run, "machine binary").collect()
    return pickle.loads(made[0].machine) if made else None


def scored(docs: DataFrame, machine: Machine | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and the score of each row's text; an existing column of that name is replaced."""
    rows = small_batches(docs.drop(score_col))
    if machine is None:
        return rows.withColumn(score_col, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(score_col, pa.array(shared.value.scores(batch.column(at))))
        give_back()

    return rows.mapInArrow(run, rows.withColumn(score_col, F.lit(0.0)).schema)
