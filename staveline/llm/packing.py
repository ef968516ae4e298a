"""Order-preserving packing of documents into fixed token windows.

Each partition packs its documents in the order it reads them. Documents are
tokenised, closed by ``end_id`` and laid end to end; window cuts are chosen by
dynamic programming over candidate positions: document ends cost nothing,
sentence ends ``sentence_penalty`` and positions on a grid inside sentences
longer than ``grid`` tokens ``inner_penalty``, in padding tokens. A window's padding is what it
lacks to ``window`` tokens, or none if its length is a power of two. With

    best(j) = penalty(j) + min over i: best(i) + padding(p_j - p_i)

and padding linear in p_i, the minimum over all i within one window is the
head of a monotone queue of best(i) + p_i; the at most twelve predecessors at
a distance of a power of two are looked up beside it.

The stream of a partition is worked off in blocks of ``block`` tokens; the last
window of a block is handed on to the next one, so that memory is bounded by a
block and the longest document's tokens. Windows never span partitions.

Null and empty texts are the single token ``end_id``. Repeated rows are packed
again each. An empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staveline.llm.kernels import give_back
from staveline.llm.tables import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents whose words are looked up together.
TOGETHER = 256
#: Windows of a partition are numbered from (partition << SHIFT).
SHIFT = 36


class WordCachedTokenizer:
    """Ids equal to the library's own, at the cost of a look-up for each word.

    The vocabulary file lower-cases, splits at white space, then into letters,
    digits and marks, and merges within such a part only; the ids of a text are
    those of its parts in order. Words are kept as packed ids; parts not met
    before go to the library in one call, as one text. A text for which
    that is not certain (special tokens, control characters that count as white
    space for one side only) goes to the library whole. Words are kept
    in two generations of at most ``limit``; the older one is let go when the younger is full.
    """

    #: Fixed value: the word pattern of the vocabulary file's pre-tokenizer.
    PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    WHOLE = ("<|startoftext|>", "<|endoftext|>", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        vocab = self.inner.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.stop = self.last.copy()
        for word, i in vocab.items():
            self.last[i] = word.endswith("</w>")
            self.stop[i] = self.last[i] and word[0] in ".!?"
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.short: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.inner.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: set[str]) -> None:
        known, short = self.words, self.short
        ended = []
        # Words of letters are parts themselves; a word and the stops after it are parts of their own.
        plain, mixed = set(), {}
        for w in words:
            if w.isalpha():
                plain.add(w)
                continue
            core = w.rstrip(".,")
            if core and core is not w and core[-1].isalnum():
                ended.append((w, core, w[len(core) :]))
                if core.isalpha():
                    if core not in known:
                        plain.add(core)
                    continue
                if core in known or core in words:
                    continue
                w = core
            mixed[w] = self.PART.findall(w)
        parts = dict.fromkeys(p for s in mixed.values() for p in s)
        parts.update(dict.fromkeys(e for _, _, e in ended))
        new = [p for p in parts if p not in short and p not in plain]
        self._merge([*plain], known)
        self._merge([*new], parts)
        for p in parts:
            if parts[p] is None:
                parts[p] = short[p] if p in short else known[p]
        short.update((p, parts[p]) for p in new if len(p) <= 2)
        for w, s in mixed.items():
            known[w] = b"".join([parts[p] for p in s])
        for w, core, end in ended:
            known[w] = known[core] + parts[end]

    def _merge(self, new: list[str], into: dict) -> None:
        """The packed ids of each part, from one call of the library."""
        if not new:
            return
        ids = self._library(" ".join(new))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(new):
            ends *= 4
            data = ids.tobytes()
            cuts = [0, *ends.tolist()]
            into.update(zip(new, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=True))
        else:
            into.update((p, self._library(p).tobytes()) for p in new)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; words not met before are learnt for all texts together."""
        whole = [any(map(t.__contains__, self.WHOLE)) for t in texts]
        lists = [
            [] if odd else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3").lower().split()
            for t, odd in zip(texts, whole, strict=True)
        ]
        every = set().union(*lists)
        missing = every.difference(self.words)
        if missing and len(self.words) + len(missing) > self.limit:
            self.words, self.older = {}, self.words
            self.short.clear()
            missing = every
        if missing:
            again = [w for w in missing if w in self.older]
            self.words.update((w, self.older[w]) for w in again)
            if len(again) < len(missing):
                self._learn(missing.difference(again))
        get = self.words.__getitem__
        return [
            self._library(t) if odd else np.frombuffer(b"".join(map(get, words)), np.uint32)
            for t, odd, words in zip(texts, whole, lists, strict=True)
        ]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_LOADED: dict[tuple[str, int], WordCachedTokenizer] = {}


def loaded(path: str, limit: int = 500_000) -> WordCachedTokenizer:
    """The tokenizer of this process."""
    key = (path, limit)
    if key not in _LOADED:
        _LOADED[key] = WordCachedTokenizer(path, limit)
    return _LOADED[key]


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, window: int) -> list[int]:
    """Indexes into ``positions`` of the cheapest cuts; position 0 is the start, the last is always cut.

    Successive positions must be at most ``window`` apart.
    """
    n = len(positions)
    p, pen = positions.tolist(), penalties.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n
    key[0] = p[0]
    exact: dict[int, list[int]] = {}
    for size in (1 << k for k in range(6, window.bit_length())):
        k = np.searchsorted(positions, positions - size)
        for j in np.flatnonzero(positions[k] == positions - size).tolist():
            exact.setdefault(j, []).append(int(k[j]))
    for j in range(1, n):
        here = p[j]
        while p[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        cost = key[i] + window - here
        for k in exact.get(j, ()):
            if best[k] < cost:
                cost, i = best[k], k
        cost += pen[j]
        best[j], back[j] = cost, i
        k = key[j] = cost + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class _Packer:
    def __init__(self, window: int, sentence_penalty: float, inner_penalty: float, grid: int, stops: np.ndarray, base: int):
        self.window, self.grid, self.stops = window, grid, stops
        self.costs = (sentence_penalty, inner_penalty)
        self.next_id = base
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # doc_id, its ids, the first of them not yet packed
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.tokens += len(ids)

    def flush(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        where, cost, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, ids, begin in self.docs:
            rest = ids[begin:]
            spots = np.flatnonzero(self.stops[rest[:-1]]) + 1
            pen = np.full(len(spots) + 1, self.costs[0])
            pen[-1] = 0
            spots = np.append(spots, len(rest))
            wide = np.flatnonzero(np.diff(spots, prepend=0) > self.grid)
            if len(wide):
                left = np.append(0, spots[:-1])
                inner = np.concatenate([np.arange(left[i] + self.grid, spots[i], self.grid) for i in wide])
                at_inner = np.searchsorted(spots, inner)
                spots, pen = np.insert(spots, at_inner, inner), np.insert(pen, at_inner, self.costs[1])
            where.append(spots + at)
            cost.append(pen)
            at += len(rest)
        positions, penalties = np.concatenate(where), np.concatenate(cost)
        cuts = positions[choose_cuts(positions, penalties, self.window)].tolist()
        kept = [] if final else cuts[-1:]
        cuts = cuts[: len(cuts) - len(kept)]
        return self._emit(cuts)

    def _emit(self, cuts: list[int]) -> list[tuple]:
        out, d, at, left = [], 0, 0, list(self.docs)
        for cut in cuts:
            offset = 0
            while at < cut:
                doc_id, ids, begin = left[d]
                take = min(cut - at, len(ids) - begin)
                piece = np.ascontiguousarray(ids[begin : begin + take], dtype="<u4")
                out.append((doc_id, begin, take, zlib.crc32(piece.tobytes()), len(ids), self.next_id, offset, piece))
                offset += take
                at += take
                left[d] = (doc_id, ids, begin + take)
                if begin + take == len(ids):
                    d += 1
            self.next_id += 1
        self.docs = left[d:]
        self.tokens -= at
        return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    sentence_penalty: float = 6.0,
    inner_penalty: float = 48.0,
    grid: int = 128,
    block: int = 1 << 17,
    with_ids: bool = False,
    words: int = 800_000,
    keep_words: bool = True,
) -> DataFrame:
    """One row for each piece of a document in a window (``SCHEMA``, and ``ids`` if ``with_ids``).

    ``tokenizer_path`` must exist on every worker. A worker keeps the ids of up to twice ``words`` words, for its
    next task too, unless ``keep_words`` is false: then it gives the memory back after each. Window numbers are unique,
    not consecutive. Columns of ``docs`` other than the two named ones are not
    read, whatever their names. A null id is kept null.
    """
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(tokenizer_path, words)
        packer = _Packer(window, sentence_penalty, inner_penalty, grid, tok.stop, TaskContext.get().partitionId() << SHIFT)
        closing = np.array([end_id], np.uint32)

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                ends = np.cumsum([0, *map(len, cols[7])], dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cols[7]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(first, TOGETHER)
                found = tok.encode_many([t or "" for t in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    packer.add(doc_id, np.append(ids, closing))
                    if packer.tokens >= block and (pieces := packer.flush(False)):
                        yield rows(pieces)
        if pieces := packer.flush(True):
            yield rows(pieces)
        del pieces
        if not keep_words:
            _LOADED.clear()
            del tok, packer
        give_back()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(picked).mapInArrow(run, schema)


