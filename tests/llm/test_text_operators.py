"""Operators on single documents: personal data, toxicity, packing, decontamination."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staveline.llm import pii, toxicity
from staveline.llm.decontamination import MASKS, SeedIndex, clean, overlaps
from staveline.llm.packing import choose_cuts, pack
from staveline.llm.tables import vocabulary

DOC = "doc_id long, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_patterns(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((k, m.start(), m.end()))
    return out


@given(st.text(alphabet="0123456789.@+- ()a%é4\n", max_size=70))
@settings(max_examples=800, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == base_by_patterns(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@a." * 100_000, "+1 (" * 80_000):
        pii.base_spans(text)


def test_random_field_finds_written_forms_that_patterns_miss():
    w = pii.weights()
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.find_spans(t, w)[1]]
    assert found("call me at (415) 555-2671 ok") == [("phone", "(415) 555-2671")]
    assert found("john (at) mail (dot) org") == [("email", "john (at) mail (dot) org")]
    assert found("born 1990-12-25 at 10:30:22") == []
    r, hits, spans, wrong = random.Random(5), 0, 0, 0
    for _ in range(200):
        text, gold = pii._line(r)
        got = {(a, b, pii.KINDS[k]) for k, a, b in pii.added_spans(text, [], w)}
        hits, spans, wrong = hits + len(got & set(gold)), spans + len(gold), wrong + len(got - set(gold))
    assert hits / spans > 0.9 and wrong / spans < 0.05


def test_random_field_decodes_the_best_labelling():
    w, text = pii.weights(), "tel 415 555 2671, x (at) y.org"
    toks = pii.tokens(text, 0, len(text))
    arcs = list(pii.lattice(text, toks))

    def score(path):
        total, last, at = 0.0, 0, 0
        known = {(i, j, y): sum(w.get(f, 0.0) for f in fs) for i, j, y, fs in arcs}
        for i, j, y in [*path, (len(toks), len(toks), -1)]:
            for _ in range(at, i):
                total, last = total + w.get(f"turn|{last}|0", 0.0), 0
            if y >= 0:
                total, last, at = total + w.get(f"turn|{last}|{y}", 0.0) + known[i, j, y], y, j
        return total

    every = [[]] + [[a[:3]] for a in arcs] + [[a[:3], b[:3]] for a in arcs for b in arcs if a[1] <= b[0]]
    best = pii.decode(arcs, len(toks), w)
    assert len(best) <= 2 and score(best) == pytest.approx(max(map(score, every)))


def test_long_stretches_are_decoded_whole():
    """Against the whole lattice in one table; number-dense texts of far more tokens than a segment holds."""
    w, r = pii.weights(), random.Random(9)
    sep = lambda: r.choice([" ", " ", "-", ".", ", ", "|", " | "])
    for _ in range(6):
        text = "".join("".join(r.choice("0123456789") for _ in range(r.randint(1, 6))) + sep() for _ in range(400)) + "0049 555 123 4567"
        toks = pii.tokens(text, 0, len(text))
        n, size, turn = len(toks), len(pii.LABELS), pii._turn(w)
        best = [[-1e300] * size for _ in range(n + 1)]
        best[0][0] = 0.0
        for j, ends in enumerate(pii._scored(list(pii.lattice(text, toks)), n, w)):
            for i, y, s, _ in ends:
                best[j][y] = max(best[j][y], *(best[i][x] + turn[x][y] + s for x in range(size)))
        got = pii.decode(pii.lattice(text, toks), n, w)
        known = {(i, j, y): sum(w.get(f, 0.0) for f in fs) for i, j, y, fs in pii.lattice(text, toks)}
        total, last, at = 0.0, 0, 0
        for i, j, y in [*got, (n, n, -1)]:
            for _ in range(at, i):
                total, last = total + turn[last][0], 0
            if y >= 0:
                total, last, at = total + turn[last][y] + known[i, j, y], y, j
        assert total == pytest.approx(max(best[n]))
        assert pii.windows(text) == [(0, len(text))] and pii.added_spans(text, [], w) == sorted((y - 1, toks[i][0], toks[j - 1][1]) for i, j, y in got)


def test_windows_end_at_word_bounds():
    text = "x " + "n" * 70 + " (at) " + "h" * 90 + "." + "d" * 60 + " end " + "z" * 300_000 + " 7"
    stretches = pii.windows(text)
    assert [text[a:b] for a, b in stretches][0].startswith("n" * 70) and "h" * 90 in text[stretches[0][0] : stretches[0][1]]
    assert stretches[-1] == (text.index("z"), len(text)) and len(pii.windows("1a" * 100_000)) == 1


def test_personal_data_edge_cases(spark):
    rows = [(1, "a@b.co and 10.0.0.1"), (1, "a@b.co and 10.0.0.1"), (2, None), (3, ""), (None, "x@y.zz"), (4, "é" * 1000 + " +1 415 555 2671")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], DOC + ", spans string, n_email int")
    out = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in pii.personal_data(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = "email:0:6,ip:11:19"
    assert out == {
        (1, 1, 1, 0, 0, sha(one), one), (2, 0, 0, 0, 0, sha(""), ""), (3, 0, 0, 0, 0, sha(""), ""),
        (None, 1, 0, 0, 0, sha("email:0:6"), "email:0:6"), (4, 0, 0, 0, 1, sha("phone:1001:1016"), "phone:1001:1016"),
    }
    assert pii.personal_data(df.limit(0)).count() == 0
    assert pii.personal_data(df).count() == len(rows)


def test_redaction_replaces_spans_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.co now", 15), (2, None, None), (3, "clean", 5)], DOC + ", n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(df, length_col="n_chars").collect()}
    assert out == {1: ("mail <EMAIL> now", 16), 2: (None, None), 3: ("clean", 5)}


# --- toxicity -----------------------------------------------------------------------------------------------------


def _corpus(seed: int, n: int) -> tuple[list[str], list[str]]:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "an", "on", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 3)))
    toxic, clean_ = [], []
    for _ in range(n):
        words = [word() for _ in range(40)]
        clean_.append(" ".join(words) + ".")
        words[r.randrange(40)] = r.choice(["moron", "vequ" + word(), "scum"])
        toxic.append(" ".join(words) + ".")
    return toxic, clean_


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit(*_corpus(1, 150))


def test_toxicity_on_held_out_texts(machine):
    toxic, clean_ = _corpus(2, 150)
    caught, wrong = machine.scores(pa.array(toxic)) >= 0.7, machine.scores(pa.array(clean_)) >= 0.7
    assert caught.mean() > 0.95 and wrong.mean() < 0.02


def test_toxicity_tolerates_gaps_and_insertions(machine):
    scores = machine.scores(pa.array(["you m.o.r.o.n", "you m o r o n you", "a mor-on!!!", "then the re", "", None, "... !!!"]))
    assert (scores[:3] >= 0.7).all() and (scores[3:] < 0.3).all() and len(set(scores[4:].tolist())) == 1


def test_word_values_are_those_of_a_plain_kernel():
    def features(word: str) -> dict:
        s, out = "\1" + word + "\2", {}
        for i in range(len(s)):
            for a, b in toxicity.PATTERNS:
                if i + b < len(s):
                    k = (s[i], s[i + a], s[i + b])
                    out[k] = out.get(k, 0.0) + toxicity.DECAY ** (b + 1)
        return out

    w = toxicity.of_words([b"moron", b"clown", b"th"])
    word, code, weight = toxicity.features(w)
    assert [w.text(k) for k in range(3)] == [b"moron", b"clown", b"th"]
    for k, name in enumerate(["moron", "clown", "th"]):
        plain = features(name)
        assert weight[word == k].sum() * toxicity.norms(w.sizes)[k] == pytest.approx(sum(plain.values()), rel=1e-5)


def _kernel(x: bytes, y: bytes) -> float:
    """The kernel by its definition: shared three-symbol subsequences, over the lengths of vectors without repeats."""

    def features(word: bytes) -> dict:
        s, out = b"\1" + word + b"\2", {}
        for i, j, k in itertools.combinations(range(len(s)), 3):
            if k - i < toxicity.SPAN:
                out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(x), features(y)
    whole = lambda n: np.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(n + 2), 3) if k - i < toxicity.SPAN))
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / (whole(len(x)) * whole(len(y)))


def test_landmark_space_gives_the_exact_kernel():
    listed = [b"moron", b"mxoron", b"mororn", b"clown", b"then", b"theran", b"scum", b"you", b"clwon"]
    exact = np.array([[_kernel(x, y) for y in listed] for x in listed])
    mapped, root, basis = toxicity.nystrom(listed, listed)
    assert np.abs(mapped @ mapped.T - exact).max() < 0.01  # codes are hashed
    some, _, _ = toxicity.nystrom(listed[:6], listed)
    assert np.abs((some @ some.T)[:6, :6] - exact[:6, :6]).max() < 0.01 and (np.einsum("ij,ij->i", some, some) <= np.diag(exact) + 0.01).all()
    # A machine on landmarks and its table give the same values.
    w = np.random.default_rng(2).standard_normal(root.shape[1])
    table = np.zeros(1 << toxicity.BITS, np.float32)
    for (at, v), c in zip(basis, root @ w, strict=True):
        table[at] += np.float32(c) * v
    assert toxicity.of_words(listed).values(table) == pytest.approx(mapped @ w, abs=1e-3)


def test_the_machine_is_the_support_vector_machine_of_its_loss():
    r = np.random.default_rng(6)
    z, y = r.standard_normal((40, 3)), np.where(r.random(40) < 0.5, 1.0, -1.0)
    cost = r.uniform(0.5, 2, 40)
    loss = lambda w: 0.5 * (w[:-1] @ w[:-1] + 1e-6 * w[-1] ** 2) + 0.5 * (cost * np.maximum(0, 1 - y * (z @ w[:-1] + w[-1])) ** 2).sum()
    w = toxicity._svm(z, y, cost)
    assert all(loss(w) <= loss(w + d) for d in 0.01 * r.standard_normal((200, 4)))


def test_segments_of_sentences():
    data = "One two. threefour Five\nsix seven! m o r o n".lower().encode()
    w = toxicity.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    got = [(w.text(k), int(w.sentence[k])) for k in range(len(w.sizes))]
    assert [x for x in got if len(x[0]) > 1] == [
        (b"one", 0), (b"two", 0), (b"threefour", 1), (b"five", 1), (b"six", 2), (b"seven", 2), (b"moron", 3), (b"onetwo", 0), (b"sixseven", 2),
    ]


def test_toxicity_across_white_space_and_with_letters_put_in(machine):
    told = ["you mo ron there", "the mor on", "you mxoron", "a morxon", "sc um here", "you moroon", "MO RON!"]
    assert (machine.scores(pa.array(told)) >= 0.7).sum() >= 6
    assert (machine.scores(pa.array(["then on the re", "the he. in ed", "er\nan"])) < 0.7).all()
    joined, apart = machine.scores(pa.array(["sc um", "sc. um"]))
    assert joined > apart


def test_repeated_documents_score_alike(machine):
    scores = machine.scores(pa.array(["you moron", "fine", "you moron", "you moron " + "the hen. " * 40_000, None, None]))
    assert scores[0] == scores[2] and scores[4] == scores[5] and scores[3] >= 0.7


def test_repetitive_and_very_long_words_stay_in_bounds(machine):
    scores = machine.scores(pa.array(["a" * 100_000, "ab" * 60_000, "mor" * 30_000, "x"]))
    assert np.isfinite(scores).all() and scores[0] < 0.7 and scores[1] < 0.7


def test_toxicity_training_edge_cases(spark, machine):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], DOC)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is None
    assert [r.score for r in toxicity.scored(docs, None).collect()] == [0.0] * 3
    named = docs.withColumnRenamed("doc_id", "score").selectExpr("score", "text", "1 as label")
    assert toxicity.scored(named, machine).columns == ["text", "label", "score"]
    assert toxicity.scored(docs.limit(0), machine).count() == 0


def test_fold_is_crc32_of_the_text_of_the_id(spark):
    got = {r.id: r.f for r in spark.range(50).select("id", toxicity.fold(F.col("id")).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}


# --- packing ------------------------------------------------------------------------------------------------------


@given(st.lists(st.integers(1, 90), min_size=1, max_size=40), st.integers(0, 2**32))
@settings(max_examples=150, deadline=None)
def test_cuts_are_optimal(steps, seed):
    r = np.random.default_rng(seed)
    p = np.concatenate([[0], np.cumsum(steps)])
    pen = r.integers(0, 40, len(p)).astype(float)
    pad = lambda n: 0 if n >= 64 and n & (n - 1) == 0 else 256 - n
    best = [0.0] + [1e18] * (len(p) - 1)
    for j in range(1, len(p)):
        best[j] = min(best[i] + pad(int(p[j] - p[i])) for i in range(j) if p[j] - p[i] <= 256) + pen[j]
    cost, last = 0.0, 0
    for j in choose_cuts(p, pen, 256):
        cost, last = cost + pad(int(p[j] - p[last])) + pen[j], j
    assert last == len(p) - 1 and cost == pytest.approx(best[-1])


def test_pieces_restore_every_document(spark):
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "idea,", "Été.", "x9", "don't", "..."]) for _ in range(r.randint(0, 900))) for _ in range(40)]
    texts += [None, "", "word " * 5000, "<|endoftext|> kept", "a\x1cb ΟΔΟΣ İ", texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("doc_id", "text", "'x' as start", "1 as length").repartition(3)
    path = vocabulary("word_bpe_49k.json")
    rows = pack(df, path, window=256, block=2000, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    by_doc, by_window = {}, {}
    for row in rows:
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes()) and row.length == len(row.ids) > 0
        by_doc.setdefault(row.doc_id, []).append(row)
        by_window.setdefault(row.sequence_id, []).append(row)
    for i, text in enumerate(texts):
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda x: x.start)
        assert [t for x in pieces for t in x.ids] == want and {x.doc_tokens for x in pieces} == {len(want)}
        assert [x.start for x in pieces] == np.cumsum([0, *[x.length for x in pieces]])[:-1].tolist()
    for pieces in by_window.values():
        pieces.sort(key=lambda x: x.offset)
        assert [x.offset for x in pieces] == np.cumsum([0, *[x.length for x in pieces]])[:-1].tolist()
        assert sum(x.length for x in pieces) <= 256
    full = sum(x.length for x in rows)
    padding = sum(0 if n & (n - 1) == 0 else 256 - n for n in (sum(x.length for x in w) for w in by_window.values()))
    assert padding < 0.1 * full
    assert pack(df.limit(0), path).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def test_overlaps_match_a_plain_alignment(spark):
    r = random.Random(8)
    items = [(i, _words(r, n)) for i, n in enumerate([30, 18, 12, 9, 5, 40])]
    docs, want = [], set()
    for i in range(60):
        words, (k, item) = _words(r, 60), items[i % len(items)]
        bad = i // len(items)  # so many substitutions
        held = list(item)
        for j in r.sample(range(len(held)), min(bad, len(held))):
            held[j] = "zzzz"
        docs.append((i, " ".join(words[:20] + held + words[20:]).replace("a", "A") + "!"))
        equal = [x == y for x, y in zip(held, item, strict=True)]
        # The best run by trying all.
        n = len(item)
        runs = [(sum(1 if e else -1.5 for e in equal[a:b]), -b, a) for a in range(n) for b in range(a + 1, n + 1)]
        _, minus_b, a = max(runs)  # of equal scores the earliest end, then the shortest
        same, size = sum(equal[a:-minus_b]), -minus_b - a
        seeded = any(all(equal[a + j] for j, on in enumerate(m) if on == "1") for m in MASKS for a in range(n - len(m) + 1))
        if (seeded and same >= 0.8 * size and same >= min(12, 0.8 * n)) if n >= 8 else same == n:
            want.add((i, k))
    df = spark.createDataFrame(docs, DOC).selectExpr("*", "1 as item_id")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in overlaps(df, bench).collect()} == want and len(want) > 20
    small = overlaps(df, bench, block_hashes=100)
    assert {(x.doc_id, x.item_id) for x in small.collect()} == want
    assert {x.doc_id for x in clean(df, bench, block_hashes=100).collect()} == set(range(60)) - {i for i, _ in want}


def test_every_accepted_run_holds_a_seed_and_is_found():
    """All replacements in short items, random ones in longer items, against trying every run; no seed and no score rule."""
    r = random.Random(5)
    for n in range(8, 41):
        item = np.array([r.getrandbits(63) for _ in range(n)], np.uint64)
        index = SeedIndex([(0, item)])
        sets = [c for m in range(5) for c in itertools.combinations(range(n), m)] if n <= 12 else []
        sets += [r.sample(range(n), r.randrange(1, n // 4 + 3)) for _ in range(400)] if n > 12 else []
        for lost in sets:
            held = item.copy()
            held[list(lost)] = [r.getrandbits(63) for _ in lost]
            equal = [0, *itertools.accumulate((held == item).astype(int).tolist())]
            want = max((s for a in range(n) for b in range(a + 1, n + 1) if (s := equal[b] - equal[a]) * 5 >= 4 * (b - a) and s >= min(12, 0.8 * n)), default=0)
            got = index.found(held, 12, 0.8, 1.5, True)
            assert bool(got) == bool(want) and (not got or got[0][2] >= min(12, 0.8 * n)), (n, lost)


def test_replaced_tokens_near_both_ends_do_not_hide_an_item(spark):
    item = [f"w{i}" for i in range(15)]
    held = [w if i not in (1, 13) else "other" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "before " + " ".join(held) + " after")], DOC)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    (row,) = overlaps(docs, bench, any_run=True).collect()
    assert (row.doc_start, row.n_tokens, row.n_equal) == (1, 15, 13) and clean(docs, bench, any_run=True).count() == 0


def test_short_items_are_found_whole(spark):
    items = ["What is the capital of France?", "Who was it", "yes", "one two three four five six seven"]
    docs = [
        "what is the CAPITAL of france", "So: what is the capital of France, they asked", "what is the capital of spain", "yes", "Yes, who was it then",
        "who was it", "one two three four five six seven", "one two three four x six seven", "yes yes", "zero one two three four five six seven",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), DOC)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(0, 0), (1, 0), (3, 2), (5, 1), (6, 3), (9, 3)}
    for hashes in (1 << 20, 1):
        assert {(x.doc_id, x.item_id) for x in overlaps(df, bench, any_run=True, block_hashes=hashes).collect()} == want
        assert {x.doc_id for x in clean(df, bench, any_run=True, block_hashes=hashes).collect()} == set(range(10)) - {i for i, _ in want}


def test_joined_hashes_give_the_rows_of_the_broadcast_index(spark):
    """Shared prompts, long texts, repeated rows and ids, ties between equal overlaps."""
    r = random.Random(4)
    prompt = _words(r, 9)
    items = [(i, " ".join(prompt + _words(r, r.randrange(1, 25)))) for i in range(40)] + [(3, " ".join(_words(r, 20))), (50, None), (51, "")]
    docs = []
    for i in range(60):
        item = r.choice(items[:41])[1].split()
        item[r.randrange(len(item))] = "zz"
        docs.append((i // 2, " ".join(_words(r, 30) + item + _words(r, 5) + (item if i % 5 == 0 else []))))
    docs += [docs[0], (None, docs[1][1]), (None, None), (99, ""), (98, " ".join(_words(r, 60_000)) + " " + items[5][1])]
    df = spark.createDataFrame([(*d, "clash", i) for i, d in enumerate(docs)], DOC + ", h string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted(tuple(-1 if v is None else v for v in x) for x in rows)
    one, other = (key(overlaps(df, bench, any_run=True, block_hashes=n).collect()) for n in (1 << 20, 1))
    assert one == other and len(one) > 60 and any(x[0] == 98 for x in one)
    kept = [sorted(x.item_id for x in clean(df, bench, any_run=True, block_hashes=n).collect()) for n in (1 << 20, 1)]
    assert kept[0] == kept[1] and clean(df, bench, block_hashes=1).columns == df.columns


def test_decontamination_edge_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text)], DOC)
    bench = spark.createDataFrame([(7, text), (7, text), (8, None), (9, "short item")], "item_id long, text string")
    assert sorted((x.doc_id or -1, x.item_id) for x in overlaps(docs, bench).collect()) == [(-1, 7), (1, 7), (1, 7)]
    assert sorted(x.doc_id for x in clean(docs, bench).collect()) == [2, 3]
    assert overlaps(docs.limit(0), bench).count() == 0
    assert overlaps(docs, bench.limit(0)).count() == 0 and clean(docs, bench.limit(0)).count() == 5
