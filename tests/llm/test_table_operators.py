"""Operators that relate rows: near-duplicates, vectors, archives, urls, pages, transcripts."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from staveline.llm import chat, html_main, minhash, subspace, url_templates, warc
from staveline.sources.scratch import scratch_path

DOC = "doc_id long, text string"


def _components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


# --- MinHash ------------------------------------------------------------------------------------------------------


def _shingles(text, n):
    w = (text or "").encode().lower().split() if (text or "").isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def _families(seed):
    """Groups of copies, of near copies around and across the threshold, a passage in very many texts, and single texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for size in (1, 2, 30, 60):
        base = [word() for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for j in r.sample(range(120), r.choice([0, 0, 1, 2, 3, 4, 5, 6, 8, 12])):
                copy[j] = r.choice([word(), "common", "the"])
            texts.append(" ".join(copy))
    for _ in range(60):
        own = [word() for _ in range(r.randint(20, 80))]
        texts.append(" ".join(own[:10] + passage + own[10:]))
    texts += ["", None, "one", "One", "one two", "x y z", "X  y\tz", "Été été x", "été été x", " ".join(passage)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "shingle", "per_cent"), [(1, 3, 85), (2, 5, 80)])
def test_near_duplicates_equal_all_pairs(spark, seed, shingle, per_cent):
    texts = _families(seed)
    sets = [_shingles(t, shingle) for t in texts]
    edges = [
        (i, j) for i, j in itertools.combinations(range(len(texts)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= per_cent * len(sets[i] | sets[j])
    ]
    want = _components(range(len(texts)), edges)
    df = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "1 as component_id", "'k' as key")
    rows = minhash.near_duplicates(df, shingle=shingle, per_cent=per_cent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}
    assert len(rows) == len(texts)
    kept = minhash.first_of_each_group(df, shingle=shingle, per_cent=per_cent)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_duplicates_edge_cases(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (5, "a b c"), (7, "b"), (7, "a")], DOC)
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (5, 1), (7, 7)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    kept = minhash.first_of_each_group(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "a b c"), (1, "a b c"), (7, "a")]


def test_match_floor_bounds_the_miss_rate():
    r = np.random.default_rng(1)
    for k, s in ((40, 0.85), (40, 0.8), (64, 0.85)):
        floor = minhash.match_floor(k, s)
        assert (r.binomial(k, s, 200_000) < floor).mean() < 1e-5 and floor > 0.35 * k


# --- embeddings ---------------------------------------------------------------------------------------------------


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(subspace, "CELL", 20)
    r = np.random.default_rng(4)
    centres = r.standard_normal((6, 16))
    vectors = [(c + 0.06 * r.standard_normal(16)).tolist() for c in centres for _ in range(25)]
    vectors += [vectors[0], vectors[0], [2 * v for v in vectors[3]], [0.0] * 16, None, [float("nan")] * 16, [1.0, None] * 8, [1.0, 2.0], [1.0, 2.0], [3.0], []]
    labels = [int(k) for k in r.integers(0, 2, len(vectors) - 1)] + [None]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and y is not None for v, y in zip(vectors, labels, strict=True)]
    edges = []
    for i, j in itertools.combinations(range(len(vectors)), 2):
        if good[i] and good[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
            x, y = np.array(vectors[i]), np.array(vectors[j])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                edges.append((i, j))
    want = _components(range(len(vectors)), edges)
    links = [sum(i in e for e in edges) for i in range(len(vectors))]
    df = spark.createDataFrame(list(zip(range(len(vectors)), vectors, labels, strict=True)), "vec_id long, embedding array<double>, label int")
    rows = subspace.near_vectors(df.selectExpr("*", "0 as rep")).collect()
    assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in rows} == {i: (links[i], want[i], want[i] == i) for i in want}
    assert subspace.near_vectors(df.limit(0)).count() == 0
    twice = subspace.near_vectors(df.union(df.filter("vec_id < 3"))).collect()
    assert len(twice) == len(vectors)


def test_blocks_cover_all_dimensions():
    for dim in (1, 3, 8, 13, 64):
        parts = subspace.splits(dim, 8)
        assert [x for lo, hi in parts for x in range(lo, hi)] == list(range(dim))
        for lo, hi in parts:
            assert subspace.share(hi - lo, 8) >= (hi - lo) / dim - 1e-12


# --- archives -----------------------------------------------------------------------------------------------------


def test_archives_are_read_back_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    pages = [(i, f"http://{'abc'[i % 3]}.Example.com/{i // 4}?q={i}", f"<p>{i % 7}é</p>" if i % 5 else None) for i in range(60)]
    pages += [(100, None, "x"), (101, "no scheme", ""), (102, "http://a.example.com/0?q=0", "same url"), (103, "http://x/\r\ny", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as file").repartition(3)
    rows = warc.round_trip(df).collect()
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    keeper = {}
    for i, _, h in pages:
        keeper[sha(h)] = max(i, keeper.get(sha(h), -1))
    assert len(rows) == len(pages)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}
    for i, _, h in pages:
        last = keeper[sha(h)]
        assert got[i] == (len((h or "").encode()), sha(h), "response" if i == last else "revisit", None if i == last else last)


def test_archive_edge_cases_and_record_format(spark):
    df = spark.createDataFrame([(None, "http://a/", "n"), (None, "http://a/", "n"), (3, "http://a/", "n"), (3, "http://a/", "n")], "page_id long, url string, html string")
    folder = scratch_path(spark, "archives")
    files = warc.archive(df, folder)
    found = warc.lookup(df.select("page_id", "url").distinct(), files).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in found) == [(-1, "response", None)] * 2 + [(3, "response", None)] * 2
    assert warc.lookup(spark.createDataFrame([(9, "http://zz/")], "page_id long, url string"), files).count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file://")).glob("*.warc.gz"))
    assert data.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 4
    broken = warc.record(1, "http://a/", b"payload", None, digest="A" * 32)
    with pytest.raises(ValueError, match="doesn't hold"):
        warc.parse(broken)


def test_url_keys():
    assert warc.surt("http://www.Example.com/a?b#c") == "com,example,www)/a?b#c"
    assert warc.surt(None) == warc.surt("nothing") == ")"


# --- urls ---------------------------------------------------------------------------------------------------------

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _judge(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


@pytest.mark.parametrize("inline", [64, 0])
def test_rules_hosts_and_paths(spark, monkeypatch, inline):
    monkeypatch.setattr(url_templates, "INLINE_RULES", inline)
    urls = [
        "http://a.EXAMPLE.com/en/7", "http://example.com/en/8", "https://com/en/", "http://xcom/en/1", "http://b.example.net/de/81?x#y", "ftp://net/de/1",
        "http://a.org/es/1#f", "http://ÀB.org/es/", "http://a.org?/es/", "http://a.org#/es/", "x://y://z/en/", "://com/en/1", None, "", "no scheme", "http://com\n/en/2", "HTTP://A.COM/EN/",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, bad boolean").selectExpr("*", "1 as host", "2 as shape")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_templates.judge_urls(df, RULES).collect()}
    assert got == {i: (*_judge(u)[:3], _judge(u)[3] or "allow") for i, u in enumerate(urls)}
    assert url_templates.judge_urls(df.limit(0), RULES).count() == 0


@pytest.mark.parametrize("inline", [64, 0])
def test_rules_of_one_length_are_judged_alike_on_both_paths(spark, monkeypatch, inline):
    monkeypatch.setattr(url_templates, "INLINE_RULES", inline)
    rules = [("block", "b.a.com", "/x"), ("allow", "a.com", "/xyz"), ("block", "c.com", "/t"), ("allow", "c.com", "/t")]
    urls = ["http://b.a.com/xyz", "http://c.com/t", "http://b.a.com/x", "http://c.com/t", "http://c.com/" + "s/" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "cast(null as boolean) as bad")
    got = {r.page_id: (r.rule, r.verdict) for r in url_templates.judge_urls(df, rules).collect()}
    assert got == {0: ("a.com/xyz", "allow"), 1: ("c.com/t", "allow"), 2: ("b.a.com/x", "block"), 3: ("c.com/t", "allow"), 4: (None, "allow")}


def test_templates_generalise_and_reject(spark):
    rows = []
    for i in range(400):
        rows.append((i, f"http://shop.test/item/{'x' * (i % 9)}{i}a{i * 7}.html", False if i % 3 else None))
        rows.append((1000 + i, f"http://shop.test/spam/w{i}q", True if i % 3 else None))
        rows.append((2000 + i, f"http://good.test/{'ab'[i % 2]}/z{i}", False))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = url_templates.judge_urls(df, []).collect()
    verdicts = {r.page_id: (r.template, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert all(verdicts[1000 + i][1] == "block" and verdicts[i][1] == "allow" and verdicts[2000 + i][1] == "allow" for i in range(400))
    assert {verdicts[1000 + i][0] for i in range(400)} == {"/spam/+"} and len({verdicts[2000 + i][0] for i in range(400)}) == 1


def test_deep_sections_and_small_directories_are_told_apart(spark):
    rows = []
    for i in range(300):
        section = "abc"[i % 3]
        rows.append((i, f"http://news.test/2024/05/12/{section}/x{i}", section == "a"))
        rows.append((1000 + i, f"http://deep.test/p/q/r/s/t/u/{section}/y{i}", section == "a"))
    rows += [(2000 + i, f"http://hot.test/d{chr(97 + i % 20)}/z{i}", False) for i in range(3000)]
    rows += [(6000 + i, f"http://hot.test/rare/z{i}", True) for i in range(20)]  # 0.7 % of the host
    rows += [(7000 + i, f"http://wide.test/{''.join(chr(97 + int(c)) for c in str(i % 150))}/z{i}", i % 150 == 7) for i in range(1500)]
    rows += [(9000, "http://long.test" + "/a" * 400, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = {r.page_id: r for r in url_templates.judge_urls(df, []).collect()}
    assert len(out) == len(rows)
    assert all((out[p].verdict == "block") == bool(bad) for p, _, bad in rows)
    assert out[9000].template == "/+" * 400


def test_url_filter_runs_no_python(spark):
    df = spark.createDataFrame([(1, "http://a/b", True)], "page_id long, url string, bad boolean")
    plan = url_templates.judge_urls(df.filter("page_id > 0"), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pages --------------------------------------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    r = random.Random(1)
    for _ in range(150):
        n = r.randint(1, 9)
        lean = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1.5)) for i in range(n) for j in range(i) if r.random() < 0.4]

        def cost(labels, lean=lean, edges=edges):
            own = sum(max(-x, 0) if k else max(x, 0) for x, k in zip(lean, labels, strict=True))
            return own + sum(c for i, j, c in edges if labels[i] != labels[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(html_main.minimum_cut(lean, edges)) == pytest.approx(best)


def test_main_text_of_pages(spark):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="home">
    <header><a href=x>Logo</a><h1>Site</h1></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div><main><article>
    <header><h1>Title</h1></header><p>First &amp; para<br>more<p>Second <b>bold</b> &nbsp; text &#x41;</p><div class="ad">Buy</div>
    <ul><li>one<li>two</ul><section id="comments"><h3>Comments</h3><p>Nice post, thanks.</p></section><form>Mail <input></form>
    </article></main><aside>Side</aside><footer>Foot"""
    bare = """<div id="menu"><a href=a>A</a> <a href=b>B</a></div><div><h1>Heading here</h1><p>Long paragraph with text, and more. It is good.</p>
    <p>short</p><p>Another long paragraph, with commas, and more text. Yes.</p></div><div class="footer">c 2020</div>"""
    rows = [(1, "u", page), (1, "u", page), (2, None, bare), (3, "v", None), (4, "w", ""), (5, "x", "<article>a < b<p>" + "long " * 30_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = {r.page_id: (r.url, r.text, r.n_chars) for r in html_main.extract(df).collect()}
    one = "Title\n\nFirst & para more\n\nSecond bold text A\n\none\n\ntwo"
    assert out[1] == ("u", one, len(one))
    assert out[2][1].split("\n\n")[0] == "Heading here" and "short" in out[2][1] and "2020" not in out[2][1]
    assert out[3] == ("v", "", 0) and out[4] == ("w", "", 0)
    assert out[5][1] == "a < b\n\n" + " ".join(["long"] * 30_000)
    assert html_main.extract(df).count() == len(rows) and html_main.extract(df.limit(0)).count() == 0


def test_wrappers_and_headers_by_name_do_not_take_the_article():
    text = "<p>A long paragraph with text, and more of it. It is good.</p><p>Another one, with commas, and some text. Yes.</p>"
    for wrapper in ('class="content has-sidebar"', 'id="page-with-comments"', 'class="no-js without-banner"'):
        got = html_main.main_text(f"<div {wrapper}>{text}</div><div class='sidebar'><a href=x>One</a> <a href=y>Two</a></div>", html_main.PRIOR)
        assert got.count("\n\n") == 1 and "One" not in got
    page = f"<div class='sidebar-left-layout'><main><div class='post-header'><h1>The headline</h1></div>{text}<div class=comments><p>Nice, thanks.</p></div></main></div>"
    got = html_main.main_text(page, html_main.PRIOR)
    assert got.startswith("The headline\n\nA long") and "Nice" not in got


def test_elements_without_end_do_not_take_the_rest():
    for name in ("iframe", "svg", "object", "canvas", "noscript"):
        assert "after" in html_main.main_text(f"<article><p>before</p><{name} a=b><p>after</p>", html_main.PRIOR)
        assert "inside" not in html_main.main_text(f"<article><p>before</p><{name}>inside</{name.upper()} ><p>after</p>", html_main.PRIOR)
    assert html_main.main_text("<article>a<p title='x>y' id=q\"r>b</p>", html_main.PRIOR) == "a\n\nb"


def test_long_pages_take_linear_time():
    n = 1 << 19
    pages = ["<a ", '<a href="', "<a b='", "<div>", "</div>", "<div><b>", "<!--", "<svg>", "<p>x", "<i><li>y", "<div><p>x"]
    for piece in pages:
        took = []
        for size in (n // 8, n):
            start = time.process_time()
            html_main.main_text(piece * (size // len(piece)) + "'\"", html_main.PRIOR)
            took.append(time.process_time() - start)
        assert took[1] < 24 * took[0] + 0.5, (piece, took)
    r = random.Random(3)
    lean = [r.uniform(-1, 1) for _ in range(20_000)]
    edges = [(i, i + 1, r.uniform(0.2, 2)) for i in range(19_999)] + [(i, i + 3, 1.0) for i in range(0, 19_990, 2)]
    start = time.process_time()
    labels = html_main.minimum_cut(lean, edges)
    assert any(labels) and not all(labels) and time.process_time() - start < 30


# --- transcripts --------------------------------------------------------------------------------------------------


def _talk(spark, seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        roles = ["system"] * (r.random() < 0.3) + ["user", "assistant"] * r.randint(1, 5)
        for t, role in enumerate(roles):
            text = "Be kind." if role == "system" else "What is it?" if role == "user" else "\n".join("An answer of some length, with details." for _ in range(r.randint(1, 4)))
            rows.append((c, t, role, text))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered_and_rendered(spark):
    talk = chat.as_transcript(_talk(spark, 1, 60))
    out = chat.parse(talk.drop("role").selectExpr("*", "1 as h", "2 as codes"), talk.filter("conv_id < 40").select("conv_id", "turn", "role"))
    first = out.filter("line = 0 and conv_id >= 40").join(talk.withColumnRenamed("role", "truth"), ["conv_id", "turn"])
    right, n = first.agg(F.avg((F.col("role") == F.col("truth")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.95
    lines = sorted((r.turn, r.line, r.rendered) for r in out.filter("conv_id = 41").collect())
    text = "\n".join(x for _, _, x in lines)
    assert text.startswith("<|im_start|>") and text.endswith("<|im_end|>") and text.count("<|im_start|>") == text.count("<|im_end|>")


def test_viterbi_in_chunks_is_viterbi(spark, monkeypatch):
    talk = chat.as_transcript(_talk(spark, 2, 25))
    roles = talk.select("conv_id", "turn", "role")
    key = lambda df: sorted(map(tuple, df.select("conv_id", "turn", "line", "role", "begins", "rendered").collect()))
    whole = key(chat.parse(talk.drop("role"), roles))
    monkeypatch.setattr(chat, "CHUNK", 2)
    for lines in (4096, 3, 0):
        monkeypatch.setattr(chat, "LINES", lines)
        assert key(chat.parse(talk.drop("role"), roles)) == whole


def test_a_transcript_in_one_row_is_parsed_as_in_many(spark):
    talk = chat.as_transcript(_talk(spark, 5, 30))
    roles = talk.select("conv_id", "turn", "role")
    codes = chat.coded(talk.select("conv_id", "turn", "text", F.xxhash64("text").alias("h")))
    chain = chat.train(codes, codes.select("conv_id", "turn", "h").join(roles, ["conv_id", "turn"]))
    one = talk.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    one = one.select("conv_id", F.lit(0).alias("turn"), F.concat_ws("\n", "x.text").alias("text"))
    lines = lambda df: [(r.conv_id, r.role, r.begins, r.rendered) for r in df.orderBy("conv_id", "turn", "line").collect()]
    many = lines(chat.parse(talk.drop("role"), chain=chain))
    assert lines(chat.parse(one, chain=chain)) == many
    long = "\n".join(f"{'AI' if k % 2 else 'User'}: line {k}" for k in range(9000))
    rows = chat.parse(spark.createDataFrame([(1, 0, long)], "conv_id long, turn long, text string"), chain=chain).orderBy("line").collect()
    assert len(rows) == 9000 and all(r.begins and r.role == ("assistant" if r.line % 2 else "user") for r in rows)


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(3)
    n = len(chat.STATES)
    chain = chat.Chain(r.integers(0, 9, n).astype(float), r.integers(0, 9, (n, n)).astype(float), [r.integers(0, 9, (n, s)).astype(float) for s in chat.SIZES])
    codes = r.integers(0, int(np.prod(chat.SIZES)), 5)
    e = chain.emissions(codes)
    score = lambda p: chain.start[p[0]] + e[0][p[0]] + sum(chain.step[a, b] + e[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(p)))
    best = max(itertools.product(range(n), repeat=5), key=score)
    assert score(chain.path(codes, None, best[-1]).tolist()) == pytest.approx(score(best))
    m = chain.matrix(codes[1:])
    assert max((chain.start + e[0])[:, None].repeat(n, 1).__add__(m).max(0)) == pytest.approx(score(best))


def test_transcript_edge_cases(spark):
    rows = [(1, 0, "User: hi"), (1, 0, "User: hi"), (1, 1, None), (2, None, ""), (None, 0, "lost"), (3, 5, "x\n" * 3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    roles = spark.createDataFrame([(1, 0, "user"), (1, 1, None)], "conv_id long, turn long, role string")
    out = chat.parse(df, roles).collect()
    assert sorted((r.conv_id, r.turn) for r in out if r.line == 0) == [(1, 0), (1, 0), (1, 1), (2, -1), (3, 5)]
    assert chat.parse(df.limit(0), roles).count() == 0
