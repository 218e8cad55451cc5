"""The operators against brute force, the libraries and edge cases."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import brown_lm, chat_tools, compaction, decontamination, html_extraction, jaccard_join, language_id, packing, quality_rules, queries, token_counts
from quillon.llm.common import small_batches

from ..oracle import check

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and columns whose names clash with outputs."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", None, None),
        (2, "", None, "s", 0),
        (3, "  \n\t ", "en", "s", 4),
        (4, "one", "en", "s", 3),
        (5, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (6, long, "en", "s", len(long)),
        (7, "x" * 30_000, "en", "s", 30_000),
        (8, "¿qué? 日本語 \U0001f600 \x00 <|endoftext|>", "es", "s", 5),
        (None, "no id at all", None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("score", "kept", "n_words", "n_tokens", "lang_pred", "held_out", "failed", "node", "root")})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.oracle_sql()[name])


# --- 1: HTML --------------------------------------------------------------------


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_articles(spark, sf_dir):
    from html import unescape

    def truth(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        return "\n\n".join(x for x in parts if x)

    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in table.collect()}
    got = html_extraction.extract(table).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == truth(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_markup():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice">We use cookies</div><header class="top">Site</header>
    <main><h1>A &amp; B</h1><p>One <b>two</b>\n three<p>Four&nbsp;x<div class="ad">buy</div><ul><li>a<li>b</ul><section id="comments"><p>troll</p></section>
    <form><p>Name</p><input></form><footer>by me</footer><p hidden>secret</p><script>var t="</p>";</script></main><aside>side</aside><!-- note --></body>"""
    assert [t for s, t in html_extraction.blocks(page) if s == html_extraction.IN] == ["A & B", "One two three", "Four x", "a", "b"]
    nested = '<div class="banner wrap"><p>x</p><article class="post promo"><p>in</p><article class="comment"><p>troll</p></article></article></div><div class="has-sidebar"><p>open</p></div><div id=comments><article>no</article></div>'
    assert html_extraction.blocks(nested) == [(2, "x"), (1, "in"), (2, "troll"), (0, "open"), (2, "no")]
    assert html_extraction.blocks("<div><a href=x>Home</a> <a>News</a></div><p>See <a>this</a> for all the details</p>") == [(2, "Home News"), (0, "See this for all the details")]
    assert html_extraction.blocks(None) == [] and html_extraction.blocks("a < b") == [(0, "a < b")] and html_extraction.blocks("<script>x") == []
    assert html_extraction.blocks("<p>&lt;b&gt; &#233; &unknown;") == [(0, "<b> é &unknown;")]


def test_repeats_by_brute_force():
    rng = random.Random(5)
    stock = [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(40)) for _ in range(12)) for _ in range(4)]
    texts, page = [], []
    for p in range(12):
        for _ in range(rng.randrange(1, 5)):
            texts.append(rng.choice(stock) if rng.random() < 0.5 else " ".join(str(rng.random()) for _ in range(rng.randrange(1, 15))))
            page.append(p)
    streams = collections.defaultdict(list)
    for i, (t, p) in enumerate(zip(texts, page, strict=True)):
        streams[p] += [(w, i) for w in t.split()]
    seen = collections.defaultdict(set)
    run = html_extraction.RUN
    for p, s in streams.items():
        for k in range(len(s) - run + 1):
            seen[tuple(w for w, _ in s[k : k + run])].add(p)
    hit = collections.Counter()
    for s in streams.values():
        covered = set()
        for k in range(len(s) - run + 1):
            if len(seen[tuple(w for w, _ in s[k : k + run])]) > 1:
                covered.update(range(k, k + run))
        hit.update(s[k][1] for k in covered)
    want = [hit[i] / len(t.split()) for i, t in enumerate(texts)]
    assert np.allclose(html_extraction.repeats(texts, np.array(page)), want)
    assert list(html_extraction.repeats([], np.zeros(0, int))) == [] and list(html_extraction.repeats(["", "a"], np.array([0, 1]))) == [0, 0]


def test_unique_runs_stay(spark):
    """Without an article the array decides: what pages share goes, what is theirs stays."""
    menu = "Home News Sport Weather Travel Food Science Culture Contact us"
    legal = "All rights reserved by the owners of this site since many years ago"
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(30))
    rows = [(i, "https://h.example/a", f"<body><div>{menu}</div><div>{body(i)}</div><div>{legal}</div></body>") for i in range(6)]
    rows += [(90, None, "<p>hello"), (91, "https://h.example/z", None), (92, "https://h.example/z", ""), (0, *rows[0][1:])]
    got = html_extraction.extract(pages(spark, *rows).withColumn("text", F.lit("clash")), group=4).collect()
    text = collections.defaultdict(set)
    for r in got:
        text[r["page_id"]].add(r["text"])
    assert len(got) == len(rows) and text[90] == {"hello"} and text[91] == text[92] == {""}
    big = html_extraction.extract(pages(spark, *rows)).collect()
    assert all(r["text"] == body(r["page_id"]) for r in big if r["page_id"] < 6)
    copies = [(i, "https://c.example/", f"<body><div>{body(1)}</div><p>{body(2)}</p></body>") for i in range(3)]
    assert {r["text"] for r in html_extraction.extract(pages(spark, *copies)).collect()} == {body(1) + "\n\n" + body(2)}
    assert html_extraction.extract(pages(spark, (1, "u", "x")).limit(0)).count() == 0


def test_groups_of_a_host_have_one_threshold(spark):
    """A footer on a few pages of a host goes from all of them, however the host is dealt; copies count once."""
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(20))
    foot = "This footer of nine words stands on few pages"
    rows = [(i, "https://h.example/a", f"<body><div>{body(i)}</div>" + (f"<div>{foot}</div>" if i % 10 == 0 else "") + "</body>") for i in range(1, 61)]
    rows += [(100 + i, "https://h.example/a", f"<body><div>{body(7)}</div></body>") for i in range(4)] + [(None, "https://h.example/a", f"<p>{body(8)}")]

    def got(n):
        return sorted((r["page_id"] or -1, r["text"], r["n_repeated"]) for r in html_extraction.extract(pages(spark, *rows), group=n).collect())

    assert got(4) == got(1000)
    assert all(t == body({-1: 8}.get(i, 7 if i >= 100 else i)) for i, t, _ in got(4))


def test_unique_words_of_a_block_stay(spark):
    """In a block of shared and own words just the shared run goes, whichever is longer."""
    shared = " ".join(f"shared{j}" for j in range(12))
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    rows = [(i, "https://h.example/a", f"<body><div>{own(i, 5)} {shared} {own(-i, 1 + 9 * (i % 2))}</div></body>") for i in range(1, 7)]
    for n in (2, 64):
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, *rows), group=n).collect()}
        assert got == {i: f"{own(i, 5)} {own(-i, 1 + 9 * (i % 2))}" for i in range(1, 7)}


def test_attributes_are_read_whole():
    """Names and values inside other values, and names of content, do not put text away."""
    kept = ['title="a hidden gem"', 'data-hidden="false"', 'data-style="display:none"', 'data-role="ad"', 'data-id="share-1"', "title='class=\"ad\"'", 'class="social-science"', 'id="notice-of-meeting"', 'class="comments-policy-article"', "class=lead data-x=a>b"]
    for a in kept[:-1]:
        assert html_extraction.blocks(f"<article><p {a}>Hello</p></article>") == [(1, "Hello")], a
        assert html_extraction.blocks(f"<div {a}><p>Hello</p></div>") == [(0, "Hello")], a
    away = ["hidden", 'hidden=""', "HIDDEN", 'class="ad"', "class=ad", 'id="cookie-notice"', 'class="x siteFooter"', 'style="color:red; display: none"', "aria-hidden='true'", 'class="comment-list"', 'role="navigation"']
    for a in away:
        assert html_extraction.blocks(f"<div {a}><p>Hello</p></div>") in ([(2, "Hello")], [(3, "Hello")]), a
    assert html_extraction.blocks('<p><a href="/x">A long link that is all of its paragraph</a></p><li><a href="/y">Home</a></li>') == [(0, "A long link that is all of its paragraph"), (2, "Home")]


def test_markup_is_read_in_one_pass():
    """Broken mark-up takes time in proportion to its length."""
    import time

    def seconds(page):
        began = time.process_time()
        html_extraction.blocks(page)
        return time.process_time() - began

    n = 8000
    for page in ("<p data='" * n, "<p data='>" * n, "<p a=\"x' b='y\">" * n, "<b>" * n + "</span>" * n, "<div>" * n + "</span>" * n, "<span>" + "<div>" * n + "</span>" * n, "<i>" + "<b>" * n + "</i></u>" * n, "<" * 9 * n, "<!--" * n, "<script>" * n, "<a " + " " * 9 * n, "<p x" + "=" * 9 * n, "<p>x" * n, "</" * n, "<li><b>" * n):
        assert seconds(page) < 0.5, page[:20]
    assert html_extraction.blocks("<p class='x>one</p><p>two</p>") == [(0, "one"), (0, "two")]


def open_pages(seed, n=40):
    """Pages without an article: shared and own runs of words in mixed blocks, and copies."""
    rng = random.Random(seed)
    own = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 15)))
    stock = [" ".join(f"s{k}x{rng.randrange(6)}" for _ in range(rng.choice([6, 8, 9, 20]))) for k in range(8)]
    rows = []
    for i in range(n):
        body = "".join(f"<div>{' '.join(rng.choice([own(), rng.choice(stock[: 2 + i % 7])]) for _ in range(rng.randrange(1, 4)))}</div>" for _ in range(rng.randrange(1, 5)))
        rows += [(len(rows) + k, f"https://h{i % 3}.example/{i}", f"<html><body>{body}<nav>menu {k}</nav></body></html>") for k in range(rng.choice([1, 1, 1, 4]))]
    return rows


def runs_removed(rows, run=8, share=20):
    """The definition, page by page: words in a run that is on two contents and a twentieth of a host's go."""
    hosts = collections.defaultdict(list)
    for i, url, html in rows:
        parts = [" ".join(re.sub("<[^>]+>", " ", x).split()) for x in re.findall(r"<div>(.*?)</div>", html)]
        hosts[url.split("/")[2]].append((i, [p for p in parts if p]))
    out = {}
    for mine in hosts.values():
        on = collections.defaultdict(set)
        for _, parts in mine:
            w = " ".join(parts).split()
            for k in range(len(w) - run + 1):
                on[tuple(w[k : k + run])].add(tuple(parts))
        n = len({tuple(parts) for _, parts in mine if parts})
        for i, parts in mine:
            w = " ".join(parts).split()
            gone = {p for k in range(len(w) - run + 1) if (m := len(on[tuple(w[k : k + run])])) >= 2 and share * m >= n for p in range(k, k + run)}
            texts, at = [], 0
            for p in parts:
                size = len(p.split())
                texts.append(" ".join(x for k, x in enumerate(p.split(), at) if k not in gone))
                at += size
            out[i] = "\n\n".join(t for t in texts if t)
    return out


@pytest.mark.parametrize("group", [3, 64])
def test_pages_without_an_article_by_brute_force(spark, group):
    for seed in (1, 2):
        rows = open_pages(seed)
        want = runs_removed(rows)
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, *rows), group=group).collect()}
        assert got == want and any(want.values()) and sum(map(len, want.values())) < sum(len(re.sub("<[^>]+>", "", h)) for _, _, h in rows)


@pytest.mark.parametrize("group", [5, 64])
def test_a_line_in_most_articles_goes(spark, group):
    """Inside articles just a whole short block that half of a host's pages have; quotes and copies stay."""
    quote = " ".join(f"quoted{j}" for j in range(30))
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(25))
    line = "<p>Sign up for our weekly letter</p>"
    rows = [(i, "https://h.example/a", f"<article><h1>Title number {i} here</h1><p>{body(i)}</p>{line}" + (f"<p>{quote}</p>" if i < 6 else "") + "</article>") for i in range(20)]
    rows += [(100 + i, "https://h.example/a", rows[0][2]) for i in range(30)]
    rows += [(200 + i, "https://small.example/a", f"<article><p>{body(i)}</p>{line}</article>") for i in range(5)]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages(spark, *rows), group=group).collect()}
    assert got[0] == f"Title number 0 here\n\n{body(0)}\n\n{quote}" == got[110] and got[9] == f"Title number 9 here\n\n{body(9)}"
    assert got[203] == f"{body(3)}\n\nSign up for our weekly letter"


def test_odd_pages(spark):
    """Null, repeated and large ids, a very long page, an empty host, ties, clashing columns and an empty table."""
    long = "<p>" + " ".join(f"w{i}" for i in range(200_000))
    rows = [(None, None, "<p>a"), (None, None, "<p>b"), (2**60 + 1, "", "<p>c"), (7, "x", long), (7, "x", "<p>d"), (7, "x", "<p>d"), (8, "https://EXAMPLE/é", None)]
    df = pages(spark, *rows).withColumns({c: F.lit("clash") for c in ("host", "text", "shard", "groups", "many", "key")})
    for group in (2, 64):
        got = sorted((r["page_id"] or 0, r["text"][:3], r["n_chars"]) for r in html_extraction.extract(df, group=group).collect())
        assert got == [(0, "a", 1), (0, "b", 1), (7, "d", 1), (7, "d", 1), (7, "w0 ", len(long) - 3), (8, "", 0), (2**60 + 1, "c", 1)]
    assert html_extraction.extract(df.limit(0)).count() == 0


# --- 2: languages -----------------------------------------------------------------


def test_languages(spark, docs):
    got = language_id.identify(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and abs(sum(r["proportions"].values()) - 1) < 1e-6 for r in got)


def test_mixtures(spark, docs):
    model = language_id.fit(docs, F.lit(True))
    en, fr = ([r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(20).collect()] for x in ("en", "fr"))
    # Neither text nor languages name the answer; half and half is both.
    a, b = " ".join(en)[:6000], " ".join(fr)[:6000]
    lang, score, pi = model.predict(a + " " + b)
    shares = dict(zip(model.languages, pi, strict=True))
    assert abs(shares["en"] - 0.5) < 0.1 and abs(shares["fr"] - 0.5) < 0.1 and shares["de"] == shares["es"] == 0
    assert model.predict(a)[0] == "en" and model.predict(a)[1] == 1.0
    dense = model.predict(a * 40)  # counted by bucket
    assert dense[0] == "en" and dense[1] == 1.0
    assert model.predict("123 !?")[0] == "und" and model.predict(None)[:2] == ("und", 0.0)


def test_mixtures_by_brute_force(docs, texts):
    """Proportions and sets of languages by EM in plain loops over every set, and by leaving out one language at a time."""
    import math

    model = language_id.fit(docs, F.lit(True))
    k, size = model.like.shape

    def em(p, rows):
        pi = {r: 1 / len(rows) for r in rows}
        for _ in range(60):
            new = dict.fromkeys(rows, 0.0)
            for x in p:
                mixed = sum(pi[r] * x[r] for r in rows)
                for r in rows:
                    new[r] += pi[r] * x[r] / mixed / len(p)
            pi = new
        return pi, sum(math.log(sum(pi[r] * x[r] for r in rows)) for x in p)

    some = [t[:100] for _, t in sorted(texts.items())[:12] if t and len(t) > 100]
    some += [a[:60] + " " + b[:60] for a, b in zip(some[:4], some[4:8], strict=True)]
    same = 0
    for t in some:
        g = language_id.grams(t, size)
        p = model.like[:, g].T.astype(float).tolist()
        fits = {}
        for mask in range(1, 1 << k):
            rows = [r for r in range(k) if mask >> r & 1]
            pi, fit = em(p, rows)
            fits[mask] = (fit - model.penalty * math.log(len(g)) * len(rows), pi)
        value, pi = max(fits.values(), key=lambda f: f[0])
        lang, score, got = model.predict(t)
        top = max(pi, key=pi.get)
        mine = fits[sum(1 << int(r) for r in np.flatnonzero(got))]
        same += lang == model.languages[top] and abs(score - pi[top]) < 0.05
        assert mine[0] >= value - 3 and all(abs(got[r] - q) < 0.08 for r, q in mine[1].items())
    assert same >= 0.9 * len(some)


def test_many_languages(spark, monkeypatch):
    """Every label is learnt, by few EM runs, and the model keeps its size."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(3)
    own = {f"l{i:03d}": ["".join(rng.choice(letters) for _ in range(4)) for _ in range(12)] for i in range(300)}
    rows = [(i * 300 + j, " ".join(rng.choice(ws) for _ in range(30)), l) for i in range(3) for j, (l, ws) in enumerate(own.items())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, F.lit(True))
    assert model.languages == sorted(own) and all(model.predict(t)[0] == l for _, t, l in rows[:40])
    monkeypatch.setattr(language_id, "MODEL", 300 * 4096)
    small = language_id.fit(df, F.lit(True))
    assert small.like.shape == (300, 4096) and sum(small.predict(t)[0] == l for _, t, l in rows[:40]) >= 38


def test_language_edges(spark):
    got = {r["doc_id"]: r for r in language_id.identify(odd(spark)).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == "und" and got[1]["score"] == 0
    assert len(language_id.identify(odd(spark)).columns) == len(set(odd(spark).columns) | {"proportions"})
    assert language_id.identify(odd(spark).limit(0)).count() == 0
    untaught = language_id.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


# --- 3: tool calls ------------------------------------------------------------------

SCHEMAS = {"t": (chat_tools.Parameter("b", "integer"), chat_tools.Parameter("a", "object", False))}
CALLS = "conv_id long, call_id string, turn long, tool string, args string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def linked(spark, calls, results=()):
    out = chat_tools.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMAS)
    return {r["call_id"]: r for r in out.collect()}


def test_links(spark):
    calls = [
        (1, "a", 0, "t", '{"b":1,"a":{"d":[1, 2],"c":null}}', ["b"]),
        (1, "b", 1, "t", '{"b":"x"}', []),
        (1, "c", 2, "u", '{"z":1}', ["zz"]),
        (2, "x", 0, "t", '{"b":2.5,"extra":1}', ["y"]),
        (2, "y", 1, "t", "{bad", ["x"]),
        (3, "s", 0, "t", "[1]", ["s"]),
        (None, "q", 0, "t", None, None),
    ]
    got = linked(spark, calls, [(1, "a", 5, 'hé"\n'), (1, "a", 4, "first"), (1, "nobody", 1, "x"), (None, "q", 1, "x")])
    assert json.loads(got["a"]["json"]) == {"arguments": {"a": {"c": None, "d": [1, 2]}, "b": 1}, "id": "a", "result": "first", "tool": "t"}
    assert got["a"]["json"].startswith('{"arguments":{"a":{"c":null,"d":[1,2]},"b":1},"id":')
    assert got["a"]["valid"] and got["a"]["linked"] and (got["a"]["level"], got["b"]["level"]) == (1, 0)
    assert got["b"]["errors"] == ["type:b"] and got["c"]["errors"] == ["unknown_tool", "missing_dependency"]
    assert got["x"]["errors"] == ["type:b", "unknown:extra", "cycle"] and got["x"]["level"] is None
    assert got["y"]["errors"] == ["invalid_json", "cycle"] and got["s"]["errors"] == ["invalid_json", "cycle"]
    assert got["nobody"]["errors"] == ["unknown_call"] and got["nobody"]["tool"] is None
    assert chat_tools.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_levels_are_depths(spark):
    """A chain of three has three levels, whatever else the conversation holds; a long chain takes few rounds."""
    chain = [(1, "c", 2, "t", '{"b":1}', ["b"]), (1, "b", 1, "t", '{"b":1}', ["a"]), (1, "a", 0, "t", '{"b":1}', [])]
    back = [(1, "x", 3, "t", '{"b":1}', ["y"]), (1, "y", 4, "t", '{"b":1}', None)]
    long = [(2, f"n{i}", i, "t", '{"b":1}', [f"n{i - 1}"] if i else []) for i in range(100)]
    for calls in (chain, chain + back):
        got = linked(spark, calls)
        assert [got[x]["level"] for x in "abc"] == [0, 1, 2] and all(r["valid"] for r in got.values())
    assert [linked(spark, long)[f"n{i}"]["level"] for i in (0, 1, 64, 99)] == [0, 1, 64, 99]
    hung = linked(spark, [(1, "p", 0, "t", '{"b":1}', ["q"]), (1, "q", 1, "t", '{"b":1}', ["p"]), (1, "r", 2, "t", '{"b":1}', ["q"])])
    assert all(r["level"] is None and r["errors"] == ["cycle"] for r in hung.values())


def test_results_of_no_call(spark):
    got = chat_tools.link(spark.createDataFrame([(1, "a", 0, "t", '{"b":1}', [])], CALLS), spark.createDataFrame([(1, "z", 4, "b"), (1, "z", 3, 'q"'), (None, "a", 1, "n"), (1, "a", 1, "r")], RESULTS), SCHEMAS).collect()
    alone = sorted(((r["conv_id"] or 0, r["call_id"], r["turn"], r["linked"], r["errors"], r["json"]) for r in got if r["tool"] is None))
    assert len(got) == 3 and alone == [(0, "a", 1, False, ["unknown_call"], '{"id":"a","result":"n"}'), (1, "z", 3, False, ["unknown_call"], '{"id":"z","result":"q\\""}')]


def test_canonical_json(spark):
    cases = {
        '{"b":1.0, "a":1e2}': '{"a":100,"b":1}',
        '{"x":[1, 1.50, -0.0, 1E-3, 12345678901234567890, 1.0e7, 2.5e-9, 1e30, 0.1]}': '{"x":[1,1.5,0,0.001,12345678901234567890,10000000,2.5e-9,1e+30,0.1]}',
        '{"s":"1.0 and \\"2e5\\" 3.0", "n": null, "t": true}': '{"n":null,"s":"1.0 and \\"2e5\\" 3.0","t":true}',
        "{}": "{}",
        "{bad": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", chat_tools.canonical(F.col("a")).alias("c"))
    assert {r["a"]: r["c"] for r in df.collect()} == cases


def test_odd_calls(spark):
    """Repeated calls and very long texts, clashing columns, and empty tables."""
    long = json.dumps({"b": 1, "a": {"x": "y" * 2_000_000}})
    calls = spark.createDataFrame([(1, "a", 0, "t", long, None)] * 3 + [(1, "a", 5, "t", '{"b":2}', None)], CALLS)
    results = spark.createDataFrame([(1, "a", 1, "z" * 2_000_000)], RESULTS)
    clash = {c: F.lit("clash") for c in ("level", "missing", "result", "canonical", "linked", "errors", "json", "needs")}
    got = chat_tools.link(calls.withColumns(clash), results.withColumns(clash), SCHEMAS).collect()
    assert sorted(r["turn"] for r in got) == [0, 5] and all(r["linked"] and r["level"] == 0 for r in got)
    assert json.loads(max((r["json"] for r in got), key=len))["arguments"] == json.loads(long)
    assert chat_tools.link(calls.limit(0), results, SCHEMAS).count() == 1 and chat_tools.link(calls, results.limit(0), SCHEMAS).where("linked").count() == 0


def test_order_by_brute_force(spark):
    rng = random.Random(3)
    calls, needs = [], {}
    for c in range(6):
        order = list(range(12))
        rng.shuffle(order)
        for k, name in enumerate(order):
            needs[c, name] = [order[j] for j in range(k) if rng.random() < 0.2]
            calls.append((c, f"{c}-{name}", name, "t", '{"b":1}', [f"{c}-{d}" for d in needs[c, name]]))
    got = linked(spark, calls)
    for (c, name), ds in needs.items():
        me = got[f"{c}-{name}"]
        assert me["level"] == max((got[f"{c}-{d}"]["level"] + 1 for d in ds), default=0)


# --- 4: near duplicates ----------------------------------------------------------------


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def classes(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, links, top = sorted(sets), collections.Counter(), {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    where = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            where[s].append(i)
    common = collections.Counter((a, b) for l in where.values() for k, b in enumerate(l) for a in l[:k])
    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def test_bands():
    bands, rows = jaccard_join.choose_bands(0.8, 0.999)
    assert bands * rows <= jaccard_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.999
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 90, dtype=np.uint64)
        a, b = base, np.r_[base[:80], rng.integers(0, 2**63, 10, dtype=np.uint64)]
        s = jaccard_join.signatures(np.r_[a, b], np.array([0, 90, 180]), bands, rows)
        found += bool((s[0] == s[1]).any())
    assert found >= 297


def test_classes(docs, texts):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(docs).collect()}
    assert got == classes(texts)


@pytest.mark.parametrize("block", [256, 4])
def test_groups_of_near_copies(spark, block):
    """Large groups across blocks: copies, near copies, and links through a third text."""
    rng = random.Random(11)
    texts, n = {}, 0
    for g in range(4):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
            for _ in range(rng.randrange(1, 3)):
                texts[n] = " ".join(w)
                n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.join(df, block=block).collect()}
    assert got == classes(texts)


def test_jaccard_edges(spark):
    df = odd(spark)
    got = jaccard_join.join(df).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got}
    assert by[1] == (1, 0) and by[2] == (2, 0) and by[3] == (3, 0) and by[4] == (4, 0)
    assert by[5] == (5, 1) and by[6] == (5, 1) and by[None] == (None, 0)
    short = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a c")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in jaccard_join.join(short).collect()} == {1: 1, 2: 1, 3: 3}
    assert jaccard_join.join(short.limit(0)).count() == 0


# --- 5: language model --------------------------------------------------------------------


def test_scores(docs, texts):
    import math

    got = {r["doc_id"]: r for r in brown_lm.held_out_score(docs).collect()}
    tokens = {i: WORDS.findall(t.translate(LOWER)) + ["\n"] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and r["perplexity"] > 1
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_by_brute_force(spark, docs, texts, monkeypatch, lexicon=1500):
    """Each score from the classes of the words, with transitions and emissions counted one token at a time."""
    import math

    import pyarrow as pa

    from quillon.llm.common import Scratch, remainder

    monkeypatch.setattr(brown_lm, "LEXICON", lexicon)
    got = {r["doc_id"]: r for r in brown_lm.held_out_score(docs).collect()}
    model, classed, _ = brown_lm.train(docs.where(remainder(F.col("doc_id"), 10) != 0).select("text"), Scratch(spark, "t"))
    rows = classed.collect()
    own, count = {r["word"]: r["cls"] for r in rows}, {r["word"]: r["n"] for r in rows}
    inside, kinds = collections.Counter(), collections.Counter()
    for r in rows:
        inside[r["cls"]] += r["n"]
        kinds[r["cls"]] += 1
    tokens, unknown = {}, {}
    for i, t in texts.items():
        _, h, unit, _ = next(brown_lm.token_chunks(pa.array([t])))
        tokens[i] = h.view(np.int64).tolist()
        unknown.update((w, int(model.cls[u])) for w, u in zip(tokens[i], unit.tolist(), strict=True) if w not in own)
    pair = collections.Counter()
    for i, h in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            pair.update(zip([0] + [own[w] for w in h[:-1]], [own[w] for w in h], strict=True))
    after = collections.Counter()
    for (a, _), n in pair.items():
        after[a] += n
    prior = {c: (inside[c] + 1) / sum(inside[x] + 1 for x in range(brown_lm.CLASSES)) for c in range(brown_lm.CLASSES)}
    for i, h in tokens.items():
        total, last = 0.0, 0
        for w in h:
            c = own.get(w, unknown.get(w))
            total += math.log10((pair[last, c] + brown_lm.PRIOR * prior[c]) / (after[last] + brown_lm.PRIOR))
            total += math.log10((count.get(w, 0) + brown_lm.ALPHA) / (inside[c] + brown_lm.ALPHA * (kinds[c] + 1)))
            last = c
        assert math.isclose(got[i]["score"], total, rel_tol=1e-9), i


def test_rare_words_are_joined(docs, monkeypatch):
    """With a small lexicon most counts come by the join; the scores stay."""
    whole = {r["doc_id"]: (r["score"], r["n_known"]) for r in brown_lm.held_out_score(docs).collect()}
    monkeypatch.setattr(brown_lm, "LEXICON", 1500)
    for r in brown_lm.held_out_score(docs).collect():
        score, known = whole[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-6 and r["n_known"] == known


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    true = rng.integers(1, 4, 60)
    move = np.array([[0, 0, 0, 0], [0, 0.8, 0.1, 0.1], [0, 0.1, 0.1, 0.8], [0, 0.1, 0.8, 0.1]])
    pairs = np.zeros((61, 61))
    for a in range(60):
        for b in range(60):
            pairs[a, b] = rng.poisson(20 * move[true[a], true[b]])

    def fit(cls):
        k = cls.max() + 1
        grid = np.zeros((k, k))
        np.add.at(grid, (np.repeat(cls, 61), np.tile(cls, 61)), pairs.ravel())
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(grid) - f(grid.sum(1)) - f(grid.sum(0))

    cls = brown_lm.exchange(pairs, 60, classes=4)
    assert cls[60] == 0 and (cls[:60] > 0).all() and fit(cls) >= fit(np.r_[true, 0]) - 1


def test_each_word_moves_to_the_best_class():
    """The classes by which one word raises the likelihood most, against the likelihood itself."""
    rng = np.random.default_rng(6)
    pairs = rng.poisson(0.4, (40, 40)).astype(float)
    cls = rng.integers(1, 5, 40)
    cls[0] = 0

    def grid(cls):
        out = np.zeros((5, 5))
        np.add.at(out, (np.repeat(cls, 40), np.tile(cls, 40)), pairs.ravel())
        return out

    def fit(cls):
        f = lambda x: brown_lm.xlogx(x).sum()
        return f(grid(cls)) - f(grid(cls).sum(1)) - f(grid(cls).sum(0))

    alone = pairs - np.diag(np.diag(pairs))
    side = lambda x: np.array([[row[cls == c].sum() for c in range(5)] for row in x])[1:]
    got = brown_lm.best_classes(side(alone), side(alone.T), np.diag(pairs)[1:], cls[1:], grid(cls))
    for i, k in enumerate(got, 1):
        fits = [fit(np.r_[cls[:i], c, cls[i + 1 :]]) for c in range(1, 5)]
        assert np.isclose(max(fits), fits[k - 1])
    assert (got != cls[1:]).any()


@pytest.mark.parametrize("lexicon", [1 << 20, 20])
def test_rare_words_have_classes_of_their_own(spark, monkeypatch, lexicon):
    """Words of one spelling that stand in different places part, though no head; the class bigrams count each."""
    from quillon.llm.common import Scratch

    monkeypatch.setattr(brown_lm, "HEAD", 4)
    monkeypatch.setattr(brown_lm, "LEXICON", lexicon)
    rows = [(f"red n{k}ing blue v{k}ing red n{k + 1}ing",) for k in range(0, 30, 2)] * 3 + [("red blue red blue",)] * 20
    model, classed, _ = brown_lm.train(spark.createDataFrame(rows, "text string"), Scratch(spark, "t"))
    own = {r["word"]: r["cls"] for r in classed.collect()}
    pairs, seen = np.zeros((brown_lm.CLASSES,) * 2), collections.defaultdict(set)
    import pyarrow as pa

    for text, times in collections.Counter(t for (t,) in rows).items():
        h = next(brown_lm.token_chunks(pa.array([text])))[1]
        c = [own[x] for x in h.view(np.int64).tolist()]
        for a, b in zip([0, *c[:-1]], c, strict=True):
            pairs[a, b] += times
        for w, k in zip([*text.split(), "end"], c, strict=True):
            seen[w[0] if w.endswith("ing") else w].add(k)
    assert seen["n"].isdisjoint(seen["v"]) and seen["end"] == {0}
    n = pairs.sum(0)
    prior = (n + 1) / (n + 1).sum()
    assert np.allclose(10.0**model.transition, (pairs + brown_lm.PRIOR * prior) / (pairs.sum(1, keepdims=True) + brown_lm.PRIOR))


def test_the_model_sums_to_one(spark, docs):
    from quillon.llm.common import Scratch

    model, counted, _ = brown_lm.train(docs.select("text"), Scratch(spark, "t"))
    assert np.allclose((10.0**model.transition).sum(1), 1)
    cls = model.cls[model.units.of(model.lexicon, _units(counted, model.lexicon))]
    for c in np.unique(cls):
        words = (model.counts[cls == c] + brown_lm.ALPHA).sum() + brown_lm.ALPHA
        assert np.isclose(words, 10.0 ** model.emission[c])


def _units(counted, lexicon):
    rows = counted.toPandas()
    own = dict(zip(rows["word"].to_numpy().view(np.uint64).tolist(), rows["unit"].tolist(), strict=True))
    return np.array([own[w] for w in lexicon.tolist()])


def test_model_edges(spark):
    got = collections.defaultdict(list)
    for r in brown_lm.held_out_score(odd(spark)).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["n_tokens"] == got[2][0]["n_tokens"] == got[3][0]["n_tokens"] == 1 and len(got[6]) == 2 and got[5][0]["n_tokens"] == 60_001
    assert brown_lm.held_out_score(odd(spark).limit(0)).count() == 0
    untrained = brown_lm.score(odd(spark), F.lit(False)).collect()
    assert len(untrained) == 10 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untrained)


# --- 6 and 10: tokens ----------------------------------------------------------------------


def fuzz(seed, n=1500):
    rng = random.Random(seed)
    parts = list("  \n\t abAB'sté的日.!?,<|> 　\x1c\x85\xa0​0१²ßÀµªº") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "  ", " \n ", "'ll", "aaaa", "İ", "Σ", "é", "́", "...", "word,", " Word. "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)] + ["a" * 5000, "ab" * 3000, " " * 777, ""]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary(name))


def test_token_counts(docs, texts):
    name = "byte_bpe_50k.json"
    tok = library(name)
    for r in token_counts.count_tokens(docs, queries.vocabulary(name)).collect():
        n = len(tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 1024)
    some = fuzz(1)
    assert token_counts.Counter(token_counts.load(queries.vocabulary(name)))(some) == [len(e.ids) for e in tok.encode_batch(some, add_special_tokens=False)]


def test_token_edges(spark, monkeypatch):
    path = queries.vocabulary("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(odd(spark), path).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"]) == (0, 0, 0) and got[5]["over_limit"]
    assert token_counts.count_tokens(odd(spark).limit(0), path).count() == 0
    monkeypatch.setattr(token_counts, "REMEMBER", 3)
    assert token_counts.Counter(token_counts.load(path))(["a b c d e f", "a b"]) == [6, 2]


def test_packing(docs, texts):
    name = "word_bpe_49k.json"
    tok = library(name)
    pieces = collections.defaultdict(list)
    rows = packing.pack(docs, queries.vocabulary(name)).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids, at = tok.encode(t, add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids"] == own and r["doc_tokens"] == len(ids) and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and r["length"] == 1 << r["bucket"] <= 4096
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    some = fuzz(2)
    assert packing.load(queries.vocabulary(name))(some) == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch(some, add_special_tokens=False)]


def test_cuts():
    for n in range(70):
        c = packing.cuts(n, 16)
        assert sum(c) == n and c == sorted(c, reverse=True) and all(x & (x - 1) == 0 for x in c)
    with pytest.raises(AssertionError):
        packing.cuts(5, 12)


def test_packing_edges(spark):
    got = packing.pack(odd(spark), queries.vocabulary("word_bpe_49k.json"), with_ids=False).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [(r["length"], r["doc_tokens"]) for r in by[1]] == [(1, 1)] == [(r["length"], r["doc_tokens"]) for r in by[2]]
    assert sum(r["length"] for r in by[6]) == 2 * by[6][0]["doc_tokens"] and got[0]["ids"] is None
    assert packing.pack(odd(spark).limit(0), queries.vocabulary("word_bpe_49k.json")).count() == 0


# --- 7: benchmark passages --------------------------------------------------------------------

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(texts, items, width=13):
    windows = collections.defaultdict(set)
    for i, x in items:
        w = ITEM.findall((x or "").translate(LOWER))
        k = min(width, len(w))
        for s in range(len(w) - k + 1) if w else ():
            windows[tuple(w[s : s + k])].add(i)
    sizes, out = {len(w) for w in windows}, []
    for i, t in texts:
        w, hit, found = ITEM.findall((t or "").translate(LOWER)), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    found |= ids
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def tuples(df):
    return sorted(tuple(r)[:6] for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_random_passages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "The", "and"]) if rng.random() < 0.7 else f"x{rng.randrange(30)}é"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(25)] + [(25, ""), (26, None), (27, "..."), (3, "the of"), (28, None)]
    texts = []
    for k in range(60):
        w = [word() for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            src = ITEM.findall(rng.choice(items)[1] or "")
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[rng.randrange(3) :]
        texts.append((k, rng.choice([" ", ", ", "\n"]).join(w)))
    texts += [(100, None), (101, ""), (7, "another text of one id: " + (items[5][1] or ""))]
    d, b = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_words", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    assert tuples(decontamination.report(d, b)) == sorted(contamination(texts, items))


def test_passage_edges(spark):
    b = spark.createDataFrame([(1, "x" * 5)], "item_id long, text string")
    want = {r["doc_id"]: r["n_words"] for r in decontamination.report(odd(spark), b).collect()}
    assert want[1] == want[2] == want[3] == 0 and want[5] == 60_000 and decontamination.report(odd(spark), b).count() == 10
    assert decontamination.report(odd(spark).limit(0), b).count() == 0
    assert {r["n_hit"] for r in decontamination.report(odd(spark), b.limit(0)).collect()} == {0}


def test_passages_without_an_id(spark):
    item, clean = "one two three four five", "nothing of the kind is here"
    texts = [(None, f"see {item}"), (None, clean), (0, clean), (0, f"see {item}"), (1, item)]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [tuple(r)[:6] for r in decontamination.report(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=key) == sorted(contamination(texts, [(9, item)]), key=key)


def searched(spark, path, d, b, width=13, slop=0):
    """(doc_id, item_id, start, size) from a stored index of all terms."""
    from quillon.llm.common import Scratch

    scratch = Scratch(spark, "t")
    decontamination.build_index(d, path, keep=("doc_id",))
    index, wanted = decontamination.open_index(spark, path), decontamination.windows(b, scratch, width=width)
    hits = decontamination.search(index, wanted, scratch, slop).join(wanted.items, "window").join(index.documents, "n")
    return sorted(tuple(r) for r in hits.select("doc_id", "item_id", "start", "size").collect())


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity(spark, tmp_path, slop):
    """Places of windows, exact or near, against a search of every place."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(40))) for i in range(12)] + [(20, "a quick very brown fox"), (21, "quick brown fox"), (22, "fox brown quick")]
    items = [(1, "quick brown fox"), (2, "a b c"), (3, "d a d"), (4, "g f e d c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = searched(spark, str(tmp_path / "i"), d, b, 4, slop)
    often = collections.Counter(w for _, t in docs for w in t.split())
    ids = lambda k: {r[0] for r in got if r[1] == k}
    assert ids(1) == ({21}, {20, 21}, {20, 21, 22})[slop]
    if not slop:
        want = [(i, k, s, len(v)) for i, t in docs for k, x in items for v in {tuple(x.split()[o : o + 4]) for o in range(max(1, len(x.split()) - 3))} for s in range(len(t.split())) if tuple(t.split()[s : s + len(v)]) == v]
        assert got == sorted(want)
        return
    for i, k, s, size in got:  # every term near its place, and the rarest there
        w = dict(docs)[i].split()
        x = dict(items)[k].split()
        fits = [v for o in range(max(1, len(x) - 3)) if len(v := x[o : o + 4]) == size and all(any(w[p : p + 1] == [y] for p in range(max(0, s + j - slop), s + j + slop + 1)) for j, y in enumerate(v))]
        assert fits and any(w[s + j : s + j + 1] == [y] for v in fits for j, y in enumerate(v) if often[y] == min(often[z] for z in v))


def test_long_documents_and_no_broadcast(spark, monkeypatch):
    """Without a broadcast a long document's words are shuffled a few numbers each, never with its text."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(10_000))) for i in range(3)]
    items = [(9, " ".join(texts[1][1].split()[700:740])), (8, " ".join(f"w{k}" for k in range(20)))]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    df = decontamination.report(d, b)
    assert tuples(df) == sorted(contamination(texts, items))
    # What is joined by term has numbers alone.
    from quillon.llm.common import Scratch

    wanted = decontamination.windows(b, Scratch(spark, "t"))
    assert [t for _, t in wanted.terms.dtypes] == ["bigint", "int", "int", "bigint"]


# --- 8: shards ---------------------------------------------------------------------------------


def test_compaction(spark, tmp_path):
    t = compaction.Table(spark, f"file://{tmp_path}/t")
    rows = spark.range(4000).select("id", F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(8)]).alias("text")).repartition(4)
    assert t.versions() == [] and t.compact() is None
    assert t.append(rows.where("id % 2 = 0"), 100) == 1 and t.append(rows.where("id % 2 = 1"), 100) == 2
    assert t.append(rows.limit(0)) == 2
    files = t.manifest().count()
    target = t.manifest().agg(F.sum("bytes")).first()[0] // 3
    assert t.compact(target) == 3
    assert t.manifest().count() < files / 4 and t.manifest().agg(F.sum("rows")).first()[0] == 4000
    for v, n in ((1, 2000), (2, 4000), (3, 4000)):
        assert t.read(v).count() == n
    assert t.read().exceptAll(rows).isEmpty() and rows.exceptAll(t.read()).isEmpty()
    assert all(r["bytes"] < 2 * target for r in t.manifest().collect())
    with pytest.raises(compaction.CommitConflict):
        t.commit(t.manifest(), 2)
    assert t.read(2).count() == 4000, "a lost commit changes nothing"
    with pytest.raises(ValueError):
        t.append(rows.withColumn("more", F.lit(1)))
    assert t.vacuum() == files and t.versions() == [3] and t.read().count() == 4000
    assert t.vacuum() == 0


def test_compaction_edges(spark, tmp_path):
    t = compaction.Table(spark, f"file://{tmp_path}/t")
    for _ in range(5):
        t.append(odd(spark), 3)
    t.compact()
    assert t.read(shard="s").count() == 50 and t.read().where("text is null").count() == 5
    with pytest.raises(ValueError):
        compaction.Table(spark, f"file://{tmp_path}/none").read()


def test_files_of_a_lost_writer_go(spark, tmp_path):
    t = compaction.Table(spark, f"file://{tmp_path}/t")
    t.append(spark.range(10))
    spark.range(5).write.parquet(f"{t.path}/data/lost")
    assert t.sweep() == 0 and t.sweep(0) == 1 and t.read().count() == 10 and t.sweep(0) == 0


# --- 9: rules -----------------------------------------------------------------------------------


def figures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    rep = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_figures(spark, docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.judge(docs).collect():
        f = figures(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == f
        assert r["base_failed"] == (f[0] < 20 or 100 * f[4] > 30 * f[0]) and (not r["base_failed"] or not r["kept"])
    some = ["a b c d e f g h " * 3, "x " * 9, "x " * 8, "x " * 7, "a\n\na\n \n b\nb", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 0 2 3 4 5 6 7 8 9 1"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    assert [tuple(r[n] for n in names) for r in quality_rules.judge(df).orderBy("doc_id").collect()] == [figures(t) for t in some]


def test_rule_edges(spark):
    df = odd(spark)
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert not got[1]["kept"] and got[1]["n_words"] == 0 and got[5]["n_words"] == 60_000 and got[7]["word_chars"] == 30_000
    assert quality_rules.judge(df).count() == 10 and quality_rules.judge(df.limit(0)).count() == 0
    own = (quality_rules.Rule("few_words", "n_words", low=1, per=1),)
    assert quality_rules.judge(df, rules=own).where("kept").count() == 7


def test_stop_words_are_asked_of_listed_languages(spark):
    text = "Быстрая лиса прыгает через ленивую собаку и бежит дальше по лесу к реке где живут бобры строят плотины каждый день летом"
    rows = [(1, text, "ru"), (2, text, None), (3, text, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["failed"] for r in quality_rules.judge(df).collect()} == {1: [], 2: [], 3: ["stop_words"]}
    assert quality_rules.judge(df.drop("lang")).where("kept").count() == 3


def test_rules_keep_good_documents(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("n_words >= 20").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.95 and kept[0] < 0.1


def test_scratch_is_cleared(spark):
    from quillon.llm.common import Scratch, clear_scratch

    t = Scratch(spark, "x").put(spark.range(3), "t")
    assert t.count() == 3
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        t.count()


def test_native_plans_have_no_python(spark, sf_dir):
    for name in ("op3_tool_calls", "op7_decontamination", "op8_compaction", "op9_quality_rules"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
