"""Every operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipe
from panelweft.llm import bpe, fmindex, html, language, neardup, queries, substrings, topk, toxicity, unigram, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, tag string, spans int, rest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"{r.choice(['ka', 'lo', 'mé', 'ñu', 'ri'])}{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    base = words_of(1, 200)
    near = base.copy()
    near[100] = "other"
    texts = {
        1: " ".join(base), 2: " ".join(base), 3: " ".join(near), 4: "  ".join(base[:90]) + "\n\t" + " ".join(words_of(2, 60)), 5: None, 6: "", 7: " \n\t ", 8: "one two three", 9: "one two three",
        10: " ".join(words_of(3, 12)), 11: " ".join(words_of(3, 13)), 12: " ".join([*words_of(4, 40), *words_of(3, 13), *words_of(5, 40)]), 13: " ".join(words_of(6, 30000, 9000)), 14: " ".join(["same"] * 500), 15: " ".join(["same"] * 40),
        16: "Ünï 日本語 😀   x" * 20, 17: " ".join([*base[:150], *words_of(7, 10)]),
    }
    rows = [(i, t, "en" if i % 2 else None, "s", None, "clash", "clash", 1, "clash") for i, t in texts.items()]
    return [*rows, rows[0], rows[11], (None, texts[1], "en", "s", 1, "", "", 0, ""), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return WORD.findall(t or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_substrings(docs, empty):
    text = [(r[0], split(r[1])) for r in corpus()]
    least = {}
    for i, w in text:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                least[g] = min(i, least.get(g, i))
    want = []
    for i, w in text:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    assert rows(substrings.dedup(docs)) == sorted(want, key=repr)
    assert rows(substrings.dedup(empty)) == []


def test_refused_paths_stay(spark, monkeypatch):
    """With all edge hashes equal, nothing but true repeats goes."""
    monkeypatch.setattr(substrings, "windows", lambda h, k: np.full(max(len(h) - k + 1, 0), 7, np.uint64))
    t = spark.createDataFrame([(1, " ".join(words_of(1, 20))), (2, " ".join(words_of(2, 20)))], "doc_id long, text string").coalesce(1)
    edges = substrings.edges(t.withColumn("tag", F.lit(0)), 13, 4).where("settled").count()
    assert edges  # within one process the patch holds
    got = substrings.dedup(t)
    assert [r["n_removed"] for r in got.orderBy("doc_id").collect()] == [0, 0]


def brute_links(text):
    first = {}
    for i, w in text:
        if i is not None:
            first[tuple(w)] = min(i, first.get(tuple(w), i))
    sets = {i: {w[k : k + 5] for k in range(max(len(w) - 4, 1))} if w else set() for w, i in first.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    n, up = collections.Counter(), {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        n[a] += 1
        n[b] += 1
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(i, *((c := first[tuple(w)]), n[c], root(c))) if i is not None else (None, None, None, None) for i, w in text]


def test_neardup(docs, empty):
    want = brute_links([(r[0], split(r[1])) for r in corpus()])
    assert rows(neardup.join(docs)) == sorted(want, key=repr)
    assert rows(neardup.join(empty)) == []


def test_neardup_recall():
    """The chance that all runs miss a pair at the threshold, drawn over the tokens that all of them share."""
    share = np.random.default_rng(1).binomial(neardup.T, neardup.THRESHOLD, 400_000) / neardup.T
    survival = 1 - (1 - share) * (1 - neardup.SECOND + neardup.SECOND * (1 - share))
    assert np.mean((1 - survival**neardup.DEPTH) ** neardup.RUNS) < 1 - neardup.RECALL


def test_neardup_large_groups(spark, monkeypatch):
    """More near copies than a bucket or a block holds, and chains of them: no link is lost."""
    monkeypatch.setattr(neardup, "LIMIT", 8)
    monkeypatch.setattr(neardup, "SPLIT", 16)
    base, r, text = words_of(8, 120), random.Random(4), []
    for i in range(70):
        w = base.copy()
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"new{i}"
        text.append((i, w))
    for i in range(30):
        base[4 * i] = f"drift{i}"
        text.append((100 + i, base.copy()))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in text], "doc_id long, text string").repartition(4)
    assert rows(neardup.join(df)) == sorted(brute_links(text), key=repr)


PAGES = {
    "<html><head><title>T</title><script>if (a < b) { x('<p>no</p>') }</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class='ad'>Buy this now</div><article><h1>Head  &amp;\n line</h1><p><b>Bold. <br>A first paragraph.<p>A second one.</p></article><footer>&copy; x</footer>": "Head & line Bold. A first paragraph. A second one.",
    "<header><h1>Site</h1></header><div id=cookie-notice>We use cookies, please accept them all.</div><div class=content><h2>Title</h2><p>A long paragraph with quite a few words, so that it counts as text.</p><div class='sponsored ad'>An advert with many words that has to go away now.</div><p>Another long paragraph with quite a few words.</p></div><div class=sidebar><p>Side text that is long enough to be taken for an article.</p></div><form><p>Name <input></p></form><section id=comments><p>Reader: I don't agree with what is said in the text.</p></section>": "Title A long paragraph with quite a few words, so that it counts as text. Another long paragraph with quite a few words.",
    "<div class='layout has-sidebar'><article><header><h1>Title</h1></header><p>Text of it.</p></article><section id='comments'><article><p>I think so too.</p></article><article class='comment'>Me too.</article></section></div><article class='comment-1'>And me.</article>": "Title Text of it.",
    "<nav><ul><li>Never closed<article><p>Text.</p></article><aside>Side</aside>": "Text.", "<main><table><tr><td>a<td>b</table><p hidden>no<p>c</main>": "a b c",
    "plain text only": "plain text only", "": "", "<p>a <b>b</b>c</p><script>x": "a bc", "<!-- only a comment": "", "<article><p>x": "x", "<<<>>>&&&;<p": "<<<>>>&&&;<p",
}


def test_html(spark, empty):
    for page, text in PAGES.items():
        assert html.main_text(page) == text
    data = [(i, f"u{i}", p) for i, p in enumerate([*PAGES, None, "<article>" + "<p>long text</p>" * 20000])]
    got = html.extract(spark.createDataFrame([*data, data[0]], "page_id long, url string, html string")).collect()
    assert len(got) == len(data) + 1 and {(r["page_id"], r["text"]) for r in got} == {(i, html.main_text(p)) for i, _, p in data}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


OPEN_ENDED = {
    "<article><p class='ad'>Buy<p>Real text</p><p>More</p></article>": "Real text More", "<main><p>a<p hidden>no<p>c</main>": "a c", "<article><p class=ad>Buy<div>b</div>c</article>": "b c",
    "<article><ul><li>a<li class=share>no<ul><li>no</ul>no<li>b</ul>c</article>": "a b c", "<article><dl><dt class=ad>no<dd>a<dt hidden>no</dl>b</article>": "a b",
    "<article><ul><li class=share>no<section><li>no</section>no<p>no</ul>a</article>": "a", "<article><ul><li class=promo><p>no</li><li>a</ul></article>": "a",
    "<article><table><tr><td>a<td class=promo>no<table><tr><td>no</table>no<td>b<tr hidden><td>no<tr><td>c<th class=ad>no</table>d</article>": "a b c d",
    "<article><table><caption class=ad>no<tbody hidden><tr><td>no<tbody><tr><td>a</table></article>": "a", "<article><div><p class=ad>no</div>a</p>b</article>": "a b",
    "<article><p class=ad>no<b>no</b><br>no<img src=x>no</p>a</article>": "a", "<article><div class=ad>no<p>no</div>a</article>": "a", "<main><p class=ad>no<hr>a</main>": "a",
}


def test_html_end_tags_left_out():
    """A dropped part whose end tag is left out ends where HTML ends it."""
    for page, text in OPEN_ENDED.items():
        assert html.main_text(page) == text


CUT = {
    "<article><p>x</p></article><a " + 'b="c" ' * 1000: "x", "<article><p>x" + "<a b='" * 20000: "x", "<article><p>x</p><p class=\"y>z": "x", "<article>a<b c=d": "a", "<article><p>x</p>" + "<![CDATA[" * 20000: "x " + "<![CDATA[" * 19999,
    "<article>" + "<div>a" * 50000: " ".join("a" * 50000), "<article>" + "<p><table>" + "<div>" * 50000 + "a": "a", "<article><table>" + "<div>" * 25000 + "<td>a" * 25000: " ".join("a" * 25000), "<title>" * 50000 + "<article>a": "a",
    "<article>" + "<li><div>a" * 20000: " ".join("a" * 20000), "<article>" + "<span class=ad>a" * 20000: "a" * 20000, "</p>" * 50000 + "<article>a<p title=a>b": "a b", '<article><a title="it\'s > that">a</a> <i x="">b</i>': "a b",
}


def test_html_cut_and_unclosed():
    """Pages that end inside a tag and elements that are never closed cost no more than their length."""
    for page, text in CUT.items():
        began = time.monotonic()
        assert html.main_text(page) == text, page[:80]
        assert time.monotonic() - began < 2, page[:80]


ABOUT = "Body of it."


def test_html_names_inside_an_article():
    """Inside an article only names that say nothing else drop a part; headings and sections aren't judged by what they are about."""
    keeps = ["<section id='related-work'><h2>Related work</h2><p>{}</p></section>", "<h2 id='side-effects'>Side effects</h2>{}", "<h2 id=search class=nav-title>Search</h2>{}", "<div class='legal-text'>{}</div>", "<p class='social-theory'>{}</p>", "<div id='menu-of-the-day'>{}</div>"]
    for k in keeps:
        assert html.main_text(f"<article><p>a</p>{k.format(ABOUT)}</article>").endswith(ABOUT), k
    for k in ["ad", "share-buttons", "adBox", "related_posts", "newsletter-signup", "comments", "notice", "social share-links", "sidebar-left", "ad-300"]:
        assert html.main_text(f"<article><p>a</p><div class='{k}'>{ABOUT}</div></article>") == "a", k


def made_page(r, landmark):
    """A random page and its main text, known as it is put together."""
    words = lambda n: [r.choice(["alpha", "beta", "naïve", "10", "日本", "x-ray", "it's", "R&D", "a<b", "“q”"]) for _ in range(n)]
    code = lambda w: w.replace("&", "&amp;").replace("<", "&lt;").replace("“", "&ldquo;").replace("”", "&#8221;").replace("ï", r.choice(["ï", "&iuml;", "&#xEF;"]))

    def inline(n):
        plain_, marked = words(n), []
        for w in plain_:
            tag = r.choice(["", "", "", "b", "em", "span class='hl'", "a href='/x?a=1&b=>'", "code"])
            marked.append(f"<{tag}>{code(w)}</{tag.split()[0]}>" if tag else code(w))
        return r.choice([" ", "\n", "  ", " \t"]).join(marked), " ".join(plain_)

    def dropped():
        t, _ = inline(r.randrange(1, 12))
        kinds = ["div class=ad", "div class='share-buttons'", "aside", "nav", "form", "div class='newsletter-signup'", "ul class=breadcrumbs", "div id=comments", "p hidden", "div style='display: none'", "footer"]
        k = r.choice(kinds if landmark else kinds[:2] + kinds[5:6])  # elsewhere only what stands in the middle of a text
        inner = {"ul": f"<li>{t}</li>", "div": r.choice([t, f"<p>{t}</p>", f"<div>{t}</div><div>{t}</div>"])}.get(k.split()[0], t)
        return r.choice([f"<{k}>{inner}</{k.split()[0]}>", f"<script>if (1 < 2) {{ s = '</p>{words(1)[0]}' }}</script>", "<style>p > a { x: y }</style>", f"<!-- {t} -->", f"<noscript>{t}</noscript>", "<button>Go</button>", "<svg><text>no</text></svg>"])

    def block(depth, least):
        n = r.randrange(least, least + 30)
        kind = r.choice(["p", "p", "p", "h2", "ul", "table", "section", "blockquote", "pre", "br"]) if depth < 3 else "p"
        if kind == "section":
            parts = [block(depth + 1, least) for _ in range(r.randrange(1, 4))]
            return f"<section id='{r.choice(['related-work', 'side-effects', 'search' if landmark else 'searching', 'part'])}'>" + "".join(h for h, _ in parts) + "</section>", [t for _, ts in parts for t in ts]
        if kind in ("ul", "table"):
            items = [inline(r.randrange(least, least + 6)) for _ in range(r.randrange(1, 4))]
            shut = r.random() < 0.5  # end tags may be left out
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{h}" + ("</li>" if shut else "") for h, _ in items) + "</ul>", [t for _, t in items]
            return "<table><tr>" + "".join(f"<td>{h}" + ("</td>" if shut else "") for h, _ in items) + "</tr></table>", [t for _, t in items]
        h, t = inline(n)
        if kind == "br":
            h2, t2 = inline(n)
            return f"<p>{h}<br/>{h2}</p>", [t + " " + t2]
        return f"<{kind}>{h}</{kind}>", [t]

    html_, text = [], []
    for _ in range(r.randrange(2, 9)):
        if r.random() < 0.4 and (landmark or text):
            html_.append(dropped())
        h, ts = block(0, 1 if landmark else 25)
        html_.append(h)
        text += ts
    body = "".join(html_)
    around = ["<header><h1>Site</h1><a href=/>Home</a></header>", "<nav><ul><li><a href=/a>A</a></li></ul></nav>", "<div class='cookie-consent'><p>We use cookies.</p></div>"]
    inner = f"<{landmark}>{body}</{landmark}>" if landmark else f"<div class=content>{body}</div>"
    page = "<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>" + "".join(r.sample(around, r.randrange(3))) + inner + r.choice(["<footer>© 1</footer>", "<div class=sidebar><p>More</p></div>", ""]) + "</body></html>"
    return page, " ".join(text)


@pytest.mark.parametrize("landmark", ["article", "main", ""])
def test_html_pages_put_together(landmark):
    r = random.Random(f"pages {landmark}")
    for k in range(300):
        page, text = made_page(r, landmark)
        assert html.main_text(page) == text, (k, page)


LONG = "A paragraph of the article that has a good many words, so that it holds most of what the page says. " * 8
SHORT = "A closing section of the text that is rather short, but not so short as a line."
LINKED = {
    "<article><p>Text.</p><p>See <a href=x>the whole of the report</a></p><ul><li><a href=y>Source</a></ul></article>": "Text. See the whole of the report Source",
    "<main><p><a href=x>Only a link</a></p></main><p>Outside.</p>": "Only a link",
    f"<div><div><h2>Head</h2><p>Sub</p><aside>no</aside><p>{LONG}</p><form>no</form><p>{SHORT}</p><aside>no</aside><p>End.</p></div></div>": f"Head Sub {LONG.strip()} {SHORT} End.",
    f"<div><section><p>{LONG}</p></section><aside>no</aside><section><p>{SHORT}</p></section></div>": f"{LONG.strip()} {SHORT}",
    f"<div><div><p>{LONG}</p></div><aside>no</aside><div><p>{SHORT}</p></div><aside>no</aside><div><p>{LONG}</p></div></div>": f"{LONG.strip()} {SHORT} {LONG.strip()}",
    f"<body><div><p>Site</p></div><aside>no</aside><div><p>{LONG}</p><p><a href=x>More</a></p></div><aside>no</aside><div><p>{SHORT}</p></div>": LONG.strip(),
}


def test_html_links_and_short_parts():
    """Links of an article stay, and short parts of a page without one between or beside its long ones."""
    for page, text in LINKED.items():
        assert html.main_text(page) == text


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    bad = ["stupid", "idiot", "moron", "loser", "scum"]
    text = []
    for i in range(400):
        w = words_of(1000 + i, r.randrange(10, 80))
        if i % 4 == 0:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        text.append((i, " ".join(w)))
    df = spark.createDataFrame(text, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 1), (1, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = dict(rows(toxicity.score(df, model)))
    held = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]
    assert np.mean(held) > 0.95
    assert model.scores(pa.array(["stuppid idiotts moronic"]))[0] > model.scores(pa.array([" ".join(words_of(5, 40))]))[0]
    got = toxicity.score(docs, model, rest=["score", "tag"]).collect()
    assert len(got) == len(corpus()) and all(0 <= r["score"] <= 1 for r in got) and {r["rest"]["score"] for r in got} == {"clash", "", None}
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r["score"] < 1e-6 for r in toxicity.score(docs, none).collect()} == {True}


def test_toxicity_scores_by_definition():
    """A score is the softmax of the mean weight of all subwords of all words, one word at a time."""
    weight = np.random.default_rng(6).normal(0, 2, toxicity.BUCKETS)
    model = toxicity.Model(weight, 0.3)
    texts = [r[1] for r in corpus()] + ["Ünï-CODE 日本語 😀 a I 1st", "same same same SAME", "x"]
    for text, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        total, count = 0.0, 0
        for word, times in collections.Counter(plain(text)).items():
            ids, first = toxicity.subwords(toxicity.Words(pa.array([word]), toxicity.NOT_WORD, lower=True))
            assert len(ids) == first[-1] == 1 + sum(max(len(word) + 3 - k, 0) for k in toxicity.GRAMS)
            total, count = total + times * float(weight[ids].astype(np.float32).sum(dtype=float)), count + times * len(ids)
        assert got == pytest.approx(1 / (1 + np.exp(-(total / max(count, 1) + 0.3))), abs=1e-6)


def reference_bits(samples, text):
    """Code length by prediction by partial matching with exclusion, from its definition."""
    fold = lambda b: bytes(language.FOLD[np.frombuffer(b, np.uint8)]) if b else b""
    seen = collections.defaultdict(collections.Counter)
    for s in samples:
        s = b" " * language.ORDER + fold(s)
        for i in range(language.ORDER, len(s)):
            for k in range(language.ORDER + 1):
                seen[k, s[i - k : i]][s[i]] += 1
    t, out = b" " * language.ORDER + fold(text), 0.0
    for i in range(language.ORDER, len(t)):
        gone = set()
        for k in range(language.ORDER, -1, -1):
            c = seen.get((k, t[i - k : i]))
            if c is None:
                continue
            left = {s: n for s, n in c.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if t[i] in left:
                out -= np.log2(left[t[i]] / whole)
                break
            if left:
                out -= np.log2(len(left) / whole)
            gone |= set(left)
        else:
            out += np.log2(256 - len(gone))
    return out


def test_language(spark, docs, empty):
    samples = {"aa": [b"The cat sat on the mat, and the dog ran. ", b"A cat and a dog. "], "bb": ["Der Hund läuft über die Straße. ".encode(), b"Die Katze und der Hund."]}
    trees = {}
    for k, v in samples.items():
        g = np.concatenate([language.grams(pa.array([s.decode()]))[0] for s in v])
        value, n = np.unique(g, return_counts=True)
        trees[k] = language.Tree(value, n.astype(float))
    model = language.Model(trees)
    texts = ["The dog ran on the mat", "Die Straße über x", "zzz\n\x01", "", "ü"]
    got = model.lengths(pa.array(texts))
    for t, row in zip(texts, got):
        np.testing.assert_allclose(row, [reference_bits(samples[k], t.encode()) for k in model.names], rtol=1e-5, atol=1e-6)
    rows_ = spark.createDataFrame([(i, s.decode(), k) for i, (k, s) in enumerate((k, s) for k in samples for s in samples[k])] + [(9, None, "aa"), (10, "x", None)], "doc_id long, text string, lang string")
    fitted = language.train(rows_)
    assert fitted.names == ["aa", "bb"]
    np.testing.assert_allclose(fitted.lengths(pa.array(texts)), got, rtol=1e-6)
    pred = language.predict(docs, fitted).collect()
    assert len(pred) == len(corpus()) and all(0 <= r["score"] <= 1 for r in pred)
    assert {r["lang_pred"] for r in pred if r["doc_id"] in (5, 6, 7)} == {"und"}
    assert language.predict(empty, fitted).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.train(rows_.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("least,size", [(0, 64 << 20), (5, 64 << 20), (0, 30_000)])
def test_warc(spark, monkeypatch, least, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)  # a small one means a file for each capture
    data = [(1, "http://a/x", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (2, "http://b", "same page"), (3, None, "same page"), (4, "u\r\nv", None), (5, "", ""), (0, "z", "same page"), (6, "w", "x" * 300000), (7, "q", "ab"), (8, "q", "ab"), (None, "n", "alone"), (None, "n", "same page")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages, least).collect()
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        f = first.get(h or "", i) if len(b) >= least else i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f, None if f != i else b.decode()))
    seen = []
    for r in got:
        fields, main = r["metadata"]["fields"], r["response"]
        assert r["request"]["http"].startswith("GET ")
        assert (main["refers_to"] is None) == (main["type"] == "response")
        seen.append((int(fields["page-id"]) if fields["page-id"] else None, main["payload_bytes"], main["payload_digest"], main["type"], int(fields["refers-to-page"]) if "refers-to-page" in fields else None, main["payload"]))
    assert sorted(seen, key=repr) == sorted(want, key=repr)


def test_warc_repeated_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    assert sorted((r["metadata"]["fields"]["page-id"], r["response"]["type"]) for r in warc.round_trip(pages).collect()) == [("1", "response")] * 2 + [("2", "revisit")] * 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.BYTE_BPE)
    odd = ["a<|endoftext|>b <|endoftext|>", "aaaaaaaaaa" * 50, "  \n\n x\t\t ", "'s don't I'll  12345 ?!?!", "x y　 b", "\x1c a\x85 b", "x" * 3000]
    r = random.Random(3)
    odd += ["".join(r.choice(" \n\tab's12é,.　\x1f\u0085 ") for _ in range(30)) for _ in range(300)]
    own = bpe.Trie(queries.BYTE_BPE)
    ids = own.texts(odd)
    want = t.encode_batch(odd, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in want]
    assert own.decode(ids) == [t.decode(e.ids, skip_special_tokens=False) for e in want]
    want = []
    for r in corpus():
        e = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows(bpe.digests(docs, queries.BYTE_BPE)) == sorted(want, key=repr)
    assert {(r["doc_id"], r["decoded"]) for r in bpe.encode(docs, queries.BYTE_BPE).collect()} == {(r[0], r[1] or "") for r in corpus()}
    assert bpe.digests(empty, queries.BYTE_BPE).count() == 0


def test_unigram(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    m = unigram.model(queries.PIECES)
    lib = Tokenizer(models.Unigram([("<unk>", min(m.scores.values())), *m.scores.items()], unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(1)
    texts = [x[1] or "" for x in corpus()] + [" ", "  a  b", "a▁b"] + ["".join(r.choice(" ab\nteé😀x") for _ in range(20)) for _ in range(300)]
    want = [sum(1 if t in m.scores else len(t.encode()) for t in e.tokens) for e in lib.encode_batch(texts)]
    assert [n for n, _ in m.texts(texts)] == want
    toy = unigram.Model({"▁": -5.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁a": -4.5, "▁ab": -9.0})
    assert toy.texts(["ab", "ab ab", "", "c", "é"]) == [(2, 1), (4, 2), (0, 0), (2, 1), (3, 1)]
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.count(docs, queries.PIECES).collect() if r["doc_id"] is not None}
    assert got == {r[0]: n for r, n in zip(corpus(), want) if r[0] is not None}
    assert unigram.count(empty, queries.PIECES).count() == 0


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(t):
    return PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_fmindex(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(fmindex, "BLOCK", block)
    base = words_of(1, 200)
    items = [(1, " ".join(base[10:40]).upper().replace("É", "é").replace("Ñ", "ñ")), (2, "one, TWO three"), (3, None), (4, "..."), (5, " ".join(words_of(50, 30))), (6, "same " * 12), (7, " ".join(base[20:35])), (7, " ".join(base[20:35])), (10, "x"), (None, " ".join(base[150:175])), (None, "fünf 5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = plain(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            phrases[tuple(w[k : k + 10])] |= {str(i)} - {"None"}
    want = []
    for r in corpus():
        w = plain(r[1])
        hit, found = [0] * len(w), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    hit[k : k + n] = [1] * n
                    found |= phrases[tuple(w[k : k + n])]
        want.append((r[0], len(w), sum(hit), sorted(found)))
    found = fmindex.find_phrases(docs, bench)
    got = [(r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), r["items"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in fmindex.find_phrases(docs, bench, cut=True).collect():
        hits = next(x[2] for x in want if x[0] == r["doc_id"])
        assert len(plain(r["text"])) == r["n_words"] - hits or r["doc_id"] is None
    assert fmindex.find_phrases(empty, bench).count() == 0
    assert {len(r["items"]) for r in fmindex.find_phrases(docs, bench.limit(0)).collect()} == {0}


def test_suffixes_and_ranks():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], *[np.append(rng.integers(1, 4, rng.integers(0, 30)), 0) for _ in range(40)]])
    order = fmindex.suffixes(text)
    key = lambda i: [(0, i + k) if c == 0 else (1, c) for k, c in enumerate(text[i : i + 40])]
    ends = lambda i: key(i)[: next(k for k, c in enumerate(text[i:]) if c == 0) + 1]
    assert order.tolist() == sorted(range(len(text)), key=ends)
    w = fmindex.Wavelet(text, 4)
    at = rng.integers(0, len(text), 50)
    for c in range(4):
        assert w.rank(np.full(50, c), at).tolist() == [int((text[:i] == c).sum()) for i in at]
    value, before = w.value(at)
    assert value.tolist() == text[at].tolist() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in at]


@pytest.mark.parametrize("block", [2048, 16])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", 6)
    rng = np.random.default_rng(3)
    data = [(int(i), rng.normal(0, 0.2, 8).round(3).tolist()) for i in range(0, 900)]
    data += [(1000 + i, [0.125] * 8) for i in range(120)]  # copies, one of them asked for
    again = [data[50], (7, [0.9] * 8), (7, [0.05] * 8), (100, [0.3] * 8)]  # rows that share an id
    bad = [(2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [0.1] * 8), (2200, []), (2250, [0.5])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in [*data, *bad, *again]], "vec_id long, embedding array<double>, score string").repartition(3)
    known = [*data, (2200, []), (2250, [0.5]), *again]
    q = np.array([[*topk.whole(np.array(v)), *[0] * (8 - len(v))] for _, v in known])
    want = []
    for n, (i, _) in enumerate(known):
        if i % 50 == 0:
            best = sorted((-int(s), j) for m, (s, (j, _)) in enumerate(zip(q @ q[n], known)) if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert rows(topk.search(df)) == sorted(want, key=repr)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 1.0])], "vec_id long, embedding array<float>")
    assert rows(topk.search(few)) == [(0, 1, 50, 5 * 65536), (50, 1, 0, 5 * 65536)]
    assert topk.search(few.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage takes awkward rows, keeps clean documents and the columns of documents."""
    toxic = [(100 + i, " ".join([*words_of(300 + i, 20), "idiot", "moron"]), "en", "s", 1) for i in range(40)]
    clean = [(200 + i, " ".join(words_of(400 + i, 60)), "en", "s", 1) for i in range(160)]
    twice = [(500, " ".join(words_of(900, 60)), "en", "s", 1), (500, " ".join(words_of(901, 60)), "en", "s", 1), (500, corpus()[0][1], "en", "s", 1), (501, " ".join(words_of(901, 60)), "en", "s", 1)]
    docs = [r[:5] for r in corpus()] + toxic + clean + twice
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 1) for r in toxic] + [(r[0], 1, 0) for r in clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words_of(405, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(pipe.STAGES):
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        df = spark.read.parquet(f"{tmp_path}/stage{i}")
        assert df.columns == list(r.split(" ")[0] for r in schema.split(", ")) or i == len(pipe.STAGES) - 1
        if i == 1:  # rows that share a doc_id are documents of their own
            assert sorted(r["text"] for r in df.where("doc_id in (500, 501)").collect()) == sorted(x[1] for x in twice[:2])
        kept[name] = {r["doc_id"]: r["text"] if i < len(pipe.STAGES) - 1 else r["ids"] for r in df.collect()}
    steps = [kept[n] for n, _ in pipe.STAGES]
    assert not any(100 <= (i or 0) < 140 for i in steps[0]) and all(200 + i in steps[0] for i in range(40))
    assert {1, 4, 8, 13} <= set(steps[1]) and not {2, 3, 9} & set(steps[1]) and all(200 + i in steps[1] for i in range(40))
    assert steps[2][204] == clean[4][1] and steps[2][13] == " ".join(words_of(6, 30000, 9000)) and len(split(steps[2][4])) < 150 - 70
    assert steps[3][205].split() == words_of(405, 60)[30:] and steps[3][206] == clean[6][1]
    assert set(steps[4]) == set(steps[3])
    no = spark.createDataFrame([], schema)
    for _, stage in pipe.STAGES:
        assert stage(spark, no, str(tmp_path)).count() == 0


def kept_words(text, width=13):
    """Each text without the words of windows that a smaller doc_id has; None where nothing goes."""
    least = {}
    for i, w in text:
        for k in range(len(w) - width + 1):
            least[tuple(w[k : k + width])] = min(i, least.get(tuple(w[k : k + width]), i))
    out = {}
    for i, w in text:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else None
    return out


def without_phrases(text, phrases):
    """A text without the runs of words that phrases cover."""
    at = list(PLAIN.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
    words = [m.group() for m in at]
    hit = [False] * len(words)
    for n in {len(p) for p in phrases}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in phrases:
                hit[k : k + n] = [True] * n
    if not any(hit):
        return text
    out, last = [], 0
    for k, h in enumerate(hit):
        if h and (k == 0 or not hit[k - 1]):
            out += [text[last : at[k].start()], " "]
        if h:
            last = at[k].end()
    return "".join([*out, text[last:]]).strip(" \t\n\r\x0b\x0c")


def test_pipeline_by_definition(spark, tmp_path):
    """The whole pipeline against its stages written plainly, one after the other."""
    import tokenizers

    r = random.Random(44)
    base, shared, leak = words_of(700, 150), words_of(701, 40), words_of(702, 24)
    text = {}
    for i in range(1, 181):
        w = words_of(2000 + i, r.randrange(3, 120))
        if i % 9 == 0:
            w = base.copy()
            w[r.randrange(150)] = f"near{i}"
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = shared
        if i % 11 == 0:
            w[len(w) // 3 : len(w) // 3] = leak[: 8 + i % 16]
        if i % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "scum"]))
        if i % 13 == 0:
            w = text[i - 12].split()
        text[i] = (" " if i % 3 else "  \n").join(x.upper() if i % 17 == 0 else x for x in w)
    text[181], text[182], text[183] = None, "", "Ünï 日本語 😀."
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in text.items()], schema).repartition(5)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1, 150)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(leak)), (2, "unheard of words"), (3, None), (None, " ".join(words_of(2004, 40)[:12]))], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    ids = list(text)
    left = {i: text[i] for i, s in zip(ids, model.scores(pa.array([text[i] for i in ids], pa.string()))) if s < 0.5}
    groups = {i: g for i, _, _, g in brute_links([(i, split(t)) for i, t in left.items()])}
    left = {i: t for i, t in left.items() if groups[i] == i}
    cut = kept_words([(i, split(t)) for i, t in sorted(left.items())])
    repeats = sum(c is not None for c in cut.values())
    left = {i: t if cut[i] is None else cut[i] for i, t in left.items()}
    phrases = set()
    for t in [" ".join(leak), "unheard of words", " ".join(words_of(2004, 40)[:12])]:
        w = plain(t)
        phrases |= {tuple(w[k : k + 10]) for k in range(max(len(w) - 10, 0) + 1)}
    clean = {i: None if t is None else without_phrases(t, phrases) for i, t in left.items()}
    assert len(text) - 20 > len(left) > 80 and repeats > 5 and sum(clean[i] != left[i] for i in left) > 3
    coder = tokenizers.Tokenizer.from_file(queries.BYTE_BPE)
    coder.no_truncation()
    coder.no_padding()
    want = {}
    for i, t in clean.items():
        code = coder.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(code), np.array(code, "<u4").tobytes(), hashlib.sha256(coder.decode(code, skip_special_tokens=False).encode()).hexdigest())
    got = {x["doc_id"]: (x["n_tokens"], bytes(x["ids"]), x["decoded_sha256"]) for x in pipe.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i] == want[i], (i, clean[i])


@pytest.mark.parametrize("name", ["op1_substrings", "op2_jaccard", "op3_html", "op4_toxicity", "op5_language", "op6_warc", "op7_bpe", "op8_token_counts", "op9_decontamination", "op10_topk", "op11_divergence", "op12_simhash", "op13_lexical", "pipeline"])
def test_registered(spark, small, name):
    got = entry.queries()[name](spark, small)
    n = {"op3": "pages", "op6": "pages"}.get(name.split("_")[0], "documents")
    many = duckdb.sql(f"select count(*) from '{small}/{n}.parquet'").fetchall()[0][0]
    if name not in ("op10_topk", "op11_divergence", "op13_lexical", "pipeline"):
        assert got.count() == many
    else:
        assert got.count() == (50 if name == "op10_topk" else got.count())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").df()
    got = queries.op5_language(spark, sf).toPandas().merge(lang)
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.98
    labels = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").df()
    got = queries.op4_toxicity(spark, sf).toPandas().merge(labels)
    assert isinstance(got, pd.DataFrame) and (got.predicted == got.toxic)[got.held_out].mean() > 0.85
