"""Divergence audit, SimHash and lexical search against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from panelweft.llm import divergence, lexical, simhash

DOCS = "doc_id long, text string, lang string, source string, score string, item_id string, rank string, print string, key string, term string, n string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n, words=60):
    r = random.Random(seed)
    return " ".join(f"{r.choice(['Ka', 'lo', 'mé', 'ÑU', 'ri'])}{r.choice('abcdefghijkl')}{r.choice('mnopq')}" if r.random() < 0.9 else str(r.randrange(words)) for _ in range(n))


def corpus():
    base = prose(1, 300).split()
    texts = [prose(10 + i, 5 + 7 * i) for i in range(40)]
    texts += [None, "", " \n\t", "...!", "one", "Zwei Wörter", "日本 語 日本 語", prose(2, 20000), " ".join(base), " \t".join(base).lower(), "THE " * 500]
    for i in range(12):
        near = base.copy()
        near[20 * i + 3] = f"other{i}"
        texts.append(" ".join(near))
    rows = []
    for i, t in enumerate(texts):
        lang = ["en", "de", None, "en", "fr"][i % 5]
        rows.append((i + 1, t, lang, [f"s{i % 4}", "S", None][i % 3], *["clash"] * 7))
    rows.append((None, texts[0], "en", "only", *["x"] * 7))
    rows.append((None, "nobody else writes this here", "en", "only", *["x"] * 7))
    rows += [rows[3], (4, texts[20], "en", "s1", *["x"] * 7), (777, "xx yy", "xx", "lonely", *["x"] * 7), (778, None, None, None, *["x"] * 7)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def audited(table, least, top):
    """The audit by its definition, in fractions."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, df, of = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source, *_ in table:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(AZ))
        of[lang].add(source)
        count.update((lang, source, w) for w in words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang, sources in of.items():
        kept = [w for (g, w), d in df.items() if g == lang and d >= least]
        v = len(kept)

        def share(c, n):
            return 1 + math.floor(Fraction(10**9 * (c + 5), n + 5 * v))

        n = {s: sum(count[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: share(count[lang, s, w], n[s]) for w in kept} for s in sources}
        q = {w: share(sum(count[lang, s, w] for s in sources), sum(n.values())) for w in kept}
        for s in sources:
            pair = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            more = [(w, p[s][w] - q[w]) for w in kept if count[lang, s, w] and p[s][w] > q[w]]
            for part, items, limit in (("pair", pair, len(pair)), ("term", more, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(items[:limit], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,top", [(30, 50), (3, 4), (1, 1000), (1000, 5)])
def test_divergence(docs, least, top):
    assert rows(divergence.audit(docs, least=least, top=top)) == audited(corpus(), least, top)


def test_divergence_in_small_blocks_and_tiles(docs, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "TILE", 2)
    assert rows(divergence.audit(docs, least=2, top=9)) == audited(corpus(), 2, 9)


def test_divergence_adds_up_in_tasks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 400)
    table = [(t or "", a or "", b or "") for _, t, a, b, *_ in corpus()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*table)], names=["text", "lang", "source"])
    seen = collections.Counter()
    for b in divergence.count_terms(iter([batch.slice(0, 30), batch.slice(30)])):
        for r in b.to_pylist():
            seen[r["lang"], r["source"], r["term"], "n"] += r["n"]
            seen[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    want = collections.Counter()
    for t, a, b in table:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(AZ))
        want.update((a, b, w, "n") for w in words)
        want.update((a, b, w, "docs") for w in set(words))
        want[a, b, "", "n"] += 0
        want[a, b, "", "docs"] += 0
    assert seen == want


def test_divergence_empty(empty, spark):
    assert rows(divergence.audit(empty)) == []
    nulls = spark.createDataFrame([(None,) * 11] * 3, DOCS)
    assert rows(divergence.audit(nulls)) == []


def test_shares_of_large_counts():
    for c, n in ((9 * 10**14, 9 * 10**14 + 1), (1, 9 * 10**15 // 2), (5, 5), (123456789012345, 987654321098765)):
        assert divergence.share(np.array([c], np.int64), np.int64(n))[0] == 1 + 10**9 * c // n


def printed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    """The smallest place reachable from each by 3 or fewer differing bits."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(x) for x in up]


def test_simhash(docs, empty):
    table = corpus()
    prints = [printed(r[1]) for r in table]
    root = roots(prints)
    least = {}
    for r, k in zip(table, root):
        if r[0] is not None:
            least[k] = min(r[0], least.get(k, r[0]))
    want = [(r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(table, prints, root)]
    assert rows(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    assert len(set(root)) < len(set(prints))
    assert rows(simhash.near_duplicates(empty)) == []


@pytest.mark.parametrize("longest", [512, 8, 3])
def test_simhash_lists(spark, monkeypatch, longest):
    """Scattered prints, a dense group, and lists of prints that have bytes in common and no links, searched in parts."""
    monkeypatch.setattr(simhash, "LIST", longest)
    r = random.Random(5)
    centre = r.getrandbits(64)

    def shifted(x, most):
        for b in r.sample(range(64), r.randint(0, most)):
            x ^= 1 << b
        return x

    prints = [r.getrandbits(64) for _ in range(30)] + [shifted(centre, 3) for _ in range(60)] + [centre & 0xFFFFFFFF | r.getrandbits(32) << 32 for _ in range(40)]
    prints += [shifted(r.choice(prints), 4) for _ in range(60)]
    prints = sorted(set(prints))
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = dict(map(tuple, simhash.join_prints(spark.createDataFrame([(x,) for x in signed], "print long").repartition(4)).collect()))
    of = collections.defaultdict(set)
    for x, k in zip(signed, roots(prints)):
        of[k].add(x)
    got = collections.defaultdict(set)
    for x in signed:
        got[found.get(x, x)].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, of.values()))
    assert max(map(len, of.values())) > 60


def searched(table, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    words = [term.findall((r[1] or "").translate(AZ)) for r in table]
    docs, total = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(w for x in words for w in set(x))
    tf = [collections.Counter(x) for x in words]
    out = []
    for item, text in items:
        found = []
        for r, x, f in zip(table, words, tf):
            score = 0
            for t in term.findall((text or "").translate(AZ)):
                if f[t]:
                    m = 75 + 25 * len(x) * docs // total
                    score += math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (10**9 * f[t] // (1000 * f[t] + 12 * m))
            if score > 0:
                found.append((-score, r[0] is None, r[0] or 0))
        out += [(item, rank, None if missing else doc, -s) for rank, (s, missing, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, prose(11, 30)), (2, "the THE zwei"), (3, None), (4, "..."), (5, "unheard of"), (6, prose(2, 400)), (None, "Kaam lobn 3"), (7, "日本"), (7, "one"), (8, prose(1, 60))]


@pytest.mark.parametrize("k,bucket", [(20, 1024), (3, 4), (1000, 5)])
def test_lexical(spark, docs, monkeypatch, k, bucket):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SEEDS", 10)
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, doc_id string")
    assert rows(lexical.search(docs, items, k)) == searched(corpus(), ITEMS, k)


def test_lexical_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 300)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    assert len(list(lexical.blocks(items))) > 2
    assert rows(lexical.search(docs, items, 5)) == searched(corpus(), ITEMS, 5)


def test_lexical_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(lexical.search(empty, items)) == []
    assert rows(lexical.search(docs, items.limit(0))) == []


def test_lexical_skips_what_cannot_win():
    """A bucket whose bound stays below the floor is never opened, and ties at the floor are kept."""
    import pyarrow as pa

    texts = ["alpha beta"] * 30 + ["alpha"] * 2000
    terms = lexical.Terms(["alpha beta"])
    n, row, place, times = terms.frequencies(pa.array(texts))
    x = 1_000_000_000 * times // (1000 * times + 1200)
    length = np.sqrt(np.bincount(row, weights=x.astype(float) ** 2))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts), 0, -1)), pa.array(length), lexical.lists(place, row, len(n), "<u4"), lexical.lists(x, row, len(n), "<i4")], names=["doc_id", "length", "places", "impacts"])
    search, opened = lexical.Search(terms, np.array([3, 5]), 20), []
    real = lexical.Bucket.scores
    try:
        lexical.Bucket.scores = lambda self, item, floor: opened.append(1) or real(self, item, floor)
        out = pa.Table.from_batches(search.search(iter([batch])))
    finally:
        lexical.Bucket.scores = real
    assert len(opened) == 1 and out["doc_id"].to_pylist() == list(range(2001, 2021))
