"""Source divergence audit: how the term shares of a language's groups (lang, source) differ.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms that
``least`` of its documents hold. A kept term's share in a group is 1 + floor(10**9 * (count + 5) / (N + 5 V)).

1. A pass over documents counts terms per group. Each task sums its own counts up before they are
   shuffled by (lang, term), so a word that every document holds leaves a task once a group.
2. Kept terms get ids, which fall into blocks of ``BLOCK``. Per block a group is a sorted array of term
   ids and one of counts.
3. Pair tasks: groups are dealt to tiles of ``TILE`` by their order in the language, and the arrays of two
   tiles meet per block. For each unordered pair the ids of the shorter array gallop through the longer
   one. Overlaps, terms of one side and terms of neither are priced, and the sums of the blocks added up.
   A pair's value is the same both ways, so it becomes a row of either group.

Nothing grows with a group's texts but its counts: a task holds 2 * TILE arrays of one block at most.
Counts and shares are exact 64-bit integers; the product with 10**9 is divided in steps of 1,000, so
totals may reach 9 * 10**15.

Null text, lang and source are ''. Every row is a document, repeated or without doc_id alike. Groups
without kept terms have value rows too; a language that keeps no term has value 0 in all pairs. Equal
values are ranked by UTF-8 bytes. A language with one source has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweft.llm.storage import kept
from panelweft.llm.text import NOT_LETTER, Words, pieces

LEAST, TOP, SCALE_STEPS, PRIOR = 30, 50, 3, 5
PIECE, HELD = 8 << 20, 400_000
BLOCK, TILE = 1 << 16, 16
COUNTS = ["lang", "source", "term", "n", "docs"]


def counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a run of documents; every group has a row of the term '' with zeros."""
    words = Words(batch.column("text"), NOT_LETTER, lower=True)
    code, terms = words.coded()
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
    groups, group = np.unique(group, return_inverse=True)
    width = max(len(terms), 1)
    in_doc = np.unique(words.rows() * width + code)
    pairs, docs = np.unique(group[in_doc // width] * width + in_doc % width, return_counts=True)
    pairs_too, n = np.unique(group[words.rows()] * width + code, return_counts=True)
    assert len(pairs) == len(pairs_too)
    of = np.append(groups[pairs // width], groups)
    a, b = np.divmod(of, max(len(source.dictionary), 1))
    names = pa.concat_arrays([terms.take(pa.array(pairs % width)), pa.array([""] * len(groups), terms.type)]).cast(pa.string())
    zeros = np.zeros(len(groups), np.int64)
    return pa.table([lang.dictionary.take(pa.array(a)), source.dictionary.take(pa.array(b)), names, pa.array(np.append(n, zeros)), pa.array(np.append(docs, zeros))], names=COUNTS)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's documents, added up while they are fewer than ``HELD`` rows."""
    held: list[pa.Table] = []

    def total() -> pa.Table:
        sums = pa.concat_tables(held).group_by(COUNTS[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns(COUNTS)

    for batch in batches:
        for a, b in pieces(batch.column("text"), PIECE):
            held.append(counted(batch.slice(a, b - a)))
            if sum(map(len, held)) > HELD:
                held = [total()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from total().to_batches()


def share(count, total):
    """1 + floor(10**9 * count / total) of numpy integers, exactly."""
    out = np.zeros_like(count)
    for _ in range(SCALE_STEPS):
        count = count * 1000
        out = out * 1000 + count // total
        count = count % total
    return out + 1


def share_column(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) of long columns, exactly."""

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    out = F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        out = out * 1000 + div(count * 1000, total)
        count = (count * 1000) % total
    return out + 1


def gallop(ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ids that both sorted arrays hold, by searching the shorter one's ids in the longer one."""
    if len(ids) > len(among):
        there, here = gallop(among, ids)
        return here, there
    at = np.searchsorted(among, ids)
    here = np.flatnonzero(at < len(among))
    here = here[among[at[here]] == ids[here]]
    return here, at[here]


def merge(cell: pa.Table) -> pa.Table:
    """(lang, a, b, value, seen): of each pair of a cell's groups, the difference over the terms that either holds, and their number."""
    out = []
    rows = cell.select(["side", "source", "ids", "counts", "total"]).to_pylist()
    for r in rows:
        r["ids"], counts = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<i8")
        r["p"] = share(counts + PRIOR, np.int64(r["total"]))
        r["none"] = share(np.array([PRIOR], np.int64), np.int64(r["total"]))[0]
    two = any(r["side"] for r in rows)
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            if two and x["side"] == y["side"]:
                continue
            here, there = gallop(x["ids"], y["ids"])
            p, q = x["p"][here], y["p"][there]
            value = np.abs(p - q).sum()
            value += np.abs(x["p"] - y["none"]).sum() - np.abs(p - y["none"]).sum()
            value += np.abs(y["p"] - x["none"]).sum() - np.abs(q - x["none"]).sum()
            out.append((*sorted((x["source"], y["source"])), int(value), len(x["ids"]) + len(y["ids"]) - len(here)))
    a, b, value, seen = zip(*out) if out else ([], [], [], [])
    lang = [cell.column("lang")[0].as_py()] * len(out)
    return pa.table([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value, pa.int64()), pa.array(seen, pa.int64())], names=["lang", "a", "b", "value", "seen"])


def packed(arrays: DataFrame) -> DataFrame:
    """Lists of (id, n) as two packed arrays, in order of ids."""

    def run(batches):
        for b in batches:
            entries = b.column("entries")
            at = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(entries), 0)))).tolist()
            flat = entries.flatten()
            ids, n = (np.asarray(flat.field(f)).astype("<i8") for f in (0, 1))
            both = []
            for i, j in zip(at, at[1:]):
                order = np.argsort(ids[i:j])
                both.append((ids[i:j][order].tobytes(), n[i:j][order].tobytes()))
            columns = [b.column(c) for c in ("lang", "source", "block", "total", "tile", "tiles")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.binary()) for x in (zip(*both) if both else ([], [])))], names=["lang", "source", "block", "total", "tile", "tiles", "ids", "counts"])

    return arrays.mapInArrow(run, "lang string, source string, block long, total long, tile int, tiles int, ids binary, counts binary")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources of the language by their difference
    to the group, part ``term`` the ``top`` terms that the group holds more of than its language does."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    counts = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    # the tasks have added up already: one shuffle serves the sums per group and per language
    sums = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    in_lang = F.sum("docs").over(Window.partitionBy("lang", "term"))
    sums = kept(sums.withColumn("df", in_lang).where((F.col("df") >= least) | (F.col("term") == "")).select("lang", "source", "term", "n"), "counts")
    terms = sums.where("term != ''")
    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    vocabulary = kept(vocabulary.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    groups = sums.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = groups.join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.col("n_group") + PRIOR * F.coalesce("v", F.lit(0))).alias("total"), (F.coalesce("n_lang", F.lit(0)) + PRIOR * F.coalesce("v", F.lit(0))).alias("total_lang"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("many"),
    )
    groups = kept(groups.select("*", F.expr(f"int(place div {TILE})").alias("tile"), F.expr(f"int((many + {TILE - 1}) div {TILE})").alias("tiles")), "groups")
    entries = kept(terms.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "id", "n", "in_lang"), "entries")

    # a group takes part in every block of its language, with empty arrays where it holds none of the terms
    block = F.shiftright("id", 16) if BLOCK == 1 << 16 else F.expr(f"id div {BLOCK}")
    lists = entries.groupBy("lang", "source", block.alias("block")).agg(F.collect_list(F.struct("id", "n")).alias("entries"))
    blocks = vocabulary.select("lang", block.alias("block")).distinct()
    arrays = packed(groups.join(blocks, "lang").join(lists, ["lang", "source", "block"], "left"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = arrays.select("*", other).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).withColumn("side", (F.col("tile") > F.col("other")).cast("int"))
    priced = dealt.groupBy("lang", "block", "low", "high").applyInArrow(merge, "lang string, a string, b string, value long, seen long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    one = groups.select("lang", "source", "v", "total")
    left, right = (one.select("lang", F.col("source").alias(c), F.col("v").alias(f"v_{c}"), F.col("total").alias(f"total_{c}")) for c in "ab")
    pairs = left.join(right, "lang").where("a < b").join(priced, ["lang", "a", "b"], "left")

    def absent(total: str) -> Column:
        return share_column(F.lit(PRIOR).cast("long"), F.col(total))

    neither = (F.col("v_a") - F.col("seen")) * F.abs(absent("total_a") - absent("total_b"))
    pairs = pairs.select("lang", "a", "b", F.when(F.col("v_a") == 0, F.lit(0).cast("long")).otherwise(F.col("value") + neither).alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way")
    pairs = pairs.select("lang", ways, "value").select("lang", "way.*", "value")

    p, q = share_column(F.col("n") + PRIOR, F.col("total")), share_column(F.col("in_lang") + PRIOR, F.col("total_lang"))
    more = entries.where("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [pairs.withColumn("rank", order).withColumn("part", F.lit("pair")), more.withColumn("rank", order).where(F.col("rank") <= top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM vocabulary GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY lang, source),
groups AS (
    SELECT g.lang, g.source, coalesce(s.n, 0) + {PRIOR} * coalesce(l.v, 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS (
    SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + {PRIOR})::HUGEINT) // g.total AS p,
        1 + (1000000000 * (v.in_lang + {PRIOR})::HUGEINT) // (l.n + {PRIOR} * l.v) AS q
    FROM groups g JOIN vocabulary v USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
    SELECT g.lang, g.source, h.source AS item, coalesce(d.value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source != h.source
    LEFT JOIN (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL) d
    ON d.lang = g.lang AND d.source = g.source AND d.item = h.source),
both_parts AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
