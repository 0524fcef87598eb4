"""Ranked lexical search over norm buckets of impact vectors.

A document is a vector of impacts over the items' terms, an item one of weights, and a score their inner
product. Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

1. A pass over documents keeps, of each, its length and the places and frequencies of the items' terms;
   sums over them give N, L and the document frequencies.
2. Impacts follow, and each partition orders its vectors by length (longest first).
3. Runs of ``BUCKET`` vectors are norm buckets. An item skips a bucket if its own length times the
   bucket's longest can't reach the item's k-th score (Cauchy-Schwarz). Within a bucket its heaviest
   coordinates are added up; what is missing is bounded by the lengths of the rest of both vectors, and
   only documents whose bound reaches the k-th score are rescored, exactly, in 64-bit integers.

k-th scores start from those of the longest vectors of all documents (about ``SEEDS``) and rise
within a task. Buckets are made of what a partition holds: no shuffle of vectors, and long vectors, which
are searched most, stay dealt out over all tasks. Tasks return at most k documents an item, and a ranked window,
limited before it is shuffled, takes the best.

Items come from the driver in blocks of about ``BLOCK`` bytes of text, so what a task holds of them doesn't grow
with their number; each block is one search of all documents.

Null texts and texts without terms count neither in N nor in L, and are never found. Every row is a
document, whatever its doc_id: repeated rows are found as often as they stand, and of equal scores a
missing doc_id comes last. Every row of the items is an item; one without text or terms, or whose terms no document holds, finds
nothing, a missing item_id stays missing, and rows that share an item_id are searched one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweft.llm.storage import documents, kept
from panelweft.llm.text import NOT_WORD, Words, pieces

K, BUCKET, SEEDS, BLOCK = 20, 1024, 4096, 4 << 20
PIECE = 4 << 20
#: Share of an item's squared length that its first coordinates hold.
FOCUS = 0.7
IMPACT = 1_000_000_000


class Terms:
    """The items of a block: their distinct terms, and per item the places and frequencies of its terms."""

    def __init__(self, texts: list[str | None]):
        words = Words(pa.array(texts, pa.string()), NOT_WORD, lower=True)
        code, self.terms = words.coded()
        cut = words.first.tolist()
        self.items = [np.unique(code[a:b], return_counts=True) for a, b in zip(cut, cut[1:])]

    def frequencies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of terms of each row; row, place and frequency of the items' terms in it, in this order)."""
        words = Words(column, NOT_WORD, lower=True)
        code, distinct = words.coded()
        place = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.terms), -1)).astype(np.int64)[code] if len(code) else code
        known = place >= 0
        many = max(len(self.terms), 1)
        both, times = np.unique(words.rows()[known] * many + place[known], return_counts=True)
        return words.counts(), both // many, both % many, times


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: str) -> pa.Array:
    """The values of each of n rows, packed."""
    offsets = np.searchsorted(rows, np.arange(n + 1)) * np.dtype(kind).itemsize
    data = np.ascontiguousarray(values.astype(kind)).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unlisted(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each row's begin) of packed lists."""
    body, offsets = flat_bytes(column)
    return np.frombuffer(body, kind), offsets // np.dtype(kind).itemsize


def flat_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (data[offsets[0] : offsets[-1]].to_pybytes() if data is not None else b""), offsets - offsets[0]


def frequency_rows(rows: DataFrame, terms) -> DataFrame:
    """(doc_id, n, places, times) of the documents with terms."""

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column("text"), PIECE):
                part = batch.slice(a, b - a)
                n, row, place, times = terms.value.frequencies(part.column("text"))
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), lists(place, row, len(n), "<u4"), lists(times, row, len(n), "<u4")], names=["doc_id", "n", "places", "times"])
                yield out.filter(pa.array(n > 0))

    return rows.mapInArrow(run, "doc_id long, n long, places binary, times binary")


def document_frequencies(found: DataFrame) -> DataFrame:
    """(place, docs), added up per task."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            seen = np.bincount(unlisted(b.column("places"), "<u4")[0])
            if len(seen) > len(total):
                total = np.append(total, np.zeros(len(seen) - len(total), np.int64))
            total[: len(seen)] += seen
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "docs"])

    return found.mapInArrow(run, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs"))


def vectors(found: DataFrame, docs: int, words: int) -> DataFrame:
    """(doc_id, length, places, impacts) of the documents that hold a term of an item, longest first in each partition."""

    def run(batches):
        for b in batches:
            places, at = unlisted(b.column("places"), "<u4")
            times = unlisted(b.column("times"), "<u4")[0].astype(np.int64)
            row = np.repeat(np.arange(len(b)), np.diff(at))
            m = 100 - 25 + (25 * np.asarray(b.column("n")) * docs) // words
            x = (IMPACT * times) // (1000 * times + 12 * m[row])
            length = np.sqrt(np.bincount(row, weights=x.astype(float) ** 2, minlength=len(b)))
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(length), b.column("places"), lists(x, row, len(b), "<i4")], names=["doc_id", "length", "places", "impacts"])
            yield out.filter(pa.array(np.diff(at) > 0))

    return found.mapInArrow(run, "doc_id long, length double, places binary, impacts binary").sortWithinPartitions(F.desc("length"))


class Bucket:
    """Vectors of about the same length, by coordinate."""

    def __init__(self, part: pa.RecordBatch):
        places, at = unlisted(part.column("places"), "<u4")
        row = np.repeat(np.arange(len(part)), np.diff(at))
        order = np.argsort(places, kind="stable")
        self.places, self.row = places[order], row[order]
        self.impact = unlisted(part.column("impacts"), "<i4")[0].astype(np.int64)[order]
        self.length = np.asarray(part.column("length"))
        self.longest = self.length.max(initial=0)
        self.doc = np.asarray(part.column("doc_id").fill_null(0))
        self.missing = np.asarray(part.column("doc_id").is_null())

    def entries(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, impact, the item's weight) of the vectors' entries at some coordinates."""
        first, stop = np.searchsorted(self.places, places), np.searchsorted(self.places, places, "right")
        many = stop - first
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return self.row[at], self.impact[at], np.repeat(weights, many)

    def scores(self, item: Item, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the vectors that reach the floor."""
        n = len(self.length)
        row, x, y = self.entries(item.places[: item.focus], item.weights[: item.focus])
        x = x.astype(float)
        part, square = np.bincount(row, weights=x * y, minlength=n), np.bincount(row, weights=x * x, minlength=n)
        rest = np.sqrt(np.maximum(self.length**2 - square, 0) + 1e-9 * self.length**2)
        may = (part + item.rest * rest) * (1 + 1e-9) >= floor
        if not may.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, x, y = self.entries(item.places, item.weights)
        score = np.zeros(n, np.int64)
        some = may[row]
        np.add.at(score, row[some], x[some] * y[some])
        row = np.flatnonzero(score >= floor)
        return row, score[row]


class Item:
    """An item's coordinates, heaviest first; the first ``focus`` hold most of its length, the others ``rest``."""

    def __init__(self, places: np.ndarray, times: np.ndarray, weight: np.ndarray):
        y = times * weight[places]
        order = np.lexsort((places, -y))[: int((y > 0).sum())]
        self.places, self.weights = places[order], y[order]
        square = np.append(0.0, np.cumsum(self.weights.astype(float) ** 2))
        self.focus = int(np.searchsorted(square, FOCUS * square[-1]))
        self.length, self.rest = math.sqrt(square[-1]), math.sqrt(square[-1] - square[self.focus])


class Search:
    """The items of a block, and the scores that a document must reach."""

    def __init__(self, terms: Terms, weight: np.ndarray, k: int):
        self.k, self.items = k, [Item(places, times, weight) for places, times in terms.items]
        self.floor = np.ones(len(self.items), np.int64)

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, doc_id, score): at most k documents of each item, among them all of this task that are its best."""
        floor, lengths = self.floor.copy(), np.array([x.length for x in self.items])
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in pieces(batch.column("places"), PIECE):
                for first in range(a, b, BUCKET):
                    bucket = Bucket(batch.slice(first, min(BUCKET, b - first)))
                    for i in np.flatnonzero(lengths * bucket.longest * (1 + 1e-9) >= floor).tolist():
                        row, score = bucket.scores(self.items[i], int(floor[i]))
                        if len(row):
                            found = (score, bucket.missing[row], bucket.doc[row])
                            score, missing, doc = (np.append(x, y) for x, y in zip(best[i], found)) if i in best else found
                            order = np.lexsort((doc, missing, -score))[: self.k]
                            best[i] = score[order], missing[order], doc[order]
                            if len(order) == self.k:
                                floor[i] = max(floor[i], score[order[-1]])
        for i, (score, missing, doc) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), i, np.int64)), pa.array(doc, mask=missing), pa.array(score)], names=["item", "doc_id", "score"])


def blocks(items: DataFrame) -> Iterator[tuple[list, list[str | None]]]:
    """(item ids, texts) in blocks of about ``BLOCK`` bytes, one after the other."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"] or "") + 64
        if held >= BLOCK:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _search_block(rows: DataFrame, names: StructType, ids: list, texts: list[str | None], k: int) -> DataFrame:
    spark = rows.sparkSession
    terms = Terms(texts)
    found = kept(frequency_rows(rows, spark.sparkContext.broadcast(terms)), "frequencies")
    docs, words = found.agg(F.count("*"), F.sum("n")).first()
    weight = np.zeros(len(terms.terms), np.int64)
    for r in document_frequencies(found).toLocalIterator():  # at most as many rows as the block has terms
        weight[r["place"]] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["docs"] + 1)))
    long_ = kept(vectors(found, docs, words or 1), "vectors")
    search = Search(terms, weight, k)
    best = "item long, doc_id long, score long"
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))

    def ranked(vectors_: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(search)
        some = vectors_.mapInArrow(lambda batches: shared.value.search(batches), best)
        return some.withColumn("rank", order).where(F.col("rank") <= k)

    # the k-th scores of the longest vectors are a floor for those of all
    longest = long_.agg(F.percentile_approx("length", max(0.0, 1 - SEEDS / max(docs, 1)), 1000)).first()[0]
    seeds = ranked(long_.where(F.col("length") >= (longest or 0.0)))
    for r in seeds.where(F.col("rank") == k).select("item", "score").toLocalIterator():  # a row an item of the block
        search.floor[r["item"]] = max(1, r["score"])
    return ranked(long_).join(spark.createDataFrame(list(enumerate(ids)), names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    rows = documents(docs, key, text)
    asked = items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    names = StructType().add("item", "long").add("item_id", asked.schema["item_id"].dataType)
    out = None
    for ids, texts in blocks(asked):
        found = kept(_search_block(rows, names, ids, texts, k), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], names.add("rank", "integer").add("doc_id", "long").add("score", "long")).drop("item")
    return out.select("item_id", "rank", "doc_id", "score")


ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
asked AS (SELECT row_number() OVER () AS i, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
words AS (SELECT d, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
terms AS (SELECT i, item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM asked),
lengths AS (SELECT d, count(*) AS n FROM words GROUP BY d),
sums AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
found AS (SELECT d, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM found, sums GROUP BY term, docs),
impacts AS (
    SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)) AS x
    FROM found JOIN lengths USING (d), sums),
scores AS (SELECT i, item_id, d, doc_id, sum(w * x)::BIGINT AS score FROM terms JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING sum(w * x) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {K}
"""
