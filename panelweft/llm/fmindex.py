"""Benchmark decontamination through an FM-index of each training shard.

A shard is a run of whole documents of about ``SHARD`` bytes inside one task. Its words become
symbols: one for each word that some test phrase has, and breaks for all other words and for the
ends of documents (neighbouring breaks are one). From the sorted suffixes comes the
Burrows-Wheeler transform, kept as a wavelet matrix; backward search narrows the suffix ranges of
all phrases together, and occurrences are found by walking back to sampled suffix positions. The
words of the occurrences merge into removal spans.

A phrase is each window of ``width`` words of an item; an item with fewer words, but not none, is
one phrase. Items are taken in blocks of at most about ``BLOCK`` words, one index pass each, so
that what the tasks get stays bounded; documents are never shuffled. Null texts have no words; an
empty side means no hits; repeated rows are each handled; words are compared by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.storage import along, documents, with_rest
from panelweft.llm.text import NOT_WORD, Words, by_piece, cover

SHARD, BLOCK, SAMPLE = 3 << 20, 1_000_000, 8


def suffixes(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Breaks (0) differ by position and sort first, so no comparison passes a break."""
    n = len(symbols)
    breaks = symbols == 0
    key = np.where(breaks, np.cumsum(breaks), symbols.astype(np.int64) + int(breaks.sum()))
    order = np.argsort(key, kind="stable")
    rank, open_, width = np.empty(n, np.int64), np.arange(n), 1

    def number(at: np.ndarray, sorted_key: np.ndarray) -> np.ndarray:
        """Ranks for places ``at`` of the order from their sorted keys; returns the places that are not alone."""
        new = np.append(True, sorted_key[1:] != sorted_key[:-1]) if len(at) else np.zeros(0, bool)
        group = np.flatnonzero(new)
        first = np.repeat(at[group], np.diff(np.append(group, len(at))))
        rank[order[at]] = first
        alone = new & np.append(new[1:], True)
        return at[~alone]

    open_ = number(open_, key[order])
    while len(open_):
        here = order[open_]
        pair = rank[here] * (n + 1) + rank[np.minimum(here + width, n - 1)]
        by = np.argsort(pair, kind="stable")
        order[open_] = here[by]
        open_ = number(open_, pair[by])
        width *= 2
    return order


class Wavelet:
    """Ranks of symbols in a sequence, a bit plane per level."""

    def __init__(self, values: np.ndarray, kinds: int):
        self.bits = max(int(kinds - 1).bit_length(), 1)
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(at), at
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = (symbol >> level & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def value(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbol at each place, how often it stands before)."""
        symbol, low, place = np.zeros_like(at), np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            a, b, c = ones[low], ones[place], ones[place + 1]
            one = c > b
            symbol = symbol * 2 + one
            low, place = np.where(one, zeros + a, low - a), np.where(one, zeros + b, place - b)
        return symbol, place - low


class Index:
    """FM-index of symbols 1..kinds-1 with breaks 0; the text must begin and end with a break."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        order = suffixes(symbols)
        self.before = Wavelet(symbols[order - 1], kinds)  # order 0 wraps to the last break
        self.start = np.cumsum(np.bincount(symbols, minlength=kinds)) - np.bincount(symbols, minlength=kinds)
        known = (order % SAMPLE == 0) | (symbols[order - 1] == 0)  # a walk back never meets a break
        self.known, self.places = known, order[known]
        self.number = np.cumsum(known) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each phrase; rows are padded at the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.number), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((lengths > j) & (low < high))
            if len(on):
                symbol = phrases[on, j]
                low[on] = self.start[symbol] + self.before.rank(symbol, low[on])
                high[on] = self.start[symbol] + self.before.rank(symbol, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row of the suffix order."""
        out, steps = np.empty(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows
        while len(open_):
            done = self.known[at]
            out[open_[done]] = self.places[self.number[at[done]]] + steps
            open_, at = open_[~done], at[~done]
            symbol, before = self.before.value(at)
            at, steps = self.start[symbol] + before, steps + 1
        return out


@dataclass
class Phrases:
    """Distinct phrases of a block of items as word numbers (from 1, padded by 0), with the items of each."""

    words: np.ndarray  # sorted word hashes
    phrases: np.ndarray
    lengths: np.ndarray
    items: list[list[str | None]]

    @staticmethod
    def of(ids: list[str | None], texts: list[str | None], width: int) -> Phrases:
        w = Words(pa.array(texts, pa.string()), NOT_WORD, lower=True)
        hashes = w.hashes()
        words = np.unique(hashes)
        number = (np.searchsorted(words, hashes) + 1).tolist()
        found: dict[tuple, dict[str | None, None]] = {}
        for item, a, b in zip(ids, w.first, w.first[1:]):
            for i in range(a, max(b - width, a) + 1 if b > a else a):
                found.setdefault(tuple(number[i : min(i + width, b)]), {})[item] = None
        phrases = np.zeros((len(found), width), np.int64)
        for i, p in enumerate(found):
            phrases[i, : len(p)] = p
        return Phrases(words, phrases, (phrases > 0).sum(1), [list(x) for x in found.values()])


def hits(column: pa.Array, p: Phrases) -> tuple[Words, np.ndarray, list[list[str]]]:
    """(words of the shard, which of them an occurrence covers, items found in each row)."""
    w = Words(column, NOT_WORD, lower=True)
    hashes = w.hashes()
    place = np.searchsorted(p.words, hashes)
    symbol = np.where(p.words[np.minimum(place, len(p.words) - 1)] == hashes, place + 1, 0)
    # a break before each document; runs of breaks become one
    at = np.arange(len(w)) + np.repeat(np.arange(1, len(w.first)), w.counts())
    text = np.zeros(len(w) + len(w.first), np.int64)
    text[at] = symbol
    word = np.zeros(len(text), np.int64)
    word[at] = np.arange(len(w))
    keep = (text > 0) | np.append(True, text[:-1] > 0)
    text, word = text[keep], word[keep]
    if text[-1]:
        text, word = np.append(text, 0), np.append(word, 0)
    index = Index(text, len(p.words) + 1)
    low, high = index.search(p.phrases, p.lengths)
    many = high - low
    which = np.repeat(np.arange(len(many)), many)
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))
    begin = word[index.locate(rows)]
    covered = cover(begin, p.lengths[which], len(w))
    found: list[dict[str | None, None]] = [{} for _ in range(len(column))]
    pair = np.unique(np.searchsorted(w.first, begin, side="right") * np.int64(len(many) + 1) + which)
    for row, phrase in zip((pair // (len(many) + 1) - 1).tolist(), (pair % (len(many) + 1)).tolist()):
        found[row].update(dict.fromkeys(p.items[phrase]))
    return w, covered, [sorted(i for i in x if i is not None) for x in found]


SCHEMA = "doc_id long, text string, spans array<struct<start:int,stop:int>>, items array<string>, n_words long"


def _spans(covered: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Runs of covered words by row, counted from the row's first word."""
    edge = np.zeros(len(covered) + 1, bool)
    edge[first] = True
    opens = covered & (edge[:-1] | ~np.append(False, covered[:-1]))
    closes = covered & (edge[1:] | ~np.append(covered[1:], False))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.searchsorted(a, first)
    base = np.repeat(first[:-1], np.diff(offsets))
    spans = pa.StructArray.from_arrays([pa.array((a - base).astype(np.int32)), pa.array((b - base).astype(np.int32))], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), spans)


def find_phrases(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", rest: list[str] | None = None, cut: bool = False) -> DataFrame:
    """(doc_id, text, spans, items, n_words) of every row.

    ``spans`` are the merged runs of words (start, stop) inside an occurrence of a phrase, ``items`` the
    item_ids whose phrases occur, sorted as strings; phrases of items without item_id are found too, and add no id. Words are runs of digits, ASCII letters (case
    ignored) and non-ASCII characters. Columns named in ``rest`` go along in a struct. With ``cut`` the text
    comes without the words of ``spans``, one space where they stood, trimmed; other texts are unchanged.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * BLOCK)))
    out = documents(docs, key, text, rest).withColumns({"spans": F.expr("cast(array() as array<struct<start:int,stop:int>>)"), "items": F.expr("cast(array() as array<string>)"), "n_words": F.lit(0).cast("long")})
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().collect()  # about BLOCK words
        shared = spark.sparkContext.broadcast(Phrases.of([r["item"] for r in rows], [r["text"] for r in rows], width))

        def run(batch: pa.RecordBatch, shared=shared, last=block == blocks - 1) -> pa.RecordBatch:
            p, column = shared.value, batch.column("text")
            if len(p.phrases):
                w, covered, found = hits(column, p)
            else:
                w = Words(column, NOT_WORD, lower=True)
                covered, found = np.zeros(len(w), bool), [[] for _ in range(len(column))]
            old = batch.column("spans")
            if len(old.values):  # earlier blocks
                flat_ = old.flatten()
                base = np.repeat(w.first[:-1], np.asarray(pc.list_value_length(old)))
                a, b = (np.asarray(flat_.field(c)).astype(np.int64) + base for c in ("start", "stop"))
                covered = covered | cover(a, b - a, len(w))
            found = [sorted({*x, *y}) for x, y in zip(found, batch.column("items").to_pylist())]
            spans = _spans(covered, w.first)
            if cut and last:
                column = without(column, w, spans)
            return with_rest(
                batch, [batch.column("doc_id"), column, spans, pa.array(found, pa.list_(pa.string())), pa.array(w.counts().astype(np.int64))], ["doc_id", "text", "spans", "items", "n_words"]
            )

        out = out.mapInArrow(by_piece(run, size=SHARD), along(SCHEMA, out))
    return out


def without(column: pa.Array, w: Words, spans: pa.ListArray) -> pa.Array:
    """The texts without the words of their spans, one space where they stood, trimmed; other texts are unchanged."""
    many = np.asarray(pc.list_value_length(spans))
    out = column.to_pylist()
    for r in np.flatnonzero(many).tolist():
        raw, base, at, kept = out[r].encode(), w.offsets[r], 0, []
        for s in spans[r].as_py():
            a, b = w.begin[w.first[r] + s["start"]] - base, w.end[w.first[r] + s["stop"] - 1] - base
            kept += [raw[at:a], b" "]
            at = b
        out[r] = b"".join([*kept, raw[at:]]).strip().decode("utf-8", "replace")
    return pa.array(out, pa.string())
