"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order ``ORDER`` holds how often each byte followed each
context in the language's sample. The code length of a byte is that of an adaptive coder whose
statistics are frozen: it starts at the longest context the tree knows and, while the byte was
never seen there, pays for an escape and drops the oldest byte of the context. Escapes weigh as
many as a context has distinct bytes, and bytes that a longer context could have coded are left
out of the shorter ones (full exclusion), so each context's probabilities add up to one. The
language of the shortest code wins, ties go to the smaller name. Its score is its share of the
languages' likelihoods.

ASCII capitals count as small letters and each control character as a space; a text is preceded
by spaces. Learning takes about ``PER_LANG`` documents of each language, those with the smallest
hash of doc_id, however many there are. Null text and text without a letter is ``und`` with
score 1, as is every text if nothing could be learnt. The languages of the learnt rows are
assumed to be few enough to list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.storage import documents
from panelweft.llm.text import LOWER, by_piece, flat

ORDER, PER_LANG, UNDECIDED = 4, 400, "und"
#: Grams whose code lengths a worker keeps before it starts anew.
KEPT = 1_000_000
FOLD = LOWER.copy()
FOLD[:0x20] = 0x20


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the ORDER bytes before it as an integer, offsets of rows)."""
    body, offsets = flat(column)
    body = FOLD[body].astype(np.uint64)
    out = body.copy()
    at = np.arange(len(body)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        before = np.full(len(body), 0x20, np.uint64)
        before[k:] = body[:-k] if k <= len(body) else body[:0]
        before[at < k] = 0x20
        out |= before << np.uint64(8 * k)
    return out, offsets


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether it is there) of each x in sorted keys."""
    i = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return i, keys[i] == x if len(keys) else np.zeros(len(x), bool)


class Tree:
    """One language's contexts, by order: bytes seen, escape weights and what is left after exclusion."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.levels = []
        for k in range(ORDER, -1, -1):
            key = gram & np.uint64((1 << 8 * (k + 1)) - 1)
            order = np.argsort(key, kind="stable")
            key, n = key[order], count[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[first], np.add.reduceat(n, first).astype(np.float64)
            gram, count = key, n
            ctx = key >> np.uint64(8)
            first = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ctx))))
            level = {"gram": key, "n": n, "ctx": ctx[first], "total": np.add.reduceat(n, first), "kinds": np.diff(np.append(first, len(ctx))).astype(float), "owner": owner}
            if self.levels:  # what a longer context leaves of this one
                above = self.levels[-1]
                same, _ = find(key, above["gram"] & np.uint64((1 << 8 * (k + 1)) - 1))
                taken = np.bincount(above["owner"], n[same], len(above["ctx"]))
                here, _ = find(level["ctx"], above["ctx"] & np.uint64((1 << 8 * k) - 1))
                above["left"], above["new"] = level["total"][here] - taken, level["kinds"][here] - above["kinds"]
            self.levels.append(level)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(gram))
        open_, above = np.arange(len(gram)), np.full(len(gram), -1)
        for k, level in zip(range(ORDER, -1, -1), self.levels):
            g = gram[open_]
            c, known = find(level["ctx"], (g >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            total, kinds = level["total"][c], level["kinds"][c]
            came = above[open_]
            if k < ORDER:
                upper = self.levels[ORDER - k - 1]
                fell = came >= 0
                total = np.where(fell, upper["left"][came], total)
                kinds = np.where(fell, upper["new"][came], kinds)
            i, seen = find(level["gram"], g & np.uint64((1 << 8 * (k + 1)) - 1))
            seen &= known
            whole = np.maximum(total + kinds, 1e-300)
            out[open_[seen]] -= np.log2(level["n"][i[seen]] / whole[seen])
            leave = known & ~seen & (kinds > 0)
            out[open_[leave]] -= np.log2(kinds[leave] / whole[leave])
            above[open_] = np.where(known, c, -1)
            open_ = open_[~seen]
        out[open_] += np.log2(max(256 - self.levels[-1]["kinds"][0], 1))
        return out


class Model:
    def __init__(self, trees: dict[str, Tree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]
        self.gram, self.cost = np.zeros(0, np.uint64), np.zeros((0, len(self.names)), np.float32)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths by language of distinct grams; those seen before are kept."""
        _, old = find(self.gram, gram)
        new = np.sort(gram[~old])
        if len(new):
            if len(self.gram) + len(new) > KEPT:
                self.gram, self.cost, new = self.gram[:0], self.cost[:0], np.sort(gram)
            cost = np.stack([t.bits(new) for t in self.trees], axis=1).astype(np.float32)
            gram_all = np.concatenate([self.gram, new])
            order = np.argsort(gram_all, kind="stable")
            self.gram, self.cost = gram_all[order], np.concatenate([self.cost, cost])[order]
        return self.cost[np.searchsorted(self.gram, gram)]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each row in each language."""
        gram, offsets = grams(column)
        code, kinds = pd.factorize(gram)
        cost = self.costs(kinds)
        out = np.zeros((len(column), len(self.names)))
        full = np.flatnonzero(np.diff(offsets))
        for j in range(len(self.names)):
            if len(full):
                out[full, j] = np.add.reduceat(cost[:, j].astype(np.float64)[code], offsets[full])
        return out


def train(docs: DataFrame, lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """Learns from docs (doc_id, text, lang); rows that must not be learnt from are left out by the caller."""
    rows = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang).cast("string").alias("lang"))
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return Model({})
    parts = 1 << 24
    limit = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, min(parts, -(-parts * per_lang // n)))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < limit[F.col("lang")])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        gram, offsets = grams(batch.column("text"))
        name = batch.column("lang").dictionary_encode()
        who = np.repeat(np.asarray(name.indices), np.diff(offsets))
        parts = []
        for i in range(len(name.dictionary)):
            value, n = np.unique(gram[who == i], return_counts=True)
            parts.append((np.full(len(value), i), value, n))
        who, value, n = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(who)), pa.array(value.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(by_piece(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    name = counted.column("lang").combine_chunks().dictionary_encode() if counted.num_rows else pa.array([], pa.string()).dictionary_encode()
    name = pa.concat_arrays(name.chunks) if isinstance(name, pa.ChunkedArray) else name
    who, gram, n = np.asarray(name.indices), np.asarray(counted.column("gram")).astype(np.uint64), np.asarray(counted.column("n")).astype(np.float64)
    return Model({k: Tree(gram[who == i], n[who == i]) for i, k in enumerate(name.dictionary.to_pylist())})


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = documents(docs, key, text).withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        lettered = np.asarray(batch.column("lettered").cast(pa.uint8())).astype(bool)
        if m.names:
            bits = m.lengths(batch.column("text"))
            best = bits.argmin(1)
            score = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            names = np.array(m.names, object)[best]
        else:
            names, score, lettered = np.full(batch.num_rows, UNDECIDED, object), np.ones(batch.num_rows), np.zeros(batch.num_rows, bool)
        names = np.where(lettered, names, UNDECIDED)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, score, 1.0))], names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(by_piece(run), "doc_id long, lang_pred string, score double")
