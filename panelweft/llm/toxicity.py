"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is its lower-cased letters and digits; its features are the word itself and its
character n-grams with border marks, hashed into a fixed table. A document's vector is the
mean of the embeddings of all its words' features, and a softmax over two classes reads it.
Embeddings and softmax are learnt together, by full-batch gradient steps in numpy, on at most
``PER_CLASS`` labelled documents of each class (those of the smallest hash of doc_id, so the
sample doesn't depend on the order of rows). Features whose documents differ between the classes
by a chi-square of ``CHI2`` or more are learnt (in small samples at least the 200 strongest); the
rest stay neutral: each is rare, and together they would memorise the sample.

Every whole text is scored. Null, empty and wordless texts have no features and score what the
softmax's bias gives. Labels that are null or not 0 or 1 aren't learnt from; of repeated labels
of one document the largest counts. Without labels of both classes every score is the share of
label 1, or 0 without labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.storage import along, documents, with_rest
from panelweft.llm.text import NOT_WORD, Words, by_piece, mix

PER_CLASS, CHI2, BUCKETS, DIM, STEPS, GRAMS = 2000, 20.0, 1 << 18, 4, 120, (3, 4, 5)
SCALE, RATE = 300.0, 0.1


def subwords(w: Words, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_subwords` of some words at a time, which bounds what it holds besides its result."""
    parts = [_subwords(w.some(slice(a, a + at_once))) for a in range(0, max(len(w), 1), at_once)]
    shift = np.cumsum([0, *(len(i) for i, _ in parts)])
    return np.concatenate([i for i, _ in parts]), np.concatenate([*(f[:-1] + s for (_, f), s in zip(parts, shift)), shift[-1:]])


def _subwords(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, first feature of each word and the end): n-grams over characters, marked at the borders, and the word."""
    size = w.end - w.begin
    total = int(size.sum()) + 2 * len(w)
    at = np.cumsum(size + 2) - (size + 2)  # each word as < word >
    body = np.empty(total, np.uint8)
    body[at], body[at + size + 1] = ord("<"), ord(">")
    inner = np.repeat(at + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    body[inner] = w.body[np.repeat(w.begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    lead = np.flatnonzero((body & 0xC0) != 0x80)  # where characters start
    word = np.repeat(np.arange(len(w), dtype=np.int32), size + 2)[lead]
    stop = np.append(lead[1:], total)
    n = len(lead)
    table = mix(np.arange(1, 257, dtype=np.uint64))
    char = np.zeros(n, np.uint64)  # a hash of each character
    for j in range(4):
        here = lead + j < stop
        char[here] = char[here] * np.uint64(0x100000001B3) + table[body[(lead + j)[here]]]
    ids, owner = [(w.hashes(3) % np.uint64(BUCKETS)).astype(np.int32)], [np.arange(len(w), dtype=np.int32)]
    gram = np.zeros(n, np.uint64)
    for k in range(1, max(GRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        gram = gram[:m] * np.uint64(0xD1342543DE82EF95) + char[k - 1 : k - 1 + m]
        if k in GRAMS:
            whole = word[:m] == word[k - 1 : k - 1 + m]
            ids.append((mix(gram[whole] + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(word[:m][whole])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(ids)[order], np.searchsorted(owner_all[order], np.arange(len(w) + 1))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


class Model:
    """Per feature the difference of the two classes' scores; ``bias`` of an empty text."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def scores(self, column: pa.Array) -> np.ndarray:
        w = Words(column, NOT_WORD, lower=True)
        code, kinds = pd.factorize(w.hashes())
        one = np.zeros(len(kinds), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]  # an instance of each distinct word
        ids, first = subwords(w.some(one))
        weight, count = sums(self.weight[ids], first), np.diff(first)
        logit = sums(weight[code], w.first) / np.maximum(sums(count[code].astype(float), w.first), 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of values; no run is empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


def compact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, number of each item's value, starts of runs) of sorted x."""
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x)))), starts


def fit(words: pa.ListArray, counts: pa.ListArray, labels: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Embeddings and softmax for documents given as lists of distinct words with their counts.

    prior: the share of label 1 among all labels that may be learnt from; the sample is weighted to it.
    """
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS), np.log((prior + 1e-9) / (1 - prior + 1e-9)))
    first = np.asarray(words.offsets).astype(np.int64)
    coded = words.values.dictionary_encode()
    word, n = np.asarray(coded.indices).astype(np.int64), np.asarray(counts.values).astype(np.float32)
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    w = Words(coded.dictionary, np.zeros(256, bool))
    ids, wf = subwords(w)
    per_word = np.diff(wf)
    size = np.maximum(np.bincount(doc, n * per_word[word], len(labels)), 1)[:, None].astype(np.float32)
    seen = np.zeros((2, BUCKETS))  # documents of each class that hold a feature
    for a in range(0, len(labels), 50):
        own = word[first[a] : first[min(a + 50, len(labels))]]
        of = np.repeat(doc[first[a] : first[min(a + 50, len(labels))]], per_word[own])
        f = ids[np.repeat(wf[own] - (np.cumsum(per_word[own]) - per_word[own]), per_word[own]) + np.arange(len(of))]
        pair = pd.unique(of * BUCKETS + f)
        for c in (0, 1):
            seen[c] += np.bincount(pair[labels[pair // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
    df, whole = seen.sum(0), np.bincount(labels, minlength=2)
    odds = (seen[1] * whole[0] - seen[0] * whole[1]) ** 2 * len(labels) / np.maximum(df * (len(labels) - df) * whole[0] * whole[1], 1)
    learnt = (df >= 2) & (odds >= max(min(CHI2, np.sort(odds)[-200]), 3))
    keep = learnt[ids]
    feature, owner = ids[keep], np.repeat(np.arange(len(w), dtype=np.int32), per_word)[keep]
    del ids, keep
    used_words, owner, o_start = compact(owner)
    number = np.full(len(w), -1)
    number[used_words] = np.arange(len(used_words))
    has = number[word] >= 0
    word, n, doc = number[word[has]], n[has][:, None], doc[has]
    used_docs, row, d_start = compact(doc)
    by_feature, by_word = np.argsort(feature, kind="stable"), np.argsort(word, kind="stable")
    used, feature_sorted, f_start = compact(feature[by_feature])
    feature = np.empty(len(by_feature), np.int64)
    feature[by_feature] = feature_sorted
    _, _, w_start = compact(word[by_word])
    rng = np.random.default_rng(seed)
    e, soft, bias = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.log([1 - prior, prior]).astype(np.float32)
    held = rng.random(len(labels)) < 0.15
    truth = np.eye(2, dtype=np.float32)[labels]
    share = np.array([1 - prior, prior]) / np.bincount(labels[~held], minlength=2).clip(1)
    check = (np.array([1 - prior, prior]) / np.bincount(labels[held], minlength=2).clip(1))[labels] * held
    weight = np.where(held, 0, share[labels])[:, None].astype(np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, soft, bias)]
    best, out = np.inf, (np.zeros(len(used)), np.log(prior / (1 - prior)))
    pace = np.minimum(1, df[used] / (0.03 * len(labels)))[:, None].astype(np.float32)  # rare features move slowly: they could memorise documents
    for step in range(1, STEPS + 1):
        h = np.zeros((len(labels), DIM), np.float32)
        h[used_docs] = runs(runs(e[feature], o_start)[word] * n, d_start)
        h *= SCALE / size
        z = h @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        loss = -(np.log((p * truth).sum(1) + 1e-9) * check).sum()
        if loss < best:
            best, out = loss, (e @ (soft[:, 1] - soft[:, 0]) * SCALE, bias[1] - bias[0])
        dz = (p - truth) * weight
        dh = SCALE * dz @ soft.T / size
        dw = runs((dh[doc] * n)[by_word], w_start)
        grads = runs(dw[owner[by_feature]], f_start), h.T @ dz, dz.sum(0)
        for x, g, m, rate in zip((e, soft, bias), grads, moments, (RATE * pace, RATE / 2, RATE / 2)):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    full = np.zeros(BUCKETS)
    full[used] = out[0]
    return Model(full, out[1])


def bags(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each text's distinct words and how often they stand in it."""
    w = Words(batch.column("text"), NOT_WORD, lower=True)
    words, counts = [], []
    for a, b in zip(w.first, w.first[1:]):
        value, n = np.unique(np.array([w.body[i:j].tobytes() for i, j in zip(w.begin[a:b], w.end[a:b])], object), return_counts=True)
        words.append([x.decode("utf-8", "replace") for x in value])
        counts.append(n.tolist())
    return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "words", "counts"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from labels (doc_id, toxic); rows that must not be learnt from are left out by the caller."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1])  # at most 2 * per_class rows
    rows = documents(docs).join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(by_piece(bags), "toxic int, words array<string>, counts array<long>").toArrow()
    lists = [pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type) for c in ("words", "counts")]
    return fit(*lists, np.asarray(rows.column("toxic")).astype(np.int64), prior)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", rest: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of every row. Columns named in ``rest`` go along in a struct."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return with_rest(batch, [batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    rows = documents(docs, key, text, rest)
    return rows.mapInArrow(by_piece(run, size=1 << 20), along("doc_id long, score double", rows))
