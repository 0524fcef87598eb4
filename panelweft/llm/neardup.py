"""N-gram Jaccard join by chosen paths.

A document's set is its windows of ``SHINGLE`` words. Copies (the same words in the same order) are
one class, and only classes are joined. Each class becomes a set of ``T`` tokens (i, i-th minimum of
a hash over its windows); two sets share a token with the probability of their similarity.

A run starts with all sets in one bucket. A bucket is split on one or two coordinates sampled by its
own path, so on average 1 / threshold branches lead on, and sets with the same token there stay
together. Buckets of one set end; small ones are compared pair by pair on their tokens; large ones
are split again, up to ``DEPTH`` times, and what is still large then is compared in blocks. A pair at
the threshold is missed by all runs with the chance ``missed``, in the mean over the agreement of its
tokens; ``RUNS`` is the least number of runs for which that is less than 1 - ``RECALL``.

Buckets only say which classes belong together: each yields a spanning tree of its likely pairs, and
connected trees are components. Within a component every pair is checked once against its whole
sets, so the links are exact; large components are checked in blocks of ``SPLIT`` by ``SPLIT``.

Words are runs of characters other than ASCII white space; of fewer than ``SHINGLE`` words the whole is
one window. Null, empty and wordless texts are one class, without links. Rows without doc_id take no
part: class, group and links are null. Rows that share a doc_id count as one document that has the
links of all its texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.storage import documents, kept
from panelweft.llm.text import Words, by_piece, mix, window_starts, windows

SHINGLE, THRESHOLD, T, LIMIT, DEPTH, SPLIT, RECALL = 5, 0.8, 48, 256, 3, 1024, 0.999
#: A split takes one coordinate, and a second one of a quarter of the buckets: 1 / THRESHOLD on average.
SECOND = 1 / THRESHOLD - 1


def missed(runs: int, similarity: float = THRESHOLD) -> float:
    """Chance that no run holds a pair together over DEPTH splits. All runs sample the same T tokens, so it is the mean over how many of them agree."""
    out = 0.0
    for k in range(T + 1):
        apart = 1 - k / T
        survival = 1 - apart * (1 - SECOND + SECOND * apart)
        out += math.comb(T, k) * similarity**k * (1 - similarity) ** (T - k) * (1 - survival**DEPTH) ** runs
    return out


RUNS = next(r for r in range(1, 1000) if missed(r) < 1 - RECALL)
#: Shared tokens from which a pair counts as likely: a pair at the threshold falls below with a chance of some millionths.
LIKELY = math.ceil(T * THRESHOLD - 4.5 * math.sqrt(T * THRESHOLD * (1 - THRESHOLD)))


def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hashes, row of each, hash of each row's words in order); a row's windows may repeat."""
    w = Words(column)
    hashes, counts = w.hashes(), w.counts()
    at, row = window_starts(counts, SHINGLE)
    h = windows(hashes, SHINGLE)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    few = np.array([mix(np.bitwise_xor.reduce(mix(hashes[a:b] + np.arange(1, b - a + 1, dtype=np.uint64)))[None])[0] for a, b in zip(w.first[short], w.first[short + 1])], np.uint64)
    order = np.argsort(np.append(row, short), kind="stable")
    h, row = np.append(h, few)[order], np.append(row, short)[order]
    place = np.arange(len(w)) - np.repeat(w.first[:-1], counts)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(mix(hashes ^ mix(place.astype(np.uint64) + np.uint64(77))), out=total[1:])
    return h, row, total[w.first[1:]] - total[w.first[:-1]]


def tokens(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """T minima of each row's windows; rows without windows get zeros."""
    out = np.zeros((n, T), "<u4")
    if len(h):
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        for t in range(T):
            odd = np.uint64(int(mix(np.array([t + 1], np.uint64))[0]) | 1)
            out[row[start], t] = (np.minimum.reduceat((h ^ (h >> np.uint64(29))) * odd, start) >> np.uint64(32)).astype(np.uint32)
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, kind1, kind2, full, tokens): the class of each document and its token set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, row, whole = sets(batch.column("text"))
        n = batch.num_rows
        sig = tokens(h, row, n)
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(5)), out=total[1:])
        edge = np.searchsorted(row, np.arange(n + 1))
        second = total[edge[1:]] - total[edge[:-1]]
        raw = sig.tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(whole.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.diff(edge) > 0), pa.array([raw[4 * T * i : 4 * T * (i + 1)] for i in range(n)], pa.binary())],
            names=["doc_id", "kind1", "kind2", "full", "tokens"],
        )

    return docs.mapInArrow(by_piece(run), "doc_id long, kind1 long, kind2 long, full boolean, tokens binary")


def branch(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, child paths) of sets at their paths: each path samples its coordinates itself."""
    rows, out = [], []
    at = np.arange(len(path))
    for turn in (1, 2):
        pick = mix(path ^ np.uint64(0x1234567 * turn))
        on = at if turn == 1 else at[(mix(path + np.uint64(99)) >> np.uint64(40)) < np.uint64(SECOND * (1 << 24))]
        i = (pick[on] % np.uint64(T)).astype(np.int64)
        rows.append(on)
        out.append(mix(path[on] * np.uint64(0x9E3779B97F4A7C15) + sig[on, i].astype(np.uint64) * np.uint64(256) + i.astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(out)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), T)


def split(batches):
    """Children of each row (id, path, tokens) as (path, id)."""
    for b in batches:
        sig = signatures(b.column("tokens"))
        path = np.asarray(b.column("path")).view(np.uint64)
        rows, child = branch(path, sig)
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("id").take(pa.array(rows))], names=["path", "id"])


def roots(batches):
    """Children of the root of every run."""
    for b in batches:
        sig = signatures(b.column("tokens"))
        for r in range(RUNS):
            rows, child = branch(np.full(len(sig), mix(np.array([r + 1], np.uint64))[0], np.uint64), sig)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("id").take(pa.array(rows))], names=["path", "id"])


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tree(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of an n by n matrix of pairs, whose diagonal may be set."""
    left, out = np.ones(n, bool), []
    for s in range(n):
        if left[s]:
            left[s] = False
            front = [s]
            while front:
                x = front.pop()
                new = np.flatnonzero(pairs[x] & left)
                left[new] = False
                out += [(x, y) for y in new.tolist()]
                front += new.tolist()
    return out


def likely(group: pa.Table) -> pa.Table:
    """Spanning trees (a, b) of the likely pairs of each bucket's sets; side 0 meets side 1, or itself if there is none."""
    path, ids, side = (np.asarray(group.column(c)) for c in ("path", "id", "side"))
    sig = signatures(group.column("tokens").combine_chunks()) if group.num_rows else np.zeros((0, T), "<u4")
    order = np.lexsort((ids, side, path))
    path, ids, side, sig = path[order], ids[order], side[order], sig[order]
    cut = np.append(np.flatnonzero(np.append(True, path[1:] != path[:-1])), len(path)).tolist()
    out = set()
    for i, j in zip(cut, cut[1:]):
        if j - i == 2:
            if (sig[i] == sig[i + 1]).sum() >= LIKELY and ids[i] != ids[i + 1]:
                out.add((int(ids[i]), int(ids[i + 1])))
            continue
        s = sig[i:j]
        same = np.zeros((j - i, j - i), np.uint8)
        for t in range(T):
            same += s[:, t, None] == s[:, t]
        near = same >= LIKELY
        if side[j - 1]:
            near &= side[i:j, None] != side[i:j]
        out.update((int(ids[i + a]), int(ids[i + b])) for a, b in tree(near, j - i))
    out = [x for x in out if x[0] != x[1]]
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def blocks(rows: DataFrame, n: str, part: str, size: int) -> DataFrame:
    """Rows of groups with more than ``size`` rows, dealt so that each two rows of a group meet in one cell: adds ``cell`` and ``side``.

    A group of k parts has a cell for each two parts and for each part with itself.
    """
    parts = F.ceil(F.col(n) / size).cast("int")
    own = F.pmod(F.xxhash64(part), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    return (
        rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", other)
        .withColumn("cell", F.least("own", "other") * F.col("parts") + F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("parts", "own", "other")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each id's component. Labels fall along edges and jump along labels until none changes."""
    both = kept(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct(), "edges")
    label = kept(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("root")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("root").alias("least"))
        fell = label.join(near, "id").select("id", F.least("root", "least").alias("new"), "root")
        up = label.select(F.col("id").alias("new"), F.col("root").alias("far"))
        jumped = kept(fell.join(up, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("root"), (F.col("root") != F.least("new", F.coalesce("far", "new"))).alias("changed")), "labels")
        label = jumped.select("id", "root")
        if not jumped.where("changed").limit(1).count():
            return label


def checked(group: pa.Table) -> pa.Table:
    """Links between whole sets: per class their number (b null), and spanning trees (a, b)."""
    root, ids, side = (np.asarray(group.column(c)) for c in ("root", "id", "side"))
    order = np.lexsort((ids, side, root))
    texts = group.column("text").combine_chunks()
    texts = (texts.take(pa.array(order)) if len(order) else texts)
    root, ids, side = root[order], ids[order], side[order]
    cut = np.append(np.flatnonzero(np.append(True, root[1:] != root[:-1])), len(root)).tolist()
    out: list[tuple] = []
    for i, j in zip(cut, cut[1:]):
        h, row, whole = sets(texts.slice(i, j - i))
        pair = np.unique(np.stack([row.astype(np.uint64), h]), axis=1) if len(h) < 64 else _distinct(row, h)
        row, h = pair[0].astype(np.int64), pair[1]
        size = np.bincount(row, minlength=j - i)
        # windows that several sets have, as columns
        by = np.argsort(h, kind="stable")
        h, row = h[by], row[by]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(h)))
        keep = np.repeat(times > 1, times)
        column = np.cumsum(np.repeat(np.arange(len(times)), times)[keep] != np.append(-1, np.repeat(np.arange(len(times)), times)[keep][:-1])) - 1 if keep.any() else np.zeros(0, np.int64)
        row = row[keep]
        shared = np.zeros((j - i, j - i), np.float32)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
            a, b = np.searchsorted(column, (c, c + 1024))
            has = np.zeros((j - i, 1024), np.float32)
            has[row[a:b], column[a:b] - c] = 1
            shared += has @ has.T
        near = shared >= THRESHOLD * (size[:, None] + size - shared) - 1e-4
        near &= (size[:, None] > 0) & (size > 0) & (ids[i:j, None] != ids[i:j])
        # repeated rows of a class count once
        again = np.zeros(j - i, bool)
        again[1:] = (ids[i + 1 : j] == ids[i : j - 1]) & (whole[1:] == whole[:-1])
        near[again], near[:, again] = False, False
        if side[j - 1]:
            near &= side[i:j, None] != side[i:j]
        out += [(int(x), None, int(k)) for x, k in zip(ids[i:j], near.sum(1)) if k]
        out += [(int(ids[i + a]), int(ids[i + b]), 0) for a, b in tree(near, j - i)]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], names=["a", "b", "n"])


def _distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
    return row[new], h[new]


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, group_id) of every row.

    class_id is the smallest doc_id of the same words, n_links the number of other classes with a
    similarity of ``THRESHOLD`` or more, group_id the smallest class_id that links lead to.
    """
    spark = docs.sparkSession
    width = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs, key, text)
    each = kept(features(rows.where("doc_id is not null")), "features")
    classes = kept(each.groupBy("kind1", "kind2", "full", "tokens").agg(F.min("doc_id").alias("id")), "classes")
    joined = classes.where("full").select("id", "tokens")

    def meet(paths: DataFrame) -> DataFrame:
        """(path, id, n, tokens) of the buckets with several sets."""
        paths = paths.distinct()
        many = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        return kept(paths.join(many, "path").join(joined, "id"), "buckets")

    found = None
    level = meet(joined.mapInArrow(roots, "path long, id long"))
    for depth in range(1, DEPTH + 1):
        large = F.col("n") > LIMIT
        small = level.where(~large).withColumn("side", F.lit(0)).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(width)))
        trees = small.groupBy("bucket").applyInArrow(likely, "a long, b long")
        found = trees if found is None else found.unionByName(trees)
        rest = level.where(large)
        if depth == DEPTH:
            cells = blocks(rest, "n", "id", SPLIT)
            found = found.unionByName(cells.groupBy("path", "cell").applyInArrow(likely, "a long, b long"))
        else:
            level = meet(rest.select("path", "id", "tokens").mapInArrow(split, "path long, id long"))

    label = components(found)
    size = label.groupBy("root").agg(F.count("*").alias("n"))
    member = label.join(size, "root")
    # merged at every size: how many documents have a neighbour grows with the corpus
    texts = rows.join(member.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id").select("root", "n", F.col("doc_id").alias("id"), "text")
    small = texts.where(F.col("n") <= SPLIT).withColumn("side", F.lit(0)).withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(4 * width)))
    cells = blocks(texts.where(F.col("n") > SPLIT), "n", "id", SPLIT)
    links = "a long, b long, n long"
    links = kept(small.groupBy("bucket").applyInArrow(checked, links).unionByName(cells.groupBy("root", "cell").applyInArrow(checked, links)), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    group = components(links.where("b is not null").select("a", "b"))
    known = classes.select("kind1", "kind2", "id").join(counts, "id", "left").join(group, "id", "left").select("kind1", "kind2", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("group_id"))
    return each.select("doc_id", "kind1", "kind2").join(known, ["kind1", "kind2"], "left").select("doc_id", "class_id", "n_links", "group_id").unionByName(
        rows.where("doc_id is null").select("doc_id", *(F.lit(None).cast("long").alias(c) for c in ("class_id", "n_links", "group_id")))
    )
