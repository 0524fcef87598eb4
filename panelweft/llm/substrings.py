"""Substring dedup on the De Bruijn graph of word windows.

An edge of the graph is a window of ``width`` consecutive words (its ends are the windows of one
word less). Three joins find what to remove:

1. Edges meet by their hash. Each task first settles what its own run of documents can tell: an
   edge that a smaller document of the run has needs no further look, so a window that many
   documents share leaves each run once. Of an edge's documents the smallest is its source; every
   other occurrence becomes (document, position) -> (source, position).
2. These meet by document. Neighbouring edges whose sources are neighbours too don't branch: they
   compact into one path, a long repeated span with its place in the document and in the source.
3. Paths and the places asked of sources meet the texts. Both sides hash their words independently
   of step 1, and a path whose hash differs from its source's is refused.

Rows travel as packed arrays, one row per task and bucket. Edge hashes have 56 bits within a bucket;
a collision can't remove anything, as the path is refused, and could only keep a window that is due.

Words are runs of characters other than ASCII white space. Null or empty texts have no words. Rows
without a doc_id are left whole and are no one's source. Rows that share a doc_id don't remove each
other's words and are told apart by a 16-bit checksum of their texts. Documents shorter than a
window have none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.storage import along, documents, kept, with_rest
from panelweft.llm.text import Words, by_piece, cover, mix, window_starts, windows

RUN = 3 << 20
_STEP = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(0xA24BAED4963EE407, -1, 1 << 64))


def pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), kind)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


#: Occurrences as columns: doc, tag, pos and the source's src, src_tag, src_pos.
COLUMNS = ("doc", "tag", "pos", "src", "src_tag", "src_pos")


def pack_moves(m: dict[str, np.ndarray]) -> bytes:
    """Occurrences in order of document and position; small differences pack well."""
    parts = [pack(_steps(m["doc"].astype("<i8"))), pack(m["tag"].astype("<u2")), pack(_steps(m["pos"].astype("<i4"))), pack(_steps(m["src"].astype("<i8"))), pack(m["src_tag"].astype("<u2")), pack(_steps((m["src_pos"] - m["pos"]).astype("<i4")))]
    return np.array([len(m["doc"]), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_moves(blob: bytes) -> dict[str, np.ndarray]:
    n, *sizes = np.frombuffer(blob[:28], "<u4").tolist()
    at, parts = 28, []
    for size, kind in zip(sizes, ("<i8", "<u2", "<i4", "<i8", "<u2", "<i4")):
        parts.append(unpack(blob[at : at + size], n, kind))
        at += size
    doc, tag, pos, src, src_tag, lean = parts
    pos = np.cumsum(pos, dtype=np.int64)
    return {"doc": np.cumsum(doc), "tag": tag, "pos": pos, "src": np.cumsum(src), "src_tag": src_tag, "src_pos": pos + np.cumsum(lean, dtype=np.int64)}


def merged(many: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([m[c] for m in many]) for c in COLUMNS}


def by_source(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, place in it of each occurrence's source): the smallest (doc, pos, tag) of its hash.

    The input is in order of document and position.
    """
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return order, np.repeat(start, np.diff(np.append(start, len(h))))


def buckets_of(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def moves_rows(m: dict[str, np.ndarray], n: int) -> list[tuple[int, bytes]]:
    """Occurrences dealt by document, in order."""
    to = buckets_of(m["doc"], n)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n + 1))
    return [(b, pack_moves({c: m[c][order[i:j]] for c in COLUMNS})) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]


EDGE = "bucket int, settled boolean, n int, docs int, hash binary, doc binary, tag binary, times binary, pos binary, moves binary"
EDGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("n", pa.int32()), ("docs", pa.int32()), *((c, pa.binary()) for c in ("hash", "doc", "tag", "times", "pos", "moves"))])


def edges(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Packed edges of each task's runs of documents by bucket; ``settled`` rows hold occurrences whose source lies in the run."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, known = np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_valid())
        tags = np.asarray(batch.column("tag")).astype(np.uint16)
        w = Words(batch.column("text"))
        at, row = window_starts(w.counts(), width)
        h = windows(w.hashes(), width)[at] if len(at) else np.zeros(0, np.uint64)
        pos = at - w.first[row]
        use = known[row]
        h, row, pos = h[use], row[use], pos[use]
        by_doc = np.lexsort((tags, ids))
        rank = np.empty(len(ids), np.int64)
        rank[by_doc] = np.arange(len(ids))
        order = np.argsort(rank[row], kind="stable")
        h, row, pos = h[order], row[order], pos[order]
        doc, tag = ids[row], tags[row]
        sorted_, first = by_source(h, doc, tag, pos)
        source = np.empty(len(h), np.int64)
        source[sorted_] = sorted_[first]
        moved = doc > doc[source]
        out: list[list] = []
        if moved.any():
            m = {"doc": doc[moved], "tag": tag[moved], "pos": pos[moved], "src": doc[source[moved]], "src_tag": tag[source[moved]], "src_pos": pos[source[moved]]}
            out += [[b, True, None, None, None, None, None, None, None, x] for b, x in moves_rows(m, buckets)]
        stay = ~moved
        h, doc, tag, pos = h[stay], doc[stay], tag[stay], pos[stay]
        to = (mix(h ^ np.uint64(0x5BF03635)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cut, cut[1:])):
            if j > i:
                s = order[i:j]
                d, t, p = doc[s], tag[s], pos[s]
                new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
                step = np.diff(p, prepend=0)
                step[new] = p[new]
                key = np.ascontiguousarray(h[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
                out.append([b, False, j - i, len(new), key, pack(_steps(d[new])), t[new].tobytes(), pack(np.diff(np.append(new, j - i)).astype("<u4")), pack(step.astype("<u4")), None])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), EDGE_SCHEMA)] if out else [pa.array([], f.type) for f in EDGE_SCHEMA], schema=EDGE_SCHEMA)

    return docs.mapInArrow(by_piece(run, size=RUN), EDGE)


def occurrences(packed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, moves) dealt by document: edges meet by hash, and all but the smallest document's occurrences get a source."""

    def run(group: pa.Table) -> pa.Table:
        out = [(r["bucket"], r["moves"]) for r in group.filter(group.column("settled")).select(["bucket", "moves"]).to_pylist()]
        hs, docs, tags, ps = [], [], [], []
        for r in group.filter(pc.invert(group.column("settled"))).to_pylist():
            n, k = r["n"], r["docs"]
            raw = np.zeros((n, 8), np.uint8)
            raw[:, :7] = np.frombuffer(r["hash"], np.uint8).reshape(n, 7)
            hs.append(raw.view("<u8").ravel())
            times = unpack(r["times"], k, "<u4")
            docs.append(np.repeat(np.cumsum(unpack(r["doc"], k, "<i8")), times))
            tags.append(np.repeat(np.frombuffer(r["tag"], "<u2"), times))
            step = unpack(r["pos"], n, "<u4").astype(np.int64)
            total, start = np.cumsum(step), np.cumsum(times) - times
            ps.append(total - np.repeat(total[start] - step[start], times))
        if hs:
            h = np.concatenate(hs)
            del hs
            order = np.argsort(h, kind="stable")
            h = h[order]
            twin = np.append(h[1:] == h[:-1], False)
            order = order[twin | np.append(False, twin[:-1])]  # only hashes that come twice
            doc, tag, pos = (np.concatenate(x)[order] for x in (docs, tags, ps))
            h = h[twin | np.append(False, twin[:-1])]
            by_doc = np.lexsort((pos, tag, doc))
            h, doc, tag, pos = h[by_doc], doc[by_doc], tag[by_doc], pos[by_doc]
            sorted_, first = by_source(h, doc, tag, pos)
            source = np.empty(len(h), np.int64)
            source[sorted_] = sorted_[first]
            moved = doc > doc[source]
            if moved.any():
                m = {"doc": doc[moved], "tag": tag[moved], "pos": pos[moved], "src": doc[source[moved]], "src_tag": tag[source[moved]], "src_pos": pos[source[moved]]}
                out += moves_rows(m, buckets)
        return pa.table([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "moves"])

    return packed.groupBy("bucket").applyInArrow(run, "bucket int, moves binary")


PATH = "doc_id long, tag int, start array<int>, length array<int>, src array<long>, src_tag array<int>, src_start array<int>, asked_start array<int>, asked_length array<int>"


def paths(moved: DataFrame) -> DataFrame:
    """One row per document with its compacted paths, or with the places that other documents' paths ask of it.

    A path of ``length`` edges starts at word ``start`` of the document and ``src_start`` of its source.
    """

    def run(group: pa.Table) -> pa.Table:
        m = merged([unpack_moves(x.as_py()) for x in group.column("moves")])
        order = np.lexsort((m["pos"], m["tag"], m["doc"]))
        m = {c: m[c][order] for c in COLUMNS}
        same = lambda c, d=0: m[c][1:] - m[c][:-1].astype(m[c].dtype) == d
        follows = same("doc") & same("tag") & same("pos", 1) & same("src") & same("src_tag") & same("src_pos", 1)
        start = np.flatnonzero(np.append(True, ~follows))
        length = np.diff(np.append(start, len(order)))
        p = {c: m[c][start] for c in COLUMNS}
        new = np.flatnonzero(np.append(True, (p["doc"][1:] != p["doc"][:-1]) | (p["tag"][1:] != p["tag"][:-1])))
        lists = lambda x, t, cut: pa.ListArray.from_arrays(pa.array(np.append(cut, len(x)).astype(np.int32)), pa.array(x, t))
        none = lambda n, t: pa.nulls(n, pa.list_(t))
        i, long = pa.int32(), pa.int64()
        own = pa.table(
            [pa.array(p["doc"][new], long), pa.array(p["tag"][new].astype(np.int32)), lists(p["pos"], i, new), lists(length, i, new), lists(p["src"], long, new), lists(p["src_tag"].astype(np.int32), i, new), lists(p["src_pos"], i, new), none(len(new), i), none(len(new), i)],
            names=[x.split(" ")[0] for x in PATH.split(", ")],
        )
        order = np.lexsort((length, p["src_pos"], p["src_tag"], p["src"]))
        a = [x[order] for x in (p["src"], p["src_tag"].astype(np.int64), p["src_pos"], length)]
        once = np.append(True, np.any([x[1:] != x[:-1] for x in a], axis=0))
        a = [x[once] for x in a]
        new = np.flatnonzero(np.append(True, (a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1])))
        asked = pa.table(
            [pa.array(a[0][new], long), pa.array(a[1][new].astype(np.int32)), *(none(len(new), t) for t in (i, i, long, i, i)), lists(a[2], i, new), lists(a[3], i, new)], schema=own.schema
        )
        return pa.concat_tables([own, asked])

    return moved.groupBy("bucket").applyInArrow(run, PATH)


def span_hashes(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words a..b of each span, independent of the edges' hashes."""
    words = mix(w.hashes(911) ^ np.uint64(0xC0FFEE1234567))
    n = len(words)
    up, down = np.full(n + 1, _STEP, np.uint64), np.full(n + 1, _BACK, np.uint64)
    up[0] = down[0] = 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * np.cumprod(up)[:n], out=total[1:])
    return mix((total[b] - total[a]) * np.cumprod(down)[a] + (b - a).astype(np.uint64))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column; null lists are empty."""
    n = np.asarray(pc.fill_null(pa.compute.list_value_length(column), 0))
    return np.asarray(column.flatten()).astype(np.int64), np.repeat(np.arange(len(column)), n)


def dedup(docs: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", rest: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row, the text being the kept words joined by one space.

    A word goes if it lies in a window of ``width`` words that also starts in a document with a smaller
    doc_id, all judged on the input. Columns named in ``rest`` go along in a struct. ``buckets`` deal the
    edges, by default two for each shuffle partition; one should hold some millions of words at most.
    """
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs, key, text, rest).withColumn("tag", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 16)).cast("int"))
    found = paths(occurrences(edges(rows.select("doc_id", "text", "tag"), width, buckets), buckets))
    lists = ["start", "length", "src", "src_tag", "src_start", "asked_start", "asked_length"]
    found = kept(
        found.groupBy("doc_id", "tag").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists)), "paths"
    )  # one list of paths per document, and at most one of asked places per bucket
    whole = rows.join(found, ["doc_id", "tag"], "left")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists_ = [pc.fill_null(pc.list_value_length(batch.column(c)), 0) for c in ("start", "asked_start")]
        batch = batch.filter(pc.greater(pc.add(*lists_), 0))
        w = Words(batch.column("text"))
        start, row = _flat(batch.column("start"))
        length = _flat(batch.column("length"))[0]
        a = w.first[row] + start
        own = span_hashes(w, a, a + length + width - 1)
        asked, asked_row = _flat(batch.column("asked_start"))
        size = _flat(batch.column("asked_length"))[0]
        b = w.first[asked_row] + asked
        fits = b + size + width - 1 <= w.first[asked_row + 1]  # always, unless a checksum misled
        once = np.unique(np.stack([asked_row, asked, size, b])[:, fits], axis=1)  # several buckets may ask for one place
        asked_row, asked, size, b = once
        there = span_hashes(w, b, b + size + width - 1)
        ids, tags = np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("tag")).astype(np.int64)
        col = lambda x, y: np.concatenate([x, y])
        src, src_tag, src_start = (_flat(batch.column(c))[0] for c in ("src", "src_tag", "src_start"))
        return pa.RecordBatch.from_arrays(
            [pa.array(col(np.ones(len(a), bool), np.zeros(len(b), bool))), pa.array(col(src, ids[asked_row])), pa.array(col(src_tag, tags[asked_row]).astype(np.int32)), pa.array(col(src_start, asked).astype(np.int32)), pa.array(col(length, size).astype(np.int32)),
             pa.array(col(own, there).view(np.int64)), pa.array(col(ids[row], 0 * b)), pa.array(col(tags[row], 0 * b).astype(np.int32)), pa.array(col(start, 0 * b).astype(np.int32))],
            names=["path", "src", "src_tag", "src_start", "length", "hash", "doc_id", "tag", "start"],
        )

    # both uses of the texts read the same rows, so that they are shuffled once
    sides = whole.mapInArrow(by_piece(check), "path boolean, src long, src_tag int, src_start int, length int, hash long, doc_id long, tag int, start int")
    place = ["src", "src_tag", "src_start", "length"]
    refused = (
        sides.where("path").drop("path").join(sides.where("not path").select(*place, F.col("hash").alias("there")), place, "left")
        .where("there is null or there != hash").groupBy("doc_id", "tag").agg(F.collect_list("start").alias("refused"))
    )

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = Words(batch.column("text"))
        start, row = _flat(batch.column("start"))
        length = _flat(batch.column("length"))[0]
        bad, bad_row = _flat(batch.column("refused"))
        if len(bad):
            good = ~np.isin(row * (1 << 32) + start, bad_row * (1 << 32) + bad)
            start, row, length = start[good], row[good], length[good]
        gone = cover(w.first[row] + start, length + width - 1, len(w))
        # kept words and one space after each; a row's last space goes
        keep = np.flatnonzero(~gone)
        size = w.end[keep] - w.begin[keep] + 1
        stop = np.cumsum(size)
        n_kept = np.searchsorted(keep, w.first)
        body = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
        src = np.repeat(w.begin[keep] - (stop - size), size) + np.arange(len(body))
        inside = np.ones(len(body), bool)
        inside[stop - 1] = False
        body[inside] = w.body[src[inside]]
        ends = np.append(0, stop)[n_kept]
        raw = body.tobytes()
        texts = [raw[i : max(i, j - 1)] for i, j in zip(ends.tolist(), ends[1:].tolist())]
        removed = w.counts() - np.diff(n_kept)
        return with_rest(batch, [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(w.counts().astype(np.int64)), pa.array(removed.astype(np.int64))], ["doc_id", "text", "n_words", "n_removed"])

    return whole.join(refused, ["doc_id", "tag"], "left").mapInArrow(by_piece(remove), along("doc_id long, text string, n_words long, n_removed long", rows))
