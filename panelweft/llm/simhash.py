"""SimHash near-duplicates through an inverted index of positional bytes with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most ``BITS`` = 3
bits share at least ``SHARED`` = 5 of them, and of any seven at least 4. A posting list of a single
byte would hold a 256th of everything, so lists are kept per choice of 4 of the first 7 positions and
their bytes: 35 entries a fingerprint, and whoever meets in a list has shared 4 bytes already. Lists
tally the bytes that two fingerprints share, keep pairs with ``SHARED``, and verify those by their bits.

1. A pass over documents; equal fingerprints are one node from here on.
2. Lists of up to ``LIST`` nodes are searched whole. Longer ones are dealt to parts by a hash of node
   and list, so other lists deal the same nodes to other parts; each part is searched by itself.
   Lists give spanning trees of their links, never all pairs. Components follow.
3. A long list may still hold links between its components. All its nodes outside its largest component
   (most long lists have none) meet all its nodes, part by part; the further links join components.
   So no link is lost, whatever the length of a list.

A document's words are runs other than ASCII white space, A-Z lower-cased; its shingles are 3 words
joined by one space, repeats included; a document of fewer words has one shingle of them all; one
without words, or null, has the fingerprint zero and is linked like any other. A row without doc_id has
a fingerprint and links, but is no one's component_id (null if it meets rows without doc_id alone).
Rows that repeat a doc_id are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.neardup import components, tree
from panelweft.llm.storage import documents, kept
from panelweft.llm.text import by_piece, flat

SEED, WIDTH, BITS, SHARED = 42, 3, 3, 5
LIST = 512
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Signed masks of 4 of the first 7 bytes.
MASKS = [int(np.uint64(sum(0xFF << 8 * b for b in four)).astype(np.int64)) for four in combinations(range(1, 8), 4)]


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each shingle of lower-cased UTF-8 text."""
    words = text.split()  # bytes: ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return np.array([digest(joined, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.append(0, end[:-1] + 1)
    spans = zip(begin[: len(words) - WIDTH + 1].tolist(), end[WIDTH - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - WIDTH + 1)


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[i : i + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, print) with the fingerprint as a signed integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        body, offsets = flat(batch.column("text"))
        at = offsets.tolist()
        prints = np.array([fingerprint(body[a:b].tobytes().lower()) for a, b in zip(at, at[1:])], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return rows.mapInArrow(by_piece(run), "doc_id long, print long")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which fingerprints of two arrays are linked: tally of shared bytes, then bits."""
    differ = a ^ b
    tally = (differ[..., None].view(np.uint8) == 0).sum(-1)
    out = tally >= SHARED
    out[out] = np.bitwise_count(differ[out]) <= BITS
    return out


def lists_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of whole lists from rows sorted by (key, part); a list is never larger than its cell."""
    held = None
    for b in batches:
        now = {c: np.asarray(b.column(c)) for c in columns}
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in columns}
        n = len(held["key"])
        if not n:
            continue
        new = np.flatnonzero((held["key"][1:] != held["key"][:-1]) | (held["part"][1:] != held["part"][:-1]))
        if len(new):
            yield {c: held[c][: new[-1] + 1] for c in columns}
            held = {c: held[c][new[-1] + 1 :] for c in columns}
    if held is not None and len(held["key"]):
        yield held


def links(rows: DataFrame) -> DataFrame:
    """Spanning trees (a, b) of the links in each part of each list; with ``side`` only links between the sides, and of ``root`` only between different ones."""
    columns = [c for c in ("key", "part", "print", "side", "root") if c in rows.columns]
    sided = "side" in columns

    def run(batches):
        for run_ in lists_of(batches, columns):
            key, part, prints = run_["key"], run_["part"], run_["print"].view(np.uint64)
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            size = np.diff(np.append(first, len(key)))
            out = []
            if not sided:
                pair = first[size == 2]
                a, b = prints[pair], prints[pair + 1]
                linked = near(a, b)
                out.append((a[linked], b[linked]))
            for i, n in zip(*(x[size > (1 if sided else 2)].tolist() for x in (first, size))):
                own = prints[i : i + n]
                if sided:
                    side, root = run_["side"][i : i + n], run_["root"][i : i + n]
                    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    for x in right.tolist():
                        others = left[root[left] != root[x]]
                        hit = others[near(own[others], own[x])]
                        # one link is enough for each component that x meets
                        _, at = np.unique(root[hit], return_index=True)
                        out.append((np.full(len(at), own[x]), own[hit[at]]))
                else:
                    found = tree(near(own[:, None], own), n)
                    if found:
                        a, b = np.array(found).T
                        out.append((own[a], own[b]))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.select(*columns).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long")


def parted(column: str):
    """The part of a node in a list with ``column`` nodes."""
    return F.pmod(F.xxhash64("print", "key"), F.ceil(F.col(column) / LIST)).cast("int")


def join_prints(prints: DataFrame) -> DataFrame:
    """(print, root): the component of each of the distinct fingerprints that has a link."""
    mask = F.explode(F.array(*(F.lit(m).cast("long") for m in MASKS))).alias("mask")
    index = prints.select("print", mask).select("print", F.xxhash64("mask", F.col("print").bitwiseAND(F.col("mask"))).alias("key"))
    long_ = kept(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LIST), "long")
    if long_.isEmpty():
        return components(links(index.withColumn("part", F.lit(0)))).withColumnRenamed("id", "print")
    part = F.when(F.col("n").isNull(), 0).otherwise(parted("n"))
    found = kept(links(index.join(long_, "key", "left").withColumn("part", part)), "links")
    label = components(found).withColumnRenamed("id", "print")

    nodes = kept(index.join(long_, "key").join(label, "print", "left").select("key", "n", "print", F.coalesce("root", "print").alias("root")), "nodes")
    largest = nodes.groupBy("key", "root").agg(F.count("*").alias("size"), F.first("n").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("size", "root")).alias("most"), F.max("size").alias("size"), F.max("n").alias("n"))
    split = largest.where("size < n").select("key", "most", (F.col("n") - F.col("size")).alias("strays"))
    nodes = nodes.join(split, "key")

    def meets(other: str):
        return F.explode(F.sequence(F.lit(0), F.ceil(F.col(other) / LIST).cast("int") - 1))

    of_list, of_strays = F.ceil(F.col("n") / LIST).cast("int"), F.ceil(F.col("strays") / LIST).cast("int")
    all_ = nodes.withColumn("cell", meets("strays")).withColumn("part", parted("n") * of_strays + F.col("cell")).withColumn("side", F.lit(0))
    strays = nodes.where("root != most").withColumn("cell", meets("n")).withColumn("part", F.col("cell") * of_strays + parted("strays")).withColumn("side", F.lit(1))
    columns = ["key", "part", "print", "side", "root"]
    further = links(all_.select(*columns).unionByName(strays.select(*columns)))
    return components(found.unionByName(further)).withColumnRenamed("id", "print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest doc_id that links lead to."""
    rows = kept(fingerprints(documents(docs, key, text)), "prints")
    prints = kept(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    root = prints.join(join_prints(prints), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = root.groupBy("root").agg(F.min("least").alias("component_id"))
    known = root.select("print", "root").join(least, "root").select("print", "component_id")
    return rows.join(known, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
