"""Byte-level BPE encoding and decoding by a trie that shares prefixes.

Distinct words are walked as a byte trie. A node's state is the last token of the encoding of
its prefix. That token is the one suffix of the prefix which may follow the last token of the
rest: two tokens may stand side by side if no merge rule joins them across their border
before either is used up inside. So a node needs its ancestors alone, prefixes are encoded
once, and a word's ids are read by walking back token by token.

Null text counts as empty: no tokens, and the digests of no bytes. Repeated rows give
repeated results. A stretch of text without a break is one word of any length.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelweft.llm.storage import documents
from panelweft.llm.text import pieces

#: How the vocabulary's own library splits text, and how it spells bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches and token pairs that a worker keeps before it starts anew.
WORDS, NODES = 200_000, 200_000
#: A mark that follows letters is a word by itself.
ENDS = (",", ".", ";", ":", "!", "?")


def byte_names() -> dict[str, int]:
    """Printable stand-ins of bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Trie:
    """Encodes words with the merges of a vocabulary."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.ids = vocab
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for k, v in vocab.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.merge: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (pair if isinstance(pair, list) else pair.split(" "))
            a, b = raw(a), raw(b)
            self.merge[vocab[a] * self.size + vocab[b]] = rank
            parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
        never = len(self.merge) + 1
        self.longest = max(map(len, vocab))
        #: token -> [(edge token, the rank that uses it up)], outermost first.
        self.right, self.left = [()] * self.size, [()] * self.size
        for t in vocab.values():
            for edges, side in ((self.right, 1), (self.left, 0)):
                at, end, out = t, never, []
                while True:
                    out.append((at, end))
                    if at not in parts:
                        break
                    at, end = parts[at][side], parts[at][2]
                edges[t] = tuple(out)
        self.split = regex.compile(SPLIT)
        self.odd = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.sizes = [*map(len, self.bytes)]
        self.body = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths = np.array(self.sizes, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.code = [i.to_bytes(4, "little") for i in range(self.size)]

    def fits(self, a: int, b: int) -> bool:
        """Whether no rule joins across the border of tokens a and b.

        At the border stand, in turn, the edge tokens of a and b, each until its own rank is due.
        Of equal ranks the one further left is due first.
        """
        for x, x_end in self.right[a]:
            for y, y_end in self.left[b]:
                rank = self.merge.get(x * self.size + y)
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word, the words sorted as bytes.

        The sorted list is the depth-first walk of its trie: ``last`` holds the states on the
        path to the present node, and a word starts from the prefix it shares with the one before.
        """
        ids, pairs, size, longest, sizes, code = self.ids, self.pairs, self.size, self.longest, self.sizes, self.code
        last, before, out = [-1], b"", []
        for text in words:
            w = text.encode("utf-8", "surrogatepass")
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for n in range(shared + 1, len(w) + 1):
                for k in range(n - 1, max(-1, n - 1 - longest), -1):
                    t = ids.get(w[k:n])
                    if t is not None:
                        if k == 0:
                            break
                        key = last[k] * size + t
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = self.fits(last[k], t)
                        if fits:
                            break
                last.append(t)
            before, n, found = w, len(w), []
            while n:
                t = last[n]
                found.append(code[t])
                n -= sizes[t]
            found.reverse()
            out.append(b"".join(found))
        return out

    def slow(self, text: str) -> bytes:
        words = self.split.findall(text)
        new = sorted(set(words), key=str.encode)
        have = dict(zip(new, self.encode(new)))
        return b"".join(map(have.__getitem__, words))

    def learn(self, chunks: set[str]) -> None:
        """Encodes what stands between spaces: its words once each, in the trie's order."""
        split = {c: [" " + c] if c.isalpha() else [" " + c[:-1], c[-1]] if c[-1:] in ENDS and c[:-1].isalpha() else self.split.findall(" " + c) for c in chunks}
        new = sorted({w for x in split.values() for w in x}, key=lambda w: w.encode("utf-8", "surrogatepass"))
        have = dict(zip(new, self.encode(new)))
        for c, x in split.items():
            self.words[c] = have[x[0]] if len(x) == 1 else b"".join(map(have.__getitem__, x))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text; the special tokens' strings are those tokens.

        A space between two visible characters always starts a word, so the stretches between such
        spaces are encoded by themselves, and kept; a text with other spacing is split as a whole.
        """
        plain: list[list[str] | None] = []
        new: set[str] = set()
        for x in texts:
            if any(s in x for s in self.special) or any(p in x for p in self.odd):
                plain.append(None)
            else:
                _, *rest = parts = x.split(" ")
                plain.append(parts)
                new.update(rest)
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.pairs) > NODES:
            self.pairs.clear()
        self.learn(new.difference(self.words))
        get = self.words.__getitem__
        return [self.text(x) if p is None else self.slow(p[0]) + b"".join(map(get, p[1:])) for x, p in zip(texts, plain)]

    def text(self, text: str) -> bytes:
        """Little-endian ids of a text; the special tokens' strings are those tokens."""
        for s, i in self.special.items():
            if s in text:
                return np.array([i], "<u4").tobytes().join(self.text(x) if x else b"" for x in text.split(s))
        return self.slow(text)

    def decode(self, ids: list[bytes]) -> list[str]:
        """The text of each row's ids; bytes that aren't UTF-8 become the replacement character."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        long = self.lengths[flat]
        ends = np.cumsum(long)
        body = self.body[np.repeat(self.starts[flat] - ends + long, long) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(path)


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row; ids are little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of the tokenizer file as the executors see it.
    """

    def run(batches):
        t = trie(vocabulary)
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                texts = [x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]
                ids = t.texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(ids, pa.binary()), pa.array(t.decode(ids), pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return documents(docs, key, text).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number of tokens and digests of ``encode``'s ids and decoded text, made where the ids are."""

    def run(batches):
        t = trie(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                ids = t.texts([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()])
                counts, first, second = [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x.encode()) for x in t.decode(ids)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
