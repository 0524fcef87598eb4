"""Token counts of a unigram model by forward scores over a trie.

A text is cut before every space into pre-tokens, each with the mark "▁" for the space before it; a
text that doesn't start with a space gets a mark too.
Distinct pre-tokens are walked as a trie, in sorted order. A node's state is the best score of any
segmentation of its prefix into pieces, with the number of tokens that it has; it needs the states of
its ancestors alone, so a prefix that several pre-tokens share is scored once. At a pre-token's end the
count is stored, and a text's count is the sum over its pre-tokens.

The pieces come from a vocabulary file. It stores ranks, not probabilities: a piece of rank r scores
log(1 / (r + 1)), up to a constant. A character without a piece scores ``UNKNOWN`` less than the worst
piece and counts as many tokens as it has bytes in UTF-8. Of equal scores the longer last piece wins.

Null and empty texts have no tokens. Runs of spaces give marks of their own. Repeated rows give
repeated results.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from panelweft.llm.storage import documents
from panelweft.llm.text import pieces

MARK, UNKNOWN = "▁", 10.0
#: Pre-tokens that a worker keeps before it starts anew.
WORDS = 250_000


class Model:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        #: How long pieces that end with a character can be.
        self.lengths: dict[str, list[int]] = {}
        for p in scores:
            self.lengths.setdefault(p[-1], []).append(len(p))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}
        self.counts: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        """Counts of new pre-tokens, in the order of their trie."""
        scores, lengths, unknown, counts = self.scores, self.lengths, self.unknown, self.counts
        best, many, before = [0.0], [0], ""
        for w in sorted(words):
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], many[shared + 1 :]
            for n in range(shared + 1, len(w) + 1):
                c = w[n - 1]
                top, count = -math.inf, 0
                for k in lengths.get(c, ()):
                    if k > n:
                        break
                    s = scores.get(w[n - k : n])
                    if s is not None and (s := best[n - k] + s) >= top:
                        top, count = s, many[n - k] + 1
                if c not in scores and best[n - 1] + unknown > top:
                    top, count = best[n - 1] + unknown, many[n - 1] + len(c.encode("utf-8", "surrogatepass"))
                best.append(top)
                many.append(count)
            before = w
            counts[w] = many[-1]

    def texts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        parts = [Counter(x.replace(" ", MARK).removeprefix(MARK).split(MARK)) if x else None for x in texts]
        new = {w for p in parts if p for w in p}.difference(self.counts)
        if len(self.counts) + len(new) > WORDS:
            self.counts.clear()
            new = {w for p in parts if p for w in p}
        if new:
            marked = Model.__new__(Model)
            marked.__dict__.update(self.__dict__)
            marked.counts = {}
            marked.learn({MARK + w for w in new})
            self.counts.update((w[1:], n) for w, n in marked.counts.items())
        return [(sum(self.counts[w] * n for w, n in p.items()), p.total()) if p else (0, 0) for p in parts]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    use = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return Model({m.id_to_piece(i): -math.log(r + 1) for r, i in enumerate(use, 1)})


def count(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) of every row. ``vocabulary`` is the piece file's path as the executors see it."""

    def run(batches):
        m = model(vocabulary)
        for batch in batches:
            for a, b in pieces(batch.column("text")):
                found = m.texts([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return documents(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")
