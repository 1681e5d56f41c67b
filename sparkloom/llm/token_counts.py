"""Unigram token counts by dynamic programming over a trie of distinct pre-tokens.

Each worker keeps a trie of the pre-tokens its rows hold. A node stands for a prefix; it stores
the best log-probability of any segmentation of that prefix into vocabulary pieces and the
number of pieces of that segmentation, worked out once when the node is made. Where a
pre-token ends, its count is the node's.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bpe import tokenizer_path
from sparkloom.llm.common import arrow_schema, utf8_bytes

MARK = "▁"
#: Pre-tokens of more characters are scored alone, so that a trie's depth stays bounded.
LONGEST = 64
#: Nodes of a worker's trie; at this number it starts again.
MOST_NODES = 1_000_000


def zipf_scores(n: int) -> list[float]:
    """Log-probabilities of n pieces by rank, in proportion to 1 / (rank + 2.7); they sum to 1."""
    total = math.log(math.fsum(1 / (r + 2.7) for r in range(n)))
    return [-math.log(r + 2.7) - total for r in range(n)]


@lru_cache(maxsize=1)
def pieces(path: str) -> tuple[dict[str, float], float]:
    """The vocabulary's normal pieces with a log-probability each, by rank, and the one of a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = zipf_scores(len(normal))
    return dict(zip(normal, scores, strict=True)), scores[-1] - 10.0


class Trie:
    """Forward scores of prefixes. A node is [score, pieces, children or None, longest end that starts a piece]."""

    def __init__(self, vocabulary: dict[str, float], byte_score: float) -> None:
        self.byte_score = byte_score
        self.vocabulary = vocabulary
        # every start of a piece; its value, made when first needed, is the pieces that end with it: (length, log-probability)
        self.starts: dict[str, tuple | None] = dict.fromkeys((p[:k] for p in vocabulary for k in range(len(p) + 1)), None)
        self.made = 0
        self.root: list = [0.0, 0, {}, ""]
        self.ends: dict[bytes, tuple[int, float]] = {}

    def _extend(self, path: list, word: str, i: int) -> list:
        """The node of word[: i + 1], given those of its prefixes in path.

        Equal scores: fewer pieces. A character that no piece covers costs its UTF-8 bytes.
        """
        starts, ch = self.starts, word[i]
        end = path[i][3] + ch
        while end not in starts:
            end = end[1:]
        found = starts[end]
        if found is None:
            ends = [(k, self.vocabulary.get(end[len(end) - k :])) for k in range(1, len(end) + 1)]
            found = starts[end] = tuple(e for e in ends if e[1] is not None)
        top, n = -math.inf, 0
        if not found or found[0][0] > 1:  # a piece of this character alone is always better than its bytes
            size = len(ch.encode())
            top, n = path[i][0] + size * self.byte_score, path[i][1] + size
        for k, score in found:
            before = path[i + 1 - k]
            total = before[0] + score
            if total > top or (total == top and before[1] < n - 1):
                top, n = total, before[1] + 1
        return [top, n, None, end]

    def count(self, raw: bytes) -> tuple[int, float]:
        """Pieces and log-probability of a pre-token, given without its mark as UTF-8."""
        found = self.ends.get(raw)
        if found is not None:
            return found
        word = MARK + raw.decode()
        if len(word) > LONGEST:
            path = [[0.0, 0, None, ""]]
            for i in range(len(word)):
                path.append(self._extend(path, word, i))
            return path[-1][1], path[-1][0]
        if self.made > MOST_NODES:
            self.root, self.made = [0.0, 0, {}, ""], 0
            self.ends = {}
        node, path = self.root, [self.root]
        for i, ch in enumerate(word):
            child = node[2].get(ch) if node[2] else None
            if child is None:
                if node[2] is None:
                    node[2] = {}
                child = node[2][ch] = self._extend(path, word, i)
                self.made += 1
            node = child
            path.append(node)
        found = self.ends[raw] = (node[1], node[0])
        return found


@lru_cache(maxsize=1)
def trie(path: str) -> Trie:
    return Trie(*pieces(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, score: pieces of each text and their log-probability.

    Pre-tokens are words between ASCII white space, each with a leading mark. Null and empty texts
    have no words, no tokens and score 0. Repeated rows get equal values; no row is dropped.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")
    schema, arrow = arrow_schema("doc_id long, n_words long, n_tokens long, score double")

    def count(batches):
        t = trie(model)
        for batch in batches:
            words, tokens, scores = [], [], []
            for data in utf8_bytes(batch.column(1)):
                counts = Counter(data.split())
                n = total = 0
                parts = []
                for w, k in counts.items():
                    c, s = t.count(w)
                    n, total = n + k, total + c * k
                    parts.append(s * k)
                words.append(n)
                tokens.append(total)
                scores.append(math.fsum(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())], schema=arrow)

    def run(batches):
        gc.disable()  # a trie has no cycles, and looking for them takes a third of the time
        try:
            yield from count(batches)
        finally:
            gc.enable()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
