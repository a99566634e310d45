"""Token counts of a unigram vocabulary by dynamic programming shared along a trie of distinct words."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumtext.llm.arrow import frame, segments

#: SentencePiece's mark at the start of a word.
MARK = "▁"
#: Cost of each byte of a character that no piece covers.
BYTE_SCORE = -20.0


def piece_scores(path: str) -> dict[str, float]:
    """Piece -> score of a SentencePiece file.  Its rank r scores -log(r + 2), the rank-frequency law; control and
    byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return {p: -math.log(r + 2) for r, p in enumerate(plain)}


class Trie:
    """Nodes are prefixes; each holds the forward score of its prefix and the tokens on the best path to it.  Words
    that share a prefix share its scores."""

    def __init__(self, scores: Mapping[str, float], most_nodes: int = 600_000, long_word: int = 200):
        #: every ending of a piece, with the piece's score where it is one
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))}
        self.endings.update(scores)
        self.most_nodes, self.long_word = most_nodes, long_word
        self.nodes: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        self.ends: dict[bytes, int] = {}

    def _node(self, path: list[tuple[float, int]], word: str, at: int) -> tuple[float, int]:
        """Best (score, tokens) of word[:at] from the nodes of the shorter prefixes; ties take fewer tokens."""
        score, tokens = path[at - 1]
        size = 1 if word[at - 1] < "\x80" else len(word[at - 1].encode())
        score, tokens = score + BYTE_SCORE * size, tokens + size
        endings, start = self.endings, at - 1
        while start >= 0:
            part = word[start:at]
            if part not in endings:
                break
            own = endings[part]
            if own is not None:
                before, count = path[start]
                if before + own > score or before + own == score and count + 1 < tokens:
                    score, tokens = before + own, count + 1
            start -= 1
        return score, tokens

    def insert(self, raw: bytes) -> int:
        word = MARK + raw.decode("utf-8", "replace")
        if len(word) > self.long_word:  # not kept: its prefixes are shared by nothing
            path = [(0.0, 0)]
            for at in range(1, len(word) + 1):
                path.append(self._node(path, word, at))
            return path[-1][1]
        if len(self.nodes) > self.most_nodes:  # memory stays bounded; dropped prefixes are computed again
            self.nodes = {"": (0.0, 0)}
        path = []
        for at in range(len(word) + 1):
            node = self.nodes.get(word[:at])
            if node is None:
                node = self.nodes[word[:at]] = self._node(path, word, at)
            path.append(node)
        return path[-1][1]

    def count(self, words: list[bytes]) -> int:
        ends = self.ends
        new = set(words).difference(ends)
        if len(ends) + len(new) > self.most_nodes:
            ends.clear()
            new = set(words)
        for word in sorted(new):
            ends[word] = self.insert(word)
        return sum(map(ends.__getitem__, words))


def token_counts(docs: DataFrame, scores: Mapping[str, float], block: int = 100_000) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row's whole text under the unigram `scores`.

    Pre-tokens are runs without ASCII white space, each with the word mark before it.  A word's count is the number
    of pieces on its best-scoring path, fewer pieces on ties; a character that no piece covers costs its UTF-8 bytes.
    Each task keeps one bounded trie over the distinct pre-tokens it meets; nothing is shuffled.  Null and empty
    texts count 0; repeated rows each keep their row; other columns of `docs` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dict(scores))  # the vocabulary: bounded by its file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for batch in batches:
            for part in segments(batch):
                words, tokens = [], []
                for text in part.column("text").to_pylist():
                    found = (text or "").encode().split()
                    words.append(len(found))
                    tokens.append(sum(trie.count(found[i : i + block]) for i in range(0, len(found), block)))
                yield frame({"doc_id": (part.column("doc_id"), None), "n_words": (words, pa.int64()), "n_tokens": (tokens, pa.int64())})

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
