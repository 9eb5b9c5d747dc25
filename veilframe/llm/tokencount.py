"""Token counts under a unigram model, by dynamic programming over a trie.

Distinct words are inserted into a trie. Each node holds the best score of its prefix
and the number of tokens that reach it, worked out once however many words share the
prefix. A word's count is read from its last node.

The pieces come from a public vocabulary file in which they are listed by rank. A piece's
probability follows from its rank by Zipf's law, so nothing is trained.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import on_worker, per_worker, slices

#: Trie nodes, and words with known counts, that a Python worker keeps before it starts afresh.
MAX_NODES, MAX_WORDS = 400_000, 400_000
#: Characters of a word that go into the trie; what is beyond is worked out without it and not kept.
TRIE_DEPTH = 200
WORD_START = "▁"


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> log-probability by rank; control, unknown and byte pieces have none."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    kept.sort(key=lambda i: (-m.get_score(i), i))
    pieces = list(dict.fromkeys(m.id_to_piece(i) for i in kept))
    total = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: -math.log(r + 2) - total for r, p in enumerate(pieces)}


class Trie:
    """Best segmentations of all inserted words' prefixes.

    A character in no piece costs one token a UTF-8 byte, each as unlikely as the rarest
    piece. Of equal scores the one with fewer tokens wins.
    """

    def __init__(self, pieces: dict[str, float]):
        #: Every end of a piece: the piece's score, or None if it is only an end.
        self.ends: dict[str, float | None] = {}
        for p in pieces:
            for k in range(1, len(p)):
                self.ends.setdefault(p[k:], None)
        self.ends.update(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.rarest = min(pieces.values(), default=-1.0)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best = [0.0]
        self.tokens = [0]

    def _step(self, word: str, end: int, best, tokens) -> tuple[float, int]:
        """Score and tokens of ``word[:end]``; ``best[-k]`` and ``tokens[-k]`` are those of the prefix k shorter."""
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        top, least, ends = best[-1] + n * self.rarest, tokens[-1] + n, self.ends
        for k in range(1, min(end, self.longest) + 1):
            p = ends.get(word[end - k : end], 0.0)
            if p is None:
                continue
            if not p:  # no piece ends so
                break
            s, t = best[-k] + p, tokens[-k] + 1
            if s > top or s == top and t < least:
                top, least = s, t
        return top, least

    def insert(self, word: str) -> int:
        """Token count of a word; prefixes seen before are not worked out again."""
        if len(self.best) > MAX_NODES:
            self.clear()
        child, nodes = self.child, 0
        best, tokens = [0.0], [0]
        for end, c in enumerate(word[:TRIE_DEPTH], 1):
            key = nodes << 21 | ord(c)
            found = child.get(key)
            if found is None:
                top, least = self._step(word, end, best, tokens)
                found = child[key] = len(self.best)
                self.best.append(top)
                self.tokens.append(least)
            nodes = found
            best.append(self.best[found])
            tokens.append(self.tokens[found])
        if len(word) > TRIE_DEPTH:
            best, tokens = deque(best, self.longest), deque(tokens, self.longest)
            for end in range(TRIE_DEPTH + 1, len(word) + 1):
                top, least = self._step(word, end, best, tokens)
                best.append(top)
                tokens.append(least)
        return tokens[-1]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each row's whole text.

    Words are runs without ASCII white space, each with a word start before it. Null and
    empty texts have none. A word of any length takes bounded memory beside its text. Repeated rows and null doc_ids count like others; other columns
    are ignored; an empty table gives no rows. There is no shuffle.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        trie, counts = per_worker(("trie", vocabulary_path), lambda: (Trie(vocabulary(on_worker(vocabulary_path))), {}))
        for batch in slices(batches):
            n_words, n_tokens = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                total = 0
                if max(map(len, words), default=0) > TRIE_DEPTH:
                    for w, n in Counter(w for w in words if len(w) > TRIE_DEPTH).items():
                        total += n * trie.insert(WORD_START + w.decode("utf-8", "surrogatepass"))
                    words = [w for w in words if len(w) <= TRIE_DEPTH]
                try:
                    total += sum(map(counts.__getitem__, words))
                except KeyError:
                    if len(counts) > MAX_WORDS:
                        counts.clear()
                    for w in sorted({w for w in words if w not in counts}):
                        counts[w] = trie.insert(WORD_START + w.decode("utf-8", "surrogatepass"))
                    total += sum(map(counts.__getitem__, words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
