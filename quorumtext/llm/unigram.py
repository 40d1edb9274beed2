"""Token counts under a unigram vocabulary, by dynamic programming over a trie of pre-tokens.

Pre-tokens are runs of text that begin at white space. The best segmentation of a prefix depends on
the prefix alone, so the distinct pre-tokens are inserted into a trie and each node gets the score
and the token count of the best way to reach it, from its ancestors; a prefix that many pre-tokens
share is scored once. The nodes where pre-tokens end keep their counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value of the file format: the letter that stands for a space.
SPACE = "▁"
#: Finished pre-tokens and trie nodes that a worker keeps between batches.
MAX_WORDS, MAX_NODES = 700_000, 700_000
#: Characters of the longest pre-token whose prefixes become nodes, which bounds the nodes' bytes too.
#: Longer ones pass the same recurrence over a window of the longest piece, and are forgotten with their batch.
MAX_PATH = 64
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: A batch's rows are counted in slices of so many characters.
SLICE = 4 << 20


def scores(pieces: list[tuple[str, int]]) -> dict[str, float]:
    """Log probabilities by Zipf's law over the pieces' ranks: the file's own scores give their order only."""
    order = sorted(pieces, key=lambda p: p[1])
    total = sum(1 / (i + 1) for i in range(len(order)))
    return {p: -math.log((i + 1) * total) for i, (p, _) in enumerate(order)}


class Trie:
    """Prefixes of pre-tokens with the (score, tokens) of their best segmentation.

    Of equally good segmentations the one with fewer tokens counts. A character that no piece covers
    costs one token for each of its UTF-8 bytes, each scored below every piece.
    """

    def __init__(self, logp: dict[str, float]):
        self.logp = logp
        self.window = max(map(len, logp), default=0) + 1
        self.ends = {p[k:] for p in logp for k in range(len(p))}
        self.byte = min(logp.values(), default=0.0) - 10.0
        self.best: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        self.counts: dict[str, int] = {}
        self.long: list[str] = []

    def add(self, distinct: set[str]) -> None:
        """Count the pre-tokens that are new; sorted order visits the trie depth first."""
        for word in self.long:
            self.counts.pop(word, None)
        self.long.clear()
        if len(self.counts) > MAX_WORDS:
            self.counts.clear()
        best, logp, ends = self.best, self.logp, self.ends
        for word in sorted(distinct.difference(self.counts)):
            depth = len(word)
            if depth > MAX_PATH:
                self.long.append(word)
                self.counts[word] = self._alone(word)
                continue
            if len(best) > MAX_NODES:
                best.clear()
                best[""] = 0.0, 0
            while word[:depth] not in best:
                depth -= 1
            while depth < len(word):
                depth += 1
                size = len(word[depth - 1].encode())
                s, n = best[word[: depth - 1]]
                s, n = s + size * self.byte, n + size
                for start in range(depth - 1, -1, -1):
                    piece = word[start:depth]
                    if piece not in ends:
                        break
                    if (p := logp.get(piece)) is not None:
                        s0, n0 = best[word[:start]]
                        if s0 + p > s or s0 + p == s and n0 + 1 < n:
                            s, n = s0 + p, n0 + 1
                best[word[:depth]] = s, n
            self.counts[word] = best[word][1]

    def _alone(self, word: str) -> int:
        """Tokens of one pre-token; no piece reaches back further than the window."""
        logp, ends = self.logp, self.ends
        window = self.window
        scores_, tokens = [0.0] * window, [0] * window
        for depth in range(1, len(word) + 1):
            size = len(word[depth - 1].encode())
            s, n = scores_[(depth - 1) % window] + size * self.byte, tokens[(depth - 1) % window] + size
            for start in range(depth - 1, -1, -1):
                piece = word[start:depth]
                if piece not in ends:
                    break
                if (p := logp.get(piece)) is not None:
                    s0, n0 = scores_[start % window], tokens[start % window]
                    if s0 + p > s or s0 + p == s and n0 + 1 < n:
                        s, n = s0 + p, n0 + 1
            scores_[depth % window], tokens[depth % window] = s, n
        return tokens[len(word) % window]


@cache
def loaded(path_bytes: bytes) -> Trie:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=path_bytes)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
    return Trie(scores([(sp.id_to_piece(i), rank) for rank, i in enumerate(ranked)]))


def pretokens(text: str | None) -> list[str]:
    """Runs that begin with the spaces before them; a text begins with one space more, a null text has none."""
    return _PRETOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def count_texts(texts: list[str | None], trie: Trie) -> list[tuple[int, int]]:
    """(tokens, pre-tokens) of each text."""
    cut = [pretokens(t) for t in texts]
    trie.add(set().union(*cut))
    counts = trie.counts
    return [(sum([counts[p] for p in pieces]), len(pieces)) for pieces in cut]


def token_counts(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_pretokens, n_chars, n_bytes) of every whole text.

    Null and empty texts have zeros. Null keys stay, repeated rows give repeated rows, an empty table
    gives an empty one; other columns are ignored. Rows never leave their partition.
    """
    with open(path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # about half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = loaded(model.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n: list[tuple[int, int]] = []
            begin = load = 0
            for i, t in enumerate(texts):
                load += len(t or "")
                if load >= SLICE or i + 1 == len(texts):
                    n += count_texts(texts[begin : i + 1], trie)
                    begin, load = i + 1, 0
            columns = [[x[0] for x in n], [x[1] for x in n], [len(t or "") for t in texts], [len((t or "").encode()) for t in texts]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["key", "n_tokens", "n_pretokens", "n_chars", "n_bytes"])

    own = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    kind = df.schema[key].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, n_tokens long, n_pretokens long, n_chars long, n_bytes long").withColumnRenamed("key", key)
