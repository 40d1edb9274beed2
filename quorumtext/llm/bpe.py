"""Byte-level BPE encoding and decoding by traversal of a trie that shares prefixes.

The encoding of a prefix is fixed by its last token: with the longest token that ends the prefix
and agrees with the last token of what stands before it. So the distinct words are put into a trie,
each node keeps the last token of its path's encoding, and a depth-first pass derives every
node from its ancestors. A prefix that many words share is encoded once; a word's tokens are read
back from its node by jumping from last token to last token.

Two neighbouring tokens agree if merging by rank leaves their border alone, which undoing the two
tokens' own merges from the latest to the earliest tells without encoding anything.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed values of the file format: the pattern that cuts texts into words.
WORDS = r""" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that are letters or numbers only in later versions of Unicode than 16.0, which the
#: tokenizers library cuts by, as (first, last).
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Finished words and trie nodes that a worker keeps between batches before it starts anew.
MAX_WORDS, MAX_NODES = 200_000, 100_000
#: Bytes of the paths that many words share, which are kept while they are few.
SHORT_PATH = 5
#: Bytes of the longest word whose prefixes become nodes, which bounds the nodes' bytes too. Longer words
#: pass the same recurrence over their positions, and are forgotten with their batch.
MAX_PATH = 64


def byte_letters() -> dict[str, int]:
    """The letter that the file format writes for each byte: printable ones stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, their merges and the special tokens of a tokenizer file."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            left, right, both = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = rank
            if both not in self.halves:
                self.halves[both], self.made_at[both] = (left, right), rank
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        #: Every end of a token, with the token it is or -1. Tokens that no merge makes stand in no encoding.
        self.pieces = {b[k:]: -1 for b in self.ids for k in range(len(b))} | {b: i for b, i in self.ids.items() if len(b) == 1 or i in self.halves}
        self.agreed: dict[tuple[int, int], bool] = {}

    def agree(self, left: int, right: int) -> bool:
        """Whether `left`, `right` stay as they are when their bytes are encoded together."""
        if (known := self.agreed.get((left, right))) is None:
            if len(self.agreed) > 500_000:
                self.agreed.clear()
            known = self.agreed[left, right] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        """Undo the later merge of the two at the border until none is left; a merge across it must not have come first.

        A pair across the border comes before the last undone merge if its rank is lower, or if it is
        the same merge and stands further left, which holds where the right token was undone.
        """
        limit, ties = len(self.rank), False
        while True:
            across = self.rank.get((left, right))
            if across is not None and (across < limit or ties and across == limit):
                return False
            at_left, at_right = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                limit, ties, left = at_left, False, self.halves[left][1]
            else:
                limit, ties, right = at_right, True, self.halves[right][0]


class Trie:
    """Distinct words as paths of bytes; `last` has the last token of each path's encoding.

    A node is known by the bytes of its path. `seen` has every finished word: its ids in decimal,
    joined by commas, and the bytes that they decode to, None for the word's own.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.last: dict[bytes, int] = {}
        self.seen: dict[str, tuple[str, bytes | None]] = {}
        self.long: list[str] = []

    def add(self, distinct: set[str]) -> None:
        """Encode the words that are new. Past their limits, finished words and open paths are forgotten."""
        for name in self.long:
            self.seen.pop(name, None)
        self.long.clear()
        if len(self.seen) > MAX_WORDS:
            self.seen.clear()
        v, last, seen = self.vocabulary, self.last, self.seen
        pieces, rank, agreed = v.pieces, v.bytes, v.agreed
        for name in sorted(distinct.difference(seen)):  # sorted words visit the trie depth first
            word = name.encode()
            size = depth = len(word)
            if size > MAX_PATH:
                self.long.append(name)
                seen[name] = self._spelled(self._alone(word), word)
                continue
            if len(last) > MAX_NODES:
                short = {path: token for path, token in last.items() if len(path) <= SHORT_PATH}
                last.clear()
                if len(short) < MAX_NODES // 2:
                    last.update(short)
            while depth and word[:depth] not in last:
                depth -= 1
            while depth < size:
                depth += 1
                found = []
                for start in range(depth - 1, -1, -1):
                    token = pieces.get(word[start:depth])
                    if token is None:
                        break
                    if token >= 0:
                        found.append((start, token))
                while True:
                    start, token = found.pop()
                    if not start:
                        break
                    before = last[word[:start]]
                    if (known := agreed.get((before, token))) is None:
                        known = v.agree(before, token)
                    if known:
                        break
                last[word[:depth]] = token
            ids = []
            while size:
                token = last[word[:size]]
                ids.append(token)
                size -= len(rank[token])
            ids.reverse()
            seen[name] = self._spelled(ids, word)

    def _spelled(self, ids: list[int], word: bytes) -> tuple[str, bytes | None]:
        rank = self.vocabulary.bytes
        decoded = b"".join([rank[i] for i in ids])
        return ",".join(map(str, ids)), None if decoded == word else decoded

    def _alone(self, word: bytes) -> list[int]:
        """Ids of one word by the last tokens of its positions: four bytes for each of the word's."""
        v = self.vocabulary
        pieces = v.pieces
        last = array("i", bytes(4 * (len(word) + 1)))
        for depth in range(1, len(word) + 1):
            found = []
            for start in range(depth - 1, -1, -1):
                token = pieces.get(word[start:depth])
                if token is None:
                    break
                if token >= 0:
                    found.append((start, token))
            while True:
                start, token = found.pop()
                if not start or v.agree(last[start], token):
                    break
            last[depth] = token
        ids, size = [], len(word)
        while size:
            ids.append(last[size])
            size -= len(v.bytes[last[size]])
        ids.reverse()
        return ids


class Words:
    """Cuts texts into words as the library does: code points that became letters or numbers later are neither."""

    def __init__(self) -> None:
        import regex

        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER)
        self.later = regex.compile(f"[{later}]")
        self.plain = regex.compile(WORDS)
        # Without later code points both patterns cut alike; the plain one is faster.
        kinds = WORDS.replace(r"[^\s\p{L}\p{N}]", "[^LN]").replace(r"\p{L}", f"[\\p{{L}}--[{later}]]").replace(r"\p{N}", f"[\\p{{N}}--[{later}]]")
        self.exact = regex.compile(kinds.replace("[^LN]", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{later}])"), regex.V1)

    def findall(self, text: str) -> list[str]:
        pattern = self.plain if text.isascii() or not self.later.search(text) else self.exact
        return pattern.findall(text)


@cache
def loaded(spec: str) -> tuple[Vocabulary, Trie, object, object]:
    """Once for each worker: the vocabulary, its trie and the two patterns."""
    import regex

    v = Vocabulary(json.loads(spec))
    marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
    return v, Trie(v), Words(), marks


def encode_words(texts: list[str | None], spec: str) -> Iterator[tuple[str, bytes]]:
    """For each text its ids in decimal, joined by commas, and the bytes that they decode to; special tokens' strings become their ids."""
    v, trie, pattern, marks = loaded(spec)
    cut: list[list[str]] = []
    for text in texts:
        if marks and text and marks.search(text):
            cut.append([w for i, part in enumerate(marks.split(text)) for w in ([part] if i % 2 else pattern.findall(part))])
        else:
            cut.append(pattern.findall(text or ""))
    trie.add(set().union(*cut).difference(v.special))
    seen = trie.seen
    special = {s: (str(i), None) for s, i in v.special.items()}
    for pieces in cut:
        found = [seen[p] if p in seen else special[p] for p in pieces] if special.keys() & pieces else [seen[p] for p in pieces]
        ids = ",".join([ids for ids, _ in found])
        if any([decoded is not None for _, decoded in found]):
            yield ids, b"".join([p.encode() if decoded is None else decoded for p, (_, decoded) in zip(pieces, found, strict=True)])
        else:
            yield ids, "".join(pieces).encode()


def encode_texts(texts: list[str | None], spec: str) -> list[list[int]]:
    """Ids of each text; a null text has none."""
    return [[int(i) for i in ids.split(",")] if ids else [] for ids, _ in encode_words(texts, spec)]


def decode_ids(ids: list[int], spec: str) -> str:
    """The text of ids, bytes that are no UTF-8 as U+FFFD; ids out of the vocabulary are left out."""
    v = loaded(spec)[0]
    return b"".join([v.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _in_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and about `size` characters, but of a row at least."""
    for batch in batches:
        begin, load = 0, 0
        lengths = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > begin and (i - begin >= rows or load + n > size):
                yield batch.slice(begin, i - begin)
                begin, load = i, 0
            load += n
        if batch.num_rows > begin:
            yield batch.slice(begin)


def tokenizer_spec(path: str) -> str:
    """The tokenizer file's text, read on the driver; tasks get it with the code (about 1.5 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, round_trip): ids of every whole text as an array of int, and whether they decode to the text.

    Null and empty texts have an empty array, which decodes to an empty text. Null keys stay, repeated
    rows give repeated rows, an empty table gives an empty one; columns other than key and text are
    ignored. Rows never leave their partition.
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_batches(batches, 1000, 1 << 20):
            texts = b.column(1).to_pylist()
            joined, same = [], []
            for body, (ids, decoded) in zip(texts, encode_words(texts, spec.value), strict=True):
                joined.append(ids)
                same.append(decoded == (body or "").encode())
            sizes = [j.count(",") + 1 if j else 0 for j in joined]
            flat = np.fromstring(",".join(filter(None, joined)), dtype=np.int32, sep=",")
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(same)], ["key", "ids", "round_trip"])

    out = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return out.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids array<int>, round_trip boolean").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of every array of ids. Null arrays give null; an empty array gives an empty text."""
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if row is None else decode_ids(row, spec.value) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = df.select(df[key].alias("key"), df[ids].cast("array<int>").alias("ids"))
    return out.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text encoded and decoded again, in one pass.

    The ids' digest is of decimal numbers joined by commas, the text's of its UTF-8. Cases as for encode().
    """
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_batches(batches, 1000, 1 << 20):
            n, a, d = [], [], []
            for ids, decoded in encode_words(b.column(1).to_pylist(), spec.value):
                n.append(ids.count(",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids.encode()).hexdigest())
                d.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return out.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
