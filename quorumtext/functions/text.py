"""Column functions over text: tokens, distances, checks and hash splits. Null counts as empty throughout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow

#: Code points of Unicode white space, as str.split() sees them; Java's \s with (?U) lacks the separators U+001C to U+001F.
WHITE = r"(?U)[\s\x1c-\x1f]+"
#: The four letters and eight vowel signs that this manuscript tradition adds to Arabic.
SPECIAL_LETTERS = (0x08A8, 0x08A9, 0x08B3, 0x08BD)
SPECIAL_MARKS = (0x08F5, 0x08F6, 0x08F7, 0x08F8, 0x08F9, 0x08FB, 0x08FC, 0x08FD)
SPECIAL = "".join(map(chr, SPECIAL_LETTERS + SPECIAL_MARKS))
#: Invisible characters that count as characters (joiners and direction marks).
INVISIBLE = "\u200c\u200d\u200e\u200f"


def text(x: Column | str) -> Column:
    """Null as an empty string."""
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def tokens(x: Column | str) -> Column:
    """Words between runs of Unicode white space; none for empty and blank texts."""
    return F.array_remove(F.split(text(x), WHITE), "")


def collapse_spaces(x: Column | str) -> Column:
    """Words joined by single spaces."""
    return F.array_join(tokens(x), " ")


#: Code points of texts that are compared together, in whole words of bits, and lines of a group; longer texts go to Spark's own function.
TOGETHER, GROUP = 256, 1024


def _points(texts: list[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in rows filled up with `blank`, and their lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, sizes.max())), blank, np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def apart(line: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n lines, whether no letter that `a` has beside another one of `b`, or alone, is one that `b` has so.

    a and b are letters side by side, -1 for none, of the lines that `line` tells. Each pair that differs, and each letter alone, is then an edit
    that no way can save, so this way is a cheapest one.
    """
    differ = np.flatnonzero(a != b)
    line, sides = line[differ], (a[differ], b[differ])
    if not len(differ):
        return np.ones(n, bool)
    known, at = np.unique(np.concatenate(sides), return_inverse=True)
    at = at.reshape(2, -1)
    if n * len(known) <= 1 << 26:
        held = np.zeros((2, n, len(known)), bool)
        for k in (0, 1):
            own = sides[k] >= 0
            held[k, line[own], at[k][own]] = True
        return ~(held[0] & held[1]).any(1)
    keys = [line[side >= 0] * len(known) + own[side >= 0] for side, own in zip(sides, at, strict=True)]
    out = np.ones(n, bool)
    out[np.intersect1d(*keys) // len(known)] = False
    return out


#: Letters of texts from which on distance() takes single pairs.
LONG = 512


def distance(a: str, b: str) -> int:
    """Levenshtein distance of one pair, a table's column as the bits of whole numbers (Myers 1999)."""
    if not a or not b:
        return len(a) + len(b)
    equal: dict[str, int] = {}
    for i, c in enumerate(a):
        equal[c] = equal.get(c, 0) | 1 << i
    all_, top = (1 << len(a)) - 1, len(a) - 1
    up, down, found = all_, 0, len(a)
    for c in b:
        e = equal.get(c, 0)
        vertical = e | down
        along = (((e & up) + up) ^ up) | e
        plus, minus = down | (all_ & ~(along | up)), up & along
        found += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = (plus << 1 | 1) & all_, minus << 1 & all_
        up, down = minus | (all_ & ~(vertical | plus)), plus & vertical
    return found


def plain_edits(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What pairs cost as texts that end together, and whether apart() tells that no way costs less."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    columns = sizes.max(1, initial=0)
    line = np.repeat(np.arange(len(a)), columns)
    col = np.arange(len(line)) - np.repeat(np.cumsum(columns) - columns, columns)
    sides = []
    for k, texts in enumerate((a, b)):
        points = np.append(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32), np.int32(-1))
        at = col - (columns - sizes[:, k])[line]
        sides.append(points[np.where(at < 0, -1, at + (np.cumsum(sizes[:, k]) - sizes[:, k])[line])])
    return np.bincount(line[sides[0] != sides[1]], minlength=len(a)), apart(line, *sides, len(a))


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs; only those that plain_edits() leaves open need a table."""
    found, sure = plain_edits(a, b)
    left = np.flatnonzero(~sure).tolist()
    if left:
        found[left] = tabled([a[k] for k in left], [b[k] for k in left])
    return found


def tabled(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs, all pairs one letter of b further at each step.

    A table's column is held as its differences downwards, +1 and -1 as bits of words (Myers 1999); each word takes the
    difference along its upper edge from the word above.
    """
    x, rows = _points(a, 1 << 31)
    y, columns = _points(b, 1 << 30)
    words = -(-x.shape[1] // 64)
    x = np.pad(x, ((0, 0), (0, 64 * words - x.shape[1])), constant_values=1 << 31)
    one, top = np.uint64(1), np.uint64(63)
    up = np.full((words, len(a)), ~np.uint64(0))
    down = np.zeros((words, len(a)), np.uint64)
    last, bit = np.maximum(rows - 1, 0) // 64, (np.maximum(rows - 1, 0) % 64).astype(np.uint64)
    found = rows.copy()
    for j in range(y.shape[1]):
        equal = np.packbits(x == y[:, j, None], axis=1, bitorder="little").view(np.uint64)
        more, less = np.full(len(a), one), np.zeros(len(a), np.uint64)
        for w in range(words):
            e, p, m = equal[:, w], up[w], down[w]
            vertical = e | m
            e = e | less
            along = (((e & p) + p) ^ p) | e
            plus, minus = m | ~(along | p), p & along
            here = (last == w) & (j < columns)
            found += np.where(here, ((plus >> bit) & one).astype(np.int64) - ((minus >> bit) & one).astype(np.int64), 0)
            next_more, next_less = plus >> top, minus >> top
            plus, minus = plus << one | more, minus << one | less
            up[w], down[w] = minus | ~(vertical | plus), plus & vertical
            more, less = next_more, next_less
    return np.where(rows == 0, columns, found)


@arrow("long")
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """distances() of pairs in groups of like length; null where a text is."""
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    a, b = a.to_numpy(), b.to_numpy()
    known = known[np.argsort([len(x) for x in b[known]], kind="stable")]
    worth = True
    for k in range(0, len(known), GROUP):
        own = known[k : k + GROUP]
        x, y = list(a[own]), list(b[own])
        found, sure = plain_edits(x, y) if worth else (np.zeros(len(own), np.int64), np.zeros(len(own), bool))
        worth = worth and sure.mean() > 0.25  # of pairs that need tables, the next ones go to them at once
        left = np.flatnonzero(~sure).tolist()
        if left:
            found[left] = tabled([x[i] for i in left], [y[i] for i in left])
        out[own] = found
    return pd.Series(out).astype("Int64")


def char_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over code points: 0 for equal texts, usual lines compared many at a time, long ones by Spark's own function."""
    a, b = text(a), text(b)
    short = F.greatest(F.length(a), F.length(b)) <= TOGETHER
    some = lambda x: F.when((a != b) & short, x)
    return F.when(a == b, F.lit(0)).when(short, _distances(some(a), some(b))).otherwise(F.levenshtein(a, b)).cast("long")


#: Letters that stand for the tokens of a pair: printable ASCII, then as many code points as a pair of usual lines can need.
LETTERS = "".join(map(chr, [*range(33, 127), *range(0x4E00, 0x4E00 + 1000)]))


def spelled_distance(a: Column | str, b: Column | str, known: Column | str) -> Column:
    """Levenshtein distance over tokens (arrays a and b): each of the pair's distinct tokens, `known`, becomes one letter."""
    a, b, known = (F.col(x) if isinstance(x, str) else x for x in (a, b, known))
    short = lambda t: F.substr(F.lit(LETTERS), F.array_position(known, t).cast("int"), F.lit(1))
    far = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(0x4E00) + F.array_position(known, t)), 4, "0")), "UTF-16BE")
    word = lambda ts, letter: F.array_join(F.transform(ts, letter), "")
    few = F.size(known) <= len(LETTERS)
    return F.when(few, F.levenshtein(word(a, short), word(b, short))).otherwise(F.levenshtein(word(a, far), word(b, far))).cast("long")


def token_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance over tokens. Tokens are bound to a variable, so that they are made once a row."""
    x, y = tokens(a), tokens(b)
    pair = F.array(F.struct(x.alias("x"), y.alias("y"), F.array_distinct(F.concat(x, y)).alias("known")))
    return F.transform(pair, lambda p: spelled_distance(p["x"], p["y"], p["known"]))[0]


def only(x: Column | str, charset: str) -> Column:
    """The characters of x that are in charset."""
    return F.regexp_replace(text(x), "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in charset) + "]", "")


def crc_half(x: Column | str) -> Column:
    """Validation half by CRC-32 of the UTF-8 id: 0 is A, 1 is B."""
    return (F.crc32(F.encode((F.col(x) if isinstance(x, str) else x).cast("string"), "UTF-8")) % 2).cast("int")


def in_part(split: Column | str, id_: Column | str, part: str) -> Column:
    """Whether a row belongs to test, train, valA or valB; another part name is an error."""
    if part in ("test", "train"):
        return F.col(split) == part if isinstance(split, str) else split == part
    if part not in ("valA", "valB"):
        raise ValueError(f"unknown part {part!r}")
    own = F.col(split) if isinstance(split, str) else split
    return (own == "val") & (crc_half(id_) == (0 if part == "valA" else 1))


def percent(x: Column | str) -> Column:
    return F.format_string("%.2f%%", (F.col(x) if isinstance(x, str) else x) * 100)


def padded_confidence(conf: Column | str, of: Column | str) -> Column:
    """Confidences cut or filled with 0.5 to the text's length; null counts as none."""
    have = F.coalesce(F.col(conf) if isinstance(conf, str) else conf, F.array().cast("array<double>"))
    n = F.length(text(of))
    return F.slice(F.concat(have, F.array_repeat(F.lit(0.5), n)), F.lit(1), n)


def output_length(width: Column | str) -> Column:
    """Frames that a recogniser makes of an image of that width."""
    return F.greatest(F.lit(1), F.floor((F.col(width) if isinstance(width, str) else width) / 2)).cast("int")


def to_codec(x: Column | str) -> Column:
    """Spaces as the letter that marks them in sub-word vocabularies."""
    return F.replace(text(x), F.lit(" "), F.lit("▁"))


def from_codec(pieces: Column | str) -> Column:
    """Pieces joined to text: continuation marks dropped, space letters back to spaces."""
    own = F.col(pieces) if isinstance(pieces, str) else pieces
    return F.replace(F.array_join(F.transform(own, lambda p: F.regexp_replace(p, "^##", "")), ""), F.lit("▁"), F.lit(" "))


def first_difference(a: Column | str, b: Column | str) -> Column:
    """1-based position of the first differing character, 0 if the texts are equal."""
    x, y = text(a), text(b)
    same = F.transform(F.arrays_zip(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    return F.when(x == y, F.lit(0)).otherwise(F.array_position(same, False)).cast("int")
