"""Cheapest alignments of texts with columns of texts, in memory that grows with a line's length and not its square.

A profile is an array (members, columns) of code points, -1 for a gap. A column costs the share of its members
that differ from the character put in it, or from a gap; a column of its own costs a character 1. Among
equal ways the one back from the end takes the diagonal before a gap in the sequence and that before a new
column. Short lines are aligned together over whole tables. For a long one only diagonals near the straight way are
searched, widened until no cheaper way can leave them, and its table is divided at a middle row: a sweep
carries to its end where the way it would go back crosses that row, so both halves keep the whole table's choices.
"""

from __future__ import annotations

import numpy as np

from ..functions.text import LONG, apart, distance, distances

GAP = -1
#: Cells of a table that lines of like length share in one pass, about; longer lines are aligned by `divided`.
CELLS = 4_000_000
#: Moves that one part of a divided table keeps at most, about, and the first width of the searched diagonals.
PART, BAND = 64_000_000, 64


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


def cost_bounds(profile: np.ndarray, seq: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each line the cost of its cheapest alignment whose steps without a partner are side by side; no cheapest one costs more.

    profile is (lines, members, columns), seq (lines, characters); a line's own are the first `size` columns and `length` characters.
    """
    lines, members, columns = profile.shape
    least, row = np.minimum(size, length), np.arange(lines)[:, None]
    t = np.arange(int(least.max(initial=0)))
    inside = t < least[:, None]

    def along(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        off = np.zeros(inside.shape)
        chars = seq[row, np.where(inside, j, 0)] if len(t) else off
        for m in range(members):
            off += profile[row, m, np.where(inside, i, 0)] != chars if len(t) else 0
        return np.concatenate([np.zeros((lines, 1)), np.cumsum(np.where(inside, off / members, 0.0), 1)], 1)

    left = along(t[None], t[None])
    right = along((size - least)[:, None] + t, (length - least)[:, None] + t)
    up = np.concatenate([np.zeros((lines, 1)), np.cumsum((profile != GAP).sum(1) / members, 1)], 1)
    s = np.minimum(np.arange(len(t) + 1), least[:, None])
    gaps = up[row, s + (size - least)[:, None]] - up[row, s] + (length - least)[:, None]
    return (left + gaps + right[:, -1:] - right)[row, s].min(1)


def tables(profile: np.ndarray, seq: np.ndarray, size: np.ndarray | None = None, length: np.ndarray | None = None, band: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(moves[anti-diagonal, line, place], lowest column of each anti-diagonal) of the cheapest alignments of many lines: 0 diagonal, 1 column without a character, 2 a new column.

    profile is (lines, members, columns), seq (lines, characters). All lines advance together, one anti-diagonal at a time,
    no farther than `band` from the straight ways to their ends, if it is given.
    """
    lines, members, columns = profile.shape
    n = seq.shape[1]
    size, length = (np.full(lines, whole) if own is None else own for own, whole in ((size, columns), (length, n)))
    band = columns + n if band is None else band
    low, high = min(0, int((size - length).min())) - band, max(0, int((size - length).max())) + band  # of column - character
    profile = np.pad(profile, ((0, 0), (0, 0), (1, 0)), constant_values=GAP)
    seq = np.pad(seq, ((0, 0), (1, 0)), constant_values=GAP)
    up = (profile != GAP).sum(1) / members
    width, pad = min(columns, n, (high - low) // 2 + 1) + 1, 3
    moves = np.zeros((columns + n + 1, lines, width), dtype=np.int8)
    begin = np.zeros(columns + n + 1, np.int64)
    before, last, own = (np.full((lines, width + 2 * pad), np.inf) for _ in range(3))  # cell i of its anti-diagonal at i - begin + pad
    for d in range(columns + n + 1):
        lo, hi = max(0, d - n, -((-d - low) // 2)), min(columns, d, (d + high) // 2)
        begin[d] = lo
        k = hi - lo + 1
        own.fill(np.inf)
        if d == 0:
            own[:, pad] = 0.0
        elif k > 0:
            # Cells of a table's edge read characters and columns that are not there, beside cells of infinite cost.
            chars = seq[:, d - hi : d - lo + 1][:, ::-1]
            off = np.zeros(chars.shape)
            for m in range(members):
                off += profile[:, m, lo : hi + 1] != chars
            at = lo - 1 - int(begin[d - 2]) + pad if d > 1 else 0
            best = before[:, at : at + k] + off / members if d > 1 else np.full(chars.shape, np.inf)
            at = lo - int(begin[d - 1]) + pad
            down = last[:, at - 1 : at - 1 + k] + up[:, lo : hi + 1]
            kind = (down < best).view(np.int8)
            best = np.minimum(best, down)
            new = last[:, at : at + k] + 1.0
            longer = new < best
            kind[longer] = 2
            moves[d, :, :k] = kind
            own[:, pad : pad + k] = np.minimum(best, new)
        before, last, own = last, own, before
    return moves, begin


def _steps_back(table: tuple[np.ndarray, np.ndarray], size: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, characters, counts) of all lines' ways through their tables(), -1 where a step has none."""
    moves, begin = table
    row = np.arange(len(size))
    i, j = size.astype(np.int64), length.astype(np.int64)
    steps = []
    while (i + j > 0).any():
        move = moves[i + j, row, i - begin[i + j]]
        open_ = i + j > 0
        i, j = i - (open_ & (move != 2)), j - (open_ & (move != 1))
        steps.append((np.where(open_ & (move != 2), i, -1), np.where(open_ & (move != 1), j, -1), open_))
    count = sum((o for _, _, o in steps), np.zeros(len(size), dtype=np.int64))
    width = len(steps)
    column, character = (np.stack([s[k] for s in steps], 1) if steps else np.zeros((len(size), 0), np.int64) for k in (0, 1))
    order = np.clip(count[:, None] - 1 - np.arange(width), 0, None)  # steps went from the end
    return np.take_along_axis(column, order, 1), np.take_along_axis(character, order, 1), count


def _together(profile: np.ndarray, seq: np.ndarray, size: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_steps_back() of many lines, those whose ways need a like band in one pass.

    A way that leaves the straight one by k columns has at least k steps without a partner, of 1 / members each at least, so no cheapest way
    leaves the band that the bound of its cost allows; its moves are those of the whole table.
    """
    lines, members, columns = profile.shape
    bands = (cost_bounds(profile, seq, size, length) * members + 1e-6).astype(np.int64) + 1
    least = np.minimum(size - length, 0), np.maximum(size - length, 0)
    order = np.lexsort((least[1] - least[0], bands))
    found, at = [], 0
    while at < lines:
        top = 2 * int(bands[order[at]]) + 4
        own = order[at : at + 1024]
        own = own[bands[own] <= top]
        room = (int(bands[own].max()) * 2 + int(least[1][own].max() - least[0][own].min())) // 2 + 2
        own = own[: max(1, CELLS // ((columns + seq.shape[1] + 1) * min(room, columns + 1)))]
        n, c = int(length[own].max()), int(size[own].max())
        found.append((own, *_steps_back(tables(profile[own][:, :, :c], seq[own][:, :n], size[own], length[own], int(bands[own].max())), size[own], length[own])))
        at += len(own)
    width = max(f[1].shape[1] for f in found)
    column, character, count = np.full((lines, width), -1, np.int64), np.full((lines, width), -1, np.int64), np.zeros(lines, np.int64)
    for own, a, b, k in found:
        column[own, : a.shape[1]], character[own, : b.shape[1]], count[own] = a, b, k
    return column, character, count


# --- one long line --------------------------------------------------------------------------------


class _Sweep:
    """One pass over the anti-diagonals of a part of a table, no farther than `band` from its straight way.

    `end` is the cost of its last cell, starting from `base`. With `keep`, moves are kept by
    anti-diagonal; with `middle`, `crossing` is the character at which the way back from the end first stands on that row,
    and `there` the cost of that cell. Sums are made in the same order as over the whole table, so they are equal to the last bit.
    """

    def __init__(self, profile: np.ndarray, up: np.ndarray, seq: np.ndarray, base: float, band: int, keep: bool = False, middle: int | None = None):
        members, columns = profile.shape
        n = len(seq)
        low, high = min(0, columns - n) - band, max(0, columns - n) + band  # of column - character
        before, last, own = (np.full(columns + 3, np.inf) for _ in range(3))  # cell i at i + 1, with one beyond each end
        cross = [np.zeros(columns + 3, np.int64) for _ in range(3)]
        row = np.full(n + 1, np.inf)
        self.kept: list[tuple[int, np.ndarray]] = []
        for d in range(columns + n + 1):
            lo, hi = max(0, d - n, -((-d - low) // 2)), min(columns, d, (d + high) // 2)
            a, b = lo + 1, hi + 2  # places of the cells lo to hi
            own[a - 1], own[b] = np.inf, np.inf
            kind = np.full(hi - lo + 1, 2, np.int8)
            if d == 0:
                own[1] = base
            else:
                # Diagonals of a table's edge read characters and columns that are not there, beside cells of infinite cost.
                i = slice(max(lo, 1), min(hi, d - 1) + 1)
                best = np.full(hi - lo + 1, np.inf)
                if i.start < i.stop:
                    chars = seq[d - i.stop : d - i.start][::-1]
                    off = np.zeros(i.stop - i.start)
                    for m in range(members):
                        off += profile[m, i.start - 1 : i.stop - 1] != chars
                    best[i.start - lo : i.stop - lo] = before[i.start : i.stop] + off / members
                kind[:] = 0
                first = max(lo, 1)
                if first <= hi:
                    down = last[first : hi + 1] + up[first - 1 : hi]
                    part = best[first - lo :]
                    less = down < part
                    kind[first - lo :][less] = 1
                    part[less] = down[less]
                stop = min(hi, d - 1)
                if lo <= stop:
                    new = last[lo + 1 : stop + 2] + 1.0
                    part = best[: stop - lo + 1]
                    less = new < part
                    kind[: stop - lo + 1][less] = 2
                    part[less] = new[less]
                own[a:b] = best
            if keep:
                self.kept.append((lo, kind))
            if middle is not None and hi >= middle:
                if lo <= middle:
                    row[d - middle] = own[middle + 1]
                    cross[2][middle + 1] = d - middle
                first = max(lo, middle + 1)
                if first <= hi:
                    k = kind[first - lo :]
                    cross[2][first + 1 : hi + 2] = np.where(k == 0, cross[0][first : hi + 1], np.where(k == 1, cross[1][first : hi + 1], cross[1][first + 1 : hi + 2]))
            before, last, own = last, own, before
            cross = [cross[1], cross[2], cross[0]]
        self.end = float(last[columns + 1])
        if middle is not None:
            self.crossing = int(cross[1][columns + 1])
            self.there = float(row[self.crossing])

    def way(self, columns: int, n: int) -> list[tuple[int, int]]:
        """The kept moves from the end to the start, as (column, character) with -1 for none."""
        out, i, j = [], columns, n
        while i or j:
            lo, kind = self.kept[i + j]
            move = kind[i - lo]
            i, j = i - (move != 2), j - (move != 1)
            out.append((i if move != 2 else -1, j if move != 1 else -1))
        return out


def divided(profile: np.ndarray, seq: np.ndarray, part: int = PART, band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """(columns, characters) of one line's cheapest alignment, -1 where a step has none, equal to the whole table's.

    A way that leaves the straight one by k columns has at least k steps without a partner, of 1 / members each at least; so a
    band is wide enough once its cheapest way costs less. Bands double, up to what the way found so far may leave. A part whose moves
    are too many is divided at its middle row.
    """
    members, columns = profile.shape
    up = (profile != GAP).sum(0) / members
    whole = columns + len(seq) + 1
    while band < whole:
        bound = int(_Sweep(profile, up, seq, 0.0, band).end * members + 1)
        if bound <= 8 * band:
            band = max(band, bound)
            break
        band *= 2
    out: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, columns, 0, len(seq), 0.0)]
    while todo:
        i0, i1, j0, j1, base = todo.pop()
        own = (profile[:, i0:i1], up[i0:i1], seq[j0:j1], base, band)
        cells = (i1 - i0 + j1 - j0 + 1) * min(min(i1 - i0, j1 - j0) + 1, band + abs((i1 - i0) - (j1 - j0)) + 1)
        if cells <= part or i1 - i0 < 2:
            steps = _Sweep(*own, keep=True).way(i1 - i0, j1 - j0)[::-1]
            at = np.array(steps, np.int64).reshape(-1, 2)
            out.append((np.where(at[:, 0] < 0, -1, at[:, 0] + i0), np.where(at[:, 1] < 0, -1, at[:, 1] + j0)))
            continue
        middle = (i1 - i0) // 2
        sweep = _Sweep(*own, middle=middle)
        todo.append((i0 + middle, i1, j0 + sweep.crossing, j1, sweep.there))
        todo.append((i0, i0 + middle, j0, j0 + sweep.crossing, base))
    return np.concatenate([c for c, _ in out]), np.concatenate([c for _, c in out])


# --- networks of lines ----------------------------------------------------------------------------


def straight(line: np.ndarray, letters: np.ndarray, n: int) -> np.ndarray:
    """For each of n lines, whether texts that end together are aligned as merged_columns() would.

    letters is (columns, members), -1 before a text's begin. For up to three members sums are exact: if apart() holds for all pairs, the way that goes back
    along the diagonal costs no more than any, for a profile too, whose cost is the mean of its members', and among equals the diagonal comes first.
    """
    members = letters.shape[1]
    out = np.full(n, members <= 3)
    for a in range(members if members <= 3 else 0):
        for b in range(a + 1, members):
            out &= apart(line, letters[:, a], letters[:, b], n)
    return out


def closest(lines: list[list[str]]) -> list[tuple[int, int]]:
    """For each line the two members that differ least, the earlier ones of equals; (0, 0) for one member."""
    pairs = [(k, a, b) for k, own in enumerate(lines) for a in range(len(own)) for b in range(a + 1, len(own))]
    d = np.zeros(len(pairs), np.int64)
    size = np.array([max(len(lines[k][a]), len(lines[k][b])) for k, a, b in pairs], np.int64)
    order = np.argsort(size, kind="stable")
    short = order[: np.searchsorted(size[order], LONG, "right")]
    for begin in range(0, len(short), 1024):
        own = short[begin : begin + 1024].tolist()
        d[own] = distances([lines[k][a] for k, a, _ in (pairs[i] for i in own)], [lines[k][b] for k, _, b in (pairs[i] for i in own)])
    for i in order[len(short) :].tolist():
        k, a, b = pairs[i]
        d[i] = distance(lines[k][a], lines[k][b])
    best: list[tuple[int, int, int]] = [(1 << 62, 0, 0)] * len(lines)
    for (k, a, b), cost in zip(pairs, d.tolist(), strict=True):
        best[k] = min(best[k], (cost, a, b))
    return [(a, b) for _, a, b in best]


def _grown(at: np.ndarray, column: np.ndarray, character: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The columns (lines, columns, members) with a further member put in by its steps."""
    lines, _, members = at.shape
    width = column.shape[1]
    inside = np.arange(width) < count[:, None]
    out = np.full((lines, width, members + 1), -1, dtype=np.int64)
    if at.shape[1]:
        held = np.take_along_axis(at, np.broadcast_to(np.maximum(column, 0)[:, :, None], (lines, width, members)), 1)
        out[:, :, :members] = np.where((inside & (column >= 0))[:, :, None], held, -1)
    out[:, :, members] = np.where(inside, character, -1)
    return out


def _merge(texts: list[list[str]]) -> list[np.ndarray]:
    """merged columns, one array (columns, members) for each line, of lines with equally many members in the order of merging."""
    members = len(texts[0])
    length = np.array([[len(t) for t in own] for own in texts])
    own_codes = np.full((len(texts), members, length.max() + 1), GAP, dtype=np.int32)  # an index of -1 picks the last place, a gap
    for k, own in enumerate(texts):
        for m, t in enumerate(own):
            own_codes[k, m, : len(t)] = codes(t)
    at = np.where(np.arange(length[:, 0].max()) < length[:, :1], np.arange(length[:, 0].max()), -1)[:, :, None]
    size = length[:, 0]
    for k in range(1, members):
        profile = np.stack([np.take_along_axis(own_codes[:, m], at[:, :, m], 1) for m in range(k)], 1)
        n = max(length[:, k].max(), 0)
        if len(texts) == 1 and (profile.shape[2] + 1) * (n + 1) > CELLS:
            column, character = (x[None] for x in divided(profile[0], own_codes[0, k, :n]))
            size = np.array([column.shape[1]])
        else:
            column, character, size = _together(profile, own_codes[:, k, :n], size, length[:, k])
        at = _grown(at, column, character, size)
    return [a[:n] for a, n in zip(at, size, strict=True)]


def _straight_columns(lines: list[list[str]], held: list[int], members: int) -> dict[int, np.ndarray]:
    """merged_columns() of those of the held lines that straight() clears."""
    length = np.array([[len(t) for t in lines[k]] for k in held], np.int64).reshape(len(held), members)
    points = np.append(codes("".join(t for k in held for t in lines[k])), np.int32(GAP))
    sizes = length.max(1, initial=0)
    ends = np.cumsum(sizes)
    line = np.repeat(np.arange(len(held)), sizes)
    at = np.maximum((np.arange(len(line)) - (ends - sizes)[line])[:, None] - (sizes[:, None] - length)[line], GAP)
    begin = (np.cumsum(length.ravel()) - length.ravel()).reshape(length.shape)
    clear = straight(line, points[np.where(at < 0, GAP, at + begin[line])], len(held))
    return {held[i]: at[ends[i] - sizes[i] : ends[i]].copy() for i in np.flatnonzero(clear).tolist()}


def merged_columns(lines: list[list[str]], first: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each line its columns as an array (columns, members) of indices into every member's text, -1 for a gap.

    The pair of members given by `first` is merged first, then the others in order. Lines of like length are
    aligned together; those whose texts are all equal, or that straight() clears, are not aligned at all.
    """
    out: list[np.ndarray] = [np.empty((0, 0))] * len(lines)
    clear: dict[int, np.ndarray] = {}
    for members in (2, 3):
        clear |= _straight_columns(lines, [k for k, own in enumerate(lines) if len(own) == members], members)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, own in enumerate(lines):
        if all(t == own[0] for t in own):
            out[k] = np.repeat(np.arange(len(own[0]) if own else 0)[:, None], max(len(own), 1), 1)
        elif k in clear:
            out[k] = clear[k]
        else:
            longest = max(map(len, own))
            groups.setdefault((len(own), longest // 16), []).append(k)
    for (members, size), held in groups.items():
        step = max(1, CELLS // (members * (size + 1) * 16 * 16))
        for begin in range(0, len(held), step):
            part = held[begin : begin + step]
            order = [[a, b, *(m for m in range(members) if m not in (a, b))] for a, b in (first[k] for k in part)]
            made = _merge([[lines[k][m] for m in o] for k, o in zip(part, order, strict=True)])
            for k, o, columns in zip(part, order, made, strict=True):
                out[k] = columns[:, np.argsort(o)]
    return out


def letter_pairs(refs: list[str], hyps: list[str], insertion_first: bool = False) -> list[np.ndarray]:
    """The cheapest edits of texts to others, one array of (place in ref, place in hyp) for each, -1 where a letter has no partner.

    The way back prefers two letters, then a deletion, then an insertion; the last two change places if `insertion_first`.
    """
    if insertion_first:
        return [x[:, ::-1] for x in letter_pairs(hyps, refs)]
    return merged_columns([[r, h] for r, h in zip(refs, hyps, strict=True)], [(0, 1)] * len(refs))
