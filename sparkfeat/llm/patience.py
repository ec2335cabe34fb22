"""Patience alignment of two sequences."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Sequence


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first number, whose second numbers increase."""
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tails, j)
        if pile:
            back[k] = tops[pile - 1]
        if pile == len(tails):
            tails.append(j)
            tops.append(k)
        else:
            tails[pile], tops[pile] = j, k
    chain, k = [], tops[-1] if tops else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


#: Bits of the table that an exact diff keeps; larger gaps are halved first.
TABLE_BITS = 1 << 26


def _row(a: Sequence[Hashable], b: Sequence[Hashable], keep: list[int] | None = None) -> int:
    """The last row of the longest common subsequences of ``a`` with each start of ``b``: its zero bits are where it grows.

    One operation on a number of ``len(b)`` bits for each symbol of ``a``. All rows go to ``keep`` if given.
    """
    masks: dict[Hashable, int] = {}
    for j, symbol in enumerate(b):
        masks[symbol] = masks.get(symbol, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for symbol in a:
        both = row & masks.get(symbol, 0)
        row = ((row + both) | (row - both)) & full
        if keep is not None:
            keep.append(row)
    return row


def _lengths(row: int, size: int) -> list[int]:
    out = [0]
    for bit in bin(row | 1 << size)[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common_subsequence(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """A longest common subsequence as places ``(i, j)``, in memory in proportion to both lengths."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, i_end, j, j_end = parts.pop()
        if i == i_end or j == j_end:
            continue
        if (i_end - i) * (j_end - j) <= TABLE_BITS or i_end - i == 1:
            rows: list[int] = []
            _row(a[i:i_end], b[j:j_end], rows)
            at, column = i_end - i, j_end - j
            while at and column:
                if rows[at - 1] >> (column - 1) & 1:
                    column -= 1
                    continue
                at -= 1
                if not at or rows[at - 1] >> (column - 1) & 1:  # the bit fell in this row: a match
                    column -= 1
                    out.append((i + at, j + column))
            continue
        middle = (i + i_end) // 2
        ahead = _lengths(_row(a[i:middle], b[j:j_end]), j_end - j)
        back = _lengths(_row(a[middle:i_end][::-1], b[j:j_end][::-1]), j_end - j)[::-1]
        cut = j + max(range(len(ahead)), key=lambda k: ahead[k] + back[k])
        parts += [(i, middle, j, cut), (middle, i_end, cut, j_end)]
    return sorted(out)


def align(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Aligned places ``(i, j)`` with ``a[i] == b[j]``, increasing in both.

    Equal ends are matched first; then symbols that occur once in either side are anchors, of which
    the longest increasing chain is kept; the gaps between anchors are aligned the same way. A gap
    without anchors gets an exact diff. Works with a list of open gaps, not recursively.
    """
    out: list[tuple[int, int]] = []
    open_gaps = [(0, len(a), 0, len(b))]
    while open_gaps:
        i, i_end, j, j_end = open_gaps.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        once = {s for s, n in in_a.items() if n == 1 and in_b.get(s) == 1}
        if not once:
            out += [(i + x, j + y) for x, y in common_subsequence(a[i:i_end], b[j:j_end])]
            continue
        where = {b[y]: y for y in range(j, j_end) if b[y] in once}
        chain = _increasing([(x, where[a[x]]) for x in range(i, i_end) if a[x] in once])
        out += chain
        for (x, y), (x_next, y_next) in zip([(i - 1, j - 1), *chain], [*chain, (i_end, j_end)], strict=True):
            open_gaps.append((x + 1, x_next, y + 1, y_next))
    return sorted(out)
