"""Edit distance in Python, for functions that work on whole documents in Arrow batches."""

from __future__ import annotations


def edits(a: str, b: str) -> int:
    """Insertions, deletions and replacements; one column of the table is two numbers of len(a) bits, which change by a few operations for each character of b."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus, minus = down | every & ~(horizontal | up), up & horizontal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & every, (minus << 1) & every
        up, down = minus | every & ~(vertical | plus), plus & vertical
    return score


def alignment(a: str, b: str) -> list[tuple[int, int]]:
    """A cheapest alignment as pairs of places (-1: gap). Among equal ones a match is preferred to a replacement, that to a deletion, that to an insertion.

    The columns of the table are kept as bits that tell where the next row or column is one more or one less; the way back is read from them."""
    if not a or not b:
        return [(i, -1) for i in range(len(a))] + [(-1, j) for j in range(len(b))]
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    up, down = every, 0
    columns = [(up, down, 0, 0)]
    for c in b:
        same = at.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        more, less = down | every & ~(horizontal | up), up & horizontal
        plus, minus = (more << 1 | 1) & every, (less << 1) & every
        up, down = minus | every & ~(vertical | plus), plus & vertical
        columns.append((up, down, more, less))
    step = lambda plus, minus, i: (plus >> i & 1) - (minus >> i & 1)
    i, j, back = len(a), len(b), []
    while i and j:
        up, down, more, less = columns[j]
        v, h = step(up, down, i - 1), step(more, less, i - 1)
        straight = h + step(*columns[j - 1][:2], i - 1)  # what the step from the place before both costs
        if straight == (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            back.append((i, j))
        elif v == 1:
            i -= 1
            back.append((i, -1))
        else:
            j -= 1
            back.append((-1, j))
    back += [(k, -1) for k in range(i - 1, -1, -1)] + [(-1, k) for k in range(j - 1, -1, -1)]
    return back[::-1]
