"""Edit distance of two sequences: by bounds that meet, else by bit vectors; of very long ones that differ little, by furthest-reaching diagonals.

A distance is never below the longer length less what the two have in common as multisets, and never above the cost of any
alignment. Where a simple alignment costs no more than that, it is the answer, in time linear in the pair. For the others the
columns of the table of distances are kept as bits of one integer, so a step handles a whole column.
"""

from __future__ import annotations

from operator import ne

import numpy as np

from .diagonals import diagonal_distance

#: Product of lengths from which few edits are looked for first, and how many: up to one in so many symbols, and so many in all.
HUGE, SPARSE, MOST = 1 << 28, 64, 4_000


def bit_distance(a, b) -> int:
    """Edit distance of two sequences of hashable symbols; what they begin and end with in common costs nothing."""
    if len(a) < len(b):
        a, b = b, a
    first, last = 0, len(b)
    while first < last and a[first] == b[first]:
        first += 1
    while last > first and a[last - 1 - len(b)] == b[last - 1]:
        last -= 1
    a, b = a[first : len(a) - len(b) + last], b[first:last]
    if not len(b):
        return len(a)
    m = len(b)
    rows = {}
    for k, x in enumerate(b):
        rows.setdefault(x, []).append(k)
    where = {}
    for x, places in rows.items():
        bits = bytearray(m // 8 + 1)
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        where[x] = int.from_bytes(bits, "little")
    every, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = every, 0, m  # rows where the column rises or falls by one
    for x in a:
        equal = where.get(x, 0)
        diagonal = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise = down | (every & ~(across | up))
        fall = up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1 | 1) & every
        fall = (fall << 1) & every
        up = fall | (every & ~(diagonal | rise))
        down = rise & diagonal
    return score


def codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("ascii"), dtype=np.uint8) if x.isascii() else np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def met_bounds(a, b) -> int | None:
    """The edit distance of two texts, or of two lists of words, where a simple alignment reaches the lower bound; else None.

    Tried are: symbols in their places, if as many; all of the shorter within the longer in order; and for words those that both
    have, if in the same order, with what lies between them changed or left out.
    """
    if len(a) < len(b):
        a, b = b, a
    text = isinstance(a, str)
    if len(a) == len(b):
        if text:
            x, y = codes(a), codes(b)
            apart = np.flatnonzero(x != y)
            x, y = x[apart].tolist(), y[apart].tolist()
        else:
            apart = [k for k, other in enumerate(map(ne, a, b)) if other]
            x, y = [a[k] for k in apart], [b[k] for k in apart]
        if set(x).isdisjoint(y):
            return len(apart)
    elif (text and a.startswith(b)) or _within(a, b):
        return len(a) - len(b)
    return None if text else _met_in_common(a, b)


def _within(a, b) -> bool:
    rest = iter(a)
    return all(x in rest for x in b)


def _met_in_common(a: list, b: list) -> int | None:
    """a is not the shorter one. Common words in the same order cut both into gaps, of which each costs its longer side."""
    of_a, of_b = set(a), set(b)
    at, other = [k for k, x in enumerate(a) if x in of_b], [k for k, x in enumerate(b) if x in of_a]
    if len(at) != len(other) or any(a[i] != b[j] for i, j in zip(at, other)):
        return None
    cost, i0, j0 = 0, -1, -1
    for i, j in zip([*at, len(a)], [*other, len(b)]):
        cost += max(i - i0, j - j0) - 1
        i0, j0 = i, j
    return cost if cost == len(a) - len(at) else None


def sequence_distance(a, b) -> int:
    """Edit distance of two texts or two lists of words, by the way that suits them."""
    found = met_bounds(a, b)
    return unmet_distance(a, b) if found is None else found


def unmet_distance(a, b) -> int:
    """Edit distance of two texts or two lists of words whose bounds do not meet."""
    if len(a) * len(b) >= HUGE:
        found = diagonal_distance(*_numbers(a, b), min(MOST, max(len(a), len(b)) // SPARSE))
        if found is not None:
            return found
    return bit_distance(a, b)


def _numbers(a, b) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in (a, b))
    names: dict = {}
    return tuple(np.array([names.setdefault(w, len(names)) for w in x], dtype=np.int64) for x in (a, b))
