"""Multisets that pairs of sequences share, and edit distances of those whose bounds meet, for many pairs at once.

The pairs' symbols stand one pair after the other in arrays, so that short pairs cost no calls of their own. What is found is
what `distance.met_bounds` finds pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from operator import ne

import numpy as np

from .distance import codes, sequence_distance, unmet_distance

#: Symbols of both sides, and counters of each, that are handled together; one pair may have more.
SYMBOLS, COUNTERS = 1 << 20, 1 << 21


@dataclass
class Pairs:
    """Symbols of pairs, x never shorter than y: counters' numbers, lengths, and the first counter of each pair."""

    x: np.ndarray
    y: np.ndarray
    n_x: np.ndarray
    n_y: np.ndarray
    base: np.ndarray
    size: int


def shared_and_distances(pairs: list[tuple], distance: bool) -> tuple[list[int], list[int]]:
    """pairs: two texts each, or two lists of words. Gives what each pair shares as multisets, and its edit distance if that is asked for."""
    shared, distances = [0] * len(pairs), [0] * len(pairs)
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    rest = _plain_texts(ordered, shared, distances) if pairs and isinstance(pairs[0][0], str) else _plain_words(ordered, shared, distances)
    for some in _portions(rest, ordered):
        taken = [ordered[k] for k in some]
        words = not isinstance(taken[0][0], str)
        common, found, unsure = _settled((_of_words if words else _of_texts)(taken), distance, words)
        for k, (a, b), n, d, u in zip(some, taken, common.tolist(), found.tolist(), unsure.tolist(), strict=True):
            shared[k] = n
            if distance:
                distances[k] = d if d >= 0 else (sequence_distance if u else unmet_distance)(a, b)
    return shared, distances


def _plain_words(ordered: list[tuple[list[str], list[str]]], shared: list[int], distances: list[int]) -> list[int]:
    """Settles pairs of lists that differ in place by words of their own, or of which the shorter one begins the longer up to its last word. Gives the others."""
    rest = []
    for k, (a, b) in enumerate(ordered):
        apart = list(map(ne, a, b))
        if len(a) == len(b):
            if set(compress(a, apart)).isdisjoint(compress(b, apart)):
                distances[k] = sum(apart)
                shared[k] = len(a) - distances[k]
            else:
                rest.append(k)
            continue
        same = apart.index(True) if True in apart else len(b)
        if same < len(b) - 1:
            rest.append(k)
        else:
            shared[k] = len(b) if same == len(b) or b[-1] in a[same:] else same
            distances[k] = len(a) - shared[k]
    return rest


def _plain_texts(ordered: list[tuple[str, str]], shared: list[int], distances: list[int]) -> list[int]:
    """Settles pairs of texts that differ in place by characters of their own, or of which the longer one goes on, or has a few characters more that the other never has. Gives the others."""
    rest, even = [], []
    for k, (a, b) in enumerate(ordered):
        if len(a) == len(b):
            even.append(k)
        elif a.startswith(b) or _without(a, b):
            shared[k], distances[k] = len(b), len(a) - len(b)
        else:
            rest.append(k)
    for some in _portions(even, ordered):
        x, y = (codes("".join([ordered[k][side] for k in some])) for side in (0, 1))
        ends = np.cumsum([len(ordered[k][0]) for k in some])
        apart = np.flatnonzero(x != y)
        owners = np.searchsorted(ends, apart, side="right")
        many = np.bincount(owners, minlength=len(some))
        of_x, of_y = (np.unique(owners << 21 | side[apart]) for side in (x, y))
        meets = np.zeros(len(some), dtype=bool)
        meets[np.intersect1d(of_x, of_y, assume_unique=True) >> 21] = True
        for k, n, other in zip(some, many.tolist(), meets.tolist(), strict=True):
            if other:
                rest.append(k)
            else:
                shared[k], distances[k] = len(ordered[k][0]) - n, n
    return rest


def _without(a: str, b: str, few: int = 4) -> bool:
    """Whether b is a without all of its characters of a few kinds."""
    gone = set(a).difference(b)
    if not 0 < len(gone) <= few:
        return False
    for c in gone:
        a = a.replace(c, "")
    return a == b


def _portions(which: list[int], pairs: list[tuple]) -> Iterator[list[int]]:
    some, held = [], 0
    for k in which:
        n = len(pairs[k][0]) + len(pairs[k][1])
        if some and held + n > SYMBOLS:
            yield some
            some, held = [], 0
        some.append(k)
        held += n
    if some:
        yield some


def _lengths(ordered: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.fromiter((len(p[k]) for p in ordered), dtype=np.int64, count=len(ordered)) for k in (0, 1))


def _of_texts(ordered: list[tuple[str, str]]) -> Pairs:
    x, y = (codes("".join(p[k] for p in ordered)) for k in (0, 1))
    n_x, n_y = _lengths(ordered)
    top = int(max(x.max(initial=0), y.max(initial=0))) + 1
    used = np.zeros(top, dtype=bool)
    used[x] = used[y] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    kinds = int(place[-1]) + 1
    if kinds * len(ordered) <= COUNTERS:
        base, size = np.arange(len(ordered)) * kinds, len(ordered) * kinds
        return Pairs(place[x] + np.repeat(base, n_x), place[y] + np.repeat(base, n_y), n_x, n_y, base, size)
    # many kinds of characters in short texts: each pair numbers its own
    both = np.concatenate([place[x], place[y]]) + kinds * np.concatenate([np.repeat(np.arange(len(ordered)), n_x), np.repeat(np.arange(len(ordered)), n_y)])
    names, both = np.unique(both, return_inverse=True)
    return Pairs(both[: len(x)], both[len(x) :], n_x, n_y, np.searchsorted(names, np.arange(len(ordered)) * kinds), len(names))


def _of_words(ordered: list[tuple[list[str], list[str]]]) -> Pairs:
    """Words are numbered within their pair."""
    n_x, n_y = _lengths(ordered)
    x, y, kinds = [], [], []
    for a, b in ordered:
        distinct = dict.fromkeys(a)
        distinct.update(dict.fromkeys(b))
        number = dict(zip(distinct, range(len(distinct)))).__getitem__
        x.extend(map(number, a))
        y.extend(map(number, b))
        kinds.append(len(distinct))
    size = sum(kinds)
    base = np.cumsum(kinds) - kinds
    return Pairs(np.array(x, dtype=np.int64) + np.repeat(base, n_x), np.array(y, dtype=np.int64) + np.repeat(base, n_y), n_x, n_y, base, size)


def _settled(p: Pairs, distance: bool, gaps: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair what is shared, the distance where bounds meet, else -1, and whether that needs another look."""
    n = len(p.n_x)
    of_x, of_y = (np.bincount(side, minlength=p.size) for side in (p.x, p.y))
    sums = np.concatenate([[0], np.cumsum(np.minimum(of_x, of_y))])
    common = sums[np.append(p.base[1:], p.size)] - sums[p.base]
    found, unsure = np.full(n, -1), np.zeros(n, dtype=bool)
    if not distance:
        return common, found, unsure
    least = p.n_x - common
    at_x, at_y = np.repeat(np.arange(n), p.n_x), np.repeat(np.arange(n), p.n_y)

    # in their places, if as many; at its beginning, if the longer one has all of the shorter
    even, holds = p.n_x == p.n_y, (p.n_x > p.n_y) & (common == p.n_y)
    tried = even | holds
    place = np.arange(len(p.x)) - np.repeat(np.cumsum(p.n_x) - p.n_x, p.n_x)
    apart = _differ(p, at_x, at_y, tried[at_x] & (place < np.repeat(p.n_y, p.n_x)), tried[at_y])
    met = (even & (apart == least)) | (holds & (apart == 0))
    # some symbols go altogether; where only some of a kind go, it is not as plain
    left = holds & ~met
    if left.any():
        whole = of_x == of_y
        keeps = left[at_x]
        keeps[keeps] = whole[p.x[keeps]]
        plain = left & (np.bincount(at_x[keeps], minlength=n) == p.n_y)
        unsure = left & ~plain
        met |= plain & (_differ(p, at_x, at_y, keeps & plain[at_x], plain[at_y]) == 0)
    if gaps:
        left = ~met & ~unsure
        met |= left & (_gaps(p, of_x, of_y, at_x, at_y, left) == least)
    found[met] = least[met]
    return common, found, unsure & ~met


def _differ(p: Pairs, at_x: np.ndarray, at_y: np.ndarray, in_x: np.ndarray, in_y: np.ndarray) -> np.ndarray:
    """How many of a pair's chosen symbols differ in turn; as many are chosen on both sides."""
    return np.bincount(at_y[in_y][p.x[in_x] != p.y[in_y]], minlength=len(p.n_x))


def _gaps(p: Pairs, of_x: np.ndarray, of_y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, left: np.ndarray) -> np.ndarray:
    """What it costs to keep all symbols that both have, if in the same order, and change or leave out what lies between; else -1."""
    n = len(p.n_x)
    in_x, in_y = left[at_x], left[at_y]
    in_x[in_x], in_y[in_y] = of_y[p.x[in_x]] > 0, of_x[p.y[in_y]] > 0
    many = np.bincount(at_x[in_x], minlength=n)
    left = left & (many == np.bincount(at_y[in_y], minlength=n))
    in_x, in_y = in_x & left[at_x], in_y & left[at_y]
    left = left & (_differ(p, at_x, at_y, in_x, in_y) == 0)
    out = np.full(n, -1)
    chosen = np.flatnonzero(left)
    if not len(chosen):
        return out
    # each text gets an end, which counts as common: from one end to the next are a pair's gaps
    wide = []
    for at, here, lengths in ((at_x, in_x & left[at_x], p.n_x), (at_y, in_y & left[at_y], p.n_y)):
        ends = np.cumsum(lengths) + np.arange(n)
        places = np.sort(np.concatenate([np.flatnonzero(here) + at[here], ends]))
        wide.append(np.diff(places, prepend=-1))
        owners = np.searchsorted(ends, places)
        wide[-1] = wide[-1][left[owners]]
    cost = np.maximum(*wide) - 1
    each = many[chosen] + 1
    out[chosen] = np.add.reduceat(cost, np.cumsum(each) - each)
    return out
