"""Edit distance of very long sequences that differ little: O((n + d^2) log n) for a distance d, and exact.

For each number of edits, the furthest place that each diagonal of the table can reach is kept. Stretches that are equal are
jumped over at once: digests of all prefixes tell how long they are, by doubling and halving. Digests can only make a
stretch too long and the distance too small, so the path found is walked back and its stretches are compared symbol by
symbol: if all are equal, the distance is reached by a path and is exact; if not, there is no answer.
"""

from __future__ import annotations

import numpy as np

_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = (1_103_515_245, 1_664_525_007)


def _powers(n: int, base: int, p: int) -> np.ndarray:
    out = np.ones(n, dtype=np.int64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step % p
        have, step = have + more, step * step % p
    return out


class _Digests:
    """Whether stretches of two sequences are equal, by two digests of 31 bits each."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        n = max(len(a), len(b)) + 1
        self.parts = []
        for base, p in zip(_BASES, _PRIMES, strict=True):
            power = _powers(n, base, p)
            sums = [np.concatenate([[0], np.cumsum((x.astype(np.int64) + 1) % p * power[: len(x)] % p) % p]) for x in (a, b)]
            self.parts.append((p, power, *sums))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), dtype=bool)
        for p, power, of_a, of_b in self.parts:
            out &= (of_a[i + length] - of_a[i]) % p * power[j] % p == (of_b[j + length] - of_b[j]) % p * power[i] % p
        return out


def _run(a: np.ndarray, b: np.ndarray, digests: _Digests, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How long a from i and b from j are equal."""
    room = np.minimum(len(a) - i, len(b) - j)
    out = np.zeros(len(i), dtype=np.int64)
    live = np.flatnonzero(room > 0)
    live = live[a[i[live]] == b[j[live]]]
    if not len(live):
        return out
    # double while equal, then halve: done is known to be equal, step is what is tried
    done, step = np.ones(len(live), dtype=np.int64), 1
    grows = np.arange(len(live))
    widest = np.ones(len(live), dtype=np.int64)
    while len(grows):
        more = np.minimum(step, room[live[grows]] - done[grows])
        at = live[grows]
        same = digests.equal(i[at] + done[grows], j[at] + done[grows], more)
        widest[grows[~same]] = step
        done[grows[same]] += more[same]
        grows = grows[same & (more == step)]
        step *= 2
    size = int(widest.max())
    while size > 1:
        size //= 2
        tried = np.flatnonzero((widest > size) & (done + size <= room[live]))
        at = live[tried]
        same = digests.equal(i[at] + done[tried], j[at] + done[tried], np.full(len(tried), size))
        done[tried[same]] += size
    out[live] = done
    return out


def diagonal_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The edit distance of two sequences of whole numbers, or None if it is above ``limit``."""
    n, m = len(a), len(b)
    goal = n - m
    if abs(goal) > limit:
        return None
    digests = _Digests(a, b)
    reached: list[np.ndarray] = []
    for e in range(limit + 1):
        k = np.arange(-e, e + 1)
        start = _start(reached[-1] if reached else None, e, n, m)
        far = start.copy()
        inside = np.flatnonzero((start >= 0) & (start >= k) & (start - k <= m))
        far[inside] += _run(a, b, digests, start[inside], start[inside] - k[inside])
        reached.append(far)
        if abs(goal) <= e and far[goal + e] >= n:
            return e if _proved(a, b, reached, goal) else None
    return None


def _start(before: np.ndarray | None, e: int, n: int, m: int) -> np.ndarray:
    """Where each diagonal from -e to e begins its stretch, one edit after what was reached; -1: nowhere."""
    if before is None:
        return np.zeros(1, dtype=np.int64)
    k = np.arange(-e, e + 1)
    wide = np.full(2 * e + 3, -2, dtype=np.int64)  # diagonals from -e - 1 to e + 1
    wide[2 : 2 * e + 1] = before
    changed, dropped, added = wide[1:-1] + 1, wide[:-2] + 1, wide[2:]
    out = np.maximum(np.maximum(changed, dropped), added)
    out = np.minimum(out, np.minimum(n, m + k))
    return np.where((out >= 0) & (out >= k), out, -2)


def _proved(a: np.ndarray, b: np.ndarray, reached: list[np.ndarray], k: int) -> bool:
    """Walks the path back; true if every stretch it jumped over is equal."""
    n, m = len(a), len(b)
    end = n
    for e in range(len(reached) - 1, -1, -1):
        start = int(_start(reached[e - 1] if e else None, e, n, m)[k + e])
        start = min(start, end)
        if not np.array_equal(a[start:end], b[start - k : end - k]):
            return False
        if e:
            before = reached[e - 1]
            options = [(int(before[x + e - 1]) + i, x, i) for x, i in ((k, 1), (k - 1, 1), (k + 1, 0)) if abs(x) < e]
            here = [o for o in options if o[0] >= start]
            if not here:
                return False
            _, k, i = here[0]
            end = start - i
    return k == 0
