"""The diagonal method against bit vectors and a plain table."""

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import diagonals, distance


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("ab", max_size=30), st.text("abc", max_size=30))
def test_small(a, b):
    d = table(a, b)
    x, y = distance._numbers(a, b)
    assert diagonals.diagonal_distance(x, y, 60) == d
    assert diagonals.diagonal_distance(x, y, d) == d and (d == 0 or diagonals.diagonal_distance(x, y, d - 1) is None)


def edited(rng, a, n, letters):
    b = list(a)
    for _ in range(n):
        k = rng.randrange(len(b))
        what = rng.randrange(3)
        if what == 0:
            b[k] = rng.choice(letters)
        elif what == 1:
            del b[k]
        else:
            b.insert(k, rng.choice(letters))
    return "".join(b)


def test_as_bit_vectors(monkeypatch):
    rng = random.Random(1)
    for letters in ("ab", "abcdefghijklmnopqrst 你\U0001f600", "a"):
        a = "".join(rng.choice(letters) for _ in range(6000))
        for n in (0, 1, 30, 90):
            b = edited(rng, a, n, letters)
            assert diagonals.diagonal_distance(*distance._numbers(a, b), 400) == distance.bit_distance(a, b)
            monkeypatch.setattr(distance, "HUGE", 1)
            assert distance.sequence_distance(a.split(" "), b.split(" ")) == distance.bit_distance(a.split(" "), b.split(" "))


def test_megabytes_in_seconds():
    rng = random.Random(2)
    a = "".join(rng.choice("etaoin shrdlu") for _ in range(1_000_000))
    b = edited(rng, a, 1000, "etaoin shrdlu")
    began = time.perf_counter()
    d = distance.sequence_distance(a, b)
    assert 900 < d <= 1000 and time.perf_counter() - began < 30


def test_a_wrong_digest_gives_no_answer(monkeypatch):
    monkeypatch.setattr(diagonals._Digests, "equal", lambda self, i, j, length: np.ones(len(i), dtype=bool))
    a, b = (np.array(x) for x in ([1, 2, 3, 4, 5, 6, 7, 8], [1, 9, 3, 9, 5, 9, 7, 9]))
    assert diagonals.diagonal_distance(a, b, 8) is None
