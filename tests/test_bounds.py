"""Many pairs at once against pair by pair."""

import random
from collections import Counter

import pytest
from pagewright.functions import bounds, distance


def _texts(r, signs, n):
    a = "".join(r.choice(signs) for _ in range(n))
    k, c = r.randrange(len(a) + 1), r.choice(signs)
    yield from ((a, a.replace(c, "")), (a, a.replace(c, r.choice(signs))), (a, a[:k]), (a[:k], a), (a, a[:k] + c + a[k:]), (a, a[k:] + a[:k]), ("", a), (a.replace(c, "", 1), a))


@pytest.mark.parametrize("signs", ["ab ", "abcde fgh", "aé中\U0001f600 b", "".join(map(chr, range(0x4E00, 0x6E00)))])
def test_pairs_together_and_alone(signs, monkeypatch):
    r = random.Random(7)
    texts = [p for _ in range(60) for p in _texts(r, signs, r.randrange(0, 30) + 1)]
    for small in (False, True):
        if small:  # portions of few symbols, and counters numbered by pair
            monkeypatch.setattr(bounds, "SYMBOLS", 50)
            monkeypatch.setattr(bounds, "COUNTERS", 20)
        for pairs in (texts, [(a.split(), b.split()) for a, b in texts]):
            shared, found = bounds.shared_and_distances(pairs, True)
            assert shared == bounds.shared_and_distances(pairs, False)[0] == [(Counter(a) & Counter(b)).total() for a, b in pairs]
            assert found == [distance.bit_distance(a, b) for a, b in pairs]
