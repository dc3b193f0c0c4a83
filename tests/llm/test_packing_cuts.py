"""The plan of cuts against every plan."""

import random
from functools import lru_cache

import pytest

from quern.llm import packing


def price_of(at, price, ends, p):
    total, before = 0, at[0]
    for x in ends:
        total += packing.padding(x - before, p.length) + p.window_price + (min(price[at.index(x)], p.forced_price) if x in at else p.forced_price)  # a forced cut may meet a border
        before = x
    return total


def cheapest(at, price, p):
    """The least price: from border to border with one window, or with forced cuts after each ``length`` tokens between."""

    @lru_cache(None)
    def to(j):
        if j == 0:
            return 0
        out = []
        for i in range(j):
            h, rest = divmod(at[j] - at[i] - 1, p.length)
            if h <= p.forced:
                left = p.length - rest - 1 if h else packing.padding(rest + 1, p.length)  # after a forced cut every length is padded
                out.append(to(i) + left + price[j] + p.window_price + h * (p.forced_price + p.window_price))
        return min(out)

    return to(len(at) - 1)


@pytest.mark.parametrize("forced", [0, 1, 3])
def test_cuts_are_the_cheapest(forced):
    rnd = random.Random(forced)
    for _ in range(200):
        length = rnd.choice([4, 8, 16])
        p = packing.PackingParams(length=length, forced=forced, window_price=rnd.choice([0, 1, 8]), forced_price=rnd.choice([0, 1, 6]))
        at = [0]
        for _ in range(rnd.randrange(1, 40)):
            at.append(at[-1] + rnd.randint(1, rnd.choice([2, length // 2, length])))
        price = [rnd.choice([0, 0, 1, 6]) for _ in at]
        ends = packing.cuts(at, price, p)
        assert ends[-1] == at[-1] and all(0 < b - a <= length for a, b in zip([0, *ends], ends, strict=False))
        assert price_of(at, price, ends, p) <= cheapest(at, price, p)
