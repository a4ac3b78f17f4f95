"""Mixing until every source has run out."""

import pytest

from tidemill.operators import mixing


def one_by_one(weights, counts, offset):
    n, state, at, active, out = len(weights), [0] * len(weights), [0] * len(weights), [True] * len(weights), []
    while any(active):
        total = 0
        for k in range(n):
            if active[k]:
                state[k] += weights[k]
                total += weights[k]
        pick = min((k for k in range(n) if active[k]), key=lambda k: (-state[k], (k - offset) % n))
        state[pick] -= total
        if at[pick] == counts[pick]:
            active[pick] = False
            continue
        out.append((len(out), pick, at[pick]))
        at[pick] += 1
    return out


@pytest.mark.parametrize(("weights", "counts", "offset"), [([10, 5, 3, 2], [700, 900, 50, 650], 1), ([7, 3], [5, 100], 0), ([1, 1, 1], [0, 4, 9], 2), ([5, 1], [0, 0], 0)])
def test_every_row_has_its_tick(spark, weights, counts, offset):
    found = sorted(tuple(r) for r in mixing.drained(spark, weights, counts, offset).collect())
    assert found == one_by_one(weights, counts, offset) and len(found) == sum(counts)
