"""Properties of the pure parts of the operators under random input."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenact.llm.packing import plan
from lumenact.llm.splitting import CUE, choose


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 40), st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=25))
def test_plans_use_every_item_once_within_the_capacity(capacity, items):
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in items:
        counts[min(size, capacity)] += n
    placed, used = np.zeros_like(counts), 0
    for pattern, times in plan(counts, capacity):
        assert times > 0 and sum(pattern) <= capacity
        np.add.at(placed, pattern, times)
        used += times
    assert (placed == counts).all()
    total = int(counts @ np.arange(capacity + 1))
    assert used >= -(-total // capacity) and used <= 2 * -(-total // capacity) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(0, 3)), min_size=1, max_size=300), st.integers(0, 16))
def test_pieces_cover_a_text_in_order(units, overlap):
    limit = 32
    tokens = np.append(0, np.cumsum([t for t, _ in units]))
    kind = np.append([k for _, k in units], 2)
    pieces = choose(tokens, kind, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(tokens) - 1
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:], strict=False):
        assert a < c <= b < d
        assert tokens[b] - tokens[c] <= overlap
    for a, b, cut in pieces:
        assert tokens[b] - tokens[a] <= limit
        if b < len(tokens) - 1 and cut < CUE:  # no cue could have been reached with new text before it
            start = next((p for x, p, _ in reversed(pieces) if p < b), 0)
            reach = np.flatnonzero((tokens <= tokens[a] + limit) & (kind == CUE))
            assert not (reach > start).any()
