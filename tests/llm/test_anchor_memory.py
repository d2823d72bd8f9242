"""Anchors of a piece of texts are found in steps: a worker holds columns of one step, and every window keeps its anchor."""

import tracemalloc

import numpy as np

from supportkb.llm import common
from supportkb.llm import suffix_dedup as D


def _windows(runs):
    row, anchor, first, last, gram = runs
    n = last - first + 1
    start = np.repeat(first, n) + common.sequences(n)
    order = np.argsort(start)
    return [np.repeat(x, n)[order].tolist() for x in (row, anchor, gram)] + [start[order].tolist()]


def test_steps_keep_every_window():
    data = np.random.default_rng(3).integers(97, 101, 9_000).astype(np.uint8)
    offsets = np.array([0, 50, 4_000, 4_000, 8_990, 9_000])
    whole = _windows(D.anchored_runs(data, offsets, step=1 << 22))
    for step in (1, 37, 1_000):
        assert _windows(D.anchored_runs(data, offsets, step=step)) == whole


def test_a_piece_takes_little_memory():
    data = np.random.default_rng(4).integers(97, 123, D.PIECE).astype(np.uint8)
    offsets = np.arange(0, D.PIECE + 1, 2_048)
    D.anchored_runs(data, offsets)             # the powers stay
    tracemalloc.start()
    try:
        D.anchored_runs(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * D.PIECE
