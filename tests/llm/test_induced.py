"""Induced sorting against plain comparison, for several alphabets, depths and memory bounds."""

import numpy as np
import pytest

from weftgraph.llm.induced import BREAK, SENTINEL, SHIFT, equal_windows, s_types


def plain_groups(t, depth):
    groups = {}
    for i in range(len(t) - depth + 1):
        groups.setdefault(bytes(t[i : i + depth]), set()).add(i)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def strings(rng, letters, n):
    parts = []
    for _ in range(n):
        kind = rng.integers(4)
        if kind == 0 and parts:
            old = parts[rng.integers(len(parts))]
            cut = rng.integers(len(old) + 1)
            parts.append(np.concatenate((old[cut:], rng.integers(0, letters, rng.integers(0, 20)))))
        elif kind == 1:
            parts.append(np.tile(rng.integers(0, letters, rng.integers(1, 4)), rng.integers(1, 30)))
        else:
            parts.append(rng.integers(0, letters, rng.integers(0, 60)))
    return parts


@pytest.mark.parametrize("letters,depth,limit", [(1, 5, 1 << 20), (2, 6, 4), (2, 20, 1 << 20), (4, 9, 16), (250, 3, 1 << 20), (3, 33, 7)])
def test_groups(letters, depth, limit):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        joined = []
        for p in strings(rng, letters, 25):
            joined += [p.astype(np.uint8) + SHIFT, np.array([BREAK], np.uint8)]
        t = np.concatenate([*joined, np.array([SENTINEL], np.uint8)]).astype(np.uint8)
        assert (s_types(t) == [i == len(t) - 1 or bytes(t[i:]) < bytes(t[i + 1 :]) for i in range(len(t))]).all()
        got, places_seen = set(), []
        for places, starts in equal_windows(t, depth, limit):
            places_seen += places.tolist()
            for run in np.split(places, starts[1:]):
                # a run may also hold suffixes near the end that are shorter than depth: never, as the sentinel ends them
                if len(run) > 1:
                    got.add(frozenset(run.tolist()))
        assert len(places_seen) == len(set(places_seen))
        assert got == plain_groups(t, depth), seed
