"""A minimal acyclic transducer: sorted keys to their ordinals, many keys at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Built from sorted distinct byte keys; equal endings share their states.

    An arc carries the number of keys that come before those behind it, so the sum along the
    way of a key is its ordinal.  Arcs lie in one array sorted by (state, byte).
    """

    def __init__(self, keys: Iterable[bytes]):
        register: dict[tuple, int] = {}
        arcs: list[tuple] = []
        finals: list[bool] = []
        sizes: list[int] = []

        def freeze(final: bool, out: list[tuple[int, int]]) -> int:
            signature = (final, *out)
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(arcs)
                arcs.append(tuple(out))
                finals.append(final)
                sizes.append(final + sum(sizes[target] for _, target in out))
            return state

        # The states along the last key are open: whether a key ends there, and the arcs that are settled.
        path: list[list] = [[False, []]]
        last = b""
        for key in keys:
            common = 0
            shorter = min(len(last), len(key))
            while common < shorter and last[common] == key[common]:
                common += 1
            for depth in range(len(last), common, -1):
                final, out = path.pop()
                path[-1][1].append((last[depth - 1], freeze(final, out)))
            path.extend([False, []] for _ in range(len(key) - common))
            path[-1][0] = True
            last = key
        for depth in range(len(last), 0, -1):
            final, out = path.pop()
            path[-1][1].append((last[depth - 1], freeze(final, out)))
        self.start = freeze(*path[0])

        label, target, before = [], [], []
        for state, out in enumerate(arcs):
            passed = int(finals[state])
            for byte, to in out:
                label.append(state << 8 | byte)
                target.append(to)
                before.append(passed)
                passed += sizes[to]
        order = np.argsort(np.array(label, np.int64), kind="stable")
        self.label = np.append(np.array(label, np.int64)[order], np.int64(-1))
        self.target = np.append(np.array(target, np.int64)[order], 0)
        self.before = np.append(np.array(before, np.int64)[order], 0)
        self.final = np.array(finals, bool)
        self.n_states = len(arcs)
        self.n_keys = sizes[self.start]

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states, what the arcs add, and whether there is an arc."""
        wanted = state << 8 | byte
        at = np.searchsorted(self.label[:-1], wanted)
        return self.target[at], self.before[at], self.label[at] == wanted

    def ordinals(self, prefix: bytes, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ordinal of ``prefix`` + ``data[start : start + length]`` for each key, -1 if it is none."""
        out = np.full(len(starts), -1, np.int64)
        state, passed = np.array([self.start]), np.zeros(1, np.int64)
        for byte in prefix:
            state, add, known = self.step(state, np.array([byte]))
            if not known[0]:
                return out
            passed = passed + add
        live = np.arange(len(starts))
        state, passed = np.repeat(state, len(starts)), np.repeat(passed, len(starts))
        depth = 0
        while len(live):
            ended = lengths[live] == depth
            if ended.any():
                accepted = ended & self.final[state]
                out[live[accepted]] = passed[accepted]
                live, state, passed = live[~ended], state[~ended], passed[~ended]
            if not len(live):
                break
            state, add, known = self.step(state, data[starts[live] + depth].astype(np.int64))
            live, state, passed = live[known], state[known], (passed + add)[known]
            depth += 1
        return out
