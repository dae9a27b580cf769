"""A minimal acyclic transducer from sorted byte strings to their lexicographic ordinals."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np


class Transducer:
    """States with equal futures are one; an edge carries how many terms come before its branch.

    The ordinal of a term is the sum along its path. Edges are rows of three arrays, sorted by (state, byte).
    """

    def __init__(self, edges: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, root: int):
        self.edges, self.targets, self.skips, self.final, self.root = edges, targets, skips, final, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in byte order. Only the path of the last term is open; finished states are looked up in a register."""
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]   # open states: final, edges (byte, state)
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], register.setdefault((final, tuple(edges)), len(register))))

        for term in terms:
            same = 0
            for x, y in zip(term, last, strict=False):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend([False, []] for _ in range(len(term) - same))
            path[-1][0] = True
            last = term
        close(0)
        root = register.setdefault((path[0][0], tuple(path[0][1])), len(register))
        held = np.zeros(len(register), dtype=np.int64)   # terms from a state on
        rows = []
        for state, (final, edges) in enumerate(register):   # targets come before their sources
            held[state] = final
            for byte, target in edges:
                rows.append((state << 8 | byte, target, held[state]))
                held[state] += held[target]
        edges, targets, skips = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
        return cls(edges, targets.astype(np.int32), skips, np.array([f for f, _ in register], dtype=bool), root)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 for those that are not held. All terms take their n-th step together."""
        out = np.full(len(terms), -1, dtype=np.int64)
        if not len(self.edges):
            return np.array([0 if self.final[self.root] and not t else -1 for t in terms], dtype=np.int64)
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        at = np.cumsum(sizes) - sizes
        alive = np.arange(len(terms))
        state, total = np.full(len(terms), self.root, dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        step = 0
        while len(alive):
            ended = sizes[alive] == step
            done = ended & self.final[state]
            out[alive[done]] = total[done]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            want = state << 8 | data[at[alive] + step]
            edge = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
            met = self.edges[edge] == want
            alive, edge = alive[met], edge[met]
            state, total = self.targets[edge].astype(np.int64), total[met] + self.skips[edge]
            step += 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal: the last edge of a state that skips no more than what is left."""
        out, state = bytearray(), self.root
        while not (ordinal == 0 and self.final[state]):
            low, high = np.searchsorted(self.edges, (state << 8, (state + 1) << 8))
            edge = low + int(np.searchsorted(self.skips[low:high], ordinal, side="right")) - 1
            ordinal -= int(self.skips[edge])
            out.append(int(self.edges[edge]) & 255)
            state = int(self.targets[edge])
        return bytes(out)

    def dump(self) -> bytes:
        return pickle.dumps((self.edges, self.targets, self.skips, self.final, self.root), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        return cls(*pickle.loads(data))
