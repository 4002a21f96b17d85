"""Weighted acyclic automata over words: counts of word sequences, built from sorted input."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import zstandard

Words = tuple[bytes, ...]


class CountAutomaton:
    """A minimal acyclic automaton whose strings carry counts.

    The strings below a prefix are neighbours in sorted order. A state knows how many strings it leads to, so walking a
    prefix gives the range of their places, and the sum of the counts of that range is one difference of running sums.
    """

    def __init__(self, words: list[bytes], starts: np.ndarray, labels: np.ndarray, targets: np.ndarray, final: np.ndarray, counts: np.ndarray) -> None:
        """State i has the arcs from ``starts[i]`` to ``starts[i + 1]``, in order of label; the last state is the first to be entered."""
        self.words, self.starts, self.labels, self.targets, self.final, self.counts = words, starts, labels, targets, final, counts
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        below = self.below = [0] * (len(starts) - 1)
        for state in range(len(below)):  # arcs lead to earlier states
            below[state] = int(final[state]) + sum(below[t] for t in targets[starts[state] : starts[state + 1]].tolist())

    @classmethod
    def build(cls, strings: Iterable[tuple[Words, int]]) -> CountAutomaton:
        """From strings in sorted order, each once: what a new string doesn't share with the last one is final and is
        merged with an equal state at once, so open states are never more than the words of a string."""
        register: dict[tuple, int] = {}
        arcs: list[tuple[tuple[bytes, ...], tuple[int, ...], bool]] = []
        open_states: list[tuple[list[bytes], list[int], list[bool]]] = [([], [], [False])]
        last: Words = ()
        counts: list[int] = []

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                labels, targets, final = open_states.pop()
                key = (tuple(labels), tuple(targets), final[0])
                state = register.get(key)
                if state is None:
                    state = register[key] = len(arcs)
                    arcs.append(key)
                open_states[-1][1].append(state)

        for string, count in strings:
            shared = 0
            for a, b in zip(last, string, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            for word in string[shared:]:
                open_states[-1][0].append(word)
                open_states.append(([], [], [False]))
            open_states[-1][2][0] = True
            counts.append(count)
            last = string
        close(0)
        arcs.append((tuple(open_states[0][0]), tuple(open_states[0][1]), open_states[0][2][0]))
        words = sorted({w for labels, _, _ in arcs for w in labels})
        at = {w: i for i, w in enumerate(words)}
        return cls(
            words,
            np.cumsum([0, *(len(a[0]) for a in arcs)], dtype=np.int64),
            np.array([at[w] for a in arcs for w in a[0]], np.int64),
            np.array([t for a in arcs for t in a[1]], np.int64),
            np.array([a[2] for a in arcs], bool),
            np.array(counts, np.int64),
        )

    def to_bytes(self) -> bytes:
        text = b"\n".join(self.words)
        head = struct.pack("<5q", len(self.words), len(text), len(self.starts), len(self.labels), len(self.counts))
        small = [np.asarray(x, np.int32).tobytes() for x in (self.starts, self.labels, self.targets)]
        return zstandard.compress(b"".join([head, text, *small, np.packbits(self.final).tobytes(), np.asarray(self.counts, np.int64).tobytes()]))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        data = zstandard.decompress(data)
        n_words, size, states, arcs, strings = struct.unpack_from("<5q", data)
        at = struct.calcsize("<5q")
        words = data[at : at + size].split(b"\n") if n_words else []
        at += size
        parts = []
        for kind, n in (("<i4", states), ("<i4", arcs), ("<i4", arcs), ("u1", (states + 6) // 8), ("<i8", strings)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        starts, labels, targets, bits, counts = parts
        return cls(words, starts.astype(np.int64), labels.astype(np.int64), targets.astype(np.int64), np.unpackbits(bits)[: states - 1].astype(bool), counts)

    @property
    def root(self) -> int:
        return len(self.starts) - 2

    def arcs(self, state: int) -> Iterator[tuple[bytes, int]]:
        for i in range(self.starts[state], self.starts[state + 1]):
            yield self.words[self.labels[i]], int(self.targets[i])

    def strings(self) -> Iterator[tuple[Words, int]]:
        """All strings with their counts, in sorted order."""
        counts = iter(self.counts.tolist())
        todo: list[tuple[Words, int]] = [((), self.root)]
        while todo:
            string, state = todo.pop()
            if self.final[state]:
                yield string, next(counts)
            todo += [((*string, word), target) for word, target in reversed(list(self.arcs(state)))]

    def prefixes(self, least: int) -> Iterator[tuple[Words, int]]:
        """Every prefix of two words or more whose strings count ``least`` together, and one-word strings that do."""
        todo: list[tuple[Words, int, int]] = [((), self.root, 0)]
        while todo:
            string, state, first = todo.pop()
            total = int(self.sums[first + self.below[state]] - self.sums[first])
            if total < least:
                continue
            if len(string) > 1:
                yield string, total
            elif string and self.final[state] and self.counts[first] >= least:
                yield string, int(self.counts[first])
            at = first + int(self.final[state])
            for word, target in self.arcs(state):
                todo.append(((*string, word), target, at))
                at += self.below[target]

    def compose(self, asked: CountAutomaton) -> Iterator[tuple[Words, int]]:
        """Counts of the strings of ``asked`` by walking both automata along the arcs they share: of a single word the
        count of that string, else the sum over all strings that start with it. Strings that are not there are left out."""
        todo: list[tuple[Words, int, int, int]] = [((), asked.root, self.root, 0)]
        while todo:
            string, theirs, own, first = todo.pop()
            if asked.final[theirs]:
                if len(string) > 1:
                    yield string, int(self.sums[first + self.below[own]] - self.sums[first])
                elif string and self.final[own]:
                    yield string, int(self.counts[first])
            wanted = dict(asked.arcs(theirs))
            at = first + int(self.final[own])
            for word, target in self.arcs(own):
                if word in wanted:
                    todo.append(((*string, word), wanted[word], target, at))
                at += self.below[target]


def union(automata: Iterable[CountAutomaton]) -> CountAutomaton:
    """One automaton of all strings, counts of equal strings added up, by merging the sorted streams."""
    merged = heapq.merge(*(a.strings() for a in automata), key=itemgetter(0))
    return CountAutomaton.build((string, sum(count for _, count in same)) for string, same in groupby(merged, itemgetter(0)))
