"""Suffix automata over words, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """All factors of some sequences, in states whose number is at most twice the sequences' length."""

    def __init__(self, sequences: Iterable[Sequence[Hashable]] = ()):
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for sequence in sequences:
            self.add(sequence)

    def add(self, sequence: Sequence[Hashable]) -> None:
        step, link, length = self.step, self.link, self.length
        last = 0
        for word in sequence:
            known = step[last].get(word)
            if known is not None:  # an earlier sequence has led here
                last = known if length[known] == length[last] + 1 else self.split(last, known, word)
                continue
            now = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = now
                at = link[at]
            if at >= 0:
                known = step[at][word]
                link[now] = known if length[known] == length[at] + 1 else self.split(at, known, word)
            last = now

    def split(self, at: int, known: int, word: Hashable) -> int:
        """Divide state ``known`` so that one part holds what the step from ``at`` by ``word`` reads."""
        copy = len(self.step)
        self.step.append(self.step[known].copy())
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[known])
        self.link[known] = copy
        while at >= 0 and self.step[at].get(word) == known:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def statistics(self, words: Iterable[Hashable]) -> list[int]:
        """For each word, the length of the longest factor that ends with it."""
        step, link, length = self.step, self.link, self.length
        state = size = 0
        found = []
        for word in words:
            while state and word not in step[state]:
                state = link[state]
                size = length[state]
            after = step[state].get(word)
            if after is None:
                size = 0
            else:
                state, size = after, size + 1
            found.append(size)
        return found


def long_matches(statistics: Sequence[int], least: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) that the matches of at least ``least`` words cover."""
    spans: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= least:
            if spans and spans[-1][1] >= end - size:
                spans[-1] = (min(spans[-1][0], end - size), end)
            else:
                spans.append((end - size, end))
    return spans
