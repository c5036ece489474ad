"""Generalised suffix automaton over word sequences.

The automaton of several sequences has one path for every run of consecutive words of any of them.
Streaming a text through it gives, after each word, the longest run ending there that some sequence
holds (the matching statistic). It is kept as plain lists, so that it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


def build(sequences: Iterable[Sequence[Hashable]]) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and longest run lengths by state; state 0 is the empty run."""
    moves: list[dict] = [{}]
    link = [-1]
    longest = [0]

    def split(p: int, word: Hashable, q: int) -> int:
        moves.append(dict(moves[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        copy = len(moves) - 1
        link[q] = copy
        while p >= 0 and moves[p].get(word) == q:
            moves[p][word] = copy
            p = link[p]
        return copy

    def add(last: int, word: Hashable) -> int:
        q = moves[last].get(word)
        if q is not None:  # an earlier sequence holds this run
            return q if longest[q] == longest[last] + 1 else split(last, word, q)
        moves.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        new, p = len(moves) - 1, last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, word, q)
        return new

    for sequence in sequences:
        last = 0
        for word in sequence:
            last = add(last, word)
    return moves, link, longest


def run_states(sequence: Sequence[Hashable], moves: list[dict]) -> list[int]:
    """State after each word of a sequence the automaton was built from."""
    out, state = [], 0
    for word in sequence:
        state = moves[state][word]
        out.append(state)
    return out


def home_states(link: list[int], longest: list[int], length: int) -> list[int]:
    """By state: the state of the last ``length`` words of its runs, or -1 for shorter runs."""
    home = [-1] * len(link)
    for state in sorted(range(len(link)), key=longest.__getitem__):
        if longest[state] >= length:
            up = link[state]
            home[state] = state if longest[up] < length else home[up]
    return home


def inherited(link: list[int], longest: list[int], marks: dict[int, tuple]) -> dict[int, tuple]:
    """By state: the marks of the state and of all shorter runs that end it, where there are any."""
    out: dict[int, tuple] = {}
    for state in sorted(range(len(link)), key=longest.__getitem__):
        up = out.get(link[state], ()) if state else ()
        if own := marks.get(state, ()) + up:
            out[state] = own
    return out


def matching_statistics(words: Sequence[Hashable], moves: list[dict], link: list[int],
                        longest: list[int]) -> list[tuple[int, int]]:
    """After each word: the automaton's state and the length of the longest run ending there."""
    out, state, length = [], 0, 0
    for word in words:
        to = moves[state].get(word)
        while to is None and state:
            state = link[state]
            length = longest[state]
            to = moves[state].get(word)
        if to is None:
            length = 0
        else:
            state = to
            length += 1
        out.append((state, length))
    return out
