"""Exact byte-pair encoding as dynamic programming over prefixes, driven by an Aho-Corasick automaton.

The encoding of a prefix ends in exactly one token; the encoding without it is that of the shorter prefix. So one pass
suffices: at each position the automaton's output links list the tokens that end there, and the one that stands beside
the last token of its own start as merging would leave the two is the last token here.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick


_NEVER = float("inf")


class Memo(dict):
    """Remembers `make(key)` of short keys; forgets all at `limit` entries."""

    def __init__(self, make: Callable, limit: int = 300_000, longest: int = 64) -> None:
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def merge(symbols: list[str], rank: Callable[[str, str], float | None]) -> list[str]:
    """The definition: the pair of the lowest rank is joined, the leftmost of equals, until none can be."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = None, -1
        for k in range(len(symbols) - 1):
            r = rank(symbols[k], symbols[k + 1])
            if r is not None and (best is None or r < best):
                best, at = r, k
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


class PrefixBpe:
    """tokens: all that merging can leave; rank(a, b): when a and b are joined, None for never."""

    def __init__(self, tokens: list[str], rank: Callable[[str, str], float | None]) -> None:
        self.rank = rank
        self.automaton = ahocorasick.Automaton()
        for token in tokens:
            self.automaton.add_word(token, token)
        if tokens:
            self.automaton.make_automaton()
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    def _steps(self, token: str) -> list[tuple[float, str, str]]:
        """The merges that make a token: their ranks, and its first and last symbol before each; at the end itself."""
        found = self.steps.get(token)
        if found is None:
            symbols, found = list(token), []
            while len(symbols) > 1:
                r, at = min((r, k) for k in range(len(symbols) - 1) if (r := self.rank(symbols[k], symbols[k + 1])) is not None)
                found.append((r, symbols[0], symbols[-1]))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found.append((_NEVER, token, token))
            self.steps[token] = found
        return found

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging leaves the two side by side: no pair across them comes up before their own merges."""
        pair = left, right
        found = self.beside.get(pair)
        if found is None:
            if len(self.beside) >= 200_000:
                self.beside.clear()
            ours, theirs, i, j, found = self._steps(left), self._steps(right), 0, 0, True
            while True:
                (a, _, x), (b, y, _) = ours[i], theirs[j]
                across = self.rank(x, y)
                if across is not None and across < a and across <= b:  # of equals the leftmost goes first
                    found = False
                    break
                if a is b is _NEVER:
                    break
                if a <= b:
                    i += 1
                else:
                    j += 1
            self.beside[pair] = found
        return found

    def last_tokens(self, text: str) -> tuple[list[str | None], list[bool]]:
        """For each prefix length the last token of its encoding; whether that is a character without a token."""
        size = len(text)
        last: list[str | None] = [None] * (size + 1)
        strange = [False] * (size + 1)
        done = 0  # prefixes up to here are settled
        for end, token in self.automaton.iter(text):
            here = end + 1
            while done < here - 1:
                done += 1
                if last[done] is None:
                    last[done], strange[done] = text[done - 1], True
            if last[here] is None:
                start = here - len(token)
                if not start or strange[start] or self._fits(last[start], token):
                    last[here] = token
        for k in range(done + 1, size + 1):
            if last[k] is None:
                last[k], strange[k] = text[k - 1], True
        return last, strange

    def counts(self, text: str) -> list[int]:
        """The number of tokens of every prefix, the empty one first; all characters must have tokens."""
        size = len(text)
        counts = [0] * (size + 1)
        last: list[str | None] = [None] * (size + 1)
        known = self.beside.get
        for end, token in self.automaton.iter(text):
            here = end + 1
            if last[here] is None:
                start = here - len(token)
                if start:
                    before = last[start]
                    fits = known((before, token))
                    if fits is None:
                        fits = self._fits(before, token)
                    if not fits:
                        continue
                last[here] = token
                counts[here] = counts[start] + 1
        return counts

    def encode(self, text: str) -> list[str]:
        last, _ = self.last_tokens(text)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]
