"""Byte-pair encodings read as automata: which tokens may stand side by side.

A sequence of tokens is the encoding of its text if and only if each token
encodes itself and each pair of neighbours is the encoding of its own text.  So
for every prefix of a text there is exactly one last token, found from the last
tokens of shorter prefixes: a dynamic program over prefixes that never encodes
anything again.
"""

from __future__ import annotations

from collections.abc import Callable

#: Entries of a worker's memo tables, which are emptied when full (they only save time).
MEMO = 400_000


class PairAutomaton:
    """Tokens are strings of symbols; ``rank(a, b)`` orders merges, the lowest first, None where a pair doesn't merge."""

    def __init__(self, tokens: dict[str, int], rank: Callable[[str, str], float | None], made: dict[str, tuple[str, str]] | None = None):
        self.rank = rank
        #: How each token is made: the rank and the parts of its last merge.  One symbol is never made.
        self.made: dict[str, tuple[float, str, str]] = {}
        for t in tokens:
            if len(t) > 1:
                parts = made.get(t) if made is not None else self.last_merge(t)
                if parts:
                    self.made[t] = (rank(*parts), *parts)
        import ahocorasick

        self.tokens = [t for t in tokens if len(t) == 1 or t in self.made]
        #: Finds the tokens that end at each place of a text, the longest first.
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for i, t in enumerate(self.tokens):
            self.ends.add_word(t, (i, len(t)))
        self.ends.make_automaton()
        self.single = {t for t in self.tokens if len(t) == 1}
        self.pairs: dict[int, bool] = {}

    def last_merge(self, text: str) -> tuple[str, str] | None:
        """The two parts that merging a text ends with, None if it ends with more."""
        parts = list(text)
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at is None:
                return None
            if len(parts) == 2:
                return parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return None

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: no merge across the border comes before the merges that make a and b.

        The border is followed back in time: the later of the two merges beside it
        is undone, and the pair that is then at the border must not merge while
        both of its tokens are there.  At equal ranks the left merge comes first.
        """
        made, rank = self.made.get, self.rank
        until, or_at = float("inf"), False
        while True:
            r = rank(a, b)
            if r is not None and (r < until or (or_at and r == until)):
                return False
            left, right = made(a), made(b)
            if left and (not right or left[0] > right[0]):
                until, or_at, a = left[0], False, left[2]
            elif right:
                until, or_at, b = right[0], True, right[1]
            else:
                return True

    def may_follow(self, before: int, after: int) -> bool:
        """``fits`` for places in ``tokens``, remembered."""
        key = before << 20 | after
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            ok = self.pairs[key] = self.fits(self.tokens[before], self.tokens[after])
        return ok

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """For each prefix of 0, 1, 2, ... symbols: its number of tokens and the place of its last token in ``tokens``.

        All symbols of the text must be tokens.
        """
        n = len(text)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        known = self.pairs.get
        for end, (t, size) in self.ends.iter(text):
            j = end + 1
            if last[j] >= 0:
                continue
            i = j - size
            if i:
                ok = known(last[i] << 20 | t)
                if not (self.may_follow(last[i], t) if ok is None else ok):
                    continue
            last[j] = t
            counts[j] = counts[i] + 1
        return counts, last
