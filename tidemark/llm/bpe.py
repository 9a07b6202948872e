"""Byte-pair encodings as paths: exact token counts at every prefix by dynamic programming.

A sequence of tokens is the encoding of its text exactly if every two neighbours are the encoding of their
own text.  So the last token of each prefix can be found from those of shorter prefixes, and with it the
prefix's token count, in one pass and without merging anything.

Whether two neighbours are the encoding of their own text is read off the merges that formed them.  Where a
token's rank is above those of its parts, as in every trained vocabulary, merges happen in the order of rank.
Going back in time from the finished pair, the token that was formed last is undone, and what then meets at the
border must not merge before that token was formed; ties go to the left.  Vocabularies without that order are
merged instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import ahocorasick


class Remembered(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Paths:
    """Encoding paths of a vocabulary.

    ``tokens``: the tokens as strings, with their ids.  ``rank(a, b)``: the rank of the merge of two
    neighbours, None if they don't merge; the lowest rank merges first, leftmost among equals.  A character
    that is no token stands alone and never merges.  One automaton finds all tokens that end at a place.
    """

    def __init__(self, tokens: dict[str, int], rank: Callable, pairs: int = 1 << 17):
        self.tokens, self.rank = tokens, rank
        self.names = {i: t for t, i in tokens.items()}
        self.width = max(tokens.values()) + 1
        self.automaton = ahocorasick.Automaton()
        for token, i in tokens.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        self.ordered = True
        self.fits = Remembered(self._fit, pairs)
        self.whole = Remembered(lambda i: len(self.merged(self.names[i])) == 1, pairs)
        self.formed = Remembered(self._formed, pairs)

    def _formed(self, token: str) -> tuple[float, str, str]:
        """(rank of the token's last merge, its left and right part); single characters have rank -1."""
        if len(token) == 1:
            return -1.0, token, token
        parts, at = self._merge(token)
        if len(parts) != 1:
            return math.inf, token, token
        left, right = token[:at], token[at:]
        rank = self.rank(left, right)
        if any(len(x) > 1 and self.formed[x][0] >= rank for x in (left, right)):
            self.ordered = False
        return rank, left, right

    def _fit(self, pair: int) -> bool:
        a, b = (self.names[i] for i in divmod(pair, self.width))
        rank, formed = self.rank, self.formed
        (of_x, _, right), (of_y, left, _) = formed[a], formed[b]
        if of_x == math.inf or of_y == math.inf:
            return False
        x, y, limit, tie = a, b, math.inf, False
        while True:
            r = rank(x, y)
            if r is not None and (r < limit or tie and r == limit):
                return not self.ordered and self.merged(a + b) == [a, b]
            if of_x == of_y == -1.0:
                return self.ordered or self.merged(a + b) == [a, b]
            if of_x > of_y:
                limit, tie, x = of_x, False, right
                of_x, _, right = formed[x]
            else:
                limit, tie, y = of_y, True, left
                of_y, left, _ = formed[y]

    def merged(self, text: str) -> list[str]:
        """The encoding by merging, for short texts."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], int]:
        """(encoding, where the last merge was, in characters)."""
        parts, last = list(text), 0
        rank = self.rank
        ranks = [rank(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            least, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (least is None or r < least):
                    least, at = r, i
            if least is None:
                return parts, last
            last = sum(map(len, parts[: at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = rank(parts[at], parts[at + 1])

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """(counts, last): tokens in each prefix, the empty one first, and the last token's id (-1: no token)."""
        n = len(text)
        counts, last, done = [0] * (n + 1), [None] * (n + 1), 0
        last[0] = -1
        fits, whole, width = self.fits, self.whole, self.width
        for end, (size, token) in self.automaton.iter(text):
            i = end + 1
            if last[i] is not None:
                continue
            if done < end:
                for k in range(done + 1, i):
                    if last[k] is None:
                        self._unmatched(text, k, counts, last)
                done = end
            j = i - size
            before = last[j]
            if fits[before * width + token] if before >= 0 else whole[token]:
                counts[i], last[i] = counts[j] + 1, token
        for k in range(done + 1, n + 1):
            if last[k] is None:
                self._unmatched(text, k, counts, last)
        return counts, last

    def _unmatched(self, text: str, k: int, counts: list[int], last: list) -> None:
        """A prefix that ends in a character that is no token; by merging, if ever tokens don't fit."""
        if text[k - 1] not in self.tokens:
            counts[k], last[k] = counts[k - 1] + 1, -1
        else:
            found = self.merged(text[:k])
            counts[k], last[k] = len(found), self.tokens.get(found[-1], -1)

    def path(self, text: str) -> list[str]:
        """The tokens of a text, read back from the table."""
        _, last = self.table(text)
        out, i = [], len(text)
        while i:
            token = self.names[last[i]] if last[i] >= 0 else text[i - 1]
            out.append(token)
            i -= len(token)
        return out[::-1]
