"""Values of pre-tokens, remembered while texts are worked off.

Byte-level BPE treats each pre-token on its own, so what a text comes to is the sum (or the joining) of what its
pre-tokens come to. Texts are cut at single spaces first, which is much faster than the split pattern; a piece with the
space before it splits into the same pre-tokens as in the text unless white space meets white space there, and such
texts take the pattern's way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import regex

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceMemory:
    """``learn`` gives the values of new pre-tokens, ``combine`` puts values together, ``specials`` have their own.

    Values live in two generations of at most ``room`` each: a full one becomes the old one, and what is met again moves
    to the new one, so that common pre-tokens stay and the rest is forgotten in time.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable[Any]], combine: Callable[[Iterable[Any]], Any], specials: dict[str, Any], room: int):
        self.learn, self.combine, self.specials, self.room = learn, combine, specials, room
        self.pattern = regex.compile(PATTERN)
        strings = sorted(specials, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.words: dict[str, Any] = {}
        self.pieces: dict[str, Any] = {}
        self.old_words: dict[str, Any] = {}
        self.old_pieces: dict[str, Any] = {}

    def _age(self) -> None:
        if len(self.words) > self.room:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > self.room:
            self.pieces, self.old_pieces = {}, self.pieces

    @staticmethod
    def _renewed(wanted: set[str], now: dict[str, Any], old: dict[str, Any]) -> set[str]:
        """What neither generation knows; what the old one knows moves on."""
        missing = wanted.difference(now)
        known = {k for k in missing if k in old}
        now.update((k, old[k]) for k in known)
        return missing - known

    def _learn(self, words: set[str]) -> None:
        new = list(self._renewed(words, self.words, self.old_words))
        self.words.update(zip(new, self.learn(new)))

    def _split(self, piece: str) -> list[str]:
        """The pre-tokens of a space and the piece; most are letters, or letters and one mark, and need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.pattern.findall(" " + piece)

    def _learn_pieces(self, pieces: set[str]) -> None:
        pieces = self._renewed(pieces, self.pieces, self.old_pieces)
        split = {p: self._split(p) for p in pieces if p and not p[0].isspace() and not p[-1].isspace()}
        self._learn({w for words in split.values() for w in words})
        value = self.words.__getitem__
        self.pieces.update((p, self.combine(map(value, split[p])) if p in split else None) for p in pieces)

    def _by_pattern(self, text: str) -> Any:
        words = self.pattern.findall(text)
        self._learn(set(words))
        return self.combine(map(self.words.__getitem__, words))

    def _plain(self, texts: list[str]) -> list[Any]:
        self._age()
        split = [t.split(" ") for t in texts]
        self._learn_pieces(set().union(*(s[1:] for s in split)))
        heads = [self.pattern.findall(s[0]) for s in split]  # the first piece has no space before it
        self._learn(set().union(*heads))
        out = []
        for text, begun, (head, *rest) in zip(texts, heads, split):
            values = [self.pieces[p] for p in rest]
            if None in values or (rest and not head) or (head and head[-1].isspace()):
                out.append(self._by_pattern(text))
            else:
                out.append(self.combine([*map(self.words.__getitem__, begun), *values]))
        return out

    def values(self, texts: list[str]) -> list[Any]:
        """The value of each text."""
        if not any(s in t for s in self.specials for t in texts):
            return self._plain(texts)
        out = []
        for text in texts:
            parts = self.special_pattern.split(text)  # plain, special, plain, ...
            plain = self._plain(parts[::2])
            out.append(self.combine(v for i, p in enumerate(parts) for v in [plain[i // 2] if i % 2 == 0 else self.specials[p]]))
        return out
