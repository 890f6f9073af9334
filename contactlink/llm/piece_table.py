"""Token ids of whole batches of texts, looked up by the distinct pieces of the batch.

Texts are cut, on their bytes and many at once, where a tokenizer's split pattern is sure to cut as well: between letters,
digits, marks and white space whose kind the bytes alone tell. A piece keeps the space before it. Every piece then comes
to the same ids wherever it stands, so the distinct pieces of a batch are found in Arrow, each is looked up once, and the
ids of all of them are gathered from one flat array. Only pieces not met before reach the ``tokenizers`` library. A table
that is full forgets the pieces that it has not met for longest.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from contactlink.llm.tables import bytes_of
from contactlink.llm.token_counts import byte_symbols

#: Pieces a table holds: about 200 bytes each.
ROOM = 800_000
SLICE_BYTES = 4 << 20
GROUP = 500

LETTER, DIGIT, MARK, SPACE, BREAK, UNSURE = range(6)


def _kinds() -> np.ndarray:
    """Kind of each byte. Apostrophes, which may begin a contraction, control characters that some call white space, and
    bytes of most characters beyond ASCII are not sure."""
    kind = np.full(256, MARK, np.uint8)
    kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    kind[[*range(ord("0"), ord("9") + 1)]] = DIGIT
    kind[ord(" ")] = SPACE
    kind[[*range(0x09, 0x0E)]] = BREAK
    kind[[ord("'"), *range(0x1C, 0x20), *range(0x7F, 0x100)]] = UNSURE
    return kind


KIND = _kinds()
# First bytes of two-byte characters that are letters, and the characters among them that are not, or whose
# lower case is not one letter: the multiplication and division signs, the dotted capital I.
LETTER_LEADS = [0xC3, 0xC4, 0xC5, 0xD0, 0xD1]
NOT_LETTERS = ["×", "÷", "İ"]
IS_LEAD = np.zeros(256, bool)
IS_LEAD[LETTER_LEADS] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts; every text begins one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = KIND[data]
    leads = np.flatnonzero(IS_LEAD[data[:-1]])
    if len(leads):
        pair = data[leads].astype(np.uint16) << 8 | data[leads + 1]
        leads = leads[~np.isin(pair, [int.from_bytes(c.encode(), "big") for c in NOT_LETTERS])]
        kind[leads] = LETTER
        kind[leads + 1] = LETTER
    left, right = kind[:-1], kind[1:]
    sure = kind < SPACE
    white = (kind == SPACE) | (kind == BREAK)
    cut = np.zeros(n, bool)
    cut[1:] = sure[:-1] & sure[1:] & (left != right)  # another kind of character
    cut[1:] |= sure[:-1] & white[1:]  # white space begins
    begins = offsets[:-1][offsets[:-1] < n]
    last = white[:-1] & sure[1:]  # the last of a run of white space before a sure character of the same text
    last[begins[begins > 0] - 1] = False
    cut[:-1] |= last
    cut[1:] |= last & (left == BREAK)  # all but a space stand alone
    cut[begins] = True
    return np.flatnonzero(cut)


class PieceTable:
    """``learn`` gives the ids of new pieces, one piece after the other, and how many each has. ``specials`` are strings with ids of their own, cut out before all else. All
    ids are under ``vocabulary``."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], specials: dict[str, int], room: int = ROOM):
        self.learn, self.specials, self.room = learn, specials, room
        self.vocabulary = 1 << 32
        strings = sorted(specials, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.begin, self.length, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.round = 0

    def _add(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self.number), len(pieces)
        while first + n > len(self.begin):
            self.begin, self.length, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.length, self.met))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.begin[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.met[first : first + n] = self.round
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(pieces, range(first, first + n)))

    def _forget(self) -> None:
        """Keep, of a full table, half the room: what was met last."""
        if len(self.number) <= self.room:
            return
        met = self.met[: len(self.number)]
        place = len(met) - self.room // 2
        oldest = np.partition(met, place)[place]
        kept = [(p, k) for p, k in self.number.items() if met[k] > oldest]
        numbers = np.fromiter((k for _, k in kept), np.int64, len(kept))
        ids, lengths, met = self.gathered(numbers), self.length[numbers], met[numbers]
        self.number, self.used = {}, 0
        self._add([p for p, _ in kept], ids, lengths)
        self.met[: len(kept)] = met

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of all the entries, one after the other."""
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + lengths, lengths)
        return self.flat[at]

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """Entry of each piece; the pieces are distinct."""
        found = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [distinct[i] for i in missing]
            found[missing] = np.arange(len(self.number), len(self.number) + len(new))
            self._add(new, *self.learn(new))
        self.met[found] = self.round
        return found

    def _looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The entries of all pieces, and where each text's ids begin and end."""
        data, offsets = bytes_of(texts)
        starts = piece_starts(data, offsets)
        self.round += 1
        self._forget()
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        numbers = self.numbers(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.length[numbers])])
        return numbers, ends[np.searchsorted(starts, offsets)]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, bounds = self._looked_up(texts)
        return self.gathered(numbers), bounds

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has, without the ids. Strings of special tokens count as the text they are."""
        return np.diff(self._looked_up(texts.fill_null(""))[1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin and end. Nulls are empty."""
        texts = texts.fill_null("")
        with_special = pa.array(np.zeros(len(texts), bool))
        for special in self.specials:
            with_special = pc.or_(with_special, pc.match_substring(texts, special))
        if not pc.any(with_special).as_py():
            return self._plain(texts)
        # Parts of all texts as texts of their own: plain, special, plain, ...
        parts = [self.special_pattern.split(t) if s else [t] for t, s in zip(texts.to_pylist(), with_special.to_pylist())]
        ids, bounds = self._plain(pa.array([p for cut in parts for p in cut[::2]], pa.large_string()))
        between = np.split(ids, bounds[1:-1])
        values, at = [], 0
        for cut in parts:
            own = [between[at]]
            for special in cut[1::2]:
                at += 1
                own += [np.array([self.specials[special]], "<u4"), between[at]]
            at += 1
            values.append(np.concatenate(own))
        return np.concatenate(values), np.cumsum([0, *map(len, values)])

    def in_slices(self, texts: pa.Array, slice_bytes: int = SLICE_BYTES):
        """``encode`` over stretches of about ``slice_bytes``: first row, ids and bounds of each."""
        sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
            yield start, *self.encode(texts.slice(start, stop - start))
            start = stop


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return encode, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, 1 + max(tokenizer.get_vocab().values())


def _in_groups(words: list[str], chosen: np.ndarray, together: Callable[[list[str]], np.ndarray], mark: int, alone: Callable[[list[str]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words and how many each has: the chosen ones many at once, told apart by the id ``mark``, the others one by one."""
    parts, owners, sizes = [], [], []
    rest = [np.setdiff1d(np.arange(len(words)), chosen)]
    for at in range(0, len(chosen), GROUP):
        group = chosen[at : at + GROUP]
        ids = together([words[i] for i in group])
        cuts = np.flatnonzero(ids == mark)
        if len(cuts) != len(group) - 1:  # some word holds the mark after all
            rest.append(group)
            continue
        parts.append(np.delete(ids, cuts))
        owners.append(group)
        sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
    single = np.concatenate(rest)
    for at in range(0, len(single), GROUP):
        values = alone([words[i] for i in single[at : at + GROUP]])
        parts += values
        owners.append(single[at : at + GROUP])
        sizes.append(np.fromiter(map(len, values), np.int64, len(values)))
    if not parts:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    flat, owner, size = np.concatenate(parts), np.concatenate(owners), np.concatenate(sizes)
    order = np.argsort(owner, kind="stable")
    lengths = size[order]
    ends = np.cumsum(lengths)
    return flat[np.arange(len(flat)) + np.repeat((np.cumsum(size) - size)[order] - ends + lengths, lengths)], lengths


@functools.cache
def byte_table(path: str, room: int = ROOM) -> PieceTable:
    """The table of a byte-level BPE file; special strings as the library's default has it."""
    encode, specials, vocabulary = _library(path)
    from tokenizers import Tokenizer, pre_tokenizers

    # The same model without the split pattern: words of letters are pre-tokens, and their bytes are written as its symbols.
    model = Tokenizer.from_file(path)
    model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    symbols = {byte: char for char, byte in byte_symbols().items()}
    feed, mark = encode(["\n"])[0], symbols[ord("\n")]
    if len(feed) != 1:
        raise ValueError(f"{path}: a line feed must be one token")

    def together(words: list[str]) -> np.ndarray:
        text = "\n".join(words).encode().decode("latin-1").translate(symbols).replace(mark, f" {mark} ")
        return np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.flatnonzero([w.isalpha() or (w[0] == " " and w[1:].isalpha()) for w in words])
        return _in_groups(words, letters, together, int(feed[0]), encode)

    table = PieceTable(learn, specials, room)
    table.vocabulary = vocabulary
    return table


@functools.cache
def word_table(path: str, room: int = ROOM) -> PieceTable:
    """The table of a file that drops white space; special strings as the library's default has it."""
    encode, specials, vocabulary = _library(path)
    mark = encode(["|"])[0]
    if len(mark) != 1 or not np.array_equal(np.concatenate(encode(["a", "|", "a"])), encode([" a | a"])[0]):
        raise ValueError(f"{path}: white space must set words apart and be dropped")

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.flatnonzero(["|" not in w for w in words])
        return _in_groups(words, chosen, lambda group: encode([" | ".join(group)])[0], int(mark[0]), encode)

    table = PieceTable(learn, specials, room)
    table.vocabulary = vocabulary
    return table
