"""Token ids of whole texts, with the ids of each distinct word asked of the tokenizer once.

The tokenizer lower-cases, drops white space and never joins anything across
it, so the ids of a text are those of its words between white space.  A word
seen twice before is one dictionary look-up, and numpy gathers the ids of a text;
another word is split into letters, digits and other signs, each piece of which is
encoded by itself.  Texts with characters beyond Latin letters give their words
to the tokenizer whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Words and pieces that a Python worker remembers (about 100 MB in all); what came once only is not among them.
REMEMBERED = 350_000
#: For one word remembered, words whose ids are held, remembered or not, before all is forgotten.
HELD = 7
_LATIN = re.compile("[\t-\r\x20-\x7e\xa1-ɏ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s]|_)+")


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class _Seen:
    """Tells whether a text was probably asked for before: one flag for each of four million hashes."""

    def __init__(self):
        self.flags = bytearray(1 << 22)

    def before(self, text: str) -> bool:
        at = hash(text) & 0x3FFFFF
        known, self.flags[at] = self.flags[at], 1
        return known == 1


class _Words(dict):
    """Number of each word that came twice, by its text; others are encoded when they are looked up."""

    def __init__(self, encode: Callable[[str], list[int]], remembered: int):
        super().__init__()
        self.encode, self.remembered, self.seen = encode, remembered, _Seen()
        self.flat = array("I")
        self.start = array("q", [0])

    def __missing__(self, word: str) -> int:
        at = len(self.start) - 1
        self.flat.extend(self.encode(word))
        self.start.append(len(self.flat))
        if self.seen.before(word):
            self[word] = at
        return at

    def full(self) -> bool:
        return len(self) > self.remembered or len(self.start) > HELD * self.remembered

    def ids(self, words: list[str], last: int) -> np.ndarray:
        """Ids of all words in order, and `last` behind them."""
        k = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        start = np.frombuffer(self.start, dtype=np.int64)
        first = start[k]
        count = start[k + 1] - first
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = np.empty(total + 1, dtype=np.uint32)
        out[:-1] = np.frombuffer(self.flat, dtype=np.uint32)[np.arange(total) + np.repeat(first - (ends - count), count)]
        out[-1] = last
        return out


class CachedTokenizer:
    """Encodes texts with a tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.end_id, self.remembered = end_id, remembered
        self._forget()
        self.pieces, self.seen = {}, _Seen()

    def _forget(self) -> None:
        self.latin, self.other = _Words(self._word, self.remembered), _Words(self._chunk, self.remembered)

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            letters = _byte_letters()
            found = tuple([t.id for t in self.whole.model.tokenize("".join([letters[b] for b in piece.encode()]))])
            if self.seen.before(piece):
                if len(self.pieces) >= self.remembered:
                    self.pieces, self.seen = {}, _Seen()
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> list[int]:
        return [i for piece in _SPLIT.findall(word) for i in self._piece(piece)]

    def _chunk(self, chunk: str) -> list[int]:
        return self.whole.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text followed by end_id, as uint32; a null text has end_id alone."""
        if self.latin.full() or self.other.full():
            self._forget()
        text = text or ""
        if _LATIN.fullmatch(text) and "<|" not in text:  # in these, white space is ASCII and normal form C changes nothing
            return self.latin.ids(text.lower().split(), self.end_id)
        return self.other.ids([c.decode() for c in text.encode().split()], self.end_id)


@lru_cache(maxsize=2)
def worker_tokenizer(path: str, end_id: int, remembered: int = REMEMBERED) -> CachedTokenizer:
    """The tokenizer of this Python worker, which the tasks it runs one after the other share."""
    return CachedTokenizer(path, end_id, remembered)
