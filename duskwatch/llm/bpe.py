"""Token ids of whole texts by the tokenizers library, with a bounded cache of words in front of it.

Both vocabularies used here split a text into words before they merge symbols, so a text's ids are the ids of its pieces
joined. A piece is cut only where the vocabulary's own splitting rule always cuts; whatever is not plainly such a place
goes to the library whole.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

from tokenizers import Tokenizer

# Letters and marks of ASCII and Latin-1 that every Unicode version agrees on; the apostrophe has rules of its own.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?([!-&(-/:-@\[-`{-~]*)\Z")
# White space other than single blanks and line ends, as UTF-8: where any occurs, the whole text goes to the library.
_OTHER_SPACE = [*(bytes([b]) for b in (0, 9, 11, 12, 13, 28, 29, 30, 31)), b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_OTHER_SPACE += [b"  ", b" \n", b"\n ", b"\n\n"]
_LATIN_1 = re.compile(r"[^\x00-\xff]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordCache(dict):
    """Ids of a piece of text as little-endian unsigned 32-bit integers; a missing piece is encoded and kept.

    When ``most`` pieces are held, the newer half goes: the oldest are the frequent ones. Control strings of the vocabulary
    get their one id, as the library has it; with ``spell`` they are plain text.
    """

    def __init__(self, path: str, most: int = 600_000, spell: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spell
        self.control = [] if spell else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.most = most
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and "Lowercase" in str(normalizer)

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece[piece[:1] == " " :].isalpha():
            ids = self._merge(piece)
        elif not piece:
            ids = b""
        elif (found := _PLAIN.match(piece)) is None:
            ids = self._whole(piece)
        else:
            word, marks = found.groups()
            ids = self[word] + self[marks] if word and marks else self._merge(word or marks)
        self[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _merge(self, word: str) -> bytes:
        """Merge the symbols of one word as the vocabulary's splitting rule yields it."""
        if self.lowers:
            word = word.lower().lstrip(" ")
        if word.isascii():
            word = word.replace(" ", "Ġ")
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def trim(self) -> None:
        if len(self) > self.most:
            kept = list(islice(self.items(), self.most // 2))
            self.clear()
            self.update(kept)

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; null is the empty text."""
        if not text:
            return b""
        if any(map(text.__contains__, self.control)):
            return self._whole(text)
        if self.lowers:
            # White space is dropped, so every blank is a place to cut. Lower-casing first only merges cache entries and is
            # done where it cannot differ from the library's order of steps.
            if _LATIN_1.search(text) is None:
                lower = text.lower()
                if any(map(lower.__contains__, self.control)):  # in the text's own letters it is none
                    return self._whole(text)
                text = lower
            pieces = text.replace("\n", " ").split(" ")
        elif not any(map(text.encode(errors="replace").__contains__, _OTHER_SPACE)):
            # A blank after a mark or letter starts a new word and belongs to it; a line end stands alone.
            pieces = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        else:
            pieces = [text]
        if len(pieces) == 1:
            return self._whole(text)
        ids = b"".join(map(self.__getitem__, pieces))
        self.trim()
        return ids


_CACHES: dict[tuple[str, int, bool], WordCache] = {}


def word_cache(path: str, most: int = 600_000, spell: bool = False) -> WordCache:
    """The cache of this Python worker for one vocabulary file."""
    if (path, most, spell) not in _CACHES:
        _CACHES[path, most, spell] = WordCache(path, most, spell)
    return _CACHES[path, most, spell]
