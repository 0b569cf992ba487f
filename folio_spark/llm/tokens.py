"""Token ids of whole texts, computed once per distinct word of a Python worker."""

from __future__ import annotations

import os
import string
import unicodedata
from array import array

PUNCTUATION = string.punctuation.encode()
#: Bytes of texts in which every character beyond ASCII is a letter of U+00C0 to U+017F (or one of two signs).
PLAIN = b"\t\n\r" + bytes(range(32, 127)) + bytes(range(0x80, 0xC0)) + b"\xc3\xc4\xc5"
#: Every ASCII mark shown as one letter, so that two marks side by side are found by a search.
MARKS = bytes.maketrans(PUNCTUATION, b"!" * len(PUNCTUATION))
#: Distinct words a worker remembers; the memory is emptied when it is full.
REMEMBERED = 250_000
WORKERS: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Encoder(dict):
    """Ids of texts under a ``tokenizers`` file whose words never cross white space.

    The file splits a text into words at white space, and letters from punctuation, before it
    merges anything, so ids of a text are the ids of its space-separated pieces put together.
    Each distinct piece is encoded once and then looked up: this dictionary has the ids of the
    pieces met. A text with the opening of a special token takes the library's own way.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: bytes) -> bytes:
        # Letters that composition and lower-casing leave alone form a single word of the
        # tokenizer's; its merges apply to them directly.
        if word.isalpha():
            return array("I", [x.id for x in self.merge(word.decode())]).tobytes()
        text = word.decode()
        if (
            text.isalpha()
            and max(text) < "ɐ"
            and text == text.lower()
            and unicodedata.is_normalized("NFC", text)
        ):
            shown = "".join([self.letters[b] for b in word])
            return array("I", [x.id for x in self.merge(shown)]).tobytes()
        return self.whole(text)

    def __missing__(self, piece: bytes) -> bytes:
        core = piece.strip(PUNCTUATION)
        ids = None
        if core and core != piece:
            at = piece.index(core)
            before, after = piece[:at], piece[at + len(core) :]
            text = core.decode()
            # Punctuation is a word of its own beside a letter or digit, except that an
            # apostrophe may open a contraction.
            if not before.endswith(b"'") and alone(text[0]) and alone(text[-1]):
                ids = b"".join([self[x] for x in (before, core, after) if x])
        if ids is None:
            ids = self.word(piece)
        self[piece] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        if b"<|" in text:
            return self.whole(text.decode())
        text = text.lower()
        # Commas and stops after a letter or digit become pieces of their own, so that fewer
        # distinct pieces are met.
        if (
            not text.translate(None, PLAIN)
            and b"!!" not in text.translate(MARKS)
            and b"\xc3\x97" not in text
            and b"\xc3\xb7" not in text
            and "İ".encode() not in text
        ):
            text = text.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
        if len(self) > REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def alone(letter: str) -> bool:
    return letter.isalpha() and letter < "ɐ" and letter != "İ" or letter.isascii() and letter.isdigit()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for later tasks."""
    if path not in WORKERS:
        WORKERS[path] = Encoder(path)
    return WORKERS[path]
