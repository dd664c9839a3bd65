"""Token ids of texts by a `tokenizers` file whose pieces never cross white space.

Such a tokenizer gives the same ids for a text as for its white-space chunks one after the other,
so a worker keeps a table chunk -> ids and joins entries by position. The table has two generations
of bounded size: memory stays bounded whatever the vocabulary, and every chunk is encoded in full.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable

import public_tokenizers
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
#: Entries of one generation of a worker's table; about 150 bytes each, two generations are held.
MOST_CHUNKS = 500_000
#: Longer chunks (bytes) are encoded each time instead of being kept.
LONGEST_KEPT = 48

#: How that tokenizer divides lower-cased ASCII (a fixed value of its file).
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LETTERS_THEN_MARKS = re.compile(r"([^\W\d_]+)([!-&*-/:;=>?@]*)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Latin letters below this have simple lower-case forms in every Unicode version.
_LATIN_END = "\u0250"
_BYTE_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Chunk of UTF-8 bytes -> its ids as little-endian unsigned 32-bit integers.

    Entries come from the library: plain ASCII chunks and Latin words straight from its model (their
    normalisation is lower case, their division the patterns above), all else from its whole pipeline.
    """

    def __init__(self, path: str | None = None) -> None:
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path or public_tokenizers.path(WORD_BPE))
        self._pieces = self._tokenizer.model.tokenize
        self._old: dict[bytes, bytes] = {}

    def _word(self, letters: str) -> bytes:
        """Ids of one word or run of marks, in the letters of the vocabulary."""
        return _packed([piece.id for piece in self._pieces(letters)])

    def _made(self, chunk: bytes) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self._word(low.decode("ascii")) if low == chunk else self[low]
            word = low.rstrip(_ASCII_MARKS)
            if word.isalpha():
                return self[word] + self[low[len(word) :]]
            text = low.decode("ascii")
            if text.isprintable() and "<|" not in text:
                parts = _ASCII_WORDS.findall(text)
                if len(parts) == 1:
                    return self._word(text)
                return b"".join([self[part.encode("ascii")] for part in parts])
        text = chunk.decode("utf-8")
        if parts := _LETTERS_THEN_MARKS.fullmatch(text):
            word = parts[1].lower()
            if word.isalpha() and parts[1].isalpha() and max(parts[1]) < _LATIN_END:
                if unicodedata.is_normalized("NFC", parts[1]):
                    if word != text:
                        marks = parts[2].encode("ascii")
                        return self[word.encode("utf-8")] + (self[marks] if marks else b"")
                    return self._word(chunk.decode("latin-1").translate(_BYTE_LETTERS))
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return _packed(ids)

    def __missing__(self, chunk: bytes) -> bytes:
        value = self._old.get(chunk)
        if value is None:
            value = self._made(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= MOST_CHUNKS:
                self._old = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null counts as empty. Chunks lie between ASCII white space."""
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8").split()))


@functools.cache
def word_ids(path: str | None = None) -> WordIds:
    """The table of this worker process, kept from task to task."""
    return WordIds(path)


def crc(data: bytes | memoryview) -> int:
    return zlib.crc32(data)


def texts_of(batch, id_column: int = 0, text_column: int = 1) -> Iterable[tuple[int | None, str | None]]:
    return zip(batch.column(id_column).to_pylist(), batch.column(text_column).to_pylist())
