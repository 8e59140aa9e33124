"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

No token of either vocabulary spans a change from a visible character to white space, so a
text may be cut there and its pieces encoded apart. A worker keeps the ids of the pieces it
has met, at most ``KEPT`` of them; when that many are kept it starts anew, which costs time
and changes no result.
"""

from __future__ import annotations

import os
import re
import struct

from tokenizers import Tokenizer

from joblattice.llm.common import held

KEPT = 1_000_000
# Control characters that str.split() takes for white space and the vocabularies don't.
ODD_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
# Marks that follow letters as one token of their own; not the apostrophe, and not the start of a
# special token.
MARKS = ",.;:!?*#%&$()[]{}-_/|+=~^@"
# Words of ASCII and Latin letters that are one code point in any normal form and in either case (not "\u0130").
PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
# The byte-level signs: visible Latin-1 characters for themselves, the other bytes from 256 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


def load(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class RunsOn(Exception):
    """A piece ends with white space, so that it runs on into the next piece."""


class KnownPieces(dict):
    """Ids of pieces as bytes; a piece not met before is encoded when it is looked up.

    A word of plain letters goes to the library's model, past its normalizer and pre-tokenizer, which
    would lower its case (vocabulary without white space), spell its bytes and leave it whole. Letters and the marks after them are encoded apart, so "word" serves "word,"
    and "word!!", and so are lines. All other pieces go through the whole library.
    """

    def __init__(self, tokenizer: Tokenizer, keeps_space: bool):
        super().__init__()
        self.tokenizer, self.model, self.keeps_space = tokenizer, tokenizer.model, keeps_space
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, text: str) -> bytes:
        if not self.keeps_space and text != (lower := text.lower()):
            return self[lower]
        spelled = text if text.isascii() and text[0] != " " else text.encode().decode("latin-1").translate(BYTE_SIGNS)
        return _packed([t.id for t in self.model.tokenize(spelled)])

    def __missing__(self, piece: str) -> bytes:
        if self.keeps_space:
            if piece[-1:].isspace():
                raise RunsOn
            if "\n" in piece:
                lines = piece.split("\n")
                if all(lines) and not any(l[-1].isspace() for l in lines) and not any(l[0].isspace() for l in lines[1:]):
                    return self.line_end.join(map(self.__getitem__, lines))
        if PLAIN(piece):
            ids = self.word(piece)
        else:
            body = piece.rstrip(MARKS)
            if len(body) < len(piece) and body.lstrip(" ").isalpha():
                ids = self[body] + self[piece[len(body) :]]
            else:
                ids = self.whole(piece)
        self[piece] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Texts to little-endian unsigned 32-bit ids.

    ``keeps_space``: white space belongs to the tokens (byte-level vocabulary); else it is
    dropped (vocabulary with word ends).
    """

    def __init__(self, path: str, keeps_space: bool, kept: int = KEPT):
        self.tokenizer, self.keeps_space, self.kept = load(path), keeps_space, kept
        self.known = KnownPieces(self.tokenizer, keeps_space)

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it has to be encoded as a whole."""
        if not self.keeps_space:
            return None if any(c in text for c in ODD_SPACES) else text.split()
        return None if "\0" in text else text.replace(" ", "\0 ").split("\0")

    def _ids(self, text: str) -> bytes:
        if len(self.known) > self.kept:
            self.known.clear()
        pieces = self._pieces(text)
        try:
            return self.known.whole(text) if pieces is None else b"".join(map(self.known.__getitem__, pieces))
        except RunsOn:
            return self.known.whole(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        return list(map(self._ids, texts))


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """One encoder per worker and vocabulary."""
    return held(PieceEncoder, path, keeps_space)


def slices(batch, size: int = 256):
    """An Arrow batch in slices of at most ``size`` rows, to bound what Python holds."""
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)
