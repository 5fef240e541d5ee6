"""Token ids of whole texts with a tokenizer file of the tokenizers library, inside Arrow batches.

A text is cut where no token can cross: before the spaces of the next word, and between letters and an ASCII
character that is none. Each distinct piece is encoded by the library once and remembered as bytes, up to a
bound; a text's ids are the joined bytes of its pieces. Words repeat so much that this takes a small part of
encoding every text anew, and the ids are those of the whole text (a test compares them).
"""

from __future__ import annotations

import re
from array import array

from murmur.llm.common import single_threaded_tokenizers

_SPACE = r" \t\n\r\x0b\x0c"
_LETTER = r"A-Za-zÀ-ÖØ-öø-įı-ſ"  # without the one letter that lower case makes two characters
_NO_LETTER = r"\x00-@\[-`{-\x7f"
#: Spaces that engines count differently: a text with one of them is encoded whole.
_UNSURE = re.compile("[\x1c-\x1f\x85  ᠎ -‍    ⁠　﻿]")
#: Pieces with the spaces before them, for byte-level tokenizers, and without, for those that drop spaces.
_WITH_SPACE = re.compile(f"[{_SPACE}]*(?:[{_LETTER}]+(?=[{_NO_LETTER}]|$)|[^{_SPACE}]+)|[{_SPACE}]+")
_WITHOUT = re.compile(f"[{_LETTER}]+(?=[{_NO_LETTER}]|$)|[^{_SPACE}]+")


#: A character outside Latin letters, digits and signs that lower case maps one to one.
_NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: A piece that is one word for any tokenizer.
_WORD = re.compile(f" ?[{_LETTER}]+").fullmatch
_PROBES = ("a", " a", "word", " Word", " ñandú", "Élan", " thntonble")


def _byte_characters() -> dict[str, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """piece -> bytes of its ids; what is asked for in vain is noted."""

    def __init__(self):
        super().__init__()
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.missing.append(piece)


class TextEncoder:
    """encode(text) -> ids as little-endian unsigned integers of the given width in bytes."""

    def __init__(self, path: str, width: int = 4, most: int = 200_000):
        single_threaded_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = {2: "H", 4: "I"}[width]
        if self.tokenizer.get_vocab_size(True) > 256**width:
            raise ValueError(f"{path} has more ids than {width} bytes hold")
        self.most = most
        self.known, self.older = _Known(), _Known()
        drops_spaces = self.whole("a b") == self.whole("a") + self.whole("b")
        self.cut = (_WITHOUT if drops_spaces else _WITH_SPACE).findall
        self.model, self.normalizer, self.characters = self.tokenizer.model, self.tokenizer.normalizer, _byte_characters()
        latin = [c for c in map(chr, range(0x250)) if re.match(f"[{_LETTER}]", c)]
        self.lowers = self.normalizer is not None and all(self.normalizer.normalize_str(c) == c.lower() for c in latin)
        probes = [p.strip() for p in _PROBES] if drops_spaces else _PROBES
        self.words_alone = all(self._word(p) == self.whole(p) for p in probes)

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A single word goes to the library's model without the steps that whole texts need."""
        if self.lowers:
            word = word.lower()
        elif self.normalizer is not None:
            word = self.normalizer.normalize_str(word)
        return array(self.kind, [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.characters))]).tobytes()

    def encode(self, text: str) -> bytes:
        if _UNSURE.search(text):
            return self.whole(text)
        if self.lowers and not _NOT_LATIN.search(text):
            text = text.lower()  # fewer distinct pieces
        pieces, known = self.cut(text), self.known
        found = list(map(known.__getitem__, pieces))
        if known.missing:
            self._learn()
            found = [known[p] if b is None else b for p, b in zip(pieces, found)]
        return b"".join(found)

    def _learn(self) -> None:
        """Two generations bound what is remembered: a full one becomes the older, what it is asked for comes back."""
        new = []
        for piece in dict.fromkeys(self.known.missing):
            if piece in self.older:
                self.known[piece] = self.older[piece]
            elif self.words_alone and _WORD(piece):
                self.known[piece] = self._word(piece)
            else:
                new.append(piece)
        for piece, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[piece] = array(self.kind, e.ids).tobytes()
        self.known.missing.clear()

    def forget(self) -> None:
        """To be called between batches."""
        if len(self.known) > self.most:
            self.known, self.older = _Known(), self.known


_encoders: dict[tuple[str, int], TextEncoder] = {}


def encoder(path: str, width: int = 4) -> TextEncoder:
    """One encoder a Python worker, so that what it has learnt serves the worker's next tasks."""
    if (path, width) not in _encoders:
        _encoders[path, width] = TextEncoder(path, width)
    return _encoders[path, width]
