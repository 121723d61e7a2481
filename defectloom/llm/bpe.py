"""Byte-level BPE ids by the ``tokenizers`` library, with a bounded cache of text pieces.

A text is cut before each single space or newline that stands between two
characters other than white space. The byte-level pre-tokenizer never makes a
token across such a cut, so the ids of the pieces in a row are the ids of the
text. Pieces repeat, so most are looked up instead of encoded again.
"""

from __future__ import annotations

import gc
import os
import re
from struct import pack

#: White space of Python's ``\\s`` holds all that the pre-tokenizer's does.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that form one token run after a word.
_MARKS = ".,!?;:"
#: Pieces longer than this are encoded but not kept.
_LONGEST_KEPT = 48


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE uses for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Marks(dict):
    """Ids of a run of marks."""

    def __init__(self, model):
        self._tokenize = model.tokenize

    def __missing__(self, run: str) -> list[int]:
        ids = [t.id for t in self._tokenize(run)]
        if len(run) < 4:
            self[run] = ids
        return ids


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``cache_entries`` bounds the memory (about 200 bytes an entry); a full cache
    is emptied and refilled, which changes the speed and nothing else.
    """

    def __init__(self, path: str, cache_entries: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        letters = _byte_letters()
        self._letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self._entries = cache_entries
        self._marks = _Marks(self._model)
        self._cache: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        """The pieces; all but the first stand for one space and themselves, unless they begin with a newline or a space."""
        if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):  # only single spaces and newlines, none at the ends
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]
            return pieces
        pieces = _CUT.split(text)
        return ["\0" + pieces[0], *(p[1:] if p[0] == " " and p[1:2] not in ("\0", "\n", " ") else p for p in pieces[1:])]

    def _learn(self, new: set[str]) -> None:
        tokenize, letters, kept = self._model.tokenize, self._letters, self._cache
        odd: list[str] = []
        marks = self._marks
        space, line = "Ġ", [t.id for t in tokenize("Ċ")]
        for p in new:
            lead, ids = space, []
            word = p.rstrip(_MARKS)
            if not word.isalpha():
                if word[:1] not in ("\n", "\0") or not word[1:].isalpha():
                    odd.append(p)
                    continue
                lead, ids, word = "", line if word[0] == "\n" else [], word[1:]
            if word.isascii():
                ids = ids + [t.id for t in tokenize(lead + word)]
            elif _LATIN.fullmatch(word):
                ids = ids + [t.id for t in tokenize(lead + word.translate(letters))]
            else:
                odd.append(p)
                continue
            if p[-1] in _MARKS:
                ids += marks[p[len(p.rstrip(_MARKS)) :]]
            kept[p] = pack(f"<{len(ids)}I", *ids)
        full = [p[1:] if p[:1] == "\0" else p if p[:1] in (" ", "\n") else " " + p for p in odd]
        for p, e in zip(odd, self._tokenizer.encode_batch_fast(full, add_special_tokens=False)):
            kept[p] = pack(f"<{len(e.ids)}I", *e.ids)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        cut = [self._pieces(t) if t else [] for t in texts]
        found = [list(map(self._cache.get, pieces)) for pieces in cut]  # one look for each piece, as most are there
        lacking = [i for i, ids in enumerate(found) if None in ids]
        new = {p for i in lacking for p, ids in zip(cut[i], found[i]) if ids is None}
        if len(self._cache) + len(new) > self._entries:
            self._cache.clear()
        gc.disable()  # millions of small objects and no cycles
        try:
            self._learn(new)
        finally:
            gc.enable()
        for i in lacking:
            found[i] = [self._cache[p] if ids is None else ids for p, ids in zip(cut[i], found[i])]
        for p in new:
            if len(p) > _LONGEST_KEPT:
                del self._cache[p]
        return list(map(b"".join, found))


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cache_entries: int = 1_000_000) -> PieceEncoder:
    """The encoder of this Python worker, kept between its tasks."""
    key = (path, cache_entries)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cache_entries)
    return _ENCODERS[key]


def default_tokenizer() -> str:
    """The public 50k byte-level vocabulary; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
