"""What the two public byte-level vocabularies share: their files, pre-tokens and byte letters.

Both vocabularies write each byte of a pre-token as one printable letter.  The library finds
special strings in the raw text first, then normalises and cuts the stretches between them.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

#: The cutting patterns written in the two vocabulary files.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """For each byte its letter: itself where printable, else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


def spelled(pretoken: str) -> str:
    """A pre-token in byte letters."""
    if pretoken.isascii() and pretoken.isalnum():
        return pretoken
    letters = byte_letters()
    return "".join([letters[b] for b in pretoken.encode("utf-8")])


#: What mostly follows a word at its end: there the cut is known without the pattern.
_STOPS = (".", ",")
_ODD = re.compile("[\x1c-\x1f]").search
#: Runs between blanks, which no pre-token of the first pattern crosses, and for the second the same with
#: the one blank before them; blanks before the last of a row stand alone.
_WORDS, _CHUNKS = str.split, re.compile(r" ?\S+|\s+(?!\S)|\s+").findall


class Cutter:
    """Texts to chunks, pre-tokens and special strings, as a vocabulary file says.

    Chunks are what a worker caches; a chunk is cut into pre-tokens only when it is not cached.
    """

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ordered = sorted(self.specials, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, ordered))) if ordered else None
        self._lower = spec["normalizer"] is not None
        self._find = regex.compile(WORD_PATTERN if self._lower else BYTE_PATTERN).findall
        self._path, self._library, self._plain = path, None, {}
        self.model = spec["model"]

    def chunks(self, stretch: str) -> list[str]:
        """A stretch without special strings, normalised and cut where pre-tokens end."""
        if not stretch.isascii() or _ODD(stretch):
            if not all(map(self._is_plain, set(stretch))):
                return self._by_library(stretch)
            if self._lower:
                if not unicodedata.is_normalized("NFC", stretch):
                    stretch = unicodedata.normalize("NFC", stretch)
                # Letter by letter: a final sigma is lowered like any other.
                stretch = stretch.replace("Σ", "σ")
        return _WORDS(stretch.lower()) if self._lower else _CHUNKS(stretch)

    def pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens of one chunk."""
        if type(chunk) is Pretoken:
            return [chunk]
        bare = chunk.removeprefix(" ")
        if bare.isalpha():
            return [chunk]
        if bare[-1:] in _STOPS and bare[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._find(chunk)

    def _is_plain(self, letter: str) -> bool:
        """Whether all Unicode versions agree about a letter: it is an old one, and no control that Python calls a blank."""
        known = self._plain.get(letter)
        if known is None:
            old = unicodedata.ucd_3_2_0.category(letter)
            known = self._plain[letter] = "Cn" != old == unicodedata.category(letter) and not "\x1c" <= letter <= "\x1f"
        return known

    def _by_library(self, stretch: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        library = self._library
        if library.normalizer is not None:
            stretch = library.normalizer.normalize_str(stretch)
        back = {x: b for b, x in enumerate(byte_letters())}
        cut = library.pre_tokenizer.pre_tokenize_str(stretch)
        return [Pretoken(bytes([back[x] for x in word]).decode("utf-8")) for word, _ in cut]

    def stretches(self, text: str):
        """Pairs (stretch, id of the special string behind it or None), in order."""
        if self._special is None or "<" not in text:
            yield text, None
            return
        at = 0
        for found in self._special.finditer(text):
            yield text[at : found.start()], self.specials[found.group()]
            at = found.end()
        yield text[at:], None


class Pretoken(str):
    """A pre-token that the library has cut; it is not cut again."""

    __slots__ = ()
    __hash__ = str.__hash__

    def __eq__(self, other):
        return type(other) is Pretoken and str.__eq__(self, other)


class BoundedCache(dict):
    """A worker's cache: computes what it lacks and is emptied when full."""

    def __init__(self, compute, limit: int):
        self._compute, self._limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self._limit:
            self.clear()
        value = self[key] = self._compute(key)
        return value


_kept: dict = {}


def kept_in_worker(key, make):
    """``make()`` once per Python worker and key; tasks that follow in the worker find it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]
