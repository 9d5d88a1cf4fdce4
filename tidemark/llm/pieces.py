"""Pre-tokens of byte-level BPE, and their ids by a public tokenizer, remembered per task."""

from __future__ import annotations

import re

import regex

#: Fixed value: the split pattern of the public tokenizers (``public_tokenizers.PATTERN``).
#: ``\s`` is Unicode's White_Space in the tokenizers' own engines, so it is spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Below U+0250 the classes are short lists, which the standard engine matches faster.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_NARROW = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    rf"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_WIDE_CHARACTER = re.compile("[^\x00-ɏ]")
_WIDE = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

#: Bytes as the printable characters by which byte-level vocabularies name them.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def split(text: str) -> list[str]:
    """The pre-tokens of a text, in order; together they are the text."""
    return _WIDE.findall(text) if _WIDE_CHARACTER.search(text) else _NARROW.findall(text)


class PieceIds(dict):
    """Pre-token to its ids as little-endian unsigned 16-bit bytes, by the tokenizers library.

    Remembers up to ``limit`` pre-tokens, for each of which the library's model is
    asked. Texts are cut at the vocabulary's added tokens first, as the library does.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self._model = tokenizer.model
        self._limit = limit
        added = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("an added token takes white space or asks for word limits")
        self._added = {t.content: i.to_bytes(2, "little") for i, t in added.items()}
        # of two that begin at one place the library takes the longer
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")

    def __missing__(self, piece: str) -> bytes:
        named = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_NAMES)
        value = b"".join(t.id.to_bytes(2, "little") for t in self._model.tokenize(named))
        if len(self) < self._limit:
            self[piece] = value
        return value

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(t in text for t in self._added):
            return b"".join(map(self.__getitem__, split(text)))
        # odd places hold the added tokens
        parts = self._cut.split(text)
        return b"".join(self._added[p] if i % 2 else b"".join(map(self.__getitem__, split(p))) for i, p in enumerate(parts))
