"""Pre-tokens of byte-level BPE vocabularies: the stretches that merges never cross."""

from __future__ import annotations

import os
from collections.abc import Iterator

import regex

#: Fixed value: the public splitting pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters above which a text is split in parts.
PART = 1 << 20
_CUT = regex.compile(r"\S(?= )")


class Splitter:
    """Splits texts as the byte-level tokenizer file at ``path`` does, ``special`` strings being plain text or not.

    The pattern is run here, many times faster than through the library. Character classes depend on a library's
    Unicode version, so each character beyond ASCII is first tried in both; a text with one on which they differ, or
    with a special string that counts as such, has no pieces here and goes to the library whole.
    """

    def __init__(self, path: str, plain_special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if plain_special else added
        self._find = regex.compile(PATTERN).findall
        probe = "It's  a 'test'\n\n of x1,2!? \t <|a|> 'll .\r\n "
        self.same = self._split(probe) == self._find(probe) and self.tokenizer.normalizer is None
        self._known = {chr(c) for c in range(128)}
        self._odd: set[str] = set()

    def _split(self, text: str) -> list[str]:
        return [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _agrees(self, text: str) -> bool:
        new = set(text) - self._known
        for c in new:
            probes = (f"a{c}a", f"1{c}1", f"!{c}!", f" {c} ", f"a{c}", f"{c}\n")
            if any(self._split(p) != self._find(p) for p in probes):
                self._odd.add(c)
            self._known.add(c)
        return not (self._odd and self._odd.intersection(text))

    def pieces(self, text: str) -> Iterator[list[str]] | None:
        """The pre-tokens of a text, a list for each part of about ``PART`` characters; None if the library must split."""
        if not self.same or any(s in text for s in self.special) or not (text.isascii() or self._agrees(text)):
            return None
        return map(self._find, parts(text))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` cut before spaces that follow no white space: no pre-token spans such a place, none looks across it."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    if at < len(text) or not text:
        yield text[at:] if at else text
