"""Token ids of whole texts with the public tokenizer files.

``ChunkEncoder`` gives exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``. Both
vocabularies split a text into words before they merge, so the ids of a text are those of its
chunks, one after the other, as long as no cut falls inside a word; repeated chunks come from a
bounded cache. Cuts are made only where that holds:

* ``word``: at runs of white space, which this vocabulary drops;
* ``byte``: before a single space with a non-space on both sides, where a new word always begins,
  and around a single line break.
"""

from __future__ import annotations

import os
import re
from array import array

_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
_TWO_SPACES = re.compile(r"\s\s")
# letters and punctuation that belongs to no contraction
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:#$%&*]*)")


def _shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies show a byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SHOWN = _shown_bytes()
_CLEAN_CUT = re.compile(r"(?<=\S)(?= \S)")


class ChunkEncoder:
    """ids of a text as little-endian unsigned 32-bit integers, in one ``bytes`` object."""

    def __init__(self, path: str, kind: str, cache_entries: int = 400_000):
        from tokenizers import Tokenizer
        if kind not in ("word", "byte"):
            raise ValueError(kind)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = kind
        self.cache_entries = cache_entries
        self.young: dict[str, bytes] = {}  # two generations: what is used again outlives the older one
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.spaced = kind == "byte"
        self.line = self._encode("\n")

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return array("I", ids).tobytes()

    def _model(self, word: str, spaced: bool) -> bytes:
        """ids of a run of letters (after a space): one word to the tokenizer, so its model alone is asked."""
        if self.kind == "word":
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SHOWN)
        if spaced:
            word = _SHOWN[32] + word
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _new(self, key: str) -> bytes:
        """ids of a chunk not seen lately; ``key`` as made by ``_keys``."""
        spaced, before, word = self.spaced, b"", key
        if spaced and key[:1] == "\n":
            if key[1:2] == "\n":
                return self._encode(key[2:])
            spaced, before, word = False, self.line, key[1:]
        if word.isascii() and word.isalpha():
            ids = before + self._model(word, spaced)
        elif (m := _PLAIN.fullmatch(word)) is not None:
            letters, tail = m[1], m[2]
            ids = None if before else self.young.get(letters) or self.old.get(letters)
            if ids is None:
                ids = before + self._model(letters, spaced)
                if not before:
                    self.young[letters] = ids
            if tail:  # punctuation after letters is a word of its own
                if tail not in self.tails:
                    if len(self.tails) > 10_000:
                        self.tails.clear()
                    self.tails[tail] = self._encode(tail)
                ids += self.tails[tail]
        else:
            ids = before + self._encode(" " + word if spaced else word)
        if len(key) <= 64:
            self.young[key] = ids
        return ids

    def _keys(self, text: str) -> list[str]:
        """Cache keys of a text's chunks.

        Word kind: the chunks. Byte kind: a bare word stands for itself after a space, a word after one
        line break for both, and after two for a chunk as it is.
        """
        if self.kind == "word":
            return [text] if _SEPARATORS.search(text) else text.split()
        if _TWO_SPACES.search(text):
            return [c[1:] if c[0] == " " and c[1:].isalpha() else "\n\n" + c for c in _CLEAN_CUT.split(text)]
        first, *lines = text.split("\n")  # here every white space stands alone
        head, *out = first.split(" ")
        out.insert(0, "\n\n" + head)
        for line in lines:
            at = len(out)
            out += line.split(" ")
            out[at] = "\n" + out[at]
        return out

    def encode(self, text: str) -> bytes:
        chunks = self._keys(text)
        out = list(map(self.young.get, chunks))
        if None not in out:
            return b"".join(out)
        if len(self.young) > self.cache_entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            c = chunks[at]
            ids = young.get(c)
            if ids is None:
                ids = old.get(c)
                if ids is None:
                    ids = self._new(c)
                else:
                    young[c] = ids
            out[at] = ids
        return b"".join(out)


    def rest(self) -> None:
        """Give back what a task leaves behind: the worker may do other work next."""
        self.old = {}
        if len(self.young) > self.cache_entries // 4:
            self.young = {}


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, kind: str) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    key = (path, kind)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, kind)
    return _ENCODERS[key]


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file (never copied into this repository)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))
