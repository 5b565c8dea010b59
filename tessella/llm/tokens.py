"""Exact tokenizer calls with a memo of space-separated chunks.

Neither tokenizer's splitting ever joins what a single space or line end separates, so a text's ids
are the ids of its chunks in turn.  A new chunk of letters with punctuation behind goes to the
library's BPE model as it would after normalising and splitting; any other new chunk, texts in
which white space stands next to white space, and texts that hold the string of an added token
(which the library gives that token's id) go through the library's whole chain.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

from . import common

#: The name under which a worker keeps its encoders.
KEPT = "tokens"
#: Chunks that a worker keeps at most, in two generations.
MEMO_CHUNKS = 700_000
_INSIDE = re.compile(r"\s \s|\s \Z")
_OTHER = re.compile(r"[^\S \n]")
_ADJACENT = re.compile(r"\s\s|\s\Z|\A\s")
#: Signs that split off whole behind letters; the apostrophe may begin a contraction.
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Chunk to ids; what isn't used for a generation is forgotten.

    Signs behind a known word are put together from both parts, and kept only where the word is in
    use, so that a word's variants don't crowd out other words."""

    def __init__(self, word, whole, tail, solid):
        super().__init__()
        self.word, self.whole, self.tail, self.solid, self.old = word, whole, tail, solid, {}

    def keep(self, chunk: str, got: bytes) -> None:
        if len(self) >= MEMO_CHUNKS // 2:
            self.old = self.copy()
            self.clear()
        self[chunk] = got

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is not None:
            self.keep(chunk, got)
            return got
        core = chunk.rstrip(_TAIL)
        if len(core) == len(chunk):
            got = self.word(core) if core.isalpha() else None
            if got is None:
                got = self.whole(chunk)
            self.keep(chunk, got)
            return got
        if not self.solid(core):
            return self.whole(chunk)
        base = self.get(core)
        if base is not None:
            got = base + self.tail(chunk[len(core) :])
            self.keep(chunk, got)
            return got
        base = self.old.get(core)
        if base is None:
            base = self.word(core)
            if base is None:
                return self.whole(chunk)
        self.keep(core, base)
        return base + self.tail(chunk[len(core) :])


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)  # four bytes each
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _single_spaced(t: str) -> bool:
    """No white space beside white space or at either end."""
    if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1].isspace() or t[-1:].isspace():
        return False
    return not _OTHER.search(t) or not _ADJACENT.search(t)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Strings that the library cuts out of a text before anything else.
        self.added = tuple(x["content"] for x in spec["added_tokens"])
        before = spec["pre_tokenizer"]
        #: White space only separates: every chunk stands alone.
        self.drops_space = before["type"] == "Sequence" and before["pretokenizers"][0].get("behavior") == "Removed"
        if not self.drops_space and before != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} splits texts in a way that isn't known here")
        self.letters = _byte_letters()
        self.model, self.tails, self.newline = self.tok.model, {}, b""
        if not self.drops_space:
            self.newline = self._whole("\n")
        self.memo = _Memo(self._bare, self._whole_bare, self._tail, self._stays_letters) if self.drops_space else _Memo(self._spaced, self._whole_spaced, self._tail, str.isalpha)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str, before: str = "") -> bytes:
        """Ids of one run of letters."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return _packed([t.id for t in self.model.tokenize(before + word)])

    def _tail(self, signs: str) -> bytes:
        got = self.tails.get(signs)
        if got is None:
            if len(self.tails) > 50_000:
                self.tails.clear()
            got = self.tails[signs] = self._whole(signs)
        return got

    def _bare(self, word: str) -> bytes | None:
        """Ids of letters alone; None if the normalised word isn't letters alone."""
        if word.isascii():
            return _packed([t.id for t in self.model.tokenize(word.lower())]) if len(word) <= 200 else None
        low = unicodedata.normalize("NFC", word).lower()
        return self._word(low) if low.isalpha() and "Σ" not in word and len(low) <= 200 else None

    @staticmethod
    def _stays_letters(word: str) -> bool:
        """Whether the normalised word is letters alone."""
        if word.isascii():
            return word.isalpha()
        return "Σ" not in word and word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()

    def _whole_bare(self, chunk: str) -> bytes:
        return self._whole(chunk) if chunk else b""

    def _spaced(self, word: str) -> bytes | None:
        if word.isascii():
            return _packed([t.id for t in self.model.tokenize("Ġ" + word)]) if len(word) <= 200 else None
        return self._word(word, "Ġ") if len(word) <= 200 else None

    def _whole_spaced(self, chunk: str) -> bytes:
        """A chunk after a space, or after a line end, which then is its first character."""
        return self.newline + self._lead(chunk[1:]) if chunk[:1] == "\n" else self._whole(" " + chunk)

    def _lead(self, chunk: str) -> bytes:
        core = chunk.rstrip(_TAIL)
        if len(core) > 200 or not core.isalpha():
            return self._whole(chunk)
        return self._word(core) + (self._tail(chunk[len(core) :]) if len(core) < len(chunk) else b"")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        get, out = self.memo.__getitem__, []
        for t in texts:
            if any(x in t for x in self.added):
                out.append(self._whole(t))
            elif self.drops_space:
                out.append(b"".join(map(get, t.replace("\n", " ").split(" "))))
            elif _single_spaced(t):
                first, *rest = t.replace("\n", " \n").split(" ")
                out.append(self._lead(first) + b"".join(map(get, rest)))
            elif not _INSIDE.search(t) and t[:1] != " " and "\n" not in t[:1]:
                first, *rest = t.split(" ")
                out.append(self._whole(first) + b"".join([self._whole(" " + c) if c[:1] == "\n" else get(c) for c in rest]))
            else:
                out.append(self._whole(t))
        return out


def encoder(path: str) -> Encoder:
    """One for each worker and file, kept for tasks that keep KEPT."""
    loaded = common.kept(KEPT)
    if path not in loaded:
        loaded[path] = Encoder(path)
    return loaded[path]
