"""Encoding with a public tokenizer file, remembering the ids of text pieces between white space.

Both byte-pair encodings cut a text at white space before they merge, so the ids of a text are the ids
of its pieces in order. The pieces repeat a lot; each is encoded once by the tokenizers library and kept
in a bounded table. Texts that hold a special token's string are encoded whole, as those strings are
cut out before white space is looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as Unicode's White_Space property has it (the tokenizers' regular expressions use that).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters beyond doubt; a run of them that ends before white space or an ASCII mark or digit is a word of
#: its own for either encoding, so that the table needs no entry for each mark behind it.
LETTERS = "[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+"
WORD = LETTERS + "(?=[" + SPACE + "!-@\\[-`{-~]|$)"
#: A piece: a word, or a run of characters other than white space, with the one space before it; or a run
#: of white space that leaves its last space to the piece behind it.
PIECE = re.compile(f" ?{WORD}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for encodings that drop white space.
BARE = re.compile(f"{WORD}|[^{SPACE}]+")

#: Entries of the table (about 200 bytes each) before it is emptied, and characters of the longest piece it keeps.
MAX_PIECES = 500_000
LONGEST_KEPT = 64


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype`` (2 or 4 bytes an id).

    special_as_text: strings of special tokens are ordinary text. Empty texts give no ids.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = None if special_as_text or not added else re.compile("|".join(map(re.escape, added)), re.I)
        self.opening = {c for t in added for c in (t[:1].lower(), t[:1].upper())}
        self.bare = self._library(" a") == self._library("a")
        self.find = (BARE if self.bare else PIECE).findall
        self.pieces: dict[str, bytes] = {}
        # Where words stand side by side in one text, the tokens that end (or begin) a word tell them apart.
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(tokens.values(), default=0) + 1, bool)
        self.edge[[i for t, i in tokens.items() if (t.endswith("</w>") if self.bare else t.startswith("\u0120"))]] = True

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; unknown pieces of all the texts are encoded together."""
        whole = {i for i, t in enumerate(texts) if self._has_special(t)}
        found = [() if i in whole else self.find(t) for i, t in enumerate(texts)]
        if len(self.pieces) > MAX_PIECES:
            self.pieces.clear()
        new = set().union(*found).difference(self.pieces)
        self._learn(list(new))
        get = self.pieces.__getitem__
        out = [self._library(t) if i in whole else b"".join(map(get, found[i])) for i, t in enumerate(texts)]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self.pieces[p]
        return out

    def _has_special(self, text: str) -> bool:
        return self.special is not None and any(c in text for c in self.opening) and self.special.search(text) is not None

    def _learn(self, new: list[str]) -> None:
        """Put pieces into the table: words many at a time, others one by one."""
        words, others = [], []
        for p in new:
            word = p.isalpha() if self.bare else p[0] == " " and p[1:].isalpha()
            (words if word else others).append(p)
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        texts = [(" " if self.bare else "").join(g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
            ids = np.array(e.ids, np.int64)
            cut = np.flatnonzero(self.edge[ids]) + self.bare
            if len(cut) != len(group) or (not self.bare and cut[0]) or (self.bare and cut[-1] != len(ids)):
                others += group
                continue
            at = (np.concatenate(([0], cut)) if self.bare else np.append(cut, len(ids))) * self.dtype.itemsize
            data, at = ids.astype(self.dtype).tobytes(), at.tolist()
            self.pieces.update(zip(group, [data[x:y] for x, y in zip(at, at[1:])]))
        for p in others:
            self.pieces[p] = self._library(p)

    def number(self, i: int) -> bytes:
        """The bytes of one id."""
        return np.array([i], dtype=self.dtype).tobytes()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per file and Python worker."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, special_as_text)
    return _ENCODERS[key]


def encoded_texts(enc: Encoder, texts: list[str]) -> Iterator[bytes]:
    """The ids of texts in order, a slice at a time: small ones, whose pieces stay in the processor's cache."""
    for i, j in slices(map(len, texts), 1 << 16):
        yield from enc.encode_all(texts[i:j])


def wide(ids: bytes, dtype: np.dtype) -> bytes:
    """The ids as little-endian unsigned 32-bit numbers."""
    return ids if dtype.itemsize == 4 else np.frombuffer(ids, dtype).astype("<u4").tobytes()
