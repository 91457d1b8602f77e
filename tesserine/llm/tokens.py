"""Token ids of whole texts with a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Words and other pieces that a worker remembers, unless it is told otherwise; over that it starts anew, so memory has a bound. A worker outlives its
#: stage, so what it remembers takes room in later stages, too.
WORDS, PIECES = 200_000, 100_000
#: Parts looked up at once.
SLICE = 1 << 16
# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: All but letters, digits, signs and white space whose class has never changed.
RARE = re.compile("[^\t-\r -~\xa1-\u0220\u0222-\u0233\u0391-\u03a1\u03a3-\u03a9\u03b1-\u03c9\u0400-\u045f]")
# Marks that no contraction begins with, and the byte-level alphabet: printing bytes stand for themselves, others for signs from 256 on.
MARKS = ".,;:!?)(\"%&$#*|"
_PRINTING = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _PRINTING} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTING)))}
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, words: int = WORDS) -> Encoder:
    """One encoder a worker and file: it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = words
    return _ENCODERS[path]


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, equal to those of the library for the whole text.

    The file's pre-tokenizer puts a single space into the token that follows it, so a text may be cut before each
    single space, and only parts not met before go to the library. Where white space meets such a space on both sides, or spaces
    stand in runs, the pre-tokenizer looks further: those texts are cut by its pattern as a whole. Parts with signs
    whose class differs between versions of Unicode go to the library uncut. The library finds
    its added tokens (such as the end of a text) in ordinary text, too: a text that holds the string of one goes to it uncut.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.most = WORDS
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = self._splitter(path)
        self.model = self.library.model
        self.line_end = self._ids(["\n"])[0] if self.split else b""

    @staticmethod
    def _splitter(path: str):
        """The file's pattern as a function, if its pre-tokenizer is the plain byte-level one; else None: no cutting at all."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and (spec.get("model") or {}).get("type") == "BPE"
        return PATTERN.findall if plain else None

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that the pattern has cut, by the library's model alone: what it does after pre-tokenising."""
        tokenize = self.model.tokenize
        return [array("I", [t.id for t in tokenize(p.encode().decode("latin-1").translate(BYTE_SIGNS))]).tobytes() for p in pieces]

    def _one(self, piece: str) -> bytes:
        """The ids of one piece. A word behind a space is remembered without it, in the dictionary that parts are looked up in."""
        table, key = (self.words, piece[1:]) if piece[0] == " " and piece[1:].isalpha() else (self.pieces, piece)
        got = table.get(key)
        if got is None:
            got = self._ids([piece])[0]
            if len(table) >= (self.most if table is self.words else PIECES):
                table.clear()
            table[key] = got
        return got

    def _word(self, word: str) -> bytes | None:
        """The ids of a new word behind a space; None if its letters are rare."""
        if word.isascii():
            signs = "\u0120" + word
        elif RARE.search(word):
            return None
        else:
            signs = (" " + word).encode().decode("latin-1").translate(BYTE_SIGNS)
        got = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        if len(self.words) >= self.most:
            self.words.clear()
        self.words[word] = got
        return got

    def _cut(self, text: str) -> bytes:
        return b"".join([self._one(p) for p in self.split(text)])

    def _whole(self, text: str) -> bytes:
        return self._ask([text])[0] if RARE.search(text) else self._cut(text)

    def _part(self, part: str) -> bytes:
        """A part behind its space: a word, with marks or a line end and a word behind it, needs no pattern."""
        if part.isalpha() and not RARE.search(part):
            return self._one(" " + part)
        if RARE.search(part):
            return self._ask([" " + part])[0]
        out, space = [], " "
        for line in part.split("\n"):
            word = line.rstrip(MARKS)
            if not word.isalpha():
                return self._cut(" " + part)
            if not space:
                out.append(self._one("\n"))
            out.append(self._one(space + word))
            if len(word) < len(line):
                out.append(self._one(line[len(word) :]))
            space = ""
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split is None or any(x in text for x in self.added):
            return self._ask([text])[0]
        parts = text.split(" ")
        if not parts[0]:
            return self._whole(text)
        out = [self._whole(parts.pop(0))]
        word, piece, line_end = self.words.get, self.pieces.get, self.line_end
        for k in range(0, len(parts), SLICE):
            some = parts[k : k + SLICE]
            ids = list(map(word, some))
            if None in ids:
                for i in [i for i, x in enumerate(ids) if x is None]:
                    p = some[i]
                    # most of what isn't known as a whole is a known word with marks or a line end behind it
                    head, end, tail = p.partition("\n")
                    bare = head.rstrip(MARKS)
                    x = word(bare)
                    if x is None and bare.isalpha():
                        x = self._word(bare)
                    if x is not None:
                        if len(bare) < len(head):
                            x += piece(head[len(bare) :]) or self._one(head[len(bare) :])
                        if not end:
                            ids[i] = x
                            continue
                        if tail.isalpha() and (z := piece(tail)) is not None:
                            ids[i] = x + line_end + z
                            continue
                    # white space at the edge of a part may belong to that of its neighbour
                    if not p or p[0].isspace():
                        return self._whole(text)
                    ids[i] = self._part(p)
            out += ids
        return b"".join(out)

    def with_end(self, text: str, end_id: int = 0) -> bytes:
        return self.encode(text) + end_id.to_bytes(4, "little")


def id_counts(text: Column, path: str | None = None) -> Column:
    """How many ids the whole text (null: empty) has with the one that ends it."""
    path = path or tokenizer_path()

    @pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        made = encoder(path)
        return texts.map(lambda t: len(made.encode(t)) // 4 + 1)

    return count(F.coalesce(text, F.lit("")))


def merkle_root(leaves: list[bytes]) -> bytes:
    """BLAKE2b-128 over pairs, level by level; an odd last node moves up. Leaves and inner nodes are marked apart. No leaf: the hash of nothing."""

    def h(x: bytes) -> bytes:
        return hashlib.blake2b(x, digest_size=16).digest()

    level = [h(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [h(b"\1" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else h(b"")


_GEAR = ((np.arange(1, 65537, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
WINDOW = 4


def chunk_ends(ids: np.ndarray, average: int = 512, least: int = 128, most: int = 2048) -> list[int]:
    """Where content-defined chunks end: after an id whose rolling hash of the last WINDOW ids has its top bits clear.

    ``average`` is a power of two. A chunk has ``least`` ids at least, the last one of a stream excepted, and ``most`` at most.
    Equal ids around a cut give the same cut wherever they stand.
    """
    if not len(ids):
        return []
    with np.errstate(over="ignore"):
        g = _GEAR[ids & 0xFFFF] + (ids >> 16).astype(np.uint32)
        h = g.copy()
        for k in range(1, min(WINDOW, len(g))):
            h[k:] += g[:-k] << np.uint32(k * 7)
        cuts = np.flatnonzero((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - (average.bit_length() - 1)) == 0) + 1
    ends, start = [], 0
    for cut in [*cuts.tolist(), len(ids)]:
        while cut - start > most:
            start += most
            ends.append(start)
        if cut - start >= least or cut == len(ids) > start:
            ends.append(cut)
            start = cut
    return ends
