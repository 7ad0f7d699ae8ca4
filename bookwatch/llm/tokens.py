"""Exact tokenizer ids with a memory of pieces seen before.

Both public vocabularies cut a text into pieces and merge inside a piece only,
so the ids of a text are those of its pieces, joined. A text is cut into pieces
by the vocabulary's pattern, and each piece not seen before goes to the
library's merge model. Where white space always separates pieces, the memory
holds the ids of whole chunks between it, so a text is only split there. Where a text has characters beyond Latin-1, whose classes
or normal forms could depend on a Unicode version, it is first cut at white
space and the chunks that hold such characters are encoded whole by the
library. The memory is bounded (about 130 MB a worker process), passes from task
to task of the same stage, and is given up when the worker does other work.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from .common import worker_memory

CHUNKS = {
    # A space joins the word after it; of a longer run only the last does.
    "byte": r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]",
    # White space separates and is dropped.
    "word": r"[^\t-\r ]+",
}
# The vocabularies' patterns on Latin-1: letters, numbers and the rest by name,
# the commonest alternative first where the order between them is free.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
PIECES = {
    "byte": rf" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^\t-\r {_L}{_N}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+",
    "word": rf"[{_L}]+|{_SHORT}|[{_N}]|[^\t-\r {_L}{_N}]+",
}
# Characters beyond Latin-1, and those that some definitions of white space include.
UNSURE = re.compile("[\x1c-\x1f\x85\xa0Ā-\U0010ffff]")
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁠　﻿]")
#: Units remembered by a worker, and the longest that is.
KEEP, KEEP_CHARS = 900_000, 32


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte value: itself where printable in
    Latin-1, else the next character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Memory(dict):
    """Ids by unit of text, worked out when first asked for. Forgotten when
    full; long units are not kept."""

    def __init__(self, work_out: Callable[[str], bytes]):
        super().__init__()
        self.work_out = work_out

    def __missing__(self, unit: str) -> bytes:
        found = self.work_out(unit)
        if len(unit) <= KEEP_CHARS:
            if len(self) >= KEEP:
                self.clear()
            self[unit] = found
        return found


class Ids:
    """``of(text)``: its ids as bytes, little-endian unsigned of ``width`` bytes."""

    def __init__(self, path: str, kind: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = (path, kind, width)
        mine = self.mine = worker_memory(("ids", *key))
        if key not in mine:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            if t.get_vocab_size() > 1 << 8 * width:
                raise ValueError(f"ids of {path} do not fit {width} bytes")
            mine[key] = (t, t.model.tokenize, re.compile(CHUNKS[kind]).findall,
                         re.compile(PIECES[kind]).findall, byte_letters(),
                         Memory(self.piece if kind == "byte" else self.chunk))
        (self.library, self.merge, self.chunks, self.pieces, self.letters, self.known) = mine[key]
        self.code = {1: "B", 2: "H", 4: "I"}[width]
        self.dtype = np.dtype(f"<u{width}")
        self.lower = kind == "word"

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            shown = piece.replace(" ", self.letters[32])
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.merge(shown)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk that the caller remembers. A piece is a chunk of its own,
        so the pieces of longer ones are remembered beside them."""
        if UNSURE.search(chunk):
            return self.of(chunk)
        pieces = self.pieces(chunk)
        return self.piece(chunk) if len(pieces) == 1 else self.parts(pieces)

    def parts(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not UNSURE.search(text):
            if self.lower:  # split() knows no white space here but the pattern's
                return self.parts(text.lower().split())
            return self.parts(self.pieces(text))
        if ODD_SPACE.search(text):
            return self.whole(text)
        sure = UNSURE.search
        return b"".join([self.whole(c) if sure(c) else self.parts(self.pieces(c.lower() if self.lower else c))
                         for c in self.chunks(text)])
