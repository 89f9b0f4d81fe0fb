"""Exact tokenizer encoding through a bounded cache of pieces.

A text is cut where no token of the tokenizer can cross ("safe boundaries"), every distinct piece
is encoded once by the tokenizers library, and the ids of a text are the ids of its pieces in
order. Pieces of plain letters go straight to the library's BPE model, everything else through
the whole tokenizer. A full cache is emptied, so it bounds memory and never changes a result.

The rules for boundaries hold for the two tokenizers named in ``KINDS``:

* ``words``: white space is dropped and separates tokens, so ASCII spaces and line feeds are safe;
  a full stop or comma after a letter starts a token of its own.
* ``bytes``: a token holds white space only at its start, so every place with a non-space before
  and a space behind it is safe. Texts with white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

CACHE_PIECES = 600_000

KINDS = {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "bytes"}

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = {"words": re.compile(rf"[{_LETTERS}]+"), "bytes": re.compile(rf" ?[{_LETTERS}]+")}
_SPACED_PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space beyond ASCII, and controls that some engines count as white space.
_ODD_SPACE = re.compile(
    "[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
)


class PieceEncoder:
    """Encodes texts with one tokenizer; one per Python worker (see ``encoder``)."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.kind = KINDS[name]
        self.plain = _PLAIN[self.kind].fullmatch
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100)] + [" "]
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        end = "</w>" if self.kind == "words" else ""
        self.marks = {c: self.model.token_to_id(c + end) for c in ".,"}
        self._empty()

    def _empty(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.lengths, self.ids = array("q"), array("q"), array("i")

    def pieces(self, text: str) -> list[str]:
        """The text cut at safe boundaries."""
        if self.kind == "words":
            return text.replace("\n", " ").split(" ")
        return [text] if _ODD_SPACE.search(text) else _SPACED_PIECE.findall(text)

    def _model_ids(self, piece: str) -> list[int]:
        if self.kind == "words":
            piece = piece.lower()
        if piece[0] == " " or not piece.isascii():
            piece = piece.translate(self.as_bytes)
        return [token.id for token in self.model.tokenize(piece)]

    def _encode(self, piece: str) -> list[int]:
        if self.plain(piece):
            return self._model_ids(piece)
        mark = self.marks.get(piece[-1:])
        if mark is not None and self.plain(piece[:-1]):
            code = self.codes.get(piece[:-1])
            if code is None:
                return [*self._model_ids(piece[:-1]), mark]
            start = self.starts[code]
            return [*self.ids[start : start + self.lengths[code]], mark]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _add(self, piece: str) -> int:
        ids = self._encode(piece)
        code = self.codes[piece] = len(self.starts)
        self.starts.append(len(self.ids))
        self.lengths.append(len(ids))
        self.ids.extend(ids)
        return code

    def _piece_codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The code of every piece of all texts, and the number of pieces of each text."""
        if len(self.codes) > CACHE_PIECES:
            self._empty()
        found: list[int] = []
        counts = []
        look = self.codes.get
        for text in texts:
            pieces = self.pieces(text) if text else ()
            codes = list(map(look, pieces))
            if None in codes:
                i = -1
                for _ in range(codes.count(None)):
                    i = codes.index(None, i + 1)
                    known = look(pieces[i])
                    codes[i] = self._add(pieces[i]) if known is None else known
            counts.append(len(codes))
            found += codes
        return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text; null counts as empty."""
        codes, counts = self._piece_codes(texts)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(self.lengths, np.int64)[codes])])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text."""
        codes, counts = self._piece_codes(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        lengths = np.frombuffer(self.lengths, np.int64)[codes]
        starts = np.frombuffer(self.starts, np.int64)[codes]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - sums[:-1], lengths)
        at += np.arange(len(at))
        ends = np.cumsum(counts)
        return np.frombuffer(self.ids, np.int32)[at], sums[ends] - sums[ends - counts]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """The encoder of this Python worker; its cache lives as long as the worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]
