"""Exact token ids of whole texts, with the ids of repeated words kept in each Python worker.

A run of letters after a space is one word of the library's pre-tokenizer, which its model encodes directly.
Byte-level BPE never merges across a lone space or a lone line feed between two visible characters, so the pieces between
them can be encoded apart and joined. A text whose white space isn't of that kind (runs of it, at its ends, next to other
white space) is encoded whole. Either way the ids are those of the tokenizers library for the whole text.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces whose ids a worker keeps, some 200 bytes each; beyond it starts afresh. It changes speed only.
KEPT_PIECES = 1_500_000
#: A run of letters and one of marks after it: two words of the pre-tokenizer, whatever stands around them.
WORD = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;=>?@\[\]^`{|}~]*)")

_encoders: dict[str, "Encoder"] = {}


class _Apart(Exception):
    """A piece that can't stand apart."""


class Encoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; holds the ids of pieces.

    The piece `x` stands for a space and x, the piece `\\nx` for a line feed and x.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = t = Tokenizer.from_file(path)
        self.apart = isinstance(t.model, BPE) and isinstance(t.pre_tokenizer, ByteLevel) and t.normalizer is None
        self.apart = self.apart and not t.pre_tokenizer.add_prefix_space and not any(x.lstrip or x.rstrip or x.single_word or x.content.isalpha() for x in t.get_added_tokens_decoder().values())
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks: dict[str, bytes] = {"": b""}
        self.most = KEPT_PIECES
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        """The ids of one text, by one call of the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, letters: str) -> bytes:
        """The ids of a run of letters, with or without a space before it: one word for the library's model."""
        word = letters.replace(" ", "\u0120") if letters.isascii() else self.bytes.pre_tokenize_str(letters)[0][0]
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        fed = piece[:1] == "\n"
        body = piece[1:] if fed else piece
        if m := WORD.fullmatch(body):
            stem, marks = m.groups()
            if (tail := self.marks.get(marks)) is None:
                tail = self.marks[marks] = self.whole(marks)
            ids = self.feed + self._letters(stem) + tail if fed else (self[stem] if marks else self._letters(" " + stem)) + tail
        elif not body or body[0].isspace() or body[-1].isspace():
            raise _Apart
        else:
            ids = self.feed + self.whole(body) if fed else self.whole(" " + body)
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; of a null or empty one none."""
        if not text:
            return b""
        if self.apart:
            if len(self) > self.most or len(self.marks) > self.most:
                self.clear()
                self.marks = {"": b""}
            try:
                return b"".join(map(self.__getitem__, ("\n" + text).replace("\n", " \n")[1:].split(" ")))[len(self.feed) :]
            except _Apart:
                pass
        return self.whole(text)


def encoder(path: str, most: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file, which keeps the ids of so many pieces at most."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = most or KEPT_PIECES
    return _encoders[path]
