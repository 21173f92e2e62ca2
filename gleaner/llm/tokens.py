"""Token ids of the public tokenizers, looked up by piece of text.

Both vocabularies split a text before any merge, and never merge across a space: so a text's ids are the ids of its
pieces between spaces, one after another. Each worker remembers its pieces' ids as little-endian bytes. Marks between a
Latin letter and white space or the end are pieces of their own, as both vocabularies split them off, and where the
vocabulary has lower case only, a text of Latin letters is lower-cased at once. A run of Latin letters needs no
normaliser or splitter: the library's merge model gets it directly. Every other piece goes through the library's whole path.
"""

from __future__ import annotations

import codecs
import os
import re

_EDGE = re.compile(r"(?<=\S)(?= \S)")
_OTHER_SPACE = re.compile("[\0\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search  # or the separator of pieces()
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)").fullmatch
_MARKS = re.compile(r"([.,;:!?|#*$%&<>](?<=[A-Za-zÀ-ÖØ-öø-ÿ].)[.,;:!?|#*$%&<>]*)(?=[ \n]|\Z)").split
_BEYOND = re.compile(r"[^\x00-\xff]").search
_MADE: dict = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PieceEncoder(dict):
    """piece -> bytes of its ids; learns a piece when it is first asked for.

    Two generations of pieces are remembered, of about `most` bytes each: when the newer one is full it becomes the
    older one, from which pieces that are asked for again are taken over.
    """

    def __init__(self, path: str, leading_space: bool, most: int = 40 << 20):
        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        self.held = 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.lower, self.leading_space, self.most = self.tok.normalizer is not None, leading_space, most
        self.model, self.letters = self.tok.model, _byte_letters()
        self.blank, self.table = self.letters[32], "".join(self.letters)
        self.ids = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]

    def _word(self, w: str) -> bytes:
        """A run of letters, with or without the blank before it, straight through the merge model."""
        if self.lower:
            low = w.lower()
            if low != w:
                return self[low]
        if w.isascii():
            shown = self.blank + w[1:] if w[0] == " " else w
        else:
            shown = codecs.charmap_decode(w.encode(), "strict", self.table)[0]
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(shown)])

    def __missing__(self, piece: str) -> bytes:
        if self.held >= self.most:
            self.older, self.held = dict(self), 0
            self.clear()
            self[""] = b""
        got = self.older.get(piece)
        if got is not None:
            return self._keep(piece, got)
        word = piece[1:] if self.leading_space and piece[0] == " " else piece
        if word.isascii() and word.isalpha():
            got = self._word(piece)
        else:
            m = _PLAIN(piece)
            if m is None or (m[1] and not self.leading_space):
                got = b"".join([self.ids[i] for i in self.tok.encode(piece, add_special_tokens=False).ids])
            else:
                got = self._word(piece)
        return self._keep(piece, got)

    def _keep(self, piece: str, got: bytes) -> bytes:
        self[piece] = got
        self.held += len(piece) + len(got) + 150
        return got

    def pieces(self, text: str) -> list[str]:
        if not self.leading_space:
            if self.lower and not _BEYOND(text):
                text = text.lower()  # letter by letter, as the library does
            return " ".join(_MARKS(text)).replace("\n", " ").split(" ")
        odd = text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if odd or _OTHER_SPACE(text):
            return _EDGE.split(text)
        return "\0".join(_MARKS(text)).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))


def encoder(path: str, leading_space: bool) -> PieceEncoder:
    """One a worker process: what it has learned serves later tasks too."""
    key = (path, leading_space)
    if key not in _MADE:
        _MADE[key] = PieceEncoder(path, leading_space)
    return _MADE[key]
