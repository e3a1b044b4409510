"""Encoding of whole texts with a byte-level BPE of the tokenizers library, piece by piece.

A text is cut before runs of white space and after runs of Latin letters. No pre-token of such a vocabulary
crosses these cuts, so the ids of the text are those of its pieces. Pieces repeat; each worker keeps the ids
of the pieces it met last (a bounded table of two generations), and only new ones go through the library.
A text that contains the string of an added token, such as an end mark, goes through the library as a whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Pieces of a generation a worker remembers, and the longest piece worth remembering.
_REMEMBERED, _LONGEST = 500_000, 64
#: White space as Unicode has it, which Python's \s exceeds by U+001C to U+001F.
_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECE = re.compile(
    rf"{_SPACE}*+[^\s\x1c-\x1f{_LATIN}]*+[{_LATIN}]++(?![^\W\d_])"  # to the end of a run of letters
    rf"|{_SPACE}*+[^\s\x1c-\x1f{_LATIN}]++(?=\s|\Z)|{_SPACE}*+{_OTHER}+|{_SPACE}+"
)
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str) -> str:
    """A path is taken as it is; other names are looked up among the public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.end = self._bytes([END_ID])

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Make ``known`` hold these pieces; returns those too long to be remembered."""
        if len(self.known) > _REMEMBERED:
            self.known, self.before = {}, self.known
        again = new & self.before.keys()
        self.known.update((p, self.before[p]) for p in again)
        extra: dict[str, bytes] = {}
        unknown = list(new - again)
        for at in range(0, len(unknown), 4096):
            part = unknown[at : at + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (self.known if len(p) <= _LONGEST else extra)[p] = self._bytes(e.ids)
        return extra

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and then ``END_ID``, as little-endian integers of ``width`` bytes."""
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        found = self.tokenizer.encode_batch_fast([texts[i] for i in marked], add_special_tokens=False) if marked else []
        whole = {i: self._bytes(e.ids) for i, e in zip(marked, found)}
        pieces = [[] if i in whole else _PIECE.findall(t) for i, t in enumerate(texts)]
        ids = [list(map(self.known.get, p)) for p in pieces]
        open_ = [i for i, x in enumerate(ids) if None in x]
        if open_:
            extra = self._learn({p for i in open_ for p, x in zip(pieces[i], ids[i]) if x is None})
            both = (self.known, self.before, extra)
            for i in open_:
                ids[i] = [x if x is not None else next(d[p] for d in both if p in d) for p, x in zip(pieces[i], ids[i])]
        return [(whole[i] if i in whole else b"".join(x)) + self.end for i, x in enumerate(ids)]


def encoder(name: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary: made once, as workers serve many tasks."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]
