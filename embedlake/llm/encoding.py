"""Token ids of whole texts, with a memory of pieces between blanks.

A text is cut before each blank. Where the pre-tokenizer cannot join across
such a cut, the ids of the text are the ids of its pieces, and frequent pieces
are encoded once per worker. Texts or tokenizers for which that does not hold
are encoded whole, so the ids are always those of the library.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Pieces held per worker before the memory starts anew (about 220 MB).
PIECES = 1_000_000
LONGEST_PIECE = 64
# A longer text is encoded by itself, so that the arrays of a slice stay small.
LONGEST_TEXT = 16 << 20
# Signs behind a letter or digit begin a pre-token of their own.
MARKS = string.punctuation
# Letters before this one are composed, and lower-case the same everywhere.
LATIN_END = "\u0250"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
# A line break beside other white space, or at an end, is left to the library.
_BLANKS = re.compile(r"^\n|\n$|\s\n|\n\s|[^\S\n ]")


def _kind(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex"):
        return "whole" if pre.get("add_prefix_space") else "leading"
    steps = [x.get("type") for x in norm.get("normalizers", [])]
    first = (pre.get("pretokenizers") or [{}])[0]
    if steps == ["NFC", "Replace", "Lowercase"] and first.get("behavior") == "Removed":
        return "dropped"
    return "whole"


class _Pieces(dict):
    """Ids by piece. A new piece is cut once more where that is safe: before
    trailing marks that follow a letter or digit, and around a line break
    between two other characters. What is left is encoded by the library; a
    word of Latin letters is one pre-token, so the library's model gets it
    directly."""

    def __init__(self, library, lead: str, limit: int, inner: _Pieces | None = None):
        self.library, self.lead, self.limit, self.inner = library, lead, limit, self if inner is None else inner

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        base = piece.rstrip(MARKS)
        if base != piece and base and base[-1].isalnum():
            ids = self[base] + self.inner[piece[len(base) :]]
        elif self.lead and "\n" in piece and not _BLANKS.search(piece):
            first, *rest = piece.split("\n")
            ids = self[first] + b"".join(self.inner["\n"] + self.inner[x] for x in rest)
            return ids
        elif self.is_word(piece):
            found = self.library.model.tokenize(_byte_chars(self.lead + piece))
            ids = _packed([t.id for t in found])
        else:
            ids = _library(self.library, self.lead + piece)
        if len(piece) <= LONGEST_PIECE:
            self[piece] = ids
        return ids


    def is_word(self, piece: str) -> bool:
        """Letters that are one pre-token whatever stands around them."""
        return piece.isalpha() and (piece.isascii() or max(piece) < LATIN_END) and (bool(self.lead) or piece.islower())


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


def _library(library, text: str) -> bytes:
    return _packed(library.encode(text, add_special_tokens=False).ids)


def _byte_table() -> dict[int, int]:
    """Byte-level tokenizers write a byte as the character of its number, or as
    the next one from 256 on if that one can't be seen."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: 256 + i for i, b in enumerate(hidden)}


_HIDDEN = _byte_table()


def _byte_chars(text: str) -> str:
    if text.isascii() and text.isalpha():
        return text
    return text.encode().decode("latin-1").translate(_HIDDEN)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, pieces: int = PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = _kind(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.bare = _Pieces(self.library, "", pieces // 4)
        self.known = _Pieces(self.library, " ", pieces, self.bare)
        if self.kind == "dropped":
            self.known = _Pieces(self.library, "", pieces)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as `encode` gives them.

        All texts are cut at once, each different piece is looked up once, and
        the ids are put together as arrays. Texts that `encode` gives to the
        library as a whole, and very long ones, go there one by one.
        """
        out: list[bytes | None] = [None] * len(texts)
        together = [i for i, t in enumerate(texts) if t and self._cuts(t)]
        if together:
            held = [self._lowered(texts[i]) if self.kind == "dropped" else texts[i] for i in together]
            lists = pc.split_pattern(pa.array(held, pa.large_string()), " ")
            pieces = lists.flatten().dictionary_encode()
            offsets, codes = lists.offsets.to_numpy().astype("i8"), pieces.indices.to_numpy().astype("i8")
            offsets -= offsets[0]
            different = pieces.dictionary.to_pylist()
            self.learn(different)
            found = [self.known[p] for p in different]
            if self.kind == "leading":
                # The first piece has no blank before it; an empty one is a blank at the begin.
                codes[offsets[:-1]] = np.arange(len(held)) + len(found)
                found += [self.bare[first] if first else b"" for first in (t.partition(" ")[0] for t in held)]
            pool = np.frombuffer(b"".join(found), "<u4")
            sizes = np.fromiter(map(len, found), "i8", len(found)) // 4
            begins = np.cumsum(sizes) - sizes
            lengths = sizes[codes]
            ends = np.cumsum(lengths)
            ids = pool[np.repeat(begins[codes] - ends + lengths, lengths) + np.arange(int(ends[-1]))].tobytes()
            edges = (4 * np.append(0, ends)[offsets]).tolist()
            for i, a, b in zip(together, edges, edges[1:]):
                out[i] = ids[a:b]
        for i, text in enumerate(texts):
            yield self.encode(text) if out[i] is None else out[i]

    def _cuts(self, text: str) -> bool:
        """Whether the ids of a text are the ids of its pieces between blanks."""
        if self.kind == "whole" or len(text) > LONGEST_TEXT or any(s in text for s in self.special):
            return False
        return self.kind == "dropped" or "  " not in text

    @staticmethod
    def _lowered(text: str) -> str:
        # The tokenizer lowers letter by letter; Python's final sigma differs.
        return (text if "\u03a3" in text else text.lower()).replace("\n", " ")

    def learn(self, pieces: list[str]) -> None:
        """Encode the new words among pieces in one call, so that each of them is known.

        Words are one pre-token each, so blanks keep them apart; where a blank
        goes to the word behind it the first token of a word shows it, and where
        blanks are dropped the last one does.
        """
        if self.kind not in ("leading", "dropped"):
            return
        known = self.known
        new = {p.rstrip(MARKS) for p in pieces if p not in known}
        words = [w for w in new if w not in known and len(w) <= LONGEST_PIECE and known.is_word(w)]
        if len(known) + len(words) > known.limit:
            known.clear()
        # A memory smaller than the words of one slice takes what fits.
        words = words[: known.limit]
        if not words:
            return
        joined = known.lead + " ".join(words)
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(self._edges[ids]) + (not known.lead)
        edges = np.append(edges, len(ids)) if known.lead else np.concatenate([[0], edges])
        if len(edges) != len(words) + 1:
            return
        raw, places = ids.tobytes(), (4 * edges).tolist()
        known.update(zip(words, [raw[a:b] for a, b in zip(places, places[1:])]))

    @functools.cached_property
    def _edges(self) -> np.ndarray:
        """Which tokens begin a word with its blank, or end one."""
        mark = _byte_chars(" ") if self.known.lead else self.library.model.end_of_word_suffix
        shows = str.startswith if self.known.lead else str.endswith
        out = np.zeros(self.library.get_vocab_size(), bool)
        out[[i for t, i in self.library.get_vocab().items() if mark and shows(t, mark)]] = True
        return out

    @property
    def id_bytes(self) -> int:
        return 2 if self.library.get_vocab_size() <= 1 << 16 else 4

    def encode(self, text: str) -> bytes:
        if self.kind == "whole" or any(s in text for s in self.special):
            return _library(self.library, text)
        if self.kind == "dropped":
            return b"".join(map(self.known.__getitem__, self._lowered(text).split(" ")))
        if "  " in text:
            return _library(self.library, text)
        first, blank, rest = text.partition(" ")
        head = self.bare[first] if first else b""
        if not blank:
            return head
        return head + b"".join(map(self.known.__getitem__, rest.split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per tokenizer file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
