"""Token ids of whole texts, by the tokenizers library, through a cache of pieces.

Pre-tokenisation never joins characters across certain white space, so a text
can be cut there and every distinct piece be encoded once per worker. Cuts:

- byte-level vocabularies keep white space with the word after it: before a
  single space or line feed that has no white space beside it; texts with runs
  of white space are cut only before a space that a visible character follows.
- word-level vocabularies drop white space: at every space and line feed.

Texts that hold the string of one of the vocabulary's added tokens go to the
library whole, which then gives the token's own id, or, with special_as_text,
the ids of the string as ordinary text.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import string
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

CACHE_MOST, CACHE_KEPT, LONGEST_CACHED = 1_000_000, 700_000, 256
_RUN = re.compile(r"\s\s")
_BEFORE_WORD = re.compile(r" (?=\S)")
#: Marks that both kinds of pre-tokenisation part from a letter before them; no apostrophe, which may begin a contraction.
_MARKS = string.punctuation.replace("'", "")
#: Letters whose small forms are single letters of this range again, and composed ones.
_LATIN = re.compile("[\0-\u012f\u0131-\u017f]*")


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else one from 256 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[0x20]


class _Cache(dict):
    """Ids by piece; a missing piece is noted and gets an empty place, which is filled later."""

    def __init__(self, known: dict[str, bytes] | Iterable[tuple[str, bytes]]):
        super().__init__(known)
        self.missing: list[str] = []

    def __missing__(self, piece: str) -> bytearray:
        place = self[piece] = bytearray()
        self.missing.append(piece)
        return place


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Keys of the cache are pieces as they stand in the text without the space
    before them; a leading NUL says that there is none. A missing piece of Latin
    letters is one word to both pre-tokenisers and goes to the library's model as
    its bytes' letters; other pieces are encoded many at a time, joined by a
    separator that is one id of its own.
    """

    def __init__(self, vocabulary: str, word_level: bool, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = None
        if any(t.normalized for t in added):
            self.added = re.compile("")  # found anywhere only after normalisation: no text is cut
        elif added:
            self.added = re.compile("|".join(re.escape(t.content) for t in added))
        self.word_level = word_level
        self.glue, self.mark = (" ~ ", "~") if word_level else ("\n", "\n")
        (self.glue_id,) = self._ids(self.mark)
        self.ends: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.size)]
        self.cache = _Cache({"": b""} if word_level else {"\0": b""})
        self.most: int | None = None

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pieces(self, text: str) -> list[str]:
        if self.word_level:
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            return ["\0" + text]
        if _RUN.search(text):
            first, *rest = _BEFORE_WORD.split(text)
            return ["\0" + first, *rest]
        return ("\0" + text.replace("\n", " \n \0")).split(" ")

    def _source(self, piece: str) -> str:
        if self.word_level or piece == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else " " + piece

    def _learn(self, missing: list[str]) -> None:
        """Fill the places of missing pieces: one that ends in marks by its base, a word-level one by its small letters."""
        cache, fresh, derived = self.cache, [], []
        for piece in missing:
            base, end = piece, b""
            if not piece[-1:].isalpha():
                short = piece.rstrip(_MARKS)
                if short[-1:].isalpha() and short[-1] < "\u0250" and short[-1] != "\u0130":  # whose small form ends in a mark
                    base, end = short, self._end(piece[len(short) :])
            if self.word_level and _LATIN.fullmatch(base):
                small = base.lower()
                if not (self.added and self.added.search(small)):
                    base = small
            if base == piece:
                fresh.append(piece)
            else:
                derived.append((piece, base, end))
                if base not in cache:
                    cache[base]  # makes its place
                    fresh.append(base)
        self._encode_new(fresh)
        for piece, base, end in derived:
            cache[piece] += cache[base] + end

    def _end(self, marks: str) -> bytes:
        if marks not in self.ends:
            if len(self.ends) > LONGEST_CACHED:
                self.ends.clear()
            self.ends[marks] = np.array(self._ids(marks), "<u4").tobytes()
        return self.ends[marks]

    def _encode_new(self, missing: list[str]) -> None:
        cache, alone, joined, raw, bpe = self.cache, [], [], self.raw, self.tokenizer.model.tokenize
        for piece in missing:
            head, word = "", piece
            if not self.word_level and piece:
                head, word = ("", piece[1:]) if piece[0] == "\0" else (_SPACE, piece)
            if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)) and not (self.word_level and word != word.lower()):
                letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
                cache[piece] += b"".join([raw[t.id] for t in bpe(head + letters)])
            else:
                plain = self.mark not in piece and piece[-1:].strip() and (self.word_level or piece[0] != "\0" or piece[1:2].strip())
                (joined if plain else alone).append(piece)
        for some in itertools.batched(joined, 1000):
            ids = np.array(self._ids(self.glue.join(map(self._source, some))), "<u4")
            ends = np.flatnonzero(ids == self.glue_id)
            if len(ends) != len(some) - 1:
                alone += some
                continue
            joint = ids.tobytes()
            ends = (4 * ends).tolist()
            for piece, start, end in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(joint)], strict=True):
                cache[piece] += joint[start:end]
        for piece in alone:
            cache[piece] += np.array(self._ids(self._source(piece)), "<u4").tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        cache, missing = self.cache, self.cache.missing
        while missing:  # places that an error left unfilled
            cache.pop(missing.pop(), None)
        cut = [None if self.added and self.added.search(t) else list(map(cache.__getitem__, self.pieces(t))) for t in texts]
        if missing:
            self._learn(missing.copy())
        out = [np.array(self._ids(t), "<u4").tobytes() if c is None else b"".join(c) for t, c in zip(texts, cut, strict=True)]
        for piece in missing:
            if len(piece) <= LONGEST_CACHED:
                cache[piece] = bytes(cache[piece])
            else:
                del cache[piece]
        missing.clear()
        if len(cache) > (self.most or CACHE_MOST):
            self.cache = _Cache(itertools.islice(cache.items(), self.most * 7 // 10 if self.most else CACHE_KEPT))
        return out


_encoders: dict[tuple[str, bool, bool], PieceEncoder] = {}


def encoder_for(vocabulary: str, word_level: bool, special_as_text: bool = False, cached: int | None = None) -> PieceEncoder:
    """The worker's encoder, whose cache lasts from task to task; `cached` pieces at most, where given."""
    key = vocabulary, word_level, special_as_text
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(*key)
    _encoders[key].most = cached
    return _encoders[key]


def forget_encoders() -> None:
    """Give the cache's memory, and what earlier tasks of the worker left free, back to the system; for steps that encode nothing."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def few_rows(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterable[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that only their texts are objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def in_slices(texts: list[str], most_chars: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of neighbours with about so many characters together."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) + 16
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
