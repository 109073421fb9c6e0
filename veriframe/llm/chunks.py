"""Ids of texts by a tokenizer library, asked once for each distinct chunk.

A text is cut before every space that follows a character other than white space. A byte-level
pre-tokenizer always parts there (no piece of its holds white space after anything else), and a
sentence-piece model whose pieces hold the space mark at their front only cannot merge across it.
So the ids of a text are those of its chunks, one after the other, and a chunk that comes again is
looked up. ``Memory`` holds a bounded number of chunks and of characters.

A chunk that begins with a space is known by its rest; any other (the front of a text, or a text
that must stay whole) by a tuple of its string.
"""

from __future__ import annotations

import ctypes
import json
import re
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veriframe.llm.bpe import _shown_bytes

#: Chunks remembered by a task, and their characters.
MEMORY_CHUNKS, MEMORY_CHARS = 1 << 20, 1 << 24

#: New chunks that a library gets in one text, and bytes of the texts that are worked on at once.
JOINED, SLICE_BYTES = 64, 1 << 20

_SPACE_AFTER_SPACE = [chr(c) + " " for c in (*range(9, 14), *range(28, 33))]
_OTHER_SPACE_AFTER = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def keys(text: str) -> list[Hashable]:
    """The chunks of a text in order; an empty text has none."""
    if not text:
        return []
    if any(pair in text for pair in _SPACE_AFTER_SPACE) or not text.isascii() and _OTHER_SPACE_AFTER.search(text):
        return [c[1:] if c[0] == " " else (c,) for c in _CUT.split(text)]
    first, *rest = text.split(" ")
    return [(first,), *rest] if first else rest


def string(key: Hashable) -> str:
    return key[0] if isinstance(key, tuple) else " " + key


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start[k] .. start[k] + size[k]."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def slices(batch: pa.RecordBatch, most: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about ``most`` or ``SLICE_BYTES`` each, or of one longer text; a null is empty.
    Only the texts of one slice are Python strings at a time."""
    column = batch.column("text")
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = size[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(size, before + (most or SLICE_BYTES), "right")))
        yield first, [t or "" for t in column.slice(first, stop - first).to_pylist()]
        first = stop


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside other tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class _Places(dict):
    """Chunk -> place; a chunk asked for the first time gets the next place and is noted as new."""

    def __init__(self) -> None:
        self.new: list[Hashable] = []

    def __missing__(self, key: Hashable) -> int:
        self.new.append(key)
        place = self[key] = len(self)
        return place


class Memory:
    """Chunk -> place; ``add`` is told what is new, and whether all places before were forgotten."""

    def __init__(self, chunks: int | None = None, chars: int | None = None) -> None:
        self.most = chunks or MEMORY_CHUNKS, chars or MEMORY_CHARS
        self.place = _Places()
        self.chars = 0

    def full(self) -> bool:
        return len(self.place) > self.most[0] or self.chars > self.most[1]

    def look_up(self, wanted: list[Hashable], add: Callable[[list[Hashable], bool], None]) -> np.ndarray:
        full = self.full()
        if full:
            self.place.clear()
            self.chars = 0
        self.place.new = []
        at = np.fromiter(map(self.place.__getitem__, wanted), np.int64, len(wanted))
        new = self.place.new
        if new or full:
            add(new, full)
            self.chars += sum(len(key if isinstance(key, str) else key[0]) for key in new)
        return at


class Grown:
    """An array that rows are put to: its room doubles, so it is not copied for each few rows."""

    def __init__(self, kind: type, *width: int) -> None:
        self.held, self.n = np.zeros((0, *width), kind), 0

    def extend(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.held):
            wider = np.empty((max(n, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            wider[: self.n] = self.rows
            self.held = wider
        self.held[self.n : n] = rows
        self.n = n

    @property
    def rows(self) -> np.ndarray:
        return self.held[: self.n]


class Ragged:
    """Growing rows of numbers."""

    def __init__(self, kind: type) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self._start, self._size, self._flat = Grown(np.int64), Grown(np.int64), Grown(self.kind)

    @property
    def start(self) -> np.ndarray:
        return self._start.rows

    @property
    def size(self) -> np.ndarray:
        return self._size.rows

    @property
    def flat(self) -> np.ndarray:
        return self._flat.rows

    def extend(self, size: np.ndarray, flat: np.ndarray) -> None:
        self._start.extend(len(self.flat) + np.cumsum(size) - size)
        self._size.extend(size)
        self._flat.extend(flat)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.start[at], self.size[at])]


def flat_ids(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of lists of ids."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    return size, np.array(list(chain.from_iterable(found)), np.int64)


def ids_of(strings: list[str], encode: Callable[[list[str]], list[list[int]]], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and ids of the chunks ``strings``, which the library gets ``JOINED`` at a time.

    Chunks may stand in one text where each begins with a space and the one before ends with
    something else. Their ids are parted by the bytes of the tokens (``length`` by id); where tokens
    have other bytes than their text, all of them are encoded again chunk by chunk.
    """
    joined: list[list[str]] = []
    for s in strings:
        if not joined or len(joined[-1]) == JOINED or s[:1] != " " or joined[-1][-1][-1:].isspace():
            joined.append([])
        joined[-1].append(s)
    found = encode(["".join(part) for part in joined])
    bytes_of = np.fromiter((len(s.encode("utf-8")) for s in strings), np.int64, len(strings))
    sizes, flat = flat_ids(found)
    many = np.fromiter(map(len, joined), np.int64, len(joined))
    # the tokens of a text must have its bytes, and one must end where each chunk does
    reached = np.cumsum(length[flat])
    ends = np.cumsum(bytes_of)
    place = np.minimum(np.searchsorted(reached, ends), max(0, len(flat) - 1))
    if len(flat) and (reached[place] == ends).all() and (np.diff(place[np.cumsum(many) - 1], prepend=-1) == sizes).all():
        return np.diff(place, prepend=-1), flat
    parts = [flat_ids([ids] if len(part) == 1 else encode(part)) for part, ids in zip(joined, found)]
    return np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


@lru_cache(maxsize=4)
def byte_level(raw: bytes, special_as_text: bool):
    """The library's tokenizer of a .json file, the bytes of its tokens by id, and whether its texts
    may be cut into chunks."""
    from tokenizers import Tokenizer

    spec = json.loads(raw)
    pre = spec["pre_tokenizer"] or {}
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and " " not in t["content"] for t in spec["added_tokens"])
    cuts = plain and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
    found = Tokenizer.from_str(raw.decode("utf-8"))
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = special_as_text
    byte_of = {shown: bytes([k]) for k, shown in enumerate(_shown_bytes())}
    added = {t["content"] for t in spec["added_tokens"]}
    entries = {k: token for token, k in found.get_vocab().items()}
    tokens = [
        token.encode("utf-8") if (token := entries.get(k, "")) in added
        else b"".join(byte_of.get(c, c.encode("utf-8")) for c in token)
        for k in range(max(entries) + 1)
    ]
    return found, tokens, cuts


def byte_level_ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def pieces(raw: bytes):
    """The library's processor of a .model file, the bytes of its pieces by id (none for what never
    stands in a text), and whether its texts may be cut into chunks."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_proto=raw)
    names = [found.id_to_piece(k) for k in range(found.get_piece_size())]
    cuts = not any(re.search("[^▁]▁", name) for name in names)
    # a model that folds or squeezes white space must see whole texts
    cuts &= found.decode(found.encode("a  b \n c")) == "a  b \n c"
    tokens = [
        bytes([int(name[3:-1], 16)]) if found.is_byte(k)
        else b"" if found.is_control(k) or found.is_unknown(k)
        else name.replace("▁", " ").encode("utf-8")
        for k, name in enumerate(names)
    ]
    return found, tokens, cuts
