"""Encoding whole texts with a tokenizer file, fast.

Both kinds of vocabulary in use (``_PIECES``) split a text into pieces before any merge. A piece never goes on into a space or line feed that follows a
non-blank, and a line feed between non-blanks is a piece, so a text may be cut there and its chunks encoded apart: the ids are those of the whole text.
Chunks repeat, so every worker keeps the ids of those it has met; a full store loses its older half, which costs time only. A tokenizer
file that splits texts in another way encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks that a worker remembers at most.
STORE = 1 << 19
#: Where blanks meet, the last of them goes with what follows and the others are one piece. Without these pairs and with no blanks but
#: space and line feed (as Python sees blanks), no blanks meet.
_DELICATE_PAIRS = ["  ", "\n ", " \n", "\n\n", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")]
#: A run of these after a letter or digit is a piece of its own, so such words are encoded without it.
_TAIL = ".,;:!?&%$#*|"
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=\s)(?= \S)|(?<=\S\n)(?=\S)")
#: Blanks at which str.split and the tokenizers may differ.
_RARE_BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Signs that may stand between words that are encoded together; one that is a single id is taken.
_BETWEEN = "\u2605\u2192\u00a9\u00a3^"
_PLAIN = re.compile("[a-z]+").fullmatch
# How the tokenizer files that may be cut normalise and split a text; blanks are part of pieces in the first, of none in the second.
_PIECES = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
     {"type": "Sequence", "pretokenizers": [
         {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
         {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})]
_encoders: dict[object, Encoder] = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes. Strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ids: dict[str, bytes] = {}
        self.caseless = self.tokenizer.encode("Ab", add_special_tokens=False).ids == self.tokenizer.encode("aB", add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) for t in texts]
        missing = set().union(*cut).difference(self.ids)
        if len(self.ids) + len(missing) > STORE:
            self.ids = dict(islice(self.ids.items(), len(self.ids) // 2, None))  # the younger half stays
            missing = set().union(*cut).difference(self.ids)
        cores = {c: self._core(c) for c in missing}
        keys = {k: k.lower() if self.caseless and k.isascii() else k for c, core in cores.items() for k in (core, c[len(core):]) if k}
        wanted = list(set(keys.values()).difference(self.ids))
        for at in range(0, len(wanted), 20_000):
            part = wanted[at:at + 20_000]
            self.ids.update(zip(part, self._fresh(part)))
        get = self.ids.__getitem__
        for c, core in cores.items():
            tail = c[len(core):]
            self.ids[c] = get(keys[core]) + get(keys[tail]) if tail else get(keys[core])
        known = self.ids.__getitem__
        return [b"".join(map(known, chunks)) for chunks in cut]

    def _fresh(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    @staticmethod
    def _core(chunk: str) -> str:
        core = chunk.rstrip(_TAIL)
        return core if core and core[-1].isalnum() else chunk

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if any(b in text for b in _DELICATE_PAIRS):
            return [c for c in _SAFE_CUT.split(text) if c]
        # Equal to cutting before every space and around every line feed, at the speed of str.split.
        chunks = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if first:
                chunks.append(first)
            chunks += [" " + c for c in rest]
            chunks.append("\n")
        return chunks[:-1]


class WholeEncoder(Encoder):
    """For tokenizer files whose pieces are not known: whole texts, nothing remembered."""

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._fresh(texts)


class WordEncoder(Encoder):
    """For files that drop blanks: texts are lists of plain words, words are numbers, and ids are gathered by arrays.

    ``number`` gives a word's place in ``start`` and ``length``, which say where its ids lie in ``flat``. New words are encoded many at a
    time, as one text with a sign between them that no word among them has; those of small ASCII letters alone, which the file's own
    steps before the merges leave as they are, by the merges at once."""

    def __init__(self, path: str):
        super().__init__(path)
        self.merged = self.tokenizer.model.tokenize
        coded = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in _BETWEEN}
        self.sign = next((s for s, ids in coded.items() if len(ids) == 1), None)
        self.sign_id = coded[self.sign][0] if self.sign else None
        self.number: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._chunks(t) if any(b in t for b in _RARE_BLANKS) else t.split() for t in texts]
        words = list(chain.from_iterable(cut))
        places = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(places < 0).tolist()
        if new:
            missing = {words[i] for i in new}
            if len(self.number) + len(missing) > STORE:
                self._halve()
                new, missing = range(len(words)), set(words).difference(self.number)
            self._learn(missing)
            places[new] = [self.number[words[i]] for i in new]
        ends = np.append(0, self.length[places].cumsum())[np.cumsum([0, *map(len, cut)])] * 4
        ids = self._gathered(places).tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _gathered(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at ``places``, one after the other."""
        length = self.length[places]
        shift = self.start[places] - (length.cumsum() - length)
        return self.flat[np.repeat(shift, length) + np.arange(length.sum())]

    def _add(self, words: list[str], length: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + length.cumsum() - length])
        self.length, self.flat = np.concatenate([self.length, length]), np.concatenate([self.flat, ids])

    def _halve(self) -> None:
        """The younger half stays."""
        young = list(self.number)[len(self.number) // 2:]
        places = np.fromiter(map(self.number.__getitem__, young), np.int64, len(young))
        length, ids = self.length[places], self._gathered(places)
        self.number, self.start, self.length, self.flat = {}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._add(young, length, ids)

    def _learn(self, missing: set[str]) -> None:
        """A word is its core and what follows it; both are encoded once, in small letters where case doesn't count."""
        parts, wanted = [], set()
        for w in missing:
            core = w.rstrip(_TAIL)
            if not core or not core[-1].isalnum():
                core = w
            key = core.lower() if self.caseless and core.isascii() else core
            tail = w[len(core):]
            wanted.add(key)
            if tail:
                wanted.add(tail)
            if tail or key != w:
                parts.append((w, key, tail))
        plain, others = [], []
        for w in wanted:
            if w not in self.number:
                (plain if _PLAIN(w) else others).append(w)
        self._add_plain(plain)
        for at in range(0, len(others), 5_000):
            self._add_joined(others[at:at + 5_000])
        made = [(w, self.number[k], self.number[t] if t else -1) for w, k, t in parts if w not in self.number]
        if made:
            pairs = np.array([m[1:] for m in made])
            sizes = np.where(pairs < 0, 0, self.length[pairs])
            self._add([m[0] for m in made], sizes.sum(axis=1), self._gathered(pairs[pairs >= 0]))

    def _add_plain(self, words: list[str]) -> None:
        coded = [[t.id for t in self.merged(w)] for w in words]
        self._add(words, np.fromiter(map(len, coded), np.int64, len(coded)), np.fromiter(chain.from_iterable(coded), np.uint32))

    def _add_joined(self, words: list[str]) -> None:
        alone = [w for w in words if self.sign is None or self.sign in w]
        joined = [w for w in words if self.sign is not None and self.sign not in w]
        if joined:
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.sign} ".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
            signs = np.flatnonzero(ids == self.sign_id)
            if len(signs) != len(joined) - 1:
                raise ValueError("the tokenizer doesn't keep words apart")
            self._add(joined, np.diff(np.concatenate([[-1], signs, [len(ids)]])) - 1, np.delete(ids, signs))
        if alone:
            coded = self._fresh(alone)
            self._add(alone, np.array([len(c) // 4 for c in coded]), np.frombuffer(b"".join(coded), np.uint32))


def open_tokenizer(path: str) -> Encoder:
    """The fastest encoder that gives the file's ids."""
    with open(path, encoding="utf-8") as f:
        about = json.load(f)
    pieces = (about["normalizer"], about["pre_tokenizer"])
    known = pieces in _PIECES and about["post_processor"] is None
    return (WholeEncoder if not known else Encoder if pieces == _PIECES[0] else WordEncoder)(path)


def encoder(*key, make: Callable[..., Encoder] = open_tokenizer) -> Encoder:
    """The worker's encoder for a file (and what else ``make`` takes), loaded once."""
    if key not in _encoders:
        _encoders[key] = make(*key)
    return _encoders[key]


def forget() -> None:
    """Frees what this worker remembers, and Arrow's spare memory. Workers outlive a stage: one that goes on to other work has no use for old chunks."""
    _encoders.clear()
    pa.default_memory_pool().release_unused()


def batches(texts, chars: int = 500_000):
    """Lists of (index, text) with about ``chars`` characters each; a longer text goes alone. Bounds what is in work at once."""
    part, size = [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
