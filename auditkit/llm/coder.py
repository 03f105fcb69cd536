"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks. Every block has its own model and coder state, starts afresh and carries a checksum of its
ids, so a damaged block is found and costs no other. Blocks of one call are coded in step, one numpy operation for all
blocks at a time.

Three predictions share the code space of the next id:

* order 2 and order 1 each name the id last seen after the same two ids, or the same one. How likely they are right is
  learned by how often they were before: each order keeps hits and misses by the confidence of its guess. What order 2
  leaves goes to order 1 by its own record, and what that leaves to order 0;
* order 0 spells an id neither guessed, in nibbles from high to low, by counts of the symbols seen after the same higher
  nibbles (below the third nibble, tables are shared by hash).

Block format: ``TIB1``, nibbles of an id (1 byte), ids (4), crc32 of the ids as little-endian 32-bit integers (4), then
16-bit little-endian words of the range coder.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, and blocks coded side by side at most.
BLOCK, LANES, MAGIC = 1024, 2048, b"TIB1"
_HEAD = struct.Struct("<4sBII")
TAILS, SLOTS, CONFIDENCES = 64, 512, 8
_NODES = 1 + 16 + 256 + TAILS
STEP, LIMIT = 24, 4096
#: Code space that orders 2, 1 and 0 share: 2^12, of which order 0 always has some.
_SPACE, _LEAST = 12, 64
#: 16 running sums of 16 bits are kept as 4 numbers of 64 bits, which are added and moved faster; a view shows the sums.
_ADDED = np.triu(np.full((16, 16), STEP, "<u2")).view("<u8")
_ONES = np.uint64(0x0101010101010101)
_U = np.uint64
_MASK, _LOW = _U(2**48 - 1), _U(2**32 - 1)


def _at(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``table[index]`` for valid numbers; taking is several times faster than indexing."""
    return table.take(index, axis=0, mode="clip")


class _Model:
    """What a block knows of the ids before, for all blocks side by side."""

    def __init__(self, lanes: int):
        self.sums = np.tile(np.arange(1, 17, dtype="<u2").view("<u8"), (lanes * _NODES, 1))
        self.guess = [np.zeros(lanes * SLOTS, np.uint32) for _ in range(2)]
        self.trust = [np.zeros(lanes * SLOTS, np.int8) for _ in range(2)]
        self.hits = [np.ones(lanes * CONFIDENCES, np.int64) for _ in range(2)]
        self.tries = [np.full(lanes * CONFIDENCES, 3, np.int64) for _ in range(2)]
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.lane = np.arange(lanes)
        self.rows = self.lane * 16

    def look(self, a: int) -> tuple:
        """Guesses of order 2 and order 1 for the next id of the first ``a`` blocks, and their code space."""
        last, lane = self.last[:a], self.lane[:a]
        two = (last * 40503 + self.before[:a] * 30011) >> 2
        self.slots = (lane * SLOTS + (two & (SLOTS - 1)), lane * SLOTS + (last & (SLOTS - 1)))
        self.ids = [_at(g, s).astype(np.int64) for g, s in zip(self.guess, self.slots)]
        self.levels = [_at(t, s) for t, s in zip(self.trust, self.slots)]
        self.kinds = [lane * CONFIDENCES + c for c in self.levels]
        left, space = np.full(a, (1 << _SPACE) - _LEAST), []
        for o in range(2):
            f = left * _at(self.hits[o], self.kinds[o]) // _at(self.tries[o], self.kinds[o])
            f *= self.levels[o] > 0
            if o:
                f *= self.ids[0] != self.ids[1]
            left = left - f
            space.append(f)
        return space[0], space[0] + space[1]

    def learn(self, a: int, ids: np.ndarray, hit: tuple) -> None:
        """Takes in the ids just coded; ``hit`` says for which of them each order's guess was used."""
        for o in range(2):
            c, slots, kinds = self.levels[o], self.slots[o], self.kinds[o]
            right = self.ids[o] == ids
            self.hits[o][kinds] += hit[o]
            self.tries[o][kinds] += 1 if o == 0 else ~hit[0]
            weak = c <= 1
            self.guess[o][slots] = np.where(weak, ids, self.ids[o])
            self.trust[o][slots] = np.where(right, np.minimum(c + 1, CONFIDENCES - 1), np.maximum(c >> 1, 1))
        self.before[:a], self.last[:a] = self.last[:a], ids

    def count(self, row: np.ndarray, sums: np.ndarray, symbol: np.ndarray) -> None:
        """One more ``symbol`` in each table; full tables are halved."""
        self.sums[row] = sums.view("<u8") + _at(_ADDED, symbol)
        over = np.flatnonzero(sums[:, 15] > LIMIT)
        if len(over):
            counts = np.diff(_at(self.sums, row[over]).view("<u2").astype(np.int64), axis=1, prepend=0)
            self.sums[row[over]] = np.cumsum((counts >> 1) | 1, axis=1).astype("<u2").view("<u8")


def _node(level: int, prefix: np.ndarray) -> np.ndarray:
    if level < 3:
        return (0, 1, 17)[level] + prefix
    return 273 + ((prefix * 40503) >> 3) % TAILS


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.out = np.zeros((words, lanes), np.int32)  # words of one rank lie together, as blocks grow at about one pace
        self.at = np.zeros(lanes, np.int64)
        self.low, self.wide = np.zeros(lanes, _U), np.full(lanes, 2**48 - 1, _U)

    def put(self, lanes, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Narrows ``lanes`` (a slice or an array of numbers) to ``size`` units from ``start`` on."""
        low = self.low[lanes] if isinstance(lanes, slice) else _at(self.low, lanes)
        lo, w = low + unit * start.astype(_U), unit * size.astype(_U)
        some = np.flatnonzero((w <= _LOW) | (lo > _MASK))
        if len(some):
            numbers = some if isinstance(lanes, slice) else lanes[some]
            l, v = lo[some], w[some]
            self._carry(numbers[l > _MASK])
            l &= _MASK
            send = v <= _LOW
            who = numbers[send]
            self.out[self.at[who], who] = l[send] >> _U(32)
            self.at[who] += 1
            lo[some], w[some] = np.where(send, (l & _LOW) << _U(16), l), np.where(send, v << _U(16), v)
        self.low[lanes], self.wide[lanes] = lo, w

    def _carry(self, who: np.ndarray) -> None:
        place = self.at[who] - 1
        while len(who):
            self.out[place, who] += 1
            more = self.out[place, who] > 0xFFFF
            self.out[place[more], who[more]] = 0
            who, place = who[more], place[more] - 1

    def words(self, lane: int) -> bytes:
        tail = [int(self.low[lane]) >> s & 0xFFFF for s in (32, 16, 0)]
        return np.append(self.out[:self.at[lane], lane], tail).astype("<u2").tobytes()


def _share(sums: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> tuple:
    """Where each row's symbol starts in its code space, and how much it has."""
    flat, place = sums.ravel(), rows + symbol
    start = np.where(symbol > 0, flat.take(place - 1, mode="clip"), np.uint16(0))
    return start, flat.take(place, mode="clip") - start


def _unit(wide: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A share of ``wide``; one less than a rounded quotient never overshoots."""
    return (wide.astype(np.float64) / total).astype(_U) - _U(1)


def _active(sizes: np.ndarray, steps: int) -> list[int]:
    """How many blocks have more than t ids; ``sizes`` falls."""
    return np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """One coded block for each array of ids (below 2^32)."""
    return [c for at in range(0, len(blocks), LANES) for c in _encode(blocks[at:at + LANES])]


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    steps = int(sizes.max(initial=0))
    ids = np.zeros((steps, len(order)), np.int64)
    for lane, i in enumerate(order):
        ids[:len(blocks[i]), lane] = blocks[i]
    nibbles = max(4, (int(ids.max(initial=0)).bit_length() + 3) // 4)
    model, writer = _Model(len(order)), _Writer(len(order), steps * (nibbles + 1) + 8)
    for t, a in enumerate(_active(sizes, steps)):
        now = ids[t, :a]
        first, both = model.look(a)
        hit2 = (model.ids[0] == now) & (first > 0)
        hit1 = (model.ids[1] == now) & (both > first) & ~hit2
        start = np.where(hit2, 0, np.where(hit1, first, both))
        size = np.where(hit2, first, np.where(hit1, both, 1 << _SPACE)) - start
        writer.put(slice(0, a), writer.wide[:a] >> _U(_SPACE), start, size)
        spell = np.flatnonzero(~(hit2 | hit1))
        prefix, rows, spelled = np.zeros(len(spell), np.int64), model.rows[:len(spell)], now[spell]
        for level in range(nibbles):
            symbol = (spelled >> (4 * (nibbles - 1 - level))) & 15
            row = spell * _NODES + _node(level, prefix)
            sums = _at(model.sums, row).view("<u2")
            start, size = _share(sums, rows, symbol)
            writer.put(spell, _unit(_at(writer.wide, spell), sums[:, 15]), start, size)
            model.count(row, sums, symbol)
            prefix = (prefix << 4) | symbol
        model.learn(a, now, (hit2, hit1))
    coded: list = [b""] * len(blocks)
    for lane, i in enumerate(order):
        coded[i] = _HEAD.pack(MAGIC, nibbles, len(blocks[i]), zlib.crc32(blocks[i].astype("<u4").tobytes())) + writer.words(lane)
    return coded


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks. Raises ValueError for a block that is not whole."""
    return [ids for at in range(0, len(coded), LANES) for ids in _checked(coded[at:at + LANES])]


def _checked(coded: list[bytes]) -> list[np.ndarray]:
    heads = [_HEAD.unpack_from(c) if len(c) >= _HEAD.size + 6 else (b"",) for c in coded]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a block of token ids")
    found: list = [None] * len(coded)
    for nibbles in {h[1] for h in heads}:
        mine = [i for i, h in enumerate(heads) if h[1] == nibbles]
        for i, ids in zip(mine, _decode([coded[i][_HEAD.size:] for i in mine], [heads[i][2] for i in mine], nibbles)):
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][3]:
                raise ValueError("the checksum of a block does not match")
            found[i] = ids
    return found


class _Reader:
    def __init__(self, payloads: list[bytes]):
        words = np.zeros((len(payloads), max(len(p) // 2 for p in payloads) + 4), np.uint16)
        for lane, p in enumerate(payloads):
            part = np.frombuffer(p, "<u2", len(p) // 2)
            words[lane, :len(part)] = part
        self.words = np.ascontiguousarray(words.T)
        first = self.words[:3].astype(_U)
        self.code = (first[0] << _U(32)) | (first[1] << _U(16)) | first[2]
        self.at = np.full(len(payloads), 3)
        self.wide = np.full(len(payloads), 2**48 - 1, _U)

    def value(self, lanes, unit: np.ndarray, total) -> np.ndarray:
        code = self.code[lanes] if isinstance(lanes, slice) else _at(self.code, lanes)
        return np.minimum((code // unit).astype(np.int64), total - 1)

    def take(self, lanes, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        c, w = self.code[lanes] - unit * start.astype(_U), unit * size.astype(_U)
        some = np.flatnonzero(w <= _LOW)
        if len(some):
            who = some if isinstance(lanes, slice) else lanes[some]
            c[some] = ((c[some] << _U(16)) | self.words[np.minimum(self.at[who], len(self.words) - 1), who]) & _MASK
            w[some] <<= _U(16)
            self.at[who] += 1
        self.code[lanes], self.wide[lanes] = c, w


def _decode(payloads: list[bytes], counts: list[int], nibbles: int) -> list[np.ndarray]:
    order = sorted(range(len(counts)), key=lambda i: -counts[i])
    sizes = np.array([counts[i] for i in order], np.int64)
    steps = int(sizes.max(initial=0))
    model, reader = _Model(len(order)), _Reader([payloads[i] for i in order])
    ids = np.zeros((steps, len(order)), np.int64)
    for t, a in enumerate(_active(sizes, steps)):
        first, both = model.look(a)
        lanes = slice(0, a)
        unit = reader.wide[lanes] >> _U(_SPACE)
        value = reader.value(lanes, unit, 1 << _SPACE)
        hit2 = value < first
        hit1 = (value < both) & ~hit2
        start = np.where(hit2, 0, np.where(hit1, first, both))
        reader.take(lanes, unit, start, np.where(hit2, first, np.where(hit1, both, 1 << _SPACE)) - start)
        now = np.where(hit2, model.ids[0], model.ids[1])
        spell = np.flatnonzero(~(hit2 | hit1))
        prefix, rows = np.zeros(len(spell), np.int64), model.rows[:len(spell)]
        for level in range(nibbles):
            row = spell * _NODES + _node(level, prefix)
            sums = _at(model.sums, row).view("<u2")
            unit = _unit(_at(reader.wide, spell), sums[:, 15])
            value = reader.value(spell, unit, sums[:, 15].astype(np.int64))
            below = (sums <= value.astype("<u2")[:, None]).view("<u8")  # a byte for each sum
            symbol = (((below[:, 0] + below[:, 1]) * _ONES) >> _U(56)).astype(np.int64)
            start, size = _share(sums, rows, symbol)
            reader.take(spell, unit, start, size)
            model.count(row, sums, symbol)
            prefix = (prefix << 4) | symbol
        now[spell] = prefix
        model.learn(a, now, (hit2, hit1))
        ids[t, :a] = now
    found: list = [None] * len(counts)
    for lane, i in enumerate(order):
        found[i] = ids[:counts[i], lane].astype(np.uint32)
    return found
