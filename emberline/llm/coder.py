"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks. Each starts anew from the same model, so any block can be decoded alone, and a CRC32 guards its ids. An
id is some digits of four bits: frequent ids have few, by a Huffman code of sixteen branches over the ids of the blocks that are
written together; an id that these do not hold is an escape and four digits. Three orders predict each digit: under the digits of
the id before it (order 0), under these and the last id (order 1), and under these and the last two ids (order 2). The probability
of a digit is the sum of what the orders say, each with its weight. Weights adapt with every digit, within a context of the digit's
place and of how often orders 1 and 2 have met their contexts.

What the orders say at the start of a block is learned from the ids of many blocks, those that are written together, and kept once for
all of them (``Start``); contexts that are too rare to be worth their room there are left to the orders below. All is integers, so
encoder and decoder agree on every machine. The coder is a carry-less range coder of 64 bits that moves 32 at a time.

Many blocks are coded in lockstep: every variable is an array with one entry a block, and one pass over the longest
block codes them all. What does not depend on the digits before it is made in arrays for all digits beforehand.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK, LANES = 1024, 4096
MAGIC, START = b"EMC4", b"EMS2"
_DIGITS, _WEIGHT = 12, 8  # bits of an order's probabilities, and of its weight
_BITS = _DIGITS + _WEIGHT
_ONE = 1 << 15
_RATE = 5
_LEAST = (2, 256, 1024)  # how often a context of each order must be met to be kept
_S32, _LOW, _WORD = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
#: Counts that stand for the steps of a row: nothing, then by halves of a power of two.
_SIZES = np.array([0, *(int(2 ** (k / 2) * 64) for k in range(1, 17))], np.int64)
_IDS = 1 << 16  # ids lie below; this is the escape
_PART = 1 << 15  # ids whose digits are made at a time


class _Coder:
    """A range coder a lane. ``narrow`` takes all lanes of a prefix or some of them."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def narrow(self, at, start: np.ndarray, size: np.ndarray, step: np.ndarray) -> None:
        low = self.low[at] + start.astype(np.uint64) * step
        wide = step * size.astype(np.uint64)
        tight = np.flatnonzero(wide < _WORD)
        if len(tight):
            # a range that straddles a word's border is cut at it, so the high word is settled
            cut = low[tight]
            self.shift(at[tight] if isinstance(at, np.ndarray) else tight, cut >> _S32)
            wide[tight] = np.minimum(wide[tight], _WORD - (cut & _LOW)) << _S32
            low[tight] = cut << _S32
        self.low[at], self.range[at] = low, wide


class Encoder(_Coder):
    def __init__(self, lanes: int, words: int):
        super().__init__(lanes)
        self.out, self.n = np.zeros((lanes, words), np.uint32), np.zeros(lanes, np.int64)

    def shift(self, lanes, words):
        n = self.n[lanes]
        if int(n.max()) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, n] = words
        self.n[lanes] = n + 1

    def value(self, at):
        return self.range[at] >> np.uint64(_BITS), None

    def finish(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(2):
            self.shift(every, self.low >> _S32)
            self.low <<= _S32
        return [self.out[i, : self.n[i]].astype("<u4").tobytes() for i in every]


class Decoder(_Coder):
    def __init__(self, coded: list[bytes]):
        super().__init__(len(coded))
        most = max(map(len, coded)) // 4 + 4
        self.data, self.n = np.zeros((len(coded), most), np.uint64), np.full(len(coded), 2, np.int64)
        for i, c in enumerate(coded):
            self.data[i, : len(c) // 4] = np.frombuffer(c[: len(c) // 4 * 4], "<u4")
        self.code = self.data[:, 0] << _S32 | self.data[:, 1]

    def shift(self, lanes, _):
        n = self.n[lanes]
        self.code[lanes] = self.code[lanes] << _S32 | self.data[lanes, np.minimum(n, self.data.shape[1] - 1)]
        self.n[lanes] = n + 1

    def value(self, at):
        step = self.range[at] >> np.uint64(_BITS)
        return step, ((self.code[at] - self.low[at]) // step).astype(np.int32)


class _Digits:
    """The digits of every id, and the tree that leads back: a node is what is known of an id before its next digit."""

    def __init__(self, sizes: np.ndarray):
        """``sizes``: digits of the code of every id and of the escape, 0 for ids without one. The code is canonical."""
        self.sizes = sizes
        code, next_code, most = np.zeros(_IDS + 1, np.int64), 0, int(sizes.max())
        for size in range(1, most + 1):
            own = np.flatnonzero(sizes == size)
            next_code <<= 4
            code[own] = next_code + np.arange(len(own))
            next_code += len(own)
        escape = sizes[:_IDS] == 0
        own, code = np.where(escape, sizes[_IDS], sizes[:_IDS]).astype(np.int64), np.where(escape, code[_IDS], code[:_IDS])
        self.n = own + 4 * escape
        self.width = most + 4
        node, digit = np.zeros((_IDS, self.width), np.int64), np.zeros((_IDS, self.width), np.int64)
        place, nodes = [], 0
        for k in range(most):
            inside = np.flatnonzero(own > k)
            found, at = np.unique(code[inside] >> 4 * (own[inside] - k), return_inverse=True)
            node[inside, k] = nodes + at
            digit[inside, k] = code[inside] >> 4 * (own[inside] - 1 - k) & 15
            place += [min(k, 3) * 16] * len(found)
            nodes += len(found)
        rest, at = np.flatnonzero(escape), int(sizes[_IDS])
        for k, before in enumerate((0, 1, 17, 273)):
            node[rest, at + k] = nodes + before + (rest >> 16 - 4 * k)
            digit[rest, at + k] = rest >> 12 - 4 * k & 15
        self.nodes = nodes + 4369
        self.place = np.array([*place, *[3 * 16] * 4369], np.uint32)  # of the weights
        self.child = np.full(self.nodes * 16, -1, np.int32)  # the next node, or the id turned over
        for k in range(self.width):
            inside = np.flatnonzero(self.n > k)
            after = np.where(self.n[inside] > k + 1, node[inside, min(k + 1, self.width - 1)], ~inside)
            self.child[node[inside, k] * 16 + digit[inside, k]] = after
        self.node, self.digit = node.astype(np.uint16).ravel(), digit.astype(np.uint8).ravel()

    @classmethod
    def of(cls, counts: np.ndarray) -> _Digits:
        """A Huffman code of sixteen branches for the ids that ``counts`` counts, and for the escape."""
        seen = np.append(np.flatnonzero(counts), _IDS)
        weights = np.append(counts[seen[:-1]], 0).tolist()
        none = -(len(seen) - 1) % 15 if len(seen) > 1 else 0
        heap = [(w, i) for i, w in enumerate([*weights, *[0] * none])]
        above, made = np.zeros(len(heap), np.int64), len(heap)
        heapq.heapify(heap)
        parents = []  # of the nodes made
        while len(heap) > 1:
            total = 0
            for _ in range(16):
                w, i = heapq.heappop(heap)
                total += w
                if i < len(above):
                    above[i] = made + len(parents)
                else:
                    parents[i - made] = made + len(parents)
            parents.append(0)
            heapq.heappush(heap, (total, made + len(parents) - 1))
        depth = np.zeros(max(len(parents), 1), np.int64)
        for i in range(len(parents) - 2, -1, -1):
            depth[i] = depth[parents[i] - made] + 1
        sizes = np.zeros(_IDS + 1, np.uint8)
        sizes[seen] = depth[above[: len(seen)] - made] + 1 if parents else 1
        return cls(sizes)

    def parts(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(node, digit, last id, the id before that) of every digit of ``ids``, some at a time; at ``starts`` there are no ids before."""
        last = np.append(ids[:1] * 0, ids[:-1]).astype(np.uint32)
        last[starts] = 0
        before = np.append(last[:1] * 0, last[:-1])
        before[starts] = 0
        for k in range(0, len(ids), _PART):
            some = ids[k : k + _PART].astype(np.int64)
            n = self.n.take(some)
            ends = np.cumsum(n)
            at = np.repeat(some * self.width - ends + n, n) + np.arange(ends[-1])
            yield self.node.take(at), self.digit.take(at), np.repeat(last[k : k + _PART], n), np.repeat(before[k : k + _PART], n)


def _slots(bits: int, node: np.ndarray, last: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The row of a context in the table of each order, as its first entry; different contexts may share one. All are of 32 bits."""
    node = node.astype(np.uint32)
    one = last * _MIX[0]
    one += node * _MIX[1]
    two = before * _MIX[2]
    two ^= one
    out = [node.astype(np.int64) << 4]
    for x in (one, two):
        x ^= x >> _S15
        x *= _MIX[3]
        x ^= x >> _S13
        x &= np.uint32((1 << bits) - 1)
        out.append(x.astype(np.int64) << 4)
    return out


_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x2C1B3C6D], np.uint32)
_S2, _S4, _S13, _S15, _S16 = (np.uint32(n) for n in (2, 4, 13, 15, 16))
_ROOM, _CLASS, _ONCE = np.uint32((1 << _DIGITS) - 1), np.uint32(3), np.uint32(1)


class Start:
    """What the three orders say before a block is read: rows of sixteen counts, and a class of how often each was met."""

    def __init__(self, digits: _Digits, bits: int, counts: list[np.ndarray], met: list[np.ndarray]):
        self.digits, self.bits, self.counts, self.met = digits, bits, counts, met
        self.said = []  # an entry holds where a digit begins (from bit 16 on), its room less one (12 bits), its row's class
        for rows, kind in zip(counts, met, strict=True):
            some = np.flatnonzero(rows.any(1))
            # a row without counts says that all digits are alike
            said = np.tile(np.arange(16, dtype=np.uint32) << np.uint32(24) | np.uint32(255 << 4), (len(rows), 1))
            n = _SIZES[rows[some]]
            share = n * ((1 << _DIGITS) - 16) // n.sum(1, keepdims=True) + 1  # every digit keeps some room
            ends = np.cumsum(share, axis=1)
            share[:, 15] += (1 << _DIGITS) - ends[:, 15]
            ends[:, 15] = 1 << _DIGITS
            said[some] = (ends - share << 16 | share - 1 << 4 | kind[some, None]).astype(np.uint32)
            self.said.append(said.ravel())

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Start:
        """Learned from ``blocks``."""
        ids, starts = _joined(blocks)
        digits = _Digits.of(np.bincount(ids, minlength=_IDS))
        bits = min(max(len(ids).bit_length() - 5, 8), 17)
        sizes = [digits.nodes, 1 << bits, 1 << bits]
        counts = [np.zeros(n * 16, np.int32) for n in sizes]
        held: list[list[np.ndarray]] = [[], [], []]

        def add() -> None:
            for table, own in zip(counts, held, strict=True):
                if own:
                    table += np.bincount(np.concatenate(own), minlength=len(table)).astype(np.int32)
                    own.clear()

        for k, (node, digit, last, before) in enumerate(digits.parts(ids, starts), 1):
            for own, rows in zip(held, _slots(bits, node, last, before), strict=True):
                rows += digit
                own.append(rows)
            if k % 32 == 0:
                add()
        add()
        kept, met = [], []
        for table, least in zip(counts, _LEAST, strict=True):
            rows = table.reshape(-1, 16)
            total = rows.sum(1)
            some = np.flatnonzero(total >= least)
            own, steps = rows[some], np.zeros(rows.shape, np.uint8)
            # halves of a power of two, down from a row's largest count: few values, which pack well
            most = np.maximum(own.max(1, keepdims=True), 1)
            step = np.floor(2 * np.log2(np.maximum(own, 1) / most) + 0.5).astype(np.int64) + 16
            steps[some] = np.where((own > 0) & (own.astype(np.int64) * 256 > most), np.clip(step, 1, 16), 0)
            kept.append(steps)
            met.append(np.where(total < least, 0, np.where(total < 16 * least, 1, np.where(total < 256 * least, 2, 3))).astype(np.uint8))
        return cls(digits, bits, kept, met)

    def pack(self) -> bytes:
        body = zlib.compress(b"".join(x.tobytes() for x in (self.digits.sizes, *self.counts, *self.met[1:])), 4)
        return START + struct.pack("<BI", self.bits, zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> Start:
        if data[:4] != START or len(data) < 9:
            raise ValueError("not the start of coded blocks")
        bits, crc = struct.unpack("<BI", data[4:9])
        if zlib.crc32(data[9:]) != crc:
            raise ValueError("the start of coded blocks fails its checksum")
        flat = np.frombuffer(zlib.decompress(data[9:]), np.uint8)
        digits = _Digits(flat[: _IDS + 1])
        sizes = [digits.nodes * 16, 16 << bits, 16 << bits, 1 << bits, 1 << bits]
        a, b, c, d, e = np.split(flat[_IDS + 1 :], np.cumsum(sizes)[:-1])
        return cls(digits, bits, [x.reshape(-1, 16) for x in (a, b, c)], [np.zeros(digits.nodes, np.uint8), d, e])


def _joined(blocks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all blocks, and where each block that has any begins."""
    ids = np.concatenate([np.empty(0, np.int32), *blocks])
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < _IDS:
        raise ValueError("ids must lie in 0 to 65535")
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    return ids.astype(np.int32), starts[[len(x) > 0 for x in blocks]] if len(blocks) else starts


#: What the ends of the weights move to when order 2, order 1 or order 0 said most; each keeps some room.
_RIGHT = np.array([[_ONE - 256, _ONE - 128], [128, _ONE - 128], [128, 256]], np.int16).view(np.int32).ravel()


def _first_weights() -> np.ndarray:
    """Where the weights of order 2 and order 1 end, by classes of order 2 and order 1."""
    out = np.zeros((4, 4, 2), np.int16)
    for two in range(4):
        for one in range(4):
            out[two, one] = (_ONE // 2 if two else 128), (_ONE * 7 // 8 if one or two else 256)
    return out.reshape(16, 2)


def _at(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Entries of a table; all of ``at`` lie in it, so they are not checked."""
    return table.take(at, mode="clip")


def _shares(weights: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ends of the weights at ``place``, and the weights of the orders 0 to 2."""
    ends = _at(weights, place)
    both = (ends.view(np.int16) >> 15 - _WEIGHT).astype(np.int32).reshape(-1, 2)
    two, one = both[:, 0].copy(), both[:, 1]
    return ends, [(1 << _WEIGHT) - one, one - two, two]


def _adapt(weights: np.ndarray, place: np.ndarray, ends: np.ndarray, right: np.ndarray) -> None:
    """Move the ends of the weights, as they were, to the order that was right."""
    now, to = ends.view(np.int16), _at(_RIGHT, right).view(np.int16)
    to -= now
    to >>= _RATE
    now += to
    weights[place] = ends


def _mixed(said: list[np.ndarray], share: list[np.ndarray]) -> np.ndarray:
    out = said[0] * share[0]
    out += said[1] * share[1]
    out += said[2] * share[2]
    return out


def _begin(entries: list[np.ndarray], share: list[np.ndarray]) -> np.ndarray:
    return _mixed([(x >> _S16).view(np.int32) for x in entries], share)


def _room(entries: np.ndarray) -> np.ndarray:
    """How much of an order's room a digit has."""
    out = entries >> _S4
    out &= _ROOM
    out += _ONCE
    return out.view(np.int32)


def _right(said: list[np.ndarray]) -> np.ndarray:
    """Which order said most of a digit: 0 for order 2, 1 for order 1, 2 for order 0."""
    first = said[2] >= np.maximum(said[0], said[1])
    return (2 - (said[1] >= said[0]).view(np.int8)) * ~first


def _places(node_place: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where the weights of a digit are kept: by its place and by the classes of orders 2 and 1."""
    return ((two & _CLASS) << _S2) + (one & _CLASS) + node_place


def _encode(blocks: list[np.ndarray], start: Start) -> tuple[list[bytes], np.ndarray]:
    """The coded words of each block, and its number of digits."""
    ids, starts = _joined(blocks)
    digits, n = start.digits, len(blocks)
    sizes = np.array([len(x) for x in blocks], np.int64)
    ends = np.append(0, np.cumsum(digits.n.take(ids)))
    ends = ends[np.append(0, np.cumsum(sizes))]
    # all that does not depend on the weights: what each order says, the place of the weights and the order that said most
    known, at = np.empty((ends[-1], 4), np.uint32), 0
    for node, digit, last, before in digits.parts(ids, starts):
        found = [_at(t, r + digit) for t, r in zip(start.said, _slots(start.bits, node, last, before), strict=True)]
        to = slice(at, at := at + len(node))
        for k, x in enumerate(found):
            known[to, k] = x
        known[to, 3] = _places(_at(digits.place, node), found[1], found[2]) + _right([_room(x) for x in found]).astype(np.uint32) * np.uint32(64)
    known = known.view(np.complex128).ravel()  # an entry is moved as one
    order = np.argsort(-np.diff(ends), kind="stable")
    lengths, at = np.diff(ends)[order], ends[:-1][order]
    coder = Encoder(n, int(lengths[0]) // 4 + 16)
    weights = np.tile(_first_weights(), (n * 4, 1)).view(np.int32).ravel()  # lane, place of the digit, classes
    lane, m = np.arange(n) * 64, n
    for t in range(int(lengths[0])):
        if lengths[m - 1] <= t:
            m = int(np.searchsorted(-lengths, -t, side="left"))
            lane, at = lane[:m], at[:m]
        every, here = slice(0, m), at + t
        *found, kind = _at(known, here).view(np.uint32).reshape(-1, 4).T
        place = lane + (kind & 63)
        own, share = _shares(weights, place)
        coder.narrow(every, _begin(found, share), _mixed([_room(x) for x in found], share), coder.value(every)[0])
        _adapt(weights, place, own, kind >> 6)
    words = coder.finish()
    out = [b""] * n
    for i, x in zip(order.tolist(), words, strict=True):
        out[i] = x
    return out, np.diff(ends)


def _decode(coded: list[bytes], start: Start, sizes: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks by their numbers of ids and of digits, ``lengths``, which descend."""
    coder, digits, n = Decoder(coded), start.digits, len(coded)
    room = int(sizes.max()) + 1
    out, at = np.zeros(n * room, np.uint32), np.arange(n) * room
    most = at + sizes
    weights = np.tile(_first_weights(), (n * 4, 1)).view(np.int32).ravel()
    lane, m = np.arange(n) * 64, n
    node, last, before = np.zeros(n, np.int32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for t in range(int(lengths[0])):
        if lengths[m - 1] <= t:
            m = int(np.searchsorted(-lengths, -t, side="left"))
            node, last, before, at, most, lane = node[:m], last[:m], before[:m], at[:m], most[:m], lane[:m]
        every = slice(0, m)
        rows = _slots(start.bits, node, last, before)
        # by halves: the digit begins at or before the value, the next one behind it
        found = [_at(x, r + 8) for x, r in zip(start.said, rows, strict=True)]
        place = lane + _places(_at(digits.place, node), found[1], found[2])
        own, share = _shares(weights, place)
        step, value = coder.value(every)
        for half in (4, 2, 1, 0):
            more = (_begin(found, share) <= value).astype(np.int64)
            more *= half * 2 or 1
            for r in rows:
                r += more
            found = [_at(x, r + half if half else r) for x, r in zip(start.said, rows, strict=True)]
        said = [_room(x) for x in found]
        coder.narrow(every, _begin(found, share), _mixed(said, share), step)
        _adapt(weights, place, own, _right(said))
        # order 0 has a row a node, so the place in its table is that of the node and the digit
        after = _at(digits.child, rows[0])
        leaf = after >> 31
        seen = (~after).view(np.uint32)
        out[at] = seen  # a later id takes the place of what was none
        at = np.minimum(at - leaf, most)
        leaf = leaf.view(np.uint32)
        before = before ^ (before ^ last) & leaf
        last = last ^ (last ^ seen) & leaf
        node = np.maximum(after, 0)
    return [out[i * room : i * room + k] for i, k in enumerate(sizes.tolist())]


def encode(blocks: list[np.ndarray], start: Start) -> list[bytes]:
    """Each block of ids (0 to 65535) as bytes: magic, numbers of ids and of digits, CRC32 of the ids as uint32, coded words."""
    out = []
    for at in range(0, len(blocks), LANES):
        some = blocks[at : at + LANES]
        for x, words, n in zip(some, *_encode(some, start), strict=True):
            out.append(MAGIC + struct.pack("<III", len(x), n, zlib.crc32(x.astype("<u4").tobytes())) + words)
    return out


def decode(coded: list[bytes], start: Start) -> list[np.ndarray]:
    """The ids of blocks; ValueError on a block that is not one or fails its checksum."""
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(coded)
    heads = []
    for c in coded:
        if c[:4] != MAGIC or len(c) < 16:
            raise ValueError("not a block of coded ids")
        heads.append(struct.unpack("<III", c[4:16]))
    for at in range(0, len(coded), LANES):
        order = sorted(range(at, min(at + LANES, len(coded))), key=lambda i: -heads[i][1])
        sizes, lengths = (np.array([heads[i][k] for i in order], np.int64) for k in (0, 1))
        if (lengths > sizes * start.digits.width).any():
            raise ValueError("a block has more digits than its ids")
        for i, ids in zip(order, _decode([coded[i][16:] for i in order], start, sizes, lengths), strict=True):
            out[i] = ids.astype("<u4")
            if zlib.crc32(out[i].tobytes()) != heads[i][2]:
                raise ValueError("a block fails its checksum")
    return out
