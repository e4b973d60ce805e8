"""Adaptive context mixing and range coding of token ids, many lanes at a time.

A block of ids is cut into lanes that advance together, one id a step; every step is a handful of numpy operations over all lanes,
and all lanes share one model, which starts anew with each block. The model predicts the next id from the last two ids
(order 2), from the last one (order 1), and from counts of single ids (order 0). How far to trust either prediction is learnt per
pair of their confidences: a first coding step says which prediction holds, with adaptive odds, and where neither does, a
second one codes the id by its count. Encoder and decoder make the same updates in whole numbers."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a full block.
BLOCK_TOKENS = 1 << 20
MOST_LANES = 8192
LEAST_STEPS = 128
MAGIC = b"CMR1"
HEADER = struct.Struct("<4s7I")

_U = np.uint64
_WORD = _U(32)
_LOW_MASK = _U(0xFFFFFFFF)
_UNIT = _U(1 << 32)
_TABLE_BITS = 18
_STEP_COUNT = 24
_MOST_COUNT = 1 << 23
_MOST_ODDS = 1 << 15
_ODDS_BITS = _U(16)
_SURE = 7


class Model:
    """The adaptive state that coder and decoder keep alike."""

    def __init__(self, lanes: int, vocabulary: int) -> None:
        self.next1 = np.zeros(vocabulary, np.int64)
        self.sure1 = np.zeros(vocabulary, np.int64)
        self.next2 = np.zeros(1 << _TABLE_BITS, np.int64)
        self.sure2 = np.zeros(1 << _TABLE_BITS, np.int64)
        self.odds = np.tile(np.array([4, 2, 4], np.int64), ((_SURE + 1) ** 2 * 2, 1))
        self._share()
        self.count = np.ones(vocabulary, np.int64)
        self.fresh: list[np.ndarray] = []
        self.last1 = np.zeros(lanes, np.int64)
        self.last2 = np.zeros(lanes, np.int64)
        self.step = 0
        self._sum()

    def _sum(self) -> None:
        self.upto = np.cumsum(self.count)
        self.total = _U(self.upto[-1])

    def _share(self) -> None:
        """The odds of each pair of confidences as three shares of 2**16, none of them empty, and where each begins."""
        total = self.odds.sum(axis=1, keepdims=True)
        shares = np.maximum((self.odds << 16) // total, 1)
        shares[np.arange(len(shares)), shares.argmax(axis=1)] += (1 << 16) - shares.sum(axis=1)
        self.size = shares.astype(_U).ravel()
        self.first, self.second = shares[:, 0].copy(), shares[:, 0] + shares[:, 1]
        self.start = np.stack([np.zeros(len(shares), _U), self.first.astype(_U), self.second.astype(_U)], axis=1).ravel()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The predictions of either order for each lane; ``pair`` is then the place of its odds."""
        self.slot = ((self.last2 * 0x9E3779B1 + self.last1 * 0x85EBCA6B) >> 7) & ((1 << _TABLE_BITS) - 1)
        self.guess2, self.guess1 = self.next2[self.slot], self.next1[self.last1]
        self.conf2, self.conf1 = self.sure2[self.slot], self.sure1[self.last1]
        self.pair = (self.conf2 * (_SURE + 1) + self.conf1) * 2 + (self.guess1 == self.guess2)
        return self.guess2, self.guess1

    def update(self, ids: np.ndarray, entry: np.ndarray, missed: np.ndarray) -> None:
        """``entry`` is 3 * pair + what came true (0: order 2, 1: order 1, 2: neither), ``missed`` the ids of lanes where neither
        did. Where lanes write to one place, the last holds."""
        for guess, sure, following, at in ((self.guess2, self.conf2, self.next2, self.slot), (self.guess1, self.conf1, self.next1, self.last1)):
            right = guess == ids
            following[at] = np.where(right | (sure > 0), guess, ids)
            (self.sure2 if following is self.next2 else self.sure1)[at] = np.where(right, np.minimum(sure + 1, _SURE), sure >> 1)
        self.odds += np.bincount(entry, minlength=self.odds.size).reshape(self.odds.shape)
        heavy = self.odds.sum(axis=1) > _MOST_ODDS
        if heavy.any():
            self.odds[heavy] = (self.odds[heavy] + 1) >> 1
        self._share()
        self.fresh.append(missed)
        self.last2, self.last1 = self.last1, ids
        self.step += 1
        if self.step <= 8 or self.step % 8 == 0:
            self.count += _STEP_COUNT * np.bincount(np.concatenate(self.fresh), minlength=len(self.count))
            self.fresh = []
            if self.count.sum() > _MOST_COUNT:
                self.count = (self.count + 1) >> 1
            self._sum()


def _layout(n: int) -> tuple[int, int]:
    lanes = max(1, min(MOST_LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


class _Encoder:
    """Range coders without carry, one a lane: 64-bit bounds, 32-bit words out."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.words = np.zeros((lanes, 2 * steps + 2), np.uint32)
        self.filled = np.zeros(lanes, np.int64)

    def put(self, where: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.uint64 | None = None) -> None:
        """Code an interval of ``total``, or of 2**16 where there is none."""
        low, width = self.low[where], self.range[where]
        width = width >> _ODDS_BITS if total is None else width // total
        low = low + width * start
        width = width * size
        small = np.flatnonzero(width < _UNIT)
        if len(small):
            lanes = small if isinstance(where, slice) else where[small]
            at = low[small]
            self.words[lanes, self.filled[lanes]] = at >> _WORD
            self.filled[lanes] += 1
            # a range across a word's bound is cut to this side of it
            width[small] = np.minimum(width[small], _UNIT - (at & _LOW_MASK)) << _WORD
            low[small] = at << _WORD
        self.low[where], self.range[where] = low, width

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        lanes = np.arange(len(self.low))
        self.words[lanes, self.filled] = (self.low + _LOW_MASK) >> _WORD
        self.filled += 1
        return self.filled, self.words[np.arange(self.words.shape[1]) < self.filled[:, None]]


class _Decoder:
    def __init__(self, filled: np.ndarray, words: np.ndarray) -> None:
        self.words = np.append(words, np.uint32(0)).astype(_U)
        self.end = np.cumsum(filled)
        self.at = self.end - filled
        self.low = np.zeros(len(filled), _U)
        self.range = np.full(len(filled), 0xFFFFFFFFFFFFFFFF, _U)
        self.code = np.zeros(len(filled), _U)
        for _ in range(2):
            self._shift(np.arange(len(filled)))

    def _shift(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        word = self.words[np.where(at < self.end[lanes], at, len(self.words) - 1)]
        self.code[lanes] = (self.code[lanes] << _WORD) | word
        self.at[lanes] += 1

    def target(self, where: np.ndarray | slice, total: np.uint64 | None = None) -> np.ndarray:
        width = self.range[where]
        self.part = width >> _ODDS_BITS if total is None else width // total
        most = _U((1 << 16) - 1) if total is None else total - _U(1)
        return np.minimum((self.code[where] - self.low[where]) // self.part, most).astype(np.int64)

    def take(self, where: np.ndarray | slice, start: np.ndarray, size: np.ndarray) -> None:
        low = self.low[where] + self.part * start
        width = self.part * size
        small = np.flatnonzero(width < _UNIT)
        if len(small):
            at = low[small]
            width[small] = np.minimum(width[small], _UNIT - (at & _LOW_MASK)) << _WORD
            low[small] = at << _WORD
            self._shift(small if isinstance(where, slice) else where[small])
        self.low[where], self.range[where] = low, width


_ALL = slice(None)


def encode_block(ids: np.ndarray) -> bytes:
    """One block, header and checksums included. ``ids`` are below 2**20."""
    n = len(ids)
    lanes, steps = _layout(n)
    vocabulary = int(ids.max()) + 1
    laid = np.zeros(lanes * steps, np.int64)
    laid[:n] = ids
    columns = np.ascontiguousarray(laid.reshape(lanes, steps).T)
    model, coder = Model(lanes, vocabulary), _Encoder(lanes, steps)
    for now in columns:
        guess2, guess1 = model.predict()
        event = np.where(now == guess2, 0, 2 - (now == guess1))
        entry = 3 * model.pair + event
        coder.put(_ALL, model.start[entry], model.size[entry])
        missing = np.flatnonzero(event == 2)
        missed = now[missing]
        if len(missing):
            size = model.count[missed]
            coder.put(missing, (model.upto[missed] - size).astype(_U), size.astype(_U), model.total)
        model.update(now, entry, missed)
    filled, words = coder.finish()
    payload = filled.astype("<u2").tobytes() + words.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, n, lanes, steps, vocabulary, len(payload), zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def decode_block(header: bytes, payload: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit numbers. Raises ValueError where a checksum does not hold."""
    magic, n, lanes, steps, vocabulary, size, payload_crc, ids_crc = HEADER.unpack(header)
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != payload_crc:
        raise ValueError("damaged block")
    filled = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    coder = _Decoder(filled, np.frombuffer(payload[2 * lanes:], "<u4", int(filled.sum())))
    model = Model(lanes, vocabulary)
    columns = np.empty((steps, lanes), np.int64)
    for step in range(steps):
        guess2, guess1 = model.predict()
        value = coder.target(_ALL)
        event = (value >= model.first[model.pair]).astype(np.int64) + (value >= model.second[model.pair])
        entry = 3 * model.pair + event
        coder.take(_ALL, model.start[entry], model.size[entry])
        now = np.where(event == 0, guess2, guess1)
        missing = np.flatnonzero(event == 2)
        missed = np.searchsorted(model.upto, coder.target(missing, model.total), side="right") if len(missing) else missing
        if len(missing):
            size = model.count[missed]
            coder.take(missing, (model.upto[missed] - size).astype(_U), size.astype(_U))
            now[missing] = missed
        model.update(now, entry, missed)
        columns[step] = now
    ids = columns.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("damaged ids")
    return ids
