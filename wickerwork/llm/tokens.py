"""Tokenising with a cache of pieces: both public tokenizers cut a text at white space before they merge, so a piece between
two cuts always gives the same ids, and only pieces not seen before reach the tokenizer. A batch's pieces are cut, hashed, looked
up and replaced by their ids with a few array operations."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already

#: Pieces that a worker remembers, some 40 bytes each, and plain words; bytes of the texts whose pieces are looked up together, and
#: of a long piece.
CACHE_PIECES, CACHE_WORDS, BUFFER_BYTES, LONG_PIECE = 1_000_000, 100_000, 1 << 20, 256

#: White space that is not ASCII, and separators that some pattern languages count as white space.
_ODD_SPACE = re.compile(rb"\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]")
_ODD_ASCII = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_ODD_OTHERS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Signs that may follow a word and are a piece of their own; the apostrophe is not one, as it begins contractions.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _odd(text: bytes) -> bool:
    """Whether a text has white space of those kinds. Plain searches for bytes come first, as nearly every text has none."""
    if any(x in text for x in _ODD_ASCII):
        return True
    if text.isascii():
        return False
    return any(x in text for x in _ODD_OTHERS) or (b"\xe2\x80" in text or b"\xe2\x81" in text) and _ODD_SPACE.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """The letters byte-level vocabularies spell bytes with: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own on the whole text.

    ``spaces`` says whether white space belongs to the word after it (byte-level) or is dropped (word-level). The strings of special
    tokens give their ids, as the library's plain call does, or with ``literal`` are ordinary text. A text in which cutting at ASCII
    white space could matter goes whole, and so does one that may hold a special token."""

    def __init__(self, path: str, spaces: bool, most: int = CACHE_PIECES, literal: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        added = [] if literal else self.tokenizer.get_added_tokens_decoder().values()
        self.marks = {t.content.encode()[:2] for t in added}
        self.spaces, self.most = spaces, most
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.merged: dict[str, bytes] = {}
        self.merged_before: dict[str, bytes] = {}
        self.hasher, self.table = _Hasher(), _Table()

    def _ids(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of pieces not seen before. A plain word, with or without a space before and stops after, is a merge of its own letters
        and needs the vocabulary's model only; anything else takes the tokenizer's whole way."""
        out: list[bytes | None] = [self._plain(p) for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        made = self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
        for i, x in zip(rest, made):
            out[i] = _bytes_of(x.ids)
        return out

    def _plain(self, piece: bytes) -> bytes | None:
        text = piece.decode("utf-8", "replace")
        space = self.spaces and text[:1] == " "
        word = text[space:].rstrip(_TAIL)
        tail = text[space + len(word):]
        if not word.isalpha() or not (word.isascii() or unicodedata.is_normalized("NFC", word) and self._simple(word)):
            return None
        if not self.spaces:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = self._merge("\u0120" + word if space else word)  # the letter that stands for a space
        return ids + self._merge(tail) if tail else ids

    def _merge(self, spelled: str) -> bytes:
        ids = self.merged.get(spelled)
        if ids is None:
            ids = self.merged_before.get(spelled)
            if ids is None:
                ids = _bytes_of([t.id for t in self.model.tokenize(spelled)])
            self.merged[spelled] = ids
        return ids

    @staticmethod
    def _simple(word: str) -> bool:
        """Latin letters, whose classes and lower case no two Unicode versions disagree on."""
        return max(word) < "\u0180" and "\u0130" not in word

    def encode(self, texts: Sequence[bytes | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(mark in text for mark in self.marks) or self.spaces and _odd(text):
                out[i] = _bytes_of(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
            else:
                plain.append(i)
        at, size = 0, 0
        for k, i in enumerate(plain):  # some texts at a time, so that the arrays stay small
            size += len(texts[i])
            if size > BUFFER_BYTES or k + 1 == len(plain):
                self._encode_plain(texts, plain[at:k + 1], out)
                at, size = k + 1, 0
        return out

    def _encode_plain(self, texts: Sequence[bytes | None], chosen: list[int], out: list[bytes]) -> None:
        buffer = b"".join([texts[i] for i in chosen])
        ends = np.cumsum([len(texts[i]) for i in chosen])
        first, last = self._cuts(np.frombuffer(buffer, np.uint8), ends)
        keys = self.hasher(buffer, first, last)
        place = self.table.find(keys)
        if (fresh := np.flatnonzero(place < 0)).size:
            _, once = np.unique(keys[fresh], return_index=True)
            new = fresh[once]
            pieces = [buffer[x:y] for x, y in zip(first[new].tolist(), last[new].tolist())]
            made: list[bytes] = []
            for lo in range(0, len(pieces), 4096):
                made.extend(self._ids(pieces[lo:lo + 4096]))
            if len(self.table) + len(new) > self.most:
                # those of this batch stay; what is met again later is made again
                kept = np.unique(place[place >= 0])
                self.table = self.table.only(kept)
            self.table.add(keys[new], made)
            place = self.table.find(keys)
            if len(self.merged) > CACHE_WORDS:
                self.merged_before, self.merged = self.merged, {}
        ids, lengths = self.table.gather(place)
        upto = np.r_[0, np.cumsum(lengths)]
        # a text's pieces lie together: up to which piece, up to which id
        stop = upto[np.searchsorted(first, ends, "left")]
        start = 0
        for i, end in zip(chosen, stop.tolist()):
            out[i] = ids[start:end].tobytes()
            start = end

    def _cuts(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and end: words, or white space and the word after it. No piece goes on in the next text."""
        white = _IS_SPACE[raw]
        opens = np.zeros(len(raw), bool)
        opens[0] = True
        opens[ends[:-1]] = True
        before = np.r_[False, white[:-1]]
        if self.spaces:
            first = np.flatnonzero(opens | (white & ~before))
            return first, np.r_[first[1:], len(raw)]
        first = np.flatnonzero(~white & (before | opens))
        closes = np.r_[opens[1:], True] | np.r_[white[1:], True]
        return first, np.flatnonzero(~white & closes) + 1


class _Hasher:
    """64-bit hashes of slices of a buffer: differences of running sums of its bytes times powers of an odd number, turned back by
    the slice's start. Two of a worker's pieces have the same hash about once in a million million batches; pieces of more
    than LONG_PIECE bytes, for which such sums are weak, are hashed by themselves."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240611)
        self.letter = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        factor = 0x9E3779B97F4A7C15
        self.factor, self.inverse = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        self.powers = self.back = np.ones(1, np.uint64)

    def __call__(self, buffer: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = len(buffer)
        if len(self.powers) < n:
            self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, self.factor)])
            self.back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, self.inverse)])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letter[np.frombuffer(buffer, np.uint8)] * self.powers[:n], out=sums[1:])
        keys = (sums[last] - sums[first]) * self.back[first]
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys += (last - first).astype(np.uint64)
        for i in np.flatnonzero(last - first > LONG_PIECE).tolist():
            keys[i] = int.from_bytes(hashlib.blake2b(buffer[first[i]:last[i]], digest_size=8).digest(), "little")
        return keys


class _Table:
    """Ids of pieces by hash, in arrays: sorted hashes, and where in one row of ids those of each piece lie."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, place, -1)

    def add(self, keys: np.ndarray, made: list[bytes]) -> None:
        length = np.fromiter(map(len, made), np.int64, len(made)) // 4
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), np.uint32)])
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        self.keys, self.start, self.length = every[order], np.concatenate([self.start, start])[order], np.concatenate([self.length, length])[order]

    def gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places, one after another, and how many each has."""
        length = self.length[place]
        upto = np.cumsum(length)
        at = np.repeat(self.start[place] - upto + length, length) + np.arange(int(upto[-1]) if len(upto) else 0)
        return self.ids[at], length

    def only(self, kept: np.ndarray) -> _Table:
        out = _Table()
        out.keys, out.length = self.keys[kept], self.length[kept]
        out.ids, _ = self.gather(kept)
        out.start = np.cumsum(out.length) - out.length
        return out


@lru_cache(maxsize=2)
def shared_encoder(path: str, spaces: bool, literal: bool = False) -> CachedEncoder:
    """The encoder of a worker process, whose cache lasts from task to task."""
    return CachedEncoder(path, spaces, literal=literal)
