"""Token ids of whole texts by a public tokenizer, with each distinct piece encoded once.

Texts are cut into pieces where no pre-token, normalisation or merge of the
tokenizers can reach across: before the last white-space byte of each run that
precedes other characters, and between a plain Latin letter and ASCII
punctuation other than the apostrophe.  The ids of a text are those of its
pieces in order.  Pieces repeat heavily, so a task encodes the distinct ones
and copies their ids.  A piece is looked up by a hash, and its bytes are compared
with those of the piece found; one that differs is encoded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from lamellar.llm import kernels as K

#: Distinct pieces remembered in a Python worker before it starts afresh.
REMEMBERED = 400_000
#: An odd number, the base of the hash that looks pieces up.
BASE = 0x5851F42D4C957F2D
#: Text bytes encoded at once, and those hashed at once (which fit a core's cache).
BLOCK_BYTES, PART_BYTES = 1 << 20, 256 << 10
#: Pieces that make one string for the tokenizer.
JOINED = 64

_ENCODERS: dict[str, "Encoder"] = {}

_BYTES = K.mix(np.arange(1, 257, dtype=np.uint64))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A quick 64-bit hash of slices, modulo 2**64; different ones may share it."""
    n = max(PART_BYTES, 1 << int(len(raw)).bit_length())
    upto = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(BASE, n)[: len(raw)], out=upto[1:])
    return K.mix((upto[end] - upto[start]) * _powers(pow(BASE, -1, 1 << 64), n)[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def encoder(path: str) -> "Encoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Ids of blocks of rows by the tokenizer at path; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        #: Bytes of text that a token stands for: each character of a byte-level token is one byte.
        self.width = np.array([len(x.removesuffix("</w>")) for x in names], np.int64)
        self.drops_white = any(x.endswith("</w>") for x in names)
        self.forget()

    def forget(self) -> None:
        self.known = pd.Index(np.zeros(0, np.uint64))
        self.flat = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        #: The known pieces' bytes, and where each starts in them.
        self.bytes, self.bytes_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def differing(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which pieces are not, byte by byte, those known at the given places."""
        size, own = end - start, self.bytes_at[place]
        out = size != self.bytes_at[place + 1] - own
        same, low = np.flatnonzero(~out), 0
        upto = np.concatenate([[0], np.cumsum(size[same])])
        while low < len(same):  # some kilobytes at once
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + PART_BYTES, side="right")) - 1)
            k = same[low:high]
            inner = np.arange(upto[high] - upto[low])
            shift = lambda base: inner + np.repeat(base - (upto[low:high] - upto[low]), size[k])  # noqa: B023,E731
            odd = raw[shift(start[k])] != self.bytes[shift(own[k])]
            if odd.any():
                out[k[np.searchsorted(upto[low : high + 1] - upto[low], np.flatnonzero(odd), side="right") - 1]] = True
            low = high
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def pieces(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte start of each piece; every row with text starts one."""
        white, letter = K._IS_WHITE[raw], _LETTER[raw]
        wide = raw == 0xC3
        if wide.any():  # U+00C0 to U+00FF but the two signs among them are letters
            after = np.flatnonzero(wide[:-1]) + 1
            letter[after] = (raw[after] != 0x97) & (raw[after] != 0xB7)
        cut = np.zeros(len(raw) + 1, bool)
        cut[: len(raw) - 1] = white[:-1] & ~white[1:]
        cut[1 : len(raw)] |= letter[:-1] & _PUNCTUATION[raw[1:]]
        last = at[1:][at[1:] > at[:-1]] - 1
        cut[last] &= ~white[last]  # white space at a row's end: what follows is another row
        cut[at] = True
        return np.flatnonzero(cut[: len(raw)])

    def fresh(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the given pieces, and each piece's number of ids."""
        data = raw.tobytes()
        texts = [data[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        # Plain pieces keep their length in bytes, so that many can be encoded as one string and told apart after.
        high = raw >= 0x80
        odd = high.copy()
        odd[1:] &= ~((raw[:-1] == 0xC3) & high[1:])
        odd &= raw != 0xC3
        odd |= raw == 0x27
        seen = np.concatenate([[0], np.cumsum(odd)])
        begins = K._IS_WHITE[raw[start]]
        plain = (seen[end] == seen[start]) & begins
        counts, lists = np.zeros(len(texts), np.int64), [None] * len(texts)
        together = np.flatnonzero(plain)
        if len(together):
            groups = [together[i : i + JOINED] for i in range(0, len(together), JOINED)]
            ids = self.encode([b"".join([texts[k] for k in g.tolist()]).decode() for g in groups])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            long = (end - start)[together]
            if self.drops_white:
                whites = np.concatenate([[0], np.cumsum(K._IS_WHITE[raw])])
                long = long - (whites[end] - whites[start])[together]
            bounds, reach = np.cumsum(long), np.concatenate([[0], np.cumsum(self.width[flat])])
            place = np.searchsorted(reach, bounds)
            if not len(reach) or reach[-1] != bounds[-1] or (reach[place] != bounds).any():
                plain[:] = False  # a token over a bound: encode each piece by itself
            else:
                counts[together] = np.diff(place, prepend=0)
        alone = np.flatnonzero(~plain)
        if not len(alone):
            return flat, counts
        ids = self.encode([texts[k].decode() for k in alone.tolist()])
        counts[alone] = np.fromiter(map(len, ids), np.int64, len(ids))
        rest = np.fromiter((i for x in ids for i in x), np.uint32, int(counts[alone].sum()))
        out = np.zeros(int(counts.sum()), np.uint32)
        own = np.repeat(plain, counts)
        if own.any():
            out[own] = flat
        out[~own] = rest
        return out, counts

    def rows(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the rows, and each row's number of ids."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts, hashes, row = [], [], 0
        while row < len(at) - 1:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + PART_BYTES, side="right")) - 1)
            part, own = raw[at[row] : at[stop]], at[row : stop + 1] - at[row]
            if len(part):
                s = self.pieces(part, own)
                starts.append(s + at[row])
                hashes.append(names(part, s, np.append(s[1:], len(part))))
            row = stop
        start, hashed = np.concatenate(starts), np.concatenate(hashes)
        end = np.append(start[1:], len(raw))
        code, distinct = pd.factorize(hashed)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if len(self.known) > REMEMBERED:
            self.forget()
        place = self.known.get_indexer(distinct)
        new = np.flatnonzero(place < 0)
        if len(new):
            flat, counts = self.fresh(raw, start[first[new]], end[first[new]])
            place[new] = len(self.known) + np.arange(len(new))
            self.known = self.known.append(pd.Index(distinct[new]))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat])
            s, size = start[first[new]], (end - start)[first[new]]
            upto = np.cumsum(size) - size
            self.bytes = np.concatenate([self.bytes, raw[np.arange(size.sum()) + np.repeat(s - upto, size)]])
            self.bytes_at = np.concatenate([self.bytes_at, self.bytes_at[-1] + np.cumsum(size)])
        where, known, at_ = place[code], self.flat, self.at
        if (odd := self.differing(raw, start, end, where)).any():  # another piece with the same hash
            flat, counts = self.fresh(raw, start[odd], end[odd])
            where[odd] = len(at_) - 1 + np.arange(len(counts))
            known, at_ = np.concatenate([known, flat]), np.concatenate([at_, at_[-1] + np.cumsum(counts)])
        length = np.diff(at_)[where]
        upto = np.concatenate([[0], np.cumsum(length)])
        out = np.arange(upto[-1]) + np.repeat(at_[where] - upto[:-1], length)
        return known[out], np.diff(upto[np.searchsorted(start, at)])


def encoded(column: pa.Array | pa.ChunkedArray, path: str, end_id: int | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, flat ids, n + 1 offsets) of runs of rows, each row with its end id."""
    own = encoder(path)
    for first, end, raw, at in K.blocks(column, BLOCK_BYTES):
        ids, n = own.rows(raw, at)
        offsets = np.zeros(len(n) + 1, np.int64)
        if end_id is None:
            np.cumsum(n, out=offsets[1:])
            yield first, end, ids, offsets
            continue
        np.cumsum(n + 1, out=offsets[1:])
        out = np.full(int(offsets[-1]), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = ids
        yield first, end, out, offsets
