"""Vectorised word work on UTF-8 bytes: hashes of byte spans, and the pre-tokens of the word-end BPE vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

from cinelake.llm.common import mix

_SEED = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)

#: The pre-token pattern, white space and special tokens of the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; one table per process, which grows with the longest batch."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _TABLES.clear()
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _TABLES.append(np.multiply.accumulate(out, out=out))
    return _TABLES[0], _TABLES[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' values times the powers of the base, up to each place: differences hash spans."""
    up, _ = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(_BYTE, data, out=sums[1:])
    sums[1:] *= up[: len(data)]
    return np.cumsum(sums, out=sums)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the bytes, from prefix sums (made here if not given) of a polynomial hash."""
    _, down = _powers(len(data) + 1)
    sums = prefix_sums(data) if sums is None else sums
    size = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + size * np.uint64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all grams of ``size`` bytes, one per start. Their upper bits are mixed well, the lower ones less."""
    _, down = _powers(len(data) + 1)
    sums = prefix_sums(data) if sums is None else sums
    out = sums[size:] - sums[:-size]
    out *= down[: len(out)]
    return out


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point below U+0250: 0 white space, 1 letter, 2 digit or number, 3 anything else."""
    out = np.full(0x250, 3, np.uint8)
    for c in range(0x250):
        x = chr(c)
        if regex.match(r"\p{White_Space}", x):
            out[c] = 0
        elif regex.match(r"\p{L}", x):
            out[c] = 1
        elif regex.match(r"\p{N}", x):
            out[c] = 2
    return out


_SPLIT_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")


class Pretokens:
    """Pre-tokens of a batch of texts: spans of ``data`` with the text each belongs to. special: 0, or 1 + its index."""

    def __init__(self, texts: list[str], cut, special: bool = True, contractions: bool = True):
        """cut: the pre-tokens of a text that the byte tables don't cover, in order. special: whether the strings of the special
        tokens are tokens of their own. contractions: whether the byte tables keep an apostrophe with s, t, re, ve, m, ll, d."""
        parts: list[tuple[int, bytes, list | None]] = []
        for k, text in enumerate(texts):
            pieces = _SPLIT_SPECIAL.split(text) if special and "<|" in text else [text]
            for piece in pieces:
                if special and piece in SPECIAL:
                    parts.append((k, b"", [SPECIAL.index(piece)]))
                    continue
                low = piece.lower()
                raw = low.encode("utf-8", "surrogatepass")
                if low.isascii() or max(low) < "ɐ":
                    parts.append((k, raw, None))
                else:
                    found = cut(piece)
                    parts.append((k, "".join(found).encode("utf-8"), [len(x.encode("utf-8")) for x in found]))
        starts, ends, owner, special = [], [], [], []
        plain = [(k, raw) for k, raw, how in parts if how is None]
        self.data = np.frombuffer(b" ".join([r for _, r in plain] + [b""]), np.uint8) if plain else np.zeros(0, np.uint8)
        s, e = _scan(self.data, contractions)
        edges = np.cumsum([len(r) + 1 for _, r in plain]) if plain else np.zeros(0, np.int64)
        own = np.array([k for k, _ in plain], np.int64)[np.searchsorted(edges, s, side="right")] if plain else np.zeros(0, np.int64)
        starts.append(s), ends.append(e), owner.append(own), special.append(np.zeros(len(s), np.int64))
        if len(plain) < len(parts):
            # rank by part, so that the order within a text holds
            rank = [np.array([i for i, p in enumerate(parts) if p[2] is None], np.int64)[np.searchsorted(edges, s, side="right")]] if plain else [np.zeros(0, np.int64)]
            extra, at = [], len(self.data)
            for i, (k, raw, how) in enumerate(parts):
                if how is None:
                    continue
                if raw == b"" and len(how) == 1 and how[0] in (0, 1):
                    starts.append(np.array([at])), ends.append(np.array([at])), owner.append(np.array([k])), special.append(np.array([how[0] + 1]))
                    rank.append(np.array([i]))
                    continue
                stop = at + np.cumsum(np.array(how, np.int64))
                starts.append(stop - np.array(how, np.int64)), ends.append(stop), owner.append(np.full(len(how), k)), special.append(np.zeros(len(how), np.int64))
                rank.append(np.full(len(how), i))
                extra.append(raw)
                at += len(raw)
            self.data = np.concatenate([self.data, np.frombuffer(b"".join(extra), np.uint8)])
            order = np.argsort(np.concatenate(rank), kind="stable")
        else:
            order = slice(None)
        self.starts, self.ends, self.owner, self.special = (np.concatenate(x)[order] for x in (starts, ends, owner, special))


def _scan(data: np.ndarray, contractions: bool) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pre-tokens of lower-case UTF-8 bytes with code points below U+0250."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data.astype(np.int16)
    cls = _classes()
    follow = (data & 0xC0) == 0x80
    if follow.any():
        at = np.flatnonzero(follow)
        code[at - 1] = ((code[at - 1] & 0x1F) << 6) | (code[at] & 0x3F)
    kind = cls[code]
    if follow.any():
        kind[at] = kind[at - 1]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first &= ~follow
    quote = np.flatnonzero((data == 39) & first & (kind == 3) & contractions)
    if len(quote):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        hit = quote[one | two]
        size = np.where(one, 2, 3)[one | two]
        first[hit + 1] = False
        after = hit + size
        after = after[after < len(data)]
        first[after[kind[after] != 0]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    return starts[keep], ends[keep]
