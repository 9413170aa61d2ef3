"""Randomness that depends on row identity only, never on partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelab.functions.numeric import col

TWO_32 = 4294967296.0
TWO_53 = 9007199254740992.0


def uniform(seed: int | str, *keys: Column | str, method: str = "md5") -> Column:
    """A uniform number in [0, 1) for (seed, keys).

    ``md5`` can be repeated by any SQL engine; ``xxhash64`` is several times
    cheaper and the one to use on large inputs. ``counter`` hashes all keys but
    the last once and mixes the last, a whole number, into that: the one to use
    for many numbers a row, and SQL can repeat it too.
    """
    parts = [F.lit(str(seed)), *[col(k).cast("string") for k in keys]]
    if method == "md5":
        digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
        return F.conv(digits, 16, 10).cast("double") / F.lit(TWO_32)
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(TWO_53)
    if method == "counter":
        first, second = stream_key(seed, *keys[:-1])
        return counter_bits(first, second, col(keys[-1]).cast("long")).cast("double") / F.lit(TWO_32)
    raise ValueError(f"unknown hash method {method!r}")


# The increment of the counter, and shifts and factors of a public 32-bit mixing function
STEP_32, MIX_32 = 0x9E3779B9, ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))


def stream_key(seed: int | str, *keys: Column | str) -> tuple[Column, Column]:
    """Two 32-bit numbers (as long) that name the stream of (seed, keys)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _times_32(x: Column, factor: int) -> Column:
    """The low 32 bits of a product, in 16-bit limbs so that no product passes 63 bits."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return (low * factor + (high * factor).bitwiseAND(F.lit(0xFFFF)) * 65536).bitwiseAND(F.lit(0xFFFFFFFF))


def _mixed_32(x: Column) -> Column:
    for shift, factor in MIX_32:
        x = x.bitwiseXOR(F.shiftright(x, shift))
        x = x if factor == 1 else _times_32(x, factor)
    return x


def counter_bits(first: Column, second: Column, at: Column) -> Column:
    """Number ``at`` of a stream: 32 bits, as long."""
    start = (first + (at * STEP_32).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))
    return _mixed_32(_mixed_32(start).bitwiseXOR(second))


def counter_block(first: np.ndarray, second: np.ndarray, start: int, end: int) -> np.ndarray:
    """Numbers ``start`` to ``end`` (inclusive) of many streams at once: a uint32 matrix of streams x numbers."""
    steps = (np.arange(start, end + 1, dtype=np.uint64) * np.uint64(STEP_32)).astype(np.uint32)
    x = first.astype(np.uint32)[:, None] + steps
    for turn in range(2):
        if turn:
            x ^= second.astype(np.uint32)[:, None]
        for shift, factor in MIX_32:
            x ^= x >> np.uint32(shift)
            if factor != 1:
                x *= np.uint32(factor)
    return x


# Constants of MD5
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * TWO_32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_first(words: Sequence[np.ndarray | int], n: int) -> np.ndarray:
    """The first word of the MD5 state of ``n`` messages of one block; ``words`` are its 16 little-endian words.

    That word stands after 61 of the 64 steps.
    """
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f = np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            place = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            place = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            place = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            place = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[place]
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[i])
        a += f
        shift = _SHIFTS[i // 16][i % 4]
        np.right_shift(a, np.uint32(32 - shift), out=f)
        a <<= np.uint32(shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])


def md5_uniforms(heads: Sequence[bytes], tails: Sequence[bytes], wanted: np.ndarray | None = None, block: int = 8192) -> np.ndarray:
    """``uniform`` by MD5 of every head + tail, a matrix of heads x tails; 0 where ``wanted`` is false.

    Messages of one MD5 block (55 bytes) are hashed ``block`` at a time, longer ones one by one.
    """
    out = np.zeros((len(heads), len(tails)))
    sizes = [np.array([len(x) for x in part], np.int64) for part in (heads, tails)]
    for long in np.unique(sizes[0]):
        mine = np.flatnonzero(sizes[0] == long)
        head = np.frombuffer(b"".join(heads[i] for i in mine), np.uint8).reshape(len(mine), long)
        for short in np.unique(sizes[1]):
            own = np.flatnonzero(sizes[1] == short)
            tail = np.frombuffer(b"".join(tails[i] for i in own), np.uint8).reshape(len(own), short)
            asked = np.ones((len(mine), len(own)), bool) if wanted is None else wanted[np.ix_(mine, own)]
            row, place = np.nonzero(asked)
            size = int(long + short)
            found = np.empty(len(row))
            if size > 55:
                found[:] = [int.from_bytes(hashlib.md5(heads[mine[i]] + tails[own[j]]).digest()[:4], "big") for i, j in zip(row, place)]
            for at in range(0, len(row) if size <= 55 else 0, block):
                r, p = row[at : at + block], place[at : at + block]
                text = np.zeros((len(r), 64), np.uint8)
                text[:, :long], text[:, long:size], text[:, size] = head[r], tail[p], 0x80
                used = size // 4 + 1
                words = [*np.ascontiguousarray(text.view("<u4").T[:used]), *[0] * (16 - used)]
                words[14] = 8 * size
                found[at : at + block] = _md5_first(words, len(r)).byteswap()
            out[mine[row], own[place]] = found / TWO_32
    return out


def standard_normal(seed: int | str, *keys: Column | str, method: str = "md5") -> Column:
    """Box-Muller on two hashed uniforms; u1 is moved off zero."""
    u1 = 1.0 - uniform(f"{seed}a", *keys, method=method)
    u2 = uniform(f"{seed}b", *keys, method=method)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def poisson_steps(bits: int = 53) -> list[float]:
    """Values of the Poisson(1) distribution function that a uniform of ``bits`` bits can reach."""
    mass = total = 2.718281828459045 ** -1
    steps, k = [], 0
    while total <= 1.0 - 2.0**-bits:
        steps.append(total)
        k += 1
        mass /= k
        total += mass
    return steps


def poisson_one(u: Column, bits: int = 53) -> Column:
    """Poisson(1) draw by inverting its distribution function at ``u``."""
    out = F.lit(0)
    for step in poisson_steps(bits):
        out = out + F.when(u >= F.lit(step), 1).otherwise(0)
    return out


def poisson_block(bits: np.ndarray) -> np.ndarray:
    """Poisson(1) draws of a matrix of 32-bit numbers."""
    out = np.zeros(bits.shape, np.uint8)
    for step in poisson_steps(32):
        out += bits >= np.uint32(np.ceil(step * TWO_32))
    return out


def row_fingerprint(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in columns])
