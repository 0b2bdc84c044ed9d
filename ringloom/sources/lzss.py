"""Sequential kernels of the LZSS payloads: bits to tokens, tokens to bytes, tokens to bits.

A ring of 4096 slots whose head moves with every byte is the same as a history that only grows: a slot that lies ``d`` behind the head
(1..4096) is the byte ``d`` from the end. So the kernels keep one bytearray that starts with a whole ring of the fill byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

RING, START, FILL, SHORTEST, LONGEST = 4096, 0x0FEE, 0x20, 3, 18


class Token(NamedTuple):
    """A literal byte (pos 0, len 1) or a match of ring position and nominal length."""

    is_match: bool
    lit: int
    pos: int
    len: int


def literal(byte: int) -> Token:
    return Token(False, byte, 0, 1)


def match(pos: int, length: int) -> Token:
    return Token(True, 0, pos, length)


class Truncated(ValueError):
    pass


def read_tokens(payload: bytes, total: int, strict: bool = False) -> Iterator[Token]:
    """Tokens of an inverted, most-significant-bit-first payload until ``total`` bytes are told. A payload that ends early is an error if
    ``strict``, and the end otherwise."""
    data, at, told = bytes(b ^ 0xFF for b in payload), 0, 0
    while told < total:
        if at >= len(data):
            if strict:
                raise Truncated(f"flag byte missing at {at}")
            return
        flags, at = data[at], at + 1
        for bit in range(7, -1, -1):
            if told >= total:
                return
            if flags >> bit & 1:
                if at >= len(data):
                    break
                yield literal(data[at])
                at, told = at + 1, told + 1
            else:
                if at + 1 >= len(data):
                    at = len(data)
                    break
                a, b = data[at], data[at + 1]
                token = match(a >> 4 | b << 4, (a & 15) + SHORTEST)
                yield token
                at, told = at + 2, told + token.len
        else:
            continue
        if strict:
            raise Truncated(f"token cut off at {at}")
        return


def expand(tokens: Iterable[Token], total: int | None = None, fill: int = FILL) -> bytes:
    """The bytes that tokens stand for, ``total`` at most."""
    history = bytearray([fill]) * RING
    for t in tokens:
        done = len(history) - RING
        if not t.is_match:
            history.append(t.lit)
        else:
            back = (START + done - t.pos) % RING or RING
            n = t.len if total is None else min(t.len, total - done)
            at = len(history) - back
            for i in range(n):
                history.append(history[at + i])
        if total is not None and len(history) - RING >= total:
            break
    return bytes(history[RING:])


def frame(tokens: Iterable[Token]) -> bytes:
    """Tokens in groups of eight behind a flag byte, all inverted."""
    out, group, flags, n = bytearray(), bytearray(), 0, 0
    for t in tokens:
        if t.is_match:
            group += bytes([(t.len - SHORTEST) & 15 | (t.pos & 15) << 4, t.pos >> 4 & 0xFF])
        else:
            flags |= 0x80 >> n
            group.append(t.lit)
        n += 1
        if n == 8:
            out += bytes([flags]) + group
            group, flags, n = bytearray(), 0, 0
    if n:
        out += bytes([flags]) + group
    return bytes(b ^ 0xFF for b in out)


def inflate_units(data: bytes, total: int, unit: int, length_mask: int, shortest: int, shift: int) -> bytes:
    """The other family: nothing inverted, literals of ``unit`` bytes, a little-endian word of length and distance behind the head, a ring of zeros.
    Ends where the data end."""
    history = bytearray(RING * unit)
    at = 0
    while len(history) < (RING + total) * unit and at < len(data):
        flags, at = data[at], at + 1
        for bit in range(7, -1, -1):
            room = total - (len(history) // unit - RING)
            if room <= 0:
                break
            if flags >> bit & 1:
                if at + unit > len(data):
                    return bytes(history[RING * unit :])
                history += data[at : at + unit]
                at += unit
            else:
                if at + 2 > len(data):
                    return bytes(history[RING * unit :])
                word, at = data[at] | data[at + 1] << 8, at + 2
                back = (word >> shift & 0xFFF) + 1
                for _ in range(min(room, (word & length_mask) + shortest)):
                    end = len(history)
                    history += history[end - back * unit : end - back * unit + unit]
    return bytes(history[RING * unit :])
