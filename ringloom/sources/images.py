"""Image records: LF2 and PDT files to rows and back, and the byte layouts of the output formats."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from ringloom.sources import batch
from ringloom.sources.lzss import Token, frame

LF2_MAGIC, PDT_MAGIC = b"LEAF256\0", b"PDT10\0\0\0"
LF2_HEADER = 0x18


@dataclass
class Image:
    """Pixels are palette indices (LF2), or RGB triples with an alpha mask (PDT); rows run from the top."""

    format: str
    width: int
    height: int
    pixels: bytes
    palette: list[tuple[int, int, int]] = field(default_factory=list)
    transparent: int = 0
    x_offset: int = 0
    y_offset: int = 0
    alpha: bytes = b""

    @property
    def indexed(self) -> bool:
        return self.format != "pdt"


def flip(rows: bytes, width: int) -> bytes:
    """Rows in reverse order; the file's first row is the image's last."""
    return np.frombuffer(rows, np.uint8)[len(rows) % width :].reshape(-1, width)[::-1].tobytes() if width else b""


@lru_cache(256)
def _palette(stored: bytes) -> tuple[tuple[int, int, int], ...]:
    return tuple((stored[i + 2], stored[i + 1], stored[i]) for i in range(0, len(stored), 3))  # the file has B, G, R


def lf2_header(data: bytes) -> dict:
    if len(data) < LF2_HEADER:
        raise ValueError("LF2 file too small")
    if data[:8] != LF2_MAGIC:
        raise ValueError("invalid LF2 magic")
    x, y, w, h = struct.unpack_from("<4H", data, 8)
    n = data[0x16]
    start = LF2_HEADER + 3 * n
    if len(data) < start:
        raise ValueError("LF2 palette cut off")
    palette = list(_palette(data[LF2_HEADER:start]))
    return {"x_offset": x, "y_offset": y, "width": w, "height": h, "transparent": data[0x12], "palette": palette, "payload_start": start}


def read_lf2(data: bytes) -> Image:
    """A payload that ends early leaves the rest zero."""
    (out,) = read_all([data], ["LF2"])
    if isinstance(out, Exception):
        raise out
    return out


def lf2_head(image: Image) -> bytes:
    """All before the payload."""
    if len(image.palette) > 255:
        raise ValueError("LF2 holds 255 colours at most")
    head = LF2_MAGIC + struct.pack("<4H", image.x_offset, image.y_offset, image.width, image.height)
    head = head + bytes([0, 0, image.transparent, 0, 0, 0, len(image.palette), 0])
    return head + b"".join(bytes([b, g, r]) for r, g, b in image.palette)


def write_lf2(image: Image, tokens: list[Token]) -> bytes:
    return lf2_head(image) + frame(tokens)


def pdt_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and where the mask begins."""
    if len(data) < 32:
        raise ValueError("PDT file too small")
    if data[:8] != PDT_MAGIC:
        raise ValueError("invalid PDT magic")
    return *struct.unpack_from("<2I", data, 12), struct.unpack_from("<I", data, 28)[0]


def read_pdt(data: bytes) -> Image:
    """RGB pixels that are cut off stay black; an alpha stream that is cut off stays short, and counts as opaque beyond."""
    (out,) = read_all([data], ["PDT"])
    if isinstance(out, Exception):
        raise out
    return out


def read_all(contents: list[bytes], kinds: list[str]) -> list[Image | Exception]:
    """The images of many files, whose streams are decoded together; in place of a file that can't be read, why."""
    out: list = [None] * len(contents)
    lf2, colours, masks, heads = [], [], [], {}
    for i, (data, kind) in enumerate(zip(contents, kinds, strict=True)):
        try:
            if kind == "PDT":
                w, h, mask = heads[i] = pdt_header(data)
                colours.append((i, data[32:], w * h))
                if 0 < mask < len(data):
                    masks.append((i, data[mask:], w * h))
            elif kind in ("LF2", "SCN"):
                h = heads[i] = lf2_header(data)
                lf2.append((i, data[h["payload_start"] :], h["width"] * h["height"]))
            else:
                raise ValueError(f"unsupported format {kind}")
        except ValueError as e:
            out[i] = e

    def decoded(streams: list, how: Callable) -> dict[int, bytes]:
        if not streams:
            return {}
        payload = np.frombuffer(b"".join(p for _, p, _ in streams), np.uint8)
        raw, at = how(payload, batch.bounds_of(np.array([len(p) for _, p, _ in streams])), np.array([n for _, _, n in streams], np.int64))
        return {i: raw[s:e].tobytes() for (i, _, _), s, e in zip(streams, at[:-1].tolist(), at[1:].tolist(), strict=True)}

    for i, raw in decoded(lf2, lambda p, b, n: batch.expand(batch.read(p, b, n), n)).items():
        h = {k: v for k, v in heads[i].items() if k != "payload_start"}
        out[i] = Image("lf2", pixels=flip(raw.ljust(h["width"] * h["height"], b"\0"), h["width"]), **h)
    alpha = decoded(masks, lambda p, b, n: batch.inflate_units(p, b, n, 1, 0xFF, 2, 8))
    for i, raw in decoded(colours, lambda p, b, n: batch.inflate_units(p, b, n, 3, 15, 1, 4)).items():
        w, h, _ = heads[i]
        out[i] = Image("pdt", w, h, reversed_units(raw).ljust(3 * w * h, b"\0"), alpha=alpha[i] if i in alpha else b"\xff" * (w * h))
    return out


def reversed_units(data: bytes) -> bytes:
    """RGB to BGR and back."""
    return np.frombuffer(data, np.uint8).reshape(-1, 3)[:, ::-1].tobytes()


def write_pdt(image: Image) -> bytes:
    """Literals only, as the format allows; the mask stream is left out where there is no mask."""

    def literals(data: bytes, unit: int) -> bytes:
        raw, step = np.frombuffer(data, np.uint8), 8 * unit
        whole = len(raw) - len(raw) % step
        groups = np.empty((whole // step, step + 1), np.uint8)
        groups[:, 0], groups[:, 1:] = 0xFF, raw[:whole].reshape(-1, step)
        return groups.tobytes() + (b"\xff" + data[whole:] if whole < len(raw) else b"")

    n = image.width * image.height
    stored = reversed_units(image.pixels[: 3 * n])
    colours, mask = literals(stored, 3), literals(image.alpha, 1)
    at = 32 + len(colours) if mask else 0
    return PDT_MAGIC + struct.pack("<3I", 32 + len(colours) + len(mask), image.width, image.height) + bytes(8) + struct.pack("<I", at) + colours + mask


def colours_of(rgb: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct colours in order of appearance, a row each, and every pixel's number among them."""
    x = np.frombuffer(rgb, np.uint8)[: len(rgb) - len(rgb) % 3].reshape(-1, 3)
    codes = x[:, 0].astype(np.int32) << 16 | x[:, 1].astype(np.int32) << 8 | x[:, 2]
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return x[first[order]], number[which]


def quantise(rgb: bytes, most: int) -> tuple[list[tuple[int, int, int]], bytes]:
    """Palette of the first ``most`` distinct colours, in order of appearance; any other pixel takes the nearest (the first on a tie)."""
    colours, which = colours_of(rgb)
    index, palette = np.arange(len(colours)), colours[:most].astype(np.int64)
    for at in range(most, len(colours), 1024):
        gap = colours[at : at + 1024, None].astype(np.int64) - palette
        index[at : at + 1024] = (gap * gap).sum(2).argmin(1)
    return [tuple(c) for c in palette.tolist()], index[which].astype(np.uint8).tobytes()


@lru_cache(256)
def _rgba_table(palette: tuple[tuple[int, int, int], ...], transparent: int) -> np.ndarray:
    n = len(palette)
    return np.array([[*(palette[i] if i < n else (0, 0, 0)), 0 if i == transparent or i >= n else 255] for i in range(256)], np.uint8)


def rgba(image: Image) -> bytes:
    """A palette pixel is clear if its index is the transparent one or has no colour."""
    if image.indexed:
        return _rgba_table(tuple(map(tuple, image.palette)), image.transparent)[np.frombuffer(image.pixels, np.uint8)].tobytes()
    n = len(image.pixels) // 3
    out = np.empty((n, 4), np.uint8)
    out[:, :3] = np.frombuffer(image.pixels, np.uint8)[: 3 * n].reshape(-1, 3)
    out[:, 3] = np.frombuffer(image.alpha[:n].ljust(n, b"\xff"), np.uint8)
    return out.tobytes()


def rgb(image: Image) -> bytes:
    """Without alpha; clear palette pixels are black."""
    if not image.indexed:
        return image.pixels
    full = np.frombuffer(rgba(image), np.uint8).reshape(-1, 4)
    return np.where(full[:, 3:] != 0, full[:, :3], 0).astype(np.uint8).tobytes()


def _bmp(width: int, height: int, bits: int, palette: bytes, rows: list[bytes]) -> bytes:
    body = b"".join(r + b"\0" * (-len(r) % 4) for r in reversed(rows))
    offset = 54 + len(palette)
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", offset + len(body), 0, offset, 40, width, height, 1, bits, 0, len(body), 2835, 2835, len(palette) // 4, 0)
    return head + palette + body


def bmp(image: Image) -> bytes:
    """Eight bits with a palette of 256 at least, or 32 bits with alpha; rows from the bottom, padded to four bytes."""
    w = image.width
    if image.indexed:
        colours = [*image.palette, *[(0, 0, 0)] * (256 - len(image.palette))]
        rows = [image.pixels[i : i + w] for i in range(0, w * image.height, w)]
        return _bmp(w, image.height, 8, b"".join(bytes([b, g, r, 0]) for r, g, b in colours), rows)
    full = rgba(image)
    bgra = np.frombuffer(full, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()
    return _bmp(w, image.height, 32, b"", [bgra[i : i + 4 * w] for i in range(0, 4 * w * image.height, 4 * w)])


def png(image: Image) -> bytes:
    full, w = rgba(image), image.width
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((len(full) // (4 * w) if w else 0, 4 * w + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(full, np.uint8).reshape(rows.shape[0], 4 * w)
    lines = rows.tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, image.height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA bytes of a PNG as ``png`` writes it; a wrong checksum is an error."""
    at, body, size = 8, b"", (0, 0)
    while at < len(data):
        n, kind = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"{kind!r}: wrong checksum")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", part)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    lines, step = zlib.decompress(body), 4 * size[0] + 1
    return *size, np.frombuffer(lines, np.uint8).reshape(-1, step)[:, 1:].tobytes()


SINKS = {"bmp": bmp, "png": png, "raw": rgb, "rgb": rgb, "rgba": rgba}


def encode_as(image: Image, kind: str) -> bytes:
    """Output bytes by the sink's extension; an unknown one means BMP."""
    return SINKS.get(kind.lower(), bmp)(image)
