"""Small image codecs in NumPy, and sizes from file heads: BMP and PNG in full, JPEG and WebP heads."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bit, bottom up."""
    h, w = image.shape[:2]
    pad = -w * 3 % 4
    rows = b"".join(image[y, :, ::-1].tobytes() + bytes(pad) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def decode_bmp(data: bytes) -> np.ndarray:
    """8 (palette, plain or run-length), 24 and 32 bit."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    offset, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    up, h = h > 0, abs(h)
    if w <= 0 or h == 0:
        raise ValueError("a BMP without pixels")
    if depth == 8:
        colors = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colors * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = _runs(data[offset:], w, h) if packing == 1 else np.frombuffer(data, np.uint8, (w + -w % 4) * h, offset).reshape(h, -1)[:, :w]
        image = palette[index]
    elif depth in (24, 32) and packing in (0, 3):
        size = depth // 8
        stride = w * size + -(w * size) % 4
        if len(data) < offset + stride * h:
            raise ValueError("a BMP cut short")
        image = np.frombuffer(data, np.uint8, stride * h, offset).reshape(h, stride)[:, : w * size].reshape(h, w, size)[..., 2::-1]
    else:
        raise ValueError(f"a BMP of {depth} bits, packing {packing}")
    return np.ascontiguousarray(image[::-1] if up else image)


def _runs(data: bytes, w: int, h: int) -> np.ndarray:
    out, x, y, i = np.zeros((h, w), np.uint8), 0, 0, 0
    while i + 1 < len(data) and y < h:
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            out[y, x : x + n] = v
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y, i = x + data[i], y + data[i + 1], i + 2
        else:
            out[y, x : x + v] = np.frombuffer(data, np.uint8, v, i)[: max(0, w - x)]
            x, i = x + v, i + v + v % 2
    return out


def encode_png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """8 bit grey, RGB, RGBA and palette, not interlaced; alpha is left out."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("a PNG of another kind")
    w, h, size = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * size)
    out = np.zeros((h, w * size), np.uint8)
    for y in range(h):
        out[y] = _unfiltered(int(raw[y, 0]), raw[y, 1:], out[y - 1] if y else np.zeros(w * size, np.uint8), size)
    out = out.reshape(h, w, size)
    if head[3] == 3:
        return palette[out[..., 0]]
    return np.ascontiguousarray(out[..., :3] if size >= 3 else out[..., :1].repeat(3, -1))


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, size: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    out = row.astype(int)
    up = above.astype(int)
    for i in range(len(out)):
        left, corner = (out[i - size], up[i - size]) if i >= size else (0, 0)
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min(((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner)))[2]
        out[i] = out[i] + guess & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """By magic bytes; raises where it has no codec."""
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    raise ValueError("no codec for this image")


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the head alone, for BMP, PNG, JPEG, WebP and TIFF; None if it is none of these."""
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        return w, abs(h)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:3] == b"\xff\xd8\xff":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None
            kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack_from(">HH", data, at + 5)
                return w, h
            at += 2 + n
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            w, h = struct.unpack_from("<HH", data, 26)
            return w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*") and len(data) >= 8:
        end = "<" if data[:2] == b"II" else ">"
        at, found = struct.unpack_from(f"{end}I", data, 4)[0], {}
        if at + 2 <= len(data):
            for k in range(struct.unpack_from(f"{end}H", data, at)[0]):
                if at + 14 + 12 * k > len(data):
                    break
                tag, kind = struct.unpack_from(f"{end}HH", data, at + 2 + 12 * k)
                if tag in (256, 257):
                    found[tag] = struct.unpack_from(f"{end}{'H' if kind == 3 else 'I'}", data, at + 10 + 12 * k)[0]
        return (found[256], found[257]) if len(found) == 2 else None
    return None
