"""PNG and APNG bytes: splitting into chunks, and packing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Keyword of the text chunk that names what an APNG hides; a parameter everywhere.
MARKER = "disguise"
PIECE = 65_536


def chunks(raw: bytes | None, strict: bool = False) -> Iterator[tuple[int, str, int, bytes, int]]:
    """(number, type, end offset, payload, stored CRC) up to IEND; nothing for other files.

    A chunk that runs past the end of the file is cut off there, or with `strict` refuses the file.
    """
    if not raw or raw[:8] != SIGNATURE:
        return
    found, at, n = [], 8, 0
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        end = at + 8 + size
        if strict and end + 4 > len(raw):
            return
        crc = struct.unpack_from(">I", raw, end)[0] if end + 4 <= len(raw) else -1
        found.append((n, kind.decode("latin-1"), min(end + 4, len(raw)), raw[at + 8 : end], crc))
        at, n = end + 4, n + 1
        if kind == b"IEND":
            break
    yield from found


def pack(kind: str | bytes, payload: bytes) -> bytes:
    kind = kind.encode("latin-1") if isinstance(kind, str) else kind
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


def assemble(parts: Iterable[tuple[str, bytes]]) -> bytes:
    """A file of the given chunks, in order."""
    return SIGNATURE + b"".join(pack(k, p) for k, p in parts)


def header(w: int, h: int, like: bytes | None = None) -> bytes:
    """An IHDR payload; `like` gives depth, colour type and the rest."""
    return struct.pack(">II", w, h) + (like[8:13] if like else b"\x08\x06\x00\x00\x00")


def frame_to_png(ihdr: bytes, pieces: list[bytes], w: int = 0, h: int = 0) -> bytes:
    """A standalone picture of a frame: its own size where both sides are known, one IDAT for each piece."""
    head = header(w, h, ihdr) if w > 0 and h > 0 else ihdr
    return assemble([("IHDR", head), *(("IDAT", p) for p in pieces), ("IEND", b"")])


def encode(rgba: np.ndarray) -> bytes:
    """An RGBA picture, unfiltered rows, deflate level 6, IDAT pieces of 64 KiB."""
    h, w = rgba.shape[:2]
    rows = np.zeros((h, 1 + 4 * w), np.uint8)
    rows[:, 1:] = rgba.reshape(h, 4 * w)
    data = zlib.compress(rows.tobytes(), 6)
    return frame_to_png(header(w, h), [data[i : i + PIECE] for i in range(0, len(data), PIECE)])


def frame_control(seq: int, w: int, h: int, num: int, den: int, dispose: int = 0, blend: int = 0) -> bytes:
    return struct.pack(">IIIIIHHBB", seq, w, h, 0, 0, num, den, dispose, blend)


def size_of(png: bytes) -> tuple[int, int]:
    return next(struct.unpack(">II", p[:8]) for _, k, _, p, _ in chunks(png) if k == "IHDR")


def _data(png: bytes) -> list[bytes]:
    return [p for _, k, _, p, _ in chunks(png) if k == "IDAT"]


def compose(cover: bytes, frames: list[tuple[bytes, int]], kind: str, marker: str = MARKER) -> bytes:
    """An APNG that shows the cover and hides frames (png, delay in ms).

    STATIC holds one frame of 10/100 and a transparent 1x1 frame behind it; ANIMATED holds all, delays in
    hundredths, one at least.
    """
    ihdr = next(p for _, k, _, p, _ in chunks(cover) if k == "IHDR")
    static = kind == "STATIC"
    shown = [(size_of(f), _data(f), 10 if static else max(1, int(ms / 10 + 0.5)), 0) for f, ms in frames]
    if static:
        shown.append(((1, 1), [zlib.compress(b"\x00\x00\x00\x00\x00")], 10, 1))
    parts = [("IHDR", ihdr), ("acTL", struct.pack(">II", len(shown), 0)), ("tEXt", f"{marker}\0" f"1;{kind};{len(frames)}".encode("latin-1"))]
    parts += [("IDAT", p) for p in _data(cover)]
    seq = 0
    for (w, h), data, num, blend in shown:
        parts.append(("fcTL", frame_control(seq, w, h, num, 100, 0, blend)))
        seq += 1
        for p in data:
            parts.append(("fdAT", struct.pack(">I", seq) + p))
            seq += 1
    return assemble([*parts, ("IEND", b"")])
