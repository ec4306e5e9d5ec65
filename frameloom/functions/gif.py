"""GIF bytes: frames with delays, LZW indices, compositing by disposal."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Frame:
    delay_ms: int
    x: int
    y: int
    w: int
    h: int
    disposal: int
    interlace: bool
    transparent: int
    rgba: np.ndarray


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    """Joined sub-blocks from `at`, and where they end."""
    out = []
    while at < len(raw) and raw[at]:
        out.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(out), at + 1


def lzw(data: bytes, least: int, n: int) -> np.ndarray:
    """n colour indices; missing ones are 0."""
    clear, stop = 1 << least, (1 << least) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, last = list(base), least + 1, b""
    out, have, bits, count = [], 0, 0, 0
    for byte in data:
        bits |= byte << count
        count += 8
        while count >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            count -= width
            if code == stop:
                data = b""
                break
            if code == clear:
                table, width, last = list(base), least + 1, b""
                continue
            if code < len(table):
                entry = table[code]
            elif last and code == len(table):
                entry = last + last[:1]
            else:
                data = b""
                break
            out.append(entry)
            have += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
        if not data or have >= n:
            break
    got = np.frombuffer(b"".join(out)[:n], np.uint8)
    return np.concatenate([got, np.zeros(n - len(got), np.uint8)])


def _palette(raw: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 3 * (2 << (flags & 7))
    colours = np.zeros((256, 3), np.uint8)
    table = np.frombuffer(raw[at : at + size], np.uint8)
    colours[: len(table) // 3] = table[: len(table) // 3 * 3].reshape(-1, 3)
    return colours, at + size


def frames(raw: bytes | None) -> Iterator[Frame]:
    """Full pictures in order. Disposal 2 clears the previous frame's rectangle and 3 brings back what was before it."""
    if not raw or raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    common, at = _palette(raw, 13, flags) if flags & 0x80 else (np.zeros((256, 3), np.uint8), 13)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear, undo = 100, 0, -1, None
    while at < len(raw):
        if raw[at] == 0x21 and at + 1 < len(raw):
            if raw[at + 1] == 0xF9 and at + 8 <= len(raw):
                bits, hundredths, index = struct.unpack_from("<BHB", raw, at + 3)
                delay, disposal, clear = hundredths * 10 or 100, bits >> 2 & 7, index if bits & 1 else -1
            _, at = _blocks(raw, at + 2)
        elif raw[at] == 0x2C and at + 10 <= len(raw):
            x, y, w, h, bits = struct.unpack_from("<HHHHB", raw, at + 1)
            colours, at = _palette(raw, at + 10, bits) if bits & 0x80 else (common, at + 10)
            least = raw[at] if at < len(raw) else 2
            data, at = _blocks(raw, at + 1)
            index = lzw(data, min(max(least, 1), 8), w * h).reshape(h, w)
            if bits & 0x40:
                rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(index)
                straight[rows] = index
                index = straight
            if undo is not None:
                how, (ux, uy, uw, uh), before = undo
                if how == 2:
                    canvas[uy : uy + uh, ux : ux + uw] = 0
                elif how == 3:
                    canvas = before.copy()
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            index = index[: part.shape[0], : part.shape[1]]
            show = index != clear
            part[show, :3] = colours[index[show]]
            part[show, 3] = 255
            yield Frame(delay, x, y, w, h, disposal, bool(bits & 0x40), clear, canvas.copy())
            undo = (disposal, (x, y, w, h), before)
            delay, disposal, clear = 100, 0, -1
        else:
            break


def loops(raw: bytes | None) -> int:
    """How often the animation plays by its NETSCAPE extension, the last one of several; 0 for ever, or where none says."""
    if not raw or raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return 0
    table = lambda bits: 3 * (2 << (bits & 7)) if bits & 0x80 else 0
    at, found = 13 + table(raw[10]), 0
    while at + 1 < len(raw):
        if raw[at] == 0x21:
            if raw[at + 1] == 0xFF and raw[at + 3 : at + 14] == b"NETSCAPE2.0" and raw[at + 14 : at + 16] == b"\x03\x01" and at + 18 <= len(raw):
                found = struct.unpack_from("<H", raw, at + 16)[0]
            _, at = _blocks(raw, at + 2)
        elif raw[at] == 0x2C and at + 10 <= len(raw):
            _, at = _blocks(raw, at + 11 + table(raw[at + 9]))
        else:
            break
    return found


def encode(frames: list[tuple[int, int, int, int, int, int, bytes]], loops: int | None = None) -> bytes:
    """An animated GIF of 256 greys from (delay_ms, x, y, w, h, disposal, a byte for each pixel), which says how often it plays.

    Codes are 9 bits wide throughout: a clear code comes before the table would grow past that.
    """
    wide, high = max(x + w for _, x, _, w, _, _, _ in frames), max(y + h for _, _, y, _, h, _, _ in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for delay, x, y, w, h, disposal, grey in frames:
        codes = np.frombuffer(grey, np.uint8).astype(np.uint32)
        runs = -(-len(codes) // 250)
        codes = np.insert(codes, np.arange(runs) * 250, 256)
        bits = (np.append(codes, 257)[:, None] >> np.arange(9)) & 1
        raw = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        out += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2, delay // 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", x, y, w, h, 0), b"\x08"]
        out += [part for k in range(0, len(raw), 255) for part in (bytes([len(raw[k : k + 255])]), raw[k : k + 255])] + [b"\0"]
    return b"".join([*out, b"\x3b"])
