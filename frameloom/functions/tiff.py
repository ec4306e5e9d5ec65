"""EXIF: TIFF directories read and written, and the JPEG segments that hold them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Names of tags by directory (fixed values of the EXIF standard).
NAMES = {
    "ifd0": {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x8769: "ExifIFD", 0x8825: "GPSIFD"},
    "exif": {0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9204: "ExposureBiasValue", 0x920A: "FocalLength", 0x9286: "UserComment", 0xA405: "FocalLengthIn35mmFilm", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber"},
    "gps": {0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude", 0x0005: "GPSAltitudeRef", 0x0006: "GPSAltitude", 0x0007: "GPSTimeStamp", 0x001D: "GPSDateStamp"},
}
#: Bytes of a value by type code: BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SLONG, SRATIONAL.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
#: Numbers of a value beyond which it is left out.
MOST = 4

Tag = tuple[str, int, int, str, int, int, str | None, list[float] | None]


def _value(raw: bytes, at: int, kind: int, n: int, order: str) -> tuple[str | None, list[float] | None]:
    if kind == 2:
        return raw[at : at + n].split(b"\0")[0].decode("utf-8", "replace"), None
    if kind in (1, 7):
        return raw[at : at + n].hex() if kind == 7 else None, list(map(float, raw[at : at + n])) if kind == 1 and n <= MOST else None
    if n > MOST:
        return None, None
    if kind in (5, 10):
        flat = struct.unpack_from(order + ("I" if kind == 5 else "i") * 2 * n, raw, at)
        return None, [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2], strict=True)]
    return None, [float(v) for v in struct.unpack_from(order + {3: "H", 4: "I", 9: "i"}[kind] * n, raw, at)]


def tags(raw: bytes | None) -> Iterator[Tag]:
    """(ifd, order, tag, name, type, count, text, numbers) of a TIFF block; malformed entries are left out."""
    if not raw or raw[:2] not in (b"II", b"MM") or len(raw) < 8:
        return
    order = "<" if raw[:2] == b"II" else ">"
    todo, n = [("ifd0", struct.unpack_from(order + "I", raw, 4)[0])], 0
    seen = set()
    while todo:
        ifd, at = todo.pop(0)
        if at in seen or at + 2 > len(raw):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", raw, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(raw):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", raw, entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", raw, entry + 8)[0]
            if not size or place + size > len(raw):
                continue
            text, numbers = _value(raw, place, kind, count, order)
            if ifd == "ifd0" and tag in (0x8769, 0x8825):
                todo.append(("exif" if tag == 0x8769 else "gps", int(numbers[0])) if numbers else ("ifd0", at))
            elif text is not None or numbers is not None:
                yield ifd, n, tag, NAMES[ifd].get(tag, f"0x{tag:X}"), kind, count, text, numbers
                n += 1


def pack(fields: list[tuple[str, int, int, list | str | bytes]]) -> bytes:
    """A little-endian TIFF block of (ifd, tag, type, values); entries are sorted by tag."""
    groups = {ifd: sorted((t, k, v) for i, t, k, v in fields if i == ifd) for ifd in ("ifd0", "exif", "gps")}
    links = [(0x8769, "exif"), (0x8825, "gps")]
    groups["ifd0"] = sorted(groups["ifd0"] + [(t, 4, [0]) for t, ifd in links if groups[ifd]], key=lambda e: e[0])

    def body(kind: int, v) -> tuple[int, bytes]:
        if kind == 2:
            b = v.encode() + b"\0"
            return len(b), b
        if kind == 7:
            return len(v), bytes(v)
        if kind in (5, 10):
            flat = [x for pair in v for x in pair]
            return len(v), struct.pack("<" + ("I" if kind == 5 else "i") * len(flat), *flat)
        return len(v), struct.pack("<" + {1: "B", 3: "H", 4: "I", 9: "i"}[kind] * len(v), *v)

    at, places = 8, {}
    for ifd, entries in groups.items():
        if entries or ifd == "ifd0":
            places[ifd] = at
            at += 2 + 12 * len(entries) + 4
    heads, tail = [], b""
    for ifd in places:
        out = struct.pack("<H", len(groups[ifd]))
        for tag, kind, v in groups[ifd]:
            v = [places[dict(links)[tag]]] if ifd == "ifd0" and tag in dict(links) else v
            n, raw = body(kind, v)
            inline = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at + len(tail))
            tail += b"" if len(raw) <= 4 else raw + b"\0" * (len(raw) % 2)
            out += struct.pack("<HHI", tag, kind, n) + inline
        heads.append(out + b"\0\0\0\0")
    return b"II*\0\x08\0\0\0" + b"".join(heads) + tail


def jpeg_segments(raw: bytes | None) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, marker, offset, payload) of the segments before the picture data."""
    if not raw or raw[:2] != b"\xff\xd8":
        return
    at, n = 2, 0
    while at + 4 <= len(raw) and raw[at] == 0xFF and raw[at + 1] != 0xDA:
        size = struct.unpack_from(">H", raw, at + 2)[0]
        if size < 2:
            return
        yield n, raw[at + 1], at, raw[at + 4 : at + 2 + size]
        at, n = at + 2 + size, n + 1


def exif_block(raw: bytes | None, png_chunks: list[tuple[str, bytes]] | None = None) -> bytes | None:
    """The TIFF block of a JPEG (first APP1 that starts with Exif) or of PNG chunks (eXIf, with or without that prefix)."""
    for _, marker, _, p in jpeg_segments(raw):
        if marker == 0xE1 and p[:4] == b"Exif":
            return p[6:]
    for kind, p in png_chunks or ():
        if kind == "eXIf":
            return p[6:] if p[:4] == b"Exif" else p
    return None


def insert_jpeg(raw: bytes, tiff: bytes) -> bytes:
    """The JPEG with an APP1 segment right behind its start."""
    body = b"Exif\0\0" + tiff
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + raw[2:]
