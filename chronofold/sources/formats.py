"""Image formats that need no library: PNG, TIFF in strips, BMP and FITS in, PNG and TIFF out, and what stands beside the
picture in JPEG and GIF files too.

A decoder gets a whole file and returns (height, width, channels) of unsigned whole numbers, or None where the file is
damaged or of a kind that is not supported; read() also says why. Channels are in the order red, green, blue.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}


@dataclass
class Info:
    """What a file says about its picture."""

    exif: dict[str, str] = field(default_factory=dict)
    profile: bytes = b""


# --- PNG


def _png_chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_MAGIC)
    while at + 8 <= len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        yield content[at + 4 : at + 8], content[at + 8 : at + 8 + n]
        at += 12 + n


def _png_header(content: bytes) -> tuple[int, int, int, int, int]:
    width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", content[16:29])
    return height, width, _CHANNELS.get(kind, 0), bits, interlaced


def _unfiltered(raw: np.ndarray, height: int, line: int, step: int) -> np.ndarray:
    """Bytes of filtered lines (a kind, then ``line`` bytes; a pixel has ``step``) with their predictions added back.

    A pixel needs its left, upper and upper left neighbours, so all pixels of one anti-diagonal are done at once: the work
    is a few array operations for each of about height + width of them. Lines that need no neighbour but the one above, or
    to the left, are done line by line.
    """
    lines = raw.reshape(height, line + 1)
    kinds, now = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown prediction")
    if not np.isin(kinds, (3, 4)).any():
        out, above = np.empty((height, line), np.uint8), np.zeros(line, np.uint8)
        for y in range(height):
            row = now[y]
            if kinds[y] == 1:
                row = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
            elif kinds[y] == 2:
                row = row + above
            out[y] = above = row
        return out
    width = line // step
    out = np.zeros((height + 1, width + 1, step), np.int16)  # a line above and a pixel to the left of zeros
    told = now.reshape(height, width, step).astype(np.int16)
    for t in range(height + width - 1):
        y = np.arange(max(0, t - width + 1), min(height, t + 1))
        x, kind = t - y, kinds[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        p = left + up - corner
        dl, du, dc = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        nearest = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (told[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, line)


#: First column and line, and distances between columns and lines, of the passes of an interlaced image (fixed values).
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def decode_png(content: bytes) -> np.ndarray:
    height, width, channels, bits, interlaced = _png_header(content)
    palette = content[25] == 3
    channels = 1 if palette else channels
    if not channels or bits not in (1, 2, 4, 8, 16) or interlaced > 1:
        raise ValueError("unknown kind of PNG")
    chunks = list(_png_chunks(content))
    raw = np.frombuffer(zlib.decompress(b"".join(body for name, body in chunks if name == b"IDAT")), np.uint8)
    pixels, at = np.zeros((height, width, channels), np.uint16 if bits == 16 else np.uint8), 0
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        h, w = len(range(y0, height, dy)), len(range(x0, width, dx))
        if not h or not w:
            continue
        line = -(-w * channels * bits // 8)
        found = _unfiltered(raw[at : at + h * (line + 1)], h, line, max(1, channels * bits // 8))
        at += h * (line + 1)
        if bits == 16:
            found = found.reshape(-1).view(">u2").astype(np.uint16)
        elif bits < 8:
            found = np.unpackbits(found, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits, dtype=np.uint8)[::-1])
            found = found[:, : w * channels] * (1 if palette else 255 // ((1 << bits) - 1))
        pixels[y0::dy, x0::dx] = found.reshape(h, w, channels)
    if palette:
        colours = np.frombuffer(next(body for name, body in chunks if name == b"PLTE"), np.uint8).reshape(-1, 3)
        pixels = colours[pixels[:, :, 0]]
    return pixels


def png_chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png_lines(pixels: np.ndarray) -> bytes:
    """Lines of (height, width, channels) pixels as they are compressed: each behind the number of its prediction, none."""
    rows = np.ascontiguousarray(pixels.astype(">u2" if pixels.dtype.itemsize == 2 else "u1")).view(np.uint8).reshape(len(pixels), -1)
    return np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()


def png_head(height: int, width: int, channels: int, bits: int, info: Info | None = None) -> bytes:
    """What stands before the pixels."""
    if bits not in (8, 16):
        raise ValueError("PNG holds 8 or 16 bits")
    kind = {n: k for k, n in _CHANNELS.items() if k != 3}[channels]
    notes = png_chunk(b"iCCP", b"profile\0\0" + zlib.compress(info.profile)) if info and info.profile else b""
    for key, value in (info.exif if info else {}).items():
        notes += png_chunk(b"tEXt", key.encode("latin-1", "replace") + b"\0" + value.encode("latin-1", "replace"))
    return PNG_MAGIC + png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, 0)) + notes


def encode_png(pixels: np.ndarray, level: int = 6, info: Info | None = None) -> bytes:
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    head = png_head(*pixels.shape, 8 * pixels.dtype.itemsize, info)
    return head + png_chunk(b"IDAT", zlib.compress(png_lines(pixels), level)) + png_chunk(b"IEND", b"")


def _png_info(content: bytes) -> Info:
    found = Info()
    for name, body in _png_chunks(content):
        key, _, rest = body.partition(b"\0")
        if name == b"tEXt":
            found.exif[key.decode("latin-1")] = rest.decode("latin-1")
        elif name == b"iCCP":
            found.profile = zlib.decompress(rest[1:])
    return found


# --- TIFF: one image in strips, whole pixels together; no compression, deflate or byte runs, with or without differences

_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
_TIFF_TEXT = {305: "Software", 271: "Make", 272: "Model", 306: "DateTime"}


def _tiff_tags(content: bytes, at: int | None = None) -> tuple[str, dict[int, list | bytes]]:
    """Byte order and tags of the first directory, or of the one at a place."""
    order = "<" if content[:2] == b"II" else ">"
    if at is None:
        (at,) = struct.unpack(f"{order}I", content[4:8])
    (count,) = struct.unpack(f"{order}H", content[at : at + 2])
    tags: dict[int, list | bytes] = {}
    for k in range(count):
        entry = content[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(f"{order}HHI", entry[:8])
        size = _TIFF_SIZES.get(kind, 0) * n
        body = entry[8 : 8 + size] if size <= 4 else content[struct.unpack(f"{order}I", entry[8:12])[0] :][:size]
        if kind in (2, 7, 1):
            tags[tag] = body
        elif kind in (3, 4):
            tags[tag] = list(struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", body))
        elif kind == 5:
            tags[tag] = list(struct.unpack(f"{order}{2 * n}I", body))
    return order, tags


def _byte_runs(packed: bytes) -> bytes:
    """n < 128: n + 1 bytes follow; n > 128: the next byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(packed):
        n = packed[at]
        if n < 128:
            out += packed[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += packed[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def decode_tiff(content: bytes) -> np.ndarray:
    order, tags = _tiff_tags(content)
    width, height, channels = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    bits, packing, differences = set(tags.get(258, [1])), tags.get(259, [1])[0], tags.get(317, [1])[0]
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _byte_runs}.get(packing)
    if unpack is None or len(bits) != 1 or tags.get(284, [1])[0] != 1 or differences not in (1, 2) or 273 not in tags or tags.get(339, [1])[0] != 1:
        raise ValueError(f"TIFF of a kind that is not supported (compression {packing})")
    depth = bits.pop()
    if depth not in (8, 16, 32):
        raise ValueError(f"TIFF of {depth} bits")
    raw = b"".join(unpack(content[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    pixels = np.frombuffer(raw, f"{order}u{depth // 8}", height * width * channels).reshape(height, width, channels).astype(f"u{depth // 8}")
    return np.cumsum(pixels, axis=1, dtype=pixels.dtype) if differences == 2 else pixels


def tiff_ends(height: int, width: int, channels: int, bits: int, info: Info | None = None) -> tuple[bytes, bytes]:
    """What stands before and behind the pixels, lowest bytes first, of an image in one strip."""
    size = height * width * channels * bits // 8
    if size >= 1 << 32:
        raise ValueError("TIFF files hold less than 4 GB")
    tags: list[tuple[int, int, list | bytes]] = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * channels), (259, 3, [1]), (262, 3, [2 if channels >= 3 else 1]), (273, 4, [8]), (277, 3, [channels]), (278, 4, [height]), (279, 4, [size]), (284, 3, [1])]
    for tag, name in _TIFF_TEXT.items():
        if info and name in info.exif:
            tags.append((tag, 2, info.exif[name].encode("latin-1", "replace") + b"\0"))
    if info and info.profile:
        tags.append((34675, 7, info.profile))
    tags.sort()
    at = 8 + size + size % 2
    extra, more, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, value in tags:
        body = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{'H' if kind == 3 else 'I'}", *value)
        n = len(value)
        if len(body) > 4:
            entries += struct.pack("<HHII", tag, kind, n, extra + len(more))
            more += body + b"\0" * (len(body) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at), b"\0" * (size % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + more


def encode_tiff(pixels: np.ndarray, info: Info | None = None) -> bytes:
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    head, tail = tiff_ends(*pixels.shape, 8 * pixels.dtype.itemsize, info)
    return head + np.ascontiguousarray(pixels.astype(pixels.dtype.newbyteorder("<"))).tobytes() + tail


def _tiff_info(content: bytes) -> Info:
    order, tags = _tiff_tags(content)
    exif = {name: tags[tag].rstrip(b"\0").decode("latin-1") for tag, name in _TIFF_TEXT.items() if tag in tags}
    more = _tiff_tags(content, tags[_EXIF_AT][0])[1] if _EXIF_AT in tags else {}
    exposure = more.get(_EXPOSURE) or tags.get(_EXPOSURE)
    if exposure:
        exif["ExposureTime"] = "/".join(map(str, exposure[:2]))
    return Info(exif, tags.get(34675, b""))


#: Tags of the directory of exposure data, and of the exposure time in it (fixed values).
_EXIF_AT, _EXPOSURE = 34665, 33434


def exif_block(exif: dict[str, str]) -> bytes:
    """The texts and the exposure time as a TIFF without a picture, as other formats carry it."""
    texts = sorted((tag, exif[name].encode("latin-1", "replace") + b"\0") for tag, name in _TIFF_TEXT.items() if name in exif)
    num, _, den = exif.get("ExposureTime", "").partition("/")
    timed = num.strip().isdigit() and (den.strip() or "1").isdigit() and int(num) < 1 << 32 and 0 < int(den or 1) < 1 << 32
    count = len(texts) + timed
    at = 8 + 2 + 12 * count + 4
    entries, more = b"", b""
    for tag, body in texts:
        if len(body) > 4:
            entries += struct.pack("<HHII", tag, 2, len(body), at + len(more))
            more += body + b"\0" * (len(body) % 2)
        else:
            entries += struct.pack("<HHI", tag, 2, len(body)) + body.ljust(4, b"\0")
    if timed:
        inner = at + len(more)
        entries += struct.pack("<HHII", _EXIF_AT, 4, 1, inner)
        more += struct.pack("<HHHIII", 1, _EXPOSURE, 5, 1, inner + 18, 0) + struct.pack("<II", int(num), int(den or 1))
    return b"II*\0" + struct.pack("<IH", 8, count) + entries + b"\0\0\0\0" + more


# --- JPEG: what stands beside the picture; the picture itself is Spark's image source's


def _jpeg_segments(content: bytes) -> Iterator[tuple[int, bytes]]:
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        (n,) = struct.unpack(">H", content[at + 2 : at + 4])
        yield content[at + 1], content[at + 4 : at + 2 + n]
        at += 2 + n


def _jpeg_info(content: bytes) -> Info:
    found, parts = Info(), {}
    for marker, body in _jpeg_segments(content):
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            found.exif = _tiff_info(body[6:]).exif
        elif marker == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            parts[body[12]] = body[14:]
    found.profile = b"".join(parts[k] for k in sorted(parts))
    return found


def with_jpeg_info(content: bytes, about: Info | None) -> bytes:
    """A JPEG file with texts, exposure time and profile put in front of what it holds."""
    more = b""
    if about and about.exif:
        body = b"Exif\0\0" + exif_block(about.exif)
        more += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body if len(body) < 65_000 else b""
    pieces = [about.profile[at : at + 65_000] for at in range(0, len(about.profile), 65_000)] if about else []
    for k, piece in enumerate(pieces):
        body = b"ICC_PROFILE\0" + bytes([k + 1, len(pieces)]) + piece
        more += b"\xff\xe2" + struct.pack(">H", len(body) + 2) + body
    return content[:2] + more + content[2:]


# --- BMP and FITS


def decode_bmp(content: bytes) -> np.ndarray:
    (at,) = struct.unpack("<I", content[10:14])
    width, height, _, bits, packing = struct.unpack("<iiHHI", content[18:34])
    if bits not in (24, 32) or packing:
        raise ValueError("BMP of a kind that is not supported")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(height), at).reshape(abs(height), line)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def _fits_cards(content: bytes) -> tuple[dict[str, str], int]:
    cards, at = {}, 0
    while True:
        card = content[at : at + 80].decode("latin-1")
        at += 80
        if card.startswith("END") or not card:
            return cards, math.ceil(at / 2880) * 2880
        if card[8:10] == "= ":
            cards[card[:8].strip()] = card[10:].split(" /")[0].strip().strip("'").strip()


def decode_fits(content: bytes) -> np.ndarray:
    cards, at = _fits_cards(content)
    bits, axes = int(cards["BITPIX"]), [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards["NAXIS"]))]
    if bits not in (8, 16, 32) or len(axes) not in (2, 3):
        raise ValueError("FITS of a kind that is not supported")
    shape = (axes[2] if len(axes) == 3 else 1, axes[1], axes[0])
    raw = np.frombuffer(content, {8: "u1", 16: ">i2", 32: ">i4"}[bits], math.prod(shape), at).reshape(shape).astype(np.int64)
    values = np.clip(raw + int(float(cards.get("BZERO", 0))), 0, (1 << bits) - 1)
    return np.moveaxis(values, 0, 2).astype(f"u{bits // 8}")


# --- any of them


def read(content: bytes | None) -> tuple[np.ndarray | None, str | None]:
    """(pixels, None), or (None, why there are none); by the first bytes of the file, whatever its name says."""
    content = bytes(content or b"")
    decoders = ((PNG_MAGIC, decode_png), (b"II*\0", decode_tiff), (b"MM\0*", decode_tiff), (b"BM", decode_bmp), (b"SIMPLE  =", decode_fits))
    for magic, decoder in decoders:
        if content.startswith(magic):
            try:
                return decoder(content), None
            except (zlib.error, ValueError, struct.error, KeyError, IndexError, TypeError, StopIteration) as e:
                return None, f"not decodable: {e or type(e).__name__}"
    if content.startswith(b"\xff\xd8") or content[:4] == b"GIF8":
        return None, "not decodable: no decoder for JPEG and GIF files in tables"
    return None, "not decodable: empty file" if not content else "not decodable: unknown kind of file"


def decode(content: bytes | None) -> np.ndarray | None:
    return read(content)[0]


def header(content: bytes | None) -> tuple[int, int, int | None] | None:
    """(width, height, bits of a channel) without decoding; None for anything else."""
    content = bytes(content or b"")
    try:
        if content.startswith(PNG_MAGIC):
            height, width, _, bits, _ = _png_header(content)
            return width, height, bits
        if content[:4] in (b"II*\0", b"MM\0*"):
            _, tags = _tiff_tags(content)
            return tags[256][0], tags[257][0], tags.get(258, [1])[0]
        if content.startswith(b"BM"):
            width, height = struct.unpack("<ii", content[18:26])
            return width, abs(height), 8
        if content.startswith(b"SIMPLE  ="):
            cards, _ = _fits_cards(content)
            return int(cards["NAXIS1"]), int(cards["NAXIS2"]), abs(int(cards["BITPIX"]))
        if content[:6] in (b"GIF87a", b"GIF89a"):
            return *struct.unpack("<HH", content[6:10]), 8
        if content.startswith(b"\xff\xd8"):
            at = 2
            while at + 9 <= len(content) and content[at] == 0xFF:
                marker = content[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    bits, height, width = struct.unpack(">BHH", content[at + 4 : at + 9])
                    return width, height, bits
                at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    except (struct.error, KeyError, ValueError, IndexError, TypeError):
        pass
    return None


def info(content: bytes | None) -> Info:
    """Text and profile of a PNG, TIFF or JPEG file; empty for anything else."""
    content = bytes(content or b"")
    try:
        if content.startswith(PNG_MAGIC):
            return _png_info(content)
        if content[:4] in (b"II*\0", b"MM\0*"):
            return _tiff_info(content)
        if content.startswith(b"\xff\xd8"):
            return _jpeg_info(content)
    except (zlib.error, struct.error, KeyError, ValueError, IndexError, TypeError):
        pass
    return Info()


#: Suffixes of files that can be written.
WRITTEN = ("png", "tif", "tiff", "jpg", "jpeg")


def encode(pixels: np.ndarray, suffix: str, level: int = 6, about: Info | None = None) -> bytes:
    if suffix == "png":
        return encode_png(pixels, level, about)
    if suffix in ("tif", "tiff"):
        return encode_tiff(pixels, about)
    raise ValueError(f"no encoder for {suffix} files")


def resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with places measured from the middles of pixels and edges repeated; halves round to even."""
    h, w = pixels.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(float)
    top, bottom = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + bottom * fy).astype(pixels.dtype)
