"""Baseline JPEG in numpy: write bytes as DC-only images, parse markers, decode scans to DC thumbnails.

A payload byte b becomes an 8x8 block of the constant sample b: its only
coefficient is DC = b - 128 with a DC quantiser of 8.  Every row of 24 blocks
ends with a restart marker, so a decoder can work on all rows at once.  The
decoder reads any baseline image (one or several interleaved components, AC
coefficients are skipped); each restart interval is a lane, and all lanes of all
images with the same tables advance together.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

ROW = 24
#: Blocks a row, times rows whose height stays below 65,536 samples, as a multiple of 576.
IMAGE_BYTES = ROW * 8184
#: Code length of each DC category 0 to 8, and of the AC end-of-block symbol.
DC_LENGTHS = {7: 2, 4: 2, 2: 3, 3: 3, 5: 3, 1: 5, 6: 5, 0: 6, 8: 6}
AC_LENGTHS = {0: 1}


def _huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The BITS and HUFFVAL bytes of a table, and its canonical (code, length) per symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    bits = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bits + bytes(order), codes


_DC_SPEC, _DC_CODES = _huffman(DC_LENGTHS)
_AC_SPEC, _AC_CODES = _huffman(AC_LENGTHS)
_DC_CODE = np.array([_DC_CODES[c][0] for c in range(9)], dtype=np.int32)
_DC_LEN = np.array([_DC_CODES[c][1] for c in range(9)], dtype=np.int32)
_CATEGORY = np.array([i.bit_length() for i in range(256)], dtype=np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        (
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            _segment(0xDB, bytes([0, 8, *[1] * 63])),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + _DC_SPEC + b"\x10" + _AC_SPEC),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


def pad_payload(raw: bytes) -> bytes:
    """The bytes with 255 appended up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One stored form per payload (multiples of 24 bytes): JPEG images, one after the other."""
    images = [p[i : i + IMAGE_BYTES] for p in payloads for i in range(0, len(p), IMAGE_BYTES)]
    scans = iter(_entropy_rows(images))
    out = []
    for p in payloads:
        parts = []
        for i in range(0, len(p), IMAGE_BYTES):
            parts += [_header(min(len(p) - i, IMAGE_BYTES) // ROW), next(scans), b"\xff\xd9"]
        out.append(b"".join(parts))
    return out


def _entropy_rows(images: list[bytes]) -> list[bytes]:
    """The scan of each image, restart markers between its rows."""
    if not images:
        return []
    rows = np.array([len(i) // ROW for i in images])
    level = np.frombuffer(b"".join(images), dtype=np.uint8).astype(np.int32).reshape(-1, ROW) - 128
    diff = np.diff(level, axis=1, prepend=0)
    category = _CATEGORY[np.abs(diff)]
    bits = np.where(diff < 0, diff + (1 << category) - 1, diff)
    code = (_DC_CODE[category] << (category + 1)) | (bits << 1)  # the end of block is a single 0
    length = _DC_LEN[category] + category + 1
    ends = np.cumsum(length, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    first = np.cumsum(row_bytes + 2) - (row_bytes + 2)
    at = first[:, None] * 8 + ends - length
    size = int(first[-1] + row_bytes[-1] + 2)
    shifted = code << (24 - (at & 7) - length)
    byte = at >> 3
    sums = [np.bincount(byte.ravel(), weights=((shifted >> s) & 255).ravel(), minlength=size + 2) for s in (16, 8, 0)]
    total = sums[0][:size]
    total[1:] += sums[1][: size - 1]
    total[2:] += sums[2][: size - 2]
    data = total.astype(np.uint8)
    data[first + row_bytes - 1] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)
    stuff = np.flatnonzero(data == 255) + 1
    image_first = np.cumsum(rows) - rows
    number = np.arange(len(row_bytes)) - np.repeat(image_first, rows)
    marker = first + row_bytes
    data[marker] = 255
    data[marker + 1] = 0xD0 + number % 8
    starts = first[image_first]
    stops = np.append(starts[1:], size) - 2  # without the marker after the last row
    shift = np.searchsorted(stuff, np.stack((starts, stops)), side="right")
    data = np.insert(data, stuff, 0).tobytes()
    return [data[a:b] for a, b in zip((starts + shift[0]).tolist(), (stops + shift[1]).tolist(), strict=True)]


@dataclass
class Image:
    """What the markers of one baseline image say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component id, dc, ac
    restart: int = 0
    data: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))

    def layout(self) -> tuple:
        """Images of equal layout can be decoded together."""
        by_id = {c[0]: c for c in self.components}
        single = len(self.scan) == 1
        return tuple(
            (1 if single else by_id[i][1] * by_id[i][2], self.tables[dc], self.tables[0x10 | ac])
            for i, dc, ac in self.scan
        )


def parse(raw: bytes) -> list[Image]:
    """The images of a byte string; ValueError where it isn't baseline JPEG."""
    images, at = [], 0
    while at < len(raw):
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = Image(), at + 2
        while True:
            if at + 2 > len(raw) or raw[at] != 0xFF:
                raise ValueError("marker expected")
            marker = raw[at + 1]
            if marker == 0xD9:
                at += 2
                break
            (length,) = struct.unpack_from(">H", raw, at + 2)
            body = raw[at + 4 : at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    table = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else "u1")
                    image.quantisers[body[0] & 15] = table
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    image.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xC0:
                _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
                image.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("not a baseline frame")
            elif marker == 0xDD:
                (image.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                image.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                data = np.frombuffer(raw, dtype=np.uint8, offset=at)
                stop = _scan_end(data)
                image.data, at = data[:stop], at + stop
        images.append(image)
    return images


def _scan_end(data: np.ndarray) -> int:
    """Offset of the first marker that is neither a stuffed byte nor a restart."""
    step = 1 << 18
    for first in range(0, len(data), step):
        part = data[first : first + step + 1]
        ff = np.flatnonzero(part[:-1] == 255)
        after = part[ff + 1]
        ends = ff[(after != 0) & (after != 255) & ((after & 0xF8) != 0xD0)]
        if len(ends):
            return first + int(ends[0])
    raise ValueError("scan without end")


def _peek_table(spec: bytes) -> np.ndarray:
    """For every 16 bits ahead: code length << 8 | symbol."""
    out = np.zeros(1 << 16, dtype=np.int32)
    code, symbol = 0, 16
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | spec[symbol]
            code, symbol = code + 1, symbol + 1
        code <<= 1
    return out


def _lanes(images: list[Image]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all scans without stuffing and markers; the first byte of each lane; lanes per image."""
    data = np.concatenate([i.data for i in images])
    edges = np.cumsum([0, *(len(i.data) for i in images)])
    ff = np.flatnonzero(data[:-1] == 255)
    ff = ff[~np.isin(ff, edges[1:] - 1)]
    after = data[ff + 1]
    restart = ff[(after & 0xF8) == 0xD0]
    drop = np.sort(np.concatenate((ff[after == 0] + 1, restart, restart + 1)))
    first = np.sort(np.concatenate((edges[:-1], restart + 2)))
    count = np.searchsorted(restart, edges)
    return np.delete(data, drop), first - np.searchsorted(drop, first), np.diff(count) + 1


def dc_planes(images: list[Image]) -> list[np.ndarray]:
    """The luminance thumbnail of each image: one sample per 8x8 block, from DC only."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        _check_size(image)
        groups.setdefault(image.layout(), []).append(k)
    for layout, members in groups.items():
        for k, dc in zip(members, _decode(layout, [images[k] for k in members]), strict=True):
            out[k] = _arrange(images[k], dc)
    return out


def _check_size(image: Image) -> None:
    """ValueError where the frame is empty or larger than its scan can hold (two bits a block at least)."""
    if not image.scan or not image.components or min(min(c[1:3]) for c in image.components) < 1:
        raise ValueError("no frame or no scan")
    rows, columns = _mcus(image)
    if not 0 < rows * columns <= 4 * len(image.data):
        raise ValueError("dimensions do not fit the scan")


def _mcus(image: Image) -> tuple[int, int]:
    """MCU rows and columns of the scan."""
    high = max(v for _, _, v, _ in image.components) if len(image.scan) > 1 else 1
    wide = max(h for _, h, _, _ in image.components) if len(image.scan) > 1 else 1
    return -(-image.height // (8 * high)), -(-image.width // (8 * wide))


def _decode(layout: tuple, images: list[Image]) -> list[np.ndarray]:
    """DC values (MCU, luminance block) of images with one layout."""
    data, first, lanes = _lanes(images)
    padded = np.concatenate((data, np.full(8, 255, np.uint8))).astype(np.uint32)
    word = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    total = np.array([np.prod(_mcus(i)) for i in images])
    each = np.array([i.restart or t for i, t in zip(images, total, strict=True)])
    number = np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    mcus = np.minimum(np.repeat(each, lanes), np.repeat(total, lanes) - number * np.repeat(each, lanes))
    tables = [(blocks, _peek_table(dc), _peek_table(ac)) for blocks, dc, ac in layout]
    last = (len(word) - 1) * 8
    at = first.astype(np.int64) * 8
    most = int(mcus.max())
    dcs = np.zeros((most, layout[0][0], len(first)), dtype=np.int32)
    pred = [np.zeros(len(first), dtype=np.int32) for _ in layout]
    order = np.arange(len(first))
    for mcu in range(most):
        live = order[mcus > mcu] if mcu and (mcus <= mcu).any() else order
        p = at[live]
        for c, (blocks, dc, ac) in enumerate(tables):
            for block in range(blocks):
                entry = dc[(word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF]
                p += entry >> 8
                size = entry & 255
                p = np.minimum(p, last)
                value = ((word[p >> 3].astype(np.int64) << (p & 7)) & 0xFFFFFFFF) >> (32 - size)
                value -= np.where(value < (1 << size) >> 1, (1 << size) - 1, 0)
                p += size
                pred[c][live] += value.astype(np.int32)
                if c == 0:
                    dcs[mcu, block, live] = pred[0][live]
                _skip_ac(ac, word, p, last)
        at[live] = p
    ends = np.cumsum(lanes)
    return [
        np.concatenate([dcs[: mcus[i], :, i] for i in range(e - n, e)])
        if (mcus[e - n : e] != mcus[e - n]).any()
        else dcs[: mcus[e - n], :, e - n : e].transpose(2, 0, 1).reshape(-1, layout[0][0])
        for e, n in zip(ends.tolist(), lanes.tolist(), strict=True)
    ]


def _skip_ac(ac: np.ndarray, word: np.ndarray, p: np.ndarray, last: int) -> None:
    """Advance p over the AC coefficients of one block in every lane."""
    live, k = None, np.ones(len(p), dtype=np.int32)
    while True:
        q = p if live is None else p[live]
        q = np.minimum(q, last)
        entry = ac[(word[q >> 3] >> (16 - (q & 7)).astype(np.uint32)) & 0xFFFF]
        run, size = (entry >> 4) & 15, entry & 15
        q = q + (entry >> 8) + size
        step = np.where(size > 0, run + 1, np.where(run == 15, 16, 64))
        if live is None:
            p[:] = q
            k += step
            live = np.flatnonzero(k < 64)
        else:
            p[live] = q
            k[live] += step
            live = live[k[live] < 64]
        if not len(live):
            return


def _arrange(image: Image, dc: np.ndarray) -> np.ndarray:
    rows, columns = _mcus(image)
    _, h, v, q = next(c for c in image.components if c[0] == image.scan[0][0])
    if len(image.scan) == 1:
        h = v = 1
    plane = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    sample = np.floor_divide(plane * int(image.quantisers[q][0]) + 4, 8) + 128
    wide = max(c[1] for c in image.components) if len(image.scan) > 1 else 1
    high = max(c[2] for c in image.components) if len(image.scan) > 1 else 1
    height, width = -(-(-(-image.height * v // high)) // 8), -(-(-(-image.width * h // wide)) // 8)
    return np.clip(sample, 0, 255).astype(np.uint8)[:height, :width]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which of 8x8 cells of the thumbnail are brighter than their mean."""
    rows = np.unique(np.arange(8) * thumb.shape[0] // 8)
    columns = np.unique(np.arange(8) * thumb.shape[1] // 8)
    total = np.add.reduceat(np.add.reduceat(thumb.astype(np.float64), rows, axis=0), columns, axis=1)
    area = np.diff(np.append(rows, thumb.shape[0]))[:, None] * np.diff(np.append(columns, thumb.shape[1]))
    cells = total / area
    bits = np.zeros(64, dtype=np.uint8)
    found = (cells > cells.mean()).ravel()
    bits[: len(found)] = found
    return np.packbits(bits).tobytes().hex()
