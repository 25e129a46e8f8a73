"""Media columns: baseline JPEG streams, written, parsed and decoded with numpy.

Writing is lossless because the payload is stored in JPEG's own unit, the
quantised coefficient, with quantiser steps of 1: byte b is the coefficient
b - 128 in zigzag order of a one-component image.  Scans use the standard's
Huffman tables for luminance, runs of zeros and end-of-block codes, and a
restart marker after every block.

Reading handles any baseline stream (SOF0, 8 bits, interleaved or separate
scans, any sampling, restart intervals, any tables).  Restart intervals can be
decoded independently, so those of all streams of a batch that share tables are
Huffman-decoded in step, one symbol of each at a time, as array operations;
scans with few intervals are decoded symbol by symbol.  Thumbnails need no
inverse DCT: the DC coefficient of a block is 8 times its mean.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import binary_values, map_batches, utf8

PAD = 576  # 3 x 3 blocks of 64 coefficients
_ACROSS = 3  # blocks in a row of an image
_ROWS = 2700  # rows of 3 x 3 blocks in an image at most: JPEG counts at most 65,535 lines
_GROUP = 2 << 20  # coefficients written or read at a time; an image has fewer
_FEW = 16  # scans with fewer restart intervals are decoded symbol by symbol

# Fixed values of the JPEG standard (Annex K): codes of each length from 1 to 16, and the symbols in the order of their codes.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_COUNTS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SHORT = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14,
    0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]
#: All other pairs of a run and a size have 16 bits, in order.
AC_SYMBOLS = AC_SHORT + sorted({run << 4 | size for run in range(16) for size in range(1, 11)} - set(AC_SHORT))

_END_OF_BLOCK, _SIXTEEN_ZEROS = 0x00, 0xF0


def _codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, at = 0, 0
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        code, at = code << 1, at + n
    return codes, lengths


_DC, _AC = _codes(DC_COUNTS, DC_SYMBOLS), _codes(AC_COUNTS, AC_SYMBOLS)
_VALUE = np.arange(256) - 128
_SIZE = np.array([abs(int(v)).bit_length() for v in _VALUE])
_LOW = np.where(_VALUE < 0, _VALUE + (1 << _SIZE) - 1, _VALUE).astype(np.uint64)
#: By byte: the whole code of a DC value, which a restart makes a difference from 0.
_DC_BITS = _DC[0][_SIZE] << _SIZE.astype(np.uint64) | _LOW
_DC_LENGTH = _DC[1][_SIZE] + _SIZE


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


_TABLES = (
    _marker(0xDB, bytes([0] + [1] * 64))
    + _marker(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS]))
    + _marker(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS]))
    + _marker(0xDD, struct.pack(">H", 1))
)


def _block_codes(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths, one place a coefficient; zeros have length 0, and the end of a block is in its last place."""
    n = len(blocks)
    codes, lengths = np.zeros((n, 64), np.uint64), np.zeros((n, 64), np.int64)
    row, column = np.nonzero(blocks[:, 1:] != 128)
    column += 1
    before = np.zeros(len(column), np.int64)
    before[1:] = np.where(row[1:] == row[:-1], column[:-1], 0)
    run, own = column - before - 1, blocks[row, column]
    symbol = (run & 15) << 4 | _SIZE[own]
    code, length = _AC[0][symbol] << _SIZE[own].astype(np.uint64) | _LOW[own], _AC[1][symbol] + _SIZE[own]
    for times in range(1, 4):  # each takes 16 zeros
        long = run >> 4 >= times
        if not long.any():
            break
        code[long] |= _AC[0][_SIXTEEN_ZEROS] << length[long].astype(np.uint64)
        length[long] += _AC[1][_SIXTEEN_ZEROS]
    codes[row, column], lengths[row, column] = code, length
    codes[:, 0], lengths[:, 0] = _DC_BITS[blocks[:, 0]], _DC_LENGTH[blocks[:, 0]]
    ended = blocks[:, 63] == 128
    codes[ended, 63], lengths[ended, 63] = _AC[0][_END_OF_BLOCK], _AC[1][_END_OF_BLOCK]
    return codes, lengths


def _entropy_coded(blocks: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scans of images one after the other, and where each block begins in them; ``image`` numbers the image of each block."""
    codes, lengths = _block_codes(blocks)
    within = np.cumsum(lengths, axis=1)
    bits = within[:, -1]
    size = (bits + 7) >> 3
    start = np.concatenate(([0], np.cumsum(size)))
    there = lengths.reshape(-1) > 0
    code, length = codes.reshape(-1)[there], lengths.reshape(-1)[there]
    place = ((start[:-1] * 8)[:, None] + within - lengths).reshape(-1)[there]
    raw = np.zeros(start[-1], np.int64)
    byte, reach = place >> 3, (place & 7) + length
    word = code << (64 - reach).astype(np.uint64)
    for k in range(8):
        if k:
            more = reach > 8 * k
            if not more.any():
                break
            byte, reach, word = byte[more], reach[more], word[more]
        # Codes do not overlap, so adding their bits puts them together.
        part = word >> np.uint64(56 - 8 * k) & np.uint64(255)
        raw += np.bincount(byte + k, part, len(raw)).astype(np.int64)
    raw[start[1:] - 1] |= (1 << (size * 8 - bits)) - 1
    # A zero follows every byte 255, a restart marker every block but the last of an image.
    full = raw == 255
    markers = np.arange(len(blocks)) - image
    shift = np.concatenate(([0], np.cumsum(full)))
    block_start = start[:-1] + shift[start[:-1]] + 2 * markers
    end = start[-1] + shift[-1] + 2 * markers[-1]
    out = np.zeros(end, np.uint8)
    out[np.arange(len(raw)) + shift[:-1] + np.repeat(2 * markers, size)] = raw
    last = np.append(image[1:] != image[:-1], True)
    first_of = np.flatnonzero(np.append(True, image[1:] != image[:-1]))
    number = np.arange(len(blocks)) - first_of[image]
    at = np.append(block_start[1:], end)[~last] - 2
    out[at] = 0xFF
    out[at + 1] = 0xD0 + number[~last] % 8
    return out, np.append(block_start[first_of], end)


def _stored(texts: list) -> list[bytes]:
    sizes = [max(1, -(-len(t) // PAD)) * PAD for t in texts]
    payload = np.full(sum(sizes), 255, np.uint8)
    at, images, owner = 0, [], []
    for k, (text, size) in enumerate(zip(texts, sizes, strict=True)):
        payload[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += size
        for left in range(size, 0, -_ROWS * PAD):
            images.append(min(left, _ROWS * PAD) // 64)
            owner.append(k)
    scans, start = _entropy_coded(payload.reshape(-1, 64), np.repeat(np.arange(len(images)), images))
    out: list[list[bytes]] = [[] for _ in texts]
    for k, (n, own) in enumerate(zip(images, owner, strict=True)):
        frame = _marker(0xC0, struct.pack(">BHHB", 8, 8 * (n // _ACROSS), 8 * _ACROSS, 1) + b"\x01\x11\x00")
        scan = scans[start[k] : start[k + 1]].tobytes()
        out[own].append(b"\xff\xd8" + _TABLES + frame + _marker(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9")
    return [b"".join(x) for x in out]


def encode_payloads(texts: Iterable[bytes | memoryview]) -> Iterator[bytes]:
    """Store bytes, padded with 255 to a positive multiple of 576, as JPEG streams; each text's streams stand one after the other.

    A text of more than one group of images is written group by group, so memory does not follow the longest text.
    """
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _GROUP:
            yield from _stored(held)
            held, size = [], 0
        if len(text) > _GROUP:
            step = _GROUP // (_ROWS * PAD) * _ROWS * PAD
            yield b"".join(_stored([text[at : at + step]])[0] for at in range(0, len(text), step))
        else:
            held.append(text)
            size += len(text) + PAD
    if held:
        yield from _stored(held)


def encode_payload(text: bytes | memoryview) -> bytes:
    """``encode_payloads`` of one text."""
    return next(encode_payloads([text]))


# ---------------------------------------------------------------- reading


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    across: int = 0  # blocks, with those that only fill up the last unit
    down: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    """Dimensions, quantisers and quantised coefficients in zigzag order of one baseline stream."""

    width: int
    height: int
    components: dict[int, Component]
    quantisers: dict[int, np.ndarray]

    def thumbnail(self) -> np.ndarray:
        """One luminance value a block, from DC coefficients alone."""
        first = next(iter(self.components.values()))
        dc = first.coefficients[:, 0].reshape(first.down, first.across)
        step = int(self.quantisers[first.quantiser][0])
        across, down = self.blocks(first)
        return np.clip(np.round(dc[:down, :across] * step / 8) + 128, 0, 255).astype(np.uint8)

    def blocks(self, part: Component) -> tuple[int, int]:
        """Blocks of a component across and down that hold samples of the image."""
        unit_h = max(c.h for c in self.components.values())
        unit_v = max(c.v for c in self.components.values())
        return -(-self.width * part.h // (8 * unit_h)), -(-self.height * part.v // (8 * unit_v))


@dataclass
class Huffman:
    """A Huffman table: by the next 16 bits, the code's length (0: no such code) and its symbol."""

    lengths: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, counts: bytes, values: bytes) -> Huffman:
        if len(counts) != 16 or len(values) != sum(counts):
            raise ValueError("a Huffman table is cut off")
        lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                if code >> length:
                    raise ValueError("a Huffman table has too many codes")
                span = 1 << (16 - length)
                lengths[code * span : (code + 1) * span] = length
                symbols[code * span : (code + 1) * span] = values[at]
                code, at = code + 1, at + 1
            code <<= 1
        return cls(lengths, symbols)


@dataclass
class Scan:
    """A scan to decode: its components with their tables, and its bytes without stuffing, cut at restarts."""

    image: Image
    parts: list[tuple[Component, Huffman, Huffman]]
    data: np.ndarray
    starts: np.ndarray  # of the pieces between restarts, and the end
    interval: int  # units in a piece; 0: all

    def rows(self) -> np.ndarray:
        """Block rows of a scan of one component, in scan order."""
        part = self.parts[0][0]
        across, down = self.image.blocks(part) if len(self.image.components) > 1 else (part.across, part.down)
        return (np.arange(down)[:, None] * part.across + np.arange(across)).reshape(-1)


_huffman: dict[bytes, Huffman] = {}


def _tables_of(body: bytes, into: dict[int, Huffman]) -> None:
    at = 0
    while at < len(body):
        n = sum(body[at + 1 : at + 17])
        key = body[at : at + 17 + n]
        if key not in _huffman:
            table = Huffman.read(key[1:17], key[17:])
            if len(_huffman) > 64:
                _huffman.clear()
            _huffman[key] = table
        into[key[0]] = _huffman[key]
        at += 17 + n


def _quantisers_of(body: bytes, into: dict[int, np.ndarray]) -> None:
    at = 0
    while at < len(body):
        size = 128 if body[at] >> 4 else 64
        if at + 1 + size > len(body):
            raise ValueError("a quantiser table is cut off")
        into[body[at] & 15] = np.frombuffer(body, ">u2" if size == 128 else "u1", 64, at + 1).astype(np.int32)
        at += 1 + size


def _read(data: bytes, start: int) -> tuple[Image, list[Scan], int]:
    """Parse the markers of one stream; its scans remain to be decoded."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, image, interval = start + 2, None, 0
    huffman: dict[int, Huffman] = {}
    quantisers: dict[int, np.ndarray] = {}
    scans: list[Scan] = []
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        code = data[at + 1]
        at += 2
        if code == 0xD9:
            if image is None:
                raise ValueError("no frame")
            if any(c.quantiser not in quantisers for c in image.components.values()):
                raise ValueError("a quantiser table is missing")
            return image, scans, at
        length = int.from_bytes(data[at : at + 2], "big")
        if length < 2 or at + length > len(data):
            raise ValueError("a segment is cut off")
        body = data[at + 2 : at + length]
        at += length
        if code == 0xDB:
            _quantisers_of(body, quantisers)
        elif code == 0xC4:
            _tables_of(body, huffman)
        elif code == 0xDD:
            if len(body) != 2:
                raise ValueError("a restart interval is cut off")
            interval = int.from_bytes(body, "big")
        elif code == 0xC0:
            if image is not None:
                raise ValueError("a second frame")
            image = _frame(body, quantisers, len(data) - at)
        elif 0xC1 <= code <= 0xCF and code not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif code == 0xDA:
            if image is None:
                raise ValueError("a scan before the frame")
            end = _SCAN_END.search(data, at)
            if not end:
                raise ValueError("the scan does not end")
            scans.append(_scan(image, body, np.frombuffer(data, np.uint8, end.start() - at, at), huffman, interval))
            at = end.start()


#: The marker behind a scan: not a stuffed byte, a restart or a byte that fills up.
_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)


def _frame(body: bytes, quantisers: dict[int, np.ndarray], left: int) -> Image:
    if len(body) < 6 or len(body) != 6 + 3 * body[5] or not body[5]:
        raise ValueError("a frame is cut off")
    bits, height, width, n = struct.unpack_from(">BHHB", body)
    if bits != 8 or not height or not width:
        raise ValueError("not 8 bits, or without a size")
    parts = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
    if len(parts) != n or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in parts.values()):
        raise ValueError("components are not distinct or their sampling is not 1 to 4")
    unit_h, unit_v = max(c.h for c in parts.values()), max(c.v for c in parts.values())
    for c in parts.values():
        c.across = -(-width // (8 * unit_h)) * c.h
        c.down = -(-height // (8 * unit_v)) * c.v
        if n == 1:
            c.h = c.v = 1
            c.across, c.down = -(-width // 8), -(-height // 8)
    # A block has two codes at least.
    if sum(c.across * c.down for c in parts.values()) > 4 * left:
        raise ValueError("the stream is too short for its size")
    for c in parts.values():
        c.coefficients = np.zeros((c.across * c.down, 64), np.int32)
    return Image(width, height, parts, quantisers)


def _scan(image: Image, header: bytes, raw: np.ndarray, huffman: dict[int, Huffman], interval: int) -> Scan:
    n = header[0] if header else 0
    if not n or len(header) != 4 + 2 * n:
        raise ValueError("a scan's header is cut off")
    chosen = []
    for k in range(n):
        part, tables = image.components.get(header[1 + 2 * k]), header[2 + 2 * k]
        dc, ac = huffman.get(tables >> 4), huffman.get(0x10 | tables & 15)
        if part is None or dc is None or ac is None:
            raise ValueError("a scan names a component or table that is missing")
        chosen.append((part, dc, ac))
    if len({id(c[0]) for c in chosen}) != n:
        raise ValueError("a scan names a component twice")
    # Of 255 and 0 the first counts; 255 and a restart marker part two pieces; other bytes 255 before a marker fill up.
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    restart = full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(raw), bool)
    keep[full[after == 0] + 1] = False
    keep[full[after == 255]] = False
    keep[restart] = keep[restart + 1] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return Scan(image, chosen, raw[keep], np.concatenate(([0], kept[restart], kept[-1:])), interval)


def _decode_all(scans: list[Scan]) -> None:
    """Decode scans into their components' coefficients; those of one component and the same tables in step."""
    in_step: dict[tuple[int, int], list[Scan]] = defaultdict(list)
    for scan in scans:
        if len(scan.parts) == 1 and len(scan.starts) > _FEW:
            in_step[id(scan.parts[0][1]), id(scan.parts[0][2])].append(scan)
        else:
            _by_symbol(scan)
    for group in in_step.values():
        held, size = [], 0
        for scan in group:
            held.append(scan)
            size += len(scan.data)
            if size > _GROUP:
                _in_step(held)
                held, size = [], 0
        if held:
            _in_step(held)


_FULL = np.array([(1 << s) - 1 for s in range(16)])
_HALF = np.array([1 << s >> 1 for s in range(16)])


def _in_step(scans: list[Scan]) -> None:
    """Decode scans of one component with the same tables, one symbol of every restart interval at a time."""
    _, dc, ac = scans[0].parts[0]
    rows = [s.rows() for s in scans]
    total = sum(map(len, rows))
    starts, ends, first, counts = [], [], [], []
    byte = block = 0
    for scan, own in zip(scans, rows, strict=True):
        step = scan.interval or len(own)
        pieces = len(scan.starts) - 1
        if pieces != -(-len(own) // step):
            raise ValueError("restart markers do not match the interval")
        starts.append(scan.starts[:-1] + byte)
        ends.append(scan.starts[1:] + byte)
        first.append(block + step * np.arange(pieces))
        counts.append(np.minimum(step, len(own) - step * np.arange(pieces)))
        byte += len(scan.data)
        block += len(own)
    data = np.concatenate([*(s.data for s in scans), np.full(8, 255, np.uint8)]).astype(np.uint64)
    words = data[:-4].copy()  # the next 40 bits at each byte
    for k in range(1, 5):
        words = words << np.uint64(8) | data[k : len(data) - 4 + k]
    lengths, symbols = np.concatenate((dc.lengths, ac.lengths)).astype(np.int64), np.concatenate((dc.symbols, ac.symbols)).astype(np.int64)
    out = np.zeros(total * 64, np.int32)
    at, end, row, left = np.concatenate(starts) * 8, np.concatenate(ends) * 8, np.concatenate(first), np.concatenate(counts)
    heads = row
    k = np.zeros(len(at), np.int64)
    while len(at):
        word, shift = words[at >> 3], at & 7
        index = (word >> (24 - shift).astype(np.uint64) & np.uint64(0xFFFF)).astype(np.int64) + ((k > 0) << 16)
        length, symbol = lengths[index], symbols[index]
        size, run = symbol & 15, np.where(k > 0, symbol >> 4, 0)
        at = at + length + size
        if not length.all() or (at > end).any():
            raise ValueError("no such code, or the scan is too short")
        low = (word >> (40 - shift - length - size).astype(np.uint64)).astype(np.int64) & _FULL[size]
        value = low - np.where(low < _HALF[size], _FULL[size], 0)
        skips = (size == 0) & (k > 0)
        to = k + run
        real = ~skips
        if (to[real] > 63).any():
            raise ValueError("a run leaves the block")
        out[(row * 64 + to)[real]] = value[real]
        k = np.where(skips & (run != 15), 64, to + 1)
        done = k >= 64
        if done.any():
            k[done] = 0
            row, left = row + done, left - done
            if not left.all():
                more = left > 0
                at, end, row, left, k = at[more], end[more], row[more], left[more], k[more]
    blocks = out.reshape(-1, 64)
    if len(heads) < total:  # DC values are differences within an interval
        sums = np.concatenate(([0], np.cumsum(blocks[:, 0])))
        blocks[:, 0] = sums[1:] - np.repeat(sums[heads], np.diff(np.append(heads, total)))
    block = 0
    for scan, own in zip(scans, rows, strict=True):
        scan.parts[0][0].coefficients[own] = blocks[block : block + len(own)]
        block += len(own)


def _by_symbol(scan: Scan) -> None:
    """Decode a scan symbol by symbol."""
    if len(scan.parts) == 1:
        order = [[(*scan.parts[0], block)] for block in scan.rows().tolist()]
    else:
        first = scan.parts[0][0]
        order = [
            [(c, dc, ac, (uy * c.v + y) * c.across + ux * c.h + x) for c, dc, ac in scan.parts for y in range(c.v) for x in range(c.h)]
            for uy in range(first.down // first.v)
            for ux in range(first.across // first.h)
        ]
    step = scan.interval or len(order)
    if len(scan.starts) - 1 != -(-len(order) // step):
        raise ValueError("restart markers do not match the interval")
    for k in range(len(scan.starts) - 1):
        _units(order[k * step : (k + 1) * step], scan.data[scan.starts[k] : scan.starts[k + 1]].tobytes())


def _units(units: list[list[tuple[Component, Huffman, Huffman, int]]], piece: bytes) -> None:
    padded = piece + b"\xff" * 8
    at = 0  # in bits

    def peek(n: int) -> int:
        byte = at >> 3
        return int.from_bytes(padded[byte : byte + 5], "big") >> (40 - (at & 7) - n) & ((1 << n) - 1)

    before: dict[int, int] = {}
    for unit in units:
        for part, dc, ac, block in unit:
            row = part.coefficients[block]
            k, table = 0, dc
            while k < 64:
                window = peek(16)
                length, symbol = int(table.lengths[window]), int(table.symbols[window])
                run, size = symbol >> 4 if k else 0, symbol & 15
                at += length
                value = peek(size) if size else 0
                at += size
                if not length or at > 8 * len(piece):
                    raise ValueError("no such code, or the scan is too short")
                if k and not size:
                    k = k + 16 if run == 15 else 64
                    continue
                k += run
                if k > 63:
                    raise ValueError("a run leaves the block")
                if size and value < 1 << (size - 1):
                    value -= (1 << size) - 1
                if not k:
                    value = before[id(part)] = before.get(id(part), 0) + value
                row[k] = value
                k, table = k + 1, ac


def parse(data: bytes, start: int = 0) -> tuple[Image, int]:
    """Read one stream; returns it and the place behind it.  Raises ValueError on what is not baseline JPEG or cut off."""
    image, scans, end = _read(data, start)
    _decode_all(scans)
    return image, end


def images(media: bytes) -> list[Image]:
    """All streams of a stored value."""
    return images_of([media])[0]


def images_of(values: Iterable[bytes]) -> list[list[Image]]:
    """All streams of some stored values; their scans are decoded together."""
    out, scans = [], []
    for media in values:
        found, at = [], 0
        while at < len(media):
            image, own, at = _read(media, at)
            found.append(image)
            scans += own
        out.append(found)
    _decode_all(scans)
    return out


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode_payload`` put into an image's coefficients."""
    return (next(iter(image.components.values())).coefficients + 128).astype(np.uint8).tobytes()


def thumbnail_hashes(image: Image) -> tuple[str, str]:
    """SHA-256 prefix of the DC thumbnail, and a 64-bit difference hash of it averaged to 8 rows of 9."""
    small = image.thumbnail()
    rows = np.linspace(0, small.shape[0], 9).astype(int)
    cols = np.linspace(0, small.shape[1], 10).astype(int)
    sums = np.zeros((small.shape[0] + 1, small.shape[1] + 1))
    sums[1:, 1:] = small.cumsum(0, dtype=np.float64).cumsum(1)
    r0, c0 = np.minimum(rows[:-1], small.shape[0] - 1), np.minimum(cols[:-1], small.shape[1] - 1)
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    cells = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    cells /= np.outer(r1 - r0, c1 - c0)
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel()).tobytes().hex()
    return hashlib.sha256(small.tobytes()).hexdigest()[:16], bits


def with_media(records: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, payload, media): every text's UTF-8 bytes and the JPEG streams that store them.  A null text is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = pa.array(list(encode_payloads(binary_values(batch.column(1)))), pa.binary())
        return pa.record_batch([batch.column(0), media, batch.column(2)], names=[id_column, "media", "n_bytes"])

    chosen = records.select(F.col(id_column).cast("long").alias(id_column), utf8(text_column).alias("payload"))
    return map_batches(
        chosen.withColumn("n_bytes", F.octet_length("payload").cast("long")), run, f"`{id_column}` long, media binary, n_bytes long"
    )


def _in_groups(values: Iterable[memoryview]) -> Iterator[list[Image]]:
    held, size = [], 0
    for media in values:
        held.append(bytes(media))
        size += len(media)
        if size > _GROUP:
            yield from images_of(held)
            held, size = [], 0
    yield from images_of(held)


MEDIA_SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail binary, width int, height int, thumb_sha string, thumb_dhash string, feature string"
)


def read_media(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Parse and decode the ``media`` column: dimensions (height over all streams), thumbnail hashes, payload digests.

    Raises ValueError on a value that holds no baseline JPEG.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for streams in _in_groups(binary_values(batch.column(1))):
            payload = b"".join(map(payload_of, streams))
            hashes = [thumbnail_hashes(x) for x in streams]
            sha, dhash = ("-".join(x) for x in zip(*hashes, strict=True))
            width, height = max(x.width for x in streams), sum(x.height for x in streams)
            feature = f"{width}x{height}:{dhash}:{sha}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), payload[-32:], width, height, sha, dhash, feature))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        shas = pa.array([hashlib.sha256(media).hexdigest() for media in binary_values(batch.column(1))], pa.string())
        sizes = pa.array([len(media) for media in binary_values(batch.column(1))], pa.int64())
        names = [id_column, "n_bytes", "media_bytes", "media_sha256", *(c.split()[0] for c in MEDIA_SCHEMA.split(", "))]
        return pa.record_batch([batch.column(0), batch.column(2), sizes, shas, *columns], names=names)

    schema = f"`{id_column}` long, n_bytes long, media_bytes long, media_sha256 string, {MEDIA_SCHEMA}"
    return map_batches(stored.select(id_column, "media", "n_bytes"), run, schema)


def media_digests(documents: DataFrame) -> DataFrame:
    """Store every text as JPEG, read it back, and return digests.

    A null text is empty, and an empty one is 576 bytes of padding.  Repeated
    rows get a row each; other columns are ignored; no rows give no rows.
    """
    read = read_media(with_media(documents))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"), "media_bytes", "media_sha256",
        "feature", "width", "height", "thumb_dhash",
    )
