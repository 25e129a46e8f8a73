"""The JPEG reader on streams with other tables, samplings and restarts, written here symbol by symbol."""

from __future__ import annotations

import os
import random
import struct

import numpy as np
import pytest

from anchorage.llm import jpeg


def table(lengths: dict[int, int]) -> tuple[bytes, dict[int, str]]:
    """Body of a Huffman table and the code of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    code, codes, last = 0, {}, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = format(code, f"0{last}b")
        code += 1
    return counts + bytes(order), codes


def bits_of(value: int) -> tuple[int, str]:
    size = abs(value).bit_length()
    return size, format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def write(parts, unit, width, height, interval, seed):
    """A stream of random sparse coefficients: parts is [(h, v)], unit the number of units; returns it with the coefficients."""
    r = random.Random(seed)
    dc_body, dc = table({s: 3 + s // 3 for s in range(9)})
    symbols = [0x00, 0xF0] + [run << 4 | s for run in range(16) for s in range(1, 8)]
    ac_body, ac = table({s: 7 for s in symbols[:100]} | {s: 9 for s in symbols[100:]})
    scan, piece, before, kept = b"", "", [0] * len(parts), [[] for _ in parts]

    def flush(piece):
        piece += "1" * (-len(piece) % 8)
        return bytes(int(piece[k : k + 8], 2) for k in range(0, len(piece), 8)).replace(b"\xff", b"\xff\x00")

    for u in range(unit):
        if interval and u and u % interval == 0:
            scan += flush(piece) + bytes([0xFF, 0xD0 + (u // interval - 1) % 8])
            piece, before = "", [0] * len(parts)
        for p, (h, v) in enumerate(parts):
            for _ in range(h * v):
                block = [0] * 64
                block[0] = r.randrange(-100, 100)
                for k in range(1, 64):
                    if r.random() < 0.1:
                        block[k] = r.choice([-1, 1]) * r.randrange(1, 90)
                kept[p].append(block)
                size, low = bits_of(block[0] - before[p])
                before[p] = block[0]
                piece += dc[size] + low
                run = 0
                for k in range(1, 64):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        piece, run = piece + ac[0xF0], run - 16
                    size, low = bits_of(block[k])
                    piece, run = piece + ac[run << 4 | size] + low, 0
                if run:
                    piece += ac[0]
    scan += flush(piece)
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([p + 1, h << 4 | v, 0]) for p, (h, v) in enumerate(parts))
    head = bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in range(len(parts))) + b"\x00\x3f\x00"
    segments = jpeg._marker(0xE0, b"JFIF\0....") + jpeg._marker(0xDB, bytes([0, 16] + [3] * 63))
    segments += jpeg._marker(0xC4, b"\x00" + dc_body) + jpeg._marker(0xC4, b"\x10" + ac_body)
    segments += (jpeg._marker(0xDD, struct.pack(">H", interval)) if interval else b"") + jpeg._marker(0xC0, frame)
    return b"\xff\xd8" + segments + jpeg._marker(0xDA, head) + scan + b"\xff\xd9", kept


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_one_component(interval):
    data, kept = write([(1, 1)], 12, 30, 20, interval, 4)
    (image,) = jpeg.images(data)
    assert (image.width, image.height) == (30, 20)
    assert image.components[1].coefficients.tolist() == kept[0]
    means = np.array([b[0] * 16 / 8 + 128 for b in kept[0]]).reshape(3, 4)
    assert (image.thumbnail() == np.clip(np.round(means), 0, 255)).all()


@pytest.mark.parametrize("interval", [0, 2])
def test_sampled_colour(interval):
    data, kept = write([(2, 2), (1, 1), (1, 1)], 6, 44, 30, interval, 9)
    (image,) = jpeg.images(data)
    luma = image.components[1].coefficients.reshape(4, 6, 64)
    blocks = iter(kept[0])
    for uy in range(2):
        for ux in range(3):
            for y in range(2):
                for x in range(2):
                    assert luma[2 * uy + y, 2 * ux + x].tolist() == next(blocks)
    assert image.components[3].coefficients.tolist() == kept[2]
    assert image.thumbnail().shape == (4, 6)


def test_both_decoders_agree(monkeypatch):
    r = random.Random(3)
    sparse = bytes(128 if r.random() < 0.8 else r.randrange(256) for _ in range(576 * 7))  # long runs of zeros
    for payload in (os.urandom(576 * 5), sparse, b"\x80" * 576 * 3, "Prose, ordinary prose. ".encode() * 200):
        data = jpeg.encode_payload(payload)
        in_step = jpeg.images(data)[0].components[1].coefficients.copy()
        assert in_step.any() or set(payload) == {128}
        with monkeypatch.context() as m:
            m.setattr(jpeg, "_FEW", 1 << 30)
            assert (jpeg.images(data)[0].components[1].coefficients == in_step).all()


@pytest.mark.parametrize("interval", [1, 2, 5])
def test_intervals_in_step_keep_dc_differences(interval, monkeypatch):
    monkeypatch.setattr(jpeg, "_FEW", 1)
    data, kept = write([(1, 1)], 12, 30, 20, interval, 4)
    other, more = write([(1, 1)], 12, 30, 20, interval, 5)
    first, second = jpeg.images_of([data, other])
    assert first[0].components[1].coefficients.tolist() == kept[0] and second[0].components[1].coefficients.tolist() == more[0]


def test_tables_with_an_end_of_block_of_nine_bits():
    """Categories 8 to 1 have codes of 1 to 8 bits, so that code and value take 9 bits; the end of a block has 9 bits, too."""
    tables = jpeg._marker(0xDB, bytes([0] + [1] * 64))
    for kind in (0x00, 0x10):
        tables += jpeg._marker(0xC4, bytes([kind] + [1] * 9 + [0] * 7 + [8, 7, 6, 5, 4, 3, 2, 1, 0]))
    frame = jpeg._marker(0xC0, struct.pack(">BHHB", 8, 8, 8, 1) + b"\x01\x11\x00")
    bits = "0" + "11001000" + "0" + "10000001" + "111111110"  # DC 200, AC 129, end
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    data = b"\xff\xd8" + tables + frame + jpeg._marker(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"
    assert jpeg.images(data)[0].components[1].coefficients[0].tolist() == [200, 129] + [0] * 62


@pytest.mark.parametrize("interval", [0, 1])
def test_every_cut_stream_is_refused(interval):
    colour, _ = write([(2, 1), (1, 1)], 2, 20, 8, interval, 1)
    for data in (jpeg.encode_payload(os.urandom(2000) + b"\x80" * 900), colour):
        for k in range(len(data)):
            with pytest.raises(ValueError):
                jpeg.parse(data[:k])


def test_damaged_streams_are_refused_or_read():
    """Any byte changed gives an image or a ValueError, and no other error."""
    r = random.Random(6)
    good = jpeg.encode_payload(os.urandom(3000))
    for _ in range(400):
        data = bytearray(good)
        for _ in range(r.randrange(1, 4)):
            data[r.randrange(len(data) if r.random() < 0.3 else 420)] = r.randrange(256)
        try:
            jpeg.images(bytes(data))
        except ValueError:
            pass


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 2700 * 576, 2700 * 576 + 1])
def test_round_trip(n):
    for text in (os.urandom(n), b"\xff" * n, bytes(n)):
        payload = b"".join(map(jpeg.payload_of, jpeg.images(jpeg.encode_payload(text))))
        assert payload[:n] == text and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"GIF89a", jpeg.encode_payload(b"x")[:-30], jpeg.encode_payload(b"x")[:100]])
def test_broken_streams(data):
    with pytest.raises((ValueError, struct.error)):
        jpeg.parse(data)
