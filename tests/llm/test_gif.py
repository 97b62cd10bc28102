import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pagewright.llm import gif


def lzw(samples, least):
    """A plain encoder that lets codes grow to 12 bits."""
    clear = 1 << least
    codes, known, width, held = [(clear, least + 1)], {bytes([i]): i for i in range(clear)}, least + 1, b""
    following = clear + 2
    for s in samples:
        if held + bytes([s]) in known:
            held += bytes([s])
            continue
        codes.append((known[held], width))
        if following < 4096:
            known[held + bytes([s])] = following
            width += following == 1 << width and width < 12
            following += 1
        else:
            codes.append((clear, width))
            known, width, following = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        held = bytes([s])
    codes += [(known[held], width), (clear + 1, width)]
    value = at = 0
    for code, width in codes:
        value |= code << at
        at += width
    return value.to_bytes((at + 7) // 8, "little")


def test_grown_codes_decode():
    rnd = random.Random(1)
    for least, n, k in ((8, 20_000, 256), (8, 40_000, 3), (2, 5000, 4), (4, 30_000, 16), (8, 5000, 1), (8, 100, 2)):
        s = np.array([rnd.randrange(k) for _ in range(n)], np.uint8)
        assert (gif.lzw_decode(lzw(s.tolist(), least), least, n) == s).all()
        assert gif.lzw_encode(s.tobytes(), least) == lzw(s.tolist(), least)


def test_text_shrinks_and_later_frames_show_through():
    line = b"the same line of a table, again and again | "
    samples = np.frombuffer((line * 4000)[: 64 * 2500], np.uint8)
    media = gif.encode(samples)
    shown = list(gif.decode(media))
    assert len(media) < len(samples) / 8 and len(shown) == 3
    assert b"".join(f.canvas[: f.box[3], :, 0].tobytes() for f in shown) == samples.tobytes()


def test_brute_force_reader_of_whole_files(spark):
    """Every stored text read by a second reader, which knows only the codes, the palette and what shows through."""
    for text in ("", "a", "ab" * 40_000, "x" * 200_000, "".join(chr(k) for k in range(1, 3000)), "\x00\x01" * 5000):
        raw = text.encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        data = gif.encode(np.frombuffer(payload, np.uint8))
        assert _read(data) == payload


def _read(data):
    """Frames of one width laid end to end, by a plain reader."""
    size = 2 << (data[10] & 7)
    palette, at, out, last = data[13 : 13 + 3 * size : 3], 13 + 3 * size, b"", b""
    while data[at] != 0x3B:
        flags, clear = data[at + 3], data[at + 6]
        at += 8
        w, h = struct.unpack_from("<HH", data, at + 5)
        least, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        index = _plain(stream, least)[: w * h]
        frame = bytes(last[i] if flags & 1 and k == clear else palette[k] for i, k in enumerate(index))
        out, last = out + frame, frame + last[len(frame) :]
    return out


def _plain(stream, least):
    bits, value, at, out = least + 1, int.from_bytes(stream, "little"), 0, bytearray()
    clear, table, old = 1 << least, [], b""
    while True:
        code = (value >> at) & ((1 << bits) - 1)
        at += bits
        if code == clear:
            table, bits, old = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, b""
            continue
        if code == clear + 1:
            return bytes(out)
        entry = table[code] if code < len(table) else old + old[:1]
        out += entry
        if old and len(table) < 4096:
            table.append(old + entry[:1])
            bits += len(table) == 1 << bits and bits < 12
        old = entry


def test_huge_canvas_is_refused():
    data = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    with pytest.raises(ValueError, match="too large"):
        list(gif.decode(data))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=300))
def test_payload_comes_back(text):
    raw = text.encode("utf-8", "surrogatepass")
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    found = gif.stored(text)
    assert found[:3] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())


def test_many_frames():
    samples = np.random.default_rng(0).integers(0, 256, 64 * 2500).astype(np.uint8)
    shown = list(gif.decode(gif.encode(samples)))
    assert [f.box[3] for f in shown] == [1024, 1024, 452] and sum(f.delay_cs for f in shown) == 3 * gif.DELAY_CS


def picture(blocks):
    red_green = bytes([255, 0, 0, 0, 255, 0])
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + red_green
    for disposal, clear, samples in blocks:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear >= 0), 7, max(clear, 0)) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02" + gif._to_blocks(lzw(samples, 2))
    return out + b"\x3b"


def test_transparency_and_disposal():
    shown = list(gif.decode(picture([(3, -1, [1, 1, 1, 1]), (2, 0, [0, 1, 0, 1]), (0, 0, [0, 0, 0, 1])])))
    assert shown[0].canvas[0, 0].tolist() == [0, 255, 0, 255]
    assert shown[1].canvas[0, 0].tolist() == [0, 0, 0, 0] and shown[1].canvas[0, 1].tolist() == [0, 255, 0, 255]
    assert shown[2].canvas[0, 1].tolist() == [0, 0, 0, 0] and shown[2].canvas[1, 1].tolist() == [0, 255, 0, 255]


def test_frames_table(spark):
    media = spark.createDataFrame([(1, bytearray(picture([(0, -1, [0, 1, 0, 1])]))), (2, bytearray(b"no picture")), (3, None)], "key long, data binary")
    found = {r.key: r for r in gif.frames(media).collect()}
    assert found[1].frame == 0 and sum(found[1].histogram) == 4 and found[2].frame == -1 and 3 not in found


def test_odd_rows(odd_docs, no_docs):
    found = gif.query(odd_docs).collect()
    assert len(found) == odd_docs.count() and gif.query(no_docs).count() == 0
    assert {r.payload_bytes for r in found if r.doc_id in (3, 4)} == {64}
    same = {(r.media_sha256, r.feature) for r in found if r.doc_id in (1, 2)}
    assert len(same) == 1
