"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

WIDTH = 64
ROWS_PER_FRAME = 1024
DELAY_CS = 4
#: Entries of a code table: codes have at most 12 bits.
TABLE = 1 << 12
#: Bytes that a canvas may take; larger ones are refused before any memory is.
MAX_CANVAS = 1 << 28
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
# First row and step of the four interlace passes.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


@dataclass
class Frame:
    """One shown picture: the whole canvas after it is drawn, and its own rectangle."""

    delay_cs: int
    disposal: int
    box: tuple[int, int, int, int]
    canvas: np.ndarray  # height, width, RGBA


@lru_cache(1)
def _longer() -> list[int]:
    """Code and next sample to a longer code; 0 if there is none. All 0 between two streams."""
    return [0] * (TABLE << 8)


def lzw_encode(samples: bytes, least: int) -> bytes:
    """Samples below 2**least as an LZW stream; codes grow to 12 bits, and the table is cleared when it is full."""
    clear = 1 << least
    runs: list[list[int]] = []
    codes: list[int] = []
    table, used = _longer(), []
    rest = iter(samples)
    held, free = next(rest, -1), clear + 2
    for sample in rest:
        key = held << 8 | sample
        if found := table[key]:
            held = found
            continue
        codes.append(held)
        held = sample
        if free < TABLE:
            table[key] = free
            free += 1
            used.append(key)
        else:
            runs.append(codes)
            codes, free = [], clear + 2
            for k in used:
                table[k] = 0
            used.clear()
    for k in used:
        table[k] = 0
    if held >= 0:
        codes.append(held)
    runs.append(codes)
    flat = np.concatenate([[clear, *run] for run in runs] + [[clear + 1]]).astype(np.uint16)
    # a clear code still has the width of the run before it, the first one that of an empty table
    widths = np.concatenate([_widths(least, 1)] + [_widths(least, len(run) + 1)[: len(run) + 1] for run in runs])
    bits = np.unpackbits(flat.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16)[None, :] < widths[:, None]], bitorder="little").tobytes()


def _codes(data: np.ndarray, bit: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    at = bit >> 3
    word = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << 8 | data[at + 2].astype(np.uint32) << 16
    return (word >> (bit & 7).astype(np.uint32)) & ((1 << width) - 1)


def _widths(least: int, n: int) -> np.ndarray:
    """Width of the k-th code after a clear code; fixed by how many table entries the codes before it made."""
    size = np.minimum((1 << least) + 2 + np.maximum(0, np.arange(n) - 1), 4095)
    return np.maximum(least + 1, np.floor(np.log2(size)).astype(np.int64) + 1)


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    The entry that code k + 1 completes is the string of code k and one sample more, so it stands in the output, from where code
    k starts. A code thus points at an earlier code, and each of its samples at an earlier sample; pointers are followed by
    doubling until they reach samples that are codes themselves.
    """
    n = len(codes)
    place, plain = np.arange(n), codes < clear
    entry = codes.astype(np.int64) - clear - 2
    if (~plain & ((entry < 0) | (entry >= place))).any():
        raise ValueError("code without an entry")
    hop, more = np.where(plain, place, entry), (~plain).astype(np.int64)
    while not plain[hop].all():
        more, hop = more + more[hop], hop[hop]
    size = more + 1
    start = np.cumsum(size) - size
    owner = np.repeat(place, size)
    source = np.arange(len(owner))
    source = np.where(plain[owner], source, start[np.maximum(entry, 0)][owner] + source - start[owner])
    while (further := source[source]).tobytes() != source.tobytes():
        source = further
    return codes[owner[source]].astype(np.uint8)


def lzw_decode(stream: bytes, least: int, wanted: int) -> np.ndarray:
    """Samples of an LZW stream with codes of least + 1 to 12 bits; short streams are filled with 0.

    Code widths depend only on the distance to the last clear code, so all codes between two clear codes are read at once.
    """
    clear, parts, held = 1 << least, [], 0
    data = np.frombuffer(stream + b"\0\0\0", np.uint8)
    total, bit = len(stream) * 8, 0
    while bit + least + 1 <= total and held < wanted:
        n = min(TABLE, (total - bit) // (least + 1) + 1)
        while True:
            widths = _widths(least, n)
            at = bit + np.cumsum(widths) - widths
            at = at[at + widths <= total]
            codes = _codes(data, at, widths[: len(at)])
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or len(at) < n or n > wanted + 2:
                break
            n *= 4
        end = int(stop[0]) if len(stop) else len(codes)
        bit = total if end >= len(codes) or codes[end] == clear + 1 else int(at[end] + widths[end])
        parts.append(_expand(codes[:end], clear))
        held += len(parts[-1])
    found = np.zeros(wanted, np.uint8)
    out = np.concatenate([np.zeros(0, np.uint8), *parts])[:wanted]
    found[: len(out)] = out
    return found


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _to_blocks(stream: bytes) -> bytes:
    full = len(stream) // 255
    head = np.full((full, 256), 255, np.uint8)
    head[:, 1:] = np.frombuffer(stream[: full * 255], np.uint8).reshape(full, 255)
    rest = stream[full * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(samples: np.ndarray, width: int = WIDTH, rows_per_frame: int = ROWS_PER_FRAME, delay_cs: int = DELAY_CS) -> bytes:
    """A grey GIF whose frames, one after another, hold the samples row by row.

    The palette holds the shades that occur. Where it has a colour to spare, that one is transparent, and a later frame shows
    the frame before it wherever both agree, so such samples compress to almost nothing.
    """
    rows = len(samples) // width
    shades = np.unique(samples)
    least = max(2, int(len(shades)).bit_length() if len(shades) < 256 else 8)
    clear = len(shades) if len(shades) < 1 << least else -1
    palette = np.zeros(1 << least, np.uint8)
    palette[: len(shades)] = shades
    index = np.searchsorted(shades, samples).astype(np.uint8)
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, rows_per_frame), 0xF0 | least - 1, 0, 0), np.repeat(palette, 3).tobytes()]
    for top in range(0, rows, rows_per_frame):
        height = min(rows_per_frame, rows - top)
        part, old = index[top * width : (top + height) * width], index[max(0, top - rows_per_frame) * width :][: height * width]
        see_through = top > 0 and clear >= 0
        if see_through:
            part = np.where(part == old, np.uint8(clear), part)
        control = struct.pack("<BHBB", 4 | see_through, delay_cs, max(0, clear), 0)
        out += [b"\x21\xf9\x04", control, b"\x2c", struct.pack("<HHHHB", 0, 0, width, height, 0), bytes([least]), _to_blocks(lzw_encode(part.tobytes(), least))]
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order: palettes (global or local), transparency, interlacing and disposal are applied."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13
    common = None
    if packed & 0x80:
        size = 2 << (packed & 7)
        common = np.frombuffer(data, np.uint8, 3 * size, at).reshape(size, 3)
        at += 3 * size
    if high * wide * 4 > MAX_CANVAS:
        raise ValueError("canvas too large")
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, disposal, clear = 0, 0, -1
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind, (body, at) = data[at + 1], _blocks(data, at + 2)
            if kind == 0xF9:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear = body[3] if body[0] & 1 else -1
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if packed & 0x80:
            size = 2 << (packed & 7)
            palette = np.frombuffer(data, np.uint8, 3 * size, at).reshape(size, 3)
            at += 3 * size
        least = data[at]
        stream, at = _blocks(data, at + 1)
        if w * h * 4 > MAX_CANVAS or not 1 <= least <= 8:
            raise ValueError("frame too large, or odd codes")
        index = lzw_decode(stream, least, w * h).reshape(h, w)
        if packed & 0x40:
            order = [r for first, step in PASSES for r in range(first, h, step)]
            index = index[np.argsort(order)]
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        index = index[: box.shape[0], : box.shape[1]]
        colours = GREY[: 1 << least] if palette is None else palette
        shown = np.empty((*index.shape, 4), np.uint8)
        shown[..., :3], shown[..., 3] = colours[np.minimum(index, len(colours) - 1)], 255
        if clear >= 0:
            box[index != clear] = shown[index != clear]
        else:
            box[:] = shown
        yield Frame(delay, disposal, (left, top, w, h), canvas.copy())
        if disposal == 2:
            box[:] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, -1


def histogram(pixels: np.ndarray, bits: int = 2) -> np.ndarray:
    """Counts of RGB colours cut to their leading bits."""
    c = pixels.reshape(-1, pixels.shape[-1]).astype(np.uint16) >> (8 - bits)
    return np.bincount((c[:, 0] << 2 * bits) | (c[:, 1] << bits) | c[:, 2], minlength=1 << 3 * bits)


def frames(media: DataFrame, key: str = "key", data: str = "data") -> DataFrame:
    """One row per frame of media (key, GIF bytes): number, time of showing, box, RGBA canvas, colour histogram.

    Null bytes give no frame; bytes that are no GIF give one row with a negative number and no canvas.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "frame", "start_cs", "delay_cs", "disposal", "width", "height", "rgba", "histogram"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = 0
                try:
                    for i, f in enumerate(decode(blob) if blob is not None else ()):
                        row = [k, i, start, f.delay_cs, f.disposal, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas[..., :3]).tolist()]
                        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)
                        start += f.delay_cs
                except (ValueError, IndexError, struct.error):
                    yield pa.record_batch([pa.array([v], t) for v, t in zip([k, -1, start, *[None] * 6], types, strict=True)], names)

    schema = "key long, frame int, start_cs long, delay_cs int, disposal int, width int, height int, rgba binary, histogram array<long>"
    return media.select(F.col(key).cast("long").alias("key"), F.col(data).alias("data")).mapInArrow(run, schema)


def read_back(data: bytes, wanted: int) -> tuple[bytes, str]:
    """The samples that the frames of a grey GIF hold, and a digest of its timing and colours."""
    parts, shades, count, time = [], np.zeros(64, np.int64), 0, 0
    for f in decode(data):
        _, _, w, h = f.box
        picture = f.canvas[:h, :w, :3]
        parts.append(picture[..., 0].tobytes())
        shades += histogram(picture)
        count, time = count + 1, time + f.delay_cs
    payload = b"".join(parts)
    if len(payload) != wanted:
        raise ValueError("the media lost samples")
    grey = shades[[0, 21, 42, 63]]
    return payload, f"frames={count};cs={time};grey=" + ",".join(map(str, grey.tolist()))


def stored(text: str | None) -> tuple:
    """Columns of the contract for one text: stored as GIF, read back from its bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")
    media = encode(np.frombuffer(payload, np.uint8))
    back, feature = read_back(media, len(payload))
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def query(docs: DataFrame) -> DataFrame:
    """Every text of docs (doc_id, text) stored as a GIF and read back.

    Null texts count as empty, null ids are kept, repeated rows stay and equal texts give equal values; a long text becomes many
    frames; other columns are ignored, whatever their names; an empty table gives no row.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [stored(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
