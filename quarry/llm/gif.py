"""GIF images: writing byte payloads as frames, and reading frames back with their timing and colours.

The reader takes any GIF: it decodes LZW code streams (growing code widths, clear codes at any place),
undoes interlacing, applies global or local palettes, leaves transparent pixels as they were and disposes
of each frame as it asks before the next one is drawn.

A string of the LZW table is the output of the code before it and the first sample of the next one, and
those lie side by side in the output; so all codes between two clear codes can be expanded at once.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, row_struct, text_bytes, with_row

WIDTH = 192
ROWS = 64
DELAY = 4
BINS = 8
FRAME = "struct<left:int,top:int,width:int,height:int,delay_cs:int,disposal:int,transparent:int,histogram:array<bigint>>"
DECODED = f"id long, media binary, payload binary, canvas_sha256 string, frames array<{FRAME}>, error string"


def _widths(count: int, start: int) -> np.ndarray:
    """Bits of the first `count` codes after a clear code, for `start` bits of literals."""
    entries = (1 << start) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), start + 1, 12)


#: Codes after a clear code until the table is full, and then some; all further ones have twelve bits.
_GROWING = 8192
_WIDTHS = {s: _widths(_GROWING, s) for s in range(2, 9)}
_REACH = {s: np.concatenate([[0], np.cumsum(w)]).astype(np.int64) for s, w in _WIDTHS.items()}
_MASKS = {s: ((1 << w) - 1).astype(np.int32) for s, w in _WIDTHS.items()}


def _layout(start: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where codes begin after a clear code, and their masks, for as many codes as `bits` can hold."""
    reach, masks = _REACH[start], _MASKS[start]
    more = (bits - int(reach[-1])) // 12 + 1
    if more <= 0:
        return reach, masks
    return np.concatenate([reach, reach[-1] + 12 * np.arange(1, more + 1)]), np.concatenate([masks, np.full(more, 4095, np.int32)])


def lzw_encode(data: bytes, start: int = 8) -> bytes:
    """Code stream of some samples; the table is cleared when it is full."""
    clear = 1 << start
    codes, table, free = [clear], {}, clear + 2
    counts = [1]
    if data:
        append = codes.append
        held = data[0]
        for c in data[1:]:
            key = held << 8 | c
            if key in table:
                held = table[key]
            else:
                append(held)
                table[key] = free
                free += 1
                held = c
                if free == 4096:
                    append(clear)
                    counts.append(len(codes))
                    table.clear()
                    free = clear + 2
        append(held)
    codes.append(clear + 1)
    counts.append(len(codes))
    widths = np.concatenate([[start + 1], *(_WIDTHS[start][: b - a] for a, b in zip(counts, counts[1:], strict=False))])
    bits = np.array(codes, "<u2").view(np.uint8).reshape(-1, 2)
    bits = np.unpackbits(bits, axis=1, bitorder="little", count=12)
    return np.packbits(bits[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """Samples of the codes between two clear codes, all at once.

    A code above the literals stands for the output of an earlier code and the sample after it.  Following
    those references by doubling gives first the lengths, then where each output sample was written first.
    """
    n = len(codes)
    place = np.arange(n, dtype=np.int32)
    refers = codes >= clear
    parent = np.where(refers, codes - clear - 2, place)
    if (parent[refers] >= place[refers]).any():  # entries end with code 4095; what stands for them stays put
        raise ValueError("a code before its table entry")
    length, up = refers.astype(np.int32), parent
    while (step := length[up]).any():
        length += step
        up = up[up]
    length += 1
    begin = np.cumsum(length, dtype=np.int32) - length
    source = np.arange(int(length.sum()), dtype=np.int32) + np.repeat(begin[parent] - begin, length)
    first = np.zeros(len(source), np.uint8)
    first[begin] = np.where(refers, 0, codes)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return first[source]
        source = further


def lzw_decode(stream: bytes, start: int, most: int) -> bytes:
    """Samples of a code stream, at most `most`; a stream that ends early gives what it holds."""
    clear, stop = 1 << start, (1 << start) + 1
    data = np.frombuffer(stream + bytes(3), np.uint8)
    total = 8 * len(stream)
    out, at, written = [], 0, 0
    while at < total and written < most:
        reach, masks = _layout(start, total - at)
        n = int(np.searchsorted(reach, total - at, "right")) - 1
        if n <= 0:
            break
        bit = reach[:n] + at
        byte = bit >> 3
        found = data[byte] | data[byte + 1].astype(np.int32) << 8 | data[byte + 2].astype(np.int32) << 16
        found = (found >> (bit & 7)) & masks[:n]
        ends = np.flatnonzero((found == clear) | (found == stop))
        end = int(ends[0]) if len(ends) else n
        if end:
            out.append(_expand(found[:end], clear).tobytes())
            written += len(out[-1])
        at += int(reach[min(end + 1, len(reach) - 1)])
        if end < n and found[end] == stop:
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for i in range(0, len(data), 255) if (part := data[i : i + 255])) + b"\0"


_GREYS = bytes(v for g in range(256) for v in (g, g, g))


def write_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Frames of `width` by up to `rows` grey samples; the payload's length must be a positive multiple of `width`."""
    height = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), _GREYS]
    for top in range(0, height, rows):
        n = min(rows, height - top)
        data = payload[top * width : (top + n) * width]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, n, 0), b"\x08", _blocks(lzw_encode(data))]
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    return np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3), at + 3 * n


def read_gif(data: bytes):
    """Yields (frame fields, the frame's own samples, the canvas in RGB after drawing it)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    canvas = np.zeros((high, wide, 3), np.uint8)
    control = (0, 0, -1)
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, clear if packed & 1 else -1)
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = shared
        if flags & 0x80:
            colours, at = _palette(data, at, flags)
        start = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(stream, start, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        disposal, delay, transparent = control
        control = (0, 0, -1)
        before = canvas.copy() if disposal == 3 else None
        if colours is None:
            colours = np.zeros((256, 3), np.uint8)
        area = canvas[top : top + h, left : left + w]
        shown = colours[np.minimum(samples, len(colours) - 1)][: area.shape[0], : area.shape[1]]
        if transparent >= 0:
            solid = (samples != transparent)[: area.shape[0], : area.shape[1]]
            area[solid] = shown[solid]
        else:
            area[:] = shown
        yield {"left": left, "top": top, "width": w, "height": h, "delay_cs": delay, "disposal": disposal, "transparent": transparent}, samples, canvas
        if disposal == 2:
            area[:] = 0 if shared is None or transparent >= 0 else shared[min(background, len(shared) - 1)]
        elif disposal == 3:
            canvas[:] = before


def histogram(rgb: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of each channel in `bins` equal ranges: red, then green, then blue."""
    flat = rgb.reshape(-1, 3).astype(np.int64) * bins // 256
    return [n for c in range(3) for n in np.bincount(flat[:, c], minlength=bins).tolist()]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as a GIF.

    Null texts count as empty; null ids and repeated rows are kept; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        media = [write_gif(t + b" " * (-len(t) % WIDTH if t else WIDTH)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")), run, "id long, n_bytes long, media binary", rows=128)


def read_frames(media: DataFrame, id_col: str = "id", media_col: str = "media", carry: bool = False) -> DataFrame:
    """(id, media, payload, canvas_sha256, frames, error), with `carry` also the input row as a struct `row`: the samples of all frames in order, the digest of the last
    canvas, and each frame's place, timing and colour histogram of the drawn canvas area.

    What is no GIF, or a broken one, gives null results and the reason in `error`; null media likewise.
    """

    def one(data: bytes | None):
        try:
            if data is None:
                raise ValueError("no media")
            frames, payload, canvas = [], [], np.zeros((0, 0, 3), np.uint8)
            for frame, samples, canvas in read_gif(data):
                area = canvas[frame["top"] : frame["top"] + frame["height"], frame["left"] : frame["left"] + frame["width"]]
                frames.append(frame | {"histogram": histogram(area)})
                payload.append(samples.tobytes())
                digest = hashlib.sha256(canvas.tobytes())
            return b"".join(payload), digest.hexdigest() if frames else None, frames, None
        except (ValueError, IndexError, KeyError, struct.error) as broken:
            return None, None, None, str(broken)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [one(m) for m in batch.column(1).to_pylist()]
        payload, canvas, frames, error = zip(*got, strict=True) if got else ((), (), (), ())
        kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("left", "top", "width", "height", "delay_cs", "disposal", "transparent")] + [("histogram", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(payload, pa.binary()), pa.array(canvas, pa.string()), pa.array(frames, kind), pa.array(error, pa.string()), *batch.columns[2:]],
            ["id", "media", "payload", "canvas_sha256", "frames", "error", "row"][: 4 + batch.num_columns],
        )

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"), *([row_struct(media.drop(media_col))] if carry else []))
    return map_rows(rows, run, with_row(DECODED, rows), rows=128)
