import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import gif, queries


def slow_lzw(stream, start):
    """The textbook decoder, bit by bit, with a table of strings."""
    clear, stop = 1 << start, (1 << start) + 1
    value, bits, at, out = 0, 0, 0, b""
    width, table, before = start + 1, None, None
    for byte in stream:
        value |= byte << bits
        bits += 8
        while bits >= width:
            code, value, bits = value & ((1 << width) - 1), value >> width, bits - width
            if code == clear:
                table, width, before = {i: bytes([i]) for i in range(clear)} | {clear: b"", stop: b""}, start + 1, None
                continue
            if code == stop:
                return out
            s = table[code] if code in table else before + before[:1]
            out += s
            if before is not None and len(table) < 4096:
                table[len(table)] = before + s[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
            before = s
    return out


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([0, 0, 1]))
def test_lzw_small(data, few):
    data = bytes(b & 3 for b in data) if few else data
    start = 2 if few else 8
    stream = gif.lzw_encode(data, start)
    assert slow_lzw(stream, start) == data == gif.lzw_decode(stream, start, len(data))


def test_lzw_long():
    rnd = random.Random(3)
    for data in (bytes(rnd.randrange(256) for _ in range(30000)), b"abc" * 20000, b"a" * 50000, b" ".join(rnd.choice([b"the", b"of", b"word"]) for _ in range(20000))):
        stream = gif.lzw_encode(data)
        assert slow_lzw(stream, 8) == data == gif.lzw_decode(stream, 8, len(data))


def image(frames, palette, size=(3, 2)):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for left, top, w, h, disposal, transparent, local, interlaced, samples in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), 7, transparent or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x81 if local else 0) | (0x40 if interlaced else 0)) + (local or b"")
        out += b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2))
    return out + b"\x3b"


def test_disposal_transparency_and_palettes():
    grey = bytes([0, 0, 0, 10, 10, 10, 20, 20, 20, 30, 30, 30])
    red = bytes([0, 0, 0, 99, 0, 0, 0, 99, 0, 0, 0, 99])
    data = image([
        (0, 0, 3, 2, 1, None, None, False, [1] * 6), (1, 0, 2, 1, 2, 0, None, False, [0, 3]), (0, 1, 2, 1, 3, None, red, False, [1, 2]),
        (2, 1, 1, 1, 0, None, None, False, [2]),
    ], grey)
    seen = [canvas[:, :, 0].tolist() for _, _, canvas in map(lambda x: (x[0], x[1], x[2].copy()), gif.read_gif(data))]
    assert seen[0] == [[10, 10, 10], [10, 10, 10]]
    assert seen[1] == [[10, 10, 30], [10, 10, 10]]
    assert seen[2] == [[10, 0, 0], [99, 0, 10]]
    assert seen[3] == [[10, 0, 0], [10, 10, 20]]
    rows = [[i % 4] * 2 for i in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = image([(0, 0, 2, 9, 0, None, None, True, sum((rows[i] for i in order), []))], grey, (2, 9))
    assert next(gif.read_gif(data))[1].tolist() == rows


def test_documents(spark, tmp_path):
    texts = ["", None, "é" * 96, "x" * 193, "long line " * 30000, "x" * 193]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", None)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_gif_frames(spark, str(tmp_path)).collect()}
    for d, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(gif.write_gif(payload)).hexdigest() and r.media_bytes == len(gif.write_gif(payload))
    assert got[3].feature == got[5].feature != got[2].feature


def test_broken_media(spark):
    good = gif.write_gif(b"z" * 192)
    df = spark.createDataFrame([(1, None), (2, bytearray(b"text")), (3, bytearray(good[:800])), (4, bytearray(good)), (5, bytearray(b""))], "id long, media binary").withColumn("frames", F.lit(1))
    got = {r.id: r for r in gif.read_frames(df).collect()}
    assert got[1].error and got[2].error and got[5].error and bytes(got[4].payload) == b"z" * 192
    assert got[4].frames[0].delay_cs == gif.DELAY and sum(got[4].frames[0].histogram) == 3 * 192
    assert gif.read_frames(df.limit(0)).count() == 0


def deferred(data, start=8):
    """A code stream whose table fills up once and is never cleared again, as encoders may write it."""
    clear = 1 << start
    table = {bytes([i]): i for i in range(clear)}
    value, bits, width, free, held = clear, start + 1, start + 1, clear + 2, b""
    for c in data:
        if held + bytes([c]) in table:
            held += bytes([c])
            continue
        value |= table[held] << bits
        bits += width
        if free < 4096:
            table[held + bytes([c])] = free
            free += 1
            width = max(width, min(12, (free - 1).bit_length()))
        held = bytes([c])
    value |= table[held] << bits if held else 0
    bits += width if held else 0
    value |= (clear + 1) << bits
    return value.to_bytes((bits + width + 7) // 8, "little")


def test_deferred_clear():
    rnd = random.Random(6)
    for n in (500, 20_000, 60_000):
        data = bytes(rnd.choice(b"abcdefgh ") for _ in range(n))
        stream = deferred(data)
        assert slow_lzw(stream, 8) == data == gif.lzw_decode(stream, 8, n)


def test_stored_media_by_an_independent_reader():
    """Whole files of our writer, parsed here block by block, with the textbook decoder."""
    payload = b" ".join(b"word%d" % (i * i % 997) for i in range(6000))
    payload += b" " * (-len(payload) % 192)
    data, at, out = gif.write_gif(payload), 13 + 768, b""
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 8
            continue
        at += 11
        stream = b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        out += slow_lzw(stream, 8)
    assert out == payload
