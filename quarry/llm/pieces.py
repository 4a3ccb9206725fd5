"""SentencePiece encoding that keeps the source spans of every piece, and decoding.

`Normalizer` reads the model's compiled character map (a trie in double-array form, then the replacement
strings) and rewrites a text by the longest prefix that the map knows, else one character unchanged.  It
records for each normalised byte where its source began, so any run of normalised bytes projects to a span
of source bytes.  Pieces come from the library; their normalised lengths are projected through that alignment.

A model with an empty map, a dummy prefix and no white-space removal only turns spaces into marks.  There
the text is cut at spaces, and each cut is encoded once per worker: no piece of such a vocabulary has a
mark after another character (checked when the model is loaded), so no merge crosses a cut.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunked import ChunkCache, loaded
from quarry.llm.common import map_rows, text_bytes

MARK = "▁".encode()
SCHEMA = "id long, ids array<int>, starts array<int>, ends array<int>, decoded string"


class Normalizer:
    """Longest-prefix rewriting with alignment, from the fields of a model's normaliser."""

    def __init__(self, charsmap: bytes, add_dummy_prefix: bool = True, remove_extra_whitespaces: bool = False, escape_whitespaces: bool = True):
        self.units, self.strings = (), b""
        if charsmap:
            size = struct.unpack_from("<I", charsmap)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.strings = charsmap[4 + size :]
        self.dummy, self.strip, self.escape = add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key that starts here and the offset of its replacement; (0, 0) if none."""
        units, node, best = self.units, 0, (0, 0)
        if not units:
            return best
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return best

    def step(self, text: bytes, at: int) -> tuple[bytes, int]:
        """The next replacement and how many source bytes it stands for."""
        length, where = self.longest(text, at)
        if length:
            return self.strings[where : self.strings.index(0, where)], length
        lead = text[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + length], min(length, len(text) - at)

    def normalize(self, text: bytes) -> tuple[bytes, list[int]]:
        """(normalised bytes, source offset of each of them, one more for the end)."""
        out, align = bytearray(), []
        at = 0
        parts = []
        while at < len(text):
            new, used = self.step(text, at)
            parts.append((new, at))
            at += used
        end = len(text)
        if self.strip:
            while parts and parts[0][0] in (b" ", b""):
                parts.pop(0)
        if not parts:
            return b"", [end]
        space = MARK if self.escape else b" "

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.dummy:
            put(space, parts[0][1])
        was_space = self.strip
        for new, source in parts:
            kept = new.lstrip(b" ") if was_space else new
            same = text.startswith(new, source) and new == kept
            for i in range(len(kept)):
                put(space if kept[i] == 32 else kept[i : i + 1], source + i * same)
            if kept or not self.strip:
                was_space = self.strip and kept.endswith(b" ")
        if self.strip:
            while out.endswith(space):
                end = align[len(out) - len(space)]
                del out[len(out) - len(space) :], align[len(out) :]
        align.append(end)
        return bytes(out), align


class OffsetEncoder:
    """ids, start and end byte of each piece, and the decoded text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        mark = MARK.decode()
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.cut_at_spaces = plain and not any(mark in p.piece.lstrip(mark) or p.type == 4 for p in model.pieces) and not model.trainer_spec.treat_whitespace_as_suffix
        self.widths = np.array([1 if p.type == 6 else len(p.piece.encode()) - 2 * p.piece.count(mark) for p in model.pieces], np.int32)
        self.lone_mark = self.library.piece_to_id(mark)
        self.unknown = self.library.unk_id()
        self.cache: ChunkCache = ChunkCache()

    def _learn(self, chunks: list[bytes]) -> None:
        self.cache.room(len(chunks))
        texts = [c.decode("utf-8", "replace") for c in chunks]
        for c, ids in zip(chunks, self.library.encode(texts, num_threads=1), strict=True):
            self.cache[c] = np.array(ids if c else [self.lone_mark], np.int32).tobytes()

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        """What stands between the marks that begin a run of characters; runs of spaces join what follows."""
        parts = text.split(b" ")
        if b"" not in parts:
            return parts
        chunks, held = [], 0
        for p in parts:
            if p:
                chunks.append(b" " * held + p)
                held = 0
            else:
                held += 1
        if held:
            chunks.append(b" " * (held - 1))
        return chunks

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not text:
            none = np.empty(0, np.int32)
            return none, none, none
        if not self.cut_at_spaces or MARK in text:
            return self._encode_whole(text)
        joined = self.cache.gather(self._chunks(text), self._learn)
        ids = np.frombuffer(joined, np.int32)
        if (ids == self.unknown).any():
            return self._encode_whole(text)
        width = self.widths[ids]
        ends = np.cumsum(width, dtype=np.int32) - 1  # the dummy prefix stands for no source byte
        starts = ends - width
        starts[0] = 0
        return ids, np.maximum(starts, 0), ends

    def _encode_whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = text.decode("utf-8", "replace")
        ids = np.array(self.library.encode(s), np.int32)
        pieces = self.library.encode(s, out_type=str)
        normal, align = self.normalizer.normalize(s.encode())
        lengths = [1 if self.library.is_byte(i) else len(p.encode()) for i, p in zip(ids.tolist(), pieces, strict=True)]
        cuts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        if cuts[-1] != len(normal):
            raise ValueError("the pieces don't cover the normalised text")
        offsets = np.array(align, np.int32)[cuts]
        return ids, offsets[:-1], offsets[1:]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, starts, ends, decoded): piece i covers source bytes starts[i] up to ends[i].

    Null texts count as empty and give empty arrays and an empty decoded text; null ids are kept, repeated
    rows are encoded each, an empty table gives no rows, other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = loaded(OffsetEncoder, model)
        got = [encoder.encode(t) for t in batch.column(1).to_pylist()]
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.empty(0, np.int32), *(g[k] for g in got)]))) for k in range(3)]
        decoded = [encoder.library.decode(g[0].tolist()) for g in got]
        return pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(decoded, pa.string())], ["id", "ids", "starts", "ends", "decoded"])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")), run, SCHEMA, rows=128)
