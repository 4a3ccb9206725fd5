"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and a remainder; a remainder above `piece` tokens is cut further,
and a remainder of some length gives off two crumbs, of about 100 and 25 tokens.  Differencing evens out windows by
the small items that it meets last, so the crumbs bring padding from about 8 % down to about 1 %.
Full pieces are windows of their own.  The rest are dealt to buckets of about `bucket_pieces` pieces;
in a bucket the differencing method splits them over the fewest windows that could hold them: two partial
partitions, the ones with the largest imbalance, are merged with opposing order until one is left, and
the number of windows rises until none of them is over capacity.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.chunked import WordPieces, loaded, uncollected
from quarry.llm.common import map_rows, materialize, text_bytes

CAPACITY = 2048
PIECE = 1024
BUCKET_PIECES = 2000
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, spread long"


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Window of each item and the largest sum: Karmarkar-Karp's differencing method for any number of windows.

    A partial partition holds only its non-empty windows, by falling sum, and what all windows have in
    common is taken off; its imbalance is then its largest sum.  Merged windows are nodes of a forest.
    """
    n = len(sizes)
    child = np.full((2 * n + 1, 2), -1, np.int64)
    nodes = n
    items = np.arange(n)
    heap = [(-s, i, sizes[i : i + 1], items[i : i + 1]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, sa, ma = heapq.heappop(heap)
        _, _, sb, mb = heapq.heappop(heap)
        over = len(sa) + len(sb) - windows
        if over <= 0:  # opposing order puts every item beside an empty window
            sums, members = np.concatenate([sa, sb]), np.concatenate([ma, mb])
        else:  # the smallest of one with the largest of the other
            keep, low = len(sa) - over, len(sb) - over
            new = np.arange(nodes, nodes + over)
            child[new, 0], child[new, 1] = ma[keep:], mb[low:][::-1]
            nodes += over
            sums = np.concatenate([sa[:keep], sb[:low], sa[keep:] + sb[low:][::-1]])
            members = np.concatenate([ma[:keep], mb[:low], new])
            if nodes + windows > len(child):
                child = np.concatenate([child, np.full_like(child, -1)])
        order = np.argsort(-sums, kind="stable")
        sums, members = sums[order], members[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, members))
        tie += 1
    window = np.full(nodes, -1, np.int64)
    if n:
        roots = heap[0][3]
        window[roots] = np.arange(len(roots))
    for k in range(nodes - 1, n - 1, -1):
        window[child[k]] = window[k]
    window = window[:n]
    return window, int(np.bincount(window, sizes).max()) if n else 0


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[np.ndarray]:
    """Items of each window, none over `capacity`; every size must be between 1 and capacity."""
    if not len(sizes):
        return []
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, worst = difference(sizes, windows)
        if worst <= capacity:
            order = np.argsort(window, kind="stable")
            return np.split(order, np.flatnonzero(np.diff(window[order])) + 1)
        windows += max(1, int(windows * (worst / capacity - 1) / 3))


def remainder_cuts(rest: int, piece: int = PIECE) -> list[int]:
    """Where the pieces of a remainder start: large ones of equal length, then the crumbs."""
    if not rest:
        return []
    crumbs = []
    for size in (48 + rest % 97, 12 + rest % 25):
        if rest - sum(crumbs) > 4 * size:
            crumbs.append(size)
    large = rest - sum(crumbs)
    k = -(-large // piece)
    cuts = [large * j // k for j in range(k)]
    for size in crumbs:
        cuts.append(large)
        large += size
    return cuts


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """Pieces of each document's ids (its text's, then the end id): where they start, their length and CRC-32.

    Every row has at least the end id, null and empty texts included.
    """

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = loaded(WordPieces, tokenizer)
        ids = batch.column(0).to_pylist()
        rows = []
        for k, (doc, got) in enumerate(zip(ids, encoder.encode(batch.column(1).to_pylist()), strict=True)):
            got += END_ID.to_bytes(4, "little")
            n = len(got) // 4
            full = n - n % capacity
            cuts = list(range(0, full, capacity))
            cuts += [full + c for c in remainder_cuts(n - full, piece)]
            cuts.append(n)
            for a, b in zip(cuts, cuts[1:], strict=False):
                crc = zlib.crc32(got[4 * a : 4 * b])
                rows.append((doc, a, b - a, crc, n, crc ^ (k << 32) ^ (a << 40)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        with uncollected():
            return cut(batch)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")), run, PIECES, rows=256)


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, bucket_pieces: int = BUCKET_PIECES
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces of a sequence lie side by side from offset 0.  A null text counts as empty and still has its end
    id; a null id is kept; repeated rows are packed once each; an empty table gives no rows.
    Pieces go to buckets by their own content, so a hot document or id spreads over all buckets.
    """
    pieces = materialize(token_pieces(docs, tokenizer, id_col, text_col, capacity, piece), "pieces")
    buckets = max(1, -(-pieces.count() // bucket_pieces))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(buckets)))

    def dealt_out(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("spread", "ascending")])
        size = table.column("length").to_numpy()
        full = np.flatnonzero(size == capacity)
        rest = np.flatnonzero(size < capacity)
        windows = [[i] for i in full.tolist()] + [rest[p].tolist() for p in pack(size[rest], capacity)]
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for w, members in enumerate(windows):
            sequence[members] = (key[0].as_py() << 32) + w
            offset[members] = np.cumsum(size[members]) - size[members]
        keep = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return keep.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        with uncollected():
            return dealt_out(key, table)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("bucket").applyInArrow(run, out)
