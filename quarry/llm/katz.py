"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights, per-token scores.

Texts become tokens and one end token.  With c counts over training texts, d Good-Turing discounts of counts
up to five (one above), and r = 0.5 a reserve so that no history leaves nothing for what it has not seen:

    P(w)   = d(c(w)) c(w) / (N + r) for a word of the training texts; what is left over is P(unknown)
    P(w|h) = d(c(hw)) c(hw) / (c(h) + r) if c(hw) > 0, else a(h) P(w)
    a(h)   = (1 - sum of P(w|h) over seen w) / (1 - sum of P(w) over seen w), or 1 for a history without counts

Text travels in packed rows, so that Spark shuffles a few large rows instead of one per token:

    texts, by chunk        compressed; chunks are dealt by content and hold about 16 MB of text
    word counts, by word   a chunk's distinct words and counts -> totals, and each chunk's totals back to it
    bigrams, by history    a chunk's distinct bigrams with word totals and the documents that hold them
    model, by history      bigram counts, figures for a(h), and for each document the sums that don't need
                           the discounts; written as a table partitioned by kind
    sums, by chunk         each history bucket's part of each document's score

A history that is too frequent for one bucket is split over buckets by the word that follows; its figures are
added up afterwards.  There are at most as many such histories as buckets.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import fold, materialize, text_bytes

CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 20 << 20
TOP = 5
RESERVE = 0.5
END = np.uint64(xxhash.xxh64_intdigest(b"\nend", 7))
BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\nbegin", 7))
LOW = np.uint64((1 << 48) - 1)
MODEL = "kind string, bucket long, chunk long, n_rows long, figures array<long>, blob binary, weights binary"


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), a.nbytes)], np.int64)
    return zstandard.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), level)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for kind, size in head:
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, size // dtype.itemsize, at))
        at += size
    return out


def _release() -> None:
    """Give back what earlier groups of this worker held, before the next one is unpacked."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def _six(x: np.ndarray) -> np.ndarray:
    """The low six bytes of each hash."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def _from_six(x: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), np.uint8)
    wide[:, :6] = x.reshape(-1, 6)
    return wide.view("<u8").ravel()


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds all values."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 1 << 32 else np.uint64)


def _range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of hashes each one is in."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_HASHES = _Hashes()


def _tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's tokens, the end token last."""
    words = text.lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = [_HASHES[w] for w in words]
    out[-1] = END
    return out


def _read_chunk(t: pa.Table):
    """ids (masked), training flags, tokens of all texts, and each text's number of tokens; in a fixed order."""
    parts = []
    for blob in t.column("blob").to_pylist():
        ids, given, train, lengths, text = _unpack(blob)
        text, ends = text.tobytes(), np.cumsum(lengths, dtype=np.int64)
        parts += [(int(g), int(i), int(k), text[e - n : e]) for i, g, k, n, e in zip(ids, given, train, lengths, ends.tolist(), strict=True)]
    parts.sort()
    tokens = [_tokens(p[3]) for p in parts]
    lengths = np.array([len(x) for x in tokens], np.int64)
    return np.array([p[1] for p in parts], np.int64), np.array([p[0] for p in parts], bool), np.array([p[2] for p in parts], bool), np.concatenate(tokens), lengths


def _text_rows(docs: DataFrame, id_col: str, text_col: str, chunks: int, learn) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), learn.cast("int").alias("train"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))

    def run(batches):
        for batch in batches:
            ids, texts, train, chunk = (batch.column(k) for k in range(4))
            given = np.array([i.is_valid for i in ids], np.uint8)
            ids, texts, train, chunk = ids.fill_null(0).to_numpy(), texts.to_pylist(), train.to_numpy(), chunk.to_numpy()
            out = []
            for c in np.unique(chunk).tolist():
                own = np.flatnonzero(chunk == c)
                lengths = np.array([len(texts[i]) for i in own.tolist()], np.uint32)
                out.append((c, _pack(ids[own], given[own], train[own].astype(np.uint8), lengths, np.frombuffer(b"".join(texts[i] for i in own.tolist()), np.uint8), level=9)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["chunk", "blob"])

    return rows.select("id", "text", "train", "chunk").mapInArrow(run, "chunk long, blob binary")


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _word_counts(parts: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _release()
        _, _, train, tokens, lengths = _read_chunk(t)
        words, place = np.unique(tokens, return_inverse=True)
        counts = np.bincount(place[np.repeat(train, lengths)], minlength=len(words))
        cuts = np.searchsorted(_range_of(words, parts), np.arange(parts + 1))
        rows = [(b, key[0].as_py(), _pack(words[lo:hi], _small(counts[lo:hi]))) for b, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False))]
        return _table(rows, ["bucket", "chunk", "blob"], [pa.int64(), pa.int64(), pa.binary()])

    return run


def _word_totals(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Totals of a range of words, to each chunk in the chunk's order; and the totals themselves as chunk -1 - bucket."""
    bucket = key[0].as_py()
    chunks = t.column("chunk").to_pylist()
    parts = [_unpack(b) for b in t.column("blob").to_pylist()]
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(place, np.concatenate([p[1].astype(np.int64) for p in parts]), minlength=len(words)).astype(np.int64)
    rows, at = [], 0
    for chunk, (own, _) in zip(chunks, parts, strict=True):
        rows.append((chunk, bucket, _pack(_small(total[place[at : at + len(own)]]))))
        at += len(own)
    known = total > 0
    rows.append((-1 - bucket, bucket, _pack(words[known], _small(total[known]))))
    return _table(rows, ["chunk", "bucket", "totals"], [pa.int64(), pa.int64(), pa.binary()])


def _bigram_rows(parts: int, hot_from: float):
    """Cogrouped texts and totals of a chunk -> packed rows by history bucket; word totals pass through."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["bucket", "chunk", "kind", "blob"], [pa.int64(), pa.int64(), pa.string(), pa.binary()]
        right = right.sort_by("bucket")
        totals = right.column("totals").to_pylist()
        chunk = key[0].as_py() if key[0].is_valid else right.column("chunk")[0].as_py()
        if not left.num_rows:
            return _table([(b, chunk, "words", blob) for b, blob in zip(right.column("bucket").to_pylist(), totals, strict=True)], names, kinds)
        _release()
        ids, given, train, tokens, lengths = _read_chunk(left)
        del left
        words, place = np.unique(tokens, return_inverse=True)
        count = np.concatenate([_unpack(b)[0] for b in totals]).astype(np.int64)
        del tokens
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        c = count[place]
        known = np.bincount(doc, c > 0, minlength=len(lengths)).astype(np.int64)
        logs = np.bincount(doc, np.log10(c + 0.5), minlength=len(lengths))
        del c
        rows = [(chunk % parts, chunk, "documents", _pack(ids, given.view(np.uint8), train.view(np.uint8), lengths, known, logs))]
        n = len(words)
        pair = np.empty(len(place), np.int64)
        pair[1:] = place[:-1]
        pair[np.cumsum(lengths) - lengths] = n  # the beginning, after all words
        pair *= n + 1
        pair += place
        del place
        order = np.argsort(pair, kind="stable")
        pair, docs_of = pair[order], doc[order]
        del order, doc
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        times = np.diff(np.append(first, len(pair)))
        h, w = np.divmod(pair[first], n + 1)
        del pair
        hashes = np.append(words, BEGIN)
        counts = np.append(count, 0)
        hot = (counts[h] >= hot_from) | (h == n)
        bucket = np.where(hot, _range_of(hashes[w], parts), _range_of(hashes[h], parts))
        for b in range(parts):
            own = np.flatnonzero(bucket == b)
            if not len(own):
                continue
            hs, h_at = np.unique(h[own], return_index=True)
            ws, w_place = np.unique(w[own], return_inverse=True)
            n_own = times[own]
            occ = docs_of[np.repeat(first[own] - np.cumsum(n_own) + n_own, n_own) + np.arange(int(n_own.sum()))]
            blob = _pack(
                _six(hashes[hs]), _small(counts[hs]), _small(np.diff(np.append(h_at, len(own)))), (hot[own][h_at]).view(np.uint8), _six(hashes[ws]), _small(counts[ws]),
                _small(w_place), _small(n_own), _small(occ), train.view(np.uint8),
            )
            rows.append((b, chunk, "bigrams", blob))
        return _table(rows, names, kinds)

    return run


def _model_rows(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """A history bucket's model: counts, figures per history, sums per document; other rows pass through.

    figures: for words and bigrams how many types have each count 1 to 6, then tokens and types.
    """
    names = ["kind", "bucket", "chunk", "n_rows", "figures", "blob", "weights"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    _release()
    bucket, rows, chunks, blobs = key[0].as_py(), [], [], []
    for kind, chunk, blob in zip(t.column("kind").to_pylist(), t.column("chunk").to_pylist(), t.column("blob").to_pylist(), strict=True):
        if kind == "words":
            counts = _unpack(blob)[1].astype(np.int64)
            rows.append((kind, bucket, chunk, len(counts), _figures(counts), blob, None))
        elif kind == "documents":
            rows.append((kind, bucket, chunk, len(_unpack(blob)[0]), None, blob, None))
        else:
            chunks.append(chunk)
            blobs.append(blob)
    if blobs:
        rows += _merge(bucket, chunks, blobs)
    return _table(rows, names, kinds)


def _figures(counts: np.ndarray) -> list[int]:
    return [*np.bincount(np.minimum(counts, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist(), int(counts.sum()), len(counts)]


def _merge(bucket: int, chunks: list[int], blobs: list[bytes]) -> list[tuple]:
    order = np.argsort(np.array(chunks), kind="stable").tolist()
    h_all, w_all, meta = [], [], []
    for i in order:
        a = _unpack(blobs[i])
        h_all.append((_from_six(a[0]), a[1].astype(np.int64), a[3].copy()))
        w_all.append((_from_six(a[4]), a[5].astype(np.int64)))
        meta.append((chunks[i], *(x.copy() for x in (a[2], a[6], a[7], a[8], a[9]))))
        blobs[i] = None
        del a
    hs, h_first, h_place = np.unique(np.concatenate([x[0] for x in h_all]), return_index=True, return_inverse=True)
    ws, w_first, w_place = np.unique(np.concatenate([x[0] for x in w_all]), return_index=True, return_inverse=True)
    c_h = np.concatenate([x[1] for x in h_all])[h_first]
    hot = np.concatenate([x[2] for x in h_all])[h_first]
    c_w = np.concatenate([x[1] for x in w_all])[w_first]
    keys = np.empty(sum(len(m[2]) for m in meta), np.int64)
    seen = np.empty(len(keys), np.int32)  # how often training texts of the chunk have the bigram
    at = at_h = at_w = 0
    for (own_h, _, _), (own_w, _), (_, per, w, n, occ, train) in zip(h_all, w_all, meta, strict=True):
        own = slice(at, at + len(w))
        keys[own] = np.repeat(h_place[at_h : at_h + len(own_h)], per) * len(ws) + w_place[at_w : at_w + len(own_w)][w]
        seen[own] = np.bincount(np.repeat(np.arange(len(n)), n), train.astype(bool)[occ], minlength=len(n))
        at, at_h, at_w = at + len(w), at_h + len(own_h), at_w + len(own_w)
    del h_all, w_all, h_place, w_place
    pair, place = np.unique(keys, return_inverse=True)
    del keys
    place = place.astype(np.int32)
    count = np.bincount(place, seen, minlength=len(pair)).astype(np.int64)
    del seen
    h, w = np.divmod(pair, len(ws))
    del pair
    # Figures of each history: types of each low count, tokens above, and the same of the words that follow.
    low = (count > 0) & (count <= TOP)
    stats = np.zeros((len(hs), 2 * TOP + 2), np.int64)
    np.add.at(stats, (h[low], count[low] - 1), 1)
    np.add.at(stats[:, TOP], h[count > TOP], count[count > TOP])
    low = (count > 0) & (c_w[w] <= TOP)
    np.add.at(stats, (h[low], TOP + c_w[w][low]), 1)
    high = (count > 0) & (c_w[w] > TOP)
    np.add.at(stats[:, -1], h[high], c_w[w][high])
    begin = hs == (BEGIN & LOW)
    rows = [("bigrams", bucket, -1, int((count > 0).sum()), _figures(count[count > 0]), _pack(_six(hs), _small(c_h), hot, _six(ws), _small(h[count > 0]), _small(w[count > 0]), _small(count[count > 0])), _pack(_six(hs), c_h, hot, stats.ravel(), begin.view(np.uint8)))]
    at = 0
    for chunk, _, _, n, occ, train in meta:
        own = place[at : at + len(n)]
        at += len(n)
        which = np.repeat(own, n)
        docs = len(train)
        c, u, hh = count[which], c_w[w[which]], h[which]
        sums = np.bincount(occ, np.where(c > TOP, np.log10(np.maximum(c, 1)), 0) + np.where((c > 0) & (c <= TOP), np.log10(np.maximum(c, 1)), 0), minlength=docs)
        sums += np.bincount(occ, np.where((c == 0) & (u > 0), np.log10(np.maximum(u, 1)), 0), minlength=docs)
        class_c = np.bincount(occ[c > 0] * (TOP + 2) + np.minimum(c[c > 0], TOP + 1), minlength=docs * (TOP + 2)).reshape(docs, -1)[:, 1:]
        class_u = np.bincount(occ[c == 0] * (TOP + 2) + np.minimum(u[c == 0], TOP + 1), minlength=docs * (TOP + 2)).reshape(docs, -1)
        # Histories whose weights the documents still need: with c(h) where seen, with a(h) where not.
        pairs, times_of = np.unique((hh * docs + occ) * 2 + (c > 0), return_counts=True)
        plain = pairs[(pairs & 1) == 1], times_of[(pairs & 1) == 1]
        log_ch = np.zeros(docs)
        special = hot[plain[0] // 2 // docs].astype(bool) & begin[plain[0] // 2 // docs]
        hp, dp = np.divmod(plain[0] // 2, docs)
        np.add.at(log_ch, dp[~special], -np.log10(c_h[hp[~special]] + RESERVE) * plain[1][~special])
        later = np.zeros(docs, np.int64)  # after the beginning, whose count is the number of training texts
        np.add.at(later, dp[special], plain[1][special])
        back, back_n = pairs[(pairs & 1) == 0] // 2, times_of[(pairs & 1) == 0]
        back_h, back_d = np.divmod(back, docs)
        rows.append(("sums", bucket, chunk, docs, None, _pack(sums + log_ch, _small(class_c.ravel()), _small(class_u.ravel()), _small(later), _small(np.diff(back_h, prepend=0)), _small(back_d), _small(back_n)), None))
    return rows


def discounts(types: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 0 (unused) to TOP + 1 from how many types have each count 1 to TOP + 1.

    Katz's correction makes the discounted mass n1 in all.  Where the counts of counts give no discount
    strictly between 0 and 1 (small or odd corpora), 0.5 is taken off the count instead.
    """
    d = np.ones(TOP + 2)
    common = (TOP + 1) * types[TOP] / types[0] if types[0] else 1.0
    for r in range(1, TOP + 1):
        value = -1.0
        if types[r - 1] and common < 1:
            value = ((r + 1) * types[r] / types[r - 1] / r - common) / (1 - common)
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


class Constants:
    """What scoring needs of the whole corpus."""

    def __init__(self, words: list[int], bigrams: list[int], texts: int, hot: dict[int, tuple]):
        self.tokens, self.types, self.texts = words[-2], words[-1], texts
        self.d1, self.d2, self.hot = discounts(words), discounts(bigrams), hot
        rising = np.arange(1, TOP + 1)
        low = np.array(words[:TOP])
        kept = float(self.tokens) - float((low * rising * (1 - self.d1[1 : TOP + 1])).sum())
        self.unknown = 1 - kept / (self.tokens + RESERVE)

    def log_weight(self, c_h: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """log10 of the back-off weight of histories from their counts and figures."""
        rising = np.arange(1, TOP + 1)
        seen = (stats[:, :TOP] * rising * self.d2[1 : TOP + 1]).sum(1) + stats[:, TOP]
        under = (stats[:, TOP + 1 : 2 * TOP + 1] * rising * self.d1[1 : TOP + 1]).sum(1) + stats[:, -1]
        weight = (1 - seen / (c_h + RESERVE)) / np.maximum(1 - under / (self.tokens + RESERVE), 1e-300)
        return np.where(c_h > 0, np.log10(weight), 0.0)


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The model table over all texts; counts come from rows where the condition `learn` holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count("*").alias("n")).first()
    total = (size.b or 0) + size.n
    chunks = max(1, -(-total // CHUNK_BYTES))
    parts = max(1, min(-(-total // BUCKET_BYTES), 1 << 20))
    texts = _text_rows(docs, id_col, text_col, chunks, F.coalesce(learn, F.lit(False)))
    counts = texts.groupBy("chunk").applyInArrow(_word_counts(parts), "bucket long, chunk long, blob binary")
    totals = counts.groupBy("bucket").applyInArrow(_word_totals, "chunk long, bucket long, totals binary")
    hot_from = max(1000.0, total / 7 / parts)
    bigrams = texts.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_bigram_rows(parts, hot_from), "bucket long, chunk long, kind string, blob binary")
    return materialize(bigrams.groupBy("bucket").applyInArrow(_model_rows, MODEL), "katz")


def constants(model: DataFrame) -> Constants:
    """Counts of counts, sizes, and the figures of the split histories (at most as many as buckets)."""
    parts = [F.sum(F.element_at("figures", k + 1)).alias(f"f{k}") for k in range(TOP + 3)]
    got = {r.kind: list(r)[1:] for r in model.where("figures is not null").groupBy("kind").agg(*parts).collect()}
    none = [0] * (TOP + 3)

    def hot_rows(batches):
        for batch in batches:
            rows = []
            for blob in batch.column(0).to_pylist():
                h, c, hot, stats, begin = _unpack(blob)
                h, stats = _from_six(h), stats.reshape(len(c), -1)
                rows += [(int(h[i]), int(c[i]), int(begin[i]), stats[i].tolist()) for i in np.flatnonzero(hot).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["h", "c", "begin", "stats"])

    split = model.where("kind = 'bigrams'").select("weights").mapInArrow(hot_rows, "h long, c long, begin long, stats array<long>")
    split = split.groupBy("h").agg(F.max("c").alias("c"), F.max("begin").alias("begin"), *[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(2 * TOP + 2)])

    def trained(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(_unpack(b)[2].sum()) for b in batch.column(0).to_pylist()], pa.int64())], ["n"])

    texts = model.where("kind = 'documents'").select("blob").mapInArrow(trained, "n long").agg(F.sum("n")).first()[0] or 0
    hot = {r.h: (texts if r.begin else r.c, [r[f"s{k}"] for k in range(2 * TOP + 2)]) for r in split.collect()}
    return Constants(got.get("words", none), got.get("bigrams", none), texts, hot)


def score(model: DataFrame, known: Constants) -> DataFrame:
    """(id, learnt, n_tokens, n_known, base_score, score) for every text of the model table."""
    d1, d2 = np.log10(known.d1), np.log10(known.d2)
    log_n, log_texts = np.log10(known.tokens + RESERVE), np.log10(known.texts + RESERVE)
    log_unknown = np.log10(max(known.unknown, 1e-300))
    # What a token adds by the class of its count: unseen words are unknown, others P(w) without its log c.
    by_word = np.array([log_unknown, *(d1[1 : TOP + 1] - log_n), -log_n])
    hot_keys = np.array(sorted(known.hot), np.uint64)
    hot_c = np.array([known.hot[int(k)][0] for k in hot_keys.tolist()], np.int64)
    hot_stats = np.array([known.hot[int(k)][1] for k in hot_keys.tolist()], np.int64).reshape(len(hot_keys), 2 * TOP + 2)
    hot_log = known.log_weight(hot_c, hot_stats)

    def parts(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        weights = [b for b in t.column("weights").to_pylist() if b]
        rows = []
        if weights:
            h, c, hot, stats, _ = _unpack(weights[0])
            h, hot = _from_six(h), hot.astype(bool)
            log_a = known.log_weight(c, stats.reshape(len(c), -1))
            if hot.any():
                log_a = log_a.copy()
                log_a[hot] = hot_log[np.searchsorted(hot_keys, h[hot])]
        for kind, chunk, n, blob in zip(t.column("kind").to_pylist(), t.column("chunk").to_pylist(), t.column("n_rows").to_pylist(), t.column("blob").to_pylist(), strict=True):
            if kind != "sums":
                continue
            sums, class_c, class_u, later, steps, back_d, back_n = _unpack(blob)
            total = sums + class_c.reshape(n, -1) @ d2[1:] + class_u.reshape(n, -1) @ by_word - later * log_texts
            back_h = np.cumsum(steps.astype(np.int64))
            total += np.bincount(back_d.astype(np.int64), log_a[back_h] * back_n, minlength=n)
            rows.append((chunk, "sums", total.tobytes()))
        return _table(rows, ["chunk", "kind", "blob"], [pa.int64(), pa.string(), pa.binary()])

    # Of the bigram rows only the weights are needed; their counts stay where they are.
    needed = model.where("kind in ('bigrams', 'sums')").withColumn("blob", F.when(F.col("kind") == "sums", F.col("blob"))).select("kind", "bucket", "chunk", "n_rows", "blob", "weights")
    sums = needed.groupBy("bucket").applyInArrow(parts, "chunk long, kind string, blob binary")
    texts = model.where("kind = 'documents'").select("chunk", "kind", "blob")
    width = np.log10(known.tokens + 0.5 * (known.types + 1))

    def gather(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        ids, given, train, lengths, n_known, logs = _unpack(blobs[kinds.index("documents")])
        total = np.sum([np.frombuffer(b) for k, b in sorted(zip(kinds, blobs, strict=True)) if k == "sums"], axis=0)
        return pa.table({
            "id": pa.array(ids, mask=given == 0), "learnt": pa.array(train.astype(bool)), "n_tokens": pa.array(lengths), "n_known": pa.array(n_known),
            "base_score": pa.array(logs - lengths * width), "score": pa.array(total),
        })

    return sums.unionByName(texts).groupBy("chunk").applyInArrow(gather, "id long, learnt boolean, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on rows where `learn` holds and score every row; adds train_tokens.

    Null texts count as empty: they are the end token alone.  Null ids stay null, repeated rows are counted
    and scored each, an empty table gives no rows.  Other columns are not read.
    """
    model = fit(docs, learn, id_col, text_col)
    known = constants(model)
    return score(model, known).withColumn("train_tokens", F.lit(known.tokens).cast("long"))


def held_out(id_col: str = "doc_id"):
    return fold(id_col) == 1
