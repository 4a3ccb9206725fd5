"""Collocations from bidirectional BWT indexes: one index a shard of texts, phrases counted level by level over all shards.

A task cuts its texts into pieces and words, numbers the words of a language and, every SHARD words, stores an index: the
Burrows-Wheeler transforms of the shard's word sequence and of its reverse.  Contexts are sorted to the depth of the longest
phrase, so the interval of every phrase up to that length is the one a whole suffix array has.  A phrase is a pair of
intervals, one in each transform; extending it by a word to the right (left) takes the symbols inside its backward
(forward) interval, and the symbols below the new one move the other interval along.

Level by level: a shard extends its frequent phrases of k words, and keeps an extension whose last k words are frequent too; counts
are summed over LOT neighbouring shards in their task and over all lots by Spark, and a lot is told which of its phrases
are frequent.  Intervals aren't sent: a shard walks again from its words through the frequent phrases of each level.  A phrase
that reaches the least count does so in all its parts, so nothing is lost.  Indexes are written once by the tasks that build
them, bucketed by lot, and each level reads them from there without a shuffle.

Words and phrases are dealt by a hash to parts of about PART words of text.  A lot's phrases of one part are one row, sorted columns as
compressed byte planes; a part sums the rows of all lots, numbers its frequent phrases and answers each lot with the lot's own.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.llm.common import materialize, scratch

SHARD, LOT = 1 << 20, 4
LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Words of text to a part, and the least number of parts.
PART, PARTS = 1 << 20, 32
#: A table of at most so many languages is broadcast to the rows that ask for it; a larger one is joined by key.
BROADCAST = 1 << 20
#: Ends a piece; no word, as pieces are cut at it.
END = b"."
CUTS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", b"\n\n\n\n\n\n\n\n\n\n ")
TEXTS = 256


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of all texts, ASCII letters lower-cased, an END after each piece."""
    return b"\n".join([*texts, b""]).lower().translate(CUTS).replace(b"\n", b" . ").split()


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable argsort of whole numbers below 2**32, sixteen bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if values.size and values.max() > 0xFFFF:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The symbols before each place of a sequence, places sorted by their next `depth` symbols."""
    n = len(sequence)
    padded = np.concatenate([sequence, np.zeros(depth, sequence.dtype)])
    places = np.arange(n)
    for at in range(depth - 1, -1, -1):
        places = places[stable_order(padded[places + at])]
    return sequence[places - 1]


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, none below zero, as compressed byte planes; a column has as many planes as its largest number needs."""
    planes = [bytes([len(columns)])]
    for values in columns:
        wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
        width = (int(values.max(initial=0)).bit_length() + 7) // 8
        planes += [bytes([width]), len(values).to_bytes(8, "little"), wide[:, :width].T.tobytes()]
    return squeezed(b"".join(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw, columns = unsqueezed(blob), []
    at = 1
    for _ in range(raw[0]):
        width, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 9).reshape(width, n).T
        columns.append(wide.view("<i8").ravel())
        at += 9 + width * n
    return columns


class Side:
    """One transform with its last-to-first mapping."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, self.order = bwt, stable_order(bwt).astype(np.int32)
        self.first = np.empty(len(bwt), np.int32)
        self.first[self.order] = np.arange(len(bwt), dtype=np.int32)
        self.inner = np.zeros(len(bwt) + 1, np.int32)
        np.cumsum(bwt != 0, out=self.inner[1:])

    def extended(self, lows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by one word of disjoint intervals: (parent, symbol, low, count, symbols below it in the parent)."""
        parent = np.repeat(np.arange(len(lows), dtype=np.int32), counts)
        rows = np.arange(len(parent), dtype=np.int32) + np.repeat((lows - np.cumsum(counts) + counts).astype(np.int32), counts)
        inside = self.bwt[rows] != 0
        owner = np.full(len(self.bwt), -1, np.int32)
        owner[self.first[rows[inside]]] = parent[inside]
        places = np.flatnonzero(owner >= 0)
        owners, symbols = owner[places], self.bwt[self.order[places]]
        new = np.flatnonzero(np.concatenate([[True], (owners[1:] != owners[:-1]) | (symbols[1:] != symbols[:-1])])) if len(places) else places
        found, counted = owners[new], np.diff(np.append(new, len(places)))
        by = np.argsort(found, kind="stable")
        running = np.cumsum(counted[by]) - counted[by]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(found[by]) != 0])) if len(by) else by
        running -= np.repeat(running[starts], np.diff(np.append(starts, len(by))))
        below = np.empty(len(by), np.int64)
        below[by] = running
        return found, symbols[new], places[new], counted, below + np.bincount(parent[~inside], minlength=len(lows))[found]

    def extendable(self, lows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How many occurrences of each interval have a word, not a piece's end, beside them."""
        return self.inner[lows + counts] - self.inner[lows]


class Index:
    """Forward and backward transforms of one shard; a phrase is (low, back, count), its two intervals' starts and their length."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.forward, self.backward = Side(forward), Side(backward)

    @classmethod
    def of(cls, sequence: np.ndarray, depth: int = LONGEST) -> Index:
        return cls(transform(sequence, depth), transform(sequence[::-1], depth))

    def right(self, low: np.ndarray, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(parent, symbol, low, back, count) of every extension to the right."""
        parent, symbol, new, counted, below = self.backward.extended(back, counts)
        return parent, symbol, low[parent] + below, new, counted

    def left(self, low: np.ndarray, back: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(parent, symbol, low, back, count) of every extension to the left."""
        parent, symbol, new, counted, below = self.forward.extended(low, counts)
        return parent, symbol, new, back[parent] + below, counted


#: words: one a line, by symbol from 1; lows: the starts of their intervals, each as its distance from the one before.
SHARDS = "lot long, shard int, lang string, n long, length int, words binary, lows binary, forward binary, backward binary"


def _indexed(depth: int, size: int):
    """Rows (lang, text) of a task -> one index for each language and `size` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list[np.ndarray], list[int]]] = {}
        base, numbers = TaskContext.get().partitionId() << 33, count()

        def stored(lang: str) -> pa.RecordBatch:
            words, parts, _ = held.pop(lang)
            sequence = np.concatenate(parts)
            counts = np.bincount(sequence, minlength=len(words))
            by = np.append(0, 1 + np.argsort(-counts[1:], kind="stable"))  # the smaller numbers are, the smaller their planes
            symbols = np.empty(len(by), np.uint32)
            symbols[by] = np.arange(len(by))
            sequence, counts, named, number = symbols[sequence], counts[by], list(words), next(numbers)
            row = [base + number // LOT, number % LOT, lang, int(counts[1:].sum()), len(sequence), squeezed(b"\n".join([named[at] for at in by[1:].tolist()])), packed(counts[:-1]), packed(transform(sequence, depth)), packed(transform(sequence[::-1], depth))]
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [f.split(" ")[0] for f in SHARDS.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                own = defaultdict(list)
                for lang, text in zip(*[c.to_pylist() for c in batch.slice(at, TEXTS).columns], strict=True):
                    own[lang].append(text)
                for lang, texts in own.items():
                    if lang not in held:
                        number = defaultdict(count().__next__)
                        number[END]  # symbol 0
                        held[lang] = (number, [np.zeros(1, np.uint32)], [0])
                    number, parts, total = held[lang]
                    found = tokens(texts)
                    parts.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
                    total[0] += len(found)
                    if total[0] >= size:
                        yield stored(lang)
        for lang in list(held):
            yield stored(lang)

    return run


#: What a lot, or a shard of it, has of a part: words (one a line) and their counts, or phrases (prefix, suffix, n, and how often less a word stands before and after).
GRAMS = "part int, lot long, shard int, lang string, words binary, blob binary"
#: A part's answers to lots, and its frequent phrases (lot null).
SUMMED = "level int, part int, lot long, shard int, blob binary, lang string, word binary, prefix long, suffix long, f long, before long, after long, gram long"


def bound(function: Callable[..., pa.Table], tables: int, **given: int) -> Callable[..., pa.Table]:
    """A function of a group's key and its one or two tables, its keywords given; Spark takes no partial()."""

    def one(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        return function(key, own, **given)

    def two(key: tuple[pa.Scalar, ...], own: pa.Table, other: pa.Table) -> pa.Table:
        return function(key, own, other, **given)

    return one if tables == 1 else two


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def words_by_part(blob: bytes, parts: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A shard's words by symbol, from 0 here, their order by hash, and the places in it where parts begin, with its end."""
    raw = unsqueezed(blob)
    words = raw.split(b"\n") if raw else []
    hashes = np.fromiter(map(crc32, words), np.uint32, len(words))
    order = stable_order(hashes)
    return words, order, np.searchsorted(hashes[order].astype(np.int64) * parts >> 32, np.arange(parts + 1))


def part_of(prefix: np.ndarray, suffix: np.ndarray, parts: int) -> np.ndarray:
    mixed = (prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_pair(prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by prefix and suffix, places in it where a new pair begins)."""
    if max(prefix.max(initial=0), suffix.max(initial=0)) < 1 << 31:
        order = np.argsort(prefix << 32 | suffix, kind="stable")
    else:
        order = np.lexsort((suffix, prefix))
    prefix, suffix = prefix[order], suffix[order]
    return order, np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (suffix[1:] != suffix[:-1])])) if len(order) else order


def _worded(parts: int):
    """Rows of SHARDS -> the words of each part and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lot, shard, lang, length, blob, lows = (batch.column(c)[row].as_py() for c in ("lot", "shard", "lang", "length", "words", "lows"))
                words, order, starts = words_by_part(blob, parts)
                counts = np.diff(np.append(np.cumsum(unpacked(lows)[0]), length))
                own = [(part, order[a:b]) for part, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if a < b]
                yield from table_of(GRAMS, [(part, lot, shard, lang, squeezed(b"\n".join(map(words.__getitem__, o.tolist()))), packed(counts[o])) for part, o in own]).to_batches()

    return run


def steps(numbers: np.ndarray, parts: int) -> np.ndarray:
    """A part's numbers as steps from one to the next, those back odd."""
    step = np.diff(numbers // parts, prepend=0)
    return step << 1 ^ step >> 63


class Walk:
    """The frequent phrases of a lot, level by level, and their intervals in one of its shards after another."""

    def __init__(self, known: pa.Table, parts: int):
        self.parts, answers = parts, defaultdict(list)
        rows = sorted(zip(*[known.column(c).to_pylist() for c in ("level", "shard", "part")], range(known.num_rows), strict=True))
        for level, shard, part, row in rows:
            *others, steps = unpacked(known.column("blob")[row].as_py())
            numbers = np.cumsum(steps >> 1 ^ -(steps & 1)) * parts + part
            if level == 1:
                answers[level, shard].append(np.zeros(len(others[0]), np.int64))
                answers[level, shard][-1][others[0] > 0] = numbers + 1
            else:
                answers[level, shard].append((np.cumsum(others[0]), others[1], numbers))
        #: by shard, the numbers of its words in their order by hash, from 1; 0: not frequent
        self.words = {shard: np.concatenate(found) for (level, shard), found in answers.items() if level == 1}
        own = np.unique(np.concatenate(list(self.words.values())))
        self.grams, self.pairs = [own[own > 0] - 1], []
        for k in range(2, max(level for level, _ in answers) + 1):
            prefix, suffix, gram = (np.concatenate(c) for c in zip(*answers[k, None], strict=True)) if (k, None) in answers else np.zeros((3, 0), np.int64)
            keys = self.keyed(k - 1, prefix, suffix)
            by = np.argsort(keys)
            self.pairs.append((keys[by], gram[by]))
            self.grams.append(np.sort(gram))

    def keyed(self, k: int, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """One number for two phrases of k words, by their places among the lot's."""
        own = self.grams[k - 1]
        return np.searchsorted(own, prefix) * len(own) + np.searchsorted(own, suffix)

    def extensions(self, shard: int, words: bytes, lows: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
        """(prefix, suffix, low, back, count) of the extensions of the longest frequent phrases; lows: of all words, and the sequence's end."""
        order = words_by_part(words, self.parts)[1]
        numbers = np.zeros(len(order), np.int64)
        numbers[order] = self.words[shard] if len(order) else 0
        mine = np.flatnonzero(numbers)
        low, counts, gram = lows[mine], np.diff(lows)[mine], numbers[mine] - 1
        back = low
        for k in range(1, len(self.grams) + 1):
            by = np.argsort(back)
            low, back, counts, gram = low[by], back[by], counts[by], gram[by]
            parent, _, new_low, new_back, counted = index.right(low, back, counts)
            # read backwards, the new phrase begins with its last k words: their interval holds the new one
            last = np.searchsorted(back, new_back, side="right") - 1
            keep = (last >= 0) & (new_back < back[last] + counts[last])
            prefix, suffix, low, back, counts = gram[parent[keep]], gram[last[keep]], new_low[keep], new_back[keep], counted[keep]
            if k < len(self.grams):
                keys, grams = self.pairs[k - 1]
                wanted = self.keyed(k, prefix, suffix)
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                told = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                low, back, counts, gram = low[told], back[told], counts[told], grams[at[told]]
        return prefix, suffix, low, back, counts


def _extended(key: tuple[pa.Scalar, ...], index: pa.Table, known: pa.Table, *, level: int = 2, parts: int = PARTS) -> pa.Table:
    """One lot's frequent phrases of fewer than `level` words -> its phrases of `level` words with two frequent parts."""
    pairs, sums = [np.zeros((2, 0), np.int64)], [np.zeros((3, 0), np.int32)]
    if known.num_rows and pc.max(known.column("level")).as_py() == level - 1:  # numbers are unique in one level only
        walk = Walk(known, parts)
        for row in range(index.num_rows):
            shard, length, words, lows, *sides = (index.column(c)[row].as_py() for c in ("shard", "length", "words", "lows", "forward", "backward"))
            if shard not in walk.words:
                continue  # it has no words
            both = Index(*[unpacked(side)[0].astype(np.uint32) for side in sides])
            prefix, suffix, low, back, counts = walk.extensions(shard, words, np.append(np.cumsum(unpacked(lows)[0]), length), both)
            pairs.append(np.stack([prefix, suffix]))
            sums.append(np.stack([counts, counts - both.forward.extendable(low, counts), counts - both.backward.extendable(back, counts)]).astype(np.int32))
            del both
    pair, rows = np.concatenate(pairs, axis=1), np.concatenate(sums, axis=1)
    order, new = by_pair(*pair)
    rows = [np.add.reduceat(r[order].astype(np.int64), new) if len(new) else r for r in rows]
    pair = pair[:, order[new]]
    part = part_of(*pair, parts)
    by = np.argsort(part, kind="stable")
    columns, starts = [c[by] for c in (*pair, *rows)], np.searchsorted(part[by], np.arange(parts + 1))
    own = [(at, [c[a:b] for c in columns]) for at, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if a < b]
    return table_of(GRAMS, [(at, key[0].as_py(), None, None, None, packed(np.diff(c[0], prepend=0), *c[1:])) for at, c in own])


def _summed_words(key: tuple[pa.Scalar, ...], sent: pa.Table, *, least: int, parts: int) -> pa.Table:
    """All words of a part -> the frequent ones, numbered by hash, and for each shard which of its words they are, and their numbers."""
    part, out, numbers = key[0].as_py(), [], count(key[0].as_py(), parts)
    by_lang = defaultdict(list)
    for row, lang in enumerate(sent.column("lang").to_pylist()):
        by_lang[lang].append(row)
    for lang, rows in by_lang.items():
        lists = [unsqueezed(sent.column("words")[row].as_py()).split(b"\n") for row in rows]
        coded = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        place, counts = coded.indices.to_numpy(), np.concatenate([unpacked(sent.column("blob")[row].as_py())[0] for row in rows])
        f = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(f, place, counts)
        gram = np.full(len(f), -1)
        frequent = np.flatnonzero(f >= least)
        frequent = frequent[np.argsort([crc32(coded.dictionary[at].as_py()) for at in frequent.tolist()], kind="stable")]
        gram[frequent] = [next(numbers) for _ in frequent]
        out += [(1, part, None, None, None, lang, coded.dictionary[at].as_py(), None, None, int(f[at]), None, None, int(gram[at])) for at in frequent.tolist()]
        ends = np.cumsum([len(words) for words in lists])
        for row, told in zip(rows, np.split(gram[place], ends[:-1]), strict=True):
            out.append((1, part, sent.column("lot")[row].as_py(), sent.column("shard")[row].as_py(), packed(told >= 0, steps(told[told >= 0], parts)), *[None] * 8))
    return table_of(SUMMED, out)


def _summed(key: tuple[pa.Scalar, ...], sent: pa.Table, *, level: int, least: int, parts: int) -> pa.Table:
    """All phrases of a part -> the frequent ones, numbered, and for each lot its own (prefix, suffix, number)."""
    part = key[0].as_py()
    columns = [unpacked(blob) for blob in sent.column("blob").to_pylist()]
    ends = np.cumsum([len(c[0]) for c in columns])
    prefix, suffix, *rows = (np.concatenate(c) for c in zip(*[(np.cumsum(c[0]), *c[1:]) for c in columns], strict=True))
    order, new = by_pair(prefix, suffix)
    f, first, last = (np.add.reduceat(r[order], new) for r in rows)
    frequent = f >= least
    gram = np.full(len(f), -1)
    gram[frequent] = part + parts * np.arange(frequent.sum())
    told = np.empty(len(order), np.int64)
    told[order] = np.repeat(gram, np.diff(np.append(new, len(order))))
    at = order[new[frequent]]
    n = len(at)
    full = {"level": np.full(n, level, np.int32), "part": np.full(n, part, np.int32), "prefix": prefix[at], "suffix": suffix[at], "f": f[frequent], "before": (f - first)[frequent], "after": (f - last)[frequent], "gram": gram[frequent]}
    found = table_of(SUMMED, [])
    found = pa.table([pa.array(full[c.name]) if c.name in full else pa.nulls(n, c.type) for c in found.schema], found.schema)
    answers = []
    for lot, p, s, g in zip(sent.column("lot").to_pylist(), *[np.split(c, ends[:-1]) for c in (prefix, suffix, told)], strict=True):
        if (own := g >= 0).any():
            answers.append((level, part, lot, None, packed(np.diff(p[own], prepend=0), s[own], steps(g[own], parts)), *[None] * 8))
    return pa.concat_tables([found, table_of(SUMMED, answers)])


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shard: int = SHARD, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): every phrase of 1 to `longest` words that occurs `least` times in its language, and each language's words.

    phrases: (lang, phrase, words, f, before, after); before and after count the occurrences that a word of the same piece precedes or
    follows (null for single words).  totals: (lang, n).
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    name = f"phrases_{uuid.uuid4().hex}"
    rows.mapInArrow(_indexed(longest, shard), SHARDS).write.bucketBy(buckets, "lot").option("path", scratch(spark, "indexes")).option("compression", "zstd").saveAsTable(name)
    indexes = spark.table(name)
    totals = materialize(indexes.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    parts = max(PARTS, -(-(totals.agg(F.sum("n")).first()[0] or 0) // part))
    found, known = [], None
    for k in range(1, longest + 1):
        if k == 1:
            sent = indexes.select("lot", "shard", "lang", "length", "words", "lows").mapInArrow(_worded(parts), GRAMS)
            summed = sent.groupBy("part").applyInArrow(bound(_summed_words, 1, least=least, parts=parts), SUMMED)
        else:
            sent = indexes.select("lot", "shard", "length", "words", "lows", "forward", "backward").groupBy("lot").cogroup(known.groupBy("lot")).applyInArrow(bound(_extended, 2, level=k, parts=parts), GRAMS)
            summed = sent.select("part", "lot", "blob").groupBy("part").applyInArrow(bound(_summed, 1, level=k, least=least, parts=parts), SUMMED)
        summed = materialize(summed, "summed")
        told = summed.where("lot is not null").select("lot", "level", "shard", "part", "blob")
        known = told if known is None else known.unionAll(told)
        own = summed.where("lot is null")
        if k == 1:
            level = own.select("lang", F.col("word").cast("string").alias("phrase"), F.lit(1).alias("words"), "f", "before", "after", "gram").withColumn("last", F.col("phrase"))
        else:
            first = level.select(F.col("gram").alias("prefix"), "lang", "phrase")
            second = level.select(F.col("gram").alias("suffix"), "last")
            level = own.select("prefix", "suffix", "f", "before", "after", "gram").join(first, "prefix").join(second, "suffix")
            level = materialize(level.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.lit(k).alias("words"), "f", "before", "after", "last", "gram"), "frequent")
        found.append(level)
        if level.isEmpty():
            break
    spark.sql(f"drop table {name}")
    columns = ("lang", "phrase", "words", "f", "before", "after")
    out = found[0].select(*columns)
    for more in found[1:]:
        out = out.unionAll(more.select(*columns))
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, broadcast: int = BROADCAST, **build: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, before, after): each language's `top` phrases of 2 to `longest` words.

    Texts (null: empty) of a language (null: und) are lower-cased (A-Z) and cut into pieces at .,;:!? and line ends, pieces into words at
    spaces and tabs; phrases lie inside pieces.  A candidate occurs a >= `least` times.  Cut after its first words, which occur l times, its rest
    r times, and n words in the language, it scores floor(1000 a n / (l r)); its lowest cut counts, the shortest first part on ties.  A
    candidate inside a longer one that occurs at least `percent` % as often is dropped.  Order: score and a falling, phrase by its bytes.
    Arithmetic is in whole numbers of 38 digits.  Repeated rows count as often as they occur; empty tables and texts give no rows;
    other columns play no part.  Texts aren't cut: a shard is at least as large as its longest text.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, least, longest, **build)
    phrases = materialize(phrases, "phrases")
    candidates = phrases.where("words > 1")
    part = lambda at, size: F.array_join(F.slice("w", at, size), " ")
    split = candidates.withColumn("w", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    split = split.select("*", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("tail"))
    counted = phrases.select("lang", "phrase", "f")
    split = split.join(counted.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    split = split.join(counted.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(F.broadcast(totals) if totals.count() <= broadcast else totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    split = split.withColumn("over", (F.lit(1000).cast("decimal(38,0)") * whole("f")).cast("decimal(38,0)") * whole("n")).withColumn("under", whole("l") * whole("r"))
    split = split.withColumn("score", F.expr("cast(over as decimal(38,0)) div cast(under as decimal(38,0))"))
    scored = split.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "f", "before", "after")).alias("s"))
    # every phrase inside a longer candidate, with the count of the most frequent such candidate
    longer = candidates.where("words > 2").withColumn("w", F.split("phrase", " ")).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    longer = longer.groupBy("lang", part(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("s.f")))
    kept = kept.select("lang", "phrase", F.col("s.f").alias("a"), "s.l", "s.r", "s.n", "s.score", "s.before", "s.after")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "before", "after")
