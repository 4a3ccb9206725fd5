"""SimHash near-duplicate detection by a binary trie self-join.

A document's fingerprint is the bitwise majority over the hashes of its word shingles.  The bits are
dealt to `bands`; two documents are candidates if some band differs in at most `budget` bits, and are
linked if the whole fingerprints differ in at most `max_bits`.

The self-join walks pairs of trie nodes together, adds up the bits in which the two paths differ and
drops a pair as soon as the error budget is spent.  A band is cut into budget + 1 blocks; two values
within the budget agree on at least one block, so for each block the trie is rooted with that block's
bits on top and no error allowed in them.  That makes every value of the block a subtree of its own,
which is what Spark deals out.  A subtree above `node_limit` values is expanded further before the shuffle: its
next bits name the child, and a value is sent to each pair of children still within the budget that has two sides.

`near_copies` uses the join for candidates only and decides by the exact Jaccard similarity of the shingle sets.
Texts with many candidates are a crowd: their pairs come from a prefix join on their rarest shingles instead, which loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, materialize, text_bytes
from quarry.llm.components import components

SEED = 42
BLOCK = 1 << 14
NODE_LIMIT = 4096
BUCKET_ROWS = 250_000
MINS = 8
NEAR_LIMIT = 200_000
SET_BYTES = 512 << 10
ASKED_BYTES = 1 << 20
#: Nodes, two longs each, that `similar` may broadcast.
BROADCAST_ROWS = 1_000_000
#: A text with so many candidates under the first PROBE roots is one of a crowd.
PROBE, CROWD = 4, 4
#: Counters of a sketch of shingles, and how many of them a row holds.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Longs of a bit map of a set of shingles.
MAP = 16


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; A-Z in lower case, words cut at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def _mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits from a hash (splitmix64 finaliser); lane 0 is the hash itself."""
    if not lane:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * lane) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: bytes, shingle: int = 3, lanes: int = 1) -> bytes:
    """8 * lanes bytes, most significant first; all zero for a text without words."""
    return _majority(_shingle_hashes(text, shingle), lanes)


def _majority(h: np.ndarray, lanes: int) -> bytes:
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(h), BLOCK):
        part = h[at : at + BLOCK]
        for lane in range(lanes):
            bits = np.unpackbits(_mix(part, lane).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[lane] += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(id long, fp binary), one row per input row.  Null text is the empty text, whose fingerprint is zero;
    null ids stay null; other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle, lanes) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return map_rows(rows, run, "id long, fp binary")


def _words(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)


def _blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """Start and width of budget + 1 blocks that cover the band."""
    cuts = [round(i * bits / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _apart(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: the smallest index of each component."""
    while len(a):
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        differ = low != high
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(label, high[differ], low[differ])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def trie_links(keys: np.ndarray, task: np.ndarray, side: np.ndarray, words: np.ndarray, bits: int, budget: int, max_bits: int, leaf: int = 64, label: np.ndarray | None = None, found: list | None = None) -> np.ndarray:
    """Traverse the node pairs of some tasks; returns the component label (a row number) of each row.

    With `label` and `found`, labels are given and stay, and every pair within the limits whose labels
    differ goes to `found`.

    Rows come sorted by task, side and key.  A task of one side joins that subtree with itself, a task of
    sides 1 and 2 joins two subtrees.  Node pairs whose members all share a component already are dropped,
    as they can add no link that changes a component; so dense groups don't cost the square of their size.
    """
    n = len(keys)
    label = np.arange(n) if label is None else label
    if not n:
        return label
    starts = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (side[1:] != side[:-1])]))
    ends = np.append(starts[1:], n)
    own = side[starts] == 0
    paired = np.flatnonzero(~own[:-1] & (side[starts[:-1]] == 1) & (side[starts[1:]] == 2) & (task[starts[:-1]] == task[starts[1:]])) if len(starts) > 1 else np.empty(0, np.int64)
    for lo, hi in zip(starts[own].tolist(), ends[own].tolist(), strict=True) if found is None else ():  # a few pivots join most of a dense subtree
        left = np.arange(lo, hi)
        for _ in range(8):
            if len(left) <= leaf:
                break
            pivot = np.full(len(left), left[0])
            near = (np.bitwise_count(keys[left] ^ keys[pivot]) <= budget) & (_apart(words, left, pivot) <= max_bits)
            label = _settle(label, left[near], pivot[near])
            left = left[~near]
    turns = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    run_end = np.repeat(np.append(turns[1:], n), np.diff(np.append(turns, n)))
    a, b = np.concatenate([starts[own], starts[paired]]), np.concatenate([ends[own], ends[paired]])
    c, d = np.concatenate([starts[own], starts[paired + 1]]), np.concatenate([ends[own], ends[paired + 1]])
    err = np.zeros(len(a), np.int64)
    for depth in range(bits + 1):
        keep = (b > a) & (d > c) & (err <= budget) & ~((a == c) & (b - a < 2))
        a, b, c, d, err = a[keep], b[keep], c[keep], d[keep], err[keep]
        keep = ~((run_end[a] >= b) & (run_end[c] >= d) & (label[a] == label[c]))
        a, b, c, d, err = a[keep], b[keep], c[keep], d[keep], err[keep]
        small = ((b - a) * (d - c) <= leaf) | (depth == bits)
        label = _leaves(label, a[small], b[small], c[small], d[small], keys, words, budget, max_bits, found=found)
        a, b, c, d, err = a[~small], b[~small], c[~small], d[~small], err[~small]
        if not len(a):
            break
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        m, k = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        two = a != c
        a, b, c, d, err = (
            np.concatenate([a, m, a, m[two]]),
            np.concatenate([m, b, m, b[two]]),
            np.concatenate([c, k, k, c[two]]),
            np.concatenate([k, d, d, k[two]]),
            np.concatenate([err, err, err + 1, err[two] + 1]),
        )
    return label


def _leaves(label, a, b, c, d, keys, words, budget, max_bits, chunk: int = 1 << 18, found: list | None = None):
    """Compare the members of small node pairs one by one, a bounded number at a time."""
    size = (b - a) * (d - c)
    upto = np.cumsum(size)
    for lo in range(0, int(upto[-1]) if len(upto) else 0, chunk):
        flat = np.arange(lo, min(int(upto[-1]), lo + chunk))
        own = np.searchsorted(upto, flat, "right")
        row, col = np.divmod(flat - (upto - size)[own], (d - c)[own])
        i, j = a[own] + row, c[own] + col
        ok = (i < j) & (label[i] != label[j])
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        i, j = i[ok], j[ok]
        ok = _apart(words, i, j) <= max_bits
        if found is not None:
            found.append((i[ok], j[ok]))
        else:
            label = _settle(label, i[ok], j[ok])
    return label


def _plan(bands: int, bits: int, budget: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(bits of the root, bits of the key, depth where the root ends in the key) of each block of each band."""
    out = []
    for band in range(bands):
        for start, width in _blocks(bits, budget):
            key = band * bits + (np.arange(bits) + start) % bits
            out.append((key[:width], key, width))
    return out


def _tables(root: int, tables: int, width: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """`tables` draws of `root` bits that must agree and of 64 further bits that are compared."""
    rng = np.random.default_rng(seed)
    draws = [rng.permutation(width) for _ in range(tables)]
    return [(d[:root], d[root : root + 64], 0) for d in draws]


class _Partners:
    """Takes the place of `found` in trie_links: how many pairs each row is in, not the pairs."""

    def __init__(self, n: int):
        self.count = np.zeros(n, np.int64)

    def append(self, pairs: tuple[np.ndarray, np.ndarray]) -> None:
        for rows in pairs:
            self.count += np.bincount(rows, minlength=len(self.count))


def _subtrees(distinct: DataFrame, plan: list, whole: bool, labelled: bool) -> DataFrame:
    """(node, fp) -> one row per subtree: the task that the root's bits name, the key to descend by, its depth there.

    whole: take the whole fingerprint along, for a limit on all its bits.
    """

    def top64(grid: np.ndarray, columns: np.ndarray) -> np.ndarray:
        packed = np.packbits(grid[:, columns], axis=1)
        wide = np.zeros((len(grid), 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        return wide.view(">u8").ravel().astype(np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, fps = batch.num_rows, batch.column(1).to_pylist()
        grid = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(n, -1), axis=1)
        task = [_mix(top64(grid, root), 1 + k).view(np.int64) for k, (root, _, _) in enumerate(plan)]
        keys = [top64(grid, key).view(np.int64) for _, key, _ in plan]
        depth = np.repeat(np.array([d for _, _, d in plan], np.int32), n)
        take = pa.array(np.tile(np.arange(n), len(plan)))
        fp = batch.column(1).take(take) if whole else pa.nulls(n * len(plan), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), fp, pa.array(np.concatenate(keys)), pa.array(np.concatenate(task)), pa.array(depth)], ["node", "label", "fp", "key", "task", "depth"])

    label = F.col("label") if labelled else F.lit(0).cast("long").alias("label")
    rows = map_rows(distinct.select("node", "fp", label), run, "node long, label long, fp binary, key long, task long, depth int", rows=2048)
    return rows.select("*", F.lit(0).alias("side"), F.lit(0).alias("err"))


def _expand(hot: DataFrame, budget: int, limit: int, bits: int) -> DataFrame:
    """Replace node pairs by the pairs of their descendants that are still within the budget and have both sides.

    One descends by as many bits as it takes for children of half the limit (hot has `n`, a task's rows), so a
    value goes to about as many pairs as its task was too large, and pairs that lack a partner aren't kept.
    """
    step = F.least(F.lit(8), F.lit(bits) - F.col("depth"), F.ceil(F.log2(F.col("n") / limit)).cast("int") + 1)
    child = F.call_function("shiftrightunsigned", F.col("key"), F.lit(64) - F.col("step") - F.col("depth")).bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("step")) - 1)
    wide = hot.withColumn("step", step.cast("int")).withColumn("own", child)
    masks = F.sequence(F.lit(0).cast("long"), (F.call_function("shiftleft", F.lit(1), F.col("step")) - 1).cast("long"))
    wide = wide.withColumn("mask", F.explode(F.filter(masks, lambda m: F.bit_count(m) <= F.lit(budget) - F.col("err"))))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mask") == 0, F.lit(0)).when(F.col("own") < other, F.lit(1)).otherwise(F.lit(2))
    wide = wide.withColumn("other", other).withColumn("side2", side)
    left = F.when(F.col("side2") == 2, F.col("other")).otherwise(F.col("own"))
    right = F.when(F.col("side2") == 2, F.col("own")).otherwise(F.col("other"))
    wide = wide.select(
        "node", "label", "fp", "key", F.xxhash64("task", left, right).alias("task"), (F.col("depth") + F.col("step")).cast("int").alias("depth"),
        F.col("side2").alias("side"), (F.col("err") + F.bit_count("mask")).cast("int").alias("err"),
    )
    both = wide.groupBy("task").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.count("*").alias("n"))
    both = both.where("(low = 0 and n > 1) or (low = 1 and high = 2)").select("task")
    return wide.join(both, "task", "left_semi")


def _deal_out(hot: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Subtrees that one label dominates: (its rows dealt to salted tasks, the rows of all others in each of those).

    Rows of one label need no comparison with each other, so this loses none and copies only the others.
    hot: rows with `n`, their task's rows.  The second result are the hot rows of all other tasks.
    """
    share = hot.where("side = 0").groupBy("task", "label").agg(F.count("*").alias("m"), F.first("n").alias("all"))
    most = share.where("2 * m > all").select("task", F.col("label").alias("main"), F.ceil(F.col("m") / limit).cast("long").alias("salts"))
    most = materialize(most, "dominated")
    rows = hot.join(most, "task")
    salt = F.when(F.col("label") == F.col("main"), F.array(F.pmod(F.xxhash64("node"), F.col("salts")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    rows = rows.withColumn("salt", F.explode(salt)).withColumn("task", F.xxhash64("task", "salt"))
    return rows.drop("main", "salts", "salt", "n"), hot.join(most, "task", "left_anti")


def trie_self_join(
    distinct: DataFrame, bands: int = 1, bits: int = 64, budget: int = 2, max_bits: int | None = None, node_limit: int = NODE_LIMIT, labelled: bool = False, tables: list | None = None, counted_only: bool = False
) -> DataFrame:
    """Links among distinct fingerprints: (node long, fp binary) -> (u, v), enough of them to connect
    every two nodes that are connected by links.  Rows with equal nodes or fingerprints must not occur.

    labelled: a column label, long, names groups, and all links between nodes of different labels come, maybe repeatedly.
    tables: roots and keys in place of the bands' blocks (see _tables); links are then pairs within the budget in a key.
    max_bits: a limit on all bits of the fingerprint; None for none but the budget.
    counted_only: with labels, (node, partners) in place of links: in how many pairs a subtree has a node, one row a subtree.
    """
    spark = distinct.sparkSession
    plan = tables or _plan(bands, bits, budget)
    whole = max_bits is not None and (bool(tables) or bands > 1 or bits < 64 or max_bits != budget)
    rows = _subtrees(distinct, plan, whole, labelled)
    total = distinct.count()
    # Which tasks are too large is a matter of balance alone: large limits are measured on one value in `every`.
    every = max(1, node_limit // NODE_LIMIT)
    counted = _subtrees(distinct.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0), plan, whole, labelled)
    done = None
    for _ in range(bits if total > node_limit else 0):
        hot = counted.groupBy("task").agg((F.count("*") * every).alias("n"), F.max("depth").alias("d")).where((F.col("n") > node_limit) & (F.col("d") < bits)).select("task", "n")
        hot = materialize(hot, "hot")
        if hot.isEmpty():
            break
        cool = rows.join(hot, "task", "left_anti")
        rows = rows.join(hot, "task")
        if labelled:
            dealt, rows = _deal_out(rows, node_limit)
            cool = cool.unionByName(dealt)
        done = cool if done is None else done.unionByName(cool)
        rows = materialize(_expand(rows, budget, node_limit, bits), "expanded")
        counted = rows.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0)
    rows = rows if done is None else done.unionByName(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * len(plan) // BUCKET_ROWS))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, key, task, side, label = (t.column(x).to_numpy() for x in ("node", "key", "task", "side", "label"))
        key = key.view(np.uint64)
        order = np.lexsort((key, side, task))
        words = _words(t.column("fp").to_pylist())[order] if whole else key[order][:, None]
        most = max_bits if whole else budget
        node = node[order]
        if counted_only:
            partners = _Partners(len(node))
            trie_links(key[order], task[order], side[order], words, bits, budget, most, label=np.unique(label[order], return_inverse=True)[1], found=partners)
            some = partners.count > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(partners.count[some])], ["node", "partners"])
            return
        if labelled:
            found: list = []
            trie_links(key[order], task[order], side[order], words, bits, budget, most, label=np.unique(label[order], return_inverse=True)[1], found=found)
            for i, j in found:
                pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])
            return
        label = trie_links(key[order], task[order], side[order], words, bits, budget, most)
        other = label != np.arange(len(label))
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[label[other]])], ["u", "v"])

    dealt = rows.select("node", "label", "fp", "key", "task", "side").repartition(parts, "task")
    return dealt.mapInArrow(run, "node long, partners long") if counted_only else dealt.mapInArrow(run, "u long, v long").where("u <> v")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 1, bands: int = 1, bits: int = 64, budget: int = 2, max_bits: int = 2, node_limit: int = NODE_LIMIT
) -> DataFrame:
    """One row (doc_id, fingerprint hex, component_id) per input row.

    component_id is the smallest id reachable over links, which are of texts: rows that share an id and differ in text are
    linked only if their fingerprints are.  Null texts count as empty; texts without words
    share the zero fingerprint and are linked like any other.  A row with a null id keeps the null, can
    carry links, and gives no component its id.  Repeated rows come back repeated, an empty table empty.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, lanes), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")).withColumn("node", F.xxhash64("fp")), "nodes")
    root = components(trie_self_join(nodes, bands, bits, budget, max_bits, node_limit))
    linked = nodes.join(root, "node").select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    named = nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return fps.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, lanes: int) -> DataFrame:
    """(id, text, node, fp, mins): a hash of the text's set of shingles, that set's fingerprint and its least hashes in MINS orders."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, fps, mins = [], [], []
        for text in batch.column(1).to_pylist():
            h = np.unique(_shingle_hashes(text, shingle))
            nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63))
            fps.append(_majority(h, lanes))
            mins.append([int(_mix(h, lanes + k).min().view(np.int64)) for k in range(MINS)] if len(h) else [])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64()), pa.array(fps, pa.binary()), pa.array(mins, pa.list_(pa.int64()))], ["id", "text", "node", "fp", "mins"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return map_rows(rows, run, "id long, text binary, node long, fp binary, mins array<long>")


def _star_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes that share a least hash in one of the orders, each with one of them only.

    Which one is decided by a hash that differs from order to order, so a poor choice in one isn't repeated in the next.
    """
    rows = nodes.select("node", F.posexplode("mins").alias("k", "least"))
    first = rows.groupBy("k", "least").agg(F.min(F.struct(F.xxhash64("node", "k").alias("h"), F.col("node").alias("u"))).alias("p"), F.count("*").alias("n"))
    first = first.where("n > 1").select("k", "least", "p.u")
    return rows.join(first, ["k", "least"]).where("u <> node").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()


def similar(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, least: float) -> DataFrame:
    """The distinct pairs (u, v) whose shingle sets have a Jaccard similarity of at least `least`.

    rows: (row, text); nodes: (node, row), the row that has the node's text.  Only texts of the pairs' nodes are hashed.
    The sets of the v are dealt to buckets of about SET_BYTES; a u's set goes once to each bucket that has some of its v.
    A bucket that many u ask is copied to tasks that take ASKED_BYTES of their sets each.
    """

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(_shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.binary())], ["node", "size", "hashes"])

    def decide(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets = {n: np.frombuffer(y, np.uint64) for n, y in zip(held.column("v").to_pylist(), held.column("held").to_pylist(), strict=True)}
        us, out = [], []
        for u, vs, x in zip(asked.column("u").to_pylist(), asked.column("vs"), asked.column("hashes"), strict=True):
            x, vs = np.frombuffer(x.as_py(), np.uint64), np.array(vs.as_py(), np.int64)
            b = np.array([len(sets[v]) for v in vs.tolist()])
            vs, b = (k[np.minimum(b, len(x)) >= np.maximum(1, least * np.maximum(b, len(x)) - 1e-9)] for k in (vs, b))
            if not len(vs):
                continue
            y = np.concatenate([sets[v] for v in vs.tolist()])
            hits = np.append(0, np.cumsum(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
            both = np.diff(hits[np.append(0, np.cumsum(b))])
            near = vs[both >= least * (len(x) + b - both) - 1e-9]
            us.append(np.full(len(near), u))
            out.append(near)
        return pa.table({"u": pa.array(np.concatenate([*us, np.empty(0, np.int64)])), "v": pa.array(np.concatenate([*out, np.empty(0, np.int64)]))})

    needed = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "row"), "node")
    needed = materialize(needed, "needed")
    # Few enough to broadcast, the texts stay where they are; else both sides are shuffled.
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    sets = materialize(map_rows(rows.select("row", "text").join(few, "row").select("node", "text"), hashed, "node long, size long, hashes binary"), "sets")
    buckets = -(-(sets.agg(F.sum("size")).first()[0] or 1) // SET_BYTES)
    asked = materialize(pairs.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(buckets)).alias("bucket")).agg(F.collect_list("v").alias("vs")), "asked")
    loads = asked.join(sets.select(F.col("node").alias("u"), "size"), "u").groupBy("bucket").agg(F.ceil(F.sum("size") / ASKED_BYTES).cast("long").alias("salts"))
    loads = materialize(loads.withColumn("salts", F.greatest("salts", F.lit(1).cast("long"))), "loads")
    left = asked.join(loads, "bucket").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts"))).join(sets.select(F.col("node").alias("u"), "hashes"), "u")
    right = sets.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets))).join(loads, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    left, right = left.select("bucket", "salt", "u", "vs", "hashes"), right.select("bucket", "salt", "node", "hashes").toDF("bucket", "salt", "v", "held")
    return left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(decide, "u long, v long")


def _sketch(df: DataFrame, shingles: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each remainder of COUNTERS occurs among the shingles of all rows: exact below 16, by logarithm above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for h in shingles(batch):
                np.add.at(seen, (h % np.uint64(COUNTERS)).astype(np.int64), 1)
        for at, part in enumerate(seen.reshape(-1, SLICE)):
            if len(own := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([own.astype(np.uint16).tobytes()]), pa.array([part[own].tobytes()])], ["at", "own", "seen"])

    def summed(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for own, seen in zip(parts.column("own").to_pylist(), parts.column("seen").to_pylist(), strict=True):
            total[np.frombuffer(own, np.uint16)] += np.frombuffer(seen, np.uint32)
        levels = np.where(total < 16, total, 16 * np.log2(np.maximum(total, 1)) - 48)  # rarer stays rarer
        return pa.table({"at": pa.array([key[0].as_py()]), "seen": pa.array([np.minimum(levels, 255).astype(np.uint8).tobytes()])})

    out = np.zeros(COUNTERS, np.uint8)
    for row in df.mapInArrow(run, "at long, own binary, seen binary").groupBy("at").applyInArrow(summed, "at long, seen binary").collect():
        out[row["at"] * SLICE : (row["at"] + 1) * SLICE] = np.frombuffer(row["seen"], np.uint8)
    return out


def crowd_pairs(crowd: DataFrame, rows: DataFrame, shingle: int, least: float) -> DataFrame:
    """Candidates (u, v) of different labels in a crowd, all pairs of similarity `least` or more among them.

    crowd: (node, label, row); rows: (row, text).  Shingles are put in one order for all texts, rarest first.  Two sets as similar
    as that share one among the first |x| - least |x| + 1 of each, as the rest is too small.  Rarity is a sketch's
    estimate: a poor one costs candidates and loses none.  Shingles that only one prefix can have aren't shuffled.  Pairs meet
    at their first common shingle if bit maps of both sets leave room for enough common ones: no more than the common bits and
    the shingles that share a bit with others of their set.
    """

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(_shingle_hashes(t, shingle)).tobytes() for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["node", "label", "hashes"])

    def whole(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for h in batch.column("hashes").to_pylist():
            yield np.frombuffer(h, np.uint64)

    texts = crowd.select("node", "label", "row").join(rows.select("row", "text"), "row").select("node", "label", "text")
    sets = materialize(map_rows(texts, hashed, "node long, label long, hashes binary"), "crowd")
    common = _sketch(sets, whole)

    def prefixes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for h in whole(batch):
            seen = common[(h % np.uint64(COUNTERS)).astype(np.int64)]
            yield h[np.lexsort((h, seen))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]

    shared = _sketch(sets, prefixes)

    def asked(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for node, label, h, first in zip(*(batch.column(c).to_pylist() for c in ("node", "label")), whole(batch), prefixes(batch), strict=True):
            held = np.zeros(64 * MAP, np.uint8)
            held[(h >> np.uint64(32)) % np.uint64(64 * MAP)] = 1
            bits, spare = np.packbits(held).view(np.int64).tolist(), len(h) - int(held.sum())
            places = np.flatnonzero(shared[(first % np.uint64(COUNTERS)).astype(np.int64)] > 1)
            keys = first[places].view(np.int64).tolist()
            out += [(node, label, len(h), spare, bits, key, place, keys[:k]) for k, (key, place) in enumerate(zip(keys, places.tolist(), strict=True))]
        columns = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())] + [pa.int64()] * 2 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["node", "label", "size", "spare", "bits", "h", "place", "earlier"])

    schema = "node long, label long, size long, spare long, bits array<long>, h long, place long, earlier array<long>"
    found = materialize(map_rows(sets, asked, schema, rows=64), "prefixes")
    x, y = found.alias("x"), found.alias("y")
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    enough = F.lit(least / (1 + least)) * (small + large) - 1e-6
    rest = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))  # all they can share from their first common shingle on
    common_bits = sum((F.bit_count(F.col("x.bits")[k].bitwiseAND(F.col("y.bits")[k])) for k in range(MAP)), F.least("x.spare", "y.spare"))
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    near = (small >= F.lit(least) * large - 1e-9) & (rest >= enough) & (common_bits >= enough)
    return x.join(y, same & near & ~F.arrays_overlap("x.earlier", "y.earlier")).select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, lanes: int = 4, budget: int = 20, max_bits: int = 56, node_limit: int = NEAR_LIMIT, recall: float = 0.99
) -> DataFrame:
    """One row (doc_id, component_id) per input row; links are pairs whose shingle sets have a Jaccard similarity of at least `least`.

    The trie join gives candidates, `similar` decides.  Its roots are bits of the fingerprint drawn at random,
    sixteen and one more for each doubling above 2**24 texts, so that subtrees stay at some hundred values; there are as many roots as
    it takes for a pair of just that similarity to share one with probability `recall`.  Under a root,
    64 further bits may differ in `budget` places, and all bits in `max_bits`.  Before it, nodes that share a least hash are checked
    against one of them, so groups of copies are linked already and the join need not give all their pairs: it leaves out
    pairs that checked links connect, and no others.  Texts that have many candidates under the first roots are a crowd, with the
    texts linked to them: pairs within it come from crowd_pairs, all others from the trie.  Rows without ids and texts without words are as in near_duplicates.
    """
    rows = materialize(sketches(docs, id_col, text_col, shingle, lanes).withColumn("row", F.monotonically_increasing_id()), "sketches")
    found = rows.groupBy("node").agg(F.min("id").alias("first"), F.min("row").alias("row"))
    nodes = materialize(rows.select("row", "fp", "mins").join(found, "row"), "nodes")
    close = materialize(similar(materialize(_star_pairs(nodes), "stars"), rows, nodes, shingle, least), "close")
    marked = materialize(nodes.join(components(close), "node", "left").select("node", "fp", F.coalesce("root", "node").alias("label")), "marked")
    size = 16 + max(0, int(np.ceil(np.log2(max(1, nodes.count())))) - 24)
    tables = _tables(size, tables_for(size, least, recall), 64 * lanes)
    join = {"budget": budget, "max_bits": max_bits, "node_limit": node_limit, "labelled": True}
    partners = trie_self_join(marked, tables=tables[:PROBE], counted_only=True, **join).groupBy("node").agg(F.sum("partners").alias("n"))
    crowded = materialize(marked.join(partners.where(F.col("n") >= CROWD), "node", "left_semi").select(F.col("label")).distinct(), "crowded")
    held = crowded.agg(F.min("label")).first()[0]
    if held is None:
        pairs = trie_self_join(marked, tables=tables, **join)
    else:  # a crowd of whole labels counts as one label to the trie join, so its own pairs are left to the prefixes
        crowd = materialize(marked.join(crowded, "label", "left_semi"), "crowd")
        others = marked.join(crowded, "label", "left_anti").unionByName(crowd.withColumn("label", F.lit(held)))
        pairs = trie_self_join(materialize(others, "marked"), tables=tables, **join)
        pairs = pairs.unionByName(crowd_pairs(crowd.join(nodes.select("node", "row"), "node"), rows, shingle, least))
    pairs = materialize(pairs.distinct(), "pairs")
    links = similar(pairs, rows, nodes, shingle, least)
    root = components(close.unionByName(links))
    linked = materialize(nodes.select("node", "first").join(root, "node"), "linked")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("node", "component")
    named = nodes.select("node", "first").join(named, "node", "left").select("node", F.coalesce("component", "first").alias("component_id"))
    return rows.select("id", "node").join(named, "node").select(F.col("id").alias("doc_id"), "component_id")


def tables_for(root: int, least: float, recall: float) -> int:
    """How many draws of `root` bits let a pair of similarity `least` agree in one of them with probability `recall`.

    A bit of two sets' fingerprints differs with the angle between the sets as vectors, arccos(2 J / (1 + J)) / pi.
    """
    agree = (1 - np.arccos(2 * least / (1 + least)) / np.pi) ** root
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))) if agree < 1 else 1
