"""Exact deduplication: texts go to partitions by length and content hash, and there into Patricia tries whose terminals know the owner.

1. Where the rows lie, each task inserts its texts into a trie, so that a task sends a text once however often it holds it.
   A row keeps the number of its class (its text in that task).
2. The classes' texts are dealt by (length, content hash).  A task inserts whole byte strings into a compressed radix
   trie; texts are equal only if they end in the same terminal, whatever their hashes.  A terminal keeps the smallest (or
   largest) identifier and the number of copies; a class that reaches a terminal again is sent on as a link only.
3. A trie above its budget gives up its heaviest subtrees: their terminals, and later texts that lead into them, leave the task
   as open rows under the subtree's name and are merged in the next round, each subtree for itself.
4. Rows take the owner of their class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, text_bytes

#: Bytes of edge labels that a trie may hold before it gives up subtrees; a partition's texts aim at the same size.
BUDGET = 64 << 20
#: Most classes of one text that one task takes at once; hotter texts are merged in salted groups first.
FAN_IN = 4096
#: What a node costs beside its label.
NODE = 200

SCHEMA = "kind string, class long, rep long, row long, id long, text binary, n_bytes long, hash long, sha256 string, owner long, owner_row long, copies long, subtree string"
NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]


class Terminal:
    """The end of one text: who represents it, who owns it, how often it occurs."""

    __slots__ = ("copies", "hash", "owner", "owner_row", "rep", "sha256")

    def __init__(self, rep: int, sha256: str, key: int, owner: int | None, owner_row: int, copies: int):
        self.rep, self.sha256, self.hash, self.owner, self.owner_row, self.copies = rep, sha256, key, owner, owner_row, copies

    def merge(self, owner: int | None, owner_row: int, copies: int, largest: bool) -> None:
        self.copies += copies
        self.owner_row, self.owner = min((self.owner_row, self.owner), (owner_row, owner), key=lambda x: rank(x[1], x[0], largest))


def rank(owner: int | None, row: int, largest: bool) -> tuple[bool, int, int]:
    """Owners by rising rank: rows with an id first, then by id, then by place in the table."""
    return owner is None, (-owner if largest else owner) if owner is not None else 0, row


class Node:
    """`spilled` names a subtree that was given up, `above` tells of one further down, `empty` that nothing is left to give up."""

    __slots__ = ("above", "children", "empty", "label", "spilled", "terminal", "weight")

    def __init__(self, label: bytes):
        self.label, self.terminal, self.children, self.spilled, self.weight = label, None, {}, None, len(label) + NODE
        self.above = self.empty = False


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two texts of the same length."""
    odd = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (odd.bit_length() + 7) // 8


class Patricia:
    """A compressed radix trie over byte strings; `weight` of a node is what its subtree holds."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def find(self, text: bytes) -> Terminal | Node:
        """The text's terminal, or the spilled node that it leads to; a node without terminal is made where there is none."""
        node, at, path = self.root, 0, [self.root]
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                for up in path:
                    up.weight += child.weight
                    up.empty = False
                return child
            label = child.label
            part = text[at : at + len(label)]
            if part != label:
                same = common(label[: len(part)], part)
                upper = Node(label[:same])
                child.label = label[same:]
                child.weight -= same
                upper.children[child.label[0]] = child
                upper.weight += child.weight
                upper.above = child.above or child.spilled is not None
                node.children[text[at]] = upper
                for up in path:
                    up.weight += NODE
                child = upper
            node, at = child, at + len(child.label)
            if node.spilled is not None:
                return node
            path.append(node)
        return node.terminal or node

    def heaviest(self) -> tuple[Node, bytes] | None:
        """A heavy subtree below the first branching with nothing given up inside, and its prefix; None where there is no other text."""
        node, prefix, branched = self.root, b"", False
        while True:
            branched = branched or len(node.children) > 1 or node.terminal is not None
            below = [c for c in node.children.values() if c.spilled is None and not c.empty]
            if not below:
                return None
            node = max(below, key=lambda c: c.weight)
            prefix += node.label
            if branched and not node.above and (node.weight <= self.root.weight / 2 or not node.children):
                return node, prefix

    def spill(self, node: Node, prefix: bytes) -> list[tuple[bytes, Terminal]]:
        """Empty a subtree and mark it; its texts and terminals."""
        out = list(self.entries(node, prefix))
        freed, path, left = node.weight - len(node.label) - NODE, [self.root], prefix
        while path[-1].children[left[0]] is not node:
            path.append(path[-1].children[left[0]])
            left = left[len(path[-1].label) :]
        node.weight -= freed
        node.children, node.terminal, node.spilled = {}, None, f"{len(prefix)}:{hashlib.sha256(prefix).hexdigest()}"
        for up in reversed(path):
            up.weight -= freed
            up.above, up.empty = True, all(c.spilled is not None or c.empty for c in up.children.values())
        return out

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Terminal]]:
        """Texts and terminals below a node, which ends `prefix`."""
        todo = [(node or self.root, prefix)]
        while todo:
            here, text = todo.pop()
            if here.terminal is not None:
                yield text, here.terminal
            todo += [(c, text + c.label) for c in here.children.values()]


class Out:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.bytes = 0

    def add(self, **row) -> None:
        self.rows.append(row)
        self.bytes += 100 + len(row.get("text") or b"")

    def batches(self, least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.bytes >= least:
            types = {"kind": pa.string(), "text": pa.binary(), "sha256": pa.string(), "subtree": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in self.rows], types.get(n, pa.int64())) for n in NAMES], NAMES)
            self.rows, self.bytes = [], 0


def _send(out: Out, text: bytes, t: Terminal, kind: str, subtree: str | None = None) -> None:
    kept = {"text": text} if kind == "open" else {}
    out.add(kind=kind, rep=t.rep, n_bytes=len(text), hash=t.hash, sha256=t.sha256, owner=t.owner, owner_row=t.owner_row, copies=t.copies, subtree=subtree, **kept)


def _classes(largest: bool, budget: int):
    """Rows (id, text) of a task -> a `row` each, and an `open` row for each different text; the trie starts anew above its budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, out, trie = TaskContext.get().partitionId() << 33, Out(), Patricia()
        row = rep = base
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = trie.find(text)
                if isinstance(found, Node):
                    digest = hashlib.sha256(text)
                    found.terminal = Terminal(rep, digest.hexdigest(), int.from_bytes(digest.digest()[:8], "big", signed=True), owner, row, 1)
                    found, rep = found.terminal, rep + 1
                else:
                    found.merge(owner, row, 1, largest)
                out.add(kind="row", **{"class": found.rep}, row=row, id=owner)
                row += 1
                if trie.root.weight > budget:
                    for whole, t in trie.entries():
                        _send(out, whole, t, "open")
                        yield from out.batches()
                    trie = Patricia()
                yield from out.batches()
        for whole, t in trie.entries():
            _send(out, whole, t, "open")
            yield from out.batches()
        yield from out.batches(0)

    return run


def _merged(largest: bool, budget: int, final: bool):
    """Open rows of a task, sorted by subtree -> a `link` for each class that isn't its text's first, and each text `done`, or `open` where its subtree was given up."""

    def ended(trie: Patricia, out: Out) -> Iterator[pa.RecordBatch]:
        for whole, t in trie.entries():
            _send(out, whole, t, "done" if final else "open")
            yield from out.batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie, inside = Out(), Patricia(), None
        columns = ("subtree", "text", "rep", "sha256", "hash", "owner", "owner_row", "copies")
        for batch in batches:
            for subtree, text, rep, sha256, key, owner, owner_row, copies in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns], strict=True):
                if subtree != inside:
                    yield from ended(trie, out)
                    trie, inside = Patricia(), subtree
                found = trie.find(text)
                if isinstance(found, Node):
                    first = Terminal(rep, sha256, key, owner, owner_row, copies)
                    if found.spilled is not None:
                        _send(out, text, first, "open", found.spilled)
                    else:
                        found.terminal = first
                else:
                    found.merge(owner, owner_row, copies, largest)
                    out.add(kind="link", **{"class": rep}, rep=found.rep)
                while trie.root.weight > budget and (heavy := trie.heaviest()):
                    for whole, t in trie.spill(*heavy):
                        _send(out, whole, t, "open", heavy[0].spilled)
                        yield from out.batches()
                yield from out.batches()
        yield from ended(trie, out)
        yield from out.batches(0)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, budget: int = BUDGET, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if all their bytes are; null counts as empty.  Of equal texts the row with the smallest id stays
    (`largest`: the largest), of repeated rows with that id the one that comes first; rows without an id only stay where no row of
    the group has one, and keep_id is null then.  So exactly one row of each group has kept true.  Other columns
    of docs play no part, whatever their names; an empty table gives no rows.
    A text longer than the budget is held alone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    first = materialize(rows.mapInArrow(_classes(largest, budget), SCHEMA), "classes")
    opened = first.where("kind = 'open'")
    total = opened.agg(F.sum("n_bytes"), F.count("*")).first()
    parts = max(1, -(-((total[0] or 0) + NODE * total[1]) // budget), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if total[1] else 1)
    keys, links, done = ["n_bytes", "hash", "subtree"], [], []
    copies = opened.groupBy("n_bytes", "hash").count().agg(F.max("count")).first()[0] or 0
    while copies > fan_in:  # texts that more tasks hold than one should take: merge salted groups first
        salted = opened.repartition(parts, "n_bytes", "hash", F.pmod(F.xxhash64("rep"), F.lit(-(-copies // fan_in))))
        level = materialize(salted.mapInArrow(_merged(largest, budget, False), SCHEMA), "salted")
        links.append(level.where("kind = 'link'"))
        opened = level.where("kind = 'open'").withColumn("subtree", F.lit(None).cast("string"))
        fewer = opened.groupBy("n_bytes", "hash").count().agg(F.max("count")).first()[0]
        if fewer >= copies:  # different texts under one key: the trie tells them apart
            break
        copies = fewer
    while True:
        dealt = opened.repartition(parts, *keys)
        dealt = dealt.sortWithinPartitions("subtree") if done else dealt
        level = materialize(dealt.mapInArrow(_merged(largest, budget, True), SCHEMA), "tries")
        links.append(level.where("kind = 'link'"))
        done.append(level.where("kind = 'done'"))
        opened, keys = level.where("kind = 'open'"), ["subtree"]  # a subtree is merged by one task, in a trie of its own
        if opened.isEmpty():
            break
    found = first.where("kind = 'row'").select("class", "row", "id")
    for link in links:
        found = found.join(link.select("class", F.col("rep").alias("next")), "class", "left").select(F.coalesce("next", "class").alias("class"), "row", "id")
    owners = done[0]
    for more in done[1:]:
        owners = owners.unionAll(more)
    owners = owners.select(F.col("rep").alias("class"), "owner", "owner_row", "copies", "sha256")
    return found.join(owners, "class").select(
        F.col("id").alias("doc_id"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("row") == F.col("owner_row")).alias("kept"), F.col("sha256").alias("text_sha256"),
    )
