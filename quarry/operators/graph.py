"""Entity and relation graphs: merging, neighbourhoods, components, communities and their texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize_name
from quarry.plans.stages import written


def merge_entities(rows: DataFrame) -> DataFrame:
    """rows(seq, name, entity_type, description, chunk_id) -> one entity per normalised name.

    Type: the most frequent, first seen on ties; distinct descriptions in first-seen order; sorted chunk ids.
    """
    rows = rows.withColumn("name", normalize_name(F.col("name"))).where("name <> ''")
    kind = rows.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kind = kind.groupBy("name").agg(F.max_by("entity_type", F.struct("n", (-F.col("first")).alias("f"))).alias("entity_type"))
    told = rows.where(F.trim("description") != "").groupBy("name", "description").agg(F.min("seq").alias("first"))
    told = told.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first", "description"))).alias("d"))
    told = told.select("name", F.array_join(F.transform("d", lambda x: x["description"]), " | ").alias("description"))
    chunks = rows.groupBy("name").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return kind.join(told, "name", "left").join(chunks, "name").withColumn("description", F.coalesce("description", F.lit("")))


def merge_relationships(rows: DataFrame) -> DataFrame:
    """rows(seq, source, target, description, strength, chunk_id) -> longest description, greatest strength, all chunks."""
    rows = rows.withColumn("source", normalize_name(F.col("source"))).withColumn("target", normalize_name(F.col("target")))
    return rows.groupBy("source", "target").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"), F.max("strength").alias("strength"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")
    )


def build_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged entities, and merged relations between known ones."""
    nodes = merge_entities(entities)
    edges = merge_relationships(relations)
    known = entities.select(normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct()  # the names of `nodes`, without their texts
    for end in ("source", "target"):
        edges = edges.join(known.select(F.col("name").alias(end)), end, "left_semi")
    return nodes, edges.select("source", "target", "description", "strength", "chunk_ids")


def repair_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Replace endpoints by the entity of that name, else by the first one of which either name contains the other.

    entities(seq, name).  Relations with an endpoint that matches nothing go.  Only unknown names meet the entities.
    """
    ends = relations.select(F.col("source").alias("end")).union(relations.select(F.col("target"))).distinct()
    exact = ends.join(entities.select(F.col("name").alias("end")), "end", "left_semi").select("end", F.col("end").alias("name"))
    lost = ends.join(exact, "end", "left_anti")
    # Of two names the shorter one's first characters stand somewhere in the longer one: that is the key they meet on.
    inside = _keyed(lost, "end").join(_runs(entities, "name"), "key").where(F.col("name").contains(F.col("end")))
    around = _keyed(entities, "name").join(_runs(lost, "end"), "key").where(F.col("end").contains(F.col("name")))
    near = inside.select("end", "name", "seq").unionByName(around.select("end", "name", "seq")).groupBy("end").agg(F.min_by("name", "seq").alias("name"))
    names = exact.unionByName(near)
    for end in ("source", "target"):
        relations = relations.join(names.select(F.col("end").alias(end), F.col("name").alias(f"{end}_name")), end)
    return relations.drop("source", "target").withColumnsRenamed({"source_name": "source", "target_name": "target"})


def _keyed(rows: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Adds `key`: the first `n` characters, all of a shorter text."""
    return rows.withColumn("key", F.substring(column, 1, n))


def _runs(rows: DataFrame, column: str, n: int = 4) -> DataFrame:
    """Adds `key`: every run of `n` characters once, and all shorter ones, for names that are as short as that."""
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(column) - size + 1, F.lit(1))), lambda i: F.substring(F.col(column), i, F.lit(size))) for size in range(1, n + 1)]  # noqa: B023
    return rows.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *runs))))


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree over nodes that have edges, greatest degree, and types(entity_type, n), the most frequent first."""
    degree = relations.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("d"))
    shape = degree.agg(F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"))
    types = entities.groupBy("entity_type").agg(F.count("*").alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_type", "n"))), lambda x: F.struct(x["entity_type"].alias("entity_type"), x["n"].alias("n")))
    return types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), listed.alias("types")).join(relations.agg(F.count("*").alias("edges"))).join(shape)


#: Most names of a frontier that are sent to all links, so that other links stay where they are; links to a task; pairs of a link and a seed at once.
MOST_SENT, LINKS, PAIRS = 1_000_000, 2_000_000, 1 << 21


def _numbers(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class _Reached:
    """What a task knows of a hop: links (kind 0), seeds that reached their near ends (1) and seeds that have been at a name before (2)."""

    def __init__(self, rows: pa.Table):
        links, lists, before = (rows.filter(pc.equal(rows.column("kind"), k)).combine_chunks() for k in range(3))
        whole = lambda t, c: t.column(c).combine_chunks() if t.num_rows else pa.array([], rows.schema.field(c).type)
        of = pc.index_in(whole(links, "near"), whole(lists, "near"))
        links, self.of = links.filter(of.is_valid()).combine_chunks(), of.drop_null().to_numpy().astype(np.int64)
        seeds, old = whole(lists, "seeds"), whole(before, "seeds")
        code, self.seeds = _numbers(pa.concat_arrays([seeds.flatten(), old.flatten()]))
        self.code = code[: len(seeds.flatten())]
        self.ends = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(seeds)).astype(np.int64))]
        far, self.names = _numbers(pa.concat_arrays([whole(links, "far"), whole(before, "far")]))
        self.old = np.unique(np.repeat(far[links.num_rows :], np.asarray(pc.list_value_length(old))) * max(1, len(self.seeds)) + code[len(self.code) :])
        order = np.argsort(far[: links.num_rows], kind="stable")
        self.links, self.of, self.far = links.take(pa.array(order)), self.of[order], far[: links.num_rows][order]

    def steps(self):
        """(places of links by their far ends, name and seed as one number), of seeds that are new at the far end, some at once."""
        many = self.ends[self.of + 1] - self.ends[self.of]
        cost, lo = np.r_[0, np.cumsum(many)], 0
        while lo < len(self.of):
            hi = max(lo + 1, int(np.searchsorted(cost, cost[lo] + PAIRS, "right")) - 1)
            m = many[lo:hi]
            link = np.repeat(np.arange(lo, hi), m)
            key = self.far[link] * len(self.seeds) + self.code[np.repeat(self.ends[self.of[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            if len(self.old):
                fresh = self.old[np.minimum(np.searchsorted(self.old, key), len(self.old) - 1)] != key
                link, key = link[fresh], key[fresh]
            yield link, key
            lo = hi

    def lists(self, key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The groups, which stand together, and the seeds of each."""
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return group[at], pa.ListArray.from_arrays(pa.array(np.r_[at, len(group)].astype(np.int32)), self.seeds.take(pa.array(key % len(self.seeds))))


def _told_names(batches):
    """(name, seeds) of names that seeds reach for the first time."""
    batches = list(batches)
    if not batches:
        return
    task = _Reached(pa.Table.from_batches(batches))

    def told(key):
        if len(key):
            names, seeds = task.lists(key, key // len(task.seeds))
            yield pa.RecordBatch.from_arrays([task.names.take(pa.array(names)), seeds], ["name", "seeds"])

    rest = np.zeros(0, np.int64)
    for _, key in task.steps():
        key = np.unique(np.r_[rest, key])
        last = np.searchsorted(key, key[-1] // len(task.seeds) * len(task.seeds)) if len(key) else 0  # more links may lead to the last name
        yield from told(key[:last])
        rest = key[last:]
    yield from told(rest)


def _told_links(batches):
    """(source, target, seeds) of links that lead seeds to a name that they haven't reached before."""
    batches = list(batches)
    if not batches:
        return
    task = _Reached(pa.Table.from_batches(batches))
    for link, key in task.steps():
        if len(key):
            at, seeds = task.lists(key, link)
            near, far, ahead = (task.links.column(c).take(pa.array(at)).combine_chunks() for c in ("near", "far", "ahead"))
            yield pa.RecordBatch.from_arrays([pc.if_else(ahead, near, far), pc.if_else(ahead, far, near), seeds], ["source", "target", "seeds"])


def neighbors(relations: DataFrame, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """seeds(name) -> (neighbours(seed, name, hop), edges(seed, source, target, hop)), undirected.

    An edge is collected at a hop if its far end isn't visited yet, so one inside a frontier comes from either end.
    A hop's links are dealt by their far ends, and each task gets the seeds of a near end once, however many of its links are there; so pairs
    of a name and a seed are made where they are told apart, and only results hold a row for each.
    """
    spark = relations.sparkSession
    kind = relations.schema["source"].dataType.simpleString()
    ends = written(relations.select("source", "target"), "links")
    there, back = (ends.select(F.col(x).alias("near"), F.col(y).alias("far"), F.lit(x == "source").alias("ahead")) for x, y in (("source", "target"), ("target", "source")))
    links = there.unionAll(back).where("near is not null")
    tasks = max(2 * spark.sparkContext.defaultParallelism, ends.count() // LINKS)
    frontier = written(seeds.select("name").where("name is not null").distinct().select("name", F.array("name").alias("seeds")), "seeds")
    visited, found, edges = frontier, None, None
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(tasks)).cast("int").alias("task")
    for hop in range(1, hops + 1):
        names = frontier.where("name is not null").select(F.col("name").alias("near"), "seeds")
        mine = links.join(F.broadcast(names.select("near")), "near", "left_semi") if names.count() <= MOST_SENT else links
        lists = names.join(mine.select("near", place("far")).distinct(), "near")
        none = lambda c: F.lit(None).cast(f"array<{kind}>" if c == "seeds" else "boolean" if c == "ahead" else kind).alias(c)
        rows = mine.select(place("far"), F.lit(0).alias("kind"), "near", "far", "ahead", none("seeds"))
        rows = rows.unionAll(lists.select("task", F.lit(1), "near", none("far"), none("ahead"), "seeds"))
        rows = rows.unionAll(visited.where("name is not null").select(place("name"), F.lit(2), none("near"), "name", none("ahead"), "seeds")).repartition(tasks, "task")
        new = rows.mapInArrow(_told_names, f"name {kind}, seeds array<{kind}>")
        if hop < hops:
            frontier = new = written(new, "hop")
            visited = visited.unionAll(new)
        new = new.select(F.explode("seeds").alias("seed"), "name", F.lit(hop).alias("hop"))
        own = rows.mapInArrow(_told_links, f"source {kind}, target {kind}, seeds array<{kind}>").select(F.explode("seeds").alias("seed"), "source", "target", F.lit(hop).alias("hop"))
        found, edges = (new, own) if found is None else (found.unionByName(new), edges.unionByName(own))
    return found, edges


def contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts(tid, text), patterns(pattern) -> tid, pattern: every pattern that stands somewhere in the text, once.

    A pattern is looked up by its first p characters, p the largest power of two within its length; texts offer all their
    substrings of the powers that occur, so they meet on equal strings, and the rest is compared where they meet.
    """
    keyed = patterns.where(F.length("pattern") > 0).select("pattern").distinct().withColumn("p", F.expr("shiftleft(1, cast(length(bin(length(pattern))) - 1 as int))"))
    keyed = keyed.withColumn("key", F.substr("pattern", F.lit(1), F.col("p")))
    powers = sorted(r.p for r in keyed.select("p").distinct().collect())  # 31 at most
    if not powers:
        return texts.select("tid", F.lit("").alias("pattern")).where("false")
    none = F.array().cast("array<struct<at:int,p:int>>")

    def places(p: int) -> Column:
        return F.when(F.length("text") >= p, F.transform(F.sequence(F.lit(1), F.length("text") - p + 1), lambda i: F.struct(i.alias("at"), F.lit(p).alias("p")))).otherwise(none)

    place = F.explode(F.flatten(F.array(*map(places, powers))))
    offered = texts.select("tid", "text", place.alias("s")).select("tid", "text", "s.at", "s.p", F.substr("text", F.col("s.at"), F.col("s.p")).alias("key"))
    met = offered.join(keyed, ["p", "key"]).where(F.substr("text", F.col("at"), F.length("pattern")) == F.col("pattern"))
    return met.select("tid", "pattern").distinct()


def link_query_entities(queries: DataFrame, entities: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """queries(query_id, text), entities(seq, name), extracted(query_id, name) -> query_id, name: the entities that a query names.

    Those whose name stands in the upper-cased text, word or not, and for each name that a model extracted from the query the entity of that
    name, else the one of smallest seq whose name holds it or stands in it.  Entity names are upper-cased with single spaces; blank ones match nothing.
    """
    texts = queries.select(F.col("query_id").alias("tid"), F.upper(F.coalesce("text", F.lit(""))).alias("text"))
    names = entities.select(F.col("name").alias("pattern"))
    linked = contained(texts, names).select(F.col("tid").alias("query_id"), F.col("pattern").alias("name"))
    if extracted is None:
        return linked
    asked = extracted.select("query_id", normalize_name(F.col("name")).alias("asked")).where("asked <> ''").distinct()
    exact = asked.join(entities.select(F.col("name").alias("asked")).distinct(), "asked")
    rest = asked.join(exact, ["query_id", "asked"], "left_anti")
    terms = rest.select("asked").distinct()
    inside = contained(terms.select(F.col("asked").alias("tid"), F.col("asked").alias("text")), names).select(F.col("tid").alias("asked"), F.col("pattern").alias("name"))
    around = contained(names.distinct().select(F.col("pattern").alias("tid"), F.col("pattern").alias("text")), terms.select(F.col("asked").alias("pattern"))).select(F.col("pattern").alias("asked"), F.col("tid").alias("name"))
    first = inside.union(around).join(entities.groupBy("name").agg(F.min("seq").alias("seq")), "name").groupBy("asked").agg(F.min_by("name", F.struct("seq", "name")).alias("name"))
    return linked.union(exact.select("query_id", F.col("asked").alias("name"))).union(rest.join(first, "asked").select("query_id", "name")).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(a, b), nodes(node) -> node, component: the smallest node reachable, undirected.

    Labels jump: each round takes the least label around, then the label of that label.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    labels = written(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        step = labels.join(around, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        of = step.select(F.col("node").alias("new"), F.col("new").alias("newer"))
        step = written(step.join(of, "new").select("node", "label", F.least("new", "newer").alias("new")), "labels")
        changed = step.where("label <> new").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def undirected(relations: DataFrame) -> DataFrame:
    """relations(seq, source, target, weight) -> a, b, weight with a < b; the last of a pair counts, in either direction."""
    pair = relations.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight", "seq")
    return pair.groupBy("a", "b").agg(F.max_by("weight", "seq").alias("weight"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of labels(node, label) on edges(a, b, weight)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("l")), labels.select(F.col("node").alias("b"), F.col("label").alias("k"))
    inside = edges.join(la, "a").join(lb, "b").where("l = k").groupBy(F.col("l").alias("label")).agg(F.sum("weight").alias("w"))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("d"))
    total = edges.agg(F.sum("weight").alias("m"))
    per = degree.join(labels, "node").groupBy("label").agg(F.sum("d").alias("d")).join(inside, "label", "left").join(F.broadcast(total))
    return per.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * (F.col("d") / (2 * F.col("m"))) ** 2).alias("modularity"))


def assemble_communities(labels: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """labels(name, label), entities(name, chunk_ids), relations(source, target, description) -> one row per community."""
    own = entities.join(labels, "name")
    members = own.groupBy("label").agg(F.array_sort(F.collect_list("name")).alias("entity_names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"))
    s, t = labels.select(F.col("name").alias("source"), "label"), labels.select(F.col("name").alias("target"), F.col("label").alias("to"))
    inner = relations.join(s, "source").join(t, "target").where("label = to")
    text = F.concat("source", F.lit(" → "), "target", F.lit(": "), F.coalesce("description", F.lit("")))
    inner = inner.groupBy("label").agg(F.array_sort(F.collect_list(text)).alias("relationship_descriptions"))
    first = F.array_join(F.slice("entity_names", 1, 5), ", ")
    out = members.join(inner, "label", "left").withColumn("relationship_descriptions", F.coalesce("relationship_descriptions", F.array().cast("array<string>")))
    return out.select(F.col("label").alias("community_id"), F.size("entity_names").alias("size"), F.concat(F.lit("Community "), F.col("label").cast("string")).alias("title"), first.alias("summary"), "entity_names", "relationship_descriptions", "chunk_ids")


def global_reduce(scored: DataFrame, threshold: float = 20) -> DataFrame:
    """scored(query_id, community_id, title, summary, score, answer): partial answers from `threshold` on, by falling score."""
    kept = scored.where((F.trim("summary") != "") & (F.col("score") >= threshold) & (F.trim("answer") != ""))
    part = F.concat(F.lit("### ["), "title", F.lit("] (相关度: "), F.col("score").cast("string"), F.lit(")\n"), "answer")
    ordered = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "community_id", part.alias("p")))).alias("parts"))
    return ordered.select("query_id", F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n").alias("answer"))


def pack_to_budget(lines: DataFrame, budget: int = 3000) -> DataFrame:
    """lines(query_id, section, position, text): in section order, a section stops at its first line that doesn't fit
    and the next one goes on with what is left.  Sections are few and fixed, so each is a window step."""
    costs = lines.withColumn("cost", F.length("text"))
    left = lines.select("query_id").distinct().withColumn("left", F.lit(budget))
    out = None
    for (section,) in costs.select("section").distinct().orderBy("section").collect():
        order = Window.partitionBy("query_id").orderBy("position")
        own = costs.where(F.col("section") == section).withColumn("used", F.sum("cost").over(order)).join(left, "query_id")
        kept = own.where((F.col("used") <= F.col("left")) & (F.col("left") > 0))
        spent = kept.groupBy("query_id").agg(F.max("used").alias("spent"))
        left = written(left.join(spent, "query_id", "left").select("query_id", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")), "left")
        kept = kept.select("query_id", "section", "position", "text")
        out = kept if out is None else out.unionByName(kept)
    return out


def _sieve(names: DataFrame):
    """A condition on a column that all of names(name) meet and few others, for Spark to carry below joins and groupings; any value meets it if there are more than MOST_SENT."""
    n = names.count()
    if n > MOST_SENT:
        return lambda c: F.lit(True)
    slots = 1 << max(10, min(23, (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(slots)).cast("int")
    marks = np.zeros(slots, np.uint8)
    marks[names.select(place("name").alias("at")).distinct().toArrow().column("at").to_numpy()] = 1
    return lambda c: F.substring(F.lit(marks.tobytes()), place(c) + 1, F.lit(1)) == F.lit(b"\x01")


def local_context(seeds: DataFrame, entities: DataFrame, relations: DataFrame, communities: DataFrame, budget: int = 3000) -> DataFrame:
    """seeds(query_id, name) -> query_id, section, position, text: the seeds whatever they cost, then relations by
    strength, seeds' communities, and up to ten neighbours, as far as the budget goes.

    Relations are merged only where they may touch a seed, entities where they may be a seed or its neighbour, and each once.
    """
    names = written(seeds.select("name").where("name is not null").distinct(), "seeds")
    seed = _sieve(names)
    relations = written(relations.where(seed("source") | seed("target")).select("source", "target", "strength", "description"), "relations")
    found, edges = (written(x, "around") for x in neighbors(relations, names))
    entities = written(entities.where(_sieve(names.union(found.select("name")).distinct())("name")).select("name", "description"), "entities")
    communities = communities.where(seed("name"))
    mine = seeds.select("query_id", F.col("name").alias("seed"))
    rels = edges.join(mine, "seed").select("query_id", "source", "target").distinct().join(relations.groupBy("source", "target").agg(F.max("strength").alias("strength"), F.max_by("description", "strength").alias("description")), ["source", "target"])
    number = lambda *o: F.row_number().over(Window.partitionBy("query_id").orderBy(*o))
    rels = rels.select("query_id", F.lit(1).alias("section"), number(F.desc("strength"), "source", "target").alias("position"), F.concat("source", F.lit(" → "), "target", F.lit(": "), "description").alias("text"))
    groups = seeds.join(communities.select("name", "label", "title", "summary"), "name").select("query_id", "label", "title", "summary").distinct()
    groups = groups.select("query_id", F.lit(2).alias("section"), number("label").alias("position"), F.concat(F.lit("["), "title", F.lit("] "), "summary").alias("text"))
    near = found.join(mine, "seed").select("query_id", "name").distinct().join(seeds, ["query_id", "name"], "left_anti").join(entities, "name")
    near = near.select("query_id", F.lit(3).alias("section"), number("name").alias("position"), F.concat("name", F.lit(": "), F.substring("description", 1, 100)).alias("text")).where("position <= 10")
    own = seeds.join(entities, "name").select("query_id", F.lit(0).alias("section"), number("name").alias("position"), F.concat("name", F.lit(": "), "description").alias("text"))
    return own.unionByName(pack_to_budget(rels.unionByName(groups).unionByName(near), budget))
