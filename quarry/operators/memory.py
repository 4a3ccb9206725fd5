"""Conversation windows and keyed memories: token budgets, retention, recall and updates over tables."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import estimate_tokens_mixed, estimate_tokens_quarter, is_sensitive, memory_signal, outcome_importance, redact_secrets, sanitize_json
from quarry.functions.vectors import cosine
from quarry.plans.stages import written

KEY_PATTERN = r"^[a-z][a-z0-9_.-]*$"


def pair_turns(messages: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turn, user, assistant; unanswered users are no turns."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ahead = messages.withColumn("next_role", F.lead("role").over(order)).withColumn("assistant", F.lead("text").over(order))
    return ahead.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user"), "assistant")


def recent(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key: recent turns, recent rounds."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("r", last).where(F.col("r") <= n).drop("r")


def turn_cost(per_message: int = 4) -> Column:
    return estimate_tokens_mixed(F.coalesce("user", F.lit(""))) + estimate_tokens_mixed(F.coalesce("assistant", F.lit(""))) + 2 * per_message


def token_budget_turns(turns: DataFrame, budget: int = 1200) -> DataFrame:
    """The longest run of newest turns within the budget; costs aren't negative, so a running sum from the end decides."""
    later = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, Window.unboundedFollowing)
    return turns.withColumn("cost", turn_cost()).withColumn("used", F.sum("cost").over(later)).where(F.col("used") <= budget)


def window_membership(turns: DataFrame, budget: int = 1200) -> DataFrame:
    """After each turn: how many turns are live, the oldest of them, and their cost.

    Turn i is live at t if the running cost at t less that before i is within the budget.  Running costs rise, so
    the oldest live turn is the next start on the cost axis from (total at t - budget) on: one window finds it.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    run = turns.withColumn("cost", turn_cost()).withColumn("total", F.sum("cost").over(order))
    points = run.select("conv_id", "turn", (F.col("total") - F.col("cost")).alias("at"), F.lit(1).alias("kind"), "total").unionByName(run.select("conv_id", "turn", (F.col("total") - budget).alias("at"), F.lit(0).alias("kind"), "total"))
    ahead = Window.partitionBy("conv_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = points.withColumn("oldest", F.first(F.when(F.col("kind") == 1, F.struct("turn", "at")), ignorenulls=True).over(ahead)).where("kind = 0")
    found = found.select("conv_id", "turn", "total", "oldest")
    used = F.when(F.col("oldest.turn") <= F.col("turn"), F.col("total") - F.col("oldest.at")).otherwise(0)
    return found.select("conv_id", "turn", F.when(F.col("oldest.turn") <= F.col("turn"), F.col("oldest.turn")).alias("oldest_turn"), used.cast("long").alias("live_tokens"))


def fold_old_results(messages: DataFrame, keep: int = 3, watermark: float = 0.75) -> DataFrame:
    """messages(session_id, msg_seq, role, content, context_tokens, token_limit): in sessions above the watermark all
    but the newest tool results lose their data, keeping id, name, ok and err; tokens_saved tells the difference."""
    order = Window.partitionBy("session_id", F.col("role") == "tool").orderBy(F.desc("msg_seq"))
    small = F.to_json(F.struct(*[F.get_json_object("content", f"$.{k}").alias(k) for k in ("id", "name", "ok", "err")], F.lit("[folded]").alias("data")))
    over = F.col("context_tokens") > F.col("token_limit") * watermark
    old = (F.col("role") == "tool") & over & (F.row_number().over(order) > keep) & (F.coalesce(F.get_json_object("content", "$.data"), F.lit("")) != "[folded]")
    out = messages.withColumn("folded", F.when(old, small).otherwise(F.col("content"))).withColumn("was_folded", old)
    return out.withColumn("tokens_saved", estimate_tokens_quarter(F.col("content")) - estimate_tokens_quarter(F.col("folded"))).drop("content").withColumnRenamed("folded", "content")


def running_context_tokens(rows: DataFrame) -> DataFrame:
    """rows(session_id, seq, estimate, usage): running estimate, set to the reported usage whenever one arrives."""
    order = Window.partitionBy("session_id").orderBy("seq")
    part = rows.withColumn("span", F.sum(F.col("usage").isNotNull().cast("int")).over(order))
    within = Window.partitionBy("session_id", "span").orderBy("seq")
    added = F.sum(F.when(F.col("usage").isNull(), F.col("estimate")).otherwise(0)).over(within)
    return part.withColumn("context_tokens", added + F.coalesce(F.max("usage").over(within), F.lit(0))).drop("span")


def usage_totals(rows: DataFrame) -> DataFrame:
    """Sums per session; a missing total is prompt and completion."""
    total = F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return rows.groupBy("session_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"))


def forgetting_score(now: Column, retention_days: float, fallback: str = "updated_at") -> Column:
    """Idle days over retention, which importance and up to five recalls stretch; 1 and more means forgotten."""
    idle = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.coalesce("last_recalled_at", fallback))) / 86_400e6)
    recalls = F.least(F.greatest(F.coalesce("recall_count", F.lit(0)), F.lit(0)), F.lit(5))
    return idle / (retention_days * (1 + F.coalesce("importance", F.lit(0.5))) * (1 + recalls / 5))


def retain_top(rows: DataFrame, cap: int, key: str, time: str = "updated_at", partition: str | None = None) -> DataFrame:
    """Keep the `cap` rows of lowest score, newest and then greatest key first on ties."""
    if partition is None:
        return rows.orderBy("score", F.desc(time), F.desc(key)).limit(cap)
    order = Window.partitionBy(partition).orderBy("score", F.desc(time), F.desc(key))
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")


def prune(rows: DataFrame, now: Column, retention_days: float, cap: int, key: str, partition: str | None = None, time: str = "updated_at") -> DataFrame:
    """Drop what is forgotten, then what is over capacity."""
    scored = rows.withColumn("score", forgetting_score(now, retention_days, time))
    return retain_top(scored.where("score < 1"), cap, key, time, partition)


def upgrade_memory(rows: DataFrame, version: int, now: Column | None = None, cap: int = 500, retention_days: float = 30) -> DataFrame:
    """Rows of version 1 get the later fields' defaults; version 2 passes; sensitive facts go; dimensions must agree.

    With `now`, a store above its capacity keeps the `cap` rows of lowest forgetting score.
    """
    if version not in (1, 2):
        raise ValueError(f"unknown version: {version}")
    if version == 1:
        rows = rows.withColumn("importance", F.lit(0.5)).withColumn("recall_count", F.lit(0)).withColumn("last_recalled_at", F.lit(None).cast("timestamp"))
    sizes = rows.agg(F.count_distinct(F.size("embedding"))).first()[0]
    if sizes > 1:
        raise ValueError("embeddings of several dimensions")
    kept = rows.where(~is_sensitive(F.col("key")) & ~is_sensitive(F.col("value")))
    return kept if now is None else retain_top(kept.withColumn("score", forgetting_score(now, retention_days)), cap, "key").drop("score")


def recall(state: DataFrame, queries: DataFrame, k: int = 3, min_similarity: float = 0.35, time: str = "updated_at", digits: int = 9, block: int = 4096, lot: int = 256) -> DataFrame:
    """state(key, embedding, time), queries(query_id, embedding): the k most similar entries at or above the threshold.

    Only vectors of equal length meet.  Blocks of entries meet lots of queries, one matrix product a pair, and of those only what can be
    among a query's k best of the block goes on, to have its similarity taken exactly.  Entries are cut to blocks where they lie, so
    no key decides where they go.  The product of two tables is Spark's, which holds a part of the queries' table at a time.
    """
    entries = _packed(state.select("key", F.col("embedding"), F.col(time).alias("time")), "embedding", "entries", block)
    asked = _packed(queries.select("query_id", F.col("embedding").alias("q")), "q", "asked", lot)
    kinds = [*state.select("key", "embedding", F.col(time).alias("time")).schema.fields, *queries.select("query_id", F.col("embedding").alias("q")).schema.fields]

    def run(batches):
        for batch in batches:
            for mine, theirs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = (pa.ipc.open_stream(x).read_all().combine_chunks() for x in (mine, theirs))
                left = left.take(pc.sort_indices(left, [("time", "descending"), ("key", "descending")]))
                for i, j in _near(_units(left.column("embedding")), _units(right.column("q")), k, min_similarity, digits):
                    yield from pa.Table.from_arrays([*left.take(i).columns, *right.take(j).columns], [f.name for f in kinds]).combine_chunks().to_batches()

    near = entries.crossJoin(asked).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds))
    hit = near.withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("q")), digits)).where(F.col("similarity") >= min_similarity)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("time"), F.desc("key"))
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "similarity", "rank")


def _packed(rows: DataFrame, vector: str, name: str, size: int) -> DataFrame:
    """Rows with a vector as binary blocks of at most `size` rows, cut where they lie."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                own = batch.slice(at, size)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], [name])

    return written(rows.where(F.col(vector).isNotNull()).mapInArrow(run, f"{name} binary"), name)


def _units(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their places, unit vectors, and which of them have a length that can't be divided by safely."""
    sizes = np.asarray(pc.list_value_length(vectors))
    out = {}
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        parts = vectors.take(pa.array(at)).combine_chunks().flatten()
        grid = np.asarray(parts.cast(pa.float64()).fill_null(0.0)).reshape(len(at), size).copy()
        grid[np.asarray(parts.is_null()).reshape(len(at), size).any(axis=1)] = 0  # an unknown component: no similarity to anything
        with np.errstate(all="ignore"):
            length = np.sqrt((grid * grid).sum(axis=1))
            odd = ~((length > 1e-100) & (length < 1e100)) & (grid != 0).any(axis=1)
            out[size] = at, np.divide(grid, length[:, None], out=np.zeros_like(grid), where=(~odd & (length > 0))[:, None]), odd
    return out


def _near(left: dict, right: dict, k: int, least: float, digits: int):
    """(places left, places right) of pairs that can be among the k best of a place on the right: of equally similar ones the first on the left."""
    for size, (at, units, odd) in left.items():
        if size not in right:
            continue
        to, asked, strange = right[size]
        scores = asked @ units.T
        scores[strange] = np.inf
        scores[:, odd] = np.inf
        coarse = np.round(scores, digits)
        for row in range(len(to)):
            own = np.flatnonzero(coarse[row] >= least - 2 * 10.0**-digits)
            plain = own[np.isfinite(coarse[row, own])]
            best = plain[np.argsort(-coarse[row, plain], kind="stable")[:k]]
            found = np.concatenate([best, own[np.isinf(coarse[row, own])]])
            if len(found):
                yield pa.array(at[found]), pa.array(np.full(len(found), to[row]))


def record_recall(state: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """recall_count + 1 and last_recalled_at = now, once for each row that was recalled."""
    seen = hits.select("key").distinct().withColumn("hit", F.lit(True))
    out = state.join(seen, "key", "left")
    return out.withColumn("recall_count", F.coalesce("recall_count", F.lit(0)) + F.coalesce(F.col("hit").cast("int"), F.lit(0))).withColumn("last_recalled_at", F.when(F.col("hit"), now).otherwise(F.col("last_recalled_at"))).drop("hit")


def validate_ops(ops: DataFrame, batch: str = "conv_id", most: int = 10) -> DataFrame:
    """Adds `reason`, null for valid operations: keys, values, importance, enums and the size of a batch."""
    n = F.count("*").over(Window.partitionBy(batch))
    return ops.withColumn(
        "reason",
        F.when(~F.coalesce(F.col("action").isin("upsert", "delete"), F.lit(False)), "action").when(~F.coalesce(F.col("key").rlike(KEY_PATTERN) & (F.length("key") <= 80), F.lit(False)), "key")
        .when((F.col("action") == "upsert") & (F.trim(F.coalesce("value", F.lit(""))) == ""), "blank value").when(F.length("value") > 300, "long value")
        .when(~F.coalesce(F.col("importance"), F.lit(0.5)).between(0, 1), "importance").when(n > most, "batch"),
    )


def apply_ops(state: DataFrame, ops: DataFrame) -> DataFrame:
    """Keyed state(conv_id, category, key, value, created_turn, updated_turn) after a log of ops(…, seq, turn, action, value).

    The last effective operation of a key decides; an upsert keeps the turn since which the key lives without a
    delete between; a value that stays equal isn't an update; sensitive operations don't count.
    """
    keys = ["conv_id", "category", "key"]
    log = ops.where(~is_sensitive(F.col("key")) & ~F.coalesce(is_sensitive(F.col("value")), F.lit(False))).select(*keys, "seq", "turn", "action", "value", F.lit(None).cast("long").alias("was_created"))
    start = state.select(*keys, F.lit(-1).cast("long").alias("seq"), F.col("updated_turn").alias("turn"), F.lit("upsert").alias("action"), "value", F.col("created_turn").alias("was_created"))
    order = Window.partitionBy(*keys).orderBy("seq")
    log = start.unionByName(log).withColumn("life", F.sum((F.col("action") == "delete").cast("int")).over(order))
    within = Window.partitionBy(*keys, "life").orderBy("seq")
    ups = log.where("action = 'upsert'").withColumn("old", F.lag("value").over(within))
    ups = ups.withColumn("change", F.when(F.col("old").isNull() | (F.col("old") != F.col("value")), F.col("turn")))
    last = log.groupBy(*keys).agg(F.max("life").alias("life"))
    live = ups.join(last, [*keys, "life"], "left_semi").groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.coalesce(F.max("was_created"), F.min("turn")).alias("created_turn"), F.max("change").alias("updated_turn"))
    return live


def evict(state: DataFrame, cap: int = 30) -> DataFrame:
    """The `cap` most recently updated entries of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("updated_turn"), F.desc("created_turn"), F.desc("key"))
    return state.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")


def apply_semantic_ops(state: DataFrame, ops: DataFrame, now: Column, cap: int | None = None, retention_days: float = 30) -> DataFrame:
    """state(category, key, value, importance, created_at, updated_at, recall_count, last_recalled_at, embedding) after one batch.

    Facts only; deletes act before upserts; an upsert of equal value and importance changes nothing, another keeps
    created_at and recalls; a dimension other than the state's rejects the batch.  Values are trimmed.  With a `cap` what is forgotten
    after `retention_days` goes, and of the rest the `cap` facts of lowest forgetting score stay.
    """
    keys = ["category", "key"]
    good = ops.where((F.col("category") == "fact") & ~is_sensitive(F.col("key")) & ~F.coalesce(is_sensitive(F.col("value")), F.lit(False)))
    good = good.withColumn("value", F.regexp_replace("value", r"^\s+|\s+$", ""))
    new = good.where("action = 'upsert'").groupBy(*keys).agg(*[F.max_by(c, "seq").alias(f"new_{c}") for c in ("value", "importance", "embedding")])
    sizes = {r[0] for r in state.select(F.size("embedding")).union(new.select(F.size("new_embedding"))).distinct().limit(3).collect()}
    if len(sizes) > 1:
        return state
    old = state.join(good.where("action = 'delete'").select(*keys).distinct(), keys, "left_anti")
    both = old.join(new, keys, "full_outer")
    changed = F.col("new_value").isNotNull() & ~(F.col("value").eqNullSafe(F.col("new_value")) & F.col("importance").eqNullSafe(F.col("new_importance")))
    pick = lambda c: F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    out = both.select(*keys, pick("value"), pick("importance"), F.coalesce("created_at", now).alias("created_at"), F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"), F.coalesce("recall_count", F.lit(0)).alias("recall_count"), "last_recalled_at", pick("embedding"))
    return out if cap is None else prune(out, now, retention_days, cap, "key").drop("score")


#: What stands in for a missing reflection or a blank field.
NO_SUMMARY, NO_STRATEGY = "无可用摘要", "无可用策略"
FAILED = ("任务执行期间发生异常。", "执行在异常点终止，已保留脱敏轨迹供后续排查。")
UNREFLECTED = ("任务已返回结果，但自动反思未能完成。", "保留已执行的脱敏工具轨迹，供后续人工复盘。", "反思器失败: ")


def record_episodes(runs: DataFrame, now: Column | None = None, cap: int = 500, retention_days: float = 90) -> DataFrame:
    """runs(id, task, outcome, error, summary, created_at[, strategy, lessons, pitfalls, steps, error_text, reflection_error]) -> redacted and capped episodes.

    A run without a summary has no reflection: fixed texts and the error's text stand in for it, and its outcome is failure after an error, else
    partial.  Lists keep five entries of 300 characters, blank ones go; steps(tool, args, result_preview) keep 100, args as cleaned JSON.
    Blank tasks are skipped.  With `now`, forgotten episodes go and the `cap` of lowest forgetting score stay.
    """
    for name, kind in (("strategy", "string"), ("lessons", "array<string>"), ("pitfalls", "array<string>"), ("error_text", "string"), ("reflection_error", "string")):
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kind))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cap_text = lambda c, n, blank: F.coalesce(F.nullif(F.substring(redact_secrets(text(c)), 1, n), F.lit("")), F.lit(blank))
    failed, bare = F.coalesce("error", F.lit(False)), F.col("summary").isNull()
    outcome = F.when(failed, "failure").otherwise(F.when(bare, "partial").otherwise(F.coalesce("outcome", F.lit("partial"))))
    few = lambda c: F.filter(F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 5), lambda x: F.substring(redact_secrets(x), 1, 300)), lambda x: x.rlike(r"\S"))
    instead = F.when(failed, F.array(F.substring(redact_secrets(text("error_text")), 1, 300))).otherwise(F.array(F.concat(F.lit(UNREFLECTED[2]), F.substring(redact_secrets(text("reflection_error")), 1, 240))))
    kept = runs.where(F.trim(text("task")) != "")
    out = kept.select(
        "id", F.substring(redact_secrets(F.col("task")), 1, 2000).alias("task"), outcome.alias("outcome"),
        F.when(bare, F.when(failed, FAILED[0]).otherwise(UNREFLECTED[0])).otherwise(cap_text("summary", 800, NO_SUMMARY)).alias("summary"),
        F.when(bare, F.when(failed, FAILED[1]).otherwise(UNREFLECTED[1])).otherwise(cap_text("strategy", 800, NO_STRATEGY)).alias("strategy"),
        F.when(bare, F.array().cast("array<string>")).otherwise(few(F.col("lessons"))).alias("lessons"), F.when(bare, instead).otherwise(few(F.col("pitfalls"))).alias("pitfalls"),
        outcome_importance(outcome, F.col("error")).alias("importance"), "created_at", F.lit(0).alias("recall_count"), F.lit(None).cast("timestamp").alias("last_recalled_at"),
    )
    if "steps" in runs.columns:
        one = kept.select("id", F.posexplode(F.slice("steps", 1, 100)).alias("at", "s"))
        clean = F.struct("at", F.substring("s.tool", 1, 100).alias("tool"), sanitize_json(F.col("s.args")).alias("args"), F.substring(redact_secrets(F.coalesce("s.result_preview", F.lit(""))), 1, 500).alias("result_preview"))
        steps = one.select("id", clean.alias("s")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x.dropFields("at")).alias("steps"))
        out = out.join(steps, "id", "left")
    return out if now is None else prune(out, now, retention_days, cap, "id", time="created_at").drop("score")


def _first_at_least(rows: DataFrame, total: str, asked: Column) -> DataFrame:
    """(conv_id, pos, at): the first place whose running total reaches what each row asks for; both are sorted together once."""
    marks = rows.select("conv_id", F.col(total).alias("key"), F.lit(1).alias("kind"), "pos").unionAll(rows.select("conv_id", asked.alias("key"), F.lit(0).alias("kind"), "pos"))
    ahead = Window.partitionBy("conv_id").orderBy(F.desc("key"), F.desc("kind"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("at", F.min(F.when(F.col("kind") == 1, F.col("pos"))).over(ahead)).where("kind = 0").select("conv_id", "pos", "at")


def _reached(jumps: DataFrame) -> DataFrame:
    """jumps(conv_id, pos, to) -> (conv_id, pos): what is reached from place 1, by doubling the jumps round after round."""
    found = written(jumps.where("pos = 1").select("conv_id", "pos"), "reached")
    while True:
        new = found.join(jumps, ["conv_id", "pos"]).where("to is not null").select("conv_id", F.col("to").alias("pos"))
        more = written(found.unionAll(new).distinct(), "reached")
        twice = jumps.select("conv_id", F.col("pos").alias("to"), F.col("to").alias("next"))
        jumps = written(jumps.where("to is not null").join(twice, ["conv_id", "to"]).where("next is not null").select("conv_id", "pos", F.col("next").alias("to")), "jumps")
        found = more
        if jumps.isEmpty():
            return found


def extraction_batches(turns: DataFrame, tokens: int = 150, mentions: int = 3) -> DataFrame:
    """turns(conv_id, turn, user, assistant) -> conv_id, turn, batch: turns that are extracted together, 0 while pending.

    A batch closes on an explicit signal, or from `tokens` pending tokens on once tools were named often or not in the
    newest turn.  The sums start anew at each batch; so for each turn the end of a batch that would start there is looked up in the
    running sums, and the starts that follow from the first turn are found by doubling the jumps from start to start.
    """
    own = estimate_tokens_mixed(F.coalesce("user", F.lit(""))) + estimate_tokens_mixed(F.coalesce("assistant", F.lit("")))
    tools = F.size(F.regexp_extract_all(F.lower(F.coalesce("assistant", F.lit(""))), F.lit("tool"), F.lit(0))).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", F.coalesce(memory_signal(F.col("user")), F.lit(False)).alias("signal"), own.cast("long").alias("own"), tools.alias("tools"))
    rows = rows.withColumns({"pos": F.row_number().over(order), "cost": F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)), "named": F.sum("tools").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    behind = Window.partitionBy("conv_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumns({"told": F.min(F.when(F.col("signal"), F.col("pos"))).over(behind), "calm": F.min(F.when(F.col("tools") == 0, F.col("pos"))).over(behind)}), "turns")
    full = _first_at_least(rows, "cost", F.col("cost") - F.col("own") + tokens).withColumn("at", F.when(F.col("at").isNotNull(), F.greatest("at", "pos")))
    often = _first_at_least(rows, "named", F.col("named") - F.col("tools") + mentions).withColumnRenamed("at", "often")
    calm = rows.select("conv_id", F.col("pos").alias("at"), F.col("calm").alias("then"))
    ends = rows.select("conv_id", "pos", "told").join(full, ["conv_id", "pos"]).join(often, ["conv_id", "pos"]).join(calm, ["conv_id", "at"], "left")
    both = F.when(F.col("at").isNotNull() & F.col("often").isNotNull(), F.greatest("at", "often", "pos"))
    ends = written(ends.select("conv_id", "pos", F.least("told", "then", both).alias("end")), "ends")
    starts = _reached(ends.select("conv_id", "pos", (F.col("end") + 1).alias("to")))
    opened = starts.join(ends, ["conv_id", "pos"]).where("end is not null").select("conv_id", "pos", "end")
    marked = rows.select("conv_id", "turn", "pos").join(opened, ["conv_id", "pos"], "left")
    number = F.count("end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("conv_id", "turn", F.when(F.col("pos") <= last, number).otherwise(0).cast("long").alias("batch"))


def dedupe_surfaced(hits: DataFrame, seen: DataFrame, known: DataFrame, n: int = 5) -> DataFrame:
    """hits(query_id, name, rank): known names not surfaced before, once each, at most n."""
    fresh = hits.join(seen, ["query_id", "name"], "left_anti").join(known, "name", "left_semi").groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "name")
    return fresh.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def memory_context(entries: DataFrame, prefix: str) -> DataFrame:
    """entries(conv_id, key, value): one line of compact JSON with sorted keys."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    rows = entries.groupBy("conv_id").agg(pairs.alias("p"))
    return rows.select("conv_id", F.concat(F.lit(prefix), F.to_json(F.map_from_entries("p"))).alias("context"))


def _lists(rows: DataFrame, field: str, fields: dict[str, Column], order: list[str]) -> DataFrame:
    """conv_id, content: compact JSON of one list, its objects in the given order and their keys sorted; nulls stay."""
    one = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*order, one.alias("_one")))).alias("l"))
    return got.select("conv_id", F.to_json(F.struct(F.transform("l", lambda x: x["_one"]).alias(field)), {"ignoreNullFields": "false"}).alias("content"))


def context_messages(
    prefixes: dict[str, str], structured: DataFrame | None = None, summaries: DataFrame | None = None, turns: DataFrame | None = None, facts: DataFrame | None = None, episodes: DataFrame | None = None
) -> DataFrame:
    """All memories of a conversation as messages: conv_id, section, position, role, content.

    Sections in order: 0 structured(conv_id, category, key, value), 1 summaries(conv_id, summary), 2 turns(conv_id, turn, user, assistant), a
    message each, 3 facts(conv_id, rank, key, value, score, updated_at), 4 episodes(conv_id, rank, id, task, outcome, summary, strategy, lessons, pitfalls,
    score).  All but the turns are one system message behind its prefix (`structured`, `summary`, `facts`, `episodes`); the JSON is compact
    with sorted keys, similarities are rounded to four places.  A section without rows, and a blank summary, gives no message.
    """
    out = []
    scored = F.round(F.col("score").cast("double"), 4)

    def told(rows: DataFrame, section: int, prefix: str) -> None:
        out.append(rows.select("conv_id", F.lit(section).alias("section"), F.lit(0).cast("long").alias("position"), F.lit("system").alias("role"), F.concat(F.lit(prefixes[prefix]), "content").alias("content")))

    if structured is not None:
        told(_lists(structured, "entries", {k: F.col(k) for k in ("category", "key", "value")}, ["category", "key"]), 0, "structured")
    if summaries is not None:
        told(summaries.where("summary <> ''").select("conv_id", F.col("summary").alias("content")), 1, "summary")
    if turns is not None:
        both = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("role"), F.coalesce(r, F.lit("")).alias("content")) for i, r in enumerate(("user", "assistant"))]))
        rows = turns.select("conv_id", "turn", both.alias("m")).select("conv_id", "turn", "m.*")
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i")).cast("long") - 1
        out.append(rows.select("conv_id", F.lit(2).alias("section"), place.alias("position"), "role", "content"))
    if facts is not None:
        told(_lists(facts, "facts", {"similarity": scored} | {k: F.col(k) for k in ("key", "value", "updated_at")}, ["rank", "key"]), 3, "facts")
    if episodes is not None:
        names = ("id", "task", "outcome", "summary", "strategy", "lessons", "pitfalls")
        told(_lists(episodes, "experiences", {"similarity": scored} | {k: F.col(k) for k in names}, ["rank", "id"]), 4, "episodes")
    if not out:
        raise ValueError("no memories given")
    return functools.reduce(DataFrame.unionByName, out)


def forget(state: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed) by category and key."""
    on = ["category", "key"]
    return state.join(keys.select(*on).distinct(), on, "left_anti"), state.join(keys.select(*on).distinct(), on, "left_semi")


def bounded_transcript(messages: DataFrame, most: int = 12_000, marker: str = "[earlier messages cut]\n") -> DataFrame:
    """User and assistant messages as lines, the tail of them with a mark where something was cut."""
    lines = messages.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    joined = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return joined.select("conv_id", text.alias("t")).select("conv_id", F.when(F.length("t") > most, F.concat(F.lit(marker), F.expr(f"right(t, {most})"))).otherwise(F.col("t")).alias("transcript"))


#: What the system block says before and after the tools' signatures, a line each.
TOOLS_BEFORE = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>\n"
TOOLS_AFTER = (
    "</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n"
    '<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
)


def render_chat_template(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One prompt per conversation, ending in an open assistant message.

    messages(conv_id, turn, role, text[, call_name, call_arguments]): an assistant message with a call shows the call in its text's place, and a
    tool's message is wrapped and given as the user's.  tools(conv_id, position, signature) go into a system block in front, signatures
    being JSON; a conversation without tools has no such block.
    """
    called = "call_name" in messages.columns
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    body = F.when(role == "tool", F.concat(F.lit("<tool_response>\n"), text, F.lit("\n</tool_response>"))).otherwise(text)
    if called:
        call = F.concat(F.lit('<tool_call>\n{"name": "'), "call_name", F.lit('", "arguments": '), F.coalesce("call_arguments", F.lit("{}")), F.lit("}\n</tool_call>"))
        body = F.when((role == "assistant") & F.col("call_name").isNotNull(), call).otherwise(body)
    part = F.concat(F.lit("<|im_start|>"), F.when(role == "tool", "user").otherwise(role), F.lit("\n"), body, F.lit("<|im_end|>\n"))
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("parts"))
    prompt = F.concat(F.array_join(F.transform("parts", lambda x: x["p"]), ""), F.lit("<|im_start|>assistant\n"))
    if tools is None:
        return rows.select("conv_id", prompt.alias("prompt"))
    listed = tools.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "signature"))).alias("tools"))
    lines = F.array_join(F.transform("tools", lambda t: F.concat(t["signature"], F.lit("\n"))), "")
    block = F.concat(F.lit("<|im_start|>system\n" + TOOLS_BEFORE), lines, F.lit(TOOLS_AFTER + "<|im_end|>\n"))
    return rows.join(listed, "conv_id", "left").select("conv_id", F.concat(F.coalesce(block, F.lit("")), prompt).alias("prompt"))


def format_context(hits: DataFrame) -> DataFrame:
    """hits(query_id, rank, source, content): blocks in rank order under their source."""
    part = F.concat(F.lit("[来源: "), "source", F.lit("]\n"), "content")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))).alias("parts"))
    return rows.select("query_id", F.array_join(F.transform("parts", lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def pushed_out(held: list[tuple], budget: int) -> list[tuple]:
    """Takes the oldest of held (cost, user, assistant) away until the rest fits the budget; (user, assistant) of what went."""
    gone, total = [], sum(h[0] for h in held)
    while held and total > budget:
        cost, *turn = held.pop(0)
        total -= cost
        gone.append(tuple(turn))
    return gone


def shortened(summarise, summary: str, gone: list[tuple], cap: int) -> str:
    """The new summary, cut to its longest prefix of at most `cap` tokens; the old one if the summariser fails."""

    def tokens(text: str) -> int:
        plain = sum(ord(c) < 128 for c in text)
        return len(text) - plain + -(-plain // 4)

    try:
        text = summarise(summary, gone)
        low, high = 0, len(text)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if tokens(text[:mid]) <= cap else (low, mid - 1)
        return text[:low]
    except Exception:  # noqa: BLE001  the summariser is the caller's; its failures must not lose the conversation
        return summary


def summary_buffer(turns: DataFrame, summarise, budget: int = 1200, cap: int = 400) -> DataFrame:
    """turns(conv_id, turn, user, assistant) -> conv_id, turn, summary, evicted: after each turn the running summary.

    Turns that an arrival pushes out of the budget go to summarise(old summary, list of (user, assistant)) at once; its
    text is cut to the longest prefix of at most `cap` tokens.  If it fails the old summary stays and the turns go.
    Sums depend on what was evicted before, so this is a fold over each conversation.
    """
    import pyarrow as pa

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("turn")
        held, summary, out = [], "", []
        for turn, user, assistant, cost in zip(*(t.column(c).to_pylist() for c in ("turn", "user", "assistant", "cost")), strict=True):
            held.append((cost, user, assistant))
            gone = pushed_out(held, budget)
            if gone:
                summary = shortened(summarise, summary, gone, cap)
            out.append((key[0].as_py(), turn, summary, len(gone)))
        return pa.table({n: pa.array([o[k] for o in out], kind) for k, (n, kind) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("summary", pa.string()), ("evicted", pa.int64())))})

    rows = turns.select("conv_id", "turn", F.coalesce("user", F.lit("")).alias("user"), F.coalesce("assistant", F.lit("")).alias("assistant"), turn_cost().alias("cost"))
    return rows.groupBy("conv_id").applyInArrow(run, "conv_id long, turn long, summary string, evicted long")
