"""One query per operator, over its whole table, with the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, edits, exact, gif, katz, packing, phrases, pieces, quality, simhash, topk, toxicity, whitening
from quarry.llm.common import fold, table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score_texts(table(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return scored.select(F.col("id").alias("doc_id"), (fold("id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = toxicity.tag_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return tagged.select(F.col("id").alias("doc_id"), (fold("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op4_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = gif.read_frames(gif.store_texts(table(spark, sf_dir, "documents")), carry=True)
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 3 * gif.BINS), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    time = F.aggregate("frames", F.lit(0), lambda a, f: a + f["delay_cs"])
    return frames.select(
        F.col("id").alias("doc_id"), F.col("row.n_bytes").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("centiseconds="), time), F.concat(F.lit("rgb="), F.array_join(total, ","))).alias("feature"), "canvas_sha256",
    )


def op5_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return got.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.size(F.filter(F.arrays_zip("starts", "ends"), lambda s: s["ends"] > s["starts"])).cast("long").alias("n_source_spans"),
    )


def op6_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits per document, at places its id and length decide: a replacement, an insertion, a deletion."""
    docs = table(spark, sf_dir, "documents")
    length = F.coalesce(F.length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(k)), length + 1)
    change = lambda at, gone, new: F.struct(at.cast("long").alias("at"), F.lit(gone).cast("long").alias("deleted"), F.lit(new).alias("inserted"))
    docs = docs.withColumn("edits", F.array(change(place(1), 7, " revised, once"), change(place(2), 0, "   \nA new line 42"), change(place(3), 40, "")))
    ranks = public_tokenizers.path(BYTE_RANKS)
    done = edits.apply_edits(edits.build_trees(docs.select("doc_id", "text", "edits"), ranks, carry=True), ranks)
    return done.select(F.col("id").alias("doc_id"), F.col("n_before").alias("tokens_before"), F.col("n_tokens").alias("tokens_after"), "n_edits", "reencoded_chars", F.sha2(F.col("text").cast("binary"), 256).alias("edited_sha256"))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat.format_trees(chat.linear_tree(rows, "conv_id", "turn", "role", "text"))
    turns = chat.read_chat(F.col("chat"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(F.substr("chat", (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))), "")
    done = done.withColumn("told", told).withColumn("loss", loss)
    return done.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("chat").cast("long").alias("formatted_chars"),
    )


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_differencing_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whitened_components(table(spark, sf_dir, "embeddings"))
    return done.withColumn("deviation", F.col("deviation").cast("long"))  # one that no long can hold is an error


def op12_bidirectional_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), largest=True)


SQL: dict[str, str] = {
    "op12_bidirectional_phrases": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
        worded as (select lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
        placed as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded),
        grams as (select lang, w[i : i + k - 1] as g, k from placed, (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w)),
        f as (select lang, array_to_string(g, ' ') as phrase, any_value(g) as g, any_value(k) as k, count(*) as f from grams group by 1, 2),
        totals as (select lang, sum(f)::bigint as n from f where k = 1 group by 1),
        candidates as (select * from f where k > 1 and f >= 100),
        cuts as (select lang, phrase, g, k, f, unnest(range(1, k)) as cut from candidates),
        scored as (
            select c.lang, c.phrase, c.f as a, x.f as l, y.f as r, n, (1000::hugeint * c.f * n // (x.f::hugeint * y.f))::bigint as score,
                row_number() over (partition by c.lang, c.phrase order by 1000::hugeint * c.f * n // (x.f::hugeint * y.f), cut) as place
            from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.g[1 : cut], ' ')
            join f y on y.lang = c.lang and y.phrase = array_to_string(c.g[cut + 1 : c.k], ' ') join totals t on t.lang = c.lang),
        inside as (
            select lang, array_to_string(g[i : i + size - 1], ' ') as phrase, max(f) as longer
            from (select *, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from candidates)) group by 1, 2),
        kept as (select s.* from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase where place = 1 and (longer is null or 100 * longer < 100 * a)),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000""",
    "op13_patricia_owners": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_katz_scores, op2_pu_quality, op3_toxic_spans, op4_gif_frames, op5_offset_pieces, op6_impact_topk, op7_edit_counts, op8_reply_trees, op9_simhash_trie, op10_differencing_packer, op11_exact_whitening, op12_bidirectional_phrases, op13_patricia_owners)}
