"""Registered queries on text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vectors import cosine, valid_vector
from quarry.operators import bpe, chunking, classify, evaluation, memory
from quarry.plans.stages import written

REGISTRY: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        REGISTRY[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
WORDS = f"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND NOT list_contains([{STOP}], x))"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+|[^\\sa-z0-9]')"
EST = "(length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) + CAST(ceil(length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) / 4.0) AS BIGINT))"


@query("""
WITH w AS (SELECT doc_id, source, i, regexp_replace(substring(text, i + 1, 500), '^\\s+|\\s+$', '', 'g') AS content
           FROM documents, unnest(range(0, greatest(length(text), 1), 450)) AS t(i))
SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total, content
FROM w WHERE content <> ''""")
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return chunking.chunk_documents(docs, "fixed").select("doc_id", "source", F.col("chunk_index").cast("long"), F.col("chunk_total").cast("long"), "content")


@query()
def chunk_sentences(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence")


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "recursive")


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents")
def tokenize_mixed(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokenize_mixed(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, array_to_string({WORDS}, ' ') AS words FROM documents")
def preprocess_english(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.preprocess_english(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, {EST.format('text')} AS mixed, CAST(floor(length(text) / 4) AS BIGINT) AS quarter FROM documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens_mixed(F.col("text")).alias("mixed"), T.estimate_tokens_quarter(F.col("text")).alias("quarter"))




def _redacted(x: str) -> str:
    for pattern, by in ((T.PEM_BLOCK, "[REDACTED PRIVATE KEY]"), (T.BEARER, "Bearer [REDACTED]"), (T.PREFIXED_KEY, "[REDACTED]"), (T.ASSIGNED, "\\1\\2[REDACTED]")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_NOTE = "concat(text, ' note ', doc_id, CASE source WHEN 'src1' THEN ' api_key = ab12, x' WHEN 'src2' THEN ' Bearer abc.def=' WHEN 'src3' THEN ' sk-abcdefgh12' ELSE '' END)"


@query(f"SELECT doc_id, {_redacted(_NOTE)} AS redacted, regexp_matches({_NOTE}, '{T.SENSITIVE_LABEL}') OR {_redacted(_NOTE)} <> {_NOTE} AS sensitive FROM documents")
def redact_secrets(spark, sf_dir):
    secret = F.when(F.col("source") == "src1", " api_key = ab12, x").when(F.col("source") == "src2", " Bearer abc.def=").when(F.col("source") == "src3", " sk-abcdefgh12").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" note "), F.col("doc_id").cast("string"), secret).alias("note"))
    return docs.select("doc_id", T.redact_secrets(F.col("note")).alias("redacted"), T.is_sensitive(F.col("note")).alias("sensitive"))


_SIGNS = "".join("\\" + c if ord(c) < 128 else c for c in T.QUALITY_SIGNS).replace("'", "''")
_VIS = "regexp_replace(text, '\\s', '', 'g')"


@query(f"""
WITH v AS (SELECT doc_id, {_VIS} AS v FROM documents),
n AS (SELECT doc_id, length(v) AS n, length(v) - length(regexp_replace(v, '[\\p{{L}}\\p{{N}}{T.CJK}{_SIGNS}]', '', 'g')) AS good,
      length(v) - length(regexp_replace(v, '[\\x{{FFFD}}\\x00-\\x1F\\x{{E000}}-\\x{{F8FF}}]', '', 'g')) AS bad FROM v)
SELECT doc_id, CASE WHEN n = 0 THEN 1.0 ELSE round(greatest(0.0, (good - bad) / CAST(n AS DOUBLE)), 9) END AS quality FROM n""")
def text_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 9).alias("quality"))


@query("SELECT p_partkey, trim(regexp_replace(upper(concat('  ', p_name, '  x ')), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_name(F.concat(F.lit("  "), "p_name", F.lit("  x "))).alias("name"))


@query("""
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 9).alias("similarity"))


@query("SELECT label, count(*) AS n, count(*) FILTER (len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x) OR isinf(x)))) AS valid, count(DISTINCT len(embedding)) AS dimensions FROM embeddings GROUP BY label")
def valid_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(valid_vector(F.col("embedding"))).alias("valid"), F.count_distinct(F.size("embedding")).alias("dimensions"))


@query("""
SELECT doc_id, CASE WHEN coalesce(CASE WHEN lang = 'en' THEN NULL ELSE 'd' || doc_id END, CASE WHEN lang = 'en' AND source = 'src1' THEN NULL ELSE source END) IS NULL THEN text
  ELSE concat_ws('|', coalesce(CASE WHEN lang = 'en' THEN NULL ELSE 'd' || doc_id END, CASE WHEN lang = 'en' AND source = 'src1' THEN NULL ELSE source END), 'part=' || CASE WHEN lang = 'fr' THEN NULL ELSE n_chars % 7 END, 'chunk=' || doc_id % 3) END AS chunk_key
FROM documents""")
def chunk_key(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.when(F.col("lang") != "en", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    path = F.when(~((F.col("lang") == "en") & (F.col("source") == "src1")), F.col("source"))
    return d.select("doc_id", T.chunk_key(key, path, F.lit(None).cast("string"), F.when(F.col("lang") != "fr", F.col("n_chars") % 7), F.col("doc_id") % 3, F.col("text")).alias("chunk_key"))


@query("""
SELECT conv_id, turn, CASE WHEN contains(t, '天气') OR contains(t, 'weather') OR contains(t, '下雨') OR contains(t, '温度') THEN 'ask_weather'
  WHEN contains(t, '你好') OR contains(t, 'hi') OR contains(t, 'hello') THEN 'greet' WHEN contains(t, '炸弹') OR contains(t, '攻击') OR contains(t, '违法') THEN 'unsafe' ELSE 'general' END AS intent,
  CASE WHEN contains(t, '天气') OR contains(t, 'weather') OR contains(t, '下雨') OR contains(t, '温度') THEN CAST(0.92 AS DOUBLE)
  WHEN contains(t, '你好') OR contains(t, 'hi') OR contains(t, 'hello') THEN 0.95 WHEN contains(t, '炸弹') OR contains(t, '攻击') OR contains(t, '违法') THEN 0.99 ELSE 0.55 END AS confidence
FROM (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations)""")
def classify_keywords(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.classify_keywords(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", "c.intent", "c.confidence")


@query("SELECT doc_id, array_to_string(list_filter(['trash', 'idiot', 'loser', '攻击'], lambda w: contains(text, w)), ',') AS hits FROM documents")
def blocklist_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.blocklist_hits(F.col("text"), ["trash", "idiot", "loser", "攻击"]), ",").alias("hits"))


@query(f"SELECT conv_id, turn, regexp_matches(concat(text, CASE WHEN turn % 3 = 0 THEN ' please remember this' ELSE '' END), '{T.MEMORY_SIGNAL}') AS signal FROM conversations")
def memory_signal(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.memory_signal(F.concat("text", F.when(F.col("turn") % 3 == 0, " please remember this").otherwise(""))).alias("signal"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_REPLY = "concat(text, CASE WHEN turn % 2 = 0 THEN concat('\\nSo, the answer is ', conv_id, '.') ELSE '' END)".replace("\\n", "' || chr(10) || '")


@query(f"""
WITH r AS (SELECT conv_id, turn, {_REPLY} AS t FROM conversations)
SELECT conv_id, turn,
  CASE WHEN regexp_matches(t, '{T.ANSWER}') THEN {_STRIP.format("regexp_replace(t, '" + T.ANSWER + "', '')")} ELSE {_STRIP.format("array_to_string(string_split(" + _STRIP.format("t") + ", chr(10))[:-2], chr(10))")} END AS reasoning,
  CASE WHEN regexp_matches(t, '{T.ANSWER}') THEN {_STRIP.format("regexp_extract(t, '" + T.ANSWER + "', 1)")} ELSE {_STRIP.format("string_split(" + _STRIP.format("t") + ", chr(10))[-1]")} END AS answer
FROM r""")
def extract_final_answer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    reply = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nSo, the answer is "), F.col("conv_id").cast("string"), F.lit("."))).otherwise(""))
    return c.select("conv_id", "turn", T.extract_final_answer(reply).alias("r")).select("conv_id", "turn", "r.reasoning", "r.answer")


_L1 = "list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || '1. '), '\\r\\n|\\n|\\r'), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(- |\\* |• )', ''))"
_L2 = f"list_transform({_L1}, lambda x: regexp_replace(CASE WHEN regexp_matches(x, '^[0-9][.、)]') AND length(x) > 2 THEN substring(x, 3) WHEN regexp_matches(x, '^[0-9]{{2}}[.、)]') AND length(x) > 3 THEN substring(x, 4) ELSE x END, '^\\s+|\\s+$', '', 'g'))"


@query(f"SELECT item_id, array_to_string(list_filter({_L2}, lambda x: x <> '')[1:3], chr(10)) AS lines FROM benchmark")
def parse_query_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(T.parse_query_lines(F.replace("text", F.lit(". "), F.lit("\n1. "))), "\n").alias("lines"))


@query("""
SELECT conv_id, concat(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn), '<|im_start|>assistant', chr(10)) AS prompt
FROM conversations GROUP BY conv_id""")
def render_chat_template(spark, sf_dir):
    return memory.render_chat_template(table(spark, sf_dir, "conversations"))


_TOOL_LINES = """chr(10) || '{"name": "find", "conv": ' || conv_id || '}' || chr(10) || '{"name": "sum", "turns": ' || count(*) || '}' || chr(10)"""


@query(f"""
WITH m AS (SELECT *, CASE WHEN role = 'user' AND turn % 4 = 2 THEN 'tool' ELSE role END AS kind FROM conversations),
p AS (SELECT conv_id, turn, '<|im_start|>' || CASE WHEN kind = 'tool' THEN 'user' ELSE kind END || chr(10) ||
  CASE WHEN kind = 'tool' THEN '<tool_response>' || chr(10) || coalesce(text, '') || chr(10) || '</tool_response>'
       WHEN kind = 'assistant' AND turn % 4 = 1 THEN '<tool_call>' || chr(10) || '{{"name": "find", "arguments": {{"turn": ' || turn || '}}}}' || chr(10) || '</tool_call>' ELSE coalesce(text, '') END || '<|im_end|>' || chr(10) AS part FROM m)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '' ELSE '<|im_start|>system' || chr(10) || '{memory.TOOLS_BEFORE.rstrip()}' || {_TOOL_LINES} || '{memory.TOOLS_AFTER}' || '<|im_end|>' || chr(10) END || string_agg(part, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt
FROM p GROUP BY conv_id""")
def render_tool_template(spark, sf_dir):
    """Every fourth user message stands for a tool's answer, the one before for the call; two thirds of the conversations have two tools."""
    c = table(spark, sf_dir, "conversations")
    calls = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    messages = c.withColumns({
        "call_name": F.when(calls, "find"), "call_arguments": F.when(calls, F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))),
        "role": F.when((F.col("role") == "user") & (F.col("turn") % 4 == 2), "tool").otherwise(F.col("role")),
    })
    counted = c.groupBy("conv_id").agg(F.count("*").alias("n")).where("conv_id % 3 <> 0")
    signature = lambda name, field, value: F.concat(F.lit(f'{{"name": "{name}", "{field}": '), value.cast("string"), F.lit("}"))
    tools = counted.select("conv_id", F.posexplode(F.array(signature("find", "conv", F.col("conv_id")), signature("sum", "turns", F.col("n")))).alias("position", "signature"))
    return memory.render_chat_template(messages, tools)


@query("""
WITH t AS (SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS t FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 1000 THEN '[earlier messages cut]' || chr(10) || right(t, 1000) ELSE t END AS transcript FROM t""")
def bounded_transcript(spark, sf_dir):
    return memory.bounded_transcript(table(spark, sf_dir, "conversations"), most=1000)


@query("""
SELECT event_id, CASE WHEN try_cast(j AS JSON) IS NOT NULL THEN j ELSE '{}' END AS object
FROM (SELECT event_id, regexp_extract('reply: ' || props || ' done', '(?s)\\{.*\\}') AS j FROM events)""")
def extract_json_object(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.extract_json_object(F.concat(F.lit("reply: "), "props", F.lit(" done"))).alias("object"))


@query("SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w")
def word_freq(spark, sf_dir):
    return classify.word_freq(table(spark, sf_dir, "documents"))


_WF = "(SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w)"


@query(f"SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(list_append(string_split(word, ''), '</w>')) AS token, freq FROM {_WF}) GROUP BY token")
def char_freq(spark, sf_dir):
    return classify.char_freq(classify.word_freq(table(spark, sf_dir, "documents")))


@query(f"""
WITH t AS (SELECT list_append(string_split(word, ''), '</w>') AS t, freq FROM {_WF}),
p AS (SELECT t[i] AS "left", t[i + 1] AS "right", freq FROM t, unnest(range(1, len(t))) AS r(i))
SELECT "left", "right", CAST(sum(freq) AS BIGINT) AS freq FROM p GROUP BY ALL""")
def pair_freq(spark, sf_dir):
    words = classify.word_freq(table(spark, sf_dir, "documents"))
    return classify.pair_freq(words.select(F.concat(F.split("word", ""), F.array(F.lit("</w>"))).alias("tokens"), "freq"))


@query(f"""
SELECT word AS token, row_number() OVER (ORDER BY freq DESC, word) + 3 AS id FROM {_WF}
UNION ALL SELECT unnest(['<PAD>', '<UNK>', '<BOS>', '<EOS>']), unnest([0, 1, 2, 3])""")
def build_vocab(spark, sf_dir):
    return bpe.build_vocab(classify.word_freq(table(spark, sf_dir, "documents")).withColumnRenamed("word", "token"), order="freq")


@query("SELECT doc_id, w AS word, count(*) AS count FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def count_vectors(spark, sf_dir):
    return classify.count_vectors(table(spark, sf_dir, "documents"))


_TFIDF = f"""
w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
c AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
v AS (SELECT word, count(*) AS df FROM c GROUP BY word ORDER BY sum(c) DESC, word LIMIT 1000),
f AS (SELECT c.doc_id, c.word, c.c / CAST(len(w.ws) AS DOUBLE) * ln((SELECT count(*) FROM documents) / (1.0 + v.df)) AS weight FROM c JOIN v USING (word) JOIN w USING (doc_id))"""


@query(f"WITH {_TFIDF} SELECT doc_id, word, round(weight, 9) AS weight FROM f")
def tfidf(spark, sf_dir):
    return classify.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


_NB = """
l AS (SELECT doc_id, quality AS label FROM labels WHERE quality IS NOT NULL),
cl AS (SELECT label, count(*) AS n FROM l GROUP BY label),
own AS (SELECT label, word, sum(weight) AS s FROM f JOIN l USING (doc_id) GROUP BY ALL),
m AS (SELECT label, sum(s) AS mass FROM own GROUP BY label),
p AS (SELECT label, ln(n / CAST((SELECT count(*) FROM l) AS DOUBLE)) AS lp, coalesce(mass, 0) + (SELECT count(DISTINCT word) FROM f) AS bottom FROM cl LEFT JOIN m USING (label)),
wt AS (SELECT own.label, word, CASE WHEN s + 1 > 0 THEN ln((s + 1) / bottom) END AS log_p FROM own JOIN p USING (label)),
k AS (SELECT f.* FROM f WHERE word IN (SELECT word FROM wt)),
b AS (SELECT doc_id, sum(weight) AS w FROM k GROUP BY doc_id),
g AS (SELECT doc_id, wt.label, sum(weight * (log_p - ln(1 / bottom))) AS g FROM k JOIN wt USING (word) JOIN p ON p.label = wt.label GROUP BY ALL),
s AS (SELECT d.doc_id, p.label, round(lp + coalesce(w, 0) * ln(1 / bottom) + coalesce(g, 0), 6) AS ls FROM documents d CROSS JOIN p LEFT JOIN b USING (doc_id) LEFT JOIN g ON g.doc_id = d.doc_id AND g.label = p.label)
SELECT doc_id, label, ls AS log_score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ls DESC, label) = 1"""


@query("WITH f AS (SELECT doc_id, w AS word, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL)," + _NB)
def multinomial_nb(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    f = written(classify.count_vectors(docs).select("doc_id", "word", F.col("count").cast("double").alias("weight")), "features")
    return classify.multinomial_nb_predict(f, docs, classify.multinomial_nb_fit(f, labels), digits=6).select("doc_id", "label", "log_score")


@query(f"WITH {_TFIDF}, {_NB}")
def tfidf_nb(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    f = classify.tfidf(docs)
    return classify.multinomial_nb_predict(f, docs, classify.multinomial_nb_fit(f, labels), digits=6).select("doc_id", "label", "log_score")


_GNB_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LOGPDF = " ".join(f"- 0.5 * ln(2 * pi() * (v_{f} + 1e-10)) - pow(CAST({f} AS DOUBLE) - m_{f}, 2) / (2 * (v_{f} + 1e-10))" for f in _GNB_FEATURES)


@query(f"""
WITH m AS (SELECT l_returnflag AS label, count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS prior, {', '.join(f'avg(CAST({f} AS DOUBLE)) AS m_{f}, var_pop(CAST({f} AS DOUBLE)) AS v_{f}' for f in _GNB_FEATURES)} FROM lineitem GROUP BY 1),
s AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS line_id, label, round(ln(prior) {_LOGPDF}, 5) AS ls FROM lineitem CROSS JOIN m)
SELECT line_id, label, ls AS log_score FROM s QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY ls DESC, label) = 1""")
def gaussian_nb(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("line_id"), F.col("l_returnflag").alias("label"), *[F.col(f).cast("double").alias(f) for f in _GNB_FEATURES])
    model = classify.gaussian_nb_fit(rows, _GNB_FEATURES)
    return classify.gaussian_nb_predict(rows, model, _GNB_FEATURES, "line_id", digits=5).select("line_id", "label", "log_score")


@query("""
WITH c AS (SELECT l_linestatus AS value, l_returnflag AS label, count(*) AS b FROM lineitem GROUP BY ALL),
o AS (SELECT *, sum(b) OVER (PARTITION BY value) AS nv, sum(b) OVER (PARTITION BY label) AS nl, sum(b) OVER () AS n FROM c)
SELECT value, label, round((nl / n) * (b / nl) / (nv / n), 9) AS posterior FROM o""")
def categorical_posterior(spark, sf_dir):
    return classify.categorical_posterior(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag").withColumn("posterior", F.round("posterior", 9))


@query("""
SELECT vec_id, round(ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))))) + list_max(embedding) - embedding[label + 1], 6) AS loss
FROM embeddings WHERE label BETWEEN 0 AND len(embedding) - 1""")
def cross_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label between 0 and size(embedding) - 1")
    return e.select("vec_id", F.round(classify.cross_entropy(F.col("embedding"), F.col("label")), 6).alias("loss"))


@query("""
WITH x AS (SELECT CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS y, CASE WHEN contains(d.text, '|') OR contains(d.text, '%%%') THEN 0 ELSE 1 END AS p FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM x)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.coalesce("quality", F.lit(0)).alias("label"), (~(F.col("text").contains("|") | F.col("text").contains("%%%"))).cast("int").alias("predicted"))
    return evaluation.confusion_metrics(rows).select("tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("""
WITH w AS (SELECT source, length(regexp_replace(substring(text, i + 1, 500), '^\\s+|\\s+$', '', 'g')) AS n FROM documents, unnest(range(0, greatest(length(text), 1), 450)) AS t(i)),
c AS (SELECT source, count(*) AS chunks, max(n) AS longest, round(avg(n), 6) AS mean_chunk FROM w WHERE n > 0 GROUP BY source),
d AS (SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source)
SELECT source, documents, chars, chunks, longest, mean_chunk FROM d LEFT JOIN c USING (source)""")
def corpus_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return classify.corpus_summary(docs, chunking.chunk_documents(docs, "fixed")).withColumn("mean_chunk", F.round("mean_chunk", 6))


@query()
def bpe_round_trip(spark, sf_dir):
    """A vocabulary of sixty merges beyond its characters from all documents, encoding them and reading them back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chars = classify.char_freq(classify.word_freq(docs)).where("freq >= 2").count()
    vocab, merges = bpe.bpe_train(docs, chars + 4 + 60)
    coded = bpe.bpe_encode(docs, vocab, merges)
    back = bpe.bpe_decode(coded, vocab, one_each=True)
    told = back.select("doc_id", F.length("text").alias("n_chars_back"), F.sha2("text", 256).alias("back_sha256"))
    return coded.select("doc_id", F.size("ids").alias("n_ids")).join(told, "doc_id")


@query()
def bpe_text_vocabulary(spark, sf_dir):
    """A vocabulary whose pairs may cross word ends, from all whole conversations: ten merges."""
    texts = table(spark, sf_dir, "conversations").select("text")
    vocab, merged = bpe.bpe_train_text(texts, 1 << 20, 9)
    return vocab.withColumn("merged", F.col("token").isin(merged))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substring(md5('42:' || doc_id), 1, 3) AS INTEGER) < 3686 THEN 'train' ELSE 'test' END AS part FROM documents")
def split_dataset(spark, sf_dir):
    return bpe.split_dataset(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "part")


@query("""
WITH r AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: ord(c)) AS ids FROM conversations),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS n FROM r)
SELECT conv_id, turn, array_to_string(list_resize(ids, n, 0), ',') AS ids FROM m""")
def pad_batches(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ids = F.transform(F.split("text", ""), lambda x: F.expr("0") + F.call_function("ascii", x))
    rows = c.select("conv_id", "turn", ids.alias("ids"))
    return bpe.pad_batches(rows, "conv_id").select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(100 * CAST(x AS DOUBLE)) AS BIGINT)) AS ids FROM embeddings),
w AS (SELECT vec_id, ids[1:20] AS source, list_append(list_prepend(2, ids[1:18]), 3) AS whole FROM r)
SELECT vec_id, array_to_string(source, ',') AS source, array_to_string(whole[1:len(whole) - 1], ',') AS input, array_to_string(whole[2:], ',') AS label FROM w""")
def training_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    ids = F.transform("embedding", lambda x: F.floor(100 * x.cast("double")))
    pairs = bpe.training_pairs(e.select("vec_id", ids.alias("source"), ids.alias("target")), 20)
    return pairs.select("vec_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("source", "input", "label")])
