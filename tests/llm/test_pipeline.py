import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import quality, toxicity


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(3)
    vocab = [a + b for a in "stone lake river cloud morning walk green calm".split() for b in ("", "s", "ing", "ed", "er", "ly", "y")]
    docs, labels = [], []

    def add(words, q, t, label=True):
        docs.append((len(docs), " ".join(words), "en", "s", 1))
        if label:
            labels.append((len(docs) - 1, q, t))

    for i in range(300):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(60, 200))]
        kind = i % 10
        if kind == 0:
            add([w + "%%%" for w in words], 0, 0, i % 20 == 0)
        elif kind in (1, 2):
            at = rnd.randrange(len(words))
            add(words[:at] + [rnd.choice(["fiend", "wretch"])] + words[at:], 1, 1)
        else:
            add(words, 1, 0, i % 3 > 0)
    plain = [d for d in docs if d[0] % 10 > 2]
    for d in plain[:20]:
        docs.append((len(docs), d[1], "en", "s", 1))
    for d in plain[20:40]:
        words = d[1].split()
        words[len(words) // 2] = "changed"
        docs.append((len(docs), " ".join(words), "en", "s", 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "packing"]
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        kept.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in kept.select("doc_id").collect()})
    assert sum(d % 10 == 0 and d < 300 for d in seen[0]) <= 2 and len({d[0] for d in plain} - seen[0]) <= 3
    assert sum(d % 10 in (1, 2) and d < 300 for d in seen[1]) == 0 and len(seen[0] - seen[1]) >= 55
    assert seen[2] == {d for d in seen[1] if d < 300}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {d[0]: d[1] for d in docs}
    assert set(out.doc_id) == seen[2]
    assert out.length.sum() == sum(len(tokenizer.encode(text[d], add_special_tokens=False).ids) + 1 for d in seen[2])
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_rows_without_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "en"), (None, "a b c d e f", "en"), (1, "g h i j k l", None), (1, "g h i j k l", None)], "doc_id long, text string, lang string")
    assert sorted(map(str, [r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, "").collect()])) == ["1", "None", "None"]


def test_clashing_columns_pass_through(spark, tmp_path):
    """Extra columns with the names that stages use inside, and one with a dot, come through unchanged."""
    texts = ["stone lake river cloud number %d morning walk" % i for i in range(40)] + [None, "", "stone lake river cloud number 1 morning walk"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    extra = ["id", "score", "spans", "row", "node", "fp", "component_id", "__text", "__row", "place", "text_hash", "a.b"]
    for k, name in enumerate(extra):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")) if k % 2 else F.col("doc_id") * k)
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r == before[r.doc_id] for r in rows)
    assert corpus_pipeline.pack(spark, kept, str(tmp_path)).count() >= len(rows)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
