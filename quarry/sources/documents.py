"""Reading documents, notes and logs; writing and upgrading stores."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ["txt", "md", "csv", "json", "log"]
MIME = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json"}
NOTE_TYPES = ["user", "feedback", "project", "reference"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, not of its folders: filepath, text (null where its bytes aren't UTF-8), size and time; corrupt files are left out."""
    raw = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(path)
    text = F.col("content").cast("string")
    text = F.regexp_replace(F.when(F.is_valid_utf8(text), text), "^\ufeff", "")
    return raw.select(F.col("path").alias("filepath"), text.alias("content"), F.col("length").alias("file_size"), F.col("modificationTime").alias("file_modified_at"))


def read_documents(spark: SparkSession, folder: str, extensions: list[str] | None = None, errors: bool = False) -> DataFrame:
    """Files of a folder, not of its folders: path, extension, content, size and time; blank and other files are left out.

    A file that isn't UTF-8 is left out, too; with `errors` it is a row without content that says so in `error`.
    """
    extension = F.lower(F.regexp_extract("filepath", r"\.([^./]+)$", 1))
    rows = _files(spark, folder).withColumn("extension", extension).where(F.col("extension").isin(extensions or EXTENSIONS))
    rows = rows.withColumn("error", F.when(F.col("content").isNull(), F.lit("not UTF-8")))
    if errors:
        return rows.where(F.col("error").isNotNull() | F.col("content").rlike(r"\S")).select("filepath", "extension", "content", "file_size", "file_modified_at", "error")
    return rows.where(F.col("content").rlike(r"\S")).select("filepath", "extension", "content", "file_size", "file_modified_at")


def with_document_metadata(docs: DataFrame, part: str | None = None) -> DataFrame:
    """Adds document_id, source, filename, mime_type, char_count and the part's number among its document's parts."""
    path = F.regexp_replace("filepath", "^file:/*", "/")
    mime = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    over = Window.partitionBy("filepath")
    order = over.orderBy(part or "filepath")
    return docs.withColumns({
        "document_id": F.substring(F.sha2(path, 256), 1, 16), "source": path, "filename": F.regexp_extract("filepath", r"([^/]+)$", 1), "mime_type": F.coalesce(mime[F.col("extension")], F.lit("application/octet-stream")),
        "char_count": F.length("content"), "part_index": F.row_number().over(order) - 1, "part_total": F.count("*").over(over),
    })


def markdown_cell(value) -> object:
    """Trimmed, backslashes and bars escaped, line breaks as <br>, null as empty."""
    value = value if isinstance(value, Column) else F.col(value)
    text = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"^\s+|\s+$", "")
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(text, r"\r\n|\r|\n", "<br>")


def table_to_markdown(rows: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """(by, markdown): each group's rows in order under a header; rows with only blank cells are left out."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [markdown_cell(c) for c in columns]
    some = F.concat(*cells) != ""
    groups = rows.where(some).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line(cells).alias("line")))).alias("l"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return groups.select(by, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))


def sniff_separator(head: str) -> str:
    """The separator outside quotes that the first line holds most often; the comma if it holds none."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", head).lstrip("\n\r")
    first = bare.splitlines()[0] if bare.strip() else ""
    best = max((",", ";", "\t", "|"), key=first.count)
    return best if best in first else ","


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(filepath, text) -> a row (filepath, seq, cells, error) for each record of a file, in its own separator."""
    csv.field_size_limit(2**31 - 1)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["filepath", "seq", "cells", "error"])

    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                yield out([(path, -1, None, "not UTF-8")])
                continue
            rows: list[tuple] = []
            try:
                for seq, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=sniff_separator(text[:4096]))):
                    rows.append((path, seq, cells, None))
                    if len(rows) == 4096:
                        yield out(rows)
                        rows = []
            except csv.Error as wrong:
                rows.append((path, -1, None, str(wrong)))
            yield out(rows)


def read_csv_documents(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """One CSV file, or each of a folder, as a markdown table: (filepath, markdown).

    Separator and width are those of the file: the width is its longest record's, shorter ones are padded.  Quoted line breaks stay, blank
    records and empty files go.  A file that isn't UTF-8 or can't be parsed is left out; with `errors` it is a row without markdown that says why
    in `error`.  A file is parsed by one task.
    """
    rows = _files(spark, path).select("filepath", "content").mapInArrow(_records, "filepath string, seq long, cells array<string>, error string")
    cells = F.transform("cells", markdown_cell)
    files = rows.withColumn("cells", cells).where(F.col("error").isNotNull() | F.exists("cells", lambda c: c != ""))
    files = files.groupBy("filepath").agg(F.max("error").alias("error"), F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("seq", "cells")))).alias("r"))
    files = files.withColumn("width", F.array_max(F.transform("r", lambda x: F.size(x["cells"]))))
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(""), F.col("width") - F.size(c))), " | "), F.lit(" |"))
    lines = F.transform("r", lambda x: line(x["cells"]))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    table = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, 2**30)), "\n")
    told = files.select("filepath", F.when(F.col("error").isNull(), table).alias("markdown"), "error")
    return told if errors else told.where("error is null").drop("error")


def _indented(text: str) -> str | None:
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return None


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file one document, its JSON indented by two; invalid files have a null content and `valid` false."""
    raw = spark.read.text(path, wholetext=True).withColumn("filepath", F.input_file_name())
    content = F.udf(_indented, "string", useArrow=True)("value")
    return raw.select("filepath", content.alias("content")).withColumn("valid", F.col("content").isNotNull())


def append_event_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def recent_events(lines: DataFrame, n: int = 8) -> DataFrame:
    """lines(seq, line): of the last n lines those that are JSON objects."""
    last = lines.orderBy(F.desc("seq")).limit(n)
    fine = F.call_function("try_parse_json", F.when(F.col("line").rlike(r"(?s)^\s*\{.*\}\s*$"), F.col("line"))).isNotNull()
    return last.where(fine)


def _numbered(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines with their numbers: lines of a file lie in order over its splits, so counts per split number them."""
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    return spark.createDataFrame(lines, f"line long, {name} string")


def read_parallel_corpus(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Line i of one file with line i of the other; lines without a partner are left out."""
    return _numbered(spark, source, "source").join(_numbered(spark, target, "target"), "line")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per table: indexes, graphs, communities."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """The saved table; None if there is none or it is empty, which means not ready."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.parquet(f"{path}/{name}")
    except AnalysisException:
        return None
    return None if df.isEmpty() else df


def read_frontmatter_notes(spark: SparkSession, folder: str, most: int = 200, index: str = "MEMORY.md") -> DataFrame:
    """Notes under a folder, newest first: name, description and type from the header in the first 30 lines."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    text = F.decode("content", "UTF-8")
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 30), "\n")
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    notes = raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("modificationTime").alias("mtime"), field("name").alias("name"), field("description").alias("description"), F.when(field("type").isin(NOTE_TYPES), field("type")).alias("type"), text.alias("body"))
    return notes.where(F.col("filename") != index).orderBy(F.desc("mtime"), "filename").limit(most)


def slug(name) -> object:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "memory").otherwise(out)


def upsert_notes(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes by slug; the one of greatest seq replaces the others."""
    both = notes.unionByName(new).withColumn("slug", slug(F.col("name")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("seq")))).where("r = 1").drop("r")


def note_manifest(notes: DataFrame) -> DataFrame:
    """One row: a line per note, newest first."""
    line = F.concat(F.lit("- ["), F.coalesce("type", F.lit("note")), F.lit("] "), "filename", F.lit(": "), F.coalesce("description", F.lit("")))
    rows = notes.agg(F.reverse(F.array_sort(F.collect_list(F.struct("mtime", line.alias("line"))))).alias("l"))
    return rows.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("manifest"))
