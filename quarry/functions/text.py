"""Column functions on text: tokens, estimates, redaction, quality, names, rules and model output."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import deque
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the classifier's vocabulary.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs what which who whom this that these those am is are was were be been being have has had having do does "
    "did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

# Patterns of secrets and of sensitive labels.
PEM_BLOCK = r"(?s)-----BEGIN [^-]*PRIVATE KEY-----.*?-----END [^-]*PRIVATE KEY-----"
BEARER = r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+"
PREFIXED_KEY = r"\bsk-[A-Za-z0-9_-]{8,}\b"
ASSIGNED = (
    r"(?i)(api[_. -]?key|password|passwd|access[_. -]?token|refresh[_. -]?token|private[_. -]?key|密码|令牌|私钥)"
    r"(\s*[:=是为]\s*|\s+)([^\s,;，；]+)"
)
SENSITIVE_LABEL = r"(?i)(api.?key|password|passwd|access.?token|refresh.?token|private.?key|bearer|银行卡|密码|令牌|私钥)"

# What asks for memory, and the keyword rules with their confidence.
MEMORY_SIGNAL = (
    r"(?i)(请记住|记住我|帮我记|记我|别忘|忘记我|不要记|删除.{0,8}记忆|更正.{0,8}(我|信息|一下)|更新.{0,8}(我|偏好|信息)|搬到|"
    r"换了.{0,4}(地址|地方|城市|住处)|以后.{0,12}(回答|使用|不要|都)|\bremember\b|\bforget\b|\bcorrect\s+(my|the)\b|"
    r"\bupdate\s+my\b|\bupdate\b.{0,20}\b(preference|memory|profile)\b|\bmoved?\s+to\b|\brelocated?\b)"
)
INTENT_RULES = [
    ("ask_weather", 0.92, ["天气", "weather", "下雨", "温度"]),
    ("greet", 0.95, ["你好", "hi", "hello"]),
    ("unsafe", 0.99, ["炸弹", "攻击", "违法"]),
]
BANNED_WORDS = ["炸弹", "攻击", "违法", "毒品"]
QUALITY_SIGNS = "，。！？；：、,.!?;:()[]{}<>《》“”\"'`-_/\\|+*=#%&@$~^"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}"


def tokenize_mixed(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; every other visible character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([a-z0-9]+|[^\sa-z0-9])"), F.lit(1))


def preprocess_english(text: Column, stopwords: bool = True) -> Column:
    """Lower-case words of ASCII letters longer than two characters, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & (~w.isin(*STOPWORDS) if stopwords else F.lit(True)))


def estimate_tokens_mixed(text: Column) -> Column:
    """Characters beyond ASCII, and a quarter of the ASCII ones rounded up."""
    ascii_chars = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return (F.length(text) - ascii_chars + F.ceil(ascii_chars / 4)).cast("long")


def estimate_tokens_quarter(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


#: What is replaced by what, in this order; an assignment keeps its label and separator.
REDACTIONS = [(PEM_BLOCK, "[REDACTED PRIVATE KEY]"), (BEARER, "Bearer [REDACTED]"), (PREFIXED_KEY, "[REDACTED]"), (ASSIGNED, "$1$2[REDACTED]")]


def redact_secrets(text: Column) -> Column:
    """Key blocks, bearer tokens, prefixed keys, then assigned values, whose label and separator stay."""
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), REDACTIONS, text)


def is_sensitive(text: Column) -> Column:
    return text.rlike(SENSITIVE_LABEL) | (redact_secrets(text) != text)


def text_quality(text: Column) -> Column:
    """Share of readable characters less the share of broken ones, among visible characters; 1 if there are none."""
    signs = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in QUALITY_SIGNS)
    visible = F.regexp_replace(text, r"(?U)\s", "")
    n = F.length(visible)
    good = n - F.length(F.regexp_replace(visible, rf"[\p{{L}}\p{{N}}{CJK}{signs}]", ""))
    bad = n - F.length(F.regexp_replace(visible, r"[\x{FFFD}\x00-\x1F\x{E000}-\x{F8FF}]", ""))
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), (good - bad) / F.when(n > 0, n)))


def needs_reprocessing(text: Column, images: Column, tables: Column, min_chars: int = 30, min_quality: float = 0.65) -> Column:
    n = F.length(text)
    return ((n < min_chars) & (images >= 1)) | (images >= 2) | (tables >= 2) | ((n >= min_chars) & (text_quality(text) < min_quality))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(name), r"(?U)\s+", " "))


def chunk_key(document_id: Column, filepath: Column, source: Column, part_index: Column, chunk_index: Column, content: Column) -> Column:
    """Identity of a chunk: its document, then part and chunk numbers where there are any; else its content."""
    document = F.coalesce(document_id, filepath, source)
    return F.when(document.isNull(), content).otherwise(
        F.concat_ws("|", document, F.concat(F.lit("part="), part_index.cast("string")), F.concat(F.lit("chunk="), chunk_index.cast("string")))
    )


def classify_keywords(text: Column, rules: Sequence[tuple[str, float, list[str]]] = INTENT_RULES, default: tuple[str, float] = ("general", 0.55)) -> Column:
    """First rule with a keyword in the text: struct(intent, confidence)."""
    low, out = F.lower(F.trim(text)), None
    for name, confidence, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        value = F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    other = F.struct(F.lit(default[0]).alias("intent"), F.lit(default[1]).alias("confidence"))
    return other if out is None else out.otherwise(other)


def blocklist_hits(text: Column, words: Sequence[str] = BANNED_WORDS) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def memory_signal(text: Column) -> Column:
    return text.rlike(MEMORY_SIGNAL)


ANSWER = r"(?is)(?:therefore|so|thus|hence),?\s*the answer is\s*(.+?)\.?\s*$"


def extract_final_answer(text: Column) -> Column:
    """struct(reasoning, answer): by the closing phrase, else the last line."""
    whole = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    lines = F.split(whole, "\n")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = F.regexp_extract(text, ANSWER, 1)
    plain = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.struct(
        F.when(text.rlike(ANSWER), strip(F.regexp_replace(text, ANSWER, ""))).otherwise(strip(plain)).alias("reasoning"),
        F.when(text.rlike(ANSWER), strip(found)).otherwise(strip(F.element_at(lines, -1))).alias("answer"),
    )


def parse_query_lines(text: Column, n: int = 3) -> Column:
    """The first n non-blank lines without list marks and numbering."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^(- |\* |• )", ""))
    bare = lambda x: F.when(x.rlike(r"^[0-9][.、)]") & (F.length(x) > 2), F.substring(x, 3, 2**30)).when(x.rlike(r"^[0-9]{2}[.、)]") & (F.length(x) > 3), F.substring(x, 4, 2**30)).otherwise(x)
    lines = F.transform(lines, lambda x: F.regexp_replace(bare(x), r"^\s+|\s+$", ""))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, n)


def extract_json_object(text: Column) -> Column:
    """The JSON object in a model's reply, as text: fenced, whole, or from the first to the last brace; else `{}`."""
    inner = F.when(text.rlike(r"(?s)^\s*```"), F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```", 1)).otherwise(F.regexp_replace(text, r"^\s+|\s+$", ""))
    braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    valid = lambda c: F.coalesce(F.call_function("try_parse_json", F.when(c.rlike(r"(?s)^\{.*\}$"), c)).isNotNull(), F.lit(False))
    return F.when(valid(inner), inner).when(valid(braces), braces).otherwise(F.lit("{}"))


def route_turn(text: Column) -> Column:
    """struct(kind, reason): a JSON object with either tool calls or a final answer."""
    valid = F.coalesce(F.call_function("try_parse_json", F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text)).isNotNull(), F.lit(False))
    calls = F.coalesce(F.get_json_object(text, "$.tool_calls"), F.lit("[]"))
    answer = F.get_json_object(text, "$.final_answer")
    has_calls = ~F.regexp_replace(calls, r"\s", "").isin("[]", "null", "")
    kind = F.when(~valid, "invalid").when(has_calls & answer.isNotNull(), "invalid").when(has_calls, "tool_calls").when(answer.isNotNull(), "final_answer").otherwise("invalid")
    reason = F.when(~valid, "not a JSON object").when(has_calls & answer.isNotNull(), "both calls and answer").when(~has_calls & answer.isNull(), "neither calls nor answer")
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def outcome_importance(outcome: Column, error: Column) -> Column:
    """Importance of an episode; an error makes it a failure."""
    return F.when(F.coalesce(error, F.lit(False)) | (outcome == "failure"), 0.7).when(outcome == "success", 0.6).otherwise(0.5)


def _number(literal: str) -> float | str:
    """A JSON number, or its name where it isn't finite."""
    value = float(literal)
    return value if math.isfinite(value) else str(value)


def sanitize_json(text: Column, most: int = 500, members: int = 50, key_chars: int = 100) -> Column:
    """JSON of any depth with secrets redacted, strings cut, and 50 members a level; null if it is no JSON."""
    rules = [(re.compile(pattern), by.replace("$", "\\")) for pattern, by in REDACTIONS]
    secret = re.compile(SENSITIVE_LABEL)

    def string(value: str) -> str:
        return reduce(lambda out, rule: rule[0].sub(rule[1], out), rules, value)[:most]

    def members_of(box):
        """Key and value of what stays of an object or array."""
        if isinstance(box, list):
            return enumerate(itertools.islice(box, members))
        return ((key[:key_chars], value) for key, value in itertools.islice(box.items(), members))

    def clean(t: str | None) -> str | None:
        try:
            whole = [json.loads(t, parse_float=_number, parse_constant=_number)]
        except (TypeError, ValueError):
            return None
        # Boxes still to be filled from their originals, outermost first; filling one finds those inside it.
        result: list = []
        work = deque([(whole, result)])
        while work:
            source, target = work.popleft()
            for key, value in members_of(source):
                if isinstance(key, str) and secret.search(key):
                    value = "[REDACTED]"
                elif isinstance(value, str):
                    value = string(value)
                elif isinstance(value, (dict, list)):
                    work.append((value, value := type(value)()))
                if isinstance(target, list):
                    target.append(value)
                else:
                    target[key] = value
        return json.dumps(result[0], ensure_ascii=False)

    return F.udf(clean, "string", useArrow=True)(text)


EXTRACTION = (
    "struct<entities:array<struct<name:string,type:string,description:string>>,"
    "relationships:array<struct<source:string,target:string,description:string,strength:string>>>"
)


def parse_entities(text: Column) -> Column:
    """Entities of a model's extraction: blank names left out, names and types in upper case, UNKNOWN by default."""
    rows = F.coalesce(F.from_json(extract_json_object(text), EXTRACTION)["entities"], F.array().cast("array<struct<name:string,type:string,description:string>>"))
    made = F.transform(rows, lambda e: F.struct(normalize_name(F.coalesce(e["name"], F.lit(""))).alias("name"), F.coalesce(F.nullif(F.upper(F.trim(e["type"])), F.lit("")), F.lit("UNKNOWN")).alias("entity_type"), F.coalesce(e["description"], F.lit("")).alias("description")))
    return F.filter(made, lambda e: e["name"] != "")


def parse_relationships(text: Column) -> Column:
    """Relations of a model's extraction: both ends named, strength between 1 and 10 and 5 where it isn't a number."""
    rows = F.coalesce(F.from_json(extract_json_object(text), EXTRACTION)["relationships"], F.array().cast("array<struct<source:string,target:string,description:string,strength:string>>"))
    strength = lambda s: F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.coalesce(s.try_cast("double"), F.lit(5.0))))
    made = F.transform(rows, lambda r: F.struct(normalize_name(F.coalesce(r["source"], F.lit(""))).alias("source"), normalize_name(F.coalesce(r["target"], F.lit(""))).alias("target"), F.coalesce(r["description"], F.lit("")).alias("description"), strength(r["strength"]).alias("strength")))
    return F.filter(made, lambda r: (r["source"] != "") & (r["target"] != ""))


def build_prompt(question: Column, examples: Sequence[str] = (), trigger: str | None = None) -> Column:
    """Few-shot: examples, a blank line apart, then the question; zero-shot: the question and what triggers reasoning."""
    if trigger is not None:
        return F.concat(question, F.lit("\n" + trigger))
    return F.concat(F.lit("".join(e + "\n\n" for e in examples)), question)
