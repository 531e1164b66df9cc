"""External guard and defender verdicts: normalise their JSON, join them, merge the risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.functions.text import STRIP_CHARS, strip

# External category -> flag of this taxonomy.
CATEGORY_FLAGS = {
    "prompt_injection": "JAILBREAK_ATTEMPT",
    "jailbreak": "JAILBREAK_ATTEMPT",
    "unknown_links": "PROMPT_LEAKING_ATTEMPT",
    "pii": "PII_DETECTED",
    "moderated_content/hate": "CONTENT_MODERATION_FLAG",
    "moderated_content/violence": "CONTENT_MODERATION_FLAG",
    "moderated_content/sexual": "CONTENT_MODERATION_FLAG",
    "moderated_content/weapons": "CONTENT_MODERATION_FLAG",
    "moderated_content/self_harm": "CONTENT_MODERATION_FLAG",
}
UNMAPPED_PREFIX = "LAKERA_"

# What a failing or silent defender is taken to have said.
FAIL_OPEN_RISK, FAIL_OPEN_CONFIDENCE = 0.1, 0.0
DEFAULT_RISK, DEFAULT_CONFIDENCE, DEFAULT_REASON = 0.1, 0.5, "no reason provided"
FAIL_OPEN_REASON = "defender unavailable"

_VERDICT = "flagged boolean, categories map<string,boolean>, category_scores map<string,double>"
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
_SENTINEL = "end of reply"


def framed(json: Column) -> Column:
    """The text between two array elements, parsed; keep it in a column of its own where it is read again.

    The lenient readers take single quotes and ignore what follows a value: only a complete
    value leaves both elements in place.
    """
    return F.try_parse_json(F.concat(F.lit("[0,"), json, F.lit(f',"{_SENTINEL}"]')))


def strict_object(json: Column, parsed: Column | None = None) -> Column:
    """True where the whole text is one JSON object by the strict grammar; ``parsed`` is its :func:`framed` form."""
    ends = F.try_variant_get(framed(json) if parsed is None else parsed, "$[2]", "string") == _SENTINEL
    return F.coalesce(F.ltrim(json, F.lit(STRIP_CHARS)).startswith("{") & ends, F.lit(False))


def ext_parse(json: Column) -> Column:
    """The raw verdict; keep it in a column of its own, it is read many times."""
    return F.when(strict_object(json), F.from_json(json, f"{_VERDICT}, results array<struct<{_VERDICT}>>"))


def ext_normalize(parsed: Column) -> Column:
    """Verdict at top level or under ``results[0]`` -> struct; NULL when there is no verdict."""
    top = {f: parsed[f] for f in ("flagged", "categories", "category_scores")}
    first = F.get(parsed["results"], 0)
    nested = first.isNotNull()

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.when(nested, first[name]).otherwise(top[name]), default)

    return F.when(parsed.isNotNull(), F.struct(
        field("flagged", F.lit(False)).alias("flagged"),
        field("categories", F.create_map().cast("map<string,boolean>")).alias("categories"),
        field("category_scores", F.create_map().cast("map<string,double>")).alias("category_scores"),
    ))


def ext_status(json: Column, verdict: Column, enabled: bool = True) -> Column:
    if not enabled:
        return F.lit("disabled")
    return F.when(json.isNull() | verdict.isNull(), "unavailable").otherwise("ok")


def ext_flags(categories: Column) -> Column:
    """Positive categories as flags, sorted and without repeats."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORY_FLAGS.items() for x in pair])
    names = F.map_keys(F.map_filter(categories, lambda _, v: F.coalesce(v, F.lit(False))))
    flags = F.transform(
        names, lambda c: F.coalesce(F.try_element_at(known, c), F.concat(F.lit(UNMAPPED_PREFIX), F.upper(c)))
    )
    return F.coalesce(F.sort_array(F.array_distinct(flags)), F.array().cast("array<string>"))


def ext_score(flagged: Column, scores: Column) -> Column:
    """Highest score as a truncated percentage; without scores, all or nothing."""
    best = F.array_max(F.map_values(scores))
    return F.coalesce(F.floor(best * 100), F.when(flagged, 100), F.lit(0)).cast("int")


def semantic_score(flags: Column, max_similarity: Column) -> Column:
    return F.when(F.size(flags) > 0, F.bround(max_similarity * 100)).otherwise(0).cast("int")


def risk_merge(flags: list[Column], scores: list[Column]) -> tuple[Column, Column, Column]:
    """Union of the flags, the most confident score (not a sum), and whether any flag was raised."""
    merged = F.array_sort(F.array_distinct(reduce(F.array_union, flags)))
    return merged, F.greatest(*scores), reduce(lambda a, b: a | b, [F.size(f) > 0 for f in flags])


def risk_band(score: Column, suspicious: Column) -> Column:
    return F.when(score > 80, "critical").when(suspicious, "suspicious").otherwise("clean")


def _number(value: Column, kind: Column) -> Column:
    """A JSON number, a string that spells one (``inf`` and ``nan`` too), or a JSON boolean as 1 or 0."""
    truth = F.when(kind == "BOOLEAN", (value == "true").cast("double"))
    return F.coalesce(truth, F.when(value.rlike(_NUMBER), strip(value).try_cast("double")))


def defender_body(reply: Column) -> Column:
    """A stripped reply without its code fence."""
    return F.when(reply.startswith("```"), F.regexp_replace(reply, r"(?m)^```.*$", "")).otherwise(reply)


def defender_fields(body: Column, parsed: Column) -> Column:
    """The reply's fields and the JSON types of three of them, NULL when it is no JSON object.

    ``parsed`` is the body's :func:`framed` form. Keep the result in a column of its own, it is read many times.
    """
    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(parsed, f"$[1].{key}", "variant")).alias(key)

    return F.when(strict_object(body, parsed), F.struct(
        F.from_json(body, "map<string,string>").alias("values"),
        F.struct(*[kind(k) for k in ("defender_risk", "confidence", "threats")]).alias("kinds"),
    ))


def defender_parse(parsed: Column) -> Column:
    """Fields of a reply -> ``defender_risk, confidence, reason, threats``.

    A missing key takes its own default; a reply that cannot be used at all (no JSON object,
    a number that is none, threats that are no list) fails open. A string of threats is the
    list of its characters.
    """
    fields, kinds = parsed["values"], parsed["kinds"]

    def number(key: str, default: float) -> Column:
        has = F.map_contains_key(fields, key)
        return F.when(has, _number(F.try_element_at(fields, F.lit(key)), kinds[key])).otherwise(F.lit(default))

    risk, confidence = number("defender_risk", DEFAULT_RISK), number("confidence", DEFAULT_CONFIDENCE)
    text = kinds["threats"] == "STRING"
    listed = ~F.map_contains_key(fields, "threats") | text | kinds["threats"].startswith("ARRAY")
    usable = parsed.isNotNull() & risk.isNotNull() & confidence.isNotNull() & listed

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    reason = F.when(
        F.map_contains_key(fields, "reason"), F.coalesce(F.try_element_at(fields, F.lit("reason")), F.lit("None"))
    ).otherwise(F.lit(DEFAULT_REASON))
    given = F.try_element_at(fields, F.lit("threats"))
    characters = F.filter(F.split(given, ""), lambda c: c != "")
    threats = F.coalesce(
        F.when(text, characters).otherwise(F.from_json(given, "array<string>")), F.array().cast("array<string>")
    )
    return F.struct(
        F.when(usable, clamp(risk)).otherwise(FAIL_OPEN_RISK).alias("defender_risk"),
        F.when(usable, clamp(confidence)).otherwise(FAIL_OPEN_CONFIDENCE).alias("confidence"),
        F.when(usable, reason).otherwise(FAIL_OPEN_REASON).alias("reason"),
        F.when(usable, threats).otherwise(F.array().cast("array<string>")).alias("threats"),
    )


def defender_band(risk: Column) -> Column:
    return F.when(risk >= 0.5, "dangerous").when(risk > 0.4, "suspicious").otherwise("safe")


def with_ext_signals(df: DataFrame, json: str = "ext_json", enabled: bool = True) -> DataFrame:
    """Add ``ext_flags, ext_score, ext_categories, ext_status`` from a verdict column."""
    raw = F.col(json) if enabled else F.lit(None).cast("string")
    df = df.withColumn("_raw", ext_parse(raw)).withColumn("_v", ext_normalize(F.col("_raw")))
    no_map = F.create_map().cast("map<string,boolean>")
    return df.withColumns({
        "ext_status": ext_status(raw, F.col("_v"), enabled),
        "ext_categories": F.coalesce(F.col("_v.categories"), no_map),
        "ext_flags": ext_flags(F.coalesce(F.col("_v.categories"), no_map)),
        "ext_score": F.coalesce(ext_score(F.col("_v.flagged"), F.col("_v.category_scores")), F.lit(0)),
    }).drop("_v", "_raw")


def with_defender(df: DataFrame, text: str = "defender_text") -> DataFrame:
    """Add ``defender_risk, defender_confidence, defender_reason, defender_threats``."""
    df = df.withColumn("_reply", strip(F.col(text))).withColumn("_body", defender_body(F.col("_reply")))
    df = df.withColumn("_framed", framed(F.col("_body")))
    df = df.withColumn("_fields", defender_fields(F.col("_body"), F.col("_framed"))).withColumn("_d", defender_parse(F.col("_fields")))
    return df.withColumns({
        "defender_risk": F.col("_d.defender_risk"),
        "defender_confidence": F.col("_d.confidence"),
        "defender_reason": F.col("_d.reason"),
        "defender_threats": F.col("_d.threats"),
    }).drop("_d", "_fields", "_framed", "_body", "_reply")


def join_verdicts(df: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Optional verdicts: a missing one never removes a request. One verdict row per key."""
    return df.join(verdicts, key, "left")
