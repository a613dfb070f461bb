"""Telemetry and strict contracts of provider responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.decisions import VALID_VALUES
from .text import col, strip, word_count

# The keys of an answer.
OUTPUT_KEYS = ("item_id", "original_validity", "target_state_t1", "lifecycle_label", "instructional_priority", "leakage_label", "evidence_ids", "short_reason")
GENERATION_KEYS = ("generation_status", "diagnostic_claim", "hint", "target")
REASON_CHARS = 2000


def telemetry(raw: str | Column) -> Column:
    """(prompt_tokens, completion_tokens, reasoning_tokens, total_tokens, finish_reason); whatever isn't a whole number
    of 0 or more is null."""
    v = F.try_parse_json(col(raw))

    def number(path: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        n = F.try_variant_get(v, path, "bigint")
        return F.when((kind == "BIGINT") & (n >= 0), n)

    reason = F.when(F.schema_of_variant(F.try_variant_get(v, "$.choices[0].finish_reason", "variant")) == "STRING", F.try_variant_get(v, "$.choices[0].finish_reason", "string"))
    return F.struct(
        number("$.usage.prompt_tokens").alias("prompt_tokens"), number("$.usage.completion_tokens").alias("completion_tokens"),
        F.coalesce(number("$.usage.completion_tokens_details.reasoning_tokens"), number("$.usage.reasoning_tokens")).alias("reasoning_tokens"),
        number("$.usage.total_tokens").alias("total_tokens"), reason.alias("finish_reason"),
    )


def returned_model(raw: str | Column, *fields: str | Column) -> Column:
    """The first name that isn't empty: of the fields, then of the raw response."""
    return F.coalesce(*(F.nullif(col(f), F.lit("")) for f in fields), F.get_json_object(col(raw), "$.model"))


def strip_fence(x: str | Column) -> Column:
    """The text without a code fence around it."""
    bare = strip(x)
    inside = F.regexp_extract(bare, r"(?s)^```[^\n]*\n(.*)\n\s*```$", 1)
    return F.when(bare.rlike(r"(?s)^```[^\n]*\n.*\n\s*```$"), strip(inside)).otherwise(bare)


def keys_of(v: Column) -> Column:
    return F.array_sort(F.map_keys(F.from_json(F.to_json(v), "map<string,string>")))


def answer_error(text: str | Column, item: str | Column, permitted: str | Column) -> Column:
    """The first rule that an answer breaks, or null: JSON, exact keys, item, enumerations, cited ids, reason."""
    bare = strip_fence(text)
    v = F.try_parse_json(bare)
    get = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    ids = F.try_variant_get(v, "$.evidence_ids", "array<string>")
    out = F.when(v.isNull() | ~bare.rlike(r"(?s)^[\[{].*[\]}]$"), "response was not valid JSON")
    out = out.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & (keys_of(v) == F.array(*map(F.lit, sorted(OUTPUT_KEYS)))), F.lit(False)), "response keys do not match the fixed output schema")
    out = out.when(~F.coalesce(get("item_id") == col(item), F.lit(False)), F.concat(F.lit("response item_id must be "), col(item)))
    for f, values in VALID_VALUES.items():
        out = out.when(~F.coalesce(get(f).isin(*values), F.lit(False)), F.lit(f"response has invalid {f}"))
    good = (F.size(ids) > 0) & (F.size(F.array_distinct(ids)) == F.size(ids)) & ~F.exists(ids, lambda x: F.coalesce(x, F.lit("")) == "")
    out = out.when(~F.coalesce(good, F.lit(False)), "response evidence_ids must be a non-empty list of unique strings")
    unknown = F.array_sort(F.array_except(ids, col(permitted)))
    out = out.when(F.size(unknown) > 0, F.concat(F.lit("response cited evidence IDs not supplied: "), F.array_join(unknown, ", ")))
    reason = get("short_reason")
    return out.when(~F.coalesce((strip(reason) != "") & (F.length(reason) <= REASON_CHARS), F.lit(False)), "response short_reason must be a non-empty string up to 2,000 characters")


def generation_status(text: str | Column, requested: str | Column | None = None, returned: str | Column | None = None, least: int = 20, most: int = 60) -> Column:
    """The status of a generated hint: ``error`` for a broken contract, ``length_violation``, ``model_mismatch``, or
    what the answer says."""
    bare = strip_fence(text)
    v = F.try_parse_json(bare)
    get = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    has = lambda f: F.coalesce(F.trim(get(f)), F.lit("")) != ""
    s = get("generation_status")
    broken = v.isNull() | ~F.coalesce(keys_of(v) == F.array(*map(F.lit, sorted(GENERATION_KEYS))), F.lit(False)) | ~F.coalesce(s.isin("diagnostic", "non_diagnostic"), F.lit(False))
    broken = broken | ((s == "diagnostic") & ~(has("hint") & has("diagnostic_claim"))) | ((s == "non_diagnostic") & (get("hint").isNotNull() | get("diagnostic_claim").isNotNull()))
    out = F.when(F.coalesce(broken, F.lit(True)), "error")
    if requested is not None and returned is not None:
        out = out.when(F.coalesce(col(returned) != col(requested), F.lit(False)), "model_mismatch")
    return out.when((s == "diagnostic") & ~word_count(get("hint")).between(least, most), "length_violation").otherwise(s)
