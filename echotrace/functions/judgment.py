"""What a judge over HTTP answers, as column expressions: model names, errors, verdicts, usage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of a verdict, and reasons of HTTP failures.
LABELS = ("match", "non_match", "abstain")
REASONS = {401: "provider_auth_failed", 402: "provider_quota_exceeded", 429: "provider_rate_limited", 502: "provider_unavailable"}
OTHER_REASON, INVALID = "provider_request_failed", "provider_invalid_response"
MODEL = "^[a-z0-9][a-z0-9-]*/[A-Za-z0-9._:-]+$"
SAFE_INTEGER = (1 << 53) - 1
STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}


def is_fixed_model(model: Column, automatic: str) -> Column:
    """True for `vendor/model`, but for the name that leaves the choice to the router."""
    return F.coalesce(model.rlike(MODEL) & ~model.contains("\n") & (model != F.lit(automatic)), F.lit(False))


def error_reason(status: Column) -> Column:
    """Why a response without success is no judgment."""
    out = F.lit(OTHER_REASON)
    for code, reason in REASONS.items():
        out = F.when(status == code, reason).otherwise(out)
    return out


def retry_after(header: Column) -> Column:
    """Whole seconds, or null for anything but digits of a number that a double holds exactly."""
    seconds = F.when(header.rlike("^[0-9]+$") & ~header.contains("\n"), F.try_to_number(F.ltrim(F.concat(F.lit("0"), header)), F.lit("9" * 38)))
    return F.when(seconds <= SAFE_INTEGER, seconds.cast("long"))


def verdict(content: Column) -> Column:
    """`struct(label, score)` of a JSON text whose label is known and whose score is a number from 0 to 1, else null."""
    whole = F.try_parse_json(content)
    label, score = F.try_variant_get(whole, "$.label", "string"), F.try_variant_get(whole, "$.score", "double")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(whole, path, "variant"))
    known = (kind("$.label") == "STRING") & label.isin(*LABELS) & kind("$.score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & score.between(0, 1)
    return F.when(F.coalesce(known, F.lit(False)), F.struct(label.alias("label"), score.alias("score")))


def token_count(count: Column) -> Column:
    """A whole number of tokens of at least 0, else 0."""
    return F.when((count >= 0) & (count == F.floor(count)), count.cast("long")).otherwise(F.lit(0).cast("long"))


def judgment(status: Column, retry_header: Column, body: Column, model_header: Column, asked_model: str) -> Column:
    """The judgment fields of one HTTP response: a verdict, or unavailable with its reason."""
    payload = F.try_parse_json(body)
    get = lambda path, kind="string": F.try_variant_get(payload, path, kind)
    found = verdict(get("$.choices[0].message.content"))
    ok = status.between(200, 299)
    done = F.coalesce(ok & found.isNotNull(), F.lit(False))
    reason = F.when(done, F.lit(None).cast("string")).when(ok, INVALID).otherwise(error_reason(status))
    model = F.coalesce(F.when(model_header != "", model_header), F.when(get("$.model") != "", get("$.model")), F.lit(asked_model))
    count = lambda path: F.when(done, token_count(get(path, "double"))).otherwise(F.lit(0).cast("long"))
    return F.struct(
        F.when(done, "completed").otherwise("unavailable").alias("status"), F.when(done, found["label"]).otherwise("abstain").alias("label"), F.when(done, found["score"]).otherwise(0.0).alias("score"),
        F.when(done, model).alias("resolvedModel"), F.struct(count("$.usage.prompt_tokens").alias("inputTokens"), count("$.usage.completion_tokens").alias("outputTokens")).alias("usage"),
        reason.alias("reason"), F.when(~F.coalesce(ok, F.lit(False)), retry_after(retry_header)).alias("retryAfterSeconds"),
    )
