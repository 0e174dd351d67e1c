"""Statuses, error categories and retry times as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes that a reader sees as they are, and those that are shown under another name.
SHOWN = (
    "credential_rejected", "invalid_stage_output", "model_not_available", "output_limit", "output_truncated", "prompt_too_large", "provider_bad_request", "provider_content_filtered", "provider_invalid_json",
    "provider_retry_exhausted", "unsupported_schema",
)
RENAMED = {
    "provider_connection": "unreachable", "provider_http_401": "credential_rejected", "provider_http_403": "credential_rejected", "provider_http_404": "model_not_available", "provider_http_408": "timeout",
    "provider_http_429": "rate_limited", "provider_timeout": "timeout",
}
#: Error codes that may leave the engine.
SAFE = (
    "credential_missing", "credential_rejected", "invalid_stage_output", "model_changed", "model_not_available", "model_not_installed", "model_server_error", "model_unreachable", "output_limit", "output_truncated",
    "prompt_too_large", "provider_bad_request", "provider_batch_failed", "provider_connection", "provider_content_filtered", "provider_http_400", "provider_http_401", "provider_http_403", "provider_http_404",
    "provider_http_413", "provider_http_422", "provider_http_429", "provider_invalid_json", "provider_retry_exhausted", "provider_timeout", "quota_exhausted", "rate_limited", "stage_failed", "timeout", "unreachable",
    "unsupported_schema",
)
#: Categories that an error carries itself, and the codes they are stored as.
CARRIED = {
    "credential_rejected": "credential_rejected", "model_changed": "model_changed", "model_not_available": "model_not_available", "model_server_error": "model_server_error", "output_limit": "output_limit",
    "provider_bad_request": "provider_bad_request", "provider_content_filtered": "provider_content_filtered", "provider_invalid_json": "provider_invalid_json", "provider_retry_exhausted": "provider_retry_exhausted",
    "quota_exhausted": "quota_exhausted", "rate_limited": "rate_limited", "request_budget": "prompt_too_large", "truncated_output": "output_truncated", "unreachable": "model_unreachable",
    "unsupported_schema": "unsupported_schema", "untranslated_output": "untranslated_output",
}
#: Carried categories that also name a failed repair.
REPAIR_CARRIED = ("embed_unavailable", "model_server_error", "provider_retry_exhausted", "quota_exhausted", "rate_limited")
#: Codes in the body of a refused request (status 400 or 422).
REFUSED = {"context_length_exceeded": "prompt_too_large", "json_validate_failed": "provider_invalid_json", "model_decommissioned": "model_not_available", "model_not_found": "model_not_available"}
#: Phrases of messages and the class of failure they tell; the first that occurs counts.
PHRASES = (
    ("prompt changed; create a new", "model_changed"), ("model or inference configuration changed", "model_changed"), ("serving identity changed", "serving_identity_changed"), ("saved prose changed", "input_changed"),
    ("chapter input changed", "input_changed"), ("graph context exceeds hard model budget", "prompt_too_large"), ("num_predict", "output_truncated"), ("provider output limit reached", "output_truncated"), ("fenced", "fenced"),
    ("revision cannot be rebuilt", "revision_not_rebuildable"), ("no configured api key", "credential_missing"), ("provider credential is missing", "credential_missing"), ("model is not installed", "model_not_installed"),
    ("review must", "review_rejected"), ("must assess", "review_rejected"), ("not found", "not_found"), ("no such", "not_found"), ("provider unreachable", "model_unreachable"), ("timeout", "timeout"), ("timed out", "timeout"),
    ("deadline", "timeout"), ("connecterror", "model_unreachable"), ("connection refused", "model_unreachable"), ("connection attempts failed", "model_unreachable"), ("could not connect", "model_unreachable"),
    ("unreachable", "model_unreachable"),
)
#: Ends of a model endpoint's path, words of a daily quota, and how a body names a wait in seconds.
MODEL_PATH = r"/models/|/models$|/completions$|/messages$|/generate$"
DAILY = r"(?is)\bper[- ]day\b|\bdaily\b|\b24\s*hours?\b|\bday\s+quota\b|\bquota\b.{0,80}\b(?:tomorrow|next\s+day|day)\b"
DAILY_WORDS = ("per-day", "per day", "daily", "24 hours", "day quota")
WAIT = r"(?i)(?:retry in|\"?retryDelay\"?\s*:\s*\")\s*([0-9]+(?:\.[0-9]+)?)\s*s"
LONG_WAIT = r"(?i)(?:retry\s+in|\"?retryDelay\"?\s*[:=])\s*\"?([0-9]+(?:\.[0-9]+)?)\s*s\"?"
#: A wait of more seconds than this is a quota used up.
QUOTA_WAIT = 3600.0


def _first(pairs, otherwise: Column) -> Column:
    """A chain of (condition, value), as one expression."""
    out = None
    for condition, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def _seconds(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("double")


def reader_category(code: Column) -> Column:
    """What a reader is shown of an error code: empty for none, unknown for a code that is not listed."""
    code = F.coalesce(code, F.lit(""))
    status = F.regexp_extract(code, r"^provider_http_([+-]?[0-9]+)$", 1).try_cast("long")
    renamed = F.try_element_at(F.create_map(*(F.lit(x) for pair in RENAMED.items() for x in pair)), code)
    return F.when(code.isin(*SHOWN), code).when(renamed.isNotNull(), renamed).when(status >= 500, "model_server_error").when(code != "", "unknown").otherwise("")


def safe_code(code: Column) -> Column:
    """Listed codes as they are, any other, or none, as stage_failed."""
    return F.when(code.isin(*SAFE), code).otherwise("stage_failed")


def retry_hint(body: Column) -> Column:
    """Seconds to wait that a message names; null if it names none."""
    return _seconds(body, WAIT)


def quota_exhausted(body: Column, retry_after: Column) -> Column:
    """Whether a refusal for too many requests will not pass soon: a wait of over an hour, or words for a daily quota."""
    low = F.lower(F.coalesce(body, F.lit("")))
    words = F.exists(F.array(*map(F.lit, DAILY_WORDS)), lambda w: F.contains(low, w))
    return F.coalesce(retry_after.try_cast("double") > QUOTA_WAIT, F.lit(False)) | words | F.coalesce(retry_hint(body) > QUOTA_WAIT, F.lit(False))


def failure_category(category: Column, status: Column, path: Column, body: Column, retry_after: Column, message: Column) -> Column:
    """The class of a failure, from the most to the least specific sign; unknown if there is none.

    category: what the error carries; status, path, body and retry_after: of an HTTP response, null for other errors;
    message: type and text of the error.
    """
    refused = F.try_element_at(F.create_map(*(F.lit(x) for pair in REFUSED.items() for x in pair)), F.get_json_object(body, "$.error.code"))
    used_up = F.coalesce(retry_after.try_cast("double") > QUOTA_WAIT, F.lit(False)) | F.coalesce(body.rlike(DAILY), F.lit(False)) | F.coalesce(_seconds(body, LONG_WAIT) > QUOTA_WAIT, F.lit(False))
    by_status = [
        (status == 413, "prompt_too_large"), (status.isin(400, 422), F.coalesce(refused, F.lit("provider_bad_request"))), (status.isin(401, 403), "credential_rejected"),
        ((status == 404) & F.lower(path).rlike(MODEL_PATH), "model_not_available"), (status == 429, F.when(used_up, "quota_exhausted").otherwise("rate_limited")), (status >= 500, "model_server_error"),
    ]
    low = F.lower(F.coalesce(message, F.lit("")))
    own = [(category == "unreachable", "model_unreachable"), (category.isin(*REPAIR_CARRIED), category)]
    return _first(own + by_status + [(F.contains(low, F.lit(words)), name) for words, name in PHRASES], F.lit("unknown"))


def error_code(category: Column, kind: Column, status: Column, path: Column, body: Column, retry_after: Column, message: Column) -> Column:
    """The code an error is stored under. kind: timeout, transport, status, batch, value or null; the rest as above."""
    carried = F.try_element_at(F.create_map(*(F.lit(x) for pair in CARRIED.items() for x in pair)), category)
    known = failure_category(category, status, path, body, retry_after, message)
    by_kind = [
        (carried.isNotNull(), carried), (kind == "timeout", "provider_timeout"), (kind == "transport", "provider_connection"), (kind == "status", F.concat(F.lit("provider_http_"), status)),
        (kind == "batch", "provider_batch_failed"), (kind == "value", "invalid_stage_output"), (known != "unknown", known),
    ]
    return _first(by_kind, F.lit("stage_failed"))


def stage_backoff(attempt: Column) -> Column:
    return F.least(300 * F.pow(F.lit(2.0), attempt - 1), F.lit(3600.0))


def provider_backoff(attempt: Column, hint: Column) -> Column:
    return F.greatest(60 * F.pow(F.lit(2.0), attempt - 1), F.coalesce(hint, F.lit(0.0)))


def rendering_status(locked_at: Column, first_seen: Column, deleted: Column, at: int) -> Column:
    locked = F.coalesce((locked_at <= at) & ~deleted, F.lit(False))
    return F.when(locked, "locked").when(F.coalesce(first_seen <= at, F.lit(False)), "pending").otherwise("unlocked")


def health(failed: Column, warnings: Column, observed: Column, unstable: Column) -> Column:
    """The first that holds: failing from 3 failures, warning from 1, unstable from 25 % of at least 8 terms."""
    return F.when(failed >= 3, "failing").when(warnings > 0, "warning").when((observed >= 8) & (unstable * 4 >= observed), "unstable").otherwise("healthy")
