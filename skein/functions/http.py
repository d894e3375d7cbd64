"""HTTP rules and line formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RETRY_STATUSES = (429, 500, 502, 503, 504)
RETRY_KINDS = ("timeout", "connect", "reset")
REDIRECTS = (301, 302, 303, 307, 308)
WAIT_CAP = 5000


def is_html(content_type: Column) -> Column:
    media = F.lower(F.regexp_replace(F.substring_index(content_type, ";", 1), r"^\s+|\s+$", ""))
    return F.coalesce(media.isin("text/html", "application/xhtml+xml"), F.lit(False))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


#: Fixed values below: codes of errors and the kinds they stand for.
def error_kind(code: Column) -> Column:
    return (
        F.when(code == "TimeoutError", "timeout")
        .when(code.isin("ENOTFOUND", "EAI_AGAIN"), "dns")
        .when(code.isin("ECONNREFUSED", "UND_ERR_CONNECT_TIMEOUT"), "connect")
        .when(code.isin("ECONNRESET", "UND_ERR_SOCKET", "EPIPE"), "reset")
        .when((code == "DEPTH_ZERO_SELF_SIGNED_CERT") | code.startswith("CERT_") | code.startswith("ERR_TLS_"), "tls")
        .otherwise("connect")
    )


def error_message(message: Column, code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", message).otherwise(F.concat(message, F.lit(" ("), code, F.lit(")")))


def backoff_ms(retry: Column, base_ms: Column) -> Column:
    return F.least(F.lit(float(WAIT_CAP)), base_ms * F.pow(F.lit(2.0), retry - 1)).cast("bigint")


#: The three forms of an HTTP date without the day's name, as patterns: what to match, what to read it as.
_DATES = (
    (r"^[A-Za-z]{3}, (\d{1,2} [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d) (?:GMT|UTC)$", "d MMM yyyy HH:mm:ss Z"),
    (r"^[A-Za-z]{6,9}, (\d\d-[A-Za-z]{3}-\d\d \d\d:\d\d:\d\d) (?:GMT|UTC)$", "dd-MMM-yyyy HH:mm:ss Z"),
    (r"^[A-Za-z]{3} ([A-Za-z]{3} +\d{1,2} \d\d:\d\d:\d\d \d{4})$", "MMM d HH:mm:ss yyyy Z"),
)


def http_date_ms(text: Column) -> Column:
    """Milliseconds of an HTTP date, which is in UTC whatever the session's zone; null if it is none."""

    def read(pattern: str, form: str) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, pattern, 1), " +", " ")
        # Years of two digits lie between 1950 and 2049.
        found = F.regexp_replace(F.regexp_replace(found, r"-([5-9]\d) ", "-19$1 "), r"-(\d\d) ", "-20$1 ")
        return F.unix_millis(F.try_to_timestamp(F.concat(found, F.lit(" +0000")), F.lit(form)))

    return F.coalesce(*(F.when(text.rlike(pattern), read(pattern, form)) for pattern, form in _DATES))


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Seconds, or an HTTP date from now on; null if neither."""
    text = F.trim(header)
    date = http_date_ms(text)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint") * 1000).when(date.isNotNull(), F.greatest(F.lit(0), date - now_ms))


def retry_wait_ms(status: Column, retry_after: Column, attempt: Column, base_ms: Column, now_ms: Column) -> Column:
    """The wait before the next attempt; null: no retry, as it is over the cap."""
    own = backoff_ms(attempt, base_ms)
    asked = F.when(status.isin(429, 503), retry_after_ms(retry_after, now_ms))
    wait = F.greatest(own, F.coalesce(asked, own))
    return F.when(wait <= WAIT_CAP, wait)


def retryable(status: Column, kind: Column) -> Column:
    return F.coalesce(status.isin(*RETRY_STATUSES), F.lit(False)) | F.coalesce(kind.isin(*RETRY_KINDS), F.lit(False))


def too_large(content_length: Column, body: Column, max_bytes: int) -> Column:
    return F.coalesce(content_length.try_cast("double") > max_bytes, F.lit(False)) | F.coalesce(F.octet_length(body) > max_bytes, F.lit(False))


def csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, values))


def trace_value(value: Column) -> Column:
    from skein.functions.url import redact_userinfo

    text = F.regexp_replace(redact_userinfo(value.cast("string")), r"[\r\n]+", " ")
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(text.rlike(r"\A[A-Za-z0-9._:/-]+\z"), text).otherwise(quoted)


def trace_line(event: str, **fields: Column) -> Column:
    """[trace] event k=v ...; null fields are left out, the order is that of the arguments."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), trace_value(v))) for k, v in fields.items()]
    return F.concat_ws(" ", F.lit(f"[trace] {event}"), *parts)


def robots_line(origin: Column, outcome: Column, status: Column, kind: Column) -> Column:
    return F.concat(F.lit("  "), origin, F.lit("  "), F.concat_ws(" ", outcome, status.cast("string"), kind))


def status_cell(state: Column, status: Column) -> Column:
    return F.when(state.isin("ok", "failed") & status.isNotNull(), status.cast("string")).otherwise("-")


def reason_cell(state: Column, skip: Column, error: Column) -> Column:
    return F.coalesce(F.when(state == "skipped", skip).when(state == "failed", error), F.lit("-"))
