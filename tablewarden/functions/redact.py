"""Redaction of personal data and secrets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of personal data in the order in which they are replaced, with pattern and tag. ASCII classes.
PII = {
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b", "[SSN]"),
    "card": (r"\b(?:\d{4}[-\s]?){3}\d{1,7}\b|\b\d{13,19}\b", "[CARD]"),
    "phone": (r"(?:\(\d{3}\)\s*\d{3}[-.]?\d{4}|\b\d{3}[-.]?\d{3}[-.]?\d{4}\b)", "[PHONE]"),
    "ip": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", "[IP]"),
}
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
#: Patterns with the same matches that begin with the digit that each match needs: a scan then passes over other
#: characters at once, instead of asking for a word boundary at each.
QUICK = {
    "email": PII["email"][0],
    "ssn": r"\d(?<=\b\d)(?:\d{2}-\d{2}-\d{4}\b|\d{8}\b)",
    "card": r"\d(?<=\b\d)(?:\d{3}[-\s]?(?:\d{4}[-\s]?){2}\d{1,7}\b|\d{12,18}\b)",
    "phone": r"[\d(](?:(?<=\()\d{3}\)\s*\d{3}[-.]?\d{4}|(?<=\b\d)\d{2}[-.]?\d{3}[-.]?\d{4}\b)",
    "ip": rf"[0-9](?<=\b[0-9])(?:(?<=2)(?:5[0-5]|[0-4][0-9])|(?<=[01])[0-9]{{2}}|[0-9]?)\.(?:{_OCTET}\.){{2}}{_OCTET}\b",
}
# Words that mark a key as sensitive, prefixes of secret values, keys that are never sensitive.
SENSITIVE_WORDS = (
    "password", "secret", "token", "bearer", "authorization", "credential", "api_key", "apikey", "private_key",
    "privatekey", "hmac", "signature", "oidc", "jwt", "access_token", "refresh_token", "client_secret", "database_url",
    "connection_string",
)
SECRET_PREFIXES = (
    "bearer ", "basic ", "ey", "ghp_", "gho_", "sk-", "pk_", "ya29.", "agp_", "postgres://", "postgresql://",
    "mysql://", "redis://",
)
ALLOWED_KEYS = (
    "execution_id", "workflow_id", "tenant_id", "request_id", "trace_id", "span_id", "parent_span_id", "task_id", "asset_id",
    "step_id", "db.system", "db.operation", "db.sql.table", "db.name", "db.response.rows_affected", "http.method",
    "http.status_code", "http.route", "http.target", "service.name", "service.version", "environment", "queue_path",
    "target_url", "attempts", "max_attempts", "max_concurrent", "available_before", "wait_duration_ms", "total_duration_ms",
    "strategy", "status", "error.type", "error.message", "level", "target", "file", "line", "otel.name", "otel.kind",
    "otel.status_code", "otel.status_message", "code.function", "code.namespace", "code.filepath", "code.lineno", "thread.id",
    "thread.name",
)
REDACTED = "[REDACTED]"


def redact_pii(value: Column, kinds: tuple[str, ...] = tuple(PII), max_len: int | None = 1000) -> Column:
    """Replaces each kind by its tag, in the fixed order, then cuts at ``max_len`` characters."""
    for kind, (_, tag) in PII.items():
        if kind in kinds:
            found = F.regexp_replace(value, QUICK[kind], tag.replace("[", "\\[").replace("]", "\\]"))
            value = F.when(F.contains(value, F.lit("@")), found).otherwise(value) if kind == "email" else found
    if max_len is None:
        return value
    return F.when(F.char_length(value) > max_len, F.concat(F.substring(value, 1, max_len), F.lit("...[TRUNCATED]"))).otherwise(value)


def redact_value(value: Column, kind: T.DataType, kinds: tuple[str, ...] = tuple(PII)) -> Column:
    """Every text inside a value of that type."""
    if isinstance(kind, T.StringType):
        return redact_pii(value, kinds)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_value(x, kind.elementType, kinds))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: redact_value(v, kind.valueType, kinds))
    if isinstance(kind, T.StructType):
        inner = F.struct(*[redact_value(value.getField(f.name), f.dataType, kinds).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    return value


def redact_nested(df: DataFrame, kinds: tuple[str, ...] = tuple(PII), columns: list[str] | None = None) -> DataFrame:
    """Every text of the columns (default: all), in structs, arrays and map values too."""
    wanted = {f.name: redact_value(F.col(f"`{f.name}`"), f.dataType, kinds) for f in df.schema.fields if columns is None or f.name in columns}
    return df.withColumns(wanted)


def is_secret(key: Column, value: Column) -> Column:
    """A sensitive word in the key (unless the key is allowed), or a secret's prefix; letter case does not matter."""
    low = F.lower(key)
    word = F.exists(F.array(*map(F.lit, SENSITIVE_WORDS)), lambda w: F.contains(low, w))
    start = F.exists(F.array(*map(F.lit, SECRET_PREFIXES)), lambda p: F.startswith(F.lower(value), p))
    return (word & ~low.isin(*ALLOWED_KEYS)) | F.coalesce(start, F.lit(False))


def redact_secrets(values: Column) -> Column:
    """A map of text to text with the secret values replaced."""
    return F.transform_values(values, lambda k, v: F.when(is_secret(k, v), F.lit(REDACTED)).otherwise(v))


def mask_url_password(url: Column) -> Column:
    """``user:pw@host`` to ``user:****@host``."""
    return F.regexp_replace(url, r"://([^:/@]+):([^@/]+)@", r"://$1:****@")


def has_pii(value: Column, kind: str) -> Column:
    found = value.rlike(QUICK[kind])
    return F.contains(value, F.lit("@")) & found if kind == "email" else found


def pii_counts(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Rows with each kind, per group."""
    return df.groupBy(*by).agg(*[F.count_if(has_pii(F.col(text), k)).alias(f"n_{k}") for k in PII])
