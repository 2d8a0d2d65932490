"""Scalar functions: codes, casts, times, keys, hashes, arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code(c: Column) -> Column:
    """Trimmed upper case; empty is null."""
    return F.nullif(F.upper(F.trim(c.cast("string"))), F.lit(""))


def squeezed(c: Column) -> Column:
    """White space runs as one space, none at the ends; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit(""))


def decimal_or_null(c: Column, kind: str = "decimal(18,2)") -> Column:
    """Null for null, empty and malformed text; see malformed."""
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def int_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit("")).try_cast("bigint")


def malformed(c: Column, kind: str) -> Column:
    """True where text is there but is no kind: what a row-at-a-time engine would raise on."""
    text = F.nullif(F.trim(c), F.lit(""))
    return text.isNotNull() & text.try_cast(kind).isNull()


def utc_time(c: Column) -> Column:
    """ISO text as a timestamp; without a zone it is the session's, UTC. Malformed text is null."""
    return F.try_to_timestamp(c)


def zoned_time(c: Column) -> Column:
    """ISO text that names its zone, else null: the rule at ingestion."""
    return F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def bucket(ts: Column, width: str) -> Column:
    """Start of the window of that width that ts is in."""
    return F.window(ts, width)["start"]


def business_key(*cols: Column) -> Column:
    """Parts joined by ||, with <null> for null."""
    return F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in cols])


def first_key(*cols: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def canonical_key(entity: Column, prop: Column, key: Column) -> Column:
    return F.concat_ws(":", entity.cast("string"), prop.cast("string"), key.cast("string"))


def ordering_key(prop: Column, key: Column) -> Column:
    return F.concat_ws(":", prop.cast("string"), key.cast("string"))


def stable_event_id(topic: Column, prop: Column, key: Column, version: Column) -> Column:
    """First 32 hex digits, upper case, of SHA-256 over topic|property|key|version."""
    joined = F.concat_ws("|", *[c.cast("string") for c in (topic, prop, key, version)])
    return F.upper(F.substring(F.sha2(joined, 256), 1, 32))


def stable_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in order of their names; nulls are kept as nulls."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def net_win(coin_in: Column, payout: Column, jackpot: Column) -> Column:
    zero = F.lit(0)
    return F.coalesce(coin_in, zero) - F.coalesce(payout, zero) - F.coalesce(jackpot, zero)


def backoff(attempt: Column, base: float = 0.25, cap: float = 30.0) -> Column:
    """Seconds before a retry: base, doubled with each attempt after the first, cap at most."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1).cast("double")))


def dead_letter_topic(topic: Column) -> Column:
    return F.concat(topic, F.lit(".dlq"))


def subscription_name(topic: Column, environment: str) -> Column:
    return F.concat(F.lit(f"{environment}-"), F.replace(topic, F.lit("."), F.lit("-")), F.lit("-consumer-v1"))


def slug(*parts: Column) -> Column:
    return F.replace(F.lower(F.concat_ws("-", *parts)), F.lit(" "), F.lit("-"))


def age_status(age_seconds: Column, warn: int, error: int) -> Column:
    """Freshness: pass, warn or error by the age of what was loaded last."""
    return F.when(age_seconds.isNull() | (age_seconds > error), "error").when(age_seconds > warn, "warn").otherwise("pass")
