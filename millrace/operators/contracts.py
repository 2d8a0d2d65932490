"""Contracts: rules compiled to columns, reasons, and the split into clean and quarantined rows.

Every rule is total: where a comparison is null, the rule has failed, so clean and quarantine together are the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of fields that may not hold plain identifiers.
SENSITIVE = ("ssn", "tax_id", "credit_card", "pan", "passport_number", "drivers_license")
#: How far ahead of now an event may be.
FUTURE_SECONDS = 300


@dataclass(frozen=True)
class Rule:
    """A named check; ok is true, false or null, and null fails."""

    name: str
    ok: Column
    severity: str = "ERROR"
    description: str = ""


def present(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def required(*names: str) -> Rule:
    ok = F.lit(True)
    for n in names:
        ok = ok & present(F.col(n))
    return Rule(f"required:{','.join(names)}", ok, description="A key or event metadata is missing.")


def allowed(name: str, values: Iterable[str]) -> Rule:
    return Rule(f"allowed:{name}", F.upper(F.coalesce(F.col(name).cast("string"), F.lit(""))).isin(*values), description=f"{name} must be a governed value.")


def non_negative(name: str) -> Rule:
    return Rule(f"non_negative:{name}", F.col(name).cast("string").try_cast("double") >= 0, description=f"{name} cannot be negative.")


def no_plaintext_sensitive_fields(payload: str) -> Rule:
    """payload is a map of text: none of the sensitive names may have a value."""
    leak = F.exists(F.map_entries(F.col(payload)), lambda e: F.lower(e["key"]).isin(*SENSITIVE) & present(e["value"]))
    return Rule("sensitive_data_tokenization", ~F.coalesce(leak, F.lit(False)), description="Identifiers must be tokens.")


def predicate(name: str, ok: Column, severity: str = "ERROR", description: str = "") -> Rule:
    return Rule(name, ok, severity, description)


def violations(rules: Iterable[Rule]) -> Column:
    """array of (rule, severity, description) of the rules that fail."""
    each = [F.when(~F.coalesce(r.ok, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("description"))) for r in rules]
    return F.filter(F.array(*each), lambda v: v.isNotNull())


def evaluate(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """df with violations, and valid: no violation of severity ERROR."""
    return df.withColumn("violations", violations(rules)).withColumn("valid", ~F.exists("violations", lambda v: v["severity"] == "ERROR"))


def reasons(checks: Iterable[tuple[str, Column]]) -> Column:
    """All codes whose failure column is true, sorted and distinct; a null failure column counts as no failure."""
    each = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in checks]
    return F.array_sort(F.array_distinct(F.filter(F.array(*each), lambda x: x.isNotNull())))


def first_reason(checks: Iterable[tuple[str, Column]]) -> Column:
    """The first code whose failure column is true; null if none is."""
    out = None
    for code, bad in checks:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, code) if out is None else out.when(bad, code)
    return out


def split(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine) by a reason column that is null, or an array that is empty, where a row is clean."""
    kind = df.schema[reason].dataType
    bad = F.size(reason) > 0 if isinstance(kind, T.ArrayType) else F.col(reason).isNotNull()
    return df.where(~bad).drop(reason), df.where(bad)


@dataclass(frozen=True)
class StreamContract:
    """What a stream's events must have: type, versions, required fields, key."""

    domain: str
    event_type: str
    required: tuple[str, ...]
    key: tuple[str, ...]
    versions: tuple[str, ...] = ("1",)
    extra: dict[str, str] = field(default_factory=dict)

    #: The fields of every envelope.
    ENVELOPE = ("event_id", "event_type", "schema_version", "source_system", "property_code", "event_ts", "trace_id")

    def schema(self) -> T.StructType:
        names = [*self.ENVELOPE, *[c for c in (*self.required, *self.key, *self.extra) if c not in self.ENVELOPE]]
        return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])


def parse_envelope(df: DataFrame, contract: StreamContract, value: str = "value") -> DataFrame:
    """The JSON text in value as one column a field; malformed JSON gives nulls, which the checks then catch."""
    return df.withColumn("_event", F.from_json(F.col(value).cast("string"), contract.schema())).select(*[c for c in df.columns], "_event.*")


def quality_checks(contract: StreamContract) -> list[tuple[str, Column]]:
    """The checks of a stream in their order."""
    lacks = F.lit(False)
    for name in contract.required:
        lacks = lacks | ~present(F.col(name))
    return [
        ("MISSING_EVENT_ID", ~present(F.col("event_id"))),
        ("MISSING_EVENT_TIME", F.try_to_timestamp(F.col("event_ts").cast("string")).isNull()),
        ("MISSING_REQUIRED_FIELD", lacks),
        ("INVALID_EVENT_TYPE", ~F.coalesce(F.upper("event_type") == contract.event_type, F.lit(False))),
        ("UNSUPPORTED_SCHEMA_VERSION", ~F.coalesce(F.col("schema_version").isin(*contract.versions), F.lit(False))),
    ]


def add_quality_status(df: DataFrame, contract: StreamContract) -> DataFrame:
    """df with _dq_valid and _dq_reason, the first check that fails; never null in the first."""
    return df.withColumn("_dq_reason", first_reason(quality_checks(contract))).withColumn("_dq_valid", F.col("_dq_reason").isNull())


def message_checks(key: str, event_type: str, payload: str = "payload") -> list[tuple[str, Column]]:
    """First-failure checks of a message given as a map of text."""
    get = lambda name: F.col(payload)[name]
    names = ("event_id", "event_type", "event_ts", "schema_version", "source_system", "property_code", key)
    zoned = get("event_ts").rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(get("event_ts")).isNotNull()
    leak = F.exists(F.map_entries(F.col(payload)), lambda e: F.lower(e["key"]).isin(*SENSITIVE) & present(e["value"]))
    return [
        ("INVALID_JSON", F.col(payload).isNull()),
        *[(f"MISSING_{n.upper()}", ~present(get(n)) | get(n).isNull()) for n in names],
        ("INVALID_EVENT_TYPE", F.upper(get("event_type")) != event_type.upper()),
        ("UNSUPPORTED_SCHEMA_VERSION", ~get("schema_version").isin("1", "1.0")),
        ("INVALID_EVENT_TIME", ~F.coalesce(zoned, F.lit(False))),
        ("PLAINTEXT_SENSITIVE_IDENTIFIER", leak),
    ]


def envelope_checks(properties: Iterable[str], versions: Iterable[str], as_of: Column) -> list[tuple[str, Column]]:
    """All-failures checks of a canonical envelope; as_of stands for now."""
    return [
        ("EVENT_ID_REQUIRED", ~present(F.col("event_id")) | F.col("event_id").isNull()),
        ("EVENT_TYPE_REQUIRED", ~present(F.col("event_type")) | F.col("event_type").isNull()),
        ("SOURCE_SYSTEM_REQUIRED", ~present(F.col("source_system")) | F.col("source_system").isNull()),
        ("PROPERTY_UNSUPPORTED", ~F.coalesce(F.col("property_code").isin(*properties), F.lit(False))),
        ("FUTURE_EVENT_TIME", F.col("event_time") > as_of + F.expr(f"INTERVAL {FUTURE_SECONDS} SECONDS")),
        ("UNSUPPORTED_SCHEMA_VERSION", ~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False))),
        ("PAYLOAD_NOT_OBJECT", F.col("payload").isNull()),
    ]


def _missing(c: Column) -> Column:
    return ~F.coalesce(present(c), F.lit(False))


def reservation_checks(get: Callable[[str], Column]) -> list[tuple[str, Column]]:
    arrival, departure = get("arrival_date"), get("departure_date")
    return [
        ("RESERVATION_ID_REQUIRED", _missing(F.trim(get("reservation_id")))),
        ("STAY_DATES_REQUIRED", _missing(arrival) | _missing(departure)),
        ("DEPARTURE_BEFORE_ARRIVAL", departure.try_cast("date") < arrival.try_cast("date")),
        ("ROOMS_NEGATIVE", get("rooms").try_cast("bigint") < 0),
        ("REVENUE_NEGATIVE", get("revenue_amount").try_cast("decimal(18,2)") < 0),
    ]


def slot_play_checks(get: Callable[[str], Column]) -> list[tuple[str, Column]]:
    return [
        ("PLAY_ID_REQUIRED", _missing(get("play_id"))),
        ("MACHINE_ID_REQUIRED", _missing(get("machine_id"))),
        ("COIN_IN_NEGATIVE", get("coin_in").try_cast("decimal(18,2)") < 0),
        ("PAYOUT_NEGATIVE", get("payout").try_cast("decimal(18,2)") < 0),
    ]


def reward_checks(get: Callable[[str], Column]) -> list[tuple[str, Column]]:
    return [("REWARD_EVENT_ID_REQUIRED", _missing(get("reward_event_id"))), ("GUEST_ID_REQUIRED", _missing(get("guest_id")))]


def payment_checks(get: Callable[[str], Column], currencies: Iterable[str] = ("USD",)) -> list[tuple[str, Column]]:
    return [("TRANSACTION_ID_REQUIRED", _missing(get("transaction_id"))), ("CURRENCY_UNSUPPORTED", ~F.coalesce(F.upper(F.trim(get("currency"))).isin(*currencies), F.lit(False)))]


def work_order_checks(get: Callable[[str], Column]) -> list[tuple[str, Column]]:
    return [
        ("WORK_ORDER_ID_REQUIRED", _missing(get("work_order_id"))),
        ("CLOSED_BEFORE_OPENED", F.try_to_timestamp(get("closed_at")) < F.try_to_timestamp(get("opened_at"))),
    ]


#: Checks by event type; a type that is not here has the envelope's alone.
DOMAIN_CHECKS: dict[str, Callable[[Callable[[str], Column]], list[tuple[str, Column]]]] = {
    "HOTEL_RESERVATION": reservation_checks,
    "SLOT_PLAY": slot_play_checks,
    "REWARD_ACTIVITY": reward_checks,
    "PAYMENT": payment_checks,
    "WORK_ORDER": work_order_checks,
}


def domain_checks(kind: Column, payload: str = "payload") -> list[tuple[str, Column]]:
    """All checks of the domains, each for rows of its type alone."""
    return [(code, (kind == event_type) & bad) for event_type, checks in DOMAIN_CHECKS.items() for code, bad in checks(lambda n: F.col(payload)[n])]


def route(df: DataFrame, properties: Iterable[str], versions: Iterable[str], as_of: Column, payload: str = "payload") -> DataFrame:
    """df with reasons (all, sorted, distinct) and zone, quarantine if there is any reason, else clean. payload is a map of text."""
    checks = envelope_checks(properties, versions, as_of) + domain_checks(F.upper(F.trim("event_type")), payload)
    return df.withColumn("reasons", reasons(checks)).withColumn("zone", F.when(F.size("reasons") > 0, "quarantine").otherwise("clean"))


def topic_checks(known_topic: str = "known_topic", known_version: str = "known_version") -> list[tuple[str, Column]]:
    """All-failures checks of a broker's message (event_id, property_code, schema_version, payload as JSON text) joined to its topic's catalog row.

    Without a catalog row the topic is unknown; then, or where the row names no version, any version will do.
    """
    missing = lambda name: F.col(name).isNull() | (F.col(name) == "")
    return [
        ("UNKNOWN_TOPIC", F.col(known_topic).isNull()),
        ("EVENT_ID_REQUIRED", missing("event_id")),
        ("PROPERTY_REQUIRED", missing("property_code")),
        ("SCHEMA_VERSION_UNSUPPORTED", F.col(known_version).isNotNull() & ~F.col("schema_version").eqNullSafe(F.col(known_version))),
        ("PAYLOAD_NOT_OBJECT", F.json_object_keys("payload").isNull()),
    ]


def gateway_status(event_type: Column, idempotency_key: Column, event_id: Column, valid: Column, types: Iterable[str]) -> Column:
    """What a gateway answers to a posted event: 404 for a type it does not know, 422 for a body against its contract, 409 where a key is
    given that is not the event's id, else 200. Only what gets 200 may land."""
    known = F.coalesce(F.upper(event_type).isin(*[t.upper() for t in types]), F.lit(False))
    other = F.coalesce(idempotency_key != "", F.lit(False)) & ~idempotency_key.eqNullSafe(event_id)
    return F.when(~known, 404).when(~F.coalesce(valid, F.lit(False)), 422).when(other, 409).otherwise(200)


#: Fixed value: the form of a UUID.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def from_json_schema(schema: dict, payload: str = "payload") -> list[tuple[str, Column]]:
    """Failure columns compiled from a JSON-Schema contract, over payload, a map of text.

    Covers required, const, enum, minimum, maximum, minLength, the formats uuid, date, date-time and zoned (a date-time that names its zone), type
    integer and number, and additionalProperties false.
    A property that is absent or null is checked by required alone.
    """
    get = lambda n: F.col(payload)[n]
    out = [(f"REQUIRED_{n.upper()}", get(n).isNull()) for n in schema.get("required", [])]
    for n, p in schema.get("properties", {}).items():
        kinds = p.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        here, name = get(n).isNotNull(), n.upper()
        if "const" in p:
            out.append((f"CONST_{name}", here & (get(n) != str(p["const"]))))
        if "enum" in p:
            out.append((f"ENUM_{name}", here & ~get(n).isin(*[str(v) for v in p["enum"] if v is not None])))
        if "integer" in kinds:
            out.append((f"TYPE_{name}", here & get(n).try_cast("bigint").isNull()))
        elif "number" in kinds:
            out.append((f"TYPE_{name}", here & get(n).try_cast("double").isNull()))
        if "minimum" in p:
            out.append((f"MINIMUM_{name}", here & (get(n).try_cast("double") < float(p["minimum"]))))
        if "maximum" in p:
            out.append((f"MAXIMUM_{name}", here & (get(n).try_cast("double") > float(p["maximum"]))))
        if "minLength" in p:
            out.append((f"LENGTH_{name}", here & (F.length(get(n)) < int(p["minLength"]))))
        if p.get("format") == "uuid":
            out.append((f"FORMAT_{name}", here & ~get(n).rlike(UUID)))
        elif p.get("format") == "zoned":
            zoned = get(n).rlike(r"(Z|[+-]\d\d:?\d\d)$") & F.try_to_timestamp(get(n)).isNotNull()
            out.append((f"FORMAT_{name}", here & ~F.coalesce(zoned, F.lit(False))))
        elif p.get("format") == "date-time":
            out.append((f"FORMAT_{name}", here & F.try_to_timestamp(get(n)).isNull()))
        elif p.get("format") == "date":
            out.append((f"FORMAT_{name}", here & get(n).try_cast("date").isNull()))
    if schema.get("additionalProperties") is False:
        known = list(schema.get("properties", {}))
        out.append(("UNKNOWN_FIELD", F.exists(F.map_keys(F.col(payload)), lambda k: ~k.isin(*known))))
    return out


def _event(event_type: str, required: dict, optional: dict | None = None) -> dict:
    """The closed schema of an event: the envelope's fields and its own."""
    envelope = {"event_id": {"format": "uuid"}, "event_ts": {"format": "zoned"}, "schema_version": {"const": "1"}, "source_system": {"type": "string"}, "property_code": {"type": "string"}, "trace_id": {"format": "uuid"}, "event_type": {"const": event_type}}
    needs = ["event_id", "event_ts", "event_type", "source_system", "property_code", *required]
    return {"additionalProperties": False, "required": needs, "properties": envelope | required | (optional or {})}


_TEXT, _MONEY = {"type": "string"}, {"type": "number"}
#: The fields and bounds of the five typed events.
EVENT_SCHEMAS = {
    "HOTEL_RESERVATION": _event("HOTEL_RESERVATION", {
        "reservation_id": _TEXT, "guest_token": _TEXT, "arrival_date": {"format": "date-time"}, "departure_date": {"format": "date-time"}, "room_type_code": _TEXT,
        "status": {"enum": ["BOOKED", "CHECKED_IN", "CHECKED_OUT", "CANCELLED", "NO_SHOW"]}, "channel": _TEXT}, {"room_revenue": _MONEY}),
    "SLOT_PLAY": _event("SLOT_PLAY", {"session_id": _TEXT, "device_token": _TEXT, "coin_in": _MONEY, "payout": _MONEY}, {"guest_token": _TEXT, "jackpot_amount": _MONEY}),
    "TABLE_PLAY": _event("TABLE_PLAY", {"session_id": _TEXT, "table_token": _TEXT, "game_code": _TEXT, "buy_in": _MONEY, "cash_out": _MONEY, "average_bet": _MONEY, "minutes_played": {"type": "integer", "minimum": 0, "maximum": 1440}}, {"guest_token": _TEXT}),
    "REWARD_ACTIVITY": _event("REWARD_ACTIVITY", {
        "reward_event_id": _TEXT, "guest_token": _TEXT, "activity_type": {"enum": ["EARN", "REDEEM", "ADJUST"]}, "points_delta": {"type": "integer"},
        "source_domain": {"enum": ["GAMING", "HOTEL", "DINING", "ENTERTAINMENT", "SPA", "RETAIL"]}}, {"monetary_value": _MONEY}),
    "MOBILE_APP": _event("MOBILE_APP", {"mobile_event_id": _TEXT, "action": _TEXT, "screen_name": _TEXT}, {"guest_token": _TEXT, "anonymous_session_id": _TEXT, "offer_token": _TEXT, "device_family": _TEXT}),
}


def typed_event_failures(payload: str = "payload") -> Column:
    """Sorted failures of a typed event given as a map of text, by the schema of its event_type; UNKNOWN_EVENT_TYPE where there is none."""
    kind, out = F.col(payload)["event_type"], F.array(F.lit("UNKNOWN_EVENT_TYPE"))
    for name, schema in EVENT_SCHEMAS.items():
        out = F.when(kind == name, reasons(from_json_schema(schema, payload))).otherwise(out)
    return out
