"""The standing groups of continuous queries, and windows by domain."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.contracts import StreamContract
from ..sources.readers import SourceSpec
from .queries import QuerySpec

#: Topics, types, keys and required fields of the three domains; offsets taken a trigger.
DOMAINS = {
    "hotel": ("hotel.reservation-events.v1", "HOTEL_RESERVATION", ("reservation_id",)),
    "gaming": ("gaming.slot-play-events.v1", "SLOT_PLAY", ("session_id", "event_id")),
    "rewards": ("rewards.earn-events.v1", "REWARD_ACTIVITY", ("reward_event_id",)),
}
MAX_OFFSETS = 250_000
REQUIRED = ("event_id", "event_type", "schema_version", "source_system", "property_code", "event_ts")


def default_specs(bootstrap: str, root: str, trigger: str = "15 seconds") -> list[QuerySpec]:
    """The three domains' queries from Kafka."""
    out = []
    for domain, (topic, event_type, key) in DOMAINS.items():
        source = SourceSpec("kafka", topic, max_per_trigger=MAX_OFFSETS, options={"kafka.bootstrap.servers": bootstrap})
        out.append(QuerySpec(f"{domain}_events", source, StreamContract(domain, event_type, (*REQUIRED, *key), key), root, trigger=trigger))
    return out


@dataclass(frozen=True)
class WindowSpec:
    """How a domain's events are windowed: fixed by width, sliding by width and hop, session by gap."""

    kind: str
    width: str
    hop: str | None = None
    lateness: str = "600 seconds"


#: The windows of the domains.
WINDOWS = {"hotel": WindowSpec("fixed", "60 seconds"), "gaming": WindowSpec("sliding", "300 seconds", "30 seconds"), "mobile": WindowSpec("session", "600 seconds")}


def windowed(df, domain: str, ts: str, keys: list[str], measures: dict):
    """The domain's window over df, with its lateness as the watermark where df is a stream."""
    from ..operators import windows as W

    spec = WINDOWS[domain]
    df = df.withWatermark(ts, spec.lateness) if df.isStreaming else df
    if spec.kind == "fixed":
        return W.tumbling(df, ts, spec.width, keys, measures)
    if spec.kind == "sliding":
        return W.hopping(df, ts, spec.width, spec.hop, keys, measures)
    return W.sessions(df, ts, spec.width, keys, measures)
