"""Which events are enabled: a 64-bit mask per provider, as a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EVENTS

#: Events that one lifecycle's token covers.
LIFECYCLES = {
    "packet": ["quic_packet_start", "quic_packet_phase", "quic_packet_end"],
    "socket": ["udp_socket_start", "udp_socket_end"],
    "blocked": ["quic_send_blocked"],
    "object": ["moq_object_start", "moq_object_phase", "moq_object_end"],
}
PHASES = {"packet": "quic_packet_phase", "object": "moq_object_phase"}


def provider(event: str) -> str:
    """Objects have a schema of their own; everything else is the transport's."""
    return "object" if event.startswith("moq_") else "transport"


def events(of: str) -> list[str]:
    return [e for e in EVENTS if provider(e) == of]


def bit(event: str) -> int:
    """The event's bit in its provider's mask; a schema has 64 events at most."""
    return 1 << events(provider(event)).index(event)


def enable_only(event: str) -> Column:
    return F.lit(bit(event)).cast("long")


def set_enabled(mask: Column, event: str, on: Column) -> Column:
    """The mask with one event's bit set or cleared."""
    return F.when(on, mask.bitwiseOR(F.lit(bit(event)))).otherwise(mask.bitwiseAND(F.lit(~bit(event))))


def enabled(mask: Column, event: str) -> Column:
    return mask.bitwiseAND(F.lit(bit(event))) != 0


def any_enabled(mask: Column, of: list[str]) -> Column:
    """Whether any of these events (of one provider) is enabled."""
    return mask.bitwiseAND(F.lit(reduce(int.__or__, map(bit, of), 0))) != 0


def traced(mask: Column, lifecycle: str) -> Column:
    """Whether a lifecycle that begins under this mask has a token at all."""
    return any_enabled(mask, LIFECYCLES[lifecycle])


def records_phases(at_start: Column, now: Column, lifecycle: str) -> Column:
    """Whether a token made under one mask records a phase under another."""
    return traced(at_start, lifecycle) & enabled(now, PHASES[lifecycle])


def emitted(event: Column, at_start: Column, now: Column, lifecycle: str) -> Column:
    """Whether an event of a lifecycle leaves: it has a token, and the event is enabled when it would leave."""
    on = reduce(lambda a, b: a | b, [(event == e) & enabled(now, e) for e in LIFECYCLES[lifecycle]])
    return traced(at_start, lifecycle) & on


def if_enabled(mask: Column, value: Column, of: str = "transport") -> Column:
    """A clock reading, taken only where any event of the provider would be recorded."""
    return F.when(any_enabled(mask, events(of)), value)
