"""The event tables' fixed schemas and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

#: Labels by wire code; each enumeration has its own codes. Fixed values.
ENUMS = {
    "direction": ["rx", "tx"],
    "edge": ["start", "done"],
    "packet_space": ["initial", "handshake", "zero_rtt", "data"],
    "packet_phase": ["header_parse", "routing", "scheduling", "header_unprotect", "payload_decrypt", "frame_process", "frame_encode", "packet_encrypt", "application", "read_queue", "send_queue"],
    "packet_outcome": ["success", "malformed", "authentication_failed", "dropped", "abandoned"],
    "send_blocked_reason": ["congestion_window", "pacing", "amplification", "connection_flow_control", "stream_flow_control", "send_buffer"],
    "socket_outcome": ["success", "pending", "would_block", "connection_reset", "error", "abandoned"],
    "object_phase": ["header_parse", "create", "payload_read", "frame_commit", "clone", "header_encode", "payload_write", "notify", "delivery_wait", "write_blocked", "transport_call"],
    "object_outcome": ["success", "failed", "abandoned", "expired", "dropped", "reset"],
}
WAITS = {"object": ("delivery_wait", "write_blocked"), "packet": ("scheduling", "read_queue", "send_queue")}

#: Columns after process_key: name, kind (long, int, bool, binary or an enumeration), ? where a has_ flag precedes the value.
EVENTS = {
    "quic_packet_start": "timestamp_ns:long trace_id:long connection_id:long direction:direction packet_number:long? packet_space:packet_space? byte_len:long?",
    "quic_packet_end": "timestamp_ns:long trace_id:long packet_number:long? packet_space:packet_space? byte_len:long? outcome:packet_outcome",
    "quic_packet_phase": "timestamp_ns:long trace_id:long span_id:long phase:packet_phase edge:edge outcome:packet_outcome?",
    "quic_stream_frame": "timestamp_ns:long trace_id:long stream_id:long offset_start:long offset_end:long outcome:packet_outcome retransmission:bool?",
    "quic_send_blocked": "timestamp_ns:long span_id:long connection_id:long stream_id:long? reason:send_blocked_reason edge:edge",
    "quic_connection_path": "timestamp_ns:long connection_id:long local_address:binary local_port:int peer_address:binary peer_port:int",
    "udp_socket_start": "timestamp_ns:long trace_id:long connection_id:long? direction:direction",
    "udp_socket_end": "timestamp_ns:long trace_id:long outcome:socket_outcome buffers:long datagrams:long bytes:long",
    "moq_object_start": "timestamp_ns:long trace_id:long logical_group:long logical_frame:long session_id:long? connection_id:long? direction:direction track_alias:long group_id:long object_id:long stream_id:long? stream_offset_start:long?",
    "moq_object_end": "timestamp_ns:long trace_id:long stream_offset_end:long? payload_bytes:long outcome:object_outcome",
    "moq_object_phase": "timestamp_ns:long trace_id:long span_id:long phase:object_phase edge:edge outcome:object_outcome?",
}
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "bool": T.BooleanType(), "binary": T.BinaryType()}


def fields(event: str) -> list[tuple[str, str, bool]]:
    """Name, kind and whether it is optional, of an event's columns."""
    out = []
    for part in EVENTS[event].split():
        name, kind = part.split(":")
        out.append((name, kind.rstrip("?"), kind.endswith("?")))
    return out


def decoded_schema(event: str) -> T.StructType:
    own = [T.StructField(name, _TYPES.get(kind, T.StringType()), optional) for name, kind, optional in fields(event)]
    return T.StructType([T.StructField("process_key", T.StringType(), False), *own])


def raw_schema(event: str) -> T.StructType:
    """As captured: has_ flags, enumeration codes, addresses as two unsigned halves."""
    out = [T.StructField("process_key", T.StringType(), False)]
    for name, kind, optional in fields(event):
        if optional:
            out.append(T.StructField(f"has_{name}", T.ShortType(), False))
        if kind == "binary":
            out += [T.StructField(f"{name}_{half}", T.DecimalType(20, 0), False) for half in ("high", "low")]
        else:
            out.append(T.StructField(name, {"bool": T.ShortType(), "int": T.IntegerType(), "long": T.LongType()}.get(kind, T.ShortType()), False))
    return T.StructType(out)
