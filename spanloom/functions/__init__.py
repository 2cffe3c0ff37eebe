"""Column functions: decoding of wire values and the toolkit's scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ENUMS, fields


def optional(flag: Column, value: Column) -> Column:
    """A flagged value; 0 is a value like any other."""
    return F.when(flag == 1, value)


def enum_label(name: str, code: Column) -> Column:
    """Label of a code; codes that are not known yet survive as unknown_N."""
    labels = F.array(*map(F.lit, ENUMS[name]))
    return F.when(code.isNotNull(), F.coalesce(F.get(labels, code.cast("int")), F.concat(F.lit("unknown_"), code.cast("string"))))


def enum_code(name: str, label: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, ENUMS[name])), label)
    return F.when(position > 0, position - 1).cast("short")


def decode(raw: DataFrame, event: str) -> DataFrame:
    """A captured table as typed, nullable, labelled columns."""
    out = [F.col("process_key")]
    for name, kind, is_optional in fields(event):
        if kind == "binary":
            value = address(F.col(f"{name}_high"), F.col(f"{name}_low"))
        elif kind == "bool":
            value = F.col(name) == 1
        elif kind in ENUMS:
            value = enum_label(kind, F.col(name))
        else:
            value = F.col(name)
        out.append((optional(F.col(f"has_{name}"), value) if is_optional else value).alias(name))
    return raw.select(*out)


def address(high: Column, low: Column) -> Column:
    """16 bytes from two unsigned 64-bit halves."""
    half = lambda v: F.lpad(F.conv(v.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(half(high), half(low)))


def ipv4_mapped(dotted: Column) -> Column:
    """::ffff:a.b.c.d as 16 bytes."""
    parts = F.transform(F.split(dotted, r"\."), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0"))
    return F.unhex(F.concat(F.repeat(F.lit("0"), 20), F.lit("FFFF"), F.array_join(parts, "")))


def address_text(value: Column) -> Column:
    """Dotted form of an IPv4-mapped address; else 32 hexadecimal digits; null where unspecified."""
    digits = F.hex(value)
    byte = lambda i: F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10)
    mapped = F.substring(digits, 1, 24) == "0" * 20 + "FFFF"
    return F.when(digits == "0" * 32, None).when(mapped, F.concat_ws(".", *[byte(i) for i in range(4)])).otherwise(F.lower(digits))


def datagrams(size: Column, segment: Column) -> Column:
    """Datagrams of one buffer: at least one; without a segment size exactly one."""
    return F.when(segment > 0, F.greatest(F.lit(1), F.call_function("div", size + segment - 1, segment))).otherwise(1).cast("long")


def errno_outcome(code: Column) -> Column:
    """Linux errno to a socket outcome. Fixed values."""
    return F.when(code == 0, "success").when(code == 11, "would_block").when(code == 104, "connection_reset").when(code.isNotNull(), "error")


def io_error_outcome(kind: Column, code: Column | None = None) -> Column:
    """A failed call's error to a socket outcome: by its code where it has one, else by its kind's name. Fixed values."""
    by_kind = F.when(kind == "WouldBlock", "would_block").when(kind == "ConnectionReset", "connection_reset").when(kind.isNotNull(), "error")
    return by_kind if code is None else F.coalesce(errno_outcome(code), by_kind)


def sockaddr_endpoint(raw: Column) -> Column:
    """Address (16 bytes) and port of a Linux socket address as bytes.

    Families 2 and 10 are IPv4 and IPv6 (fixed values); of another family, too short, or null: the unspecified address, port 0.
    """
    digits = F.hex(raw)
    family = F.concat(F.substring(digits, 3, 2), F.substring(digits, 1, 2))  # little-endian
    port = F.conv(F.substring(digits, 5, 4), 16, 10).cast("int")
    four, six = (family == "0002") & (F.length(digits) >= 16), (family == "000A") & (F.length(digits) >= 48)
    address = F.when(four, F.concat(F.lit("0" * 20 + "FFFF"), F.substring(digits, 9, 8))).when(six, F.substring(digits, 17, 32)).otherwise("0" * 32)
    return F.struct(F.unhex(address).alias("address"), F.when(four | six, port).otherwise(0).alias("port"))


def clock_ns(seconds: Column, nanos: Column) -> Column:
    """A clock reading as nanoseconds."""
    return seconds.cast("long") * 1_000_000_000 + nanos.cast("long")


def stamped(rows: DataFrame, session_id: Column | None = None, connection_id: Column | None = None) -> DataFrame:
    """Rows with the session and connection of the handle they came through; what is not given stays as it is."""
    given = {"session_id": session_id, "connection_id": connection_id}
    return rows.withColumns({c: v for c, v in given.items() if v is not None})


def saturated(value: Column) -> Column:
    """An unsigned 64-bit value as a long; what does not fit is the largest long."""
    return F.coalesce(value.try_cast("long"), F.when(value.isNotNull(), F.lit(2**63 - 1)))


def logical_id(group: Column, frame: Column) -> Column:
    """A logical id; structs compare by group, then frame."""
    return F.struct(group.alias("group"), frame.alias("frame"))


def logical_text(value: Column) -> Column:
    return F.concat_ws(":", value["group"].cast("string"), value["frame"].cast("string"))


def same(a: Column, b: Column) -> Column:
    """Equality where null equals null."""
    return a.eqNullSafe(b)
