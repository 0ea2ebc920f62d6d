"""Port and protocol vocabulary."""

from pyspark.sql import Column, functions as F

from flowloom.constants import (
    NAMED_PORTS, PORT_BUCKET_EDGES, PORT_FIRST_TOKEN, PORT_UNKNOWN_TOKEN, PROTOCOL_NUMBERS,
    PROTOCOL_TOKENS, PROTOCOL_UNKNOWN_TOKEN,
)


def _lookup(table: dict) -> Column:
    """A constant map literal, evaluated inside the scan stage."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def port_token(port: Column) -> Column:
    """Named ports have their own token, all others share one per range bucket."""
    number = port.try_cast("double")
    whole = F.floor(number).cast("int")
    # tokens follow port order, so a search in a constant array is the lookup; a map literal
    # of this size would be unrolled into one branch per port
    at = F.array_position(F.array(*[F.lit(p) for p in NAMED_PORTS]), whole).cast("int")
    named = F.when(at > 0, at + (PORT_FIRST_TOKEN - 1))
    base = PORT_FIRST_TOKEN + len(NAMED_PORTS)
    reached = [(whole >= edge).cast("int") for edge in PORT_BUCKET_EDGES[1:-1]]
    bucket = sum(reached, F.lit(base))
    known = number.isNotNull() & ~F.isnan(number) & number.between(0, 65535)
    return F.when(known, F.coalesce(named, bucket)).otherwise(PORT_UNKNOWN_TOKEN)


def protocol_token(protocol: Column) -> Column:
    token = _lookup(PROTOCOL_TOKENS)[protocol.try_cast("int")]
    return F.coalesce(token, F.lit(PROTOCOL_UNKNOWN_TOKEN))


def protocol_number(name: Column) -> Column:
    """IANA number of a protocol name; a number stays itself, an unknown name is 0."""
    text = F.upper(F.trim(name.cast("string")))
    return F.coalesce(_lookup(PROTOCOL_NUMBERS)[text], text.try_cast("int"), F.lit(0))
