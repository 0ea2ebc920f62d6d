"""IPv4 address expressions."""

import ipaddress

from pyspark.sql import Column, functions as F

FULL_MASK = 0xFFFFFFFF


def ipv4_to_int(ip: Column) -> Column:
    """Dotted quad as an unsigned 32-bit value in a long; text without four parts is 0 and an
    octet that is not a number counts as 0. The text is split once per row."""
    def fold(parts):
        step = lambda acc, part: acc * 256 + F.coalesce(part.try_cast("bigint"), F.lit(0).cast("bigint"))
        value = F.aggregate(F.slice(parts, 1, 4), F.lit(0).cast("bigint"), step)
        return F.when(F.size(parts) >= 4, value).otherwise(F.lit(0).cast("bigint"))

    return F.get(F.transform(F.array(F.split(ip, r"\.")), fold), F.lit(0))


def int_to_ipv4(value: Column) -> Column:
    octets = [(F.shiftright(value, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def subnet_key(value: Column, prefix: int = 24) -> Column:
    mask = (FULL_MASK << (32 - prefix)) & FULL_MASK
    return value.bitwiseAND(F.lit(mask).cast("bigint"))


def stable_slot(ip: Column, capacity: int) -> Column:
    """The same slot for an address in every process."""
    return F.pmod(F.xxhash64(ip), F.lit(capacity).cast("bigint"))


def in_network(value: Column, cidr: str) -> Column:
    net = ipaddress.ip_network(cidr, strict=False)
    return value.between(int(net.network_address), int(net.broadcast_address))


def is_ipv4_text(ip: Column) -> Column:
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(F.trim(ip).rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def is_private(value: Column) -> Column:
    nets = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16"]
    test = in_network(value, nets[0])
    for cidr in nets[1:]:
        test = test | in_network(value, cidr)
    return test


def is_enforceable(ip: Column, cidr: str = "10.0.0.0/24", protected: tuple = ()) -> Column:
    """A unicast host address inside ``cidr`` that is not infrastructure."""
    value = ipv4_to_int(ip)
    net = ipaddress.ip_network(cidr, strict=False)
    special = (
        in_network(value, "224.0.0.0/4") | in_network(value, "127.0.0.0/8")
        | in_network(value, "169.254.0.0/16") | (value == 0)
    )
    edge = value.isin(int(net.network_address), int(net.broadcast_address))
    allowed = is_ipv4_text(ip) & ~special & in_network(value, cidr) & ~edge
    return allowed & ~ip.isin(*protected) if protected else allowed


def host_label(ip: Column) -> Column:
    last = F.element_at(F.split(ip, r"\."), -1)
    return F.when(last.rlike(r"^[0-9]+$"), F.concat(F.lit("h"), last)).otherwise(ip)


def sort_key(ip: Column) -> Column:
    """Numeric order for addresses, anything else after them by text."""
    return F.struct(F.when(is_ipv4_text(ip), ipv4_to_int(ip)).otherwise(F.lit(1 << 40)), ip)
