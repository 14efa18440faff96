"""Keyed pseudonyms and generalisation, with built-in hash functions only.

The key pads are literals of the plan. Set ``spark.sql.redaction.string.regex`` on clusters that
publish plans or event logs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC (RFC 2104) for SHA-256."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_token(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the UTF-8 text as lower-case hex; NULL stays NULL."""
    inner, outer = hmac_pads(key)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)


def namespaced_key(key: bytes, namespace: str) -> bytes:
    """Separate key per purpose, so that tokens of different columns cannot be joined."""
    return hashlib.sha256(key + b":" + namespace.encode()).digest()


def actor_token(text: Column, key: bytes) -> Column:
    return hmac_token(F.trim(text), namespaced_key(key, "actor"))


# Fixed shapes: a dotted address, and eight groups of up to four hexadecimal digits.
IPV4_SHAPE = r"^\d{1,3}(\.\d{1,3}){3}$"
IPV6_SHAPE = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$"


def ip_prefix(ip: Column) -> Column:
    """Generalise an address to its network: /24 of IPv4, /48 of IPv6; NULL for anything else.

    IPv6 is written out before it is cut: ``::`` stands for the groups that are missing. A zone (``%eth0``) is dropped, and
    an IPv4 address mapped into IPv6 is generalised as what it is.
    """

    def text(t: Column) -> Column:
        return F.lower(F.regexp_replace(F.trim(t), "%.*$", ""))

    def plain(t: Column) -> Column:
        mapped = t.rlike(r"^(::ffff:|0:0:0:0:0:ffff:)\d+\.")
        return F.when(mapped, F.substring_index(t, ":", -1)).otherwise(t)

    def sides(t: Column) -> Column:
        left, right = F.substring_index(t, "::", 1), F.substring_index(t, "::", -1)
        return F.struct(t.alias("plain"), left.alias("left"), right.alias("right"))

    def groups(side: Column) -> Column:
        return F.when(side == "", 0).otherwise(F.length(side) - F.length(F.replace(side, F.lit(":"), F.lit(""))) + 1)

    def whole(t: Column) -> Column:
        missing = 8 - groups(t["left"]) - groups(t["right"])
        # At least one group is missing where there is a ``::``, which may stand once.
        once = F.length(t["plain"]) == F.length(t["left"]) + F.length(t["right"]) + 2
        zeros = F.rtrim(F.repeat(F.lit("0:"), missing), F.lit(":"))
        filled = F.concat_ws(":", F.nullif(t["left"], F.lit("")), zeros, F.nullif(t["right"], F.lit("")))
        without = ~F.contains(t["plain"], F.lit("::"))
        return F.when(without, t["plain"]).when(once & (missing >= 1), filled)

    def network(t: Column) -> Column:
        first = F.regexp_replace(F.substring_index(t, ":", 3), "(^|:)0+(?=[0-9a-f])", "$1")
        return F.when(t.rlike(IPV4_SHAPE), F.regexp_replace(t, r"\.\d+$", ".0")).when(
            t.rlike(IPV6_SHAPE), F.concat(first, F.lit("::/48"))
        )

    # Each step reads the one before it several times; as elements of an array the values are computed once.
    value = F.array(ip)
    for step in (text, plain, sides, whole, network):
        value = F.transform(value, step)
    return value[0]
