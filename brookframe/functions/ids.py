"""Values generated on write: as functions of no arguments (defaults of single rows), and as columns for whole DataFrames."""

from __future__ import annotations

import hashlib
import secrets
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabets of the formats.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
NANO = "useandom-26T198340PX75pxJACKVERYMINDBUSHWOLF_GQZbfghjklqvwyzrict"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def uuid4() -> str:
    return str(uuid.uuid4())


def uuid7() -> str:
    """Milliseconds, then random bits, so that ids sort by time."""
    n = (time.time_ns() // 1_000_000 & (1 << 48) - 1) << 80 | secrets.randbits(80)
    n = n & ~(0xF << 76) | 0x7 << 76
    return str(uuid.UUID(int=n & ~(0x3 << 62) | 0x2 << 62))


def ulid() -> str:
    n = time.time_ns() // 1_000_000 << 80 | secrets.randbits(80)
    return "".join(CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def nanoid(size: int = 21) -> str:
    return "".join(secrets.choice(NANO) for _ in range(size))


def cuid2(size: int = 24) -> str:
    """A letter, then base-36 digits of a hash of time and random bits."""
    n = int.from_bytes(hashlib.sha3_512(f"{time.time_ns()}{secrets.token_hex(32)}".encode()).digest())
    digits = ""
    while len(digits) < size - 1:
        n, r = divmod(n, 36)
        digits += BASE36[r]
    return secrets.choice(BASE36[10:]) + digits


def uuid4_column() -> Column:
    return F.uuid()


def uuid7_column() -> Column:
    """The time of the query, then the random digits of a random uuid."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(rest, 14, 3), F.lit("-"), F.substring(rest, 17, 4), F.lit("-"), F.substring(rest, 21, 12))
