"""Identity rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of edge ids.
EDGE_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"


def short_sha(*parts: Column | str) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 32)


def node_id(repo: Column, rel_path: Column, kind: Column, qualified_name: Column, occurrence: Column | None = None) -> Column:
    """A node's id; repeats of a name in a file carry their ordinal from 1 on."""
    first = short_sha(repo, rel_path, kind, qualified_name)
    if occurrence is None:
        return first
    return F.when(occurrence < 1, first).otherwise(F.substring(F.sha2(F.concat(F.lit("occurrence:"), occurrence.cast("string"), F.lit(":"), F.concat_ws(":", repo, rel_path, kind, qualified_name)), 256), 1, 32))


def file_id(repo: Column, rel_path: Column) -> Column:
    return short_sha("file", repo, rel_path)


def commit_id(sha: Column) -> Column:
    return short_sha("commit", sha)


def contributor_id(email: Column) -> Column:
    return short_sha("contributor", F.lower(email))


def store_id(root: Column) -> Column:
    return F.sha2(root, 256)


def uuid5(name: Column, namespace: str = EDGE_NAMESPACE) -> Column:
    """A version 5 UUID: SHA-1 of the namespace's bytes and the name, with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def edge_id(source: Column, target: Column, relationship: Column) -> Column:
    """One id for each (source, target, relationship)."""
    return uuid5(F.concat_ws(":", source, target, relationship))


def keyed_hash(key: bytes, value: Column) -> Column:
    """The first 16 digits of HMAC-SHA-256 by the definition of HMAC; empty for an absent value."""
    block = key.ljust(64, b"\0") if len(key) <= 64 else __import__("hashlib").sha256(key).digest().ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in block).hex())) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)
    return F.when(value.isNull() | (value == ""), F.lit("")).otherwise(F.substring(digest, 1, 16))
