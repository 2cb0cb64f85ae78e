"""Keys and hashes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def link_key(source_type: Column, source: Column, target_type: Column, target: Column, relation: Column) -> Column:
    return F.concat(source_type, F.lit(":"), source, F.lit("->"), target_type, F.lit(":"), target, F.lit(":"), relation)


def cache_key(model: str, text: Column) -> Column:
    return F.concat(F.lit(f"{model}:"), F.substring(F.sha2(text, 256), 1, 16))


def node_key(node_type: Column, node: Column) -> Column:
    return F.concat(node_type, F.lit("_"), node.cast("string"))


def chunk_key(doc_type: Column, doc: Column, index: Column, text: Column) -> Column:
    """The same chunk has the same id in every run."""
    return F.sha2(F.concat_ws("\x1f", doc_type, doc, index.cast("string"), text), 256)


def uuid5(name: Column) -> Column:
    """Name-based UUID, version 5, in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "utf-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    variant = F.lower(F.conv(digit.cast("string"), 10, 16))
    parts = (
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
    return F.concat_ws("-", *parts)


def repo_slug(text: Column) -> Column:
    """owner/name of an address or slug."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"/+\z", ""), r"\.git\z", "")
    path = F.regexp_replace(bare, r"\A.*github\.com[/:]", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
