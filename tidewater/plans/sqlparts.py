"""Pieces of the SQL that stands beside the queries: hashes and coins written for an independent engine."""

from __future__ import annotations

M = "4294967295"
CODES = "list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i::INT, 1))::BIGINT)"


def _fold(s: str, start: str, step: str) -> str:
    codes = CODES.format(s=s)
    return f"list_reduce(list_prepend({start}::BIGINT, {codes}), lambda h, c: ({step}) & {M})"


def fnv1a_from(s: str, start: int) -> str:
    return _fold(s, str(start), "xor(h, c) * 16777619")


def fnv1a(s: str) -> str:
    return fnv1a_from(s, 2166136261)


def djb2(s: str) -> str:
    return _fold(s, "5381", "h * 33 + c")


def sdbm(s: str) -> str:
    return _fold(s, "0", "h * 65599 + c")


def times(x: str, factor: int) -> str:
    return f"((((({x}) * {factor >> 16}) & 65535) * 65536 + ({x}) * {factor & 65535}) & {M})"


def hash32_table(source: str, key: str) -> str:
    """A subquery: ``source`` with a column h, the finalised hash of ``key``."""
    return f"""(SELECT *, xor(c3, c3 >> 16) AS h FROM (SELECT *, {times("c2", 0xC2B2AE35)} AS c3 FROM (SELECT *, xor(b2, b2 >> 13) AS c2 FROM
(SELECT *, {times("a2", 0x85EBCA6B)} AS b2 FROM (SELECT *, xor(a1, a1 >> 16) AS a2 FROM (SELECT *, {fnv1a(key)} AS a1 FROM {source}))))))"""


def shard_of(s: str, shards: int) -> str:
    h = djb2(s)
    return f"(abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % {shards})"


def coin(salt: str, *keys: str) -> str:
    text = " || '|' || ".join([f"'{salt}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0)"


def slots(s: str, m: int, k: int) -> str:
    h1, h2 = fnv1a(s), f"xor({djb2(s)}, {sdbm(s)})"
    return f"list_transform(range(0, {k}), lambda i: (({h1}) + ((i * ({h2})) & {M}) & {M}) % {m})"
