"""Key-to-shard expressions, and placement of shards by size."""

from __future__ import annotations

import heapq

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import compatible_hash
from ..functions.text import domain_of_key


def by_mod(key: str | Column, shards: int) -> Column:
    """Never negative, also for negative keys."""
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(shards)).cast("int")


def by_hash(*keys: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int")


def by_string_hash(key: Column, shards: int) -> Column:
    """The placement of older string tables."""
    return (compatible_hash(key) % shards).cast("int")


def by_domain(key: Column, shards: int) -> Column:
    """Keys '<domain> <url>' of one domain in one shard."""
    return F.pmod(F.xxhash64(domain_of_key(key)), F.lit(shards)).cast("int")


def longest_first(sizes: dict[int, float], workers: int) -> dict[int, int]:
    """shard -> worker: the largest shards first, each to the worker with the least load."""
    load = [(0.0, w) for w in range(workers)]
    out = {}
    for shard in sorted(sizes, key=lambda s: (-sizes[s], s)):
        size, worker = heapq.heappop(load)
        out[shard] = worker
        heapq.heappush(load, (size + sizes[shard], worker))
    return out
