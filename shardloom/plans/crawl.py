"""An offline crawl over stored pages: frontier steps on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import acceptable_url, host, join_url, links, url_key
from ..operators.accumulators import MAX, SUM
from ..operators.joins import not_blocked
from ..operators.table import KeyedTable, TableSpec
from .driver import cut

#: Status codes, greater ones win.
STATUS = {"should_fetch": 0, "fetching": 1, "fetch_done": 2, "parse_done": 3, "done": 4, "robots_blacklist": 5, "fetch_error": 6, "parse_error": 7, "generic_error": 8, "fetched_bytes": 10}
FETCH = TableSpec(("key",), {"status": MAX})
DOMAINS = TableSpec(("host",), {"fetched": SUM, "bytes": SUM})
COUNTS = TableSpec(("status",), {"n": SUM})
CRAWLED = TableSpec(("host",), {"at": MAX})


def status_of(event: Column, codes: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, code in codes.items():
        out = F.when(event == name, F.lit(code)).otherwise(out)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link): acceptable absolute links of stored pages, once for each page."""
    found = pages.select("page_id", "url", F.explode(links(F.col("html"))).alias("target"))
    found = found.select("page_id", "url", join_url(F.col("url"), F.col("target")).alias("link")).distinct()
    return found.where(acceptable_url(F.col("link")))


def crawl(pages: DataFrame, seeds: DataFrame, rules: DataFrame, steps: int, gap: int | None = None, step_seconds: int = 60) -> tuple[KeyedTable, KeyedTable, KeyedTable, KeyedTable]:
    """(status by key, fetches and bytes by host, updates by status and bytes, last crawl by host) after so many frontier steps from seeds (url).

    Pages stand for the network: a URL that is not stored is a fetch error; a blocked one counts
    no bytes. A URL that is stored more than once is one fetch, which counts the bytes of its largest
    page and follows the links of all. A step takes place every step_seconds. With gap, it fetches one due URL of each host,
    the first by key, and only of hosts whose last crawl is gap seconds ago or more; the others
    stay due.
    """
    stored = pages.groupBy("url").agg(F.max(F.coalesce(F.octet_length("html"), F.lit(0))).cast("long").alias("size"))
    out = page_links(pages).select("url", "link").distinct()
    name = lambda u: url_key(host(u), u)
    state = KeyedTable.of(FETCH, seeds.select(name(F.col("url")).alias("key"), F.lit(STATUS["should_fetch"]).alias("status")))
    spark = pages.sparkSession
    counts = KeyedTable(DOMAINS, spark.createDataFrame([], "host string, fetched long, bytes long"))
    updates = KeyedTable(COUNTS, spark.createDataFrame([], "status int, n long"))
    times = KeyedTable(CRAWLED, spark.createDataFrame([], "host string, at long"))
    for k in range(steps):
        now = k * step_seconds
        due = state.df.where(F.col("status") == STATUS["should_fetch"]).select("key", F.expr("substr(key, instr(key, ' ') + 1)").alias("url"))
        if gap is not None:
            ready = times.lookup(due.withColumn("host", host(F.col("url")))).where(F.col("at").isNull() | (F.col("at") <= now - gap))
            due = ready.groupBy("host").agg(F.min("key").alias("key")).select("key", F.expr("substr(key, instr(key, ' ') + 1)").alias("url"))
        due = cut(due, "due")
        if due.isEmpty():
            if gap is None:
                break
            continue
        free = not_blocked(due, rules)
        got = free.join(stored, "url", "left")
        result = got.select("key", "url", "size", F.when(F.col("size").isNull(), STATUS["fetch_error"]).otherwise(STATUS["done"]).alias("status"))
        blocked = due.join(free.select("key"), "key", "left_anti").select("key", "url", F.lit(None).cast("long").alias("size"), F.lit(STATUS["robots_blacklist"]).alias("status"))
        seen = cut(result.unionByName(blocked), "seen")
        new = seen.where(F.col("status") == STATUS["done"]).join(out, "url").select(name(F.col("link")).alias("key"), F.lit(STATUS["should_fetch"]).alias("status"))
        state = state.update(seen.select("key", "status").unionByName(new.distinct()))
        state = KeyedTable(state.spec, cut(state.df, "state"))
        fetched = seen.where(F.col("status") != STATUS["robots_blacklist"]).select(host(F.col("url")).alias("host"), F.lit(now).cast("long").alias("at"))
        times = KeyedTable(CRAWLED, cut(times.update(fetched).df, "times"))
        delta = seen.select(host(F.col("url")).alias("host"), F.lit(1).cast("long").alias("fetched"), F.coalesce("size", F.lit(0)).alias("bytes"))
        counts = KeyedTable(DOMAINS, cut(counts.update(delta).df, "counts"))
        rows = F.explode(F.array(F.struct(F.col("status").alias("s"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(STATUS["fetched_bytes"]).alias("s"), F.coalesce("size", F.lit(0)).alias("n"))))
        delta = seen.select(rows.alias("r")).select(F.col("r.s").alias("status"), F.col("r.n").alias("n"))
        updates = KeyedTable(COUNTS, cut(updates.update(delta).df, "updates"))
    return state, counts, updates, times
