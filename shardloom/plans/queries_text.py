"""Word, URL, robots and crawl queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, ordering
from ..operators.accumulators import COUNT, MAX, SUM
from ..operators.table import KeyedTable, TableSpec
from ..sources.files import lines_of, spread
from . import crawl as C
from .registry import Queries, table

_q = Queries()
QUERIES, ORACLES = _q.functions, _q.sql

#: Public suffixes of the pages' hosts.
SUFFIXES = ["com", "org", "net"]


@_q.add(
    "wordcount",
    r"""SELECT word, count(*)::BIGINT AS n FROM (SELECT regexp_replace(regexp_replace(unnest(string_split(line, ' ')), '^[ \t\n\x0B\f\r]+', ''), '[ \t\n\x0B\f\r]+$', '') AS word
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1 HAVING count(*) > 50""",
)
def wordcount(spark, d):
    # raw tokens are counted first, so white space is stripped from the distinct ones only
    tokens = lines_of(spread(table(spark, d, "documents").select("text")), "text").select(F.explode(F.split("line", " ")).alias("token"))
    raw = KeyedTable.of(TableSpec(("token",), {"n": COUNT}), tokens.withColumn("n", F.lit(1)))
    words = raw.df.select(T.strip(F.col("token")).alias("word"), "n")
    return KeyedTable.of(TableSpec(("word",), {"n": SUM}), words).df.where("n > 50")


@_q.add("tokenize", "SELECT doc_id, coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, ' ')))), 0)::INT AS n FROM documents")
def tokenize(spark, d):
    counts = F.transform(F.split("text", "\n"), lambda line: F.size(F.split(line, " ")))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.aggregate(counts, F.lit(0), lambda a, x: a + x), F.lit(0)).alias("n"))


@_q.add(
    "split_chars",
    "SELECT doc_id, (len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END)::INT AS n FROM (SELECT doc_id, regexp_split_to_array(text, '[ ,.]') AS p FROM documents)",
)
def split_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.split_chars(F.col("text"), " ,.")).alias("n"))


@_q.add("string_format", "SELECT c_custkey, printf('%08d', c_custkey) || '/' || c_mktsegment AS v FROM customer")
def string_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.format_string("%08d/%s", "c_custkey", "c_mktsegment").alias("v"))


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]*)', 1))"


@_q.add("top_domains", f"SELECT host, count(*)::BIGINT AS n FROM (SELECT {_HOST} AS host FROM pages) GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def top_domains(spark, d):
    counts = KeyedTable.of(TableSpec(("host",), {"n": COUNT}), table(spark, d, "pages").select(T.host(F.col("url")).alias("host"), F.lit(1).alias("n")))
    return ordering.top(counts.df, 10, F.desc("n"), "host")


@_q.add("registered_domain", f"SELECT page_id, regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS domain FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def registered_domain(spark, d):
    return table(spark, d, "pages").select("page_id", T.registered_domain(T.host(F.col("url")), SUFFIXES).alias("domain"))


@_q.add("url_key", f"SELECT page_id, {_HOST} || ' ' || url AS k, url AS back, {_HOST} AS domain FROM pages")
def url_key(spark, d):
    key = T.url_key(T.host(F.col("url")), F.col("url"))
    return table(spark, d, "pages").select("page_id", key.alias("k"), T.url_of_key(key).alias("back"), T.domain_of_key(key).alias("domain"))


@_q.add(
    "site_page_ids",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^.{8}[^/]*/') AS h FROM pages),
c AS (SELECT *, CASE WHEN h IS DISTINCT FROM lag(h) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS n FROM p WINDOW w AS (ORDER BY url, page_id)),
s AS (SELECT *, sum(n) OVER (ORDER BY url, page_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS site FROM c)
SELECT page_id, site, row_number() OVER (PARTITION BY site ORDER BY url, page_id) - 1 AS page FROM s""",
)
def site_page_ids(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url")
    return ordering.runs_by_range(rows, T.host_prefix(F.col("url")), ["url", "page_id"], "site", "page").select("page_id", "site", "page")


@_q.add("link_extract", """SELECT page_id, count(DISTINCT l)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS l FROM pages) GROUP BY 1""")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("l")).groupBy("page_id").agg(F.count("l").alias("n"))


@_q.add("link_filter", "SELECT page_id, u FROM (SELECT page_id, regexp_replace(url, '#.*', '') AS u FROM pages) WHERE length(u) BETWEEN 6 AND 200 AND u NOT LIKE '% %' AND starts_with(u, 'http://') AND length(u) - length(replace(u, '&', '')) <= 2")
def link_filter(spark, d):
    return table(spark, d, "pages").select("page_id", T.without_fragment(F.col("url")).alias("u")).where(T.acceptable_url(F.col("u")))


@_q.add(
    "page_links",
    """WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(t, '#.*', '') AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t FROM pages) WHERE starts_with(t, '/') AND NOT starts_with(t, '//'))
SELECT page_id, link FROM l WHERE length(link) BETWEEN 6 AND 200 AND link NOT LIKE '% %' AND starts_with(link, 'http://') AND length(link) - length(replace(link, '&', '')) <= 2""",
)
def page_links(spark, d):
    return C.page_links(table(spark, d, "pages")).select("page_id", "link")


#: A stand-in robots file forbids what its host serves with a query: the paths of URLs that have one.
_RULE = "^https?://[^/]*(/[^?#]*)[?]"


def _robots(pages: DataFrame) -> DataFrame:
    """(host, robots): a robots file of each host, made from all its pages."""
    rules = pages.select(T.host(F.col("url")).alias("host"), F.regexp_extract("url", _RULE, 1).alias("rule"))
    return rules.where("rule <> ''").groupBy("host").agg(F.concat(F.lit("User-agent: *\n"), F.array_join(F.transform(F.array_sort(F.collect_set("rule")), lambda r: F.concat(F.lit("Disallow: "), r, F.lit("*\n"))), "")).alias("robots"))


_RULES = f"SELECT DISTINCT {_HOST} AS host, regexp_extract(url, '{_RULE}', 1) AS rule FROM pages"


@_q.add("robots_parse", f"SELECT * FROM ({_RULES}) WHERE rule <> ''")
def robots_parse(spark, d):
    return _robots(table(spark, d, "pages")).select("host", F.explode(T.robots_rules(F.col("robots"))).alias("rule"))


@_q.add("robots_filter", f"WITH r AS (SELECT * FROM ({_RULES}) WHERE rule <> '') SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.host = {_HOST.replace('url', 'p.url')} AND starts_with(regexp_extract(p.url, '^https?://[^/]*(/[^?#]*)', 1), r.rule))")
def robots_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    rules = _robots(pages).select("host", F.explode(T.robots_rules(F.col("robots"))).alias("rule"))
    return joins.not_blocked(pages, rules)


_STATUS = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 WHEN 'click' THEN 1 ELSE 0 END"
_CODES = {"error": 3, "purchase": 5, "click": 1}


@_q.add("crawl_status", f"SELECT user_id, max({_STATUS})::INT AS status FROM events GROUP BY 1")
def crawl_status(spark, d):
    rows = table(spark, d, "events").select("user_id", C.status_of(F.col("event_type"), _CODES).alias("status"))
    return KeyedTable.of(TableSpec(("user_id",), {"status": MAX}), rows).df


@_q.add("fetch_counts", f"SELECT status, count(*)::BIGINT AS n FROM (SELECT user_id, max({_STATUS})::INT AS status FROM events GROUP BY 1) GROUP BY 1")
def fetch_counts(spark, d):
    return KeyedTable.of(TableSpec(("status",), {"n": SUM}), crawl_status(spark, d).select("status", F.lit(1).cast("long").alias("n"))).df


_BLOCKED = f"EXISTS (SELECT 1 FROM rules r WHERE r.host = {_HOST} AND starts_with(regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1), r.rule))"
_CRAWL = f"""WITH rules AS (SELECT * FROM ({_RULES}) WHERE rule <> ''),
u AS (SELECT DISTINCT url FROM pages),
one AS (SELECT url, CASE WHEN {_BLOCKED} THEN 5 ELSE 4 END AS status FROM u)"""
_LINKS = """l AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(t, '#.*', '') AS url FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS t FROM pages WHERE url IN (SELECT url FROM one WHERE status = 4)) WHERE starts_with(t, '/') AND NOT starts_with(t, '//')),
new AS (SELECT url FROM l WHERE length(url) BETWEEN 6 AND 200 AND url NOT LIKE '% %' AND starts_with(url, 'http://') AND length(url) - length(replace(url, '&', '')) <= 2 AND url NOT IN (SELECT url FROM u))"""


def _rules(pages: DataFrame) -> DataFrame:
    return _robots(pages).select("host", F.explode(T.robots_rules(F.col("robots"))).alias("rule"))


@_q.add("crawl_first_step", _CRAWL + " SELECT status::INT AS status, count(*)::BIGINT AS n FROM one GROUP BY 1")
def crawl_first_step(spark, d):
    pages = table(spark, d, "pages")
    _, _, updates, _ = C.crawl(pages, pages.select("url").distinct(), _rules(pages), 1)
    return updates.df.where("status < 10")


@_q.add("crawl", f"{_CRAWL}, {_LINKS} SELECT status::INT AS status, count(*)::BIGINT AS n FROM (SELECT status FROM one UNION ALL SELECT CASE WHEN {_BLOCKED} THEN 5 ELSE 6 END FROM new) GROUP BY 1")
def crawl(spark, d):
    """Two steps: all stored pages, then what they link to."""
    pages = table(spark, d, "pages")
    state, _, _, _ = C.crawl(pages, pages.select("url").distinct(), _rules(pages), 2)
    return state.df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_q.add("crawl_polite", f"{_CRAWL} SELECT host, 0::BIGINT AS at FROM (SELECT {_HOST} AS host, arg_min(status, url) AS status FROM one GROUP BY 1) WHERE status = 4")
def crawl_polite(spark, d):
    """Last crawl by host after a step that fetches one page of each, and one too soon after it: only hosts that were not fetched go on."""
    pages = table(spark, d, "pages")
    _, _, _, times = C.crawl(pages, pages.select("url").distinct(), _rules(pages), 2, gap=60, step_seconds=30)
    return times.df.where("at = 0")
