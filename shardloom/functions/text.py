"""Text and URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that C's isspace trims, as a regular-expression class.
SPACE = "[ \\t\\n\\x0B\\f\\r]"


def strip(s: Column) -> Column:
    """Without white space of either end (also tabs, line ends, vertical tabs and form feeds)."""
    return F.regexp_replace(F.regexp_replace(s, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def split_chars(s: Column, chars: str) -> Column:
    """Split at any of chars; empty tokens stay, but for one empty token at the end."""
    quoted = "".join("\\" + c for c in chars)
    parts = F.split(s, f"[{quoted}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def host(url: Column) -> Column:
    """Host name of an http or https URL, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^https?://([^/:?#]*)", 1))


def host_prefix(url: Column) -> Column:
    """The part up to and including the first slash after the scheme; empty if there is none."""
    return F.regexp_extract(url, "^.{8}[^/]*/", 0)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/]*(/[^?#]*)", 1)


def registered_domain(host_name: Column, suffixes: list[str]) -> Column:
    """The longest public suffix of the host and the label before it; the host itself if no suffix fits.

    suffixes may begin with '*.', which stands for any one label.
    """
    out = host_name
    for suffix in sorted(set(suffixes), key=lambda s: (s.count("."), s)):
        tail = suffix[2:].replace(".", "\\.") if suffix.startswith("*.") else suffix.replace(".", "\\.")
        tail = f"[^.]+\\.{tail}" if suffix.startswith("*.") else tail
        found = F.regexp_extract(host_name, f"(?:^|\\.)([^.]+\\.{tail})$", 1)
        out = F.when(found != "", found).otherwise(out)
    return out


def url_key(domain: Column, url: Column) -> Column:
    return F.concat_ws(" ", domain, url)


def url_of_key(key: Column) -> Column:
    return F.substr(key, F.instr(key, " ") + 1)


def domain_of_key(key: Column) -> Column:
    return F.substring_index(key, " ", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def acceptable_url(url: Column) -> Column:
    """Crawl filter on a URL without fragment: length, no space, http, at most two ampersands."""
    return F.length(url).between(6, 200) & ~F.contains(url, F.lit(" ")) & F.startswith(url, F.lit("http://")) & (F.length(url) - F.length(F.replace(url, F.lit("&"), F.lit(""))) <= 2)


def links(html: Column) -> Column:
    """Distinct targets of anchors and of base tags, in order of appearance."""
    anchors = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
    bases = F.regexp_extract_all(html, F.lit('<base href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.concat(bases, anchors))


def join_url(page: Column, target: Column) -> Column:
    """Absolute URL of a link on a page: absolute, scheme-relative, host-relative, query and path-relative targets."""
    site = F.regexp_extract(page, "^[a-z]+://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_replace(page, "[?#].*$", ""), "^([a-z]+://[^/]*/(?:.*/)?)", 1)
    folder = F.when(folder == "", F.concat(site, F.lit("/"))).otherwise(folder)
    clean = without_fragment(target)
    return (
        F.when(clean == "", without_fragment(page))
        .when(clean.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), clean)
        .when(F.startswith(clean, F.lit("//")), F.concat(F.regexp_extract(page, "^[a-z]+:", 0), clean))
        .when(F.startswith(clean, F.lit("/")), F.concat(site, clean))
        .when(F.startswith(clean, F.lit("?")), F.concat(F.regexp_replace(page, "[?#].*$", ""), clean))
        .otherwise(F.concat(folder, clean))
    )


def robots_rules(robots: Column) -> Column:
    """Distinct disallowed path beginnings of a robots file; one star at the end is dropped."""
    raw = F.regexp_extract_all(robots, F.lit("Disallow:([^\\n\\r]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda r: F.regexp_replace(strip(r), "\\*$", "")), lambda r: r != ""))
