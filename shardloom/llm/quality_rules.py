"""Quality rules: a table of thresholds compiled into one projection of text statistics.

No user functions: words, lines and ratios are built-in string and array expressions,
so the projection runs inside the scan's stage and moves no rows.
"""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, let

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to a in is it that for was with as be by on at are this from or an "
    "de la le et les des en un du une que est dans qui par pour au sur pas avec ne se "
    "der die das und zu den mit von ein eine nicht ist im auf sich dem es für auch "
    "el los y las del se con por para su al lo como más o"
).split()

#: Fixed values: (statistic, least, most) of a kept document; None: no bound. Statistics are those of `statistics`.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 50, None),
    ("mean_word_length", 2.0, 12.0),
    ("symbol_ratio", None, 0.05),
    ("caps_ratio", None, 0.50),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.50),
    ("mean_line_words", 1.5, None),
    ("repeat_ratio", None, 0.50),
)


def words_of(text: Column) -> Column:
    """Array of the runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    for white in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice in the text.

    Windows are sorted with their positions; equal neighbours are repeats. Texts
    without a repeated window skip the sort.
    """
    grams = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeats(sorted_: Column) -> Column:
        def twin(s, k):
            other = lambda step: F.coalesce(F.get(sorted_, k + step)["g"] == s["g"], F.lit(False))
            return F.when(k > 0, other(-1)).otherwise(F.lit(False)) | other(1)

        return let(F.sort_array(F.transform(F.filter(sorted_, twin), lambda s: s["i"])), covered)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, repeats))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams, count))


#: Counts of `statistics`, and those that each ratio of `ratios` is made of.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_stop_words")
MADE_OF = {
    "n_words": ("n_words",),
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "caps_ratio": ("n_caps", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "mean_line_words": ("n_words", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


def statistics(text: Column, stop_words: list[str] = STOP_WORDS, only: Collection[str] = COUNTS, words: Column | None = None) -> Column:
    """Struct of counts of one text (COUNTS); null and empty texts have all counts 0, as have counts that are not among only.

    words: words_of the text, where they are there already.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    if not {"n_lines", "n_dup_lines"} & set(only):
        lines = F.array().cast("array<string>")

    def of(words: Column) -> Column:
        counts = {
            "n_words": lambda: F.size(words),
            "word_chars": lambda: F.length(F.array_join(words, "")),
            "n_symbols": lambda: F.regexp_count(text, F.lit("[#*$%&|<>]")),
            "n_repeat_words": lambda: repeat_words(words),
            "n_caps": lambda: F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]{2,}")),
            "n_stop_words": lambda: F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words))),
        }
        own = {name: (make() if name in only else F.lit(0)).cast("long") for name, make in counts.items()}

        def with_lines(x: Column) -> Column:
            every = own | {"n_lines": F.size(x).cast("long"), "n_dup_lines": (F.size(x) - F.size(F.array_distinct(x))).cast("long")}
            return F.struct(*[every[name].alias(name) for name in COUNTS])

        return let(lines, with_lines)

    return let(words_of(text), of) if words is None else of(words)


def ratios(s: Column) -> dict[str, Column]:
    """The statistics that thresholds name, from the struct of `statistics`."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "word_chars"),
        "caps_ratio": per("n_caps", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "mean_line_words": per("n_words", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"),
    }


def verdict(s: Column, thresholds=THRESHOLDS) -> Column:
    """True where every threshold holds."""
    r = ratios(s)
    tests = [r[name] >= F.lit(float(least)) for name, least, _ in thresholds if least is not None]
    tests += [r[name] <= F.lit(float(most)) for name, _, most in thresholds if most is not None]
    return reduce(lambda a, b: a & b, tests)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def kept_column(text: Column, thresholds=THRESHOLDS) -> Column:
    """One boolean expression for filters; never null."""
    return let(statistics(text), lambda s: ~base_failed(s) & verdict(s, thresholds))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Statistics and verdict per row: id_col, the counts, base_failed, kept.

    Defined cases: null, empty and blank texts have no words and are not kept; a text of any
    length is read whole; a ratio at its threshold is kept; a null id is passed on; repeated
    rows give repeated results; an empty table gives an empty result; columns other than the
    two named are ignored.
    """
    row = F.struct(F.col(id_col).alias("id"), statistics(F.col(text_col)).alias("s"))
    out = let(
        row,
        lambda r: F.struct(
            r["id"].alias(id_col),
            *[r["s"][n].alias(n) for n in COUNTS],
            base_failed(r["s"]).alias("base_failed"),
            (~base_failed(r["s"]) & verdict(r["s"], thresholds)).alias("kept"),
        ),
    )
    return docs.select(F.inline(F.array(out)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


#: The ratios of `ratios` in SQL.
_RATIOS_SQL = {
    "n_words": "n_words",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "caps_ratio": "n_caps / greatest(n_words, 1)",
    "stop_word_ratio": "n_stop_words / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "mean_line_words": "n_words / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
}
_VERDICT_SQL = " AND ".join(f"{_RATIOS_SQL[name]} {sign} {bound}" for name, least, most in THRESHOLDS for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
_STOP_SQL = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]{{2,}}'))::BIGINT AS n_caps,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT *, NOT base_failed AND {_VERDICT_SQL} AS kept
FROM b
"""
