"""Quality rules as a short-circuit cascade, in DataFrame operations only.

The base statistics are computed once for each document. Every further rule is a predicate over them or over the
text. On a bounded sample, drawn from all rows by a hash of the text, the cascade measures each rule's time and how many rows it rejects, and evaluates rules in
falling order of rejection per cost, so that later rules run only on rows that earlier ones let through. The order
never changes which documents are kept.

Null text has no words, lines or symbols. Empty tables give empty results. Repeated rows are judged each on its own.
Extra columns pass through `keep`; `measure` returns only doc_id and the statistics.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, first_by_hash, materialize

WINDOW = 5
#: The sample for costs: so many rows at most, those with the smallest hashes of their texts, of any length.
SAMPLE_ROWS = 500
#: Bits of a sort key that hold the position of a window; the others hold its hash.
POSITION_BITS = 30
PREFIX = "__rules_"


@dataclass(frozen=True)
class Rule:
    """A document is rejected where `rejects`, an SQL predicate over the statistics and __rules_text, is true."""

    name: str
    rejects: str


BASE = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
)
EXTRA = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", f"10 * n_dup_lines > 3 * {PREFIX}lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", f"2 * (length({PREFIX}text) - length(regexp_replace({PREFIX}text, '[A-ZÀ-ÖØ-Þ]', ''))) > word_chars"),
)


def _hash_of_window(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and helper columns under PREFIX.

    Repeated windows: windows are sorted by the leading bits of a hash with their position; those whose bits occur
    twice are sorted again by their words, which makes the result exact. A word counts once however many repeated
    windows hold it.
    """
    p = lambda n: F.col(PREFIX + n)
    low = F.lit((1 << POSITION_BITS) - 1)
    shape = docs.withColumn(PREFIX + "text", F.coalesce(F.col(text), F.lit("")))
    shape = shape.withColumns({
        PREFIX + "words": F.filter(F.split(p("text"), SPACE + "+"), lambda w: w != ""),
        PREFIX + "kept_lines": F.filter(F.split(p("text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    shape = shape.withColumns({
        "n_words": F.size(p("words")).cast("long"),
        "word_chars": F.length(F.translate(p("text"), " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(p("text")) - F.length(F.translate(p("text"), "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(p("kept_lines")) - F.size(F.array_distinct(p("kept_lines")))).cast("long"),
        PREFIX + "lines": F.size(p("kept_lines")).cast("long"),
        PREFIX + "hashes": F.transform(p("words"), lambda w: F.xxhash64(w)),
    }).drop(PREFIX + "kept_lines")
    starts = F.when(F.size(p("hashes")) >= WINDOW, F.sequence(F.lit(0), F.size(p("hashes")) - WINDOW)).otherwise(F.array().cast("array<int>"))
    shape = shape.withColumn(PREFIX + "keys", F.sort_array(F.transform(starts, lambda i: F.shiftleft(_hash_of_window(p("hashes"), i), POSITION_BITS).bitwiseOR(i.cast("long")))))
    head = lambda x: F.shiftright(x, POSITION_BITS)
    keys = p("keys")
    shape = shape.withColumn(PREFIX + "likely", F.filter(keys, lambda x, i: ((i > 0) & (head(x) == head(F.get(keys, i - 1)))) | ((i + 1 < F.size(keys)) & (head(x) == head(F.get(keys, i + 1))))))
    shape = shape.withColumn(PREFIX + "texts", F.array_sort(F.transform(p("likely"), lambda x: F.struct(
        F.concat_ws(" ", *(F.get(p("words"), x.bitwiseAND(low).cast("int") + k) for k in range(WINDOW))).alias("s"), x.bitwiseAND(low).alias("i")))))
    texts = p("texts")
    same = lambda x, i: ((i > 0) & (x["s"] == F.get(texts, i - 1)["s"])) | ((i + 1 < F.size(texts)) & (x["s"] == F.get(texts, i + 1)["s"]))
    shape = shape.withColumn(PREFIX + "at", F.sort_array(F.transform(F.filter(texts, same), lambda x: x["i"])))
    at = p("at")
    covered = F.transform(at, lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW).cast("long"))))
    shape = shape.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b))
    return shape.drop(*(PREFIX + n for n in ("words", "hashes", "keys", "likely", "texts", "at")))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(docs: DataFrame, text: str, rules: tuple[Rule, ...] = EXTRA, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejected rows per second, highest first, as a sample of at most sample_rows rows shows it."""
    if len(rules) < 2:
        return list(rules)
    sample = materialize(with_statistics(first_by_hash(docs.select(F.col(text).alias("text")), "text", sample_rows)))
    worth = []
    for rule in rules:
        count = sample.agg(F.count(F.when(F.expr(rule.rejects), 1)).alias("n"))
        count.collect()  # compiles the plan, so that the time below is the rule's own
        began = time.perf_counter()
        rejected = count.collect()[0]["n"]
        worth.append((-rejected / (time.perf_counter() - began), rule.name, rule))
    discard(sample)
    return [rule for _, _, rule in sorted(worth, key=lambda x: x[:2])]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, in the given order; null where none does."""
    out = F
    for rule in rules:
        out = out.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """docs with the statistics, base_failed, rejected_by (first rejecting rule of the cascade) and kept."""
    measured = with_statistics(docs, text)
    rules = [*base, *order_rules(docs, text, extra)]
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in base))
    return measured.withColumns({"base_failed": failed, "rejected_by": cascade(rules)}).withColumn("kept", F.col("rejected_by").isNull()).drop(PREFIX + "text", PREFIX + "lines")


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: the statistics and verdicts of judge()."""
    return judge(docs.select("doc_id", "text")).select("doc_id", *STATISTICS, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with docs' own columns; columns of the same names as the statistics are left alone."""
    own = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias(PREFIX + "row"), F.col(text).alias(PREFIX + "source"))
    # The row number keeps Catalyst from moving the filter below the statistics, which would compute them over again.
    judged = judge(held, PREFIX + "source").withColumn(PREFIX + "row_number", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col(PREFIX + "row_number") >= 0)).select(*(F.col(PREFIX + "row")[c].alias(c) for c in own))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), one AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words
), win AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
  FROM one WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win WHERE s IS NOT NULL) WHERE n >= 2
), covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS at FROM twice, unnest([0, 1, 2, 3, 4]) AS u(k)) GROUP BY doc_id
), stats AS (
  SELECT w.doc_id, t, len(ls) AS lines, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM words w LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM stats
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) > word_chars) AS kept
FROM judged
"""
