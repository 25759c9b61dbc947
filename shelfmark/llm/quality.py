"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Base counts are computed for every document with built-in functions. The
cascade then asks one rule after another and stops at the first that rejects.
Its order comes from a sample: every rule is run alone over several copies of
the same stored sample rows, its cost is the time above a bare scan of them,
its selectivity the share of rows it rejects, and rules with the most
rejections for their cost go first. Order decides only the work done: a document is kept when no rule
rejects it, whichever is asked first.

Defined cases: null text counts as an empty text (no words, base fails);
documents without words fail the base; repeated rows get equal results; an
empty table gives an empty result (rules stay in their given order); other
columns of the table are left behind.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark._util import with_once
from shelfmark.llm.common import pick, stored, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"

#: Rows of the planning sample (they only order the rules), times that each is asked, the least share of the bare scan
#: that counts as a cost, and the factor between two costs that are told apart.
SAMPLE_ROWS = 1000
COPIES = 5
FLOOR = 0.5
STEP = 4


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds the predicate from the measured columns (never null)."""

    name: str
    rejects: Callable[[], Column]


def _share_over(part: Column, whole: Column, pct: int) -> Column:
    return part * 100 > whole * pct


RULES = (
    Rule("symbols", lambda: _share_over(F.col("n_symbols"), F.col("n_words"), 10)),
    Rule("word_length", lambda: (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 12)),
    Rule("duplicate_lines", lambda: _share_over(F.col("n_dup_lines"), F.col("n_lines"), 40)),
    Rule("few_distinct", lambda: F.size(F.array_distinct("w")) * 100 < F.col("n_words") * 20),
    Rule("no_letters", lambda: F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))) * 100 < F.col("n_words") * 70),
    Rule("upper_case", lambda: _share_over(F.size(F.filter("w", lambda x: x.rlike(r"\p{Lu}{2}") & ~x.rlike(r"\p{Ll}"))), F.col("n_words"), 40)),
    Rule("long_words", lambda: _share_over(F.size(F.filter("w", lambda x: F.length(x) > 60)), F.col("n_words"), 10)),
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the words ``w`` and the base counts of every whole text."""
    df = pick(docs, doc_id=id_col, text=text_col)
    df = with_once(df, words(F.col("text")), "w")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))
    df = with_once(df, lines, "ln")
    df = with_once(df, F.transform("w", lambda x: F.xxhash64(x)), "h")
    n = F.size("w")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    df = with_once(df, F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, WINDOW))), "win")
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    # Only texts that have a repeated window at all sort their windows.
    order = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(
        F.transform("win", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).otherwise(none)
    df = with_once(df, order, "by_hash")
    twice = F.filter(F.transform("by_hash", lambda x, i: F.when(
        F.coalesce(x["h"] == F.get("by_hash", i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get("by_hash", i + 1)["h"], F.lit(False)), x["p"])), lambda p: p.isNotNull())
    df = with_once(df, F.array_sort(twice), "at")
    repeat = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
                         F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return df.select(
        "doc_id", "w", F.size("ln").cast("bigint").alias("n_lines"), F.size("w").cast("bigint").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("bigint").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)


def sampled(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measured columns of ``rows`` documents on average (all, if there are no more), the same ones in every call.

    They are drawn by a hash of id and text, and rows equal in both count once, so a repeated row can't fill the sample.
    """
    total = max(1, docs.count())
    df = pick(docs, doc_id=id_col, text=text_col)
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, rows / total) * (1 << 30))
    chosen = df.filter(drawn).dropDuplicates(["doc_id", "text"])
    return stored(measure(chosen), "quality-sample", rows)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
                rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected), most rejections for the cost first.

    ``rows`` is the size of the sample. A rule is asked COPIES times for every sample
    row in one job, twice over, and the lesser time above a bare scan of
    the copies is its cost, or FLOOR of that scan if it is less: what a rule
    costs beside the reading is not told apart below that. Costs count by
    powers of STEP, so that noise in the timing does not change the order;
    rules that gain the same stay in their given order.
    """
    sample = sampled(docs, rows, id_col, text_col)
    n = max(1, sample.count())
    copies = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(COPIES))).alias("copy"))

    def timed(hit: Column) -> tuple[float, int]:
        best, got = float("inf"), 0
        for _ in range(2):
            t = time.perf_counter()
            # The copy's number takes part, so that every copy is asked.
            got = copies.agg(F.count(F.when(hit & (F.col("copy") > 0), 1)).alias("n"), F.sum(F.size("w")).alias("read")).first()["n"]
            best = min(best, time.perf_counter() - t)
        return best, got

    timed(F.col("n_words") < 0)   # the first scan pays for what later ones find ready
    bare, _ = timed(F.col("n_words") < 0)
    found = []
    for rule in rules:
        took, got = timed(rule.rejects())
        found.append((rule, max(took - bare, FLOOR * bare) / (n * COPIES), got / (n * COPIES)))
    return sorted(found, key=lambda x: -x[2] / STEP ** round(math.log(x[1], STEP)))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated then."""
    out = None
    for rule in rules:
        hit = rule.rejects()
        out = F.when(hit, rule.name) if out is None else out.when(hit, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, kept and the rejecting rule of every document."""
    ordered = [rule for rule, _, _ in order_rules(docs, rules, id_col, text_col)]
    df = measure(docs, id_col, text_col).withColumn("base_failed", base_failed())
    df = with_once(df, F.when(F.col("base_failed"), "base").otherwise(cascade(ordered)), "rejected_by")
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     F.col("rejected_by").isNull().alias("kept"), "rejected_by")


#: DuckDB SQL for the contract's columns.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents),
win AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_rep
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (
  SELECT d.doc_id, d.w, len(d.w)::BIGINT AS n_words, len(d.ln)::BIGINT AS n_lines,
         coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(d.ln) - len(list_distinct(d.ln)))::BIGINT AS n_dup_lines,
         coalesce(c.n_rep, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov c USING (rid)),
b AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 10 * n_words
    OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 100 * n_dup_lines > 40 * n_lines
    OR 100 * len(list_distinct(w)) < 20 * n_words
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 70 * n_words
    OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}{2}') AND NOT regexp_matches(x, '\p{Ll}'))) > 40 * n_words
    OR 100 * len(list_filter(w, lambda x: length(x) > 60)) > 10 * n_words) AS kept
FROM b
"""
