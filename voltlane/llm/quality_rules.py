"""Operator 1: quality rules. A threshold table is compiled into one chain of Spark projections; no user functions.

Null text: no words, so the base rule fails and the document is rejected. Empty and blank texts likewise. Ties and
repeated rows do not matter, as every row is judged alone. An empty table gives an empty table. Extra columns are kept
by `with_quality` and never read; helper columns take names that clash with none of them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import col, fresh, register, table

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the four languages, as words of a lower-case text.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat "
    "le la les de et des en un une du dans que est pour qui par sur au plus pas ce il se ne "
    "el los las y que del se por con una su para es al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """A measure of the document must lie between `least` and `most`, both included; None: no bound."""

    measure: str
    least: float | None
    most: float | None


#: Production thresholds. Measures are the keys of `_measures`.
RULES = (
    Rule("mean_word_length", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.25),
    Rule("exclamations_per_word", None, 0.25),
    Rule("words_without_stop_word", None, 30.0),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _line_count(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda line: line.rlike(pattern))).cast("double")


def _measures(text: Column, lower: Column, lines: Column, n_words: Column, chars: Column, symbols: Column, dup: Column) -> dict[str, Column]:
    per_word = lambda c: c / F.greatest(n_words, F.lit(1))
    per_line = lambda c: c / F.greatest(F.size(lines), F.lit(1))
    return {
        "mean_word_length": per_word(chars),
        "symbols_per_word": per_word(symbols),
        "exclamations_per_word": per_word(_without(text, "!")),
        "words_without_stop_word": F.when(F.arrays_overlap(lower, F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])), 0).otherwise(n_words).cast("double"),
        "dup_line_ratio": per_line(dup),
        "bullet_line_ratio": per_line(_line_count(lines, "^[\\x20\\x09-\\x0D]*[-*•]")),
        "ellipsis_line_ratio": per_line(_line_count(lines, "(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$")),
    }


def compile_rules(rules: tuple[Rule, ...], measures: dict[str, Column]) -> Column:
    """One boolean expression: every rule of the table holds."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            verdict = verdict & (measures[rule.measure] >= rule.least)
        if rule.most is not None:
            verdict = verdict & (measures[rule.measure] <= rule.most)
    return verdict


def with_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`df` with the six result columns; also their names, which differ from the plain ones only where those are taken.

    Words that stand in a run of `WINDOW` words found twice or more are found inside the row: hashes of all runs are
    compared; only where two agree are (hash, position) pairs sorted and the union of the repeated runs measured.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    result = dict(zip(names, fresh(df.columns, *names), strict=True))
    words, lines, runs, pairs, repeated = fresh([*df.columns, *result.values()], "_words", "_lines", "_runs", "_pairs", "_repeated")
    here = [col(c) for c in df.columns]
    body = F.coalesce(col(text), F.lit(""))
    n, w = F.size(col(words)), col(words)
    step = df.select(
        *here,
        F.array_remove(F.split(body, BLANKS), "").alias(words),
        F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias(lines),
    )
    step = step.select(
        *here, words, lines,
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>")).alias(runs),
    )
    r = col(runs)
    step = step.select(
        *here, words, lines,
        F.when(
            F.size(F.array_distinct(r)) < F.size(r),
            F.sort_array(F.transform(r, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias(pairs),
    )
    p = col(pairs)
    step = step.select(
        *here, words, lines,
        F.sort_array(F.transform(
            F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])), lambda x: x["i"],
        )).alias(repeated),
    )
    q = col(repeated)
    covered = F.aggregate(
        F.transform(q, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(q, i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    base = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": _without(body, SYMBOLS),
        "n_dup_lines": F.size(col(lines)) - F.size(F.array_distinct(col(lines))),
        "n_repeat_words": covered,
    }
    lower = F.array_distinct(F.split(F.lower(F.array_join(w, " ")), " "))
    step = step.select(*here, words, lines, *[c.cast("bigint").alias(result[k]) for k, c in base.items()])
    own = {k: col(result[k]) for k in base}
    verdict = compile_rules(rules, _measures(body, lower, col(lines), own["n_words"], own["word_chars"], own["n_symbols"], own["n_dup_lines"]))
    failed = (own["n_words"] < 10) | (own["n_repeat_words"] * 100 > own["n_words"] * 20)
    # The one row of a generator: a filter on its columns stays above it. Pushed down, the filter would repeat the whole
    # chain of projections inside one expression, once for every use of every step.
    verdicts = F.struct(*[c.alias(result[k]) for k, c in own.items()], failed.alias(result["base_failed"]), F.when(failed, False).otherwise(verdict).alias(result["kept"]))
    return step.select(*here, F.inline(F.array(verdicts))), result


def keep_quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Rows of `df` that no rule rejects, with their own columns."""
    judged, names = with_quality(df, rules, text)
    return judged.where(col(names["kept"])).select(*[col(c) for c in df.columns])


def _sql() -> str:
    blank = "[\\x20\\x09-\\x0D]"
    stops = "[" + ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS)) + "]"
    return f"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blank}+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
runs AS (
  SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM a WHERE len(words) >= {WINDOW})),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) AS t(k) GROUP BY doc_id),
b AS (
  SELECT a.doc_id, body, words, lines, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS chars,
    (length(body) - length(regexp_replace(body, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN covered USING (doc_id)),
c AS (SELECT *, coalesce(chars, 0) AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE
    word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0
    AND n_symbols / n_words <= 0.25
    AND (length(body) - length(replace(body, '!', ''))) / n_words <= 0.25
    AND (n_words <= 30 OR list_has_any(list_transform(words, lambda x: lower(x)), {stops}))
    AND n_dup_lines / len(lines) <= 0.5
    AND len(list_filter(lines, lambda x: regexp_matches(x, '^{blank}*[-*•]'))) / len(lines) <= 0.9
    AND len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){blank}*$'))) / len(lines) <= 0.3
  END AS kept
FROM c"""


@register("op1_quality_rules", _sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs)[0].drop("text")
