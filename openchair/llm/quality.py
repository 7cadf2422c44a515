"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of characters other than space and U+0009 to U+000D. Defined cases: a null or blank text has no words, so it
fails the base rule and its ratios are 0; repeated rows are judged one by one; an empty table gives no rows; columns
other than the id and the text are ignored by `measure` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.llm.common import pick, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MARKS = "!?"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du en est et il la le les ne pas pour qui que sur un une "
    "an auf das dem den der die ein eine für ich ist im mit nicht sich sie und von zu "
    "al como con del el es las lo los no para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high."""

    metric: str
    low: float = float("-inf")
    high: float = float("inf")

    def passes(self) -> Column:
        value = F.col(self.metric)
        bounds = [value >= self.low] * (self.low != float("-inf")) + [value <= self.high] * (self.high != float("inf"))
        return reduce(Column.__and__, bounds, F.lit(True))


#: The production thresholds.
RULES = (
    Rule("mean_word_chars", low=1.5, high=25.0),
    Rule("symbols_per_word", high=0.25),
    Rule("marks_per_word", high=0.6),
    Rule("stop_word_share", low=0.01),
    Rule("dup_line_share", high=0.5),
)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _covered(positions: Column) -> Column:
    """Words covered by windows that start at the given ascending positions."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        positions,
        begin,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
    )["n"]


def _repeat_words(windows: Column) -> Column:
    """Words in windows found twice or more; windows: array<bigint> of digests by position."""

    def repeated(sorted_pairs: Column) -> Column:
        def twin(pair: Column, i: Column) -> Column:
            before = F.get(sorted_pairs, i - 1)["h"]
            after = F.get(sorted_pairs, i + 1)["h"]
            return F.coalesce(pair["h"] == before, F.lit(False)) | F.coalesce(pair["h"] == after, F.lit(False))

        return F.transform(F.filter(sorted_pairs, twin), lambda pair: pair["i"])

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    slow = _covered(F.array_sort(_bind(F.array_sort(pairs), repeated)))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(slow)


def _windows(digests: Column) -> Column:
    count = F.size(digests) - (WINDOW - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(digests, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _stop_count(words: Column) -> Column:
    known = sorted(set(STOP_WORDS))
    return F.size(F.filter(words, lambda w: F.lower(w).isin(known)))


def with_metrics(df: DataFrame, text: str) -> DataFrame:
    """df with one more column for each count and ratio of the text column."""
    body, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    ready = (
        df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", F.filter(F.split("_text", r"[ \x09-\x0D]+"), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: _without(line, SPACES) != ""))
        .withColumn("_digests", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("_windows", _windows(F.col("_digests")))
    )
    counts = ready.select(
        *df.columns,
        F.size(words).cast("bigint").alias("n_words"),
        F.length(_without(body, SPACES)).cast("bigint").alias("word_chars"),
        (F.length(body) - F.length(_without(body, SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).cast("bigint").alias("n_repeat_words"),
        (F.length(body) - F.length(_without(body, MARKS))).alias("_marks"),
        _stop_count(words).alias("_stops"),
        F.size(lines).alias("_n_lines"),
    )
    n = F.col("n_words")
    return counts.select(
        *df.columns,
        *COUNTS,
        _share(F.col("word_chars"), n).alias("mean_word_chars"),
        _share(F.col("n_symbols"), n).alias("symbols_per_word"),
        _share(F.col("_marks"), n).alias("marks_per_word"),
        _share(F.col("_stops"), n).alias("stop_word_share"),
        _share(F.col("n_dup_lines"), F.col("_n_lines")).alias("dup_line_share"),
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    return reduce(Column.__and__, (rule.passes() for rule in rules), ~base_failed())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, counts, ratios, base_failed and kept."""
    found = with_metrics(pick(docs, id_col, text_col), text_col)
    return found.drop(text_col).withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes, with their own columns."""
    columns = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(columns))))
    judged = with_metrics(plain, f"_c{columns.index(text_col)}")
    # A filter on a row number stays above the projections, so that each metric is computed once.
    marked = judged.select(*plain.columns, verdict(rules).alias("_kept"), F.monotonically_increasing_id().alias("_row"))
    judged = marked.where("_kept AND _row >= 0")
    return judged.select(*plain.columns).toDF(*columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept")


def _bounds_sql() -> str:
    tests = []
    for rule in RULES:
        tests += [f"{rule.metric} >= {rule.low!r}"] * (rule.low != float("-inf"))
        tests += [f"{rule.metric} <= {rule.high!r}"] * (rule.high != float("inf"))
    return " AND ".join(tests)


def _sql() -> str:
    spaces = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))
    grams = " || ' ' || ".join(f"lead(word, {i}) OVER p" for i in range(WINDOW))
    return f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10))
            IF length(regexp_replace(x, '{spaces}', '', 'g')) > 0] AS lines
  FROM documents
), places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w
), starts AS (
  SELECT doc_id, i, {grams} AS gram FROM places WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM starts WHERE gram IS NOT NULL
), hits AS (
  SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW}) AS gap FROM grams WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least({WINDOW}, gap))::BIGINT AS n_repeat_words FROM hits GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '{spaces}', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         (length(t) - length(regexp_replace(t, '[{MARKS}]', '', 'g')))::DOUBLE AS marks,
         len([x FOR x IN words IF lower(x) IN ({stops})])::DOUBLE AS stops,
         len(lines)::DOUBLE AS n_lines
  FROM w
), ratios AS (
  SELECT *, coalesce(r.n_repeat_words, 0)::BIGINT AS reps,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbols_per_word,
         CASE WHEN n_words > 0 THEN marks / n_words ELSE 0.0 END AS marks_per_word,
         CASE WHEN n_words > 0 THEN stops / n_words ELSE 0.0 END AS stop_word_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share
  FROM counts LEFT JOIN repeats r USING (doc_id)
), judged AS (
  SELECT *, (n_words < {MIN_WORDS} OR 100 * reps > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM ratios
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, reps AS n_repeat_words, base_failed,
       NOT base_failed AND {_bounds_sql()} AS kept
FROM judged
"""


SQL = _sql()
