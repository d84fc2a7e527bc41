"""Quality rules that look at lines first: failing lines go, then documents that lost too much text.

Everything is a DataFrame expression. A line with a word fails by any of these rules:

- punctuation: it does not end in a closing mark and has fewer than eight words;
- symbols: more than one in twenty of its word characters is one of # * $ % & | < >;
- navigation: it holds three or more separators of menus and bread crumbs;
- boilerplate: it has at most twenty words and one of the stock phrases of web pages.

A document is rejected when the lines that stay hold less than half of its word characters, or when it fails the
base rules: fewer than 50 words, or more than half of its words in repeated three-word windows.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. Defined cases: a null or blank text has no words
and fails; repeated rows are judged alike; a null doc_id is kept; extra columns are ignored by `judged` and kept by
`cleaned`. Windows of three words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
#: The characters that separate words, symbols, closing marks, separators of menus, stock phrases.
BLANK = r"[\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
CLOSED = r"[.!?:;…\"'”’»)\]]" + BLANK + "*$"
NOT_SEPARATOR = r"[^|>»›•·→]+"
PHRASES = (
    "all rights reserved|accept cookies|use cookies|cookie policy|privacy policy|terms of use|terms of service|"
    "enable javascript|lorem ipsum|sign in|log in|subscribe to|click here|read more|share this|share on|"
    "licensed under|released under|back to top|skip to content")
STOCK = f"(?i)({PHRASES})"
SHORT_LINE, STOCK_LINE, SEPARATORS, SYMBOL_PART, LEAST_KEPT = 8, 20, 3, 20, 50


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK + "+", ""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+", -1), "")


def fails(line: Column) -> Column:
    """Whether a line with a word fails a rule."""
    n_words = F.size(words(line))
    symbols = F.length(F.regexp_replace(line, NOT_SYMBOL, ""))
    separators = F.length(F.regexp_replace(line, NOT_SEPARATOR, ""))
    return ((symbols * SYMBOL_PART > word_chars(line)) | (separators >= SEPARATORS)
            | (~line.rlike(CLOSED) & (n_words < SHORT_LINE)) | (line.rlike(STOCK) & (n_words <= STOCK_LINE)))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _free(name: str, table: DataFrame) -> str:
    while name in table.columns:
        name += "_"
    return name


def _with_measures(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with helper columns, and their names: each step is a projection of its own, so nothing is computed twice."""
    names = {k: _free(f"_{k}", docs) for k in ("text", "words", "lines", "windows", "order", "at", "held", "repeated")}
    c = {k: F.col(v) for k, v in names.items()}
    out = docs.withColumn(names["text"], F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    out = out.withColumns({
        names["words"]: words(c["text"]),
        names["lines"]: F.filter(F.split(c["text"], "\n", -1), _has_word)})
    n = F.size(c["words"])
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(c["words"], i), F.get(c["words"], i + 1), F.get(c["words"], i + 2)))
    out = out.withColumn(names["windows"], F.when(n >= 3, window))
    # windows in the order of their hashes; equal ones are then neighbours
    some = F.size(F.array_distinct(c["windows"])) < F.size(c["windows"])
    out = out.withColumn(names["order"], F.when(some, F.array_sort(
        F.transform(c["windows"], lambda x, i: F.struct(x.alias("hash"), i.alias("at"))))))
    beside = lambda x, i: F.get(c["order"], i)["hash"] == x["hash"]
    same = F.filter(c["order"], lambda x, j: F.coalesce(
        (j > 0) & beside(x, j - 1), F.lit(False)) | F.coalesce(beside(x, j + 1), F.lit(False)))
    out = out.withColumn(names["at"], F.array_sort(F.transform(same, lambda x: x["at"])))
    # a window covers three words, or as many as lie before the next such window
    covered = F.transform(c["at"], lambda p, j: F.least(F.lit(3), F.coalesce(F.get(c["at"], j + 1) - p, F.lit(3))))
    return out.withColumns({
        names["repeated"]: F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        names["held"]: F.filter(c["lines"], lambda x: ~fails(x))}), names


def _verdict(table: DataFrame, names: dict[str, str], min_words: int) -> dict[str, Column]:
    text, held, lines = (F.col(names[k]) for k in ("text", "held", "lines"))
    n = F.size(names["words"]).cast("long")
    chars = word_chars(text).cast("long")
    left = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + word_chars(x))
    repeated = F.col(names["repeated"])
    base_failed = (n < min_words) | (100 * repeated > 50 * n)
    return {
        "n_words": n, "word_chars": chars,
        "n_symbols": F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated, "base_failed": base_failed,
        "kept": ~base_failed & (100 * left >= LEAST_KEPT * chars),
        "n_lines": F.size(lines).cast("long"), "n_failed_lines": (F.size(lines) - F.size(held)).cast("long"),
        "kept_chars": left}


def judged(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """One row a document: doc_id, its measures, base_failed, kept, n_lines, n_failed_lines and kept_chars."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table, names = _with_measures(plain, "text")
    return table.select("doc_id", *[v.alias(k) for k, v in _verdict(table, names, min_words).items()])


def cleaned(docs: DataFrame, text_col="text", min_words=MIN_WORDS) -> DataFrame:
    """The documents that are kept, without their failing lines; lines without a word stay."""
    table, names = _with_measures(docs, text_col)
    lines = F.filter(F.split(names["text"], "\n", -1), lambda x: ~_has_word(x) | ~fails(x))
    own = F.struct(*[F.array_join(lines, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns])
    # a generator instead of a filter: a filter would be pushed below the helper columns and compute them in its place
    return table.select(F.inline(F.when(_verdict(table, names, min_words)["kept"], F.array(own))))


#: `judged` over the table documents, in DuckDB's SQL.
SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT r, doc_id, text,
    list_filter(string_split_regex(text, '{BLANK}+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT r, i AS pos, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM parts)),
often AS (SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS p FROM often) GROUP BY r),
held AS (
  SELECT r, list_filter(lines, lambda x: NOT (
    length(regexp_replace(x, '{NOT_SYMBOL}', '', 'g')) * {SYMBOL_PART} > length(regexp_replace(x, '{BLANK}+', '', 'g'))
    OR length(regexp_replace(x, '{NOT_SEPARATOR}', '', 'g')) >= {SEPARATORS}
    OR (NOT regexp_matches(x, '{CLOSED.replace("'", "''")}')
        AND len(list_filter(string_split_regex(x, '{BLANK}+'), lambda y: y <> '')) < {SHORT_LINE})
    OR (regexp_matches(x, '{STOCK}')
        AND len(list_filter(string_split_regex(x, '{BLANK}+'), lambda y: y <> '')) <= {STOCK_LINE}))) AS held
  FROM parts),
measures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK}+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '{NOT_SYMBOL}', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(held))::BIGINT AS n_failed_lines,
    coalesce(list_sum(list_transform(held, lambda x: length(regexp_replace(x, '{BLANK}+', '', 'g')))), 0)::BIGINT
      AS kept_chars
  FROM parts JOIN held USING (r) LEFT JOIN repeated USING (r)),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures)
SELECT *, NOT base_failed AND 100 * kept_chars >= {LEAST_KEPT} * word_chars AS kept FROM base
"""
