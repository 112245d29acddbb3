"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text, so the operator is one scan without a shuffle and
without Python. The table is data: a rule names a measure and the closed range in which a text passes.

Defined cases: a null or blank text has no words and all counts 0, and fails the base rule (fewer than 50 words); null
ids are kept; a very long text is measured and judged whole, by the same rules; repeated
rows are judged alike; an empty table gives an empty result; other columns of the input, whatever their names, are not
read; ratios over nothing are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP_CHARS, let, table, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des auf für ist im nicht dem ein eine als "
    "de la le et les en un du une que pour est par qui dans avec sur pas au "
    "el y los se del las con por no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("few_symbols", "symbol_ratio", high=0.1),
    Rule("few_shouts", "shout_ratio", high=0.5),
    Rule("stop_words", "stop_ratio", low=0.03),
    Rule("own_lines", "dup_line_ratio", high=0.5),
)
#: For corpora in which a text of so many words is a dump; not among the rules, as size alone says nothing against a text.
NOT_ENDLESS = Rule("not_endless", "n_words", high=1_000_000)


#: The half of a hash that is kept beside a window's place in one long.
HASH_HALF = -(1 << 32)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three found twice or more.

    Half of each window's hash and its place make one long, and longs sort fast; windows that share the half with no other
    occur once and go. The rest, few in most texts, are sorted by their whole hash and then their words, so equality is
    exact; equal neighbours give the places of repeated windows, and each place in order adds the words that the one before
    did not cover.
    """
    hashed = lambda w, i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    beside = lambda s, x, k, same: F.coalesce(same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1), x), F.lit(False))
    keys = lambda w: F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: hashed(w, i).bitwiseAND(F.lit(HASH_HALF)).bitwiseOR(i.cast("long"))))
    alike = lambda s: F.filter(s, lambda x, k: beside(s, x, k, lambda p, q: F.shiftright(p, 32) == F.shiftright(q, 32)))
    windows = lambda w, s: F.sort_array(
        F.transform(
            F.transform(s, lambda x: x.bitwiseAND(F.lit(~HASH_HALF)).cast("int")),
            lambda i: F.struct(hashed(w, i).alias("h"), F.struct(F.get(w, i - 1).alias("a"), F.get(w, i).alias("b"), F.get(w, i + 1).alias("c")).alias("g"), i.alias("i")),
        )
    )
    places = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, k: beside(s, x, k, lambda p, q: (p["h"] == q["h"]) & (p["g"] == q["g"]))), lambda x: x["i"]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda at, k: F.least(F.lit(3), F.coalesce(at - F.get(p, k - 1), F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return F.when(F.size(words) >= 4, let(let(let(keys(words), alike), lambda s: let(windows(words, s), places)), covered)).otherwise(F.lit(0).cast("long"))


def _without(text: Column, chars: str) -> Column:
    """text without these characters. Each is looked for in the bytes; translate would look up every character in a map."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(text: Column) -> list[Column]:
    """All measures of a text. What needs no words or lines stays outside of lambdas, so that Spark compiles it."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(GAP_CHARS))) > 0)
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [
        of_words.alias("_words"),
        of_lines.alias("_lines"),
        F.length(_without(text, GAP_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(text, "!"))).cast("long").alias("n_shouts"),
        F.size(F.filter(F.split(F.lower(text), r"[\s.,!?;:]+", -1), lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    ]


def _over(a: str, b: str) -> Column:
    return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


def compile_rules(rules: tuple[Rule, ...]) -> list[Column]:
    """One boolean column for each rule: true where it passes."""
    out = []
    for r in rules:
        checks = [F.col(r.measure) >= F.lit(r.low)] * (r.low is not None) + [F.col(r.measure) <= F.lit(r.high)] * (r.high is not None)
        ok = F.lit(True)
        for c in checks:
            ok = ok & c
        out.append(ok.alias(r.name))
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the measures, base_failed, failed_rules and kept."""
    counted = docs.select(F.col(id_col), *measures(text_or_empty(text_col))).select(id_col, "_words.*", "_lines.*", "word_chars", "n_symbols", "n_shouts", "n_stop_words")
    ratios = counted.select(
        "*",
        _over("word_chars", "n_words").alias("mean_word_chars"),
        _over("n_symbols", "n_words").alias("symbol_ratio"),
        _over("n_shouts", "n_words").alias("shout_ratio"),
        _over("n_stop_words", "n_words").alias("stop_ratio"),
        _over("n_dup_lines", "n_lines").alias("dup_line_ratio"),
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = ratios.select("*", base.alias("base_failed"), F.filter(F.array(*[F.when(~ok, F.lit(r.name)) for r, ok in zip(rules, compile_rules(rules), strict=True)]), lambda x: x.isNotNull()).alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(*RESULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go. The verdict is a column of the row itself, so nothing is joined.

    Null and blank texts go, null ids pass; rows that repeat each other are judged alike; columns of any name pass through;
    an empty table stays empty."""
    judged = quality(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_or_empty("text").alias("_t")), id_col="_row", text_col="_t")
    # A filter isn't pushed below a column that isn't deterministic; pushed down, it would count each measure anew for
    # every rule that names it.
    return judged.withColumn("_n", F.monotonically_increasing_id()).filter("kept and _n >= 0").select("_row.*")


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), toks AS (
  SELECT rid, w, i FROM (
    SELECT rid, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
           generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM base)
), grams AS (
  SELECT rid, i, w AS a, lead(w, 1) OVER (PARTITION BY rid ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY rid ORDER BY i) AS c FROM toks
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, c, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE c IS NOT NULL AND n >= 2
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, i AS p FROM twice UNION ALL SELECT rid, i + 1 FROM twice UNION ALL SELECT rid, i + 2 FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT b.rid, doc_id,
         CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts,
         CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(regexp_split_to_array(lower(t), '[\s\x0B.,!?;:]+'), lambda x: x IN ({_STOP_LIST}))) AS BIGINT) AS n_stop
  FROM base b LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)
), v AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 12.0 * n_words
        AND n_symbols <= 0.1 * n_words AND n_shouts <= 0.5 * n_words AND n_stop >= 0.03 * n_words
        AND n_dup_lines <= 0.5 * n_lines) AS kept
FROM v
"""
