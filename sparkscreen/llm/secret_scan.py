"""Secret scans over a trigram inverted index.

From each rule's pattern follow the trigrams that any match must contain, as a Boolean query (an OR of ANDs): literal
runs of the pattern, with small classes and alternatives spelled out. The index has a posting (trigram, text) for the
trigrams that queries ask for. Postings of a text are intersected as bit sets; only texts that satisfy a rule's query
are matched against its pattern. A rule without mandatory trigrams is matched against every text.

Texts are keyed by a hash of id and text. A collision would only let a pattern look at one text more, as the pattern
decides. All work on rows is done by built-in functions; Python only reads the rules' patterns.

Places are in code points, end exclusive, leftmost and non-overlapping within a rule; a match is dropped if the group
that a rule names is shorter than it asks. Defined cases: a null text is empty and has no spans; null ids are kept; a text
of any length and with any number of matches is matched whole; repeated rows give repeated results; an empty table gives an empty result; other columns
of the input aren't read by the query and are kept by the pipeline stage, whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table, text_or_empty

STRETCH, PIECE = 128, 1024
MOST_WAYS = 64  # alternatives that a pattern is spelled out into, at most; beyond, that part asks for nothing


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The base rules as they are given. A maximal run of hex digits or of key characters that is too short holds no other
#: match, so the length can stand in the pattern there; for assignments it can't, and the group is measured.
BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: A private key to its END line or, without one, to the end of its base64 lines.
_KEY_LINE, _KEY_BODY = r"PRIVATE KEY-----", r"(?:\s+[A-Z][A-Za-z-]{1,30}: [^\r\n]{1,200}){0,20}[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,30}"
_KEY_LINES = r"(?:\s+[A-Za-z0-9+/=]{40,}){1,1000}(?:\s+[A-Za-z0-9+/]+=*(?=\s*(?:[\r\n]|$)))?"
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,30}}{_KEY_LINE}(?:{_KEY_BODY}{_KEY_LINE}|{_KEY_LINES})?"),
    Rule("login_url", r"[a-z]{3,10}://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]+@"),
)
RULES = BASE + MORE


def _ways(parsed) -> list[list[str | None]]:
    """The pattern as alternatives of runs: lower-cased characters, and None for what may be anything."""
    from re import _constants as c

    out: list[list[str | None]] = [[]]
    for op, arg in parsed:
        if op is c.LITERAL:
            part = [[chr(arg).lower()]]
        elif op is c.IN:
            chars = {chr(x).lower() for k, x in arg if k is c.LITERAL} if all(k is c.LITERAL for k, _ in arg) else set()
            part = [[x] for x in sorted(chars)] if 0 < len(chars) <= 8 else [[None]]
        elif op is c.SUBPATTERN:
            part = _ways(arg[3])
        elif op is c.BRANCH:
            part = [w for x in arg[1] for w in _ways(x)]
        elif op is c.MAX_REPEAT:
            low, high, inner = arg
            one = _ways(inner)
            part = [[]] + one if (low, high) == (0, 1) else [w + [None] for w in one] if low == 1 else [[None]] if low == 0 else [list(itertools.chain(*[w] * min(low, 3))) + [None] for w in one] if len(one) == 1 else [[None]]
        else:
            part = [[None]]
        if len(out) * len(part) > MOST_WAYS:
            part = [[None]]
        out = [a + b for a in out for b in part]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams, or None if some way to match has no mandatory trigram."""
    from re import _parser

    query = set()
    for way in _ways(_parser.parse(pattern)):
        runs = "".join(x if x is not None else "\0" for x in way).split("\0")
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return None
        query.add(grams)
    return [q for q in query if not any(p < q for p in query)]


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """keyed: key, text. The inverted index for these trigrams: gram (its number), key."""
    lower = F.lower(F.col("text"))
    return keyed.select("key", F.explode(let(lower, lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull()))).alias("gram")).select("gram", "key")


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """key, rules: the rules whose query a text's trigrams satisfy. Postings become bit sets of 62 trigrams a long."""
    number, width = {g: i for i, g in enumerate(grams)}, 62
    n_sets = -(-len(grams) // width)
    bit = F.expr(f"shiftleft(1L, cast(pmod(gram, {width}) AS int))")
    sets = index.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("gram") / width) == s, bit)), F.lit(0).cast("long")).alias(f"s{s}") for s in range(n_sets)])

    def satisfied(query: list[frozenset[str]]) -> Column:
        any_way = F.lit(False)
        for grams_of_way in query:
            way = F.lit(True)
            for s in range(n_sets):
                if mask := sum(1 << (number[g] % width) for g in grams_of_way if number[g] // width == s):
                    way = way & (F.col(f"s{s}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
            any_way = any_way | way
        return any_way

    hit = F.filter(F.array(*[F.when(satisfied(q), F.lit(k)) for k, q in queries.items()]), lambda x: x.isNotNull())
    return sets.select("key", hit.alias("rules")).filter(F.size("rules") > 0)


_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array what join makes of 0 and all before it: sums or maxima. Values go through in
    stretches of STRETCH, whose ends are then carried on, so work stays in proportion to the array's length."""

    def run(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRETCH).cast("int")), lambda i: run(F.slice(values, i * STRETCH + 1, F.lit(STRETCH))))
    carried = lambda c: F.flatten(F.zip_with(c, run(F.transform(c, lambda x: x["at"]))["out"], lambda x, at: F.transform(x["out"], lambda y: join(at, y))))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(stretches, carried))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Places of a rule's matches: what lies between matches and the matches take turns."""
    pattern = F.lit(rule.pattern)
    parts = lambda t: F.transform(
        F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(t, pattern, F.lit(rule.group)).alias("k"), F.split(t, rule.pattern, -1).alias("gap")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["k"]).alias("k")),
    )

    def placed(found: Column) -> Column:
        at = _before(F.transform(found, lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))), lambda a, b: a + b)
        spans = F.zip_with(found, at, lambda x, y: F.when(x["k"] >= rule.least, F.struct((y + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (y + x["gap"] + x["n"]).alias("end"))))
        return F.filter(spans, lambda x: x.isNotNull())

    return F.when(F.rlike(text, pattern), let(parts(text), placed)).otherwise(F.array().cast(_SPAN))


def scan(rows: DataFrame, key: Column, text: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rows with spans: an array of (start, rank of the rule, end), by start, then rank; a column spans that they have is
    replaced. key: tells texts apart."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    grams = sorted({g for q in indexed.values() for way in q for g in way})
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "spans"])
    keyed = rows.select(F.xxhash64(key, text).alias("scan_key"), text.alias("scan_text"), own.alias("scan_row"))
    index = materialize(postings(keyed.select(F.col("scan_key").alias("key"), F.col("scan_text").alias("text")), grams), "postings")
    found = candidates(index, grams, indexed).withColumnRenamed("key", "found_key")
    rank = {r.kind: i for i, r in enumerate(rules)}
    everywhere = [_spans(F.col("scan_text"), r, rank[r.kind]) for r in rules if queries[r.kind] is None]
    joined = keyed.withColumn("scan_all", F.concat(F.array().cast(_SPAN), *everywhere)).join(found, F.col("scan_key") == F.col("found_key"), "left")
    chosen = [F.when(F.array_contains("rules", r.kind), _spans(F.col("scan_text"), r, rank[r.kind])).otherwise(F.array().cast(_SPAN)) for r in rules if queries[r.kind] is not None]
    return joined.select("scan_row.*", F.array_sort(F.concat("scan_all", *chosen)).alias("spans"))


def _text_of(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    found = scan(rows, F.col("doc_id"), F.col("text"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(_text_of(base, RULES), 256).alias("base_sha256"), _text_of(F.col("spans"), RULES).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each span, or run of overlapping spans, replaced by mark. The text is cut into pieces of PIECE characters
    first, so that a place in it is found without counting from its start each time."""

    def rebuilt(pieces: Column) -> Column:
        def part(at: Column, n: Column) -> Column:
            first, skip = F.floor(at / PIECE).cast("int"), F.pmod(at, F.lit(PIECE))
            return F.substring(F.array_join(F.slice(pieces, first + 1, F.floor((skip + n) / PIECE).cast("int") + 1), ""), skip + 1, n)

        def kept(ends: Column) -> Column:
            return F.zip_with(spans, ends, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(part(at, s["start"] - at), F.lit(mark))))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(let(_before(F.transform(spans, lambda s: s["end"]), F.greatest), kept), ""), part(last, F.length(text) - last))

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), rebuilt)).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in texts are replaced by a mark, and n_chars follows; all documents stay, also repeated rows,
    null ids and null texts, which stay null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = scan(rows, F.col("_row.doc_id"), F.coalesce(F.col("_row.text"), F.lit("")))
    new = found.withColumn("_new", F.when(F.size("spans") > 0, redacted(F.col("_row.text"), F.col("spans"))).otherwise(F.col("_row.text")))
    value = {"text": F.col("_new"), "n_chars": F.when(F.size("spans") > 0, F.length("_new").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("_row")["n_chars"])} if "n_chars" in docs.columns else {"text": F.col("_new")}
    return new.select(*[value.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def _sql_rule(r: Rule, rank: int) -> str:
    """DuckDB's patterns have no look-ahead, so white space behind a key's last line is matched and then cut off; nor
    have they large nested repetitions, so lines of a key aren't bounded there."""
    p = r.pattern.replace("(?=\\s*(?:[\\r\\n]|$))", "\\s*?(?:[\\r\\n]|$)").replace("*+", "*").replace("{1,1000}", "+").replace("{0,20}", "*").replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, s AS start, s + cut AS stop FROM (
      SELECT rid, cut, k, CAST(sum(g) OVER w + sum(n) OVER w - n AS BIGINT) AS s FROM (
        SELECT rid, unnest(range(1, len(m) + 1)) AS i, length(m[i]) AS n, length(rtrim(m[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS cut, length(key[i]) AS k, length(gaps[i]) AS g FROM (
          SELECT rid, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS key, regexp_split_to_array(t, '{p}') AS gaps
          FROM docs WHERE regexp_matches(t, '{p}')))
      WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE k >= {r.least}"""


_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(r, i) for i, r in enumerate(RULES))}),
named AS (SELECT *, ({_KINDS})[rank + 1] || ':' || start || ':' || stop AS s FROM found),
grouped AS (
  SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2,
         string_agg(s, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(s, ',' ORDER BY start, rank) AS every
  FROM named GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN grouped USING (rid)
"""
