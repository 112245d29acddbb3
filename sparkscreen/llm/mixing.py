"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

A token budget flows down the tree. Each node gets its share by weight among its siblings, but never more than its
subtree can give (its tokens times the allowed epochs); what a node can't take goes to its siblings, and leaves their
parent only if that whole subtree is short, because the parent's own capacity is known before. A leaf then takes whole
seeded epochs and, of the next one, the prefix of documents in seeded order that fills its budget; the document at the
end is taken in part.

Scale: the tree is aggregated first, so budgeting runs on one row a leaf. The end of a leaf's prefix is found in two
steps: token sums of sqrt(rows) equal ranges of the order, then a running sum in the one range that holds the end. No
task sees a whole leaf, however large it is. Only DataFrame functions are used.

Defined cases: a null text has 0 tokens and is never taken; null domain, language or source are leaves of their own;
rows of one leaf with the same id move together; a text of any length counts all its tokens, and only the one at the end
of a prefix is taken in part; an empty table, or a budget or weight of 0, gives no rows; other columns of the input,
whatever their names, aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, materialize, table, text_or_empty, words_of

LEAF = ["domain", "lang", "source"]


@dataclass(frozen=True)
class Mix:
    """Integer weights for each level; a name that isn't listed has weight 1."""

    domains: dict = field(default_factory=lambda: {"web": 2, "curated": 3})
    langs: dict = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2})
    sources: dict = field(default_factory=dict)
    budget_percent: int = 80
    epochs: int = 4
    seed: int = 17


MIX = Mix()


def domain_of(source: Column) -> Column:
    """The domain of a source in the given tables: src0 to src9 are web, src10 to src19 curated."""
    return F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src1[0-9]$"), "curated").otherwise("other")


def _weight(names: dict, col: str) -> Column:
    if not names:
        return F.lit(1).cast("long")
    out = F.lit(1)
    for k, v in names.items():
        out = F.when(F.col(col) == k, F.lit(int(v))).otherwise(out)
    return out.cast("long")


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, where on is equal or null in both."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in b.columns if c not in on])
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return a.join(b, keys, how).drop(*[f"_{c}" for c in on])


def _shared(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add got: the node's part of its parent's budget (column budget), by weight, at most its capacity."""
    group = Window.partitionBy(*parent)
    order = group.orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(name).asc_nulls_first())
    ranked = nodes.filter("weight > 0").select(
        "*",
        F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"),
    )
    full = ranked.withColumn("_full", F.col("capacity") * F.col("_rest") <= (F.col("budget") - F.col("_before")) * F.col("weight"))
    sums = full.select(
        "*",
        F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(group).alias("_taken"),
        F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(group).alias("_open"),
    )
    got = F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("((budget - _taken) * weight) div nullif(_open, 0)"))
    return sums.withColumn("got", got).drop("_before", "_rest", "_full", "_taken", "_open", "weight", "budget")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves: domain, lang, source, tokens, rows. Adds got, and what it means: whole epochs and the rest."""
    sized = leaves.withColumn("capacity", F.col("tokens") * mix.epochs).withColumn("_all", F.lit(0))
    total = sized.groupBy("_all").agg(F.expr(f"(sum(tokens) * {mix.budget_percent}) div 100").alias("budget"))
    domains = sized.groupBy("_all", "domain").agg(F.sum("capacity").alias("capacity")).join(total, "_all").withColumn("weight", _weight(mix.domains, "domain"))
    domains = _shared(domains, ["_all"], "domain").select("domain", F.col("got").alias("budget"))
    langs = sized.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    langs = _joined(langs, domains, ["domain"]).withColumn("weight", _weight(mix.langs, "lang"))
    langs = _shared(langs, ["domain"], "lang").select("domain", "lang", F.col("got").alias("budget"))
    sources = _joined(sized.drop("_all"), langs, ["domain", "lang"]).withColumn("weight", _weight(mix.sources, "source"))
    got = _shared(sources, ["domain", "lang"], "source")
    return got.select(*LEAF, "tokens", "rows", "got", F.expr("coalesce(got div nullif(tokens, 0), 0)").alias("whole"), F.expr("coalesce(got % nullif(tokens, 0), 0)").alias("rest"))


def _order_key(mix: Mix) -> Column:
    """Seeded order of a leaf's rows in its last, partial epoch: the same for rows with the same id."""
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def _range(key: Column, n: Column) -> Column:
    """The place of key among n equal ranges of all keys."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(2.0**32)).cast("long")


def prefix_ends(keyed: DataFrame, budgets: DataFrame, mix: Mix) -> DataFrame:
    """budgets with end_key, end_left: the last key of the leaf's prefix and the tokens left for that key's rows."""
    rows = _joined(keyed, budgets.filter("rest > 0").drop("tokens", "got"), LEAF)
    rows = rows.withColumn("key", _order_key(mix)).withColumn("bucket", _range(F.col("key"), F.ceil(F.sqrt("rows"))))
    rows = materialize(rows.select(*LEAF, "rest", "bucket", "key", "n_tokens"), "mix-order")
    in_leaf = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("n")).withColumn("until", F.sum("n").over(in_leaf))
    last = sums.filter("until >= rest and until - n < rest").select(*LEAF, "bucket", (F.col("until") - F.col("n")).alias("before"))
    inner = _joined(rows, last, [*LEAF, "bucket"])
    keys = inner.groupBy(*LEAF, "rest", "key", "before").agg(F.sum("n_tokens").alias("n"))
    in_bucket = Window.partitionBy(*LEAF).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = keys.withColumn("until", F.col("before") + F.sum("n").over(in_bucket)).filter("until >= rest and until - n < rest").select(*LEAF, F.col("key").alias("end_key"), (F.col("rest") - F.col("until") + F.col("n")).alias("end_left"))
    return _joined(budgets, ends, LEAF, "left")


def chosen(docs: DataFrame, mix: Mix, id_col: str, text_col: str, source_col: str, lang_col: str, row: Column | None = None) -> DataFrame:
    """One row for each document and epoch taken: id, domain, lang, source, epoch, n_tokens, n_taken, and row if given."""
    source, lang = F.col(source_col), F.col(lang_col)
    cols = [F.col(id_col).alias("id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), let(text_or_empty(text_col), lambda t: F.size(words_of(t))).cast("long").alias("n_tokens")]
    keyed = materialize(docs.select(*cols), "mix-keyed")
    leaves = keyed.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    ends = materialize(prefix_ends(keyed, materialize(leaf_budgets(leaves, mix), "mix-budgets"), mix).filter("got > 0"), "mix-ends")
    rows = keyed if row is None else docs.select(*cols, row.alias("row"))
    hit = _joined(rows.filter("n_tokens > 0"), ends.select(*LEAF, "whole", "end_key", "end_left"), LEAF).withColumn("_key", _order_key(mix))
    more = F.when(F.col("_key") < F.col("end_key"), F.col("n_tokens")).when(F.col("_key") == F.col("end_key"), F.least("n_tokens", "end_left"))
    hit = hit.withColumn("_more", more).withColumn("_epochs", (F.col("whole") + F.col("_more").isNotNull().cast("long")).cast("int")).filter("_epochs > 0")
    out = hit.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
    return out.withColumn("n_taken", F.when(F.col("epoch") == F.col("whole"), F.col("_more")).otherwise(F.col("n_tokens"))).drop("whole", "end_key", "end_left", "_key", "_more", "_epochs")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chosen(table(spark, sf_dir, "documents"), MIX, "doc_id", "text", "source", "lang")
    return out.select(F.col("id").alias("doc_id"), *LEAF, "epoch", "n_tokens", "n_taken")


#: The pipeline takes each document at most once: it spends all tokens as far as the weights let it.
STAGE_MIX = Mix(budget_percent=90, epochs=1)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, whole, also the one at the end of a leaf's prefix.

    Texts that are null or blank have no token to take and go; null ids, languages and sources are kept as they are; rows
    that repeat an id stay or go together; columns of any name pass through; an empty table stays empty."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return chosen(docs, STAGE_MIX, "doc_id", "text", "source", "lang", row).select("row.*")


def _case(names: dict, col: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in names.items()) + " ELSE 1 END" if names else "1"


def _sql_share(nodes: str, parent: str, name: str) -> str:
    """The rows of nodes (with capacity, weight, budget) and got."""
    return f"""SELECT * EXCLUDE (capacity, weight, budget, bef, rest_w, fl, taken, opn), CASE WHEN fl THEN capacity ELSE ((budget - taken) * weight) // nullif(opn, 0) END AS got FROM (
      SELECT *, sum(CASE WHEN fl THEN capacity ELSE 0 END) OVER (PARTITION BY {parent}) AS taken, sum(CASE WHEN fl THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS opn FROM (
        SELECT *, capacity * rest_w <= (budget - bef) * weight AS fl FROM (
          SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
                 sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
          FROM ({nodes}) WHERE weight > 0)))"""


ORACLE_SQL = rf"""
WITH keyed AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' WHEN regexp_matches(source, '^src1[0-9]$') THEN 'curated' ELSE 'other' END AS domain,
         lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MIX.epochs} AS BIGINT) AS capacity FROM keyed GROUP BY ALL
), d AS (
  {_sql_share(f"SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, {_case(MIX.domains, 'domain')} AS weight, (SELECT CAST(sum(tokens) * {MIX.budget_percent} // 100 AS BIGINT) FROM leaves) AS budget, 0 AS top FROM leaves GROUP BY domain", "top", "domain")}
), l AS (
  {_sql_share(f"SELECT v.domain, v.lang, CAST(sum(v.capacity) AS BIGINT) AS capacity, {_case(MIX.langs, 'v.lang')} AS weight, CAST(any_value(d.got) AS BIGINT) AS budget FROM leaves v JOIN d ON v.domain IS NOT DISTINCT FROM d.domain GROUP BY v.domain, v.lang", "domain", "lang")}
), s AS (
  {_sql_share("SELECT v.*, 1 AS weight, CAST(l.got AS BIGINT) AS budget FROM leaves v JOIN l ON v.domain IS NOT DISTINCT FROM l.domain AND v.lang IS NOT DISTINCT FROM l.lang", "domain, lang", "source")}
), cut AS (
  SELECT *, coalesce(CAST(got AS BIGINT) // nullif(tokens, 0), 0) AS whole, coalesce(CAST(got AS BIGINT) % nullif(tokens, 0), 0) AS rest FROM s WHERE got > 0
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) AS until, sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS own FROM (
    SELECT k.*, c.whole, c.rest, md5('{MIX.seed}:' || c.whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
    FROM keyed k JOIN cut c ON k.domain IS NOT DISTINCT FROM c.domain AND k.lang IS NOT DISTINCT FROM c.lang AND k.source IS NOT DISTINCT FROM c.source)
)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, CAST(CASE WHEN e < whole THEN n_tokens ELSE least(n_tokens, rest - (until - own)) END AS BIGINT) AS n_taken
FROM (SELECT *, unnest(range(0, {MIX.epochs + 1})) AS e FROM run)
WHERE n_tokens > 0 AND (e < whole OR (e = whole AND until - own < rest))
"""
