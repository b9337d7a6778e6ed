"""Mixing sources to target weights: budgets down a domain-language-source tree, and seeded token prefixes of its leaves.

DataFrame operations only.

* Tree. A document's leaf is (domain, language, source). A null level is a node of its own, shown as null.
* Weights. Every node has a whole-number weight among its siblings (``weights``: a level's value -> weight, 1 where
  unnamed; 0 leaves a branch out). The root's budget is ``share`` of all tokens, or ``budget`` tokens.
* Capacity. A leaf can give ``epochs`` times its tokens, an inner node the sum of its children (of weight above 0).
* Budgets. A node's budget is dealt to its children in proportion to their weights. A child whose capacity is
  smaller gets its capacity, and its shortage is dealt to its siblings, again by weight. Only what all siblings together
  can't take is missing at the parent, which by its own capacity asked for less from the start: there its siblings take
  it. The level of the water is found in closed form: children in the order of capacity / weight are full as long
  as their capacity is at most their share of what remains. Whole tokens that division leaves over go one each to the
  largest remainders.
* Selection. A leaf with budget b and t tokens gives b div t whole epochs, and of the next one the prefix that holds
  b mod t tokens, in the order of md5(seed:epoch:id), ties by id and token count. The document at the border gives the
  part that still fits. ``copies`` counts a document's whole epochs, ``taken`` all its tokens that are used.

Scale. Only (id, leaf, tokens) leaves the scan. Sums are pre-aggregated. A hot leaf is never ordered in one task: leaves are cut by
the hash into bins of about ``bin_rows`` documents, whose token sums give the border bin; only that bin is ordered.
All arithmetic is on whole numbers. Empty input or no positive weight: empty result. Documents without tokens (null or blank text)
are never selected. Repeated rows count as documents of their own; rows equal in id and tokens tie, and either may come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longpath.llm.common import stored

LEVELS = ("domain", "lang", "source")
WORD = "[^\\x20\\x09-\\x0D]+"


def tokens(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in sorted(weights.items()):
        out = F.when(level == name, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def dealt(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (w, cap, asked: the parent's budget) with a column got: the budgets of siblings, those with equal parent columns."""
    by = Window.partitionBy(*parent)
    order = by.orderBy("ratio", *[F.col(c).asc_nulls_first() for c in LEVELS if c in nodes.columns]).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    left_cap = F.col("asked") - F.coalesce(F.sum("cap").over(order), F.lit(0))
    left_w = F.sum("w").over(by) - F.coalesce(F.sum("w").over(order), F.lit(0))
    out = out.withColumns({"left_cap": left_cap, "left_w": left_w})
    out = out.withColumn("full", _wide(F.col("cap")) * _wide(F.col("left_w")) <= _wide(F.col("w")) * _wide(F.col("left_cap")))
    rest_cap = F.col("asked") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    rest_w = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0))
    out = out.withColumns({"rest_cap": rest_cap, "rest_w": rest_w})
    exact = _wide(F.col("w")) * _wide(F.col("rest_cap"))
    out = out.withColumn("floor", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(cast(w as decimal(19,0)) * cast(rest_cap as decimal(19,0)) div rest_w as bigint)")))
    out = out.withColumn("part", F.when(F.col("full"), F.lit(-1).cast("decimal(38,0)")).otherwise((exact % _wide(F.col("rest_w"))).cast("decimal(38,0)")))
    over = F.col("asked") - F.sum("floor").over(by)
    rank = F.row_number().over(by.orderBy(F.desc("part"), *[F.col(c).asc_nulls_first() for c in LEVELS if c in nodes.columns]))
    out = out.withColumns({"over": over, "rank": rank})
    got = F.col("floor") + F.when(~F.col("full") & (F.col("rank") <= F.col("over")), 1).otherwise(0)
    return out.withColumn("got", got.cast("long")).drop("ratio", "left_cap", "left_w", "full", "rest_cap", "rest_w", "floor", "part", "over", "rank", "asked")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, budget: int | None = None) -> DataFrame:
    """domain, lang, source, total and got of each leaf (domain, lang, source, total: its tokens)."""
    rows = leaves.withColumns({f"w_{x}": weight_of(F.col(x), weights.get(x, {})) for x in LEVELS})
    rows = rows.where((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0) & (F.col("total") > 0))
    rows = rows.withColumn("cap", F.col("total") * epochs)
    langs = rows.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("cap").alias("cap"))
    everything = leaves.agg(F.sum("total")).first()[0] or 0
    wanted = budget if budget is not None else everything * int(share[0]) // int(share[1])
    most = domains.agg(F.sum("cap")).first()[0] or 0
    level1 = dealt(domains.withColumnRenamed("w_domain", "w").withColumn("asked", F.lit(min(most, wanted)).cast("long")), [])
    two = langs.withColumnRenamed("w_lang", "w").join(level1.select(F.col("domain").alias("d"), F.col("got").alias("asked")), F.col("domain").eqNullSafe(F.col("d"))).drop("d", "w_domain")
    level2 = dealt(two, ["domain"])
    three = rows.select(*LEVELS, "total", F.col("w_source").alias("w"), "cap").join(
        level2.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("got").alias("asked")), F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))
    ).drop("d", "l")
    return dealt(three, ["domain", "lang"]).select(*LEVELS, "total", "got")


def _plan(thin: DataFrame, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int, bin_rows: int, budget: int | None) -> DataFrame:
    """A row a leaf: its whole epochs, the rest in tokens, its number of bins, and border bin and tokens before it (if there is a rest)."""
    leaves = thin.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("total"), F.count("*").alias("rows"))
    leaves = stored(leaves, "mixing-leaves")
    budgets = leaf_budgets(leaves.select(*LEVELS, "total"), weights, share, epochs, budget)
    plan = budgets.where("got > 0").selectExpr(*[f"{x} as p_{x}" for x in LEVELS], "got div total as epoch", "got % total as rest")
    plan = plan.join(leaves, [F.col(x).eqNullSafe(F.col(f"p_{x}")) for x in LEVELS]).drop(*LEVELS, "total")
    plan = stored(plan.withColumn("bins", F.expr(f"1 + rows div {bin_rows}")).drop("rows"), "mixing-plan")
    sums = _binned(thin, plan, seed).where("rest > 0").groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = sums.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    border = border.select(*LEVELS, F.col("bin").alias("border"), "before")
    return stored(plan.join(border, [F.col(x).eqNullSafe(F.col(f"p_{x}")) for x in LEVELS], "left").drop(*LEVELS), "mixing-border")


def _binned(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (id, levels, n_tokens, ...) of planned leaves with their leaf's plan, key and bin."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    out = rows.join(plan, [F.col(x).eqNullSafe(F.col(f"p_{x}")) for x in LEVELS]).drop(*[f"p_{x}" for x in LEVELS])
    return out.withColumn("key", key).withColumn("bin", F.expr("cast(conv(substring(key, 1, 8), 16, 10) as bigint) * bins div 4294967296"))


def _taken(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with epoch and taken; only the border bins are ordered."""
    rows = _binned(rows, plan, seed)
    whole = rows.where("border is null or bin <> border").withColumn("part", F.expr("case when rest > 0 and bin < border then n_tokens else 0 end"))
    at = Window.partitionBy(*LEVELS).orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("bin = border").withColumn("sum", F.col("before") + F.coalesce(F.sum("n_tokens").over(at), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - F.col("sum")))).drop("sum")
    both = whole.unionByName(edge).withColumn("taken", (F.col("epoch") * F.col("n_tokens") + F.col("part")).cast("long"))
    return both.where("taken > 0")


def _thin(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), tokens(F.col(text_col)).alias("n_tokens"), *more)
    return rows.where("n_tokens > 0")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 7, bin_rows: int = 4096, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, domain, lang, source, n_tokens, copies and taken of each selected document (taken > 0)."""
    thin = stored(_thin(docs, domain, id_col, text_col, lang_col, source_col), "mixing")
    rows = _taken(thin, _plan(thin, weights, share, epochs, seed, bin_rows, budget), seed)
    return rows.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", F.col("epoch").cast("long").alias("copies"), "taken")


def mixed(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 7, bin_rows: int = 4096, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The selected rows of docs, whole, each as often as epochs use it (a part counts as one use).

    The text is scanned twice but not shuffled, except for the documents of border bins.
    """
    names = (id_col, text_col, lang_col, source_col)
    thin = stored(_thin(docs, domain, *names), "mixing")
    plan = _plan(thin, weights, share, epochs, seed, bin_rows, budget)
    rows = _taken(_thin(docs, domain, *names, F.struct(*[docs[c] for c in docs.columns]).alias("doc")), plan, seed)
    uses = F.ceil(F.col("taken") / F.col("n_tokens")).cast("int")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), uses)).alias("use")).select("doc.*")


def mix_sql(domain: str, weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int) -> str:
    """The same in DuckDB's SQL, with each leaf ordered at once."""
    def weight(level: str) -> str:
        cases = "".join(f" WHEN '{k}' THEN {int(v)}" for k, v in sorted(weights.get(level, {}).items()))
        return f"CAST(CASE {level}{cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"

    def deal(source: str, keys: str, parent: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        names = keys.replace(", ", " NULLS FIRST, ") + " NULLS FIRST"
        return f"""
  SELECT *, fl + CASE WHEN NOT isfull AND row_number() OVER ({over} ORDER BY part DESC, {names}) <= asked - sum(fl) OVER ({over}) THEN 1 ELSE 0 END AS got
  FROM (SELECT *, CASE WHEN isfull THEN cap ELSE (w * rest_cap) // rest_w END AS fl, CASE WHEN isfull THEN -1 ELSE (w * rest_cap) % rest_w END AS part
    FROM (SELECT *, asked - coalesce(sum(CASE WHEN isfull THEN cap END) OVER ({over}), 0) AS rest_cap, coalesce(sum(CASE WHEN NOT isfull THEN w END) OVER ({over}), 0) AS rest_w
      FROM (SELECT *, cap * (sum(w) OVER ({over}) - coalesce(sum(w) OVER before, 0)) <= w * (asked - coalesce(sum(cap) OVER before, 0)) AS isfull
        FROM {source} WINDOW before AS ({over} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""

    return f"""
WITH thin AS (
  SELECT doc_id AS id, {domain} AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS total, {weight('domain')} AS w1, {weight('lang')} AS w2, {weight('source')} AS w3
  FROM thin WHERE n_tokens > 0 GROUP BY domain, lang, source),
used AS (SELECT *, total * {epochs} AS cap FROM leaves WHERE w1 > 0 AND w2 > 0 AND w3 > 0),
n1 AS (SELECT domain, w1 AS w, sum(cap)::HUGEINT AS cap, least((SELECT sum(cap) FROM used), (SELECT sum(total) FROM leaves)::HUGEINT * {share[0]} // {share[1]})::HUGEINT AS asked FROM used GROUP BY domain, w1),
g1 AS ({deal('n1', 'domain', '')}),
n2 AS (SELECT u.domain, u.lang, u.w2 AS w, sum(u.cap)::HUGEINT AS cap, any_value(g1.got)::HUGEINT AS asked FROM used u JOIN g1 ON u.domain IS NOT DISTINCT FROM g1.domain GROUP BY u.domain, u.lang, u.w2),
g2 AS ({deal('n2', 'domain, lang', 'domain')}),
n3 AS (SELECT u.domain, u.lang, u.source, u.total, u.w3 AS w, u.cap, g2.got::HUGEINT AS asked FROM used u JOIN g2 ON u.domain IS NOT DISTINCT FROM g2.domain AND u.lang IS NOT DISTINCT FROM g2.lang),
g3 AS ({deal('n3', 'domain, lang, source', 'domain, lang')}),
plan AS (SELECT domain, lang, source, CAST(got // total AS BIGINT) AS epoch, CAST(got % total AS BIGINT) AS rest FROM g3 WHERE got > 0),
rows AS (
  SELECT t.*, p.epoch, p.rest, coalesce(sum(t.n_tokens) OVER (PARTITION BY t.domain, t.lang, t.source
    ORDER BY md5('{seed}:' || CAST(p.epoch AS VARCHAR) || ':' || coalesce(CAST(t.id AS VARCHAR), '')), t.id, t.n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM thin t JOIN plan p ON t.domain IS NOT DISTINCT FROM p.domain AND t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source
  WHERE t.n_tokens > 0)
SELECT id AS doc_id, domain, lang, source, n_tokens, epoch AS copies, CAST(epoch * n_tokens + greatest(0, least(n_tokens, rest - before)) AS BIGINT) AS taken
FROM rows WHERE epoch * n_tokens + greatest(0, least(n_tokens, rest - before)) > 0
"""
