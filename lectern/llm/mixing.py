"""Operator 10: mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source); integer weights belong to the nodes of each level.  The root's budget is
a share of all tokens and goes down the tree level by level.  A child never gets more than its capacity (the
tokens below it times ``max_epochs``); what it can't take is dealt to its siblings by their weights, and only
what a whole family can't take is missing in its parent's capacity and so goes to the parent's siblings.
Water-filling of one family is closed: with children ordered by capacity per weight, the full ones are a
prefix, found by running sums.  All arithmetic is on integers; rounding down leaves at most one token a child.

A leaf of T tokens with budget b takes ``b div T`` whole epochs and a token-prefix of the next: documents in the
order of md5(seed:epoch:doc_id), as long as the tokens before them are below the rest of the budget (so at most one
document passes it; equal keys are taken together).  The prefix is found without sorting a leaf: keys are summed by buckets
of about ``BUCKET`` rows, running sums over buckets find the one where the prefix ends, and only its rows are sorted.
So a leaf with a third of all rows costs its share of one grouped sum, and the decision is a comparison of a
document's key with its leaf's last key.

Tokens are words.  Null text: no tokens (taken when its place in the order is within the prefix).  Null lang or source, or a name without
a weight: weight ``DEFAULT``; nulls count as the name ``none``.  Empty table: empty result.  Repeated rows share their key.  Extra columns
are kept by ``mix_documents``; the columns that it adds begin with ``mix_``, or with more underscores where a column of the caller's does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WORD, documents, free_prefix, materialize

DOMAINS = {"web": 50, "books": 30, "reference": 20}
LANGS = {"en": 40, "de": 20, "fr": 20, "es": 20}
DEFAULT, SEED, EPOCHS, BUCKET = 10, 7, 2, 4096
#: Budget of the root: this share of all tokens.
SHARE = (3, 5)
LEAF = ("mix_domain", "mix_lang", "mix_source")


def domain_of(source: Column) -> Column:
    """The benchmark's sources have no domain; their checksum gives one."""
    part = F.crc32(F.encode(source, "UTF-8")) % 10
    return F.when(part < 5, "web").when(part < 8, "books").otherwise("reference")


def _weight(name: Column, weights: dict[str, int]) -> Column:
    known = F.lit(None)
    for key, w in weights.items():
        known = F.when(name == key, F.lit(w)).otherwise(known)
    return F.coalesce(known, F.lit(DEFAULT)).cast("long")


def fill(nodes: DataFrame, family: list[str], name: str) -> DataFrame:
    """Deal ``budget`` (of a row's family) to the rows by ``w`` up to ``cap``: column ``got``."""
    order = W.partitionBy(*family).orderBy(F.col("cap") / F.col("w"), name)
    every, upto = W.partitionBy(*family), order.rowsBetween(W.unboundedPreceding, -1)
    out = nodes.withColumn("cap0", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("w0", F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    out = out.withColumn("full", F.col("cap") * F.col("w0") <= (F.col("budget") - F.col("cap0")) * F.col("w"))
    out = out.withColumn("cap1", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).withColumn("w1", F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    return out.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((budget - cap1) * w) div w1"))).drop("cap0", "w0", "full", "cap1", "w1")


def budgets(leaves: DataFrame, share=SHARE, epochs: int = EPOCHS, domains=DOMAINS, langs=LANGS, sources=None) -> DataFrame:
    """Leaves (LEAF columns, leaf_rows, leaf_tokens) with ``budget``; a leaf table is as small as the tree of weights."""
    d, la, s = LEAF
    leaves = leaves.withColumn("cap", F.col("leaf_tokens") * epochs)
    total = F.expr(f"(sum(leaf_tokens) over () * {share[0]}) div {share[1]}")
    leaves = leaves.withColumn("root", F.least(total, F.sum("cap").over(W.partitionBy()))).where("cap > 0")
    top = leaves.groupBy(d).agg(F.sum("cap").alias("cap"), F.max("root").alias("budget")).withColumn("w", _weight(F.col(d), domains)).withColumn("all", F.lit(1))
    top = fill(top, ["all"], d).select(F.col(d).alias("d1"), F.col("got").alias("budget"))
    mid = leaves.groupBy(d, la).agg(F.sum("cap").alias("cap")).join(top, F.col(d) == F.col("d1")).withColumn("w", _weight(F.col(la), langs))
    mid = fill(mid, [d], la).select(F.col(d).alias("d1"), F.col(la).alias("l1"), F.col("got").alias("budget"))
    low = leaves.join(mid, (F.col(d) == F.col("d1")) & (F.col(la) == F.col("l1"))).withColumn("w", _weight(F.col(s), sources or {}))
    return fill(low, [d, la], s).select(*LEAF, "leaf_rows", "leaf_tokens", F.col("got").alias("budget"))


def leaf_columns(docs: DataFrame, prefix: str = "mix_") -> DataFrame:
    source = F.coalesce(F.col("source").cast("string"), F.lit("none"))
    return docs.withColumns({
        f"{prefix}domain": domain_of(source), f"{prefix}lang": F.coalesce(F.col("lang").cast("string"), F.lit("none")), f"{prefix}source": source,
        f"{prefix}tokens": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    })


def key_of(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(rows: DataFrame, seed: int = SEED, **tree) -> DataFrame:
    """One row a leaf: LEAF (as p_domain, p_lang, p_source), budget, whole epochs and the last key of the prefix (null: none)."""
    leaves = rows.groupBy(*LEAF).agg(F.count("*").alias("leaf_rows"), F.sum("mix_tokens").alias("leaf_tokens"))
    deal = budgets(leaves, **tree).withColumn("epoch", F.expr("budget div leaf_tokens")).withColumn("rest", F.col("budget") - F.col("epoch") * F.col("leaf_tokens"))
    deal = deal.withColumn("bits", F.least(F.lit(31), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("leaf_rows") / BUCKET)))).cast("int"))
    deal = materialize(deal.select(*[F.col(c).alias(c.replace("mix", "p")) for c in LEAF], "budget", "epoch", "rest", "bits"), "mix-deal")
    same = [F.col(c) == F.col(c.replace("mix", "p")) for c in LEAF]
    keyed = rows.join(deal.where("rest > 0"), same).withColumn("key", key_of(F.col("epoch"), seed))
    keyed = keyed.withColumn("bucket", F.expr("cast(conv(substring(key, 1, 8), 16, 10) as bigint) div cast(pow(2, 32 - bits) as bigint)"))
    sums = keyed.groupBy("p_domain", "p_lang", "p_source", "rest", "bucket").agg(F.sum("mix_tokens").alias("n"))
    leaf = W.partitionBy("p_domain", "p_lang", "p_source")
    sums = sums.withColumn("base", F.sum("n").over(leaf.orderBy("bucket")) - F.col("n")).where("base < rest")
    last = sums.groupBy(F.col("p_domain").alias("e1"), F.col("p_lang").alias("e2"), F.col("p_source").alias("e3")).agg(F.max(F.struct("bucket", "base")).alias("end"))
    at_end = keyed.join(last, [F.col("p_domain") == F.col("e1"), F.col("p_lang") == F.col("e2"), F.col("p_source") == F.col("e3"), F.col("bucket") == F.col("end.bucket")])
    ends = at_end.groupBy("e1", "e2", "e3", "key", "rest", F.col("end.base").alias("base")).agg(F.sum("mix_tokens").alias("n"))
    ends = ends.withColumn("before", F.col("base") + F.sum("n").over(W.partitionBy("e1", "e2", "e3").orderBy("key")) - F.col("n")).where("before < rest")
    ends = ends.groupBy("e1", "e2", "e3").agg(F.max("key").alias("last_key"))
    joined = deal.join(ends, [F.col("p_domain") == F.col("e1"), F.col("p_lang") == F.col("e2"), F.col("p_source") == F.col("e3")], "left")
    return materialize(joined.select("p_domain", "p_lang", "p_source", "budget", "epoch", "last_key"), "mix-plan")


def mix_documents(docs: DataFrame, seed: int = SEED, narrow: bool = False, **tree) -> DataFrame:
    """Rows of ``docs`` that are taken, with their columns (``narrow``: doc_id alone), and domain, lang, source, tokens, budget and copies behind ``free_prefix``."""
    p = free_prefix(docs.columns, "mix_")
    rows = leaf_columns(docs, p)
    own = [f"{p}{c}" for c in ("domain", "lang", "source", "tokens")]
    thin = materialize(rows.select("doc_id", *[F.col(c).alias(f"mix_{c[len(p):]}") for c in own]), "mix-rows")
    deal = plan(thin, seed, **tree)
    deal = deal.select(*[F.col(c).alias(f"{p}_{c}") for c in deal.columns])
    rows = rows.select("doc_id", *own) if narrow else rows
    same = [F.col(f"{p}{c}") == F.col(f"{p}_p_{c}") for c in ("domain", "lang", "source")]
    met = rows.join(deal, same)
    copies = F.col(f"{p}_epoch") + F.when(key_of(F.col(f"{p}_epoch"), seed) <= F.col(f"{p}_last_key"), 1).otherwise(0)
    met = met.withColumn(f"{p}copies", copies).withColumnRenamed(f"{p}_budget", f"{p}budget")
    out = met.where(F.col(f"{p}copies") > 0).select(*(["doc_id"] if narrow else docs.columns), *own, f"{p}budget", f"{p}copies")
    return out


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the mixture takes, with their leaf, its budget and how often each is read."""
    out = mix_documents(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), narrow=True)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_budget").alias("leaf_budget"), F.col("mix_copies").alias("copies"))


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in weights.items())} ELSE {DEFAULT} END" if weights else f"{DEFAULT}"


def _fill_sql(source: str, family: str, name: str) -> str:
    """The subqueries of one family's water-filling, ending in a table with ``got``."""
    part = f"PARTITION BY {family}"
    return f"""(SELECT *, CASE WHEN is_full THEN cap ELSE ((budget - cap1) * w) // w1 END AS got FROM (
      SELECT *, coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS cap1, sum(CASE WHEN NOT is_full THEN w END) OVER ({part}) AS w1 FROM (
        SELECT *, cap * w0 <= (budget - cap0) * w AS is_full FROM (
          SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap0,
            sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0
          FROM {source} WINDOW o AS ({part} ORDER BY cap / w, {name})))))"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII string, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = "c"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda c: {step})[1]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda a, b: list_transform([xor(a, b)], lambda c: {byte})[1]), 4294967295)"


SQL = f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
named AS (
  SELECT source, CASE WHEN part < 5 THEN 'web' WHEN part < 8 THEN 'books' ELSE 'reference' END AS domain
  FROM (SELECT source, {_crc_sql('source')} % 10 AS part FROM (SELECT DISTINCT source FROM rows_))),
docs AS (SELECT * FROM rows_ JOIN named USING (source)),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS leaf_tokens, (sum(tokens) * {EPOCHS})::BIGINT AS cap FROM docs GROUP BY ALL),
root AS (SELECT least((sum(leaf_tokens) * {SHARE[0]}) // {SHARE[1]}, sum(cap))::BIGINT AS budget FROM leaves),
t1 AS (SELECT domain, sum(cap)::BIGINT AS cap, {_case('domain', DOMAINS)}::BIGINT AS w, 1 AS one, (SELECT budget FROM root) AS budget FROM leaves WHERE cap > 0 GROUP BY domain),
f1 AS (SELECT domain, got::BIGINT AS budget FROM {_fill_sql('t1', 'one', 'domain')}),
t2 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, {_case('lang', LANGS)}::BIGINT AS w, any_value(budget) AS budget FROM leaves JOIN f1 USING (domain) WHERE cap > 0 GROUP BY domain, lang),
f2 AS (SELECT domain, lang, got::BIGINT AS budget FROM {_fill_sql('t2', 'domain', 'lang')}),
t3 AS (SELECT domain, lang, source, leaf_tokens, cap, {DEFAULT}::BIGINT AS w, budget FROM leaves JOIN f2 USING (domain, lang) WHERE cap > 0),
f3 AS (SELECT domain, lang, source, leaf_tokens, got::BIGINT AS budget, (got // leaf_tokens)::BIGINT AS epoch FROM {_fill_sql('t3', 'domain, lang', 'source')}),
keyed AS (SELECT d.*, budget, epoch, budget - epoch * leaf_tokens AS rest, md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM docs d JOIN f3 USING (domain, lang, source)),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS before FROM keyed)
SELECT doc_id, domain, lang, source, tokens, budget AS leaf_budget, (epoch + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM cum WHERE epoch > 0 OR before < rest
"""
