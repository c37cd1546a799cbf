"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Token counts form a table of (source, language, topic) cells. Raking scales the
cells in turn so that the token shares of sources, languages and topics meet
their targets, a fixed number of rounds. A cell's wanted tokens over its tokens
give the sampling rate of its documents; the rates are scaled so that the
expected tokens are ``budget`` of the corpus, where a rate that would pass 1
stays at 1 and the others take up the rest. A document is selected when a
uniform number made from its id is below the rate, so the sample repeats.

Only the cell table is shuffled, after a partial aggregation per task; raking
runs on its rows (partitions by their number), and documents get their rate by
a join that broadcasts the cells only while their counted number is small.

Defined results: null source, language or topic is a category of its own (its
target comes from its share like any other's). A null or empty text has 0
tokens: its document keeps its row, and takes the rate of its cell (0 where the
whole cell has no tokens). Documents with equal ids share one uniform number.
An empty table gives no rows. Extra columns pass through ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import small, stage, table, unit_hash, unwrapped, wrapped
from ledgerloom.llm.registry import query

#: Targets are shares to the power of these (1 keeps the corpus mix, 0 is uniform).
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS = 8
BUDGET = 0.5
CELLS_PER_TASK = 50_000


def tokens_of(text: Column) -> Column:
    """About the tokens of a byte-level vocabulary: one per four bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def topic_of(text: Column) -> Column:
    """A coarse topic from surface cues of the text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.instr(t, "icense") > 0, "legal").when(F.instr(t, "@") > 0, "contact") \
        .when(F.instr(t, " | ") > 0, "tables").when(F.instr(t, "###") > 0, "symbols") \
        .otherwise("prose")


def _targets(cells: DataFrame, dim: str, want) -> DataFrame:
    """(dim, target): shares that add up to 1 over the categories present.

    ``want`` is a temperature, or a dict of category to weight (missing: 0).
    """
    w = Window.partitionBy()
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if isinstance(want, dict):
        pairs = F.create_map(*[F.lit(x) for kv in want.items() for x in
                               (kv[0], float(kv[1]))])
        by = by.withColumn("raw", F.coalesce(pairs[F.col(dim)], F.lit(0.0)))
    else:
        by = by.withColumn("raw", F.when(F.col("t") > 0, F.pow(
            F.col("t") / F.sum("t").over(w), F.lit(float(want)))).otherwise(0.0))
    return by.select(F.col(dim).alias(f"_{dim}"),
                     F.try_divide(F.col("raw"), F.sum("raw").over(w)).alias(f"target_{dim}"))


def cell_rates(docs: DataFrame, dims, tokens_col: str, targets=None, budget: float = BUDGET,
               rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(dims, tokens, weight, rate) per cell, and the number of cells."""
    targets = TEMPERATURE if targets is None else targets
    dims = list(dims)
    cells = stage(docs.groupBy(*dims).agg(F.sum(tokens_col).alias("tokens")), "cells")
    n = cells.count()
    cells = cells.coalesce(max(1, math.ceil(n / CELLS_PER_TASK)))
    for d in dims:
        t = _targets(cells, d, targets[d])
        cells = cells.join(small(t, n), F.col(d).eqNullSafe(F.col(f"_{d}"))).drop(f"_{d}")
    everything = Window.partitionBy()
    cells = cells.withColumn("weight", F.try_divide(F.col("tokens").cast("double"),
                                                    F.sum("tokens").over(everything)))
    for _ in range(rounds):
        for d in dims:
            w = Window.partitionBy(d)
            cells = cells.withColumn("weight", F.coalesce(F.try_divide(
                F.col("weight") * F.col(f"target_{d}"), F.sum("weight").over(w)), F.lit(0.0)))
    # Rates: the most wanted cells first; the first k are taken whole where they would pass 1.
    cells = cells.withColumn("want", F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")),
                                                F.lit(0.0)))
    ordered = Window.orderBy(F.desc("want"), *[F.asc_nulls_first(d) for d in dims])
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("whole", F.coalesce(F.sum("tokens").over(before), F.lit(0))) \
        .withColumn("spare", F.greatest(F.lit(0.0), F.sum("weight").over(everything)
                                        - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    total = F.sum("tokens").over(everything)
    scale = F.try_divide(budget * total - F.col("whole"), F.col("spare"))
    cells = cells.withColumn("scale", F.greatest(scale, F.lit(0.0)))
    # The first cell whose rate stays within 1 fixes the scale; before it, cells are whole.
    fits = F.col("scale") * F.col("want") <= 1.0
    cells = cells.withColumn("_n", F.row_number().over(ordered))
    cut = F.min(F.when(fits, F.col("_n"))).over(everything)
    cells = cells.withColumn("_cut", cut)
    chosen = F.min(F.when(F.col("_n") == F.col("_cut"), F.col("scale"))).over(everything)
    cells = cells.withColumn("rate", F.when(F.col("_cut").isNull() | (F.col("_n") < F.col("_cut")),
                                            F.lit(1.0)).otherwise(F.col("want") * chosen))
    out = cells.select(*dims, "tokens", "weight", F.when(F.col("want") == 0, 0.0).otherwise(
        F.round("rate", 9)).alias("rate"))
    return stage(out, "rates"), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", targets=None,
        budget: float = BUDGET, out=("_topic", "_tokens", "_rate", "_selected")) -> DataFrame:
    """``docs`` plus four columns (named by ``out``): topic, tokens, rate and whether selected."""
    rows = wrapped(docs, source=F.col(source_col), lang=F.col(lang_col),
                   topic=topic_of(F.col(text_col)), tokens=tokens_of(F.col(text_col)),
                   u=unit_hash(F.col(id_col)))
    rates, n = cell_rates(rows.select("source", "lang", "topic", "tokens"),
                          ["source", "lang", "topic"], "tokens", targets, budget)
    rates = rates.select(F.col("source").alias("r_source"), F.col("lang").alias("r_lang"),
                         F.col("topic").alias("r_topic"), "rate")
    on = (F.col("source").eqNullSafe(F.col("r_source")) & F.col("lang").eqNullSafe(F.col("r_lang"))
          & (F.col("topic") == F.col("r_topic")))
    made = (F.col("topic"), F.col("tokens"), F.col("rate"), F.col("u") < F.col("rate"))
    return unwrapped(rows.join(small(rates, n), on), docs.columns, **dict(zip(out, made)))


def mix_sql(source: str) -> str:
    """DuckDB CTEs ending in ``mixed``: every row of ``source`` with its rate and selection."""
    dims = ["source", "lang", "topic"]
    ctes = [f"""d as (select *, case when contains(t, 'icense') then 'legal' when contains(t, '@') then 'contact'
  when contains(t, ' | ') then 'tables' when contains(t, '###') then 'symbols' else 'prose' end as topic,
  cast(ceil(strlen(t) / 4) as bigint) as tokens from (select *, coalesce(text, '') as t from {source}))""",
            "c as (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all)"]
    for x in dims:
        ctes.append(f"""t_{x} as (select {x}, raw / sum(raw) over () as target from (select {x},
  case when sum(tokens) > 0 then (sum(tokens)::double / sum(sum(tokens)) over ()) ** {TEMPERATURE[x]}
  else 0.0 end as raw from c group by {x}))""")
    ctes.append("w0 as (select *, tokens::double / nullif(sum(tokens) over (), 0) as weight from c)")
    n = 0
    for _ in range(ROUNDS):
        for x in dims:
            ctes.append(f"""w{n + 1} as materialized (select w.* replace (coalesce(weight * target
  / nullif(sum(weight) over (partition by w.{x}), 0), 0.0) as weight)
  from w{n} w join t_{x} t on w.{x} is not distinct from t.{x})""")
            n += 1
    order = "order by want desc, source nulls first, lang nulls first, topic"
    ctes += [f"a as (select *, coalesce(weight / nullif(tokens, 0), 0.0) as want from w{n})",
             f"""b as (select *, row_number() over ({order}) as k, greatest(({BUDGET} * sum(tokens) over ()
  - coalesce(sum(tokens) over ({order} rows between unbounded preceding and 1 preceding), 0))
  / nullif(greatest(0.0, sum(weight) over ()
  - coalesce(sum(weight) over ({order} rows between unbounded preceding and 1 preceding), 0.0)), 0), 0.0)
  as scale from a)""",
             "cut as (select min(k) as cut from b where scale * want <= 1.0)",
             """r as (select source, lang, topic, case when want = 0 then 0.0
  when cut is null or k < cut then 1.0
  else round(want * (select scale from b where k = cut.cut), 9) end as rate from b, cut)""",
             """mixed as (select d.*, r.rate, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint
  / 4503599627370496.0) < r.rate as selected from d join r on d.source is not distinct from r.source
  and d.lang is not distinct from r.lang and d.topic = r.topic)"""]
    return ",\n".join(ctes)


SQL = f"""with {mix_sql('documents')}
select doc_id, source, lang, topic, tokens, round(rate, 6) as rate, selected from mixed"""


@query("op1_mixing", SQL)
def op1_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", F.col("_topic").alias("topic"),
                            F.col("_tokens").alias("tokens"), F.round("_rate", 6).alias("rate"),
                            F.col("_selected").alias("selected"))
