"""Views over the driver's test tables that stand in for the service's data.

``sales``          the conformed sales table, one row per lineitem.
``raw_sales``      a messy all-text table, as a freshly read upload would be.
``upload_events``  the upload registry's event log.

Each is a lazy DataFrame over the parquet tables, so column pruning and
filters reach the scan. ``id`` is an MD5 over the lineitem columns: unique
and computable row by row, so no global window or sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fact_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """A fact table with its columns pruned, spread over the cluster's cores
    when the files split into fewer scan tasks than that (see ``spread``)."""
    return spread(table(spark, sf_dir, name).select(*columns))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition to the default parallelism, only when the scan
    has fewer partitions than cores.

    Parquet splits at row-group boundaries, so a large file written as one row
    group scans in a single task and every narrow step after it (hashing,
    parsing, stacking) would run on one core. On a large input the scan already
    has many more partitions than cores and this returns ``df`` unchanged, so
    no shuffle is added at scale.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    # Round-robin, not hashing on columns: a projection above still prunes
    # columns through it down to the scan, which hash keys would pin.
    return df.repartition(target)


_LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
              "l_shipdate"]


def _row_hash() -> Column:
    parts = [F.col(c).cast("string") for c in _LINE_COLS]
    return F.md5(F.concat_ws("|", *parts))


def _lines_with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = fact_table(spark, sf_dir, "lineitem", _LINE_COLS)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    # part is a dimension: the planner broadcasts it when its measured size is
    # under the threshold and falls back to a sort-merge join otherwise.
    return line.join(part, line.l_partkey == part.p_partkey, "left")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conformed ``sales_data`` table (FIXTURES.md 3.1)."""
    lp = _lines_with_part(spark, sf_dir)
    qty = (F.when(F.col("l_orderkey") % 37 == 0, F.lit(0.0))
            .when(F.col("l_returnflag") == "R", -F.col("l_quantity"))
            .otherwise(F.col("l_quantity")))
    stock = (F.when(F.col("l_orderkey") % 50 == 0, F.lit(None).cast("double"))
              .otherwise((F.col("l_orderkey") % 500).cast("double")))
    return lp.select(
        _row_hash().alias("id"),
        F.concat(F.lit("U"), (F.col("l_suppkey") % 10).cast("string")).alias("upload_id"),
        F.col("l_shipdate").alias("date"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("sku_id"),
        qty.alias("sales_quantity"),
        F.col("l_extendedprice").alias("sales_revenue"),
        stock.alias("stock_level"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A messy all-text upload (FIXTURES.md 3.2): mixed date layouts, NA tokens, junk."""
    lp = _lines_with_part(spark, sf_dir)
    ok = F.col("l_orderkey")
    ship = F.col("l_shipdate")
    us_date = F.concat(F.month(ship).cast("string"), F.lit("/"), F.dayofmonth(ship).cast("string"),
                       F.lit("/"), F.year(ship).cast("string"))
    order_date = (F.when(ok % 4 == 0, us_date)
                   .when(ok % 29 == 0, F.lit("soon"))
                   .otherwise(ship.cast("date").cast("string")))
    null_text = F.lit(None).cast("string")
    return lp.select(
        _row_hash().alias("id"),
        order_date.alias("order_date"),
        F.concat(F.lit("SKU"), F.col("l_partkey").cast("string")).alias("product_code"),
        F.col("p_type").alias("category"),
        F.when(ok % 11 == 0, F.lit("N/A"))
         .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("qty"),
        F.when(ok % 13 == 0, F.lit("oops"))
         .otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("unit_price"),
        F.when(ok % 50 == 0, null_text).otherwise((ok % 500).cast("string")).alias("stock_level"),
        F.when(F.col("l_partkey") % 2 == 0, F.lit("yes")).otherwise(F.lit("no")).alias("in_promo"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string"))
         .otherwise(null_text).alias("sparse_note"),
        F.when(ok % 3 == 0, F.lit("code")).otherwise(ok.cast("string")).alias("mixed_code"),
    )


RAW_DATA_COLUMNS = ["order_date", "product_code", "category", "qty", "unit_price",
                    "stock_level", "in_promo", "sparse_note", "mixed_code"]

# Saved mapping for the raw upload, old name -> new name.
RAW_MAPPING = {"order_date": "date", "product_code": "sku_id", "qty": "sales_quantity"}


def upload_events(spark: SparkSession, sf_dir: str, extra_upload: str | None = None) -> DataFrame:
    """Registry events for the uploads seen in lineitem (FIXTURES.md 3.3).

    One ``uploaded`` event per upload; uploads with ``n % 3 == 2`` stop there,
    the rest go on to ``processing`` and then ``processed`` or ``error``.
    The per-upload event list is generated with ``explode``, not a join.
    """
    n = F.col("n")
    uploads = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("n")).distinct()
    if extra_upload is not None:
        uploads = uploads.unionByName(
            spark.range(1).select(F.lit(int(extra_upload.lstrip("U"))).cast("bigint").alias("n")))
    seq = F.col("seq")
    events = uploads.select(n, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    events = events.filter(~((n % 3 == 2) & (seq > 1)))
    status = (F.when(seq == 1, F.lit("uploaded"))
               .when(seq == 2, F.lit("processing"))
               .when(n % 5 == 4, F.lit("error"))
               .otherwise(F.lit("processed")))
    event_ts = (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
                + F.make_dt_interval(F.lit(0), n.cast("int"), seq.cast("int")))
    err = F.when((seq == 3) & (n % 5 == 4), F.lit("bad date")).otherwise(F.lit(None).cast("string"))
    return events.select(
        F.concat(F.lit("U"), n.cast("string")).alias("upload_id"),
        seq.cast("int").alias("seq"),
        status.alias("status"),
        event_ts.alias("event_ts"),
        err.alias("error_message"),
    )


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL, for the oracle (FIXTURES.md 3 with varchar text).
# ---------------------------------------------------------------------------

_ID_SQL = ("md5(concat_ws('|', cast(l_orderkey as varchar), cast(l_partkey as varchar), "
           "cast(l_suppkey as varchar), cast(l_linenumber as varchar), cast(l_quantity as varchar), "
           "cast(l_extendedprice as varchar), cast(l_discount as varchar), cast(l_tax as varchar), "
           "l_returnflag, l_linestatus, cast(l_shipdate as varchar)))")

SALES_SQL = f"""select {_ID_SQL} as id,
 concat('U', cast(l_suppkey % 10 as varchar)) as upload_id,
 l_shipdate as date,
 concat('SKU', cast(l_partkey as varchar)) as sku_id,
 case when l_orderkey % 37 = 0 then cast(0 as double) when l_returnflag = 'R' then -l_quantity else l_quantity end as sales_quantity,
 l_extendedprice as sales_revenue,
 case when l_orderkey % 50 = 0 then null else cast(l_orderkey % 500 as double) end as stock_level,
 p_type as category,
 p_retailprice as unit_price
from lineitem left join part on l_partkey = p_partkey"""

RAW_SALES_SQL = f"""select {_ID_SQL} as id,
 case when l_orderkey % 4 = 0 then concat(cast(month(l_shipdate) as varchar), '/', cast(day(l_shipdate) as varchar), '/', cast(year(l_shipdate) as varchar)) when l_orderkey % 29 = 0 then 'soon' else cast(cast(l_shipdate as date) as varchar) end as order_date,
 concat('SKU', cast(l_partkey as varchar)) as product_code,
 p_type as category,
 case when l_orderkey % 11 = 0 then 'N/A' else cast(cast(l_quantity as bigint) as varchar) end as qty,
 case when l_orderkey % 13 = 0 then 'oops' else cast(cast(p_retailprice as decimal(18,2)) as varchar) end as unit_price,
 case when l_orderkey % 50 = 0 then null else cast(l_orderkey % 500 as varchar) end as stock_level,
 case when l_partkey % 2 = 0 then 'yes' else 'no' end as in_promo,
 case when l_partkey % 3 = 0 then cast(l_partkey as varchar) else null end as sparse_note,
 case when l_orderkey % 3 = 0 then 'code' else cast(l_orderkey as varchar) end as mixed_code
from lineitem left join part on l_partkey = p_partkey"""

UPLOAD_EVENTS_SQL = """select concat('U', cast(r.n as varchar)) as upload_id, e.seq,
 case when e.seq = 1 then 'uploaded' when e.seq = 2 then 'processing' when r.n % 5 = 4 then 'error' else 'processed' end as status,
 cast('2024-01-01 00:00:00' as timestamp) + (r.n * interval '1' hour) + (e.seq * interval '1' minute) as event_ts,
 case when e.seq = 3 and r.n % 5 = 4 then 'bad date' else null end as error_message
from (select distinct l_suppkey % 10 as n from lineitem{extra}) r
 cross join (select 1 as seq union all select 2 union all select 3) e
where not (r.n % 3 = 2 and e.seq > 1)"""


def with_views(sql: str, *names: str, extra_upload: str | None = None,
               ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix an oracle query with the fixture views it reads (and any further
    named subqueries) as one WITH clause."""
    bodies = {
        "sales": SALES_SQL,
        "raw_sales": RAW_SALES_SQL,
        "upload_events": UPLOAD_EVENTS_SQL.format(
            extra="" if extra_upload is None
            else f" union select {int(extra_upload.lstrip('U'))}"),
    }
    parts = [(n, bodies[n]) for n in names] + list(ctes or [])
    text = ",\n".join(f"{n} as (\n{b}\n)" for n, b in parts)
    return f"with {text}\n{sql}"
