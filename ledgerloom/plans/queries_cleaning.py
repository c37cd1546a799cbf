"""Stage 2: parsing, type inference, gap filling, mapping and conforming.

Input is the all-text ``raw_sales`` view; NA tokens are turned into nulls
first, which is what reading the file does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.parsing import parse_datetime, parse_numeric
from ledgerloom.functions.text import clean_name_expr
from ledgerloom.functions.timeutil import normalize_utc
from ledgerloom.operators import cleaning as C
from ledgerloom.plans import sqltext as Q
from ledgerloom.plans.catalog import query
from ledgerloom.sources import fixtures as X

AS_OF = "2001-01-01"
RAW_COLS = X.RAW_DATA_COLUMNS
UPLOAD_ID = "U-raw"

# Messy headers that clean back to the raw column names.
MESSY_HEADERS = {
    "order_date": "Order Date", "product_code": "Product-Code", "category": " Category ",
    "qty": "QTY", "unit_price": "Unit Price", "stock_level": "Stock Level",
    "in_promo": "In-Promo", "sparse_note": "Sparse Note!", "mixed_code": "Mixed Code",
}

# Types the rules choose for raw_sales (checked by parse_ratios / infer_types).
RAW_TYPES = {"order_date": "timestamp_ntz", "product_code": "string", "category": "string",
             "qty": "bigint", "unit_price": "double", "stock_level": "bigint",
             "in_promo": "string", "sparse_note": "bigint", "mixed_code": "string"}


def raw(spark, sf):
    """raw_sales as read from a file: NA tokens are nulls."""
    return C.replace_na_tokens(X.raw_sales(spark, sf), RAW_COLS)


def typed(spark, sf):
    """Typed raw_sales. The source is columnar, so both passes of inference scan it."""
    return C.infer_types(raw(spark, sf), RAW_COLS)


# --- oracle building blocks ------------------------------------------------

_R_SQL = "select id, " + ", ".join(f"{Q.na(c)} as {c}" for c in RAW_COLS) + " from raw_sales"


def _typed_expr(c: str) -> str:
    t = RAW_TYPES[c]
    return {"timestamp_ntz": Q.dt(c), "bigint": Q.integer(c), "double": Q.num(c),
            "string": c}[t]


_TYPED_SQL = "select id, " + ", ".join(f"{_typed_expr(c)} as {c}" for c in RAW_COLS) + " from r"
_MODE_SQL = ("select arg_min(order_date, (-n, order_date)) as mode_value from "
             "(select order_date, count(*) as n from typed where order_date is not null group by order_date)")


def _filled_expr(c: str) -> str:
    t = RAW_TYPES[c]
    if t == "timestamp_ntz":
        return f"coalesce({c}, (select mode_value from mode))"
    if t == "bigint":
        return f"coalesce({c}, 0)"
    if t == "double":
        return f"(case when {c} is null or isnan({c}) then 0.0 else {c} end)"
    return f"coalesce({c}, '')"


_FILLED_SQL = "select id, " + ", ".join(f"{_filled_expr(c)} as {c}" for c in RAW_COLS) + " from typed"
_CLEAN_CTES = [("r", _R_SQL), ("typed", _TYPED_SQL), ("mode", _MODE_SQL), ("filled", _FILLED_SQL)]


def _with_raw(body: str, upto: str) -> str:
    names = [n for n, _ in _CLEAN_CTES]
    ctes = _CLEAN_CTES[: names.index(upto) + 1]
    return X.with_views(body, "raw_sales", ctes=ctes)


# --- queries -----------------------------------------------------------------

@query("clean_names", "select o_orderkey, o_orderpriority, "
       f"{Q.clean_name('o_orderpriority')} as clean_name from orders")
def q_clean_names(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return orders.withColumn("clean_name", clean_name_expr(F.col("o_orderpriority")))


_NUM_COLS = ["qty", "unit_price", "stock_level", "sparse_note", "mixed_code"]


@query("parse_numeric", _with_raw(
    "select id, " + ", ".join(f"{Q.num(c)} as {c}_num" for c in _NUM_COLS) + " from r", "r"))
def q_parse_numeric(spark, sf):
    r = raw(spark, sf)
    return r.select("id", *[parse_numeric(F.col(c)).alias(f"{c}_num") for c in _NUM_COLS])


def _measure_sql(i: int, c: str) -> str:
    x = Q.num(c)
    return (f"select '{c}' as column_name, {i} as ordinal, count(*) as n_rows, "
            f"count({c}) as n_nonnull, count(*) filter (where coalesce({Q.boolean_text(c)}, false)) as n_boolean, "
            f"count({x}) as n_numeric, count({Q.integer(c)}) as n_whole, "
            f"count(case when {x} is null then {Q.dt(c)} end) as n_datetime, "
            f"cast(count({x}) as double) / nullif(count(*), 0) as numeric_ratio, "
            f"cast(count(case when {x} is null then {Q.dt(c)} end) as double) / nullif(count(*), 0) "
            f"as datetime_ratio from r")


@query("parse_ratios", _with_raw(
    "\nunion all\n".join(_measure_sql(i, c) for i, c in enumerate(RAW_COLS)), "r"))
def q_parse_ratios(spark, sf):
    return C.parse_measures(raw(spark, sf), RAW_COLS)


@query("infer_types", _with_raw("select * from typed", "typed"))
def q_infer_types(spark, sf):
    return typed(spark, sf)


@query("date_mode", _with_raw("select 'order_date' as column_name, mode_value from mode", "mode"))
def q_date_mode(spark, sf):
    return C.column_modes(C.infer_types(raw(spark, sf).select("order_date"), ["order_date"]),
                          ["order_date"])


@query("fill_missing", _with_raw("select * from filled", "filled"))
def q_fill_missing(spark, sf):
    return C.fill_missing(typed(spark, sf), as_of=AS_OF, skip=["id"])


@query("clean_dataframe", _with_raw("select * from filled", "filled"))
def q_clean_dataframe(spark, sf):
    messy = X.raw_sales(spark, sf).withColumnsRenamed(MESSY_HEADERS)
    return C.clean_dataframe(C.replace_na_tokens(messy), as_of=AS_OF, keep=["id"])


_MAPPED = {c: X.RAW_MAPPING.get(c, c) for c in RAW_COLS}


@query("apply_mapping", X.with_views(
    "select id, " + ", ".join(f"{c} as {n}" for c, n in _MAPPED.items()) + " from raw_sales",
    "raw_sales"))
def q_apply_mapping(spark, sf):
    return C.apply_mapping(X.raw_sales(spark, sf), X.RAW_MAPPING)


def _cleaned(spark, sf):
    return C.clean_dataframe(raw(spark, sf), as_of=AS_OF, keep=["id"])


@query("conform_defaults", _with_raw(
    "select id, " + ", ".join(f"{c} as {n}" for c, n in _MAPPED.items())
    + ", cast(0.0 as double) as sales_revenue from filled", "filled"))
def q_conform_defaults(spark, sf):
    return C.conform_defaults(_cleaned(spark, sf), X.RAW_MAPPING, as_of=AS_OF)


@query("conform_sales", _with_raw(
    f"select id, '{UPLOAD_ID}' as upload_id, order_date as date, product_code as sku_id, "
    "cast(qty as double) as sales_quantity, cast(0.0 as double) as sales_revenue, "
    "coalesce(cast(stock_level as double), 0.0) as stock_level, category, "
    "cast(unit_price as double) as unit_price from filled", "filled"))
def q_conform_sales(spark, sf):
    conformed = C.conform_defaults(_cleaned(spark, sf), X.RAW_MAPPING, as_of=AS_OF)
    return C.conform_sales(conformed, UPLOAD_ID, id_col="id")


@query("normalize_utc", "select event_id, ts, try_cast(cast(ts as varchar) as timestamp) as ts_utc "
       "from events")
def q_normalize_utc(spark, sf):
    ev = X.table(spark, sf, "events").select("event_id", "ts")
    return ev.withColumn("ts_utc", normalize_utc(F.col("ts").cast("string")))


_UNREADABLE = {"order_date": "order_date = 'soon'", "unit_price": "unit_price = 'oops'"}
_COERCED_SQL = "\nunion all\n".join(
    f"select '{c}' as column_name, {i} as ordinal, '{RAW_TYPES[c]}' as spark_type, "
    f"count(*) filter (where {_UNREADABLE.get(c, 'false')}) as coerced_count from raw_sales"
    for i, c in enumerate(RAW_COLS))


@query("coerced_counts", X.with_views(_COERCED_SQL, "raw_sales"))
def q_coerced_counts(spark, sf):
    choices = C.choose_types(C.parse_measures(raw(spark, sf), RAW_COLS))
    return choices.select("column_name", "ordinal", "spark_type", "coerced_count")


# Stock above 32 bits, some with a fraction or no number at all.
@query("conform_big_stock", "select cast(o_orderkey as varchar) as id, 'U-big' as upload_id, "
       "cast(o_orderdate as timestamp) as date, 'SKU' || o_custkey as sku_id, 1.0::double as sales_quantity, "
       "o_totalprice as sales_revenue, case when o_orderkey % 9 = 0 then 0.0::double "
       "else (3000000000 + o_orderkey)::double end as stock_level, o_orderstatus as category, "
       "0.5::double as unit_price from orders")
def q_conform_big_stock(spark, sf):
    key = F.col("o_orderkey")
    stock = (F.when(key % 9 == 0, F.lit("none left"))
              .otherwise(F.concat((key + 3_000_000_000).cast("string"),
                                  F.when(key % 4 == 0, F.lit(".75")).otherwise(F.lit("")))))
    rows = X.table(spark, sf, "orders").select(
        key.cast("string").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        F.concat(F.lit("SKU"), F.col("o_custkey").cast("string")).alias("sku_id"),
        F.lit(1).alias("sales_quantity"), F.col("o_totalprice").alias("sales_revenue"),
        parse_numeric(stock).alias("stock_level"), F.col("o_orderstatus").alias("category"),
        F.lit(0.5).alias("unit_price"))
    return C.conform_sales(rows, "U-big", id_col="id")


# 18-digit codes: a double would merge neighbours.
@query("infer_wide_integers", "select 'code' as column_name, 'bigint' as spark_type, "
       "count(*) as n_rows, count(distinct 100000000000000000 + o_orderkey) as n_distinct, "
       "min(100000000000000000 + o_orderkey) as lowest, max(100000000000000000 + o_orderkey) as highest "
       "from orders")
def q_infer_wide_integers(spark, sf):
    orders = X.table(spark, sf, "orders").select(
        (F.col("o_orderkey").cast("bigint") + 100_000_000_000_000_000).cast("string").alias("code"))
    codes = C.infer_types(orders, ["code"])
    return codes.agg(F.count("*").alias("n_rows"), F.count_distinct("code").alias("n_distinct"),
                     F.min("code").alias("lowest"), F.max("code").alias("highest")).select(
        F.lit("code").alias("column_name"), F.lit(codes.dtypes[0][1]).alias("spark_type"),
        "n_rows", "n_distinct", "lowest", "highest")


_DAY = "date_trunc('day', l_shipdate)"
_SECONDS = "((l_orderkey * 37 + l_partkey * 11 + l_linenumber) % 86400)"


@query("parse_datetime_text", f"""select l_orderkey, l_linenumber, l_partkey, case l_orderkey % 12
 when 0 then {_DAY} + to_seconds({_SECONDS} // 60 * 60) when 1 then {_DAY} + to_seconds({_SECONDS})
 when 5 then {_DAY} + to_seconds({_SECONDS} - 7200) when 6 then {_DAY} + to_seconds({_SECONDS})
 when 8 then {_DAY} + to_seconds({_SECONDS}) + interval 250 milliseconds
 when 10 then {_DAY} + to_seconds({_SECONDS} // 60 * 60)
 when 11 then null else {_DAY} end as parsed from lineitem""")
def q_parse_datetime_text(spark, sf):
    rows = X.fact_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey",
                                                "l_shipdate"])
    d = F.col("l_shipdate")
    y, m, day = F.year(d), F.month(d), F.dayofmonth(d)
    sec = ((F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_linenumber")) % 86400)
    hour, minute, second = (F.floor(sec / 3600).cast("int"),
                            (F.floor(sec / 60) % 60).cast("int"), (sec % 60).cast("int"))
    half = F.when(hour < 12, "AM").otherwise("PM")
    twelve = (hour + 11) % 12 + 1
    name = F.element_at(F.array(*[F.lit(x) for x in (
        "January", "February", "March", "April", "May", "June", "July", "August", "September",
        "October", "November", "December")]), m)
    short = F.substring(name, 1, 3)
    us = F.format_string("%d/%d/%d", m, day, y)
    texts = [
        F.concat(us, F.format_string(" %d:%02d", hour, minute)),
        F.concat(us, F.format_string(" %d:%02d:%02d %s", twelve, minute, second, half)),
        F.format_string("%s %d, %d", name, day, y),
        F.format_string("%d-%s-%d", day, short, y),
        F.format_string("%d.%02d.%02d", y, m, day),
        F.format_string("%d-%02d-%02dT%02d:%02d:%02d+02:00", y, m, day, hour, minute, second),
        F.format_string("%d %s %d %02d:%02d:%02d", day, name, y, hour, minute, second),
        F.format_string("%d/%d/%02d", m, day, y % 100),
        F.format_string("%d-%02d-%02d %02d:%02d:%02d.25", y, m, day, hour, minute, second),
        F.when(day > 12, F.format_string("%d/%d/%d", day, m, y)).otherwise(us),
        F.format_string("%s %d, %d %d:%02d %s", short, day, y, twelve, minute, F.lower(half)),
        F.lit("not a date"),
    ]
    k = F.col("l_orderkey") % 12
    text = F.lit(None).cast("string")
    for n, t in enumerate(texts):
        text = F.when(k == n, t).otherwise(text)
    written = rows.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    return written.select("l_orderkey", "l_linenumber", "l_partkey",
                          parse_datetime(F.col("text")).alias("parsed"))
