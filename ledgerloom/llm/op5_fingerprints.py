"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its non-blank lines; each distinct paragraph has a
60-bit digest (from its MD5). A sketch of ``m`` rows per hash adds every digest
to three cells; a cell holds (count, xor of digests, xor of check sums) and
only cells in use are stored. Sketches subtract cell by cell, so the difference
of two versions holds just the paragraphs they do not share, and peeling reads
them back: a cell of count 1 or -1 whose check sum fits gives one digest, which
is taken out of its three cells, and so on. When peeling gets stuck the sketch
is built four times larger and tried again, up to twice as many rows as there
are digests; past that the exact set difference decides (never seen, it only
makes the result certain). The likeness of two texts is the Jaccard similarity
of their digest sets as the peeled difference gives it.

Everything is expressions on arrays inside one row; the digests of a document
never leave its row. ``next_in_order`` finds each document's successor by
doc_id with one shuffle, in range buckets that hold about the same number of
rows, and no global window over documents.

Defined results: a null text counts as empty; empty texts have an empty sketch
and likeness 1.0 to each other, 0.0 to any other text. Documents with null ids
come first; documents with one id are ordered by the MD5 of their texts. A
lone document is its own successor. Extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SPACES, small, table
from ledgerloom.llm.registry import query

#: Rows per hash of the stored fingerprint; a power of two, at most 2^20.
BASE = 32
HASHES = 3
ROUNDS = 40
ROWS_PER_BUCKET = 1000


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _hex_number(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("bigint")


def digests(text: Column) -> Column:
    """60-bit digests of the distinct non-blank lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                     lambda x: F.translate(x, SPACES, "") != "")
    return F.transform(F.array_distinct(lines), lambda x: _hex_number(x, 15))


def _check(key: Column) -> Column:
    return _hex_number(key.cast("string"), 8)


def _entries(keys: Column, m: Column, sign) -> Column:
    """The cells that each key adds itself to: (p, c, k, h)."""
    def of(key):
        return _let(_check(key), lambda h: F.array(*[F.struct(
            (F.shiftright(key, 20 * j).bitwiseAND(m - 1) + m * j).alias("p"),
            F.lit(sign).cast("int").alias("c") if isinstance(sign, int) else sign.alias("c"),
            key.alias("k"), h.alias("h")) for j in range(HASHES)]))
    return F.flatten(F.transform(keys, of))


def _merge(entries: Column) -> Column:
    """Add up the entries of each cell; cells that come to nothing go."""
    def cells(s, starts):
        def cell(at, j):
            run = F.slice(s, at + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - at)
            zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("k"),
                            F.lit(0).cast("bigint").alias("h"))
            return _let(F.aggregate(run, zero, lambda a, e: F.struct(
                (a["c"] + e["c"]).alias("c"), a["k"].bitwiseXOR(e["k"]).alias("k"),
                a["h"].bitwiseXOR(e["h"]).alias("h"))),
                lambda t: F.struct(F.get(s, at)["p"].alias("p"), t["c"].alias("c"),
                                   t["k"].alias("k"), t["h"].alias("h")))
        return F.filter(F.transform(starts, cell),
                        lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))

    def sorted_cells(s):
        index = F.filter(F.transform(s, lambda x, i: i), lambda i: F.coalesce(
            F.get(s, i)["p"] != F.get(s, i - 1)["p"], F.lit(True)))
        return _let(index, lambda starts: cells(s, starts))

    return _let(F.array_sort(entries), sorted_cells)


def sketch(keys: Column, m) -> Column:
    m = F.lit(m).cast("bigint") if isinstance(m, int) else m
    return _merge(_entries(keys, m, 1))


def subtract(a: Column, b: Column) -> Column:
    return _merge(F.concat(a, F.transform(b, lambda x: F.struct(
        x["p"].alias("p"), (-x["c"]).alias("c"), x["k"].alias("k"), x["h"].alias("h")))))


def _peel(diff: Column, m: Column) -> Column:
    """struct(cells, a, b): what is left over, and the digests only in either side."""
    none = F.array().cast("array<bigint>")
    start = F.struct(diff.alias("cells"), none.alias("a"), none.alias("b"),
                     F.lit(False).alias("stuck"))

    def side(found, c):
        return F.transform(F.filter(found, lambda f: f["c"] == c), lambda f: f["k"])

    def take(s, found):
        return F.when(F.size(found) == 0, F.struct(
            s["cells"].alias("cells"), s["a"].alias("a"), s["b"].alias("b"),
            F.lit(True).alias("stuck"))).otherwise(F.struct(
                _merge(F.concat(s["cells"], F.flatten(F.transform(
                    found, lambda f: _entries(F.array(f["k"]), m, -f["c"]))))).alias("cells"),
                F.concat(s["a"], side(found, 1)).alias("a"),
                F.concat(s["b"], side(found, -1)).alias("b"), F.lit(False).alias("stuck")))

    def one_round(s, _):
        pure = F.filter(s["cells"], lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        found = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"),
                                                                     x["c"].alias("c"))))
        return F.when(s["stuck"] | (F.size(s["cells"]) == 0), s).otherwise(
            _let(found, lambda f: take(s, f)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)


def difference(keys_a: Column, keys_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """struct(ok, a, b, rows): sizes of both one-sided differences, by peeling."""
    def outcome(m):
        # The stored sketches at the base size; larger ones are rebuilt. A sketch is a sum over
        # its digests, so subtracting two is adding one side's entries and taking the other's.
        diff = F.when(m == BASE, subtract(sketch_a, sketch_b)).otherwise(
            _merge(F.concat(_entries(keys_a, m, 1), _entries(keys_b, m, -1))))
        return _let(_peel(diff, m), lambda r: F.struct(
            (F.size(r["cells"]) == 0).alias("ok"), F.size(r["a"]).alias("a"),
            F.size(r["b"]).alias("b"), m.alias("rows")))

    total = F.size(keys_a) + F.size(keys_b)
    tries = F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(
        total, F.lit(1)) * 2.0 / BASE))).cast("int") + 1
    sizes = F.transform(F.sequence(F.lit(0), tries),
                        lambda i: (F.lit(BASE) * F.pow(F.lit(4.0), i)).cast("bigint"))
    first = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("a"), F.lit(0).alias("b"),
                     F.lit(0).cast("bigint").alias("rows"))
    peeled = F.aggregate(sizes, first, lambda s, m: F.when(s["ok"], s).otherwise(outcome(m)))
    exact = F.struct(F.lit(True).alias("ok"), F.size(F.array_except(keys_a, keys_b)).alias("a"),
                     F.size(F.array_except(keys_b, keys_a)).alias("b"),
                     F.lit(-1).cast("bigint").alias("rows"))
    return _let(peeled, lambda r: F.when(r["ok"], r).otherwise(exact))


def likeness(keys_a: Column, keys_b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    def of(d):
        union = F.size(keys_a) + d["b"]
        return F.when(union == 0, F.lit(1.0)).otherwise(
            (F.size(keys_a) - d["a"]) / union.cast("double"))
    return _let(difference(keys_a, keys_b, sketch_a, sketch_b), of)


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(
        ":", x["p"].cast("string"), x["c"].cast("string"), x["k"].cast("string"),
        x["h"].cast("string"))), ",")


def _bucket(docs: DataFrame, id_col: str, hash_col: str) -> Column:
    """A bucket number that grows with (id, hash), about ROWS_PER_BUCKET rows in each."""
    segments = 32
    s = docs.agg(F.count("*").alias("n"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"),
                 F.percentile_approx(id_col, [i / segments for i in range(1, segments)],
                                     1000).alias("q")).first()
    per = max(1, math.ceil((s["n"] or 0) / ROWS_PER_BUCKET / segments))
    ident, h = F.col(id_col), F.col(hash_col)
    by_hash = F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0 ** 32 * per)
    if s["lo"] is None:
        return by_hash.cast("bigint")
    bounds = sorted({s["lo"], *s["q"], s["hi"] + 1})
    edge = F.lit(bounds).cast("array<bigint>")
    seg = F.size(F.filter(edge, lambda x: x <= ident)) - 1
    lo, hi = F.get(edge, seg), F.get(edge, seg + 1)
    sub = F.least(F.lit(per - 1), F.floor((ident - lo).cast("double") * per
                                          / (hi - lo).cast("double")))
    return F.when(ident.isNull(), by_hash - per).otherwise(seg * per + sub).cast("bigint")


def next_in_order(docs: DataFrame, id_col: str, hash_col: str, carry: list[str]) -> DataFrame:
    """``docs`` plus ``next_<c>`` for each carried column, from the next row by (id, hash).

    Rows go to range buckets; each bucket also gets a copy of the first row of
    the next bucket in use (the last bucket: of the first), so every successor
    is found inside a bucket.
    """
    marked = docs.withColumn("_bucket", _bucket(docs, id_col, hash_col))
    firsts = marked.groupBy("_bucket").agg(F.min(F.struct(id_col, hash_col)).alias("k"))
    every = Window.orderBy("_bucket")        # one row per bucket
    ends = firsts.select("_bucket", "k", F.coalesce(
        F.lag("_bucket").over(every), F.max("_bucket").over(
            every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"))
    ends = ends.select(F.col("_bucket").alias("_b"), F.col(f"k.{id_col}").alias("_id"),
                       F.col(f"k.{hash_col}").alias("_h"), "to")
    n = firsts.count()
    heads = marked.join(small(ends, n), (F.col("_bucket") == F.col("_b"))
                        & F.col(id_col).eqNullSafe(F.col("_id"))
                        & (F.col(hash_col) == F.col("_h")))
    ghosts = heads.select(*[c for c in marked.columns if c != "_bucket"], F.col("to").alias("_bucket"),
                          F.lit(True).alias("_ghost"))
    rows = marked.select(*[c for c in marked.columns if c != "_bucket"], "_bucket",
                         F.lit(False).alias("_ghost")).unionByName(ghosts)
    w = Window.partitionBy("_bucket").orderBy("_ghost", F.asc_nulls_first(id_col), hash_col)
    led = rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return led.where(~F.col("_ghost")).drop("_bucket", "_ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and both likenesses.

    The edited text replaces the last half (rounded down) of the code points by
    as many first code points of the next document (or all, if it is shorter).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", "t", F.md5("t").alias("md5"))
    led = next_in_order(base, "doc_id", "md5", ["t"])
    n = F.length("t").cast("int")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half),
                      F.substring(F.col("next_t"), F.lit(1), half))
    e = led.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), "t", "next_t",
                   edited.alias("e"))
    e = e.select("doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"),
                 digests(F.col("t")).alias("kt"), digests(F.col("e")).alias("ke"),
                 digests(F.col("next_t")).alias("kn"))
    e = e.select("*", sketch(F.col("kt"), BASE).alias("st"), sketch(F.col("ke"), BASE).alias("se"),
                 sketch(F.col("kn"), BASE).alias("sn"))
    return e.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("st")).alias("fingerprint"),
                    as_text(F.col("se")).alias("edited_fingerprint"),
                    likeness(*map(F.col, ("kt", "ke", "st", "se"))).alias("near_edited"),
                    likeness(*map(F.col, ("kt", "kn", "st", "sn"))).alias("near_next"))


def _keys_sql(t: str) -> str:
    return (rf"[('0x' || substr(md5(x), 1, 15))::bigint for x in list_distinct(string_split({t}, chr(10)))"
            r" if regexp_matches(x, '[^\x20\x09-\x0D]')]")


def _print_sql(keys: str) -> str:
    cells = ", ".join(f"((k >> {20 * j}) & {BASE - 1}) + {BASE * j}" for j in range(HASHES))
    return f"""coalesce((select string_agg(concat_ws(':', p, c, x, h), ',' order by p) from (
  select p, count(*) as c, bit_xor(k) as x,
   bit_xor(('0x' || substr(md5(k::varchar), 1, 8))::bigint) as h from (
    select k, unnest([{cells}]) as p from (select unnest({keys}) as k)) group by p)), '')"""


def _jaccard_sql(a: str, b: str) -> str:
    return (f"case when len({a}) + len({b}) = 0 then 1.0 else len(list_intersect({a}, {b}))::double"
            f" / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end")


SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
o as (select *, lead(t) over w as nt, first_value(t) over w as ft from d
 window w as (order by doc_id nulls first, md5(t) rows between unbounded preceding and unbounded following)),
e as (select doc_id, t, coalesce(nt, ft) as n,
 substr(t, 1, length(t) - length(t) // 2) || substr(coalesce(nt, ft), 1, length(t) // 2) as e from o),
k as (select *, {_keys_sql('t')} as kt, {_keys_sql('e')} as ke, {_keys_sql('n')} as kn from e)
select doc_id, length(t)::bigint as n_chars, sha256(e) as edited_sha256,
 {_print_sql('kt')} as fingerprint, {_print_sql('ke')} as edited_fingerprint,
 {_jaccard_sql('kt', 'ke')} as near_edited, {_jaccard_sql('kt', 'kn')} as near_next from k"""


@query("op5_fingerprints", SQL)
def op5_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
