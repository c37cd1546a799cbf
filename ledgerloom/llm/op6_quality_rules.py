"""Quality rules as a short-circuit cascade.

Every rule is a boolean SQL expression that is true for a text to reject.
``plan_cascade`` measures each rule's cost (time to evaluate it over a sample)
and its selectivity (the sample's rejections), then orders the rules greedily
by rejections per cost among the texts the earlier rules leave over.
``verdict`` turns the order into one ``CASE WHEN`` chain, which stops at the
first rule that rejects. The order changes the work, never the verdict: a text
is kept when no rule rejects it.

Defined results: a null text has no words; empty and blank texts have none
either, so the word-count rule rejects them. Extra columns pass through
``apply_cascade`` untouched; rows repeat as often as they come in.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.registry import query

SYMBOLS = "[#*$%&|<>]"
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Up to this many different repeated windows are looked up one by one.
FEW = 24

#: Rows of the sample that orders the rules.
SAMPLE_ROWS = 2000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(_clean(text), SPACE_CLASS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_clean(text), F.lit(SYMBOLS)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines holding a word that equal an earlier line."""
    lines = F.filter(F.split(_clean(text), "\n", -1), lambda x: F.rlike(x, F.lit(WORD_CHAR)))
    return _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_lines(text: Column) -> Column:
    return count_of(text, "\n") + 1


def n_repeat_words(text: Column) -> Column:
    return repeat_words_in(words(text))


def repeat_words_in(word_list: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text.

    Windows are 64-bit hashes. Texts whose windows are all different (a hash
    set tells) end there. In the others the hashes that occur again come from
    one sort of the plain numbers; their positions from a look at each window
    where those hashes are few, else from one sort of (hash, position) pairs.
    The words that those windows cover are added up.
    """
    def windows(w):
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(p):
        # Sorted start positions: each adds 3 words, or the gap to the next start if smaller.
        steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x,
                                                                          F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i:
                     F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"])))

    def few(h, again):
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)),
                        lambda i: i.isNotNull())

    def again(s):
        return F.array_distinct(F.filter(s, lambda x, i: F.coalesce(
            x == F.get(s, i - 1), F.lit(False))))

    def positions(h):
        return _let(_let(F.sort_array(h), again), lambda a: F.when(
            F.size(a) <= FEW, few(h, a)).otherwise(repeated(h)))

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(positions(h), covered))

    hashed = _let(word_list, windows)
    return _let(hashed, count).cast("long")


def n_upper(text: Column) -> Column:
    return F.regexp_count(_clean(text), F.lit("[A-Z]")).cast("long")


def count_of(text: Column, char: str) -> Column:
    t = _clean(text)
    return F.length(t) - F.length(F.replace(t, F.lit(char), F.lit("")))


class Measures:
    """The counts that rules use: expressions over the text, or columns that hold them already."""

    def __init__(self, text: Column, **known: Column):
        self.text, self.known = text, known

    def __getattr__(self, name: str) -> Column:
        return self.known[name] if name in self.known else globals()[name](self.text)


@dataclass(frozen=True)
class Rule:
    """``rejects(measures)`` is a boolean column: true for a text to reject, never null."""

    name: str
    rejects: object


#: Thresholds of the default rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_100_CHARS = 8
MAX_UPPER_PERCENT = 40
MAX_SHOUTS_PER_100_CHARS = 6
MAX_PIPES_PER_100_CHARS = 3
MAX_DUP_LINE_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 2, 25

DEFAULT_RULES = [
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_windows",
         lambda m: m.n_repeat_words * 100 > m.n_words * MAX_REPEAT_PERCENT),
    Rule("symbols", lambda m: m.n_symbols * 100 > m.word_chars * MAX_SYMBOLS_PER_100_CHARS),
    Rule("upper_case", lambda m: m.n_upper * 100 > m.word_chars * MAX_UPPER_PERCENT),
    Rule("shouting",
         lambda m: count_of(m.text, "!") * 100 > m.word_chars * MAX_SHOUTS_PER_100_CHARS),
    Rule("table_rows",
         lambda m: count_of(m.text, "|") * 100 > m.word_chars * MAX_PIPES_PER_100_CHARS),
    Rule("repeated_lines", lambda m: m.n_dup_lines * 100 > m.n_lines * MAX_DUP_LINE_PERCENT),
    Rule("word_length", lambda m: (m.word_chars < m.n_words * MIN_MEAN_WORD)
         | (m.word_chars > m.n_words * MAX_MEAN_WORD)),
]


def plan_cascade(docs: DataFrame, rules=None, text_col: str = "text",
                 sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Order ``rules`` by measured rejections per cost on a bounded sample.

    The sample is a Bernoulli sample of about ``sample_rows`` rows. An empty
    sample keeps the order.
    """
    rules = list(DEFAULT_RULES if rules is None else rules)
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).alias("t")).sample(share, seed=7) \
        .limit(2 * sample_rows).persist()
    m = Measures(F.col("t"))
    try:
        flags = [r.rejects(m).alias(f"r{i}") for i, r in enumerate(rules)]
        outcomes = sample.select(*flags).groupBy(*[f"r{i}" for i in range(len(rules))]).count() \
            .collect()   # one row per combination of outcomes, at most 2^rules and sample_rows
        if not outcomes:
            return rules
        cost = []
        for r in rules:
            probe = sample.agg(F.count_if(r.rejects(m)))
            t0 = time.perf_counter()
            probe.collect()
            cost.append(time.perf_counter() - t0)
    finally:
        sample.unpersist()
    order, left = [], set(range(len(rules)))
    while left:
        alive = [o for o in outcomes if not any(o[f"r{i}"] for i in order)]
        best = max(left, key=lambda i: (sum(o["count"] for o in alive if o[f"r{i}"])
                                        / max(cost[i], 1e-6), -cost[i]))
        order.append(best)
        left.remove(best)
    return [rules[i] for i in order]


def verdict(rules, measures: Measures) -> Column:
    """True when no rule rejects; evaluation stops at the first rejection."""
    chain = None
    for r in rules:
        cond = r.rejects(measures)
        chain = F.when(cond, F.lit(False)) if chain is None else chain.when(cond, F.lit(False))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def from_words(text: Column, w: Column) -> Measures:
    """Measures that take what they can from the text's list of words."""
    return Measures(text, n_words=F.size(w).cast("long"),
                    word_chars=F.length(F.array_join(w, "")).cast("long"),
                    n_repeat_words=repeat_words_in(w))


def apply_cascade(docs: DataFrame, rules=None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged."""
    text, order = F.col(text_col), plan_cascade(docs, rules, text_col)
    # Bound by _let, the words are made once; a column would be made anew in every rule.
    return docs.where(_let(words(text), lambda w: verdict(order, from_words(text, w))))


WORDS_SQL = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"


def kept_sql(source: str, text: str = "text", extra: str = "") -> str:
    """DuckDB SELECT of the base counts and the verdict for every row of ``source``."""
    big = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed,
 not (n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}
  or n_symbols * 100 > word_chars * {MAX_SYMBOLS_PER_100_CHARS}
  or up * 100 > word_chars * {MAX_UPPER_PERCENT}
  or shouts * 100 > word_chars * {MAX_SHOUTS_PER_100_CHARS}
  or pipes * 100 > word_chars * {MAX_PIPES_PER_100_CHARS}
  or n_dup_lines * 100 > n_lines * {MAX_DUP_LINE_PERCENT}
  or word_chars < n_words * {MIN_MEAN_WORD} or word_chars > n_words * {MAX_MEAN_WORD}) as kept
from (
 select *,
  cast(coalesce(list_sum([length(x) for x in w]), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines,
  cast(coalesce((select count(distinct p + d) from
    (select unnest(ps) as p from
      (select list(i) as ps from (select i, w[i] as a, w[i+1] as b, w[i+2] as c
        from (select unnest(range(1, len(w) - 1)) as i)) group by a, b, c having count(*) > 1)),
    (select unnest([0, 1, 2]) as d)), 0) as bigint) as n_repeat_words,
  length(t) - length(translate(t, '{big}', '')) as up,
  length(t) - length(replace(t, '!', '')) as shouts,
  length(t) - length(replace(t, '|', '')) as pipes
 from (
  select *, cast(len(w) as bigint) as n_words, len(string_split(t, chr(10))) as n_lines,
   [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as ln
  from (select *, {WORDS_SQL} as w from (select *{extra}, coalesce({text}, '') as t from {source}))))"""


SQL = f"""select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 base_failed, kept from ({kept_sql('documents')})"""


@query("op6_quality_rules", SQL)
def op6_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = plan_cascade(docs)
    t = F.col("text")
    w = F.col("w")
    base = docs.select("doc_id", "text", words(t).alias("w")).select(
        "doc_id", "text", F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"),
        repeat_words_in(w).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    known = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                   "n_repeat_words")}
    # The two base rules are columns already; the cascade runs on what they leave over.
    rest = [r for r in rules if r.name not in ("few_words", "repeated_windows")]
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", failed.alias("base_failed"),
                       F.when(failed, F.lit(False)).otherwise(
                           verdict(rest, Measures(t, **known))).alias("kept"))
