"""URL filter: host/path rules first, then logistic regression on character n-grams.

Features are the hashed character 3- to 5-grams of the host (with end markers)
and of the path (every digit as 0), as counts over the square root of their number. ``train``
fits the weights by stochastic gradient descent over a small labelled table of
URLs, as one fold over its rows, ordered by URL so that the fit is repeatable.
``judge`` applies the longest rule that fits and the model elsewhere. All of it
is SQL expressions; scoring adds no shuffle.

Defined results: a null URL and one without ``://`` have an empty host and an
empty path. No rule fits an empty host and the model is not asked: the verdict
is allow. An empty labelled table gives zero weights, so the model allows all.
Repeated rows are judged alike; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.registry import query

BINS = 1024
SIZES = (3, 4, 5)
EPOCHS = 40
RATE = 3.0
DECAY = 1e-4
#: Bounds: labelled URLs (they are folded in one task) and rules (they are tried one by one).
MAX_LABELLED = 2000
MAX_RULES = 500

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: A small labelled table: 1 to block (spam, gambling, adult, pharmacy, advertising), 0 to allow.
LABELLED = [(1, u) for u in (
    "https://blog.casino-slots.example.test/en/44", "http://www.spam-post.example.test/fr/20.html",
    "https://m.ads-click.example.test/es/9", "https://free-bets.example.test/en/300",
    "http://adult-film.example.test/en/5010", "https://blog.pills-shop.example.test/en/71",
    "https://cheap-pills.example.test/fr/8/", "http://m.track-ads.example.test/en/66",
    "http://www.win-casino.example.test/es/12", "https://spam-farm.example.test/en/200",
    "http://casino-win.test/en/12", "https://www.online-casino.test/play/77", "http://free-bets.test/1",
    "https://best-bets.test/en/odds", "http://cheap-pills.test/buy/204", "https://pills-online.test/en/9",
    "http://adult-x.test/fr/88", "https://m.adult-cam.test/de/3", "http://ads-track.test/click?id=4",
    "https://blog.ads-banner.test/en/51", "http://adult.test/en/7", "http://bets.test/1", "https://casino.test/",
    "http://spam-farm.test/en/6", "https://www.spam-links.test/fr/2",
    "http://link-farm.test/en/30", "https://win-casino.test/es/14", "http://m.free-casino.test/en/1999",
    "https://track-ads.test/pixel.html", "http://poker-bets.test/de/41", "https://cheap-viagra.test/en/8",
    "http://xxx-adult.test/en/5", "https://free-pills.test/es/71", "http://sex-cam.test/en/10",
    "https://www.lottery-win.test/en/31", "http://blog.cheap-loans.test/en/17", "https://bets-win.test/fr/6",
)] + [(0, u) for u in (
    "https://blog.thing.example.test/en/44", "http://www.theren.example.test/fr/20.html",
    "https://m.thther.example.test/es/9", "https://tionsh.example.test/en/300",
    "http://garden-film.example.test/en/5010", "https://blog.book-shop.example.test/en/71",
    "https://ththan.example.test/fr/8/", "http://m.city-tram.example.test/en/66",
    "http://theres.test/en/12", "https://blog.thered.test/en/3", "https://m.theror.test/de/8.html",
    "http://therst.test/es/19", "https://blog.thernt.test/fr/40", "http://blog.cooking.test/en/2000",
    "https://www.theren.test/en/77", "http://tionsh.test/fr/1",
    "https://blog.ththth.test/de/2994", "http://m.thering.test/es/204.html", "https://ththan.test/en/9",
    "http://news.weather.test/en/88", "https://m.library.test/de/3", "http://university.test/en/4",
    "https://blog.travel.test/en/51", "http://museum.test/en/6", "https://www.recipes.test/fr/2",
    "http://garden.test/en/30", "https://history.test/es/14", "http://m.science.test/en/1999",
    "https://music.test/fr/pixel.html", "http://tionble.test/de/41", "https://health.test/en/8",
    "http://school.test/en/5", "https://thation.test/es/71", "http://cinema.test/en/10",
    "https://www.bookshop.test/en/31", "http://blog.citymap.test/en/17", "https://ththre.test/fr/6",
    "https://ththor.test/en/49123/", "http://blog.thernd.test/en/46174", "https://ththing.test/de/500",
    "https://www.sports.test/en/22", "http://m.tiontion.test/en/3665", "https://ththwh.test/es/308",
)]


def host(url: Column) -> Column:
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _grams(text: Column, tag: str) -> Column:
    """Hashed bins (0 .. BINS-1) of the character n-grams of ``text``."""
    parts = [F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)),
        lambda i, n=n: F.pmod(F.xxhash64(F.lit(tag), F.substring(text, i, F.lit(n))),
                              F.lit(BINS)).cast("int")))
        .otherwise(F.array().cast("array<int>")) for n in SIZES]
    return F.concat(*parts)


def bins(host_col: Column, path_col: Column) -> Column:
    marked = F.concat(F.lit("^"), host_col, F.lit("$"))
    return F.concat(_grams(marked, "h"),
                    _grams(F.translate(path_col, "123456789", "000000000"), "p"))


def _logit(weights: Column, b: Column) -> Column:
    total = F.aggregate(b, F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return F.get(weights, F.lit(BINS)) + F.when(F.size(b) == 0, 0.0).otherwise(
        total / F.sqrt(F.size(b).cast("double")))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "label int, url string")


def train(labelled: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """One row, one column ``weights``: BINS weights and, last, the intercept.

    ``labelled`` has ``url`` and ``label`` (1 block, 0 allow); rows with a null
    in either are left out. Raises when it holds more than MAX_LABELLED rows.
    """
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).dropna()
    if (n := rows.count()) > MAX_LABELLED:
        raise ValueError(f"{n} labelled URLs; the bound is {MAX_LABELLED}")
    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda j: F.when(
        j == BINS, F.lit(1.0)).otherwise(
            F.size(F.filter(F.col("b"), lambda x: x == j)) / F.sqrt(F.greatest(F.size("b"), F.lit(1)))))
    examples = rows.select("url", "label", bins(host(F.col("url")), path(F.col("url"))).alias("b")) \
        .select("url", "label", "b", dense.alias("x"))
    folded = examples.agg(F.array_sort(F.collect_list(
        F.struct(F.xxhash64("url").alias("k"), "url", F.col("label").cast("double").alias("y"),
                 "b", "x"))).alias("ex"))
    zero = F.array_repeat(F.lit(0.0), BINS + 1)

    def step(w, e):
        gap = F.lit(RATE) * (e["y"] - _sigmoid(_logit(w, e["b"])))
        return F.transform(F.array(gap), lambda g: F.zip_with(
            w, e["x"], lambda a, v: a * (1 - DECAY) + g * v))[0]

    passes = F.flatten(F.array_repeat(F.col("ex"), epochs))
    return folded.select(F.aggregate(passes, zero, step).alias("weights"))


def rule_of(host_col: Column, path_col: Column, rules) -> Column:
    """The longest rule that fits, as struct(n, verdict, rule); null when none does.

    Among rules of one length block wins, then the text that sorts last.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the bound is {MAX_RULES}")
    fits = [F.when(((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("n"), F.lit(v).alias("verdict"),
                            F.lit(h + p).alias("rule"))) for v, h, p in rules]
    if not fits:
        return F.lit(None).cast("struct<n:int,verdict:string,rule:string>")
    return F.array_max(F.array(*fits))


def judge(pages: DataFrame, weights: DataFrame, rules=None, url_col: str = "url",
          id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, score, verdict) for every row; score is the model's P(block)."""
    rules = RULES if rules is None else rules
    w = F.lit(weights.first()["weights"])          # BINS + 1 numbers
    parts = pages.select(F.col(id_col), host(F.col(url_col)).alias("host"),
                         path(F.col(url_col)).alias("path"))
    scored = parts.select(id_col, "host", "path",
                          rule_of(F.col("host"), F.col("path"), rules).alias("r"),
                          _sigmoid(_logit(w, bins(F.col("host"), F.col("path")))).alias("score"))
    return scored.select(
        id_col, "host", "path", F.col("r.rule").alias("rule"), "score",
        F.when(F.col("r").isNotNull(), F.col("r.verdict"))
        .when((F.col("host") != "") & (F.col("score") >= 0.5), "block")
        .otherwise("allow").alias("verdict"))


@query("op9_url_filter")
def op9_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))
