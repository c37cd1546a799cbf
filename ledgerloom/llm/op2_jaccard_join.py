"""Near-duplicate documents: a chosen-path Jaccard join on 5-word shingles.

Texts are first collapsed by equality. A text's shingle set is embedded into
``POSITIONS`` min-hash tokens. Each of ``RUNS`` runs starts a path at one token:
texts that share it meet in a bucket. A bucket larger than LIMIT is split on
``BRANCHES`` further sampled tokens, each text joining one sub-bucket per
token, level by level, until the buckets are small or a token no longer
separates them (near copies of one text); those are compared by brute force,
in blocks. A pair at similarity s meets in a run with probability s, times
``1 - (1 - s)^BRANCHES`` per split, so 8 runs miss a pair at 0.8 with
probability 3e-6, or 4e-6 after a split: the target recall is 0.9999.

Candidates share at least MIN_SHARED of the tokens; verification is exact, on
the whole texts' shingles. Connected texts form a group.

Defined results: words are runs of anything but ASCII white space; a text of
one to four words has one shingle, all its words. Null counts as empty; texts
without words are copies of each other when equal and link to nothing else.
Rows repeat as they come in; documents with equal ids stay apart by their
texts. ``class_id`` is the smallest id of the group (null if all are null).
Extra columns are left out by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import buckets, textnp
from ledgerloom.llm.buckets import earlier_buckets
from ledgerloom.llm.common import stage, table, unwrapped, wrapped
from ledgerloom.llm.graph import components
from ledgerloom.llm.registry import query

SHINGLE = 5
THRESHOLD = 0.8
RUNS = 8
POSITIONS = 24
MIN_SHARED = 9
LIMIT = buckets.BLOCK
BRANCHES = 3
DEPTH = 4
#: A split that keeps this share of a bucket together does not separate it.
DENSE = 0.5

_rng = np.random.default_rng(71)
MULTIPLIERS = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64)


def shingles_of(data, offsets, powers, size=SHINGLE):
    """Shingle hashes of a block of texts and each text's first shingle (plus the total)."""
    starts, ends, first = textnp.words(data, offsets)
    return textnp.shingles(textnp.span_hashes(data, starts, ends, powers), first, size)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textnp.Powers()
        for batch in batches:
            rest = batch.select(["doc_id", "id"])
            for i, j, data, offsets in textnp.blocks(batch.column("text")):
                h, first = shingles_of(data, offsets, powers, size)
                some = np.flatnonzero(np.diff(first))
                sig = np.zeros((j - i, POSITIONS), dtype=np.int64)
                if len(some):
                    with np.errstate(over="ignore"):
                        for p in range(POSITIONS):
                            v = h * MULTIPLIERS[p] + ADDENDS[p]
                            sig[some, p] = np.minimum.reduceat(v, first[some]).view(np.int64)
                part = rest.slice(i, j - i)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(j - i + 1, dtype=np.int32) * POSITIONS),
                    pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first), pa.int64()), lists],
                    names=["doc_id", "id", "n_shingles", "sig"])
    return run


class Kernel:
    """Candidates share tokens; verified pairs reach the Jaccard threshold exactly."""

    def __init__(self, threshold: float, size: int):
        self.threshold, self.size = threshold, size
        self.powers = textnp.Powers()          # grown once per task, on first use

    def candidates(self, sigs: np.ndarray, bucket: int, keys: list) -> np.ndarray:
        shared = np.zeros((len(sigs), len(sigs)), dtype=np.int16)
        for p in range(sigs.shape[1]):
            shared += sigs[:, p][:, None] == sigs[:, p][None, :]
        return earlier_buckets(np.triu(shared >= MIN_SHARED, 1), keys, bucket)

    def verified(self, texts, cand: np.ndarray) -> np.ndarray:
        sets = []
        for _, _, data, offsets in textnp.blocks(texts):
            h, first = shingles_of(data, offsets, self.powers, self.size)
            sets += [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        if len(sets) <= 8:
            both = np.zeros(cand.shape, dtype=np.int64)
            for x, y in zip(*np.nonzero(cand)):
                both[x, y] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        else:
            both = self._shared(sets)
        union = sizes[:, None] + sizes[None, :] - both
        return cand & (both >= self.threshold * union - 1e-9)

    @staticmethod
    def _shared(sets: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections, as products of incidence blocks."""
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        col = np.cumsum(new) - 1
        shared = (np.bincount(col) > 1)[col]
        owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        step = 4096
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            a, b = np.searchsorted(col, [at, at + step])
            m = np.zeros((len(sets), step), dtype=np.float32)
            m[owner[a:b], col[a:b] - at] = 1
            both += m @ m.T
        return np.rint(both).astype(np.int64)


def chosen_paths(sets: DataFrame) -> DataFrame:
    """(bucket, id, n): the buckets of every run, split until small or dense. Staged."""
    tokens = sets.where("n_shingles > 0").select(
        "id", F.posexplode(F.slice("sig", 1, RUNS)).alias("p", "v"))
    start = tokens.select(F.xxhash64(F.lit(0), "p", "v").alias("bucket"), "id")
    level = stage(buckets.sized(start), "paths")
    done = [level.where(F.col("n") <= LIMIT)]
    for _ in range(DEPTH):
        big = level.where(F.col("n") > LIMIT)
        if big.isEmpty():
            return _union(done)
        spare = POSITIONS - RUNS
        at = F.pmod(F.xxhash64("bucket"), F.lit(spare))
        children = big.join(sets.select("id", "sig"), "id").select(
            "bucket", "id", "n", F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(BRANCHES - 1)),
                lambda k: F.struct(k.alias("k"), F.get("sig", (RUNS + F.pmod(
                    at + k, F.lit(spare))).cast("int")).alias("v")))).alias("t"))
        children = stage(children.select("bucket", "id", "n", F.xxhash64(
            "bucket", "t.k", "t.v").alias("child")), "children")
        sizes = children.groupBy("bucket", "child").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        dense = stage(sizes.groupBy("bucket").agg(F.max("c").alias("c"), F.max("n").alias("n"))
                      .where(F.col("c") >= DENSE * F.col("n")).select("bucket"), "dense")
        done.append(big.join(dense, "bucket", "left_semi"))
        split = children.join(dense, "bucket", "left_anti") \
            .select(F.col("child").alias("bucket"), "id")
        level = stage(buckets.sized(split), "paths")
        done.append(level.where(F.col("n") <= LIMIT))
    done.append(level.where(F.col("n") > LIMIT))       # still large: blocks handle them
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("bucket", "id", "n")
    for p in parts[1:]:
        out = out.unionByName(p.select("bucket", "id", "n"))
    return stage(out, "buckets")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("id"), text.alias("text"))


def text_groups(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD,
                size=SHINGLE) -> DataFrame:
    """(id, root, class_id, n_links, n_copies) per different text; id is its MD5. Staged."""
    rows = _marked(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    sig = rows.mapInArrow(_signatures(size), f"doc_id {kind}, id string, n_shingles long, "
                          "sig array<bigint>")
    sets = stage(sig.groupBy("id").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"),
        F.max(F.struct("n_shingles", "sig")).alias("s"))
        .select("id", "rep", "n_copies", "s.n_shingles", "s.sig"), "sets")
    members = chosen_paths(sets)

    def fetch(needed: DataFrame) -> DataFrame:
        own = rows.join(needed.join(sets.select("id", "rep"), "id").select(
            *needed.columns, "rep").withColumnRenamed("id", "_id"),
            (F.col("id") == F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        return own

    keys = members.groupBy("id").agg(F.sort_array(F.collect_set("bucket")).alias("keys"))
    info = keys.join(sets.select("id", "sig"), "id")
    kernel = Kernel(threshold, size)
    rows_in = buckets.dealt(members).join(info, "id") \
        .select("bucket", "i", "j", "slot", "id", "keys", "sig")
    needed = buckets.taking_part(rows_in, kernel, "jaccard")
    found = buckets.linked(needed, info, fetch, kernel, "jaccard")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = sets.select("id", "rep", "n_copies").join(roots, "id", "left").join(
        links, "id", "left").withColumn("root", F.coalesce("root", "id"))
    low = grouped.groupBy("root").agg(F.min("rep").alias("class_id"))
    return stage(grouped.join(low, "root").select(
        "id", "root", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "groups")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD,
                    size=SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) per row of ``docs``.

    n_links counts the different texts at the threshold or above; n_copies the
    rows with exactly this text, this one included.
    """
    groups = text_groups(docs, id_col, text_col, threshold, size)
    return _marked(docs, id_col, text_col).select("doc_id", "id").join(groups, "id") \
        .select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD,
             size=SHINGLE) -> DataFrame:
    """The documents with their group's smallest id, one per group (null ids come last).

    Rows that repeat both id and text count as one document and stay as they are.
    """
    groups = text_groups(docs, id_col, text_col, threshold, size)
    holders = _marked(docs, id_col, text_col).select("doc_id", "id").join(
        groups.select("id", "root"), "id")
    keep = holders.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("n"), "doc_id", "id")).alias("k")).select(
        F.col("k.doc_id").alias("k_doc"), F.col("k.id").alias("k_id"))
    rows = wrapped(docs, doc=F.col(id_col), id=F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    on = F.col("doc").eqNullSafe(F.col("k_doc")) & (F.col("id") == F.col("k_id"))
    return unwrapped(rows.join(keep, on, "left_semi"), docs.columns)


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
