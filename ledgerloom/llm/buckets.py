"""Pairs inside buckets, checked in two passes: on signatures, then on texts.

``members`` rows say which id is in which bucket. A bucket of more than BLOCK
ids is dealt out over pairs of blocks, so no task holds a whole large bucket.
The first pass reads only signatures and names the ids that take part in a
candidate pair; only their texts are fetched. A pair that meets in several
buckets is handled in the one with the smallest number. The second pass
verifies on texts, and returns for each linked id its number of links and the
smallest id it is connected to inside the block: pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

BLOCK = 1024
#: Rows (ids in blocks, about 100 bytes each) that are broadcast at most, counted.
BROADCAST_ROWS = 500_000


def sized(members: DataFrame) -> DataFrame:
    """(bucket, id, n) of the members whose bucket has n >= 2 ids."""
    counts = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1") \
        .withColumnRenamed("bucket", "_bucket")
    return members.join(counts, F.col("bucket") == F.col("_bucket")).drop("_bucket")


def dealt(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """``members(bucket, id, n, ...)`` over block pairs (i <= j); ``slot`` is the id's block."""
    k = F.ceil(F.col("n") / block).cast("int")
    rows = members.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(11)), k).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    return rows.withColumn("i", F.least("slot", "other")).withColumn(
        "j", F.greatest("slot", "other")).drop("other", "n")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Tables that hold whole groups of sorted input, with the bounds of the groups."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        bounds = _bounds(held, keys)
        if len(bounds) > 2:
            yield held.slice(0, int(bounds[-2])), bounds[:-1]
            held = held.slice(int(bounds[-2])).combine_chunks()
    if held is not None and held.num_rows:
        yield held, _bounds(held, keys)


def _bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows + 1, dtype=bool)
    new[0] = new[-1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def earlier_buckets(cand: np.ndarray, keys: list, bucket: int) -> np.ndarray:
    """``cand`` without the pairs that also meet in a bucket with a smaller number."""
    if not cand.any():
        return cand
    earlier: dict[int, list[int]] = {}
    for m in np.flatnonzero(cand.any(0) | cand.any(1)).tolist():
        for key in keys[m]:
            if key < bucket:
                earlier.setdefault(key, []).append(m)
    for m in earlier.values():
        if len(m) > 1:
            cand[np.ix_(m, m)] = False
    return cand


TWO = np.array([[False, True], [False, False]])


def _groups(batches, kernel, texts: bool):
    for t, bounds in whole_groups(batches, ["bucket", "i", "j"]):
        cols = {c: t.column(c).to_numpy() for c in ("bucket", "i", "j", "slot")}
        ids = t.column("id").to_pylist()
        keys = t.column("keys").to_pylist() if "keys" in t.column_names else None
        sigs = t.column("sig").combine_chunks()
        width = len(sigs[0]) if len(sigs) else 0
        sigs = np.asarray(sigs.flatten()).reshape(-1, width)
        body = t.column("text") if texts else None
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if texts:       # repeated rows of one id say nothing new
                at = list({ids[x]: x for x in range(a, b)}.values())
            else:
                at = list(range(a, b))
            if len(at) < 2:
                continue
            if len(at) == 2 and hasattr(kernel, "pair"):      # most groups: no matrices
                x, y = at
                if (cols["i"][a] == cols["j"][a] or cols["slot"][x] != cols["slot"][y]) \
                        and kernel.pair(sigs[x], sigs[y], int(cols["bucket"][a])):
                    yield (int(cols["bucket"][a]), int(cols["i"][a]), int(cols["j"][a]),
                           cols["slot"], ids, at, TWO, body)
                continue
            cand = np.triu(kernel.candidates(sigs[at], int(cols["bucket"][a]),
                                             keys and [keys[x] for x in at]), 1)
            if cols["i"][a] != cols["j"][a]:
                slots = cols["slot"][at]
                cand &= slots[:, None] != slots[None, :]
            if cand.any():
                yield (int(cols["bucket"][a]), int(cols["i"][a]), int(cols["j"][a]),
                       cols["slot"], ids, at, cand, body)


def _light(kernel):
    def run(batches):
        out = []
        for bucket, i, j, slot, ids, at, cand, _ in _groups(batches, kernel, False):
            for m in np.flatnonzero(cand.any(0) | cand.any(1)).tolist():
                out.append((bucket, i, j, int(slot[at[m]]), ids[at[m]]))
            if len(out) > 20_000:
                yield _batch(out, ["bucket", "i", "j", "slot", "id"], LIGHT)
                out = []
        yield _batch(out, ["bucket", "i", "j", "slot", "id"], LIGHT)
    return run


LIGHT = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]


def _batch(rows: list[tuple], names, kinds) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _roots(linked: np.ndarray, ids: list[str]) -> list[str]:
    """The smallest id connected to each member."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(*np.nonzero(linked)):
        x, y = find(int(x)), find(int(y))
        if x != y:
            if ids[y] < ids[x]:
                x, y = y, x
            parent[y] = x
    return [ids[find(x)] for x in range(len(ids))]


def _heavy(kernel):
    def run(batches):
        out = []
        for _, _, _, _, ids, at, cand, body in _groups(batches, kernel, True):
            if cand is TWO:
                if kernel.same(body[at[0]].as_py(), body[at[1]].as_py()):
                    root = min(ids[at[0]], ids[at[1]])
                    out += [(ids[at[0]], root, 1), (ids[at[1]], root, 1)]
                continue
            low = min(at)       # taken from the group's own rows: from the whole column, each call copies it
            linked = kernel.verified(body.slice(low, max(at) + 1 - low).take(pa.array([x - low for x in at])), cand)
            if not linked.any():
                continue
            names = [ids[x] for x in at]
            degree = linked.sum(0) + linked.sum(1)
            for name, root, links in zip(names, _roots(linked, names), degree.tolist()):
                if links:
                    out.append((name, root, int(links)))
            if len(out) > 20_000:
                yield _batch(out, ["id", "root", "links"], HEAVY)
                out = []
        yield _batch(out, ["id", "root", "links"], HEAVY)
    return run


HEAVY = [pa.string(), pa.string(), pa.int64()]


def taking_part(rows: DataFrame, kernel, name: str) -> DataFrame:
    """(bucket, i, j, slot, id) of the rows in a candidate pair. Staged."""
    light = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j") \
        .mapInArrow(_light(kernel), "bucket long, i int, j int, slot int, id string")
    return stage(light, f"{name}-needed")


def linked(needed: DataFrame, info: DataFrame, fetch, kernel, name: str) -> DataFrame:
    """(id, root, links) rows, several per id, staged.

    ``needed`` comes from the first pass; ``info`` has (id, sig array<bigint>)
    and, where the kernel reads it, keys. ``fetch(rows)`` adds text to rows.
    ``kernel`` has ``candidates(sigs, bucket, keys)`` and ``verified(texts, candidates)``, and
    for groups of two may have ``pair`` (of two signatures) and ``same`` (of two texts).
    """
    n = needed.count()
    full = needed.join(info, "id")
    bodies = fetch(F.broadcast(full) if n <= BROADCAST_ROWS else full)
    heavy = bodies.select("bucket", "i", "j", "slot", "id", *[c for c in info.columns if c != "id"],
                          "text") \
        .repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j") \
        .mapInArrow(_heavy(kernel), "id string, root string, links long")
    return stage(heavy, f"{name}-links")
