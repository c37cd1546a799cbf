"""Best-fit packing: bounded-space online best fit.

Documents arrive in batches of BATCH, the longest of a batch first; each goes into the open
sequence with the least free space that still takes it. The open sequences are stacks by free space, with one bit
per free space in a bitset: the best fit is the lowest bit at or above the document's
size. A fixed number may be open; where one more would be, the fullest closes first.
A sequence without free space closes at once.

Documents of more than ``WINDOW`` tokens are cut: a first piece of what is left
over, then whole windows, which are sequences of their own and meet no bin. No other
document is cut.

Every task packs the documents it has just encoded, so neither texts nor ids are
shuffled and no queue passes through one task. Sequences open at a task's end are
carried on: their pieces (a few numbers each) go, in the order of a hash, into tasks of ``ITEMS``
pieces, which pack them in the same way, level after level, until one task
holds all that is left. Each level is written to the shared folder, so a lost
executor repeats one task. If a level leaves more than half its pieces open
(pieces so alike that nothing fills their sequences), carrying on gains nothing, and they close there.

Defined results: a null text is empty and packs its end-of-document id alone.
Documents with equal ids, null ids and repeated rows are packed one by one. A text of any length is
encoded whole; a task holds the ids of one block (1 MB of text, or one longer text).
Extra columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textnp
from ledgerloom.llm.common import stage, table
from ledgerloom.llm.op7_packing import Encoder, ranks_path, tokenizer_path
from ledgerloom.llm.registry import query

WINDOW = 1024
END_ID = 2
#: Sequences open at once in a task.
OPEN = 1024
#: Pieces that are put in order of length as they arrive. As many as may be open: short pieces of a
#: batch then find the gaps that its long ones leave.
BATCH = OPEN
#: Carried pieces packed by one task.
ITEMS = 200_000


class Bins:
    """Open bins by free space; ``place`` gives (bin, offset) for a size."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit = window, limit
        self.mask, self.open, self.made = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        taken = stack.pop()
        if not stack:
            self.mask ^= 1 << free
        self.open -= 1
        return taken

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int) -> tuple[int, int]:
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            where = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, where = self.window, self.new()
        left = free - size
        if left:
            self.stacks[left].append(where)
            self.mask |= 1 << left
            self.open += 1
        return where, self.window - free

    def place_batch(self, sizes: list[int]) -> list[tuple[int, int]]:
        """``place`` for every size, the largest first."""
        out: list = [None] * len(sizes)
        for k in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
            out[k] = self.place(sizes[k])
        return out

    def left_open(self) -> set[int]:
        return {b for stack in self.stacks for b in stack}


def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    first = n % window if n > window else n
    return ([(0, first)] if first else []) + [(at, window) for at in range(first, n, window)]


PIECE = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
         ("open", pa.bool_()), ("order", pa.int64())]


def _first_sequence(level: int) -> int:
    """Sequences are numbered by (level, task, number in the task)."""
    from pyspark import TaskContext

    return (level << 56) + (TaskContext.get().partitionId() << 32)


def _batches(columns: list[list], still: set, id_type, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """``columns`` as record batches, telling whether a piece's sequence is ``still`` open."""
    for i in range(0, len(columns[0]), rows):
        part = [c[i:i + rows] for c in columns]
        part.insert(-1, [s in still for s in part[6]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(part, [id_type, *[t for _, t in PIECE]])],
            names=["doc_id", *[n for n, _ in PIECE]])


def _encode_and_pack(path: str, ranks: str | None, id_type, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins, base = Encoder(path, ranks), Bins(limit=limit), _first_sequence(0)
        # The pieces of open sequences wait here; those of closed ones leave now and then.
        waiting: list[list] = [[] for _ in range(9)]
        arrived: list[int] = []                              # rows of pieces without a place

        def settle() -> None:
            for k, (where, offset) in zip(arrived, bins.place_batch([waiting[3][k] for k in arrived])):
                waiting[6][k], waiting[7][k] = base + where, offset
            arrived.clear()

        for batch in batches:
            docs, rids = batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist()
            for i, j, data, offsets in textnp.blocks(batch.column("text")):
                ids, first = encoder.block(data, offsets)
                m = j - i
                at = first + np.arange(m + 1)
                every = np.full(len(ids) + m, END_ID, dtype="<u4")
                every[np.arange(len(ids)) + np.repeat(np.arange(m), np.diff(first))] = ids
                raw, at = memoryview(every).cast("B"), at.tolist()
                for k in range(m):
                    begin, n = at[k], at[k + 1] - at[k]
                    for p, (start, length) in enumerate(cuts(n)):
                        whole = length == WINDOW
                        if not whole:
                            arrived.append(len(waiting[0]))
                        crc = zlib.crc32(raw[4 * (begin + start):4 * (begin + start + length)])
                        for column, value in zip(waiting, (docs[i + k], p, start, length, crc, n,
                                                           base + bins.new() if whole else -1, 0, rids[i + k])):
                            column.append(value)
                        if len(arrived) == BATCH:
                            settle()
            if len(waiting[0]) > 1 << 17:
                settle()
                still = {base + b for b in bins.left_open()}
                gone = [s not in still for s in waiting[6]]
                yield from _batches([[v for v, g in zip(c, gone) if g] for c in waiting], set(), id_type)
                waiting = [[v for v, g in zip(c, gone) if not g] for c in waiting]
        settle()
        yield from _batches(waiting, {base + b for b in bins.left_open()}, id_type)
    return run


def _repack(id_type, level: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = Bins(limit=limit), _first_sequence(level)
        held: list[list] = [[] for _ in range(9)]
        for batch in batches:
            rows = batch.to_pydict()
            for column, name in zip(held, ["doc_id", *[n for n, _ in PIECE if n != "open"]]):
                column += rows[name]
        for k in range(0, len(held[3]), BATCH):
            placed = bins.place_batch(held[3][k:k + BATCH])
            held[6][k:k + BATCH] = [base + where for where, _ in placed]
            held[7][k:k + BATCH] = [offset for _, offset in placed]
        yield from _batches(held, {base + b for b in bins.left_open()}, id_type)
    return run


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, id_col="doc_id", text_col="text",
         open_bins: int = OPEN, items: int = ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from pyspark.sql.pandas.types import to_arrow_type

    if path is None:
        path, ranks = tokenizer_path(), ranks_path()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.monotonically_increasing_id().alias("rid"))
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, " \
             "ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, order long"
    level, before = 0, None
    packed = stage(rows.mapInArrow(_encode_and_pack(path, ranks, id_type, open_bins), schema), "packed-0")
    done = []
    while True:
        n = packed.where("open").count()
        if level and (tasks == 1 or n > before / 2):
            done.append(packed)
            break
        done.append(packed.where("not open"))
        level, before, tasks = level + 1, n, max(1, -(-n // items))
        by = [F.xxhash64("order", "piece"), F.col("order"), F.col("piece")]
        carried = packed.where("open")
        carried = carried.repartition(tasks, *by) if tasks > 1 else carried.repartition(1)
        packed = stage(carried.sortWithinPartitions(*by).mapInArrow(
            _repack(id_type, level, open_bins), schema), f"packed-{level}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("open", "order")


@query("op13_best_fit")
def op13_best_fit(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
