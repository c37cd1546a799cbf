"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents in shuffled order. A round of deficit
round-robin fills one window: it credits each queue with its share of the window's
tokens and serves the piece of the queue that the whole tokens of the credit cover;
the rest carries over. Within a window the queues lie one after the other, and the
bounds between them are the targets' running shares, rounded down after a shift that is the
same for all bounds of a window and runs through a bit-reversed sequence over
windows. So every window holds each source's share to within one token, windows are
always full, and what a queue has been served in the first r windows, deficits included, has a
closed form: which windows a document's tokens fall into follows from its place in its
queue alone, across windows and partitions, with no worker's state.

When a queue cannot fill its share of the next window, it has run dry: the others go on
in proportion among themselves. What is left of dry queues, less than a window's share of
each, comes last, with the tokens past the last full window in sequences of
falling powers of two. No sequence needs padding.

A document's place in its queue is a running sum in two steps: sums per bucket (a slice of
a queue) and a window inside each bucket, so no queue has to fit in one task. Token ids
are computed once, into a staged table, and are not shuffled; they are joined
to the places by a broadcast of the places while their counted number is
small, else by a shuffle. The driver holds a few numbers per source; the sources beyond
the QUEUES largest share one queue.

Tokenizing splits text before every space that a non-space follows (a token
never spans that point) and encodes each different piece once per worker.

Defined results: a null text is empty and packs its end-of-document id alone.
A null source is a queue of its own. Documents with equal ids, and repeated
rows, are packed one by one. A weight must be positive. A text of any length is encoded whole,
in a block of its own. Extra columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textnp
from ledgerloom.llm.common import small, stage, table, unit_hash
from ledgerloom.llm.registry import query

WINDOW = 1024
END_ID = 0
ROWS_PER_BUCKET = 20_000
QUEUES = 50_000
#: Binary places of a share of a window, and the bits of the windows' shifts.
PLACES = 24
#: Positions (24 bytes each) are broadcast up to this many, counted.
BROADCAST_ROWS = 1_000_000
BLOCK_BYTES = 1 << 20
#: Different pieces of text, and their bytes, that a worker remembers before it starts over.
CACHE_PIECES, CACHE_BYTES = 300_000, 16 << 20


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class Encoder:
    """Token ids of many texts; each different piece is encoded once.

    ``path`` is the tokenizer's file. ``ranks``, when given, names the same
    vocabulary as ranks: a faster library then encodes the blocks that hold no
    special token's text, to the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import json

        with open(path, "rb") as f:
            self.special = tuple(t["content"].encode() for t in json.load(f).get("added_tokens", []))
        self.path, self._tokenizer, self.plain = path, None, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN,
                                           mergeable_ranks=table_,
                                           special_tokens={}).encode_ordinary
        self.reset()

    @property
    def tokenizer(self):
        """Loaded when first needed: a worker that meets no special token's text never holds it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def reset(self):
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def _learn(self, pieces: list[str], plain: bool) -> None:
        if plain:
            found = list(map(self.plain, pieces))
        else:
            found = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        k, used = len(self.known), self.used
        self.start = _room(self.start, k + len(size))
        self.size = _room(self.size, k + len(size))
        self.flat = _room(self.flat, used + len(flat))
        self.flat[used:used + len(flat)] = flat
        self.size[k:k + len(size)] = size
        self.start[k:k + len(size)] = used + np.cumsum(size) - size
        self.used += len(flat)
        self.known.update(zip(pieces, range(k, k + len(size))))
        self.known_bytes += sum(map(len, pieces))

    def block(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts one after the other, first id of each text plus the total)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n, dtype=bool)
        after = data[1:]
        # Lead bytes of white space beyond ASCII are left uncut: rare, and always safe.
        cut[:-1] = (data[:-1] == 32) & ~textnp.WHITE[after] & ~np.isin(
            after, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        ends = np.zeros(n + 1, dtype=bool)
        ends[offsets] = True
        cut &= ~ends[1:]          # a space that ends its text
        cut[begins] = True
        at = np.flatnonzero(cut)
        bounds = np.append(at, n).astype(np.int64)
        arr = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds),
                                               pa.py_buffer(np.ascontiguousarray(data)))
        coded = arr.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_PIECES or self.known_bytes > CACHE_BYTES:
            self.reset()
        if new := [p for p in pieces if p not in self.known]:
            raw = data.tobytes()
            self._learn(new, self.plain is not None and not any(s in raw for s in self.special))
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[
            coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[which]
        before = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.start[which] - before[:-1], size) + np.arange(before[-1])
        return self.flat[take], before[np.searchsorted(at, offsets)]


def _tokenize(path: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        for batch in batches:
            rest = batch.select(["rid", "doc_id", "source"])
            for i, j, data, offsets in textnp.blocks(batch.column("text"), BLOCK_BYTES):
                ids, first = encoder.block(data, offsets)
                wide = np.dtype("<u2") if len(ids) == 0 or ids.max() < 65536 else np.dtype("<u4")
                part = rest.slice(i, j - i)
                # 2 bytes an id where every id of the block fits.
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), j - i,
                    [None, pa.py_buffer((first * wide.itemsize).astype(np.int64)),
                     pa.py_buffer(np.ascontiguousarray(ids.astype(wide)))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(first) + 1, pa.int64()),
                     pa.array(np.full(j - i, wide.itemsize), pa.int32()), binary],
                    names=["rid", "doc_id", "source", "n", "width", "ids"])
    return run


def tokens_of(docs: DataFrame, path: str, ranks: str | None = None, id_col="doc_id", text_col="text",
              source_col="source") -> DataFrame:
    """Staged (rid, doc_id, source, n, width, ids): n counts the closing id, ids leave it out."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return stage(rows.mapInArrow(_tokenize(path, ranks),
                                 f"rid long, doc_id {kind}, source string, n long, width int, "
                                 "ids binary"), "tokens")


ONE = 1 << PLACES
_BYTE = np.array([int(f"{x:08b}"[::-1], 2) for x in range(256)], dtype=np.int64)


def shift(r: np.ndarray) -> np.ndarray:
    """The shift of window ``r``: its number's lowest PLACES bits, reversed."""
    return _BYTE[r & 255] << 16 | _BYTE[r >> 8 & 255] << 8 | _BYTE[r >> 16 & 255]


def bound(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The sum of a window's bound ``(a + shift) / ONE``, rounded down, over the windows before ``r``."""
    least = ONE - (a & ONE - 1)             # the shifts from here on round up
    m = r & ONE - 1
    up = (r >> PLACES) * (a & ONE - 1)
    fixed = np.zeros_like(m)
    for i in range(PLACES - 1, -1, -1):
        # Windows that agree with m above bit i and have a 0 there: i bits of the shift are free.
        low = least & (1 << PLACES - i) - 1
        count = np.maximum((1 << i) - 1 - (least >> PLACES - i), -1) + (fixed >= low)
        up = up + np.where(m >> i & 1, np.maximum(count, 0), 0)
        fixed = fixed | (m >> i & 1) << PLACES - 1 - i
    return r * (a >> PLACES) + up


class Phase:
    """Windows ``first`` to ``first + windows`` with the queues that still run.

    ``low`` and ``high`` are the running shares before and behind each queue in units of
    1 / ONE token (equal for queues that do not run), ``begin`` its tokens served before.
    """

    def __init__(self, first: int, low: np.ndarray, high: np.ndarray, begin: np.ndarray):
        self.first, self.low, self.high, self.begin, self.windows = first, low, high, begin, 0

    def served(self, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Tokens of queue ``s`` in the phase's windows before ``r``."""
        return bound(self.high[s], r) - bound(self.low[s], r)

    def quota(self, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        t = shift(r)
        return (self.high[s] + t >> PLACES) - (self.low[s] + t >> PLACES)

    def window_of(self, s: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The window of the phase's ``y``-th token of queue ``s``: the last with no more than y before it."""
        share = np.maximum(self.high[s] - self.low[s], 1) / ONE
        low = np.maximum(((y - 2 * PLACES) / share).astype(np.int64), 0)
        high = ((y + 2 * PLACES) / share).astype(np.int64) + 2
        while (low + 1 < high).any():
            mid = (low + high) >> 1
            here = self.served(s, mid) <= y
            low, high = np.where(here, mid, low), np.where(here, high, mid)
        return low

    def pieces(self, s: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """(row, start in the queue, length, window, offset) of the tokens [begin, end) of queues ``s``."""
        total = self.served(s, np.full(len(s), self.windows))
        y0 = np.maximum(begin - self.begin[s], 0)
        y1 = np.minimum(end - self.begin[s], total)
        row = np.flatnonzero(y1 > y0)
        s, y0, y1 = s[row], y0[row], y1[row]
        first = self.window_of(s, y0)
        thin = self.high[s] - self.low[s] < ONE      # under a token a window: token by token
        n = np.where(thin, y1 - y0, self.window_of(s, y1 - 1) - first + 1)
        at = np.repeat(np.arange(len(row)), n)
        step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        r, start, stop = first[at] + step, y0[at] + step, y0[at] + step + 1
        each = thin[at]
        r[each] = self.window_of(s[at[each]], start[each])
        before = self.served(s, first)
        quota = self.quota(s[at], r)
        run = np.cumsum(np.where(each, 0, quota))
        ahead = np.repeat(np.append(0, run)[np.cumsum(n) - n], n)
        behind = before[at] + run - ahead            # served up to and with window r
        start = np.where(each, start, np.maximum(y0[at], behind - quota))
        stop = np.where(each, stop, np.minimum(y1[at], behind))
        inside = np.where(each, 0, start - (behind - quota))
        offset = (self.low[s[at]] + shift(r) >> PLACES) + inside
        keep = stop > start
        return row[at[keep]], (self.begin[s[at]] + start)[keep], (stop - start)[keep], r[keep] + self.first, offset[keep]


class Plan:
    """Phases, and where what is left of each queue lies behind them."""

    def __init__(self, tokens: np.ndarray, shares: np.ndarray):
        tokens = tokens.astype(np.int64)
        served, running, window = np.zeros_like(tokens), tokens > 0, 0
        self.total, self.phases = int(tokens.sum()), []
        while running.any():
            share = np.where(running, shares, 0.0)
            edge = np.concatenate([[0], np.round(np.cumsum(share) / share.sum() * WINDOW * ONE).astype(np.int64)])
            phase = Phase(window, edge[:-1], edge[1:], served.copy())
            left, every = tokens - served, np.arange(len(tokens))
            mean = (phase.high - phase.low) / ONE
            live = phase.high > phase.low
            r = int((left[live] / mean[live]).min())
            while r and (over := phase.served(every, np.full(len(tokens), r)) - left)[live].max() > 0:
                r = max(0, r - max(1, int((over[live] / mean[live]).max())))
            if r:
                phase.windows = r
                self.phases.append(phase)
                served += phase.served(every, np.full(len(tokens), r))
                window += r
            # Dry: no whole share of two more windows is left.
            running &= live & (tokens - served >= 2 * mean + 2)
        left = tokens - served
        self.tail_from, self.tail_at = served, window * WINDOW + np.cumsum(left) - left
        self.full = self.total // WINDOW
        tail, at = [], self.full * WINDOW
        for bit in range(WINDOW.bit_length() - 2, -1, -1):
            if self.total % WINDOW >> bit & 1:
                tail.append(at)
                at += 1 << bit
        self.last = np.array(tail, dtype=np.int64)

    def pieces(self, s: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Pieces of the tokens [begin, end) of queues ``s``: arrays (row, start, length, sequence, offset)."""
        out = [p.pieces(s, begin, end) for p in self.phases]
        rest = []
        for k in np.flatnonzero(end > self.tail_from[s]).tolist():
            q = int(s[k])
            x = max(int(begin[k]), int(self.tail_from[q]))
            move = int(self.tail_at[q]) - int(self.tail_from[q])
            while x < end[k]:
                pos = x + move
                if pos < self.full * WINDOW:
                    seq, off = divmod(pos, WINDOW)
                    room = WINDOW - off
                else:
                    t = int(np.searchsorted(self.last, pos, side="right")) - 1
                    seq, off = self.full + t, pos - int(self.last[t])
                    room = (int(self.last[t + 1]) if t + 1 < len(self.last) else self.total) - pos
                n = min(room, int(end[k]) - x)
                rest.append((k, x, n, seq, off))
                x += n
        out.append(tuple(np.array(rest, dtype=np.int64).reshape(-1, 5).T))
        return tuple(np.concatenate(c) for c in zip(*out))


def schedule(tokens: DataFrame, weights: dict | None = None) -> tuple[DataFrame, int, Plan]:
    """((rid, turn, end): each document's queue and the place behind it there; documents; the plan).

    ``weights`` gives the target token share of sources (missing ones share
    like the corpus); without it the targets are the corpus' own shares.
    """
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive; leave a source out by filtering its documents")
    light = tokens.select("rid", "doc_id", "source", "n")
    by_source = stage(light.groupBy("source").agg(F.sum("n").alias("s_tokens"),
                                                  F.count("*").alias("s_rows")), "sources")
    top = by_source.orderBy(F.desc("s_tokens"), "source").limit(QUEUES).collect()     # a few numbers a source
    top.sort(key=lambda r: (r.source is not None, r.source or ""))
    every = by_source.agg(F.sum("s_tokens"), F.sum("s_rows")).first()
    total, n_rows = every[0] or 0, every[1] or 0
    sizes, rows = [r.s_tokens for r in top], [r.s_rows for r in top]
    shares = [(weights or {}).get(r.source, r.s_tokens / max(1, total)) for r in top]
    if sum(sizes) < total:                               # all other sources together
        rest = total - sum(sizes)
        sizes, rows, shares = [*sizes, rest], [*rows, n_rows - sum(rows)], [*shares, rest / total]
    plan = Plan(np.array(sizes, dtype=np.int64), np.array(shares, dtype=float))
    spark = tokens.sparkSession
    queues = spark.createDataFrame([(r.source, k, max(1, -(-r.s_rows // ROWS_PER_BUCKET))) for k, r in enumerate(top)],
                                   "_s string, turn int, n_b long")
    queued = light.join(small(queues, len(top)), F.col("source").eqNullSafe(F.col("_s")), "left") \
        .withColumn("turn", F.coalesce("turn", F.lit(len(top)))) \
        .withColumn("n_b", F.coalesce("n_b", F.lit(max(1, -(-(rows[-1] if rows else 1) // ROWS_PER_BUCKET))))) \
        .withColumn("u", unit_hash(F.col("doc_id"))) \
        .withColumn("b", F.floor(F.col("u") * F.col("n_b")).cast("long")) \
        .select("rid", "n", "turn", "u", "b")
    placed = _running(queued, ["turn"], "b", ["u", "rid"], "end", n_rows)
    return placed.select("rid", "turn", "end"), n_rows, plan


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[str], out: str,
             n_rows: int) -> DataFrame:
    """``df`` plus the running sum of n by ``keys`` in (bucket, order) order, row included."""
    df = stage(df, out)
    sums = df.groupBy(*keys, bucket).agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_b"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    on = F.col(bucket) == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(small(base, base.count()), on) \
        .withColumn(out, F.col("_base") + F.sum("n").over(inside)) \
        .drop("_base", "_b", *[f"_{k}" for k in keys])


def _pieces(plan: Plan):
    """Cut documents where their queues' windows end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            turn, end, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("turn", "end", "n"))
            row, start, length, seq, off = plan.pieces(turn, end - n, end)
            order = np.lexsort([start, row])
            row, start, length, seq, off = (c[order] for c in (row, start, length, seq, off))
            start = start - (end - n)[row]
            widths, ids = batch.column("width").to_pylist(), batch.column("ids")
            crc = np.empty(len(row), dtype=np.int64)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            at, to = (4 * start).tolist(), (4 * (start + length)).tolist()
            for k in range(batch.num_rows):
                raw = np.frombuffer(ids[k].as_buffer(), dtype="<u2" if widths[k] == 2 else "<u4")
                whole = np.empty(n[k], dtype="<u4")
                whole[:-1] = raw
                whole[-1] = END_ID
                view = memoryview(whole).cast("B")
                for x in range(first[k], first[k + 1]):
                    crc[x] = zlib.crc32(view[at[x]:to[x]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, off))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, weights: dict | None = None, path: str | None = None,
         ranks: str | None = None, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if path is None:
        path, ranks = tokenizer_path(), ranks_path()
    tokens = tokens_of(docs, path, ranks, id_col, text_col, source_col)
    placed, n_rows, plan = schedule(tokens, weights)
    placed = placed.withColumnRenamed("rid", "_rid")
    kind = dict(tokens.dtypes)["doc_id"]
    rows = tokens.join(small(placed, n_rows, BROADCAST_ROWS), F.col("rid") == F.col("_rid")) \
        .select("doc_id", "n", "width", "ids", "turn", "end")
    return rows.mapInArrow(_pieces(plan), f"doc_id {kind}, start long, length long, ids_crc32 long, "
                           "doc_tokens long, sequence_id long, offset long")


@query("op7_packing")
def op7_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
