"""Fuzzy line dedup: SimHash blocks, edit similarity, one line per group.

Lines are normalised (ASCII letters to lower case, digits to 0, ASCII
punctuation and white space to single spaces). Lines with fewer than MIN_WORDS
words take no part in the fuzzy step; of those with ``exact_words`` words or more, as
every line with a word in the query and the pipeline, exact repeats go. Equal normalised
lines collapse by a 128-bit hash.

A line of n words is cut into five parts: two of n // 5 words from its start, two from its
end, and the middle. Each part has a SimHash of BITS bits: the signs of the
sums of its words' hash bits, weighted by the words' lengths. These blocks make the line's
fingerprint, and lines are joined on pairs of blocks by the pigeonhole
principle: edits in at most three of five parts leave two blocks as they are, so lines apart by any
three replaced words or letters share a pair. An inserted or lost word moves no part
before it or, counted from the end, behind it, so the outer pair of the other side
is shared (a line whose number of words is a multiple of five is also cut as if it had one
word less). A SimHash of the whole line would not do: one word of ten moves a bit of six, so
blocks wide enough to tell lines apart keep few near pairs (3 of 64 bits: a third).

Pairs in a bucket whose lengths and letter counts allow it are verified by edit
similarity (Levenshtein distance over the longer length) on the normalised lines, which
alone decides. Connected lines form a group, of which the first occurrence (by document
id, then text, then line number) stays.

Defined results: a null text stays null; a text without lines to drop stays as
it is, down to its bytes. Null ids come last. Rows that repeat both id and text
are one document and lose the same lines. Extra columns stay untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import buckets, textnp
from ledgerloom.llm.buckets import whole_groups
from ledgerloom.llm.common import small, stage, table, unwrapped, wrapped
from ledgerloom.llm.graph import components
from ledgerloom.llm.registry import query

MIN_WORDS = 5
#: Parts of a line, bits of a part's SimHash, and letter classes that are counted.
PARTS, BITS, CLASSES = 5, 32, 16
#: The pairs of blocks that lines are joined on; the first two are the outer ones.
JOINED = [(0, 1), (3, 4), (0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4)]
KEYS = len(JOINED) + 2
#: No bucket; larger than any other key, so it never comes first.
NO_KEY = 2 ** 63 - 1
MIN_EDIT = 0.9
#: Buckets with this many lines, by a sample of one line in so many, are dealt over blocks.
LARGE, SAMPLE_ONE_IN = 4096, 128
#: Rows that are broadcast at most, counted: repeated lines, and documents with lines to drop.
BROADCAST_DOCS = 200_000
#: 64-bit ids that are broadcast at most, counted.
BROADCAST_IDS = 1_000_000

_codes = np.arange(256, dtype=np.uint8)
NORMAL = _codes.copy()
NORMAL[:128] = 32
NORMAL[ord("a"):ord("z") + 1] = _codes[ord("a"):ord("z") + 1]
NORMAL[ord("A"):ord("Z") + 1] = _codes[ord("a"):ord("z") + 1]
NORMAL[ord("0"):ord("9") + 1] = ord("0")
OTHER = np.uint64(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(88)
PAIR_SEEDS = _rng.integers(1, 2**63, len(JOINED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Four bits, each in a lane of 16.
LANES = np.array([sum((x >> k & 1) << 16 * k for k in range(4)) for x in range(16)], dtype=np.uint64)
#: The class of a character by its first byte; continuation bytes are in a class behind the last.
LETTER = (np.arange(256) * 7 % CLASSES).astype(np.int8)
LETTER[128:192] = CLASSES


def normal_line(raw: bytes) -> str:
    clean = NORMAL[np.frombuffer(raw, dtype=np.uint8)].tobytes()
    return " ".join(clean.decode("utf-8", "replace").split(" ")).strip() if b"  " not in clean \
        else b" ".join(clean.split()).decode("utf-8", "replace")


def line_marks(data, offsets, powers, min_words=MIN_WORDS, fuzzy_words=MIN_WORDS):
    """(text number, line number, h1, h2, block keys, whether it has such, letter counts, characters,
    first byte in the text, bytes) of the lines with enough words."""
    clean = NORMAL[data]
    starts, ends, _ = textnp.words(clean, offsets)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    first_line = np.concatenate([[0], np.cumsum(np.diff(before) + 1)])
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first_line))
    # A line starts behind a break or with its text; its words are those before the next line's first.
    line_start = np.empty(first_line[-1], dtype=np.int64)
    line_start[first_line[:-1]] = offsets[:-1]
    later = np.ones(first_line[-1], dtype=bool)
    later[first_line[:-1]] = False
    line_start[later] = breaks + 1
    line_end = np.empty(first_line[-1], dtype=np.int64)
    line_end[first_line[1:] - 1] = offsets[1:]
    line_end[np.flatnonzero(later) - 1] = breaks
    count = np.diff(np.searchsorted(starts, np.append(line_start, len(data))))
    good = np.flatnonzero(count >= min_words)
    word_hash = textnp.span_hashes(clean, starts, ends, powers)
    up, down = powers.upto(len(word_hash) + 1)
    end = np.cumsum(count)[good]
    begin = end - count[good]
    with np.errstate(over="ignore"):
        marks = []
        for h in (word_hash, textnp.mix64(word_hash ^ OTHER)):
            total = np.zeros(len(h) + 1, dtype=np.uint64)
            np.cumsum(h * up[:len(h)], out=total[1:])
            marks.append(textnp.mix64((total[end] - total[begin]) * down[begin]).view(np.int64))
    fuzzy = count[good] >= max(fuzzy_words, PARTS)
    keys = np.zeros((len(good), KEYS), dtype=np.int64)
    keys[fuzzy] = block_keys(word_hash, ends - starts, begin[fuzzy], end[fuzzy])
    letters, chars = _letters(clean, ends - starts, count, good)
    doc = doc_of[good]
    return (doc, good - first_line[doc], *marks, keys, fuzzy, letters, chars,
            line_start[good] - offsets[doc], line_end[good] - line_start[good])


def sim_hashes(word_hash, weight, bounds) -> np.ndarray:
    """The BITS-bit SimHash of the words [bounds[:, p], bounds[:, p + 1]) of every part p.

    Four bits are summed at once, in lanes of one number; a word weighs its length, 15 at most.
    """
    sums = np.zeros((len(bounds), bounds.shape[1] - 1), dtype=np.uint64)
    if not len(bounds):
        return sums
    at = bounds.reshape(-1)
    word_hash = np.append(word_hash, np.uint64(0))
    weight = np.append(np.minimum(weight, 15), 0).astype(np.uint64)

    def total(values):
        return np.add.reduceat(values, at).reshape(bounds.shape)[:, :-1]

    half = total(weight)
    for low in range(0, BITS, 4):
        lanes = total(LANES[(word_hash >> np.uint64(low + 16) & np.uint64(15)).astype(np.intp)] * weight)
        for lane in range(4):
            positive = 2 * (lanes >> np.uint64(16 * lane) & np.uint64(0xFFFF)) > half
            sums |= positive.astype(np.uint64) << np.uint64(low + lane)
    return sums


def block_keys(word_hash, sizes, begin, end) -> np.ndarray:
    """The KEYS keys of every line: its pairs of blocks, then the outer pairs of one word less (NO_KEY
    where it has none)."""
    n = end - begin

    def cut(w):
        return np.stack([begin, begin + w, begin + 2 * w, end - 2 * w, end - w, end], axis=1)

    def key(blocks, p, w):
        i, j = JOINED[p]
        with np.errstate(over="ignore"):
            return textnp.mix64((blocks[:, i] << np.uint64(32) | blocks[:, j]) * PAIR_SEEDS[p] + w.astype(np.uint64))

    keys = np.empty((len(n), KEYS), dtype=np.uint64)
    w = n // PARTS
    less = np.flatnonzero((n % PARTS == 0) & (w > 1))
    blocks = sim_hashes(word_hash, sizes, np.concatenate([cut(w), cut(w - 1)[less]]))
    for p in range(len(JOINED)):
        keys[:, p] = key(blocks[:len(n)], p, w)
    keys[:, len(JOINED):] = NO_KEY
    for p in (0, 1):
        keys[less, len(JOINED) + p] = key(blocks[len(n):], p, w[less] - 1)
    return keys.view(np.int64)


def _letters(clean, sizes, count, good):
    """Characters per class (255 at most), and all characters, of the ``good`` ones of lines with ``count`` words.

    Words stand with one space between; spaces are not counted as letters.
    """
    kind = LETTER[clean[~textnp.WHITE[clean]]]              # the words' bytes, one word after the other
    width = CLASSES + 1                                    # the last class is left out
    line = np.repeat(np.arange(len(count)) * width, count)
    cell = np.repeat(line, sizes) + kind
    counts = np.bincount(cell, minlength=len(count) * width).reshape(-1, width)[good, :CLASSES]
    chars = counts.sum(axis=1) + np.maximum(count[good] - 1, 0)
    return np.minimum(counts, 255).astype(np.uint8), chars.astype(np.int32)


def _lines(min_words: int, exact_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textnp.Powers()
        for batch in batches:
            rest = batch.select(["doc_id", "md5"])
            for i, j, data, offsets in textnp.blocks(batch.column("text")):
                doc, no, h1, h2, keys, fuzzy, letters, chars, start, size = line_marks(
                    data, offsets, powers, min(min_words, exact_words), min_words)
                mask = pa.array(~fuzzy)
                held = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, KEYS), pa.int32()), pa.array(keys.reshape(-1)), mask=mask)
                counts = pa.Array.from_buffers(pa.binary(CLASSES), len(doc), [None, pa.py_buffer(letters.tobytes())])
                part = rest.slice(i, j - i).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(no, pa.int32()), pa.array(h1), pa.array(h2),
                     held, counts.cast(pa.binary()), pa.array(chars), pa.array(start, pa.int32()),
                     pa.array(size, pa.int32())],
                    names=["doc_id", "md5", "line_no", "h1", "h2", "keys", "letters", "chars", "start", "size"])
    return run


def _shared_start(a: str, b: str) -> int:
    """How many first characters are equal, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer.

    Equal starts and ends are cut off first; they never change the distance. A distance over ``most`` may
    come out as any other number over it: a column changes it by one, so the rest can be too short to mend it.
    """
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    a, b = a[:len(a) - end], b[:len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, int] = {}
    for k, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    plus, minus, score = full, 0, len(b)
    most += len(a)
    for done, c in enumerate(a):
        if score + done > most:
            return score + done - len(a)
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return score


class Kernel:
    """Candidates share a bucket; verified pairs reach the edit similarity.

    A pair belongs to the smallest bucket that it shares. Only connections count
    here, so pairs already connected are not measured.
    """

    def __init__(self, min_edit: float):
        self.min_edit = min_edit

    def near(self, letters_a, letters_b, chars_a, chars_b):
        """Whether lengths and letter counts allow the edit similarity: one edit changes two counts at most."""
        limit = (1 - self.min_edit) * np.maximum(chars_a, chars_b) + 1e-9
        apart = np.abs(letters_a.astype(np.int32) - letters_b).sum(axis=-1)
        return (np.abs(chars_a - chars_b) <= limit) & (apart <= 2 * limit)

    def candidates(self, sigs: np.ndarray, bucket: int, keys=None) -> np.ndarray:
        """``sigs`` hold a line's keys, its letter counts and its number of characters."""
        letters, chars = sigs[:, KEYS:KEYS + CLASSES], sigs[:, -1]
        out = np.zeros((len(sigs), len(sigs)), dtype=bool)
        for x in range(len(sigs)):
            out[x] = self.near(letters[x], letters, chars[x], chars)
        return buckets.earlier_buckets(np.triu(out, 1), sigs[:, :KEYS].tolist(), bucket)

    def pair(self, a: np.ndarray, b: np.ndarray, bucket: int) -> bool:
        return min(set(a[:KEYS].tolist()) & set(b[:KEYS].tolist())) == bucket and bool(
            self.near(a[KEYS:KEYS + CLASSES], b[KEYS:KEYS + CLASSES], a[-1], b[-1]))

    def same(self, a: str, b: str) -> bool:
        return self.alike(normal_line(a.encode()), normal_line(b.encode()))

    def verified(self, texts, cand: np.ndarray) -> np.ndarray:
        lines = [normal_line(x.encode()) for x in texts.to_pylist()]
        parent = list(range(len(lines)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = np.zeros(cand.shape, dtype=bool)
        for x, y in zip(*map(np.ndarray.tolist, np.nonzero(cand))):
            a, b = find(x), find(y)
            if a != b and self.alike(lines[x], lines[y]):
                out[x, y] = True
                parent[b] = a
        return out

    def alike(self, a: str, b: str) -> bool:
        limit = (1 - self.min_edit) * max(len(a), len(b)) + 1e-9
        if abs(len(a) - len(b)) > limit:
            return False
        start = _shared_start(a, b)
        a, b = a[start:], b[start:]
        end = _shared_start(a[::-1], b[::-1])
        a, b = a[:len(a) - end], b[:len(b) - end]
        # Upper bounds first: rewriting all of the middle, or the words in it that differ.
        if max(len(a), len(b)) <= limit:
            return True
        v, w = a.split(" "), b.split(" ")
        if len(v) == len(w) and sum(max(len(x), len(y)) for x, y in zip(v, w) if x != y) <= limit:
            return True
        # A lower bound: characters that only one side has must all be changed.
        if max(len(a), len(b)) - (Counter(a) & Counter(b)).total() > limit:
            return False
        return edit_distance(a, b, limit) <= limit

    def near_rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that are in a candidate pair of their (bucket, slot, other) group; rows come in order of ``cell``
        (the bucket, where that is null).

        Candidates have lengths that are near enough and, where rows carry them, letter counts, and
        share no smaller bucket. Looks at rows 1, 2, 3 ... apart while they share a group, so a batch of
        small groups costs a few array operations.
        """
        for t, bounds in whole_groups(batches, ["cell"]):
            names = [c for c in t.column_names if c not in ("chars", "letters", "keys")]
            col = {c: t.column(c).to_numpy() for c in (*names, "chars") if c != "bucket"}
            col["bucket"] = pc.coalesce(t.column("bucket"), t.column("cell")).to_numpy()
            letters = keys = None
            if "letters" in t.column_names:
                keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, KEYS)
                held = t.column("letters").combine_chunks().cast(pa.binary(CLASSES))
                letters = np.frombuffer(held.buffers()[1], np.uint8, len(held) * CLASSES,
                                        held.offset * CLASSES).reshape(-1, CLASSES)
            chars, bucket, slot, other = (col[c] for c in ("chars", "bucket", "slot", "other"))
            dealt = bool(slot.any() or other.any())
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            hit = np.zeros(len(chars), dtype=bool)
            at = np.arange(len(chars))
            for apart in range(1, int(np.diff(bounds).max(initial=1))):
                at = at[at + apart < len(chars)]
                at = at[group[at] == group[at + apart]]
                if not len(at):
                    break
                a, b = at, at + apart
                near = np.abs(chars[a] - chars[b]) \
                    <= (1 - self.min_edit) * np.maximum(chars[a], chars[b]) + 1e-9
                if dealt:       # the same bucket and pair of blocks; in different blocks, if there are two
                    near &= (bucket[a] == bucket[b]) & (slot[a] == other[b]) & (other[a] == slot[b])
                a, b = a[near], b[near]
                if letters is not None:
                    own = self.near(letters[a], letters[b], chars[a], chars[b])
                    a, b = a[own], b[own]
                    x, y, least = keys[a], keys[b], bucket[a][:, None]
                    first = ~((x == y) & (x < least)).any(axis=1)
                    n = len(JOINED)                  # the outer pairs of one word less meet those of the other
                    for v, w in ((x, y), (y, x)):
                        first &= ~((v[:, n:] == w[:, :2]) & (v[:, n:] < least)).any(axis=1)
                    a, b = a[first], b[first]
                hit[a] = hit[b] = True
            rows = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(col[c][rows]) for c in names], names=names)


def _where_first(*more: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "md5", "line_no", *more)


def _id() -> Column:
    return F.concat_ws(".", "h1", "h2")


def _counts() -> Column:
    """The letter counts as an array of numbers."""
    return F.transform(F.sequence(F.lit(1), F.lit(CLASSES)), lambda k: F.conv(
        F.hex(F.substring("letters", k, F.lit(1))), 16, 10).cast("bigint"))


def _near(different: DataFrame, kernel: Kernel) -> tuple[DataFrame, DataFrame]:
    """(bucket, i, j, slot, h1, h2) of the lines with a candidate in a bucket, and the rows of
    ``different`` that may be among them.

    Buckets that a sample shows to be large are dealt out over pairs of blocks; ``cell`` numbers a
    bucket or such a pair, so rows are sorted by one number. A first pass
    looks at lengths only; the lines it leaves bring their letter counts and keys.
    """
    keyed = different.select(F.explode("keys").alias("bucket"), "chars", "h1").where(F.col("bucket") != NO_KEY)
    large = stage(keyed.where(F.pmod(F.xxhash64("h1"), F.lit(SAMPLE_ONE_IN)) == 0)
                  .groupBy("bucket").agg((F.count("*") * SAMPLE_ONE_IN).alias("n"))
                  .where(F.col("n") >= LARGE).withColumnRenamed("bucket", "_bucket"), "large")
    k = F.coalesce(F.ceil(F.col("n") / buckets.BLOCK), F.lit(1)).cast("int")
    rows = keyed.join(F.broadcast(large), F.col("bucket") == F.col("_bucket"), "left") \
        .withColumn("k", k).withColumn("slot", F.pmod(F.xxhash64("h1", F.lit(7)), F.col("k")).cast("int"))
    rows = rows.select("bucket", "chars", "h1", "k", "slot", F.explode(
        F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    rows = rows.select(F.when(F.col("k") == 1, F.col("bucket")).otherwise(F.xxhash64(
        "bucket", F.least("slot", "other"), F.greatest("slot", "other"))).alias("cell"),
        F.when(F.col("k") > 1, F.col("bucket")).alias("bucket"), "slot", "other", "chars", "h1")

    def passed(rows: DataFrame, kinds: str, name: str) -> DataFrame:
        return stage(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(
            kernel.near_rows, f"cell long, bucket long, slot int, other int, {kinds}"), name)

    hits = passed(rows, "h1 long", "near-lengths")
    ids = stage(hits.select(F.col("h1").alias("_h1")).distinct(), "near-ids")
    some = stage(different.join(small(ids, ids.count(), BROADCAST_IDS), F.col("h1") == F.col("_h1"),
                                "left_semi"), "near-different")
    full = hits.join(some.select("h1", "h2", "chars", "letters", "keys"), "h1").select(
        "cell", "bucket", "slot", "other", "h1", "h2", "chars", "letters", "keys")
    return passed(full, "h1 long, h2 long", "near-lines").select(
        "bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "h1", "h2"), some


def dropped_lines(docs: DataFrame, id_col="doc_id", text_col="text", min_words=MIN_WORDS,
                  min_edit=MIN_EDIT, exact_words=MIN_WORDS) -> DataFrame:
    """(doc_id, md5, drop): per document the line numbers (from 0) to drop. Staged."""
    kernel = Kernel(min_edit)
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.md5(text_col).alias("md5"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    seen = stage(rows.mapInArrow(_lines(min_words, exact_words), f"doc_id {kind}, md5 string, line_no int, "
                                 "h1 long, h2 long, keys array<long>, letters binary, chars int, "
                                 "start int, size int"), "lines")
    different = stage(seen.groupBy("h1", "h2").agg(
        F.min(_where_first("start", "size")).alias("first"), F.any_value("keys").alias("keys"),
        F.any_value("letters").alias("letters"), F.max("chars").alias("chars"), F.count("*").alias("times")),
        "different")
    needed, some = _near(different, kernel)

    # The lines in question by document; their bytes are cut out of its text.
    at = stage(some.join(needed.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy(
        F.col("first.doc_id").alias("_doc"), F.col("first.md5").alias("_md5")).agg(
        F.collect_list(F.struct("first.start", "first.size", "h1", "h2")).alias("want")), "near-documents")
    cut = rows.join(small(at, at.count(), BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("_doc"))
                    & (F.col("md5") == F.col("_md5"))) \
        .select(F.col("text").cast("binary").alias("text"), F.explode("want").alias("w")) \
        .select(F.concat_ws(".", "w.h1", "w.h2").alias("id"), F.substring(
            "text", F.col("w.start") + 1, F.col("w.size")).cast("string").alias("text"))

    def fetch(full: DataFrame) -> DataFrame:
        return cut.join(full, "id")

    found = buckets.linked(needed.withColumn("id", _id()).drop("h1", "h2"),
                           some.select(_id().alias("id"), F.concat("keys", _counts(), F.array(
                               F.col("chars").cast("bigint"))).alias("sig")),
                           fetch, kernel, "lines")
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # Groups of several lines keep their first occurrence; a line alone matters when it repeats.
    first = F.col("first").dropFields("start", "size").alias("first")
    grouped = some.join(roots, _id() == F.col("id")).select("h1", "h2", first, "root")
    keep = grouped.groupBy("root").agg(F.min("first").alias("keep")).withColumnRenamed("root", "_root")
    alone = different.where("times > 1").join(roots, _id() == F.col("id"), "left_anti") \
        .select("h1", "h2", first.alias("keep"))
    many = grouped.join(keep, F.col("root") == F.col("_root")).select("h1", "h2", "keep")
    repeated = stage(alone.unionByName(many).withColumnsRenamed({"h1": "_h1", "h2": "_h2"}),
                     "repeated")
    n = repeated.count()
    gone = seen.join(small(repeated, n, BROADCAST_DOCS),
                     (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(
        _where_first() != F.col("keep"))
    return stage(gone.groupBy("doc_id", "md5").agg(
        F.sort_array(F.collect_set("line_no")).alias("drop")), "dropped")


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", lines_col="_lines",
                    dropped_col="_dropped", **params) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus the numbers of lines and of
    dropped lines."""
    drops = dropped_lines(docs, id_col, text_col, **params)
    n = drops.count()
    rows = wrapped(docs, doc=F.col(id_col), md5=F.md5(text_col), text=F.col(text_col))
    drops = drops.withColumnsRenamed({"doc_id": "d_doc", "md5": "d_md5"})
    on = F.col("doc").eqNullSafe(F.col("d_doc")) & (F.col("md5") == F.col("d_md5"))
    joined = rows.join(small(drops, n, BROADCAST_DOCS), on, "left")
    lines = F.split("text", "\n", -1)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    return unwrapped(joined, docs.columns, **{
        text_col: text, lines_col: F.coalesce(breaks + 1, F.lit(0)),
        dropped_col: F.coalesce(F.size("drop"), F.lit(0))})


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_words=1)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"),
                      F.col("_dropped").cast("long").alias("n_dropped"), "text")
