"""Toxicity: a lexicon trie met with Levenshtein automata, weighed by context.

The lexicon is learned from labelled texts: words, and word beginnings that
stand for every word starting so, whose documents are toxic far more often than
chance allows. It becomes a trie; a nondeterministic automaton walks the trie
with up to one edit (a byte put in, left out or replaced) for terms of at least
FUZZY_FROM bytes, and is made deterministic state by state as texts need it, so
a known state costs one lookup per byte. A byte-pair table that every word
within one edit of a term must pass keeps other words away from the automaton.

Each hit weighs its term's log-odds, times a context factor from the words
around it: quotation marks, reporting and negating words lower it, words of
address raise it. A text's features are its abusive weight from exact and from
misspelled hits, its quoted weight, and both per word; a logistic regression
on the labelled texts turns them into a score.

Lexicon and regression come from at most TRAIN_ROWS labelled rows; scoring
reads every whole text.

Defined results: letters are ASCII letters (case folded) and every byte beyond
ASCII; a null text counts as empty; an empty text scores as a text without
hits. Null labels and ids are left out of the fit; with no labels of both kinds
all rows score the (smoothed) share of label 1. Null ids are not held out.
Extra columns are left out; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textnp
from ledgerloom.llm.common import crc_remainder, labelled_texts, table
from ledgerloom.llm.registry import query

TRAIN_ROWS = 6_000
THRESHOLD = 0.7
MAX_TERMS = 300
PREFIXES = (4, 5, 6, 7)
MIN_PRECISION = 0.9
FUZZY_FROM = 5
CONTEXT = 5
#: Different words a worker remembers before it starts over.
CACHE_WORDS = 200_000

#: Context cues: words that report or deny what is said, and words of address.
REPORTING = ("said says wrote writes called quote quoted quoting report reported not never "
             "sagte schrieb nannte nicht zitat dit écrit citation pas dijo escribió cita no").split()
ADDRESS = "you your you're youre u ur du dich dein ihr euch tu toi vous tú te usted".split()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
WORD = np.zeros(256, dtype=bool)
WORD[128:] = True
for _c in "abcdefghijklmnopqrstuvwxyz0123456789@$'":
    WORD[ord(_c)] = True


class Automaton:
    """A trie with one-edit Levenshtein transitions, made deterministic as it is used.

    A state is a frozen set of (trie node, edits). ``match`` gives the number of
    the matched term and the edits (0 exact, 1 misspelled), or None.
    """

    def __init__(self, terms: list[tuple[bytes, bool]]):
        self.children: list[dict[int, int]] = [{}]
        self.end: dict[int, list[tuple[int, bool, bool]]] = {}
        for n, (term, open_end) in enumerate(terms):
            node = 0
            for byte in term:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                node = self.children[node][byte]
            self.end.setdefault(node, []).append((n, open_end, len(term) >= FUZZY_FROM))
        self.numbers: dict[tuple, int] = {}
        self.next: list[dict[int, int]] = []
        self.accept: list[tuple | None] = []
        self.sets: list[tuple] = []
        self.start = self._number({(0, 0)}, None)

    def _number(self, states: set, seen) -> int:
        """The state for a set of positions; ``seen`` is the best open-ended match so far."""
        closed = set(states)
        for node, edits in states:
            if edits == 0:                       # a byte left out
                closed.update((c, 1) for c in self.children[node].values())
        full = None
        for node, edits in closed:
            for n, open_end, fuzzy in self.end.get(node, ()):
                if edits == 0 or fuzzy:
                    hit = (edits, n)
                    full = hit if full is None or hit < full else full
                    if open_end and (seen is None or hit < seen):
                        seen = hit
        key = (frozenset(closed), seen)
        if key not in self.numbers:
            self.numbers[key] = len(self.next)
            self.next.append({})
            best = [h for h in (full, seen) if h is not None]
            self.accept.append(min(best) if best else None)
            self.sets.append(key)
        return self.numbers[key]

    def _step(self, state: int, byte: int) -> int:
        closed, seen = self.sets[state]
        moved = set()
        for node, edits in closed:
            child = self.children[node].get(byte)
            if child is not None:
                moved.add((child, edits))
            if edits == 0:
                moved.add((node, 1))             # a byte put in
                moved.update((c, 1) for c in self.children[node].values())
        self.next[state][byte] = to = self._number(moved, seen)
        return to

    def match(self, word: bytes):
        state, nxt = self.start, self.next
        for byte in word:
            to = nxt[state].get(byte)
            state = self._step(state, byte) if to is None else to
        return self.accept[state]


def _pair(word: bytes, at: int) -> int:
    part = word[at:at + 2]
    return (part[0] if part else 0) * 256 + (part[1] if len(part) > 1 else 0)


class Lexicon:
    """Terms with weights, and the tables that scan a block for them."""

    def __init__(self, terms: list[tuple[bytes, bool, float]]):
        self.terms = terms
        self.weights = np.array([w for _, _, w in terms], dtype=np.float64)
        self.first = np.zeros(65536, dtype=bool)
        self.third = np.zeros(65536, dtype=bool)
        for term, _, _ in terms:
            # No edit in the first two bytes: they are the term's. An edit there: the rest of the
            # term follows from byte 1, 2 or 3 on.
            self.first[_pair(term, 0)] = True
            if len(term) >= FUZZY_FROM:
                for at in (1, 2, 3):
                    self.third[_pair(term, at)] = True
        self.ready()

    def ready(self):
        self.automaton = Automaton([(t, o) for t, o, _ in self.terms])
        self.cache: dict[bytes, tuple | None] = {}

    def __getstate__(self):
        return {"terms": self.terms}

    def __setstate__(self, state):
        self.__init__(state["terms"])

    def lookup(self, word: bytes):
        if word not in self.cache:
            if len(self.cache) >= CACHE_WORDS:
                self.ready()
            self.cache[word] = self.automaton.match(word)
        return self.cache[word]


CUES = {w.encode(): -1.0 for w in REPORTING} | {w.encode(): 1.0 for w in ADDRESS}
MAX_CUE = max(map(len, CUES))
N_FEATURES = 5


def features(data, offsets, lexicon: Lexicon, powers) -> np.ndarray:
    """(texts, N_FEATURES): abusive weight by exact and misspelled hits, quoted weight, rates."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    low = LOWER[data]
    starts, ends = textnp.spans(WORD[low], offsets)
    if not len(starts) or not lexicon.terms:
        return out
    padded = np.concatenate([low, np.zeros(4, np.uint8)]).astype(np.int64)
    size = ends - starts

    def pair(at):
        a = np.where(size > at, padded[starts + at], 0)
        return a * 256 + np.where(size > at + 1, padded[starts + at + 1], 0)

    maybe = np.flatnonzero((lexicon.first[pair(0)] | lexicon.third[pair(2)]) & (size >= 3))
    raw = low.tobytes()
    hits = []
    for k in maybe.tolist():
        found = lexicon.lookup(raw[starts[k]:ends[k]])
        if found is not None:
            hits.append((k, *found))
    if not hits:
        return out
    at = np.array([h[0] for h in hits])
    edits = np.array([h[1] for h in hits])
    weight = lexicon.weights[[h[2] for h in hits]]
    owner = np.searchsorted(offsets, starts[at], side="right") - 1
    first = np.searchsorted(starts, offsets)
    # Inside quotation marks: an odd number of them earlier in the text.
    marks = np.flatnonzero(data == ord('"'))
    before = np.searchsorted(marks, starts[at]) - np.searchsorted(marks, offsets[owner])
    factor = np.where(before % 2 == 1, 0.3, 1.0)
    for k, (word, doc) in enumerate(zip(at.tolist(), owner.tolist())):
        cue = 0.0
        for m in range(max(word - CONTEXT, int(first[doc])), min(word + CONTEXT + 1,
                                                                   int(first[doc + 1]))):
            if ends[m] - starts[m] <= MAX_CUE:
                cue += CUES.get(raw[starts[m]:ends[m]], 0.0)
        factor[k] *= min(1.5, max(0.3, 1 + 0.35 * cue))
    exact = edits == 0
    abuse, quoted = weight * factor, weight * np.maximum(0, 1 - factor)
    total = [np.bincount(owner, v, n) for v in (abuse * exact, abuse * ~exact, quoted)]
    words = np.maximum(np.diff(first), 1)
    out[:] = np.stack([*(np.log1p(t) for t in total), np.sqrt(total[0] / words),
                       np.sqrt(total[1] / words)], axis=1)
    return out


def _rows(lexicon: Lexicon, keep: str, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = None
        for batch in batches:
            for i, j, data, offsets in textnp.blocks(batch.column("text")):
                x = features(data, offsets, lexicon, powers)
                yield pa.RecordBatch.from_arrays([batch.column(keep).slice(i, j - i), finish(x)],
                                                 names=[keep, "x"])
    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]),
                                    pa.array(x.reshape(-1)))


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms of ``sample(text, label)`` that mark label 1 far beyond chance.

    At most ``max_terms`` terms, those in most toxic texts first; a beginning
    stands for the longer terms it covers.
    """
    rows = sample.select("label", F.array_distinct(F.split(F.lower(F.coalesce(
        "text", F.lit(""))), r"[^\p{L}\p{N}@$']+")).alias("w"))
    size = rows.groupBy("label").count().collect()          # two rows
    n = {r["label"]: r["count"] for r in size}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon([])
    rate = toxic / (toxic + clean)
    by_word = rows.select("label", F.explode("w").alias("w")).where("w <> ''").groupBy("w").agg(
        F.sum("label").alias("pos"), F.count("*").alias("n"))
    starts = F.array(*[F.when(F.length("w") >= k, F.struct(
        F.substring("w", 1, k).alias("t"), F.lit(True).alias("open"))) for k in PREFIXES],
        F.struct(F.col("w").alias("t"), F.lit(False).alias("open")))
    terms = by_word.select("pos", "n", F.explode(starts).alias("s")).where(
        "s is not null and length(s.t) >= 4").groupBy("s.t", "s.open").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # Enough toxic texts that chance alone would give fewer than half a term in all.
    tried = terms.count()
    least = max(3, int(np.ceil(np.log(max(tried, 2) * 2) / -np.log(rate))))
    top = terms.where((F.col("pos") >= least) & (F.col("pos") >= MIN_PRECISION * F.col("n"))) \
        .orderBy(F.desc("pos"), F.length("t"), F.desc("open"), "t").limit(4 * max_terms).collect()
    chosen: list = []
    for r in sorted(top, key=lambda r: (len(r["t"]), not r["open"], r["t"])):
        if not any(c["open"] and r["t"].startswith(c["t"]) for c in chosen):
            chosen.append(r)
    chosen = sorted(chosen, key=lambda r: (-r["pos"], r["t"]))[:max_terms]

    def odds(r):
        return float(np.log((r["pos"] + 0.5) / (r["n"] - r["pos"] + 0.5) * clean / toxic))

    return Lexicon([(r["t"].encode(), bool(r["open"]), max(0.1, odds(r))) for r in chosen])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(p / (1 - p))
    if len(np.unique(y)) < 2:
        return w
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = ridge * len(y) * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - s) - penalty * w
        hess = (a * (s * (1 - s))[:, None]).T @ a + np.diag(penalty + 1e-6)
        move = np.linalg.solve(hess, grad)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS,
          modulus: int = 3, held: int = 1) -> tuple[Lexicon, np.ndarray]:
    sample = labelled_texts(docs, labels, label, rows, modulus, held).persist()
    try:
        lexicon = learn_lexicon(sample)
        got = sample.mapInArrow(_rows(lexicon, "label", _lists), "label int, x array<double>") \
            .toArrow()
    finally:
        sample.unpersist()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, N_FEATURES)
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    return lexicon, fit_logistic(x[order], y[order])


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray, id_col="doc_id",
          text_col="text") -> DataFrame:
    """(doc_id, score) for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(x):
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40))))

    return rows.mapInArrow(_rows(lexicon, "doc_id", finish),
                           f"doc_id {dict(rows.dtypes)['doc_id']}, x double") \
        .withColumnRenamed("x", "score")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon, weights = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, lexicon, weights).select(
        "doc_id", F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
