"""Whitening, conversation repair and best-fit packing against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import op11_whitening, op12_conversation_repair, op13_best_fit

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------- 11 whitening

def brute_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)) + 100_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x - x.mean(axis=0), values[::-1], axes[:, ::-1]


def embeddings(spark, vectors, ids=None):
    rows = [(i, v, 0) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")


def check_components(m, got, vectors, n, k):
    centred, values, axes = brute_whitening(vectors)
    assert m.n == n == len(vectors) and len(m.values) == k
    assert np.allclose(m.values, values[:k], rtol=1e-12)
    assert np.allclose(m.vectors.T @ m.vectors, np.eye(k), atol=1e-13)
    # Each vector lies in the space of the eigenvalues that equal its own.
    for j in range(k):
        same = np.abs(values - values[j]) < 1e-9 * values[0]
        assert np.linalg.norm(axes[:, same].T @ m.vectors[:, j]) == pytest.approx(1, abs=1e-12)
    want = centred @ m.vectors / np.sqrt(m.values)
    for r in got:
        assert r.whitened == pytest.approx(want[r.id, r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(int).tolist()
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in x]
    assert {(r.id, int(r.deviation)) for r in got} == set(enumerate(exact))
    assert len(got) == n * k


def test_components_match_a_dense_solver(spark):
    m = op11_whitening
    r = np.random.default_rng(1)
    steep = r.standard_normal((300, 40)) * 3.0 ** -np.arange(40) * 4
    flat = r.standard_normal((300, 64)) / 8
    twins = np.concatenate([flat[:, :20], flat[:, 20:40] * 0], axis=1)
    for vectors in (steep, flat, twins, np.repeat(flat[:9, :5], 30, axis=0)):
        vectors = vectors.astype(np.float32).tolist()
        rows, n, d = m.vectors_of(embeddings(spark, vectors))
        w = m.fit(rows, n, d)
        check_components(w, m.whiten(rows, w).collect(), vectors, len(vectors), min(d, 8))
        assert m.identity_error(rows, w) < 1e-9 and w.residual < 1e-11


def test_vectors_that_do_not_count(spark):
    m = op11_whitening
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2, 0.3], [0.3, -0.1, 0.0], [0.0, 0.0, 0.9], [0.1, 0.2, 0.3]]
    bad = [None, [], [0.1, None, 0.2], [nan, 0.0, 0.0], [0.0, inf, 0.0], [0.0, 0.0, -inf], [1.0, 2.0]]
    rows, n, d = m.vectors_of(embeddings(spark, good + bad, [None, 1, 1, 3, *range(4, 11)]))
    assert (n, d) == (4, 3) and sorted(str(r[0]) for r in rows.select("id").collect()) == ["1", "1", "3", "None"]
    w = m.fit(rows, n, d)
    assert len(w.values) == 2 and m.whiten(rows, w).count() == 8   # three points span a plane
    for few in ([], [[0.5, 0.5]], [[0.5, 0.5]] * 9):
        rows, n, d = m.vectors_of(embeddings(spark, few))
        w = m.fit(rows, n, d)
        assert m.whiten(rows, w).count() == 0 and n == len(few) and m.identity_error(rows, w) == 0
    one = [[0.5], [0.25], [1.0]]
    rows, n, d = m.vectors_of(embeddings(spark, one))
    check_components(m.fit(rows, n, d), m.whiten(rows, m.fit(rows, n, d)).collect(), one, 3, 1)


def test_deviations_beyond_64_bits(spark):
    m = op11_whitening
    vectors = [[3e12, 1.0], [-3e12, 2.0], [0.0, 0.0]]
    rows, n, d = m.vectors_of(embeddings(spark, vectors))
    check = {int(r.deviation) for r in m.whiten(rows, m.fit(rows, n, d)).collect()}
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in v] for v in vectors]
    s = [sum(c) for c in zip(*x)]
    assert check == {sum((3 * a - b) ** 2 for a, b in zip(v, s)) for v in x} and max(check) > 2 ** 63


def test_whole_embeddings_table(spark):
    got = op11_whitening.op11_whitening(spark, SF).collect()
    vectors = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()]
    centred, values, axes = brute_whitening(vectors)
    assert len(got) == 8 * len(vectors) and {r.n for r in got} == {len(vectors)}
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-9
    for r in got:
        want = abs(centred[r.vec_id] @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1]))
        assert abs(r.whitened) == pytest.approx(want, abs=1e-7)


# -------------------------------------------------------------------------------- 13 best fit

def brute_best_fit(sizes, window, limit):
    """(bin of each size, bins) with a plain list of open bins."""
    open_, where, made = [], [], 0
    for n in sizes:
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            if len(open_) == limit:
                open_.remove(min(open_, key=lambda b: b[0]))
            b = [window, made]
            open_.append(b)
            made += 1
        b[0] -= n
        where.append(window - n - b[0])
        if not b[0]:
            open_.remove(b)
    return where, made


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_bins_choose_the_best_fit(limit):
    r = random.Random(limit)
    for most in (5, 40, 100):
        sizes = [r.randint(1, most) for _ in range(600)]
        bins = op13_best_fit.Bins(100, limit)
        got = [bins.place(n)[1] for n in sizes]
        want, made = brute_best_fit(sizes, 100, limit)
        assert got == want and bins.made == made and bins.open == len(bins.left_open()) <= limit


def check_pieces(got, texts):
    """Every rule of the packing; the number of sequences."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op13_best_fit.tokenizer_path())
    want = defaultdict(int)
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024
        edges = sorted({0, *range(first, len(ids) + 1, 1024), len(ids)})
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b]), len(ids)] += 1
    have, by = defaultdict(int), defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        by[r.sequence_id].append(r)
    assert have == want
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(by)


def test_pieces_of_hard_texts(spark):
    m = op13_best_fit
    texts = [(0, None), (1, ""), (2, "a b c"), (2, "a b c"), (None, "x <|endoftext|> y"), (3, "word " * 1023),
             (4, "word " * 1022), (5, "word " * 5000), (6, "é漢🙂 " * 900), (7, "z" * 1_300_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, piece int, open int")
    for options in ({}, {"open_bins": 1, "items": 2}):
        check_pieces(m.pack(df, **options).collect(), texts)
    empty = df.where("false")
    assert m.pack(empty).count() == 0 and m.pack(empty).columns == m.pack(df).columns


def test_little_is_lost(spark):
    m = op13_best_fit
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    for options in ({}, {"items": 300}):
        got = m.pack(df, **options).collect()
        used = check_pieces(got, texts)
        least = -(-sum(r.length for r in got) // 1024)
        assert used <= 1.01 * least + 2, (used, least)


def test_alike_pieces_end(spark):
    """Pieces that fill no sequence are not carried on for ever."""
    df = spark.createDataFrame([(i, "one two three four") for i in range(3000)], "doc_id long, text string")
    got = op13_best_fit.pack(df, items=10).collect()
    assert len(got) == 3000 and len({r.sequence_id for r in got}) <= 1.1 * sum(r.length for r in got) / 1020 + 310


# ------------------------------------------------------------------------ 12 conversation repair

def brute_repair(rows):
    """Dynamic programming over whole (cost, audit, lines) triples, built from the left by pattern state."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for turn, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        f = "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(f)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(states):
        again = True
        while again:
            again = False
            for q, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    to = step.get((q, role[0]))
                    new = (cost + 2, audit + "I", lines + [f"{role}:"])
                    if to and (to not in states or new[0] < states[to][0]):
                        states[to] = new
                        again = True
        return states

    # All ways are kept per (state, cost, audit), so ties are decided on whole audits.
    ways = {("", 0, ""): []}
    bound = 3 * len(rows)

    def close(ways):
        todo = list(ways.items())
        while todo:
            (q, cost, audit), lines = todo.pop()
            for role in ("user", "assistant"):
                to = step.get((q, role[0]))
                key = (to, cost + 2, audit + "I")
                if to and key[1] <= bound and key not in ways:
                    ways[key] = lines + [f"{role}:"]
                    todo.append((key, ways[key]))
        return ways

    ways = close(ways)
    for (turn, role, text), f in zip(rows, faults):
        new = {}

        def put(key, lines):
            if key[1] <= bound:
                new.setdefault(key, lines)

        for (q, cost, audit), lines in ways.items():
            put((q, cost + 3, audit + "D"), lines)
            if f in ("blank", "duplicate"):
                continue
            more = f == "truncated"
            if role and (to := step.get((q, role[0]))):
                put((to, cost + more, audit + "K"), lines + [f"{role}:{text}"])
            for other in ("user", "assistant"):
                if to := step.get((q, other[0])):
                    put((to, cost + 2 + more, audit + "R"), lines + [f"{other}:{text}"])
        ways = close(new)
    cost, audit, lines = min((c, a, ls) for (q, c, a), ls in ways.items() if q in ("", "a"))
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        hurt = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        have = by[conv]
        if hurt == 0:
            continue
        text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
        role = "user" if hurt == 4 else role
        have += [(turn, role, text)] * (2 if hurt == 3 else 1)
    return {c: brute_repair(v) for c, v in by.items()}


def conversations():
    r = random.Random(3)
    rows = []
    for conv in [*range(90), None]:
        n = r.randint(1, 6)
        for t in range(n):
            role = r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = r.choice(["Hi.", "Yes!", "no end", "", " \n", None, "é?", "Hi.  ", "x" * 40 + "."])
            rows.append((conv, r.choice([t, t, t, t + 2, None]), role, text))
            if r.random() < 0.2:
                rows.append(rows[-1])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limit", [op12_conversation_repair.ROWS, 2])
def test_repairs_match_brute_force(spark, limit):
    """``limit`` 2 sends most conversations the way of the long ones."""
    m = op12_conversation_repair
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("extra")).withColumn("n", F.lit(1))
    got = m.repair(m.damaged(df), present_col="present", max_rows=limit).collect()
    want = brute_damage(rows)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    assert any("I" in v[6] for v in want.values()) and any("R" in v[6] for v in want.values())


def test_stretches_of_one_conversation(spark):
    """One conversation over many partitions, with hot repeated turns, against the short way."""
    r = random.Random(4)
    rows = [(7, t, r.choice(["user", "assistant", "user", "assistant", "system"]),
             r.choice([f"text {t}.", f"cut {t}", "again.", "", "same"])) for t in range(1500)] + [(7, 3, "user", "again.")] * 300
    df = spark.createDataFrame(rows, SCHEMA)
    m = op12_conversation_repair
    short = [tuple(x) for x in m.repair(df).collect()]
    long_ = [tuple(x) for x in m.repair(df, max_rows=10).collect()]
    assert short == long_ and len(short[0][-2]) >= len(rows)


def test_agenda_on_every_short_sequence():
    """Cost and audit of all sequences of up to three turns against all edit strings."""
    m = op12_conversation_repair
    kinds = [("u", ""), ("a", "truncated"), ("s", ""), ("x", ""), ("a", "blank")]
    arcs = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def ways(turns, q, spare):
        """(cost, audit) of all ways to finish from state q with at most ``spare`` insertions."""
        if not turns and q in (0, 3):
            yield 0, ""
        if spare:
            for c in "ua":
                if (q, c) in arcs:
                    for cost, audit in ways(turns, arcs[q, c], spare - 1):
                        yield cost + 2, "I" + audit
        if turns:
            (initial, fault), rest = turns[0], turns[1:]
            for cost, audit in ways(rest, q, spare):
                yield cost + 3, "D" + audit
            if fault != "blank":
                for c in "sua":
                    if (q, c) in arcs:
                        for cost, audit in ways(rest, arcs[q, c], spare):
                            more = cost + (fault == "truncated")
                            if c == initial:
                                yield more, "K" + audit
                            if c != "s":
                                yield more + 2, "R" + audit

    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert m.cheapest(list(turns)) == min(ways(list(turns), 0, 4))


def test_repair_of_nothing(spark):
    m = op12_conversation_repair
    empty = spark.createDataFrame([], SCHEMA)
    assert m.repair(m.damaged(empty), present_col="present").count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA).withColumn("present", F.lit(False))
    for limit in (5, 0):
        assert [tuple(r) for r in m.repair(gone, present_col="present", max_rows=limit).collect()] == [
            (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_whole_conversations_table(spark):
    m = op12_conversation_repair
    got = {r[0]: tuple(r)[1:] for r in m.op12_conversation_repair(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == brute_damage(rows)
