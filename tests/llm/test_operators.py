"""Each operator against brute force, and on the cases that break things."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (
    buckets,
    op1_mixing,
    op2_jaccard_join,
    op3_substring_dedup,
    op4_toxicity,
    op5_fingerprints,
    op6_quality_rules,
    op7_packing,
    op8_line_dedup,
    op9_url_filter,
    op10_quality_gam,
    textnp,
)
from ledgerloom.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randint(2, 9)))
              for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    words = [r.choice(VOCABULARY) for _ in range(n)]
    lines = [" ".join(words[i:i + 12]) for i in range(0, n, 12)]
    return "\n".join(lines)


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = r.choice(VOCABULARY)
    return " ".join(words)


BASE = prose(300, 1)
SHARED = prose(80, 2).replace("\n", " ")
#: Nulls, empty, blank, one word, repeats, ties, near copies, a shared passage, a long text.
TEXTS = [None, "", " \t\n", "word", "one two three", BASE, BASE, edited(BASE, 3, 4), edited(BASE, 4, 6),
         prose(200, 5) + "\n" + SHARED + "\n" + prose(100, 6), prose(120, 7) + "\n" + SHARED,
         "SHOUT!! AGAIN!! " * 60, "a*** b### " * 80, ("the same line of words here\n" * 30),
         "x | y | z | " * 40, prose(9000, 8), 'quo"ted, text\nwith é and 漢字 and 🙂 signs ' + prose(60, 9)]
TEXTS += [prose(60 + 7 * i, 100 + i) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t) if t else 0,
             "x", i, "drop", 1.0, None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, BASE, None, None, 0, "x", 0, "", 1.0, None),
             (None, None, None, None, None, None, None, None, None, None),
             (3, prose(70, 50), "en", "s1", 5, "", 1, "", 2.0, None)]
    # Extra columns whose names the operators use themselves.
    schema = ("doc_id long, text string, lang string, source string, n_chars long, id string, "
              "_selected int, `drop` string, rate double, `a.b` string")
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def order(key):
    return (key is not None, key or 0)


# ---------------------------------------------------------------------------------- kernels

def test_words_and_hashes_of_blocks():
    col = [t or "" for t in TEXTS] + ["a\x1cb\u00a0c d"]
    for size in (64, 1 << 20):
        got, seen = [], {}
        powers = textnp.Powers()
        import pyarrow as pa
        for _, _, data, offsets in textnp.blocks(pa.array(col), size):
            s, e, first = textnp.words(data, offsets)
            h = textnp.span_hashes(data, s, e, powers).tolist()
            raw = data.tobytes()
            for k in range(len(offsets) - 1):
                words = [raw[s[x]:e[x]].decode() for x in range(first[k], first[k + 1])]
                got.append(words)
                for w, x in zip(words, h[first[k]:first[k + 1]]):
                    assert seen.setdefault(w, x) == x
        assert got == [WORD.findall(t) for t in col]
        assert len(set(seen.values())) == len(seen)


def test_connected_groups(spark):
    r = random.Random(1)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(40)] \
        + [(f"m{r.randrange(30)}", f"m{r.randrange(30)}") for _ in range(25)] + [("z", "z"), (None, "q")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for x in list(parent)}
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r.id: r.root for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------------- 1 mixing

def brute_rates(cells, dims, budget):
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items()}
    for _ in range(op1_mixing.ROUNDS):
        for d, name in enumerate(dims):
            share = Counter()
            for c, t in cells.items():
                share[c[d]] += t
            raw = {k: (v / total) ** op1_mixing.TEMPERATURE[name] if v else 0 for k, v in share.items()}
            now = Counter()
            for c, w in weight.items():
                now[c[d]] += w
            for c in weight:
                if now[c[d]]:
                    weight[c] *= raw[c[d]] / sum(raw.values()) / now[c[d]]
    want = {c: weight[c] / cells[c] if cells[c] else 0 for c in cells}
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(t * min(1, mid * want[c]) for c, t in cells.items()) < budget * total:
            lo = mid
        else:
            hi = mid
    return {c: min(1, lo * want[c]) for c in cells}


def test_mixing_rates_and_selection(spark, docs, empty):
    out = op1_mixing.mix(docs, out=("t", "n", "p", "s")).collect()
    assert len(out) == docs.count()
    cells = Counter()
    for r in out:
        assert r.n == math.ceil(len((r.text or "").encode()) / 4)
        cells[r.source, r.lang, r.t] += r.n
    want = brute_rates(cells, ["source", "lang", "topic"], op1_mixing.BUDGET)
    for r in out:
        assert r.p == pytest.approx(want[r.source, r.lang, r.t], abs=1e-6)
        u = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:13], 16) / 16 ** 13
        assert r.s == (u < r.p)
    assert out[0].__fields__[:len(docs.columns)] == docs.columns
    assert op1_mixing.mix(empty, out=("t", "n", "p", "s")).count() == 0
    fixed = op1_mixing.cell_rates(
        spark.createDataFrame([("a", "x", "p", 90), ("b", "x", "p", 10)],
                              "source string, lang string, topic string, tokens long"),
        ["source", "lang", "topic"], "tokens", {"source": {"a": 1, "b": 1}, "lang": 1.0, "topic": 1.0},
        budget=0.2)[0]
    assert {r.source: round(r.rate, 6) for r in fixed.collect()} == {"a": round(10 / 90, 6), "b": 1.0}


# ------------------------------------------------------------------------ 2 n-gram Jaccard join

def shingle_set(text, n=5):
    w = WORD.findall(text or "")
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i:i + n]) for i in range(len(w) - n + 1)))


def brute_near(rows, threshold=0.8):
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    names = list(texts)
    sets = [shingle_set(t) for t in names]
    parent, links = list(range(len(names))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(names)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                links[x] += 1
                links[y] += 1
                parent[find(x)] = find(y)
    low = {}
    for x, t in enumerate(names):
        ids = [i for i in texts[t] if i is not None]
        low[find(x)] = min(ids + [low[find(x)]] if low.get(find(x)) is not None else ids, default=None)
    return Counter((i, low[find(x)], links[x], len(texts[t])) for x, t in enumerate(names) for i in texts[t])


def test_near_duplicates_match_brute_force(docs, empty):
    got = op2_jaccard_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_near(pairs(docs))
    assert op2_jaccard_join.near_duplicates(empty).count() == 0


def test_keep_one_leaves_one_of_each_group(docs, empty):
    kept = op2_jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = Counter()
    for (i, c, _, _), n in brute_near([(r[0], r[1]) for r in pairs(docs)]).items():
        groups[c] += 1
    ids = [r.doc_id for r in kept.select("doc_id").distinct().collect()]
    assert 5 in ids and not {6, 7, 8} & set(ids) and 1 not in ids[:0]
    assert sorted(set(ids), key=order) == sorted({c for c in groups}, key=order)
    assert op2_jaccard_join.keep_one(empty).count() == 0


def test_large_buckets_split_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op2_jaccard_join, "LIMIT", 6)
    monkeypatch.setattr(buckets, "BLOCK", 4)
    monkeypatch.setattr(buckets.dealt, "__defaults__", (4,))
    rows = [(i, edited(BASE, 1000 + i, 3)) for i in range(30)]
    rows += [(100 + i, BASE + "\n" + prose(900, 2000 + i)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op2_jaccard_join.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == brute_near(rows)


# ---------------------------------------------------------------------------- 3 substring dedup

def test_compact_windows_cover_every_subsequence_once():
    h = np.random.default_rng(0).integers(0, 40, 200, dtype=np.uint64) << np.uint64(24)   # with ties
    begin = np.array([0, 90, 90, 97, 200])
    cover = Counter()
    for l, c, r in zip(*op3_substring_dedup.compact_windows(h, begin, 12)):
        for i in range(l, c + 1):
            for j in range(max(c, i + 11), r + 1):
                assert h[c] == h[i:j + 1].min()
                cover[i, j] += 1
    want = {(i, j) for s, e in zip(begin[:-1], begin[1:]) for i in range(s, e) for j in range(i + 11, e)}
    assert set(cover) == want and max(cover.values()) == 1


@pytest.mark.parametrize("heavy", [40, 1])
def test_passages_repeated_across_documents(spark, docs, empty, heavy, monkeypatch):
    monkeypatch.setattr(op3_substring_dedup, "HEAVY", heavy)      # 1: every sampled group is salted
    if heavy == 1:
        monkeypatch.setattr(op3_substring_dedup, "SAMPLE", 1.0)
    got = op3_substring_dedup.repeated_passages(docs).collect()
    words = defaultdict(list)
    for i, t in pairs(docs):
        words[i].append(WORD.findall(t or ""))
    seen = defaultdict(set)
    for i, t in enumerate(dict.fromkeys(t or "" for _, t in pairs(docs))):
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            seen[tuple(w[k:k + 50])].add(i)
    texts = list(dict.fromkeys(t or "" for _, t in pairs(docs)))
    repeated = {x for s in seen.values() if len(s) > 1 for x in s}
    copies = Counter(t or "" for _, t in pairs(docs))
    want = {i for i, t in pairs(docs) if texts.index(t or "") in repeated
            or copies[t or ""] > 1 and len(WORD.findall(t or "")) >= 50}
    assert want <= {r.doc_id for r in got}
    clean = {i for i, t in pairs(docs) if i is not None and i >= 17}
    assert not clean & {r.doc_id for r in got}
    for r in got:
        assert r.n_words >= 50 and r.similarity >= 0.8
        a = max((set(zip(*[w[r.start_word:r.start_word + r.n_words][k:] for k in range(5)]))
                 for w in words[r.doc_id] if len(w) >= r.start_word + r.n_words), key=len)
        others = [set(zip(*[w[k:] for k in range(5)])) for w in words[r.partner_id]]
        assert max(len(a & o) for o in others) >= 0.75 * len(a)
    assert op3_substring_dedup.repeated_passages(empty).count() == 0


def test_passages_with_an_edit_in_the_middle_meet(spark):
    r = random.Random(33)
    rows = []
    for i in range(200):
        p = [r.choice(VOCABULARY) for _ in range(52)]
        q = [*p[:26], "changed", *p[27:]]
        for k, words in enumerate((p, q)):
            rows.append((2 * i + k, " ".join([*prose(30, 9000 + 4 * i + k).split(), *words,
                                              *prose(30, 9002 + 4 * i + k).split()])))
    got = op3_substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({x.doc_id for x in got.collect()}) >= 0.98 * len(rows)


def test_a_first_text_with_part_of_a_passage_hides_no_other_pair(spark):
    r = random.Random(34)
    rows = []
    for i in range(150):
        p = [r.choice(VOCABULARY) for _ in range(52)]
        for k, words in enumerate((p[2:50], p, p)):
            rows.append((3 * i + k, " ".join([*prose(30, 20000 + 6 * i + k).split(), *words,
                                              *prose(30, 20003 + 6 * i + k).split()])))
    got = op3_substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in got.collect()} >= {i for i, _ in rows if i % 3}


def test_a_passage_is_one_class_of_all_its_texts(spark, monkeypatch):
    """Twenty texts with one passage: 19 partners each, also dealt out over parts; a notice under
    the length makes no class, and pairs grow with the texts."""
    m, r = op3_substring_dedup, random.Random(35)
    passage, notice = ([r.choice(VOCABULARY) for _ in range(n)] for n in (60, 43))
    rows = [(i, " ".join([*prose(40, 30000 + 2 * i).split(), *(passage if i < 20 else notice),
                          *prose(40, 30001 + 2 * i).split()])) for i in range(320)]
    rows.append((400, " ".join([*prose(30, 1).split(), *passage, *prose(70, 2).split(), *passage])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share, heavy, part in ((0.02, 40, 2000), (1.0, 2, 6)):
        for name, value in (("SAMPLE", share), ("HEAVY", heavy), ("PART", part)):
            monkeypatch.setattr(m, name, value)
        got = m.repeated_passages(df).collect()
        assert Counter(x.doc_id for x in got) == Counter([*range(20), 400, 400])
        assert {x.n_partners for x in got} == {20} and len({x.class_id for x in got}) == 1
        assert all(x.n_words >= 60 and x.partner_id in {*range(20), 400} for x in got)
    texts = df.select(F.xxhash64("text").alias("id"), "text")
    none = spark.createDataFrame([], "h_key long, parts long")
    windows = texts.mapInArrow(m._windows, m.WINDOW)
    assert m._pairs(windows, none, 0).count() <= m.REACH * windows.count()


# -------------------------------------------------------------------------------- 4 toxicity

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


def test_automaton_accepts_exactly_the_words_within_one_edit():
    terms = [(b"scum", False), (b"moron", False), (b"trash", False), (b"lowei", True), (b"abab", True)]
    automaton, r = op4_toxicity.Automaton(terms), random.Random(3)
    words = [t for t, _ in terms] + [b"", b"m"]
    for t, _ in terms:
        for _ in range(150):
            w = list(t) + [r.choice(b"abelmorstuw") for _ in range(r.randrange(3))]
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w) + 1)
                w[k:k + r.randrange(2)] = [r.choice(b"abelmorstuw")] * r.randrange(2)
            words.append(bytes(w))
    for w in words:
        best = None
        for n, (t, open_end) in enumerate(terms):
            ends = range(len(w) + 1) if open_end else [len(w)]
            d = min(distance(t, w[:e]) for e in ends)
            if d == 0 or d == 1 and len(t) >= op4_toxicity.FUZZY_FROM:
                best = min(best, (d, n)) if best else (d, n)
        assert automaton.match(w) == best, w


def test_prefilter_keeps_every_match():
    lexicon = op4_toxicity.Lexicon([(b"moron", False, 3.0), (b"scum", False, 2.0)])
    powers = textnp.Powers()
    for word in ("moron", "Moron", "oron", "mron", "mmoron", "xoron", "moron,", "morom", "scum", "moro"):
        data = np.frombuffer(f"aa {word} bb".encode(), dtype=np.uint8)
        x = op4_toxicity.features(data, np.array([0, len(data)]), lexicon, powers)
        assert x.any(), word
    for word in ("scup", "maroons", "mo", "orono"):
        data = np.frombuffer(f"aa {word} bb".encode(), dtype=np.uint8)
        assert not op4_toxicity.features(data, np.array([0, len(data)]), lexicon, powers).any(), word


def test_quotation_weighs_less_than_abuse():
    lexicon, powers = op4_toxicity.Lexicon([(b"moron", False, 3.0)]), textnp.Powers()

    def weights(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return op4_toxicity.features(data, np.array([0, len(data)]), lexicon, powers)[0]

    plain, quoted, said = (weights(t) for t in ("such a moron here", 'such a "moron" here',
                                                "they said moron here"))
    assert quoted[0] < plain[0] and said[0] < plain[0] and quoted[2] > plain[2] == 0
    assert weights("you are a moron")[0] > plain[0]


def labelled(spark, docs, bad):
    rows = [(i, prose(40, i).replace("\n", " ") + (bad if i % 4 == 0 else ""), "en", "s", 1) for i in range(400)]
    big = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(
        [(i, 1 - (i % 4 == 0), int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int")
    return big.unionByName(docs.select(*big.columns).where("doc_id is null or text is null")), labels


def test_toxicity_learns_from_labels(spark, docs, empty):
    data, labels = labelled(spark, docs, " scumbag trash scumbag")
    lexicon, w = op4_toxicity.train(data, labels)
    got = op4_toxicity.score(data, lexicon, w).collect()
    assert len(got) == data.count() and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id >= 20)
    lexicon, w = op4_toxicity.train(data, labels.limit(0))
    assert {round(r.score, 6) for r in op4_toxicity.score(data, lexicon, w).collect()} == {0.5}
    assert op4_toxicity.score(empty, lexicon, w).count() == 0


# -------------------------------------------------------------------------- 5 fingerprints

def keys(text):
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in (text or "").split("\n") if WORD.search(p)}


def test_fingerprints_match_brute_force(docs, empty):
    rows = sorted(((i, t or "") for i, t in pairs(docs)),
                  key=lambda r: (order(r[0]), hashlib.md5(r[1].encode()).hexdigest()))
    got = defaultdict(list)
    for r in op5_fingerprints.fingerprints(docs).collect():
        got[r.doc_id].append(r)
    prints = {}
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[:len(t) - half] + n[:half]
        sha = hashlib.sha256(e.encode()).hexdigest()
        r = next(x for x in got[i] if x.edited_sha256 == sha and x.n_chars == len(t))

        def near(a, b):
            return len(a & b) / len(a | b) if a | b else 1.0

        assert r.near_edited == pytest.approx(near(keys(t), keys(e)))
        assert r.near_next == pytest.approx(near(keys(t), keys(n)))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert sum(map(len, got.values())) == len(rows)
    assert op5_fingerprints.fingerprints(empty).count() == 0


def test_peeling_recovers_large_differences(spark):
    rows = [(n, list(range(1, n + 1)), [x * 7 for x in range(n // 2, n + 5)]) for n in (0, 1, 30, 200, 900)]
    df = spark.createDataFrame(rows, "n int, a array<bigint>, b array<bigint>")
    mixed = [F.transform(c, lambda x: F.conv(F.substring(F.md5(x.cast("string")), 1, 15), 16, 10).cast("bigint"))
             for c in ("a", "b")]
    df = df.select("n", "a", "b", mixed[0].alias("ka"), mixed[1].alias("kb"))
    d = op5_fingerprints.difference(F.col("ka"), F.col("kb"), op5_fingerprints.sketch(F.col("ka"), op5_fingerprints.BASE),
                                    op5_fingerprints.sketch(F.col("kb"), op5_fingerprints.BASE))
    for r in df.select("a", "b", d.alias("d")).collect():
        assert (r.d.a, r.d.b) == (len(set(r.a) - set(r.b)), len(set(r.b) - set(r.a)))
        assert r.d.rows > 0                       # by peeling, not by the exact way out


# -------------------------------------------------------------------------- 6 quality rules

def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(docs, empty):
    t = F.col("text")
    m = op6_quality_rules
    got = docs.select("text", m.n_words(t), m.word_chars(t), m.n_symbols(t), m.n_dup_lines(t), m.n_repeat_words(t))
    for r in got.collect():
        assert tuple(r)[1:] == brute_counts(r[0])
    order_ = m.plan_cascade(docs)
    assert {r.name for r in order_} == {r.name for r in m.DEFAULT_RULES}
    kept = m.apply_cascade(docs)
    assert kept.columns == docs.columns
    every = docs.where(m.verdict(list(reversed(order_)), m.Measures(t)))
    assert sorted(map(str, kept.collect())) == sorted(map(str, every.collect()))
    ids = {r.doc_id for r in kept.collect()}
    assert {5, 7, 9, 15, 16, 20} <= ids and not {0, 1, 2, 3, 4, 11, 12, 13, 14} & (ids - {3})
    assert m.apply_cascade(empty).count() == 0


# ----------------------------------------------------------------------------------- 7 packing

def test_pieces_are_exact_and_sequences_full(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op7_packing.tokenizer_path())
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[i, len(ids), zlib.crc32(ids)] += 1
    got = [r.asDict() for r in op7_packing.pack(docs).collect()]
    total = sum(r["length"] for r in got)
    assert total == sum(n * k for (_, n, _), k in want.items())
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
    sizes = []
    for s in sorted(by):
        at = 0
        for r in sorted(by[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    assert sorted(by) == list(range(len(by)))
    full = total // 1024
    assert sizes[:full] == [1024] * full and all(x & (x - 1) == 0 for x in sizes)
    whole = Counter()
    for i, n, _ in want:
        starts = sorted(r["start"] for r in got if r["doc_id"] == i and r["doc_tokens"] == n)
        whole[i, n] = starts.count(0)
    assert whole == Counter({(i, n): sum(k for (a, b, _), k in want.items() if (a, b) == (i, n))
                             for i, n, _ in want})
    # Every piece, of cut documents too, is the ids that it says.
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4"))
    for r in got:
        cuts = {zlib.crc32(ids[r["start"]:r["start"] + r["length"]]) for ids in texts[r["doc_id"]]
                if len(ids) == r["doc_tokens"]}
        assert r["ids_crc32"] in cuts
    assert op7_packing.pack(empty).count() == 0


def test_encoder_splits_where_no_token_spans():
    from tokenizers import Tokenizer
    import pyarrow as pa

    texts = ["a  b", "  a b ", "x\n y", "   ", "\u3000 q", "\u00a0 a\u00a0b", "it's  \t ok\n\n wow", "",
             "a  b <|endoftext|> c", "é à 漢字 🙂 x", *[t for t in TEXTS if t]]
    tokenizer = Tokenizer.from_file(op7_packing.tokenizer_path())
    for ranks in (None, op7_packing.ranks_path()):
        encoder, got = op7_packing.Encoder(op7_packing.tokenizer_path(), ranks), []
        for _, _, data, offsets in textnp.blocks(pa.array(texts), 500):
            ids, first = encoder.block(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_bounds_of_windows_add_up():
    m, r = op7_packing, np.random.default_rng(7)
    for a in r.integers(0, m.WINDOW * m.ONE, 20):
        for at in (np.arange(600), m.ONE * 3 - 300 + np.arange(600)):
            got = m.bound(np.full(600, a), at)
            assert (np.diff(got) == (a + m.shift(at[:-1]) >> m.PLACES)).all()
    assert m.bound(np.array([5 * m.ONE + 7]), np.array([3 * m.ONE])) == 3 * (5 * m.ONE + 7)


def test_every_window_of_real_documents_holds_the_mixture(spark):
    """Full windows hold each running source's share to within one token; deficits stay small."""
    m = op7_packing
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sources = [r[0] for r in df.select("source").distinct().orderBy("source").collect()]
    for weights in (None, {sources[0]: 0.3, sources[1]: 0.01}):
        tokens = m.tokens_of(df, m.tokenizer_path(), m.ranks_path())
        placed, n_rows, plan = m.schedule(tokens, weights)
        of = {r.doc_id: r.source for r in df.collect()}
        held = defaultdict(Counter)
        for r in m.pack(df, weights).collect():
            held[r.sequence_id][of[r.doc_id]] += r.length
        assert sum(p.windows for p in plan.phases) >= 0.9 * len(held) and placed.count() == n_rows == df.count()
        for p in plan.phases:
            share = (p.high - p.low) / m.ONE
            carried = np.zeros(len(sources))
            for w in range(p.first, p.first + p.windows):
                got = np.array([held[w][x] for x in sources])
                assert got.sum() == m.WINDOW and np.abs(got - share).max() < 1
                carried += got - share
                assert np.abs(carried).max() < m.PLACES
        if weights:
            first = plan.phases[0]
            total = sum(weights.values()) + 1 - sum(sum(held[w][x] for w in held) for x in list(weights)) / plan.total
            assert (first.high - first.low)[0] / m.ONE == pytest.approx(m.WINDOW * 0.3 / total, abs=0.01)


def test_weights_must_be_positive(spark, docs):
    with pytest.raises(ValueError, match="positive"):
        op7_packing.pack(docs, weights={"s": 0.0})


def test_rare_sources_share_a_queue(spark, monkeypatch):
    rows = [(i, "w " * (5 + i % 90), f"s{i % 40}" if i % 9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(op7_packing, "QUEUES", 6)
    monkeypatch.setattr(op7_packing, "ROWS_PER_BUCKET", 50)
    got = op7_packing.pack(df).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id, r.doc_tokens].append((r.start, r.length))
    assert len(parts) == 1500
    for (_, n), p in parts.items():
        assert [a for a, _ in sorted(p)] == [0, *np.cumsum([b for _, b in sorted(p)])[:-1]] and sum(b for _, b in p) == n


def test_windows_follow_the_weights(spark):
    rows = [(i, "w " * 50, f"s{i % 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op7_packing.pack(df, weights={"s0": 3.0, "s1": 1.0}).where("sequence_id < 60") \
        .withColumn("s", F.col("doc_id") % 2).groupBy("s").agg(F.sum("length")).collect()
    share = {r[0]: r[1] for r in got}
    assert share[0] / (share[0] + share[1]) == pytest.approx(0.75, abs=0.02)


# --------------------------------------------------------------------------------- 8 line dedup

def brute_lines(rows, exact_words=op8_line_dedup.MIN_WORDS):
    """Lines that go, by edit similarity alone; shorter ones by equality."""
    occurrences = []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            norm = op8_line_dedup.normal_line(line.encode())
            if t is not None and len(norm.split()) >= min(exact_words, op8_line_dedup.MIN_WORDS):
                occurrences.append(((i is None, i or 0, hashlib.md5(t.encode()).hexdigest(), k), norm))
    different = list(dict.fromkeys(n for _, n in occurrences))
    parent = {n: n for n in different}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [n for n in different if len(n.split()) >= op8_line_dedup.MIN_WORDS]
    counts = [Counter(n) for n in long]
    for x in range(len(long)):
        for y in range(x):
            a, b = long[x], long[y]
            limit = (1 - op8_line_dedup.MIN_EDIT) * max(len(a), len(b)) + 1e-9
            if abs(len(a) - len(b)) <= limit and (counts[x] - counts[y]).total() <= limit and distance(a, b) <= limit:
                parent[find(a)] = find(b)
    first = {}
    for at, norm in occurrences:
        first[find(norm)] = min(first.get(find(norm), at), at)
    return {at for at, norm in occurrences if first[find(norm)] != at}


LINES = ["This line of words, repeated in 12 places!", "this line of words repeated in 99 places",
         "another quite long line of many different words that goes on and on for a while here now",
         "another quite long line of many different words that goes on and on for a while here noww"]


def test_lines_match_brute_force(spark, docs, empty, monkeypatch):
    extra = [(200 + i, f"Short.\n{LINES[i % 4]}\nunique words number {i} {prose(9, 300 + i)}\n\n{LINES[2]}")
             for i in range(8)]
    data = docs.where("length(text) < 20000 or text is null").select("doc_id", "text").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    gone = brute_lines(pairs(data))
    assert len(gone) > 40

    def check():
        for r in op8_line_dedup.without_repeats(data.withColumn("before", F.col("text"))).collect():
            if r.before is None:
                assert r.text is None and r._lines == 0
                continue
            key = (r.doc_id is None, r.doc_id or 0, hashlib.md5(r.before.encode()).hexdigest())
            lines = r.before.split("\n")
            assert r.text == "\n".join(x for k, x in enumerate(lines) if (*key, k) not in gone)
            assert r._lines == len(lines) and r._dropped == sum((*key, k) in gone for k in range(len(lines)))

    check()
    monkeypatch.setattr(op8_line_dedup, "SAMPLE_ONE_IN", 1)     # every bucket of two is dealt over blocks
    monkeypatch.setattr(op8_line_dedup, "LARGE", 2)
    monkeypatch.setattr(buckets, "BLOCK", 1)
    check()
    out = op8_line_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "_lines", "_dropped"]
    assert op8_line_dedup.without_repeats(empty).count() == 0


def words_changed(line, r, how):
    """``line`` with one edit that keeps an edit similarity of 0.9."""
    w = line.split(" ")
    k = r.randrange(len(w))
    if how == "replace":
        w[k] = r.choice(VOCABULARY)
    elif how == "insert":
        w.insert(k, r.choice(VOCABULARY))
    elif how == "drop":
        del w[k]
    else:                                                  # three letters, anywhere
        s = list(line)
        for at in r.sample([k for k in range(len(s)) if s[k] != " "], 3):
            s[at] = r.choice("abcdefgh")
        return "".join(s)
    return " ".join(w)


def test_near_lines_of_every_length_meet(spark):
    """Recall against edit similarity alone, whatever made the candidates."""
    r = random.Random(81)
    rows, pairs_of = [], defaultdict(list)
    for words in (5, 8, 9, 10, 12, 20, 30, 50):
        while len(pairs_of[words]) < 100:
            a = " ".join(r.choice(VOCABULARY) for _ in range(words))
            b = words_changed(a, r, r.choice(["replace", "insert", "drop", "letters"]))
            if a != b and distance(a, b) <= (1 - op8_line_dedup.MIN_EDIT) * max(len(a), len(b)):
                pairs_of[words].append(len(rows) + 1)
                rows += [(len(rows), a), (len(rows) + 1, b)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id for x in op8_line_dedup.without_repeats(data).where("_dropped > 0").collect()}
    assert gone <= {i for m in pairs_of.values() for i in m}
    for words, m in pairs_of.items():
        assert len(gone & set(m)) >= 0.95 * len(m), words


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    rows = [(0, "Read more\none\n--\n"), (1, "read MORE!\ntwo\n--\n"), (2, "Read mores\none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.text for x in op8_line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: rows[0][1], 1: "two\n--\n", 2: "Read mores"}


def test_pairs_of_blocks_survive_three_replaced_words_and_one_moved():
    r, m = random.Random(83), op8_line_dedup

    def keys(words):
        data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
        return set(m.line_marks(data, np.array([0, len(data)]), textnp.Powers())[4][0].tolist()) - {m.NO_KEY}

    for _ in range(200):
        n = r.randint(5, 60)
        line = [r.choice(VOCABULARY) for _ in range(n)]
        other = list(line)
        for k in r.sample(range(n), 3):
            other[k] = r.choice(VOCABULARY)
        assert keys(line) & keys(other)
        k = r.randrange(n + 1)
        if n >= 6:
            assert keys(line) & keys([*line[:k], r.choice(VOCABULARY), *line[k:]])
        assert len(keys(line)) == (m.KEYS if n % 5 == 0 and n > 5 else m.KEYS - 2)


def test_edit_distance():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(20))) for _ in range(2))
        assert op8_line_dedup.edit_distance(a, b) == distance(a, b)


def test_edit_distance_stops_over_the_limit():
    r = random.Random(3)
    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(25))) for _ in range(2))
        true, most = distance(a, b), r.randrange(20)
        got = op8_line_dedup.edit_distance(a, b, most)
        assert got == true if true <= most else got > most


def test_line_marks_say_where_a_line_stands():
    r, m = random.Random(84), op8_line_dedup
    texts = ["", "\n", "", "ä ö\n\n--\nx", "one\n", "\ntwo words", "", *(
        "\n".join(" ".join(r.choice([*VOCABULARY, "über", "3.5", "--"]) for _ in range(r.randrange(9)))
                  for _ in range(r.randrange(6))) for _ in range(50)), ""]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    marks = m.line_marks(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]), textnp.Powers(), 1)
    got = [(d, no, raw[d][start:start + size].decode(), chars, tuple(letters)) for d, no, letters, chars, start, size
           in zip(*(marks[k].tolist() for k in (0, 1, 6, 7, 8, 9)))]
    want = []
    for d, t in enumerate(texts):
        for no, line in enumerate(t.split("\n")):
            norm = m.normal_line(line.encode())
            if norm:
                kinds = Counter(m.LETTER[c.encode()[0]] for c in norm if c != " ")
                want.append((d, no, line, len(norm), tuple(kinds[k] for k in range(m.CLASSES))))
    assert got == want


def test_near_rows_keep_blocks_and_colliding_cells_apart():
    """Rows of one cell meet in their own bucket and pair of blocks alone."""
    rows = [(1, None, 0, 0, 10), (2, 8, 0, 1, 10), (2, 8, 0, 1, 10), (3, 8, 0, 1, 10), (3, 9, 1, 0, 10), (3, 8, 1, 0, 10),
            (4, None, 0, 0, 10), (4, None, 0, 0, 10), (5, None, 0, 0, 10), (5, None, 0, 0, 20)]
    columns = zip(("cell", "bucket", "slot", "other", "chars"), zip(*rows))
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns} | {
        "h1": pa.array(range(len(rows)), pa.int64())})
    out = [x for b in op8_line_dedup.Kernel(0.9).near_rows(iter([batch])) for x in b.to_pylist()]
    assert [(x["h1"], x["bucket"]) for x in out] == [(3, 8), (5, 8), (6, 4), (7, 4)]


# ----------------------------------------------------------------------------------- 9 url filter

URLS = ["http://A.Example.ORG/en/1?x", "https://x.example.org/en/2", "ftp://example.org/es/", "HTTP://b.com/de/1#t",
        "http://b.com/fr/1", "http://b.com", "nothing here", "", None, "x://y.net/a://b", "http://casino-win.net/en/1",
        "http://notexample.org/es/1", "http://com/de/", "a\nb://line.net/p"]


def test_url_rules_and_model(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)],
                                  "page_id long, url string, host string, r string")
    weights = op9_url_filter.train(op9_url_filter.labelled_urls(spark))
    w = weights.first()["weights"]
    got = {r.page_id: r for r in op9_url_filter.judge(pages, weights).collect()}
    for i, u in enumerate(URLS):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), v, h + p) for v, h, p in op9_url_filter.RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path) == (host, path)
        if fits:
            assert (r.rule, r.verdict) == (max(fits)[2], max(fits)[1])
        else:
            assert r.rule is None and r.verdict == ("block" if host and r.score >= 0.5 else "allow")
    assert len(w) == op9_url_filter.BINS + 1
    made = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(op9_url_filter.LABELLED)], "page_id long, url string")
    judged = {r.page_id: r.verdict for r in op9_url_filter.judge(made, weights, rules=[]).collect()}
    right = sum(judged[i] == ("block" if y else "allow") for i, (y, _) in enumerate(op9_url_filter.LABELLED))
    assert right >= 0.95 * len(op9_url_filter.LABELLED)
    none = op9_url_filter.train(op9_url_filter.labelled_urls(spark).limit(0))
    assert {r.score for r in op9_url_filter.judge(pages, none).collect()} == {0.5}
    assert op9_url_filter.judge(pages.limit(0), weights).count() == 0


def test_url_model_matches_a_plain_gradient_descent(spark):
    """The fold over the labelled table against the same steps in numpy, on the bins it uses."""
    label = op9_url_filter.labelled_urls(spark)
    rows = label.select("url", "label", op9_url_filter.bins(op9_url_filter.host(F.col("url")),
                                                           op9_url_filter.path(F.col("url"))).alias("b"),
                        F.xxhash64("url").alias("k")).collect()
    w = np.zeros(op9_url_filter.BINS + 1)
    for _ in range(3):
        for r in sorted(rows, key=lambda r: r.k):
            x = np.bincount(r.b, minlength=op9_url_filter.BINS + 1) / math.sqrt(len(r.b))
            x[-1] = 1.0
            z = w[-1] + w[:-1] @ x[:-1]
            w = w * (1 - op9_url_filter.DECAY) + op9_url_filter.RATE * (r.label - 1 / (1 + math.exp(-z))) * x
    assert np.allclose(op9_url_filter.train(label, epochs=3).first()["weights"], w, atol=1e-9)


# ----------------------------------------------------------------------------- 10 quality classifier

def test_quality_model(spark, docs, empty):
    data, labels = labelled(spark, docs, " ### *** $$$ ###" * 8)
    model = op10_quality_gam.train(data, labels)
    got = op10_quality_gam.classify(data, model).collect()
    assert len(got) == data.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 20 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 40 and all((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in held)
    flat = op10_quality_gam.train(data, labels.limit(0))
    assert {r.score for r in op10_quality_gam.classify(data, flat).collect()} == {0.5}
    assert op10_quality_gam.classify(empty, model).count() == 0


def test_pair_tables_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = op10_quality_gam.fit(x, y), op10_quality_gam.fit(x, y, pairs=0)
    assert ((with_pairs.score(x) > 0.5) == y).mean() > 0.97 > 0.7 > ((without.score(x) > 0.5) == y).mean()
    one = with_pairs.score(x[:1])
    assert one == pytest.approx(with_pairs.score(x)[:1])


def brute_features(t):
    words, lines = [w.encode() for w in WORD.findall(t)], [x for x in t.split("\n") if x]
    raw, size, n = t.encode(), max(1, sum(len(w.encode()) for w in WORD.findall(t))), max(1, len(words))
    windows = [tuple(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []

    def share(chars):
        return sum(raw.count(c.encode()) for c in chars) / size

    return [math.log1p(len(words)), sum(map(len, words)) / n, share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"),
            share("#*$%&<>=+~^_\\{}[]"), share("!"), share("|"), (raw.count(b".") + raw.count(b",")) / n,
            sum(b >= 128 for b in raw) / size, sum(a == b for a, b in zip(words, words[1:])) / n,
            (len(windows) - len(set(windows))) / max(1, len(windows)), len(words) / max(1, len(lines)),
            (len(lines) - len(set(lines))) / max(1, len(lines))]


def test_quality_features_and_scores_match_brute_force():
    import pyarrow as pa

    m, texts = op10_quality_gam, [*TEXTS, None, "", "a a a b", "x\n\nx\ny\n", "É! #1 {a|b}", " "]
    got, powers = [], textnp.Powers()
    for _, _, data, offsets in textnp.blocks(pa.array(texts), 3000):
        got.append(m.features(data, offsets, powers))
    got = np.concatenate(got)
    assert np.allclose(got, [brute_features(t or "") for t in texts], rtol=1e-12)
    r = np.random.default_rng(4)
    x = r.random((400, len(m.FEATURES)))
    model = m.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), rounds=8, pair_rounds=4)
    for row, score in zip(x[:50], model.score(x[:50])):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        logit = model.intercept + sum(t[k] for t, k in zip(model.tables, b))
        logit += sum(g[b[f], b[h]] for (f, h), g in zip(model.pairs, model.grids))
        assert score == pytest.approx(1 / (1 + math.exp(-logit)), rel=1e-9)
    assert model.pairs and 0 < model.score(x).min() < model.score(x).max() < 1
