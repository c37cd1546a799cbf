"""The pipeline's stages, each on its own input, and the whole against brute force."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from test_operators import (
    BASE,
    TEXTS,
    WORD,
    brute_counts,
    brute_lines,
    brute_near,
    edited,
    prose,
)

from ledgerloom.llm import op1_mixing, op6_quality_rules, op7_packing

ROWS = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}", len(t) if t else None) for i, t in enumerate(TEXTS)
        if t is None or len(t) < 20000]
ROWS += [(100 + i, "A header line that every page has here\n" + prose(80 + i, 400 + i), "en", "s0", 0) for i in range(6)]
ROWS += [(200, edited(BASE, 77, 2), "en", "s1", 1), (300, BASE, "fr", "s9", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _dropped string, "
              "_selected string, row string")
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], schema).repartition(3)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def quality_kept(text):
    m = op6_quality_rules
    words, chars, symbols, dup, repeat = brute_counts(text)
    t = text or ""
    upper, shouts, pipes = sum("A" <= c <= "Z" for c in t), t.count("!"), t.count("|")
    return not (words < 50 or repeat * 100 > words * 50 or symbols * 100 > chars * m.MAX_SYMBOLS_PER_100_CHARS
                or upper * 100 > chars * m.MAX_UPPER_PERCENT or shouts * 100 > chars * m.MAX_SHOUTS_PER_100_CHARS
                or pipes * 100 > chars * m.MAX_PIPES_PER_100_CHARS
                or dup * 100 > (t.count("\n") + 1) * m.MAX_DUP_LINE_PERCENT
                or chars < words * 2 or chars > words * 25)


def after_quality(data):
    return [r for r in data if quality_kept(r[1])]


def after_lines(data):
    gone = brute_lines([r[:2] for r in data], exact_words=1)
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        key = (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())
        kept = [x for k, x in enumerate(lines) if (*key, k) not in gone]
        if len(kept) == len(lines):
            out.append(r)
        elif any(WORD.findall(x) for x in kept):
            text = "\n".join(kept)
            out.append((r[0], text, r[2], r[3], len(text), *r[5:]))
    return out


def after_near(data):
    groups = {}
    for (i, c, _, _), _ in brute_near([r[:2] for r in data]).items():
        groups[i] = c
    return [r for r in data if groups[r[0]] == r[0]]


def test_each_stage_on_its_own_input(spark, docs):
    data = [tuple(r) for r in docs.collect()]
    for name, step, brute in (("quality", pipeline.quality, after_quality), ("lines", pipeline.lines, after_lines),
                              ("near_duplicates", pipeline.near_duplicates, after_near)):
        out = step(spark, docs, "")
        assert out.columns == docs.columns, name
        assert rows(out) == Counter(brute(data)), name


def test_mix_and_pack_stages(spark, docs):
    mixed = pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    want = {r.doc_id for r in op1_mixing.mix(docs, out=("a", "b", "c", "d")).where("d").collect()}
    assert {r.doc_id for r in mixed.collect()} == want and 0 < len(want) < len(ROWS)
    pieces = pipeline.pack(spark, docs, "").collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert set(tokens) == {r[0] for r in ROWS} and all(tokens[p.doc_id] == p.doc_tokens for p in pieces)


def test_the_stages_in_order(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    data = after_near(after_lines(after_quality([tuple(r) for r in docs.collect()])))
    left = spark.createDataFrame(data, docs.schema)
    want = op7_packing.pack(pipeline.mix(spark, left, ""))
    got = pipeline.run(spark, str(tmp_path))
    keep = ["doc_id", "doc_tokens"]
    assert rows(got.select(*keep).distinct()) == rows(want.select(*keep).distinct())
    assert [name for name, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mix", "pack"]


def test_an_empty_table_passes_all_stages(spark, docs):
    none = docs.limit(0)
    for _, step in pipeline.STAGES:
        assert step(spark, none, "").count() == 0
