"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
from collections import Counter

import pytest
from test_operators import brute_near, targets, words_of

import corpus_pipeline
from tessera.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    syllables = ["ba", "ne", "ti", "lo", "mu", "ra", "é"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage = prose(40)
    rows = []
    for i in range(300):
        kind = rng.random()
        if kind < 0.1 and rows:
            t = rng.choice(rows)[1].split(" ")
            if kind < 0.06:
                t[len(t) // 2] = "other"
            t = " ".join(t)
        elif kind < 0.2:
            t = prose(rng.randint(5, 60)) + " " + passage + " " + prose(rng.randint(5, 60))
        else:
            t = prose(rng.randint(5, 150))
        rows.append((i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "b", "c"]), len(t)))
    rows += [(400 + i, "XQ|9 ##" * 60, "en", "a", 420) for i in range(4)] + [(500, None, "en", "a", 0), (501, "", None, None, None), (None, prose(30), None, None, None)]
    rows += [rows[3], rows[3]]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_stages(spark, tables, tmp_path):
    folder, rows = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == COLUMNS
        seen.append([tuple(r) for r in docs.collect()])
    read, classified, single, cut, mixed, pieces = seen

    assert not {400, 401, 402, 403, 500, 501} & {r[0] for r in classified}
    assert len(classified) >= len(read) - 12 and Counter(classified) <= Counter(tuple(r) for r in read)

    kept = Counter(r[0] for r in brute_near(classified, 5) if r[3])
    assert {r[0] for r in single} == set(kept) and len(single) == len({r[0] for r in single})
    assert Counter(single) <= Counter(classified)

    least = {}
    for r in single:
        b = r[1].encode()
        for i in range(len(b) - 49):
            if r[0] is not None:
                least[b[i : i + 50]] = min(r[0], least.get(b[i : i + 50], r[0]))
    want = {}
    for r in single:
        b, gone = r[1].encode(), set()
        for i in range(len(b) - 49):
            if r[0] is not None and least[b[i : i + 50]] < r[0]:
                gone |= set(range(i, i + 50))
        rest = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if rest or not gone:
            want[r[0]] = (rest, r[2], r[3], len(rest))
    assert {r[0]: r[1:] for r in cut} == want

    sizes, taken = Counter(), Counter()
    for r in cut:
        sizes[r[3]] += len(words_of(r[1]))
    for r in mixed:
        taken[r[3]] += len(words_of(r[1]))
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= 150
    copies = Counter(mixed)
    assert set(copies) <= set(cut) and max(copies.values()) <= 2

    tok = packing.tokenizer(packing.vocabulary())
    lengths = Counter()
    for r in mixed:
        lengths[r[0]] += len(tok.encode(r[1], add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in pieces:
        packed[r[0]] += r[2]
    assert packed == lengths


def test_one_id_with_different_texts(spark):
    rng = random.Random(2)
    prose = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    a, b, c, d = prose(), prose(), prose(), prose()
    near = lambda t: " ".join(t[:40] + ["other"] + t[41:])
    a, b, c, d, *like = *(" ".join(t) for t in (a, b, c, d)), near(a), near(d)
    rows = [(1, a), (5, like[0]), (5, b), (5, b), (7, c), (7, b), (9, d), (9, like[1]), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    # of two near copies with one id either may stay
    assert sum(got.pop((9, t), 0) for t in (d, like[1])) == 1
    assert got == Counter([(1, a), (5, b), (7, c), (None, a), (None, a)])


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables[0])
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 200
