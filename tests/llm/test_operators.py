"""Each training-data operator against brute force on small fixtures, and the odd cases they all must take."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import graph, kneser_ney, license_scan, lm_scoring, minhash, mixing, packing, quality_rules, recompression, suffix_dedup, textkit, topk_search
from tessera.llm.blocks import deltas, expand, squeeze, sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    """Prose of few words, with copies, near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    words = ["the", "of", "and", "Réunion", "ñandú", "zu", "über", "blue", "green", "stone", "river", "x", "ab", "中文"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        t = [rng.choice(words) + ("" if rng.random() < 0.9 else ".") for _ in range(rng.choice([3, 30, 90, 200]))]
        kind = rng.random()
        if kind < 0.2 and rows:
            t = (rng.choice(rows)[1] or "").split(" ")
            if rng.random() < 0.6 and t:
                t[rng.randrange(len(t))] = "edited"
        elif kind < 0.4:
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage.split(" ")
        rows.append((i * 3, " ".join(t).replace(". ", ".\n" if i % 2 else ". "), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), 1))
    rows += [(1000, None, "en", "a", None), (1001, "", "en", None, 0), (1002, "one", None, "c", 3), (1003, "one one one one " * 40, "en", "c", 640), (1004, "x" * 30000, "en", "b", 30000), (None, passage, "en", "b", 5), (None, None, None, None, None)]
    rows += [rows[0], rows[0]]  # repeated rows
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def words_of(text):
    return WORD.findall(text or "")


def by_row(rows):
    return Counter(tuple(r) for r in rows)


# quality rules


def brute_rules(text):
    ws, t = words_of(text), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {j for i in range(len(ws) - 2) if grams[ws[i], ws[i + 1], ws[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    base = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    rows = corpus()
    rows += [(2000, "a\nb\na\n\n \nb\na", "en", "a", 1), (2001, "###|| <b>" * 90, "en", "a", 1), (2002, "\n".join(["same line here"] * 30), "en", "a", 1)]
    got = quality_rules.quality_rules(frame(spark, rows)).collect()
    assert by_row(r[:7] for r in got) == by_row((r[0], *brute_rules(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_cascade_is_the_same_in_any_order():
    import pyarrow as pa

    text = pa.array([r[1] for r in corpus()] + ["SHOUT LOUD " * 60, "!!! ??? " * 60])
    for c in textkit.chunks(text):
        want = quality_rules.run_cascade(c, quality_rules.RULES) >= 0
        known = {k: v for n in quality_rules.SHOWN for k, v in quality_rules.MAKERS[n](c).items()}
        np.testing.assert_array_equal(quality_rules.run_cascade(c, quality_rules.RULES, known, quality_rules.SHOWN) >= 0, want)
        for order in itertools.islice(itertools.permutations(quality_rules.RULES), 0, 5040, 700):
            np.testing.assert_array_equal(quality_rules.run_cascade(c, order) >= 0, want)


def test_order_by_rejection_per_cost(spark):
    rows = [(i, "few words", "en", "a", 1) for i in range(40)]
    order = quality_rules.ordered(frame(spark, rows), quality_rules.RULES)
    assert order[0].name == "min_words"
    assert {r.name for r in order} == {r.name for r in quality_rules.RULES}
    # features that are there anyway cost nothing: their rules come first, the others by what is still to pay
    rest = quality_rules.ordered(frame(spark, rows), quality_rules.RULES, quality_rules.SHOWN)
    assert {r.name for r in rest[-2:]} == {"upper_case", "marks"}


def test_measures_of_a_sample(spark):
    rows = [(i, "few words" if i % 4 else "SHOUT " * 60, "en", "a", 1) for i in range(400)]
    cost, rejected, count = quality_rules.measured(frame(spark, rows), quality_rules.RULES, 1 << 30)
    assert count.sum() == 400 and count[rejected[0]].sum() == 300 and all(cost[n] > 0 for n in quality_rules.MAKERS)
    R = quality_rules.Rule
    rules = (R("dear", ("a",), None), R("cheap", ("b",), None), R("shown", ("c",), None))
    order = quality_rules.by_rate(rules, {"a": 1.0, "b": 0.1, "c": 5.0}, np.array([[True, False], [True, False], [False, True]]), np.array([5.0, 1.0]), ("c",))
    assert [r.name for r in order] == ["shown", "cheap", "dear"]


# classifier


def symbol_of(c):
    return int(kneser_ney.FOLD[ord(c)]) if ord(c) < 128 else 64 + ord(c) % (2**15 - 64)


def brute_kneser_ney(texts, order):
    """Log-probability of each n-gram, from plain dictionaries."""
    m = kneser_ney.SYMBOLS
    seqs = [[kneser_ney.NEWLINE] * (order - 1) + [symbol_of(c) for c in t] for t in texts]
    levels = {order: Counter(tuple(s[i : i + order]) for s in seqs for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(g):
        if not g:
            return 1 / m
        c = levels[len(g)]
        n1, n2, n3, n4 = (max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [max(0.1, min(i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        disc = lambda v: d[min(v, 3) - 1] if v else 0
        own = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        return (c[g] - disc(c[g]) if c[g] else 0) / total + sum(map(disc, own.values())) / total * p(g[1:])

    return p


def test_kneser_ney_probabilities(spark):
    texts = [r[1] for r in corpus(8) if r[1] and len(r[1]) < 500]
    df = spark.createDataFrame([(t,) for t in texts], "__text string")
    counts = kneser_ney.gram_counts(df, 3)
    asked = spark.createDataFrame([(t,) for t in [*texts, "zzz QQ 77 !?"]], "__text string")
    got = {r.gram: r.logp for r in kneser_ney.log_probabilities(kneser_ney.gram_counts(asked, 3).select("gram"), counts, 3).collect()}
    p = brute_kneser_ney(texts, 3)
    for g, logp in got.items():
        low = 2**15 - 1
        assert abs(logp - math.log(p((g >> 30 & low, g >> 15 & low, g & low)))) < 1e-9
    # probabilities after a context add up to one
    used = {symbol_of(x) for t in texts for x in t} | {kneser_ney.NEWLINE}
    assert abs(sum(p((1, 2, s)) for s in used) + (2**15 - len(used)) * p((1, 2, 2**15 - 1)) - 1) < 1e-9


def test_symbols_see_all_scripts():
    import pyarrow as pa

    texts = ["aZ9 é", "中文 текст", None, "", "😀x", "ελ\n"]
    for c in textkit.chunks(pa.array(texts)):
        got, offsets = kneser_ney.symbols(c)
        for i, t in enumerate(texts):
            assert got[offsets[i] : offsets[i + 1]].tolist() == [symbol_of(x) for x in t or ""]


def test_perplexity_and_verdicts(spark):
    """Each document's perplexity, deviation and verdict against plain dictionaries, one language in a script of its own."""
    rng = random.Random(12)
    write = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))
    parts = {"en": ["ba", "ne", "ti", "lo"], "ru": ["мо", "ре", "та", "ки"], "zh": ["中", "文", "山", "水", "天"]}
    rows = [(i, write(parts[g := rng.choice(sorted(parts))], rng.randint(3, 40)), g) for i in range(240)]
    # the same letters in another order, and another script under this one's name
    rows += [(900 + i, write(["оы", "тк", "рм"], 40), "ru") for i in range(4)] + [(950 + i, write(parts["ru"], 40), "zh") for i in range(4)] + [(980, None, "ru"), (981, "", "zh"), (982, write(parts["zh"], 20), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    counted = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(2)) == 0).collect()}
    got = {r.doc_id: r for r in kneser_ney.quality_classifier(docs, trusted, order=3, least_docs=20).collect()}
    p = functools.cache(brute_kneser_ney([t for i, t, _ in rows if i in counted], 3))
    mean = {}
    for i, t, _ in rows:
        s = [kneser_ney.NEWLINE] * 2 + [symbol_of(c) for c in t or ""]
        mean[i] = math.fsum(math.log(p(tuple(s[j : j + 3]))) for j in range(len(s) - 2)) / len(t) if t else None
    for i, t, g in rows:
        if not t:
            assert not got[i].kept and got[i].perplexity is None and got[i].n_chars_scored == 0
            continue
        assert got[i].n_chars_scored == len(t) and abs(math.log(got[i].perplexity) + mean[i]) < 1e-9
        calm = [(mean[j], len(u)) for j, u, h in rows if j < 200 and j not in counted and g in (h, None)]
        mu = float(np.median([a for a, _ in calm]))
        low, high = np.quantile([(a - mu) * math.sqrt(n) for a, n in calm], [0.005, 0.995]) * 1.75
        z = (mean[i] - mu) * math.sqrt(len(t))
        assert abs(got[i].deviation - z) < 1e-6 and got[i].kept == (low <= z <= high)
    assert not any(got[i].kept for i in (*range(900, 904), *range(950, 954)))


def test_classifier(spark):
    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice(["ba", "ne", "ti", "lo"]) for _ in range(rng.randint(1, 3))) for _ in range(80))
    rows = [(i, good(), "en" if i % 2 else "fr", "a", 1) for i in range(400)] + [(900 + i, "#$%! QWX 99|" * 40, "en", "a", 1) for i in range(5)]
    rows += [(990, None, "en", "a", 0), (991, "", "en", "a", 0), (992, good(), None, "a", 0), (993, good(), "xx", "a", 0), (None, good(), "en", "a", 0)]
    docs = frame(spark, rows)
    trusted = docs.where("doc_id < 300").select("doc_id")
    got = {r.doc_id: r for r in kneser_ney.quality_classifier(docs, trusted, columns=["doc_id", "lang", "text"]).collect()}
    assert not any(got[900 + i].kept for i in range(5))
    assert sum(got[i].kept for i in range(400)) >= 396
    assert not got[990].kept and not got[991].kept and got[990].perplexity is None and got[992].kept and got[993].kept
    none = kneser_ney.quality_classifier(docs, trusted.where("false"))
    assert none.where("kept").count() == 400 + 5 + 3


def test_thresholds_of_all_trusted_documents(spark):
    """A language with few documents in the sample for the counts is judged by all of its own: prose of another language does not pass for it."""
    rng = random.Random(5)
    text = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(60))
    en, es = ["ba", "ne", "ti", "lo"], ["zu", "ky", "wo", "xe", "vi", "ja"]
    rows = [(i, text(en), "en", "a", 1) for i in range(1000)] + [(2000 + i, text(es), "es", "a", 1) for i in range(200)] + [(3000 + i, text(en), "es", "a", 1) for i in range(20)]
    docs = frame(spark, rows)
    got = kneser_ney.quality_classifier(docs, docs.where("doc_id < 2150").select("doc_id"), sample_docs=200).collect()
    assert len(got) == len(rows)
    assert sum(r.kept for r in got if 2150 <= r.doc_id < 3000) >= 48
    assert not any(r.kept for r in got if r.doc_id >= 3000)


def test_every_trusted_document_counts(spark, tmp_path):
    """The query on more trusted documents than a sample would take: both models, all thresholds and all verdicts against plain dictionaries."""
    rng = random.Random(21)
    parts = {"en": ["ba", "ne", "ti"], "zh": ["中", "山", "水"]}
    rows = [(i, "".join(rng.choice(parts[g]) for _ in range(rng.randint(1, 4))), g) for i in range(9000) for g in [rng.choice(sorted(parts))]]
    rows += [(20000 + i, "".join(rng.choice("qxz?") for _ in range(12)), "en") for i in range(9)] + [(20010, None, "en"), (20011, "", "zh"), (None, "bane", "en"), (3, "titi", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, None if i % 3 else 0) for i in range(8800)] + [(i, 0, 0) for i in range(8800, 8900)] + [(i, 1, 1) for i in range(8900, 9000)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fold = {r.doc_id: r.h for r in spark.range(8800).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(2)).alias("h")).collect()}
    models = [functools.cache(brute_kneser_ney([t for i, t, _ in rows if fold.get(i) == h], 4)) for h in (0, 1)]

    @functools.cache
    def mean(t, h):
        s = [kneser_ney.NEWLINE] * 3 + [symbol_of(c) for c in t]
        return math.fsum(math.log(models[h](tuple(s[j : j + 4]))) for j in range(len(t))) / len(t)

    def score(i, t):
        return mean(t, 1 - fold[i]) if i in fold else (mean(t, 0) + mean(t, 1)) / 2

    bounds, want = {}, []
    for g in parts:
        calm = [(score(i, t), len(t)) for i, t, h in rows if i in fold and h == g]
        mu = float(np.median([a for a, _ in calm]))
        bounds[g] = (mu, *(np.quantile([(a - mu) * math.sqrt(n) for a, n in calm], [0.005, 0.995]) * 1.75))
    for i, t, g in rows:
        mu, low, high = bounds[g]
        z = (score(i, t) - mu) * math.sqrt(len(t)) if t else None
        want.append((i, len(t or ""), bool(t) and bool(low <= z <= high), math.exp(-score(i, t)) if t else None, z))
    order = lambda r: (str(r[0]), r[1])
    got = [(r.doc_id, r.n_chars_scored, r.kept, r.perplexity, r.deviation) for r in kneser_ney.op2_quality_classifier(spark, str(tmp_path)).collect()]
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:3] == b[:3] and (a[3:] == b[3:] if b[3] is None else np.allclose(a[3:], b[3:], rtol=1e-6, atol=1e-6))


def test_steps_of_log_probabilities():
    rng = np.random.default_rng(8)
    a = [-rng.exponential(4, 1000), -rng.exponential(4, 1000), np.full(1000, -0.0)]
    for models in (a, a[:1], [x[:0] for x in a]):
        back = kneser_ney.unstepped(expand(squeeze(*kneser_ney.stepped(models))))
        assert len(back) == len(models) and all(np.abs(x - y).max(initial=0) <= 0.5 / kneser_ney.STEPS for x, y in zip(back, models, strict=True))


@pytest.mark.parametrize("trusted", [[], [1], [1, 2, 3, 4, 5, 6, 7], [99]])
def test_few_trusted_documents_in_halves(spark, trusted):
    """Where one half or both have no text, the other model, or no thresholds, remain."""
    rows = [(i, f"row {i} " * i, "en", "a", 1) for i in range(1, 8)] + [(None, "a b", None, None, None), (3, None, "en", "a", 1), (8, "", "en", "a", 1)]
    ids = spark.createDataFrame([(i,) for i in [*trusted, None]], "doc_id long")
    got = kneser_ney.quality_classifier(frame(spark, rows), ids, crossed=True).collect()
    assert sorted((str(r.doc_id), r.n_chars_scored) for r in got) == sorted((str(r[0]), len(r[1] or "")) for r in rows)
    assert not any(r.kept for r in got if r.doc_id == 8 or not r.n_chars_scored)
    if len(trusted) < 2:
        assert all(r.kept for r in got if r.n_chars_scored)


def test_texts_of_many_ids(spark):
    """The bit map only saves work: with few bits, and without broadcasts, the same rows come out."""
    rows = [(i % 700, f"text {i}") for i in range(2000)] + [(None, "no id"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.range(0, 900, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("fold"))
    want = Counter((t, i % 2) for i, t in rows if i is not None and i % 3 == 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for bits in (64, 1 << 25):
            got = Counter((None if r[0] is None else zstandard.decompress(bytes(r[0])).decode(), r[1]) for r in kneser_ney.with_ids(docs, ids, bits).collect())
            assert got == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles(spark):
    rng = random.Random(6)
    values = {"en": [rng.gauss(0, 1) for _ in range(301)], "fr": [rng.choice([-2.5, 1.0, 1.001]) for _ in range(64)], "xx": [3.25], None: [rng.random() / 50 for _ in range(100)]}
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "lang string, x double")
    fractions = [0.005, 0.5, 0.995]
    for bins in (1, 100):
        got = {r.lang: (r.docs, r.q) for r in kneser_ney.quantiles(df, fractions, bins).collect()}
        assert set(got) == set(values)
        for g, xs in values.items():
            assert got[g][0] == len(xs) and np.allclose(got[g][1], np.quantile(xs, fractions), rtol=0, atol=1e-12)


# packing


def test_packing(spark):
    rows = corpus()
    out = packing.pack(frame(spark, rows), packing.vocabulary(), max_tokens=256, group_pieces=16, with_ids=True).collect()
    tok = packing.tokenizer(packing.vocabulary())
    want = Counter((r[0], tuple([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    pieces = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
    flat = Counter((d, s, p) for (d, _), ps in pieces.items() for s, p in ps)
    expected = Counter((d, s, ids[s : s + 256]) for (d, ids), k in want.items() for s in range(0, len(ids), 256) for _ in range(k))
    assert flat == expected
    for _, own in itertools.groupby(sorted(out, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 256


def test_tokens_of_odd_texts():
    import pyarrow as pa

    rng = random.Random(5)
    letters = "abC éÈσΣ́ 　\t\n\r\x0b\x0c\x85 '’s'll |<|endoftext|> *中😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)] + [None, "", "a|b | c", "don't I'll"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["a", "b"])
    tok = packing.tokenizer(packing.vocabulary())
    for i, ids in packing.document_ids([batch], packing.vocabulary(), 2):
        assert ids.tolist() == [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2]


def test_first_fit_decreasing():
    rng = random.Random(2)
    lengths = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    bins, want = [], []
    for n in lengths:
        i = next((i for i, b in enumerate(bins) if b >= n), None)
        if i is None:
            bins.append(100)
            i = len(bins) - 1
        bins[i] -= n
        want.append(i)
    assert packing.first_fit_decreasing(lengths, 100) == want
    assert packing.first_fit_decreasing([], 100) == []


# near duplicates


def brute_near(rows, size, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = words_of((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets, strict=True) if r[0] is not None], 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return by_row((r[0], len(s), *((root(r[0]), root(r[0]) == r[0]) if r[0] is not None else (None, True))) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("parts", [4000, 3])
def test_near_duplicates(spark, parts):
    rng = random.Random(9)
    rows = corpus(50)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(40):  # a group whose members are near some of the others only
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        rows.append((5000 + i, " ".join(t), "en", "a", 1))
    rows += [(6000, "A b C", "en", "a", 1), (6001, "a B c", "en", "a", 1)]
    got = minhash.near_duplicates(frame(spark, rows), words=4, group_docs=parts).collect()
    assert by_row(got) == brute_near(rows, 4)


@pytest.mark.parametrize("shared", [32, 35])
def test_links_whose_sketches_share_half(shared):
    """Jaccard above 0.8, though only `shared` of the union's 64 least values are in both sets."""
    both = list(range(shared)) + list(range(1000, 2000))
    own = [list(range(100, 100 + (64 - shared) // 2)), list(range(200, 200 + (65 - shared) // 2))]
    sets = [np.array(sorted(both + x), np.uint64) for x in own]
    assert minhash.linked([4, 9], sets, 64, 80) == [(4, 9)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (200, 200), (101, 100), (300, 299)] + [(400, 401 + i) for i in range(60)]
    got = dict(graph.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100 and got[300] == 299 and all(got[401 + i] == 400 for i in range(60))
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_rounds_and_in_one_task(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(3000) - 1500, rng.randrange(3000) - 1500) for _ in range(1300)] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000 + i, 8999) for i in range(300)]
    edges = [(a * 2**40, b * 2**40) for a, b in edges] + [(None, 1), (2, None)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges[:-2]:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = {x: find(x) for x in root}
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for one_task in (0, 10**6):
        got = graph.connected(table, one_task=one_task).collect()
        assert len(got) == len(want) and dict(got) == want
    u, v = (np.array(x) for x in zip(*[(a, b) for a, b in edges[:-2] if a != b], strict=True))
    nodes, least = graph.least_reachable(u, v)
    assert dict(zip(nodes.tolist(), least.tolist(), strict=True)) == want


def test_components_of_few_edges_take_few_jobs(spark):
    # each round left its plans, broadcast hubs and tasks' records with the driver
    table = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    spark.sparkContext.setJobGroup("few edges", "")
    try:
        assert {r.component for r in graph.connected(table).collect()} == {0}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges")) <= 8


# suffix dedup


def brute_suffix(rows, size=50):
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - size + 1):
                k = b[i : i + size]
                least[k] = min(d, least.get(k, d))
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - size + 1):
                if least[b[i : i + size]] < d:
                    gone[i : i + size] = b"\1" * size
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return by_row(out)


@pytest.mark.parametrize("step", [1, 2])
def test_suffix_dedup(spark, step, monkeypatch):
    rows = corpus(40) + [(7000, "ab" * 100, "en", "a", 1), (7001, "ab" * 80 + "c", "en", "a", 1), (7002, "é" * 60, "fr", "a", 1), (7003, "xé" + "é" * 50, "fr", "a", 1)]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 3000)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), step=step).collect()
    assert by_row(got) == brute_suffix(rows)


def test_merged_transforms_order_all_rotations():
    rng = np.random.default_rng(0)
    lengths = rng.integers(50, 90, 40)
    data = rng.integers(97, 99, int(lengths.sum())).astype(np.uint8)
    data[:300] = 97
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for half in (rng.integers(0, 2, 40), np.zeros(40, int), np.ones(40, int)):
        rotations, common = suffix_dedup.merged_intervals(data, lengths, half.astype(np.int8), 50, 2)
        key = [bytes(data[b + (i + np.arange(50)) % n]) for b, n in zip(begin, lengths, strict=True) for i in range(n)]
        order = [key[i] for i in rotations]
        assert order == sorted(key)
        shared = [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in itertools.pairwise(order)]
        assert common.tolist() == [0, *(x // 2 * 2 for x in shared)]


def test_the_merge_sorts_nothing(monkeypatch):
    """Comparison sorts belong to the halves' own transforms; the interleave counts 16-bit symbols."""
    rng = np.random.default_rng(1)
    data, lengths = rng.integers(97, 100, 4000).astype(np.uint8), np.full(50, 80)
    first, second = (suffix_dedup.transform(data[i : i + 2000], lengths[:25], 50, 2)[1] for i in (0, 2000))
    real = np.argsort

    def counting(a, *args, **options):
        assert a.dtype == np.uint16 and options.get("kind") == "stable"
        return real(a, *args, **options)

    monkeypatch.setattr(suffix_dedup.np, "argsort", counting)
    monkeypatch.setattr(suffix_dedup.np, "sort", None)
    monkeypatch.setattr(suffix_dedup.np, "unique", None)
    z, _ = suffix_dedup.interleave(first, second, 50, 2)
    assert z.sum() == 2000


# scoring


def test_lm_scoring(spark):
    rows = corpus(30)
    texts = [words_of(r[1]) for r in rows]
    c = [Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(map(len, texts))

    def s(h, w):
        if not h:
            return math.log(c[0][w,] / total)
        g = (*h, w)
        return math.log(c[len(h)][g] / c[len(h) - 1][h]) if c[len(h)][g] >= 2 else math.log(0.4) + s(h[1:], w)

    want = Counter((r[0], len(w), round(math.fsum(s(tuple(w[max(0, i - 2) : i]), w[i]) for i in range(len(w))), 6)) for r, w in zip(rows, texts, strict=True))
    got = lm_scoring.lm_scoring(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


# recompression


def brute_repeats(rows, size):
    texts = [words_of(r[1]) for r in rows]
    c = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if c[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return by_row(out)


@pytest.mark.parametrize("size,rounds", [(35, 3), (8, 3), (5, 0), (6, 1), (9, 2)])
def test_recompression(spark, size, rounds):
    rows = corpus(40) + [(8000 + k, " ".join(["a b"] * 30 + ["c"] * k), "en", "a", 1) for k in range(3)] + [(8100, " ".join("a b c d e f g h".split() * 12), "en", "a", 1)]
    got = recompression.recompression_dedup(frame(spark, rows), size=size, rounds=rounds).collect()
    assert by_row(got) == brute_repeats(rows, size)


def rounds_of(blocks, size, rounds, shards=3):
    """The rounds as the exchange runs them: for each block its sequence at the end."""
    left = [recompression.whole(names, bounds, size) for names, bounds in blocks]
    for k in range(1, rounds + 1):
        asked = [s.shorter(k) for s in left]
        inbox = {}
        for b, (s, wants) in enumerate(asked):
            for shard, body in recompression.ask_names(s, wants, shards):
                inbox.setdefault(shard, []).append((b, body))
        answers = [{} for _ in blocks]
        for shard, messages in inbox.items():
            for b, body in recompression.name_table(messages):
                answers[b][shard] = body
        left = []
        for (s, wants), own in zip(asked, answers, strict=True):
            again, w = recompression.from_state(recompression.kept_state(s, wants))
            for x, y in ((s.name, again.name), (s.left, again.left), (s.right, again.right), (s.at, again.at), (s.begin, again.begin), (s.end, again.end), (wants, w)):
                np.testing.assert_array_equal(x, y)
            left.append(recompression.without(s, recompression.named(s, wants, own, shards), size))
    return left


@pytest.mark.parametrize("spread", [2, 5, 40, 10**6])
def test_naming_rounds_keep_what_repeats(spread):
    """Blocks get the same names for the same symbols; every window that is repeated anywhere stays, and most others go."""
    rng = np.random.default_rng(4)
    a, b = (textkit.mix(rng.integers(0, spread, 3000).astype(np.uint64)) for _ in range(2))
    b[1000:1200] = a[2000:2200]
    b[2500:2540] = b[100:140]
    b[2600:2800] = b[5]
    blocks = [(a, np.array([0, 700, 700, 1500, 3000])), (b, np.array([0, 20, 2300, 3000]))]
    left = rounds_of(blocks, 35, 3)
    where = {}
    for x, (names, bounds) in enumerate(blocks):
        for i, j in itertools.pairwise(bounds.tolist()):
            for s in range(i, j - 34):
                where.setdefault(names[s : s + 35].tobytes(), []).append((x, s))
    stays = {(x, int(p)) for x, s in enumerate(left) for i, j in zip(s.begin, s.end, strict=True) for p in range(i, j - 34)}
    assert {w for ws in where.values() if len(ws) > 1 for w in ws} <= stays
    if spread == 10**6:
        assert len(stays) < 1.2 * sum(len(ws) for ws in where.values() if len(ws) > 1)
        # a stretch in two blocks: its symbols have the names of one table
        inner = lambda s, i, j: [int(n) for n, x, y in zip(s.name, s.left, s.right, strict=True) if i <= x and y <= j]
        assert len(inner(left[0], 2000, 2200)) > 20 and inner(left[0], 2000, 2200) == inner(left[1], 1000, 1200)


def test_windows_alike_in_one_hash_only():
    first, second = np.array([5, 5, 9, 9, 7], np.uint64), np.array([1, 2, 3, 3, 4], np.uint32)
    messages, which = recompression.ask_twice(first, second, 1)
    ((block, body),) = recompression.answer_twice([(0, messages[0][1])])
    assert recompression.told({0: body})[which].tolist() == [False, False, True, True, False]


# licences


def test_license_scan(spark):
    rows = [
        ("r/LICENSE", "MIT header\nReleased under the MIT License. More words follow here."),
        ("r/a/COPYING", "preface\nThis work is licensed under the GNU General Public License, version 3."),
        ("r/a/b/x.py", "code"),
        ("r/y.py", "Licensed under the Apache License, Version 2.0.\ncode"),
        ("r/c/d/e/z.py", "this licence text is about something else entirely, not a grant"),
        ("q/none.txt", None),
        ("q/empty.txt", ""),
        ("top.txt", "plain"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, path string, text string")
    got = {r.path: (r.own_licence, r.licence, r.inherited_from) for r in license_scan.license_scan(df).collect()}
    assert got["r/LICENSE"][0] == "MIT" and got["r/a/COPYING"][0] == "GPL-3.0"
    assert got["r/a/b/x.py"] == (None, "GPL-3.0", "r/a")
    assert got["r/y.py"][:2] == ("Apache-2.0", "Apache-2.0")
    assert got["r/c/d/e/z.py"][2] == "r"
    assert got["q/none.txt"] == got["q/empty.txt"] == got["top.txt"] == (None, None, None)


def test_license_templates_match_themselves(spark):
    texts = [(n, x) for n, ts in sorted(license_scan.TEMPLATES.items()) for x in ts]
    df = spark.createDataFrame([(i, f"f/{i}", f"intro words\n\n{x}\n\nAnd more.") for i, (_, x) in enumerate(texts)], "key long, path string, text string")
    got = {r.key: r.own_licence for r in license_scan.license_scan(df).collect()}
    assert [got[i] for i in range(len(got))] == [n for n, _ in texts]


def test_license_texts_in_files(spark):
    """Headers over several lines, whole licence files, SPDX lines, closing notices; inheritance from all of them, none from the middle of a text."""
    wrap = lambda t, lead: "\n".join(lead + " ".join(t.split(" ")[i : i + 9]) for i in range(0, len(t.split(" ")), 9))
    prose = "Some words about other things. " * 6
    rows = [
        ("a/x.c", "/*\n" + wrap(license_scan.APACHE_HEADER, " * ") + "\n */\n\n" + prose),
        ("a/y.c", prose),
        ("b/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Person\n\n" + wrap(license_scan.MIT_BODY, "")),
        ("b/c/d.py", prose),
        ("d/e.go", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\n" + prose),
        ("e/f.rs", "// SPDX-License-Identifier: MPL-2.0\n" + prose),
        ("g/h.txt", prose + "Licensed under CC BY-SA 4.0."),
        ("g/i/j.txt", prose),
        ("k/l.txt", prose + "Licensed under CC BY 4.0. " + prose),
        ("k/m.txt", prose),
        ("n/o.txt", "Permission to land was given by the tower. The copyright of songs is a matter of law."),
        ("p/NOTICE.txt", prose + "Licensed under CC BY 4.0. " + prose),
        ("p/q.txt", prose),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key long, path string, text string")
    got = {r.path: (r.own_licence, r.licence, r.inherited_from) for r in license_scan.license_scan(df).collect()}
    own = {"a/x.c": "Apache-2.0", "b/LICENSE": "MIT", "d/e.go": "BSD-3-Clause", "e/f.rs": "MPL-2.0", "g/h.txt": "CC-BY-SA-4.0", "k/l.txt": "CC-BY-4.0", "p/NOTICE.txt": "CC-BY-4.0"}
    assert {p: g[0] for p, g in got.items() if g[0]} == own
    assert got["a/y.c"] == (None, "Apache-2.0", "a") and got["b/c/d.py"] == (None, "MIT", "b") and got["g/i/j.txt"] == (None, "CC-BY-SA-4.0", "g")
    assert got["p/q.txt"] == (None, "CC-BY-4.0", "p") and got["k/m.txt"] == got["n/o.txt"] == (None, None, None)


def test_anchors_are_an_exact_filter():
    """No unit reaches the threshold by a template's other terms alone, whatever its weights."""
    rows, _ = license_scan.template_weights(license_scan.TEMPLATES)
    marks = set(license_scan.anchors(rows, 0.7))
    for number in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == number]
        assert marks & {r[2] for r in own} and math.sqrt(sum(r[4] ** 2 for r in own if r[2] not in marks)) < 0.7


def test_units_of_other_words_cannot_reach_the_threshold(spark):
    """The count of known words leaves out only units whose cosine to everything is below the threshold."""
    rng = random.Random(3)
    rows, other = license_scan.template_weights(license_scan.TEMPLATES)
    idf = {r[2]: r[3] for r in rows}
    vocabulary = sorted(idf)
    bags = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 12))] * rng.randint(1, 3) + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 30))] for _ in range(300)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, w array<string>")
    passed = {r.i for r in df.where(license_scan.mostly_known(F.col("w"), vocabulary, 0.7)).collect()}
    assert 20 < len(passed) < 280
    for i, b in enumerate(bags):
        weight = {x: (1 + math.log(b.count(x))) * idf.get(x, other) for x in set(b)}
        share = sum(v * v for x, v in weight.items() if x in idf) / sum(v * v for v in weight.values())
        assert i in passed or share < 0.49


def test_rows_of_the_query_inherit(spark):
    out = license_scan.op8_license_scan(spark, "/root/testdata/sf0.01")
    assert out.where("own_licence is null and inherited_from is not null").count() > 0


# search


@pytest.mark.parametrize("queries,candidates", [(4096, 8192), (3, 17)])
def test_topk(spark, queries, candidates):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 21)).astype(np.float32)
    v[50:90] = v[3]
    rows = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [None] * 21), (402, [float("nan")] * 21), (403, [float("inf")] * 21), (404, []), (450, [1.0] * 5), (None, v[0].tolist()), (7, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk_search.quantised(df, "vec_id", "embedding", 256.0)
    got = topk_search.topk_search(q, q.where("id % 50 = 0"), 5, queries, candidates).orderBy("query_id", "rank").collect()
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 300, 50):
        s = x @ x[i]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("candidates", [8192, 17])
def test_topk_of_an_id_repeated_among_the_best(spark, candidates):
    """One id with its row nine times, one with nine vectors: neither takes more than one place."""
    rng = np.random.default_rng(4)
    v = rng.integers(-20, 20, (200, 12))
    near = [(301, v[0] * 2)] * 9 + [(302, v[0] * 2 + rng.integers(0, 3, 12)) for _ in range(9)] + [(310 + i, v[0] + rng.integers(-9, 10, 12)) for i in range(40)]
    rows = [*enumerate(v), *near]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in rows], "id long, v array<long>").repartition(3)
    got = topk_search.topk_search(df, df.where("id % 2 = 0"), 5, 4096, candidates).orderBy("query_id", "rank").collect()
    want = []
    for q in sorted({i for i, _ in rows if i % 2 == 0}):
        score = {}
        for i, x in rows:
            score[i] = max(score.get(i, -(10**9)), *(int(x @ y) for j, y in rows if j == q))
        order = sorted((i for i in score if i != q), key=lambda i: (-score[i], i))[:5]
        want += [(q, k + 1, i, score[i]) for k, i in enumerate(order)]
    assert [tuple(r) for r in got] == want


def test_topk_block_of_large_numbers():
    """Scores above 2 ** 53, where an id has several vectors."""
    c = np.array([[3 << 30], [2 << 30], [1 << 30], [5]])
    found = topk_search.search_block((np.array([9]), np.array([[1 << 30]])), (np.array([1, 1, 2, 3]), c), 2)
    assert found == ([(9, 1, 3 << 60), (9, 2, 1 << 60)], 4)


def test_topk_of_huge_and_empty_vectors(spark):
    """Finite vectors whose products do not fit a long take no part; empty ones have products of 0."""
    rows = [(i, [float(i), 1.0]) for i in range(60)] + [(100, [1e18, 1.0]), (150, [3e7, -3e7]), (151, [-1e300, 0.0]), (200, []), (202, []), (203, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = topk_search.quantised(df, "vec_id", "embedding", 256.0)
    assert {r.id for r in q.collect()} == {*range(60), 200, 202, 203}
    got = [tuple(r) for r in topk_search.topk_search(q, q.where("id % 50 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 59, 65536 * 2951), (50, 2, 58, 65536 * 2901), (200, 1, 202, 0), (200, 2, 203, 0)]


def clustered(n, seed=7):
    """Vectors around 40 centres of very uneven directions."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 32)) * np.geomspace(900, 3, 32)
    return np.rint(centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 32)) * 20).astype(np.int64)


def test_topk_prunes_clustered_vectors(spark):
    """Most pairs go by the blocks' summaries and by statistics, the answers are those of all products."""
    x = clustered(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    asked = df.where("id % 50 = 0")
    got = [tuple(r) for r in topk_search.topk_search(df, asked, 5, 64, 128).orderBy("query_id", "rank").collect()]
    want = []
    for i in range(0, 3000, 50):
        s = x @ x[i]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:5])]
    assert got == want
    work = topk_search.topk_search(df, asked, 5, 64, 128, with_scored=True).agg(F.sum("met"), F.sum("scored")).first()
    pairs = 60 * 3000
    assert work[0] < 0.5 * pairs and work[1] < 0.05 * pairs


def test_bounds_are_above_the_scores():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-300, 300, (20, 64)).astype(float), rng.integers(-300, 300, (200, 64)).astype(float)
    last = None
    for s in topk_search.RESOLUTIONS:
        bound = topk_search.statistics(q, s) @ topk_search.statistics(c, s).T
        assert (bound >= q @ c.T - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound


# mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare the excess until no source is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "en", rng.choice(["é", "a", "Z", "b", "b", "b", "b", None]), 1) for i in range(900)] + [(901, None, None, "a", 0), (902, "", None, "empty", 0), (None, "a b c", None, None, 1), (5, "x y", None, "a", 1), (5, "x y", None, "a", 1)]
    docs = frame(spark, rows)
    got = mixing.mixed(docs).select("__row.*", "size", "source_size", "target", "copies", "shards").collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want = targets({s: n for s, n in sizes.items()})
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == len(words_of(r.text)) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.copies <= 2 and len(r.shards) == r.copies
        taken[r.source] += r["size"] * r.copies
    for s, t in want.items():
        assert abs(taken[s] - t) <= 21, (s, taken[s], t)
    again = mixing.mixed(docs.repartition(3)).select("__row.doc_id", "copies", "shards").collect()
    assert by_row((r.doc_id, r.copies, tuple(r.shards)) for r in again) == by_row((r.doc_id, r.copies, tuple(r.shards)) for r in got)


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 3), (3, 0), (4, 17)], "rank int, draws long")
    split = {}
    for r in mixing.split_tree(quotas, 3, 5).collect():
        split[r.rank, r.shard] = r.draws
    for rank, n in ((1, 40), (2, 3), (3, 0), (4, 17)):
        assert sum(split[rank, k] for k in range(8)) == n
    totals = [sum(split[r, k] for r in (1, 2, 3, 4)) for k in range(8)]
    assert sum(totals) == 60 and max(totals) - min(totals) <= 1
    # over seeds, the left half's share of a source is hypergeometric: mean and variance
    draws = [next(r.draws for r in mixing.split_tree(quotas, 1, s).collect() if r.rank == 4 and r.shard == 0) for s in range(30)]
    assert abs(np.mean(draws) - 8.5) < 1.5 and 0.5 < np.std(draws) < 3.5


# all of them


def test_messages_round_trip():
    rng = np.random.default_rng(3)
    for a in (np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.empty(0, np.uint64), np.array([2**64 - 1], np.uint64)):
        d, b, e = expand(squeeze(deltas(a), np.array([True, False]).view(np.uint8), np.empty(0, np.int64)))
        np.testing.assert_array_equal(sums(d), a)
        assert b.tolist() == [1, 0] and len(e) == 0


RUNS = {
    "rules": lambda d: quality_rules.quality_rules(d),
    "classifier": lambda d: kneser_ney.quality_classifier(d, d.select("doc_id")),
    "packing": lambda d: packing.pack(d, packing.vocabulary()),
    "near": lambda d: minhash.near_duplicates(d),
    "suffix": lambda d: suffix_dedup.suffix_dedup(d),
    "scores": lambda d: lm_scoring.lm_scoring(d),
    "words": lambda d: recompression.recompression_dedup(d),
    "licences": lambda d: license_scan.license_scan(d.withColumn("path", F.lit("a/b")).withColumn("key", F.xxhash64("text"))),
    "mix": lambda d: mixing.mixed(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], DOCS)).count() == 0


def test_empty_search(spark):
    none = topk_search.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding", 256.0)
    assert topk_search.topk_search(none, none).count() == 0


@pytest.mark.parametrize("name", RUNS)
def test_all_null_and_clashing_columns(spark, name):
    """Rows of nulls, and columns named as the operators name theirs."""
    rows = [(None, None, None, None, None)] * 3 + [(1, "a b c d e f", "en", "a", 1)]
    d = frame(spark, rows)
    for c in ("block", "shard", "n", "m", "kept", "size", "rank", "value", "component", "hash", "grp", "licence", "above", "directory", "copies", "doc", "__n"):
        d = d.withColumn(c, F.lit(7))
    assert RUNS[name](d).count() == 4


@pytest.mark.parametrize("name", ["near", "suffix", "words", "classifier"])
def test_carried_columns_named_like_results(spark, name):
    """They come out beside the results, with `_in` after their names."""
    rows = [(1, "a b c d e f", "en", "a", 1), (2, None, None, None, None), (2, "a b c d e f", "en", "b", 3)]
    names = ["n", "component", "component_id", "kept", "kept_in", "n_bytes", "n_words", "n_removed", "doc_id", "n_shingles", "perplexity", "Kept"]
    d = frame(spark, rows)
    for i, c in enumerate(names[:-1]):
        d = d.withColumn(c, F.lit(i)) if c != "doc_id" else d
    run = {
        "near": lambda c: minhash.near_duplicates(d, columns=c),
        "suffix": lambda c: suffix_dedup.suffix_dedup(d, columns=c),
        "words": lambda c: recompression.recompression_dedup(d, columns=c),
        "classifier": lambda c: kneser_ney.quality_classifier(d, d.select("doc_id"), columns=c),
    }[name]
    out = run(names[:-1])
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    got = out.collect()
    assert len(got) == 3
    for r in got:
        assert r["component"] == 1 and r["n"] == 0
        assert sorted(v for c, v in r.asDict().items() if c.startswith("kept") and isinstance(v, int) and not isinstance(v, bool)) == [3, 4]


def test_equal_rows_fill_no_block(spark):
    """A third of all rows alike, ids null: they go to many blocks, groups of packing and tasks."""
    rows = [(None, "the same words again and again", "en", "a", 1)] * 2000 + [(i, f"row {i} " * 5, "en", "a", 1) for i in range(1000)]
    d = frame(spark, rows)
    from tessera.llm.blocks import blocked

    most = blocked(d.select("doc_id", "text"), [], 1000)[0].groupBy("__block").count().agg(F.max("count")).first()[0]
    assert most < 500
    out = packing.pack(d, packing.vocabulary(), group_pieces=100).withColumn("grp", F.shiftright("sequence_id", 32))
    assert out.count() == 3000 and out.groupBy("grp").count().agg(F.max("count")).first()[0] < 400
