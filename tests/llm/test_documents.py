import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowloom.llm import mix as mixing
from flowloom.llm import split as splitting
from flowloom.llm import tokens
from flowloom.llm.document_queries import p8_ids, p9_found, p10_found
from flowloom.llm.encode import decode, encode
from flowloom.llm.tokens import Vocabulary, count_tokens, split_by_python
from flowloom.sources.tables import table

ODD = [
    None, "", " ", "\n", " \r\n\r\n\t x", "a b  c", "don't we'LL 're'", "0123 ٤٥ ①", "你好 \U0001f600\U0001f600", "é �\u0000\x1c\x85y",
    "<|endoftext|>", "x" * 5000, " " * 3000 + "y", "\U0001e4d0\U00016d40 new letters Ᲊ", "same", "same", "=?utf-8?q?=C3=A4?=\n--b--\n",
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(ODD)], "doc_id bigint, text string, words string, block int").repartition(3)


def test_ids_of_odd_texts_and_back(odd, vocabulary):
    whole = vocabulary.encoding()
    ids = encode(odd, "doc_id", "text", vocabulary)
    assert {x.doc_id: x.ids for x in ids.collect()} == {i: whole.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert {x.doc_id: x.text for x in decode(ids, "doc_id", "ids", vocabulary).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert encode(odd.limit(0), "doc_id", "text", vocabulary).count() == 0


def test_decoding_of_foreign_ids(spark, vocabulary):
    piece = {i: b for b, i in vocabulary.ranks().items()}
    broken = next(i for i, b in piece.items() if b == b"\xe4")
    df = spark.createDataFrame([(1, [64, -1, 50256, 10**6, 65]), (2, None), (3, [broken]), (3, [])], "doc_id bigint, ids array<int>")
    got = sorted((x.doc_id, x.text) for x in decode(df, "doc_id", "ids", vocabulary).collect())
    assert got == [(1, (piece[64] + piece[65]).decode()), (2, ""), (3, ""), (3, "\ufffd")]


def test_ids_of_the_table_against_the_whole_tokenizer(spark, sf, vocabulary):
    whole = vocabulary.encoding()
    want = {x.doc_id: whole.encode_ordinary(x.text or "") for x in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert {x.doc_id: x.ids for x in p8_ids(spark, sf).collect()} == want
    assert {x.doc_id for x in p10_found(spark, sf).collect()} == {i for i, x in want.items() if len(x) > 4000}


def test_long_texts_are_split_by_python_in_parts(odd, vocabulary, monkeypatch):
    whole = vocabulary.encoding()
    r = random.Random(0)
    text = "".join(r.choice(["ab", " ", "  ", "\n", "c1", "'s", ".", " d"]) for _ in range(4000))
    monkeypatch.setattr(tokens, "LONG_CHARS", 50)
    parts = list(split_by_python(text))
    assert len(parts) > 10 and "".join(w for p in parts for w in p) == text
    assert [i for p in parts for w in p for i in vocabulary.single()(w)] == whole.encode_ordinary(text)
    counted = count_tokens(odd, "text", ["doc_id"], vocabulary)  # now nearly every text takes that way
    assert {x.doc_id: x.n_tokens for x in counted.collect()} == {i: len(whole.encode_ordinary(t or "")) for i, t in enumerate(ODD)}


# ---- splitting


def mail(r):
    lines = ["From: a@b.test", "Subject: x", ""]
    for _ in range(r.randrange(20, 90)):
        lines.append(r.choice(["", "> " + "quoted words here. " * 3, "-- ", "--part1", "word " * r.randrange(1, 60), "Z" * r.randrange(1, 900), "é\U0001f600 " * 9, " \t "]))
    return r.choice(["\n", "\r\n"]).join(lines)


@pytest.mark.parametrize("limit,overlap", [(64, 16), (200, 0), (500, 100), (32, 8)])
def test_pieces(spark, vocabulary, limit, overlap):
    r = random.Random(limit)
    texts = dict(enumerate(ODD)) | {100 + i: mail(r) for i in range(12)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    whole = vocabulary.encoding()
    by = defaultdict(list)
    for x in splitting.split(df, "doc_id", "text", vocabulary, limit, overlap).collect():
        by[x.doc_id].append(x)
    assert set(by) == {i for i, t in texts.items() if t is not None}
    for i, xs in by.items():
        xs.sort(key=lambda x: x.piece)
        size = len(whole.encode_ordinary(texts[i]))
        assert (len(xs) > 1) == (size > limit) and all(x.doc_tokens == size and x.pieces == len(xs) for x in xs)
        assert "".join(texts[i][x.core_start : x.end] for x in xs) == texts[i]
        for before, x in zip([None, *xs], xs):
            assert x.text == texts[i][x.start : x.end] and len(whole.encode_ordinary(x.text)) <= x.n_tokens <= limit
            if before:
                assert before.start <= x.start <= x.core_start == before.end and len(whole.encode_ordinary(texts[i][x.start : x.core_start])) <= overlap


def test_cuts_fall_on_the_strongest_places(vocabulary):
    text = "From: a\nSubject: b\n\n" + "one two three. " * 6 + "\nnext line here\n\nnew paragraph of it\n> quoted reply\n> more of it\n-- \nsigned\n--part2\nContent-Type: text\n\nbody again\n"
    at, grades = splitting.line_places(text)
    graded = {text[a:].split("\n")[0]: g for a, g in zip(at, grades)}
    assert graded["next line here"] == splitting.LINE and graded["new paragraph of it"] == splitting.BLANK
    assert graded["> quoted reply"] == splitting.QUOTE and graded["-- "] == splitting.QUOTE and graded["--part2"] == splitting.PART
    assert graded["> more of it"] == splitting.LINE and graded["Subject: b"] == splitting.LINE


def test_merging_takes_weak_places_first():
    assert splitting.merged([3, 3, 3, 3], [2, 0, 2], 6) == [0, 1, 3]
    assert splitting.merged([3, 3, 3, 3], [0, 2, 0], 6) == [0, 2]
    assert splitting.merged([1, 1, 1, 9, 1], [1, 1, 1, 1], 4) == [0, 3, 4]
    assert splitting.merged([5], [], 4) == [0]


# ---- mixing


def documents(spark, n=4000):
    r = random.Random(9)
    rows = [(i, r.choice(["big"] * 6 + ["mid", "mid", "small", None, "other"]), r.choice([0, 1, 5, r.randrange(200)]), r.choice([None, -1.0, 0.2, 1.0]), 1) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, quality double, bin int")


def test_budgets_epochs_and_repeats(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("Big ", 0.3, 1), ("mid", 0.4, 3), ("SMALL", 0.25, 2), ("none", 0.05, 4)], "source string, weight double, max_repeats int")
    selection, report = mixing.mix(df, targets)
    chosen, used = selection.collect(), defaultdict(int)
    assert len({x.doc_id for x in chosen}) == len(chosen)
    for x in chosen:
        used[x.source] += x.n_tokens * x.copies
    supply = defaultdict(int)
    for _, s, n, _, _ in rows:
        supply[s] += n
    total = supply["big"] + supply["mid"] + supply["small"]
    for x in report.collect():
        key = x.source.strip().lower()
        assert x.tokens == supply[key] and x.used_tokens == used[key] and abs(x.target_tokens - x.weight * total) < 1e-6
        assert x.short == (supply[key] * x.max_repeats < x.weight * total)
        copies = [c.copies for c in chosen if c.source == key]
        if x.short:
            assert used[key] == supply[key] * x.max_repeats
        else:
            assert x.target_tokens - 200 <= used[key] <= x.target_tokens and max(copies) <= x.max_repeats and max(copies) - min(copies) <= 1
    assert sorted(map(str, mixing.mix(df.repartition(7), targets)[0].collect())) == sorted(map(str, chosen))
    assert abs(sum(x.actual_share for x in report.collect()) - 1) < 1e-9


def test_quality_raises_the_chance(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'s' as source", "10L as n_tokens", "if(id % 2 = 0, 1.0D, 0.1D) as quality")
    selection, _ = mixing.mix(df, spark.createDataFrame([("s", 0.3, 1)], "source string, weight double, max_repeats int"))
    good = selection.where("doc_id % 2 = 0").count()
    assert selection.count() == 6000 and good > 4500


def brute_mix(spark, df, targets, seed=0):
    """copies by document: sorted by draw in one place."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rows = [(x.source, x.d, x.doc_id, x.n_tokens) for x in df.select("*", (-F.log(u) / F.greatest(F.when(F.col("quality") > 0, F.col("quality")).otherwise(1e-9), F.lit(1e-9))).alias("d")).collect()]
    named = {s.strip().lower(): (w, m) for s, w, m in targets}
    total = sum(t for s, _, _, t in rows if s in named)
    out = {}
    for key, (w, m) in named.items():
        own = sorted(x[1:] for x in rows if x[0] == key)
        supply = sum(t for _, _, t in own)
        epochs = min(m, int(w * total // supply)) if supply else m
        left = int(w * total - epochs * supply) if epochs < m else 0
        at = 0
        for _, i, t in own:
            at += t
            if epochs + (at <= left and epochs < m and left > 0):
                out[i] = epochs + (at <= left and epochs < m and left > 0)
    return out


@pytest.mark.parametrize("ordered", [50_000, 3])
def test_refined_ranges_against_sorting_everything(spark, ordered, monkeypatch):
    monkeypatch.setattr(mixing, "ORDERED", ordered)
    monkeypatch.setattr(mixing, "BINS", 16)
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([0, 3, r.randrange(90)]), r.choice([None, 1e-12, 0.05, 0.5, 1.0])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, quality double")
    targets = [("A", 0.35, 1), ("b", 0.5, 3), ("c", 0.15, 2)]
    selection, _ = mixing.mix(df, spark.createDataFrame(targets, "source string, weight double, max_repeats int"))
    assert {x.doc_id: x.copies for x in selection.collect()} == brute_mix(spark, df, targets)


def test_low_qualities_spread_over_the_bins(spark):
    df = spark.range(40_000).selectExpr("id as doc_id", "'s' as source", "10L as n_tokens", "if(id % 2 = 0, 1e-9D, 0.05D) as quality")
    mixing_targets = spark.createDataFrame([("s", 0.9, 1)], "source string, weight double, max_repeats int")
    planned = mixing.plan(df, mixing_targets)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(0)), 11).cast("double") + 0.5) / float(1 << 53)
    place = F.floor((F.log(-F.log(u) / F.col("quality")) - mixing.LOG_LOW) / mixing.LOG_SPAN * float(mixing.KEYS)).cast("long")
    drawn = df.withColumn("place", place)
    old, mixing.ORDERED = mixing.ORDERED, 40
    try:
        cut = mixing._cuts(drawn, planned, True).first()
    finally:
        mixing.ORDERED = old
    assert drawn.where(F.col("place").between(cut.lo, cut.hi)).count() <= 40  # a thousandth of the rows


def test_many_sources(spark, monkeypatch):
    n = 1500
    df = spark.range(6000).selectExpr("id as doc_id", f"concat('s', id % {n}) as source", "5L + id % 3 as n_tokens", "1.0D as quality")
    targets = [(f"S{i}", 1 / n, 1 + i % 2) for i in range(n)]
    frame = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    sent = {x.doc_id: x.copies for x in mixing.mix(df, frame)[0].collect()}
    assert sent == brute_mix(spark, df, targets)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    selection, report = mixing.mix(df, frame)
    assert {x.doc_id: x.copies for x in selection.collect()} == sent and report.count() == n


def test_sources_without_tokens_or_documents_are_short(spark):
    df = spark.createDataFrame([(1, "a", 0, 1.0), (2, "a", 0, 1.0), (3, "b", 50, 1.0), (4, "c", 50, 1.0)], "doc_id bigint, source string, n_tokens bigint, quality double")
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.5, 1), ("c", 0.2, 1), ("none", 0.1, 4)], "source string, weight double, max_repeats int")
    selection, report = mixing.mix(df, targets)
    assert {x.source: (x.used_tokens, x.short) for x in report.collect()} == {"a": (0, True), "b": (50, False), "c": (0, False), "none": (0, True)}
    assert {x.doc_id: x.copies for x in selection.collect()} == {1: 2, 2: 2, 3: 1}


def test_empty_mixes(spark):
    _, df = documents(spark, 10)
    targets = spark.createDataFrame([("big", 1.0, 2)], "source string, weight double, max_repeats int")
    selection, report = mixing.mix(df.limit(0), targets)
    assert selection.count() == 0 and [(x.tokens, x.used_tokens, x.short) for x in report.collect()] == [(0, 0, False)]
    assert mixing.mix(df, targets.limit(0))[1].count() == 0


def test_found_sources(spark, sf, vocabulary):
    rows = table(spark, sf, "documents").select("text", "source").collect()
    targets = table(spark, sf, "mix_targets").collect()
    have = defaultdict(int)
    for x in rows:
        if x.source is not None:
            have[x.source.strip().lower()] += len(vocabulary.encoding().encode_ordinary(x.text or ""))
    total = sum(have[t.source.strip().lower()] for t in targets)
    assert {x.source for x in p9_found(spark, sf).collect()} == {t.source for t in targets if have[t.source.strip().lower()] * t.max_repeats < t.weight * total}


# ---- more of splitting and decoding


def naive_merge(sizes, grades, room):
    runs = [[i] for i in range(len(sizes))]
    while True:
        best = None
        for j in range(len(runs) - 1):
            both = sum(sizes[i] for i in runs[j] + runs[j + 1])
            if both <= room and (best is None or (grades[runs[j + 1][0] - 1], both, runs[j][0]) < best[0]):
                best = ((grades[runs[j + 1][0] - 1], both, runs[j][0]), j)
        if best is None:
            return [r[0] for r in runs]
        runs[best[1] : best[1] + 2] = [runs[best[1]] + runs[best[1] + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_merging_against_looking_at_every_pair(seed):
    r = random.Random(seed)
    n = r.choice([1, 2, 30, 90])
    sizes, grades = [r.choice([0, 1, 1, 2, 7, 40]) for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 5]) for _ in range(n - 1)]
    for room in (3, 20, 100):
        assert splitting.merged(sizes, grades, room) == naive_merge(sizes, grades, room)


def test_words_are_the_atoms_of_a_long_sentence(spark, vocabulary):
    r = random.Random(5)
    text = " ".join(r.choice(["alpha", "be", "gammadelta", "x1y2", "incomprehensibilities"]) for _ in range(900))
    whole = vocabulary.encoding()
    words = [w for part in split_by_python(text) for w in part]
    sizes = [len(whole.encode_ordinary(w)) for w in words]
    limit, overlap = 120, 20
    firsts = naive_merge(sizes, [0] * (len(sizes) - 1), limit - overlap)
    begins = [sum(map(len, words[:i])) for i in firsts]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = sorted((x.piece, x.core_start, x.n_tokens) for x in splitting.split(df, "doc_id", "text", vocabulary, limit, overlap).collect())
    assert [c for _, c, _ in got] == begins and all(n <= limit for _, _, n in got)
    assert len({i % 7 for i in firsts}) > 3  # not on a grid


def test_only_the_piece_that_is_too_large_is_cut_again(vocabulary):
    """An encoder under which one stretch of a long word costs more than its parts do."""
    import numpy as np

    text = "plain words here " * 20 + "Q" * 60 + " plain words there" * 20
    words = [w for part in split_by_python(text) for w in part]
    one = vocabulary.single()
    encode = lambda t: one(t) if "Q" * 8 not in t else [0] * (45 + len(t) // 4)
    array = lambda xs: np.array(xs)
    sizes, costs, blank = array(list(map(len, words))), array([60 if "Q" in w else len(one(w)) for w in words]), array([not w.strip() for w in words])
    found = splitting.pieces(text, sizes, costs, blank, encode, one, 48, 12)
    assert "".join(text[c:b] for _, c, b, _ in found) == text and all(n <= 48 or "Q" * 8 in text[a:b] for a, _, b, n in found)
    plain = splitting.pieces(text, sizes, costs, blank, one, one, 48, 12)
    elsewhere = lambda xs: {(c, b) for a, c, b, _ in xs if "Q" not in text[a:b]}
    assert len(found) > len(plain) and elsewhere(plain) <= elsewhere(found)  # the others are as they were


def test_blocks_of_ids(spark, vocabulary, monkeypatch):
    whole = vocabulary.encoding()
    texts = {i: f"text {i} " + "é\U0001f600 word " * (i % 50) for i in range(1500)}
    df = spark.createDataFrame([(i, whole.encode_ordinary(t)) for i, t in texts.items()], "doc_id bigint, ids array<int>")
    assert {x.doc_id: x.text for x in decode(df, "doc_id", "ids", vocabulary).collect()} == texts
    assert "BroadcastHashJoin" in decode(df, "doc_id", "ids", vocabulary)._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_size(spark):
    from flowloom.llm.encode import _partitions

    df = spark.range(10).select((F.col("id") * 0 + (64 << 20)).alias("b"))
    assert _partitions(df, F.col("b")) == 20 and _partitions(df.limit(0), F.col("b")) == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    try:
        assert _partitions(df, F.col("b")) == 160
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_spreading_a_small_table_changes_nothing(spark, sf, vocabulary):
    from flowloom.llm.document_queries import _documents

    plain = table(spark, sf, "documents")
    assert plain.rdd.getNumPartitions() < _documents(spark, sf).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    key = lambda df: sorted((x.doc_id, x.n_tokens) for x in count_tokens(df, "text", ["doc_id"], vocabulary).collect())
    assert key(plain) == key(_documents(spark, sf))
