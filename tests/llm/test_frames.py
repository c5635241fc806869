"""The operators on DataFrames: nulls, empty and long texts, ties and repeated rows, empty tables, clashing names."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, decontam, exact_dedup, license_scan, near_copies, quality, sharding, simhash, substring, toxicity

LONG = " ".join(f"long{k % 977}" for k in range(6000))
PASSAGE = " ".join(f"p{k}" for k in range(50))
ROWS = [
    (1, "the mit license holds here and now"), (2, "the mit license holds here and now"), (None, None), (4, ""), (5, LONG), (5, LONG), (7, PASSAGE + " tail one"), (8, "head two " + PASSAGE), (9, "the MIT license holds here and now"), (None, "no id at all"),
]
CLASH = "score double, shard int, key string, ids string, keep_id long, component_id long, fp long, slot string, own string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", "s", 0.5, 1, "k", "i", 3, 4, 5, "x", "y") for d, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, 3).collect()
    assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 1 for _, t in ROWS)
    assert sorted(r.text_crc32 for r in out) == sorted(zlib.crc32((t or "").encode()) for _, t in ROWS)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [3, 3, 4] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(none, 3).collect() == []


def test_sharding_moves_little(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    a = {r.doc_id: r for r in sharding.shard_documents(rows, 8).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(rows, 9).collect()}
    # No more rows leave their own shard than the shards have too many; a ninth shard takes a ninth, little else moves.
    own = collections.Counter(r.own_shard for r in a.values())
    assert sum(r.own_shard != r.shard for r in a.values()) == sum(max(0, n - 2500) for n in own.values()) < 0.08 * len(a)
    assert sum(a[k].shard != b[k] for k in a) < 0.2 * len(a)


def test_sharding_of_one_hot_doc_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 50)
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as doc_id", "cast(id % 5 as string) as text")
    slots = collections.defaultdict(list)
    for r in sharding.shard_documents(rows, 4).collect():
        slots[r.shard].append(r.slot)
    assert {s: sorted(v) for s, v in slots.items()} == {s: list(range(750)) for s in range(4)}


def test_exact_dedup(spark, docs, none):
    out = exact_dedup.exact_groups(docs).collect()
    groups = collections.defaultdict(list)
    for d, t in ROWS:
        groups[hashlib.sha256((t or "").encode()).digest()].append(d)
    assert len(out) == len(ROWS)
    for r in out:
        g = groups[bytes(r.digest)]
        assert r.group_size == len(g) and r.keep_id == max((d for d in g if d is not None), default=None)
    assert collections.Counter(bytes(r.digest) for r in out if r.kept) == dict.fromkeys(groups, 1)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted({t or "" for _, t in ROWS})
    assert exact_dedup.exact_groups(none).collect() == [] and exact_dedup.drop_copies(none).collect() == []


@pytest.mark.parametrize("part_keys", [4000, 2])
def test_exact_dedup_in_parts(spark, docs, none, part_keys):
    """As of the whole, wherever the halves lie."""
    more = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.col("doc_id") - 5)).repartition(7)
    whole = exact_dedup.exact_groups(more).collect()
    out = exact_dedup.exact_groups_in_parts(more, part_keys=part_keys).collect()
    told = lambda rows: collections.Counter((r.doc_id, bytes(r.digest), r.keep_id, r.group_size) for r in rows)
    assert told(out) == told(whole)
    kept = [r for r in out if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and sorted(bytes(r.digest) for r in kept) == sorted({bytes(r.digest) for r in out})
    assert exact_dedup.exact_groups_in_parts(none).collect() == []


def test_exact_dedup_against_history(spark, docs):
    history = exact_dedup.winners(exact_dedup.digest_rows(docs.where("doc_id = 1")))
    out = exact_dedup.exact_groups(docs.where("doc_id in (1, 2, 7)"), history).collect()
    assert {(r.doc_id, r.kept, r.member, r.keep_id) for r in out} == {(1, False, True, 1), (2, False, True, 1), (7, True, False, 7)}


def test_license_scan(docs, none):
    out = license_scan.scan_licenses(docs).collect()
    assert len(out) == len(ROWS) and sum(r.n_base for r in out) == 3
    assert license_scan.scan_licenses(none).collect() == []


@pytest.mark.parametrize("hot", [2048, 0])
def test_simhash_components(spark, docs, none, hot):
    out = simhash.near_groups(docs, hot_pairs=hot).collect()
    fps = [np.uint64(simhash.fingerprint((t or "").encode())) for _, t in ROWS]
    reach = {int(a): min((d for (d, _), b in zip(ROWS, fps, strict=True) if d is not None and bin(int(a) ^ int(b)).count("1") <= 3), default=None) for a in fps}
    assert len(out) == len(ROWS)
    for r in out:
        assert r.component_id == reach[r.fp & (1 << 64) - 1]
    kept = simhash.drop_near_copies(docs, hot_pairs=hot)
    assert kept.columns == docs.columns and kept.count() == len({r.root for r in out})
    assert simhash.near_groups(none).collect() == [] and simhash.drop_near_copies(none).collect() == []


@pytest.mark.parametrize("hot", [2048, 0])
def test_simhash_dense_balls(spark, hot):
    import random

    r, values = random.Random(3), set()
    for base in (r.getrandbits(64), r.getrandbits(64)):
        for _ in range(120):
            x = base
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    values = sorted(values)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    rows = spark.createDataFrame([(i, simhash._signed(v)) for i, v in enumerate(values)], "doc_id long, fp long")
    got = rows.join(simhash._named(rows, hot), "fp").collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(values))}


def test_pipeline_drops_copies_of_five_word_similarity(spark, docs, none):
    import random

    import corpus_pipeline

    r = random.Random(6)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        texts.append(list(base))
        for edits in (1, 2, 3, 4, 8):
            w = list(base)
            for at in r.sample(range(200), edits):
                w[at] = "new"
            texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    few = near_copies.drop_near_copies(docs)
    assert few.columns == docs.columns and few.count() == len({near_copies.node_of(near_copies.shingles((t or "").encode()), {}) for _, t in ROWS}) - 1  # two texts with PASSAGE
    assert near_copies.drop_near_copies(none).collect() == []


def test_substring_dedup(docs, none):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in ROWS]
    count = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    expected = []
    for (d, _), w in zip(ROWS, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected.append((d or -1, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    out = substring.drop_repeated_passages(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept) for r in out) == sorted(expected)
    assert substring.drop_repeated_passages(none).collect() == []


@pytest.mark.parametrize("key_bits", [64, 1])
def test_substring_dedup_over_many_batches(spark, key_bits):
    import random

    r = random.Random(11)
    passages = [[f"p{r.randrange(30)}" for _ in range(r.randint(4, 12))] for _ in range(6)]
    rows = []
    for d in range(900):
        w = [f"w{r.randrange(6 if d % 5 else 4000)}" for _ in range(r.randint(0, 14))]
        rows.append((d % 700, " ".join(w + (r.choice(passages) if d % 3 else passages[0]) + w[:4])))
    rows += [(1000 + d, " ".join(passages[0] * 3)) for d in range(300)]  # a third of the rows are one text
    words = [t.split() for _, t in rows]
    count = collections.Counter(tuple(w[k : k + 5]) for w in words for k in range(len(w) - 4))
    expected = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        expected.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        out = substring.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 3, key_bits=key_bits).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out) == sorted(expected)


def test_substring_rows_that_share_a_first_hash(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(40), r.randrange(9), r.randrange(30), r.randrange(3), r.random() < 0.05) for _ in range(300)]
    rows += [(50 + k, 100 + k, k, 0, False) for k in range(40)]
    count = collections.Counter((h, h2) for _, h, _, h2, _ in rows)
    expected = {(key, at) for key, h, at, h2, known in rows if known or count[h, h2] > 1}
    packed = [(key, h, int(substring._pack(np.array([at]), np.array([h2]), np.array([known]))[0])) for key, h, at, h2, known in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = {(x.key, x.at) for x in substring._repeated(spark.createDataFrame(packed, substring.ROWS)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == expected


def test_bpe(docs, none):
    out = bpe.encode_documents(docs, bpe.default_tokenizer(), with_decoded=True)
    assert sorted(r.decoded for r in out.collect()) == sorted(t or "" for _, t in ROWS)
    back = bpe.decode_documents(out, bpe.default_tokenizer()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in ROWS)
    assert bpe.encode_documents(none, bpe.default_tokenizer()).collect() == []


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE.upper()), (2, None), (3, ""), (4, "!?"), (5, PASSAGE.upper())], "item_id long, text string")
    out = decontam.find_benchmark(docs, items)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in out.collect()) == [(7, 1, 0), (7, 5, 0), (8, 1, 0), (8, 5, 0)]
    clean = decontam.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2
    assert decontam.find_benchmark(none, items).collect() == [] and decontam.find_benchmark(docs, items.limit(0)).collect() == []


def test_decontamination_against_all_pairs(spark):
    import random

    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    items = [[r.choice(words) for _ in range(n)] for n in (10, 14, 20, 33, 40, 64, 90, 130, 300)]
    texts = []
    for k in range(120):
        w, allowed = list(items[k % len(items)]), decontam.allowed(len(items[k % len(items)]), 0.8)
        for _ in range(r.choice([0, allowed // 2, allowed, allowed, allowed + 3])):
            at, kind = r.randrange(len(w)), r.randrange(3)
            w[at : at + (kind != 1)] = [] if kind == 0 else [r.choice(words)]
        around = [r.choice(words) for _ in range(r.randint(0, 80))]
        texts.append(around + w + around[:10] + (w if k % 7 == 0 else []))
    number = {w: k for k, w in enumerate(words)}
    edits = {(d, i): decontam.edit_places([number[x] for x in item], np.array([number[x] for x in w]))[0] for d, w in enumerate(texts) for i, item in enumerate(items)}
    expected = {k for k, e in edits.items() if e <= decontam.allowed(len(items[k[1]]), 0.8)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)], "doc_id long, text string")
    out = decontam.find_benchmark(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in out}
    assert found <= expected and len(found) >= 0.95 * len(expected) > 60
    best = collections.defaultdict(list)
    for x in out:
        best[x.doc_id, x.item_id].append(x)
    for key, rows in best.items():
        rows.sort(key=lambda x: x.start_word)
        assert min(x.edits for x in rows) >= edits[key] and all(a.end_word <= b.start_word for a, b in zip(rows, rows[1:], strict=False))
    assert sum(len(v) > 1 for v in best.values()) >= 5  # texts that hold an item twice


def test_classifiers_take_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (7, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model, net = quality.train(docs, labels), toxicity.train(docs, labels)
    for out in (quality.score_documents(docs, model), toxicity.score_documents(docs, net)):
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(none, model).collect() == [] and toxicity.score_documents(none, net).collect() == []
    assert quality.keep_good(docs, model, 0.0).count() == len(ROWS)
    assert toxicity.score_documents(docs.drop("lang"), net).count() == len(ROWS)


@pytest.mark.parametrize("large", [100_000, 1])
def test_chat_perspectives(spark, large):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", None, 1), (1, 2, "bob", None, 1), (1, 70, "ann", "bye", 1), (2, 0, "system", "alone", 1), (None, None, None, "lost", 1)]
    out = chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int"), large=large).collect()
    whole = collections.defaultdict(str)
    for r in sorted(out, key=lambda r: r.seq):
        whole[r.conv_id, r.perspective] += r.rendered
        assert r.start == len(whole[r.conv_id, r.perspective]) - len(r.rendered)
        assert (r.mask == 1) == (r.name == r.perspective) == (r.chat_role == "assistant")
        if r.mask:
            assert whole[r.conv_id, r.perspective][r.mask_start : r.mask_end].endswith("<|im_end|>\n")
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "system"), (None, "unnamed")}
    assert whole[1, "ann"].startswith("<|im_start|>user name=system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n")
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_training_rows_are_bounded(spark):
    from strandline.llm import labelled

    docs = spark.createDataFrame([(k % 20, f"text {k}", "en") for k in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    rows = labelled.sample(docs, labels, "toxic", 4, 2, 5, ("lang",)).collect()
    assert len(rows) == 5 and all(r.lang == "en" for r in rows)
    held = {d for d in range(20) if zlib.crc32(str(d).encode()) % 4 == 2}
    every = labelled.sample(docs, labels, "toxic", 4, 2, 100, ("lang",)).collect()
    assert {int(r.text.split()[1]) % 20 for r in every} == set(range(20)) - held and len(every) == 20 - len(held)


def test_scores_against_plain_recomputation(spark, docs):
    texts = [t or "" for _, t in ROWS]
    r = np.random.default_rng(4)
    net = toxicity.fit([f"word{k % 40} bad{k % 2} tail".encode() for k in range(200)], np.array([k % 2 for k in range(200)], float), ["en"] * 200)
    assert net.out.any()

    def plain_toxicity(text):
        words = toxicity.words_of(text.encode())
        x = np.array([net.embedding[list(toxicity.buckets(w))].sum(0) for w in words] + [np.zeros(toxicity.DIM)] * max(0, 3 - len(words)))
        best = []
        for f, b in zip(net.filters, net.bias, strict=True):
            best += [max(0.0, max(sum(float(x[k + j] @ f[j, :, c]) for j in range(len(f))) for k in range(len(x) - len(f) + 1)) + float(b[c])) for c in range(toxicity.FILTERS)]
        raw = sum(a * float(o) for a, o in zip(best, net.out, strict=True)) + net.offset
        return 1 / (1 + np.exp(-(net.scale[0] * raw + net.scale[1])))

    short = [t for t in texts if len(t) < 1000]
    scorer = toxicity.Scorer(net)
    assert np.allclose([scorer.score(t.encode()) for t in short], [plain_toxicity(t) for t in short], atol=1e-5)
    x = np.array([quality.features(t.encode()) for t in texts])
    model = quality.fit(r.random((400, len(quality.FEATURES))) * x.max(0), (r.random(400) > 0.5).astype(float))

    def plain_quality(row):
        raw = model.intercept + sum(float(t[sum(v >= c for c in cuts)]) for v, cuts, t in zip(row, model.cuts, model.tables, strict=True))
        raw += sum(float(t[sum(row[a] >= c for c in model.coarse[a]), sum(row[b] >= c for c in model.coarse[b])]) for a, b, t in model.pairs)
        return 1 / (1 + np.exp(-(model.scale[0] * raw + model.scale[1])))

    got = {r.doc_id: r.score for r in quality.score_documents(docs, model).collect()}
    assert np.allclose([got[d] for d, _ in ROWS if d], [plain_quality(v) for (d, _), v in zip(ROWS, x, strict=True) if d])


def test_toxicity_of_a_text_with_more_words_than_the_table(monkeypatch):
    net = toxicity.fit([f"word{k % 40} bad{k % 2} tail".encode() for k in range(200)], np.array([k % 2 for k in range(200)], float), ["en"] * 200)
    text = " ".join(f"word{k}" for k in range(300)).encode() + b" bad1"
    whole = toxicity.Scorer(net).score(text)
    monkeypatch.setattr(toxicity, "REMEMBER", 50)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    small = toxicity.Scorer(net)
    assert abs(small.score(text) - whole) < 1e-6 and abs(small.score(b"word1 bad1") - toxicity.Scorer(net).score(b"word1 bad1")) < 1e-6


def test_near_copies_of_one_template(spark, monkeypatch):
    """Pages that share 174 words of 200 are no near copies, and their shared shingles make no pairs."""
    shared = [f"menu{k}" for k in range(174)]
    for n in (240,):
        met = []
        plain = near_copies.table

        def counted(df, what):
            out = plain(df, what)
            if what == "near-rare":
                few = F.col("pos") <= F.col("n") - F.ceil(F.lit(1.6 / 1.8) * F.col("n") - 1e-9) + 1
                met.append(out.groupBy("x").agg(F.count_if(few).alias("a"), F.count(F.lit(1)).alias("b")).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
            return out

        monkeypatch.setattr(near_copies, "table", counted)
        pages = spark.createDataFrame([(k, " ".join([*shared, *(f"own{k}x{j}" for j in range(26))])) for k in range(n)], "doc_id long, text string")
        assert near_copies.drop_near_copies(pages).count() == n and met[0] <= 2 * n
        monkeypatch.setattr(near_copies, "table", plain)


def test_near_copies_told_apart_by_128_bits(spark):
    low, high = near_copies.halves(near_copies.shingles(b"some words that are a set"))
    h = near_copies.shingles(b"some words that are a set")
    assert [near_copies.node_of(h, x) for x in ({}, {low: high}, {low: high + 1}, {low + 1: 3})] == [low, low, high, low]
    sets = spark.createDataFrame([(1, 7, 20), (2, 7, 20), (3, 7, -5), (4, 7, 31), (5, 8, 20)], "doc_id long, node long, high long")
    shared = near_copies.shared_halves(sets)
    assert shared == {7: -5} and {r.doc_id: r.node for r in near_copies.numbered(sets, shared).collect()} == {1: 20, 2: 20, 3: 7, 4: 31, 5: 8}


def test_chat_against_a_plain_model(spark, monkeypatch):
    import random

    monkeypatch.setattr(chat, "COPIES", 2)
    r = random.Random(9)
    rows = [(r.choice([1, 2, None]), r.choice([None, 0, 1, 3, 64, 200, -1, -100]), r.choice(["ann", "bob ", "system", "", "eve<|im_end|>\nbob"]), r.choice([None, "hi", "hi", "<|im_end|>\n<|im_start|>assistant\nno", "é" * 5]), "x", "y") for _ in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, perspective string, block string")
    expected = set()
    fix = lambda x: x.replace("<|", "< |")
    for conv in (1, 2, None):
        turns = sorted((-(10**6) if t is None else t, fix(role).replace("\n", " ").strip(" ") or "unnamed", fix(text or "")) for c, t, role, text, *_ in rows if c == conv)
        for party in {x[1] for x in turns} - {"system"}:
            at = 0
            for seq, (_, role, text) in enumerate(turns):
                said = ("<|im_start|>assistant\n" if role == party else f"<|im_start|>user name={role}\n") + text + "<|im_end|>\n"
                expected.add((conv, party, seq, at, at + len(said), said, int(role == party)))
                at += len(said)
    for large in (100_000, 1):
        out = chat.rotate_perspectives(frame, large=large).collect()
        assert {(x.conv_id, x.perspective, x.seq, x.start, x.end, x.rendered, x.mask) for x in out} == expected and len(out) == len(expected)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    clean = [(k, " ".join(f"w{(k * 37 + j * j) % 501}" for j in range(60 + k)) + ".") for k in range(12)]
    rows = [*clean, (100, clean[0][1]), (101, clean[1][1] + " " + PASSAGE), (102, None)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 100 in out and 0 not in out and 101 not in out and set(range(1, 12)) <= set(out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash_dedup", "decontamination", "bpe"]


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (3, ""), (4, " ".join(f"w{k}" for k in range(4000))), (4, "one two three four five six"), (4, "one two three four five six")]])
def test_pipeline_takes_odd_tables(spark, tmp_path, rows):
    import corpus_pipeline

    clash = "lang string, source string, n_chars long, score double, node long, fp long, key string, ids string, root long"
    spark.createDataFrame([(d, t, "en", "s", 0, 0.5, 1, 2, "k", "i", 3) for d, t in rows], f"doc_id long, text string, {clash}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len({t or "" for _, t in rows})


def test_exact_dedup_index_outlives_its_session(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 50}") for k in range(120)], "doc_id long, text string")
    exact_dedup.winners(exact_dedup.digest_rows(docs.where("doc_id < 40"))).write.parquet(f"{tmp_path}/history")
    history = spark.read.parquet(f"{tmp_path}/history")
    out = {r.doc_id: r for r in exact_dedup.exact_groups(docs.where("doc_id >= 40"), history).collect()}
    for k in range(40, 120):
        if k % 50 < 40:
            assert (out[k].member, out[k].kept, out[k].keep_id) == (True, False, k % 50)
        else:
            assert (out[k].member, out[k].kept, out[k].keep_id) == (False, k + 50 >= 120, k if k + 50 >= 120 else k + 50)


def test_simhash_gathers_no_table_on_the_driver(spark, monkeypatch):
    """Rows that grow with the corpus are never broadcast, also where they are few enough for Spark to do so; smallest neighbours are up to FEW_LINKS."""
    plans, plain = [], simhash.table

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(simhash, "table", noted)
    monkeypatch.setattr(simhash, "FEW_LINKS", 0)
    rows = [(k, f"one two three four five {k % 7} " * (k % 3)) for k in range(60)]
    out = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() == 60 and any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_near_copies_meet_by_deletion_variants(spark):
    """Sets at the least similarity share a variant of a signature; one of a signature's bits may differ, two may not."""
    r = np.random.default_rng(5)
    apart = []
    for n, d in ((4, 1), (9, 1), (18, 2), (45, 5), (180, 20)):
        for _ in range(60):
            x = r.integers(0, 1 << 63, n + d, np.uint64)
            v, w = (near_copies.votes(s) for s in (x[:n], x if n == 4 else x[d:]))
            shared = [len({s >> 8 * k & 255 for k in range(5)} & {t >> 8 * k & 255 for k in range(5)}) for s, t in zip(near_copies.signatures(v).tolist(), near_copies.signatures(w).tolist(), strict=True)]
            apart.append(max(shared) < 4)
            assert ((v[:128] > 0) != (w[:128] > 0)).sum() <= near_copies.RADIUS
    assert sum(apart) <= 1
    number = lambda entries: sum(e << 8 * k for k, e in enumerate(sorted(entries)))
    base = [3, 40, 77, 130, 255]
    rows = [(1, [number(base), number(range(5))]), (2, [number([3, 40, 76, 130, 255]), number(range(10, 15))]), (3, [number([3, 40, 76, 131, 255]), number(range(20, 25))]), (4, [number(range(30, 35)), number(base)])]
    keys = {n: {x.key for x in near_copies.variants(spark.createDataFrame(rows, "node long, signatures array<long>")).where(f"node = {n}").collect()} for n, _ in rows}
    assert len(keys[1] & keys[2]) == 1 and len(keys[2] & keys[3]) == 1 and not keys[1] & keys[3] and not keys[1] & keys[4]
