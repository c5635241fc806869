"""The operators' parts without Spark: against brute force, an exact round trip or a known answer."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from strandline.llm import bpe, decontam, exact_dedup, labelled, license_scan, quality, sharding, simhash, substring, toxicity
from strandline.llm.common import Remembered


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(bpe.default_tokenizer()))


def test_bpe_is_that_of_the_library(codec):
    from tokenizers import Tokenizer

    library, r = Tokenizer.from_file(bpe.default_tokenizer()), random.Random(5)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "漢", "🙂", "١", "Ⅷ", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endof", "12", "!!", "\r\n", "ing", "ZZ", "́"]
    for _ in range(1500):
        s = "".join(r.choice(pieces) for _ in range(r.randint(0, 30)))
        expected = library.encode(s, add_special_tokens=False).ids
        assert codec.encode(s).tolist() == expected
        assert codec.decode(np.array(expected, np.int32)) == library.decode(expected, skip_special_tokens=False) == s


def test_bpe_long_pretoken_and_odd_ids(codec):
    text = "ab" * 30_000
    assert codec.decode(codec.encode(text)) == text
    assert codec.decode(np.array([-1, 10**6, 262], np.int64)) == codec.decode(np.array([262]))


def test_bpe_refuses_other_tokenizers():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))


def test_perfect_hash_is_minimal_and_checks_bytes():
    d = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(3000)), np.uint8).reshape(-1, 32)
    ids = np.arange(3000)
    mph, z = exact_dedup.unpack(exact_dedup.pack(d, ids, ids + 5, ids < 3, np.full(3000, 2)))
    slots = mph.slots(d)
    assert sorted(slots) == list(range(3000))
    assert (z["winner"][slots] == ids).all() and (z["digests"][slots] == d).all()
    strangers = np.frombuffer(b"".join(hashlib.sha256(b"x%d" % k).digest() for k in range(500)), np.uint8).reshape(-1, 32)
    s = mph.slots(strangers)
    assert not any(s[k] >= 0 and (z["digests"][s[k]] == strangers[k]).all() for k in range(500))


@pytest.mark.parametrize(
    "expression, names, free",
    [
        ("MIT", {"mit"}, True),
        ("(MIT OR GPL-2.0) AND Apache-2.0", {"mit", "gpl-2.0", "apache-2.0"}, True),
        ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, False),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT */", {"gpl-2.0 with classpath-exception-2.0", "mit"}, True),
    ],
)
def test_license_expressions(expression, names, free):
    found = license_scan.evaluate(license_scan.postfix(expression))
    assert found == (frozenset(names), free)


@pytest.mark.parametrize("expression", ["", "AND MIT", "(MIT", "(MIT OR", "*/"])
def test_license_broken_expressions(expression):
    assert license_scan.postfix(expression) is None


@pytest.mark.parametrize("expression", ["MIT", "MIT OR", "MIT)", "MIT licensed", "mit GPL", "MIT OR (GPL-2.0"])
def test_license_longest_expression(expression):
    assert license_scan.postfix(expression) == ["mit"]


def test_license_names_are_listed():
    scan = lambda x: license_scan.Scanner().scan(f"// SPDX-License-Identifier: {x}".encode())[5:7]
    assert scan("MIT") == ("spdx:mit", 1.0) and scan("GPL-2.0+ WITH Classpath-exception-2.0") == ("spdx:gpl-2.0+ with classpath-exception-2.0", 1.0)
    assert scan("hello") == ("spdx:unknown", 0.3) and scan("MIT OR hello") == ("spdx:mit,spdx:unknown", 0.3) and scan("LicenseRef-Own") == ("spdx:licenseref-own", 1.0)
    assert scan("()") == ("spdx:unparsed", 0.3)


def test_license_scan_against_regular_expressions():
    import re

    r = random.Random(12)
    pieces = ["MIT", "mit", " License", "license", "-", " ", "\n", "gnu general", " public ", "GENERAL", "cc", " by ", "Apache ", "é", "0", "mit license mit license", "cc by cc by"]
    for _ in range(2000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        at = [k for k, _ in places]
        assert license_scan.Scanner().scan(text.encode())[:5] == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))), text


def test_license_places():
    n, base, first, last, labels, *_ = license_scan.Scanner().scan("The MIT-License, cc by\nMIT license".encode())
    assert (n, base, first, last, labels) == (7, 3, 1, 5, "cc-by,mit")
    assert license_scan.Scanner().scan(b"")[:6] == (0, 0, None, None, "", "")


def test_fingerprint_against_the_definition():
    import re

    for text in ["", " ", "One", "a b", "A b C d e", "x " * 700, "é\x85y z\tq"]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("period", [1, 2, 7, 13, 21])
def test_difference_cover(period):
    cover = substring.difference_cover(period)
    assert all(any((p + d) % period in cover and (q + d) % period in cover for d in range(period)) for p in range(period) for q in range(period))


def test_edit_places_against_brute_force():
    def brute(a, b):
        best = 10**9
        for s in range(len(b) + 1):
            row = list(range(len(a) + 1))
            best = min(best, row[-1])
            for e in range(s, len(b)):
                new = [e - s + 1]
                for i, x in enumerate(a):
                    new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != b[e])))
                row = new
                best = min(best, row[-1])
        return best

    r = random.Random(3)
    for _ in range(300):
        a, b = [r.randint(0, 3) for _ in range(r.randint(1, 6))], [r.randint(0, 3) for _ in range(r.randint(0, 10))]
        assert decontam.edit_places(a, np.array(b, np.int64))[0] == brute(a, b)


def test_decontamination_finds_edited_items():
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [[r.choice(words) for _ in range(r.randint(10, 50))] for _ in range(20)]
    vocabulary = {}
    numbered = [[vocabulary.setdefault(w.encode(), len(vocabulary)) for w in i] for i in items]
    found = decontam.Items(list(range(20)), numbered, vocabulary, decontam.walks_needed(numbered, 0.8, 0.98), 0.8)
    hits = 0
    for trial in range(100):
        i = trial % 20
        w = list(items[i])
        for _ in range(decontam.allowed(len(w), 0.8)):
            w[r.randrange(len(w))] = "new"
        text = " ".join([f"v{r.randint(0, 99)}" for _ in range(30)] + w + ["end"])
        hits += any(h[0] == i for h in found.find(found.numbers(decontam.words_of(text))))
    assert hits >= 95
    assert found.find(found.numbers(decontam.words_of("nothing of the kind " * 50))) == []
    assert found.find(found.numbers([])) == []


def test_decontamination_walks_leave_every_word():
    assert (decontam.symbols(np.arange(-3, 1000)) != 0).all()
    r = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    items = [["se"] + [r.choice(words) for _ in range(r.randint(14, 58))] for _ in range(20)]
    vocabulary = {}
    numbered = [[vocabulary.setdefault(w.encode(), len(vocabulary)) for w in i] for i in items]
    found = decontam.Items(list(range(20)), numbered, vocabulary, decontam.walks_needed(numbered, 0.8, 0.98), 0.8)
    hits = 0
    for trial in range(100):
        w = ["new", *items[trial % 20][1:]]
        for _ in range(decontam.allowed(len(w), 0.8) - 1):
            w[r.randrange(1, len(w))] = "new"
        text = " ".join([f"v{r.randint(0, 99)}" for _ in range(30)] + w + ["end"])
        hits += any(h[0] == trial % 20 for h in found.find(found.numbers(decontam.words_of(text))))
    assert hits >= 95


def test_ring_gives_exact_shares_and_slots():
    nodes = [(p, s) for p, s in zip(range(-60, 60, 10), [0, 1, 2] * 4, strict=True)]
    counts = {0: 50, 3: 1, 7: 9}
    slots: dict[int, list[int]] = {}
    for arc, own, parts in sharding.allot(nodes, counts, 3):
        assert own == nodes[arc][1]
        assert sum(hi - lo for lo, hi, _, _ in parts) == counts[arc]
        for lo, hi, shard, base in parts:
            slots.setdefault(shard, []).extend(range(base, base + hi - lo))
    assert {s: sorted(v) for s, v in slots.items()} == {s: list(range(20)) for s in range(3)}


def test_quality_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert quality.features(b"") == [0.0] * len(quality.FEATURES)
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_toxicity_learns_words():
    r = random.Random(2)
    clean = [f"word{k}" for k in range(200)]
    texts, label = [], []
    for k in range(600):
        w = [r.choice(clean) for _ in range(30)]
        if k % 3 == 0:
            w[r.randrange(30)] = r.choice(["badone", "badtwo", "awful"])
        texts.append(" ".join(w).encode())
        label.append(float(k % 3 == 0))
    net = toxicity.fit(texts[:450], np.array(label[:450]), ["en"] * 450)
    scorer = toxicity.Scorer(net)
    right = [(scorer.score(t) >= 0.3) == bool(y) for t, y in zip(texts[450:], label[450:], strict=True)]
    assert np.mean(right) > 0.95
    assert 0 <= scorer.score(b"") <= 1


def test_platt_and_cache():
    assert labelled.platt(np.array([]), np.array([])) == (1.0, 0.0)
    cache = Remembered(lambda k: k * 2, 3)
    assert [cache[k] for k in (1, 2, 3, 4, 1, 1)] == [2, 4, 6, 8, 2, 2] and len(cache) <= 3
