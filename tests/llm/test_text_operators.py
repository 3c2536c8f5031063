"""Operators on texts against plain brute force, and the edge cases they define."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablevet.llm import bpe, components as components_module, fuzzy_lines, kneser_ney, parity_join, ppm
from tablevet.llm.bytegrams import gram_counts, with_scores
from tablevet.llm.decontaminate import benchmark_hits
from tablevet.llm.fuzzy_lines import line_components, without_repeated_lines
from tablevet.llm.parity_join import Similarity, one_of_each_component, similar_documents
from tablevet.llm.queries import llm_queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, id bigint, dropped int"


def frame(spark, texts, extra=False):
    """Documents numbered from 0; ``extra`` adds columns with names that operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    if extra:
        return spark.createDataFrame([(*r, "k", 1, 7, 3) for r in rows], EMPTY)
    return spark.createDataFrame(rows, DOCS)


def documents(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def links(sets, percent):
    """All pairs of keys whose sets reach the similarity, by counting shared elements."""
    holders = defaultdict(list)
    for key in sorted(sets):
        shared = Counter()
        for element in sets[key]:
            shared.update(holders[element])
            holders[element].append(key)
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[key]) + len(sets[other]) - n):
                yield other, key


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def expected_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    union = Union()
    for a, b in links({i: s for i, s in sets.items() if s}, percent):
        union.join(a, b)
    return {i: (len(s), union.root(i)) for i, s in sets.items()}


# ---------------------------------------------------------------- op1


def test_op1_equals_brute_force(spark, sf_dir):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in llm_queries()["op1_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert found == expected_components(documents(spark, sf_dir), 3, 90)


@pytest.mark.parametrize("percent", [80, 90])
def test_near_copies_at_every_distance(spark, percent):
    """Chains of edited copies around the limit: bands, parts and the second round of pairs."""
    rng = random.Random(percent)
    texts = []
    for size in (9, 10, 13, 14, 20, 21, 33, 60, 140, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size + 2)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 18)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                del copy[rng.randrange(len(copy)) :][:1]
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(frame(spark, texts), 3, percent).collect()}
    assert found == expected_components(dict(enumerate(texts)), 3, percent)


def test_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(copy))
    found = similar_documents(frame(spark, texts), 3, 90).select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [0]


def test_similarity_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "a b c", long, long + " more", "é É", "é é"]
    found = {r.doc_id: r for r in similar_documents(frame(spark, texts, extra=True), 3, 90).collect()}
    assert [found[i].n_shingles for i in range(8)] == [0, 0, 0, 1, 1, 1, 1, 1]
    assert [found[i].component_id for i in range(12)] == [0, 1, 2, 3, 3, 5, 6, 6, 8, 8, 10, 11]


def test_similarity_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "p q r"), (2, "a b c d"), (3, "p q r"), (None, "a b c d")]
    found = similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found if r.doc_id) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    kept = one_of_each_component(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1]


def test_similarity_of_nothing(spark):
    assert similar_documents(spark.createDataFrame([], EMPTY)).collect() == []
    assert one_of_each_component(spark.createDataFrame([], EMPTY)).collect() == []


def test_difference_bound_and_bands():
    likeness = Similarity(90)
    for a in range(1, 120):
        for b in range(a, likeness.largest_partner(a) + 1):
            most = max(d for d in range(a + b + 1) if (a + b - d) % 2 == 0 and 100 * (a + b - d) >= 90 * (a + b + d))
            assert most <= likeness.most_difference(a + b)
            assert a == b or set(likeness.bands_of(a)) & set(likeness.bands_of(b))


# ---------------------------------------------------------------- op2


def sequence(text, order):
    return [257] * order + list((text or "").encode().lower()) + [256]


def counts_of(texts, order):
    out = [defaultdict(Counter) for _ in range(order + 1)]
    for text in texts:
        signs = sequence(text, order)
        for j in range(order, len(signs)):
            for k in range(order + 1):
                out[k][tuple(signs[j - k : j])][signs[j]] += 1
    return out


def ppm_log(counts, order, context, sign):
    gone, total = set(), 0.0
    for k in range(order, -1, -1):
        live = {s: n for s, n in counts[k].get(context[order - k :], {}).items() if s not in gone}
        if live:
            everything = sum(live.values()) + len(live)
            if sign in live:
                return total + math.log10(live[sign] / everything)
            total += math.log10(len(live) / everything)
            gone |= set(live)
    return total - math.log10(257 - len(gone))


def ppm_score(counts, order, text):
    signs = sequence(text, order)
    return sum(ppm_log(counts, order, tuple(signs[j - order : j]), signs[j]) for j in range(order, len(signs)))


def test_op2_equals_brute_force(spark):
    texts = documents(spark, "/root/testdata/sf0.001")
    found = {r.doc_id: r for r in llm_queries()["op2_lm_scoring"](spark, "/root/testdata/sf0.001").collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    counts = counts_of(train, ppm.ORDER)
    words = Counter(w for t in train for w in t.encode().lower().split())
    total, kinds = sum(words.values()) + len(train), len(words) + 1
    base = lambda n: math.log10((n + 0.1) / (total + 0.1 * (kinds + 1)))
    assert set(found) == set(texts)
    for i in random.Random(1).sample(sorted(texts), 40):
        tokens = texts[i].encode().lower().split()
        row = found[i]
        assert row.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (row.n_tokens, row.train_tokens) == (len(tokens) + 1, total)
        assert row.n_known == 1 + sum(words[w] > 0 for w in tokens)
        assert row.base_score == pytest.approx(sum(base(words[w]) for w in tokens) + base(len(train)), rel=1e-9)
        assert row.score == pytest.approx(ppm_score(counts, ppm.ORDER, texts[i]), rel=1e-9)


def test_scores_in_blocks_and_without_frequent_words(spark):
    texts = [None, "", "abc abd", "abc abd", "zz\nyy", "é" * 50, "x" * 300_000]
    df = frame(spark, texts, extra=True)
    whole = sorted(tuple(r) for r in ppm.score_documents(df).collect())
    few = sorted(tuple(r) for r in ppm.score_documents(df, hot_words=1).collect())
    for a, b in zip(whole, few):
        assert a == pytest.approx(b)
    counts = gram_counts(df, ~ppm.held_out(), 2)
    model = ppm.ppm_model(counts, 2)
    one, many = (
        {r.doc_id: r.score for r in with_scores(df, model, 2, "score", size).collect()} for size in (10**6, 7)
    )
    assert one == pytest.approx(many)
    by_hand = counts_of([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10], 2)
    for i in range(6):
        assert one[i] == pytest.approx(ppm_score(by_hand, 2, texts[i]))


def test_scores_of_nothing_and_without_training(spark):
    assert ppm.score_documents(spark.createDataFrame([], EMPTY)).collect() == []
    only = spark.createDataFrame([(None, "ab")], "doc_id bigint, text string")
    row = ppm.score_documents(only).first()
    assert row.held_out and (row.n_known, row.train_tokens) == (0, 0)
    assert row.score == pytest.approx(-3 * math.log10(257))


# ---------------------------------------------------------------- op4


def kneser_ney_logs(texts, order):
    """log10 of every sign's probability by the textbook recursion."""
    raw = counts_of(texts, order)
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    counts[order] = raw[order]
    for k in range(order - 1, -1, -1):
        for context, signs in counts[k + 1].items():
            for sign in signs:
                counts[k][context[1:]][sign] += 1
    discounts = []
    for table in counts:
        n = Counter(v for signs in table.values() for v in signs.values())
        if not n[1] or not n[2]:
            discounts.append([0.0, 0.5, 1.0, 1.5])
            continue
        y = n[1] / (n[1] + 2 * n[2])
        ds = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
        discounts.append([0.0] + [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(ds, 1)])

    def p(k, context, sign):
        shorter = 1 / 257 if k == 0 else p(k - 1, context[1:], sign)
        signs = counts[k].get(context)
        if not signs:
            return shorter
        total = sum(signs.values())
        taken = sum(discounts[k][min(v, 3)] for v in signs.values())
        n = signs[sign]
        return (n - discounts[k][min(n, 3)] + taken * shorter) / total

    return lambda context, sign: math.log10(p(order, context, sign))


def test_kneser_ney_equals_textbook(spark):
    rng = random.Random(3)
    train = ["".join(rng.choice("aaabbc d") for _ in range(rng.randrange(1, 200))) for _ in range(30)]
    other = ["", "abc", "zzz a", "a" * 50]
    df = frame(spark, train + other)
    model = kneser_ney.kneser_ney_model(gram_counts(df, df.doc_id < len(train), 3), 3)
    found = {r.doc_id: r.logp for r in with_scores(df, model, 3, "logp").collect()}
    log = kneser_ney_logs(train, 3)
    for i, text in enumerate(train + other):
        signs = sequence(text, 3)
        assert found[i] == pytest.approx(sum(log(tuple(signs[j - 3 : j]), signs[j]) for j in range(3, len(signs))))


def test_op4_keeps_trusted_and_drops_junk(spark, sf_dir):
    found = {r.doc_id: r for r in llm_queries()["op4_quality_classifier"](spark, sf_dir).collect()}
    assert set(found) == set(documents(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    kept = [found[r.doc_id].accepted for r in labels if r.quality == 1 and not r.toxic]
    junk = [found[r.doc_id].accepted for r in labels if r.quality == 0]
    assert sum(kept) / len(kept) > 0.98
    assert sum(junk) / len(junk) < 0.3
    assert all(r.accepted == (r.perplexity <= r.threshold * (1 + 1e-12)) for r in found.values())


def test_both_tails_are_cut_where_labels_say_so(spark):
    rng = random.Random(12)
    words = ["the", "the", "the", "the", "river", "stone", "garden", "light", "under", "seven", "quick", "house"]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(400)]
    repeated = ["the " * rng.randrange(40, 90) for _ in range(50)]
    noise = ["".join(rng.choices("qxzjkvw#%", k=300)) for _ in range(50)]
    texts = good + repeated + noise
    labels = spark.createDataFrame([(i, int(i < len(good)), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in kneser_ney.rated(frame(spark, texts), labels).collect()}
    kept = [found[i].accepted for i in range(len(texts))]
    assert sum(kept[: len(good)]) / len(good) > 0.95
    assert not any(kept[len(good) :])
    assert all(found[i].perplexity < found[i].least_perplexity < found[i].threshold for i in range(400, 450))


def test_rates_of_the_quality_classifier(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = llm_queries()["op4_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    kind = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("trusted").alias("kind")
    rates = {r.kind: r.share for r in found.groupBy(kind).agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
    assert rates["trusted"] > 0.92 and rates["junk"] < 0.13 and rates["toxic"] < 0.6


def test_quality_edge_cases(spark):
    texts = [None, "", "a plain text of words", "a plain text of words", "q" * 200_000]
    df = frame(spark, texts, extra=True).withColumn("cut", F.lit(1))
    labels = spark.createDataFrame([(i % 3, 1, None) for i in range(9)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = kneser_ney.rated(df, labels).collect()
    assert len(rows) == 5 and rows[0].cut == 1
    nobody = labels.filter("quality = 5")
    assert all(r.accepted for r in kneser_ney.rated(df, nobody).collect())
    assert kneser_ney.rated(df.limit(0), labels).collect() == []


# ---------------------------------------------------------------- op6


def lowered(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)


def expected_lines(texts, percent=80, size=8):
    places = defaultdict(list)
    out = {}
    for i, text in texts.items():
        for k, line in enumerate((text or "").split("\n")):
            out[i, k] = (i, k)
            if line.strip(" \t\n\r\x0b\x0c"):
                places[lowered(line)].append((i, k))
    sets = {min(p): {x[j : j + size] for j in range(len(x) - size + 1)} or {x} for x, p in places.items()}
    union = Union()
    for a, b in links(sets, percent):
        union.join(a, b)
    for p in places.values():
        for place in p:
            out[place] = union.root(min(p))
    return out


def test_op6_equals_brute_force(spark, sf_dir):
    found = llm_queries()["op6_line_dedup"](spark, sf_dir).collect()
    expected = expected_lines(documents(spark, sf_dir))
    assert {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in found} == expected
    assert all(r.kept == ((r.doc_id, r.line_no) == expected[r.doc_id, r.line_no]) for r in found)


def test_line_edge_cases(spark):
    near = "the quick brown fox jumps over the lazy dog near the old river bank today"
    long = "x".join(str(i) for i in range(60_000))
    texts = [None, "", "\n", "ab\n\nab", "AB", near, near.replace("today", "todaz"), "z\n" + long, long + "!", near + "\n" + near]
    found = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_components(frame(spark, texts, extra=True)).collect()}
    expected = expected_lines(dict(enumerate(texts)))
    assert {k: v[:2] for k, v in found.items()} == expected
    assert all(v[2] == (v[:2] == k) for k, v in found.items())
    kept = {r.doc_id: r for r in without_repeated_lines(frame(spark, texts, extra=True)).collect()}
    assert {i: kept[i].text for i in kept} == {0: None, 1: "", 2: "\n", 3: "ab\n", 5: near, 7: "z\n" + long}
    assert kept[3].n_chars == 3 and kept[5].dropped == 3


def test_lines_of_repeated_rows_and_nothing(spark):
    rows = [(1, "a line of text\nother words"), (1, "a line of text\nother words"), (None, "a line of text"), (2, "other words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in without_repeated_lines(df).collect()) == [(0, "a line of text"), (1, "other words")]
    assert line_components(spark.createDataFrame([], EMPTY)).collect() == []
    assert without_repeated_lines(spark.createDataFrame([], EMPTY)).collect() == []


# ---------------------------------------------------------------- op7


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_op7_equals_the_library(spark, sf_dir, tokenizer):
    found = {r.doc_id: r for r in llm_queries()["op7_bpe_roundtrip"](spark, sf_dir).collect()}
    texts = documents(spark, sf_dir)
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_odd_texts_encode_as_the_library_does(tokenizer, vocabulary):
    rng = random.Random(5)
    own, bytes_of = bpe.Vocabulary(vocabulary), bpe.token_bytes(vocabulary)
    texts = ["", " ", "  ", " a ", "a  b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "a" * 40, "\x1c \x85\xa0　b", "don't I'LL 's"]
    signs = ["a", "e", "the", " ", "  ", "\n", "1", "22", "!", "é", "ß", "😀", "\t", "​", "\x00", "'s", "中", "ⅷ"]
    for _ in range(3000):
        texts.append("".join(rng.choice([*signs, chr(rng.randrange(32, 0x2FFF))]) for _ in range(rng.randrange(1, 40))))
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert bpe.decode_ids(ids, bytes_of) == tokenizer.decode(ids, skip_special_tokens=False)
    for _ in range(500):  # ids that cut characters apart
        ids = [rng.randrange(50257) for _ in range(9)]
        assert bpe.decode_ids(ids, bytes_of) == tokenizer.decode(ids, skip_special_tokens=False)


def test_encoding_edge_cases(spark, vocabulary):
    texts = [None, "", "same words", "same words", "long " * 100_000]
    df = frame(spark, texts, extra=True).withColumnRenamed("key", "ids")
    rows = {r.doc_id: r for r in bpe.round_trip(df, vocabulary).collect()}
    assert [rows[i].decoded for i in range(5)] == ["" if t is None else t for t in texts]
    assert rows[0].ids == [] and rows[2].ids == rows[3].ids
    twice = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()}
    assert twice == {i: r.decoded for i, r in rows.items()}
    assert bpe.round_trip(df.limit(0), vocabulary).collect() == []


# ---------------------------------------------------------------- op8


def folded(text):
    return " ".join(lowered(text or "").split())


def distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_op8_finds_every_whole_item(spark, sf_dir):
    found = {r.doc_id: r for r in llm_queries()["op8_benchmark_decontamination"](spark, sf_dir).collect()}
    items = {r.item_id: folded(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    texts = documents(spark, sf_dir)
    whole = {i: [k for k, item in sorted(items.items()) if item in folded(t)] for i, t in texts.items()}
    assert sum(map(bool, whole.values())) > 5
    assert {i: r.item_ids for i, r in found.items()} == whole
    assert all(r.n_items == len(r.item_ids) for r in found.values())


def test_edited_items_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (2, 4, 6, 12, 20, 40)] + ["short", "tiny one"]
    rows, expected = [], {}
    for i in range(120):
        item = rng.choice(items)
        text = list(item)
        for _ in range(rng.randrange(0, 2 + len(item) // 12)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        rows.append(" ".join(word() for _ in range(rng.randrange(15))) + " " + "".join(text) + " " + word())
        expected[i] = [
            k for k, own in enumerate(items)
            if distance_inside(own, folded(rows[-1])) <= max(0, min(len(own) // 20, len(own) // min(12, len(own)) - 1))
        ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    for block in (10**6, 60):
        found = {r.doc_id: r.item_ids for r in benchmark_hits(frame(spark, rows), bench, block).collect()}
        assert found == expected


def test_decontamination_edge_cases(spark):
    item = "what is the capital of the country in the north of the world"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, "abc"), (3, "  ")], "item_id bigint, text string")
    texts = [None, "", "abc", item.upper(), "x " * 100_000 + item.replace(" ", "\n\n"), item, item]
    df = frame(spark, texts, extra=True)
    found = {r.doc_id: r.item_ids for r in benchmark_hits(df, bench).collect()}
    assert found == {0: [], 1: [], 2: [], 3: [1], 4: [1], 5: [1], 6: [1]}
    assert benchmark_hits(df.limit(0), bench).collect() == []
    assert all(r.item_ids == [] for r in benchmark_hits(df, bench.limit(0)).collect())


# ---------------------------------------------------------------- bands and keys


def full_distance(item, region):
    row = [0] * (len(region) + 1)
    for i, sign in enumerate(item):
        new = [i + 1]
        for j, other in enumerate(region):
            new.append(min(row[j] + (sign != other), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_band_holds_every_alignment_within_the_budget():
    from tablevet.llm.decontaminate import band_width, banded_distance

    rng = random.Random(12)
    for _ in range(400):
        item = np.array([rng.randrange(3) for _ in range(rng.randrange(1, 25))], np.uint32)
        region = [rng.randrange(3) for _ in range(rng.randrange(0, 12))]
        at = rng.randrange(len(region) + 1)
        copy = [x for x in item.tolist() if rng.random() > 0.1]
        region = np.array(region[:at] + copy + region[at:], np.uint32)
        for budget in (0, 1, 3, 6):
            assert banded_distance(item, region, budget) == min(full_distance(item.tolist(), region.tolist()), budget + 1)
    assert band_width(4000, 4600, 200) * 4000 < 4600 * 4000 / 4


def test_half_of_a_text_key_may_collide(spark, monkeypatch):
    texts = [f"a line of its own, number {i} of many\nand one that all have in common, word for word" for i in range(30)]
    expected = sorted(r.text for r in without_repeated_lines(frame(spark, texts)).collect())
    real = fuzzy_lines._text_key
    stub = lambda: F.struct(F.lit(5).cast("bigint").alias("high"), real().getField("low").alias("low")).alias("text_key")
    monkeypatch.setattr(fuzzy_lines, "_text_key", stub)
    assert sorted(r.text for r in without_repeated_lines(frame(spark, texts)).collect()) == expected
    assert len(expected) == 30


def test_bands_of_many_near_lines_that_do_not_all_link(spark):
    """Long lines around the limit: a large component, a few others and lines alone, by brute force."""
    rng = random.Random(21)
    base = [f"w{i:03d}" for i in range(150)]
    texts = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(4, 12)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6):06d}"
        texts.append(" ".join(words))
    found = {r.doc_id: r.first_doc_id for r in line_components(frame(spark, texts)).collect()}
    sets = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in enumerate(texts)}
    union = Union()
    for a, b in links(sets, 80):
        union.join(a, b)
    expected = {i: union.root(i) for i in sets}
    assert sum(found[i] == expected[i] for i in sets) >= 0.99 * len(sets)  # a pair at the limit may share no band
    assert all(union.root(found[i]) == union.root(i) for i in sets)


def test_a_word_keeps_its_ids_as_four_bytes_each():
    own = bpe.Vocabulary(bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")), cached_words=2)
    for text in ("", "one", " one", "one two, two  three\nfour", "Ci\u00f3n de la ci\u00f3n mente", "a b c d e f a b c"):
        assert np.frombuffer(own.packed(text), np.int32).tolist() == own.encode(text)
        assert own.packed(text) == own._pieces(text)
    assert all(isinstance(ids, bytes) and len(ids) % 4 == 0 for ids in own.words.values())


def test_sketches_do_not_depend_on_the_lines_beside():
    lines = [f"line {i} of many that are sketched together, or each alone" for i in range(40)]
    sizes, sketches = fuzzy_lines._sketches(pa.array(lines), 8)
    for i, line in enumerate(lines):
        size, sketch = fuzzy_lines._sketches(pa.array([line]), 8)
        assert size[0] == sizes[i] == len({line[j : j + 8] for j in range(len(line) - 7)})
        assert sketch.tolist() == sketches.reshape(len(lines), -1)[i].tolist()


def test_only_marked_lines_are_read_again():
    keys = pa.array([{"high": 1, "low": 77}, {"high": 2, "low": -5}])
    batch = pa.record_batch({"text_key": keys, "text": pa.array(["first line\nsecond line\nthird line", "other line"])})
    marks = np.zeros(fuzzy_lines.MARKS, np.uint8)
    marks[[(77 ^ 2 * fuzzy_lines._STEP) % fuzzy_lines.MARKS, -5 % fuzzy_lines.MARKS]] = 1
    packed = np.packbits(marks, bitorder="little").tobytes()
    found = [r for out in fuzzy_lines._marked_lines(iter([batch]), 8, packed) for r in out.to_pylist()]
    assert [(r["text_key"]["high"], r["line_no"], r["line"]) for r in found] == [(1, 2, "third line"), (2, 0, "other line")]


def test_pairs_of_long_lines_are_tested_in_pieces(monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    near = [base[:1500] + str(i) + base[1500:] for i in range(300)]
    other = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(3)]
    b_line = near[:100] + [other[0]] + near[101:200] + [other[1], None] + near[202:299] + [other[2]]
    ids = pa.array(range(300))
    batch = pa.record_batch({"a": ids, "b": ids, "a_line": pa.array([base] * 300), "b_line": pa.array(b_line)})
    held, real = [], fuzzy_lines._distinct
    monkeypatch.setattr(fuzzy_lines, "_distinct", lambda rows, *rest: held.append(len(rows)) or real(rows, *rest))
    found = [i for out in fuzzy_lines._verified(iter([batch, batch.slice(0, 0)]), 8, 80) for i in out.column("a").to_pylist()]
    assert found == [i for i in range(300) if i not in (100, 200, 201, 299)]
    assert max(held) <= fuzzy_lines.PIECE


def test_edges_of_stars_need_no_round(spark, monkeypatch):
    rounds, real = [], components_module._round
    monkeypatch.setattr(components_module, "_round", lambda edges: rounds.append(1) or real(edges))
    for edges, least in (
        ([], 0), ([(1, 2), (3, 1), (1, 4), (5, 6)], 0), ([(1, 2), (2, 3)], 1), ([(1, 3), (2, 3)], 1), ([(i, i + 1) for i in range(40)], 2),
    ):
        rounds.clear()
        union = Union()
        for a, b in edges:
            union.join(a, b)
        found = components_module.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert {r.node: r.component for r in found} == {x: union.root(x) for edge in edges for x in edge}
        assert len(found) == len({x for edge in edges for x in edge})
        assert len(rounds) == 0 if least == 0 else len(rounds) >= least


def test_only_sets_of_near_long_texts_are_read(spark, monkeypatch):
    """Long texts that share four words of ten meet in parts; wide sketches of either length tell them from linked ones."""
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = words(2600)
    texts = [common + words(3900) for _ in range(6)]
    linked = words(4050)
    texts += [linked, linked + words(200), words(20) + linked[40:]]  # 4,096 bits, 8,192 bits, 4,096 bits
    texts = [" ".join(x) for x in texts]
    read, real = [], parity_join.staged

    def counted(df):
        out = real(df)
        if "elements" in out.columns:
            read.extend(r.doc_id for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(parity_join, "staged", counted)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(frame(spark, texts), 5, 80).collect()}
    assert found == expected_components(dict(enumerate(texts)), 5, 80)
    assert found[7][1] == found[8][1] == 6
    assert set(read) == {6, 7, 8}


def test_texts_are_shuffled_once_when_lines_go(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = without_repeated_lines(frame(spark, ["the first line\nanother line", "the first line\na third line"]))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the texts, and the numbers of the lines that go
        assert sorted(r.text for r in out.collect()) == ["a third line", "the first line\nanother line"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_one_running_sum_over_the_characters_of_a_slice(monkeypatch):
    rng = random.Random(8)
    texts = ["", "\n", "abc\n\n  \t\nABCDEFGH\nabcdefgh", None, "seven77", "é" * 9 + "\n\U0001f600 and more\n", "x", "".join(rng.choice("ab cé\n") for _ in range(3000)), "end"]
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    at = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    sums, real = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda x, *a, **k: sums.append(len(x)) or real(x, *a, **k))
    own = fuzzy_lines._Lines(data, at, 8)
    own.second()
    assert sum(n > 1500 for n in sums) == 1  # the rolling hash
    monkeypatch.undo()
    lines = [line.translate({c: c + 32 for c in range(65, 91)}) for t in texts for line in (t or "").split("\n")]
    assert own.counts.tolist() == [(t or "").count("\n") + 1 for t in texts]
    assert own.blank.tolist() == [not line.strip(" \t\n\v\f\r") for line in lines]
    runs = [[line[i : i + 8] for i in range(max(1, len(line) - 7))] if line else [] for line in lines]
    assert own.shingles.tolist() == [len(x) for x in runs]
    named = defaultdict(set)
    for run, found in zip((x for own_runs in runs for x in own_runs), own.hashes.tolist(), strict=True):
        named[run].add(found)
    assert all(len(x) == 1 for x in named.values()) and len({min(x) for x in named.values()}) == len(named)
    second = own.second().tolist()
    assert all((a == b) == (x == y) for a, x in zip(second, lines) for b, y in zip(second, lines))
