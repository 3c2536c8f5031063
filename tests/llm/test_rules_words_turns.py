"""Adaptive rules, spelling variants and conversation repair: SQL, brute force and the cases they define."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablevet.llm import adaptive_rules, turn_repair, word_variants
from tablevet.llm.queries import llm_oracles, llm_queries
from tests.oracle import connect, spark_result, sql_result

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, w int, kept string, rule string"


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_spelling_variants", "op13_conversation_repair"])
def test_matches_sql(name, spark, sf_dir):
    found = spark_result(llm_queries()[name](spark, sf_dir))
    assert found == sql_result(connect(sf_dir), llm_oracles()[name])
    assert found[1]


# ---------------------------------------------------------------- op11


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = list(zip(words, words[1:], words[2:]))
    times, inside = Counter(runs), set()
    for i, run in enumerate(runs):
        if times[run] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(inside)


ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\ny\nx\n \n \ny", " lead ing  é\x0bè\x0c\x1ctail\r\n",
    "<b>#1</b> | 50% & $3 *\n<b>#1</b>", "\x00 nul \x85 next sep", "ab " * 3000, "😀 😀 😀 😀",
]


def documents(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, "x", 1, "k", "r") for i, t in enumerate(texts)], DOCS)


def test_measures_of_odd_texts(spark):
    docs = documents(spark, ODD_TEXTS)
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    found = {r.doc_id: tuple(r[n] for n in names) for r in adaptive_rules.text_measures(docs).collect()}
    assert found == {i: measures(t) for i, t in enumerate(ODD_TEXTS)}


def prose(rng, n=80):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 7))) for _ in range(n))


def test_thresholds_follow_source_and_language(spark):
    rng = random.Random(3)
    tables = "\n".join(f"{a} | {b}" for a, b in zip(prose(rng).split(), prose(rng).split()))
    rows = [(i, prose(rng), "en", "prose") for i in range(300)] + [(1000, tables, "en", "prose")]
    rows += [(2000 + i, "\n".join(f"{prose(rng, 3)} | {i}" for _ in range(30)), "en", "tables") for i in range(300)]
    rows += [(3000, prose(rng), None, None), (3000, prose(rng), None, None), (3001, None, "xx", "tiny"), (3002, prose(rng), "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = adaptive_rules.judged(docs)
    by_id = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert all(by_id[i].kept for i in range(300))
    assert by_id[1000].failed_rules == ["symbol_share"]  # a table among prose, but tables have a source of their own
    assert all(by_id[2000 + i].kept for i in range(300))
    assert by_id[3000].kept and by_id[3002].kept and by_id[3001].base_failed and not by_id[3001].kept


def test_sketches_merge_in_any_order(spark):
    rng = random.Random(5)
    measured = adaptive_rules.text_measures(documents(spark, [prose(rng, rng.randrange(5, 90)) for _ in range(400)]))
    whole = adaptive_rules.sketches(measured)
    parts = [adaptive_rules.sketches(measured.filter(F.col("doc_id") % 3 == i)) for i in range(3)]
    union = parts[2].unionByName(parts[0]).unionByName(parts[1])
    key = lambda df: sorted(map(tuple, df.select("lang", "source", "rule", "bucket", "n").collect()))
    assert key(adaptive_rules.merged(union, "lang", "source")) == key(whole)
    exact = measured.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n_words * 0 + (word_chars * 10000L) DIV n_words)").first()[0]
    q2 = adaptive_rules._quartiles(adaptive_rules.merged(whole), adaptive_rules.RULES).first().word_length_q2
    assert q2 <= exact < q2 * (1 + 1 / adaptive_rules.BUCKETS_AN_OCTAVE) + 1


def test_salted_join_gives_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = sorted(map(tuple, adaptive_rules.judged(docs).select("doc_id", "kept").collect()))
    monkeypatch.setattr(adaptive_rules, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, adaptive_rules.judged(docs).select("doc_id", "kept").collect())) == before


def test_rules_use_no_python_workers(spark, sf_dir):
    plan = adaptive_rules.text_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rules_on_an_empty_table(spark):
    assert adaptive_rules.judged(documents(spark, []).limit(0)).collect() == []
    alone = adaptive_rules.judged(documents(spark, ["few words"])).collect()
    assert [(r.base_failed, r.kept, r.failed_rules) for r in alone] == [(True, False, [])]


# ---------------------------------------------------------------- op12


def damaged_runs(rows):
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            yield run


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected_variants(counts, times=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_damaged_words(spark):
    rows = [(i, f"Straße déjà-VU ÉCOLE été x{i}y Ñandú Wörter word{chr(0xd7)}word " * 40) for i in range(40)] + [(None, "Abcdef a"), (7, None), (8, "123 _")]
    found = word_variants.damaged_words(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(r.word for r in found.collect()) == Counter(damaged_runs(rows))


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice("abcdeéß÷ÿ") for _ in range(rng.randrange(6, 10)))
        n = rng.choice([5, 7, 40, 600, 600, 9000])
        counts[base] = n
        for _ in range(8):
            i, c = rng.randrange(len(base)), rng.choice("abcdeéß÷ÿ")
            edited = rng.choice([base[:i] + c + base[i:], base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :]])
            if len(edited) >= 6:
                counts.setdefault(edited, rng.choice([5, 6, max(5, n // 5), max(5, n // 5 - 1), n]))
                base = edited if rng.random() < 0.3 else base
    counts |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "aaaaaaaaaa": 3125, "aaaaaaaaaaa": 15625}  # a long chain
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in word_variants.variants(words).collect()}
    assert found == expected_variants(counts)


@pytest.mark.parametrize("symbols", [1, 3])
def test_neighbourhood_is_complete(spark, symbols):
    letters = "".join(map(str, range(symbols)))
    every = {"".join(p) for n in range(6) for p in itertools.product(letters, repeat=n)}
    rows = spark.createDataFrame([(x,) for x in sorted(every) if 0 < len(x) < 5], "r string")
    made = rows.selectExpr("r", f"{word_variants.neighbourhood('r', symbols)} AS near").collect()
    for row in made:
        assert set(row.near) == {x for x in every if x == row.r or one_edit(x, row.r)} | ({row.r} if symbols > 1 else {row.r})
        assert len(row.near) == len(set(row.near))


def test_no_words_at_all(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert word_variants.variants(empty).collect() == []


# ---------------------------------------------------------------- op13

TURNS = "conv_id bigint, turn bigint, role string, text string, copies string, kind int"


def brute_force(rows):
    """All repairs of a few rows: the least (cost, audit) and its lines."""
    seen, kinds = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
        seen.add((role, text))
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def go(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for more in inserts:
            own = lines + [(r, "") for r in more]
            c, a = cost + 5 * len(more), audit + "I" * len(more)
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in own)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, own)
                continue
            role, text = rows[i]
            go(i + 1, c + 2, a + "D", own)
            if kinds[i] in ("", "truncated"):
                late = 5 if kinds[i] else 0
                go(i + 1, c + late, a + "K", own + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + 1 + late, a + "R", own + [(new, text)])

    go(0, 0, "", [])
    illegal = sum(((a[0][:1] or "?") + (b[0][:1] or "?")) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = Counter(kinds)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return (counts["blank"], counts["duplicate"], counts["truncated"], illegal, best[0], best[1], digest)


def repaired(spark, convs, **options):
    rows = [(c, t, r, x, 1) for c, turns in convs.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies bigint")
    df = df.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in turn_repair.repaired_conversations(df, **options).collect()}


def random_conversations(rng, n, rows):
    roles = ["user", "assistant", "user", "assistant", "system", "", "tool", "sys"]
    texts = ["Hello.", "Yes!", "no", " ", "", "Why? ", "Hello."]
    return {c: [(t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {t}.") for t in range(rng.randrange(1, rows + 1))] for c in range(n)}


def test_cheapest_repairs(spark):
    convs = random_conversations(random.Random(1), 120, 5)
    found = repaired(spark, convs)
    assert {c: f[1:] for c, f in found.items()} == {c: brute_force([(r, x) for _, r, x in turns]) for c, turns in convs.items()}


def test_long_conversations_in_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    convs = random_conversations(rng, 25, 90)
    convs[None] = [(None, "user", "a."), (None, "user", "a."), (3, "assistant", "b."), (9, "user", "c")] * 3
    convs[77] = [(5, "user", "same.")] * 40 + [(6, "assistant", "b.")]
    whole = repaired(spark, convs)
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", 4)
    monkeypatch.setattr(turn_repair, "FAN_IN", 2)
    assert repaired(spark, convs, block_rows=5) == whole
    assert whole[77][:6] == (0, 0, 39, 0, 39, 78)
    assert whole[None][0] == 9 - 3 + 1 - 2


def test_damage_and_what_is_left(spark):
    rows = [(c, t, r, x, "k", 1) for c in range(60) for t, r, x in ((None, None, None), (0, "user", "Hi. You!"), (1, "assistant", "Yes?"))]
    rows += [(None, 2, "system", "Be kind.", "k", 1), (500, 0, None, "", "k", 1)]
    found = Counter()
    for r in turn_repair.damaged(spark.createDataFrame(rows, TURNS)).collect():
        found[r.conv_id, r.turn, r.role, r.text] += r.copies
    expected = Counter()
    for c, t, role, text, _, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            expected[c, None, "", ""] += 0
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        expected[c, t, "user" if kind == 4 else role, text] += 2 if kind == 3 else 1
    assert {k: v for k, v in found.items() if v} == {k: v for k, v in expected.items() if v}
    assert {k[0] for k in found} == {k[0] for k in expected}


def test_conversation_without_rows(spark):
    df = spark.createDataFrame([(4, None, "", "", 0)], "conv_id bigint, turn bigint, role string, text string, copies bigint")
    row = turn_repair.repaired_conversations(df).first()
    assert tuple(row) == (4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert turn_repair.repaired_conversations(df.limit(0)).collect() == []
