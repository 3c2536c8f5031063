"""Pages, licences, replicas, vectors, components and the pipeline."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablevet.llm import graph_index, licences, templates, warc_fixity
from tablevet.llm.components import components
from tablevet.llm.queries import llm_oracles, llm_queries
from tablevet.sources.scratch import staged
from tests.oracle import connect, spark_result, sql_result

# ---------------------------------------------------------------- components


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    rows = [*edges, *edges[:9], (None, 3), (5, None)]
    found = components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert len(found) == len(nodes)
    assert {r.node: r.component for r in found} == {x: root(x) for x in nodes}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# ---------------------------------------------------------------- op3


def test_op3_matches_sql(spark, sf_dir):
    found = spark_result(llm_queries()["op3_warc_merkle_fixity"](spark, sf_dir))
    assert found == sql_result(connect(sf_dir), llm_oracles()["op3_warc_merkle_fixity"])
    assert found[1]


def records(spark, rows):
    return spark.createDataFrame(rows, "file bigint, offset bigint, length bigint, digest string")


def test_audit_finds_changes_losses_and_additions(spark):
    rng = random.Random(6)
    rows = [(f, o * 9000 + f, 9000, f"{f}-{o}") for f in range(3) for o in range(400)]
    other = list(rows)
    changed = rng.sample(range(len(rows)), 7)
    for i in changed[:3]:
        other[i] = (*rows[i][:3], "rotten")
    other[changed[3]] = (*rows[changed[3]][:2], 8999, rows[changed[3]][3])
    gone = {rows[i] for i in changed[4:]}
    other = [r for r in other if r not in gone] + [(1, 5_000_000_000, 10, "new"), (7, 0, 5, "new file")]
    found = warc_fixity.audit(records(spark, rows), records(spark, other)).collect()
    assert {(r.file, r.offset, r.status) for r in found} == (
        {(*rows[i][:2], "changed") for i in changed[:4]}
        | {(*r[:2], "missing") for r in gone}
        | {(1, 5_000_000_000, "extra"), (7, 0, "extra")}
    )
    assert len(found) == 9


def test_audit_edge_cases(spark):
    none, one = records(spark, []), records(spark, [(0, 0, 3, "a"), (None, 1, 1, "x"), (0, None, 1, "x")])
    assert warc_fixity.audit(none, none).collect() == []
    assert warc_fixity.audit(one, one).collect() == []
    assert [r.status for r in warc_fixity.audit(one, none).collect()] == ["missing"]
    assert [r.status for r in warc_fixity.audit(none, one).collect()] == ["extra"]
    twice = records(spark, [(0, 0, 3, "a"), (0, 0, 3, "a")])
    assert [r.status for r in warc_fixity.audit(one, twice).collect()] == ["changed"]
    pages = spark.createDataFrame([(None, 5, "d"), (1, 7, "e"), (2, 9, "f")], "page_id bigint, length bigint, digest string")
    placed = {r.page_id: (r.file, r.offset) for r in warc_fixity.as_records(pages).collect()}
    assert placed[1] == (0, 0) and placed[2] == (0, 7) and placed[None][0] < 0


# ---------------------------------------------------------------- op5


def exact_nearest(ids, vectors, query, k):
    i = int(np.flatnonzero(ids == query)[0])
    scores = vectors @ vectors[i]
    scores[i] = -np.inf
    return [int(ids[j]) for j in np.lexsort((ids, -scores))[:k]]


def test_op5_recall_and_scores(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    found = llm_queries()["op5_nearest_neighbours"](spark, sf_dir).toPandas()
    place = {v: i for i, v in enumerate(ids)}
    queries = [q for q in ids if q % 20 == 0]
    assert sorted(found.query_id.unique()) == queries
    hits = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert q not in set(own.vec_id)
        exact = np.array([vectors[place[v]] @ vectors[place[q]] for v in own.vec_id])
        assert np.allclose(own.score, exact, rtol=1e-12)
        assert all(a > b or (a == b and x < y) for a, b, x, y in zip(own.score, own.score[1:], own.vec_id, own.vec_id[1:]))
        hits += len(set(own.vec_id) & set(exact_nearest(ids, vectors, q, 20)))
    assert hits / (20 * len(queries)) >= 0.9


def test_nearest_in_many_shards_and_dimensions(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 12)) * rng.uniform(0.2, 3, size=(600, 1))
    rows = [(i, [float(np.float32(x)) for x in v], "extra") for i, v in enumerate(vectors)]
    flat = np.array([r[1] for r in rows])
    rows += [(1000 + i, [1.0, float(i)], "short") for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    found = graph_index.nearest(df, df.filter("vec_id % 20 = 0"), k=5, shard_points=150).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        own = found[found.query_id == q].sort_values("rank").vec_id.tolist()
        hits += len(set(own) & set(exact_nearest(np.arange(600), flat, q, 5)))
    assert hits / (5 * 30) >= 0.9
    assert sorted(found[found.query_id == 1000].vec_id) == [1001, 1002, 1003, 1004]


def test_nearest_of_equal_and_unusable_vectors(spark):
    same, other = [1.0, 0.0], [0.6, 0.8]
    rows = [(i, same) for i in range(60)] + [(100, other), (101, None), (102, [0.0, 0.0]), (103, [1.0, None])]
    rows += [(104, [math.nan, 1.0]), (105, [math.inf, 1.0]), (None, same), (106, []), (100, other)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = graph_index.nearest(df, df.filter("vec_id % 20 = 0 OR vec_id > 100"), k=20).toPandas()
    assert sorted(found.query_id.unique()) == [0, 20, 40, 100]
    assert found[found.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 21))
    assert found[found.query_id == 40].sort_values("rank").vec_id.tolist() == list(range(20))
    assert found[found.query_id == 100].sort_values("rank").vec_id.tolist() == list(range(20))
    few = df.filter("vec_id IN (0, 1, 100)")
    assert graph_index.nearest(few, few.filter("vec_id = 0"), k=20).count() == 2
    assert graph_index.nearest(df.limit(0), df.limit(0)).collect() == []
    assert graph_index.nearest(df, df.limit(0)).collect() == []


@pytest.mark.parametrize("size", [1e30, 1e-30, 1.0])
def test_nearest_of_doubles_of_any_size_in_several_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(graph_index, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(400, 10)) * rng.uniform(0.3, 2, size=(400, 1)) * size
    df = spark.createDataFrame([(i, v.tolist(), "q", 1.0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, query string, rank double")
    found = graph_index.nearest(df, df.filter("vec_id % 4 = 0"), k=15, shard_points=90).toPandas()
    assert found.groupby("query_id").size().tolist() == [15] * 100
    hits = 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        assert np.allclose(own.score, vectors[own.vec_id.to_numpy()] @ vectors[q], rtol=1e-12)
        hits += len(set(own.vec_id) & set(exact_nearest(np.arange(400), vectors, q, 15)))
    assert hits / (15 * 100) >= 0.9


def test_a_shard_beyond_its_numbers_is_refused():
    with pytest.raises(ValueError):
        graph_index._graph(range((1 << 15) + 1), 1.0, 1.0)


# ---------------------------------------------------------------- op9


def expected_licences(files):
    """Plain TF-IDF cosine of every line of every file with every template."""
    import re

    low = str.maketrans(licences._UPPER, licences._LOWER)
    words = lambda s: re.findall(licences.WORD, s.translate(low))
    lines = [(p, words(line)) for p, text in files for line in (text or "").split("\n")]
    wanted = {name: words(t) for name, t in licences.TEMPLATES.items()}
    known = {w for t in wanted.values() for w in t}
    df = {w: sum(w in set(own) for _, own in lines) for w in known}
    idf = lambda w: math.log((len(lines) + 1) / (df.get(w, 0) + 1))
    vector = lambda own: {w: own.count(w) * idf(w) for w in set(own)}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, own in lines:
        a = vector(own)
        for name, t in wanted.items():
            b = vector(t)
            if norm(a) and norm(b):
                cosine = sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)
                if cosine >= licences.LEAST_COSINE:
                    out[path] = min(out.get(path, (0, "~")), (-round(cosine, 9), name))
    return {p: (name, -c) for p, (c, name) in out.items()}


def test_op9_equals_brute_force(spark, sf_dir):
    found = {r.doc_id: r for r in llm_queries()["op9_license_scans"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert set(found) == {r.doc_id for r in docs}
    own = expected_licences([(r.doc_id, r.text) for r in docs])
    assert {i: (r.licence, pytest.approx(r.cosine, abs=1e-6)) for i, r in found.items() if r.origin == "own"} == own
    givers = {}
    for i in sorted(own, key=lambda i: found[i].path):
        if i % 10 == 0:
            givers.setdefault(found[i].path.rpartition("/")[0], i)
    for i, r in found.items():
        if i not in own:
            parts = r.path.split("/")[:-1]
            near = next((givers[d] for n in range(len(parts), -1, -1) if (d := "/".join(parts[:n])) in givers), None)
            assert (r.origin, r.licence) == (("none", None) if near is None else ("inherited", own[near][0]))
            assert r.source_path == (None if near is None else found[near].path)


def test_licence_lines_near_a_template(spark):
    rng = random.Random(8)
    filler = ["the", "of", "version", "is", "this", "work", "code", "apple", "river", "stone", "x1", "under"]
    files = []
    for i in range(150):
        words = rng.choice(list(licences.TEMPLATES.values())).split()
        for _ in range(rng.randrange(5)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(filler))
        if rng.random() < 0.4:
            del words[rng.randrange(len(words))]
        files.append((f"f{i}", "plain words here\n" + " ".join(words) + "\n" + " ".join(rng.choices(filler, k=9))))
    df = spark.createDataFrame(files, "path string, text string")
    found = {r.path: (r.licence, pytest.approx(r.cosine, abs=1e-6)) for r in licences.line_licences(df).collect()}
    assert found == expected_licences(files)


def true_idf_licences(files):
    """As ``expected_licences``, but every word of every line has its own document frequency."""
    import re
    from collections import Counter

    low = str.maketrans(licences._UPPER, licences._LOWER)
    lines = [(p, Counter(re.findall(licences.WORD, line.translate(low)))) for p, text in files for line in (text or "").split("\n")]
    df = Counter(w for _, own in lines for w in own)
    vector = lambda own: {w: n * math.log((len(lines) + 1) / (df[w] + 1)) for w, n in own.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    wanted = {name: vector(Counter(re.findall(licences.WORD, t.translate(low)))) for name, t in licences.TEMPLATES.items()}
    out = {}
    for path, own in lines:
        a = vector(own)
        for name, b in wanted.items():
            if norm(a) and norm(b):
                cosine = sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)
                if cosine >= licences.LEAST_COSINE:
                    out[path] = min(out.get(path, (0, "~")), (-round(cosine, 9), name))
    return {p: (name, -c) for p, (c, name) in out.items()}


@pytest.mark.parametrize("common_share", [licences.COMMON_SHARE, 20])
def test_every_word_of_a_line_has_its_document_frequency(spark, monkeypatch, common_share):
    monkeypatch.setattr(licences, "COMMON_SHARE", common_share)
    rng = random.Random(9)
    often = ["and", "that", "for", "it", "all", "with"]
    files = [(f"p{i}", "\n".join(" ".join(rng.sample(often, 5)) + f" w{i}x{j}" for j in range(20))) for i in range(40)]
    files.append(("mit", "Released under the MIT License, and with that it is for all."))
    for i in range(80):
        words = rng.choice(list(licences.TEMPLATES.values())).split()
        for _ in range(rng.randrange(7)):
            words.insert(rng.randrange(len(words) + 1), rng.choice([*often, "river", "stone"]))
        files.append((f"f{i}", "some text\n" + " ".join(words)))
    expected = true_idf_licences(files)
    assert expected["mit"][0] == "MIT" and "mit" not in expected_licences(files)
    df = spark.createDataFrame([(*f, False) for f in files], "path string, text string, is_licence_file boolean")
    found = {r.path: (r.licence, pytest.approx(r.cosine, abs=1e-6)) for r in licences.scan_licences(df).collect() if r.origin == "own"}
    assert found == expected


def commented(text, mark="# "):
    return "\n".join(mark + line for line in text.split("\n"))


def test_licence_texts_headers_and_titles(spark):
    from tablevet.llm.licence_texts import full_texts

    texts = full_texts()
    rng = random.Random(10)
    prose = ["the", "of", "to", "and", "in", "a", "river", "stone", "license", "mit", "software", "this", "is"]
    files = [(f"p{i}", "\n".join(" ".join(rng.choices(prose, k=9)) + f" w{i}x{j}" for j in range(20)), None) for i in range(60)]
    files += [(f"{name}/LICENSE", text, name) for name, text in texts.items()]
    gpl = (
        "This program is free software: you can redistribute it and/or modify\n"
        "it under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    )
    code = "import os\nprint(os.sep)\nfor x in range(9):\n    river(x)"
    permission = texts["MIT"].split("\n\n")[2]
    files += [
        ("gpl.py", f"{commented(gpl)}\n{code}", "GPL-3.0"),
        ("agpl.py", f"{commented(gpl.replace('GNU', 'GNU Affero'))}\n{code}", "AGPL-3.0"),
        ("lgpl.c", "/*\n" + commented(gpl.replace("GNU", "GNU Lesser"), " * ") + "\n */\n" + code, "LGPL-3.0"),
        ("mit.py", " ".join(permission.split()) + "\n\n" + code, "MIT"),
        ("title.md", "# Notes\n\nstone and river\n\nMIT License\n", "MIT"),
        ("spdx.py", f"# SPDX-License-Identifier: Apache-2.0\n{code}", "Apache-2.0"),
        ("spdx.c", f"// SPDX-License-Identifier: GPL-2.0-or-later\n{code}", "GPL-2.0"),
        ("isc.c", f"// SPDX-License-Identifier: ISC\n{code}", None),
        ("word.txt", "license", None),
    ]
    df = spark.createDataFrame([(p, t, p.endswith("LICENSE")) for p, t, _ in files], "path string, text string, is_licence_file boolean")
    found = {r.path: r.licence for r in licences.scan_licences(df).collect()}
    assert found == {p: name for p, _, name in files}


def test_licence_edge_cases(spark):
    mit = "Released under the MIT License"
    rows = [
        ("LICENSE", mit, True), ("a/LICENSE", "Licensed under CC BY 4.0", True), ("a/b/c.txt", None, False),
        ("z.txt", "", None), ("a/LICENSE", "Licensed under CC BY 4.0", True), ("/abs/x", "word " * 50_000 + "\n" + mit.upper(), False),
        (None, mit, True), ("b/own", "Licensed under the Apache License, Version 2.0.", False), ("b/d/e", "no", False),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "path string, text string, is_licence_file boolean, licence string, dir int")
    found = {r.path: (r.licence, r.origin, r.source_path) for r in licences.scan_licences(df).collect()}
    assert found == {
        "LICENSE": ("MIT", "own", "LICENSE"), "a/LICENSE": ("CC-BY-4.0", "own", "a/LICENSE"),
        "a/b/c.txt": ("CC-BY-4.0", "inherited", "a/LICENSE"), "z.txt": ("MIT", "inherited", "LICENSE"),
        "/abs/x": ("MIT", "own", "/abs/x"), "b/own": ("Apache-2.0", "own", "b/own"), "b/d/e": ("MIT", "inherited", "LICENSE"),
    }
    assert licences.scan_licences(df.limit(0)).collect() == []


# ---------------------------------------------------------------- op10


def test_op10_extracts_the_article(spark, sf_dir):
    import html
    import re

    found = {r.page_id: r for r in llm_queries()["op10_html_extraction"](spark, sf_dir).collect()}
    for page in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        expected = "\n".join(b for b in blocks if b)
        assert found[page.page_id].text == expected
        assert found[page.page_id].n_chars == len(expected)
        assert found[page.page_id].url == page.url


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><article>";</script></head>
<body><header>Site <b>name</b></header><nav><ul><li>Menu<li>More</ul></nav><div id="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; tail</h1><p>One<br>two
 <b>three</p><p>four &lt;tag&gt; &eacute;&#233;<ul><li>x<li>y</ul><aside>aside</aside><div class="ad slot">buy</div>
<form><p>mail me</p></form><!-- note --><section class="comments"><p>first!</p></section></article></main>
<footer>foot</footer>"""


def test_main_text_of_a_messy_page():
    assert templates.main_text(PAGE, set()) == "Head & tail\nOne two three\nfour <tag> éé\nx\ny"
    assert templates.main_text("", set()) == ""
    assert templates.main_text("plain <i>text</i> 1 < 2", set()) == "plain text 1 < 2"
    assert templates.main_text("<p>a<script>x</script>b<div>c</p>d", set()) == "ab\nc\nd"
    assert templates.main_text("<div hidden>a</div><p style='display: none'>b</p><p>c", set()) == "c"
    assert templates.main_text("<a title='1 > 0'>x</a><![CDATA[y]]><p>" + "<b>" * 3000 + "z", set()) == "xy\nz"


def test_wrappers_named_like_parts_do_not_lose_the_article():
    side = '<div class="sidebar-left"><p>side</p></div><div id="site-footer">foot</div><div class="ad slot">buy</div>'
    article = "<article{}><h1>Head</h1><p>Text of the story</article>"
    for page in (
        '<div class="content-sidebar-wrap">' + article.format("") + side + "</div>",
        '<div class="site has-navbar">' + article.format("") + side + "</div>",
        article.format(' class="post category-social"') + side,
        article.format(' class="post tag-banner"') + side,
        article.format(' class="widget"') + side,
        '<div class="widget">' + article.format("") + "</div>" + side,
        '<div class="promo"><h1>Head</h1><p>Text of the story</div>' + side,
        '<div class="post tag-banner"><h1>Head</h1><p>Text of the story</div>' + side,
        article.format("") + '<div class="comments"><article class="comment"><p>' + "first " * 90 + "</article></div>",
    ):
        assert templates.main_text(f"<html><body class='has-sidebar'>{page}</body></html>", set()) == "Head\nText of the story", page


def test_recurring_subtrees_are_deleted_but_not_quoted_passages(spark):
    page = "<body><div><span>Welcome to {h}</span></div>{main}<div>Terms apply</div></body>"
    rows = []
    for i in range(8):
        main = f"<div><p>Story {i}</p><p>Often quoted</p></div>" if i < 4 else f"<article><p>Story {i}</p><p>Often quoted</p><div>Share this</div></article>"
        host = "a.example" if i < 4 else "b.example"
        rows.append((i, f"http://{host}/{i}", page.format(h=host, main=main), "s", 1))
    rows += [(90, None, None, "s", 1), (91, "no url", "", "s", 1), (92, "http://c.example", "<p>Once", "s", 1), (92, "http://c.example", "<p>Once", "s", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, subtrees string, host int")
    found = templates.main_texts(df).collect()
    texts = {r.page_id: r.text for r in found}
    assert len(found) == 12 and found[0].host == 1
    assert all(texts[i] == f"Story {i}" for i in range(4))
    assert all(texts[i] == f"Story {i}\nOften quoted" for i in range(4, 8))
    assert (texts[90], texts[91], texts[92]) == ("", "", "Once")
    assert templates.main_texts(df.limit(0)).collect() == []


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_do_what_their_operators_say(spark, sf_dir):
    from tests.llm.test_text_operators import expected_components, expected_lines, folded

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        texts = {i: r.text for i, r in before.items()}
        if name == "quality classifier":
            rated = {r.doc_id for r in llm_queries()["op4_quality_classifier"](spark, sf_dir).filter("accepted").collect()}
            assert set(after) == rated and 0 < len(after) < len(before)
        elif name == "line dedup":
            places = expected_lines(texts)
            for i, text in texts.items():
                kept = "\n".join(line for k, line in enumerate(text.split("\n")) if places[i, k] == (i, k))
                assert (after[i].text == kept) if i in after else not kept.strip()
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "n-gram Jaccard join":
            expected = expected_components(texts, 5, 80)
            assert set(after) == {i for i, (_, c) in expected.items() if c == i}
        elif name == "benchmark decontamination":
            items = [folded(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            clean = {i for i, t in texts.items() if not any(item in folded(t) for item in items)}
            assert set(after) == clean < set(before)
        else:
            assert set(after) == set(before)
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after.values())
            continue
        assert docs.columns == columns
        before = after
    assert corpus_pipeline.run(spark, sf_dir).select(F.count("*")).first()[0] == len(after)


def test_pipeline_stages_on_empty_tables_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        assert stage(spark, odd, sf_dir).count() >= 1
