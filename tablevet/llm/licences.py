"""Licence scan of files, with DataFrame functions only.

A part of a file and a licence template are sparse TF-IDF vectors over words; a file carries the
template with the largest cosine to any of its parts, if that is large enough.  Parts are its lines,
its blocks (adjacent lines, all commented or none) and the whole file; templates are one-line
headers, standard notices and full texts.  Only lines that have words of a one-line header, and blocks of files that share
enough with any template, get vectors.  An SPDX line or a line or block that is just a licence's title counts as a cosine of 1.
Files without one inherit from the nearest directory above them that has a licence file which carries one.

Word weights come from all lines: of each word, from the number of lines that hold it (``line_frequencies``).
Of a template's words, the most frequent ones in the corpus
together weigh less than the least cosine, so by Cauchy and Schwarz a line that shares only these
cannot reach it: lines without any of the other words need no vector.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablevet.llm.licence_texts import HEADERS, TITLES, full_texts
from tablevet.sources.scratch import staged

#: How common licences are named in a header, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
}
LEAST_COSINE = 0.7
SALTS = 16
COMMON_SHARE = 10_000
WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, _UPPER, _LOWER), F.lit(f"({WORD})"), 1)


def _template_words(templates: dict[str, str]) -> dict[str, Counter]:
    return {name: Counter(re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))) for name, text in templates.items()}


def _lines(files: DataFrame, *keys: str) -> DataFrame:
    return files.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def word_weights(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> tuple[dict[str, float], float]:
    """(ln((lines + 1) / (lines with the word + 1)) for each word of the templates, the same for an unseen word)."""
    known = sorted({w for words in _template_words(templates).values() for w in words})
    lines = _lines(files)
    own = F.array_intersect(_words(F.col("line")), F.array(*map(F.lit, known)))
    # the empty word stands for the line itself
    found = lines.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}  # a row for each word of the templates
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in known}, math.log(n + 1)


def line_frequencies(files: DataFrame, key: str = "path") -> DataFrame:
    """``word, lines``: how many lines of the files that have a key hold each word; the empty word stands for all lines."""
    lines = _lines(files.filter(F.col(key).isNotNull()))
    own = F.concat(F.array_distinct(_words(F.col("line"))), F.array(F.lit("")))
    return staged(lines.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("lines")))


def _counted_weights(frequencies: DataFrame, templates: dict[str, str]) -> tuple[dict[str, float], float]:
    """What ``word_weights`` gives, from counts at hand."""
    known = sorted({w for words in _template_words(templates).values() for w in words})
    counts = {r["word"]: r["lines"] for r in frequencies.filter(F.col("word").isin([*known, ""])).collect()}
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in known}, math.log(n + 1)


def _weighed(terms: DataFrame, frequencies: DataFrame, unseen: float) -> DataFrame:
    """``terms`` with ``own``, count times weight of the word.

    Words with a ``COMMON_SHARE``-th of the terms or more, so at most that many, are sent to the tasks; the
    others are joined by word, so that no word brings a task more than that share.
    """
    used = terms.groupBy("word").agg(F.count("*").alias("uses"))
    weights = used.join(frequencies, "word", "left")
    weight = F.lit(unseen) - F.log(F.coalesce("lines", F.lit(0)) + 1)
    weights = staged(weights.select("word", "uses", weight.alias("weight")))
    least = (weights.agg(F.sum("uses")).first()[0] or 0) / COMMON_SHARE
    common = F.broadcast(weights.filter(F.col("uses") >= least).select("word", "weight"))
    rare = weights.filter(F.col("uses") < least).select("word", "weight")
    one, two = terms.join(common, "word"), terms.join(common, "word", "left_anti").join(rare, "word")
    return one.unionByName(two).withColumn("own", F.col("n") * F.col("weight")).drop("weight")


def _telling(words: Counter, weights: dict[str, float], least: float) -> set[str]:
    """The words of a template of which a line needs one to reach the least cosine."""
    total = sum((n * weights[w]) ** 2 for w, n in words.items())
    out, light = set(words), 0.0
    for w in sorted(words, key=lambda w: (weights[w], w)):
        light += (words[w] * weights[w]) ** 2
        if light >= (least * least - 1e-9) * total:
            break
        out.discard(w)
    return out


def line_licences(
    files: DataFrame,
    key: str = "path",
    templates: dict[str, str] = TEMPLATES,
    least: float = LEAST_COSINE,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """``key, licence, cosine``: the best template of every file that carries one.

    Of equal cosines the first name wins.  A null text is empty.  A file is named by ``key``:
    rows that share it are one file, rows whose key is null are none.  ``frequencies`` are those of
    ``line_frequencies``; without them only the templates' words are counted, and each other word
    weighs as much as one that no line holds.
    """
    spark = files.sparkSession
    files = files.filter(F.col(key).isNotNull())
    weights, unseen = word_weights(files, templates) if frequencies is None else _counted_weights(frequencies, templates)
    words = _template_words(templates)
    telling = sorted(set().union(*(_telling(w, weights, least) for w in words.values())))
    rows = []
    for name, own in words.items():
        norm = math.sqrt(sum((n * weights[w]) ** 2 for w, n in own.items())) or 1.0
        rows += [(w, name, n * weights[w] * weights[w] / norm) for w, n in own.items()]
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("licence", T.StringType()), T.StructField("weight", T.DoubleType())])
    table = F.broadcast(spark.createDataFrame(rows, schema))  # as large as the templates

    low = F.translate("line", _UPPER, _LOWER)
    pattern = "|".join(re.escape(w) for w in telling) or "(?!)"
    whole = f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])"
    lines = _lines(files.select(key, "text"), key).filter(low.rlike(whole))
    text_id = F.xxhash64("line")  # repeated rows of one key may differ in their lines
    lines = lines.dropDuplicates([key, "line_no", "line"])
    lines = lines.select(key, "line_no", text_id.alias("line_id"), F.explode(_words(F.col("line"))).alias("word"))
    terms = lines.groupBy(key, "line_no", "line_id", "word").agg(F.count("*").alias("n"))
    if frequencies is None:
        idf = F.create_map(*(x for w in sorted(weights) for x in (F.lit(w), F.lit(weights[w]))))
        weighed = terms.withColumn("own", F.col("n") * F.coalesce(idf[F.col("word")], F.lit(unseen)))
    else:
        terms = staged(terms)
        weighed = _weighed(terms, frequencies, unseen)
    place = [key, "line_no", "line_id"]
    norms = weighed.groupBy(*place).agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"))
    dots = terms.join(table, "word").groupBy(*place, "licence").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, place).withColumn("cosine", F.try_divide("dot", "norm")).filter(F.col("cosine") >= least)
    return _best(scored, key)


def _best(scored: DataFrame, key: str) -> DataFrame:
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "licence"))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.licence", (-F.col("b.c")).alias("cosine"))


_COMMENT = r"(?:#|//|/\*|\*|;|--|%|<!--|\.\.)"


def _blocks(text: Column) -> Column:
    """Runs of lines that have words, all of them commented or none."""
    text = F.regexp_replace(text, "(?m)^[^A-Za-z0-9\n]*$", "")
    text = F.regexp_replace(text, rf"(?m)^([ \t]*{_COMMENT}.*)\n(?=[ \t]*[A-Za-z0-9])", "$1\n\n")
    text = F.regexp_replace(text, rf"(?m)^([ \t]*[A-Za-z0-9].*)\n(?=[ \t]*{_COMMENT})", "$1\n\n")
    return F.split(text, "\n\n+")


def declared_licences(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, licence, cosine`` of files with an SPDX line or a line or block that is a title; the cosine is 1."""
    low = F.translate("text", _UPPER, _LOWER)
    named = files.filter(F.col(key).isNotNull()).filter(low.rlike("license|cc0 1.0|4.0 international"))
    parts = named.select(key, F.explode(F.concat(F.split("text", "\n"), _blocks(F.col("text")))).alias("part"))
    parts = parts.select(key, F.translate("part", _UPPER, _LOWER).alias("part"))
    expression = F.regexp_extract("part", "spdx-license-identifier:([^\n]*)", 1)
    ids = F.transform(F.regexp_extract_all(expression, F.lit(f"({WORD})"), 1), lambda w: F.regexp_replace(w, r"-only$|-or-later$", ""))
    name = F.array_join(_words(F.col("part")), " ")
    found = parts.select(key, F.explode(F.array_append(ids, F.when(F.length("part") < 200, name))).alias("title"))
    known = {name.lower(): name for name in {*TEMPLATES, *HEADERS, *full_texts()}} | TITLES
    titles = files.sparkSession.createDataFrame(sorted(known.items()), "title string, licence string")
    return found.join(F.broadcast(titles), "title").select(key, "licence", F.lit(1.0).alias("cosine")).distinct()


def part_licences(files: DataFrame, frequencies: DataFrame, key: str = "path", least: float = LEAST_COSINE) -> DataFrame:
    """``key, licence, cosine``: the best template of every file of which a block, or the whole, is near to one.

    By Cauchy and Schwarz no part reaches the least cosine to a template of which the whole file does not
    share words with ``least`` squared of its squared norm; files for which that holds of all templates go.
    """
    spark = files.sparkSession
    texts = [(name, t) for name, t in TEMPLATES.items()]
    texts += [(name, t) for name, own in HEADERS.items() for t in own] + list(full_texts().items())
    words = {f"{i}": _template_words({name: t})[name] for i, (name, t) in enumerate(texts)}
    weights, unseen = _counted_weights(frequencies, {f"{i}": t for i, (_, t) in enumerate(texts)})
    rows = []
    for i, (name, _) in enumerate(texts):
        own = words[f"{i}"]
        norm = math.sqrt(sum((n * weights[w]) ** 2 for w, n in own.items())) or 1.0
        rows += [(w, i, name, n * weights[w] / norm, weights[w]) for w, n in own.items()]
    schema = "word string, template int, licence string, share double, weight double"
    table = F.broadcast(spark.createDataFrame(rows, schema))  # as large as the templates
    telling = sorted(set().union(*(_telling(w, weights, least) for w in words.values())))

    files = files.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text").withColumn("file_id", F.xxhash64("text"))
    held = F.array_distinct(_words(F.col("text")))
    near = files.withColumn("held", held).filter(F.arrays_overlap("held", F.array(*map(F.lit, telling))))
    shared = near.select(key, "file_id", F.explode("held").alias("word")).join(table, "word").groupBy(key, "file_id", "template")
    shared = shared.agg(F.sum(F.col("share") * F.col("share")).alias("s")).filter(F.col("s") >= least * least - 1e-9)
    near = staged(files.join(staged(shared.select(key, "file_id").distinct()), [key, "file_id"], "left_semi"))

    parts = F.posexplode(F.concat(F.array("text"), _blocks(F.col("text")))).alias("part_no", "part")
    place = [key, "file_id", "part_no"]
    terms = near.dropDuplicates([key, "file_id"]).select(key, "file_id", parts)
    terms = terms.select(*place, F.explode(_words(F.col("part"))).alias("word"))
    terms = staged(terms.groupBy(*place, "word").agg(F.count("*").alias("n")))
    weighed = _weighed(terms, frequencies, unseen)
    norms = weighed.groupBy(*place).agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"))
    dots = terms.join(table, "word").groupBy(*place, "template", "licence").agg(F.sum(F.col("n") * F.col("weight") * F.col("share")).alias("dot"))
    return _best(dots.join(norms, place).withColumn("cosine", F.try_divide("dot", "norm")).filter(F.col("cosine") >= least), key)


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherited_licences(files: DataFrame, own: DataFrame) -> DataFrame:
    """``path, licence, cosine, origin, source_path`` of every file; ``files`` has ``path, is_licence_file``.

    ``origin`` is ``own`` for a file that carries a licence, ``inherited`` if the nearest directory above
    it with a licensed licence file gives one, else ``none``.  Of several licence files in a directory the
    first by path counts.  Repeated paths give one row; a null path gives none.
    """
    files = files.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.coalesce("is_licence_file", F.lit(False))).alias("is_licence_file"))
    named = staged(files.join(own, "path", "left").withColumn("dir", _parent(F.col("path"))))
    first = F.min(F.struct("path", "licence", "cosine")).alias("given")
    givers = staged(named.filter("is_licence_file AND licence IS NOT NULL").groupBy("dir").agg(first))
    # every directory once, with all directories above it: joins never meet the files themselves
    dirs = named.select("dir").distinct()
    steps = F.filter(F.split("dir", "/"), lambda s: s != "")
    depth = F.explode(F.sequence(F.lit(0), F.size("steps"))).alias("depth")
    above = dirs.withColumn("steps", steps).select("dir", "steps", depth)
    above = above.select("dir", "depth", F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/").alias("up"))
    above = above.join(givers.withColumnRenamed("dir", "up"), "up")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "given")).alias("n")).select("dir", "n.given")
    # a directory may hold a third of all files: spread its rows, and its licence with them
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    nearest = staged(nearest.select("dir", "given", salts))
    out = named.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(nearest, ["dir", "salt"], "left")
    mine, given = F.col("licence").isNotNull(), F.col("given").isNotNull()
    return out.select(
        "path",
        F.coalesce("licence", "given.licence").alias("licence"),
        F.coalesce("cosine", "given.cosine").alias("cosine"),
        F.when(mine, "own").when(given, "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("given.path")).alias("source_path"),
    )


def scan_licences(files: DataFrame, **options) -> DataFrame:
    """Licences of ``files`` (``path, text, is_licence_file``), own or inherited; see the two steps.

    Every word weighs by the lines of ``files`` that hold it.
    """
    options = {"frequencies": line_frequencies(files)} | options
    parts = part_licences(files, options["frequencies"], least=options.get("least", LEAST_COSINE))
    own = line_licences(files, **options).unionByName(parts).unionByName(declared_licences(files))
    return inherited_licences(files, staged(_best(own, "path")))
