"""Spelling variants: words one edit apart, grouped under their frequent forms.

Letters are hashed to a few symbols.  Words one edit apart have reduced words at most one edit
apart, so every reduced word's full neighbourhood of one edit, over the few symbols, is joined with
the reduced vocabulary, and the original strings of those that meet are compared.  Over 8
symbols a word of 8 letters has 136 neighbours, where it would have over 1,400 over the letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablevet.llm.textcodes import crc32_sql
from tablevet.sources.scratch import staged

SYMBOLS = 8
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5  # a form is so many times as frequent as its variant
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = _LOWER + "".join(map(chr, range(0xC0, 0x100)))
_ONE_IN = 199  # of the runs loses a letter


def damaged_words(docs: DataFrame) -> DataFrame:
    r"""``word`` of every run of letters ``[A-Za-zÀ-ÿ]`` of each text, A-Z as a-z; lazy.

    Let h be the unsigned crc32 of ``<doc_id>:<run>``.  Where 199 divides h, the run loses its letter
    number h % length.  A null text has no runs; a null doc_id is written as nothing.
    """
    letters = f"translate(text, '{_UPPER}', '{_LOWER}')"
    runs = docs.selectExpr("coalesce(CAST(doc_id AS STRING), '') AS doc", rf"explode(split({letters}, '[^a-zÀ-ÿ]+')) AS run")
    hashed = runs.filter("run != ''").selectExpr("run", "crc32(CAST(concat(doc, ':', run) AS BINARY)) AS h")
    at = "CAST(h % length(run) AS INT)"
    return hashed.selectExpr(f"IF(h % {_ONE_IN} = 0, concat(left(run, {at}), substring(run, {at} + 2)), run) AS word")


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of words of at least so many code points that occur so often; counted inside tasks first."""
    long_enough = words.filter(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: str, symbols: int = SYMBOLS) -> str:
    """SQL of a word with each letter hashed to one of ``symbols`` symbols."""
    to = "".join(chr(48 + (ord(c) * 0x9E3779B1 % 2**32 >> 16) % symbols) for c in _LETTERS)
    return f"translate({word}, '{_LETTERS}', '{to}')"


def neighbourhood(r: str, symbols: int = SYMBOLS) -> str:
    """SQL of all strings within one edit of a reduced word, itself included, each once."""
    each = "array(" + ", ".join(f"'{chr(48 + s)}'" for s in range(symbols)) + ")"
    cut = f"transform(sequence(1, length({r})), i -> concat(left({r}, i - 1), substring({r}, i + 1)))"
    put = f"flatten(transform(sequence(1, length({r})), i -> transform({each}, s -> concat(left({r}, i - 1), s, substring({r}, i + 1)))))"
    add = f"flatten(transform(sequence(1, length({r}) + 1), i -> transform({each}, s -> concat(left({r}, i - 1), s, substring({r}, i)))))"
    return f"array_distinct(concat({cut}, {put}, {add}))"


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, other, other_n`` for all ordered pairs of the stored ``word, n`` exactly one edit apart.

    An edit inserts, deletes or replaces one code point.  Neighbourhoods are made once for each
    different reduced word; a pair whose replaced letters share a symbol meets in the unchanged one.
    """
    coded = staged(words.withColumn("r", F.expr(reduced("word", symbols))))
    made = coded.select("r").distinct().select("r", F.explode(F.expr(neighbourhood("r", symbols))).alias("key"))
    known = coded.select(F.col("r").alias("key")).distinct()
    pairs = staged(made.join(known, "key").select("r", "key"))
    others = coded.select(F.col("r").alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = pairs.join(coded.select("r", "word"), "r").join(others, "key")
    return met.filter("word != other AND levenshtein(word, other, 1) = 1").select("word", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms.

    Counts grow along a chain, so it ends; its length is halved in each round, which is written
    to the shared folder.
    """
    current = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def variants(words: DataFrame, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n``.

    ``n_near`` counts the words one edit away.  A word's form is the one of them with the largest n
    (of equal ones the smallest in code-point order) if that is at least ``times`` its own n, else null, and
    ``form_n`` is the form's n.  ``root`` is reached by following forms; a word without form is its own.
    Words are different by what they are of: each stands once; an empty table gives an empty table.
    """
    words = staged(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = staged(near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best))
    rated = words.join(near, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.less") >= F.col("n") * times, F.lit(False)))
    rated = staged(
        rated.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(rated.filter("form IS NOT NULL"))
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    """The same over ``documents`` in DuckDB's SQL: pairs share what one of their letters leaves out."""
    near = """SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
    UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocabulary v ON c.rest = v.word
    UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocabulary v ON c.rest = v.word"""
    return rf"""
WITH RECURSIVE runs AS (SELECT doc, run, count(*) AS n FROM
    (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
        translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents)
    GROUP BY doc, run),
hashed AS (SELECT run, n, {crc32_sql("doc || ':' || run")} AS h FROM runs),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM
    (SELECT CASE WHEN h % {_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS ({near}),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT near.word, min(other) AS form, any_value(form_n) AS form_n FROM near JOIN best USING (word) JOIN vocabulary USING (word)
    WHERE other_n = form_n AND form_n >= {TIMES} * vocabulary.n GROUP BY near.word),
chains AS (SELECT word, word AS root FROM vocabulary
    UNION SELECT chains.word, form FROM chains JOIN forms ON forms.word = chains.root),
roots AS (SELECT word, root FROM chains WHERE root NOT IN (SELECT word FROM forms))
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, forms.form_n
FROM vocabulary LEFT JOIN best USING (word) LEFT JOIN forms USING (word) JOIN roots USING (word)
"""
