"""Language model scoring by prediction by partial matching over bytes.

The context trie is a set of tables, one for each order: a row is a context with a sign that
followed it.  A sign that followed its context n times has the probability n / (N + T) there, N
being all and T the different signs that followed; the rest, T / (N + T), is the escape to the next
shorter context.  There, signs of the longer context are excluded: all counts are taken without
them.  After the empty context comes an even share among signs never seen.

Contexts nest, so what is excluded in a context is exactly the signs of the one longer by one,
and the sums without them follow from one join by gram and one window by context for each order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.llm.bytegrams import SIGNS, Lookup, context, ddl, gram_counts, with_scores, without_oldest
from tablevet.llm.textcodes import let_go, list_column, signed, slices, word_hashes
from tablevet.sources.scratch import staged

ORDER = 5
HOT_WORDS = 1 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents left out of learning: crc32 of the id's text, modulo 10, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def ppm_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, value``: log10 of the probability of every counted gram's last sign in its context.

    ``counts`` (``gram, n``) has all top-order grams of learned and other texts, the latter with 0.
    """
    tables = {order: counts}
    for k in range(order, 0, -1):
        tables[k - 1] = staged(tables[k].groupBy(without_oldest(k).alias("gram")).agg(F.sum("n").alias("n")))
    own = Window.partitionBy(context())
    seen = F.when(F.col("n") > 0, 1).otherwise(0)

    def with_totals(df: DataFrame) -> DataFrame:
        return df.withColumn("all_n", F.sum("n").over(own)).withColumn("kinds", F.sum(seen).over(own))

    never = F.log10(1.0 / F.greatest(F.lit(SIGNS) - F.col("kinds"), F.lit(1)))
    lower = staged(with_totals(tables[0]).withColumn("after", F.when(F.col("n") == 0, never)))
    for k in range(1, order + 1):
        short = lower.select(
            F.col("gram").alias("short"), F.col("n").alias("short_n"), F.col("all_n").alias("short_all"),
            F.col("kinds").alias("short_kinds"), F.col("after").alias("short_after"),
        )
        joined = with_totals(tables[k].join(short, without_oldest(k) == F.col("short")))
        # in the shorter context, without the signs that this context has itself
        excluded = F.sum(F.when(F.col("n") > 0, F.col("short_n")).otherwise(0)).over(own)
        joined = joined.withColumn("rest_n", F.col("short_all") - excluded)
        joined = joined.withColumn("rest_kinds", F.col("short_kinds") - F.col("kinds"))
        total = F.col("rest_n") + F.col("rest_kinds")
        found = F.log10(F.try_divide("short_n", total))
        # a shorter context that adds no sign to this one is passed through
        passed = F.when(F.col("rest_kinds") > 0, F.log10(F.try_divide("rest_kinds", total))).otherwise(0.0)
        after = F.when(F.col("n") == 0, F.when(F.col("short_n") > 0, found).otherwise(passed + F.col("short_after")))
        lower = staged(joined.withColumn("after", after).select("gram", "n", "all_n", "kinds", "after"))
    total = F.col("all_n") + F.col("kinds")
    escape = F.when(F.col("kinds") > 0, F.log10(F.try_divide("kinds", total))).otherwise(0.0)
    value = F.when(F.col("n") > 0, F.log10(F.try_divide("n", total))).otherwise(escape + F.col("after"))
    return staged(lower.select("gram", value.alias("value")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each batch's learned texts."""
    let_go()
    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        parts = [np.unique(word_hashes(data, at)[0], return_counts=True) for _, data, at in slices(batch.column("text").filter(pa.array(learn)))]
        if parts:
            words, counts = (np.concatenate(x) for x in zip(*parts))
            words, where = np.unique(words, return_inverse=True)
            counts = np.bincount(where, counts, len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(counts)], names=["word", "n"])


def _looked_up(batches: Iterator[pa.RecordBatch], words: Broadcast) -> Iterator[pa.RecordBatch]:
    """Adds token numbers of each text, sums over its frequent words, and its other words."""
    let_go()
    frequent = words.value
    for batch in batches:
        n = batch.num_rows
        tokens, known, sums, rest_n = (np.zeros(n, k) for k in (np.int64, np.int64, np.float64, np.int64))
        rest = [np.zeros(0, np.uint64)]
        for first, data, at in slices(batch.column("text")):
            found, starts = word_hashes(data, at)
            m, values = len(at) - 1, frequent(found)
            hit, owner = values != 0, np.repeat(np.arange(len(at) - 1), np.diff(starts))
            tokens[first : first + m] = np.diff(starts) + 1
            known[first : first + m] = np.bincount(owner[hit], minlength=m)
            sums[first : first + m] = np.bincount(owner, values, minlength=m)
            rest_n[first : first + m] = np.bincount(owner[~hit], minlength=m)
            rest.append(found[~hit])
        new = [pa.array(tokens), pa.array(known), pa.array(sums), list_column(signed(np.concatenate(rest)), rest_n)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_LOOKED])


_LOOKED = ("n_tokens", "hot_known", "hot_sum", "rest")


def score_documents(docs: DataFrame, order: int = ORDER, hot_words: int = HOT_WORDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    ``score`` is log10 of the probability that the byte model gives the whole text, A-Z as a-z, and
    its end.  ``base_score`` is that of a unigram model of words with 0.1 added to each count; a
    text's end counts as one more word.  Both learn from the documents that are not held out.  A
    null text is empty, a null doc_id is held out; rows are scored one by one, so repeated rows
    stay; without documents to learn from, all signs are equally likely.  Other columns are left out.

    Words that make up at least one in ``hot_words`` of all, of which there can be no more than that,
    travel to the tasks; all other words are joined with their counts, so no key of that join is
    frequent.
    """
    plus = 0.1
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    model = ppm_model(gram_counts(docs, ~F.col("held_out"), order), order)

    learn = docs.select("text", (~F.col("held_out")).alias("learn"))
    counts = staged(learn.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    ends = docs.filter("NOT held_out").count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    hot = counts.filter(F.col("n") * hot_words >= total).toArrow()
    logs = np.log10(hot.column("n").to_numpy() + plus)
    frequent = docs.sparkSession.sparkContext.broadcast(Lookup(hot.column("word").to_numpy().view(np.uint64), logs))
    task = partial(_looked_up, words=frequent)
    looked = docs.mapInArrow(task, f"{ddl(docs)}, n_tokens bigint, hot_known bigint, hot_sum double, rest array<bigint>")
    scored = with_scores(looked, model, order, "score").drop("text")
    scored = staged(scored.withColumn("_row", F.monotonically_increasing_id()))

    rest = scored.select("_row", F.explode("rest").alias("word")).join(counts, "word", "left")
    rest = rest.groupBy("_row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(plus))).alias("rest_sum"), F.count("n").alias("rest_known")
    )
    end_log = float(np.log10(ends + plus))
    below = float(np.log10(total + plus * (kinds + 1)))
    return scored.join(rest, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rest_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rest_sum", F.lit(0.0)) + end_log - F.col("n_tokens") * below).alias("base_score"),
        "score",
    )
