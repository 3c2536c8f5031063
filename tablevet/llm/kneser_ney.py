"""Quality classifier: an n-gram model of trusted text, and thresholds for each language.

The model is interpolated modified Kneser-Ney over bytes.  Highest-order grams count how often
they occur, lower-order grams how many different signs stand before them; three discounts for
each order come from the counts of counts; what they take away goes to the next shorter context.
Counts are sharded by gram, joined by suffix, and summed by context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablevet.llm.bytegrams import SIGNS, context, gram_counts, with_scores, without_oldest
from tablevet.sources.scratch import staged

ORDER = 4
TRAIN_DOCUMENTS = 20_000
#: Lower and upper quantiles of trusted perplexity to choose from; a lower one of 0 is no cut.
QUANTILES = ((0.0, 0.001, 0.005, 0.01, 0.02, 0.05), (0.95, 0.98, 0.99, 0.995, 0.999))
LEAST_TRUSTED = 50
_LOGP, _LANG, _CUT, _FLOOR = "__logp", "__lang", "__cut", "__floor"


def _discounts(table: DataFrame) -> list[float]:
    """Discounts of grams with a count of 1, 2, and 3 or more."""
    row = table.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).first()
    n = [0, *row]
    if not n[1] or not n[2]:
        return [0.5, 1.0, 1.5]
    y = n[1] / (n[1] + 2 * n[2])
    out = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i for i in (1, 2, 3)]
    return [min(max(d, 0.05 * i), 0.95 * i) for i, d in enumerate(out, 1)]


def kneser_ney_model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, value``: log10 of the smoothed probability of each gram's last sign.

    ``counts`` (``gram, n``) has all top-order grams to be scored, with 0 for those not learned.
    """
    tables = {order: counts}
    for k in range(order, 0, -1):
        new = F.count_if(F.col("n") > 0).alias("n")
        tables[k - 1] = staged(tables[k].groupBy(without_oldest(k).alias("gram")).agg(new))
    own = Window.partitionBy(context())
    lower = None
    for k in range(order + 1):
        one, two, more = _discounts(tables[k])
        n = F.col("n")
        taken = F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, two).otherwise(more)
        table = tables[k].withColumn("taken", taken)
        if lower is None:
            joined = table.withColumn("short_p", F.lit(1.0 / SIGNS))
        else:
            short = lower.select(F.col("gram").alias("short"), F.col("p").alias("short_p"))
            joined = table.join(short, without_oldest(k) == F.col("short"))
        all_n, all_taken = F.sum("n").over(own), F.sum("taken").over(own)
        joined = joined.withColumn("all_n", all_n).withColumn("all_taken", all_taken)
        share = F.try_divide(n - F.col("taken") + F.col("all_taken") * F.col("short_p"), F.col("all_n"))
        lower = staged(joined.select("gram", F.when(F.col("all_n") > 0, share).otherwise(F.col("short_p")).alias("p")))
    return staged(lower.select("gram", F.log10("p").alias("value")))


def _surprise() -> Column:
    """Mean -log10 of the probability of a text's signs."""
    return -F.col(_LOGP) / (F.octet_length(F.coalesce("text", F.lit(""))) + 1)


def _chosen(labelled: DataFrame, quantiles: tuple[tuple[float, ...], tuple[float, ...]]) -> tuple[int, int]:
    """The pair of quantiles with the least sum of two rates: junk accepted, trusted refused; of equal ones the widest.

    ``labelled`` has ``good, surprise, cuts``, of which the last has the cuts of all lower and then all upper quantiles.
    """
    lows, highs = quantiles
    good, rates = F.col("good"), []
    for i, low in enumerate(lows):
        for j in range(len(highs)):
            inside = F.col("surprise") <= F.col("cuts")[len(lows) + j]
            if low > 0:
                inside &= F.col("surprise") >= F.col("cuts")[i]
            misses = F.coalesce(F.try_divide(F.count_if(~good & inside), F.count_if(~good)), F.lit(0.0))
            alarms = F.coalesce(F.try_divide(F.count_if(good & ~inside), F.count_if(good)), F.lit(0.0))
            rates.append((misses + alarms).alias(f"{i}_{j}"))
    row = labelled.agg(*rates).first()
    return min(((i, j) for i in range(len(lows)) for j in range(len(highs))), key=lambda k: (row[f"{k[0]}_{k[1]}"], lows[k[0]], -highs[k[1]]))


def rated(
    docs: DataFrame,
    labels: DataFrame,
    order: int = ORDER,
    train_documents: int = TRAIN_DOCUMENTS,
    quantiles: tuple[tuple[float, ...], tuple[float, ...]] = QUANTILES,
) -> DataFrame:
    """``docs`` with ``perplexity, least_perplexity, threshold, accepted``.

    Trusted are the documents labelled ``quality = 1`` and not ``toxic = 1``.  Half of them by a
    hash of the id, at most ``train_documents``, train the model (a fixed bound on what is
    learned); all others give each language's thresholds, a lower and an upper quantile of their
    perplexities.  Which of the ``quantiles`` is chosen once for all languages by labels not trained on:
    the share of documents with ``quality = 0`` accepted plus that of trusted ones refused is least.  Without a lower
    cut ``least_perplexity`` is 0.  A language with fewer than ``LEAST_TRUSTED`` of them, a null one too, takes the
    threshold of all languages; without any, every document is accepted.

    A null or empty text is judged by the probability that a text ends at once.  Repeated rows are
    rated alike; other columns stay as they are; columns of the four names are replaced.
    """
    docs = docs.drop("perplexity", "least_perplexity", "threshold", "accepted", _LOGP)
    trusted = (
        labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
        .select("doc_id", F.xxhash64("doc_id").alias("order_by")).distinct()
    )
    half = F.pmod("order_by", F.lit(2)) == 0
    train = staged(trusted.filter(half).orderBy("order_by").limit(train_documents).select("doc_id"))
    learn = docs.select("doc_id", "text").join(F.broadcast(train.withColumn("learn", F.lit(True))), "doc_id", "left")
    model = kneser_ney_model(gram_counts(learn, F.col("learn"), order), order)

    scores = with_scores(docs.select("doc_id", "lang", "text"), model, order, _LOGP)
    scores = staged(scores.select("doc_id", "lang", _surprise().alias("surprise")))
    judges = trusted.join(F.broadcast(train), "doc_id", "left_anti").select("doc_id")
    judged = scores.join(judges, "doc_id")
    lows, highs = quantiles
    cuts = F.percentile_approx("surprise", [*lows, *highs], 10_000).alias(_CUT)
    by_lang = judged.groupBy("lang").agg(cuts, F.count("*").alias("n")).filter(F.col("n") >= LEAST_TRUSTED)
    by_lang = F.broadcast(staged(by_lang.filter("lang IS NOT NULL").select(F.col("lang").alias(_LANG), _CUT)))
    overall = judged.agg(cuts).first()[0]
    out, own = with_scores(docs, model, order, _LOGP), F.col("lang") == F.col(_LANG)
    if overall is None:
        out = out.withColumn(_FLOOR, F.lit(float("-inf"))).withColumn(_CUT, F.lit(float("inf")))
    else:
        all_cuts = F.coalesce(_CUT, F.array(*map(F.lit, overall))).alias("cuts")
        junk = labels.filter("quality = 0").select("doc_id").distinct().join(trusted, "doc_id", "left_anti")
        labelled = judges.withColumn("good", F.lit(True)).unionByName(junk.withColumn("good", F.lit(False)))
        labelled = scores.join(labelled, "doc_id").join(by_lang, own, "left").select("good", "surprise", all_cuts)
        low, high = _chosen(labelled, quantiles)
        out = out.join(by_lang, own, "left").withColumn(_CUT, all_cuts)
        floor = F.col(_CUT)[low] if lows[low] > 0 else F.lit(float("-inf"))
        out = out.withColumn(_FLOOR, floor).withColumn(_CUT, F.col(_CUT)[len(lows) + high]).drop(_LANG)
    return (
        out.withColumn("perplexity", F.pow(F.lit(10.0), _surprise()))
        .withColumn("least_perplexity", F.pow(F.lit(10.0), F.col(_FLOOR)))
        .withColumn("threshold", F.pow(F.lit(10.0), F.col(_CUT)))
        .withColumn("accepted", _surprise().between(F.col(_FLOOR), F.col(_CUT)))
        .drop(_LOGP, _CUT, _FLOOR)
    )
