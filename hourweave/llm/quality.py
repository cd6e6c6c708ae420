"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the corpus.

Two multinomials over hashed word 1- and 2-grams are counted in Spark: one over
trusted documents, one over all documents. A document's score is the mean log
ratio of its n-grams; every document is kept or rejected by one fixed threshold.
Only built-in functions are used, and no text is shuffled: both passes read the
documents, and what is exchanged is one row per hash bucket and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourweave.llm.expressions import grams, held, let, longer_grams, words

#: Hash buckets of the n-gram multinomials; the model's size whatever the input.
BUCKETS = 1 << 15
#: Trusted documents the target multinomial is fitted on, at most. With 20,000 ids
#: of 8 bytes the broadcast of the sample is under 1 MB.
TRUSTED_SAMPLE = 20_000
#: Mean log ratio (nats per n-gram) under which a document is rejected.
THRESHOLD = -0.08
#: Added to every bucket's count.
SMOOTHING = 1.0


def trusted_sample(labels: DataFrame, bound: int = TRUSTED_SAMPLE) -> DataFrame:
    """At most ``bound`` ids of documents labelled good and not toxic, chosen by id hash.

    Null ids never match a document. A document labelled twice counts as trusted
    only if no row calls it poor or toxic.
    """
    judged = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("quality"), F.max(F.coalesce("toxic", F.lit(1))).alias("toxic")
    )
    good = judged.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _hashed(docs: DataFrame) -> DataFrame:
    """Rows as struct ``row``, with their words and the hashes of all 1- and 2-grams."""
    seen = docs.select(F.struct("*").alias("row"), words(F.col("text")).alias("_words"))
    ones = seen.withColumn("_ones", grams(F.col("_words"), 1))
    return ones.withColumn("_twos", longer_grams(F.col("_ones"), F.col("_words"), 2))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with ``ratios``: log(p_trusted / p_corpus) for every bucket.

    Counts cover every document of ``docs``. Without trusted documents, or
    without any document, all ratios are 0, so nothing is rejected by them.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("trusted"))), "doc_id", "left"
    )
    found = _hashed(marked).select("row.trusted", F.explode(F.concat("_ones", "_twos")).alias("h"))
    seen = (
        found.groupBy(_bucket(F.col("h"), buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    )
    counts = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(seen, "bucket", "left")
    table = counts.agg(
        F.array_sort(
            F.collect_list(F.struct("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")]))
        ).alias("t"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"),
    )

    def log_share(count: Column, total: str) -> Column:
        return F.log((count + F.lit(smoothing)) / (F.col(total) + F.lit(smoothing * buckets)))

    ratio = F.transform("t", lambda x: log_share(x["good"], "n_good") - log_share(x["raw"], "n_raw"))
    none = F.transform("t", lambda _: F.lit(0.0))
    return table.select(F.when(F.col("n_good") > 0, ratio).otherwise(none).alias("ratios"))


def repeated_words(tokens: Column, hashes: Column, n: int) -> Column:
    """Words inside n-word windows that occur at least twice in the document.

    ``hashes`` are the windows' hashes in order. They are sorted as numbers whose low
    bits hold the position, one fast sort; only windows whose hash has an equal
    neighbour are then compared as text, so the count is exact.
    """
    bits = F.coalesce(F.ceil(F.log2(F.size(hashes) + F.lit(1.0))).cast("int"), F.lit(0))

    def equal_neighbours(h: Column, b: Column) -> Column:
        mask = _shift_left(F.lit(1).cast("bigint"), b) - F.lit(1)
        keys = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")))

        def runs(s: Column) -> Column:
            # a key and the next differ in the low bits only: both windows are candidates
            ends = F.filter(s, lambda x, i: _shift_right(x.bitwiseXOR(F.get(s, i + 1)), b) == 0)
            return F.when(F.size(ends) == 0, F.array().cast("array<bigint>")).otherwise(
                F.filter(
                    s,
                    lambda x, i: (_shift_right(x.bitwiseXOR(F.get(s, i + 1)), b) == 0)
                    | ((i > 0) & (_shift_right(x.bitwiseXOR(F.get(s, i - 1)), b) == 0)),
                )
            )

        return F.transform(let(F.sort_array(keys), runs), lambda x: x.bitwiseAND(mask).cast("int"))

    def proven(t: Column, places: Column) -> Column:
        texts = F.sort_array(
            F.transform(places, lambda p: F.struct(F.slice(t, p + 1, F.lit(n)).alias("w"), p.alias("p")))
        )
        equal = lambda s, x, i: F.coalesce(x["w"] == F.get(s, i)["w"], F.lit(False))
        kept = lambda s: F.filter(s, lambda x, i: equal(s, x, i + 1) | ((i > 0) & equal(s, x, i - 1)))
        return F.transform(let(texts, kept), lambda x: x["p"])

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1) - p, F.lit(n))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, s: a + s)

    found = let(hashes, lambda h: let(bits, lambda b: equal_neighbours(h, b)))
    return let(
        found,
        lambda c: F.when(F.size(c) == 0, F.lit(0).cast("bigint")).otherwise(
            let(F.sort_array(proven(tokens, c)), covered)
        ),
    )


def _shift_right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def _shift_left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _signals(text: Column, tokens: Column, twos: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(tokens).cast("bigint"),
        "word_chars": F.length(F.array_join(tokens, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        "n_repeat_words": repeated_words(tokens, longer_grams(twos, tokens, 3), 3),
    }


def _total(hashes: Column, ratios: Column, buckets: int) -> Column:
    return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(ratios, _bucket(h, buckets)))


def judge(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with the base figures, ``score`` and the verdict.

    ``score`` is the mean log ratio of all 1- and 2-grams. Rows are judged one by one,
    so repeated rows and repeated ids get the same verdict each. Null and empty texts
    have no words, all figures 0, and fail the base rules.
    ``trusted`` must be bounded (see ``trusted_sample``); it is broadcast.
    """
    figures = _signals(F.col("row.text"), F.col("_words"), F.col("_twos"))
    measured = _hashed(docs).select("row", *[c.alias(n) for n, c in figures.items()], "_ones", "_twos")
    # the one-row table is attached apart from the word arrays, so that it stays one value per task
    summed = measured.withColumn("_ratios", fit(docs, trusted, buckets).scalar()).select(
        "row",
        *figures,
        let(
            F.col("_ratios"),
            lambda table: _total(F.col("_ones"), table, buckets) + _total(F.col("_twos"), table, buckets),
        ).alias("_sum"),
    )
    n_grams = F.greatest(F.col("n_words"), F.lit(0)) + F.greatest(F.col("n_words") - 1, F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        summed.withColumn("score", F.when(n_grams > 0, F.col("_sum") / n_grams).otherwise(F.lit(0.0)))
        .drop("_sum")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    )


def keep_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    return held(judge(docs, trusted), F.col("kept")).select("row.*")
