"""Mixing sources to target weights.

Every source gets a share of the words by its weight, at most ``most`` times its own
words; what it can't take is shared by the others by weight.  Each row has a hash-random
key.  The rows of a source are sorted by it, each row's place is the sum of the words
before it, and the source is cut at its exact budget: full epochs take every row, and the
last, part epoch takes rows up to the budget.  The row that lies across the cut gives its
leading words, so that the words taken equal the rounded target.

The sums are distributed: the key's leading bits are a bucket, so that buckets follow one
another in the order of keys.  Buckets are summed, the sums of a source's buckets are added
up, and each bucket is sorted alone.  A source with most of the rows is thus spread over
``2 ** bits`` tasks.

Defined cases: a null text has 0 words; a null source is a source of its own, the last; a
source without words gets target 0; rows with equal doc_id have one key and lie side by
side; an empty table gives no rows; a text of any length is counted whole by the JVM; other
columns of the input are ignored by ``mix``, and in ``mixed`` rows that differ in any column
are different rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardflow.llm.common import WORD, stored

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sums: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``_src``, ``_total`` and ``_target`` from ``_src`` and ``_total``, one row a source.

    The limits are reached in the order of limit by weight.  With the k lowest at their
    limits, the others get the rest by weight; the first k for which the next one stays
    within its limit is the fixed point of sharing the excess again and again.
    """
    ordered = sums.withColumn("_i", F.row_number().over(Window.orderBy("_src")) - 1)
    ordered = ordered.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_i") % len(weights) + 1).cast("int"))).withColumn("_limit", F.col("_total") * F.lit(float(most)))
    by = Window.orderBy(F.col("_limit") / F.col("_w"), "_src")
    full = ordered.select("*", F.coalesce(F.sum("_limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_below"), F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("_rest"), (F.sum("_total").over(Window.partitionBy()) * F.lit(float(share))).alias("_all"))
    full = full.withColumn("_level", (F.col("_all") - F.col("_below")) / F.col("_rest")).withColumn("_fits", F.col("_level") <= F.col("_limit") / F.col("_w"))
    level = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return full.withColumn("_found", level).select("_src", "_total", F.when(F.col("_found").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_found") * F.col("_w"))).alias("_target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0, bits: int = 12, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row, and ``_rid`` if the input has it.

    ``bits``: the source's rows are sorted in as many as ``2 ** bits`` parts.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    sized = docs.select("doc_id", src.alias("_src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("_key"), *[c for c in docs.columns if c == "_rid"])
    sized = stored(sized.withColumn("_bucket", F.shiftright("_key", 60 - bits)))
    sums = sized.groupBy("_src", "_bucket").agg(F.sum("size").alias("_words"))
    aims = targets(sums.groupBy("_src").agg(F.sum("_words").alias("_total")), weights, share, most)
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0))).join(aims, "_src").drop("_words")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_key", "doc_id", "size", *[c for c in docs.columns if c == "_rid"]).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["_src", "_bucket"])
    budget = F.least(F.floor(F.col("_target") + 0.5), F.floor(F.col("_total") * F.lit(float(most)))).cast("long")
    placed = placed.withColumn("_budget", budget).withColumn("_epochs", F.when(F.col("_total") > 0, F.expr("_budget div greatest(_total, 1)")).otherwise(F.lit(0)))
    left = F.col("_budget") - F.col("_epochs") * F.col("_total") - F.col("_start") - F.col("_within")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    source = F.when(F.col("_src") != "1", F.expr("substr(_src, 2)"))
    return placed.select("doc_id", "size", source.alias("source"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"), *[c for c in docs.columns if c == "_rid"])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself with the columns of ``docs``: each row as often as it is taken, the row at the cut with its leading words only.

    Options as in ``mix``.  ``n_chars``, if there, follows a cut text.
    """
    rid = F.md5(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("")) for c in docs.columns)))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), rid.alias("_rid"))
    # Equal rows are one row that is taken as often as they are together.
    taken = mix(docs.select("doc_id", "source", "text", rid.alias("_rid")), **options).where("taken > 0").groupBy("_rid").agg(F.sum("taken").alias("_taken"), F.first("size").alias("_size"))
    each = keyed.dropDuplicates(["_rid"]).join(taken, "_rid")
    each = each.withColumn("_words", F.explode(F.expr("transform(sequence(1, CAST(ceil(_taken / _size) AS INT)), i -> least(_size, _taken - (i - 1) * _size))")))
    head = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_words").cast("int")), "")
    whole = F.col("_words") == F.col("_size")
    each = each.withColumn("_text", F.when(whole, F.col("_row.text")).otherwise(head))
    out = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(whole, F.col("_row.n_chars")).otherwise(F.char_length("_text").cast("long"))
    return each.select(*(x.alias(c) for c, x in out.items()))
