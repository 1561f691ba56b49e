"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a random key from SHA-256 of its id. Keys are cut into ranges by their leading digits; word totals per
(source, range) are summed to prefix sums in two levels, so no task holds a whole source; the budget of a source falls
into one range, and only that range is sorted. What comes before the cut is taken once more than the full epochs, the
document at the cut gives the words that still fit, and each source meets its budget to the word.

Targets: sources by code point (null last) weigh ``weights`` in turn and share the total size; no target exceeds
``max_epochs`` times its source, and the excess goes to the others by weight (the level where the capped shares fill the total).

Defined cases: null text has size 0; a null source is a source of its own; rows without words are taken with 0 words;
repeated rows at the cut share its words evenly, rounded down; an empty table gives an empty result.
Columns other than doc_id, text and source pass through ``mixed_documents`` unchanged (``n_chars``, if there, follows the text).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def mixing_key(seed: str = SEED) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), 256)


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from one row per source: the windows run over sources, never over documents."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    everything = Window.partitionBy(F.lit(0))
    named = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = by_source.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    before = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    t = t.withColumn("level", left_words.cast("double") / left_weight.cast("double"))
    t = t.withColumn("fill", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("w").cast("double") * F.col("fill"))
    return t.select("source", "source_size", "source_rows", F.coalesce(target, F.lit(0.0)).alias("target"))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The slim rows (doc_id, source, size, key) and one row per source with its target and its cut."""
    slim = materialize(docs.select("doc_id", "source", word_count().alias("size"), mixing_key(seed).alias("key")), "mix-sizes")
    targets = source_targets(slim, weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = materialize(targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")

    n = targets.agg(F.sum("source_rows")).first()[0] or 0
    digits = max(1, round(math.log(max(n, 1000) / 1000, 16) / 2))
    fine, coarse = F.substring("key", 1, 2 * digits), F.substring("key", 1, digits)
    per_fine = slim.groupBy("source", fine.alias("fine"), coarse.alias("coarse")).agg(F.sum("size").alias("words"))
    per_fine = materialize(per_fine, "mix-ranges")
    up_to = (Window.unboundedPreceding, -1)
    per_coarse = per_fine.groupBy("source", "coarse").agg(F.sum("words").alias("coarse_words"))
    per_coarse = per_coarse.withColumn("start", F.coalesce(F.sum("coarse_words").over(Window.partitionBy("source").orderBy("coarse").rowsBetween(*up_to)), F.lit(0)))
    per_coarse = _on_source(per_coarse, targets.select("source", "rest")).filter("start <= rest AND rest < start + coarse_words")
    inside = per_fine.alias("f").join(per_coarse.alias("c"), F.expr("f.source <=> c.source AND f.coarse = c.coarse")).select("f.*", "c.start", "c.rest")
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("fine").rowsBetween(*up_to)), F.lit(0)))
    cut_range = inside.filter("start <= rest AND rest < start + words").select("source", "fine", "start", "rest")

    units = slim.withColumn("fine", fine).alias("s").join(cut_range.alias("r"), F.expr("s.source <=> r.source AND s.fine = r.fine"))
    units = units.groupBy("s.source", "s.key", "s.size", "r.start", "r.rest").agg(F.count(F.lit(1)).alias("n"))
    units = units.withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(*up_to)), F.lit(0)))
    cut = units.filter(F.expr("start <= rest AND rest < start + size * n"))
    cut = cut.select("source", F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("start")) / F.col("n")).cast("long").alias("cut_words"))
    plan = targets.alias("t").join(cut.alias("c"), F.expr("t.source <=> c.source"), "left").select("t.*", "c.cut_key", "c.cut_size", "c.cut_words")
    return slim, materialize(plan, "mix-plan")


def _on_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, left["source"].eqNullSafe(right["__source"])).drop("__source")


def _part_words() -> Column:
    """Words of the row that the last, incomplete epoch takes."""
    first = F.struct("key", "size") < F.struct(F.col("cut_key").alias("key"), F.col("cut_size").alias("size"))
    at_cut = (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    return F.when(F.col("cut_key").isNull(), 0).when(first, F.col("size")).when(at_cut, F.col("cut_words")).otherwise(0).cast("long")


def mixture(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), epochs, part_words."""
    slim, plan = mixing_plan(docs, weights, max_epochs, seed)
    rows = _on_source(slim, plan).withColumn("part_words", _part_words())
    taken = F.col("epochs") * F.col("size") + F.col("part_words")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "part_words")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: a row for every epoch of a document, the document at the cut shortened to the words that fit.

    No text is shuffled by id: a row decides from its own key and the row of its source.
    """
    _, plan = mixing_plan(docs, weights, max_epochs, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # the caller's columns, whatever their names
    rows = docs.select(row, "source", word_count().alias("size"), mixing_key(seed).alias("key"))
    rows = _on_source(rows, plan).withColumn("part", _part_words())
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = rows.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    short = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    pieces = F.split(F.col("row.text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(short, F.array_join(F.slice(pieces, 1, F.col("part").cast("int")), "")).otherwise(F.col("row.text"))
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(short, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
