"""Mixing sources to target weights.

A source with weight w shall give w times the tokens of all documents of the sources named.
Its documents are used in whole epochs as long as they fit, at most ``max_repeats`` times
each; what is then left of its budget is a sample without replacement in which a document's
chance follows its quality weight: each document draws the key -ln(u) / quality (Efraimidis
and Spirakis), and documents are taken by ascending key while their tokens add up to no
more than what is left.  u is a hash of the document's identity and the seed, so the mix is the same
however the table is partitioned.

Adding up along a source's order needs no sort of the source.  The range of keys in which the budget
ends is split into BINS bins, tokens and documents per (source, bin) are summed, and the bin where it ends
is the next range, until few documents are in it; only those are ordered.  Bins are equal in the
logarithm of the key, so low qualities, whose keys are large, spread over as many as high ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.staging import stage

BINS = 4096
#: So many documents of a source may be ordered in one place.
ORDERED = 50_000
#: Up to so many sources what belongs to a source goes to every task; beyond, it is joined with salted sources.
SENT_SOURCES = 10_000
SALTS = 64
#: Logarithms of keys, of which the smallest is 2^-54 and the largest 37.5 over the least quality, 1e-9, lie within.
LOG_LOW, LOG_SPAN, KEYS = -40.0, 80.0, 1 << 52


def normal(source: Column) -> Column:
    """Sources compare trimmed and in lower case."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def quality_by_density(n_chars: Column, n_tokens: Column) -> Column:
    """Characters per token against the four and a half of clean prose, between 0.05 and 1: encoded attachments and noise score low."""
    return F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.try_divide(n_chars, n_tokens) / 4.5)), F.lit(1.0))


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, key, weight, max_repeats, documents, tokens, total, target_tokens, epochs, remainder.

    Targets without documents are kept; sources that no target names, or null, take no part and are
    not in the total.  Documents without tokens fit in every epoch.
    """
    named = targets.select("source", normal(F.col("source")).alias("key"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    supply = documents.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    joined = named.join(supply, "key", "left").na.fill(0, ["documents", "tokens"])
    whole = joined.withColumn("total", F.coalesce(joined.agg(F.sum("tokens")).scalar(), F.lit(0)))
    target = F.col("weight") * F.col("total")
    epochs = F.least(F.col("max_repeats"), F.coalesce(F.floor(F.try_divide(target, F.col("tokens"))), F.col("max_repeats")))
    return (
        whole.withColumn("target_tokens", target)
        .withColumn("epochs", epochs.cast("bigint"))
        .withColumn("remainder", F.when(F.col("epochs") < F.col("max_repeats"), F.floor(target - F.col("epochs") * F.col("tokens"))).otherwise(0).cast("bigint"))
    )


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows joined with one row per source, without gathering a source's rows: sent where there are few sources, else by source and salt."""
    if few:
        return rows.join(F.broadcast(per_source), "source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["source", "_salt"]).drop("_salt")


def _cuts(drawn: DataFrame, planned: DataFrame, few: bool, refine: bool = True) -> DataFrame:
    """source, lo, hi, before: documents with a place below lo are taken, ``before`` is their tokens, those in [lo, hi] have to be ordered.

    Without ``refine``, where no source has more than ORDERED documents, all of them.
    """
    state = planned.where("remainder > 0").select(
        F.col("key").alias("source"), "remainder", F.lit(0).cast("long").alias("lo"), F.lit(KEYS).cast("long").alias("hi"), F.lit(0).cast("long").alias("before"), F.col("documents").alias("n")
    )
    wide = (F.col("n") > ORDERED) & (F.col("hi") > F.col("lo"))
    while refine and state.where(wide).head(1):  # each round divides a range by BINS: at most five
        ranged = state.where(wide).withColumn("width", F.call_function("div", F.col("hi") - F.col("lo"), F.lit(BINS).cast("long")) + 1)
        counted = (
            _with_source(drawn, ranged, few)
            .where(F.col("place").between(F.col("lo"), F.col("hi")))
            .groupBy("source", "remainder", "lo", "hi", "before", "width", F.call_function("div", F.col("place") - F.col("lo"), F.col("width")).alias("bin"))
            .agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        )
        upto = F.col("before") + F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        ends = counted.withColumn("upto", upto).where((F.col("upto") > F.col("remainder")) & (F.col("upto") - F.col("t") <= F.col("remainder")))
        first = F.col("lo") + F.col("bin") * F.col("width")
        found = ends.select("source", "remainder", first.alias("lo"), F.least(first + F.col("width") - 1, F.col("hi")).alias("hi"), (F.col("upto") - F.col("t")).alias("before"), "n")
        # where the budget ends nowhere all documents are taken
        all_fit = state.where(wide).join(found.select("source"), "source", "left_anti").select("source", "remainder", (F.col("hi") + 1).alias("lo"), "hi", "before", F.lit(0).cast("long").alias("n"))
        state = stage(state.where(~wide).unionByName(found).unionByName(all_fit), "mixcuts")
    return state.select("source", "lo", "hi", "before")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    documents: doc_id, source, n_tokens, quality; sources as ``normal`` leaves them; should be
    staged, as they are read several times.  doc_id must be unique, else equal ids share their draw.
    A quality that is null, zero or negative counts as 1e-9: taken last.
    selection: doc_id, source, n_tokens, copies (at least 1).  report: per target source, weight, max_repeats,
    documents, tokens, target_tokens, epochs, used_tokens, actual_share, short.  used_tokens stays below the
    target by less than one document, or the source is short: every document was taken
    max_repeats times, and the target is not reached.  Empty tables give an empty selection and a report of zeros.
    """
    planned = stage(plan(documents, targets), "mixplan")
    sources, largest = planned.agg(F.count(F.lit(1)), F.max(F.when(F.col("remainder") > 0, F.col("documents")))).first()
    few, refine = sources <= SENT_SOURCES, (largest or 0) > ORDERED
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.greatest(F.when(F.col("quality") > 0, F.col("quality")).otherwise(1e-9), F.lit(1e-9))
    place = F.floor((F.log("draw") - LOG_LOW) / LOG_SPAN * float(KEYS))
    drawn = documents.select("doc_id", "source", "n_tokens", (-F.log(u) / weight).alias("draw")).withColumn("place", F.least(F.greatest(place, F.lit(0)), F.lit(KEYS)).cast("long"))
    cuts = _cuts(drawn, planned, few, refine)
    placed = _with_source(drawn, planned.select(F.col("key").alias("source"), "epochs", "remainder").join(cuts, "source", "left"), few)
    edge = Window.partitionBy("source").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = F.coalesce(F.col("place").between(F.col("lo"), F.col("hi")), F.lit(False))
    cut = placed.where(at_edge).withColumn("upto", F.col("before") + F.sum("n_tokens").over(edge)).withColumn("chosen", F.col("upto") <= F.col("remainder"))
    easy = placed.where(~at_edge).withColumn("chosen", F.coalesce(F.col("place") < F.col("lo"), F.lit(False)))
    columns = ["doc_id", "source", "n_tokens", (F.col("epochs") + F.col("chosen").cast("bigint")).alias("copies")]
    selection = easy.select(*columns).unionByName(cut.select(*columns)).where("copies > 0")
    used = selection.groupBy(F.col("source").alias("key")).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("copies"))
    report = planned.join(used, "key", "left").na.fill(0, ["used_tokens", "copies"])
    share = F.try_divide(F.col("used_tokens").cast("double"), F.sum("used_tokens").over(Window.partitionBy()))  # a row per target
    short = (F.col("copies") == F.col("documents") * F.col("max_repeats")) & (F.col("used_tokens") < F.col("target_tokens"))
    return selection, report.select(
        "source", "weight", "max_repeats", "documents", "tokens", "target_tokens", "epochs", "used_tokens", share.alias("actual_share"), short.alias("short")
    )
