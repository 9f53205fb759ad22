"""The driver's queries of the operators over documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import mix as mixing
from flowloom.llm.encode import decode, encode
from flowloom.llm.split import LIMIT, OVERLAP, split
from flowloom.llm.tokens import Vocabulary, count_tokens
from flowloom.sources.tables import table
from flowloom.staging import stage


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents; where the table is so small that its scan may have fewer parts than there are cores, spread over all cores.

    The size is the planner's estimate, so nothing runs for it, and the rows are the same either way.
    """
    rows = table(spark, sf, "documents")
    cores, part = spark.sparkContext.defaultParallelism, 16 << 20
    small = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * part and len(rows.inputFiles()) < cores
    return rows.repartition(cores, "doc_id") if small else rows


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(_documents(spark, sf), "doc_id", "text", Vocabulary(spark))


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts back from their ids: the round trip."""
    vocabulary = Vocabulary(spark)
    return decode(encode(_documents(spark, sf), "doc_id", "text", vocabulary), "doc_id", "ids", vocabulary)


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    rows = _documents(spark, sf).select("doc_id", mixing.normal(F.col("source")).alias("source"), F.length("text").alias("n_chars"), "text")
    counted = count_tokens(rows, "text", ["doc_id", "source", "n_chars"], Vocabulary(spark))
    return stage(counted.withColumn("quality", mixing.quality_by_density(F.col("n_chars"), F.col("n_tokens"))), "sized")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_sized(spark, sf), table(spark, sf, "mix_targets"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1].where("short").select("source")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p9_holds(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: its documents, and whether the mix kept within the budget, came within a document of it or took all there is, and repeated no document too often."""
    sized = _sized(spark, sf)
    selection, report = mixing.mix(sized, table(spark, sf, "mix_targets"))
    most = sized.groupBy(F.col("source").alias("key")).agg(F.max("n_tokens").alias("largest"))
    used = selection.groupBy(F.col("source").alias("key")).agg(F.max("copies").alias("copies"))
    rows = report.withColumn("key", mixing.normal(F.col("source"))).join(most, "key", "left").join(used, "key", "left")
    left = F.col("target_tokens") - F.col("used_tokens")
    return rows.select(
        "source",
        "documents",
        (left >= 0).alias("within"),
        (F.col("short") | (left < F.coalesce("largest", F.lit(0)) + 1)).alias("reached"),
        (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
    )


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that had to be cut, by its second piece."""
    return split(_documents(spark, sf), "doc_id", "text", Vocabulary(spark), with_text=False).where("piece = 2").select("doc_id")


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split(_documents(spark, sf), "doc_id", "text", Vocabulary(spark))


def p10_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every text from the cores of its pieces, whether all pieces, counted anew, fit the limit, and whether they overlap no more than asked."""
    vocabulary = Vocabulary(spark)
    made = stage(split(_documents(spark, sf), "doc_id", "text", vocabulary), "pieces")
    parts = made.select("doc_id", "piece", "text", F.expr("substring(text, 1, cast(core_start - start as int))").alias("lead"), (F.length("text") == F.col("end") - F.col("start")).alias("placed"))
    sizes = count_tokens(parts, "text", ["doc_id", "piece", "lead", "placed"], vocabulary).withColumnRenamed("n_tokens", "size")
    leads = count_tokens(sizes, "lead", ["doc_id", "piece", "size", "placed"], vocabulary)
    fits = leads.groupBy("doc_id").agg(F.every((F.col("size") <= LIMIT) & F.col("placed")).alias("fits"), F.every(F.col("n_tokens") <= OVERLAP).alias("overlaps"))
    core = F.expr("substring(text, cast(core_start - start as int) + 1)")
    texts = made.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", core.alias("core")))), lambda x: x["core"]), "").alias("text"))
    return texts.join(fits, "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p8_ids, p8_decoded, p9_found, p9_report, p9_selection, p9_holds, p10_found, p10_pieces, p10_rebuilt)}


def oracle_sql() -> dict[str, str]:
    key = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
    return {
        "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p9_holds": f"select source, (select count(*) from documents d where {key.format('d.source')} = {key.format('t.source')}) as documents, true as within, true as reached, true as repeats_kept from mix_targets t",
        "p10_rebuilt": "select doc_id, text, true as fits, true as overlaps from documents where text is not null",
    }
