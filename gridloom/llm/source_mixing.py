"""Operator 8: mixing sources to target weights by systematic sampling. DataFrame functions only.

A document's size is its number of words. Every source gets a target: the total size is shared by weight, capped at
``most_copies`` times the source's size, and the excess of capped sources is reshared by weight among the others (water
filling, solved exactly from sorted fill levels). A document's expected copies are target / source size. Within a source,
documents are lined up by size class; the prefix sums of expected copies, shifted by one offset from the source's
name and the seed, decide: a document is emitted once for each integer that its stretch crosses. Lining up by size keeps
each source's words near its target, since neighbours in line are of like size.

Prefix sums have two levels: counts of (source, size class, salt) groups, of which there is a fixed number a source, are
summed in line; ranks are taken within a group. No task holds a whole source.

Edge cases: a null or empty text has size 0; a null source is a source of its own, last; a source of size 0 takes
nothing; repeated rows are separate documents; ties go by id and contents; an empty table gives an empty one; other
columns are kept in the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.storage import cut, partitions

SPACE, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: Size classes for each doubling of the size.
CLASSES = 8


def size_of(text: Column) -> Column:
    """Number of runs of characters other than blank and U+0009 to U+000D."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most_copies: int, share: float = 1.0) -> DataFrame:
    """(_key, _source_size, _target) from (_key, _source_size): one row for each source, so its windows are small.

    With ``level`` the common fill per unit of weight, target = min(cap, level * weight). Sources in order of
    cap / weight are capped up to some point; that point is where the level they leave no longer exceeds the next ratio.
    """
    numbered = sizes.withColumn("_at", F.row_number().over(W.orderBy(F.col("_key.missing"), F.col("_key.name"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    every = W.partitionBy(F.lit(0))
    rows = numbered.withColumn("_w", weight).withColumn("_cap", F.col("_source_size") * F.lit(float(most_copies))).withColumn("_total", F.sum("_source_size").over(every) * F.lit(share))
    line = W.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_at")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # The first source in line that isn't capped sets the level; all before it are capped.
    level = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_at"), F.col("_level").alias("level")))).over(every)
    rows = rows.withColumn("_first", level)
    return rows.select("_key", "_source_size", F.least("_cap", F.coalesce(F.col("_first.level") * F.col("_w"), F.col("_cap"))).alias("_target"))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_copies: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, with_documents: bool = True) -> DataFrame:
    """_doc (all columns of ``documents``, unless left out), _id, _size, _source_size, _target, _copies (0 to ``most_copies``)."""
    salts = max(16, partitions(documents.sparkSession))
    key = F.struct(F.col(source_col).isNull().alias("missing"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    size = size_of(F.col(text_col))
    rows = documents.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), size.alias("_size"), key.alias("_key"), F.xxhash64(F.col(text_col)).alias("_text"))
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("_size") + 1) * CLASSES).cast("int"))
    rows = rows.withColumn("_mark", F.xxhash64("_id", "_text", F.lit(seed))).withColumn("_salt", F.pmod("_mark", F.lit(salts)).cast("int"))

    # Texts are measured once if only sizes go on, else twice: for the small table of counts, and where they are dealt.
    if not with_documents:
        rows = cut(rows.drop("_doc"))
    counted = rows.groupBy("_key", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    counted = cut(counted) if with_documents else counted
    wanted = targets(counted.groupBy("_key").agg(F.sum("_words").alias("_source_size")), weights, most_copies, share)
    line = W.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(W.unboundedPreceding, -1)
    groups = counted.withColumn("_before", F.coalesce(F.sum("_n").over(line), F.lit(0))).join(wanted, "_key").select(
        F.col("_key").alias("_k"), F.col("_class").alias("_c"), F.col("_salt").alias("_s"), "_before", "_source_size", "_target"
    )
    order = W.partitionBy("_key", "_class", "_salt").orderBy("_size", "_id", "_mark")
    ranked = rows.withColumn("_rank", F.row_number().over(order)).join(groups, (F.col("_key") == F.col("_k")) & (F.col("_class") == F.col("_c")) & (F.col("_salt") == F.col("_s")))
    expected = F.when(F.col("_source_size") > 0, F.least(F.lit(float(most_copies)), F.col("_target") / F.col("_source_size"))).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.col("_key.name"), F.col("_key.missing"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    upto = (F.col("_before") + F.col("_rank")).cast("double")
    copies = F.floor(upto * expected + offset) - F.floor((upto - 1) * expected + offset)
    copies = F.least(F.greatest(copies, F.floor(expected)), F.ceil(expected)).cast("int")  # rounding of the product can't add a copy
    return ranked.select(*["_doc"] * with_documents, "_id", "_size", "_source_size", "_target", copies.alias("_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it has copies, with its own columns only."""
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
