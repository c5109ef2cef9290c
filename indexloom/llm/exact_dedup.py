"""Exact dedup by deterministic block naming.

Texts (white-space runs as one space) are cut into blocks of fixed size.  The distinct
blocks are sorted into integer names; then adjacent names are paired and the distinct
pairs get names, again and again, until each document has one name.  Two documents have
the same name at the same level exactly when their texts are equal: names are given to
distinct contents, never to hashes alone.  Hashes only route blocks to their names, and
blocks whose hash is shared by different contents take a second join on the content.

Cost: each block's content is aggregated once (map side first, so a passage that a third
of the corpus shares leaves each task once); all else moves integers, half as many at
each level.  Joins back to the rows are sort-merge joins on both sides' keys, which
adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch, by_key, columns, number, numbered, spread
from indexloom.llm.text import SPACES

#: Characters of a block.
BLOCK = 2048


def normal(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _named(keys: DataFrame, cols: list[str], buckets: int) -> DataFrame:
    """Sorts distinct key rows into integer names: the rank within a bucket, after the bucket."""
    w = Window.partitionBy("_b").orderBy(*cols)
    return keys.withColumn("_b", F.pmod(F.xxhash64(*cols), F.lit(buckets))).withColumn("name", F.col("_b") * F.lit(1 << 36) + F.row_number().over(w)).drop("_b")


def identities(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, uid: str | None = None) -> DataFrame:
    """One row per input row: _uid, id_col, _sha (of the normalised text), _level, _name.

    Rows of equal normalised text, and only those, share (_level, _name).  ``uid``
    names a column of ``docs`` that numbers its rows; without it they are numbered here.
    """
    rows = docs.select(number(uid).alias("_uid"), F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_t"))
    # all blocks of a text in one pass, before rows are made of them
    cut = F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = rows.select("_uid", "_id", F.sha2(F.col("_t").cast("binary"), 256).alias("_sha"), F.when(F.col("_t") == "", F.array(F.lit(""))).otherwise(cut).alias("_blocks"))
    rows = rows.select("_uid", "_id", "_sha", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_pos", "_c"))
    blocks = scratch.cut(rows.withColumn("_k", F.xxhash64("_c")), "blocks")
    total = blocks.count()

    # the first names: distinct contents, counted per hash
    seen = blocks.groupBy("_k").agg(F.count_distinct("_c").alias("_m"))
    names = scratch.cut(_named(seen, ["_k"], spread(total)), "names")
    level = blocks.select("_uid", "_n", "_pos", "_k").join(names.where("_m = 1").select("_k", "name"), "_k").select("_uid", "_n", "_pos", "name")
    if not names.where("_m > 1").isEmpty():  # different contents of one hash: by content, with names below zero
        shared = blocks.join(names.where("_m > 1").select("_k"), "_k", "left_semi")
        own = _named(shared.select("_c").distinct(), ["_c"], spread(total)).withColumn("name", -F.col("name"))
        level = level.unionByName(shared.join(own, "_c").select("_uid", "_n", "_pos", "name"))
    level = scratch.cut(level, "level")

    done, depth, kept = [], 0, [blocks, level]
    while True:
        done.append(level.where("_n = 1").select("_uid", F.lit(depth).alias("_level"), F.col("name").alias("_name")))
        rest = level.where("_n > 1")
        even = F.when(F.col("_pos") % 2 == 0, F.col("name"))
        odd = F.when(F.col("_pos") % 2 == 1, F.col("name"))
        pairs = rest.groupBy("_uid", F.expr("_pos div 2").cast("int").alias("_p")).agg(F.max("_n").alias("_m"), F.max(even).alias("_a"), F.coalesce(F.max(odd), F.lit(0)).alias("_b2"))
        pairs = scratch.cut(pairs.select("_uid", F.expr("(_m + 1) div 2").cast("int").alias("_n"), F.col("_p").alias("_pos"), "_a", "_b2"), "pairs")
        count = pairs.count()
        if not count:
            scratch.drop(pairs)
            break
        depth += 1
        own = _named(pairs.select("_a", "_b2").distinct(), ["_a", "_b2"], spread(count))
        level = scratch.cut(pairs.join(own, ["_a", "_b2"]).select("_uid", "_n", "_pos", "name"), "level")
        scratch.drop(pairs)
        kept.append(level)
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    heads = blocks.where("_pos = 0").select("_uid", F.col("_id").alias(id_col), "_sha")
    return heads.join(named, "_uid")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, uid: str | None = None) -> DataFrame:
    """Groups rows of equal normalised text.

    Returns one row per input row: _uid, id_col, keep_id, group_size, kept, text_sha256.
    The row with the smallest id stays; a null id counts as larger than any other, and of
    rows with equal id and text one stays.  Null text counts as empty, empty texts are
    equal to each other, an empty table gives an empty result, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    ids = scratch.cut(identities(docs, scratch, id_col, text_col, block, uid), "identities")
    first = F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), F.col("_uid").alias("u")))
    # written, so that the join below has plain exchanges on both sides, which are split where a group is large
    groups = scratch.cut(ids.groupBy("_level", "_name").agg(first.alias("_f"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["_level", "_name"]).select("_uid", id_col, F.col("_f.i").alias("keep_id"), "group_size", (F.col("_uid") == F.col("_f.u")).alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    scratch = Scratch(docs.sparkSession)
    rows, uid = numbered(docs, scratch)
    kept = exact_dedup(rows, id_col, text_col, block, uid).where("kept").select(F.col("_uid").alias(uid))
    return rows.join(by_key(kept), uid, "left_semi").select(columns(docs))
