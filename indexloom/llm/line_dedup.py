"""Line dedup by distinct-site spread, in DataFrame operations alone.

A line is boilerplate if it stands on at least ``threshold`` different sites.  Lines are hashed
(128 bits); those of one site only leave at once by an aggregate of two numbers.  For the others
HyperLogLog sketches of their sites are built by map-side aggregation and merged; lines whose
estimate is near the threshold get an exact count of distinct sites.  Boilerplate goes from every
document that has it.

A line that many rows share is one row per task after map-side aggregation.  Where lines are joined with
keys, the keys of more than 1/``HOT`` of all lines (so fewer than ``HOT``) are broadcast, and their lines stay where
they are; the others meet by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.scratch import Scratch, by_key, number

#: Sites from which a line is boilerplate; sketch size (log2); relative width of "near" (over 6 standard errors).
THRESHOLD, LG_K, NEAR = 8, 12, 0.15
#: A line that is more than this part of all lines is hot.
HOT = 4096
_KEY = ["_h", "_g"]


def holding(lines: DataFrame, keys: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of ``lines`` whose key (_h, _g) is in ``keys``, each key once; ``hot``: the keys of all hot lines."""
    few = F.broadcast(keys.join(F.broadcast(hot), _KEY, "left_semi"))  # fewer than HOT rows, as ``hot``
    cold = lines.join(F.broadcast(hot), _KEY, "left_anti").join(by_key(keys), _KEY, "left_semi")
    return lines.join(few, _KEY, "left_semi").unionByName(cold)


def boilerplate(lines: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Keys of the lines (with _h, _g, _site) on at least ``threshold`` sites; keys of the hot lines, on any number."""
    total = lines.count()
    counts = lines.groupBy(*_KEY).agg((F.min("_site") != F.max("_site")).alias("wide"), (F.count(F.lit(1)) * HOT > total).alias("hot"))
    counts = scratch.cut(counts.where("wide or hot"), "counts")
    spread, hot = counts.where("wide").select(*_KEY), counts.where("hot").select(*_KEY)
    shared = scratch.cut(holding(lines.select(*_KEY, "_site"), spread, hot), "shared")
    sketches = shared.groupBy(*_KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("sites"))
    sketches = scratch.cut(sketches, "estimates")
    low, high = threshold * (1 - NEAR) - 1, threshold * (1 + NEAR) + 1
    near = sketches.where(F.col("sites").between(low, high)).select(*_KEY)
    exact = holding(shared, near, hot).groupBy(*_KEY).agg(F.count_distinct("_site").alias("n")).where(F.col("n") >= threshold).select(*_KEY)
    return scratch.cut(sketches.where(F.col("sites") > high).select(*_KEY).unionByName(exact), "boilerplate"), hot


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", threshold: int = THRESHOLD, uid: str | None = None) -> DataFrame:
    """One row per input row: _uid, doc_id, n_lines, n_removed, kept (the text left).

    Lines end at line feeds and are compared without blanks at their ends; blank lines stay.  Null text has
    no line, empty text one.  A null site is a site of its own.  Repeated rows are rows of their own.  Texts of very
    many lines take time in proportion; an empty table gives an empty result; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = scratch.cut(docs.select(number(uid).alias("_uid"), F.col(id_col).alias("_id"), F.xxhash64(site_col).alias("_site"), F.col(text_col).alias("_t")), "base")
    lines = base.select("_uid", "_site", F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
    bare = F.regexp_replace("_line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    hashed = lines.withColumn("_b", bare).where("_b <> ''").select("_uid", "_site", "_pos", F.xxhash64("_b").alias("_h"), F.xxhash64(F.lit(1), "_b").alias("_g"))
    hashed = scratch.cut(hashed, "lines")
    marks = holding(hashed.select("_uid", "_pos", *_KEY), *boilerplate(hashed, scratch, threshold))
    marks = scratch.cut(marks.groupBy("_uid").agg(F.collect_list("_pos").alias("_gone")), "marks")
    scratch.release()
    both = base.select("_uid", F.col("_id").alias(id_col), "_t").join(by_key(marks), "_uid", "left").withColumn("_lines", F.split("_t", "\n"))
    n = F.when(F.col("_t").isNull(), F.lit(0)).otherwise(F.size("_lines"))
    # array_except hashes the places that go, so a text of very many lines takes time in proportion
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_t", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    return both.select("_uid", id_col, n.cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_removed"), kept.alias("kept"))
