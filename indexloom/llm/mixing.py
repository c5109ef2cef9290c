"""Mixing sources to target weights with a low-discrepancy schedule.

The documents of a source, in an order shuffled by a digest of their ids, form a stream
of words that is cut into blocks of equal size.  Golden-ratio points, mapped through the
cumulative weights, give each slot of the schedule a source; a slot's rank among its
source's slots says which block of the stream it takes, round and round, and the last
slot takes what is left of the target.

Nothing here depends on how many rows a source has: rows are ranked in two levels (within
(source, digest bucket), then over bucket totals), slots as well, and only ids and sizes
are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.llm.scratch import Scratch, by_key, columns, number, numbered, spread
from indexloom.llm.text import SPACES, WORD

#: Words of a block.
BLOCK = 4096
WEIGHTS = (3, 1, 2)
#: Bits of a point, and the inverse of the golden ratio as an odd fraction of 2**BITS: point i is i * PHI mod 2**BITS.
BITS = 62
PHI = 2850178704830799621


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their rank by code point, null last; ranked by a range sort, without one large task."""
    spark = sizes.sparkSession
    ordered = sizes.orderBy(F.col("_source").asc_nulls_last())
    schema = T.StructType([*ordered.schema.fields, T.StructField("_rank", T.LongType())])
    return spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), schema)


def targets(sizes: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets by source: ``share`` of all sizes by weight, no target above ``most`` sizes, the excess shared again.

    The level (words per unit of weight) rises until no source is above its bound; each
    round is one aggregate over the sources, of which the driver sees two numbers.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    out = scratch.cut(_ranked_sources(sizes).withColumn("_w", w).withColumn("_most", F.col("source_size") * F.lit(float(most))), "sources")
    total = (out.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        under = F.col("_w") * level < F.col("_most")
        free, bound = out.agg(F.sum(F.when(under, F.col("_w"))), F.sum(F.when(~under, F.col("_most")))).first()
        new = (total - (bound or 0.0)) / free if free else level
        if new <= level:
            break
        level = new
    return out.withColumn("target", F.least(F.col("_w") * level, F.col("_most")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17, uid: str | None = None) -> dict[str, DataFrame]:
    """Plans the mix.

    Returns ``documents`` (_uid, id, size, source_size, target, taken), ``sources``, and
    ``schedule`` (slot, source, block, words): the blocks in the order of the mix; a
    document's segments of a block are in ``segments``.

    Rows without words (null or empty text) have size and taken 0.  A null source is a
    source of its own, ranked last.  Repeated rows are documents of their own.  An empty
    table gives empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = scratch.cut(docs.select(number(uid).alias("_uid"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), digest.alias("_h")), "sizes")
    rows = sized.count()
    sources = scratch.cut(targets(sized.groupBy("_source").agg(F.sum("size").alias("source_size")), scratch, weights, share, most), "targets")

    # each source's stream: start of every document, by two-level running sums over the shuffled order
    same = F.col("d._source").eqNullSafe(F.col("s._source"))
    buckets = spread(rows)
    bucket = (F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    ranked = sized.alias("d").join(sources.alias("s"), same).select("d.*", "s._rank", "s.source_size", "s.target").withColumn("_b", bucket)
    w = Window.partitionBy("_rank", "_b").orderBy("_h", F.col("_id").asc_nulls_last(), "_uid").rowsBetween(Window.unboundedPreceding, -1)
    inner = scratch.cut(ranked.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0))), "ranked")
    wb = Window.partitionBy("_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = inner.groupBy("_rank", "_b").agg(F.sum("size").alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(wb), F.lit(0))).drop("_s")
    stream = scratch.cut(inner.join(by_key(base), ["_rank", "_b"]).withColumn("_start", F.col("_base") + F.col("_in")).drop("_in", "_base", "_b"), "stream")
    scratch.drop(inner)

    # the schedule: slots with low-discrepancy sources, ranked within each source
    slots = _slots(sources, scratch, block)
    take = F.least(F.lit(block), F.col("_goal") - F.col("_turn") * block)
    visits = slots.where("_turn * %d < _goal" % block).withColumn("_from", F.col("_turn") * block).withColumn("words", take)
    # a turn reads the cyclic stream [from, from + words): at most a few pieces of blocks
    size = F.col("source_size")
    cyc = F.expr("sequence(_from div source_size, (_from + words - 1) div source_size)")
    parts = visits.withColumn("_c", F.explode(cyc))
    lo = F.greatest(F.col("_from") - F.col("_c") * size, F.lit(0))
    hi = F.least(F.col("_from") + F.col("words") - F.col("_c") * size, size)
    parts = parts.withColumn("_lo", lo).withColumn("_hi", hi)
    parts = parts.withColumn("block", F.explode(F.expr(f"sequence(_lo div {block}, (_hi - 1) div {block})")))
    parts = parts.withColumn("_lo", F.greatest("_lo", F.col("block") * block)).withColumn("_hi", F.least(F.col("_hi"), (F.col("block") + 1) * block))
    schedule = parts.select("slot", "_rank", "_source", "block", "_lo", "_hi", (F.col("_hi") - F.col("_lo")).alias("words"))

    # documents meet the schedule in their blocks
    full = stream.where("size > 0")
    segments = full.select("_uid", "_rank", "_start", (F.col("_start") + F.col("size")).alias("_end"), F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("block"))
    segments = segments.withColumn("_start", F.greatest("_start", F.col("block") * block)).withColumn("_end", F.least("_end", (F.col("block") + 1) * block))
    met = segments.join(by_key(schedule.select("_rank", "block", "_lo", "_hi")), ["_rank", "block"])
    taken = met.groupBy("_uid").agg(F.sum(F.greatest(F.lit(0), F.least("_end", "_hi") - F.greatest("_start", "_lo"))).alias("taken"))
    out = stream.join(by_key(taken), "_uid", "left").select("_uid", F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return {"documents": out, "sources": sources, "schedule": schedule, "segments": segments}


def _point(i: str) -> Column:
    """i * PHI mod 2**BITS for i below 2**44, in halves of 31 bits, so that no product leaves 63 bits."""
    half = BITS // 2
    one = (1 << half) - 1
    high, low = PHI >> half, PHI & one
    upper = f"((({i} & {one}L) * {high}L + shiftright({i}, {half}) * {low}L) & {one}L)"
    return F.expr(f"({upper} * {1 << half}L + ({i} & {one}L) * {low}L) & {(1 << BITS) - 1}L")


def _slots(sources: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """slot, _turn (rank of the slot among its source's), and the columns of the source.

    Slot i's point, a fraction of 2**BITS, falls into one source's interval of the cumulative targets; an interval
    has at least 2**18 points' room for up to 2**44 slots, so none is empty.  As many slots are laid as all targets
    take and some more; the discrepancy of the points is logarithmic, so a source can lack a few then, and gets
    them at the end.
    """
    spark = sources.sparkSession
    w = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    goal = F.round("target").cast("long")
    src = sources.where("target > 0").select("_source", "_rank", "source_size", goal.alias("_goal"))
    src = scratch.cut(src.where("_goal > 0").withColumn("_need", F.ceil(F.col("_goal") / block)).withColumn("_cum", F.sum("_need").over(w)), "needs")
    head = src.agg(F.max("_cum"), F.count(F.lit(1))).first()
    total, count = head[0] or 0, head[1]
    if total >= 1 << 43:
        raise ValueError("more than 2**43 slots; take larger blocks")
    cells = max(1024, 4 * count)
    width = (1 << BITS) // cells + 1

    def mark(c: str) -> Column:
        return F.expr(f"cast(((cast({c} as decimal(18,0)) * cast('{1 << BITS}' as decimal(20,0))) div cast({max(1, total)} as decimal(18,0))) as bigint)")

    bounds = src.withColumn("_p0", mark("(_cum - _need)")).withColumn("_p1", mark("_cum"))
    bounds = bounds.withColumn("_cell", F.explode(F.expr(f"sequence(_p0 div {width}L, (_p1 - 1) div {width}L)")))
    laid = total + 64 * (1 + max(1, total).bit_length()) if total else 0
    points = spark.range(laid).select(F.col("id").alias("slot"), _point("id").alias("_x"))
    points = points.withColumn("_cell", F.expr(f"_x div {width}L"))
    put = points.join(bounds, "_cell").where("_x >= _p0 and _x < _p1").drop("_cell", "_x", "_p0", "_p1", "_cum")
    chunk = spread(laid)
    put = scratch.cut(put.withColumn("_chunk", F.expr(f"slot div {chunk}")), "slots")
    got = put.groupBy("_rank").agg(F.count(F.lit(1)).alias("_got"))
    lack = src.join(got, "_rank", "left").withColumn("_lack", F.col("_need") - F.coalesce("_got", F.lit(0))).where("_lack > 0")
    last = (laid // chunk + 1) * chunk if total else 0
    more = lack.withColumn("_k", F.explode(F.expr("sequence(1L, _lack)"))).withColumn("slot", last + F.col("_rank") * F.lit(1 << 20) + F.col("_k"))
    put = scratch.cut(put.unionByName(more.withColumn("_chunk", F.lit(last // chunk)).select(*put.columns)), "laid")
    wc = Window.partitionBy("_rank").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = put.groupBy("_rank", "_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(wc), F.lit(0))).drop("_n")
    wi = Window.partitionBy("_rank", "_chunk").orderBy("slot")
    return put.withColumn("_i", F.row_number().over(wi)).join(by_key(base), ["_rank", "_chunk"]).withColumn("_turn", F.col("_base") + F.col("_i") - 1).drop("_i", "_base", "_chunk")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``: whole copies, then a part of one.

    A document of which the mix takes ``taken`` words comes ``taken div size`` times whole, and, if words
    remain, once with its first remaining words (white space between them kept).  Rows without
    words take no room in the mix and are left out, as are rows of which it takes nothing.
    """
    scratch = Scratch(docs.sparkSession)
    given, uid = numbered(docs, scratch)
    plan = mix(given, id_col, text_col, source_col, weights, share, most, block, seed, uid)["documents"]
    took = plan.where("taken > 0").select("_uid", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    rows = given.select(F.col(uid).alias("_uid"), F.struct(columns(docs)).alias("_row"), F.col(text_col).alias("_text")).join(by_key(took), "_uid")
    whole = F.expr("_taken div _size")
    rest = F.col("_taken") % F.col("_size")
    parts = F.concat(F.when(whole > 0, F.array_repeat(F.lit(0).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<long>")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("_words", F.explode(parts))
    cut = F.col("_row").withField(text_col, _first_words(F.col("_text"), F.col("_words")))
    return rows.select(cut.alias("_row")).select("_row.*")


def _first_words(text: Column, words: Column) -> Column:
    """The first ``words`` words of a text as they stand; all of it for 0."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{SPACES[:-1]}*{WORD}"), F.lit(0))
    return F.when(words == 0, text).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.lit(1), words.cast("int"))), ""))
