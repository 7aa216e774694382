"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Size of a document: its words.  A source's target: its weight's share of 150 % of all
   words, held at twice its size; the excess is shared again by weight.  The shares follow
   from one number (words per unit of weight), found in closed form by a running sum over
   sources in the order in which they reach their hold.
2. The targets are cut in blocks of equal words.  Sainte-Lague gives each source its blocks
   by highest quotients target / (2 s + 1).  Seats that any threshold surely grants are
   computed at once, and only the last few seats are ranked by quotient.
3. A source is dealt into shards by a seeded hash (a hot source has many; equal rows that are
   more than a shard holds are dealt over several), and its blocks are apportioned to its
   shards the same way, by their sizes.
4. In a shard the documents lie end to end in seeded order, twice.  The first lap's blocks
   come before the second's; within a lap the shard takes a run of blocks from a seeded
   start on, around the end.  A document's words in the chosen blocks are `taken`.

Defined results: a null text has size 0; a null source is a source of its own, ordered last;
repeated rows are documents of their own; sources without words have target 0; an empty
table gives an empty result; extra columns are ignored (or carried).  Reruns agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedyard.llm.common import prep, stage

#: Weights by the rank of the source, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
SHARE = 1.5
HOLD = 2
#: Words of a block.
BLOCK = 8
#: Documents that a shard holds at the mean.
SHARD_DOCS = 4096
#: Rows (sources or shards, some 50 bytes each) up to which a lookup table is broadcast.
LOOKUP_ROWS = 200_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, ...) with weight and target: min(weight * t, 2 * size) for the t
    at which the targets add up to 1.5 times all sizes."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_r", F.row_number().over(rank) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("_r", F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("_hold", F.lit(float(HOLD)) * F.col("source_size")).withColumn("_t", F.col("_hold") / F.col("weight"))
    run = Window.orderBy("_t", "_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(SHARE)
    held, rest = F.coalesce(F.sum("_hold").over(run), F.lit(0.0)), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(run), F.lit(0.0))
    # t if exactly the sources before this one are held; the right one is the first at or under its own hold
    s = s.withColumn("_try", (total - held) / rest)
    s = s.withColumn("_level", F.min(F.when(F.col("_try") <= F.col("_t"), F.struct("_t", "_r", "_try"))).over(every).getField("_try"))
    return s.withColumn("target", F.least(F.col("weight") * F.coalesce("_level", F.col("_t")), F.col("_hold"))).drop("_r", "_t", "_try", "_level")


def sainte_lague(parts: DataFrame, group: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """Adds `got`: of the group's `seats`, those that fall to each row by the highest
    quotients votes / (2 s + 1); ties go by `order`.  No seat is listed but the last few."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    v, q = F.col(votes).cast("double"), F.col(seats)
    p = (parts.withColumn("_v", F.sum(v).over(w)).withColumn("_n", F.count("*").over(w).cast("double")))
    # at the quotient V / (Q - n/2) no more than Q seats are granted, at V / (Q + n/2) no fewer
    sure = F.when((q > F.col("_n") / 2) & (F.col("_v") > 0), F.floor(v * (q - F.col("_n") / 2) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    most = F.when(F.col("_v") > 0, F.ceil(v * (q + F.col("_n") / 2) / F.col("_v") + 0.5)).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_sure", F.greatest(F.lit(0).cast("long"), sure)).withColumn("_most", most)
    p = p.withColumn("_left", q - F.sum("_sure").over(w))
    tries = F.when((F.col("_left") > 0) & (F.col("_most") > F.col("_sure")), F.sequence("_sure", F.least(F.col("_most"), F.col("_sure") + F.col("_left")) - 1))
    names = [c for c in parts.columns]
    open_ = p.withColumn("_s", F.explode_outer(tries))
    quotient = F.when(F.col("_s").isNotNull(), v / (2 * F.col("_s") + 1))
    r = Window.partitionBy(*group).orderBy(F.desc_nulls_last("_q"), *order) if group else Window.orderBy(F.desc_nulls_last("_q"), *order)
    open_ = open_.withColumn("_q", quotient).withColumn("_win", (F.row_number().over(r) <= F.col("_left")) & F.col("_s").isNotNull())
    return open_.groupBy(*names).agg((F.first("_sure") + F.sum(F.col("_win").cast("long"))).alias("got"))


def _lookup(rows: DataFrame) -> DataFrame:
    """A table of few narrow rows, written once; sent to the tasks if a count says it is small,
    else joined by shuffle."""
    rows = stage(rows, "lookup")
    return F.broadcast(rows) if rows.count() <= LOOKUP_ROWS else rows


def mix(docs: DataFrame, seed: int = 17, carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """doc (struct of the carried columns), size, source_size, target, taken and shard per document."""
    prep(docs.sparkSession)
    carry = carry or ["doc_id"]
    base = stage(docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("doc"), F.col("doc_id").cast("string").alias("_id"),
                             F.col("source").cast("string").alias("source"), words("text").alias("size"),
                             F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_h"), F.monotonically_increasing_id().alias("_m")), "sizes")
    src = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    src = targets(src)
    quota = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    src = sainte_lague(src.withColumn("_seats", quota), [], "target", "_seats", [F.col("source").asc_nulls_last(), F.col("_s")])
    src = src.withColumn("_shards", F.ceil(F.col("_docs") / SHARD_DOCS).cast("long")).select("source", "source_size", "target", F.col("got").alias("_quota"), "_shards")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    small = _lookup(src.withColumnRenamed("source", "_src"))
    # equal rows beyond a shard's share go to the shards that follow
    many = base.groupBy("source", "_h").count().where(F.col("count") > SHARD_DOCS)
    many = _lookup(many.select(F.col("source").alias("_src"), F.col("_h").alias("_hh"), F.ceil(F.col("count") / SHARD_DOCS).cast("long").alias("_parts")))
    base = base.join(small, same("source", "_src")).drop("_src")
    base = base.join(many, same("source", "_src") & (F.col("_h") == F.col("_hh")), "left").drop("_src", "_hh")
    part = F.pmod(F.xxhash64("_m"), F.coalesce("_parts", F.lit(1)))
    base = base.withColumn("_shard", F.pmod(F.pmod("_h", F.col("_shards")) + part, F.col("_shards")))
    shards = base.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    shards = sainte_lague(shards, ["source"], "_words", "_quota", [F.col("_shard"), F.col("_s")])
    shards = _lookup(shards.select(F.col("source").alias("_src"), F.col("_shard").alias("_sh"), "_words", "got"))

    lay = Window.partitionBy("source", "_shard").orderBy("_h", "_id", "size", "_m").rowsBetween(Window.unboundedPreceding, -1)
    d = base.withColumn("_at", F.coalesce(F.sum("size").over(lay), F.lit(0)).cast("long"))
    d = d.join(shards, same("source", "_src") & (F.col("_shard") == F.col("_sh")))
    blocks = F.ceil(F.col("_words") / block).cast("long")  # the last one may be short
    d = d.withColumn("_lap", blocks)
    d = d.withColumn("_start", F.when(F.col("_lap") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("_shard")), F.col("_lap"))).otherwise(F.lit(0)))
    d = d.withColumn("_full", F.least(F.floor(F.col("got") / F.greatest(F.col("_lap"), F.lit(1))), F.lit(HOLD)))
    d = d.withColumn("_run", F.when(F.col("_full") >= HOLD, F.lit(0)).otherwise(F.col("got") - F.col("_full") * F.col("_lap")))
    a, b = F.col("_at"), F.col("_at") + F.col("size")

    def inside(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(b, hi * block) - F.greatest(a, lo * block))

    end = F.col("_start") + F.col("_run")
    part = inside(F.col("_start"), F.least(end, F.col("_lap"))) + inside(F.lit(0), F.greatest(end - F.col("_lap"), F.lit(0)))
    taken = F.least(F.col("_full") * F.col("size") + part, F.lit(HOLD) * F.col("size")).cast("long")
    return d.select("doc", F.col("size"), "source_size", "target", taken.alias("taken"), F.col("_shard").alias("shard"))
