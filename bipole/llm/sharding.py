"""Shards by k-d tree partitioning of document metadata.

All nodes of a level are split at once: the bytes and the extent of every node are aggregated, a node over the target is cut along the dimension that is widest relative to
the whole table, at the weighted median of its bytes. The median is found without sorting: histograms of BINS bins per node narrow to the bin that holds it,
until a bin is one value. Texts are read once, for their sizes; only ids, four numbers and the node travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bipole.llm.common import Scratch

TARGET_BYTES = 64 << 20
BINS = 1024
DIMENSIONS = ("lang", "source", "length", "doc_id")


def shards(documents: DataFrame, *, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rows (doc_id, shard, shard_bytes), one for each row of documents: the leaf it falls in, numbered in the order of the tree, and the leaf's bytes of text.

    Dimensions are language, source (both by the rank of their names), length in characters and doc_id. A split sends values up to the weighted median to the left, a
    median at the node's maximum leaves only that value on the right, so both sides have rows; equal values stay together. A node whose rows agree in
    all dimensions can't be split and stays over the target. Null and empty texts weigh 0 bytes and have length 0; other nulls rank first, null ids too. Repeated
    rows are placed each. An empty table gives no rows; further columns aren't read.
    """
    keep = Scratch(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("length"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("w"))
    base = keep.write(rows)

    def ranked(c: str) -> DataFrame:
        # names are few, and their ranks come from a distinct aggregate; a join, not a broadcast by hand, brings them back
        names = base.select(c).distinct()
        return names.select(F.col(c).alias(f"{c}_name"), (F.row_number().over(Window.orderBy(F.col(c).asc_nulls_first())) - 1).cast("bigint").alias(f"{c}_rank"))

    la, so = ranked("lang"), ranked("source")
    cur = base.join(la, base["lang"].eqNullSafe(la["lang_name"])).join(so, base["source"].eqNullSafe(so["source_name"]))
    dims = [F.col("lang_rank").alias("d0"), F.col("source_rank").alias("d1"), F.col("length").alias("d2"), F.coalesce("doc_id", F.lit(-(2**62))).alias("d3")]
    # equal positions travel as one cell until the end
    cells = keep.write(cur.select("doc_id", *dims, "w").groupBy("d0", "d1", "d2", "d3").agg(F.sum("w").alias("w")))
    d = [f"d{i}" for i in range(4)]
    whole = cells.agg(*[F.coalesce(F.max(x) - F.min(x), F.lit(0)).alias(x) for x in d]).first()
    extent = [max(1, whole[x]) for x in d]
    cur = cells.withColumn("node", F.lit("1"))
    while True:
        stat = cur.groupBy("node").agg(F.sum("w").alias("bytes"), *[F.min(x).alias(f"lo{i}") for i, x in enumerate(d)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(d)])
        # the widest dimension, the first of equals
        width = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(float(extent[i])) for i in range(4)]
        widest = F.greatest(*width)
        axis = F.when(width[0] == widest, 0).when(width[1] == widest, 1).when(width[2] == widest, 2).otherwise(3)
        active = stat.where((F.col("bytes") > target_bytes) & (widest > 0)).select("node", axis.alias("axis"), (F.col("bytes") / 2).alias("half"), *[F.array(*[F.col(f"{e}{i}") for i in range(4)]).alias(e) for e in ("lo", "hi")])
        active = keep.write(active.select("node", "axis", "half", F.col("lo")[F.col("axis")].alias("lo"), F.col("hi")[F.col("axis")].alias("hi"), F.col("hi")[F.col("axis")].alias("top"), F.lit(0.0).alias("below")))
        if active.isEmpty():
            break
        goal, value = active, F.array(*d)[F.col("axis")]
        while True:  # narrow [lo, hi] to the bin that holds half of the bytes
            step = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1) / BINS)).cast("bigint")
            inside = cur.join(goal, "node").withColumn("v", value).where("v between lo and hi")
            bins = inside.groupBy("node", "axis", "half", "lo", "hi", "top", "below", ((F.col("v") - F.col("lo")) / step).cast("bigint").alias("bin")).agg(F.sum("w").alias("w"))
            run = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")
            hit = bins.withColumn("run", run).withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.when(F.col("run") >= F.col("half"), 0).otherwise(1), "bin"))).where("rank = 1")
            left = F.col("lo") + F.col("bin") * step
            narrowed = keep.write(hit.select("node", "axis", "half", left.alias("lo"), F.least("hi", left + step - 1).alias("hi"), "top", (F.col("run") - F.col("w")).alias("below")))
            if goal is not active:
                keep.drop(goal)
            goal = narrowed
            if goal.where("hi > lo").isEmpty():
                break
        # values up to the cut go left; a cut at the top would leave the right side empty
        cuts = goal.select("node", "axis", F.when(F.col("lo") >= F.col("top"), F.col("lo") - 1).otherwise(F.col("lo")).alias("cut"))
        side = F.when(F.col("cut").isNull(), F.col("node")).when(F.array(*d)[F.col("axis")] <= F.col("cut"), F.concat("node", F.lit("0"))).otherwise(F.concat("node", F.lit("1")))
        moved = keep.write(cur.join(cuts, "node", "left").select(*d, "w", side.alias("node")))
        keep.drop(goal, active, *([] if cur is cells else [cur]))
        cur = moved
    leaf = cur.groupBy("node").agg(F.sum("w").alias("shard_bytes"))
    leaf = leaf.withColumn("shard", (F.row_number().over(Window.orderBy("node")) - 1).cast("bigint"))
    at = cur.join(leaf, "node").select(*d, "shard", "shard_bytes")
    place = base.join(la, base["lang"].eqNullSafe(la["lang_name"])).join(so, base["source"].eqNullSafe(so["source_name"])).select("doc_id", *dims)
    return place.join(at, d).select("doc_id", "shard", "shard_bytes")


def op8_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def kd_shards_small(spark, sf_dir: str) -> DataFrame:
    """The same over the whole table with shards of 100 kB, so that small tables are split as well."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), target_bytes=100_000)


def _sql(target: int) -> str:
    width = ", ".join(f"(max(d{i}) over (partition by node) - min(d{i}) over (partition by node)) / e{i}::double w{i}" for i in range(4))
    axis = " ".join(f"when w{i} = widest then {i}" for i in range(3))
    return f"""
with recursive la as (select lang, row_number() over (order by lang nulls first) - 1 r from (select distinct lang from documents)),
so as (select source, row_number() over (order by source nulls first) - 1 r from (select distinct source from documents)),
base as (select row_number() over () rid, doc_id, la.r d0, so.r d1, coalesce(length(text), 0) d2, coalesce(doc_id, -4611686018427387904) d3, coalesce(strlen(text), 0) w
  from documents d join la on d.lang is not distinct from la.lang join so on d.source is not distinct from so.source),
extents as (select {", ".join(f"greatest(1, max(d{i}) - min(d{i})) e{i}" for i in range(4))} from base),
tree as (
  select rid, d0, d1, d2, d3, w, '1' node from base
  union all
  select rid, d0, d1, d2, d3, w, node || case when v <= case when med >= top then med - 1 else med end then '0' else '1' end
  from (select *, min(case when run >= bytes / 2.0 then v end) over (partition by node) med, max(v) over (partition by node) top
    from (select *, sum(w) over (partition by node order by v range between unbounded preceding and current row) run
      from (select *, case axis when 0 then d0 when 1 then d1 when 2 then d2 else d3 end v
        from (select *, case {axis} else 3 end axis
          from (select *, greatest(w0, w1, w2, w3) widest
            from (select tree.*, sum(w) over (partition by node) bytes, extents.*, {width} from tree, extents))))))
  where bytes > {target} and widest > 0),
leaves as (select rid, arg_max(node, length(node)) node from tree group by rid)
select doc_id, (dense_rank() over (order by node) - 1)::bigint shard, (sum(w) over (partition by node))::bigint shard_bytes from leaves join base using (rid)
"""


OP8_SQL, SMALL_SQL = _sql(TARGET_BYTES), _sql(100_000)
