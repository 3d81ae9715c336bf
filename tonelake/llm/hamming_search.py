"""Exact nearest binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments; every segment has an index of the codes by its value. A round looks up, for each
open query and segment, all values within radius r. A code that no segment brings differs in over r bits in each,
so all codes within m * r + m - 1 bits are then known. A query is done when its k-th neighbour lies within
that distance; for the others the radius grows by one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonelake.llm.store import written

BITS = 64
NEIGHBOURS = 10


def sign_code(vector: Column) -> Column:
    """64 bits as a long: bit i is set if component i is a number over zero. Components beyond the 64th do not count."""
    bits = [F.when(F.get(vector, F.lit(i)) > 0, ~F.isnan(F.get(vector, F.lit(i)))) for i in range(BITS)]
    code = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        value = (1 << i) - (1 << 64 if i == 63 else 0)
        code = code.bitwiseOR(F.when(b, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return code


def _cuts(rows: int) -> list[tuple[int, int]]:
    """Shift and width of the segments. A value should have a few codes: to verify one costs less than a further
    probe, so a segment has two bits less than the number of codes."""
    m = max(2, min(16, -(-BITS // max(4, rows.bit_length() - 2))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def top_codes(codes: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``distance`` of the ``k`` rows of ``codes`` (``id``, ``code``) nearest to every row
    of ``queries`` (``id``, ``code``), itself left out. Ties go to the smaller id, so the result is one and the same.

    Equal codes are searched once and known by their ``k + 1`` smallest ids: no more of them can be an answer.
    Fewer than ``k`` other rows give fewer ranks. Rows with a null id or code are left out; of repeated ids
    one row counts per code.
    """
    spark = codes.sparkSession
    clean = codes.select("id", "code").dropna().distinct()
    first = clean.withColumn("nth", F.row_number().over(Window.partitionBy("code", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")))
    first = first.where(F.col("nth") <= k + 1).withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id")))
    known = written(first.where(F.col("nth") <= k + 1).select("id", "code"), "code-ids")
    distinct = written(known.select("code").distinct(), "codes")
    cuts = _cuts(distinct.count())
    m = len(cuts)
    index = distinct.select("code", F.posexplode(F.array(*[_part(F.col("code"), *c) for c in cuts])).alias("s", "value"))
    index = written(index, "code-index")
    asked = written(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).dropna().distinct(), "queries")
    open_ = asked.select("query").distinct()
    done, radius = [], 0
    while True:
        reach = m * radius + m - 1
        probes = []
        for s, (shift, width) in enumerate(cuts):
            flips = [sum(1 << b for b in bits) for w in range(min(radius, width) + 1) for bits in combinations(range(width), w)]
            near = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<int>")
            part = _part(F.col("query"), shift, width)
            probes.append(open_.select("query", F.lit(s).alias("s"), part.alias("part"), F.explode(near).alias("flip")))
        probe = probes[0]
        for p in probes[1:]:
            probe = probe.unionByName(p)
        probe = probe.select("query", "s", F.col("part").bitwiseXOR(F.col("flip")).alias("value"))
        differ = F.col("query").bitwiseXOR(F.col("code"))
        # Of the segments that bring a code only the first one counts.
        earlier = F.lit(False)
        for s, c in enumerate(cuts):
            earlier = earlier | ((F.col("s") > s) & (F.bit_count(_part(differ, *c)) <= radius))
        # The probes are many times what Spark takes them for: they must not be broadcast.
        met = probe.join(index.hint("shuffle_hash"), ["s", "value"]).where(~earlier).select("query", "code", F.bit_count(differ).alias("distance"))
        met = met.where(F.col("distance") <= reach).join(known, "code")
        nearest = Window.partitionBy("query").orderBy("distance", "id")
        top = met.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k + 1).select("query", "id", "distance", "nth")
        top = written(top, "nearest")
        full = top.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("query")
        if reach >= BITS:
            done.append(top)
            break
        done.append(top.join(full, "query", "left_semi"))
        open_ = written(open_.join(full, "query", "left_anti"), "open")
        if open_.isEmpty():
            break
        radius += 1
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    out = asked.join(found, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("nth"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def op8_exact_topk(spark, sf_dir) -> DataFrame:
    """The 10 nearest sign codes of every vector whose number is divisible by 20, among all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes = written(rows.where("embedding is not null").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")), "sign-codes")
    found = top_codes(codes, codes.where("id % 20 = 0"))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").cast("long").alias("distance"))


OP8_SQL = """
with codes as (
  select vec_id, list_sum(list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then 1::hugeint << i::int else 0::hugeint end)) as code
  from embeddings where embedding is not null
), pairs as (
  select q.vec_id as query_id, c.vec_id, bit_count(xor(q.code, c.code))::bigint as distance
  from codes q join codes c on c.vec_id <> q.vec_id
  where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs
)
select query_id, rank, vec_id, distance from ranked where rank <= 10
"""
