"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, WORD

#: Multipliers of the seeded order of blocks: primes, of which the first that does not divide the number of blocks is used.
STEPS = (1000003, 998244353, 2147483647)


#: What the mix adds to a row.
RESULTS = ("size", "source_size", "target", "taken", "spans")


def draw(*parts: Column) -> Column:
    """60 bits of an md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) rows with weight and target (double).

    Weights go by the sources' code-point order, null last, repeating. All sizes together are shared by
    weight; a source stops at `most` times its size and the excess is shared again by weight. The
    rising order of most * size / weight is the order in which sources stop, so one pass suffices.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sources.withColumn("weight", w.cast("long")).withColumn("__cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("__all", F.sum("source_size").over(everything)).withColumn("__left", F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))).withColumn("__w", F.sum("weight").over(after))
    rows = rows.withColumn("__full", F.col("__cap") * F.col("__w") <= F.col("__left") * F.col("weight"))
    spent, open_w = F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)).over(everything), F.sum(F.when(~F.col("__full"), F.col("weight"))).over(everything)
    rows = rows.withColumn("target", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(((F.col("__all") - spent) * F.col("weight")).cast("double") / open_w))
    return rows.select("source", "source_size", "weight", "target")


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str, name: str) -> DataFrame:
    """Adds the number of seats of each row: the group's seats go to the highest quotients weight / (2 i + 1), ties to the lesser key.

    The divisor at which the quotients pass the number of seats is found by bisection over the group's weights,
    which are per source or per shard, never per document; only quotients equal to double precision are
    then ranked, one per row.
    """
    rows = rows.withColumn("__g", F.struct(*[F.col(g) for g in group], F.lit(1).alias("__one")))
    by = Window.partitionBy("__g")
    high = F.expr(
        f"""if(__n = 0 or size(__ws) = 0, cast('infinity' as double), aggregate(sequence(1, 120),
            struct(aggregate(__ws, 0D, (a, x) -> a + x) / (4D * __n + 2D * size(__ws) + 2D) as lo, array_max(__ws) * 2D as hi),
            (s, k) -> if(aggregate(__ws, 0L, (a, x) -> a + cast(floor((x / ((s.lo + s.hi) / 2D) + 1D) / 2D) as bigint)) > __n,
                         struct((s.lo + s.hi) / 2D as lo, s.hi as hi), struct(s.lo as lo, (s.lo + s.hi) / 2D as hi)), s -> s.hi))"""
    )
    divisors = rows.groupBy("__g").agg(F.collect_list(F.when(F.col(weight) > 0, F.col(weight).cast("double"))).alias("__ws"), F.max(seats).alias("__n")).select(F.col("__g").alias("__g2"), high.alias("__hi"))
    rows = rows.join(divisors, F.col("__g").eqNullSafe(F.col("__g2")))
    rows = rows.withColumn("__base", F.when(F.col(weight) > 0, F.floor((F.col(weight) / F.col("__hi") + 1) / 2)).otherwise(0).cast("long"))
    rows = rows.withColumn("__rest", F.col(seats) - F.sum("__base").over(by))
    last = by.orderBy((F.col(weight) > 0).desc(), (F.col(weight) / (2 * F.col("__base") + 1)).desc(), F.col(key).asc_nulls_last())
    return rows.withColumn(name, F.col("__base") + F.when((F.row_number().over(last) <= F.col("__rest")) & (F.col(weight) > 0), 1).otherwise(0)).drop("__g", "__g2", "__hi", "__base", "__rest")


#: Sources or shards of which the table is broadcast at most; with more, the join shuffles.
BROADCAST_ROWS = 100_000
#: Cells that a source's documents fall into; shards are made of whole cells.
CELLS = 1 << 20


def mix(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 32, shard_words: int = 200_000, seed: str = "mix") -> DataFrame:
    """The rows with size, source_size, target, taken and spans.

    Every source is a line of equal blocks of words, cut into shards of about shard_words words by a seeded
    hash of the document, so the largest source is dealt over many tasks. Blocks of all targets go to sources by
    Sainte-Lague, a source's blocks to its shards likewise. A shard repeats all its blocks as often as
    its quota allows and takes the remainder in a seeded order of blocks; taken counts the words of a
    document inside taken blocks, and spans has the word ranges [lo, hi) of the document that lie in the
    blocks of the remainder, the words beyond the whole repetitions, in the order of the text. Null or empty texts have size 0 and nothing taken; a null source
    is a source; repeated rows are separate documents; an empty table gives an empty one; columns of the results' names are replaced.
    """
    docs = docs.drop(*RESULTS)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("size", size).withColumn("__source", F.col(source)).withColumn("__draw", draw(F.lit(seed), F.col(doc_id).cast("string"))).withColumn("__tie", draw(F.lit(seed + " order"), F.col(doc_id).cast("string")))
    cut = Cut(spark)
    cell = F.pmod(draw(F.lit(seed), F.col(doc_id).cast("string")), F.lit(CELLS))
    cells = cut.table(docs.select(F.col(source).alias("source"), size.alias("size"), cell.alias("cell")).groupBy("source", "cell").agg(F.sum("size").alias("size")))
    totals = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    totals = totals.withColumn("__seats", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block + 0.5).cast("long"))
    totals = apportion(totals, [], "source", "target", "__seats", "__quota").withColumn("__shards", F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("long"))
    totals = cut.table(totals.select(F.col("source").alias("__s"), "source_size", "target", "__quota", "__shards"))
    hint = F.broadcast if totals.count() <= BROADCAST_ROWS else lambda x: x
    shards = cells.join(hint(totals), F.col("source").eqNullSafe(F.col("__s"))).groupBy("__s", "__quota", F.pmod("cell", "__shards").alias("__shard")).agg(F.sum("size").alias("__words"))
    shards = apportion(shards, ["__s"], "__shard", "__words", "__quota", "__take").withColumn("__n", F.ceil(F.col("__words") / block).cast("long"))
    shards = cut.table(shards.select(F.col("__s").alias("__s2"), F.col("__shard").alias("__k"), "__n", F.least(F.col("__take"), most * F.col("__n")).alias("__take")))
    small = F.broadcast if shards.count() <= BROADCAST_ROWS else lambda x: x
    rows = rows.join(hint(totals), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__shard", F.pmod(F.pmod("__draw", F.lit(CELLS)), "__shards"))
    line = Window.partitionBy("__source", "__shard").orderBy("__tie", doc_id, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__end", F.sum("size").over(line))
    rows = rows.join(small(shards), F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__shard") == F.col("__k")))
    rows = rows.withColumn("__first", F.pmod(draw(F.lit(seed + " first"), F.coalesce(F.col("__source"), F.lit("")), F.col("__shard").cast("string")), F.greatest("__n", F.lit(1))))
    rows = rows.withColumn("__step", F.coalesce(*[F.when((F.col("__n") % s) != 0, F.lit(s).cast("long")) for s in STEPS], F.lit(1).cast("long")))
    taken = F.expr(
        f"""if(size = 0, 0L, (__take div __n) * size + if(__take % __n = 0, 0L, aggregate(sequence((__end - size) div {block}, (__end - 1) div {block}), 0L,
            (a, j) -> a + if((j * (__step % __n) + __first) % __n < __take % __n, least(__end, (j + 1) * {block}) - greatest(__end - size, j * {block}), 0L))))"""
    )
    spans = F.expr(
        f"""transform(filter(if(size = 0 or __take % __n = 0, cast(array() as array<bigint>), sequence((__end - size) div {block}, (__end - 1) div {block})), j -> (j * (__step % __n) + __first) % __n < __take % __n),
            j -> struct(greatest(__end - size, j * {block}) - __end + size as lo, least(__end, (j + 1) * {block}) - __end + size as hi))"""
    )
    return rows.withColumn("taken", taken).withColumn("spans", spans).drop("__source", "__draw", "__tie", "__s", "__quota", "__shards", "__shard", "__end", "__s2", "__k", "__n", "__take", "__first", "__step")


MIX_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
             ('0x' || substr(md5('mix|' || doc_id), 1, 15))::bigint as draw, ('0x' || substr(md5('mix order|' || doc_id), 1, 15))::bigint as tie from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from d group by source),
s1 as (select *, 3 * source_size as cap, (select cast(sum(size) as bigint) from d) as everything,
              coalesce(sum(3 * source_size) over (order by 3.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as spent,
              sum(weight) over (order by 3.0::double * source_size / weight, source nulls last rows between current row and unbounded following) as open_w from s0),
s2 as (select *, cap * open_w <= (everything - spent) * weight as is_full from s1),
s3 as (select source, source_size, everything, case when is_full then cap::double else ((everything - sum(case when is_full then cap else 0 end) over ()) * weight)::double / sum(case when is_full then 0 else weight end) over () end as target from s2),
q0 as (select source, target / (2 * i + 1) as quotient from s3, range(0, (select cast(floor(max(everything) / 32.0 + 0.5) as bigint) from s3)) t(i) where target > 0),
q1 as (select source, row_number() over (order by quotient desc, source nulls last) as k from q0),
q2 as (select source, count(*) as quota from q1 where k <= (select cast(floor(max(everything) / 32.0 + 0.5) as bigint) from s3) group by source),
s4 as (select s3.*, coalesce(quota, 0) as quota, greatest(1, cast(ceil(source_size / 200000.0) as bigint)) as shards from s3 left join q2 on q2.source is not distinct from s3.source),
m as (select d.*, source_size, target, quota, (draw % 1048576) % shards as shard from d join s4 on s4.source is not distinct from d.source),
h0 as (select source, shard, max(quota) as quota, cast(sum(size) as bigint) as words from m group by source, shard),
h1 as (select source, shard, quota, row_number() over (partition by source order by words::double / (2 * i + 1) desc, shard) as k from h0, range(0, (select max(quota) from h0)) t(i) where words > 0 and i < quota),
h2 as (select source, shard, count(*) as take from h1 where k <= quota group by source, shard),
h3 as (select h0.source, h0.shard, cast(ceil(words / 32.0) as bigint) as n, least(coalesce(take, 0), 3 * cast(ceil(words / 32.0) as bigint)) as take from h0 left join h2 on h2.source is not distinct from h0.source and h2.shard = h0.shard),
r as (select m.*, n, take, cast(sum(size) over (partition by m.source, m.shard order by tie, doc_id, size rows unbounded preceding) as bigint) as stop,
             ('0x' || substr(md5('mix first|' || coalesce(m.source, '') || '|' || m.shard), 1, 15))::bigint % greatest(n, 1) as first_block,
             case when n % 1000003 <> 0 then 1000003 when n % 998244353 <> 0 then 998244353 else 2147483647 end as step
      from m join h3 on h3.source is not distinct from m.source and h3.shard = m.shard)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else (take // n) * size + coalesce((select cast(sum(least(stop, (j + 1) * 32) - greatest(stop - size, j * 32)) as bigint) from unnest(range((stop - size) // 32, (stop - 1) // 32 + 1)) t(j)
            where (j * (step % n) + first_block) % n < take % n), 0) end::bigint as taken
from r
"""
