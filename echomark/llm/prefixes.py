"""The prefix trie of conversations: digests of blocks of turns first, turn by turn only where blocks of one beginning differ.

A node is a distinct sequence of first turns. Its least conversation owns it; as members only leave on the way down, the nodes that a conversation owns
are the last turns of its own path, from the first depth at which it is the least. So every sum over a node's subtree is a sum over its members of what each
owns below, which two aggregations by digest give without walking the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cut, join_counted

#: Turns of a block.
BLOCK_TURNS = 4
#: Conversations of neighbouring ids whose ids are joined in one string before a node's digest reads them: 2^9.
CHUNK_BITS = 9


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, depth, a, b, size): turns numbered from 1 in order of turn (null first; then role, then text), with two hashes and the code points of the text, and depth 0 for every conversation.

    The hashes are two of one SHA-256 of role and text; null role and text are empty. Rows without a conversation are left out, as they belong to none.
    """
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    # texts stay behind: only one of the two orders' ties needs them, and they are not shuffled further
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.withColumn("depth", F.row_number().over(order)).select("conv", "depth", own.alias("own"), F.length("text").cast("long").alias("size"))
    turns = turns.select("conv", "depth", F.xxhash64(F.lit(1), "own").alias("a"), F.xxhash64(F.lit(2), "own").alias("b"), "size")
    return turns.unionByName(turns.where("depth = 1").select("conv", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("size")))


def with_heads(turns: DataFrame, head: Column, length: Column) -> DataFrame:
    """numbered() rows in which each conversation's first turns (`length` of them) are those of the conversation `head`, all it has if fewer, none if it is absent.

    head and length are expressions over conv. A conversation is sent to those that begin with it, so these should be bounded in number for each head.
    """
    own = turns.where((F.col("depth") == 0) | (F.col("depth") > length))
    wanted = turns.where("depth = 0").select("conv", head.alias("head"), length.alias("length"))
    heads = turns.where("depth > 0").select(F.col("conv").alias("head"), "depth", "a", "b", "size")
    lent = wanted.join(heads, "head").where(F.col("depth") <= F.col("length")).select("conv", "depth", "a", "b", "size")
    order = Window.partitionBy("conv").orderBy("depth")  # a head's turns end at `length`, and own ones begin after it
    both = lent.unionByName(own)
    return both.withColumn("depth", (F.row_number().over(order) - 1).cast("int"))


def running(column: str, keys: list[str], order: str) -> Column:
    return F.bit_xor(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def blocks_of(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv, k, lo, hi, size, length, a, b, prev_a, prev_b): each block of a conversation with the digest of all its turns up to the block's end, that of the blocks before, and the conversation's length."""
    k = F.expr(f"(depth + {block_turns - 1}) div {block_turns}").alias("k")
    placed = turns.select("conv", "depth", k, F.xxhash64("depth", "a").alias("a"), F.xxhash64("depth", "b").alias("b"), "size")
    blocks = placed.groupBy("conv", "k").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.sum("size").alias("size"))
    blocks = blocks.withColumns({"a": running("xa", ["conv"], "k"), "b": running("xb", ["conv"], "k"), "length": F.max("hi").over(Window.partitionBy("conv"))})
    before = Window.partitionBy("conv").orderBy("k")
    return blocks.withColumns({"prev_a": F.lag("a").over(before), "prev_b": F.lag("b").over(before)}).drop("xa", "xb")


def least_and_number() -> list[Column]:
    return [F.min("conv").alias("least"), F.count("*").alias("n"), F.sum((F.col("length") > F.col("hi")).cast("long")).alias("n_longer")]


UNIT = ("conv", "lo", "hi", "a", "b", "size", "length", "least", "n", "n_longer")


def shared_units(turns: DataFrame, cut: Cut, block_turns: int) -> DataFrame:
    """The conversations' rows in every unit that two or more share: a whole block where all that begin alike go on alike, else a single turn.

    A unit is known by (hi, a, b). Blocks are grouped by digest; only the blocks of a beginning that goes on in several ways are taken
    apart, so what is hashed and grouped turn by turn is where siblings diverge.
    """
    blocks = cut.table(blocks_of(turns, block_turns))
    groups = cut.table(blocks.groupBy("k", "prev_a", "prev_b", "hi", "a", "b").agg(*least_and_number()))
    split = cut.table(groups.groupBy("k", "prev_a", "prev_b").count().where("count > 1 and k > 0").select(F.col("prev_a").alias("from_a"), F.col("prev_b").alias("from_b"), F.col("k").alias("from_k")))
    shared = cut.table(groups.where("n > 1").select("hi", "a", "b", "least", "n", "n_longer"))

    beginnings = split.select(F.struct("from_k", "from_a", "from_b").alias("start"))
    marked = blocks.withColumn("start", F.struct(F.col("k").alias("from_k"), F.col("prev_a").alias("from_a"), F.col("prev_b").alias("from_b")))
    few = cut.table(join_counted(marked, beginnings, "start").drop("start"))
    apart = few.select("conv", "k", "prev_a", "prev_b", "length")
    k = F.expr(f"(depth + {block_turns - 1}) div {block_turns}").alias("k")
    steps = turns.select("conv", k, F.col("depth").alias("hi"), F.xxhash64("depth", "a").alias("xa"), F.xxhash64("depth", "b").alias("xb"), "size").join(apart, ["conv", "k"])
    steps = steps.withColumns({"a": running("xa", ["conv", "k"], "hi").bitwiseXOR(F.col("prev_a")), "b": running("xb", ["conv", "k"], "hi").bitwiseXOR(F.col("prev_b"))})
    steps = cut.table(steps.select("conv", F.col("hi").alias("lo"), "hi", "a", "b", "size", "length"))
    nodes = cut.table(steps.groupBy("hi", "a", "b").agg(*least_and_number()).where("n > 1"))

    whole = blocks.join(few.select("conv", "k"), ["conv", "k"], "left_anti")
    keyed = lambda rows: rows.withColumn("unit", F.struct("hi", "a", "b"))
    units = [join_counted(keyed(rows), keyed(found).select("unit", "least", "n", "n_longer"), "unit").select(*UNIT) for rows, found in ((whole, shared), (steps, nodes))]
    return cut.table(units[0].unionByName(units[1]))


def trie(spark: SparkSession, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of numbered() conversations, and where each conversation ends.

    Nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), a node being known by its depth and its least member conv_id;
    saved_tokens is what a cache of the subtree's turns saves: each node's further members times the code points of its last text.
    Ends: (conv_id, depth, member): the node at which the conversation `member` ends; one without turns ends at the root.

    Nothing is gathered by node or conversation: shared units are aggregated by digest before they are shuffled, and a conversation's own turns stream
    through windows in order of depth, so a common first turn, a common conversation and a conversation of any length are only more rows.
    An empty table has no node. Conversations equal in all turns end at one node; rows that repeat a turn are turns each.
    """
    cut = Cut(spark)
    turns = cut.table(turns)
    units = shared_units(turns, cut, block_turns)

    foreign = F.when(F.col("least") < F.col("conv"), F.struct("hi", "least"))
    last = F.max(F.struct("hi", "n_longer"))
    found = units.groupBy("conv").agg(F.max(foreign).alias("above"), last.alias("last"))
    lengths = turns.groupBy("conv").agg(F.max("depth").alias("length"))
    # above: depth up to which another conversation owns the path (-1: none), and the owner there; shared: depth up to which the path is shared
    facts = lengths.join(found, "conv", "left").select(
        "conv", "length", F.coalesce("above.hi", F.lit(-1)).alias("above"), F.coalesce("above.least", "conv").alias("owner_above"), F.coalesce("last.hi", F.lit(-1)).alias("shared"), F.col("last.n_longer").alias("n_longer")
    )
    childless = (F.col("length") > F.col("shared")) | (F.col("n_longer") == 0)
    facts = cut.table(facts.withColumn("leaf", (childless & (F.col("length") > F.col("above"))).cast("long")).drop("n_longer"))

    down = Window.partitionBy("conv").orderBy(F.col("hi").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.when(F.col("least") == F.col("conv"), (F.col("n") - 1) * F.col("size")).otherwise(0)
    rows = units.join(facts.select("conv", "above", "leaf"), "conv").withColumn("saved", F.sum(mine).over(down))
    begins = ((F.col("length") > F.col("hi")) & (F.col("above") <= F.col("hi"))).cast("long")
    stats = rows.groupBy("hi", "a", "b").agg(
        F.first("least").alias("conv"), F.first("n").alias("n"), F.first("size").alias("size"), F.sum(begins).alias("children"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")
    )

    # a conversation's turns from the last to the first; a unit stands before its last turn and holds until the next unit
    path = turns.select("conv", "depth", "size", F.lit(None).cast("struct<n: bigint, size: bigint, children: bigint, leaves: bigint, saved: bigint, hi: int>").alias("unit"))
    heads = stats.select("conv", F.col("hi").alias("depth"), F.lit(0).cast("long").alias("size"), F.struct("n", "size", "children", "leaves", "saved", "hi").alias("unit"))
    up = Window.partitionBy("conv").orderBy(F.col("depth").desc(), F.col("unit").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = path.unionByName(heads).withColumn("below", F.sum("size").over(up))
    walked = walked.withColumn("at", F.last(F.when(F.col("unit").isNotNull(), F.struct("unit", F.col("below").alias("after"))), ignorenulls=True).over(up))
    nodes = walked.where("unit is null").join(facts.select("conv", "length", "above", "owner_above", "shared"), "conv").where("depth > above")
    shared, unit = F.col("depth") <= F.col("shared"), F.col("at.unit")
    within = F.col("below") - F.col("at.after")  # code points from this turn to the unit's last
    nodes = nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > 0, F.when(F.col("depth") - 1 > F.col("above"), F.col("conv")).otherwise(F.col("owner_above"))).alias("parent_conv_id"),
        F.when(shared, unit["n"]).otherwise(1).alias("n_convs"),
        F.when(shared & (F.col("depth") == unit["hi"]), unit["children"]).otherwise((F.col("depth") < F.col("length")).cast("long")).alias("n_children"),
        F.when(shared, unit["leaves"]).otherwise(1).alias("n_leaves"),
        F.when(shared, unit["saved"] + (unit["n"] - 1) * (within - unit["size"])).otherwise(0).alias("saved_tokens"),
    )
    ends = facts.select(F.when(F.col("length") > F.col("above"), F.col("conv")).otherwise(F.col("owner_above")).alias("conv_id"), F.col("length").cast("long").alias("depth"), F.col("conv").alias("member"))
    return nodes, ends


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the ids of the conversations that end at a node, in order, joined with commas.

    Ids of a range of 2^CHUNK_BITS are joined first; then a node's strings pass through one running digest in order, so nothing of a node is held, however many end there.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy("conv_id", "depth", F.shiftright("member", CHUNK_BITS).alias("chunk")).agg(joined.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running_ = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": running_.hexdigest()}])
        for batch in batches:
            done = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node == (conv, depth):
                    running_.update(b"," + ids.encode())
                    continue
                if node:
                    done.append({"conv_id": node[0], "depth": node[1], "ends_sha256": running_.hexdigest()})
                node, running_ = (conv, depth), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if node:
            yield row()

    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def digest(spark: SparkSession, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """trie() with the digest of the conversations that end at each node."""
    nodes, ends = trie(spark, turns, block_turns)
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(ends_digests(ends), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))


#: crc32 bit by bit: a byte enters, then eight shifts with the polynomial.
CRC = """list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split(c::varchar, '')])),
    lambda s, x: case when x >= 0 then xor(s, x) when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end)"""

TRIE_SQL = f"""
with t as (
    select conv_id as c, coalesce(role, '') as role, coalesce("text", '') as txt,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as pos
    from conversations where conv_id is not null),
convs as (select c, xor({CRC}, 4294967295) % 6 as h from (select distinct c from t)),
rebuilt as (
    select convs.c, pos, role, txt from convs join t on t.c = convs.c - convs.c % 100 and pos <= h
    union all select t.c, pos, role, txt from t join convs on convs.c = t.c where pos > h),
steps as (select c, row_number() over (partition by c order by pos) as d, md5(role) || md5(txt) as own, length(txt) as len from rebuilt),
paths as (
    select c, d, md5(string_agg(own, '' order by d) over (partition by c order by d)) as k, len from steps
    union all select c, 0, '', 0 from convs),
ends as (select c, max(d) as d from paths group by c),
nodes as (
    select p.d, p.k, min(p.c) as c, count(*) as n, any_value(p.len) as len, count(*) = count(e.c) as childless,
        sha256(coalesce(string_agg(e.c::varchar, ',' order by e.c), '')) as digest
    from paths p left join ends e on e.c = p.c and e.d = p.d group by p.d, p.k),
sums as (
    select p.d, p.k, sum((w.n - 1) * w.len)::bigint as saved, sum(w.childless::int)::bigint as leaves
    from nodes w join paths p on p.c = w.c and p.d <= w.d group by p.d, p.k),
parents as (select w.d, w.k, p.k as pk from nodes w join paths p on p.c = w.c and p.d = w.d - 1),
children as (select d - 1 as d, pk as k, count(*) as n from parents group by 1, 2)
select w.c as conv_id, w.d as depth, u.c as parent_conv_id, w.n as n_convs, coalesce(ch.n, 0) as n_children, s.leaves as n_leaves, s.saved as saved_tokens, w.digest as ends_sha256
from nodes w join sums s using (d, k) left join children ch using (d, k)
left join parents p on p.d = w.d and p.k = w.k left join nodes u on u.d = w.d - 1 and u.k = p.pk
"""
