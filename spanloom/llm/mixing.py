"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined, stored, text_key

#: Weights of the sources in code-point order, repeating; share of all words that the mix has; most times a word is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Words in a block, words in a shard at about which a source is split, and shards in a pool, so that few rows meet in one window.
BLOCK, SHARD, POOL = 256, 1 << 19, 4096

#: What Spark and other engines spell differently.
SPARK = {"range": "explode(sequence({0}, {1}))", "hash": "cast(conv(substr(md5({0}), {1}, 8), 16, 10) as bigint)", "div": "({0} div {1})", "pick": "element_at(array({0}), {1})", "same": "{0} <=> {1}"}

#: Of a list of items with votes, `seats` to give in each group: the highest quotients votes / (2k + 1) win a seat each.
#: With N seats and n items, the divisor that fills them is within n / 2N of the plain one, so only about four quotients
#: an item are open; those below are sure to win, those above to lose.
APPORTION = """
with fair as (
  select *, case when total > 0 then votes * seats / total else 0 end as fair, case when seats > 0 then items / (2.0D * seats) else 0 end as slack
  from (select *, sum(votes) over (partition by grp) as total, count(*) over (partition by grp) as items from {items})
), sure as (
  select *, seats - sum(sure) over (partition by grp) as open
  from (select *, cast(greatest(0, floor(fair * (1 - slack)) - 1) as bigint) as sure, cast(ceil(fair * (1 + slack)) + 1 as bigint) as most from fair)
), won as (
  select grp, item, count(*) as won
  from (select *, row_number() over (partition by grp order by votes / (2 * k + 1) desc, item, k) as place from (select grp, item, votes, open, @range(sure, most)@ as k from sure))
  where place <= open group by grp, item
)
select sure.grp, sure.item, cast(sure.sure + coalesce(won.won, 0) as bigint) as quota from sure left join won on sure.grp = won.grp and sure.item = won.item
"""

#: Steps after `sized` (source, size, h1, h2, id): a name and the SQL over those before it.
STEPS = [
    # Sources by code point, null last, with their targets: in order of most words to weight those that stop at `most` come
    # first; the level of the rest is the one at the first source that it doesn't fill.
    ("sources", """
with sums as (
  select source, count(*) as docs, cast(sum(size) as bigint) as source_size from {sized} group by source
), ranked as (
  select *, @pick(@weights@, cast((sid - 1) % @n_weights@ + 1 as int))@ as weight, @most@.0D * source_size as most
  from (select *, row_number() over (order by case when source is null then 1 else 0 end, source) as sid from sums)
), filled as (
  select *, row_number() over (order by most / weight, sid) as turn,
    (@share@D * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, sid rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by most / weight, sid rows between current row and unbounded following) as lvl
  from ranked
), first_open as (select min(turn) as turn from filled where lvl * weight <= most)
select f.source, f.sid, f.source_size, least(f.most, coalesce(l.lvl * f.weight, f.most)) as target,
  cast(floor(@share@D * sum(f.source_size) over () / @block@ + 0.5D) as bigint) as all_seats
from filled f left join first_open o on true left join filled l on l.turn = o.turn
"""),
    ("source_items", "select 0 as grp, sid as item, target as votes, all_seats as seats from {sources}"),
    ("source_quota", APPORTION.replace("{items}", "{source_items}")),
    # Documents in shards of their source, one after another in hashed order.
    ("laid", """
with dealt as (
  select d.id, d.size, d.h2, d.rid, s.sid, s.source_size, s.target, d.h1 % greatest(1, cast(ceil(s.source_size / @shard@.0D) as bigint)) as shard
  from {sized} d join {sources} s on @same(d.source, s.source)@
)
select *, sum(size) over (partition by sid, shard order by h2, id, size, rid rows between unbounded preceding and current row) - size as pos from dealt
"""),
    ("shards", "select sid, @div(shard, @pool@)@ as pool, shard, cast(sum(size) as bigint) as shard_size from {laid} group by sid, shard"),
    # A source's blocks go to pools of its shards, and a pool's to the shards in it.
    ("pool_items", "select s.sid as grp, s.pool as item, cast(sum(s.shard_size) as double) as votes, max(q.quota) as seats from {shards} s join {source_quota} q on s.sid = q.item group by s.sid, s.pool"),
    ("pool_quota", APPORTION.replace("{items}", "{pool_items}")),
    ("shard_items", "select concat(cast(s.sid as string), '/', cast(s.pool as string)) as grp, s.shard as item, cast(s.shard_size as double) as votes, q.quota as seats from {shards} s join {pool_quota} q on s.sid = q.grp and s.pool = q.item"),
    ("shard_quota", APPORTION.replace("{items}", "{shard_items}")),
    # Whole passes over a shard's blocks, then those that the seed ranks first.
    ("blocks", """
with cut as (
  select s.sid, s.shard, s.shard_size, cast(ceil(s.shard_size / @block@.0D) as bigint) as blocks, q.quota
  from {shards} s join {shard_quota} q on q.grp = concat(cast(s.sid as string), '/', cast(s.pool as string)) and s.shard = q.item where s.shard_size > 0
), block as (
  select *, least(@block@, shard_size - j * @block@) as len, least(quota, @most@ * blocks) as passes from (select *, @range(cast(0 as bigint), blocks - 1)@ as j from cut)
), ranked as (
  select *, row_number() over (partition by sid, shard order by @hash(concat('@seed@|', cast(sid as string), '|', cast(shard as string), '|', cast(j as string)), 1)@, j) as place from block
), chosen as (select *, @div(passes, blocks)@ + case when place <= passes % blocks then 1 else 0 end as times from ranked)
select sid, shard, j, times, sum(times * len) over (partition by sid, shard order by j rows between unbounded preceding and current row) - times * len as earlier from chosen
"""),
    ("mixed", """
select d.id, d.rid, d.size, d.source_size, d.target,
  cast(case when d.size = 0 then 0 else z.earlier + z.times * (d.pos + d.size - z.j * @block@) - a.earlier - a.times * (d.pos - a.j * @block@) end as bigint) as taken
from {laid} d
left join {blocks} a on d.sid = a.sid and d.shard = a.shard and @div(d.pos, @block@)@ = a.j and d.size > 0
left join {blocks} z on d.sid = z.sid and d.shard = z.shard and @div((d.pos + d.size - 1), @block@)@ = z.j and d.size > 0
"""),
]


def step_sql(sql: str, dialect: dict[str, str], seed: str) -> str:
    """Fill in the parameters (@name@) and the dialect's forms (@name(arguments)@) of a step."""
    for name, value in {"weights": ", ".join(map(str, WEIGHTS)), "n_weights": len(WEIGHTS), "share": SHARE, "most": MOST, "block": BLOCK, "shard": SHARD, "pool": POOL, "seed": seed}.items():
        sql = sql.replace(f"@{name}@", str(value))
    for name, form in dialect.items():
        while (at := sql.find(f"@{name}(")) >= 0:
            end = sql.index(")@", at)
            first, _, second = sql[at + len(name) + 2 : end].rpartition(", ")
            sql = sql[:at] + form.format(first, second) + sql[end + 2 :]
    return sql


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Rows: one per input row with id, rid (text_key of id and text), size (words), source_size and target of its source,
    taken (words that the mix takes, repeats counted; never above MOST times size). A null or wordless text has size and
    taken 0. A null source is a source, the last. Repeated rows are laid out one after another, each on its own. An empty
    table gives none; other columns are not looked at. Reruns agree: order comes from hashes of seed, ids and texts.

    A source's documents are dealt to shards of about SHARD words by a hash of their ids and texts; each shard is laid out in hashed order and
    cut into blocks of BLOCK words. Sainte-Lague gives the mix's blocks to the sources, a source's to pools of POOL shards, and a pool's
    to its shards, by highest quotient. A source with a third of all rows is many shards, and no window over documents
    holds more than one shard, none over shards more than a pool; a pool has about 2**31 words, so even at a hundred
    terabytes pools are some ten thousand short rows.
    """
    return _frames(docs, seed, id_col, text_col, source_col)["mixed"]


def _frames(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> dict[str, DataFrame]:
    """The tables of all steps by name, and `placed`: mixed with the shard of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.md5(text))
    part = lambda at: F.conv(F.substring(F.md5(digest), at, 8), 16, 10).cast("bigint")
    frames = {"sized": stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), part(1).alias("h1"), part(9).alias("h2"), text_key(id_col, text_col).alias("rid")), "sized")}
    for name, sql in [*STEPS, ("placed", STEPS[-1][1].replace("select d.id,", "select d.sid, d.shard, d.id,", 1))]:
        sql = step_sql(sql, SPARK, seed)
        used = {k: v for k, v in frames.items() if "{%s}" % k in sql}
        frames[name] = docs.sparkSession.sql(sql, **used)
        if name in ("source_quota", "laid", "shards", "pool_quota", "blocks"):
            frames[name] = stored(frames[name], name)
    return frames


def mixed_documents(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as whole documents: each row of docs as often as its taken words fill its size, or once more or less, so that sums are kept.

    A shard's documents are put in order of size and their times added up from a seeded start; each comes as often as
    the sum passes a whole number. So a document comes floor or ceil of its times, at its times on the average, and a shard's
    words are off by about its longest document at most. Null and wordless texts go. Rows that repeat id and text share their
    copies evenly and are rounded together.
    """
    placed = _frames(docs, seed, id_col, text_col, source_col)["placed"].filter("size > 0")
    once = placed.groupBy("id", "rid").agg(F.min(F.struct("sid", "shard")).alias("at"), F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|start"), "at.sid", "at.shard")), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    times = F.col("taken") / F.col("size")
    upto = Window.partitionBy("at").orderBy("size", "id", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = lambda c: F.floor(F.round(c, 6))
    copies = once.withColumn("times", times).withColumn("sum", F.sum("times").over(upto) + start)
    before = F.coalesce(F.lag("sum").over(Window.partitionBy("at").orderBy("size", "id", "rid")), start)
    copies = copies.withColumn("copies", (whole(F.col("sum")) - whole(before)).cast("int")).filter("copies > 0").select("id", "rid", "copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), text_key(id_col, text_col).alias("key"))
    copies = stored(copies, "copies")
    found = joined(rows, copies, rows.own.eqNullSafe(copies.id) & (rows.key == copies.rid), "inner", 48)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
