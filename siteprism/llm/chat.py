"""Chat formatting: logged snapshots of growing conversations collapse to the longest before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteprism.llm.common import materialise, table


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, h1, h2, is_last: turns numbered from 1, with hashes of all turns so far.

    The rolling hash is the xor of the turns' own hashes, each of which holds the turn's number, so equal
    hashes at equal numbers are equal prefixes (128 bits). Rows equal in all four columns are one turn; turns
    with one number stand in the order of role and text; rows without a conv_id belong to no conversation.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    own = F.struct("turn", "role", "text")
    rows = rows.withColumn("again", F.coalesce(F.lag(own).over(order) == own, F.lit(False))).where("not again").drop("again")
    rows = rows.withColumn("pos", F.row_number().over(order))
    parts = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.max("pos").over(W.partitionBy("conv_id")) == F.col("pos")
    return rows.select("conv_id", "pos", "role", "text", F.bit_xor(F.xxhash64(*parts)).over(so_far).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(so_far).alias("h2"), last.alias("is_last"))


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the template; text that looks like a marker is broken up, so that it can't pose as one."""
    safe = [F.replace(F.coalesce(c, F.lit(missing)), F.lit("<|"), F.lit("< |")) for c, missing in ((role, "unknown"), (text, ""))]
    return F.concat(F.lit("<|"), safe[0], F.lit("|>\n"), safe[1], F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text: every maximal conversation, rendered.

    A conversation whose turns are the first turns of a longer one goes (anti-join of whole hashes against the
    distinct proper prefixes); of equal ones the least conv_id stays and ``copies`` counts them. Hot prefixes and
    copies are combined before they are shuffled. Empty input gives an empty result.
    """
    turns = materialise(turn_prefixes(conversations), "turns")
    prefixes = turns.where("not is_last").select("pos", "h1", "h2").distinct()
    whole = turns.where("is_last").groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    kept = whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "copies")
    said = turns.join(kept, "conv_id").groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", render_turn(F.col("role"), F.col("text")).alias("line")))).alias("lines"))
    return said.select("conv_id", "n_turns", "copies", F.array_join("lines.line", "").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT conv_id, pos, md5(string_agg(coalesce(md5('r' || role), '-') || coalesce(md5('t' || text), '-'), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
max(pos) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY h, n),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = w.h AND p.pos < p.n))
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.copies AS BIGINT) AS copies,
string_agg('<|' || replace(coalesce(role, 'unknown'), '<|', '< |') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM k JOIN t ON t.conv_id = k.conv_id GROUP BY k.conv_id, k.n, k.copies
"""
