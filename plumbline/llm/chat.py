"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation once per turn, each time with one turn more.  Rolling hashes of
turn prefixes identify these: a conversation whose whole hash is the hash of a proper prefix of
another one is anti-joined away, and of equal conversations the one with the smallest id stays.
Then the maximal ones are rendered.

Only hashes are moved until the rendering.  A conversation is cut into stretches by its turn
numbers: turns are numbered and hashed within a stretch, and what lies before a stretch is added
from one row per stretch, so that a conversation with a large part of all turns is still many
tasks' work.  It is rendered in parts of bounded length, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRETCH = 1024
# The rendering of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _hash(seed: int, *columns: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def _told(name: str) -> list[Column]:
    """A text and whether it is null: hashing passes over nulls."""
    return [F.coalesce(F.col(name), F.lit("")), F.col(name).isNull()]


def _running(column: str, order) -> Column:
    return F.bit_xor(column).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def number_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) with ``place`` (from 1) and ``n`` (turns of the
    conversation).  Null turn numbers come first; equal ones go by a hash of role and text."""
    marked = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH)).withColumn(
        "tie", _hash(1, *_told("role"), *_told("text"))
    )
    counts = marked.groupBy("conv", "stretch").agg(F.count("*").alias("held"))
    order = Window.partitionBy("conv").orderBy("stretch")
    before = counts.select(
        F.col("conv").alias("c"),
        F.col("stretch").alias("s"),
        (F.sum("held").over(order) - F.col("held")).alias("before"),
        F.sum("held").over(Window.partitionBy("conv")).alias("n"),
    )
    within = Window.partitionBy("conv", "stretch").orderBy("turn", "tie")
    numbered = marked.withColumn("rank", F.row_number().over(within))
    return numbered.join(before, F.expr("conv <=> c and stretch <=> s")).withColumn(
        "place", F.col("before") + F.col("rank")
    )


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """``conv``, ``place``, ``n`` and two hashes of the turns up to each place."""
    own = numbered.select(
        "conv", "place", "n", F.floor((F.col("place") - 1) / STRETCH).alias("piece"),
        *[_hash(seed, "place", *_told("role"), *_told("text")).alias(f"h{seed}") for seed in (2, 3)],
    )
    within = Window.partitionBy("conv", "piece").orderBy("place")
    rolled = own.select("conv", "place", "n", "piece", *[_running(h, within).alias(h) for h in ("h2", "h3")])
    whole = own.groupBy("conv", "piece").agg(F.bit_xor("h2").alias("w2"), F.bit_xor("h3").alias("w3"))
    order = Window.partitionBy("conv").orderBy("piece")
    before = whole.select(
        F.col("conv").alias("c"), F.col("piece").alias("p"),
        *[_running(f"w{k}", order).bitwiseXOR(F.col(f"w{k}")).alias(f"b{k}") for k in (2, 3)],
    )
    return rolled.join(before, F.expr("conv <=> c and piece = p")).select(
        "conv", "place", "n", *[F.col(f"h{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (2, 3)]
    )


def maximal_conversations(numbered: DataFrame) -> DataFrame:
    """``keeper``: ids of conversations that no other one prolongs or equals with a smaller id."""
    hashes = prefix_hashes(numbered)
    key = ["place", "h2", "h3"]
    prefixes = hashes.where("place < n").select(*key).distinct()
    whole = hashes.where("place = n").groupBy(*key).agg(F.min(F.struct("conv")).alias("owner"))
    return whole.join(prefixes, key, "left_anti").select(F.col("owner.conv").alias("keeper"))


def _plain(name: str) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(F.col(name), F.lit("")), F.lit("<|"), F.lit("< |"))


def format_chats(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns`` and ``rendered`` of every maximal conversation, in parts
    of ``STRETCH`` turns.

    Turns go by number.  Null roles and texts render as empty but differ from empty ones; turns
    without a conversation id are one conversation with a null id; a row that is there twice is
    two turns.  ``<|`` in a text is written ``< |``.  Other columns are ignored."""
    turns = conversations.select(
        F.col(id_column).alias("conv"),
        F.col(turn_column).cast("long").alias("turn"),
        F.col(role_column).cast("string").alias("role"),
        F.col(text_column).cast("string").alias("text"),
    )
    numbered = number_turns(turns)
    kept = numbered.join(maximal_conversations(numbered), F.expr("conv <=> keeper"), "left_semi")
    line = F.concat(F.lit(OPEN), _plain("role"), F.lit(MIDDLE), _plain("text"), F.lit(CLOSE))
    parts = kept.select("conv", "place", F.floor((F.col("place") - 1) / STRETCH).alias("part"), line.alias("line"))
    joined = parts.groupBy("conv", "part").agg(
        F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines")
    )
    return joined.select(
        F.col("conv").alias("conv_id"),
        F.col("part").cast("long").alias("part"),
        "n_turns",
        F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"),
    )


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = f"""
WITH placed AS (
  SELECT conv_id, role, text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
prefixes AS (
  SELECT conv_id, place, n, string_agg(md5(concat(role, '|', text)), '') OVER
    (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS prefix FROM placed),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE place = n GROUP BY prefix),
kept AS (
  SELECT conv_id FROM whole WHERE NOT EXISTS
    (SELECT 1 FROM prefixes p WHERE p.place < p.n AND p.prefix = whole.prefix))
SELECT conv_id, (place - 1) // {STRETCH} AS part, count(*) AS n_turns,
  string_agg('{OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
    || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part
"""
