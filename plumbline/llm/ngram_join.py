"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its word n-grams.  If two sets are similar enough, they share a token
among the first few of each under *any* order of all tokens.  Three orders are used.  All put
tokens that are frequent in the corpus last, by one table; the others go by three different
hashes.  A pair, but for those with a pivot, is verified only if it shares prefix tokens under all
three.  So the first order goes first, and a document that shares no prefix token under it with one
of nearly its size has no prefixes under the others.

Equal sets are one class from the start.  For the components alone, groups of thousands of near
copies need not make all pairs of their members: first every member of a large bucket is compared
with one pivot, the member in which the bucket's token comes first, and pairs that this connects
already are not made again.  Pairs with a pivot are taken from the first order alone.

All links lie inside components.  They are listed and counted there: a component is dealt into
blocks of bounded size, and every two blocks meet in one group, whose sets are compared all at
once.  Counting makes no row per pair.

Nothing is approximate but for 64-bit hashes of tokens.  The table of frequent tokens is of
bounded size and only steers the order; any table gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm.components import components
from plumbline.llm.words import blocks, find_words, mix, shingles
from plumbline.storage import settle

ORDERS = 3
# Most tokens in the table of frequent ones: 16 bytes each in every task.
FREQUENT_TOKENS = 1 << 18
# Tokens counted in one go by a task, which then forgets those it saw once.
_COUNTED_AT_ONCE = 1 << 22
# Buckets beyond this size are compared with their pivot first.
_LARGE_BUCKET = 12
# Documents and tokens in a block of a component, about.
_BLOCK, _BLOCK_TOKENS = 256, 1 << 19
# Columns of the matrices whose product counts shared tokens.
_COLUMNS = 1 << 12
# Bits of the filter that says which documents' sets are needed: 2 MB in every task.
_FILTER_BITS = 1 << 24
_BITMAP_BITS = 32768


@dataclass(frozen=True)
class JaccardJoin:
    """``members``: id, n_shingles, component."""

    members: DataFrame
    blocks: Callable[[], DataFrame]
    percent: int

    @property
    def links(self) -> DataFrame:
        """All links ``a``, ``b`` between representatives (smallest ids) of equal sets, a < b."""
        return self.blocks().mapInArrow(_links(self.percent, False), "a long, b long")

    @property
    def counts(self) -> DataFrame:
        """``component`` and ``n_links``, the number of its links; only of those that have some."""
        counted = self.blocks().mapInArrow(_links(self.percent, True), "component long, n long")
        return counted.groupBy("component").agg(F.sum("n").alias("n_links"))


def _prefix_size(size: int, percent: int) -> int:
    """Tokens of which two sets at ``percent`` or more must share one: all but the overlap
    they have at least, and one more."""
    return size - -(-percent * size // 100) + 1


def _enough(n: str, at: str, other_n: str, other_at: str, percent: int) -> str:
    """Whether two sets can share enough if their first common token stands at these places: all
    they share is at or after it.  It bounds the sizes' ratio, too."""
    return (
        f"{100 + percent} * least({n} - {at}, {other_n} - {other_at}) >= {percent} * ({n} + {other_n})"
    )


def _sets(block, n: int) -> Iterator[np.ndarray]:
    hashes, offsets = shingles(find_words(block), n)
    for start, stop in zip(offsets[:-1], offsets[1:]):
        yield np.unique(hashes[start:stop])


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    spread = mix(tokens, 11)
    return int(spread.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(spread, 12)))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _describe(n: int) -> Callable:
    """Per document: id, set size and digest; per task: tokens seen in several texts."""

    def run(batches):
        waiting: list[np.ndarray] = []
        held, seen = 0, set()
        known = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def count():
            nonlocal held, known
            tokens, counts = np.unique(
                np.concatenate([known[0], *waiting]), return_inverse=True
            )
            weights = np.concatenate([known[1], np.ones(held, np.int64)])
            totals = np.bincount(counts, weights, len(tokens)).astype(np.int64)
            # Lossy counting: what is still rare is forgotten, and the table stays bounded.
            floor = 2
            while (often := totals >= floor).sum() > FREQUENT_TOKENS:
                floor *= 2
            known = tokens[often], totals[often]
            waiting.clear()
            seen.clear()
            held = 0

        for block in blocks(batches, "text"):
            ids, sizes, firsts, seconds = block.batch.column(0), [], [], []
            for tokens in _sets(block, n):
                first, second = _digest(tokens)
                sizes.append(len(tokens))
                firsts.append(first)
                seconds.append(second)
                if (first, second) not in seen and len(tokens):
                    seen.add((first, second))
                    waiting.append(tokens)
                    held += len(tokens)
            if held > _COUNTED_AT_ONCE:
                count()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(len(sizes), np.int32)),
                    ids,
                    pa.array(np.array(sizes, np.int64)),
                    pa.array(_signed(firsts)),
                    pa.array(_signed(seconds)),
                ],
                ["kind", "id", "n", "d1", "d2"],
            )
        if held:
            count()
        tokens, totals = known
        if len(tokens):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ones(len(tokens), np.int32)),
                    pa.array(tokens.view(np.int64)),
                    pa.array(totals),
                    pa.array(np.zeros(len(tokens), np.int64)),
                    pa.array(np.zeros(len(tokens), np.int64)),
                ],
                ["kind", "id", "n", "d1", "d2"],
            )

    return run


def _let_through(batches, bits: np.ndarray, wanted: bool = True):
    """The rows whose ids the filter lets through, or all others."""
    for batch in batches:
        place = _place_of(batch.column(0).to_numpy(zero_copy_only=False))
        chosen = ((bits[place >> 3] >> (place & 7)) & 1).astype(bool)
        yield batch.filter(pa.array(chosen if wanted else ~chosen))


def _prefixes(n: int, percent: int, frequent, orders: range, filters: list[tuple]) -> Callable:
    """Per document that each filter lets through, or does not, as wanted: id, size, digest and its
    first tokens under the orders."""

    def run(batches):
        table, ranks = frequent.value
        top = np.uint64(1 << 63)
        for bits, wanted in filters:
            batches = _let_through(batches, bits.value, wanted)
        for block in blocks(batches, "text"):
            hashes, offsets = shingles(find_words(block), n)
            rows = []
            for i, (start, stop) in enumerate(zip(offsets[:-1], offsets[1:])):
                tokens = np.unique(hashes[start:stop])
                if not len(tokens):
                    continue
                size = _prefix_size(len(tokens), percent)
                place = np.searchsorted(table, tokens)
                place[place == len(table)] = 0
                often = np.flatnonzero(table[place] == tokens) if len(table) else []
                firsts = []
                for order in orders:
                    keys = mix(tokens, 20 + order) >> np.uint64(1)
                    if len(often):
                        keys[often] = top + ranks[place[often]]
                    chosen = np.argpartition(keys, size - 1)[:size]
                    chosen = chosen[np.argsort(keys[chosen])]
                    firsts.append(tokens[chosen].view(np.int64))
                rows.append((i, len(tokens), *_digest(tokens), firsts))
            if not rows:
                continue
            ends = np.concatenate([[0], np.cumsum([len(row[4][0]) for row in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(0).take(pa.array([row[0] for row in rows])),
                    pa.array([row[1] for row in rows], pa.int64()),
                    pa.array(_signed([row[2] for row in rows])),
                    pa.array(_signed([row[3] for row in rows])),
                    *[
                        pa.ListArray.from_arrays(ends, np.concatenate([row[4][k] for row in rows]))
                        for k in range(len(orders))
                    ],
                ],
                ["id", "n", "d1", "d2", *[f"p{k}" for k in orders]],
            )

    return run


def _wanted_sets(n: int, bits) -> Callable:
    """Id and token set of the documents that the filter lets through."""

    def run(batches):
        for block in blocks(_let_through(batches, bits.value), "text"):
            sets = [tokens.tobytes() for tokens in _sets(block, n)]
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0), pa.array(sets, pa.binary())], ["id", "tokens"]
            )

    return run


def _verify(percent: int) -> Callable:
    """Keeps pairs whose sets are as similar as asked."""

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                left = np.frombuffer(left.as_buffer(), np.uint64)
                right = np.frombuffer(right.as_buffer(), np.uint64)
                both = np.concatenate([left, right])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _place_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64), 31) % np.uint64(_FILTER_BITS)).astype(np.int64)


def _filter_of(spark: SparkSession, ids: DataFrame):
    """A bitmap of fixed size that lets all ids in the columns through, and some others."""

    def places(batches):
        for batch in batches:
            for column in batch.columns:
                found = np.unique(_place_of(column.to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(found)], ["place"])

    numbered = ids.mapInArrow(places, "place long")
    rows = (
        numbered.groupBy(F.floor(F.col("place") / _BITMAP_BITS).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("place") % _BITMAP_BITS).alias("bits"))
        .collect()
    )
    bits = np.zeros(_FILTER_BITS // 8, np.uint8)
    for row in rows:
        start = int(row["part"]) * _BITMAP_BITS // 8
        bits[start : start + _BITMAP_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bits)


def _verified(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough; only their documents' sets are moved."""
    spark = texts.sparkSession
    pairs = settle(pairs.select("a", "b"), "pairs")
    # Null ids would turn a batch of ids into floating-point numbers.
    known = texts.where("id is not null")
    sets = known.mapInArrow(_wanted_sets(n, _filter_of(spark, pairs)), "id long, tokens binary")
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return settle(joined.mapInArrow(_verify(percent), "a long, b long").distinct(), "links")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of tokens that each of ``left`` shares with each of ``right``."""
    rows = np.repeat(np.arange(len(left) + len(right)), [len(tokens) for tokens in left + right])
    _, column, counts = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    # Tokens of one set alone are shared by none.
    often = counts > 1
    kept = often[column]
    rows, column = rows[kept], (np.cumsum(often) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    found = np.zeros((len(left), len(right)))
    for first in range(0, int(often.sum()), _COLUMNS):
        start, stop = np.searchsorted(column, [first, first + _COLUMNS])
        held = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        held[rows[start:stop], column[start:stop] - first] = 1
        found += held[: len(left)] @ held[len(left) :].T
    return found.astype(np.int64)


def _links(percent: int, count: bool) -> Callable:
    """The links between two blocks of a component, or their number.  Rows come sorted by
    component and blocks; two blocks are held at a time."""

    def compare(rows: list[tuple]) -> np.ndarray:
        _, x, y, *_ = rows[0]
        sides = [[row for row in rows if row[3] == block] for block in (x, y)]
        if not all(sides):
            return np.empty((0, 2), np.int64)
        ids = [np.array([row[4] for row in side], np.int64) for side in sides]
        sets = [[np.frombuffer(row[5], np.uint64) for row in side] for side in sides]
        sizes = [np.array([len(tokens) for tokens in side], np.int64) for side in sets]
        shared = _shared(*sets)
        alike = 100 * shared >= percent * (sizes[0][:, None] + sizes[1] - shared)
        # A block with itself has every pair twice.
        alike &= ids[0][:, None] < ids[1] if x == y else ids[0][:, None] != ids[1]
        a, b = np.nonzero(alike)
        a, b = ids[0][a], ids[1][b]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def result(rows: list[tuple]) -> pa.RecordBatch:
        pairs = compare(rows)
        if count:
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], pa.int64()), pa.array([len(pairs)], pa.int64())], ["component", "n"]
            )
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and rows[-1][:3] != row[:3]:
                    yield result(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield result(rows)

    return run


def _block_pairs(texts: DataFrame, sizes: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Sets of all documents in components, once for each pair of blocks (x, y) theirs is in."""
    spark = texts.sparkSession
    tokens = sizes.where("n > 0").distinct().groupBy("id").agg(F.sum("n").alias("n"))
    parts = (
        found.join(tokens, "id")
        .groupBy("component")
        .agg(F.expr(f"cast(greatest(ceil(count(*) / {_BLOCK}), ceil(sum(n) / {_BLOCK_TOKENS})) as int) as parts"))
    )
    dealt = found.join(parts, "component").select(
        "id", "component", "parts", F.expr("cast(pmod(xxhash64(id), parts) as int) as block")
    )
    bits = _filter_of(spark, found.select(F.col("id").alias("a"), F.col("component").alias("b")))
    sets = texts.where("id is not null").mapInArrow(_wanted_sets(n, bits), "id long, tokens binary")
    placed = sets.where("octet_length(tokens) > 0").join(dealt, "id").dropDuplicates(["id", "tokens"])
    paired = placed.select(
        "component", "block", "id", "tokens", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
    ).select(
        "component",
        F.least("block", "other").alias("x"),
        F.greatest("block", "other").alias("y"),
        "block",
        "id",
        "tokens",
    )
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(count, "component", "x", "y").sortWithinPartitions("component", "x", "y")


def _frequent_table(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens counted at least 2**k times, for the least k that keeps the table in bounds."""
    counted = described.where("kind = 1").groupBy(F.col("id").alias("token")).agg(F.sum("n").alias("n"))
    counted = settle(counted.withColumn("power", F.floor(F.log2("n")).cast("int")), "frequent")
    held, cut = 0, 64
    for row in counted.groupBy("power").count().orderBy(F.desc("power")).collect():
        held += row["count"]
        if held > FREQUENT_TOKENS:
            break
        cut = row["power"]
    rows = counted.where(F.col("power") >= cut).select("token", "n").toPandas()
    tokens = rows["token"].to_numpy(np.int64).view(np.uint64)
    by_count = np.empty(len(tokens), np.uint64)
    by_count[np.lexsort((tokens, rows["n"].to_numpy(np.int64)))] = np.arange(len(tokens), dtype=np.uint64)
    order = np.argsort(tokens)
    return tokens[order], by_count[order]


def jaccard_join(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n: int = 3,
    percent: int = 90,
    orders: int = ORDERS,
) -> JaccardJoin:
    """Links documents whose sets of ``n``-word shingles have a Jaccard similarity of
    ``percent`` or more, and finds the components.

    A text of fewer than ``n`` words has one shingle, all of it; a null text, or one without
    words, has none, is linked with nothing and is a component of its own.  Rows of one id are
    one document that has the links of all its rows.  A null id comes back with a null
    component and has no links.  Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    described = settle(
        texts.mapInArrow(_describe(n), "kind int, id long, n long, d1 long, d2 long"), "described"
    )
    sizes = described.where("kind = 0").select("id", "n", "d1", "d2")
    frequent = spark.sparkContext.broadcast(_frequent_table(described))

    named = sizes.where("id is not null")
    classes = settle(
        named.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("owner"), F.count("*").alias("rows")),
        "classes",
    )
    # Prefixes are grouped only where a set has several rows.
    repeated = classes.where("rows > 1")
    copied = _filter_of(spark, named.join(repeated, ["d1", "d2", "n"], "left_semi").select("id"))
    bucket = Window.partitionBy("token", "k")

    known = texts.where("id is not null")

    def buckets(chosen: range, filters: list[tuple]) -> DataFrame:
        """The prefix tokens of one row per set that others of nearly its size have, too."""
        arrays = [f"p{k}" for k in chosen]
        schema = "id long, n long, d1 long, d2 long, " + ", ".join(f"{c} array<long>" for c in arrays)
        alone, several = (
            known.mapInArrow(_prefixes(n, percent, frequent, chosen, [*filters, (copied, wanted)]), schema)
            for wanted in (False, True)
        )
        owned = several.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in arrays])
        numbered = [
            F.expr(f"transform({c}, (t, i) -> named_struct('k', {k}, 'token', t, 'at', i))")
            for k, c in zip(chosen, arrays)
        ]
        tokens = alone.unionByName(owned).select("id", "n", F.inline(F.flatten(F.array(*numbered))))
        # Only sets of nearly equal size can be similar: a row stays if its neighbour by size is near.
        by_size = bucket.orderBy("n", "at", "id")
        return settle(
            tokens.withColumn("under", F.lag("n").over(by_size))
            .withColumn("over", F.lead("n").over(by_size))
            .withColumn("size", F.count("*").over(bucket))
            .withColumn("pivot", F.min(F.struct("at", "id", "n")).over(bucket))
            .where(f"100 * under >= {percent} * n or 100 * n >= {percent} * over")
            .select("id", "n", "k", "token", "at", "size", F.col("pivot.id").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat")),
            "buckets",
        )

    shared = buckets(range(1), [])
    near_pivot = (
        shared.where(f"size > {_LARGE_BUCKET} and id <> p")
        .where(_enough("n", "at", "pn", "pat", percent))
        .select(F.col("p").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    first = _verified(texts, near_pivot, n, percent)
    found = settle(components(first), "components")

    if orders > 1:
        reached = _filter_of(spark, shared.select("id"))
        shared = shared.unionByName(buckets(range(1, orders), [(reached, True)]))
    joined = (
        shared.join(found, "id", "left")
        .select("id", "n", "k", "token", "at", F.coalesce("component", "id").alias("component"))
        .withColumn("low", F.min("component").over(bucket))
        .withColumn("high", F.max("component").over(bucket))
        .where("low <> high")
    )
    sides = [
        joined.select("token", "k", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "at", "component")])
        for side in ("a", "b")
    ]
    met = sides[0].join(sides[1], ["token", "k"]).where(
        f"id_a < id_b and component_a <> component_b and {_enough('n_a', 'at_a', 'n_b', 'at_b', percent)}"
    )
    everywhere = (1 << orders) - 1
    candidates = (
        met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        .agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("under"))
        .where(f"under = {everywhere}")
    )
    second = _verified(texts, candidates, n, percent)

    owners = classes.select("d1", "d2", "n", "owner")
    owned = settle(named.join(owners, ["d1", "d2", "n"], "left").select("id", "n", "owner"), "owned")
    # An id with several texts joins the classes of all of them.
    holding = owned.where("owner is not null")
    several = holding.groupBy("id").agg(F.min("owner").alias("a"), F.max("owner").alias("high")).where("a <> high")
    tied = holding.join(several, "id").where("owner <> a").select("a", F.col("owner").alias("b")).distinct()
    found = settle(components(first.unionAll(second).unionAll(tied)), "components")

    reached = found.select(F.col("id").alias("owner"), "component")
    placed = holding.join(reached, "owner", "left").select("id", "n", F.coalesce("component", "owner").alias("component"))
    # Rows without words go with the other rows of their id.
    blank = owned.where("owner is null").select("id", "n")
    others = placed.join(blank.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component").alias("c"))
    beside = blank.join(others, "id", "left").select("id", "n", F.coalesce("c", "id").alias("component"))
    nobody = sizes.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    members = placed.unionAll(beside).unionAll(nobody).withColumnRenamed("n", "n_shingles")
    return JaccardJoin(members, lambda: _block_pairs(texts, sizes, found, n), percent)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at 90 percent, with the number of links between different
    sets in their component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = jaccard_join(docs)
    return found.members.join(found.counts, "component", "left").select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


# Sets of documents, pairs by shared shingles, and everything reachable from each document.
SQL = """
WITH RECURSIVE listed AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_sort(
    list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
  FROM listed),
told AS (SELECT doc_id, s, len(s) AS n, md5(array_to_string(s, chr(10))) AS class FROM sets),
owners AS (SELECT class, any_value(s) AS s, any_value(n) AS n, min(doc_id) AS owner FROM told WHERE n > 0 GROUP BY class),
tokens AS (SELECT owner, n, unnest(s) AS token FROM owners),
links AS (
  SELECT a.owner AS a, b.owner AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.owner < b.owner
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.owner, b.owner, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT owner AS a, owner AS b FROM owners
  UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
component AS (SELECT a AS owner, min(b) AS component FROM reached GROUP BY a),
counts AS (SELECT component, count(*) AS n_links FROM links JOIN component ON owner = a GROUP BY component)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM told LEFT JOIN (SELECT class, owner FROM owners) o ON told.n > 0 AND told.class = o.class
  LEFT JOIN component USING (owner) LEFT JOIN counts USING (component)
"""
