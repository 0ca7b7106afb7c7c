"""Benchmark decontamination with DataFrame functions only.

Items are lower-cased, split into words and cut into windows of 10 consecutive words (a shorter item is one window).
Distinct windows form a broadcast hash set. A document's windows are hashed in place and tested against a bit map of
the set, 64 bits a window, which a scalar subquery hands to the tasks; the few that pass leave their row with their words
and are joined to the set on the words themselves, which verifies each hit. Hits of a document are then united into hit
words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, gram_hashes, materialize, small

N = 10
WORD_BREAK = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Most bits of the bit map: 2^28 (32 MB), for 4 million windows. With more it lets more candidates through to the join.
MAP_BITS = 28


def words(text: str) -> str:
    """SQL for the lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return f"filter(split(translate(coalesce(cast({text} as string), ''), '{UPPER}', '{LOWER}'), '{WORD_BREAK}'), w -> w <> '')"


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """window (its words), n_words, hash, items (ids of the items it stands in): the distinct windows of all items. Items without words have none; a null item_id is no item."""
    rows = benchmark.where("item_id is not null").select(F.col("item_id"), F.expr(words("text")).alias("_w")).where("size(_w) > 0")
    grams = F.expr(f"transform(sequence(1, greatest(1, size(_w) - {n - 1})), i -> slice(_w, i, {n}))")
    rows = rows.select("item_id", F.explode(grams).alias("_g"))
    return rows.groupBy(F.array_join("_g", " ").alias("window"), F.size("_g").alias("n_words")).agg(F.collect_set("item_id").alias("items"))


def _hashed(grams: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    rows = gram_hashes(grams.withColumn("_w", F.split("window", " ")), "_w", sizes)
    chosen = " ".join(f"when n_words = {k} then get(_g{k}, 0)" for k in sizes)
    return rows.select(F.expr(f"cast((case {chosen} end) & {(1 << bits) - 1}L as int)").alias("b"))


def _bit_map(grams: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """One row: which values of the lowest bits of the windows' hashes occur, as an array of longs of 64; at most 2^bits / 64 of them reach the driver."""
    found = np.zeros((1 << bits) >> 6, np.int64)
    if sizes:
        words64 = _hashed(grams, sizes, bits).groupBy(F.shiftright("b", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("v")).toArrow()
        found[words64["k"].to_numpy()] = words64["v"].to_numpy()
    one = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))
    return grams.sparkSession.createDataFrame(pa.table({"map": one}))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of hit runs: first word, end word).

    A null or empty text has no words and no hits. Rows that repeat a doc_id stay apart. Extra columns are not read.
    Without benchmark words nothing is hit.
    """
    grams = materialize(windows(benchmark, n), "bench-windows")
    counts = {r["n_words"]: r["c"] for r in grams.groupBy("n_words").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row per length up to n
    sizes = sorted(counts)
    bits = min(MAP_BITS, max(10, (64 * sum(counts.values())).bit_length()))
    table = _bit_map(grams, sizes, bits).scalar()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(words("text")).alias("_w"))
    rows = gram_hashes(rows, "_w", sizes).withColumn("_map", table)
    low = (1 << bits) - 1
    test = f"(shiftright(get(_map, cast(shiftright(x, 6) & {low >> 6}L as int)), cast(x & 63 as int)) & 1L) = 1L"
    parts = [f"transform(filter(transform(_g{k}, (x, i) -> if({test}, i, -1)), p -> p >= 0 and p <= size(_w) - {k}), p -> named_struct('i', p, 'k', {k}))" for k in sizes]
    none = "cast(array() as array<struct<i: int, k: int>>)"
    rows = rows.select("doc_id", "_w", F.expr(f"concat({', '.join([none, *parts])})").alias("_pass"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.expr("cast(size(_w) as bigint)").alias("n_words"),
        F.expr("transform(_pass, x -> named_struct('i', x.i, 'g', array_join(slice(_w, x.i + 1, x.k), ' ')))").alias("_c"),
    )
    rows = rows.select("_row", "doc_id", "n_words", F.explode_outer("_c").alias("_x")).select("_row", "doc_id", "n_words", F.col("_x.i").alias("_i"), F.col("_x.g").alias("_g"))
    sets = small(grams.select(F.col("window").alias("_g"), F.col("n_words").alias("_k"), F.col("items").alias("_items")), 200_000)
    hits = rows.join(sets, "_g", "left")
    span = F.when(F.col("_k").isNotNull(), F.struct(F.col("_i").alias("a"), (F.col("_i") + F.col("_k")).alias("b")))
    out = hits.groupBy("_row", "doc_id", "n_words").agg(F.sort_array(F.collect_list(span)).alias("_s"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_ids"))
    merged = "aggregate(_s, named_struct('end', 0, 'n', 0L), (a, x) -> named_struct('end', greatest(a.end, x.b), 'n', a.n + greatest(0, x.b - greatest(a.end, x.a))), a -> a.n)"
    ids = F.expr("array_sort(transform(_ids, x -> cast(x as string)))")
    out = out.withColumn("n_hit", F.expr(merged)).withColumn("_names", ids)
    return out.select(
        "doc_id", "n_words", "n_hit", F.expr("cast(size(_ids) as bigint)").alias("n_items"),
        F.sha2(F.array_join("_names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.col("_s").alias("spans"),
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs, benchmark).drop("spans")


SQL = rf"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
g as (select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i+9], ' ') as g from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
ks as (select distinct k from g),
p as (select doc_id, k, i, array_to_string(w[i:i+k-1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
h as (select p.doc_id, p.i, p.k, g.item_id from p join g on p.k = g.k and p.g = g.g),
hw as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from h)) group by doc_id),
it as (select doc_id, count(*) as n, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hw.n, 0) as bigint) as n_hit, cast(coalesce(it.n, 0) as bigint) as n_items,
  sha256(coalesce(it.s, '')) as items_sha256, coalesce(hw.n, 0) > 0 as contaminated
from d left join hw using (doc_id) left join it using (doc_id)
"""
