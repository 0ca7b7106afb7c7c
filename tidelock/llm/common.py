"""Things the operators of this subpackage share: the shared folder, written tables and guarded broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import clear, fresh_dir, is_small, materialize, small  # noqa: F401

#: Keys with the most rows that join_unique() joins by broadcast where the whole table is too large for one.
HEAVY_KEYS = 100_000
#: The characters of `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A class of them for Java's regular expressions, within a SQL literal.
SPACE_CLASS = r"[ \\t\\n\\x0B\\f\\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def join_unique(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join with a written table `right` that has one row a key and, in `weight`, about how many rows of left the key has.

    A small table is broadcast. Else its heaviest keys are, and only the others are dealt out by key: no key that meets
    in one task has more than one part in HEAVY_KEYS of the rows.
    """
    if is_small(right):
        return left.join(F.broadcast(right.drop(weight)), on)
    heavy = materialize(right.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS), "heavy-keys")
    keys = F.broadcast(heavy.select(*on))
    one = left.join(F.broadcast(heavy.drop(weight)), on)
    return one.unionByName(left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti").drop(weight), on))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column); rows with a null doc_id stay."""
    gone = materialize(ids.toDF("_gone").where("_gone is not null").distinct(), "ids")
    return docs.join(small(gone), docs["doc_id"] == gone["_gone"], "left_anti")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str) -> str:
    """SQL for the words `[^\\x20\\x09-\\x0D]+` of a text as an array; null: none."""
    trimmed = rf"btrim(coalesce({text}, ''), ' \t\n\u000b\u000c\r')"
    return rf"if({trimmed} = '', cast(array() as array<string>), split({trimmed}, '{SPACE_CLASS}+'))"


def gram_hashes(df: DataFrame, words: str, sizes: list[int]) -> DataFrame:
    """df with a column _g<k> for each size: hashes of the k words from each place of the array column.

    Hashes of 2, 4, 8.. words are made from those of half as many, and other sizes from their binary digits: a few
    steps a word whatever the size. The last k - 1 entries of _g<k> stand for cut-off runs and must not be used.
    """
    powers = [1 << b for b in range(max(sizes, default=1).bit_length())]
    df = df.withColumn("_g1", F.expr(f"transform({words}, x -> xxhash64(x))"))
    for p in powers[1:]:
        df = df.withColumn(f"_g{p}", F.expr(f"transform(_g{p // 2}, (x, i) -> xxhash64(x, get(_g{p // 2}, i + {p // 2})))"))
    for k in sizes:
        if k not in powers:
            digits = [p for p in reversed(powers) if k & p]
            gets, at = [], digits[0]
            for p in digits[1:]:
                gets.append(f"get(_g{p}, i + {at})")
                at += p
            df = df.withColumn(f"_g{k}", F.expr(f"transform(_g{digits[0]}, (x, i) -> xxhash64(x, {', '.join(gets)}))"))
    return df
