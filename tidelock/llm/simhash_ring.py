"""SimHash near duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into m segments in a ring. If two fingerprints differ in at most t bits, then from some
segment on every chain of l = 1..m consecutive segments differs in at most l*t/m bits (the pigeonring principle). The
longest chain with a budget below one must be equal, so it is the key under which fingerprints meet; longer chains prune
before the full Hamming check. Where many distinct fingerprints meet under one key, they meet again under pairs of the
remaining segments, of which enough must be equal too: that is exact for any size of a group.
Copies share a fingerprint and count once; only distinct fingerprints are compared, and links are joined into components
by least labels with pointer jumping, on written tables.

Near copies whose shingle sets are similar to 0.8 differ in some 15 % of a fingerprint's bits. No key that must be equal is
then long enough to select, so near_copies() takes 256 bits, lets fingerprints meet under keys of the least shingle hashes,
and leaves it to the ring (four segments of 64 bits) and the full Hamming check to decide. Keys under which many meet are
worked off without pairs of all: first against a few of them, then those that stay outside the largest component found
so far against all, which is exact.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import is_small, join_unique, materialize, small

BITS, MAX_DIFFER, SEGMENTS, SHINGLE, SEED = 64, 2, 7, 3, 42
#: Distinct fingerprints under one key from which on they meet under finer keys.
CROWD = 64
#: Near copies under one key of which all pairs meet at once.
NEAR_CROWD = 16
#: Near copies: bits, the most of them that differ, words of a shingle, keys and the least hashes in each, first partners in a crowd.
WIDE_BITS, WIDE_DIFFER, WIDE_SHINGLE, KEYS, KEY_HASHES, HUBS = 256, 40, 5, 16, 5, 4


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half the XXH64 values (seed 42) of the shingles; no words: 0."""
    values = shingle_hashes(text, shingle)
    return int(_majority(values[:, None])[0]) if len(values) else 0


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 values of a text's shingles in order, repeats included; fewer words than a shingle are one, no words none."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z, and the white space \x20\x09-\x0D
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64)


def _majority(values: np.ndarray) -> np.ndarray:
    """For each column of 64-bit values, the bits that are set in over half of them."""
    n, lanes = values.shape
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, n, 4096):  # a bounded matrix of bits, however long the text
        part = np.ascontiguousarray(values[at : at + 4096])
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8 * lanes), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_LANES = _mixed(np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64))
_PLACES = np.arange(KEYS * KEY_HASHES, dtype=np.uint64) * np.uint64((1 << 64) // (KEYS * KEY_HASHES))


def sketch(text: bytes, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The wide fingerprint of a text's distinct shingles (four 64-bit values), and its keys: of the next hash after each of 80 places, five to a key. No words: zeros, and no keys."""
    values = np.unique(shingle_hashes(text, shingle))
    if not len(values):
        return np.zeros(len(_LANES), np.uint64), values
    least = values[np.searchsorted(values, _PLACES) % len(values)].reshape(KEY_HASHES, KEYS)
    keys = np.arange(1, KEYS + 1, dtype=np.uint64)
    for row in least:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ row)
    lanes = np.empty((len(values), len(_LANES)), np.uint64)
    for i, lane in enumerate(_LANES):
        lanes[:, i] = _mixed(values ^ lane)
    return _majority(lanes), keys


def fingerprint_batches(batches, shingle: int):
    for batch in pieces.released(batches):
        texts = pieces.filled(batch.column(1))
        data, offsets = pieces.column_bytes(texts)
        view = memoryview(data)
        values = np.fromiter((simhash(bytes(view[a:b]), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; a null or empty text has fingerprint zero."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(fingerprint_batches, shingle=shingle), "doc_id bigint, fp bigint")


def _masks(segments: int) -> list[int]:
    bounds = [BITS * k // segments for k in range(segments + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_links(nodes: DataFrame, max_differ: int = MAX_DIFFER, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) with a < b for all pairs of nodes (node, fp; fp distinct) whose fingerprints differ in at most max_differ bits."""
    masks = _masks(segments)
    budget = [chain * max_differ // segments for chain in range(segments + 1)]
    equal = max(k for k in range(segments + 1) if budget[k] == 0)
    if equal == 0:
        raise ValueError("more segments than differing bits are needed")
    ring = lambda start, n: sum(masks[(start + j) % segments] for j in range(n))
    # The longest chain under each budget stands for the shorter ones.
    chains = [(b, max(k for k in range(segments + 1) if budget[k] == b)) for b in sorted(set(budget)) if 0 < b < max_differ]
    starts = F.array(*[
        F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(ring(i, equal)))).alias("key"), F.array(*[F.lit(_signed(ring(i, k))) for _, k in chains]).cast("array<bigint>").alias("chains"))
        for i in range(segments)
    ])
    keyed = nodes.select("node", "fp", F.explode(starts).alias("_x")).select("node", "fp", "_x.*")
    crowded = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select("start", "key", F.lit(True).alias("_crowd"))
    keyed = keyed.join(small(materialize(crowded, "ring-crowded")), ["start", "key"], "left")
    rest = segments - equal
    finer = list(combinations(range(equal, segments), rest - max_differ)) if rest > max_differ else []
    if finer:
        choice = F.lit(None)
        for i in range(segments):
            fine = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[(i + j) % segments] for j in c)))).alias("v")) for n, c in enumerate(finer)])
            choice = F.when(F.col("start") == i, fine).otherwise(choice)
        one = F.array(F.struct(F.lit(-1).alias("n"), F.lit(0).cast("bigint").alias("v")))
        keyed = keyed.select("start", "key", "node", "fp", "chains", F.explode(F.when(F.col("_crowd"), choice).otherwise(one)).alias("_f"))
        keyed = keyed.select("start", "key", F.col("_f.n").alias("n"), F.col("_f.v").alias("v"), "node", "fp", "chains")
    on = ["start", "key", *(["n", "v"] if finer else [])]
    other = keyed.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("node").alias("_node"), F.col("fp").alias("_fp"))
    differ = F.col("fp").bitwiseXOR(F.col("_fp"))
    match = F.col("node") < F.col("_node")
    for c in on:
        match &= F.col(c) == F.col(f"_{c}")
    for j, (b, _) in enumerate(chains):
        match &= F.bit_count(differ.bitwiseAND(F.col("chains")[j])) <= b
    match &= F.bit_count(differ) <= max_differ
    return keyed.join(other, match).select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node that can be reached.

    Each round every node takes its least neighbour for parent, parents are followed to their roots, and only links
    between different roots are left: at least half of the parts go in a round, and few links outlive the first.
    """
    links, labels = materialize(links.toDF("a", "b"), "links"), None
    while True:
        both = links.union(links.select("b", "a")).toDF("node", "near")
        step = materialize(both.groupBy("node").agg(F.least(F.min("node"), F.min("near")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
        while True:
            parents = step.select(F.col("node").alias("label"), F.col("label").alias("_to"))
            higher = materialize(step.select("label").distinct().join(parents, "label").where(F.col("_to") < F.col("label")), "labels-higher")
            if not higher.limit(1).count():
                break
            step = materialize(step.join(small(higher), "label", "left").select("node", F.coalesce("_to", "label").alias("label"), "n"), "labels-step")
        if labels is None:
            labels = step.select("node", "label")
        else:
            moved = materialize(step.where(F.col("node") != F.col("label")).select(F.col("node").alias("label"), F.col("label").alias("_to")), "labels-moved")
            labels = materialize(labels.join(small(moved), "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"), "n") for c in "ab"]
        rooted = join_unique(join_unique(links, ends[0], ["a"], "n"), ends[1], ["b"], "n")
        links = materialize(rooted.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, max_differ: int = MAX_DIFFER, segments: int = SEGMENTS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id get the component of
    their fingerprint, or null if it has no id at all. Rows may repeat. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "fingerprint-groups")
    labels = components(ring_links(groups.where("node is not null").select("node", "fp"), max_differ, segments))
    classes = materialize(groups.join(labels, "node", "left").select("fp", "n", F.coalesce("label", "node").alias("component_id")), "fingerprint-classes")
    return join_unique(rows, classes, ["fp"], "n").select("doc_id", "fp", "component_id")


def sketch_batches(batches, shingle: int):
    for batch in pieces.released(batches):
        texts = pieces.filled(batch.column(1))
        data, offsets = pieces.column_bytes(texts)
        view, lanes, keys, ends = memoryview(data), np.zeros((len(texts), len(_LANES)), np.uint64), [np.zeros(0, np.uint64)], [0]
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            lanes[i], own = sketch(bytes(view[a:b]), shingle)
            keys.append(own)
            ends.append(ends[-1] + len(own))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
        columns = [pa.array(np.ascontiguousarray(lanes[:, i]).view(np.int64)) for i in range(len(_LANES))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, lists], names=["doc_id", *(f"f{i}" for i in range(len(_LANES))), "keys"])


def _near(max_differ: int) -> str:
    """SQL: from some segment on, every chain of segments of f and _f differs in at most its share, and so does the whole ring."""
    n = len(_LANES)
    differ = [f"bit_count(f{i} ^ _f{i})" for i in range(n)]
    ring = lambda start, k: " + ".join(differ[(start + j) % n] for j in range(k))
    chains = " or ".join("(" + " and ".join(f"{ring(i, k)} <= {k * max_differ // n}" for k in range(1, n)) + ")" for i in range(n))
    return f"({chains}) and {ring(0, n)} <= {max_differ}"


def key_links(nodes: DataFrame, max_differ: int = WIDE_DIFFER, crowd: int = NEAR_CROWD, hubs: int = HUBS) -> DataFrame:
    """(node, label) of every node (node, f0.., keys) that shares a key with another from which it differs in at most max_differ bits: components of these links."""
    lanes = [f"f{i}" for i in range(len(_LANES))]
    keyed = nodes.select("node", *lanes, F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "n", F.col("n").alias("size")), "near-keys")
    members = materialize(join_unique(keyed, shared, ["key"], "n").select("key", "size", "node", *lanes), "near-members")

    def met(left: DataFrame, right: DataFrame, apart: str, *kept: str) -> DataFrame:
        other = right.select(F.col("key").alias("_key"), F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in (*lanes, *kept)])
        return left.join(other, F.expr(f"key = _key and {apart} and {_near(max_differ)}"))

    # The first partners of a crowd are chosen by their own hash alone, so that crowds of the same texts have the same ones.
    few, many = members.where(F.col("size") <= crowd), members.where(F.col("size") > crowd)
    first = many.where(F.expr(f"pmod(xxhash64(node), cast(ceil(size / {hubs}) as bigint)) = 0"))
    links = met(few, few, "node < _node").select("node", "_node").union(met(many, small(materialize(first, "near-hubs")), "node <> _node").select("node", "_node"))
    labels = components(links.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct())
    if not many.limit(1).count():
        return labels
    # A pair within a component found so far adds nothing; of each key, those outside its largest component meet all.
    many = materialize(many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-crowds")
    counts = many.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = materialize(counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("_main"), F.sum("n").alias("n")), "near-main")
    rest = materialize(join_unique(many, main, ["key"], "n").where(F.col("label") != F.col("_main")).drop("_main"), "near-rest")
    more = met(many, small(rest), "label <> _label", "label").select(F.least("label", "_label").alias("a"), F.greatest("label", "_label").alias("b")).distinct()
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    every = labels.unionByName(many.where(F.col("label") == F.col("node")).select("node", "label")).distinct()
    return every.join(small(materialize(joined, "near-joined")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))


def near_copies(docs: DataFrame, max_differ: int = WIDE_DIFFER, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """doc_id, component_id (least doc_id reachable) of every row: texts whose sets of five-word shingles are similar to about 0.8 or more.

    Linked are fingerprints of 256 bits that share a key and differ in at most max_differ bits (40; a similarity of 0.8
    comes to 38.8 on average), and equal ones. Texts without words are alike. Rows with a null doc_id get the
    component of their fingerprint, or null if it has no id at all. Rows may repeat. An empty table gives no rows.
    """
    lanes = [f"f{i}" for i in range(len(_LANES))]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(partial(sketch_batches, shingle=shingle), f"doc_id bigint, {', '.join(f'{c} bigint' for c in lanes)}, keys array<bigint>")
    rows = materialize(rows, "sketches")
    groups = materialize(rows.groupBy(*lanes).agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys"), F.count(F.lit(1)).alias("n")), "sketch-groups")
    labels = key_links(groups.where("node is not null"), max_differ)
    classes = materialize(groups.drop("keys").join(labels, "node", "left").select(*lanes, "n", F.coalesce("label", "node").alias("component_id")), "sketch-classes")
    return join_unique(rows.select("doc_id", *lanes), classes, lanes, "n").select("doc_id", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
