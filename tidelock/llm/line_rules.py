"""Quality rules: measures of a text, and frequency of lines across the documents of a host. DataFrame functions only.

A normalised line (lower case, runs of white space and of digits folded) is counted over all documents of each host,
and lines above the limits are removed: more than LINE_LIMIT documents, and more than LINE_SHARE of those the host has,
so that a host's lines are judged alike at any size. Copies of one document share all their lines, and that is no reason
to reject them here: so equal texts of a host count once. A document that keeps too little is depleted and rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, gram_hashes, is_small, join_unique, materialize, words_of

#: A line in more documents of a host than this, and in more than this many of a thousand of them, is above the limits.
LINE_LIMIT, LINE_SHARE = 20, 5
#: A document is depleted if removed lines hold more than this percentage of its words.
DEPLETED_PERCENT = 70
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"

# Places of repeated windows by sorting (hash, place): neighbours in that order with equal hashes repeat.
_REPEATS = f"""
    if(_n < {WINDOW} or size(array_distinct(_windows)) = size(_windows), 0L,
       aggregate(
         sort_array(flatten(transform(array(sort_array(transform(_windows, (h, i) -> struct(h as h, i as i)))), s ->
           filter(transform(s, (x, j) -> if(coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false), x.i, -1)), p -> p >= 0)))),
         struct(-{WINDOW} as last, 0L as n),
         (a, p) -> struct(p as last, a.n + least({WINDOW}, p - a.last) as n),
         a -> a.n))
"""


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_hash, the measures of every row, and lines: array of (line: hash of the normalised line, w: its words). One pass over the texts."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
        F.expr("coalesce(cast(text as string), '')").alias("_text"),
    )
    rows = gram_hashes(rows.withColumn("_w", F.expr(words_of("_text"))), "_w", [WINDOW])
    folded = rf"regexp_replace(regexp_replace(translate(_text, '{UPPER}\t\u000b\u000c\r', '{LOWER}    '), '[0-9]+', '0'), ' {{2,}}', ' ')"
    rows = rows.select(
        "doc_id", "host", "_text", "_w", F.expr("size(_w)").alias("_n"),
        F.expr(f"if(size(_w) < {WINDOW}, cast(array() as array<bigint>), slice(_g{WINDOW}, 1, size(_w) - {WINDOW - 1}))").alias("_windows"),
        F.expr(r"filter(split(_text, '\n'), x -> btrim(x, ' \t\n\u000b\u000c\r') <> '')").alias("_lines"),
        F.expr(rf"filter(transform(split({folded}, '\n'), x -> btrim(x)), x -> x <> '')").alias("_folded"),
    )
    rows = rows.select(
        "doc_id", "host", F.xxhash64("_text").alias("text_hash"), F.col("_n").cast("bigint").alias("n_words"),
        F.expr("char_length(array_join(_w, ''))").cast("bigint").alias("word_chars"),
        F.expr(f"char_length(_text) - char_length(regexp_replace(_text, '[{SYMBOLS}]', ''))").cast("bigint").alias("n_symbols"),
        F.expr("size(_lines) - size(array_distinct(_lines))").cast("bigint").alias("n_dup_lines"),
        F.expr(_REPEATS).cast("bigint").alias("n_repeat_words"),
        F.expr("transform(_folded, x -> named_struct('line', xxhash64(x), 'w', size(split(x, ' '))))").alias("lines"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row; a null text has no words."""
    return profile(docs).drop("host", "text_hash", "lines")


def frequent_lines(profiles: DataFrame, limit: int = LINE_LIMIT, share: int = LINE_SHARE) -> DataFrame:
    """The lines above the limits, written: host, line, n_docs. profiles: a written profile().

    n_docs counts the different texts of a host that hold the line, and so does the number of documents of the host.
    """
    texts = profiles.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    once = texts.select("host", F.explode(F.expr("array_distinct(transform(lines, x -> x.line))")).alias("line"))
    often = materialize(once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > limit), "rule-lines")
    hosts = often.select("host").distinct()
    hosts = F.broadcast(hosts) if is_small(hosts) else hosts
    totals = materialize(profiles.join(hosts, "host", "left_semi").select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_texts")), "rule-hosts")
    weighed = often.join(F.broadcast(totals) if is_small(totals) else totals, "host")
    return materialize(weighed.where(1000 * F.col("n_docs") > share * F.col("_texts")).select("host", "line", "n_docs"), "rule-above")


def judge(docs: DataFrame, limit: int = LINE_LIMIT, depleted_percent: int = DEPLETED_PERCENT, share: int = LINE_SHARE) -> DataFrame:
    """Measures of every row with removed_words and kept.

    Hosts are values of `source` (null: one host of its own). Each row is judged by its own text, also where rows share
    a doc_id or have none. An empty table gives no rows; empty and null texts fail the base rules.
    """
    profiles = materialize(profile(docs).withColumn("_row", F.monotonically_increasing_id()), "rule-profiles")
    above = frequent_lines(profiles, limit, share)
    places = profiles.select("_row", "host", F.explode("lines").alias("_x")).select("_row", "host", F.col("_x.line").alias("line"), F.col("_x.w").alias("w"))
    removed = join_unique(places, above, ["host", "line"], "n_docs").groupBy("_row").agg(F.sum("w").alias("_removed"))
    removed = materialize(removed, "rule-removed")
    rows = profiles.drop("host", "text_hash", "lines").join(F.broadcast(removed) if is_small(removed) else removed, "_row", "left")
    rows = rows.withColumn("removed_words", F.coalesce("_removed", F.lit(0)).cast("bigint")).drop("_row", "_removed")
    depleted = 100 * F.col("removed_words") > depleted_percent * F.col("n_words")
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(docs: DataFrame, above: DataFrame) -> DataFrame:
    """doc_id and text of every row of docs, without the lines above the limits (a written frequent_lines()). A null text has no lines."""
    host = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host")
    fold = rf"btrim(regexp_replace(regexp_replace(translate(x, '{UPPER}\t\u000b\u000c\r', '{LOWER}    '), '[0-9]+', '0'), ' {{2,}}', ' '))"
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", host, F.split(F.coalesce("text", F.lit("")), "\n").alias("_l")), "rule-texts")
    lines = rows.select("_row", "host", F.posexplode("_l").alias("_at", "x")).select("_row", "host", "_at", F.expr(f"xxhash64({fold})").alias("line"))
    gone = join_unique(lines, above, ["host", "line"], "n_docs").groupBy("_row").agg(F.collect_set("_at").alias("_gone"))
    left = rows.join(gone, "_row", "left").select("doc_id", F.expr("filter(_l, (x, i) -> _gone is null or not array_contains(_gone, i))").alias("_l"))
    return left.select("doc_id", F.array_join("_l", "\n").alias("text"))


# The same in DuckDB: windows and lines as rows, whole lines in place of hashes.
SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents),
w as (select doc_id, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from d),
win as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from w where len(w) >= 8),
h as (select doc_id, i, array_to_string(w[i:i+7], ' ') as h from win),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h) as c from h) where c > 1),
cov as (select doc_id, sum(least(8, i - coalesce(p, -8))) as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from rep) group by doc_id),
raw as (select doc_id, host, unnest(string_split(t, chr(10))) as l from d),
wl as (select doc_id, host, l from raw where regexp_matches(l, '[^ \t\n\x0B\f\r]')),
dup as (select doc_id, count(*) - count(distinct l) as n from wl group by doc_id),
nl as (select doc_id, host, regexp_replace(regexp_replace(translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}'), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[0-9]+', '0', 'g') as l from wl),
lw as (select doc_id, host, l, len(string_split(l, ' ')) as lw from nl),
one as (select host, min(doc_id) as doc_id from d group by host, t),
tot as (select host, count(*) as n from one group by host),
above as (select host, l from (select distinct lw.doc_id, lw.host, l from lw join one using (doc_id)) join tot using (host) group by host, l, n
  having count(*) > {LINE_LIMIT} and 1000 * count(*) > {LINE_SHARE} * n),
rem as (select doc_id, sum(lw) as n from lw join above using (host, l) group by doc_id),
m as (select d.doc_id, cast(len(w.w) as bigint) as n_words,
  cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
  cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
  cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(rem.n, 0) as bigint) as removed_words
  from d join w using (doc_id) left join dup using (doc_id) left join cov using (doc_id) left join rem using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
  removed_words, not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and not (100 * removed_words > {DEPLETED_PERCENT} * n_words) as kept from m
"""
