"""Each operator against brute force, on edge cases and on whole small tables."""

import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from functools import partial
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelock.llm import bin_slack, common, length_histogram, license_fuzzy, line_rules, minimax_shards, nbsvm, ngram_decontam, pieces, simhash_ring, token_orc, wrapper_html
from tidelock.llm.common import materialize

WORD, BYTE = pieces.tokenizer_path("word_bpe_49k.json"), pieces.tokenizer_path("byte_bpe_50k.json")


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op1_edges(edges, empty, spark):
    got = token_orc.digest(edges, WORD).collect()
    rows = edges.collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r.doc_id, len(x := ids_of(WORD, r.text)), crc(x)) for r in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in pairwise(ordered)) and ordered[0].start == 0
    assert token_orc.digest(empty, WORD).count() == 0


def test_op1_lookup(edges, spark, tmp_path):
    token_orc.write_tokens(edges, f"file://{tmp_path}/t", WORD)
    found = {r.doc_id: list(r.ids) for r in token_orc.lookup(spark, f"file://{tmp_path}/t", [3, 10]).collect()}
    assert found == {3: [1], 10: ids_of(WORD, edges.where("doc_id = 10").first().text)}


def test_op3_against_lengths(edges, empty):
    lengths = sorted(len(ids_of(BYTE, r.text)) - 1 for r in edges.collect())
    sums = length_histogram.with_suffix_sums(length_histogram.histogram(edges, BYTE))
    for r in sums.collect():
        assert r.n_docs == lengths.count(r.n_tokens)
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.tokens_total == sum(lengths)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
        assert r["quantile"] == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    assert length_histogram.truncated_total(sums, 7).first()[0] == sum(min(x, 7) for x in lengths)
    assert length_histogram.quantile_length(sums, 0.5).first()[0] == lengths[(len(lengths) - 1) // 2]
    assert length_histogram.with_suffix_sums(length_histogram.histogram(empty, BYTE)).count() == 0


def best_sum(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_op4_best_fill():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 30, rng.integers(1, 8)).tolist()
        room = int(rng.integers(0, 60))
        fill = bin_slack.best_fill(Counter(lengths), room)
        assert sum(x * n for x, n in fill.items()) == best_sum(lengths, room)
        assert all(n <= Counter(lengths)[x] for x, n in fill.items())


def test_op4_pieces(edges, empty):
    packed = bin_slack.pack(edges, BYTE).withColumn("crc", F.crc32("ids"))
    got, sequences = packed.collect(), defaultdict(list)
    expected = Counter()
    for r in edges.collect():
        ids = ids_of(BYTE, r.text)
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            expected[r.doc_id, at, len(part), len(ids), crc(part)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.crc) for r in got) == expected
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in sequences.values():
        parts.sort()
        assert [p[0] for p in parts] == np.concatenate([[0], np.cumsum([p[1] for p in parts])[:-1]]).tolist()
        assert sum(p[1] for p in parts) <= 2048
    whole = {r.sequence_id: bytes(r.ids) for r in bin_slack.sequences(packed).collect()}
    assert whole == {s: b"".join(p[2] for p in parts) for s, parts in sequences.items()}
    assert bin_slack.digest(empty, BYTE).count() == 0


def test_op4_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = bin_slack.digest(docs, BYTE).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert r.s <= -(-r.n // 2048) * 1.005 + 1


def brute_rules(text):
    w = split(text)
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_op2_edges(edges, empty):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = line_rules.judge(edges).collect()
    assert Counter((r.doc_id, *[r[c] for c in cols]) for r in got) == Counter((r.doc_id, *brute_rules(r.text)) for r in edges.collect())
    assert all(r.kept != r.base_failed for r in got)
    assert line_rules.judge(empty).count() == 0


def test_op2_lines_of_many_documents_go_and_copies_stay(spark):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are folded in lines
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n)).translate(letters)
    rows = [(i, f"Menu 3 home about contact\n{own(i, 30)}", "h") for i in range(40)]  # boilerplate among other text
    rows += [(100 + i, "\n".join(["MENU  7 home about contact"] * 8 + [own(i, 6)]), "h") for i in range(5)]  # hardly anything else
    rows += [(200 + i, "\n".join(own(j, 12) for j in range(900, 910)), "h") for i in range(60)]  # copies of one document
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in line_rules.judge(docs).collect()}
    assert all(got[i].kept and got[i].removed_words == 5 for i in range(40))
    assert all(got[100 + i].removed_words == 40 and not got[100 + i].kept for i in range(5))
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(60))
    above = line_rules.frequent_lines(materialize(line_rules.profile(docs), "t"))
    cleaned = {r.doc_id: r.text for r in line_rules.without_lines(docs, above).collect()}
    assert cleaned[0] == own(0, 30) and cleaned[200].count("\n") == 9


def test_op2_host_of_nothing_but_template(spark):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are folded in lines
    text = lambda i: "\n".join([*[f"menu entry {c} of site" for c in "abcdefgh"], " ".join(f"own{i}x{j}" for j in range(6)).translate(letters)])
    rows = [(i, text(i), "h") for i in range(30)] + [(100 + i, text(0), "copies") for i in range(30)] + [(200 + i, text(i), "few") for i in range(20)]
    got = {r.doc_id: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(got[i].removed_words == 40 and not got[i].kept and not got[i].base_failed for i in range(30))
    assert all(got[i].removed_words == 0 and got[i].kept for i in [*range(100, 130), *range(200, 220)])


def test_op2_repeated_rows_keep_their_verdict(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    text = lambda i: "shared line of many words in this host today yes\n" + " ".join(f"own{i}x{j}" for j in range(16)).translate(letters)
    rows = [(i, text(i), "h") for i in range(30)] + [(3, text(3), "h")] * 2 + [(None, text(4), "h")] * 2 + [(3, "other text of the same id " * 5, "h")]
    got = line_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    same = [(r.n_words, r.removed_words, r.kept) for r in got if r.n_words == 26]
    assert len(got) == 35 and len(same) == 34 and set(same) == {(26, 10, True)}


def test_op2_limits_follow_the_host(spark, monkeypatch):
    letters = str.maketrans("0123456789", "abcdefghij")
    text = lambda i: ("rare line of some documents here\n" if i < 60 else "") + " ".join(f"own{i}x{j}" for j in range(25)).translate(letters)
    docs = spark.createDataFrame([(i, text(i), "h") for i in range(300)], "doc_id bigint, text string, source string")
    removed = lambda **k: sum(r.removed_words > 0 for r in line_rules.judge(docs, **k).collect())
    assert removed() == 60 and removed(limit=60) == 0 and removed(share=199) == 60 and removed(share=200) == 0
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    monkeypatch.setattr(line_rules, "is_small", lambda *_: False)
    monkeypatch.setattr(common, "HEAVY_KEYS", 1)
    assert removed() == 60


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        grams = {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v else set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    ids.add(str(item))
    return len(w), len(hit), len(ids), ",".join(sorted(ids))


def test_op5_against_brute_force(edges, empty, spark, monkeypatch):
    import hashlib

    items = [(1, "Same TEXT, here for two"), (2, " ".join(f"z{i}" for i in range(20, 45))), (10, "one two three four five six seven eight one two three"), (3, None), (4, "..."), (5, "w1"), (6, "SAME text here-for two!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter(tuple(r) for r in ngram_decontam.digest(edges, bench).collect())
    expected = Counter()
    for r in edges.collect():
        n, hit, k, ids = brute_hits(r.text, items)
        expected[r.doc_id, n, hit, k, hashlib.sha256(ids.encode()).hexdigest(), hit > 0] += 1
    assert got == expected
    monkeypatch.setattr(ngram_decontam, "MAP_BITS", 10)  # a map that lets much through
    many = bench.unionByName(spark.createDataFrame([(100 + i, " ".join(f"v{i * j}" for j in range(1, 40))) for i in range(40)], bench.schema))
    assert Counter(tuple(r) for r in ngram_decontam.digest(edges, many).collect()) == expected
    assert ngram_decontam.digest(empty, bench).count() == 0
    assert not ngram_decontam.digest(edges, bench.limit(0)).where("contaminated or n_items > 0").count()


def test_op6_edges_and_held_out(edges, empty, spark):
    labels = spark.createDataFrame([(1, 1, None), (9, 0, 1), (5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = nbsvm.classify(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.score for r in nbsvm.classify(edges, labels.limit(0)).collect()} == {0.5}
    assert nbsvm.classify(empty, labels).count() == 0


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = nbsvm.classify(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.98 * len(got)
    good, bad = [r.score for r in got if r.quality == 1], np.sort([r.score for r in got if r.quality == 0])
    above = sum(np.searchsorted(bad, g) + np.searchsorted(bad, g, "right") for g in good) / 2  # pairs in the right order, ties half
    assert above / len(good) / len(bad) >= 0.99


def slow_grams(text):
    """The n-grams themselves, without hashes."""
    words = split(text)
    fold = lambda c: "a" if c >= "\x80" or "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c
    shapes = [re.sub(r"(.)\1+", r"\1", "".join(map(fold, w)), flags=re.S) for w in words]
    marked = [(s, bool(i) and words[i] == words[i - 1]) for i, s in enumerate(shapes)]
    low = [ascii_lower(w) for w in words]
    return {("s", *marked[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)} | {("w", *low[i : i + k]) for k in (1, 2) for i in range(len(words) - k + 1)}


def test_op6_features_and_ratios_against_slow_counts():
    texts = ["a-1,b-2,c-3,Q7x the End", "a-1,b-2,c-3,d#%&4 the end", "", None, "x x x Y", "É one É two", "b one One two two", "a" * 5000]
    size = 1 << nbsvm.FEATURE_BITS
    ids = [nbsvm.features(t) for t in texts]
    names = [slow_grams(t) for t in texts]
    of = {}  # the id of each n-gram, from texts that hold it and texts that do not
    for g in set().union(*names):
        left = set.intersection(*[set(i.tolist()) for i, n in zip(ids, names, strict=True) if g in n])
        of[g] = left
        assert left
    assert [len(i) for i in ids] == [len(n) for n in names]  # no two n-grams of one of these texts share an id
    assert len(set(ids[0].tolist()) ^ set(ids[1].tolist())) > 4
    labels = np.array([1, 0, 1, 0, 1, 0, 1, 0])
    ratio = nbsvm.log_ratios(ids, labels, size)
    total = {y: size * nbsvm.SMOOTHING + sum(len(n) for n, z in zip(names, labels, strict=True) if z == y) for y in (0, 1)}
    for g, places in of.items():
        share = {y: (nbsvm.SMOOTHING + sum(g in n for n, z in zip(names, labels, strict=True) if z == y)) / total[y] for y in (0, 1)}
        assert any(ratio[i] == pytest.approx(np.log(share[1] / share[0])) for i in places)


def test_op6_dual_descent_against_slow_gradient():
    rng = np.random.default_rng(4)
    for _ in range(5):
        n, size = 12, 8
        rows = [np.sort(rng.choice(size, int(rng.integers(1, 6)), replace=False)) for _ in range(n)]
        values, bias = [rng.normal(size=len(r)) for r in rows], rng.uniform(0.3, 1, n)
        y, limit = np.where(rng.random(n) < 0.5, 1.0, -1.0), rng.uniform(0.2, 2, n)
        x = np.zeros((n, size + 1))
        for i, (r, v) in enumerate(zip(rows, values, strict=True)):
            x[i, r], x[i, size] = v, bias[i]
        goal = lambda w: w @ w / 2 + limit @ np.maximum(0, 1 - y * (x @ w))
        alpha, q = np.zeros(n), (x * y[:, None]) @ (x * y[:, None]).T
        step = 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(20_000):  # projected gradient on the dual, all coordinates at once
            alpha = np.clip(alpha - step * (q @ alpha - 1), 0, limit)
        best = x.T @ (alpha * y)
        w, b, a = nbsvm.dual_descent(rows, values, bias, y, limit, size, 3000, 1)
        assert ((a >= 0) & (a <= limit)).all()
        assert goal(np.append(w, b)) == pytest.approx(goal(best), abs=1e-3)


def test_op6_repeated_rows_do_not_reach_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"good words {i}") for i in range(300)] + [(3, "bad #% words")] + [(i, "more words") for i in range(4, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y: seen.append(len(rows)))
    nbsvm.train(docs, labels, limit=20)
    nbsvm.train(docs, labels, most=30)
    nbsvm.train(docs, labels, most=0)
    nbsvm.train(docs.limit(0), labels)
    assert seen[0] <= 20 and 1 < seen[1] < 8 and seen[2:] == [1, 0]


def least_minimax(sizes, k):
    best = {(0, 0): 0}
    for j in range(1, k + 1):
        for i in range(len(sizes) + 1):
            best[j, i] = min(max(best[j - 1, h], sum(sizes[h:i])) for h in range(i + 1) if (j - 1, h) in best)
    return best[k, len(sizes)]


def test_op7_capacity_and_cuts():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes, k = rng.integers(1, 50, rng.integers(1, 12)).tolist(), int(rng.integers(1, 6))
        assert minimax_shards.least_capacity(sizes, k) == least_minimax(sizes, k)
        bounds = [0, *minimax_shards.cuts(sizes, k), len(sizes)]
        assert bounds == sorted(bounds) and max(sum(sizes[a:b]) for a, b in pairwise(bounds)) == least_minimax(sizes, k)


def test_op7_capacity_is_the_least_over_groups(spark):
    rng = np.random.default_rng(7)
    for n, shards in ((0, 3), (1, 3), (40, 5), (300, 24), (2000, 7)):
        rows = [(int(h), int(x)) for h, x in zip(rng.integers(-(1 << 63), 1 << 63, n), rng.integers(8, 3000, n), strict=True)]
        rows += [(rows[0][0], 11)] * 5 if rows else []
        groups = Counter()
        for h, x in rows:
            groups[h] += x
        sizes = [groups[h] for h in sorted(groups)]
        df = spark.createDataFrame(rows, "_h bigint, size bigint")
        units = minimax_shards.group_ranges(df, shards, 4, 3)
        assert units[:, 2].sum() == sum(sizes) and len(units) <= len(sizes)
        assert minimax_shards.least_capacity(units[:, 2].tolist(), shards) == minimax_shards.least_capacity(sizes, shards)


def test_op7_rows(edges, empty, spark):
    for docs in (edges, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = minimax_shards.assign(docs).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len(b := (r.text or "").encode()) + 8, zlib.crc32(b)) for r in docs.collect())
        slots, of_text = defaultdict(list), defaultdict(set)
        for r in got:
            slots[r.shard].append(r.slot)
            of_text[r.size, r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 24 for s in slots)
        assert all(len(s) == 1 for s in of_text.values())
    assert minimax_shards.assign(empty).count() == 0


PAGE = """<!doctype html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="</p>"</script></head><body><div class="top">Site name</div>
<nav><a href="/">Home {i}</a></nav><div id="cookie-notice">We use cookies</div><div class="box">Always the same</div>
<article><h1>Title {i} &amp; more</h1><p>First&nbsp;para <b>bold {i}</b>text<br>line<p>Second   {i}
&lt;x&gt;<form><input>Send</form><div class="comments"><p>Nice!</p></div></article><footer>&copy; {i}</footer></body></html>"""


def test_op8_articles():
    assert wrapper_html.extract(PAGE.format(i=5)) == "Title 5 & more\nFirst para bold 5text line\nSecond 5 <x>"
    for odd in ("", None, "<", "<p", "plain &amp text", "<p>a<!-- x", "<script>", "</p></div>", "<b>x<i>y</b>z"):
        wrapper_html.extract(odd)
    assert wrapper_html.extract("plain &amp text") == "plain & text"


def by_wrapper(pages):
    references, keys = wrapper_html.induce(pages)
    layouts = [wrapper_html.content(wrapper_html.parse(p))[2] for p in pages]
    return [wrapper_html.extract(p, set(keys[x]), references[x]) for p, x in zip(pages, layouts, strict=True)]


def test_op8_deep_pages():
    deep = "<html><body>" + "<div>" * 5000 + "<p>inner</p>" + "<main>" * 2000 + "<span>most" + "</div>" * 5000 + "<p>last"
    assert wrapper_html.extract(deep) == "most"
    plain = deep.replace("<main>", "<b>")
    assert wrapper_html.extract(plain) == "inner\nmost\nlast"
    pages = [f"<div>Site</div><div>{i}</div>" + "<div>" * 5000 + f"text {i}" for i in range(5)]
    assert by_wrapper(pages)[2] == "2\ntext 2"


def best_match(a, b):
    """The weight of a heaviest match, by trying every way to pair children in order."""
    if a.label != b.label:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        w = best_match(xs[0], ys[0])
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), w + lists(xs[1:], ys[1:]) if w else 0)

    return 1 + lists(a.kids, b.kids)


def test_op8_match_is_a_heaviest_one():
    rng = np.random.default_rng(6)

    def tree(depth):
        node = wrapper_html.Node("", "ab"[int(rng.integers(2))], False)
        node.kids = [tree(depth - 1) for _ in range(int(rng.integers(0, 5)))] if depth else []
        return node

    for _ in range(300):
        a, b = tree(3), tree(3)
        a.label = b.label = "r"
        pairs = wrapper_html.match(a, b)
        assert len(pairs) == best_match(a, b)
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        above = {id(k): n for t in (a, b) for n in wrapper_html._preorder(t) for k in n.kids}
        held = {id(x): y for x, y in pairs}
        assert all(x is a or held[id(above[id(x)])] is above[id(y)] for x, y in pairs)
        order = [[wrapper_html._preorder(t).index(n) for n in column] for t, column in zip((a, b), zip(*pairs, strict=True), strict=True)]
        assert order[0] == sorted(order[0]) and order[1] == sorted(order[1])
        again = wrapper_html.tree_of(wrapper_html.outline(a))
        assert [n.label for n in wrapper_html._preorder(again)] == [n.label for n in wrapper_html._preorder(a)]


def test_op8_long_lists_are_aligned_whole(monkeypatch):
    rng = np.random.default_rng(8)

    def tree(labels):
        node = wrapper_html.Node("", "r", False)
        node.kids = [wrapper_html.Node("", x, False) for x in labels]
        return node

    a, b = (["abc"[i] for i in rng.integers(3, size=n)] for n in (1100, 1000))
    line = [0] * (len(b) + 1)
    for x in a:
        before, line = line, [0]
        for j, y in enumerate(b):
            line.append(before[j] + 1 if x == y else max(before[j + 1], line[j]))
    assert len(wrapper_html.match(tree(a), tree(b))) == 1 + line[-1]

    def near(depth):
        node = wrapper_html.Node("", "ab"[int(rng.integers(2))] if depth < 3 else "r", False)
        node.kids = [near(depth - 1) for _ in range(int(rng.integers(0, 6)))] if depth else []
        return node

    for _ in range(100):
        x, y = near(3), near(3)
        found = []
        for change in ({}, {"PLAIN_CELLS": 0}, {"PLAIN_CELLS": 0, "TABLE_CELLS": 1, "KEPT_WEIGHTS": 1}, {"PLAIN_CELLS": 0, "SPARSE_PAIRS": 0}):
            with monkeypatch.context() as m:
                for name, value in change.items():
                    m.setattr(wrapper_html, name, value)
                found.append([(id(p), id(q)) for p, q in wrapper_html.match(x, y)])
        assert found[0] == found[1] == found[2] and len(found[0]) == len(found[3]) == best_match(x, y)


def test_op8_class_words_do_not_take_content():
    page = '<article><div class="article-header"><h1>Title</h1></div><p class="notice">Court notice text</p><p>x</p><div class="comments"><p>Nice</p></div><ul id="related-posts"><li>More</ul></article>'
    assert wrapper_html.extract(page) == "Title\nCourt notice text\nx"
    assert wrapper_html.extract(f'<body><form id="aspnetForm"><input name="q"><nav>Menu</nav>{page}</form></body>') == "Title\nCourt notice text\nx"
    assert wrapper_html.extract("<div class=notice>Old</div><p class=header>Kept</p><form><p>Name</p><input></form><div class='site-footer'>End</div><div class='social-history'>Stays</div>") == "Kept\nStays"


def test_op8_wrapper_decides(spark):
    """The driver's pages with lines of their host put into them: only constancy tells these from content."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    host = [re.match(r"https?://([^/:?#]*)", r.url)[1] for r in rows]
    put = lambda h, page: page.replace("<article>", f"<div><p>Part of {h}</p></div><main><p>Welcome to {h}</p><article>").replace("</h1>", f"</h1><p>By the staff of {h}</p>", 1).replace("</article>", f"<p>Read on at {h}</p></article><p>Thanks from {h}</p></main>")
    pages = [(r.page_id, r.url, put(h, r.html)) for r, h in zip(rows, host, strict=True)]
    got = {r.page_id: r.text for r in wrapper_html.main_texts(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    texts = defaultdict(set)
    for r, h in zip(rows, host, strict=True):
        texts[h].add(wrapper_html.extract(r.html))
    decided = 0
    for r, h, (_, _, page) in zip(rows, host, pages, strict=True):
        lines = [f"By the staff of {h}", f"Read on at {h}"]
        assert [x for x in wrapper_html.extract(page).split("\n") if h in x] == lines[: 2 if "</article>" in page else 1]
        if len(texts[h]) >= 5 and all(len(t) > 400 for t in texts[h]):
            assert got[r.page_id] == wrapper_html.extract(r.html)
            decided += 1
    assert decided >= 30


def test_op8_nodes_meet_by_their_place(spark):
    """Equal paths, told apart by the alignment alone: the second of two like nodes is constant, the first varies and may hold the same text."""
    page = "<div><p>{a}</p><p>Same words</p><i>mark</i></div><div>{b}</div>"
    pages = [page.format(a="Same words" if i == 3 else f"Own {i}", b=f"text {i}") for i in range(12)]
    assert host_texts(spark, pages)[:2] == ["Own 0\ntext 0", "Own 1\ntext 1"]
    assert host_texts(spark, [*pages, *pages, pages[0]])[:2] == ["Own 0\ntext 0", "Own 1\ntext 1"]
    assert host_texts(spark, ["", "<", *pages, "<p>" * 300 + "x" * 100_000])[-1] == "x" * 100_000


def test_op8_large_pages_are_aligned_too(spark, monkeypatch):
    """A line that every second page has is told by its place in the alignment alone, on pages of any size."""
    page = "<div><p>Own {i}</p>{line}<i>mark</i></div><div>text {i}</div>"
    pages = [page.format(i=i, line="<p>Line of all</p>" if i % 2 else "") for i in range(12)]
    texts = [f"Own {i}\ntext {i}" for i in range(12)]
    assert host_texts(spark, pages) == texts
    nodes = [p + "<ul>" + "<li></li>" * 600 + "</ul>" for p in pages]
    assert host_texts(spark, nodes) == texts
    names = [p + f"<ul id={'x' * 20_000}></ul>" for p in pages]
    monkeypatch.setattr(wrapper_html, "LOT_TIMES", 0)
    monkeypatch.setattr(wrapper_html, "LOT_CHARS", 50_000)  # some pages a lot
    assert host_texts(spark, names) == texts  # held by the workers
    monkeypatch.setattr(wrapper_html, "HELD_CHARS", 0)
    assert host_texts(spark, names) == texts
    rows = [(j, f"http://{h}.example/{j}", p) for h, of in (("a", nodes), ("b", names), ("c", pages), ("d", nodes[:2])) for j, p in enumerate(of)]
    got = wrapper_html.main_texts(spark.createDataFrame([*rows, (99, None, None), (98, "http://a.example/", "")], "page_id bigint, url string, html string")).collect()
    told = Counter((r.url, r.text) for r in got)
    assert told == Counter([(u, texts[j]) for j, u, _ in rows if "d." not in u] + [("http://d.example/0", "Own 0\nmark\ntext 0"), ("http://d.example/1", "Own 1\nLine of all\nmark\ntext 1"), (None, ""), ("http://a.example/", "")])


def test_op8_template_goes_and_slots_stay(spark):
    page = "<html><body><div class=x>Site {h}</div><div class=y>Body of page {i}</div><div class=z>Last words {h}</div></body></html>"
    rows = [(i, f"http://{h}.example/{i}", page.format(h=h, i=i)) for h in ("a", "b") for i in range(20)] + [(50, None, None), (51, "http://a.example/x", ""), (52, "http://c.example", page.format(h="c", i=1))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, text int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in wrapper_html.main_texts(pages).collect()}
    assert got[3, "http://a.example/3"] == ("Body of page 3", 14) and got[7, "http://b.example/7"][0] == "Body of page 7"
    assert got[50, None] == ("", 0) and got[51, "http://a.example/x"] == ("", 0)
    assert got[52, "http://c.example"][0] == "Site c\nBody of page 1\nLast words c"  # too few pages to tell template from text
    assert wrapper_html.main_texts(pages.limit(0)).count() == 0


def test_op8_every_page_is_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html

    found = {r.page_id: r.text for r in wrapper_html.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert found[r.page_id] == "\n".join(b for b in blocks if b)


def host_texts(spark, pages):
    """Texts of pages of one host by the aggregates, held against the wrapper of the pages in memory."""
    rows = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrapper_html.main_texts(rows).collect()}
    assert [got[i] for i in range(len(pages))] == by_wrapper(pages)
    return [got[i] for i in range(len(pages))]


def test_op8_template_of_every_page_and_layout(spark):
    a, b = "<div class=a><p>Site</p><p>Alpha {i}</p></div>", "<div class=b><p>Minor site</p><p>Beta {i}</p></div>"
    same, other = "<div><p>Site</p></div><div>One {i}</div>", "<section></section><div><p>Other</p></div><div>Two {i}</div>"
    assert host_texts(spark, [a.format(i=i) for i in range(3)]) == [f"Alpha {i}" for i in range(3)]  # no page may miss
    assert host_texts(spark, [a.format(i=i) for i in range(30)] + [b.format(i=i) for i in range(4)])[30:] == [f"Beta {i}" for i in range(4)]
    got = host_texts(spark, [same.format(i=i) for i in range(12)] + [other.format(i=i) for i in range(8)])  # one path, two layouts
    assert got == [f"One {i}" for i in range(12)] + [f"Two {i}" for i in range(8)]
    deep = "<div>" * 300 + "<p>Far down</p><p>Text {i}"
    assert host_texts(spark, [deep.format(i=i) for i in range(4)]) == [f"Text {i}" for i in range(4)]


def test_op8_template_inside_articles_goes_and_repeated_articles_stay(spark):
    words = lambda i: " ".join(f"own{i}x{j}" for j in range(12))
    page = "<nav>{i}</nav><main><article><h1>Title {i}</h1><p>{text}</p><p>Read more of us</p></article></main>"
    assert host_texts(spark, [page.format(i=i, text=words(i)) for i in range(5)]) == [f"Title {i}\n{words(i)}" for i in range(5)]
    again = [f"<div>{i}</div><article><p>{words(0)}</p><p>{words(1)}</p></article>" for i in range(9)]
    assert host_texts(spark, again) == [f"{words(0)}\n{words(1)}"] * 9
    near = [f"<article><p>{words(0)}</p><p>{words(1)}</p><p>Copy {i}</p></article>" for i in range(9)]
    assert host_texts(spark, near) == [f"{words(0)}\n{words(1)}\nCopy {i}" for i in range(9)]


def brute_fp(text, k=3):
    w = split(ascii_lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, most):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_op9_edges(edges, empty):
    got = simhash_ring.digest(edges).collect()
    rows = edges.collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{brute_fp(r.text):016x}") for r in rows)
    expected = classes({r.doc_id: brute_fp(r.text) for r in rows if r.doc_id}, 2)
    assert all(r.component_id == expected[r.doc_id] for r in got if r.doc_id)
    assert simhash_ring.digest(empty).count() == 0


@pytest.mark.parametrize(("most", "segments"), [(2, 7), (3, 7), (2, 5), (1, 4)])
def test_op9_links_even_in_crowds(spark, monkeypatch, most, segments):
    monkeypatch.setattr(simhash_ring, "CROWD", 3)
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(15):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    nodes = dict(enumerate(sorted(fps)))
    rows = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes.items()], "node bigint, fp bigint")
    got = {tuple(r) for r in simhash_ring.ring_links(rows, most, segments).collect()}
    assert got == {(i, j) for i in nodes for j in nodes if i < j and (nodes[i] ^ nodes[j]).bit_count() <= most}


def families(rng, n, copies, words):
    """Texts of n families: one of random words, and copies with some words replaced, swapped or left out."""
    out = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, words, int(rng.integers(0, 8))).tolist():
                own[at] = [f"n{rng.integers(0, 9999)}", own[at].upper(), ""][int(rng.integers(0, 3))]
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("crowd", "hubs"), [(64, 16), (3, 1)])
def test_op9_near_copies_are_components_of_all_pairs(spark, monkeypatch, crowd, hubs):
    rng = np.random.default_rng(8)
    texts = families(rng, 6, 20, 150) + families(rng, 30, 2, 120) + ["", None, "  ", "one two", "ONE two", "one two three four five six"]
    sketches = [simhash_ring.sketch((t or "").encode()) for t in texts]
    lanes, keys = np.array([a for a, _ in sketches]), [set(k.tolist()) for _, k in sketches]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        apart = np.unpackbits((lanes[:i] ^ lanes[i]).view(np.uint8).reshape(i, 32), axis=1).sum(1) if i else []
        for j in range(i):
            if apart[j] == 0 or (apart[j] <= 40 and keys[i] & keys[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[3], 0)], "doc_id bigint, text string, f0 int")
    monkeypatch.setattr(simhash_ring, "key_links", partial(simhash_ring.key_links, crowd=crowd, hubs=hubs))
    got = simhash_ring.near_copies(docs).collect()
    assert len(got) == len(texts) + 2 and [r.component_id for r in got if r.doc_id is None] == [root(3)]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: root(i) for i in range(len(texts))}
    assert simhash_ring.near_copies(docs.limit(0)).count() == 0


def test_op9_near_copies_recall(spark):
    """Of pairs of texts whose sets of five-word shingles are similar to 0.8 or more, by comparing all pairs."""
    rng = np.random.default_rng(9)
    texts = families(rng, 40, 6, 200)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (split(ascii_lower(t)) for t in texts)]
    similar = [len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(len(texts)) for j in range(i)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    got = dict(simhash_ring.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    near = [got[i] == got[j] for (i, j), s in zip(pairs, similar, strict=True) if s >= 0.8]
    assert len(near) > 100 and sum(near) >= 0.95 * len(near)
    assert not any(got[i] == got[j] for (i, j), s in zip(pairs, similar, strict=True) if s < 0.2)


def test_op9_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 105)], "a bigint, b bigint")
    got = {r.node: r.label for r in simhash_ring.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 105: 100}


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    places = [(i, label) for phrase, label in license_fuzzy.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [p for p, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_op10_base(edges, empty, spark):
    for docs in (edges, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        got = license_fuzzy.digest(docs).collect()
        assert Counter(tuple(r)[:6] for r in got) == Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_fuzzy.digest(empty).count() == 0


def test_op10_long_texts_of_many_places():
    s = license_fuzzy.Scanner()
    start = time.perf_counter()
    n_words, n_base, first, last, base, _, score, spans = s.scan("é MIT License, " * 100_000 + "released under the mit licence " * 2_000)
    assert (n_words, n_base, first, last, base, score) == (310_000, 100_000, 1, 299_998, "mit", 1.0)
    assert [x[1] for x in spans] == [300_000 + 5 * i for i in range(2_000)] and all(x[2] == x[1] + 5 and x[3] == 1 for x in spans)
    assert time.perf_counter() - start < 60


def edited(rng, notice, edits):
    x = list(notice)
    for at in sorted(rng.choice(len(x), edits, replace=False).tolist(), reverse=True):
        x[at : at + 1] = [[], ["q"], [x[at], "q"]][int(rng.integers(3))]
    return "".join(x)


def test_op10_against_whole_texts_without_seeds():
    """Random texts with edited notices, some right behind each other: the whole text searched by the regex library alone."""
    s = license_fuzzy.Scanner()
    rng = np.random.default_rng(12)
    notices = list(license_fuzzy.NOTICES)
    planted = 0
    for _ in range(60):
        words = [f"{'xyzuvw'[int(rng.integers(6))] * int(rng.integers(1, 4))}{rng.integers(99)}" for _ in range(120)]
        for _ in range(3):
            n = int(rng.integers(len(notices)))
            at = int(rng.integers(len(words)))
            words[at:at] = [edited(rng, notices[n], int(rng.integers(license_fuzzy.edits_for(notices[n]) + 1))) for _ in range(int(rng.integers(1, 3)))]
        text = " " + " ".join(" ".join(words).split()) + " "
        spans = s.scan(text)[-1]
        for n, notice in enumerate(notices):
            label, _, k, pattern = s.notices[n]
            whole = sorted(s.best(text, n, 0, len(text)))
            near = []
            for end, (size, uses) in s.automaton.iter(text):
                near += [(end - size + 1 - at, at) for m, at in uses if m == n]
            got = s.verify(text, n, near)
            starts = [text.count(" ", 0, a + 1) - 1 for a, _ in whole]
            assert [(x[1], x[3]) for x in got] == [(w, sum(pattern.fullmatch(text, a, b).fuzzy_counts)) for w, (a, b) in zip(starts, whole, strict=True)], (notice, text)
            assert all(x[0] == label and x[3] <= k for x in got) and all(x in spans for x in got)
            planted += len(whole)
    assert planted > 150


def test_op10_edits_are_found():
    s = license_fuzzy.Scanner()
    for notice, label in license_fuzzy.NOTICES.items():
        rng = np.random.default_rng(len(notice))
        for edits in range(license_fuzzy.edits_for(notice) + 1):
            x = list(notice)
            for at in sorted(rng.choice(len(x), edits, replace=False).tolist(), reverse=True):
                kind = rng.integers(3)
                x[at : at + 1] = [[], ["q"], [x[at], "q"]][kind]
            if "  " in "".join(x):  # a word is gone, and with it a blank: one edit more
                continue
            _, _, _, _, _, labels, _, spans = s.scan(f"before words é {''.join(x)} after")
            assert label in labels.split(","), (notice, edits)
            assert any(sp[0] == label and sp[3] <= edits for sp in spans)
    assert s.scan("nothing of the kind in this text")[5:7] == ("", 0.0)
