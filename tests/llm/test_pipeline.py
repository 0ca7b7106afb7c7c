"""Stages of the corpus pipeline on edge cases, planted documents and against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tidelock.llm import line_rules, nbsvm, simhash_ring


def planted(spark):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are folded in lines
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n)).translate(letters)
    rows = [(i, f"{own(i, 60)}.", "en", "s", 1) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, "short", "en", "s", 1), (102, f"{own(102, 40)} {' '.join(f'b{j}' for j in range(20))}", "en", "s", 1), (103, "loop the same words again and now " * 10, "en", "s", 1)]
    rows += [(104, None, None, None, None), (105, "", "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark, tmp_path):
    docs = planted(spark)
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(20)))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "benchmark_passages", "packing"]
    kept, sizes = docs, []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns
        kept = out
        sizes.append({r.doc_id for r in kept.select("doc_id").collect()})
    clean = set(range(30))
    assert sizes == [clean | {100, 102}, clean | {100, 102}, clean | {102}, clean]
    packed = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == clean


def test_stages_on_edges_and_nothing(spark, edges, empty, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "same text here for two"), (None, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (edges, empty):
        for _, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            if docs is empty:
                assert rows == []
            elif "ids_crc32" not in out.columns:
                assert out.columns == docs.columns and not Counter(map(str, rows)) - Counter(map(str, docs.collect()))  # rows as they came
            else:
                assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    once = cp.near_duplicates(spark, edges, str(tmp_path)).groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    assert once.count() == 0


SF = "/root/testdata/sf0.001"


def words_by(pattern, text):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frequent(rows, limit, share):
    """(host, line) above the limits, over the different texts of a host; lines with their words, as the rules fold them."""
    texts, counts = defaultdict(set), Counter()
    for r in rows:
        texts[r.source or ""].add(r.text or "")
    for host, found in texts.items():
        for t in found:
            counts.update((host, x) for x in set(folded(t)))
    return {k for k, n in counts.items() if n > limit and 1000 * n > share * len(texts[k[0]])}


def folded(text):
    out = (re.sub("[0-9]+", "0", re.sub(r"[ \t\x0b\x0c\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), x))).strip(" ") for x in (text or "").split("\n"))
    return [x for x in out if x]


def brute_kept(rows):
    above = frequent(rows, line_rules.LINE_LIMIT, line_rules.LINE_SHARE)
    kept = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        removed = sum(len(x.split(" ")) for x in folded(r.text) if (r.source or "", x) in above)
        if len(w) >= 20 and 100 * len(hit) <= 30 * len(w) and 100 * removed <= 70 * len(w):
            kept.append(r.doc_id)
    return kept


def test_stages_against_brute_force(spark):
    """Each filtering stage on all documents of the smallest tables, and lines shared by many documents of one host, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n)).translate(letters)
    shared = [(10**6 + i, "\n".join([*(f"{c} {i} of  the {c} site with {c} words" for c in ("Menu", "HOME", "links", "about")), own(i, 8 + i % 30)]), "en", "menus", 1) for i in range(45)]
    docs = docs.unionByName(spark.createDataFrame(shared, docs.schema))
    rows = docs.collect()
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = brute_kept(rows)
    assert ids(cp.quality_rules(spark, docs, SF)) == Counter(kept) and len(kept) < len(rows)
    assert 0 < sum(i >= 10**6 for i in kept) < 45

    model = nbsvm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r.doc_id for r in rows if model.score(nbsvm.features(r.text)) >= nbsvm.THRESHOLD]
    assert ids(cp.quality_classifier(spark, docs, SF)) == Counter(good)

    sketches = {r.doc_id: simhash_ring.sketch((r.text or "").encode()) for r in rows}
    group = {i: i for i in sketches}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    order = sorted(sketches)
    for n, i in enumerate(order):
        for j in order[:n]:
            (a, p), (b, q) = sketches[i], sketches[j]
            apart = sum(int(x).bit_count() for x in a ^ b)
            if apart == 0 or (apart <= simhash_ring.WIDE_DIFFER and set(p.tolist()) & set(q.tolist())):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    assert ids(cp.near_duplicates(spark, docs, SF)) == Counter({i: 1 for i in order if root(i) == i})

    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for item in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words_by(word, item.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = []
    for r in rows:
        w = words_by(word, r.text)
        if not any(tuple(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1)):
            clean.append(r.doc_id)
    assert ids(cp.benchmark_passages(spark, docs, SF)) == Counter(clean) and len(clean) < len(rows)
