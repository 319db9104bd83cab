"""The near-dedup stage against brute-force groups by the Jaccard similarity of five-word shingles."""

import random

import pytest

import corpus_pipeline
from modelbom.llm import near_copies
from modelbom.llm.common import store, store_small
from modelbom.llm.near_copies import Rule, one_of_each


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """doc_ids that stay of (doc_id, text) rows."""
    rows = sorted(rows)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(rows[r][0] for r in {find(i) for i in range(len(rows))})


def planted():
    """Chains of edited texts, of one line each: links of 0.8 and more, and near misses below."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(4000)}"
    rows = []
    for n in (6, 9, 30, 60, 150, 400):
        for edits in (1, 2, 3, 4, 8):
            text = [word() for _ in range(n)]
            for _ in range(4):
                rows.append((len(rows), " ".join(text)))
                text = list(text)
                for at in rnd.sample(range(n), min(n, max(1, edits * n // 200))):
                    text[at] = word()
    common = [word() for _ in range(60)]
    rows += [(len(rows) + k, " ".join([*common, *(word() for _ in range(k))])) for k in range(40)]
    return rows + [(9000, ""), (9001, " "), (9002, "one"), (9003, "ONE"), (9004, "a b c d"), (9005, "a b c d e")]


@pytest.mark.parametrize("rows", ["planted", "table"])
def test_groups(spark, rows):
    if rows == "planted":
        docs = spark.createDataFrame(planted(), "doc_id long, text string")
    else:
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    have = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = plain_kept(have)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == want
    assert len(want) < len(have)


def test_odd_rows(odd_docs, no_docs):
    assert 0 < one_of_each(odd_docs).count() < odd_docs.count()
    assert one_of_each(no_docs).count() == 0


def near_misses(n, rnd):
    """Texts of 57 shingles of which any two share 50: a similarity of 0.78, just below the bound."""
    word = lambda: f"x{rnd.randrange(10**9)}"
    common = [word() for _ in range(54)]
    return [" ".join([word(), *common, *(word() for _ in range(6))]) for _ in range(n)]


def test_near_misses_make_no_pairs(spark, monkeypatch):
    """400 texts just below the bound: all stay, and no stored result has the rows of their pairs (79,800)."""
    rnd, made = random.Random(9), {}

    def counted(df, name):
        out = store(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "store", counted)
    monkeypatch.setattr(near_copies, "store_small", counted)
    texts = near_misses(400, rnd) + near_misses(1, rnd) * 3
    sets = [shingle_set(t) for t in texts]
    assert sum(0.7 < len(sets[0] & s) / len(sets[0] | s) < 0.8 for s in sets[1:400]) > 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert one_of_each(docs).count() == 401
    assert made["pairs"] <= made["buckets"] <= 50 * 401 and made["open"] <= made["buckets"]


@pytest.mark.parametrize("rule", [Rule(block=3), Rule(block=7, block_shingles=200), Rule()])
def test_blocks(spark, rule):
    """Buckets in blocks of any size give the same groups."""
    rows = planted()
    rnd = random.Random(4)
    rows += [(5000 + k, t) for k, t in enumerate(near_misses(30, rnd))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in one_of_each(docs, rule=rule).collect()) == plain_kept(rows)


def test_batches_are_bounded_by_bytes(spark, tmp_path):
    """Rows of large binaries come to a worker in batches of some MB; the session's setting is as before afterwards."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    rows = spark.range(0, 600, 1, 1).selectExpr("cast(repeat('x', 20000) as binary) b")
    got = [r["n"] for r in store_small(rows.mapInArrow(sizes, "n long"), "sizes", 1 << 20).collect()]
    assert sum(got) > 12_000_000 and max(got) < 1_200_000 and spark.conf.get(key) == before


def at_similarity(n, fresh, rnd):
    """Two sets' texts of about n shingles: the second has ``fresh`` words anew at its end."""
    word = lambda: f"y{rnd.randrange(10**9)}"
    text = [word() for _ in range(n + 4)]
    return " ".join(text), " ".join([*text[: n + 4 - fresh], *(word() for _ in range(fresh))])


@pytest.mark.parametrize(("changed", "least"), [(1 / 9, 0.9), (0.05, 0.99)])
def test_golay_keys_alone_find_near_copies(spark, changed, least):
    """The Golay keys of SimHash fingerprints, without the MinHash bands, find 0.9 of the pairs at a similarity of 0.8."""
    rnd = random.Random(11)
    pairs = [at_similarity(n, int(n * changed), rnd) for n in (45, 90, 180, 360) for _ in range(150)]
    similar = [len(a & b) / len(a | b) for a, b in (map(shingle_set, p) for p in pairs)]
    assert min(similar) >= 0.8 and max(similar) < (0.82 if changed > 0.1 else 0.93)
    docs = spark.createDataFrame(list(enumerate(t for p in pairs for t in p)), "doc_id long, text string")
    _, rows, nodes = near_copies._printed(docs, "text", Rule())
    node = {r["doc_id"]: r["node"] for r in rows.collect()}
    found = {(r["a"], r["b"]) for r in near_copies.code_pairs(nodes, Rule()).collect()}
    hits = {tuple(sorted((node[2 * k], node[2 * k + 1]))) for k in range(len(pairs))} & found
    assert len(hits) >= least * len(pairs)
    assert len(found) < 2 * len(pairs)  # unrelated texts are no candidates


def test_fingerprints_are_majorities():
    """Each bit is 1 if it is set in over half the hashes of the set, also of more than 255."""
    import numpy as np

    sets = [np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) for n in (1, 2, 255, 256, 1000, 7)]
    whole = near_copies.fingerprints(sets, 2)
    for s, got in zip(sets, whole):
        for f in range(2):
            seed = near_copies._mix(np.array([f + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = near_copies._mix(s ^ seed)
            # Counters are bytes: bit k of byte j stands at place 8 * k + j.
            want = [2 * int((x >> np.uint64(8 * j + k) & np.uint64(1)).sum()) > len(s) for k in range(8) for j in range(8)]
            assert list(got[64 * f : 64 * f + 64]) == want


@pytest.mark.parametrize("few", [1, 16])
def test_golay_pairs_of_large_buckets(spark, few):
    """A large group of near copies gives a spanning forest, and all of it is one group by the Golay keys alone."""
    rnd = random.Random(12)
    word = lambda: f"z{rnd.randrange(10**9)}"
    text = [word() for _ in range(300)]
    texts = [" ".join([*text, word()]) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = Rule(few=few)
    _, rows, nodes = near_copies._printed(docs, "text", rule)
    pairs = near_copies.code_pairs(nodes, rule)
    from modelbom.llm.common import components

    assert components(pairs).select("node").distinct().count() == 200 == rows.count()
    assert components(pairs).select("root").distinct().count() == 1
    assert pairs.count() < 200 * 30 and pairs.where("a >= b").count() == 0
