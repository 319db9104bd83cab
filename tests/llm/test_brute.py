"""Operators that SQL cannot say, against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from modelbom.llm import decontaminate as dc
from modelbom.llm.classifier import classify
from modelbom.llm.packing import pack
from modelbom.llm.pii import ALPHABETS, PATTERNS, pseudonymise
from modelbom.llm.queries import PII_KEY, QUERIES, tokenizer_path
from modelbom.llm.resharding import min_cost_flow, resharded
from modelbom.llm.simhash import forest, golay, keys, simhash_groups
from modelbom.llm.suffix_dedup import multikey_quicksort, remove_repeats

# --- 1


def test_decontaminate(spark, sf_dir, odd_docs, no_docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rnd = random.Random(2)
    known = [(r["item_id"], dc.words_of(r["text"])) for r in items.collect()]
    vocabulary = [w for _, ws in known for w in ws]
    rows = []
    for n, (_, ws) in enumerate(known * 6):
        for share in (0, 0.08, 0.15):
            out = list(ws)
            for _ in range(int(share * len(ws))):
                at = rnd.randrange(len(out))
                out[at : at + rnd.randrange(2)] = [rnd.choice(vocabulary)] * rnd.randrange(2)
            pad = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
            rows.append((1000 + 3 * n + len(rows), " ".join(pad(30) + out + pad(30)).title()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text")).withColumn("words", F.lit(1))
    more = [(900, None), (901, ""), (None, "a passage under no id that is long enough to find it again"), (902, known[0][1][0]), (903, " ".join(known[1][1]).upper())]
    items = items.unionByName(spark.createDataFrame(more, "item_id long, text string")).withColumn("cls", F.lit("clash"))
    want = {}
    for r in docs.collect():
        for i, ws in known + [(None, dc.words_of(more[2][1])), (902, dc.words_of(more[3][1]))]:
            if words := dc.words_of(r["text"]):
                if hit := dc.nearest_window(ws, words, int(0.15 * len(ws))):
                    want[r["doc_id"], i] = min(hit[0], want.get((r["doc_id"], i), 99))
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in dc.contaminated(docs, items).collect()}
    assert got.items() <= want.items()
    assert len(got) >= 0.9 * len(want) and len(want) > 600
    assert {k for k, e in want.items() if e == 0} <= set(got)
    clean = {r["doc_id"] for r in dc.decontaminate(docs, items).collect()}
    assert not clean & {k for k, _ in got if k is not None} and len(clean) > 40
    assert dc.contaminated(no_docs, items).count() == 0
    assert dc.contaminated(docs, items.where("item_id < -1")).count() == 0


def test_nearest_window():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(1, n))] for n in (7, 12))
        best = min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        edits, start, end = dc.nearest_window(a, b, 99)
        assert edits == best == plain(a, b[start:end])


# --- 4


def feistel(text, kind, alphabets=ALPHABETS, rounds=8):
    cut = -(-len(text) // 2)
    half = [list(text[:cut]), list(text[cut:])]
    for n in range(rounds):
        own, other = (0, 1) if n % 2 == 0 else (1, 0)
        stream = hashlib.sha256(f"{PII_KEY}|{kind}|{n}|{''.join(half[other])}".encode()).digest()
        for i, c in enumerate(half[own]):
            for a in alphabets:
                if c in a:
                    half[own][i] = a[(a.index(c) + stream[i % 32]) % len(a)]
    return "".join(half[0] + half[1])


def luhn(digits):
    return sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, digits[::-1]))) % 10


def test_pseudonyms(spark):
    texts = {
        "mail to jean.42@mail7.example.com, now": None, "card 4845168114407329 and 4845 1681 1440 7329!": None,
        "not a card 9807915762804491": "same", "on 2024-02-29 or 2023-02-29": None, "31.12.1999 and 31/12/1999 and 31.02.1999": None,
        "host 97.51.17.173 or 300.1.1.1": None, "call +1 (974) 555-3436 190.137.223.204": None, "ssn 123-45-6789 and 000-45-6789": None,
        "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"": None, "DE89 3704 0044 0532 0130 00 and DE88370400440532013000": None,
        "nothing 4.0 here, 1999": "same", "": "same", "again jean.42@mail7.example.com": None, "mailto:élan.7@b.org 4845168114407329": None,
    }
    rows = [(k if k else None, t) for k, t in enumerate([*texts, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"found": F.lit(1), "made": F.lit(2)})
    got = pseudonymise(docs, PII_KEY).collect()
    assert len(got) == len(rows)
    by = dict(zip([*texts, None], got))
    assert by[None]["text"] is None and by[None]["n_found"] == 0
    for t, way in texts.items():
        out = by[t]["text"]
        assert len(out) == len(t) if "ssn" not in t else True
        assert (out == t) == (way == "same"), (t, out)
    mail = feistel("jean.42", "email") + "@mail7.example.com"
    assert by["mail to jean.42@mail7.example.com, now"]["text"] == f"mail to {mail}, now"
    assert by["again jean.42@mail7.example.com"]["text"] == f"again {mail}"
    body = feistel("484516811440732", "card", ALPHABETS[:1])
    card = body + str(-luhn(body + "0") % 10)
    assert luhn(card) == 0
    spaced = " ".join(card[k : k + 4] for k in range(0, 16, 4))
    assert by["card 4845168114407329 and 4845 1681 1440 7329!"]["text"] == f"card {card} and {spaced}!"
    assert by["mailto:élan.7@b.org 4845168114407329"]["text"].endswith(card)
    assert by["on 2024-02-29 or 2023-02-29"]["text"].endswith(" or 2023-02-29")
    dotted = by["31.12.1999 and 31/12/1999 and 31.02.1999"]["text"].split(" and ")
    assert dotted[0].replace(".", "/") == dotted[1] != "31/12/1999" and dotted[2] == "31.02.1999"
    assert by["host 97.51.17.173 or 300.1.1.1"]["text"].endswith(" or 300.1.1.1")
    phone = by["call +1 (974) 555-3436 190.137.223.204"]["text"]
    assert phone.startswith("call +1 (") and not phone.endswith("190.137.223.204")
    assert by["ssn 123-45-6789 and 000-45-6789"]["text"].endswith(" and 000-45-6789")
    iban = by["DE89 3704 0044 0532 0130 00 and DE88370400440532013000"]["text"].split(" and ")
    plain = iban[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and iban[1] == "DE88370400440532013000"


def test_number_permutation_is_one_to_one(spark):
    from modelbom.llm.pii import permute_number

    ids = spark.range(0, 189 * 773).select(permute_number(F.col("id"), (189, 773), "k", "date").alias("x"))
    got = ids.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(got) == (189 * 773, 0, 189 * 773 - 1)


def test_pseudonyms_leave_no_value(spark, sf_dir, odd_docs, no_docs):
    import re

    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op4_pii"](spark, sf_dir).collect():
        for kind in ("email", "phone", "token"):
            for m in re.finditer(PATTERNS[kind].replace(r"\p{L}\p{N}", r"\w").replace("}+@", "}@"), before[r["doc_id"]]):
                assert m[0] not in r["text"]
    assert pseudonymise(odd_docs, "k").count() == odd_docs.count()
    assert pseudonymise(no_docs, "k").count() == 0


# --- 6


def test_flow():
    rnd = random.Random(8)
    for _ in range(100):
        n = rnd.randrange(1, 6)
        supply = [rnd.randrange(50) for _ in range(n)]
        m = rnd.randrange(1, 7)
        total = sum(supply)
        room = [total * (j + 1) // m - total * j // m for j in range(m)]
        flow = min_cost_flow(supply, room, lambda i, j: int(i != j))
        assert [sum(f) for f in flow] == supply
        assert all(sum(f[j] for f in flow) <= room[j] for j in range(m))
        stay = sum(flow[i][i] for i in range(min(n, m)))
        assert stay == sum(min(supply[i], room[i]) for i in range(min(n, m)))  # no more can stay


@pytest.mark.parametrize("rows", ["odd", "table", "none"])
def test_resharding(spark, sf_dir, odd_docs, no_docs, rows):
    docs = {"odd": odd_docs, "none": no_docs, "table": spark.read.parquet(f"{sf_dir}/documents.parquet")}[rows]
    got = resharded(docs, F.pmod(F.crc32(F.encode("source", "utf-8")), F.lit(6)), 8).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if got:
        most = max(r["size"] for r in got)
        assert all(abs(sizes[j] - sum(sizes.values()) / 8) <= 6 * most for j in range(8))


# --- 7


def test_classifier(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    labels = spark.createDataFrame([(k, k % 2, 7) for k in range(60)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, score int")
    odd = classify(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in classify(odd_docs, labels.where("doc_id < -1")).collect()} == {0.5}
    assert classify(no_docs, labels).count() == 0


# --- 8


@pytest.mark.parametrize("rows", ["odd", "table"])
def test_packing(spark, sf_dir, odd_docs, no_docs, rows):
    from tokenizers import Tokenizer

    docs = odd_docs if rows == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
    for doc, all_ids in texts.items():
        for ids in all_ids:
            for s in range(0, len(ids), 4096):
                raw = ids[s : s + 4096].tobytes()
                want[doc, s, len(raw) // 4, zlib.crc32(raw), len(ids)] += 1
    got = pack(docs, tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(no_docs, tokenizer_path()).count() == 0


def test_word_ids_are_the_tokenizers():
    from modelbom.llm.packing import WordIds

    ids = WordIds(tokenizer_path())
    rnd = random.Random(1)
    marks = "aAbBzé̈İßſKÅﬁŉ ½٣'’.,<|>endoftext\t\n\x0b\x1c\x85\xa0 漢字ひ😀!#_-Σςσ"
    odd = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    odd += ["<|endoftext|> a<|endoftext|>b", "don't we'LL it's", None, ""]
    assert list(ids.texts(odd)) == [ids.encode(t or "") for t in odd]


# --- 9


def plain_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield len(t), len(t) - len(kept), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("rows,group", [("odd", 100_000), ("odd", 1), ("table", 100_000)])
def test_suffixes(spark, sf_dir, odd_docs, no_docs, rows, group):
    docs = odd_docs if rows == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    have = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = Counter((d, *x) for (d, _), x in zip(have, plain_repeats([t for _, t in have], 200)))
    got = remove_repeats(docs, group=group).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    if rows == "odd" and group == 1:
        assert remove_repeats(no_docs).count() == 0


def test_repeats_twice_in_one_text_and_once_in_another(spark):
    """Places are hashes of 64 bits: the least and the largest of a text have to be those of the signed order of the aggregates."""
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    texts = []
    for _ in range(8):
        p = noise(3000)
        texts += [noise(90) + p + noise(70) + p + noise(50), noise(80) + p + noise(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(enumerate(plain_repeats([t.encode() for t in texts], 200)))
    got = remove_repeats(docs).collect()
    assert {(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got} == want


def test_multikey_quicksort():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        words = rnd.integers(0, 3, (rnd.integers(1, 80), 4)).astype(np.uint64)
        order, split = multikey_quicksort(words)
        rows = [tuple(r) for r in words[order]]
        assert rows == sorted(rows) and sorted(order) == list(range(len(words)))
        for k in range(1, len(rows)):
            assert split[k] == next((d for d in range(4) if rows[k][d] != rows[k - 1][d]), 4)


# --- 10


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("rows", ["odd", "table"])
def test_simhash(spark, sf_dir, odd_docs, no_docs, rows):
    docs = odd_docs if rows == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    have = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    roots = plain_groups([p for _, p in have])
    least = {}
    for (d, _), r in zip(have, roots):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = Counter((d, f"{p:016x}", least.get(r)) for (d, p), r in zip(have, roots))
    got = simhash_groups(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash_groups(no_docs).count() == 0


def test_golay_keys_and_forest():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    assert np.bincount(np.bitwise_count(golay().error)).tolist() == [1, 23, 253, 1771]
    mine = {(r, k) for r, k in zip(*(x.tolist() for x in keys(a)))}
    assert {r for r, k in zip(*(x.tolist() for x in keys(b))) if (r, k) in mine} == set(range(len(a)))
    near = np.unique(rng.integers(0, 1 << 10, 300).astype(np.uint64) * np.uint64(0x100401))
    roots, members = forest(near)
    linked = {(int(x), int(y)) for r, m in zip(roots, members) for x, y in zip(r, m)}
    got = {int(x): int(x) for x in near} | {y: x for x, y in linked}
    plain = plain_groups([int(x) for x in near])
    first = {}
    for x, r in zip(near, plain):
        first.setdefault(r, int(x))
    assert all(got[int(x)] == first[r] for x, r in zip(near, plain))
