"""Alignment against a plain version: token bytes, common offsets, overlaps and corpus-wide counts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from modelbom.llm import alignment
from modelbom.llm.alignment import Aligner, bisected, common_ends, link_counts, overlaps, token_groups
from modelbom.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), back


def plain_tokens(tools, text):
    """Ids and byte strings of both sides, or None."""
    a, b, back = tools
    if not text:
        return None
    got = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(back[c] for c in t) for t in got.tokens]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    raw = (" " + text).encode()
    return (got.ids, bytes_a, ids_b, bytes_b) if b"".join(bytes_a) == raw == b"".join(bytes_b) else None


def plain_groups(ids_a, bytes_a, ids_b, bytes_b):
    groups, i, j = [], 0, 0
    while i < len(ids_a):
        x, y, a, b = len(bytes_a[i]), len(bytes_b[j]), [ids_a[i]], [ids_b[j]]
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                x, i = x + len(bytes_a[i]), i + 1
                a.append(ids_a[i - 1])
            else:
                y, j = y + len(bytes_b[j]), j + 1
                b.append(ids_b[j - 1])
        groups.append((a, b))
    return groups


def plain_links(ids_a, bytes_a, ids_b, bytes_b):
    spans = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, out = 0, []
        for t, p in zip(ids, parts):
            out.append((at, at := at + len(p), t))
        spans.append(out)
    links, j = [], 0
    for s, e, a in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((a, spans[1][k][2]))
            k += 1
    return links


def plain(tools, rows):
    known = [(d, t and plain_tokens(tools, t)) for d, t in rows]
    links = [plain_links(*k) if k else [] for _, k in known]
    count = Counter(x for ls in links for x in ls)
    most = defaultdict(int)
    for (_, b), c in count.items():
        most[b] = max(most[b], c)
    out = []
    for (d, k), ls in zip(known, links):
        if not k:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = plain_groups(*k)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(count[x] == most[x[1]] for x in ls)
        out.append((d, len(k[0]), len(k[2]), len(groups), len(ls), best, sum(count[x] for x in ls), hashlib.sha256(text.encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  ", "a", "a  b", "a\n  b\n", " lead", "trail ", "tab\tx\r\ny;\r\n", "ﬁ ligature", "a\xa0b", "　x  y", "<s> </s> <unk>", "<|endoftext|> <0x41>",
    "▁x", "x ▁ y", "é é ñandú Übergrößenträger", "😀👩‍👩‍👧 x", " z w", "\x00n \x1c q", "中文字符測試 日本語テキスト", "ᚠᛇᚻ ᛒᛦᚦ", "q" * 950, "0123456789" * 30,
    "don't you're it's", "    indented\n        more", "a" * 5000 + " b", "퟿", "word " * 400,
]


def rows_of(got):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in names) for r in got), key=str)


def test_table(spark, sf_dir, tools):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(tools, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows_of(link_counts(docs, A, B).collect()) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1 << 21, 40])
def test_odd_texts(spark, tools, monkeypatch, size):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab é\n😀中 .'1\t") for _ in range(rnd.randrange(1, 300))) for _ in range(40)]
    al = Aligner(A, B)
    monkeypatch.setattr(alignment, "SLICE", size)  # a small one cuts texts into parts
    for t in texts:
        want = plain_tokens(tools, t)
        parts = al.align(list(al.segments(t))) if t else []
        if want is None:
            assert not parts or None in parts
            continue
        assert sum([p["a"].tolist() for p in parts], []) == want[0] and sum([p["b"].tolist() for p in parts], []) == want[2], t
        groups = plain_groups(*want)
        assert b";".join(al.text(p) for p in parts).decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        links = Counter()
        for p in parts:
            links.update({divmod(int(x), al.b.size): int(c) for x, c in zip(p["pairs"], p["counts"])})
        assert links == Counter(plain_links(*want))


def test_odd_rows(spark, tools, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + [(None, t) for t in ODD] + [(7, ODD[9])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row_key", "pairs", "counts", "pair", "n", "b", "c", "best"):
        docs = docs.withColumn(c, docs["doc_id"])
    assert rows_of(link_counts(docs, A, B).collect()) == sorted(plain(tools, rows), key=str)
    assert link_counts(no_docs, A, B).count() == 0
    for r in token_groups(docs.where("text is not null").limit(60), A, B).collect():
        assert len(r["a_ends"]) == len(r["b_ends"]) and (r["a_ends"] or [0])[-1] == len(r["a_ids"]) and (r["b_ends"] or [0])[-1] == len(r["b_ids"])


def test_divide():
    rnd = np.random.default_rng(1)
    for n in range(300):
        span = int(rnd.integers(1, 400))
        ends = [np.unique(np.append(rnd.integers(1, span + 1, int(rnd.integers(0, span + 1))), span)) for _ in range(2)]
        if n % 3 == 0:  # one long interval without a cut
            ends = [np.append(np.arange(2, 2 * span, 2), 2 * span), np.append(np.arange(1, 2 * span, 2), 2 * span)]
        at = bisected(*ends)
        i, j = common_ends(*ends, at, [len(ends[0])], [len(ends[1])])
        assert ends[0][i].tolist() == ends[1][j].tolist() == np.intersect1d(*ends).tolist()
        a, b = overlaps(*ends, at)
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = [(x, y) for x in range(len(ends[0])) for y in range(len(ends[1])) if starts[0][x] < ends[1][y] and starts[1][y] < ends[0][x]]
        assert list(zip(a.tolist(), b.tolist())) == want
