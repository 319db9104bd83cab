"""Repeated passages on one line, two lines and more, and repeated documents, against a plain version of the rule."""

import random

import pytest

from modelbom.llm.line_dedup import CHARS, RUN, fingerprints, line_dedup


def plain(rows):
    """{doc_id: removed line numbers} of (doc_id, text) rows with different doc_ids."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for i in range(len(lines)):
            n = next((k for k in range(1, RUN + 1) if i + k <= len(lines) and (k == RUN or sum(len(x) for _, x in lines[i : i + k]) >= CHARS)), None)
            if n:
                key = tuple(x for _, x in lines[i : i + n])
                gone |= set(range(i, i + n)) if key in seen else set()
                seen.add(key)
        if 0 < len(lines) < RUN:
            key = ("whole", *(x for _, x in lines))
            gone |= set(range(len(lines))) if key in seen else set()
            seen.add(key)
        out[d] = sorted(lines[i][0] for i in gone)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    one, two, three = [words(60)], [words(32), words(30)], [words(4), words(3), words(5)]
    docs = []
    for k in range(60):
        lines = [words(rnd.randrange(1, 25)) for _ in range(rnd.randrange(1, 6))]
        at = rnd.randrange(len(lines) + 1)
        lines[at:at] = rnd.choice([[], one, two, three, ["", " \t"], two[:1], three[:2]])
        docs.append((k, "\n".join(lines)))
    docs += [(60, "short copy"), (61, "short copy"), (62, "a\nb"), (63, "a\n\nb"), (64, "a\nb\nc"), (65, ""), (66, None), (67, "\n"), (68, "\n".join(two * 3))]
    return docs, (one, two, three)


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    docs, planted = corpus(seed)
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["removed"] for d, r in got.items()} == plain(docs)
    for passage in planted:  # one place of each is left
        whole = "\n".join(passage)
        holds = [d for d, t in docs if f"\n{whole}\n" in f"\n{t}\n"]
        assert len(holds) > 3 and sum(f"\n{whole}\n" in f"\n{got[d]['text']}\n" for d in holds) == 1
    assert got[61]["text"] == "" and got[60]["text"] == "short copy" and got[63]["removed"] == [0, 2] and got[64]["removed"] == []


def test_picks_are_fewer_than_windows_and_guaranteed(spark):
    rnd = random.Random(1)
    lines = [f"line {rnd.randrange(10**9)}" for _ in range(600)]
    docs = spark.createDataFrame([(1, b"x", "\n".join(lines)), (2, b"y", "\n".join(["other", *lines[200:203], "end"]))], "doc_id long, digest binary, text string")
    picks = fingerprints(docs).collect()
    first = {r["pick"]: r["fp"] for r in picks if r["doc_id"] == 1}
    assert 200 < len(first) < 400 and all(any(k in first for k in range(i, i + RUN)) for i in range(598))
    assert {r["fp"] for r in picks if r["doc_id"] == 2} & {first[k] for k in (200, 201, 202) if k in first}


def test_very_long_text(spark):
    """100,000 lines of which every tenth run of three repeats."""
    block = ["same a", "same b", "same c"]
    lines = [x for k in range(10_000) for x in (*block, *(f"own {k} {j}" for j in range(7)))]
    (r,) = line_dedup(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert r["n_lines"] == 100_000 and r["n_removed"] == 3 * 9_999
