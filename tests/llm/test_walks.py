"""The walks of decontamination by themselves, and phrases that many items and documents share."""

import random

import numpy as np
import pytest

from modelbom.llm import decontaminate as dc
from modelbom.llm.common import store


def edited(item, rnd):
    """The item with floor(0.15 n) edits at random places, of all kinds."""
    at = set(rnd.sample(range(len(item)), int(0.15 * len(item))))
    made = []
    for i, w in enumerate(item):
        made += [w] if i not in at else rnd.choice([[f"new{i}"], [], [f"new{i}", w]])
    return made


@pytest.mark.parametrize("lengths", [(3, 7, 14, 20, 33), (47, 59, 100), (200, 300)])
def test_recall_of_walks(spark, lengths):
    """At the most edits that count the walks alone find nine of ten items or more, of any length."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(3000)}"
    items, docs = [], []
    for k in range(150):
        item = [word() for _ in range(lengths[k % len(lengths)])]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([word() for _ in range(30)] + edited(item, rnd) + [word() for _ in range(30)])))
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    walks = dc.contaminated(*tables, dc.Search(whole_pieces=False)).collect()
    assert all(r["by_walk"] for r in walks)
    found = {r["doc_id"] for r in walks if r["doc_id"] == r["item_id"]}
    assert len(found) >= 0.9 * len(items)
    whole = dc.contaminated(*tables).collect()
    pairs = lambda rows: {(r["doc_id"], r["item_id"], r["n_edits"]) for r in rows}
    assert pairs(walks) <= pairs(whole) and {r["doc_id"] for r in whole if r["doc_id"] == r["item_id"]} == set(range(150))
    # An item that a walk finds is counted as found by it, whatever the pieces find too.
    assert {(r["doc_id"], r["item_id"]) for r in whole if r["by_walk"]} >= {(r["doc_id"], r["item_id"]) for r in walks}


def test_template_phrase(spark):
    """Items and documents that share a phrase: only those near as a whole are hits."""
    rnd = random.Random(12)
    word = lambda: f"w{rnd.randrange(10**6)}"
    phrase = "answer the question below with one of the four letters".split()
    items = [[*phrase, *(word() for _ in range(12))] for _ in range(25)]
    docs = [[word() for _ in range(20)] + phrase + [word() for _ in range(20)] for _ in range(40)]
    docs += [[word() for _ in range(20)] + edited(i, rnd) + [word() for _ in range(20)] for i in items]
    got = dc.contaminated(
        spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"),
    )
    want = set()
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            if hit := dc.nearest_window(item, words, int(0.15 * len(item))):
                want.add((d, i, hit[0]))
    assert {(r["doc_id"], r["item_id"], r["n_edits"]) for r in got.collect()} == want
    assert {(40 + k, k) for k in range(25)} == {(d, i) for d, i, _ in want}


def test_bitmap(spark):
    """The packed bits are those of the cells, over all blocks and for none."""
    for cells in ([], [0, 7, 32767, 32768, 99_999, (1 << 18) - 1]):
        frame = store(spark.createDataFrame([(c,) for c in cells * 2], "cell long").distinct(), "cells")
        bits = np.unpackbits(np.frombuffer(dc._bitmap(frame, 1 << 18).value, np.uint8))
        assert len(bits) == 1 << 18 and np.flatnonzero(bits).tolist() == cells
