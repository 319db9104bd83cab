"""Decontamination finds items whatever their length and wherever their edits are."""

import random

from modelbom.llm import decontaminate as dc


def test_edits_gathered(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    items, docs, want = [], [], set()
    for n in (1, 3, 6, 7, 13, 14, 20, 27, 40, 59, 100, 200, 300):
        for _ in range(6):
            item, most = [word() for _ in range(n)], int(0.15 * n)
            places = [range(most), range(n - most, n), range(n // 2, n // 2 + most), rnd.sample(range(n), most)]
            for at in places:
                for way in ("replaced", "removed", "inserted"):
                    made = []
                    for i, w in enumerate(item):
                        made += [w] if i not in at else {"replaced": [f"new{i}"], "removed": [], "inserted": [f"new{i}", w]}[way]
                    want.add((len(docs), len(items)))
                    around = [[word() for _ in range(rnd.randrange(80))] for _ in "ab"]
                    docs.append((len(docs), " ".join(around[0] + made + around[1])))
            items.append((len(items), " ".join(item)))
    got = dc.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    found = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in got.collect()}
    assert want <= set(found)
    assert all(e <= int(0.15 * len(items[i][1].split())) for (_, i), e in found.items())


def test_pieces():
    for n in range(1, 400):
        cut = dc.pieces(n, 0.15)
        assert len(cut) == int(0.15 * n) + 1 and all(size > 0 for _, size in cut)
        assert [p for s, size in cut for p in range(s, s + size)] == list(range(n))
