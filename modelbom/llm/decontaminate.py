"""Benchmark decontamination: CGK embedding and bit sampling find windows near benchmark items."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from modelbom.llm.common import store

#: Blocks of marks and spaces beyond ASCII.
_MARKS = re.compile("[\u0080-\u00bf\u00d7\u00f7\u1680\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]")
_SPACED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class Search:
    """Parameters. An item of n words matches a window at floor(edits * n) or fewer word edits."""

    edits: float = 0.15
    #: Independent random walks, and hash tables of each, for windows of up to 32 words (see ``tables_of``).
    walks: int = 2
    tables: int = 6
    #: Sampled coordinates of a table.
    coordinates: int = 4
    #: Whether whole pieces of an item are keys too, which find what the walks miss.
    whole_pieces: bool = True
    #: Cells of the filter over the item keys: at most this many bytes are broadcast.
    cells: int = 1 << 22
    seed: int = 20

    def span(self, size: int) -> int:
        """Steps of the walk from which a size's coordinates come; it advances every other step."""
        return max(1, size * 3 // 2)

    def tables_of(self, size: int) -> int:
        """Tables of a window size: more edits fall into a longer window, so more samples are drawn to miss them."""
        return self.tables * max(1, size // 32)

    def size(self, n: int) -> int:
        """The window size for an item of n words: the largest power of two, so that two windows cover the item."""
        return 1 << n.bit_length() - 1


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of ASCII letters, digits and characters beyond ASCII that are no marks."""
    return _MARKS.sub(" ", (text or "").lower()).encode("utf-8").translate(_SPACED).decode("utf-8").split()


class _Symbols(dict):
    """64-bit symbols of words as bytes; the empty word has symbol 0."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        made = self[word] = (xxh64_intdigest(word) | 1).to_bytes(8, "little") if word else bytes(8)
        return made


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The symbols that a worker knows, kept between its tasks.
_SYMBOLS = _Symbols()


class Embedding:
    """CGK walks over word symbols, sampled at each table's coordinates.

    The walk reads symbol x at step j and moves on by one if bit j of x's random bits is 1, so two near
    strings fall back into step after an edit and agree in most coordinates. Windows start at every
    position and share the walk; a window's size only says up to which step coordinates are sampled.
    """

    def __init__(self, search: Search):
        import numpy as np

        self.np, self.search = np, search
        self.drawn = {}

    def picks(self, walk: int, size: int) -> list[list[int]]:
        """The sampled coordinates of each table."""
        if (walk, size) not in self.drawn:
            span, draw = self.search.span(size), self.np.random.default_rng((self.search.seed, walk, size))
            some = min(span, self.search.coordinates)
            self.drawn[walk, size] = [sorted(draw.choice(span, some, replace=False).tolist()) for _ in range(self.search.tables_of(size))]
        return self.drawn[walk, size]

    def symbol(self, words: list[str]):
        return self.np.frombuffer(b"".join(map(_SYMBOLS.__getitem__, words)), "<u8")

    def pieces(self, symbols, size: int):
        """At every place the key of the ``size`` words that start there; a text's end makes it match nothing."""
        np, n = self.np, len(symbols)
        after = np.concatenate([symbols, np.zeros(size, np.uint64)])
        h = np.full(n, (1 << 20) + size, np.uint64)
        for k in range(size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += after[k : k + n]
        return _mix(h)

    def keys(self, symbols, walk: int, wanted: dict):
        """(size, starts, keys of all tables, places of the walks at the end) for the starts wanted of each size.

        One walk from a start serves all sizes; it ends with the largest for which the start is wanted.
        Symbol 0 ends a text and holds the walk.
        """
        np = self.np
        bits = np.where(symbols == 0, np.uint64(0), _mix(symbols + np.uint64(0x9E3779B97F4A7C15 * (walk + 1) % (1 << 64))))
        sizes, last = sorted(wanted), np.zeros(len(symbols), np.int64)
        for size in sizes:
            last[wanted[size]] = size
        starts = np.flatnonzero(last)
        pos, last, j = starts.copy(), last[starts], 0
        sums = {}
        at = {}
        for size in sizes:
            for t, picks in enumerate(self.picks(walk, size)):
                sums[size, t] = np.full(len(starts), (walk * 64 + size.bit_length()) * 65536 + t, np.uint64)
                for k in picks:
                    at.setdefault(k, []).append((size, t))
        for size in sizes:
            while j < self.search.span(size):
                if j in at:
                    seen = symbols[pos]
                    for k in at[j]:
                        sums[k] *= np.uint64(0x9E3779B97F4A7C15)
                        sums[k] += seen
                ends = pos
                pos = pos + ((bits[pos] & np.uint64(1 << (j & 63))) != 0)
                j += 1
            here = np.searchsorted(starts, wanted[size])
            yield size, wanted[size], [_mix(sums.pop((size, t))[here]) for t in range(self.search.tables_of(size))], ends[here]
            on = last > size
            starts, pos, last = starts[on], pos[on], last[on]
            sums = {k: v[on] for k, v in sums.items()}


def _cells(key, cells: int):
    import numpy as np

    return (key & np.uint64(cells - 1)).astype(np.int64), (key >> np.uint64(40) & np.uint64(cells - 1)).astype(np.int64)


def pieces(n: int, edits: float) -> list[tuple[int, int]]:
    """(start, size) of floor(edits * n) + 1 pieces of an item of n words: as many edits leave one of them whole."""
    k = int(edits * n) + 1
    return [(n * i // k, n * (i + 1) // k - n * i // k) for i in range(k)]


def _item_keys(search: Search):
    def run(batches):
        """(cls, n_words, size, key, cell1, cell2) of each item class; the size of a piece is negative."""
        import numpy as np
        import pandas as pd

        e = Embedding(search)
        for pdf in batches:
            rows = []
            for cls, text in zip(pdf["cls"], pdf["words"]):
                words = text.split(" ")
                symbols = e.symbol([*words, ""])
                for walk in range(search.walks):
                    size = search.size(len(words))
                    anchors = np.unique([0, len(words) - size])
                    for _, _, keys, ends in e.keys(symbols, walk, {size: anchors}):
                        for k in keys:
                            k = k[ends < len(words)]  # a walk that leaves the item matches nothing
                            a, b = _cells(k, search.cells)
                            rows += [(cls, len(words), size, *x) for x in zip(k.view(np.int64), a, b)]
                for start, size in pieces(len(words), search.edits) if search.whole_pieces else []:
                    k = e.pieces(symbols[start : start + size], size)[:1]
                    a, b = _cells(k, search.cells)
                    rows.append((cls, len(words), -size, k.view(np.int64)[0], a[0], b[0]))
            yield pd.DataFrame(rows, columns=["cls", "n_words", "size", "key", "cell1", "cell2"])

    return run


def _item_cells(search: Search, size: int):
    def run(batches):
        """Cells of the filter over the items' runs of ``size`` words."""
        import numpy as np
        import pandas as pd

        e = Embedding(search)
        for pdf in batches:
            keys = [e.pieces(e.symbol(text.split(" ")), size)[: 1 - size or None] for text in pdf["words"]]
            yield pd.DataFrame({"cell": np.unique(_cells(np.concatenate(keys), search.cells)[0]) if keys else []})

    return run


def _packed(width: int):
    def run(pdf):
        """A block of a bitmap: ``width`` cells as bits."""
        import numpy as np
        import pandas as pd

        bits = np.zeros(width, np.uint8)
        bits[pdf["cell"] % width] = 1
        return pd.DataFrame({"block": pdf["cell"][:1] // width, "bits": [np.packbits(bits).tobytes()]})

    return run


def _bitmap(cells: DataFrame, most: int):
    """Broadcast bits of the distinct numbers ``cell`` below ``most``: packed in tasks, most / 8 bytes in all."""
    width = min(most, 1 << 15)
    blocks = cells.groupBy(F.floor(F.col("cell") / width)).applyInPandas(_packed(width), "block long, bits binary").collect()
    bits = {r["block"]: bytes(r["bits"]) for r in blocks}
    empty = bytes(width // 8)
    return cells.sparkSession.sparkContext.broadcast(b"".join(bits.get(k, empty) for k in range(most // width)))


def _candidates(search: Search, longest: dict[int, int], cells, word_cells, pair_cells):
    """Windows whose key is among the items' keys, neighbours together, with the text around them.

    A window within ``n`` edits of an item has at most n words that no item has, and at most 2 n pairs of
    neighbours that no item has, so its first words up to the size have no more. Windows with more are left
    out before the walk. A piece may be anywhere in
    its item, so the text around reaches back by the longest item.
    """
    schema_names = ["doc_id", "digest", "key", "lo", "around"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        e = Embedding(search)
        flags, *known = (np.unpackbits(np.frombuffer(x.value, np.uint8)).astype(bool) for x in (cells, word_cells, pair_cells))
        most = max(longest.values(), default=0)
        slack = int(search.edits * most)
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()]

        def search_texts(rows):
            starts = np.cumsum([0] + [len(w) + 1 for _, _, w in rows])
            flat = []
            for _, _, w in rows:
                flat += w
                flat.append("")
            symbols = e.symbol(flat)
            upto, full = [], symbols != 0
            for size in (1, 2):
                strange = ~known[size - 1][_cells(e.pieces(symbols, size), search.cells)[0]] & full
                upto.append(np.concatenate([[0], np.cumsum(strange)]))
                full = full & np.append(full[1:], False)
            end = np.repeat(starts[1:] - 1, np.diff(starts))
            place = np.arange(len(symbols))
            found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for size in [-s for s in longest if s < 0]:
                k = e.pieces(symbols, size)
                a, b = _cells(k, search.cells)
                hit = np.flatnonzero(flags[a])
                hit = hit[flags[b[hit]]]
                found_at.append(hit)
                found.append(k[hit])
            wanted = {}
            for size, n in longest.items():
                if size > 0:
                    most_edits = int(search.edits * n)
                    few = upto[0][np.minimum(place + size, end)] - upto[0][:-1] <= most_edits
                    few &= upto[1][np.minimum(place + size - 1, end)] - upto[1][:-1] <= 2 * most_edits
                    wanted[size] = np.flatnonzero(few & (symbols != 0))
            for walk in range(search.walks):
                for _, some, keys, _ in e.keys(symbols, walk, wanted):
                    for k in keys:
                        a, b = _cells(k, search.cells)
                        hit = np.flatnonzero(flags[a])
                        hit = hit[flags[b[hit]]]
                        found_at.append(some[hit])
                        found.append(k[hit])
            pos, key = np.concatenate(found_at), np.concatenate(found)
            pos, key = pos[o := np.argsort(pos, kind="stable")], key[o]
            doc = np.searchsorted(starts, pos, "right") - 1
            out, k = [], 0
            while k < len(pos):
                d, first, end = doc[k], pos[k], k + 1
                while end < len(pos) and doc[end] == d and pos[end] - pos[end - 1] <= slack + 1 and pos[end] - first <= most:
                    end += 1
                doc_id, digest, words = rows[d]
                lo = max(0, int(first - starts[d]) - most - slack)
                around = " ".join(words[lo : int(pos[end - 1] - starts[d]) + most + slack])
                out += [(doc_id, digest, int(x), lo, around) for x in np.unique(key[k:end]).view(np.int64)]
                k = end
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], schema_names)

        for b in batches:
            rows, size = [], 0
            for doc_id, digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = words_of(text.as_py())
                rows.append((doc_id, digest, words))
                size += len(words) + 1
                if size >= 1 << 16:
                    yield search_texts(rows)
                    rows, size = [], 0
            if rows:
                yield search_texts(rows)

    return run


def nearest_window(item: list[str], words: list[str], most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the window of ``words`` with the fewest word edits from ``item``, the first such.

    None if it takes more than ``most``. Of the starts for that end the one nearest to it counts.
    """
    import numpy as np

    number: dict[str, int] = {}
    if sum(map(set(words).__contains__, item)) < len(item) - most:  # each missing word is an edit
        return None
    a = [number.setdefault(w, len(number)) for w in item]
    b = np.array([number.setdefault(w, len(number)) for w in words], np.int64)

    def last_row(a, b, free):
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, x in enumerate(a):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = last_row(a, b, True)
    end = int(row.argmin())
    edits = int(row[end])
    if edits > most:
        return None
    back = last_row(a[::-1], b[:end][::-1], False)
    return edits, end - int(np.flatnonzero(back == edits)[0]), end


def _verify(share: float):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc_id, digest, lo, around, cls, text, by_walk in zip(*(pdf[c] for c in pdf.columns)):
                item = text.split(" ")
                hit = nearest_window(item, around.split(" "), int(share * len(item)))
                if hit:
                    rows.append((doc_id, digest, cls, hit[0], lo + hit[1], hit[2] - hit[1], by_walk))
            names = ["doc_id", "digest", "cls", "n_edits", "start_word", "n_words", "by_walk"]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(member, item_id, words): every item and the smallest id among the items of the same words."""

    def joined(batches):
        for pdf in batches:
            pdf["words"] = [" ".join(words_of(t)) for t in pdf["words"]]
            yield pdf

    worded = items.select(F.col(f"`{item_id}`").cast("long").alias("member"), F.col(f"`{text}`").cast("string").alias("words"))
    worded = worded.mapInPandas(joined, "member long, words string")
    least = worded.groupBy("words").agg(F.min("member").alias("item_id"))
    return worded.join(least, "words").select("member", "item_id", "words")


def contaminated(docs: DataFrame, items: DataFrame, search: Search = Search(), text: str = "text") -> DataFrame:
    """Which document holds which benchmark item, allowing word edits.

    1. Items of equal words form a class; a class is embedded and hashed once, as two windows: the largest
       power of two of words from its first word, and as many up to its last.
    2. One narrow pass embeds the windows at every position of every document, but for those with more
       words or pairs of words that no item has than edits allow, and keeps those whose key is in a filter over the
       item keys. The three filters are bitmaps of a fixed number of bytes, whatever the corpus or benchmark; a
       benchmark that fills their cells makes them spare nothing, with the same result.
    3. What is left is joined to the exact keys, made distinct, and verified by the edit distance of the
       item to the best window around.

    Returns doc_id, digest (MD5 of the text, which tells rows of one doc_id apart), item_id (least of its
    class; see ``item_classes``), n_edits, start_word, n_words of the best window, and by_walk: whether a
    key of a walk led there, not whole pieces alone. Words are as in ``words_of``. Null or empty texts and items have no words and match nothing. Repeated
    rows count once. Further columns of any name are ignored; empty tables give an empty result.
    Distances are exact, and no pair is missed: beside its walks an item is hashed by the words of its
    ``pieces``, one more than the edits that are allowed, so one of them is whole wherever the edits are.
    """
    classes = item_classes(items).where("words <> ''").select("item_id", "words").distinct()
    classes = store(classes.withColumn("cls", F.md5("words")), "items")
    keys = store(
        classes.mapInPandas(
            _item_keys(search), "cls string, n_words int, size int, key long, cell1 long, cell2 long"
        ), "item-keys",
    )
    longest = {r["size"]: r["n"] for r in keys.groupBy("size").agg(F.max("n_words").alias("n")).collect()}
    cells = keys.select(F.explode(F.array("cell1", "cell2")).alias("cell")).distinct()
    runs = [classes.mapInPandas(_item_cells(search, n), "cell long").distinct() for n in (1, 2)]

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), F.unhex(F.md5(t)).alias("digest"), t.alias("text"))
    found = texts.mapInArrow(
        _candidates(search, longest, *(_bitmap(c, search.cells) for c in (cells, *runs))), "doc_id long, digest binary, key long, lo long, around string"
    )
    of = keys.groupBy("key", "cls").agg(F.max(F.col("size") > 0).alias("by_walk"))
    pairs = found.join(of, "key").groupBy("doc_id", "digest", "lo", "around", "cls").agg(F.max("by_walk").alias("by_walk"))
    pairs = pairs.join(classes, "cls").select("doc_id", "digest", "lo", "around", "cls", "words", "by_walk")
    hits = pairs.mapInPandas(
        _verify(search.edits), "doc_id long, digest binary, cls string, n_edits long, start_word long, n_words long, by_walk boolean"
    )
    best = hits.groupBy("doc_id", "digest", "cls").agg(
        F.min(F.struct("n_edits", "start_word", "n_words")).alias("b"), F.max("by_walk").alias("by_walk")
    )
    return best.join(classes, "cls").select("doc_id", "digest", "item_id", "b.n_edits", "b.start_word", "b.n_words", "by_walk")


def decontaminate(docs: DataFrame, items: DataFrame, search: Search = Search(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they came."""
    bad = contaminated(docs, items, search, text).select(F.col("doc_id").alias("_d"), F.col("digest").alias("_g")).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return docs.join(store(bad, "leaks"), F.col("doc_id").eqNullSafe(F.col("_d")) & (digest == F.col("_g")), "left_anti")
