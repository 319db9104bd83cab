"""Exact substring deduplication over a sparse suffix array of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import forget, store

#: Bytes of a repeated string.
LENGTH = 200
#: A suffix is taken in every stretch of this many byte positions.
GAP = 128
#: Bytes that a suffix has in common with every window of which it is the chosen one.
LEAD = LENGTH - GAP + 1
#: Distinct surroundings of one leading text that a task compares; larger groups are dealt by window.
GROUP = 100_000
#: Cells of the filters that spare rows from shuffles: 2 ** 26 bits, 8 MB, at any size of the corpus.
CELL_BITS = 26


def chosen(data: bytes, gap: int = GAP):
    """Positions of the suffixes to index: in every ``gap`` consecutive positions those of the least hash.

    The hash is of the 8 bytes at a position, so equal windows choose equal places in them.
    """
    import numpy as np

    n = len(data) - 7
    if n < gap:
        return np.zeros(0, np.int64)
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(32)
    h = h.astype(np.uint32)
    low, step = h.copy(), 1
    while step < gap:  # least of the windows of 2, 4, ... gap positions
        by = min(step, gap - step)
        low = np.minimum(low[:-by], low[by:])
        step += by
    top = np.concatenate([np.zeros(gap - 1, np.uint32), low, np.zeros(gap - 1, np.uint32)])
    step = 1
    while step < gap:  # the largest of the least of all windows that hold a position
        by = min(step, gap - step)
        top = np.maximum(top[:-by], top[by:])
        step += by
    return np.flatnonzero(h == top)


def _reach(at, n, length, gap):
    """(least, most) shift of the windows at - shift that lie within a text of n bytes."""
    import numpy as np

    return np.maximum(0, length - (n - at)), np.minimum(gap - 1, at)


def suffixes(data: bytes, length: int, gap: int):
    """(position, lead hash, surroundings hash) arrays of the chosen suffixes that lie in some window."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    at = chosen(data, gap)
    least, most = _reach(at, len(data), length, gap)
    ok = least <= most
    at, least, most = at[ok], least[ok], most[ok]
    lead = length - gap + 1
    keys = np.array([xxh3_64_intdigest(data[p : p + lead]) for p in at.tolist()], np.uint64)
    around = np.array([
        xxh3_64_intdigest(data[max(0, p - gap + 1) : p + length], s * gap + e)
        for p, s, e in zip(at.tolist(), least.tolist(), most.tolist())
    ], np.uint64)
    return at, keys, around


def _texts(batches):
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1)):
            yield doc.as_py(), (text.as_py() or "").encode("utf-8")


def _first_pass(length: int, gap: int):
    def run(batches):
        """(lead, around, place_min, place_max) of each text's suffixes; a place is a hash of text and position."""
        import numpy as np
        import pyarrow as pa

        def batch(parts):
            cols = [np.concatenate(c) for c in zip(*parts)]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], ["lead", "around", "low", "high"])

        parts, size = [], 0
        for doc, data in _texts(batches):
            at, keys, around = suffixes(data, length, gap)
            if not len(at):
                continue
            salt = np.frombuffer(doc[:8], "<u8")[0]
            place = (at.astype(np.uint64) + salt) * np.uint64(0x9E3779B97F4A7C15)
            place = (place ^ (place >> np.uint64(31))).view(np.int64)  # signed, as the aggregates compare
            order = np.lexsort((place, around, keys))
            k, a, p = keys[order], around[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])]))
            last = np.concatenate([new[1:], [len(k)]]) - 1
            parts.append((k[new], a[new], p[new], p[last]))
            size += len(new)
            if size > 50_000:
                yield batch(parts)
                parts, size = [], 0
        if parts:
            yield batch(parts)

    return run


def _cells(keys, bits: int = CELL_BITS):
    import numpy as np

    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame, column: str, bits: int = CELL_BITS):
    """A bitmap of the upper ``bits`` bits of a column of 64-bit keys, broadcast: 2 ** bits / 8 bytes."""
    import numpy as np

    cell = keys.select(F.shiftrightunsigned(column, 64 - bits).alias("c"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c").bitwiseAND(31).cast("int"))
    words = cell.groupBy(F.shiftright("c", 5).alias("w")).agg(F.bit_or(bit).alias("b"))
    got = words.toPandas()
    bitmap = np.zeros(1 << (bits - 5), "<u4")
    bitmap[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def _second_pass(length: int, gap: int, shared):
    def run(batches):
        """Texts with some suffix in the filter: doc, text and its distinct (lead, around) with their positions."""
        import numpy as np
        import pyarrow as pa

        flags = np.frombuffer(shared.value, "<u4")
        types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
        names = ["doc", "data", "lead", "around", "at"]
        rows, size = [], 0
        for doc, data in _texts(batches):
            at, keys, around = suffixes(data, length, gap)
            cell = _cells(keys)
            hit = np.flatnonzero(flags[cell >> 5] >> (cell & 31).astype(np.uint32) & np.uint32(1))
            if not len(hit):
                continue
            at, keys, around = at[hit], keys[hit], around[hit]
            order = np.lexsort((at, around, keys))
            k, a, p = keys[order], around[order], at[order].astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])]))
            rows.append((doc, data, k[new].view(np.int64), a[new].view(np.int64), np.split(p, new[1:])))
            size += len(data)
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _surroundings(length: int, gap: int):
    def run(batches):
        """For each wanted suffix of a text: its leading bytes and its surroundings of gap - 1 + length bytes."""
        import pyarrow as pa

        names = ["first", "lead", "around", "twice", "data", "least", "most"]
        types = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int32()]
        for b in batches:
            rows = []
            for data, wanted in zip(b.column(0), b.column(1)):
                data = data.as_py()
                for w in wanted.as_py():
                    p = w["at"]
                    least, most = max(0, length - (len(data) - p)), min(gap - 1, p)
                    piece = data[max(0, p - gap + 1) : p].rjust(gap - 1, b"\0") + data[p : p + length].ljust(length, b"\0")
                    rows.append((data[p : p + length - gap + 1], w["lead"], w["around"], w["twice"], piece, least, most))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def multikey_quicksort(words):
    """Order of the rows of a matrix of 64-bit words, and for each row but the first the word where it leaves its predecessor.

    Rows are parted by one word at a time: quicksort on the current word within each segment of rows that
    are equal so far, then the equal parts go on with the next word, all segments of a level at once.
    Rows that differ are not looked at again.
    """
    import numpy as np

    n, width = words.shape
    order, split = np.arange(n), np.full(n, width)
    open_, segment = np.arange(n), np.zeros(n, np.int64)  # places in the order, and their segments
    for depth in range(width):
        if len(open_) < 2:
            break
        rows = order[open_]
        w = words[rows, depth]
        by = np.lexsort((w, segment))
        order[open_] = rows[by]
        w = w[by]
        same_segment = segment[1:] == segment[:-1]
        differ = same_segment & (w[1:] != w[:-1])
        split[open_[1:][differ]] = depth
        start = np.concatenate([[True], ~same_segment | differ])
        number = np.cumsum(start) - 1
        many = np.bincount(number)[number] > 1
        open_, segment = open_[many], number[many]
    return order, split


def _as_words(matrix):
    import numpy as np

    pad = -matrix.shape[1] % 8
    return np.ascontiguousarray(np.pad(matrix, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)


def _common(matrix, order):
    """Length of the common prefix of each row, in order, with its predecessor; 0 for the first."""
    import numpy as np

    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 1 << 14):
        a, b = order[k - 1 : k - 1 + (1 << 14)], order[k : k + (1 << 14)]
        differ = matrix[a[: len(b)]] != matrix[b]
        out[k : k + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    return out


def repeated_shifts(group, data, least, most, twice, length: int = LENGTH, gap: int = GAP):
    """For rows of surroundings, which shifts give a window that some other row has too: booleans (row, shift).

    ``group`` numbers the rows of equal leading bytes, ``data`` holds gap - 1 bytes before and ``length``
    from the suffix on. Suffixes are sorted, and the texts before them, read backwards, too. Rows share
    the window of a shift s if they have s bytes before in common, and length - s from the suffix on:
    two runs of neighbours in the two sorted orders, told by the least common prefix between neighbours.
    """
    import numpy as np

    n = len(data)
    right, left = data[:, gap - 1 :], data[:, : gap - 1][:, ::-1]
    o1, _ = multikey_quicksort(_as_words(right))
    o2, _ = multikey_quicksort(np.concatenate([group[:, None].astype(np.uint64), _as_words(left)], axis=1))
    c1, c2 = _common(right, o1), _common(left, o2)
    c1[0] = c2[0] = -1
    c2[1:][group[o2][1:] != group[o2][:-1]] = -1
    r1, r2 = np.empty(n, np.int64), np.empty(n, np.int64)
    out = np.zeros((n, gap), bool)
    shift = np.arange(gap)
    out[twice] = (shift >= least[twice, None]) & (shift <= most[twice, None])
    for s in range(gap):
        r1[o1] = np.cumsum(c1 < length - s)
        r2[o2] = np.cumsum(c2 < s)
        valid = np.flatnonzero((least <= s) & (s <= most))
        if len(valid) < 2:
            continue
        _, where, count = np.unique(r1[valid] * (n + 1) + r2[valid], return_inverse=True, return_counts=True)
        out[valid, s] |= count[where] > 1
    return out


def _buckets(length: int, gap: int):
    def run(batches):
        """Masks of repeated shifts of the rows of a bucket, which come sorted by their leading bytes."""
        import numpy as np
        import pyarrow as pa

        def masks(parts):
            first = np.concatenate([p[0] for p in parts])
            lead, around, twice, data, least, most = (np.concatenate([p[k] for p in parts]) for k in range(1, 7))
            group = np.cumsum(np.concatenate([[True], first[1:] != first[:-1]])) - 1
            by = np.lexsort((around, group))  # copies of a text give a row each: one of them counts
            one = by[np.concatenate([[True], (around[by][1:] != around[by][:-1]) | (group[by][1:] != group[by][:-1])])]
            found = repeated_shifts(group[one], data[one], least[one], most[one], twice[one], length, gap)
            bits = np.packbits(found, axis=1, bitorder="little")
            return pa.RecordBatch.from_arrays(
                [pa.array(lead[one]), pa.array(around[one]), pa.array([x.tobytes() for x in bits], pa.binary())], ["lead", "around", "shifts"]
            )

        def arrays(b):
            first = np.array(b.column(0).to_pylist(), object)
            data = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(first), gap - 1 + length)
            lead, around, twice, least, most = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 5, 6))
            return first, lead, around, twice, data, least.astype(np.int64), most.astype(np.int64)

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            part = arrays(b)
            first = part[0]
            if held and size >= 60_000:
                cut = int(np.argmax(first != held[-1][0][-1])) if (first != held[-1][0][-1]).any() else len(first)
                held.append(tuple(c[:cut] for c in part))
                part = tuple(c[cut:] for c in part)
                if len(part[0]):
                    yield masks(held)
                    held, size = [], 0
            if len(part[0]):
                held.append(part)
            size += b.num_rows
        if held:
            yield masks(held)

    return run


def _windows(length: int, gap: int):
    def run(batches):
        """A row per valid shift: the 128-bit hash of what the window has beyond the leading bytes."""
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for b in batches:
            for lead, around, twice, data, least, most in zip(*(b.column(k).to_pylist() for k in range(1, 7))):
                shifts = range(least, most + 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(shifts), lead)), pa.array(np.full(len(shifts), around)),
                    pa.array(np.full(len(shifts), twice)), pa.array(list(shifts), pa.int32()),
                    pa.array([xxh3_128_digest(data[gap - 1 - s : gap - 1 - s + length]) for s in shifts], pa.binary()),
                ], ["lead", "around", "twice", "shift", "text"])

    return run


def _large_groups(rows: DataFrame, length: int, gap: int) -> DataFrame:
    """The masks of groups of any size: windows are counted by their hash, in no task's memory."""
    w = rows.mapInArrow(_windows(length, gap), "lead long, around long, twice boolean, shift int, text binary").distinct()
    seen = w.groupBy("lead", "shift", "text").agg(
        F.min("around").alias("a"), F.max("around").alias("z"), F.max("twice").alias("t")
    )
    again = seen.where("a <> z or t").select("lead", "shift", "text")
    hit = w.join(again, ["lead", "shift", "text"]).groupBy("lead", "around").agg(F.collect_set("shift").alias("s"))
    byte = lambda k: F.aggregate(
        F.filter("s", lambda x: F.floor(x / 8) == k), F.lit(0),
        lambda t, x: t + F.call_function("shiftleft", F.lit(1), (x % 8).cast("int")),
    )
    hexed = F.concat(*[F.lpad(F.hex(byte(k)), 2, "0") for k in range(-(-gap // 8))])
    return hit.select("lead", "around", F.unhex(hexed).alias("shifts"))


def _removal(length: int, gap: int):
    def run(batches):
        """Bytes left of each text, from the repeated shifts at its suffixes."""
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = ["doc", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            rows = []
            for doc, data, hits in zip(b.column(0), b.column(1), b.column(2)):
                data = data.as_py()
                n = len(data)
                start = np.zeros(n + gap, bool)
                for hit in hits.as_py():
                    at = np.array(hit["at"], np.int64)
                    if hit["shifts"] is None:
                        least, most = _reach(at, n, length, gap)
                        shift = np.arange(int(least[0]), int(most[0]) + 1)
                    else:
                        shift = np.flatnonzero(np.unpackbits(np.frombuffer(hit["shifts"], np.uint8), bitorder="little"))
                    start[(at[:, None] - shift[None, :]).ravel()] = True
                edge = np.zeros(n + 1, np.int32)
                at = np.flatnonzero(start[:n])
                edge[at] += 1
                edge[at + length] -= 1
                gone = np.cumsum(edge)[:n] > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (n > 0 and gone[0]))
                rows.append((doc.as_py(), n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gap: int = GAP, group: int = GROUP) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    A full suffix array of the corpus would need a row per byte. Here one suffix is taken in every
    ``gap`` byte positions, by content, so that each window of ``length`` bytes holds a chosen suffix at
    most gap - 1 bytes in, at the same place wherever the window occurs.

    1. First pass: per leading text (length - gap + 1 bytes, hashed) the range of its surroundings and
       places, an aggregate combined before the shuffle. Leading texts at one place are done; those
       with one surroundings repeat in all their windows; the mixed ones go on.
    2. Second pass: texts that hold shared suffixes, with these; a bitmap of fixed size spares the rest.
    3. Of mixed leading texts one row per distinct surroundings, from one of its texts, is range
       partitioned by leading bytes with sampled splitters. Equal leading bytes never straddle a
       splitter, so no window does. Each bucket sorts suffixes and the reversed texts before them by
       multikey quicksort and reads the repeated windows off the common prefixes of neighbours.
       Leading texts with over ``group`` surroundings are dealt by window instead.
    4. Shifts go back to the texts, which lose the covered bytes.

    Texts that occur in several rows are repeated as a whole, and stand for one in all steps. A null
    text counts as empty. Null doc_ids, repeated rows, further columns of any name and empty tables are
    no matter. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, doc (MD5 of the text) and kept
    (the bytes that are left; null where the text is unchanged).
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    doc = F.unhex(F.md5(t)).alias("doc")
    slim = docs.select("doc_id", doc, F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("sha256"))
    slim = store(slim, "texts")
    texts = docs.select(doc, t.alias("text"))

    places = texts.mapInArrow(_first_pass(length, gap), "lead long, around long, low long, high long")
    shared = places.groupBy("lead").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("around").alias("a"), F.max("around").alias("z")
    )
    shared = store(shared.where("low <> high").select("lead", (F.col("a") != F.col("z")).alias("mixed")), "shared")

    concerned = texts.mapInArrow(
        _second_pass(length, gap, key_filter(shared, "lead")),
        "doc binary, data binary, lead array<long>, around array<long>, at array<array<int>>",
    )
    # The row number is stored with the row: copies of a text share ``doc``, so texts are joined by row.
    concerned = store(concerned.withColumn("row", F.monotonically_increasing_id()), "concerned")
    rows = concerned.select("row", "doc", F.explode(F.arrays_zip("lead", "around", "at")).alias("x"))
    rows = rows.select("row", "doc", "x.lead", "x.around", "x.at").join(shared, "lead")
    rows = store(rows, "suffixes")

    place = F.struct("doc", F.element_at("at", 1).alias("at"), "row")
    kinds = rows.where("mixed").groupBy("lead", "around").agg(
        F.min(place).alias("one"), F.max(F.struct("doc", F.element_at("at", -1).alias("at"))).alias("other")
    )
    twice = (F.col("one.doc") != F.col("other.doc")) | (F.col("one.at") != F.col("other.at"))
    kinds = store(kinds.select("lead", "around", "one", twice.alias("twice")), "kinds")
    large = kinds.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") > group).select("lead", F.lit(True).alias("large"))
    wanted = kinds.select(F.col("one.row").alias("row"), F.struct("lead", "around", "twice", F.col("one.at").alias("at")).alias("w"))
    wanted = wanted.groupBy("row").agg(F.collect_list("w").alias("w"))  # of one text
    pieces = concerned.select("row", "data").join(wanted, "row").select("data", "w").mapInArrow(
        _surroundings(length, gap), "first binary, lead long, around long, twice boolean, data binary, least int, most int"
    )
    pieces = store(pieces.join(large, "lead", "left").select(
        "first", "lead", "around", "twice", "data", "least", "most", F.coalesce("large", F.lit(False)).alias("large")
    ), "pieces")
    forget(kinds)
    masks = (
        pieces.where("not large").drop("large").repartitionByRange("first").sortWithinPartitions("first")
        .mapInArrow(_buckets(length, gap), "lead long, around long, shifts binary")
    )
    masks = masks.unionByName(_large_groups(pieces.where("large").drop("large"), length, gap))
    masks = store(masks.withColumn("found", F.lit(True)), "masks")
    forget(pieces)  # no later plan reads the texts around the mixed suffixes

    copies = slim.groupBy("doc").agg(F.count("*").alias("copies"))
    single = rows.join(copies.where("copies = 1").select("doc"), "doc", "left_semi")
    hits = single.join(masks, ["lead", "around"], "left").where("not mixed or found")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("at", "shifts")).alias("hits"))  # of one text
    left = (
        concerned.select("row", "doc", "data").join(hits, "row").select("doc", "data", "hits")
        .mapInArrow(_removal(length, gap), "doc binary, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    empty = F.lit("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")  # SHA-256 of nothing
    return slim.join(copies, "doc").join(left, "doc", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        "doc", F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
