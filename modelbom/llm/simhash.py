"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments, verified by distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import components, store

#: Words of a shingle, and the most bits by which linked fingerprints differ.
SHINGLE = 3
DISTANCE = 3
#: (first bit, bits) of the three segments; each is a shortened word of the 23-bit code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator of the cyclic [23, 12, 7] code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingles' XXH64 (seed 42)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    h = np.array([xxh64_intdigest(g, 42) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            bits = pa.array([x - (1 << 64) if x >> 63 else x for x in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), bits], ["doc_id", "digest", "bits"])

    return run


class Golay:
    """Nearest codewords of 23-bit words. The code is perfect: each word is within 3 bits of one."""

    def __init__(self):
        import numpy as np

        self.np = np
        self.rest = self._remainder(np.arange(1 << 23, dtype=np.uint32))
        self.error = np.zeros(1 << 11, np.uint32)
        for n in range(4):
            for bits in combinations(range(23), n):
                e = sum(1 << b for b in bits)
                self.error[self.rest[e]] = e

    def _remainder(self, x):
        for b in range(22, 10, -1):
            x = self.np.where(x >> b & 1, x ^ (GENERATOR << (b - 11)), x)
        return x.astype(self.np.uint16)

    def index(self, x):
        """12-bit number of the codeword next to x."""
        return (x ^ self.error[self.rest[x]]) >> 11

    def near(self, x, bits: int):
        """(row, index) of the codewords next to x or to x with one of its bits changed.

        At most six a word: its own and, if that is three bits away, the five at a distance of four.
        Two words that differ in one bit each have the other's codeword among theirs.
        """
        np = self.np
        flips = np.array([0] + [1 << b for b in range(bits)], np.uint32)
        near = np.sort(self.index(x[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        return row, near[row, col]


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def _pairs(row1, v1, row2, v2, n):
    """All (row, v1, v2) of equal rows; rows are sorted."""
    import numpy as np

    count2 = np.bincount(row2, minlength=n)
    start2 = np.concatenate([[0], np.cumsum(count2)[:-1]])
    times = count2[row1]
    at = np.repeat(start2[row1] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.repeat(row1, times), np.repeat(v1, times), v2[at]


def keys(prints):
    """(row, key): 64-bit keys of fingerprints; any two within three bits share one.

    Three errors fall on three segments in one of two ways. Some segment i has none and another, j, at
    most one: the bits of i and a codeword near j (ordered pairs of segments). Or each has one: own
    codeword in one segment and near ones in the others, offered from both sides.
    """
    import numpy as np

    code, n = golay(), len(prints)
    parts = [(prints >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32) for at, bits in SEGMENTS]
    own = [code.index(p).astype(np.uint64) for p in parts]
    near = [code.near(p, bits) for p, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    rows, out = [], []
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, c = near[j]
                rows.append(row)
                out.append(np.uint64(tag) << np.uint64(60) | parts[i][row].astype(np.uint64) << np.uint64(12) | c.astype(np.uint64))
                tag += 1
    row, c0 = near[0]
    rows.append(row)
    out.append(np.uint64(tag) << np.uint64(60) | c0.astype(np.uint64) << np.uint64(24) | own[1][row] << np.uint64(12) | own[2][row])
    row, c1, c2 = _pairs(*near[1], *near[2], n)
    rows.append(row)
    out.append(np.uint64(tag) << np.uint64(60) | own[0][row] << np.uint64(24) | c1.astype(np.uint64) << np.uint64(12) | c2.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(prints), 4096):
            some = prints[k : k + 4096]
            row, key = keys(some)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(some[row].view(np.int64))], ["key", "bits"])


def forest(prints, distance: int = DISTANCE):
    """(root, member) of the linked groups among distinct fingerprints: one edge a member, no pairs.

    Grows each group from its first fingerprint; what is reached leaves the rest, so a dense group of
    m takes far fewer than m * m comparisons and a bucket never gives more than m edges.
    """
    import numpy as np

    roots, members, left = [], [], prints
    while len(left):
        root, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                got = left[near]
                queue.extend(got)
                members.append(got)
                roots.append(np.full(len(got), root))
                left = left[~near]
    return roots, members


def _links(distance: int):
    def run(batches):
        """Edges of the buckets; rows come sorted by key, a bucket may span batches."""
        import numpy as np
        import pyarrow as pa

        def edges(key, bits):
            roots, members = [], []
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cut)
            two = cut[:-1][size == 2]
            a, b = bits[two], bits[two + 1]
            ok = np.bitwise_count(a ^ b) <= distance
            roots.append(a[ok])
            members.append(b[ok])
            for s, e in zip(cut[:-1][size > 2], cut[1:][size > 2]):
                r, m = forest(np.sort(bits[s:e]), distance)
                roots += r
                members += m
            r, m = np.concatenate(roots), np.concatenate(members)
            both = np.unique(np.stack([np.minimum(r, m), np.maximum(r, m)], 1), axis=0)
            return pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy().view(np.int64)), pa.array(both[:, 1].copy().view(np.int64))], ["a", "b"]
            )

        held_key, held_bits = [], []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield edges(np.concatenate([*held_key, key[:last]]), np.concatenate([*held_bits, bits[:last]]))
                held_key, held_bits = [], []
            elif held_key and held_key[-1][-1] != key[0]:
                yield edges(np.concatenate(held_key), np.concatenate(held_bits))
                held_key, held_bits = [], []
            held_key.append(key[last:])
            held_bits.append(bits[last:])
        if held_key:
            yield edges(np.concatenate(held_key), np.concatenate(held_bits))

    return run


def simhash_groups(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Every row's SimHash fingerprint and group.

    1. Fingerprints in one narrow pass; equal ones become one row before anything else.
    2. Keys by Golay decoding (``keys``), dealt by key and sorted within partitions; each bucket gives
       the edges of a spanning forest of its fingerprints within ``distance`` bits, verified exactly.
       A bucket holds distinct fingerprints only, 16 bytes each, and makes no pairs.
    3. Connected components of the edges by joins; the group's id is its smallest doc_id.

    Returns doc_id, fingerprint (16 hex digits), component_id. A null or empty text has fingerprint
    zero and links like any other. Repeated rows each give a row; null doc_ids get a group too and
    never name one unless all its ids are null. Further columns of any name are ignored; an empty
    table gives an empty result. ``distance`` may be at most 3.
    """
    rows, roots = _grouped(docs, text, shingle, distance)
    group = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(group, "root").select("bits", "component_id")
    return rows.join(named, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, text: str, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, bits) of every row, and (bits, least doc_id, root) of every fingerprint."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), t.alias("text"), F.unhex(F.md5(t)).alias("digest"))
    rows = store(texts.mapInArrow(_fingerprints(shingle), "doc_id long, digest binary, bits long"), "prints")
    distinct = rows.groupBy("bits").agg(F.min("doc_id").alias("least"))
    keyed = distinct.select("bits").mapInArrow(_keyed, "key long, bits long")
    edges = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance), "a long, b long")
    labelled = distinct.join(components(edges), F.col("bits") == F.col("node"), "left")
    return rows, labelled.select("bits", "least", F.coalesce("root", "bits").alias("root"))
