"""Near copies by the Jaccard similarity of five-word shingles: Golay keys of SimHash fingerprints find pairs, MinHash
bands the few that these miss, whole sets decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import components, store, store_small
from modelbom.llm.decontaminate import _mix, _Symbols
from modelbom.llm.simhash import golay


@dataclass(frozen=True)
class Rule:
    """Texts are linked when the sets of their ``shingle``-word runs have a Jaccard similarity of ``least`` or more."""

    shingle: int = 5
    least: float = 0.8
    #: 64-bit SimHash fingerprints of a set, and keys: each has the codeword next to 23 bits and ``exact`` bits as they are,
    #: at places of its own. At 0.8 two fingerprints differ in 15 % of the bits, and 0.94 of the pairs share a key; at 0.9, 0.999.
    prints: int = 16
    codes: int = 128
    exact: int = 10
    #: Most bits by which the first fingerprints of a candidate differ: the mean at ``least`` plus three deviations.
    apart: int = 19
    #: Rows of a bucket that is compared at once with others; a larger one is walked alone.
    few: int = 16
    #: Minima of a band, and bands: a pair at 0.8 shares none with a chance of (1 - 0.8 ** 6) ** 50 = 2.5e-7.
    rows: int = 6
    bands: int = 50
    #: Bits of the sketch; pairs that agree in fewer than the mean at ``least`` minus six deviations are no candidates.
    sketch: int = 256
    #: Nodes, and shingles, of a block; a larger bucket is compared block by block, in tasks of their own.
    block: int = 1024
    block_shingles: int = 1 << 20

    @property
    def agree(self) -> int:
        p = (1 + self.least) / 2
        return int(self.sketch * p - 6 * (self.sketch * p * (1 - p)) ** 0.5)


def shingles(text: str | None, symbols: dict, size: int = Rule.shingle):
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; a shorter text is one run, an empty one has none."""
    import numpy as np

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    words += [b""] * (size - len(words))
    s = np.frombuffer(b"".join(map(symbols.__getitem__, words)), "<u8")
    n = len(s) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += s[k : k + n]
    return np.unique(_mix(h))


def _draws(rule: Rule):
    import numpy as np

    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 32, (rule.rows * rule.bands, 2), np.uint32) | np.array([0, 1], np.uint32)


def minima(sets, draws):
    """(texts, hashes) least values of non-empty sets."""
    import numpy as np

    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, buf = np.empty((len(sets), len(draws)), np.uint32), np.empty_like(h)
    for k, (x, a) in enumerate(draws):
        np.bitwise_xor(h, x, out=buf)
        np.multiply(buf, a, out=buf)
        out[:, k] = np.minimum.reduceat(buf, starts)
    return out


def fingerprints(sets, count: int):
    """(texts, 64 * count) bits of the SimHash fingerprints of non-empty sets: 1 if set in over half the hashes."""
    import numpy as np

    h, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    runs = -(-sizes // 255)  # eight counters of a byte each are added at once, over 255 hashes at most
    first = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes - 255 * first, runs) + 255 * np.arange(runs.sum())
    out = np.empty((len(sets), 64 * count), np.uint8)
    for f in range(count):
        x = _mix(h ^ _mix(np.array([f + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        for k in range(8):
            some = np.add.reduceat(x >> np.uint64(k) & np.uint64(0x0101010101010101), starts)
            ones = np.add.reduceat(some.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
            out[:, f * 64 + k * 8 : f * 64 + k * 8 + 8] = 2 * ones > sizes[:, None]
    return out


def _places(rule: Rule):
    """(codes, 64) places of the bits of each key: 23 to decode, those kept exact, and a bit that is always 0 for the rest."""
    import numpy as np

    rng, n = np.random.default_rng(7), 64 * rule.prints
    at = np.full((rule.codes, 64), n)
    for row in at:
        drawn = rng.choice(n, 23 + rule.exact, replace=False)
        row[:23], row[32 : 32 + rule.exact] = drawn[:23], drawn[23:]
    return at


def codes_of(bits, rule: Rule, places):
    """(texts, codes) keys of fingerprints: number of the key, Golay codeword, exact bits."""
    import numpy as np

    bits = np.concatenate([bits, np.zeros((len(bits), 1), np.uint8)], axis=1)
    cells = np.packbits(bits[:, places], axis=2, bitorder="little").view("<u4")
    fuzzy = golay().index(cells[:, :, 0]).astype(np.int64)
    return (np.arange(rule.codes) << 12 | fuzzy) << rule.exact | cells[:, :, 1]


def _coded(rule: Rule):
    def run(batches):
        """Per key of a node the key, the node and its first fingerprint."""
        import numpy as np
        import pyarrow as pa

        places = _places(rule)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                packed = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                keys = codes_of(np.unpackbits(packed, axis=1), rule, places)
                node, bits = b.column(0).to_numpy(zero_copy_only=False), packed[:, :8].copy().view("<i8")[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(node, rule.codes)), pa.array(np.repeat(bits, rule.codes))], ["key", "node", "bits"]
                )

    return run


def _tree(node, bits, apart: int):
    """Edges of a spanning forest of the nodes whose fingerprints are near, each of a pair that is near."""
    import numpy as np

    a, b, left = [], [], np.arange(len(node))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= apart
            if near.any():
                got = left[near]
                queue.extend(got)
                a.append(np.full(len(got), node[at]))
                b.append(node[got])
                left = left[~near]
    return a, b


def _alike(rule: Rule):
    def run(batches):
        """Candidates of the buckets of one Golay key, fewer than its rows: every node with the least one that is near.
        Rows come sorted by key and node, a bucket may span batches."""
        import numpy as np
        import pyarrow as pa

        def pairs(parts):
            key, node, bits = map(np.concatenate, zip(*parts))
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            size = np.diff(cut)
            small, least = np.repeat(size <= rule.few, size), np.arange(len(key))
            for lag in range(1, rule.few):
                at = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
                if not len(at):
                    break
                at = at[np.bitwise_count(bits[at] ^ bits[at + lag]) <= rule.apart]
                least[at + lag] = at  # of all that are near the farthest back stays
            at = np.flatnonzero(least != np.arange(len(key)))
            a, b = [node[least[at]]], [node[at]]
            for s, e in zip(cut[:-1][size > rule.few], cut[1:][size > rule.few]):
                x, y = _tree(node[s:e], bits[s:e], rule.apart)
                a += x
                b += y
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, bits = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            bits, last = bits.view(np.uint64), int(np.searchsorted(key, key[-1], "left"))
            if last or (held and held[-1][0][-1] != key[0]):
                yield pairs([*held, (key[:last], node[:last], bits[:last])])
                held = []
            held.append((key[last:], node[last:], bits[last:]))
        if held:
            yield pairs(held)

    return run


def code_pairs(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of nodes that share a Golay key and are near by their first fingerprint, not yet verified."""
    keyed = nodes.where(F.length("bits") > 0).select("node", "bits").mapInArrow(_coded(rule), "key long, node long, bits long")
    keyed = keyed.repartition("key").sortWithinPartitions("key", "node")
    return keyed.mapInArrow(_gathered(_alike(rule)), "a long, b long").distinct()


def _sketched(rule: Rule):
    def run(batches):
        """Pairs (a, b) with the sizes and sketches of both, without those that cannot be near."""
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                size, other = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
                near = _near(size, _words_of(batch.column("sketch_a").to_pylist()), other, _words_of(batch.column("sketch_b").to_pylist()), rule)
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _prints(rule: Rule):
    def run(batches):
        """Per text its node (hash of its set), the set's size, a sketch, the keys of all bands and the SimHash bits."""
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        symbols, draws = _Symbols(), _draws(rule)
        names = ["doc_id", "digest", "node", "size", "sketch", "keys", "bits"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def made(rows):
            full = [r for r in rows if len(r[2])]
            sketch, keys, votes = {}, {}, {}
            if full:
                low = minima([r[2] for r in full], draws)
                bits = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(31)
                packed = np.packbits(bits[:, : rule.sketch].astype(np.uint8), axis=1)
                band = np.broadcast_to(np.arange(1, rule.bands + 1, dtype=np.uint64), (len(full), rule.bands)).copy()
                cells = low.reshape(len(full), rule.bands, rule.rows)
                for k in range(rule.rows):
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
                simhash = np.packbits(fingerprints([r[2] for r in full], rule.prints), axis=1)
                for r, p, b, v in zip(full, packed, band, simhash):
                    sketch[id(r)], keys[id(r)], votes[id(r)] = p.tobytes(), b.tobytes(), v.tobytes()
            out = [
                (d, g, np.uint64(xxh64_intdigest(s.tobytes())).view(np.int64), len(s), *(x.get(id(r), b"") for x in (sketch, keys, votes)))
                for r in rows for d, g, s in [r]
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for b in batches:
            rows, size = [], 0
            for doc_id, text, digest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                rows.append((doc_id, digest, shingles(text.as_py(), symbols, rule.shingle)))
                size += len(rows[-1][2])
                if size >= 1 << 17:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return run


def _keyed(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        key = np.frombuffer(b"".join(b.column(3).to_pylist()), "<i8")
        row = np.repeat(np.arange(b.num_rows), [len(k) // 8 for k in b.column(3).to_pylist()])
        for k in range(0, len(key), 1 << 16):
            some = pa.array(row[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[k : k + (1 << 16)]), *[b.column(c).take(some) for c in range(3)]], ["key", "node", "size", "sketch"]
            )


def _near(size, sketch, other_size, other_sketch, rule: Rule):
    """Which pairs can reach the least similarity, by the sizes of their sets and their sketches."""
    import numpy as np

    ratio = np.minimum(size, other_size) >= rule.least * np.maximum(size, other_size) - 1e-9
    return ratio & (rule.sketch - np.bitwise_count(sketch ^ other_sketch).sum(-1, dtype=np.int64) >= rule.agree)


def _buckets(batches, columns, texts=("sketch",)):
    """Columns of one group after the other, numbers as arrays and binaries as lists; rows come sorted by the
    first column, a group may span batches. Groups of one row are passed over."""
    import numpy as np

    held, n = None, len(columns)
    for b in batches:
        if not b.num_rows:
            continue
        got = [b.column(c).to_numpy(zero_copy_only=False) for c in columns] + [b.column(c).to_pylist() for c in texts]
        if held is not None:
            got = [np.concatenate([h, g]) if k < n else h + g for k, (h, g) in enumerate(zip(held, got))]
        key = got[0]
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(cut)
        for s, m in zip(cut[:-1][size > 1], size[size > 1]):
            yield [g[s : s + m] for g in got]
        held = [g[cut[-1] :] for g in got]
    if held is not None and len(held[0]) > 1:
        yield held


def _gathered(run, rows: int = 1 << 14, most: int = 1 << 23):
    """The batches of ``run`` put together to larger ones of some MB: a batch per bucket or text would be many tiny ones.
    A task gives its unused memory back at its end, as the worker lives on."""
    def gathered(batches):
        import pyarrow as pa

        held, n, size = [], 0, 0
        for b in run(batches):
            if b.num_rows:
                held.append(b)
                n, size = n + b.num_rows, size + b.nbytes
            if n >= rows or size >= most or len(held) >= rows // 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = None
        pa.default_memory_pool().release_unused()

    return gathered


def _words_of(sketches):
    import numpy as np

    return np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)


def _keys_of(packed):
    import numpy as np

    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), -1)


def _stars(rule: Rule):
    def run(batches):
        """The rows of buckets of two or more with their first node, and whether they can be near it."""
        import numpy as np
        import pyarrow as pa

        for key, node, size, sketches in _buckets(batches, ["key", "node", "size"]):
            first, sketch = int(node.argmin()), _words_of(sketches)
            near = _near(size, sketch, size[first], sketch[first], rule) & (node != node[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(node), pa.array(size), pa.array(sketches, pa.binary()), pa.array(np.full(len(key), node[first])), pa.array(near)],
                ["key", "node", "size", "sketch", "first", "near"],
            )

    return run


def _open(rule: Rule):
    def run(batches):
        """The rows of a pair of blocks that can be near a node of another group there: rows, never pairs.

        Two nodes may share several keys; only in the bucket of the least one do they count.
        """
        import numpy as np
        import pyarrow as pa

        columns = ["part", "key", "node", "size", "root", "own", "cross"]
        for part, key, node, size, root, own, cross, sketches, packed in _buckets(batches, columns, ("sketch", "keys")):
            sketch, keys, found = _words_of(sketches), _keys_of(packed), np.zeros(len(node), bool)
            for i in range(len(node)):
                at = np.flatnonzero((root != root[i]) & (~cross[i] | (own != own[i])))
                at = at[_near(size[at], sketch[at], size[i], sketch[i], rule)]
                found[i] = (~((keys[at] == keys[i]) & (keys[i] < key[i])).any(1)).any()
            some = [pa.array(x[found]) for x in (part, key, node, root, own, cross)]
            some.append(pa.array([k for k, f in zip(packed, found) if f], pa.binary()))
            yield pa.RecordBatch.from_arrays(some, ["part", "key", "node", "root", "own", "cross", "keys"])

    return run


def _linked(rule: Rule):
    def run(batches):
        """Edges that join the groups of a pair of blocks, verified by whole sets: fewer than its nodes."""
        import numpy as np
        import pyarrow as pa

        for _, key, node, root, own, cross, sets, keys in _buckets(batches, ["part", "key", "node", "root", "own", "cross"], ("set", "keys")):
            sets, keys = [np.frombuffer(x, "<u8") for x in sets], _keys_of(keys)
            sizes = np.array([len(x) for x in sets])
            _, codes = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(sizes)
            group, a, b = root.copy(), [], []
            has = np.zeros(codes.max() + 1, bool)
            for i in range(len(node) - 1):
                j = np.arange(i + 1, len(node))
                j = j[(group[j] != group[i]) & (~cross[i] | (own[j] != own[i]))]
                j = j[np.minimum(sizes[j], sizes[i]) >= rule.least * np.maximum(sizes[j], sizes[i]) - 1e-9]
                j = j[~((keys[j] == keys[i]) & (keys[i] < key[i])).any(1)]
                if not len(j):
                    continue
                has[codes[ends[i] - sizes[i] : ends[i]]] = True
                both = np.array([np.count_nonzero(has[codes[ends[x] - sizes[x] : ends[x]]]) for x in j])
                has[codes[ends[i] - sizes[i] : ends[i]]] = False
                for x in j[both >= rule.least * (sizes[i] + sizes[j] - both) - 1e-9]:
                    if group[x] != group[i]:
                        a.append(node[i])
                        b.append(node[x])
                        group[group == group[x]] = group[i]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return run


def _sets(rule: Rule):
    def run(batches):
        import pyarrow as pa

        symbols = _Symbols()
        for b in batches:
            for k in range(b.num_rows):
                s = shingles(b.column(1)[k].as_py(), symbols, rule.shingle).tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([s], pa.binary())], ["node", "set"])

    return run


def _verified(rule: Rule):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / (len(x) + len(y) - both) >= rule.least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _printed(docs: DataFrame, text: str, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text, digest) and the stored prints of every row, and those of every distinct set of shingles."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), t.alias("text"), F.unhex(F.md5(t)).alias("digest"))
    schema = "doc_id long, digest binary, node long, size int, sketch binary, keys binary, bits binary"
    rows = store_small(texts.mapInArrow(_gathered(_prints(rule)), schema), "prints")
    return texts, rows, rows.select("node", "size", "sketch", "keys", "bits").dropDuplicates(["node"])


def _grouped(docs: DataFrame, text: str, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, node) of every row, and (node, root) of every distinct set of shingles."""
    texts, rows, nodes = _printed(docs, text, rule)
    coded = code_pairs(nodes, rule)
    for x in "ab":
        coded = coded.join(nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    coded = store(coded.mapInArrow(_gathered(_sketched(rule)), "a long, b long"), "coded")
    keyed = nodes.mapInArrow(_keyed, "key long, node long, size int, sketch binary")
    buckets = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(
        _gathered(_stars(rule)), "key long, node long, size int, sketch binary, first long, near boolean"
    )
    buckets = store_small(buckets, "buckets")
    one = rows.groupBy("node").agg(F.min("digest").alias("digest"))

    def sets_of(ends):
        wanted = texts.select("digest", "text").join(one.join(ends, "node", "left_semi"), "digest").dropDuplicates(["node"])
        return store_small(wanted.select("node", "text").mapInArrow(_gathered(_sets(rule)), "node long, set binary"), "sets")

    def rooted(frame, found):
        found = found.withColumnRenamed("node", "n")
        return frame.join(found, F.col("node") == F.col("n"), "left").withColumn("root", F.coalesce("root", "node")).drop("n")

    def verified(pairs, sets):
        sides = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return sides.mapInArrow(_gathered(_verified(rule)), "a long, b long")

    # Every node with the least one that the Golay keys found, and with the first of its band's bucket: as many pairs as rows.
    least = coded.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    stars = buckets.where("near").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = store(least.union(stars).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    edges = store_small(verified(pairs, sets), "edges")
    # All others that the Golay keys found, but for pairs of one group by then.
    groups = components(edges)
    ends = [groups.toDF(x, f"root_{x}") for x in "ab"]
    rest = coded.join(pairs, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    rest = store(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    # Buckets that hold several groups by then, in blocks: their nodes meet in every pair of blocks.
    some = store(rooted(buckets.select("key", "node", "size", "sketch"), groups), "rooted")
    several = some.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("all"), F.min("root").alias("x"), F.max("root").alias("y")
    ).where("x < y")
    blocks = F.greatest(F.ceil(F.col("n") / rule.block), F.ceil(F.col("all") / rule.block_shingles))
    dealt = some.join(several.select("key", blocks.alias("blocks")), "key").join(nodes.select("node", "keys"), "node")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    part = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(part.alias("part"), "key", "node", "size", "sketch", "keys", "root", "own", (F.col("own") != F.col("other")).alias("x"))
    # Of a pair of two blocks only nodes of different ones are compared; a block with itself is a pair too.
    dealt = dealt.withColumn("cross", F.col("x")).drop("x")
    opened = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(
        _gathered(_open(rule)), "part long, key long, node long, root long, own long, cross boolean, keys binary"
    )
    opened = store_small(opened, "open")
    sets = sets_of(opened.select("node").union(rest.select("a")).union(rest.select("b")).distinct())
    more = opened.join(sets, "node").repartition("part").sortWithinPartitions("part").mapInArrow(_gathered(_linked(rule)), "a long, b long")
    more = store_small(more.union(verified(rest, sets)), "edges")
    # The groups so far are stars already, which take fewer rounds than the edges they came from.
    groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))
    return rows.select("doc_id", "digest", "node"), rooted(nodes.select("node"), groups)


def one_of_each(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that stand for a group: the one of the smallest doc_id (null last), with all columns.

    Groups are the connected components of the pairs of texts that ``rule`` links.

    1. One narrow pass gives each text the SimHash fingerprints of its set, and the set's minima under 300 hashes: keys of
       six minima, and a sketch of a bit each. Texts of equal sets are one node from here on.
    2. Golay decoding of the fingerprints gives 128 keys a node (``codes_of``). Nodes that share one and are near by their first
       fingerprint are candidates: in a bucket each with the least node that is near, so never all pairs, if sizes and sketches allow.
       This finds 0.94 of the pairs at a similarity of 0.8 and 0.999 at 0.9. A node's least candidate is verified first,
       the others with step 4 where they still join two groups.
    3. So that no pair is lost, a supplement: in a bucket of a MinHash key every node is paired with the first one, if sizes and
       sketches allow. The candidates of both are verified by their whole sets and give the groups so far.
    4. MinHash buckets that hold several groups by then are compared in blocks: a task has a pair of blocks of a bucket, marks the
       nodes that sizes and sketches allow to be near one of another group, gets the sets of these, and gives only edges that
       join groups. So neither a large group of near copies nor one of near misses makes rows for its pairs (the comparisons of
       near misses still grow with the square of their number, in tasks of a block pair each), and a pair is missed only if it
       shares no key of either kind.

    Of rows equal in doc_id the one with the least MD5 of the text stays, of rows equal in both any one.
    Null and texts without words are copies of each other; a text of fewer than five words is one shingle.
    """
    rows, roots = _grouped(docs, text, rule)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    stays = rows.join(roots, "node").groupBy("root").agg(F.min(place).alias("p"))
    stays = stays.select(F.col("p.doc_id").alias("_doc"), F.col("p.digest").alias("_digest"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    marked = docs.select(F.col("doc_id").cast("long").alias("d"), digest.alias("g"), row.alias("row"))
    kept = marked.join(store(stays, "stays"), F.col("d").eqNullSafe(F.col("_doc")) & (F.col("g") == F.col("_digest")), "left_semi")
    return kept.dropDuplicates(["d", "g"]).select("row.*")
