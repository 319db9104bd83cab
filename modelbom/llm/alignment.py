"""Cross-tokenizer alignment: token groups of two tokenizers by divide and conquer at shared cuts.

Both tokenizers cut the same bytes. An interval of a text is divided at a common token end near its
middle, found by bisecting the other side's ends; both halves are divided in turn, and an interval
without a common end inside is a group. All intervals of a level are divided together in numpy.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import store

#: Characters that a worker aligns at a time.
SLICE = 1 << 21
#: Probes around the middle before a whole interval is looked through.
PROBES = 6
#: Runs without white space from which on the slower tokenizer with a heap is used.
LONG_RUN = 2000

_SAFE = re.compile(r"(?<=\S) ")
_LONG = re.compile(rf"\S{{{LONG_RUN}}}")


class ByteLevel:
    """Side A: a byte-level BPE of a tokenizers file; ids of space + text, strings of special tokens as plain text.

    Where the file's merges are in the order of their ids, texts go through the same ranks in tiktoken,
    which is several times faster; a text with a long run without white space, and any other file,
    goes through tokenizers.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocab = {t: i for t, i in self.slow.get_vocab().items() if t in model["vocab"]}
        self.size = max(self.slow.get_vocab().values()) + 1
        self.bytes = [b""] * self.size
        for t, i in vocab.items():
            if all(c in byte_of for c in t):
                self.bytes[i] = bytes(byte_of[c] for c in t)
        self.lengths = np.array([len(b) for b in self.bytes])
        self.fast = self._ranks(model)

    def _ranks(self, model):
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][t] for t in joined]
        if ids != sorted(ids):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes[i]: i for i in model["vocab"].values() if self.bytes[i]}
        own = self.slow.get_added_tokens_decoder()
        ranks = {b: i for b, i in ranks.items() if i not in own}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _LONG.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """Side B: a sentencepiece model that adds the leading space itself."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes])
        # A text can be cut before a space if no piece goes on over one.
        self.splits = not any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(self.size))

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with the space the model adds."""
        if text == " ":
            return [self.model.piece_to_id("▁")]
        return self.model.encode(text[1:])


def bisected(ends_a, ends_b):
    """For every A token the first B token that does not end before it; found by bisection."""
    import numpy as np

    return np.searchsorted(ends_b, ends_a)


def common_ends(ends_a, ends_b, at_b, tops_a, tops_b):
    """Sorted indexes (into A, into B) of all tokens whose ends both sides share.

    ``ends_a`` and ``ends_b`` are the rising byte ends of the tokens of one or more texts laid end to end,
    ``at_b`` their ``bisected``; ``tops_a`` and ``tops_b`` the numbers of tokens up to each text's end, where both sides end.
    """
    import numpy as np

    a1, b1 = np.asarray(tops_a), np.asarray(tops_b)
    some = np.diff(a1, prepend=0) > 0
    a1, b1 = a1[some], b1[some]
    a0, b0 = np.concatenate([[0], a1[:-1]]), np.concatenate([[0], b1[:-1]])
    found_a, found_b = [a1 - 1], [b1 - 1]
    while len(a0):
        inner = (a1 - a0 > 1) & (b1 - b0 > 1)  # an end inside on both sides
        a0, a1, b0, b1 = a0[inner], a1[inner], b0[inner], b1[inner]
        middle, cut_a, cut_b = (a0 + a1 - 2) // 2, np.full(len(a0), -1), np.full(len(a0), -1)
        open_ = np.arange(len(a0))
        for k in range(PROBES):
            step = (k + 1) // 2 * (1 if k % 2 else -1)
            i = middle[open_] + step
            inside = (i >= a0[open_]) & (i < a1[open_] - 1)
            at = np.where(inside, i, a0[open_])
            j = at_b[at]
            hit = inside & (ends_b[j] == ends_a[at])
            cut_a[open_[hit]], cut_b[open_[hit]] = at[hit], j[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        for n in open_[a1[open_] - a0[open_] > PROBES]:  # few: look through the interval, nearest to the middle first
            ends = ends_a[a0[n] : a1[n] - 1]
            j = at_b[a0[n] : a1[n] - 1]
            same = np.flatnonzero(ends_b[j] == ends)
            if len(same):
                best = same[np.argmin(np.abs(same + a0[n] - middle[n]))]
                cut_a[n], cut_b[n] = a0[n] + best, j[best]
        cut = cut_a >= 0
        a0, a1, b0, b1, i, j = a0[cut], a1[cut], b0[cut], b1[cut], cut_a[cut], cut_b[cut]
        found_a.append(i)
        found_b.append(j)
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0, i + 1), (i + 1, a1), (b0, j + 1), (j + 1, b1)))
    return np.sort(np.concatenate(found_a)), np.sort(np.concatenate(found_b))


def overlaps(ends_a, ends_b, at_b):
    """(index into A, index into B) of every pair of tokens whose byte ranges overlap."""
    import numpy as np

    # An A token's first B token is the last one of the A token before, or the next if both end there.
    low = np.concatenate([[0], at_b[:-1] + (ends_b[at_b[:-1]] == ends_a[:-1])])
    n = at_b - low + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return a, b


class Aligner:
    """Both tokenizers of a worker and the alignment of a list of texts."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        self.np, self.a, self.b = np, ByteLevel(path_a), Pieces(path_b)
        # One group is written as 'a,a|b,b'; a table has each id with what follows it.
        self.names = [f"{i}{x}" for i in range(self.a.size) for x in ",|"] + [f"{i}{x}" for i in range(self.b.size) for x in ",;"]

    def segments(self, text: str):
        """The text after its leading space, cut before spaces where both tokenizers cut too, if it is long."""
        text = " " + text
        at = 0
        if self.b.splits and "▁" not in text:
            while len(text) - at > SLICE:
                m = _SAFE.search(text, at + SLICE // 2)
                if not m:
                    break
                yield text[at : m.start()]
                at = m.start()
        yield text[at:]

    def ids(self, text: str):
        """Ids of both sides, or None where their bytes are not those of the text."""
        np = self.np
        a, b, raw = self.a.encode(text), self.b.encode(text), text.encode("utf-8")
        bytes_a, bytes_b = [self.a.bytes[i] for i in a], [self.b.bytes[i] for i in b]
        if b"".join(bytes_b) != raw or b"".join(bytes_a) != raw or b"" in bytes_a or b"" in bytes_b:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, texts: list[str]):
        """Of texts that begin with a space: None, or ids of both sides and the group ends among them, and links.

        A dict of arrays for each text: a, b (ids), group_a, group_b (indexes of the groups' last tokens),
        pairs (a * size of B + b, distinct) and counts (their links).
        """
        np = self.np
        out, have = [None] * len(texts), [(n, x) for n, t in enumerate(texts) if (x := self.ids(t))]
        if not have:
            return out
        a, b = (np.concatenate([x[k] for _, x in have]) for k in (0, 1))
        tops_a, tops_b = (np.cumsum([len(x[k]) for _, x in have]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        at_b = bisected(ends_a, ends_b)
        cut_a, cut_b = common_ends(ends_a, ends_b, at_b, tops_a, tops_b)
        link_a, link_b = overlaps(ends_a, ends_b, at_b)
        text_of = np.searchsorted(tops_a, link_a, "right")
        wide = self.a.size * self.b.size
        pairs, counts = np.unique(text_of * wide + a[link_a] * self.b.size + b[link_b], return_counts=True)
        top_p = np.searchsorted(pairs, np.arange(1, len(have) + 1) * wide)
        top_c = np.searchsorted(cut_a, tops_a - 1) + 1
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        # The groups in writing order: A tokens of a group, then its B tokens.
        before_b = np.concatenate([[0], cut_b[:-1] + 1])
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + before_b[group_a]] = 2 * a + last_a
        written[np.arange(len(b)) + cut_a[group_b] + 1] = 2 * (self.a.size + b) + last_b
        low = [0, 0, 0, 0]
        for k, (n, _) in enumerate(have):
            top = [int(x[k]) for x in (tops_a, tops_b, top_c, top_p)]
            sa, sb, sc, sp = (slice(x, y) for x, y in zip(low, top))
            out[n] = {
                "a": a[sa], "b": b[sb], "group_a": cut_a[sc] - low[0], "group_b": cut_b[sc] - low[1],
                "pairs": pairs[sp] - k * wide, "counts": counts[sp], "written": written[low[0] + low[1] : top[0] + top[1]],
            }
            low = top
        return out

    def text(self, one) -> bytes:
        """The groups of an aligned text as 'a,a|b;a|b,b'."""
        return "".join([self.names[i] for i in one["written"].tolist()])[:-1].encode()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's tokenizers, kept between its tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _aligned(al: Aligner, batches):
    """(number, doc_id, aligned segments) of each row in order; no segments: no tokens."""
    number, todo, size = 0, [], 0

    def done(todo):
        parts = iter(al.align([s for _, _, segments in todo for s in segments]))
        for n, doc, segments in todo:
            yield n, doc, [next(parts) for _ in segments]

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            t = text.as_py()
            todo.append((number, doc.as_py(), list(al.segments(t)) if t else []))
            number, size = number + 1, size + len(t or "")
            if size >= SLICE:
                if len(todo) > 1:
                    yield from done(todo[:-1])
                n, doc_id, segments = todo[-1]  # a long text goes a few segments at a time
                yield n, doc_id, [x for k in range(0, len(segments), 2) for x in al.align(segments[k : k + 2])]
                todo, size = [], 0
    yield from done(todo)


def _whole(parts):
    return bool(parts) and all(p is not None for p in parts)


def _group_rows(path_a, path_b):
    def run(batches):
        import pyarrow as pa

        al = aligner(path_a, path_b)
        for _, doc, parts in _aligned(al, batches):
            a, b, ends_a, ends_b = [], [], [], []
            for p in parts if _whole(parts) else []:
                ends_a += (p["group_a"] + len(a) + 1).tolist()
                ends_b += (p["group_b"] + len(b) + 1).tolist()
                a += p["a"].tolist()
                b += p["b"].tolist()
            kinds = [pa.int64()] + [pa.list_(pa.int32())] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((doc, a, b, ends_a, ends_b), kinds)],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"],
            )

    return run


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The groups of every document: doc_id, a_ids, b_ids and, per group, a_ends and b_ends.

    Group k has the A tokens from a_ends[k - 1] (or 0) up to a_ends[k], and the B tokens likewise. A null
    or empty text, and one whose bytes a tokenizer changes, has empty lists. Rows as in ``link_counts``.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text")).mapInArrow(
        _group_rows(path_a, path_b), "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"
    )


_ROW = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<long>"


def _link_rows(path_a, path_b):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        al, part, rows, held = aligner(path_a, path_b), TaskContext.get().partitionId() << 40, [], 0
        names = [c.split(" ")[0] for c in _ROW.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 2

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for n, doc, parts in _aligned(al, batches):
            if not _whole(parts):
                rows.append((part + n, doc, 0, 0, 0, 0, "", [], []))
            else:
                digest = hashlib.sha256()
                for k, p in enumerate(parts):
                    digest.update(b";" * (k > 0) + al.text(p))
                pairs, counts = parts[0]["pairs"], parts[0]["counts"]
                if len(parts) > 1:
                    pairs, at = np.unique(np.concatenate([p["pairs"] for p in parts]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([p["counts"] for p in parts])).astype(np.int64)
                sums = [sum(len(p[c]) for p in parts) for c in ("a", "b", "group_a")]
                rows.append((part + n, doc, *sums, int(counts.sum()), digest.hexdigest(), pairs, counts))
                held += len(pairs)
            if held > 200_000 or len(rows) >= 5000:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    return run


def link_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Alignment of every document, with the corpus-wide counts of its linked id pairs.

    A text is tokenized as space + text by the byte-level BPE ``path_a`` and by the sentencepiece model
    ``path_b``. Groups lie between byte offsets where tokens of both end. A link is a pair of an A and a B token
    whose byte ranges overlap; the count of an id pair is the number of links in the corpus that hold it.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its B id, ties
    included), count_sum (the counts over all links) and groups_sha256 (of 'a,a|b;a|b,b', see ``Aligner.text``).
    A null or empty text, and one whose bytes a tokenizer changes, has zeros and ''. Null doc_ids and
    repeated rows are documents of their own and count each; further columns of any name are ignored; an
    empty table gives no rows. A text of over 2 M characters is aligned in parts, cut before spaces at which
    both tokenizers cut; one without such spaces is held whole in its task.

    One pass tokenizes; its pairs per document are stored, summed by pair (map side first) and joined back by pair.
    """
    size_b = aligner(path_a, path_b).b.size
    made = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text"))
    made = store(made.mapInArrow(_link_rows(path_a, path_b), _ROW), "alignment")
    each = made.select("row_key", F.inline(F.arrays_zip("pairs", "counts")))
    each = each.select("row_key", F.col("pairs").alias("pair"), F.col("counts").alias("n"))
    total = store(each.groupBy("pair").agg(F.sum("n").alias("c")), "pairs")
    total = total.withColumn("b", F.pmod("pair", F.lit(size_b)))
    most = total.groupBy("b").agg(F.max("c").alias("m"))
    known = total.join(most, "b").select("pair", "c", (F.col("c") == F.col("m")).cast("long").alias("best"))
    # The sides' sizes differ much: hash the known pairs of a partition instead of sorting all documents' pairs.
    sums = each.join(known.hint("shuffle_hash"), "pair").groupBy("row_key").agg(
        F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("c")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return made.drop("pairs", "counts").join(sums, "row_key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
