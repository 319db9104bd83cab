"""Packing documents into training sequences: bounded-space online best fit per partition."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelbom.llm.common import store

LENGTH = 4096
#: Open windows per partition.
OPEN = 32
#: Partitions whose left-over windows are merged together: at most MERGE * OPEN windows a task.
MERGE = 16
#: Words whose ids a worker keeps; beyond it the memory is emptied and filled anew.
KNOWN_WORDS = 1_000_000
#: The id that ends a document.
END = 2

_PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("window", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("open", T.BooleanType()),
])


class WordIds:
    """Ids of texts by a tokenizer that never joins text across ASCII white space, kept per word.

    The vocabulary's normaliser and splitter work within runs without white space, so the ids of a text
    are those of its words in order. Of a word, a run of letters and the marks around it are encoded
    apart, as the splitter parts them too; any other word goes through the tokenizer whole. New letter
    runs are encoded in one call and parted at the ids that end a word.
    """

    _PARTS = re.compile(r'([!-&(-/:;=?@\[-`{}~]*)([^\W\d_]+)([!-&(-/:;=?@\[-`{}~]*)')

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes] = {b"": b""}
        self.runs: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        return self.np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, split: list[list[bytes]]) -> None:
        ids = self.ids
        new = set().union(*split).difference(ids)
        if len(ids) + len(new) > KNOWN_WORDS:
            self.ids, self.runs, new = {b"": b""}, {"": b""}, {w for words in split for w in words}
        parted, runs = {}, set()
        for w in new:
            m = self._PARTS.fullmatch(w.decode("utf-8"))
            low = m[2].lower() if m else ""
            if m and low.isalpha() and max(low) < "ɐ":
                parted[w] = (m[1], low, m[3])
                runs.add(low)
            else:
                self.ids[w] = self.encode(w.decode("utf-8"))
        self._learn_runs(sorted(runs - self.runs.keys()))
        for w, (before, low, after) in parted.items():
            for marks in (before, after):
                if marks not in self.runs:
                    self.runs[marks] = self.encode(marks)
            self.ids[w] = self.runs[before] + self.runs[low] + self.runs[after]

    def _learn_runs(self, runs: list[str]) -> None:
        for k in range(0, len(runs), 4096):
            some = runs[k : k + 4096]
            ids = self.np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = self.np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.runs.update((w, raw[a:b]) for w, a, b in zip(some, at, at[1:]))
            else:
                self.runs.update((w, self.encode(w)) for w in some)

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; a null text has none."""
        split = [(t or "").encode("utf-8").split() for t in texts]
        self.learn(split)
        ids = self.ids
        for words in split:
            yield b"".join(map(ids.__getitem__, words))


_TOKENIZERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer, kept between its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


class Windows:
    """A fixed number of open windows; pieces go where the least room is left."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.next = length, most, {}, 0

    def place(self, n: int) -> tuple[int, int]:
        """(window, offset) of a piece of n <= length ids."""
        best = max((u for u in self.open.values() if u + n <= self.length), default=None)
        if best is None:
            if len(self.open) == self.most:
                del self.open[max(self.open, key=self.open.get)]
            window, best, self.next = self.next, 0, self.next + 1
        else:
            window = next(w for w, u in self.open.items() if u == best)
        self.open[window] = best + n
        if best + n == self.length:
            del self.open[window]
        return window, best


def _slices(batches, most: int = 1 << 22):
    """Lists of (doc_id, text) of some MB each, so that one batch of long texts stays small."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = (row[0], row[1].as_py())
            rows.append(row)
            size += len(row[1] or "")
            if size >= most:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _packer(path: str, length: int, most: int):
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_PIECE)
        part, windows, tok = TaskContext.get().partitionId(), Windows(length, most), word_ids(path)
        end = END.to_bytes(4, "little")

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for rows in _slices(batches):
            out = []
            for (doc, _), ids in zip(rows, tok.texts(t for _, t in rows), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    raw = ids[4 * start : 4 * (start + length)]
                    n = len(raw) // 4
                    out.append((doc, start, n, zlib.crc32(raw), total, part, *windows.place(n), False))
            yield table(out)
        if windows.open:
            yield table([(None, None, u, None, None, part, w, 0, True) for w, u in windows.open.items()])

    return pack


def _merge(length: int):
    def merge(pdf):
        """Left-over windows, largest first, into the fullest merged window with room."""
        import pandas as pd

        rows, used = [], []
        for p, w, n in sorted(zip(pdf["part"], pdf["window"], pdf["length"]), key=lambda x: (-x[2], x[0], x[1])):
            at = max((k for k, (u, _) in enumerate(used) if u + n <= length), key=lambda k: used[k][0], default=None)
            if at is None:
                used.append([0, (p, w)])
                at = len(used) - 1
            rows.append((p, w, *used[at][1], used[at][0]))
            used[at][0] += n
        return pd.DataFrame(rows, columns=["part", "window", "to_part", "to_window", "base"])

    return merge


def pack(docs: DataFrame, tokenizer: str, text: str = "text", length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids.

    A document's ids are those of its words by ``tokenizer`` (a tokenizers file), without special tokens,
    then the id 2. Documents over ``length`` ids are cut into whole sequences and a rest. Within each
    input partition a fixed number of windows is open; a piece goes to the one with least room that
    takes it; if none does, the fullest is emitted and a new one begins. Windows open at a partition's
    end are merged best-fit, those of MERGE partitions at a time. Only pieces' places move, never ids.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is
    the id 2 alone; null doc_ids and repeated rows are documents of their own; an empty table gives no
    rows; further columns of any name are ignored. Sequence ids are unique, with gaps, and depend on
    how the input is split into partitions; the pieces' ids do not.
    """
    made = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").alias("text")).mapInArrow(
        _packer(tokenizer, length, open_windows), _PIECE
    )
    made = store(made, "pieces")
    merged = (
        made.where("open").select("part", "window", "length")
        .groupBy(F.floor(F.col("part") / MERGE).alias("near"))
        .applyInPandas(_merge(length), "part long, window long, to_part long, to_window long, base long")
    )
    pieces = made.where("not open").join(merged, ["part", "window"], "left")
    sequence = F.coalesce("to_part", "part") * (1 << 32) + F.coalesce("to_window", "window")
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
