"""Line deduplication: winnowing over line hashes finds runs of lines that occurred before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import store

#: A run is this many consecutive lines, or fewer that have together at least so many characters (some 50 words).
RUN, CHARS = 3, 250
#: A line with a word.
_WORDED = r"[^ \t-\r]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside lambdas nothing else keeps it from running at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _length(cells: list[Column], chars: int) -> Column:
    """Lines of the window that begins with the first cell; null if the text ends before. Cells are (a, b, n) of lines."""
    enough, out = F.lit(0), F.when(cells[-1].isNotNull(), F.lit(len(cells)))
    sums = []
    for c in cells[:-1]:
        enough = enough + c["n"]
        sums.append(enough)
    for k in reversed(range(len(sums))):
        out = F.when(sums[k] >= chars, F.lit(k + 1)).otherwise(out)
    return out


def _least(cells: list[Column], length: Column) -> Column:
    """(hash, place) of a window's least line hash; of equal ones the last."""
    pairs = [F.when(length > k, F.struct(c["a"].alias("fp"), F.lit(-k).alias("back"))) for k, c in enumerate(cells)]
    return F.least(*pairs) if len(pairs) > 1 else pairs[0]


def _hashed(text: Column) -> Column:
    """Two 64-bit hashes and the length of every line with a word, in order."""
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORDED))
    return F.transform(worded, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.length(x).alias("n")))


def fingerprints(docs: DataFrame, run: int = RUN, chars: int = CHARS) -> DataFrame:
    """The winnowed positions of every document: (doc_id, digest, pick, fp, near).

    The window of a position is the fewest lines from there that make a run. Of each window the line with the least
    hash is picked, so every run holds a pick that depends on the run alone, and equal runs pick the same line. ``near`` has
    the hashes of the lines around the pick, as far as a window with it can reach. A document of fewer than
    ``run`` lines also has one row for the whole of it (pick -1, ``near`` all its lines).
    """
    def picks(h: Column) -> Column:
        cells = lambda i: [F.get(h, i + k) for k in range(run)]

        def pick(i):
            found = _let(_length(cells(i), chars), lambda n: _least(cells(i), n))
            return _let(found, lambda m: F.struct((i - m["back"]).alias("pick"), m["fp"].alias("fp")))

        made = F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - 1), pick), lambda p: p["fp"].isNotNull())
        around = lambda i: F.transform(F.sequence(i - run + 1, i + run - 1), lambda j: F.get(h, j))
        spread = F.transform(F.array_distinct(made), lambda p: F.struct(p["pick"].alias("pick"), p["fp"].alias("fp"), around(p["pick"]).alias("near")))
        whole = F.struct(F.lit(-1).alias("pick"), _key("whole", h, "a").alias("fp"), h.alias("near"))
        none = F.array().cast("array<struct<pick:int,fp:bigint,near:array<struct<a:bigint,b:bigint,n:int>>>>")
        return F.when(F.size(h) == 0, none).when(F.size(h) < run, F.concat(spread, F.array(whole))).otherwise(spread)

    return docs.select("doc_id", "digest", F.inline(_let(_hashed(F.col("text")), picks)))


def _key(kind: str, cells: Column, field: str) -> Column:
    return F.xxhash64(F.lit(kind), F.size(cells), F.transform(cells, lambda c: c[field]))


def repeated_runs(docs: DataFrame, run: int = RUN, chars: int = CHARS) -> DataFrame:
    """Rows (doc_id, digest, i, n): windows of n lines that occur at an earlier place; docs has doc_id, digest, text.

    1. Picked lines are counted by their hash; those at one place only end here.
    2. The places of a shared pick are joined to it and extended both ways along the line hashes: the
       windows around the place that pick this line, named by 128 bits of their lines' hashes.
    3. Per window the first place in the order (doc_id, digest, i) stays; later ones are repeats.
       Counts and first places are aggregates combined before the shuffle; the joins have one row per
       key on one side, so no pairs of a hot group are made and Spark can split its rows.
    """
    picks = store(fingerprints(docs, run, chars), "picks")
    shared = picks.groupBy("fp").agg(F.count("*").alias("places")).where("places > 1").select("fp")

    def around(back: int) -> Column:
        """The window that begins ``back`` lines before the pick, if it picks this line."""
        cells = [F.get("near", F.lit(run - 1 - back + k)) for k in range(run)]

        def window(n):
            lines = F.filter(F.array(*[F.when(n > k, c) for k, c in enumerate(cells)]), lambda c: c.isNotNull())
            made = _let(lines, lambda x: _window(F.col("pick") - back, n, "run", x))
            return F.when((n > back) & cells[0].isNotNull() & (_least(cells, n)["back"] == -back), made)

        return _let(_length(cells, chars), window)

    whole = _let(F.col("near"), lambda x: _window(F.lit(0), F.size(x), "whole", x))
    windows = F.when(F.col("pick") < 0, F.array(whole)).otherwise(F.array_compact(F.array(*[around(k) for k in range(run)])))
    extended = picks.join(shared, "fp").select("doc_id", "digest", F.inline(windows))
    place = F.struct("doc_id", "digest", "i")
    first = extended.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return extended.join(first.select("x", "y", "first"), ["x", "y"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "digest", "i", "n")


def _window(i: Column, n: Column, kind: str, lines: Column) -> Column:
    return F.struct(i.alias("i"), n.alias("n"), _key(kind, lines, "a").alias("x"), _key(kind, lines, "b").alias("y"))


def line_dedup(docs: DataFrame, text: str = "text", run: int = RUN, chars: int = CHARS) -> DataFrame:
    """See ``shortened``; without the rows as they came."""
    return shortened(docs, text, run, chars).drop("row")


def shortened(docs: DataFrame, text: str = "text", run: int = RUN, chars: int = CHARS) -> DataFrame:
    """Delete from every document the lines of runs that occurred at an earlier place.

    Lines without a word are stepped over and stay. A run is ``run`` or more consecutive lines with a word, or
    fewer that have together ``chars`` characters or more, or all the lines of a document, if another document has these alone.
    Places are ordered by (doc_id, digest of the text, position); null doc_ids come first. The
    first place of a run stays, also within one document; every later one goes, wherever it is.

    Returns doc_id, text (what is left), n_lines (lines with a word), n_removed, removed (their
    0-based numbers among all lines) and row (the row as it came). Rows equal in doc_id and text are one document and give equal
    rows. A null text gives null and counts 0; an empty text stays; further columns of any name are
    ignored; an empty table gives an empty result. Lines are equal when 128 bits of two hashes are.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    digest = F.unhex(F.md5(t)).alias("digest")
    once = docs.select("doc_id", digest, t.alias("text"))
    found = store(repeated_runs(once, run, chars).distinct(), "runs")  # a row that stands twice is one document
    gone = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("i", "n")).alias("starts"))
    gone = gone.select(
        F.col("doc_id").alias("_d"), F.col("digest").alias("_g"),
        F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["i"], s["i"] + s["n"] - 1)))).alias("runs"),
    )
    both = docs.select("doc_id", digest, row.alias("row")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")), "left"
    )
    whole = F.col(f"row.`{text}`")
    lines = F.split(F.coalesce(whole, F.lit("")), "\n")
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(_WORDED)))

    def cut(parts: Column) -> Column:
        places = F.filter(F.transform(parts, lambda x, i: F.when(x.rlike(_WORDED), i)), lambda i: i.isNotNull())
        removed = _let(places, lambda p: F.sort_array(F.transform("runs", lambda i: F.get(p, i))))

        def left(r: Column) -> Column:
            kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), r), lambda i: F.get(parts, i))
            return F.struct(F.array_join(kept, "\n").alias("text"), r.alias("removed"))

        return _let(removed, left)

    both = both.select("doc_id", "row", n_lines.cast("long").alias("n_lines"), F.when(F.col("runs").isNotNull(), _let(lines, cut)).alias("cut"))
    return both.select(
        "doc_id", F.when(F.col("cut").isNull(), whole).otherwise(F.col("cut.text")).alias("text"), "n_lines",
        F.coalesce(F.size("cut.removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut.removed", F.array().cast("array<int>")).alias("removed"), "row",
    )
