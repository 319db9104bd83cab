"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelbom.llm.common import store

#: Common insults of English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns filth "
    "garbage vermin imbecile jerk bastard bitch asshole fool freak creep coward "
    "dumm dummkopf trottel abschaum arschloch wertlos widerlich erbärmlich versager dreck schwachkopf hurensohn "
    "idiote crétin crétins connard connasse salaud ordure pathétique minable débile imbécile dégoûtant raclure "
    "idiota idiotas estúpido estúpida imbécil basura patético patética escoria inútil asqueroso asquerosa payaso perdedor".split()
)
#: Words of the second person in the same languages.
YOU = frozenset(
    "you your yours yourself u ur youre you're ya du dich dir dein deine deiner deinem deinen ihr euch euer eure "
    "tu te toi ton tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
#: What stands for a letter in obfuscated words.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "length", "hits", "hit_density", "strongest", "strength_density", "insult_density", "insults", "near_you",
    "you_density", "capital_words", "capitals", "marks", "punctuation", "obfuscated", "obfuscated_hits", "drawn_out",
)
#: Words on both sides of a hit in which a second person counts as near.
NEAR = 4
#: Labelled documents of each class that the model is fitted on (about; twice as many at most).
FIT_ROWS = 10_000
#: Entries of a learned lexicon.
TERMS = 4000
#: Lengths of the beginnings of words that a learned lexicon may hold beside words.
STARTS = (3, 4, 5, 6)
#: Characters whose tokens are counted at a time, and tokens that a worker remembers.
SLICE, KNOWN = 1 << 20, 200_000

_DRAWN = re.compile(r"(.)\1\1")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


def terms_of(word: str) -> list[str]:
    """The entries under which a lower-case word can stand in a lexicon: itself and its beginnings with a hyphen."""
    return [word, *(word[:k] + "-" for k in STARTS if len(word) > k)]


def slices(text: str):
    """The text in parts of about SLICE characters, cut at white space."""
    at = 0
    while len(text) - at > SLICE:
        m = re.compile(r"\s").search(text, at + SLICE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def core(token: str) -> str:
    m = _CORE.search(token)
    return m[0].lower() if m else ""


@dataclass
class Tokens(dict):
    """Kind of every token seen, an index into ``rows`` of its attributes; new tokens are read when met."""

    lexicon: dict[str, float]
    rows: list = field(default_factory=list)
    kinds: dict = field(default_factory=dict)
    masked: dict = field(default_factory=dict)

    #: Capital word, capitals, marks, punctuation, obfuscated, obfuscated hit, drawn out of a plain lower-case word.
    QUIET = (0.0,) * 7

    def __post_init__(self):
        self.words = INSULTS | {t for t in self.lexicon if t[-1] != "-"}
        for w in self.words:
            self.masked.setdefault((len(w), w[0]), []).append(w)

    def __missing__(self, token):
        row = self.read(token)
        kind = self.kinds.setdefault(row, len(self.rows))
        if kind == len(self.rows):
            self.rows.append(row)
        if len(self) >= KNOWN:
            self.clear()
        self[token] = kind
        return kind

    def read(self, token: str) -> tuple:
        """(hit, strength, insult, you, capital word, capitals, marks, punctuation, obfuscated, obfuscated hit, drawn out, letter)"""
        plain_word = token.isalpha()
        word = token.lower() if plain_word else core(token)
        strength = max([self.lexicon.get(t, 0.0) for t in terms_of(word)]) if word else 0.0
        insult = word in INSULTS
        if plain_word and token == word and not _DRAWN.search(word):  # most tokens
            return (float(strength > 0 or insult), round(strength, 1), float(insult), float(word in YOU), *self.QUIET, float(len(word) == 1))
        letters = sum(map(str.isalpha, token))
        mixed = letters > 1 and not word.isalpha() and any(c.isdigit() or c in "@$*!|_" for c in word)
        plain = core(word.translate(STANDS_FOR)) if mixed else word
        drawn = re.sub(r"(.)\1+", r"\1", plain) if _DRAWN.search(plain) else ""
        masked = "*" in word and any(self.same(w, word) for w in self.masked.get((len(word), word[0]), ()))
        found = mixed and (plain in self.words or masked) or drawn != "" and drawn in self.words
        upper = sum(map(str.isupper, token))
        return (
            float(strength > 0 or insult or found), round(strength, 1), float(insult), float(word in YOU),
            float(upper > 1 and upper == letters), float(upper), float(token.count("!") + token.count("?")),
            float(len(token) - sum(map(str.isalnum, token))), float(mixed), float(found), float(bool(drawn)), float(len(word) == 1),
        )

    @staticmethod
    def same(word: str, masked: str) -> bool:
        return all(b in (a, "*") for a, b in zip(word, masked)) and masked.count("*") < len(word) / 2


class Reader:
    """Features of texts by a lexicon of word strengths."""

    def __init__(self, lexicon: dict[str, float]):
        import numpy as np

        self.np, self.tokens, self.rows = np, Tokens(lexicon), np.zeros((0, 12))

    def table(self):
        """The attributes of all kinds of tokens met so far."""
        if len(self.rows) < len(self.tokens.rows):
            self.rows = self.np.array(self.tokens.rows)
        return self.rows

    def spelled(self, words: list[str], single) -> int:
        """Insults spelled with spaces: runs of four or more single letters that give a word of the lexicon."""
        np = self.np
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
        runs = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= 4]
        return sum("".join(map(core, words[a:b])) in self.tokens.words for a, b in runs)

    def features(self, text: str | None) -> list[float]:
        np, kinds, spelled, chars = self.np, [], 0, len(text or "")
        for part in slices(text or ""):
            words = part.split()
            got = np.fromiter(map(self.tokens.__getitem__, words), np.int32, len(words))
            kinds.append(got)
            if len(got):
                single = self.table()[got, 11].astype(np.int8)
                if single.sum() >= 4:
                    spelled += self.spelled(words, single)
        kinds = np.concatenate(kinds)
        n = len(kinds)
        if not n:
            return [0.0] * len(FEATURES)
        rows = self.table()
        sums = np.bincount(kinds, minlength=len(rows)) @ rows
        hit, you = rows[kinds, 0] > 0, np.concatenate([[0], np.cumsum(rows[kinds, 3])])
        at = np.flatnonzero(hit)
        near = int((you[np.minimum(at + NEAR + 1, n)] > you[np.maximum(at - NEAR, 0)]).sum())
        many = lambda x: float(np.log1p(1000 * x / n))
        return [
            float(np.log1p(n)), float(np.log1p(sums[0] + spelled)), many(sums[0] + spelled), float(rows[np.unique(kinds), 1].max()), many(sums[1]),
            many(sums[2]), float(np.log1p(sums[2])), many(near), many(sums[3]), many(sums[4]), sums[5] / chars, many(sums[6]),
            many(sums[7]), many(sums[8]), float(np.log1p(sums[9] + spelled)), many(sums[10]),
        ]


def _count_terms(batches):
    """Per task, half and label: documents that hold a term."""
    from collections import Counter

    import pyarrow as pa

    counts = Counter()

    def table():
        keys = list(counts)
        columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(counts.values())]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "half", "label", "n"])

    for batch in batches:
        for text, half, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
            seen = {t for part in slices(text or "") for w in set(part.split()) if (c := core(w)) for t in terms_of(c)}
            counts.update((t, half, label) for t in seen)
            if len(counts) > 300_000:
                yield table()
                counts.clear()
    if counts:
        yield table()


def learn_lexicons(labelled: DataFrame, terms: int = TERMS) -> list[dict[str, float]]:
    """Lexicons learned from half 0, half 1 and all of (text, half, label): strength of words and of beginnings of words.

    A term counts if three toxic documents hold it and its log odds are three standard errors above zero; its
    strength is the odds less one error. The ``terms`` surest of each lexicon reach the driver.
    """
    parts = labelled.select("text", "half", "label").mapInArrow(_count_terms, "term string, half int, label int, n long")
    inside = {0: "half = 0", 1: "half = 1", 2: "half >= 0"}
    cells = [(k, y) for k in inside for y in (0, 1)]
    counted = parts.groupBy("term").agg(*[F.sum(F.expr(f"if({inside[k]} and label = {y}, n, 0)")).alias(f"n{k}{y}") for k, y in cells])
    counted = store(counted.where("n21 >= 3"), "terms")
    total = labelled.agg(*[F.count_if(F.expr(f"{inside[k]} and label = {y}")).alias(f"n{k}{y}") for k, y in cells]).first()
    out = []
    for k in inside:
        have = {y: (F.col(f"n{k}{y}") + 0.5, F.lit(total[f"n{k}{y}"] + 0.5) - F.col(f"n{k}{y}")) for y in (0, 1)}
        odds = F.log(have[1][0] / have[1][1]) - F.log(have[0][0] / have[0][1])
        error = F.sqrt(1 / have[1][0] + 1 / have[0][0])
        sure = counted.where(F.col(f"n{k}1") >= 3).select("term", (odds - error).alias("strength"), (odds / error).alias("z"))
        best = sure.where("z >= 3").orderBy(F.desc("z"), "term").limit(terms)
        out.append({r["term"]: float(r["strength"]) for r in best.collect()})
    return out


def _measure(lexicons: dict, columns: int):
    """The first ``columns`` columns as they are and the features of the last one, the text; lexicon by the column before it."""

    def run(batches):
        import pyarrow as pa

        readers = {}
        for batch in batches:
            halves = batch.column(columns).to_pylist()
            made = []
            for half, text in zip(halves, batch.column(columns + 1)):
                if half not in readers:
                    readers[half] = Reader(lexicons[half])
                made.append(readers[half].features(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(columns)), pa.array(made, pa.list_(pa.float64()))],
                names=[*batch.schema.names[:columns], "f"],
            )

    return run


def _drawn(labels: DataFrame, label: str, held, fit_rows: int):
    """Labelled ids of the fit, about ``fit_rows`` of each class drawn by a hash, with the weight of a class's rows."""
    known = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held)
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {y: min(1.0, fit_rows / max(count.get(y, 0), 1)) for y in (0, 1)}
    cut = F.when(F.col("label") == 1, F.lit(int(share[1] * 2**20))).otherwise(F.lit(int(share[0] * 2**20)))
    weight = F.when(F.col("label") == 1, F.lit(1 / share[1])).otherwise(F.lit(1 / share[0]))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < cut).withColumn("weight", weight)
    return count, some.limit(4 * fit_rows)


def toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", folds: int = 3, fold: int = 1,
    threshold: float = 0.7, fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """Score every document for the probability of label 1.

    Learned are only labels of rows whose crc32(doc_id as text) modulo ``folds`` is not ``fold``, of which about
    ``fit_rows`` a class are drawn by a hash of the id (twice as many at most): a lexicon of words and beginnings of
    words from document counts, and gradient-boosted trees over the FEATURES. Features of a row of the fit come
    from a lexicon learned on the other half, so that a row never sees its own label. A quarter of the fit calibrates
    the trees by isotonic regression; 2 % of a score stay the trees' own, which parts ties.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold). Scores depend on the text alone. A null
    text counts as empty and gets a score; a null doc_id has no label and is not held out; repeated rows are scored alike;
    labels other than 0 and 1 are ignored; without labels of both classes all scores are next to the one class
    there is, or 0.5. Further columns are ignored; an empty table gives no rows. A long text is read in parts.
    """
    of = lambda c: F.crc32(c.cast("string").cast("binary")) % folds == fold
    count, some = _drawn(labels, label, of(F.col("doc_id")), fit_rows)
    held = F.coalesce(of(F.col("doc_id")), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long"), held, F.col(f"`{text}`").alias("text"))
    known = rows.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most 4 * fit_rows ids
    drawn = lambda seed, n: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")
    known = store(known.select(drawn(1, 2).alias("half"), drawn(2, 4).alias("quarter"), "label", "weight", "text"), "labelled")
    cells = {(r["quarter"] == 0, r["label"]) for r in known.select("quarter", "label").distinct().collect()}
    if not {(False, 0), (False, 1)} <= cells:
        only = {y for y in (0, 1) if count.get(y)}
        score = F.lit({(0,): 0.01, (1,): 0.99}.get(tuple(only), 0.5))
        return rows.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    lexicons = learn_lexicons(known)
    other = {0: lexicons[1], 1: lexicons[0]}
    fit = known.select("label", "weight", "quarter", "half", "text").mapInArrow(
        _measure(other, 3), "label int, weight double, quarter int, f array<double>"
    )
    fit = store(fit.coalesce(8), "fit").withColumns({"features": array_to_vector("f"), "label": F.col("label").cast("double")})
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, weightCol="weight", seed=1, minInstancesPerNode=2)
    trees = trees.fit(fit.where("quarter <> 0"))
    raw = vector_to_array("probability")[1].alias("p")
    level = None
    if {(True, 0), (True, 1)} <= cells:
        known_p = trees.transform(fit.where("quarter = 0")).select("label", "weight", raw)
        level = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="level").fit(known_p)
    measured = rows.select("doc_id", "held_out", F.lit(2).alias("all"), "text").mapInArrow(
        _measure({2: lexicons[2]}, 2), "doc_id long, held_out boolean, f array<double>"
    )
    scored = trees.transform(measured.withColumn("features", array_to_vector("f"))).select("doc_id", "held_out", raw)
    scored = level.transform(scored) if level else scored.withColumn("level", F.col("p"))
    score = 0.98 * F.col("level") + 0.02 * F.col("p")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
