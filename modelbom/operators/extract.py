"""Reference extraction from a table of files: lines, stitched calls, rule hits.

Everything up to the hits is a narrow, row-wise plan: one pass over the files, no shuffle,
and files or lines without a trigger text are dropped before the rules run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelbom.functions import semistructured as ss
from modelbom.functions.rules import CLASS_KINDS, RULES, Rule, java_pattern, trigger_of
from modelbom.functions.text import classify_file, col, let, plausible_id, skip_path, trim

MATCH_TYPE = "array<struct<rule_ord:int,match_ord:int,method:string,id:string>>"
HIT_ORDER = ["path", "cell", "emit_line", "phase", "rule_ord", "match_ord"]


def source_files(files: DataFrame) -> DataFrame:
    """Files worth scanning, with their class; the path is relative to the scanned root."""
    return files.withColumn("class", classify_file("path")).where(
        ~skip_path("path") & (F.col("class") != "unknown")
    )


# ---- lines ----------------------------------------------------------------------------


def line_array(content) -> Column:
    """Lines without their end; a final line end adds no empty line."""
    raw = F.split(col(content), "\n")
    full = F.when(
        F.try_element_at(raw, F.lit(-1)) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)
    ).otherwise(raw)
    dropped = F.transform(
        full, lambda l: F.when(l.endswith("\r"), F.left(l, F.length(l) - 1)).otherwise(l)
    )
    return F.when(F.contains(col(content), F.lit("\r")), dropped).otherwise(full)


def explode_lines(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, line_no, line); line numbers start at 1."""
    return files.select("path", F.posexplode(line_array("content")).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "line"
    )


# ---- calls over several lines ---------------------------------------------------------


def _net_parens(line: Column) -> Column:
    def without(ch):
        return F.length(F.replace(line, F.lit(ch), F.lit("")))

    return without(")") - without("(")


BLOCK = 256


def call_spans(lines: Column) -> Column:
    """array<struct(first, last)>: line ranges while parentheses are open.

    One fold over the lines whose net depth is not zero. Depth is cut at 0 at every line
    end; a range still open at the end is dropped. The fold goes by blocks of lines: a list that
    grows is copied at each step, so ranges are listed per block and the lists joined at the end.
    """
    events = F.filter(
        F.transform(lines, lambda l, i: F.struct((i + 1).alias("line"), _net_parens(l).alias("net"))),
        lambda e: e["net"] != 0,
    )
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(s, e):
        depth = F.greatest(s["depth"] + e["net"], F.lit(0))
        closes = (s["depth"] > 0) & (depth == 0)
        span = F.struct(s["first"].alias("first"), e["line"].alias("last"))
        return F.struct(
            depth.alias("depth"),
            F.when((s["depth"] == 0) & (depth > 0), e["line"]).otherwise(s["first"]).alias("first"),
            F.when(closes, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"),
        )

    def block_step(s, block):
        start = F.struct(s["depth"].alias("depth"), s["first"].alias("first"), none.alias("spans"))
        done = F.transform(
            F.array(F.aggregate(block, start, step)),
            lambda r: F.struct(
                r["depth"].alias("depth"), r["first"].alias("first"),
                F.concat(s["lists"], F.array(r["spans"])).alias("lists"),
            ),
        )
        return F.get(done, F.lit(0))

    def parted(all_):
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)))
        ends = lambda i: F.least(i + BLOCK, F.size(all_)) - 1
        return F.transform(starts, lambda i: F.transform(F.sequence(i, ends(i)), lambda k: F.get(all_, k)))

    blocks = F.coalesce(let(events, parted), F.array().cast("array<array<struct<line:int,net:int>>>"))
    begin = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("first"), F.array().cast("array<array<struct<first:int,last:int>>>").alias("lists")
    )
    return F.aggregate(blocks, begin, block_step, lambda s: F.flatten(s["lists"]))


def call_text(lines: Column, span: Column) -> Column:
    # By index: ``slice`` copies the whole array before it cuts.
    part = F.transform(F.sequence(span["first"], span["last"]), lambda i: trim(F.get(lines, i - 1)))
    return F.array_join(part, " ")


def stitch_calls(files: DataFrame) -> DataFrame:
    """files(path, content) -> (path, start_line, end_line, text) of calls over several lines."""
    lined = files.select("path", line_array("content").alias("lines"))
    lines = F.col("lines")
    # The texts are made beside the lines, so that an exploded call carries its own lines alone.
    calls = F.transform(call_spans(lines), lambda s: F.struct(
        s["first"].alias("start_line"), s["last"].alias("end_line"), call_text(lines, s).alias("text")
    ))
    return lined.select("path", F.inline(calls))


# ---- notebooks and Markdown -----------------------------------------------------------


def notebook_cells(content) -> Column:
    """array<struct(cell, cell_type, lines)> of code and markdown cells; NULL when the text is
    not a notebook. Line numbers count over all source strings of a cell."""
    doc = F.try_parse_json(col(content))
    cells = ss.at(doc, "$.cells")

    def is_cell(c):
        void = ss.kind(c) == "VOID"
        typed = ss.kind(ss.at(c, "$.cell_type"))
        return void | (ss.kind(c).startswith("OBJECT<") & (typed.isNull() | typed.isin("STRING", "VOID")))

    listed = ss.as_list(cells)
    valid = (
        ss.kind(doc).startswith("OBJECT<")
        & (cells.isNull() | (ss.kind(cells) == "VOID") | ss.is_list(cells))
        & F.coalesce(F.forall(listed, lambda c: F.coalesce(is_cell(c), F.lit(False))), F.lit(True))
    )

    def source_lines(c):
        src = ss.at(c, "$.source")
        parts = F.when(
            ss.is_list(src)
            & F.coalesce(
                F.forall(ss.as_list(src), lambda x: ss.kind(x).isin("STRING", "VOID")), F.lit(False)
            ),
            F.transform(ss.as_list(src), ss.string_from_any),
        ).when(ss.is_string(src), F.array(ss.as_string(src)))
        return F.flatten(F.transform(parts, lambda p: F.split(p, "\n")))

    every = F.transform(
        listed,
        lambda c, i: F.struct(
            (i + 1).alias("cell"),
            ss.at(c, "$.cell_type", "string").alias("cell_type"),
            source_lines(c).alias("lines"),
        ),
    )
    empty = F.array().cast("array<struct<cell:int,cell_type:string,lines:array<string>>>")
    used = F.filter(
        every, lambda c: c["cell_type"].isin("code", "markdown") & c["lines"].isNotNull()
    )
    return F.when(valid, F.coalesce(used, empty))


def explode_notebook(files: DataFrame) -> DataFrame:
    """Notebook files -> (path, cell, cell_type, line_no, line). A file that is not a notebook
    gives its raw lines as one code cell numbered 0."""
    cells = files.select("path", "content", notebook_cells("content").alias("cells"))
    raw = F.struct(
        F.lit(0).alias("cell"), F.lit("code").alias("cell_type"), line_array("content").alias("lines")
    )
    one = cells.select("path", F.explode(F.coalesce("cells", F.array(raw))).alias("c"))
    return one.select("path", "c.cell", "c.cell_type", F.posexplode("c.lines").alias("pos", "line")).select(
        "path", "cell", "cell_type", (F.col("pos") + 1).alias("line_no"), "line"
    )


def front_matter_close(lines: Column) -> Column:
    """Line number of the closing delimiter: NULL without front matter, 0 when never closed."""
    opened = trim(F.get(lines, F.lit(0))) == "---"
    later = F.transform(
        F.slice(lines, F.lit(2), F.size(lines)), lambda l: trim(l).isin("---", "...")
    )
    at = F.array_position(later, F.lit(True)).cast("int")
    return F.when(opened, F.when(at > 0, at + 1).otherwise(F.lit(0)))


def _markdown_kind(line_no: Column, close: Column) -> Column:
    """Rule kind of a line; NULL for delimiters."""
    front = (line_no > 1) & ((close == 0) | (line_no < close))
    return (
        F.when(close.isNull(), F.lit("body"))
        .when(front, F.lit("front"))
        .when((close > 0) & (line_no > close), F.lit("body"))
    )


def markdown_lines(files: DataFrame) -> DataFrame:
    """Markdown files -> (path, line_no, kind, line), kind 'front' or 'body'."""
    lined = files.select("path", line_array("content").alias("lines"))
    closed = lined.select("path", "lines", front_matter_close(F.col("lines")).alias("close"))
    exploded = closed.select("path", "close", F.posexplode("lines").alias("pos", "line"))
    line_no = F.col("pos") + 1
    return exploded.select(
        "path", line_no.alias("line_no"), _markdown_kind(line_no, F.col("close")).alias("kind"), "line"
    ).where("kind is not null")


# ---- texts to match -------------------------------------------------------------------


def _file_can_match(rules: list[Rule]) -> Column:
    """Whole-file trigger per class. Notebooks are JSON-escaped, so they always pass."""
    test = F.lit(True)
    for cls, kinds in CLASS_KINDS.items():
        trigger = trigger_of([r for r in rules if r.kind in kinds])
        if cls != "notebook" and trigger is not None:
            test = F.when(F.col("class") == cls, F.col("content").rlike(trigger)).otherwise(test)
    return test


def _text_can_match(rules: list[Rule]) -> Column:
    test = F.lit(False)
    for kind in dict.fromkeys(r.kind for r in rules):
        trigger = trigger_of([r for r in rules if r.kind == kind])
        hit = F.lit(True) if trigger is None else F.col("text").rlike(trigger)
        test = F.when(F.col("kind") == kind, hit).otherwise(test)
    return test


def _file_cells(files: DataFrame) -> DataFrame:
    """One row per notebook cell, one row (cell 0) for any other file:
    (path, class, cell, cell_type, lines)."""
    whole = F.struct(
        F.lit(0).alias("cell"),
        F.when(F.col("class").isin("python", "notebook"), "code").otherwise(F.col("class")).alias("cell_type"),
        line_array("content").alias("lines"),
    )
    cells = F.when(F.col("class") == "notebook", notebook_cells("content"))
    return files.select("path", "class", F.inline(F.coalesce(cells, F.array(whole))))


def match_texts(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """files(path, content, class) -> one row per text to match:
    (path, cell, line_no, emit_line, phase, kind, text).

    A text is a line (phase 0) or a call joined over several lines (phase 1). Both come out
    of one generator per cell: the calls follow the lines in the same array.
    """
    lines = F.col("lines")
    is_code = F.col("cell_type") == "code"
    cells = _file_cells(files.where(_file_can_match(rules))).select(
        "*",
        F.when((F.col("cell_type") == "markdown") & (F.col("class") == "markdown"), front_matter_close(lines)).alias("close"),
    )

    def row(first, last, phase, text):
        return F.struct(first.alias("line_no"), last.alias("emit_line"), F.lit(phase).alias("phase"), text.alias("text"))

    plain = F.transform(lines, lambda l, i: row(i + 1, i + 1, 0, l))
    calls = F.transform(call_spans(lines), lambda s: row(s["first"], s["last"], 1, call_text(lines, s)))
    one = cells.select(
        "path", "class", "cell", "cell_type", "close", F.inline(F.when(is_code, F.concat(plain, calls)).otherwise(plain))
    )
    kind = (
        F.when(F.col("cell_type") != "markdown", F.col("cell_type"))
        .when(F.col("class") == "notebook", F.lit("front"))
        .otherwise(_markdown_kind(F.col("line_no"), F.col("close")))
    )
    placed = one.withColumn("kind", kind).where(_text_can_match(rules))
    return placed.select("path", "cell", "line_no", "emit_line", "phase", "kind", "text")


# ---- rules ----------------------------------------------------------------------------


def _ids_of_rule(text: Column, rule: Rule) -> Column:
    ids = F.regexp_extract_all(text, F.lit(java_pattern(rule.pattern)), F.lit(1))
    if not rule.trigger:
        return ids
    return F.when(text.rlike(rule.trigger), ids)


def _matches(text: Column, rules: list[Rule], kind: str) -> Column:
    """All matches of the rules of one kind, with the rule's place in the whole list."""
    mine = [(o, r) for o, r in enumerate(rules) if r.kind == kind]
    ords = F.lit([o for o, _ in mine])
    methods = F.lit([r.method for _, r in mine])
    empty = F.array().cast(MATCH_TYPE)
    per_rule = F.transform(
        F.array(*[_ids_of_rule(text, r) for _, r in mine]),
        lambda ids, o: F.coalesce(
            F.transform(
                ids,
                lambda ident, i: F.struct(
                    F.get(ords, o).alias("rule_ord"), i.alias("match_ord"),
                    F.get(methods, o).alias("method"), ident.alias("id"),
                ),
            ),
            empty,
        ),
    )
    return F.flatten(per_rule)


def apply_rules(texts: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All matches of the rules of each text's kind, as hits with a total order.

    ``rules`` may hold any rules with the id in group 1; they become one projection and a
    single explode.
    """
    kind, text = F.col("kind"), F.col("text")
    found = F.when(F.lit(False), F.array().cast(MATCH_TYPE))
    for name in dict.fromkeys(r.kind for r in rules):
        found = found.when(kind == name, _matches(text, rules, name))
    hits = texts.select(
        "path", "cell", "line_no", "emit_line", "phase", "text", F.explode(found).alias("h")
    ).where(plausible_id("h.id"))
    evidence = F.concat(
        F.col("h.method"), F.lit(" at line "), F.col("line_no").cast("string"), F.lit(": "), trim("text")
    )
    return hits.select(
        F.col("h.id").alias("id"),
        F.col("h.id").alias("name"),
        F.lit("model").alias("type"),
        "path",
        evidence.alias("evidence"),
        F.col("h.method").alias("method"),
        "cell",
        "emit_line",
        "phase",
        F.col("h.rule_ord").alias("rule_ord"),
        F.col("h.match_ord").alias("match_ord"),
    )


# ---- one row per reference ------------------------------------------------------------


def evidence_rows(hits: DataFrame) -> DataFrame:
    """Hits -> (type, id, evidence, at): the distinct evidence texts of each reference, with the place
    of the first one. Equal texts of one id collapse with map-side combine; the rows of a hot id stay
    spread over the tasks by their text."""
    order = F.struct(*HIT_ORDER, "method")
    return hits.groupBy("type", "id", "evidence").agg(F.min(order).alias("at"))


def references(evidence: DataFrame) -> DataFrame:
    """Evidence rows -> (id, name, type, path, method, evidence_texts, evidence_chars), one row per
    (type, id). Path and method are those of the first hit."""
    refs = evidence.groupBy("type", "id").agg(
        F.min("at").alias("head"), F.count("*").alias("evidence_texts"), F.sum(F.length("evidence")).alias("evidence_chars")
    )
    return refs.select(
        "id", F.col("id").alias("name"), "type", F.col("head.path").alias("path"), F.col("head.method").alias("method"),
        "evidence_texts", "evidence_chars",
    )


#: Stands in every evidence text between the method and the matched text.
_MARK = r" at line (\d+): "


def _occurrences(text: Column) -> Column:
    """Every place of the mark in an evidence text: (line, before, rest)."""
    numbers = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))
    parts = F.split(text, _MARK)
    marks = F.transform(numbers, lambda n: F.concat(F.lit(" at line "), n, F.lit(": ")))

    def joined(first, last):  # the parts from one to another, with their marks between
        return F.array_join(F.transform(F.sequence(first, last), lambda k: F.concat(
            F.get(parts, k), F.when(k < last, F.get(marks, k)).otherwise("")
        )), "")

    return F.transform(numbers, lambda n, i: F.struct(
        n.alias("line"), joined(F.lit(0), i).alias("before"), joined(i + 1, F.size(numbers)).alias("rest")
    ))


def kept_evidence(evidence: DataFrame) -> DataFrame:
    """The evidence rows that a joined text holds: those which the texts before them, joined by '. ', do not contain.

    An index instead of a fold: a text can only lie where its mark, with its line number, lies in another text. So each
    text gives, per mark, hashes of what follows, cut to the lengths that texts with the same number have; a
    text is dropped if one before it has its hash and the same method in front. What lies across the joint
    of two texts needs a text that ends in the middle of another at '. '; only references with such texts are
    folded one by one. So the rows of a hot reference stay spread by line number and text.
    """
    ref = ["type", "id"]
    rows = evidence.select(*ref, "at", "evidence", _occurrences(F.col("evidence")).alias("o"))
    own = F.get("o", F.lit(0))
    needles = rows.select(*ref, "at", "evidence", own["line"].alias("line"), own["before"].alias("method"), own["rest"].alias("rest"))
    found = rows.select(*ref, "at", F.inline("o"))
    lengths = needles.select(*ref, "line", F.length("rest").alias("n")).distinct()
    cut = found.join(lengths, [*ref, "line"]).where(F.length("rest") >= F.col("n"))
    index = cut.groupBy(*ref, "line", "n", F.xxhash64(F.substr("rest", F.lit(1), F.col("n"))).alias("h"), "before").agg(F.min("at").alias("first"))
    key = [*ref, "line", "n", "h"]
    asked = needles.withColumns({"n": F.length("rest"), "h": F.xxhash64("rest")})
    again = asked.join(index, key).where(F.col("first") < F.col("at")).where(F.endswith("before", F.col("method")))
    # Texts that may lie across a joint, or have no mark: their references go through the fold.
    ends = F.transform(F.split("rest", r"\. "), lambda p, i: i)
    heads = F.transform(ends, lambda i: F.xxhash64(F.array_join(F.transform(F.sequence(F.lit(0), i), lambda k: F.get(F.split("rest", r"\. "), k)), ". ")))
    across = needles.where(F.contains("rest", F.lit(". "))).select(*ref, "line", F.explode(F.slice(heads, 1, F.size(heads) - 1)).alias("h"))
    whole = found.select(*ref, "line", F.xxhash64("rest").alias("h")).distinct()
    folded = across.join(whole, [*ref, "line", "h"]).select(*ref).union(needles.where("line is null").select(*ref)).distinct()
    plain = evidence.join(folded, ref, "left_anti").join(again.select(*ref, "evidence").distinct(), [*ref, "evidence"], "left_anti")
    return plain.select(*ref, "at", "evidence").union(_folded_evidence(evidence.join(folded, ref, "left_semi")))


def _folded_evidence(evidence: DataFrame) -> DataFrame:
    """The kept texts by the rule itself: text after text of a reference, gathered in one row."""
    items = evidence.groupBy("type", "id").agg(F.array_sort(F.collect_list(F.struct("at", "evidence"))).alias("items"))
    head = F.get("items", F.lit(0))
    start = F.struct(head["evidence"].alias("text"), F.array(head).alias("kept"))
    step = lambda s, e: F.when(F.contains(s["text"], e["evidence"]), s).otherwise(F.struct(
        F.concat(s["text"], F.lit(". "), e["evidence"]).alias("text"), F.concat(s["kept"], F.array(e)).alias("kept")
    ))
    kept = F.aggregate(F.slice("items", F.lit(2), F.size("items") - 1), start, step, lambda s: s["kept"])
    return items.select("type", "id", F.inline(kept))


def joined_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows -> (type, id, evidence): one text per reference of its ``kept_evidence``, joined by '. ' in hit
    order. For a caller who wants one property text: it gathers the kept texts of a reference in a row."""
    items = kept_evidence(evidence).groupBy("type", "id").agg(F.array_sort(F.collect_list(F.struct("at", "evidence"))).alias("items"))
    return items.select("type", "id", F.array_join(F.transform("items", lambda i: i["evidence"]), ". ").alias("evidence"))


def dedupe_discoveries(hits: DataFrame) -> DataFrame:
    """Hits -> one row per reference, see ``references``."""
    return references(evidence_rows(hits))


def scan_hits(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    return apply_rules(match_texts(source_files(files), rules), rules)


def scan_references(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """files(path, content) -> discoveries, end to end."""
    return dedupe_discoveries(scan_hits(files, rules))
