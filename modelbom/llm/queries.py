"""One registered query per operator over its whole table, and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelbom.llm.alignment import link_counts
from modelbom.llm.classifier import classify
from modelbom.llm.common import new_path, read
from modelbom.llm.decontaminate import contaminated
from modelbom.llm.line_dedup import CHARS, RUN, line_dedup
from modelbom.llm.packing import pack
from modelbom.llm.pii import pseudonymise
from modelbom.llm.quality_rules import STOP_WORDS, quality_rules
from modelbom.llm.resharding import resharded
from modelbom.llm.simhash import simhash_groups
from modelbom.llm.suffix_dedup import remove_repeats
from modelbom.llm.toxicity import toxicity
from modelbom.llm.warc import BASE32, parse_records, read_archive, write_archive
from modelbom.llm.whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_SPACE = "concat(chr(9), chr(10), chr(11), chr(12), chr(13), ' ')"

RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS l FROM d),
g AS (SELECT doc_id, t, w, l, CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [] END AS g FROM w),
e AS (SELECT row_number() OVER () AS r, doc_id, t, w, l, g FROM g),
x AS (SELECT r, unnest(g) AS s, generate_subscripts(g, 1) AS i FROM e),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM x) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(w, lambda x: list_contains({list(STOP_WORDS)}, lower(x)))) AS BIGINT) AS n_stop_words,
        CAST(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS BIGINT) AS n_marks
      FROM e LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        list_filter([
          CASE WHEN n_words < 10 THEN 'word_count' END,
          CASE WHEN n_words > 0 AND (word_chars / n_words < 2 OR word_chars / n_words > 12) THEN 'mean_word_length' END,
          CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1 THEN 'symbols_per_word' END,
          CASE WHEN n_words > 0 AND n_marks / n_words > 0.5 THEN 'marks_per_word' END,
          CASE WHEN n_words > 0 AND n_stop_words / n_words < 0.02 THEN 'stop_word_share' END,
          CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_line_share' END,
          CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.2 THEN 'repeated_word_share' END],
          lambda x: x IS NOT NULL) AS failed_rules FROM m)
SELECT *, NOT base_failed AND len(failed_rules) = 0 AS kept FROM v
"""


@query("op3_quality_rules", RULES_SQL)
def op3(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"))


LINES_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t, text FROM documents),
a AS (SELECT doc_id, md5(t) AS g, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos FROM d),
n AS (SELECT doc_id, g, line, pos, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS i FROM a WHERE trim(line, {_SPACE}) <> ''),
c AS (SELECT doc_id, g, count(*) AS n_lines FROM n GROUP BY ALL),
x AS (SELECT doc_id, g, pos, i, line, lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3 FROM n WINDOW o AS (PARTITION BY doc_id, g ORDER BY i)),
w AS (SELECT doc_id, g, i, CASE WHEN length(line) >= {CHARS} THEN 1 WHEN length(line) + length(line2) >= {CHARS} THEN 2 WHEN line3 IS NOT NULL THEN {RUN} END AS size,
        concat_ws(chr(10), line, CASE WHEN length(line) < {CHARS} THEN line2 END, CASE WHEN length(line) + length(line2) < {CHARS} THEN line3 END) AS run FROM x),
u AS (SELECT doc_id, g, i, size, 'run' AS kind, run FROM w WHERE size IS NOT NULL
      UNION ALL SELECT n.doc_id, n.g, 1, c.n_lines, 'whole', string_agg(line, chr(10) ORDER BY i) FROM n JOIN c ON n.doc_id IS NOT DISTINCT FROM c.doc_id AND n.g = c.g WHERE c.n_lines < {RUN} GROUP BY n.doc_id, n.g, c.n_lines),
s AS (SELECT doc_id, g, i, size, row_number() OVER (PARTITION BY kind, run, size ORDER BY doc_id NULLS FIRST, g, i) AS place FROM u),
r AS (SELECT DISTINCT n.doc_id, n.g, n.pos FROM n JOIN s ON n.doc_id IS NOT DISTINCT FROM s.doc_id AND n.g = s.g AND n.i BETWEEN s.i AND s.i + s.size - 1 WHERE s.place > 1),
k AS (SELECT a.doc_id, a.g, string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (r.pos IS NULL) AS kept,
        CAST(count(r.pos) AS BIGINT) AS n_removed, coalesce(list(a.pos ORDER BY a.pos) FILTER (r.pos IS NOT NULL), []) AS removed
      FROM a LEFT JOIN r ON a.doc_id IS NOT DISTINCT FROM r.doc_id AND a.g = r.g AND a.pos = r.pos GROUP BY ALL)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, k.n_removed, k.removed
FROM documents o JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND md5(coalesce(o.text, '')) = k.g
LEFT JOIN c ON o.doc_id IS NOT DISTINCT FROM c.doc_id AND c.g = k.g
"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark, sf_dir):
    return line_dedup(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_packing")
def op8(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_simhash")
def op10(spark, sf_dir):
    return simhash_groups(read(spark, sf_dir, "documents"))


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("digest")


_BASE32 = ", ".join(
    f"substr('{BASE32}', 1 + (((strpos('0123456789abcdef', substr(h, {5 * i // 4 + 1}, 1)) - 1) * 16"
    f" + (strpos('0123456789abcdef', substr(h, {5 * i // 4 + 2}, 1)) - 1)) >> {3 - 5 * i % 4}) % 32, 1)"
    for i in range(32)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, concat({_BASE32}) AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM h
"""


@query("op2_warc", WARC_SQL)
def op2(spark, sf_dir):
    path = new_path(spark, "archive")
    write_archive(read(spark, sf_dir, "pages"), path)
    return parse_records(read_archive(spark, path)).drop("url")


#: The key of the registered query; a caller gives their own secret.
PII_KEY = "corpus"


@query("op4_pii")
def op4(spark, sf_dir):
    return pseudonymise(read(spark, sf_dir, "documents"), PII_KEY)


#: Shards before; their sizes follow the sources and differ much.
OLD_SHARDS = 6


@query("op6_sharding")
def op6(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return resharded(docs, F.pmod(F.crc32(F.encode("source", "utf-8")), F.lit(OLD_SHARDS)), 8)


@query("op7_classifier")
def op7(spark, sf_dir):
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_suffix_dedup")
def op9(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).drop("doc", "kept")


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitened_components(read(spark, sf_dir, "embeddings"))


@query("op12_alignment")
def op12(spark, sf_dir):
    return link_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
