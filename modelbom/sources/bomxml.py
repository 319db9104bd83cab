"""XML form of BOM documents, mapped to and from the JSON form at any depth without losing a field.

Reading: the parser makes one VARIANT of a ``bom`` element; a table of attribute, list and text names says
how its elements stand in JSON. Writing goes the other way, from the JSON text. What no table knows is
marked with attributes of an own namespace, so that it comes back as it was: lists outside the table,
numbers, booleans, nulls, empty objects, and names that XML does not allow. The tables and the step from one
parsed form to the other are in ``bomtexts``; it runs in Arrow batches, one pass over each text.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from modelbom.operators.common import dealt
from modelbom.sources import bomtexts
from modelbom.sources.bomtexts import LISTS, TEXT_MARK

__all__ = ["LISTS", "json_from_xml", "read_xml_documents", "xml_from_json"]


def _json_texts(texts: pa.Array) -> pa.Array:
    return pa.array([bomtexts.to_json(t.as_py()) for t in texts], pa.string())


def _xml_texts(texts: pa.Array) -> pa.Array:
    return pa.array([bomtexts.to_xml(t.as_py()) for t in texts], pa.string())


# ---- reading ----------------------------------------------------------------------------


def _marked(xml: Column) -> Column:
    """XML text whose CDATA is plain text and whose texts and attribute values begin with a mark."""
    noted = F.contains(xml, F.lit("<!--")) | F.contains(xml, F.lit("<?"))
    xml = F.when(noted, F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>", "")).otherwise(xml)
    escaped = lambda t: reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], t)
    plain = F.transform(F.split(xml, r"<!\[CDATA\["), lambda p, i: F.when(i == 0, p).otherwise(F.concat(
        escaped(F.substring_index(p, "]]>", 1)), F.substring(p, F.length(F.substring_index(p, "]]>", 1)) + 4, F.length(p))
    )))
    text = F.when(F.contains(xml, F.lit("<![CDATA[")), F.array_join(plain, "")).otherwise(xml)
    text = F.regexp_replace(text, r">(?=\s*[^<\s])", ">" + TEXT_MARK)
    return F.regexp_replace(text, r"""=\s*(["'])""", "=$1" + TEXT_MARK)


def json_from_xml(xml: Column) -> Column:
    """JSON document text of the XML text of one ``bom`` element; null if it cannot be parsed."""
    options = {"ignoreSurroundingSpaces": "false"}
    # The parser to VARIANT throws on a broken text; the one to a struct puts it in a column. Inside a lambda it
    # runs interpreted; Spark 4.1 generates code for it that does not compile.
    sound = lambda x: (x != "") & F.from_xml(x, "bad string", {"columnNameOfCorruptRecord": "bad"})["bad"].isNull()
    parsed = F.transform(F.array(_marked(xml)), lambda x: F.when(sound(x), F.to_json(F.from_xml(x, "variant", options))))
    return F.arrow_udf(_json_texts, StringType())(F.get(parsed, F.lit(0)))


def read_xml_documents(spark: SparkSession, paths: list[str], only_xml: bool = False) -> DataFrame:
    """``bom`` elements as (bom_id, value): JSON document texts. ``only_xml`` passes over other files.

    Files are split at ``</bom>``, so one of many BOMs is read in parallel. A BOM's id is its file's path and
    the hash of its text: versions of one serial number stay apart, an element repeated in a file is read once.
    """
    reader = spark.read.option("lineSep", "</bom>").option("recursiveFileLookup", "true")
    if only_xml:
        reader = reader.option("pathGlobFilter", "*.[xX][mM][lL]")
    raw = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)<bom[\s>].*$", 0).alias("xml"))
    xml = F.when(F.col("xml") != "", F.concat("xml", F.lit("</bom>")))
    ids = raw.where(xml.isNotNull()).select(F.concat("path", F.lit("#"), F.sha1(xml)).alias("bom_id"), xml.alias("xml"))
    ids = dealt(ids, "bom_id").dropDuplicates(["bom_id"])
    # A one-row generator keeps the filter above it, which else would hold the whole conversion a second time.
    once = F.inline(F.array(F.struct(json_from_xml(F.col("xml")).alias("value"))))
    return ids.select("bom_id", once).where(F.col("value").isNotNull())


# ---- writing ----------------------------------------------------------------------------


def xml_from_json(value: Column) -> Column:
    """XML text of a JSON document text."""
    return F.arrow_udf(_xml_texts, StringType())(F.to_json(F.try_parse_json(value)))
