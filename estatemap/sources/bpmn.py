"""Process models (BPMN XML): processes, lanes, participants and application-like elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.session import cut_lineage

# Elements and attributes that may name an application.
APPLICATION_TAGS = (
    "participant", "interface", "serviceTask", "sendTask", "receiveTask", "businessRuleTask", "callActivity",
    "dataStoreReference", "dataStore",
)
APPLICATION_ATTRIBUTES = ("name", "implementationRef", "operationRef")

_PROCESS = r"(?s)(<process(?:\s[^>]*)?/>|<process(?:\s[^>]*)?>.*?</process>)"
_PARTICIPANT = r"(?s)(<participant(?:\s[^>]*)?/?>)"
# Prefixes of tags and attributes go, so that namespaced and bare models read the same.
_PREFIX = r"(</?)[A-Za-z_][\w.-]*:"
_ATTRIBUTE_PREFIX = r"(\s)[A-Za-z_][\w.-]*:([A-Za-z_][\w.-]*\s*=)"
_NAMESPACES = r"\sxmlns(?::[\w.-]+)?\s*=\s*(?:\"[^\"]*\"|'[^']*')"


def _computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, computed once per row: what reads or filters them is not merged into them as with ``withColumns``."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


def _bare(xml):
    cleaned = F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->", "")
    cleaned = F.regexp_replace(cleaned, _NAMESPACES, "")
    return F.regexp_replace(F.regexp_replace(cleaned, _PREFIX, "$1"), _ATTRIBUTE_PREFIX, "$1$2")


def _attribute(tag, name: str):
    value = F.regexp_extract(tag, rf"""\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    plain = F.regexp_replace(value, """^["']|["']$""", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#10;", "\n"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def _tags(column: str, tags: tuple[str, ...]):
    return F.regexp_extract_all(column, F.lit(rf"(?s)(<(?:{'|'.join(tags)})(?:\s[^>]*)?>)"), 1)


def read_processes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per process of each model, and the files without a readable process.

    ``texts`` has path and text. Columns: path, ordinal, structural_id, structural_name, fragment.
    A file whose tags do not balance is malformed and gives an error row.
    """
    cleaned = _computed(texts, _xml=_bare(F.col("text")))
    opened = F.size(F.regexp_extract_all("_xml", F.lit(r"(<[A-Za-z_][^<>]*[^/<>]>|<[A-Za-z_]>)"), 1))
    closed = F.size(F.regexp_extract_all("_xml", F.lit(r"(</[A-Za-z_][^<>]*>)"), 1))
    cleaned = _computed(cleaned, _fragments=F.regexp_extract_all("_xml", F.lit(_PROCESS), 1), _sound=opened == closed)
    readable = F.coalesce(F.col("_sound") & (F.size("_fragments") > 0), F.lit(False))
    errors = cleaned.filter(~readable).select(
        "path", F.lit(model.STATUS_ERROR).alias("status"),
        F.when(~F.coalesce("_sound", F.lit(False)), "invalid XML").otherwise("no process found").alias("error_message"))
    rows = cleaned.filter(readable).select("path", "_xml", F.posexplode("_fragments").alias("ordinal", "fragment"))
    head = F.regexp_extract("fragment", r"(?s)^(<process(?:\s[^>]*)?>)", 1)
    processes = rows.select(
        "path", "ordinal", F.trim(_attribute(head, "id")).alias("structural_id"),
        F.trim(_attribute(head, "name")).alias("structural_name"), "fragment", F.col("_xml").alias("document"))
    return processes, errors


def _participants(document: str) -> Column:
    """(structural_id, participant) of the named, non-generic participants of a document that refer to a process."""
    tags = F.regexp_extract_all(document, F.lit(_PARTICIPANT), 1)
    named = F.transform(tags, lambda tag: F.struct(
        text.process_ref(_attribute(tag, "processRef")).alias("structural_id"),
        text.model_name(_attribute(tag, "name")).alias("participant")))
    return F.filter(named, lambda each: (
        (each["participant"] != "") & (each["structural_id"] != "") & ~text.is_generic_participant(each["participant"])))


def participants(processes: DataFrame) -> DataFrame:
    """(path, structural_id, participant) of named, non-generic participants that refer to the process."""
    return processes.select("path", F.inline_outer(_participants("document"))).filter("participant IS NOT NULL").distinct()


def process_entries(processes: DataFrame) -> DataFrame:
    """Per process: name, sorted lanes, sorted applications (participants and application-like elements)."""
    tags = _tags("fragment", APPLICATION_TAGS)
    names = F.flatten(F.transform(tags, lambda tag: F.array(*[
        text.model_name(_attribute(tag, attribute)) for attribute in APPLICATION_ATTRIBUTES])))
    lanes = F.filter(F.transform(_tags("fragment", ("lane",)), lambda tag: text.model_name(_attribute(tag, "name"))),
                     lambda name: name != "")
    # Written once: the models are parsed for the processes and their participants together.
    read = cut_lineage(processes.select(
        "path", "ordinal", "structural_id",
        F.coalesce(F.nullif("structural_name", F.lit("")), F.nullif("structural_id", F.lit("")),
                   F.lit("Unnamed Process")).alias("process_name"),
        F.array_sort(F.array_distinct(lanes)).alias("lanes"),
        F.filter(names, text.is_application_like).alias("_elements"), _participants("document").alias("_named")))
    # The participants of one process are a part of its own file.
    joined = read.select("path", F.inline("_named")).groupBy("path", "structural_id").agg(F.collect_set("participant").alias("_participants"))
    none = F.array().cast("array<string>")
    return read.drop("_named").join(joined, ["path", "structural_id"], "left").select(
        "path", "ordinal", "structural_id", "process_name", "lanes",
        F.array_sort(F.array_union(F.coalesce("_participants", none), "_elements")).alias("applications"))


def transform_file_name(stem, process_name):
    return F.concat(stem, F.lit("__"), text.slug(process_name), F.lit("__transform.txt"))
