"""Document files and extraction answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import display_path, file_stem
from estatemap.operators.tables import first_by

SUFFIXES = (".bpmn", ".xml", ".txt", ".docx", ".pdf")
TEXT_KEYS = ("process", "roles", "process_owner", "org_unit_candidates", "applications")
MODEL_KEYS = ("process", "process_id", "roles", "applications")


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """Process documents below ``root``: path, display_path, content and file_hash (SHA-256 of the bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    scheme_free = F.regexp_replace("path", "^file:/*", "/")
    base = "/" + root.removeprefix("file:").strip("/")
    return files.filter(suffix.isin(*SUFFIXES)).select(
        "path", display_path(scheme_free, base).alias("display_path"), "content",
        F.sha2("content", 256).alias("file_hash"), suffix.alias("suffix"))


def read_texts(documents: DataFrame) -> DataFrame:
    """Whole text per file. Bytes that are no UTF-8 give status ``error`` instead of failing the job."""
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    return documents.withColumn("text", decoded).withColumns({
        "status": F.when(F.col("text").isNull(), F.lit(model.STATUS_ERROR)),
        "error_message": F.when(F.col("text").isNull(), F.lit("not valid UTF-8")),
    }).drop("content")


def json_object(answer: Column) -> Column:
    """Text from the first brace of the answer on; the JSON parser stops at the end of that object.

    An answer that is a JSON array as a whole is no object.
    """
    whole = text.strip(answer)
    is_array = whole.startswith("[") & F.json_array_length(whole).isNotNull()
    tail = F.regexp_extract(answer, r"(?s)(\{.*)", 1)
    return F.when(~F.coalesce(is_array, F.lit(False)) & (tail != ""), tail)


def read_extractions(answers: DataFrame, column: str, required: tuple[str, ...] = TEXT_KEYS) -> tuple[DataFrame, DataFrame]:
    """Typed records of extractor answers, and the rejected rows with the reason."""
    parsed = answers.withColumn("_json", json_object(F.col(column))).withColumn(
        "payload", F.from_json("_json", model.EXTRACTION_SCHEMA)).withColumn("_keys", F.json_object_keys("_json"))
    missing = F.array_except(F.array(*[F.lit(key) for key in required]), F.col("_keys"))
    reason = (
        F.when(F.col("_json").isNull(), "no_object").when(F.col("_keys").isNull(), "invalid_json")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(F.array_sort(missing), ", ")))
        .when(F.col("payload.process").isNull() | F.col("payload.applications").isNull(), "wrong_shape")
    )
    judged = parsed.withColumn("reason", reason).drop("_json", "_keys")
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).drop("payload")


def extracted_documents(records: DataFrame, *, structural_id: str | None = None, from_model: bool = False) -> DataFrame:
    """Document rows from typed records with path, text, file_hash and payload.

    A process id in the text wins over the payload's, then the file name stands in; records of process
    models take the id of the model instead and carry neither owner nor organization names.
    """
    body = F.coalesce(F.col("text"), F.lit("")) if "text" in records.columns else F.lit("")
    none = F.array().cast("array<string>")
    if from_model:
        ident = F.coalesce(F.nullif(F.col(structural_id), F.lit("")) if structural_id else F.lit(None), F.col("payload.process_id"))
        roles, owner, units = F.coalesce(text.clean_roles(F.col("payload.roles")), none), F.lit(""), none
    else:
        ident = text.process_id_of(body, F.col("payload.process_id"), file_stem(F.col("path")))
        roles = text.roles_of(body, F.col("payload.roles"))
        owner = text.owner_of(body, F.col("payload.process_owner"))
        units = text.org_candidates_of(body, F.col("payload.org_unit_candidates"))
    documents = records.select(
        F.col("path").alias("source_path"), "file_hash", ident.alias("process_id"),
        F.col("payload.process").alias("process_name"), roles.alias("roles"),
        owner.alias("process_owner_candidate"), units.alias("org_unit_candidates"),
        F.coalesce("payload.follows_after", none).alias("follows_after"),
        F.col("payload.applications").alias("raw_applications"),
        *([F.col("ordinal")] if "ordinal" in records.columns else []),
    )
    return dedup_applications(documents).withColumn("status", text.document_status(F.col("applications")))


def dedup_applications(documents: DataFrame) -> DataFrame:
    """Best spelling per application key within each document, in the order the keys first appear.

    All of it happens inside the row's own array, so no shuffle is needed: one sort puts the best spelling
    of each key first, another the earliest, and both keep one entry per key in the same key order.
    No entry is null, so ``sort_array`` does it; ``array_sort`` calls a comparing expression for every two entries.
    """
    cleaned = F.transform("raw_applications", lambda item, i: F.struct(
        text.clean_app_name(item["name"]).alias("name"), item["confidence"].alias("confidence"), i.alias("pos")))
    keyed = F.transform(cleaned, lambda item: F.struct(
        text.app_key(item["name"]).alias("key"), item["name"].alias("name"), item["confidence"].alias("confidence"),
        item["pos"].alias("pos")))
    usable = F.filter(keyed, lambda item: (item["key"] != "") & text.is_modeled_app(item["name"]))

    def chosen(items: Column) -> Column:
        by_quality = F.sort_array(F.transform(items, lambda item: F.struct(
            item["key"].alias("key"), text.app_rank(item["name"], item["confidence"]).alias("rank"),
            item["pos"].alias("pos"), item["name"].alias("name"), item["confidence"].alias("confidence"))))
        by_place = F.sort_array(F.transform(items, lambda item: F.struct(item["key"].alias("key"), item["pos"].alias("pos"))))
        pairs = F.zip_with(text.first_of_runs(by_quality), text.first_of_runs(by_place), lambda best, first: F.struct(
            first["pos"].alias("pos"), best["name"].alias("name"), best["confidence"].alias("confidence")))
        return F.transform(F.sort_array(pairs), lambda entry: F.struct(entry["name"].alias("name"), entry["confidence"].alias("confidence")))

    return documents.withColumn("applications", text.bind(usable, chosen))


def changed_documents(documents: DataFrame, state: DataFrame) -> DataFrame:
    """Documents whose (source_path, file_hash) is not in the import state."""
    return documents.join(state.select("source_path", "file_hash"), ["source_path", "file_hash"], "left_anti")


def dedup_documents(documents: DataFrame, order: str = "ordinal") -> DataFrame:
    """First document per (source_path, file_hash, status) of a run."""
    return first_by(documents, ["source_path", "file_hash", "status"], [F.col(order)])
