"""Identifiers, paths, labels and readable texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatemap.functions.text import strip

# Language names that stand for a language code.
LANGUAGE_CODES = {"german": "de", "english": "en", "french": "fr", "spanish": "es"}
LANGUAGE_PREFERENCE = ("de", "german", "en", "english")


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(value, F.lit(default))


def node_id(label: Column | str, key: Column) -> Column:
    """Stable node id from the natural key; null key gives null."""
    head = F.lit(label) if isinstance(label, str) else label
    return F.concat(head, F.lit(":"), key)


def hashed_node_id(label: Column, source: Column, key: Column) -> Column:
    """Node id of an element that has no natural key."""
    digest = F.sha2(F.concat_ws("||", label, text_or(source), text_or(key)), 256)
    return F.concat(label, F.lit(":"), digest)


def stable_id(prefix: str, key: Column) -> Column:
    digest = F.substring(F.sha1(F.concat(F.lit(f"{prefix}:"), key).cast("binary")), 1, 16)
    return F.concat(F.lit(f"id-{prefix}-"), digest)


def row_id(*parts: Column) -> Column:
    """Hash of the parts joined by ``||``; a null part counts as the text ``None``."""
    rendered = [text_or(part.cast("string"), "None") for part in parts]
    return F.sha2(F.concat_ws("||", *rendered), 256)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def file_stem(path: Column) -> Column:
    name = base_name(path)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def display_path(path: Column, root: str) -> Column:
    """Path relative to ``root``, or the file name when it lies elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(
        base_name(path))


def pick_name(names: Column, preferences: tuple[str, ...] = LANGUAGE_PREFERENCE) -> Column:
    """Best name of an ``array<struct<text,lang>>``: preferred language first, else first non-blank."""
    codes = F.create_map(*[F.lit(part) for pair in LANGUAGE_CODES.items() for part in pair])

    def code(lang: Column) -> Column:
        lowered = F.lower(text_or(lang))
        return F.coalesce(codes[lowered], lowered)

    filled = F.filter(names, lambda name: text_or(strip(name["text"])) != "")
    wanted = list(dict.fromkeys(LANGUAGE_CODES.get(pref.lower(), pref.lower()) for pref in preferences))

    def spoken(lang: str) -> Column:
        return F.get(F.filter(filled, lambda name: code(name["lang"]) == lang), F.lit(0))["text"]

    choices = [spoken(lang) for lang in wanted]
    return text_or(strip(F.coalesce(*choices, F.get(filled, F.lit(0))["text"])))


def strip_type_prefix(value: Column) -> Column:
    return F.element_at(F.split(text_or(value), ":"), -1)


def strip_relationship_suffix(value: Column) -> Column:
    return F.regexp_replace(value, "Relationship$", "")


def display_name(name: Column, node: Column) -> Column:
    tail = F.nullif(F.element_at(F.split(node, ":"), -1), F.lit(""))
    return F.coalesce(F.nullif(strip(name), F.lit("")), tail, F.lit("?"))


def reference_of(label: Column, name: Column, process_id: Column, cmdb_id: Column, ident: Column,
                 node: Column) -> Column:
    """Readable key of a node; which property it is depends on the label."""
    return (
        F.when(label == "Process", F.coalesce(process_id, name, node, F.lit("")))
        .when(label == "Application", F.coalesce(cmdb_id, name, F.lit("")))
        .when(label.isin("Interface", "Server", "Infrastructure"), F.coalesce(ident, name, F.lit("")))
        .otherwise(F.coalesce(name, cmdb_id, ident, process_id, node, F.lit("")))
    )


def relationship_key(rel_type: Column, other_label: Column, other_ref: Column) -> Column:
    return F.concat_ws("|", text_or(rel_type), text_or(other_label), text_or(other_ref))


def option_label(name: Column, ident: Column) -> Column:
    return F.format_string("%s [%s]", text_or(name), text_or(ident))


# Texts shown for the reason a relation was skipped.
SKIP_REASONS = {
    "unresolvable_endpoint": "unbekannter Endpunkt",
    "type_not_accepted": "Typ nicht konfiguriert",
    "no_graph_relation": "kein Mapping",
}


def skip_reason_label(reason: Column) -> Column:
    return reduce(lambda chain, item: chain.when(reason == item[0], item[1]), SKIP_REASONS.items(), F).otherwise(reason)


# Per decision type, the label and payload fields of each part of the context line.
CONTEXT_PARTS = {
    "manual_process_owner_assignment": [("Prozess", "process_name", "process_id"), ("Eigentümer", "org_unit_name")],
    "manual_role_assignment": [("Rolle", "role_name"), ("Organisationseinheit", "org_unit_name")],
    "manual_link": [("Prozess", "process_id"), ("Begriff", "application_name"), ("Ziel", "matched_name")],
    "confirmed_candidate_link": [("Prozess", "process_id"), ("Begriff", "application_name"), ("Ziel", "matched_name")],
    "entity_merge": [("Typ", "entity_type"), ("Quelle", "source_name"), ("Ziel", "target_name")],
    "decision_revert": [("Zurückgenommen", "reverted_type"), ("Ursprungs-ID", "reverted_decision_id")],
}


def decision_context(decision_type: Column, payload_json: Column) -> Column:
    """One readable line per decision; empty when the payload carries nothing to show."""
    chain = F
    for kind, parts in CONTEXT_PARTS.items():
        values = [
            F.coalesce(*[F.nullif(strip(F.get_json_object(payload_json, f"$.{field}")), F.lit("")) for field in fields])
            for _, *fields in parts
        ]
        line = F.concat_ws(" | ", *[F.concat(F.lit(f"{part[0]}: "), F.coalesce(value, F.lit("-")))
                                    for part, value in zip(parts, values)])
        shown = F.when(F.coalesce(*values).isNotNull(), line).otherwise("")
        chain = chain.when(decision_type == kind, shown)
    return chain.otherwise("")
