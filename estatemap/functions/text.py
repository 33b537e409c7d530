"""Name and text normalization as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide normalized keys.
MATCH_STOP_WORDS = ("interface", "system", "operation", "op", "java", "com")
APP_STOP_WORDS = (
    "interface", "system", "service", "application", "participant", "processref", "participantref",
)
APP_KEYWORDS = (
    "api", "app", "application", "bpanda", "cloud", "crm", "excel", "interface", "jira", "microsoft", "outlook",
    "portal", "sap", "salesforce", "service", "sharepoint", "system", "teams", "ticket", "tool", "workflow",
)
TECHNICAL_NAMES = ("process", "lane", "start event", "end event")
MANUAL_NAME_LIMIT = 120
MANUAL_NAME_PATTERN = "^[A-Za-z0-9 _./()&,+-]+$"

_SPACES = r"(?U)\s+"


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def optional(value: Column) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(strip(value), F.lit(""))


def squeeze(value: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(value, _SPACES, " "))


def casefold(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, "[ßẞ]", "ss"))


def fold_key(value: Column) -> Column:
    """Key of organization and alias names: case-folded, white space collapsed."""
    return squeeze(casefold(value))


def entity_type(value: Column) -> Column:
    """Lower-cased type; blank means application. Unknown values stay visible for validation."""
    cleaned = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.when(cleaned == "", F.lit("application")).otherwise(cleaned)


def server_type(value: Column) -> Column:
    return F.nullif(F.lower(strip(F.coalesce(value, F.lit("")))), F.lit(""))


def split_camel(value: Column) -> Column:
    return F.regexp_replace(value, "([a-z0-9])(?=[A-Z])", "$1 ")


def _tokens_without(value: Column, stop_words: tuple[str, ...]) -> Column:
    tokens = F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9]+)"), 1)
    return F.array_join(F.filter(tokens, lambda token: ~token.isin(*stop_words)), " ")


def match_key(name: Column) -> Column:
    """Comparison key of a name: no parentheses or package paths, camel case split, stop words out."""
    bare = F.regexp_replace(name, r"\([^)]*\)", " ")
    bare = F.regexp_replace(bare, r"\b[a-z]+:[A-Za-z0-9_.]+\b", " ")
    return _tokens_without(F.regexp_replace(split_camel(bare), "[_./-]+", " "), MATCH_STOP_WORDS)


def display_key(name: Column) -> Column:
    """Match key after shortening dotted package paths to their last segment."""
    return match_key(F.regexp_replace(name, r"\b(?:[a-z][A-Za-z0-9_]*\.)+([A-Za-z][A-Za-z0-9_]*)\b", "$1"))


def clean_app_name(name: Column) -> Column:
    return squeeze(F.regexp_replace(strip(name), r"(?U)\s*\([^)]*\)\s*$", ""))


def app_key(name: Column) -> Column:
    return _tokens_without(split_camel(name), APP_STOP_WORDS)


def is_modeled_app(name: Column) -> Column:
    return ~F.lower(name).endswith("operation")


def app_rank(name: Column, confidence: Column) -> Column:
    """Sort key of competing spellings: strong first, then readable, then undotted, then short."""
    return F.struct(
        (~F.coalesce(confidence == "stark", F.lit(False))).alias("weak"),
        (~F.contains(name, F.lit(" "))).alias("unreadable"),
        F.contains(name, F.lit(".")).alias("dotted"),
        F.char_length(name).alias("length"),
    )


def model_name(value: Column) -> Column:
    """Display name of a process-model element: prefix before the first colon dropped."""
    cleaned = squeeze(value)
    cleaned = F.trim(F.regexp_replace(cleaned, "^[^:]*:", ""))
    return F.trim(split_camel(F.replace(cleaned, F.lit("_"), F.lit(" "))))


def process_ref(value: Column) -> Column:
    return strip(F.element_at(F.split(strip(value), ":"), -1))


def is_generic_participant(value: Column) -> Column:
    return strip(value).rlike(r"(?i)^participant( \d+)?$")


def is_application_like(value: Column) -> Column:
    folded = casefold(value)
    tokens = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), 1)
    return (
        (F.coalesce(value, F.lit("")) != "")
        & ~folded.isin(*TECHNICAL_NAMES)
        & ~folded.endswith("operation")
        & ~is_generic_participant(value)
        & F.arrays_overlap(tokens, F.array(*[F.lit(word) for word in APP_KEYWORDS]))
    )


def slug(value: Column) -> Column:
    joined = F.regexp_replace(strip(value), _SPACES, "_")
    joined = F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9_-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit("")), F.lit("process"))


def entity_key(value: Column) -> Column:
    joined = F.replace(casefold(strip(value)), F.lit("&"), F.lit(" und "))
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def batch_key(value: Column) -> Column:
    """Case-folded term without any white space."""
    return F.regexp_replace(casefold(value), _SPACES, "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of_runs(items: Column) -> Column:
    """First element of every run of equal ``key`` in a sorted array of structs."""
    return bind(items, lambda ordered: F.filter(
        ordered, lambda item, i: (i == 0) | (item["key"] != F.get(ordered, i - 1)["key"])))


def first_per_key(items: Column, key) -> Column:
    """Array without later elements whose key was already seen; sorted twice instead of compared pairwise."""
    keyed = F.array_sort(F.transform(items, lambda item, i: F.struct(
        key(item).alias("key"), i.alias("at"), item.alias("item"))))
    firsts = F.transform(first_of_runs(keyed), lambda entry: F.struct(entry["at"].alias("at"), entry["item"].alias("item")))
    return F.transform(F.array_sort(firsts), lambda entry: entry["item"])


def split_multi(values: Column, pattern: str = "[;,\n]+") -> Column:
    """Flatten separator lists, collapse blanks, drop empties, case-insensitive first wins."""
    parts = F.flatten(F.transform(values, lambda value: F.split(value, pattern)))
    cleaned = F.filter(F.transform(parts, squeeze), lambda part: part != "")
    return first_per_key(cleaned, casefold)


def clean_roles(values: Column) -> Column:
    cleaned = F.filter(F.transform(values, squeeze), lambda role: role != "")
    return first_per_key(cleaned, casefold)


def list_items(raw: Column, separator: str = ",") -> Column:
    """Trimmed non-blank items of a separator list; null gives an empty array."""
    parts = F.split(F.coalesce(raw, F.lit("")), "\\Q" + separator + "\\E")
    return F.filter(F.transform(parts, strip), lambda item: item != "")


def labelled_value(text: Column, label: str) -> Column:
    """Single-word value of a ``Label: value`` line, else null."""
    return F.nullif(F.regexp_extract(text, rf"(?mi)^\s*{label}:\s*(\S+)\s*$", 1), F.lit(""))


def is_transform_text(text: Column) -> Column:
    """Text written by the process-model transform: its first line ends in the marker."""
    return F.coalesce(text.rlike(r"^\s*(\S+ )?BPMN Transform"), F.lit(False))


def lane_labels(text: Column) -> Column:
    line = F.regexp_extract(text, r"(?mi)^[ \t]*Lane Labels:[ \t]*(.+?)[ \t]*$", 1)
    parts = F.filter(F.transform(F.split(line, ","), squeeze),
                     lambda part: (part != "") & (casefold(part) != "none"))
    return F.when(is_transform_text(text), first_per_key(parts, casefold)).otherwise(
        F.array().cast("array<string>"))


# Labels that open and close the description of a process text.
SECTION_OPEN = ("Beschreibung:", "Ziel:", "Ablauf:")
SECTION_CLOSE = (
    "Genutzte Anwendungen:", "Hinweis", "Prozess-ID:", "Prozessname:", "Abteilung:", "Rolle:", "Owner:",
)


def documentation_section(text: Column) -> Column:
    """Description text: everything after the first opening label up to the next closing label.

    A closing label before any captured text does not end the section.
    """
    opened = "|".join(SECTION_OPEN)
    closed = "|".join(SECTION_CLOSE)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip)
    kinds = F.transform(
        lines,
        lambda line: F.struct(
            line.rlike(f"^({opened})").alias("opens"),
            line.rlike(f"^({closed})").alias("closes"),
            F.when(line.rlike(f"^({opened})"), strip(F.regexp_replace(line, f"^({opened})", "")))
            .otherwise(line).alias("body"),
        ),
    )
    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("done"), F.lit("").alias("body"))

    def step(state: Column, line: Column) -> Column:
        ends = line["closes"] & state["on"] & (state["body"] != "")
        done = state["done"] | ends
        on = state["on"] | (line["opens"] & ~done)
        takes = on & ~done & ~line["closes"] & (line["body"] != "")
        body = F.when(takes, F.trim(F.concat(state["body"], F.lit(" "), line["body"]))).otherwise(state["body"])
        return F.struct(on.alias("on"), done.alias("done"), body.alias("body"))

    return F.aggregate(kinds, start, step, lambda state: state["body"])


def roles_of(text: Column, roles: Column) -> Column:
    return F.when(is_transform_text(text), lane_labels(text)).otherwise(
        F.coalesce(split_multi(roles), F.array().cast("array<string>")))


def owner_of(text: Column, owner: Column) -> Column:
    return F.when(is_transform_text(text), F.lit("")).otherwise(squeeze(F.coalesce(owner, F.lit(""))))


def org_candidates_of(text: Column, candidates: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(is_transform_text(text), none).otherwise(F.coalesce(split_multi(candidates), none))


def process_id_of(text: Column, payload_id: Column, stem: Column) -> Column:
    return F.coalesce(labelled_value(text, "Process ID"), F.nullif(payload_id, F.lit("")), stem)


def manual_name_issue(raw: Column) -> Column:
    """Null when the name may be entered by hand, else the reason."""
    cleaned = squeeze(raw)
    return (
        F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("blank"))
        .when(F.char_length(cleaned) > MANUAL_NAME_LIMIT, F.lit("too_long"))
        .when(~cleaned.rlike(MANUAL_NAME_PATTERN), F.lit("bad_character"))
    )


def document_status(applications: Column) -> Column:
    return F.when(F.size(applications) > 0, F.lit("processed")).otherwise(F.lit("no_matches"))
