"""Scalar functions and rules on columns. Rules are boolean columns; null input makes a rule false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier prefixes and the namespaces that they belong to.
PREFIXES = {"CASE": "case", "ACQ": "acquisition", "NOTE": "note", "FILE": "file", "ART": "artefact", "EXPORT": "export", "TRANSFER": "authority_transfer"}
# Suffixes of files that are still being written.
TRANSIENT = (".part", ".ytdl", ".tmp", ".temp")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sure(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def iso_utc(ts: str | Column) -> Column:
    """A time in UTC as text in whole seconds, 2024-01-31T10:00:00Z."""
    return F.date_format(F.date_trunc("second", col(ts)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_id(prefix: str, number: str | Column) -> Column:
    """PREFIX-000001; numbers of more than six digits are written in full."""
    return F.format_string(f"{prefix}-%06d", col(number).cast("long"))


def id_type(identifier: str | Column) -> Column:
    """What an identifier names, by its prefix; null for others."""
    out = F.lit(None).cast("string")
    for prefix, name in PREFIXES.items():
        out = F.when(col(identifier).startswith(prefix + "-"), name).otherwise(out)
    return out


def normalise_path(path: str | Column) -> Column:
    return F.replace(F.trim(col(path)), F.lit("\\"), F.lit("/"))


def is_safe_path(path: str | Column) -> Column:
    """Not empty, not absolute, and without a part `..`, after normalisation."""
    p = normalise_path(path)
    return sure((F.length(p) > 0) & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(p, "/"), ".."))


def safe_leaf(path: str | Column, default: str = "payload") -> Column:
    """The last part of a path, or the default."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(normalise_path(path), "/"), -1)), F.lit("")), F.lit(default))


def strip_suffix(path: str | Column, suffix: str = ".gpg") -> Column:
    return F.when(col(path).endswith(suffix), F.substring(col(path), F.lit(1), F.length(col(path)) - len(suffix))).otherwise(col(path))


def storage_path(*parts: str | Column) -> Column:
    return F.concat_ws("/", *[col(p) for p in parts])


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def has_reason(c: str | Column) -> Column:
    return sure(F.length(F.trim(col(c))) > 0)


def valid_id(c: str | Column) -> Column:
    return sure(col(c).rlike(r"^[A-Z]+-[0-9]{6,}$"))


def normalise_fingerprint(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(col(c), r"\s+", ""))


def valid_fingerprint(c: str | Column) -> Column:
    return sure(normalise_fingerprint(c).rlike("^[0-9A-F]{40}([0-9A-F]{24})?$"))


def url_item_id(url: str | Column, short_hosts: tuple[str, ...], parameter: str) -> Column:
    """The first part of the path on short hosts, else the parameter of the query; null when blank."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    path = F.get(F.split(F.try_parse_url(col(url), F.lit("PATH")), "/"), F.lit(1))
    asked = F.try_parse_url(col(url), F.lit("QUERY"), F.lit(parameter))
    return F.nullif(F.when(host.isin(*short_hosts), path).otherwise(F.try_url_decode(asked)), F.lit(""))


def is_transient(path: str | Column) -> Column:
    leaf = F.lower(col(path))
    rule = leaf.rlike(r"\.part-frag[0-9]*")
    for suffix in TRANSIENT:
        rule = rule | leaf.endswith(suffix)
    return sure(rule)


def classify_suffix(path: str | Column, suffixes: dict[str, str], default: str) -> Column:
    """The class of a file by the first suffix, in the order given, that its lower-case path ends with."""
    out = F.lit(default)
    for suffix, name in reversed(suffixes.items()):
        out = F.when(F.lower(col(path)).endswith(suffix), name).otherwise(out)
    return out


def media_type(content: str | Column) -> Column:
    """A payload's type by its first bytes."""
    h = F.hex(F.substring(col(content), 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("52494646") & F.substring(h, 17, 8).eqNullSafe("57454250"), "image/webp").otherwise("unknown")


def png_size(content: str | Column) -> Column:
    """struct<width, height> of a PNG payload; null for others."""
    number = lambda at: F.conv(F.hex(F.substring(col(content), at, 4)), 16, 10).cast("long")
    return F.when(media_type(content) == "image/png", F.struct(number(17).alias("width"), number(21).alias("height")))


def valid_point(x: str | Column, y: str | Column) -> Column:
    return sure(col(x).between(0, 1) & col(y).between(0, 1))


def valid_box(x: str | Column, y: str | Column, width: str | Column, height: str | Column) -> Column:
    """A box of positive size within the unit square."""
    inside = (col(x) + col(width) <= 1) & (col(y) + col(height) <= 1)
    return sure(valid_point(x, y) & (col(width) > 0) & (col(height) > 0) & inside)


def valid_digest(c: str | Column) -> Column:
    return sure(col(c).rlike("^[0-9a-fA-F]{64}$"))


def actor_consistent(kind: str | Column, actor_id: str | Column, actor_uuid: str | Column) -> Column:
    """A system actor has no ids, an operator has both."""
    none, both = col(actor_id).isNull() & col(actor_uuid).isNull(), col(actor_id).isNotNull() & col(actor_uuid).isNotNull()
    return sure((col(kind) == "system") & none | (col(kind) == "operator") & both)


def system_defaults(kind: str | Column, basis: str | Column) -> Column:
    """The authority basis of an event: what it names, and `system` for a system actor that names none."""
    return F.coalesce(col(basis), F.when(col(kind) == "system", "system"))


# What the columns of a ledger's tables may hold.
ENUMS = {
    "identifiers.state": ("active", "retired", "failed"), "audit_events.actor_kind": ("system", "operator"), "operators.state": ("active", "retired"), "operator_keys.state": ("active", "retired", "revoked"),
    "project_memberships.membership_role": ("owner", "contributor"), "project_memberships.state": ("pending", "active", "rejected", "removed"),
    "ownership.scope_type": ("project", "case"), "ownership_transfers.scope_type": ("project", "case"), "ownership_transfers.state": ("pending", "accepted", "rejected", "cancelled"),
    "record_authority.scope_type": ("project", "case"), "record_authority.status": ("pending", "approved", "rejected"),
    "files.presentation_state": ("presented", "retracted", "superseded"), "artefacts.presentation_state": ("presented", "retracted", "superseded"),
    "notes.visibility": ("project", "confidential"), "notes.package_disclosure": ("withheld", "include"), "note_revisions.revision_type": ("content", "cryptographic"),
    "export_policy.ordinary_export": ("owner", "members"), "export_policy.ciphertext_export": ("owner", "members"), "export_policy.confidential_plaintext_export": ("owner", "authority"), "export_policy.broad_scope_export": ("owner", "members"),
    "confidential_authority.object_type": ("file", "note", "artefact"), "access_grants.object_type": ("file", "note", "artefact"),
    "access_grants.authority_basis": ("object-owner", "explicit-grant", "project-owner", "case-role", "recovery-authority", "system-policy"), "confidential_authority_transfers.state": ("pending", "accepted", "rejected", "cancelled"),
    "exports.scope_type": ("file", "artefact", "acquisition", "case", "project", "selection"), "exports.view_mode": ("full", "presented"), "exports.representation": ("native",), "exports.output_format": ("directory", "tar"),
    "exports.state": ("preparing", "completed", "failed", "cancelled"), "export_items.mode": ("native", "derived"),
    "annotations.kind": ("rectangle", "ellipse", "arrow", "line", "freehand", "marker", "text", "highlight"),
    "acquired_files.role": ("primary", "supporting", "metadata", "transcript", "derived", "annotation", "redaction_request", "preview", "source_metadata", "network", "inspection"),
}


def enum_rule(name: str, value: str | Column | None = None) -> Column:
    """Whether a value is one of those that ENUMS names; null is not."""
    return sure(col(value if value is not None else name.split(".")[1]).isin(*ENUMS[name]))


def classify_file(path: str | Column, rules: list[tuple[tuple[str, ...], str, str | None, str, str | None]], default: tuple[str, str | None, str, str | None]) -> Column:
    """struct<role, media_type, description, relationship> by the first rule (endings, role, media type, description,
    relationship to a primary file) one of whose endings the lower-case path ends with; in a media type * stands for the ending without its dot."""

    def shape(role: str, media: Column, description: str, relationship: str | None) -> Column:
        return F.struct(F.lit(role).alias("role"), media.cast("string").alias("media_type"), F.lit(description).alias("description"), F.lit(relationship).cast("string").alias("relationship"))

    lower = F.lower(col(path))
    ending = F.regexp_extract(lower, r"\.([^./]*)$", 1)
    role, media, description, relationship = default
    out = shape(role, F.lit(media), description, relationship)
    for endings, role, media, description, relationship in reversed(rules):
        hit = F.lit(False)
        for e in endings:
            hit = hit | lower.endswith(e)
        kind = F.lit(media) if not media or "*" not in media else F.replace(F.lit(media), F.lit("*"), F.when(ending == "jpg", "jpeg").otherwise(ending))
        out = F.when(hit, shape(role, kind, description, relationship)).otherwise(out)
    return out


def is_confidential(classification: str | Column) -> Column:
    return sure(col(classification).startswith("confidential-"))


def bounded(c: str | Column, n: int = 1000) -> Column:
    return F.substring(col(c), 1, n)


def last_line(c: str | Column) -> Column:
    """The last line of a text without the white space around the text."""
    return F.element_at(F.split(F.regexp_replace(col(c), r"^\s+|\s+$", ""), "\r\n|\n|\r"), -1)


def is_broad(scope: str | Column) -> Column:
    return sure(col(scope).isin("case", "project", "selection"))


NOTE_SCHEMA = "note-payload/v1"


def note_payload(title: str | Column, body: str | Column, schema: str = NOTE_SCHEMA) -> Column:
    """A note as canonical JSON: body, schema and title, the title trimmed."""
    return F.to_json(F.struct(col(body).alias("body"), F.lit(schema).alias("schema"), F.trim(col(title)).alias("title")), {"ignoreNullFields": "false"})


def parse_note(payload: str | Column, schema: str = NOTE_SCHEMA) -> Column:
    """struct<title, body>; null for other text than a note of the schema in which both are strings."""
    raw = F.from_json(col(payload), "schema string, title string, body string")
    strings = F.lit(True)
    for field in ("title", "body"):  # numbers and objects would be read as text
        strings = strings & F.schema_of_variant(F.try_variant_get(F.try_parse_json(col(payload)), f"$.{field}", "variant")).eqNullSafe("STRING")
    return F.when((raw["schema"] == schema) & strings, F.struct(raw["title"].alias("title"), raw["body"].alias("body")))


def merge_record(base: str | Column, update: str | Column) -> Column:
    """Two string maps as one; the update's values win."""
    held = F.map_filter(col(base), lambda k, _: ~F.map_contains_key(col(update), k))
    return F.coalesce(F.map_concat(held, col(update)), col(base), col(update))
