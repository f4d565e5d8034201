"""Scopes: which files a project, case, acquisition, artefact, note, export or file stands for; listings of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import id_type
from .findings import finding, row_findings
from .matching import active_key, descendants
from .sets import latest, ordered_members, union_all

TYPES = ("project", "case", "acquisition", "artefact", "note", "export", "file")


def resolve_scopes(targets: DataFrame, state: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(scope_type, scope_id, file_id, committed_sequence) for targets (scope_type, scope_id), and findings for those
    that stand for no file.

    state: files, artefact_files, note_revisions, export_items and file_relationships. An artefact stands for its
    members and all that is related below them. With identifiers in state, scopes that exist but stand for no file
    (empty-scope) are told from those that nobody issued (unknown-scope).
    """
    files = state["files"]
    # What is no file of the catalogue goes first, before lists of any length meet the targets and are made distinct.
    catalogued = lambda name, scope: state[name].select(F.col(scope).alias("scope_id"), "file_id").join(files.select("file_id"), "file_id", "left_semi")
    keyed = {
        "project": files.select(F.col("project_id").alias("scope_id"), "file_id"),
        "case": files.select(F.col("case_id").alias("scope_id"), "file_id"),
        "acquisition": files.select(F.col("acquisition_id").alias("scope_id"), "file_id"),
        "file": files.select(F.col("file_id").alias("scope_id"), "file_id"),
        "note": catalogued("note_revisions", "note_id"),
        "export": catalogued("export_items", "export_id"),
    }
    asked = targets.select("scope_type", "scope_id").distinct()
    parts = [asked.filter(F.col("scope_type") == name).join(rows, "scope_id").select("scope_type", "scope_id", "file_id") for name, rows in keyed.items()]
    members = asked.filter("scope_type = 'artefact'").join(state["artefact_files"].select(F.col("artefact_id").alias("scope_id"), "file_id"), "scope_id")
    below = descendants(state["file_relationships"], members.select(F.col("file_id").alias("root")), "parent_file_id", "child_file_id")
    parts.append(members.join(below.withColumnRenamed("root", "file_id"), "file_id").select("scope_type", "scope_id", F.col("node").alias("file_id")))
    found = union_all(parts).distinct().join(files.select("file_id", "committed_sequence"), "file_id")
    none = asked.join(found.select("scope_type", "scope_id"), ["scope_type", "scope_id"], "left_anti")
    if "identifiers" in state:
        none = none.join(state["identifiers"].select(F.col("identifier").alias("scope_id"), F.lit(True).alias("_exists")).distinct(), "scope_id", "left")
    else:
        none = none.withColumn("_exists", F.lit(True))
    rule = F.when(F.col("scope_type").isin(*TYPES) & F.col("_exists"), "empty-scope").otherwise("unknown-scope")
    return found.select("scope_type", "scope_id", "file_id", "committed_sequence"), none.select(F.col("scope_type").alias("target"), rule.alias("rule"), F.col("scope_id").alias("key"), *[F.lit(None).cast("string").alias(c) for c in ("column", "expected", "actual")])


def expand_selection(requests: DataFrame, state: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(request_id, file_id) for requests (request_id, ids array) of mixed identifiers; findings for ids that name nothing."""
    each = requests.select("request_id", F.explode("ids").alias("scope_id")).distinct().withColumn("scope_type", id_type("scope_id"))
    found, missing = resolve_scopes(each.filter("scope_type is not null").select("scope_type", "scope_id"), state)
    strange = finding(each.filter("scope_type is null"), F.col("request_id"), "unsupported-id", F.col("scope_id"))
    rows = each.join(found, ["scope_type", "scope_id"]).select("request_id", "file_id").distinct()
    return rows, missing.unionByName(strange)


def apply_view(files: DataFrame, mode: str = "full") -> DataFrame:
    """All files, or those presented."""
    if mode not in ("full", "presented"):
        raise ValueError(f"unknown view: {mode}")
    return files if mode == "full" else files.filter("presentation_state = 'presented'")


def list_artefacts(artefacts: DataFrame, members: DataFrame) -> DataFrame:
    """Artefacts with the ordered array of their files, empty where there is none."""
    held = ordered_members(members, "artefact_id", "created_sequence", "file_id", "file_ids")
    return artefacts.join(held, "artefact_id", "left").withColumn("file_ids", F.coalesce("file_ids", F.array().cast("array<string>")))


def note_revision(notes: DataFrame, revisions: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (note_id, revision) with the revision that is meant, 0 and null being the latest, and its file."""
    meant = asked.join(notes.select("note_id", "latest_revision"), "note_id").withColumn("revision", F.coalesce(F.nullif(F.col("revision"), F.lit(0)), F.col("latest_revision"))).drop("latest_revision")
    return meant.join(revisions, ["note_id", "revision"], "left")


def list_files(files: DataFrame, case_id: str | None = None) -> DataFrame:
    """Files, of one case if it is given, by (committed_sequence, file_id)."""
    return (files if case_id is None else files.filter(F.col("case_id") == case_id)).orderBy("committed_sequence", "file_id")


def artefact_members(members: DataFrame, files: DataFrame, artefact_id: str | None = None) -> DataFrame:
    """The direct members of artefacts with their files, by (created_sequence, file_id)."""
    held = members if artefact_id is None else members.filter(F.col("artefact_id") == artefact_id)
    return held.join(files, "file_id").orderBy("artefact_id", "created_sequence", "file_id")


def list_identifiers(identifiers: DataFrame, namespace: str | None = None) -> DataFrame:
    return (identifiers if namespace is None else identifiers.filter(F.col("namespace") == namespace)).orderBy("namespace", "sequence")


def list_records(records: DataFrame) -> DataFrame:
    """Authority records by (submitted_sequence, object_type, object_id)."""
    return records.orderBy(F.col("submitted_sequence").cast("long"), "object_type", "object_id")


def list_exports(exports: DataFrame) -> DataFrame:
    return exports.orderBy(F.col("created_sequence").cast("long"), "export_id")


def export_policy(policies: DataFrame, project_id: str | None = None) -> DataFrame:
    """The policy row in force: one for each project."""
    rows = policies.filter("policy_id = 'project'")
    return rows if project_id is None else rows.filter(F.col("project_id") == project_id)


def operator_identity(operators: DataFrame, keys: DataFrame, memberships: DataFrame, active_only: bool = True) -> DataFrame:
    """(operator_id, name, public_contact, organisation, role, operator_key_fingerprint, operator_signing_subkey_fingerprint) of operators with an active key, active members only unless told otherwise."""
    held = active_key(keys).select("operator_id", F.col("primary_fingerprint").alias("operator_key_fingerprint"), F.col("signing_fingerprint").alias("operator_signing_subkey_fingerprint"))
    rows = operators.join(held, "operator_id")
    if active_only:
        rows = rows.join(memberships.filter("state = 'active'").select("operator_id").distinct(), "operator_id", "left_semi")
    return rows.select("operator_id", "name", "public_contact", "organisation", F.col("role_label").alias("role"), "operator_key_fingerprint", "operator_signing_subkey_fingerprint")


def verify_id(asked: DataFrame, identifiers: DataFrame, state: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(identifier, scope_type, state, n_files) for identifiers (identifier), and findings for those that were never
    issued, whose namespace stands for no files, or which stand for none. A project's own id counts as issued."""
    projects = state["files"].select(F.col("project_id").alias("identifier"), F.lit("project").alias("namespace"), F.lit("active").alias("state")).distinct()
    known = identifiers.select("identifier", "namespace", "state").unionByName(projects)
    named = asked.select("identifier").distinct().join(known, "identifier", "left")
    strange = row_findings(named, F.col("identifier"), F.col("identifier"), [
        ("unknown-id", F.col("namespace").isNull(), None, None, None), ("unsupported-namespace", ~F.col("namespace").isin(*TYPES), "namespace", None, F.col("namespace")),
    ])
    good = named.filter(F.col("namespace").isin(*TYPES)).select(F.col("namespace").alias("scope_type"), F.col("identifier").alias("scope_id"), "state")
    found, empty = resolve_scopes(good, state)
    counted = found.groupBy("scope_type", "scope_id").agg(F.count("*").alias("n_files"))
    rows = good.join(counted, ["scope_type", "scope_id"], "left").select(F.col("scope_id").alias("identifier"), "scope_type", "state", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    return rows, strange.unionByName(empty)


def normalise_scope(requests: DataFrame, request: str = "request_id", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(request, object_type, object_id) for the tokens of confidential scopes: trimmed, blanks dropped, each once; and
    findings for tokens of other kinds and requests that name nothing."""
    each = requests.select(F.col(request).alias("_r"), F.explode_outer(F.array_distinct(F.transform(tokens, lambda t: F.trim(t)))).alias("object_id")).filter("object_id is null or object_id <> ''")
    kind = F.when(F.col("object_id").startswith("NOTE-"), "note").when(F.col("object_id").startswith("FILE-"), "file").when(F.col("object_id").startswith("ART-"), "artefact")
    rows = each.filter("object_id is not null").withColumn("object_type", kind)
    strange = finding(rows.filter("object_type is null"), F.col("_r"), "unsupported-object", F.col("object_id"))
    none = requests.select(F.col(request).alias("_r")).distinct().join(rows.select("_r"), "_r", "left_anti")
    return rows.filter("object_type is not null").select(F.col("_r").alias(request), "object_type", "object_id"), strange.unionByName(finding(none, F.col("_r"), "empty-scope", F.col("_r")))


def list_notes(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", "visibility", "author_id", "case_id", "subject_file_id", "created_sequence", "latest_revision")


def list_transfers(transfers: DataFrame) -> DataFrame:
    """Confidential transfers with their scope as an array of structs."""
    return transfers.withColumn("scope", F.from_json("scope_json", "array<struct<object_type:string,object_id:string>>"))


def current_owner(ownership: DataFrame, operators: DataFrame) -> DataFrame:
    return ownership.join(operators.select(F.col("operator_id").alias("owner_id"), "operator_ref", "name"), "owner_id", "left")


def find_operator(operators: DataFrame, asked: DataFrame) -> DataFrame:
    """(value, operator_id) for each value that is an operator's id, reference or uuid: three equal joins, never an OR."""
    return union_all([asked.select("value").join(operators.select(F.col(c).alias("value"), "operator_id"), "value") for c in ("operator_id", "operator_ref", "operator_uuid")]).distinct()


def active_cases(identifiers: DataFrame, cases: DataFrame) -> DataFrame:
    return identifiers.filter("namespace = 'case' and state = 'active'").join(cases, "identifier", "left")


def resolve_unique(asked: DataFrame, dimension: DataFrame, value: str, target: str) -> DataFrame:
    """asked with target and status: found, unknown or ambiguous."""
    held = dimension.groupBy(value).agg(F.countDistinct(target).alias("_n"), F.min(target).alias("_t"))
    joined = asked.join(held, value, "left")
    return joined.select(*asked.columns, F.when(F.col("_n") == 1, F.col("_t")).alias(target), F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("found").alias("status"))


def current_authority(authority: DataFrame) -> DataFrame:
    return latest(authority, ["object_type", "object_id"], "effective_sequence")
