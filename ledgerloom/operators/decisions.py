"""Decisions about export and access, for tables of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_broad, is_confidential
from .matching import active_key
from .sweeps import valid_at

# What each policy field may say.
POLICY_FIELDS = {
    "ordinary_export": ("owner", "members"),
    "ciphertext_export": ("owner", "members"),
    "confidential_plaintext_export": ("owner", "authority"),
    "broad_scope_export": ("owner", "members"),
}


# The columns that make an operator's identity.
IDENTITY = ("name", "public_contact", "organisation", "role_label", "primary_fingerprint", "signing_fingerprint")


def kept_identities(operators: DataFrame, keys: DataFrame) -> DataFrame:
    """(project_id, operator_id, IDENTITY) of operators as a project keeps them, with the fingerprints of the active key; those without one are left out."""
    held = active_key(keys).select("project_id", "operator_id", "primary_fingerprint", "signing_fingerprint")
    return operators.join(held, ["project_id", "operator_id"]).select("project_id", "operator_id", *IDENTITY)


def registered(requests: DataFrame, members: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """requests with _is_member: the operator is an active member of the project. members: project_id, operator_id, state.

    With identities (of kept_identities) requests have the columns of IDENTITY too, and all of them must be those kept;
    nulls are equal. An operator whose identity is kept in more than one form is registered under none of them.
    """
    keys = ["project_id", "operator_id"]
    active = members.filter("state = 'active'").select(*keys).distinct().withColumn("_is_member", F.lit(True))
    if identities is None:
        return requests.join(active, keys, "left")
    one = identities.distinct().groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_kept_{c}") for c in IDENTITY]).filter("_n = 1").drop("_n")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in IDENTITY])
    known = requests.join(active.join(one, keys), keys, "left").withColumn("_is_member", F.col("_is_member") & same)
    return known.drop(*[f"_kept_{c}" for c in IDENTITY])


def decide_export(requests: DataFrame, policy: DataFrame, owners: DataFrame, members: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """requests (project_id, operator_id, scope_type, has_ciphertext) with rule, the policy field that decides, and allowed.

    Nobody but active members of the project is admitted, with identities only those that are who they say (see registered). A broad scope decides before ciphertext does. A field that
    says `owner` admits the owner, one that says `members` every member; a project without a policy admits nobody.
    """
    columns = requests.columns
    requests = registered(requests, members, identities)
    rule = F.when(is_broad("scope_type"), "broad_scope_export").when(F.col("has_ciphertext"), "ciphertext_export").otherwise("ordinary_export")
    joined = requests.join(policy, "project_id", "left").join(owners.select("project_id", "owner_id"), "project_id", "left").withColumn("rule", rule)
    value = F.when(F.col("rule") == "broad_scope_export", F.col("broad_scope_export")).when(F.col("rule") == "ciphertext_export", F.col("ciphertext_export")).otherwise(F.col("ordinary_export"))
    allowed = F.coalesce(F.col("_is_member") & ((value == "members") | (value.isNotNull() & (F.col("operator_id") == F.col("owner_id")))), F.lit(False))
    return joined.select(*columns, "rule", allowed.alias("allowed"))


def decide_plaintext(requests: DataFrame, policy: DataFrame, owners: DataFrame, authority: DataFrame, members: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """requests (project_id, operator_id, object_id) with allowed: the owner, or the object's authority where the policy says so.

    Nobody but active members is admitted (with identities as in decide_export); objects without a recorded authority and projects without a policy admit nobody.
    """
    columns = requests.columns
    joined = (
        registered(requests, members, identities).join(policy.select("project_id", "confidential_plaintext_export"), "project_id", "left")
        .join(owners.select("project_id", "owner_id"), "project_id", "left")
        .join(authority.select("object_id", "authority_id"), "object_id", "left")
    )
    rule, authority_id = F.col("confidential_plaintext_export"), F.col("authority_id")
    by_owner = F.coalesce(F.col("operator_id") == F.col("owner_id"), F.lit(False))
    by_authority = F.coalesce((rule == "authority") & (F.col("operator_id") == authority_id), F.lit(False))
    return joined.select(*columns, F.coalesce(F.col("_is_member") & rule.isNotNull() & authority_id.isNotNull() & (by_owner | by_authority), F.lit(False)).alias("allowed"))


def decide_export_full(requests: DataFrame, items: DataFrame, policy: DataFrame, owners: DataFrame, authority: DataFrame, members: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """requests (request_id, project_id, operator_id, scope_type, decrypt) with the reasons against them, sorted, and allowed.

    items (request_id, file_id, classification, note_id): the files that each request stands for; note_id is null for
    files of no note. Every request needs the ordinary decision. Confidential files need the ciphertext decision too,
    or where they are to be decrypted a plaintext decision for each note; other confidential files can't be decrypted.
    With identities, every decision asks for who the operator is too, as in decide_export.
    """
    who = ["project_id", "operator_id", *(IDENTITY if identities is not None else ())]
    keys = ["request_id", *who, "scope_type"]
    decide = lambda flag, name: decide_export(requests.select(*keys).withColumn("has_ciphertext", F.lit(flag)), policy, owners, members, identities).select("request_id", F.col("allowed").alias(name))
    secret = items.filter(is_confidential("classification"))
    asked = secret.filter("note_id is not null").select("request_id", F.col("note_id").alias("object_id")).distinct().join(requests.filter("decrypt").select("request_id", *who), "request_id")
    plain = decide_plaintext(asked, policy, owners, authority, members, identities).groupBy("request_id").agg(F.every("allowed").alias("_plain"))
    held = items.groupBy("request_id").agg(F.max(is_confidential("classification")).alias("_secret"), F.max(is_confidential("classification") & F.col("note_id").isNull()).alias("_loose"))
    joined = requests.join(decide(False, "_ordinary"), "request_id", "left").join(decide(True, "_cipher"), "request_id", "left").join(held, "request_id", "left").join(plain, "request_id", "left")
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(F.col("_secret").isNull(), "no-files"), F.when(~F.coalesce("_ordinary", F.lit(False)), "ordinary"),
        F.when(F.col("_secret") & ~F.col("decrypt") & ~F.coalesce("_cipher", F.lit(False)), "ciphertext"),
        F.when(F.col("_loose") & F.col("decrypt"), "no-note"), F.when(F.col("decrypt") & ~F.coalesce("_plain", F.lit(True)), "plaintext"),
    )))
    return joined.select(*requests.columns, reasons.alias("reasons")).withColumn("allowed", F.size("reasons") == 0)


def transfer_effects(accepted: DataFrame, grants: DataFrame, basis: str = "object-owner") -> DataFrame:
    """(operator_id, object_type, object_id, action) for accepted confidential transfers (from_operator_id, to_operator_id, scope array of structs).

    The authority over each object moves to the new one (`authority`); the basis closes for the old one where it is open
    (`revoke`) and opens for the new one where it is not (`grant`).
    """
    items = accepted.select("from_operator_id", "to_operator_id", F.explode("scope").alias("s")).select("from_operator_id", "to_operator_id", "s.object_type", "s.object_id").distinct()
    keys = ["operator_id", "object_type", "object_id"]
    held = grants.filter(F.col("revoked_sequence").isNull() & (F.col("authority_basis") == basis)).select(*keys).distinct()
    side = lambda c: items.select(F.col(c).alias("operator_id"), "object_type", "object_id").distinct()
    moves = side("to_operator_id").withColumn("action", F.lit("authority"))
    closes = side("from_operator_id").join(held, keys, "left_semi").withColumn("action", F.lit("revoke"))
    opens = side("to_operator_id").join(held, keys, "left_anti").withColumn("action", F.lit("grant"))
    return moves.unionByName(closes).unionByName(opens)


def grants_at(requests: DataFrame, grants: DataFrame, keys: tuple[str, ...] = ("operator_id", "object_type", "object_id"), seq: str | None = None, width: int | None = None) -> DataFrame:
    """Requests joined to each grant that holds: now, or at the request's own sequence (width: as of valid_at)."""
    if seq is None:
        return requests.join(grants.filter("revoked_sequence is null"), list(keys))
    return valid_at(requests, grants, list(keys), seq, "granted_sequence", "revoked_sequence", width)


def grant_bases(grants: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bases): the bases of open grants, by (granted_sequence, basis)."""
    items = F.sort_array(F.collect_list(F.struct("granted_sequence", "authority_basis")))
    return grants.filter("revoked_sequence is null").groupBy(*keys).agg(F.transform(items, lambda x: x["authority_basis"]).alias("bases"))


def effective_access(requests: DataFrame, grants: DataFrame, keys: tuple[str, ...] = ("operator_id", "object_type", "object_id")) -> DataFrame:
    """requests with bases, all that still hold, and allowed. One basis less leaves the others."""
    joined = requests.join(grant_bases(grants, list(keys)), list(keys), "left")
    return joined.withColumn("bases", F.coalesce("bases", F.array().cast("array<string>"))).withColumn("allowed", F.size("bases") > 0)


def owner_transition(transfers: DataFrame, objects: DataFrame, grants: DataFrame, basis: str = "project-owner") -> DataFrame:
    """(operator_id, object_id, action) for accepted transfers (project_id, from_operator_id, to_operator_id): open grants
    of the basis that the old owner has are revoked; the new owner gets those not open yet."""
    held = grants.filter(F.col("revoked_sequence").isNull() & (F.col("authority_basis") == basis)).select("operator_id", "object_id").distinct()
    moved = transfers.join(objects.select("project_id", "object_id").distinct(), "project_id")
    closes = moved.select(F.col("from_operator_id").alias("operator_id"), "object_id").distinct().join(held, ["operator_id", "object_id"], "left_semi").withColumn("action", F.lit("revoke"))
    opens = moved.select(F.col("to_operator_id").alias("operator_id"), "object_id").distinct().join(held, ["operator_id", "object_id"], "left_anti").withColumn("action", F.lit("grant"))
    return closes.unionByName(opens)


def transition_counts(changes: DataFrame) -> DataFrame:
    """(operator_id, granted, revoked)."""
    count = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0)).alias(f"{a}ed" if a == "grant" else f"{a}d")
    return changes.groupBy("operator_id").agg(count("grant"), count("revoke"))


def submission_status(submissions: DataFrame, owners: DataFrame) -> DataFrame:
    """submissions (scope_id, submitted_by) with status: approved at once for the owner, else pending."""
    joined = submissions.join(owners.select("scope_id", "owner_id"), "scope_id", "left")
    return joined.withColumn("status", F.when(F.col("submitted_by") == F.col("owner_id"), "approved").otherwise("pending")).drop("owner_id")


def latest_confidential(notes: DataFrame, revisions: DataFrame, authority: DataFrame) -> DataFrame:
    """Notes with the file of their latest revision and their authority; notes without either are left out."""
    last = revisions.select("note_id", F.col("revision").cast("long").alias("latest_revision"), "file_id")
    return notes.withColumn("latest_revision", F.col("latest_revision").cast("long")).join(last, ["note_id", "latest_revision"]).join(authority.select("note_id", "authority_id"), "note_id")


def reencrypt_worklist(notes: DataFrame, revisions: DataFrame, authority: DataFrame, owners: DataFrame) -> DataFrame:
    """(note_id, file_id, recipients, next_revision) of confidential notes at their latest revision: authority and owner, each once, in that order."""
    joined = latest_confidential(notes, revisions, authority).join(owners.select("project_id", "owner_id"), "project_id")
    return joined.select("note_id", "file_id", F.array_distinct(F.array_compact(F.array("authority_id", "owner_id"))).alias("recipients"), (F.col("latest_revision") + 1).alias("next_revision"))


def withheld_payloads(notes: DataFrame, revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the revisions of notes that are not to be disclosed."""
    held = notes.filter("package_disclosure = 'withheld'").select("note_id")
    return revisions.join(held, "note_id", "left_semi").select("note_id", "revision", "file_id").join(files, "file_id")


def latest_open(grants: DataFrame, keys: list[str], seq: str = "granted_sequence") -> DataFrame:
    """The latest open grant of each key."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return grants.filter("revoked_sequence is null").withColumn("_n", row).filter("_n = 1").drop("_n")
