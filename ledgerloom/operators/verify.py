"""Verifiers: findings where live tables, payloads, manifests or events disagree with history. None found is verified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import enum_rule, has_reason, is_safe_path, valid_box, valid_digest, valid_point
from ..sources.shared import tasks, written
from . import replay as R
from .chain import anchor_check
from .findings import COLUMNS, finding, row_findings
from .matching import active_key, diff, intervals, missing_payloads
from .members import ordinals
from .merkle import tree_diff
from .scopes import resolve_scopes
from .sets import revision_check, union_all
from .sweeps import SLICE, asof_join, valid_at

SEQ = "event_sequence"
WHERE = "event_sequence"


def verify_envelopes(ledger: DataFrame, schema: str = "authority-transaction/v2") -> DataFrame:
    """Signed events whose transaction is not that of their row: schema, position, object, predecessor, actor, key."""
    # Details are parsed once, and all findings of a row come from one pass; a null that is written out counts as absent.
    at = lambda path: F.try_variant_get("_details", f"$.{path}", "string")
    pairs = {"schema": F.lit(schema), "event_sequence": F.col(SEQ).cast("string")} | {c: F.col(c) for c in ("occurred_at", "event_type", "object_type", "object_id", "previous_hash", "actor_id", "actor_uuid")}
    pairs |= {"actor_key_fingerprint": F.col("credential_fingerprint")}
    own = [c for c in ledger.columns if c != "details_json"]
    rows = R.parsed(ledger).select(*own, at("authority_transaction").isNotNull().alias("_t"), at("authority_signature").alias("_s"), at("authority_transaction.data").alias("_d"), *[at(f"authority_transaction.{n}").alias(f"_t_{n}") for n in pairs])
    signed = F.col("_t") | F.col("_s").isNotNull()
    checks = [("envelope", signed & ~e.eqNullSafe(F.col(f"_t_{n}")), n, e, F.col(f"_t_{n}")) for n, e in pairs.items()]
    checks.append(("malformed-envelope", signed & (F.col("_s").isNull() | F.col("_d").isNull() | F.coalesce(F.col("actor_kind") != "operator", F.lit(False))), None, None, None))
    return row_findings(rows, F.col("project_id"), F.col(SEQ), checks)


def verify_signers(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    """Signed events whose key was not valid for their actor at that sequence, and first events that another than the
    owner they name has signed. keys: operator_keys with valid_from_sequence, valid_until_sequence."""
    signed = ledger.filter("actor_kind = 'operator'").select("project_id", SEQ, F.col("actor_id").alias("operator_id"), F.col("credential_fingerprint").alias("signing_fingerprint"))
    ranges = keys.select("project_id", "operator_id", "signing_fingerprint", F.col("valid_from_sequence").cast("long").alias("valid_from"), F.col("valid_until_sequence").cast("long").alias("valid_until"))
    good = valid_at(signed, ranges, ["project_id", "operator_id", "signing_fingerprint"], SEQ, width=SLICE)
    unknown = finding(signed.join(good.select("project_id", SEQ), ["project_id", SEQ], "left_anti"), F.col("project_id"), "unknown-signer", F.col(SEQ), "credential_fingerprint", actual=F.col("signing_fingerprint"))
    first = ledger.filter("event_type = 'PROJECT_GENESIS'").withColumn("_owner", R.signed("identity.operator_id"))
    return unknown.unionByName(finding(first.filter(~F.col("_owner").eqNullSafe(F.col("actor_id"))), F.col("project_id"), "genesis-signer", F.col(SEQ), "actor_id", F.col("_owner"), F.col("actor_id")))


def verify_order(ledger: DataFrame, creates: list[str], changes: list[str], key: str = "object_id") -> DataFrame:
    """Objects created twice, and changes of objects before their creation or without one."""
    made = ledger.filter(F.col("event_type").isin(creates)).groupBy("project_id", key).agg(F.min(SEQ).alias("_at"), F.count("*").alias("_n"))
    twice = finding(made.filter("_n > 1"), F.col("project_id"), "created-twice", F.col(key), actual=F.col("_n"))
    later = ledger.filter(F.col("event_type").isin(changes)).select("project_id", key, SEQ).join(made, ["project_id", key], "left")
    early = finding(later.filter(F.col("_at").isNull() | (F.col(SEQ) < F.col("_at"))), F.col("project_id"), "precedes-creation", F.col(key), SEQ, F.col("_at"), F.col(SEQ))
    return twice.unionByName(early)


# Tables whose rows need more than the events of their own key: how they are rebuilt, and their keys.
REBUILT = {
    "project_memberships": (R.memberships, ["operator_id"]), "ownership": (R.ownership, ["scope_type", "scope_id"]), "artefact_files": (R.artefact_files, ["artefact_id", "file_id"]), "acquisition_files": (R.acquisition_files, ["acquisition_id", "position"]),
    "export_items": (R.export_items, ["export_id", "output_path"]), "confidential_authority": (R.confidential_authority, ["object_type", "object_id"]), "counters": (R.counters, ["namespace"]),
}


def verify_state(ledger: DataFrame, live: dict[str, DataFrame], rebuilt: dict[str, DataFrame] | None = None, by_tree: bool = False) -> DataFrame:
    """Live tables against the tables that their history gives, row by row and column by column. Names are those of
    projections() and REBUILT. rebuilt: tables that history is known to give, as from a checkpoint; the ledger is not read
    for them. by_tree compares trees of digests first, and rows only where these differ."""
    specs, parts, compare = R.projections(), [], tree_diff if by_tree else diff
    for name, table in live.items():
        own = REBUILT[name][1] if name in REBUILT else list(specs[name].key)
        if name in (rebuilt or {}):
            expected = rebuilt[name]
        else:
            expected = REBUILT[name][0](ledger) if name in REBUILT else R.project(ledger, specs[name])
        keys = ["project_id", *own]
        text = lambda df, c: df.withColumns({x: F.col(x).cast("string") for x in c})
        columns = [c for c in expected.columns if c in table.columns and c not in keys]
        parts.append(compare(text(expected, columns), text(table, columns), keys, columns, name))
    return union_all(parts)


def verify_notes(ledger: DataFrame, notes: DataFrame, revisions: DataFrame, files: DataFrame) -> DataFrame:
    """Note identities, revision lineage, pointers, and the files of revisions: known, with the digest of the signed
    event, and of the class that goes with the note's visibility."""
    tables = verify_state(ledger, {"notes": notes, "note_revisions": revisions})
    lineage = revision_check(revisions.withColumn("revision", F.col("revision").cast("long")), notes.withColumn("latest_revision", F.col("latest_revision").cast("long")))
    said = R.project(ledger, R.Projection({"note_id": F.col("object_id"), "revision": R.signed("revision")}, {t: {"payload_digest": R.signed("payload_digest")} for t in ("NOTE_CREATED", "NOTE_REVISED", "NOTE_REENCRYPTED")}))
    rows = revisions.withColumn("revision", F.col("revision").cast("string")).join(said.select("note_id", "revision", "payload_digest"), ["note_id", "revision"], "left")
    rows = rows.join(files.select("file_id", "classification", "content_digest", F.lit(True).alias("_known")), "file_id", "left").join(notes.select("note_id", "visibility"), "note_id", "left")
    kind = F.when(F.col("visibility") == "confidential", "confidential-note-revision").otherwise("note-revision")
    key = F.concat_ws("/", "note_id", "revision")
    held = row_findings(rows, F.lit("note_revisions"), key, [
        ("unknown-file", F.col("_known").isNull(), "file_id", None, F.col("file_id")),
        ("revision-digest", F.col("_known") & ~F.col("content_digest").eqNullSafe(F.col("payload_digest")), "content_digest", F.col("payload_digest"), F.col("content_digest")),
        ("revision-class", F.col("_known") & ~F.col("classification").eqNullSafe(kind), "classification", kind, F.col("classification")),
    ])
    return union_all([tables, lineage, held])


def verify_files(ledger: DataFrame, files: DataFrame, payloads: DataFrame, allowed: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """Catalogued files against history and payloads (storage_path, content_digest, size_bytes, writable); a subset limits what is compared with payloads."""
    state = verify_state(ledger, {"files": files})
    held = files if subset is None else files.join(subset.select("file_id"), "file_id", "left_semi")
    missing = finding(missing_payloads(held.select("file_id", "storage_path"), payloads, allowed), F.lit("files"), "missing-payload", F.col("file_id"), "storage_path", F.col("storage_path"))
    seen = held.join(payloads.select("storage_path", F.col("content_digest").alias("_d"), F.col("size_bytes").alias("_n"), "writable"), "storage_path")
    digest = finding(seen.filter("content_digest <> _d"), F.lit("files"), "payload-digest", F.col("file_id"), "content_digest", F.col("content_digest"), F.col("_d"))
    size = finding(seen.filter("cast(size_bytes as bigint) <> _n"), F.lit("files"), "payload-size", F.col("file_id"), "size_bytes", F.col("size_bytes"), F.col("_n"))
    return union_all([state, missing, digest, size, finding(seen.filter("writable"), F.lit("files"), "writable-payload", F.col("file_id"))])


def verify_acquisitions(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Acquisitions recorded once, with files, each once, in the order in which they were committed.

    Files of an acquisition are never put in one row: they are numbered, and meet the event's list place by place.
    """
    recorded = ledger.filter("event_type = 'ACQUISITION_RECORDED'")
    ids = F.from_json(R.signed("file_ids"), "array<string>")
    rows = recorded.select("project_id", "object_id", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    twice = rows.groupBy("project_id", "object_id").count().filter("count > 1")
    # Named by a number, as an acquisition may be recorded more than once; written, so that all uses see the same numbers.
    rows = written(rows.withColumn("_event", F.monotonically_increasing_id()), "recorded")
    listed = rows.select("_event", "project_id", F.col("object_id").alias("acquisition_id"), F.posexplode("ids").alias("_at", "_said"))
    keys = ["project_id", "acquisition_id"]
    placed = files.filter("acquisition_id is not null").select(*keys, "file_id", F.col("committed_sequence").cast("long").alias("_seq"))
    own = ordinals(placed, keys, ["_seq", "file_id"], "_place").withColumn("_at", (F.col("_place") - 1).cast("int"))
    n = tasks(ledger.sparkSession)
    met = listed.repartition(n, *keys, "_at").join(own.repartition(n, *keys, "_at"), [*keys, "_at"]).filter(F.col("_said").eqNullSafe(F.col("file_id"))).groupBy("_event").agg(F.count("*").alias("_met"))
    held = placed.groupBy(*keys).agg(F.count("*").alias("_own")).withColumnRenamed("acquisition_id", "object_id")
    # Lists stay behind: from here on their sizes are enough.
    sizes = rows.select("_event", "project_id", "object_id", F.size("ids").alias("_n"), F.size(F.array_distinct("ids")).alias("_different"))
    joined = sizes.repartition(n, "_event").join(met, "_event", "left").repartition(n, "project_id", "object_id").join(held, ["project_id", "object_id"], "left")
    rules = {"no-files": "_n = 0", "doubled-file": "_n <> _different", "membership": "_n <> coalesce(_own, 0) or _n <> coalesce(_met, 0)"}
    found = row_findings(joined, F.col("project_id"), F.col("object_id"), [(rule, F.expr(where), None, None, None) for rule, where in rules.items()])
    return finding(twice, F.col("project_id"), "recorded-twice", F.col("object_id"), actual=F.col("count")).unionByName(found)


def verify_policy(config: DataFrame, metadata: DataFrame, ledger: DataFrame) -> DataFrame:
    """(project_id, chain_hash, content_hash) as configured and as kept must be those of the first event."""
    first = ledger.filter("event_type = 'PROJECT_GENESIS'").select("project_id", *[F.get_json_object("details_json", f"$.integrity.{c}").alias(c) for c in ("chain_hash", "content_hash")])
    columns = ["chain_hash", "content_hash"]
    return diff(first, config, ["project_id"], columns, "config").unionByName(diff(first, metadata, ["project_id"], columns, "metadata"))


def verify_exports(manifests: DataFrame, items: DataFrame, event_items: DataFrame, observed: DataFrame, ledger: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Exports: the manifest's items against those of the completion event, bytes against digests, and the anchor; with
    exports also that the export was completed, and the digests of manifest and output that it recorded.

    manifests: project_id, export_id, event_count, chain_head, and manifest_digest and output_digest as observed. items
    and event_items: export_id, file_id, output_path, source_digest, output_digest, mode. observed: export_id,
    output_path, content_digest. exports: export_id, state, manifest_digest, output_digest.
    """
    fields = ["file_id", "source_digest", "output_digest", "mode"]
    membership = diff(event_items, items, ["export_id", "output_path"], fields, "export-items")
    recorded = items.select("export_id", "output_path", F.col("output_digest").alias("content_digest"))
    held = diff(recorded, observed, ["export_id", "output_path"], ["content_digest"], "export-bytes")
    loose = finding(anchor_check(manifests.select("project_id", "export_id", "event_count", "chain_head"), ledger).filter("not anchored"), F.lit("exports"), "unanchored", F.col("export_id"), "chain_head", actual=F.col("chain_head"))
    derived = finding(items.filter("mode = 'derived' and source_digest = output_digest"), F.lit("exports"), "derived-but-equal", F.col("export_id"), "mode", actual=F.col("mode"))
    native = finding(items.filter("mode = 'native' and not (source_digest <=> output_digest)"), F.lit("exports"), "native-but-changed", F.col("export_id"), "mode", actual=F.col("mode"))
    other = finding(items.filter(~enum_rule("export_items.mode", "mode")), F.lit("exports"), "unknown-mode", F.col("export_id"), "mode", actual=F.col("mode"))
    parts = [membership, held, loose, derived, native, other]
    if exports is not None:
        recorded = exports.select("export_id", F.col("state").alias("_state"), F.col("manifest_digest").alias("_m"), F.col("output_digest").alias("_o"))
        n = tasks(manifests.sparkSession)
        seen = manifests.select("export_id", "manifest_digest", "output_digest").repartition(n, "export_id").join(recorded.repartition(n, "export_id"), "export_id", "left")
        done = F.coalesce(F.col("_state") == "completed", F.lit(False))
        parts.append(row_findings(seen, F.lit("exports"), F.col("export_id"), [
            ("incomplete-export", ~done, "state", F.lit("completed"), F.col("_state")),
            ("manifest-digest", done & ~F.col("_m").eqNullSafe(F.col("manifest_digest")), "manifest_digest", F.col("_m"), F.col("manifest_digest")),
            ("output-digest", done & ~F.col("_o").eqNullSafe(F.col("output_digest")), "output_digest", F.col("_o"), F.col("output_digest")),
        ]))
    return union_all(parts)


def verify_authority_flag(metadata: DataFrame, ledger: DataFrame) -> DataFrame:
    """Projects (project_id, authority_state) whose flag does not agree with whether they have signed events: `active` needs one, all else none."""
    signed = ledger.filter(F.get_json_object("details_json", "$.authority_transaction").isNotNull()).groupBy("project_id").agg(F.count("*").alias("_n"))
    rows = metadata.join(signed, "project_id", "left").withColumns({"_active": F.coalesce(F.col("authority_state") == "active", F.lit(False)), "_n": F.coalesce("_n", F.lit(0))})
    return finding(rows.filter(F.col("_active") != (F.col("_n") > 0)), F.col("project_id"), "authority-flag", F.col("project_id"), "authority_state", F.when(F.col("_n") > 0, "active").otherwise("absent"), F.col("authority_state"))


def verify_object(targets: DataFrame, ledger: DataFrame, live: dict[str, DataFrame], payloads: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scope_type, scope_id, n_files, n_findings, status) for targets (scope_type, scope_id), and the findings about
    their files, each once: history, payloads, digests, sizes. Only payloads of files in a scope are compared.

    live: the tables that resolve_scopes needs, with files as catalogued. Of history and catalogue only what is about the
    scopes' files is replayed and compared.
    """
    found, none = resolve_scopes(targets, live)
    found = written(found, "scope-files")
    subset = written(found.select("file_id").distinct(), "subset")
    own = subset.select(F.col("file_id").alias("object_id"))
    events = ledger.filter(F.col("event_type").isin(*R.projections()["files"].sets)).join(own, "object_id", "left_semi")
    files = live["files"].join(subset, "file_id", "left_semi")
    # A finding names a file by its id, or by its project and id.
    names = files.select("file_id", F.explode(F.array("file_id", F.concat_ws("/", "project_id", "file_id"))).alias("key")).distinct()
    about = written(verify_files(events, files, payloads, allowed, subset).join(names, "key"), "findings")
    counted = found.join(about.groupBy("file_id").agg(F.count("*").alias("_n")), "file_id", "left").groupBy("scope_type", "scope_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_findings"))
    rows = counted.withColumn("status", F.when(F.col("n_findings") == 0, "verified").otherwise("failed"))
    return rows, about.select(COLUMNS).unionByName(none)


def verify_external(probe: DataFrame, files: DataFrame, payloads: DataFrame, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(probe_id, n_matches, n_broken, status) for files from outside (probe_id, content_digest, size_bytes), and the
    files that match: (content_digest, size_bytes, file_id, artefact_ids, intact), once for each content.

    A match is intact if its own payload still has the catalogued digest and size. status is unmatched, verified or
    failed. Matches are counted by content before they meet the probes, so equal files do not multiply.
    """
    asked = probe.select("content_digest", "size_bytes").distinct()
    rows = files.select("file_id", "storage_path", "content_digest", "size_bytes").join(asked, ["content_digest", "size_bytes"], "left_semi")
    rows = rows.join(payloads.select("storage_path", F.col("content_digest").alias("_d"), F.col("size_bytes").alias("_n")), "storage_path", "left")
    rows = rows.withColumn("intact", F.coalesce((F.col("_d") == F.col("content_digest")) & (F.col("_n") == F.col("size_bytes")), F.lit(False)))
    if members is not None:
        rows = rows.join(members.groupBy("file_id").agg(F.sort_array(F.collect_set("artefact_id")).alias("artefact_ids")), "file_id", "left")
    else:
        rows = rows.withColumn("artefact_ids", F.lit(None).cast("array<string>"))
    held = rows.groupBy("content_digest", "size_bytes").agg(F.count("*").alias("n_matches"), F.sum((~F.col("intact")).cast("long")).alias("n_broken"))
    joined = probe.select("probe_id", "content_digest", "size_bytes").join(held, ["content_digest", "size_bytes"], "left")
    status = F.when(F.col("n_matches").isNull(), "unmatched").when(F.col("n_broken") == 0, "verified").otherwise("failed")
    return joined.select("probe_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_broken", F.lit(0)).alias("n_broken"), status.alias("status")), rows.select("content_digest", "size_bytes", "file_id", "artefact_ids", "intact")


def verify_package(manifest: DataFrame, observed: DataFrame) -> DataFrame:
    """Unsafe paths, and members that are missing, extra or changed. Both: path, content_digest.

    observed may have kind, what each member of the archive is: then links and members that are neither files nor
    directories are findings, unsafe paths of any member too, and files alone are compared.
    """
    unsafe = finding(manifest.filter(~is_safe_path("path")), F.lit("package"), "unsafe-path", F.col("path"))
    if "kind" not in observed.columns:
        return unsafe.unionByName(diff(manifest, observed, ["path"], ["content_digest"], "package"))
    is_file, link = F.coalesce(F.col("kind") == "file", F.lit(False)), F.coalesce(F.col("kind").isin("symlink", "hardlink"), F.lit(False))
    members = row_findings(observed, F.lit("package"), F.col("path"), [
        ("unsafe-member", ~is_safe_path("path"), None, None, None), ("unexpected-link", link, "kind", None, F.col("kind")),
        ("special-member", ~is_file & ~link & ~F.coalesce(F.col("kind") == "directory", F.lit(False)), "kind", None, F.col("kind")),
    ])
    return union_all([unsafe, members, diff(manifest, observed.filter(is_file), ["path"], ["content_digest"], "package")])


def verify_snapshot(a: dict[str, DataFrame], b: dict[str, DataFrame], keys: dict[str, list[str]], by_tree: bool = False) -> DataFrame:
    """Findings for rows that differ between two states of tables, with by_tree by way of their trees of digests."""
    return union_all([(tree_diff if by_tree else diff)(a[n], b[n], keys[n], [c for c in a[n].columns if c not in keys[n]], n) for n in a])


def verify_policy_history(ledger: DataFrame) -> DataFrame:
    """Policy changes whose `previous` is not the policy before them."""
    fields = ("ordinary_export", "ciphertext_export", "confidential_plaintext_export", "broad_scope_export")
    shape = ", ".join(f"{f} string" for f in fields)
    rows = ledger.filter("event_type in ('PROJECT_GENESIS', 'EXPORT_POLICY_CHANGED')").select(
        "project_id", SEQ, "event_type", F.from_json(F.coalesce(R.signed("policy"), R.signed("export_policy")), shape).alias("now"), F.from_json(R.signed("previous"), shape).alias("said")
    )
    # Where a change has the number of the first event, that event comes before it.
    held = rows.withColumn("held", F.lag("now").over(Window.partitionBy("project_id").orderBy(SEQ, F.col("event_type") != "PROJECT_GENESIS")))
    bad = held.filter("event_type = 'EXPORT_POLICY_CHANGED' and not (held <=> said)")
    return finding(bad, F.col("project_id"), "policy-history", F.col(SEQ), "previous", F.to_json("held"), F.to_json("said"))


def verify_transfer_source(ledger: DataFrame) -> DataFrame:
    """Accepted confidential transfers of objects that the stated source did not control just before, or that are unknown."""
    scope = F.from_json(R.signed("scope"), "array<struct<object_type:string,object_id:string>>")
    proposed = ledger.filter("event_type = 'CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED'").select("project_id", F.col("object_id").alias("t"), R.signed("from_operator_id").alias("source"), R.signed("to_operator_id").alias("authority_id"))
    moves = ledger.filter("event_type = 'CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED'").select("project_id", F.col("object_id").alias("t"), F.col(SEQ).alias("seq"), F.explode(scope).alias("s")).join(proposed, ["project_id", "t"])
    moves = moves.select("project_id", F.col("s.object_id").alias("object"), "seq", "source", "authority_id")
    made = ledger.filter("event_type = 'NOTE_CREATED'").filter(R.signed("visibility") == "confidential").select("project_id", F.col("object_id").alias("object"), F.col(SEQ).alias("seq"), F.coalesce(R.signed("authority_id"), R.signed("author_id")).alias("authority_id"))
    history = made.unionByName(moves.select("project_id", "object", "seq", "authority_id")).withColumnRenamed("authority_id", "held")
    asked = moves.select("project_id", "object", "seq", "source").withColumn("before", F.col("seq") - 1)
    found = asof_join(asked, history.withColumnRenamed("seq", "at"), ["project_id", "object"], "before", "at", ["held"], width=SLICE)
    return finding(found.filter(~F.col("held").eqNullSafe(F.col("source"))), F.col("project_id"), "transfer-source", F.col("object"), "authority_id", F.col("held"), F.col("source"))


def verify_identity(requests: DataFrame, operators: DataFrame, keys: DataFrame | None = None, columns: tuple[str, ...] = ("name", "public_contact", "organisation", "role_label", "primary_fingerprint", "signing_fingerprint")) -> DataFrame:
    """Identities in requests that differ from those kept, and those that are not kept. keys: operator_keys, whose active one gives the fingerprints."""
    if keys is not None:
        operators = operators.join(active_key(keys).select("operator_id", "primary_fingerprint", "signing_fingerprint"), "operator_id", "left")
    held = operators.join(requests.select("operator_id").distinct(), "operator_id", "left_semi")
    return diff(requests.dropDuplicates(["operator_id"]), held, ["operator_id"], list(columns), "identity")


def verify_reviews(layers: DataFrame) -> DataFrame:
    """Review rows (original_sha256, original_width, original_height, layer, id, kind, reason, geometry) with bad digests, sizes
    or geometry, annotations of no known kind, and redactions without a reason. Geometry is a map of numbers, a box where
    it has a width and a point otherwise."""
    g = lambda k: F.col("geometry").getItem(k)
    fits = F.when(F.map_contains_key("geometry", F.lit("width")), valid_box(g("x"), g("y"), g("width"), g("height"))).otherwise(valid_point(g("x"), g("y")))
    rules = {"digest": valid_digest("original_sha256"), "dimensions": F.coalesce((F.col("original_width") > 0) & (F.col("original_height") > 0), F.lit(False)), "geometry": F.coalesce(fits, F.lit(False)), "kind": (F.col("layer") != "annotation") | enum_rule("annotations.kind", "kind"), "reason": (F.col("layer") != "redaction") | has_reason("reason")}
    return union_all([finding(layers.filter(~ok), F.col("original_sha256"), f"review-{name}", F.col("id")) for name, ok in rules.items()])


def key_ranges(keys: DataFrame) -> DataFrame:
    """Operator keys as ranges: each is valid until the operator's next."""
    return intervals(keys, ["project_id", "operator_id"], "valid_from_sequence")
