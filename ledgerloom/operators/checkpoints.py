"""State taken on from a checkpoint: replaying a ledger costs what has been added to it.

A checkpoint is a folder of tables: for each projection the last value of every column of every key with the sequence that
set it, for tables that need more than their own key's events either their rows or the few events that they are made
of, and the heads of all projects. Taking on a delta merges these with what the delta's events give; that is the same as
replaying everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import replay as R
from .chain import ledger_summary
from .findings import finding

SEQ = "event_sequence"
BY = ("project_id",)
# Rebuilt tables whose rows come from one event each: the rows of a delta are added to those held.
ADDED = {"artefact_files": R.artefact_files, "acquisition_files": R.acquisition_files, "export_items": R.export_items}
# Rebuilt tables of few events: those are held, of these types.
FACTS = {
    "ownership": (R.ownership, ("PROJECT_GENESIS", "CASE_OWNERSHIP_ASSIGNED", "OWNERSHIP_TRANSFER_PROPOSED", "OWNERSHIP_TRANSFER_ACCEPTED")),
    "project_memberships": (R.memberships, ("PROJECT_GENESIS", "CONTRIBUTOR_INVITED", "CONTRIBUTOR_ACCEPTED", "CONTRIBUTOR_REJECTED", "CONTRIBUTOR_REMOVED", "OWNERSHIP_TRANSFER_PROPOSED", "OWNERSHIP_TRANSFER_ACCEPTED")),
    "confidential_authority": (R.confidential_authority, ("NOTE_CREATED", "CONFIDENTIAL_AUTHORITY_TRANSFER_PROPOSED", "CONFIDENTIAL_AUTHORITY_TRANSFER_ACCEPTED")),
}
EVENT = ["project_id", SEQ, "event_type", "object_type", "object_id", "actor_id", "details_json"]


def partial_state(ledger: DataFrame, p: R.Projection) -> DataFrame:
    """by, key, a struct (s, v) for each column, the last sequence that set it and its value, and _made."""
    rows = R.parsed(ledger.filter(F.col("event_type").isin(*p.sets)))
    last = {}
    for c in p.columns():
        own = [t for t in p.sets if c in p.sets[t]]
        value = F.lit(None).cast("string")
        for t in own:
            value = F.when(F.col("event_type") == t, p.sets[t][c].cast("string")).otherwise(value)
        last[c] = F.when(F.col("event_type").isin(*own), F.struct(F.col(SEQ).alias("s"), value.alias("v")))
    rows = rows.select(*BY, *[e.alias(k) for k, e in p.key.items()], F.col("event_type").isin(*(p.creates or tuple(p.sets))).alias("_made"), *[e.alias(f"_v_{c}") for c, e in last.items()])
    return rows.groupBy(*BY, *p.key).agg(*[F.max_by(f"_v_{c}", f"_v_{c}.s").alias(c) for c in p.columns()], F.max("_made").alias("_made"))


def merged_state(held: DataFrame, new: DataFrame, p: R.Projection) -> DataFrame:
    both = held.unionByName(new)
    return both.groupBy(*BY, *p.key).agg(*[F.max_by(c, f"{c}.s").alias(c) for c in p.columns()], F.max("_made").alias("_made"))


def rows_of_state(state: DataFrame, p: R.Projection) -> DataFrame:
    """The rows of a projection, as replay.project gives them."""
    return state.filter("_made").select(*BY, *p.key, *[F.col(f"{c}.v").alias(c) for c in p.columns()])


def parts(ledger: DataFrame, names: list[str] | None = None) -> dict[str, DataFrame]:
    """What a checkpoint holds of a ledger, by table; names: the tables asked for, else all."""
    wanted = lambda n: names is None or n in names
    out = {n: partial_state(ledger, p) for n, p in R.projections().items() if n not in FACTS and wanted(n)}
    out |= {n: f(ledger) for n, f in ADDED.items() if wanted(n)}
    out |= {n: ledger.filter(F.col("event_type").isin(*types)).select(EVENT) for n, (_, types) in FACTS.items() if wanted(n)}
    if wanted("counters"):
        out["counters"] = R.counters(ledger)
    return out


def take(ledger: DataFrame, path: str, names: list[str] | None = None) -> None:
    """Write a checkpoint of a whole ledger at a path that is new."""
    for name, df in parts(ledger, names).items():
        df.write.parquet(f"{path}/{name}")
    ledger_summary(ledger).write.parquet(f"{path}/heads")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def delta_findings(heads: DataFrame, delta: DataFrame) -> DataFrame:
    """Findings for projects whose delta does not go on from their head: its first event is another than the next, some
    are missing or doubled, or the first names another predecessor."""
    own = delta.groupBy("project_id").agg(F.min(SEQ).alias("_first"), F.max(SEQ).alias("_last"), F.count("*").alias("_n"), F.min_by("previous_hash", SEQ).alias("_before"))
    rows = own.join(heads.select("project_id", "event_count", "chain_head"), "project_id", "left")
    count = F.coalesce("event_count", F.lit(0))
    gap = finding(rows.filter((F.col("_first") != count + 1) | (F.col("_last") - F.col("_first") + 1 != F.col("_n"))), F.col("project_id"), "delta-gap", F.col("_first"), SEQ, (count + 1).cast("string"), F.col("_first").cast("string"))
    moved = rows.filter(F.col("event_count").isNotNull() & ~F.col("chain_head").eqNullSafe(F.col("_before")))
    return gap.unionByName(finding(moved, F.col("project_id"), "delta-head", F.col("_first"), "previous_hash", F.col("chain_head"), F.col("_before")))


def advance(spark: SparkSession, path: str, delta: DataFrame, out: str, names: list[str] | None = None) -> None:
    """Write the checkpoint at path, taken on by a delta of events, at a path that is new. Nothing else of the ledger is
    read. ValueError where the delta does not go on from the heads."""
    heads = read(spark, path, "heads")
    if not delta_findings(heads, delta).isEmpty():
        raise ValueError("the delta does not go on from the checkpoint")
    specs = R.projections()
    for name, new in parts(delta, names).items():
        held = read(spark, path, name)
        if name == "counters":
            both = held.unionByName(new).groupBy("project_id", "namespace").agg(F.max("next_value").alias("next_value"))
        elif name in FACTS or name in ADDED:
            both = held.unionByName(new)
        else:
            both = merged_state(held, new, specs[name])
        both.write.parquet(f"{out}/{name}")
    last = ledger_summary(delta).select("project_id", F.col("event_count").alias("_n"), F.col("chain_head").alias("_h"), F.col("last_event_at").alias("_t"))
    now = heads.join(last, "project_id", "full_outer")
    count = F.coalesce("event_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    now.select("project_id", count.alias("event_count"), F.coalesce("_h", "chain_head").alias("chain_head"), F.coalesce("_t", "last_event_at").alias("last_event_at")).write.parquet(f"{out}/heads")


def tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables that a checkpoint stands for."""
    specs, out = R.projections(), {}
    for name in names or [*[n for n in specs if n not in FACTS], *ADDED, *FACTS, "counters"]:
        held = read(spark, path, name)
        out[name] = held if name in ADDED or name == "counters" else FACTS[name][0](held) if name in FACTS else rows_of_state(held, specs[name])
    return out
