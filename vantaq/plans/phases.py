"""The scan as a plan of phases: profiles, resuming, snapshots, and the lazy chain of the data phases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import findings as ops
from ..operators import history, planning
from ..tables import settled

#: All phases in the order in which they run, and those that only the full profile has.
PHASES = (
    "indexing", "semgrep", "cpg_slice", "llm_static_analysis", "cwe_routing", "rule_synthesis", "llm_discovery", "llm_verification", "validate", "security_agent_verification", "ticket_cross_ref",
    "git_analysis", "cross_file_analysis", "confidence_scoring", "ai_aggregation", "threat_modeling", "root_cause_dedup", "auto_patching", "cve_bootstrap", "poc_compiler", "exploit_synth", "variant_search", "reporting",
)
EXPERIMENTAL = ("cpg_slice", "rule_synthesis", "validate", "security_agent_verification", "threat_modeling", "auto_patching", "poc_compiler", "exploit_synth", "variant_search")


def effective(profile: str) -> list[str]:
    if profile not in ("core", "all"):
        raise ValueError(f"unknown profile: {profile}")
    return [p for p in PHASES if profile == "all" or p not in EXPERIMENTAL]


def resume_from(done: str) -> str:
    """The phase after a completed one; anything else starts over."""
    if done not in PHASES:
        return PHASES[0]
    at = PHASES.index(done) + 1
    return PHASES[at] if at < len(PHASES) else "complete"


@dataclass
class Inputs:
    """What a scan reads. detectors: named tables of findings; cves, files and prior may be left out."""

    detectors: dict[str, DataFrame]
    cves: DataFrame | None = None
    files: DataFrame | None = None


@dataclass
class Outputs:
    findings: DataFrame
    health: dict[str, str] = field(default_factory=dict)


def merged(detectors: dict[str, DataFrame]) -> DataFrame:
    """The bag union of the detectors' rows, columns that one lacks left null."""
    out = None
    for df in detectors.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("a scan needs a detector")
    return out


def isolated(detectors: dict[str, DataFrame], health: dict[str, str]) -> dict[str, DataFrame]:
    """The detectors whose rows could be computed, each written once; of the others ``health`` tells the first line of why. A scan goes on with those that worked."""
    out = {}
    for name, df in detectors.items():
        try:
            out[name] = settled(df, "detector")
        except Exception as e:  # whatever a detector does wrong is its own; it is told, and the scan's other branches count
            health[f"detector:{name}"] = f"failed: {str(e).splitlines()[0][:200] if str(e) else type(e).__name__}"
    return out


def _score(df: DataFrame) -> DataFrame:
    names = ("confidence_score", "verification_status", "sources", "code_snippet", "cwe_id", "severity", "file_path", "verification_notes", "title", "description")
    cross = F.col("related_finding_ids").isNotNull() if "related_finding_ids" in df.columns else F.lit(False)
    score, _ = scoring.refinement({c: F.col(c) for c in names} | {"cross_file": cross})
    return df.withColumn("confidence_score", score)


RELATED = 20


def _cross(d: DataFrame) -> DataFrame:
    """Cross references without pairs: the number of partners of each finding, and up to RELATED of those with its weakness in other files, which
    are of the first of each file."""
    counts = ops.cross_file_counts(d).filter("n > 0").withColumnRenamed("n", "n_related")
    firsts = d.filter("cwe_id IS NOT NULL").groupBy("cwe_id", "file_path").agg(F.min(F.struct("ord", "id")).alias("f"))
    some = ops.top_k(firsts.select("cwe_id", "file_path", "f.ord", "f.id"), ["cwe_id"], RELATED + 1, "ord").groupBy("cwe_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "file_path"))).alias("_some"))
    others = F.slice(F.transform(F.filter("_some", lambda x: x["file_path"] != F.col("file_path")), lambda x: x["id"]), 1, RELATED)
    out = d.join(counts, "ord", "left").join(some, "cwe_id", "left")
    return out.withColumn("related_finding_ids", F.when(F.col("n_related") > 0, F.coalesce(others, F.array().cast("array<string>")))).drop("_some")


def _snapshots(spark: SparkSession, root: str) -> dict[str, str]:
    """Phases that have a whole snapshot, and where."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return {}
    names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
    return {n.split("-", 1)[1]: f"{root}/{n}" for n in names if n.startswith("phase=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))}


def scan(spark: SparkSession, inputs: Inputs, profile: str = "core", skip: tuple[str, ...] = (), snapshot: str | None = None, resume: bool = False, stop_at: int | None = None) -> Outputs:
    """One lazy chain of the data phases that the profile has. With ``snapshot`` the findings are written after each
    phase and read again, which cuts the lineage; ``resume`` starts from the last whole snapshot there (a broken one is taken for none).
    With ``stop_at`` a scan whose medium and worse findings exceed that number after detection goes to the report at once."""
    health: dict[str, str] = {}
    steps: dict[str, Callable[[DataFrame], DataFrame]] = {
        "cross_file_analysis": lambda d: ops.with_chain_partners(_cross(d), ops.chains(d)),
        "confidence_scoring": _score,
        "root_cause_dedup": lambda d: d.withColumn("root_id", ops.ids.root_cause(F.col("title"), F.col("file_path"), F.col("code_snippet"))),
        "cve_bootstrap": lambda d: history.with_cve_counts(d, inputs.cves) if inputs.cves is not None else d,
        "reporting": lambda d: ops.with_citation_verdict(ops.citations(d, inputs.files)) if inputs.files is not None else d,
    }
    phases = effective(profile)
    done = _snapshots(spark, snapshot) if snapshot and resume else {}
    last = max((phases.index(p) for p in done if p in phases), default=-1)
    if last >= 0:
        df = spark.read.parquet(done[phases[last]])
    else:
        df = settled(ops.structural_dedup(merged(isolated(inputs.detectors, health))).drop("island_size"), "detected")
    early = stop_at is not None and planning.medium_or_worse(df, stop_at).first()["terminate"]
    for k, phase in enumerate(phases):
        if k <= last:
            health[phase] = "resumed"
        elif phase in skip:
            health[phase] = "skipped"
        elif early and phase in steps and phase != "reporting":
            health[phase] = "terminated"
        elif phase in steps:
            df = steps[phase](df)
            if snapshot:
                path = f"{snapshot}/phase={k:02d}-{phase}"
                df.write.mode("overwrite").parquet(path)
                df = spark.read.schema(df.schema).parquet(path)
            health[phase] = "planned"
        else:
            health[phase] = "external"
    return Outputs(df, health)


def dry_run(files: DataFrame, findings: int, batch: int = 8) -> DataFrame:
    """What a scan of these files would cost, with triage and without."""
    t = planning.file_totals(files).agg(F.sum("files").alias("files"), F.sum("tokens").alias("tokens"), F.sum("high_risk").alias("high_risk"))
    return t.select("files", "tokens", "high_risk", *[planning.planned_calls(F.col("files"), F.col("high_risk"), F.lit(findings), batch, triage).alias(name) for triage, name in ((True, "calls_with_triage"), (False, "calls"))])
