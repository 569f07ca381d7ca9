"""The whole write path as one plan: gate, evaluation, technologies, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteprism.config import Config
from siteprism.operators import technologies, tiers
from siteprism.operators.evaluate import evaluate
from siteprism.operators.gate import gate
from siteprism.sources.packs import Blocklist, Pack


def merged(*structs: tuple[str, tuple[str, ...]]) -> Column:
    """One struct of several (column, its fields); of fields with one name the last one's stands."""
    owner = {f: c for c, fields in structs for f in fields}
    return F.struct(*[F.col(c)[f].alias(f) for f, c in owner.items()])


def process(leads: DataFrame, config: Config, pack: Pack | None = None, block: Blocklist | None = None) -> DataFrame:
    """Leads (wire shape) with gate, evaluation and final pipeline_status; none is dropped.

    With signals on and a ``pack``, what passed the gate is matched: ``technologies`` holds its resolved detections
    and ``matcher_failures`` how many patterns ran out of time (null elsewhere). All of it happens within a lead's row. ``heuristic_flags`` are the gate's and the evaluation's flags together.

    What the gate rejects keeps its gate status, score 0 and no gaps. With the LLM on, tier eligibility decides
    the status; the tiers themselves are called later, on the rows that it marks.
    """
    rows = evaluate(gate(leads, config), config)
    fields = lambda c: tuple(rows.schema[c].dataType.names)
    rows = rows.withColumn("heuristic_flags", merged(("gate_flags", fields("gate_flags")), ("evaluation_flags", fields("evaluation_flags"))))
    if config.signals_v2 and pack is not None:
        rows = technologies.with_technologies(rows, pack, block, F.col("gate_status") == "pending_tier_1")
    passed = F.col("gate_status") == "pending_tier_1"
    none = F.expr("cast(array() as array<string>)")
    skip2 = tiers.tier2_skip_reason(F.lit(config.campaign), F.col("target_industry"), config)
    status = tiers.final_status(F.col("pipeline_status"), F.lit(config.llm_enabled), F.lit("tier1_skipped"), F.lit("pass"), skip2)
    reason = F.when(F.col("gate_status") == "rejected_compliance", F.coalesce(F.nullif("crawl_disallowed_reason", F.lit("")), F.lit("crawl_disallowed"))).otherwise(F.col("gate_status"))
    return rows.withColumns(
        {
            "pipeline_status": F.when(passed, status).otherwise(F.col("gate_status")), "score": F.when(passed, F.col("score")).otherwise(0.0), "is_qualified_lead": passed & F.col("is_qualified_lead"),
            "rejection_reason": F.when(passed, F.col("rejection_reason")).otherwise(reason),
            "identified_service_gaps": F.when(passed, F.col("identified_service_gaps")).otherwise(none), "missing_critical_features": F.when(passed, F.col("missing_critical_features")).otherwise(none),
            "tier1_skip_reason": F.when(passed, tiers.tier1_skip_reason(F.col("pipeline_status"), F.lit(None).cast("double"), F.lit(config.campaign), F.col("target_industry"), config)),
            "tier2_skip_reason": F.when(passed, skip2),
        }
    )
