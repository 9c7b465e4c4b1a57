"""Class members: one ordered decision, as a CASE cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runtime hazards, the first that holds retains.
HAZARDS = ("unknown_bracket_access", "reflected_or_enumerated", "serialized", "object_spread", "proxied", "passed_to_unknown_code")
HAZARD_REASONS = ("unknown_bracket_access", "reflection_or_enumeration", "serialization", "object_spread", "proxy", "unknown_external_call")


def _first(*cases: tuple[Column, str]) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def decided(members: DataFrame, mode: str = "balanced") -> DataFrame:
    """``members`` with outcome (finding, retained, deferred), reason, and evidence of findings, comma-joined."""
    c = F.col
    always = _first(
        (c("directly_referenced"), "direct_reference"),
        (c("framework_root"), "framework_contract"),
        (c("implements_external_contract"), "external_interface_contract"),
        (c("overrides_live_base_member"), "live_base_contract"),
        (c("has_live_override"), "live_override"),
        (c("decorated"), "decorator_contract"),
        (c("emitted_decorator_metadata"), "emitted_decorator_metadata"),
    )
    hazard = _first(*[(c(h), r) for h, r in zip(HAZARDS, HAZARD_REASONS, strict=True)])
    js_private, ts_private = c("visibility") == "javascript_private", c("visibility") == "typescript_private"
    exposed = c("open_world") & c("class_exported")
    receiver_open = ~c("is_static") & ~c("receiver_targets_complete")
    override_open = c("participates_in_inheritance") & ~c("relationships_complete")
    visible = F.coalesce(F.when(exposed, "open_world_public_surface").when(c("class_escaped"), "escaped_public_surface"), hazard)
    private = F.coalesce(F.when(exposed | c("class_escaped"), "escaped_typescript_private_surface"), hazard)
    deep = c("deep") == "resolved"
    deep_live = F.when(F.lit(mode == "deep") & deep & receiver_open & c("receiver_may_reference"), "deep_receiver_reference").when(F.lit(mode == "deep") & deep & override_open & c("live_override_contract"), "deep_live_override_contract")
    kept = F.coalesce(always, F.when(js_private, None).when(F.lit(mode == "fast"), None).when(ts_private, private).otherwise(F.coalesce(visible, deep_live)))
    if mode == "fast":
        put_off = F.when(~js_private, "mode_does_not_analyze_visibility")
    elif mode == "deep":
        put_off = F.when(~js_private & ~ts_private & (receiver_open | override_open), F.when(c("deep") == "not_requested", "deep_evidence_missing").when(c("deep") == "unavailable", "deep_worker_unavailable"))
    else:
        put_off = F.when(~js_private & ~ts_private, F.when(receiver_open, "receiver_targets_ambiguous").when(override_open, "override_relationships_incomplete"))
    outcome = F.when(kept.isNotNull(), "retained").when(put_off.isNotNull(), "deferred").otherwise("finding")
    none = F.lit(None).cast("string")
    evidence = F.when(js_private, F.array(F.lit("no_semantic_reference"), F.lit("javascript_private_is_lexically_scoped"))).when(ts_private, F.array(F.lit("no_semantic_reference"), F.lit("typescript_private_surface_does_not_escape"), F.lit("class_does_not_escape"))).otherwise(
        F.array_compact(
            F.array(
                F.lit("no_semantic_reference"),
                F.lit("closed_world_class"),
                F.lit("class_does_not_escape"),
                F.when(~receiver_open, F.when(c("is_static"), "static_receiver_is_explicit").otherwise("receiver_targets_complete")).otherwise(none),
                F.when(c("participates_in_inheritance") & ~override_open, "override_relationships_complete").otherwise(none),
                F.when(receiver_open, "deep_receiver_excludes_member").otherwise(none),
                F.when(override_open, "deep_override_relationships_complete").otherwise(none),
            )
        )
    )
    out = members.withColumn("outcome", outcome).withColumn("reason", F.coalesce(kept, put_off))
    return out.withColumn("evidence", F.when(c("outcome") == "finding", F.array_join(evidence, ",")).otherwise(""))
