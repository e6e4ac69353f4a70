"""Queries are worth something only where what they are about occurs: these columns must vary on the driver's tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gaugeworks.plans import registry

FOLDER = "/root/testdata/sf0.01"
VARIES = {
    "appeal_state_machine": ["state"],
    "applicant_keys": ["key"],
    "bitmask_or": ["mask", "taxed", "plenty"],
    "canonical_names": ["variants", "display"],
    "case_states": ["state"],
    "dense_month_axis": ["n"],
    "document_freshness": ["way"],
    "enriched_panel": ["declared", "rain_event", "rain_before_14", "snow_depth_before", "snow_melt"],
    "event_overlay": ["level"],
    "first_detail": ["first_event"],
    "gated_writes": ["written", "broken"],
    "grounded_columns": ["grounded"],
    "hazard_families": ["family", "state"],
    "instant_else_daily": ["kind"],
    "left_out_lines": ["fold", "error"],
    "lifecycle_ratios": ["still_counting"],
    "lineage_problems": ["rule"],
    "listing_then_detail": ["lid", "rank", "tried"],
    "nearest_intervals": ["analogs", "low", "high"],
    "planned_change": ["leaving", "arriving"],
    "pooled_histogram": ["bin", "rate"],
    "pooled_state_effects": ["effect"],
    "recursive_cone": ["worst"],
    "request_inventory": ["status", "period", "decision"],
    "resolved_entities": ["kind", "name", "state", "region"],
    "row_conservation": ["conserved", "complete"],
    "rule_violations": ["broken", "net"],
    "scope_lenses": ["holds"],
    "script_matrices": ["days", "last_depth"],
    "seed_constants": ["basis"],
    "stamped_versions": ["stamped"],
    "streamed_alerts": ["share"],
    "streamed_sightings": ["day"],
    "trailing_feed": ["n", "week"],
    "state_panel_rows": ["counties", "declared"],
    "threshold_panel": ["indicator", "large_project"],
    "two_part_costs": ["effect", "expected", "tweedie"],
    "zone_program_and_class": ["zone", "program", "class"],
}


@pytest.mark.parametrize("name", sorted(VARIES))
def test_what_it_is_about_occurs(spark, name):
    rows = registry.queries()[name](spark, FOLDER)
    kinds = rows.agg(*(F.count_distinct(c).alias(c) for c in VARIES[name]), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in VARIES[name])).first()
    assert not [c for c in VARIES[name] if kinds[c] + (kinds[f"null_{c}"] > 0) < 2]


def test_each_way_of_a_rule_occurs(spark):
    """All branches of the rules that have named ones."""
    ways = {
        "document_freshness": ("way", {"key", "as of", "section", "newest", None}),
        "lineage_problems": ("rule", {"orphan file", "missing file", "no producer", "missing script", "unknown write", "unknown read", "write not in script", "read not in script", "column not in dictionary", "missing dictionary"}),
        "appeal_state_machine": ("state", {"settled", "stale", "pending"}),
        "seed_constants": ("basis", {"observed", "seed", "default"}),
        "instant_else_daily": ("kind", {"instant", "daily", None}),
    }
    for name, (column, every) in ways.items():
        assert {r[0] for r in registry.queries()[name](spark, FOLDER).select(column).distinct().collect()} == every, name
