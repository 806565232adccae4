"""Dimension values and thresholds. Everything here is data, passed to operators as parameters."""

from __future__ import annotations

# Product-family rules, tried in this order on lower-cased text.
FAMILY_RULES_FRONTIER = [
    ("h100", "H100"),
    ("h200", "H200"),
    ("b200", "B200"),
    ("a100", "A100"),
]
FAMILY_RULES_ORDER_BOOK = [
    ("rtx 5090", "RTX 5090"),
    ("rtx 4090", "RTX 4090"),
    ("mi300x", "MI300X"),
    ("gh200", "GH200"),
    ("b300", "B300"),
    ("b200", "B200"),
    ("h200", "H200"),
    ("h100", "H100"),
    ("a100", "A100"),
    ("l40s", "L40S"),
]
FAMILY_RULES_PROVIDER = [
    ("rtx 5090", "RTX 5090"),
    ("rtx 4090", "RTX 4090"),
    ("pro 6000", "RTX PRO 6000"),
    ("mi300x", "MI300X"),
    ("mi325", "MI325X"),
    ("gh200", "GH200"),
    ("b300", "B300"),
    ("b200", "B200"),
    ("h200", "H200"),
    ("h100", "H100"),
    ("a100", "A100"),
    ("l40s", "L40S"),
]
# Families that may enter pooled prices, and the uninterrupted rental kinds.
FRONTIER = ["H100", "H200", "B200"]
RENTAL_KINDS = ["on-demand", "secure", "community"]

# Venue grade by provider name; anything else is "neocloud".
VENUE_GRADES = {
    "aws": "hyperscaler",
    "microsoft azure": "hyperscaler",
    "azure": "hyperscaler",
    "google cloud": "hyperscaler",
    "oracle": "hyperscaler",
    "ovhcloud": "hyperscaler",
    "vastai": "marketplace",
    "runpod": "marketplace",
    "modal": "marketplace",
    "fal": "marketplace",
    "replicate": "marketplace",
    "together ai": "marketplace",
    "saladcloud": "marketplace",
    "salad": "marketplace",
    "tensordock": "marketplace",
    "prime intellect": "marketplace",
    "koyeb": "marketplace",
    "cerebrium": "marketplace",
    "baseten": "marketplace",
    "spheron": "marketplace",
    "fireworks ai": "marketplace",
}
DEFAULT_VENUE_GRADE = "neocloud"

# Price tiers for volume shares, in display order.
PRICE_TIERS = ["free", "under_1", "1_to_5", "over_5", "unmatched"]

# Fiscal quarter -> (calendar quarter, year shift) by company.
FISCAL_TO_CALENDAR = {
    "Meta": {1: ("Q1", 0), 2: ("Q2", 0), 3: ("Q3", 0), 4: ("Q4", 0)},
    "Alphabet": {1: ("Q1", 0), 2: ("Q2", 0), 3: ("Q3", 0), 4: ("Q4", 0)},
    "Amazon": {1: ("Q1", 0), 2: ("Q2", 0), 3: ("Q3", 0), 4: ("Q4", 0)},
    "Microsoft": {1: ("Q3", -1), 2: ("Q4", -1), 3: ("Q1", 0), 4: ("Q2", 0)},
    "Oracle": {1: ("Q3", 0), 2: ("Q4", 0), 3: ("Q1", 0), 4: ("Q2", 0)},
}

# The filing universe (ticker, company, filer id, capital-spending tag).
COMPANIES = [
    ("MSFT", "Microsoft", "0000789019", "PaymentsToAcquirePropertyPlantAndEquipment"),
    ("AMZN", "Amazon", "0001018724", "PaymentsToAcquireProductiveAssets"),
    ("GOOGL", "Alphabet", "0001652044", "PaymentsToAcquirePropertyPlantAndEquipment"),
    ("META", "Meta", "0001326801", "PaymentsToAcquirePropertyPlantAndEquipment"),
    ("ORCL", "Oracle", "0001341439", "PaymentsToAcquirePropertyPlantAndEquipment"),
]
TICKER_TO_COMPANY = {ticker: name for ticker, name, _, _ in COMPANIES}

# Marker of a cumulative (multi-quarter) fiscal label and its full suffix.
CUMULATIVE_MARK = "累计"
CUMULATIVE_SUFFIX = " 累计（约%d个月）"

# Metric name -> display signal for commitment events.
SIGNAL_LABELS = {
    "remaining_performance_obligations": "RPO",
    "cloud_backlog": "Cloud backlog",
    "ttm_capex_increase_reflects_ai_investment": "TTM CAPEX increase linked to AI",
    "fy2026_capex_guidance_previous_low": "Prior FY2026 CAPEX guidance low",
    "fy2026_capex_guidance_previous_high": "Prior FY2026 CAPEX guidance high",
    "fy2026_capex_guidance_low": "Current FY2026 CAPEX guidance low",
    "fy2026_capex_guidance_high": "Current FY2026 CAPEX guidance high",
    "capex_short_lived_assets_comment": "Short-lived asset CAPEX comment",
    "customer_demand_exceeds_supply": "Demand exceeds supply comment",
    "capex_quarterly": "Quarterly CAPEX actual",
    "ai_cloud_capex_ttm": "AI/cloud CAPEX TTM",
    "rd_spending": "R&D context (not CAPEX)",
    "cloud_revenue_including_other_segments": "Cloud revenue context (not CAPEX)",
}

# Ordered evidence states.
STATES = ["Unobservable", "Observing", "Trend", "Inflection Watch", "Confirmed"]

# Provenance enumerations.
SOURCE_TYPES = [
    "official",
    "public_pricing_page",
    "aggregator",
    "manual_verified",
    "licensed_unavailable",
]
COLLECTION_METHODS = [
    "sec_companyfacts_api",
    "html_parse",
    "embedded_json_parse",
    "manual_sourcebacked_yaml",
    "unavailable_marker",
]
REJECTED_SOURCE_TYPES = ["seed", "mock"]

# Business keys of the production fact tables.
UPSERT_KEYS = {
    "gpu_prices": [
        "date", "provider", "gpu_model", "gpu_variant", "billing_type",
        "commitment", "gpu_count", "region", "source_url",
    ],
    "capex_actuals": [
        "ticker", "period_start", "period_end", "fiscal_period", "xbrl_tag", "accession_no",
    ],
    "official_events": ["ticker", "announcement_date", "event_type", "metric", "source_url"],
    "public_proxy_prices": ["date", "provider", "proxy_name", "metric", "source_url"],
    "data_quality_events": ["event_id"],
    "pipeline_runs": ["run_id"],
}

# Publish-gate source classes and the statuses each may carry.
EXPECTED_SOURCES = [
    "openrouter_usage",
    "foundry_signals",
    "openrouter_active_prices",
    "sec_capex",
    "gpu_orderbook",
    "reference_indices",
    "neocloud_provider_prices",
    "epoch_supply",
    "fred_cost_anchors",
    "gpu_markets_fixings",
    "throughput_benchmarks",
    "gpufinder_market",
]
INFORMATIONAL_SOURCES = [
    "gpu_orderbook",
    "reference_indices",
    "epoch_supply",
    "fred_cost_anchors",
    "gpu_markets_fixings",
    "throughput_benchmarks",
    "gpufinder_market",
    "foundry_signals",
]
INFORMATIONAL_STATUSES = [
    "fresh",
    "partial",
    "failed",
    "stale_last_good",
    "failed_using_last_good",
    "current_for_frequency",
]
CAPEX_READY_STATUSES = ["fresh", "current_for_frequency"]
STALE_TOLERANT_SOURCES = ["foundry_signals", "neocloud_provider_prices"]
