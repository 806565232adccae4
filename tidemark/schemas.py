"""Explicit schemas of landed raw documents; nothing is inferred at read time."""

MARKETPLACE_A = (
    "date string, pagination struct<total: bigint>, data array<struct<isAvailable: boolean, currency: string,"
    " gpu: struct<slug: string, name: string>, pricePerGpu: string, gpuCount: int, provider: string>>"
)
MARKETPLACE_B = (
    "date string, offers array<struct<gpu_name: string, rentable: boolean, rented: boolean, verification: string,"
    " num_gpus: string, dph_total: string>>"
)
TIERED = (
    "date string, data struct<gpuTypes: array<struct<id: string, displayName: string, secureCloud: boolean,"
    " communityCloud: boolean, securePrice: string, communityPrice: string, maxGpuCount: double>>>"
)
PROVIDER_OFFERS = (
    "date string, offers array<struct<provider: string, gpu: string, vram_gb: double, usd_hr: string, kind: string,"
    " source_url: string>>"
)
INDEX_HISTORY = "gpu string, success boolean, data array<struct<timestamp: string, index_value: double>>"
REALIZED_PRICE = "success boolean, data array<struct<date: string, lab: string, indexPerMtok: double>>"
WIDE_INDEX = (
    "status string, index array<struct<date: string, h100: double, a100: double, b200: double>>,"
    " contract array<struct<data: array<string>>>"
)
LEDGER = (
    "as_of string, models map<string, struct<name: string, first_seen: string, last_seen: string,"
    " present_now: boolean, points: array<array<string>>>>"
)
CATALOG = (
    "data array<struct<id: string, canonical_slug: string, name: string,"
    " pricing: struct<prompt: string, completion: string>>>"
)
PROVIDER_MAP = (
    "data map<string, array<struct<date: string, avg_price: double, min_price: double, max_price: double,"
    " provider_prices: map<string, double>>>>"
)
AVAILABILITY = (
    "gpu string, providers array<struct<providerName: string, providerSlug: string,"
    " counts: array<struct<cells: array<struct<date: string, available: double, total: double>>>>>>"
)
MONTHLY = (
    "gpu string, history array<struct<month: string, provider: string, onDemandPrice: double, spotPrice: double>>"
)
FACT_ROW = (
    "struct<start: string, end: string, val: string, accn: string, fy: string, fp: string, form: string, filed: string>"
)
COMPANY_FACTS = (
    "cik string, entityName string, facts struct<`us-gaap`: map<string, struct<label: string, description: string,"
    f" units: map<string, array<{FACT_ROW}>>>>>"
)
WEEKLY_USAGE = "data struct<data: array<struct<x: string, ys: map<string, double>>>>"
THROUGHPUT = "formula string, rows array<map<string, string>>"
OFFICIAL_EVENTS = (
    "event_id string, ticker string, company string, announcement_date string, fiscal_period string,"
    " event_type string, metric string, value string, unit string, source_url string, source_excerpt string,"
    " collector_name string"
)
DATED_EVENTS = "date string, category string, importance string, label string, tooltip string, source string"
CATALOG_SNAPSHOT = (
    "snapshot_date string, models map<string, struct<input_cost_per_token: double,"
    " output_cost_per_token: double, litellm_provider: string>>"
)
CHIP_SALES = [
    "Name",
    "Chip manufacturer",
    "Start date",
    "End date",
    "Incomplete",
    "Number of Units",
    "Compute estimate in H100e (median)",
    "Chip type",
]
