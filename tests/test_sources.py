"""Readers on landed files, parsers on literal documents, partitioned writes."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import d, one, rows
from tidemark import config, schemas
from tidemark.operators import filings as G
from tidemark.sources import readers as R
from tidemark.sources import sinks


def _doc(spark, schema, payload):
    df = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "j string")
    return df.select(F.from_json("j", schema).alias("d")).select("d.*")


def _land(tmp_path, name, payload):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=1), encoding="utf-8")
    return str(path)


def test_read_rows(spark, tmp_path):
    path = _land(tmp_path, "h.json", {"rows": [{"date": "2026-01-01", "v": 1.5}], "datasets": {"x": [{"date": "2026-01-02", "v": 2.5}]}})
    assert rows(R.read_rows(spark, path, "date: string, v: double")) == [("2026-01-01", 1.5)]
    assert rows(R.read_rows(spark, path, "date: string, v: double", "datasets.x")) == [("2026-01-02", 2.5)]
    assert R.read_rows(spark, str(tmp_path / "none.json"), "date: string, v: double").count() == 0


def test_marketplace_a(spark):
    gpu = {"slug": "h100-sxm", "name": "H100"}
    offer = lambda **k: {"isAvailable": True, "currency": "USD", "gpu": gpu, "pricePerGpu": 2.0, "gpuCount": 4, "provider": "Alpha", **k}
    payload = {
        "date": "2026-01-01", "pagination": {"total": 9},
        "data": [offer(), offer(isAvailable=False), offer(currency="EUR"), offer(gpu={"slug": "a100"}), offer(pricePerGpu=0), offer(pricePerGpu="n/a")],
    }
    r = one(R.offers_marketplace_a(_doc(spark, schemas.MARKETPLACE_A, payload), "H100"))
    assert (r.price, r.gpus, r.provider, r.server_total) == (2.0, 4, "Alpha", 9)
    bare = {"date": "2026-01-01", "data": [{"isAvailable": True, "gpu": gpu, "pricePerGpu": 3}]}
    r = one(R.offers_marketplace_a(_doc(spark, schemas.MARKETPLACE_A, bare)))
    assert (r.gpus, r.provider) == (1, "unknown")


def test_marketplace_b(spark):
    offer = lambda **k: {"gpu_name": "H100 SXM", "rentable": True, "rented": False, "verification": "VERIFIED", "num_gpus": 2, "dph_total": 5.0, **k}
    payload = {"date": "t", "offers": [offer(), offer(rented=True), offer(verification="unverified"), offer(num_gpus=0), offer(gpu_name="K80"), offer(rentable=None)]}
    r = one(R.offers_marketplace_b(_doc(spark, schemas.MARKETPLACE_B, payload), ["H100"]))
    assert (r.price, r.gpus) == (2.5, 2)


def test_tiers(spark):
    card = lambda **k: {"id": "H100", "displayName": "H100", "secureCloud": True, "communityCloud": True, "securePrice": 3.0, "communityPrice": 2.0, "maxGpuCount": 8, **k}
    payload = {"date": "t", "data": {"gpuTypes": [card(), card(displayName="H100 MIG 1g"), card(communityCloud=False), card(communityPrice=0), card(secureCloud=False, communityPrice=0)]}}
    out = R.offers_tiered(_doc(spark, schemas.TIERED, payload), ["H100"])
    assert rows(out, "price") == [(2.0,), (3.0,), (3.0,)]


def test_provider_offers(spark):
    offer = lambda **k: {"provider": "AWS", "gpu": "H100", "vram_gb": 80, "usd_hr": 2.5, "kind": "Spot", "source_url": "u", **k}
    payload = {"date": "2026-01-01T00:00:00Z", "offers": [offer(), offer(provider=" aws "), offer(usd_hr=0), offer(usd_hr="text")]}
    r = one(R.provider_offers(_doc(spark, schemas.PROVIDER_OFFERS, payload)))
    assert (r.date, r.provider, r.venue_grade, r.kind, r.usd_per_gpu_hour) == ("2026-01-01", "aws", "hyperscaler", "spot", 2.5)


def test_index_feeds(spark):
    payload = {"gpu": "H100", "success": True, "data": [{"timestamp": "2026-01-01T01", "index_value": 2.0}, {"timestamp": "2026-01-01T09", "index_value": 9.0}, {"timestamp": "x", "index_value": 1.0}, {"timestamp": "2026-01-02", "index_value": -1.0}]}
    assert rows(R.index_history(_doc(spark, schemas.INDEX_HISTORY, payload)), "date", "index_value") == [("2026-01-01", 2.0)]
    labs = {"success": True, "data": [{"date": "2026-01-01", "lab": "L", "indexPerMtok": 1.5}, {"date": "2026-01-01", "lab": "", "indexPerMtok": 1.5}, {"date": "2026-1-1", "lab": "L", "indexPerMtok": 1.5}]}
    assert rows(R.realized_price(_doc(spark, schemas.REALIZED_PRICE, labs)), "series", "index_value") == [("L", 1.5)]


def test_wide_index_and_bands(spark):
    item = {"period": "2026 H1", "period_start": "Thu, 01 Jan 2026 00:00:00 GMT", "1y": [2.0, 3.0], "2y": [0, 3], "note": "x"}
    payload = {
        "status": "ok",
        "index": [{"date": "Mon, 03 Aug 2026 00:00:00 GMT", "h100": 3.15, "a100": None, "b200": 5.4}, {"date": "bad", "h100": 1.0}, {"date": "Tue, 04 Aug 2026", "h100": -1, "b200": 0}],
        "contract": [{"data": [json.dumps(item), json.dumps({"period": "p", "period_start": "later", "6m": [1, 2]})]}],
    }
    df = _doc(spark, schemas.WIDE_INDEX, payload)
    out = R.wide_index_to_long(df, {"h100": "H100", "a100": "A100", "b200": "B200"})
    assert rows(out) == [(d("2026-08-03"), "B200", 5.4), (d("2026-08-03"), "H100", 3.15)]
    assert rows(R.contract_bands(df)) == [("", "H100-6m", 1.0, 2.0, "p"), ("2026-01-01", "H100-1y", 2.0, 3.0, "2026 H1")]


def test_ledger_and_aliases(spark):
    payload = {"as_of": "2026-01-01", "models": {"m": {"points": [["2026-02-01", "2", "3"], ["2026-01-01", "1", "1"], ["", "1", "1"], ["2026-03-01", "1"]]}, "gone": {"points": []}}}
    out = R.change_point_ledger(_doc(spark, schemas.LEDGER, payload))
    assert rows(out, "model", "first_seen", "last_seen", "seq", "date", "output") == [
        ("m", "2026-02-01", "2026-01-01", 0, d("2026-02-01"), 3.0), ("m", "2026-02-01", "2026-01-01", 1, d("2026-01-01"), 1.0),
    ]
    catalog = {"data": [{"id": "a", "canonical_slug": "s", "pricing": {"prompt": "0.000001", "completion": "-1"}}, {"id": "b", "canonical_slug": "s", "name": "B"}, {"canonical_slug": "z"}]}
    listed = R.current_catalog(_doc(spark, schemas.CATALOG, catalog))
    assert rows(listed, "id", "name", "input_usd_per_1m", "output_usd_per_1m") == [("a", "a", 1.0, None), ("b", "B", None, None)]
    assert rows(R.alias_map(listed)) == [("a", "a"), ("b", "b"), ("s", "b")]


def test_provider_map(spark):
    point = {"date": "2026-01-01", "avg_price": 9.0, "min_price": 1.0, "max_price": 5.0, "provider_prices": {"a": 1.0, "b": 5.0, "c": 0.0}}
    payload = {"data": {"NVIDIA H100": [point, {**point, "provider_prices": {"c": 0.0}}], "K80": [point]}}
    r = one(R.provider_map_prices(_doc(spark, schemas.PROVIDER_MAP, payload), {"NVIDIA H100": "H100"}))
    assert (r["value"], r.average, r.low, r.high, r.provider_count) == (3.0, 9.0, 1.0, 5.0, 2)


def test_availability_keeps_every_day(spark):
    days = [f"2026-10-0{i}" for i in range(1, 8)]
    provider = lambda name, avail: {"providerName": name, "counts": [{"cells": [{"date": x, "available": avail, "total": 4} for x in days] + [{"date": "2026-10-09", "available": 1, "total": 0}]}]}
    cells = R.availability_cells(_doc(spark, schemas.AVAILABILITY, {"gpu": "H100", "providers": [provider("a", 1), provider("b", 2)]}))
    out = R.availability_days(cells)
    assert rows(out, "date", "availability_pct") == [(x, 37.5) for x in days]
    assert out.first().availability_by_provider == {"a": [1.0, 4.0], "b": [2.0, 4.0]}


def _facts(*items):
    units = [{"accn": "x", "form": "10-Q", **i} for i in items]
    return {"cik": "1", "entityName": "E", "facts": {"us-gaap": {"PaymentsToAcquireX": {"units": {"USD": units}}, "Revenues": {"units": {"USD": units}}}}}


def test_filings(spark):
    quarter = lambda start, end, val, fp, filed: {"start": start, "end": end, "val": val, "fy": 2026, "fp": fp, "filed": filed}
    payload = _facts(
        quarter("2025-07-01", "2025-09-30", 24.242e9, "Q1", "2025-10-29"), quarter("2025-10-01", "2025-12-31", 26.0e9, "Q2", "2026-01-28"),
        quarter("2026-01-01", "2026-03-31", 30.876e9, "Q3", "2026-04-28"), quarter("2025-07-01", "2026-03-31", 85.776e9, "Q3", "2026-04-28"),
        {**quarter("2025-07-01", "2026-06-30", 1.0, "Q3", ""), "filed": ""}, {**quarter("2025-07-01", "2025-09-30", "n/a", "Q1", "2025-10-29")},
    )
    df = _doc(spark, schemas.COMPANY_FACTS, payload)
    facts = R.xbrl_facts(df, F.lit("PaymentsToAcquireX"))
    assert facts.count() == 4
    assert {r.fiscal_period for r in facts.collect()} == {"FY2026 Q1", "FY2026 Q2", "FY2026 Q3", "FY2026 Q3 累计（约9个月）"}
    latest = one(G.latest_fact(facts, "cik"))
    assert (latest.raw_value, latest.fiscal_period) == (30.876e9, "FY2026 Q3")
    assert tuple(one(G.sequential_quarters(facts, "cik"))) == ("1", 3, False)
    assert one(G.candidate_tags(df, "facts.us-gaap")).tags == ["PaymentsToAcquireX"]
    companies = spark.createDataFrame([("MSFT", "Microsoft", "1", "PaymentsToAcquireX")], "ticker string, company string, cik string, xbrl_tag string")
    seen = G.capex_observation(facts, companies, F.lit("r"), F.lit("t"))
    assert {r.capex_value for r in seen.collect()} == {24.242, 26.0, 30.876, 85.776}
    assert R.xbrl_facts(df, F.lit("Absent")).count() == 0


def test_annual_label(spark):
    df = spark.createDataFrame([(2026, "FY", d("2025-06-01"), d("2026-05-31"))], "fy int, fp string, s date, e date")
    label = G.fiscal_label(F.col("fy"), F.col("fp"), F.col("s"), F.col("e"))
    assert one(df.select(label))[0] == "FY2026" + config.CUMULATIVE_SUFFIX % 12


def test_csv_sources(spark, tmp_path):
    header = ",".join(schemas.CHIP_SALES) + ",Extra\n"
    body = 'B,NV,2024-02-01,,, 10 ,x,gpu,1\nA,NV,2024-01-01,2024-02-01,,5,2.5,gpu,2\nC,NV,,,,5,,gpu,3\nD,NV,2024-03-01,,,many,,gpu,4\n'
    out = R.chip_sales_csv(spark, _land(tmp_path, "chips.csv", header + body)).collect()
    assert [(r["Name"], r["Number of Units"], r["Compute estimate in H100e (median)"], r["End date"]) for r in out] == [("A", 5.0, 2.5, "2024-02-01"), ("B", 10.0, None, None)]
    macro = R.macro_series_csv(spark, _land(tmp_path, "cpi.csv", "observation_date,CPI\n2019-01-01,1\n2020-01-01,2.5\n2020-02-01,\n"), "2020-01-01")
    assert rows(macro) == [("2020-01-01", 2.5)]


def test_fixings(spark):
    text = "[{ id: 'a', chipName: 'H100',\n tenor: 'spot', price: 2.5, obs: 7, venueCount: '3/4', x: 1, delta30d: -1.5 },\n { id: 'b', chipName: 'B200', tenor: '1y', price: 4, obs: 1, venueCount: '1' }]"
    df = spark.createDataFrame([(d("2026-01-01"), text)], "date date, text string")
    assert rows(R.fixings_from_text(df), "series_id", "chip", "tenor", "price", "obs_count", "venue_count", "delta_30d_pct") == [
        ("a", "H100", "spot", 2.5, 7, "3/4", -1.5), ("b", "B200", "1y", 4.0, 1, "1", None),
    ]


def test_events_archives_and_benchmarks(spark, tmp_path):
    _land(tmp_path, "2026-01-01.json", {"m": 1.0})
    _land(tmp_path, "2026-01-02.json", {"m": 2.0, "n": 3.0})
    assert rows(R.daily_archive(spark, str(tmp_path / "2026-*.json"))) == [(d("2026-01-01"), "m", 1.0), (d("2026-01-02"), "m", 2.0), (d("2026-01-02"), "n", 3.0)]
    path = _land(tmp_path, "bench.json", {"formula": "price / throughput", "rows": [{"engine": "e", "tps": "5"}]})
    r = one(R.benchmarks_rows(spark, path))
    assert (r.formula, r.row) == ("price / throughput", {"engine": "e", "tps": "5"})
    events = _land(tmp_path, "events.json", [{"date": "2026-01-01", "label": "x"}, {"date": "2026-01-01"}, {"label": "y"}])
    assert rows(R.dated_events(spark, events), "date", "label") == [("2026-01-01", "x")]
    assert R.dated_events(spark, _land(tmp_path, "broken.json", "{oops")).count() == 0
    assert R.dated_events(spark, str(tmp_path / "absent.json")).count() == 0


def test_official_bounds(spark):
    band = json.dumps({"low": 125, "high": 145, "previous_low": 115, "previous_high": 135})
    df = spark.createDataFrame([("e1", "capex_guidance", band), ("e2", "rpo", "523"), ("e3", "comment", "text")], "event_id string, metric string, value string")
    assert rows(R.official_events(df)) == [
        ("e1", "capex_guidance_high", 145.0), ("e1", "capex_guidance_low", 125.0), ("e1", "capex_guidance_previous_high", 135.0), ("e1", "capex_guidance_previous_low", 115.0), ("e2", "rpo", 523.0),
    ]


def test_catalog_asof_does_not_reach_back(spark):
    snaps = spark.createDataFrame([(d("2026-01-01"), "k", 0.000001, None), (d("2026-01-01"), "gone", 1.0, 1.0), (d("2026-01-08"), "k", 0.000002, 0.000004)], "date date, catalog_key string, input_cost double, output_cost double")
    models = spark.createDataFrame([("k", "K"), ("gone", "G")], "catalog_key string, model string")
    weeks = R.week_grid(spark, F.lit("2025-12-31").cast("date"), F.lit("2026-01-13").cast("date"))
    assert rows(weeks) == [(d("2025-12-29"),), (d("2026-01-05"),), (d("2026-01-12"),)]
    out = R.weekly_catalog_asof(weeks, snaps, models)
    assert rows(out, "date", "model", "input_usd_per_1m") == [(d("2026-01-05"), "G", 1000000.0), (d("2026-01-05"), "K", pytest.approx(1.0)), (d("2026-01-12"), "K", pytest.approx(2.0))]


def test_write_fact_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "fact")
    schema = "k string, v int, date date"
    sinks.write_fact(spark.createDataFrame([("a", 1, d("2026-01-01")), ("a", 2, d("2026-01-02"))], schema), path)
    sinks.write_fact(spark.createDataFrame([("b", 9, d("2026-01-02"))], schema), path, files_per_partition=2)
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 1), ("b", 9)]


def test_write_state_keeps_history(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "clock_id string, state string, as_of date"
    sinks.write_state(spark.createDataFrame([("a", "Trend", d("2026-01-01"))], schema), path)
    sinks.write_state(spark.createDataFrame([("a", "Confirmed", d("2026-01-02"))], schema), path)
    assert spark.read.json(f"{path}/history").count() == 2
    assert one(spark.read.json(f"{path}/latest")).state == "Confirmed"


def test_publish_switches_versions_at_once(spark, tmp_path):
    path, schema = str(tmp_path / "published"), "k string, v int, date date"
    read = lambda: rows(sinks.read_published(spark, path, schema), "k", "v")
    assert read() == []
    first = spark.createDataFrame([("a", 1, d("2026-01-01")), ("a", 2, d("2026-01-02")), ("n", 5, None)], schema)
    assert sinks.publish(first, path) == 1
    assert read() == [("a", 1), ("a", 2), ("n", 5)]
    assert sinks.publish(spark.createDataFrame([("b", 9, d("2026-01-02")), ("c", 8, d("2026-01-03"))], schema), path) == 2
    assert read() == [("a", 1), ("b", 9), ("c", 8), ("n", 5)]
    assert rows(sinks.read_published(spark, path, schema, [d("2026-01-03"), None]), "k") == [("c",), ("n",)]


def test_a_killed_publish_leaves_the_old_version(spark, tmp_path):
    path, schema = str(tmp_path / "published"), "k string, v int, date date"
    sinks.publish(spark.createDataFrame([("a", 1, d("2026-01-01"))], schema), path)
    broken = spark.createDataFrame([("b", 2, d("2026-01-01")), ("b", 0, d("2026-01-02"))], schema).repartition(2, "v").selectExpr("k", "IF(v = 0, raise_error('killed'), v) AS v", "date")
    with pytest.raises(Exception, match="killed"):
        sinks.publish(broken, path)
    # Rows of a version whose pointer was never written are seen by nobody.
    spark.createDataFrame([("x", 3, "2026-01-01")], "k string, v int, _part string").write.partitionBy("_part").parquet(f"{path}/data/orphan")
    assert rows(sinks.read_published(spark, path, schema), "k", "v") == [("a", 1)]


def test_publish_of_nothing_keeps_everything(spark, tmp_path):
    path, schema = str(tmp_path / "published"), "k string, v int, date date"
    one_row = spark.createDataFrame([("a", 1, d("2026-01-01"))], schema)
    sinks.publish(one_row, path)
    sinks.publish(one_row.limit(0), path)
    assert rows(sinks.read_published(spark, path, schema), "k", "v") == [("a", 1)]
