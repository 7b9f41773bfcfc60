"""Records of JSON documents split over byte ranges, against the json module."""

import json
import random

import pytest

from basinframe.errors import SourceUnavailable
from basinframe.functions import codes
from basinframe.sources import landed
from basinframe.sources.records import json_records

SERIES = list(codes.SPOT_METRICS)[0]


@pytest.fixture
def small_ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "700")
    yield
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def odd_value(rng, depth=0):
    kinds = ["s", "n", "o", "a", "z"] if depth < 3 else ["s", "n", "z"]
    kind = rng.choice(kinds)
    if kind == "s":
        return "".join(rng.choice('ab{}[]",:\\ \né') for _ in range(rng.randint(0, 12)))
    if kind == "o":
        return {odd_value(rng, 9) if rng.random() < 0.3 else f"k{i}": odd_value(rng, depth + 1) for i in range(rng.randint(0, 3))} if depth else {}
    if kind == "a":
        return [odd_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.randint(-9, 9) if kind == "n" else rng.choice([None, True])


def landed_files(folder, docs):
    for name, text in docs.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_records_equal_the_json_module(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    docs, want = {}, {}
    for f in range(6):
        records = [{"id": i, "v": odd_value(rng), "w": {"x": [odd_value(rng, 1)]}} for i in range(rng.choice([0, 1, 60]))]
        head = {"type": "x", "crs": {"properties": {"a": {"{": "}"}}}, "n": [1, [2, {"deep": 1}]]}
        mixed = [y for r in records for y in ([r] if rng.random() < 0.7 else [r, None, "}{", 3])]
        docs[f"d{f}.json"] = json.dumps(head | {"features": mixed, "tail": {"t": 1}}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])
        want[f"d{f}.json"] = json.loads(json.dumps(records))
    path = landed_files(tmp_path, docs)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    rows = json_records(spark, path, 1, 1).collect()
    got = {name: [] for name in docs}
    for r in sorted(rows, key=lambda r: (r["file"], r["pos"])):
        got[r["file"].rsplit("/", 1)[1]].append(r)
        assert (r["head"] is None) == (r["pos"] > 1)
    for name, own in got.items():
        assert [json.loads(r["record"]) for r in own] == want[name]
        assert [r["pos"] for r in own] == list(range(1, len(own) + 1))
        if own:
            assert docs[name].startswith(own[0]["head"])


def test_two_tasks_for_one_file(spark, tmp_path, small_ranges):
    text = '{"observations":[' + ",\n".join(json.dumps({"date": f"2024-01-{d:02d}", "value": str(d)}) for d in range(1, 29)) + "]}"
    path = landed_files(tmp_path, {"a.json": text})
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() >= 2
    out = landed.SPOT.load(spark, path, {"series_id": SERIES})
    assert sorted(r["value"] for r in out.collect()) == [float(d) for d in range(1, 29)]


@pytest.mark.parametrize("cut", ['{"observations":[{"date":"2024-01-01","value":"1"}', '{"observations":[{"date":"2024-01-01","val', '{"observations":[{"date":"2024'])
def test_documents_cut_off(spark, tmp_path, cut):
    with pytest.raises(SourceUnavailable):
        json_records(spark, landed_files(tmp_path, {"a.json": cut}), 1, 1).collect()


def test_errors_empty_and_truncated(spark, tmp_path):
    for k, text in enumerate(['{"error":{"code":"403","message":"no"}}', '{"observations":[]}', "{}"]):
        folder = tmp_path / str(k)
        folder.mkdir()
        with pytest.raises(SourceUnavailable):
            landed.SPOT.load(spark, landed_files(folder, {"a.json": text}), {"series_id": SERIES})
    (tmp_path / "w").mkdir()
    text = '{"response":{"total":"5","data":[{"period":"2024-01-05","value":"3"},{"period":"2024-01-12","value":null}]}}'
    path = landed_files(tmp_path / "w", {"a.json": text})
    with pytest.raises(SourceUnavailable, match="truncated"):
        landed.WEEKLY.documents(spark, path, series_id="s", metric="m")
    (tmp_path / "v").mkdir()
    path = landed_files(tmp_path / "v", {"a.json": text.replace('"5"', "2")})
    docs = landed.WEEKLY.documents(spark, path, series_id="s", metric="m")
    assert landed.WEEKLY.feed.normalize(landed.WEEKLY.feed.rows(docs)).count() == 1


def test_governance_events_and_features(spark, tmp_path):
    row = {"indicator": {"id": "GOV_WGI_CC.EST"}, "country": {"value": "Norway"}, "countryiso3code": "NOR", "date": "2020", "value": -2.75}
    path = landed_files(tmp_path, {"g.json": "﻿" + json.dumps([{"page": 1, "total": 1}, [row]])})
    out = landed.GOVERNANCE.load(spark, path).collect()
    assert [(r["iso3"], r["year"], r["value"]) for r in out] == [("NOR", 2020, -2.75)]
    (tmp_path / "e").mkdir()
    articles = [{"url": "http://a", "title": "first", "seendate": "20240101T000000Z"}, {"url": " ", "title": "x"}, {"url": "http://a", "title": "second"}]
    path = landed_files(tmp_path / "e", {"e.json": json.dumps({"articles": articles})})
    assert [(r["url"], r["title"]) for r in landed.EVENTS.load(spark, path).collect()] == [("http://a", "first")]
    (tmp_path / "f").mkdir()
    props = {"project-id": "P1", "name": "N {x}", "country-area1": "NO", "status": "operating", "discovery-year": "1999"}
    feature = {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [2.5, 60.0]}}
    path = landed_files(tmp_path / "f", {"f.json": json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "x"}}, "features": [feature]})})
    assert [(r["field_id"], r["name"], r["lon"]) for r in landed.FIELDS.load(spark, path).collect()] == [("gem_goget:P1", "N {x}", 2.5)]


def long_document(rng):
    """A document of several chunks: a long head, records longer than a chunk, a long tail."""
    sizes = [10] * 3000 + [1_300_000] + [25] * 2000 + [700_000, 600_000, 1] + [10] * 9000
    text = 'x\\"{}[]é\\\\ '
    records = [{"id": i, "v": "".join(rng.choices(text, k=10)) * (n // 10), "w": [{"x": [i, {}]}]} for i, n in enumerate(sizes)]
    head = {"crs": {"properties": {f"{{{i}": "]}" for i in range(80_000)}}, "n": [1, [2, {"deep": 1}]]}
    tail = {"t": {f"t{i}": [i, [{"u": i}]] for i in range(60_000)}}
    return records, json.dumps(head | {"features": records} | tail, ensure_ascii=False)


def test_records_longer_than_chunks(spark, tmp_path):
    records, text = long_document(random.Random(7))
    (tmp_path / "a").mkdir()
    path = landed_files(tmp_path / "a", {"a.json": text, "b.json": '{"features":[{"id":1}]}', "c.json": '{"features":[]}'})
    rows = json_records(spark, path, 1, 1).collect()
    own = sorted((r for r in rows if r["file"].endswith("a.json")), key=lambda r: r["pos"])
    assert [r["pos"] for r in own] == list(range(1, len(records) + 1))
    assert [json.loads(r["record"]) for r in own] == records
    assert own[0]["head"] == text[: text.index('"features": [') + len('"features": [')]
    assert all(r["head"] is None for r in own[1:])
    assert [(r["pos"], r["head"], r["record"]) for r in rows if r["file"].endswith("b.json")] == [(1, '{"features":[', '{"id":1}')]
    assert len(rows) == len(records) + 1


def test_only_records_across_chunks_are_shuffled(spark, tmp_path):
    """Work of a load grows with its text alone: whole records are cut where they were read."""
    articles = [{"url": f"http://a/{i % 50}", "title": "{" * (i % 4), "domain": "d"} for i in range(30_000)]
    docs = {f"{k}.json": json.dumps({"articles": articles[k::2]}) for k in range(2)}
    path = landed_files(tmp_path, docs)
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = set(stages())
    out = landed.EVENTS.load(spark, path).select("url").collect()
    assert sorted(r["url"] for r in out) == sorted({a["url"] for a in articles})
    assert sum(n for stage, n in stages().items() if stage not in before) < 5_000
