"""JSON documents cut at every place give the records that a whole parse gives."""

from __future__ import annotations

import json
import os
import random

import pytest

from kerbside.sources import jsonsplit, readers

TRICKY = ['a"b', "\\", '\\"', "[{", "}]", '"features":[', "é漢🎉", "\\\\", ""]


def made(rng, n):
    return [{"id": i, "s": rng.choice(TRICKY) * rng.randrange(3), "d": {"features": [{"x": [1, {"y": rng.choice(TRICKY)}]}], "e": []}} for i in range(n)]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_every_cut(tmp_path, size):
    """The sums and records of a file's ranges, without Spark."""
    rng = random.Random(size)
    rows = made(rng, 25)
    head = {"type": 'x"features":[{}]', "crs": {"features": [1]}, "features": rows, "elements": [{"no": 1}], "tail": [{"features": [{"no": 2}]}]}
    texts = {
        "features": json.dumps(head, ensure_ascii=False, indent=1) + "\n" + json.dumps(head, separators=(",", ":")),
        jsonsplit.ARRAY: json.dumps(rows, ensure_ascii=False) + json.dumps(rows[:3], indent=2),
        jsonsplit.ENTRIES: json.dumps({f'k{i}"\\': r for i, r in enumerate(rows)} | {"none": 3, "list": [{}]}),
    }
    for at, text in texts.items():
        path = tmp_path / "x.json"
        write(path, text)
        n, got, level = os.path.getsize(path), [], jsonsplit._level(at)
        case, depth, inside = 0, 0, False
        with jsonsplit.pafs.LocalFileSystem().open_input_file(str(path)) as f:
            for start in range(0, n, size):
                own = jsonsplit.Part(f, start, min(n, start + size), at)
                begins, _ = own.records(case, depth, inside, level)
                for b in begins.tolist():
                    rest = jsonsplit.Part(f, start, n, at)
                    all_begins, ends = rest.records(case, depth, inside, level)
                    k = all_begins.tolist().index(b)
                    got.append((own.key(b) if at == jsonsplit.ENTRIES else None, json.loads(rest.data[b : ends[k]])))
                flips, up0, up1, last0, last1 = own.sums()
                inside = (last1 if case else last0).get(level - 1 - depth, inside)
                case, depth = (case + flips) % 2, depth + (up1 if case else up0)
        want = {"features": [(None, r) for r in rows * 2], jsonsplit.ARRAY: [(None, r) for r in rows + rows[:3]], jsonsplit.ENTRIES: [(f'k{i}"\\', r) for i, r in enumerate(rows)]}[at]
        assert got == want and (case, depth) == (0, 0)


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = made(rng, 4000)
    path = write(tmp_path / "big.json", json.dumps({"version": 1, "features": rows, "n": 4000}, ensure_ascii=False))
    out = jsonsplit.json_records(spark, path, "features", 20_000)
    assert out.rdd.getNumPartitions() > 10 and sum(n > 0 for n in out.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()) > 4
    got = out.orderBy("place").collect()
    assert [json.loads(r.value) for r in got] == rows


def test_readers(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"GEOID": i}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [i, 0], [i, i], [0, 0]]]}} for i in range(1, 40)]
    path = write(tmp_path / "f.geojson", json.dumps({"type": "FeatureCollection", "features": features}))
    rings = readers.geojson_rings(readers.geojson(spark, path, 300)).select(readers.prop("GEOID", kind="long").alias("i"), "ring").collect()
    assert sorted((r.i, len(r.ring), r.ring[1].x) for r in rings) == [(i, 4, float(i)) for i in range(1, 40)]
    elements = [{"type": "node", "id": i, "lat": 1.5, "lon": 2, "tags": {"k}": '"elements":[{'}} for i in range(30)] + [{"type": "way", "id": 99, "center": {"lat": 3, "lon": 4}, "nodes": [1, 2]}]
    write(tmp_path / "_ignored.json", "{")
    path = write(tmp_path / "o.json", json.dumps({"elements": elements}))
    got = {r.id: r for r in readers.overpass(spark, path, 100).collect()}
    assert len(got) == 31 and (got[99].lat, got[99].nodes) == (3.0, [1, 2]) and got[0].tags == {"k}": '"elements":[{'}
    path = write(tmp_path / "m.json", json.dumps({f"g{i}": {"total": i} for i in range(50)}))
    assert sorted(tuple(r) for r in readers.json_map(spark, path, "total:bigint", size=17).collect()) == sorted((f"g{i}", i) for i in range(50))
    empty = write(tmp_path / "e.json", "[]")
    assert readers.json_rows(spark, empty, "id string").count() == 0
    assert readers.json_rows(spark, write(tmp_path / "n.json", ""), "id string").count() == 0
