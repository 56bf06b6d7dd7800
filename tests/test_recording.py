"""Tiles, recorded spans, censuses, exports and squeezes, each against a plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from reelgrid.operators import census, recording, sampling, search, spans, tiles
from reelgrid.plans import recording_queries
from reelgrid.sources import export

# ---- tiles


def plain_tiles(image, f, tile, overlap):
    """Tile after tile into one output, with None where nothing was written yet."""
    h, w = len(image), len(image[0])
    out, step, ov, ty = [[None] * w for _ in range(h)], max(tile - overlap, 1), max(overlap, 1), 0
    while ty < h:
        y, tx = min(ty, max(0, h - tile)), 0
        th = min(tile, h - y)
        while tx < w:
            x = min(tx, max(0, w - tile))
            tw = min(tile, w - x)
            part = f([row[x : x + tw] for row in image[y : y + th]])
            for r in range(th):
                for c in range(tw):
                    weight = min(c / ov, (tw - 1 - c) / ov, 1) * min(r / ov, (th - 1 - r) / ov, 1)
                    old = out[y + r][x + c]
                    new = float(part[r][c])
                    out[y + r][x + c] = new if old is None or weight >= 0.999 else float(int(old * (1 - weight) + new * weight + 0.5))
            if x + tw >= w:
                break
            tx += step
        if y + th >= h:
            break
        ty += step
    return out


def smooth(part):
    return [[float(int((row[max(c - 1, 0)] + row[c] + row[min(c + 1, len(row) - 1)]) / 3 + 0.5)) for c in range(len(row))] for row in part]


@pytest.mark.parametrize(("w", "h", "tile", "overlap"), [(50, 37, 16, 8), (16, 16, 16, 4), (17, 40, 16, 0), (70, 20, 32, 16), (9, 9, 16, 8)])
def test_tiles_are_blended_in_order(spark, w, h, tile, overlap):
    r = random.Random(w)
    image = [[float(r.randrange(256)) for _ in range(w)] for _ in range(h)]
    pixels = spark.createDataFrame([(1, y, x, image[y][x], w, h) for y in range(h) for x in range(w)], "id int, y int, x int, v double, w int, h int")
    got = {(p["y"], p["x"]): p["v"] for p in tiles.processed(pixels, tiles.chained(tiles.smoothed, tiles.pointwise(lambda v: 255 - v)), 1, tile, overlap).collect()}
    want = plain_tiles(image, lambda part: [[255 - v for v in row] for row in smooth(part)], tile, overlap)
    assert got == {(y, x): want[y][x] for y in range(h) for x in range(w)}


def test_small_images_are_one_tile_and_chains_fold_left(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 10.0, 20, 20)], "id int, y int, x int, v double, w int, h int")
    assert tiles.tiled(pixels, whole=400, tile=16, overlap=4).count() == 1 and tiles.tiled(pixels, whole=399, tile=16, overlap=4).count() == 1
    add, double = tiles.pointwise(lambda v: v + 1), tiles.pointwise(lambda v: v * 2)
    values = [tiles.processed(pixels, tiles.chained(*c)).first()["v"] for c in ([], [add, double], [double, add])]
    assert values == [10.0, 22.0, 21.0]
    grid = tiles.grid(spark.createDataFrame([(1, 1100, 500)], "id int, w int, h int"), whole=1).orderBy("n").collect()
    assert [(g["n"], g["x0"], g["y0"], g["tw"], g["th"]) for g in grid] == [(0, 0, 0, 512, 500), (1, 480, 0, 512, 500), (2, 588, 0, 512, 500)]


# ---- recorded spans

LOG = "kind string, seq long, t long, handle long, name string, lane string, detail int, tid long, attrs map<string,string>"


def collector(log):
    """What a collector with a clock would hold: (all that was appended, what is held at the end)."""
    on, level, epoch, n, open_, out = False, 0, None, 0, {}, []
    for kind, seq, t, handle, name, lane, detail, _, attrs in sorted(log, key=lambda r: (r[2], r[1])):
        if kind in ("enable", "reset"):
            epoch, n = t, n + 1
        if kind == "enable":
            on, level = True, detail
        elif kind == "disable":
            on = False
        elif kind == "begin" and on and detail <= level:
            open_[handle] = (name, lane, t, attrs)
        elif kind == "end" and handle in open_:
            name, lane, t0, a = open_[handle]
            out.append((name, lane, max(t0 - epoch, 0), t - t0, seq, tuple(sorted((a | attrs).items())), n))
        elif kind == "event" and on and detail <= level:
            out.append((name, lane, t - epoch, 0, seq, tuple(sorted(attrs.items())), n))
    return sorted(x[:-1] for x in out), sorted(x[:-1] for x in out if x[-1] == n)


def test_recording_against_a_collector(spark):
    r = random.Random(6)
    log, handles = [("enable", 0, 0, None, "", "", 1, 1, {})], []
    for seq in range(1, 900):
        kind = r.choice(["begin"] * 8 + ["end"] * 8 + ["event"] * 3 + ["reset", "enable", "disable"])
        handle = None
        if kind == "begin":
            handle = seq
            handles.append(seq)
        elif kind == "end":
            handle = handles.pop(r.randrange(len(handles))) if handles else 10**6
        log.append((kind, seq, seq // 3 * 10, handle, f"s{seq % 7}", "cpu", r.randrange(3), 1, {"k": str(seq)} if kind != "end" else {"e": "x"} if seq % 2 else {"k": "end"}))
    got = recording.recorded(spark.createDataFrame(log, LOG)).collect()
    short = lambda rows: sorted((x["name"], x["lane"], x["start_ns"], x["dur_ns"], x["seq"], tuple(sorted(x["attrs"].items()))) for x in rows)
    every, held = collector(log)
    assert short(got) == every and short([x for x in got if x["kept"]]) == held and held


def test_duration_is_absolute_and_start_is_clamped(spark):
    log = [("enable", 0, 100, None, "", "", 1, 1, None), ("begin", 1, 150, 7, "a", "io", 0, 1, None), ("reset", 2, 200, None, "", "", 0, 1, None), ("end", 3, 260, 7, "", "", 0, 1, None), ("begin", 4, 300, 8, "deep", "io", 2, 1, None), ("end", 5, 310, 8, "", "", 0, 1, None)]
    got = recording.recorded(spark.createDataFrame(log, LOG)).collect()
    assert [(x["name"], x["start_ns"], x["dur_ns"], x["kept"]) for x in got] == [("a", 0, 110, True)]
    assert recording.recorded(spark.createDataFrame([], LOG)).isEmpty()


# ---- export

SPANS = "name string, lane string, start_ns long, dur_ns long, tid long, seq long, detail long, attrs map<string,string>"


def test_export_is_in_order_with_its_meta_line(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [(f"n{i % 3}", "cpu", i * 1000, 1_234_567 + i, 9, i, 0, {"b": "1", "a": '"'} if i % 2 else {}) for i in range(1000)]
    random.Random(1).shuffle(rows)
    s = spark.createDataFrame(rows, SPANS).repartition(7)
    for _ in range(2):  # a second export takes the place of the first
        export.write_ndjson(s, str(tmp_path / "out"), cap=900, build="debug")
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names[0] == "0-meta.ndjson" and len(names) > 4 and all(n.startswith("1-") for n in names[1:])
    lines = b"".join((tmp_path / "out" / n).read_bytes() for n in names).decode().splitlines()
    assert lines[0] == f'{{"meta":{{"buildConfiguration":"debug","detailLevel":1,"droppedSpans":100,"parts":{len(names) - 1},"spans":900}},"t":"meta"}}'
    want = [json.dumps({"attrs": dict(sorted(r[7].items())), "durS": round(r[3] / 1e9, 6), "lane": r[1], "name": r[0], "startS": round(r[2] / 1e9, 6), "t": "span", "tid": 9}, separators=(",", ":")) for r in sorted(rows, key=lambda r: r[5])[:900]]
    parsed = [json.loads(x) for x in lines[1:]]
    assert parsed == [json.loads(x) for x in want] and all(list(x) == sorted(x) for x in parsed)
    export.write_ndjson(s.where("false"), str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["0-meta.ndjson"]


def test_failed_export_leaves_the_old_one(spark, tmp_path):
    rows = [("n", "cpu", 0, 1, 9, i, 0, {}) for i in range(10)]
    s = spark.createDataFrame(rows, SPANS)
    export.write_ndjson(s, str(tmp_path / "out"))
    before = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    broken = s.withColumn("lane", F.when(F.col("seq") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("lane")))
    with pytest.raises(Exception, match="broken"):
        export.write_ndjson(broken, str(tmp_path / "out"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == before


def test_report_of_no_spans(spark):
    assert [x["line"][:5] for x in spans.report(spark.createDataFrame([], SPANS)).orderBy("n").collect()] == ["stage", "─" * 5]


# ---- census, squeeze, plan


def test_digest_tells_order_and_place(spark):
    of = {"a": [1, 2, 3], "b": [1, 2, 3], "c": [2, 1, 3], "d": [1, 2], "e": [1, 2, 3, 3]}
    rows = [(run, i, v, i == 0) for run, vs in of.items() for i, v in enumerate(vs)]
    d = {x["run"]: x["digest"] for x in census.runs(spark.createDataFrame(rows, "run string, place int, size long, sync boolean"), ["run"]).collect()}
    assert d["a"] == d["b"] and len(set(d.values())) == 4


def test_squeeze_keeps_what_it_can_not_better(spark):
    rows = [(1, 100.0, 100.0, 0.0, 18), (2, 100.0, 100.0, 90.0, 18), (3, None, None, 0.0, 18), (4, 100.0, 100.0, 0.0, None), (5, 100.0, 0.0, 0.0, 18), (6, 100.0, 50.0, 47.0, 18)]
    found = spark.createDataFrame(rows, "id int, best double, emitted double, target double, corridor int")
    out = search.squeezed(found, lambda b: b, lambda b: b, F.col("target"), F.col("corridor")).collect()
    assert {x["id"]: (x["squeezed"] and round(x["squeezed"], 4), x["squeezes"]) for x in out} == {1: (77.8688, 3), 2: (92.0, 1), 3: (None, 0), 4: (100.0, 0), 5: (100.0, 0), 6: (100.0, 0)}


def test_sampling_plan(spark):
    rows = spark.createDataFrame([(600, None), (5, None), (600, 7), (600, 0)], "n int, e int")
    assert [tuple(x[0]) for x in rows.select(sampling.sampling_plan(F.col("n"), F.col("e"))).collect()] == [(50, 16), (1, 16), (7, 60), (1, 60)]


def test_census_moves_lines_once(spark, sf):
    """Lines are moved before they are tripled, to parts whose number grows with them; windows and runs move nothing more."""
    plan = recording_queries.run_census(spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if " Exchange " in x]
    assert any("hashpartitioning(l_orderkey" in x and "REPARTITION_BY_NUM" in x for x in moved) and not any("run#" in x for x in moved)
