from __future__ import annotations

import json
import struct

import numpy as np
import pytest

from roadkrige.sources import collections, csv_, files, geojson, geotiff, shapefile, xlsx
from roadkrige.streaming import counts


@pytest.fixture(scope="module")
def roads(spark):
    rows = [(1, "A ß", 1.5, [(0.0, 0.0), (1.0, 2.0)]), (2, None, None, [(3.0, 3.0), (4.0, 4.0), (5.5, 6.0)]), (3, 'q"', 2.0, [(9.0, 9.0), (9.0, 8.0)])]
    return spark.createDataFrame(rows, "road_id long, name string, w double, pts array<struct<x:double,y:double>>")


@pytest.mark.parametrize("lines", [False, True])
def test_geojson_round_trip(spark, roads, tmp_path, lines):
    geojson.write_geojson(roads.coalesce(1), f"{tmp_path}/g", lines=lines)
    if not lines:
        texts = [p.read_text() for p in (tmp_path / "g").glob("part-*") if p.stat().st_size]
        assert sum(len(json.loads(t)["features"]) for t in texts) == 3
    back = geojson.lines_of(geojson.read_geojson(spark, f"{tmp_path}/g", lines=lines)).select("road_id", "name", "w", "pts")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, roads.collect()))


def test_geojson_mixed_geometries(spark, tmp_path):
    shapes = {"Point": [1, 2], "LineString": [[0, 0], [1, 1]], "MultiLineString": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], "Polygon": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "MultiPolygon": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"k": i, "x": None if i else "t"}, "geometry": {"type": t, "coordinates": c}} for i, (t, c) in enumerate(shapes.items())]}
    doc["features"].append({"type": "Feature", "properties": {"k": 9}, "geometry": None})
    both = [{"type": "Point", "coordinates": [5, 5]}, {"type": "Polygon", "coordinates": shapes["Polygon"]}]
    doc["features"].append({"type": "Feature", "properties": {"k": 10}, "geometry": {"type": "GeometryCollection", "geometries": both}})
    (tmp_path / "a.geojson").write_text("﻿" + json.dumps(doc))
    df = geojson.read_geojson(spark, f"{tmp_path}/a.geojson")
    assert df.count() == 8 and df.filter("parts is null").count() == 1
    assert geojson.lines_of(df).count() == 3
    assert sorted(r.k for r in geojson.polygons_of(df).collect()) == [3, 4, 10]
    assert df.filter("gtype = 'Polygon'").first().parts[0][2].x == 1.0


def _odd_collections(n):
    """Texts with lists, strings and members that look like features, in several layouts."""
    rng = np.random.default_rng(n)
    odd = ['"', "}", "\\", '{"type":"Feature"}', '"features": [{', "]}", "ä€😀", "a\nb", '\\"features\\":[', ""]
    feature = lambda i: {
        "type": "Feature",
        "properties": {"k": int(i), "s": "".join(rng.choice(odd, 3)), "features": [{"type": "Feature", "features": [{}]}], "deep": {"a": [{"b": {}}]}},
        "geometry": {"type": "LineString", "coordinates": rng.integers(0, 99, (int(rng.integers(2, 40)), 2)).tolist()},
    }
    head = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"features": [{"type": "Feature"}], "t": '"features":[{'}}, "note": '}"features": ['}
    rows = [feature(i) for i in range(n)]
    rows_first = {"features": rows, **head, "links": [{"type": "Feature"}]}
    return rows, [json.dumps({**head, "features": rows}), json.dumps(rows_first, ensure_ascii=False), json.dumps({**head, "features": rows, "after": [{}, {"features": []}]}, indent=2) + "\n"]


def _cut_at(text, borders):
    """Features by blocks that begin at the given bytes, as the text source splits them."""
    records, at, starts = text.split(b"}"), 0, [0, *borders]
    blocks = {s: [] for s in starts}
    for i, r in enumerate(records):
        if i < len(records) - 1 or r:
            # a record is in the last block that begins before it
            blocks[max(s for s in starts if s == 0 or s < at)].append(r)
        at += len(r) + 1
    sums = []
    for start, own in blocks.items():
        both = collections._Sum(0), collections._Sum(1)
        for r in own:
            for s in both:
                s.add(collections._plain(r + b"}"))
        if own:
            sums.append((start, both[0].row(), both[1].row()))
    out, pieces = [], {}
    for start, state in collections.chained(sums).items():
        for value, begun, ended in collections.cut(iter(blocks[start]), state):
            if begun and ended:
                out.append(value)
            else:
                pieces.setdefault(start if begun else state.owner, []).append(value)
    return [json.loads(v) for v in out + [b"".join(p) for p in pieces.values()]]


def test_collections_cut_anywhere():
    rows, texts = _odd_collections(25)
    rng = np.random.default_rng(1)
    by_id = lambda found: sorted(found, key=lambda f: f["properties"]["k"])
    for text in texts:
        data = text.encode()
        for n in [0, 1, 2, 5, 40, 400] * 6:
            borders = sorted({int(b) for b in rng.integers(1, len(data), n)})
            assert by_id(_cut_at(data, borders)) == rows
    for text in ['{"type":"FeatureCollection","features":[]}', '{"features":[ ],"a":{"b":1}}', "", "{}", '{"type":"Feature","properties":{}}', "[1]"]:
        assert _cut_at(text.encode(), []) == []


def test_collections_of_several_blocks(spark, tmp_path):
    rows, texts = _odd_collections(600)
    for i, text in enumerate([*texts, '{"type":"FeatureCollection","features":[]}', ""]):
        (tmp_path / f"{i}.geojson").write_text(("\ufeff" if i == 0 else "") + text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
        features = collections.read_features(spark, f"{tmp_path}/*.geojson")
        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/2.geojson").rdd.getNumPartitions() > 10
        got = sorted((json.loads(r.value) for r in features.collect()), key=lambda f: f["properties"]["k"])
        assert got == [r for r in rows for _ in texts]
        read = geojson.lines_of(geojson.read_geojson(spark, f"{tmp_path}/1.geojson"))
        assert {r.k: (r.s, len(r.pts)) for r in read.collect()} == {r["properties"]["k"]: (r["properties"]["s"], len(r["geometry"]["coordinates"])) for r in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_xlsx_round_trip_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", 2.5), (2, None, None)], "k long, s string, v double")
    xlsx.write_xlsx(df, f"{tmp_path}/t.xlsx", "data")
    rows = xlsx.with_header(xlsx.read_xlsx(spark, f"{tmp_path}/t.xlsx", "data")).orderBy("rownum").collect()
    assert [(r.k, r.s, r.v) for r in rows] == [("1", "a<b", "2.5"), ("2", None, None)]
    pad = [None] * 10
    sheet = [["t"], [], [], [None, None, "name", xlsx.COUNT_HEADER, *pad[:9], "place"]]
    sheet += [[None, None, " Road​ A ", 100, *pad[:9], "13.5, 100.25"], [None, None, None, None], [None, None, None, 300], [None, None, "B", 5, *pad[:9], "nowhere"]]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "c_2024-01-02.xlsx").write_bytes(xlsx.workbook(sheet))
    (folder / "bad.xlsx").write_bytes(b"not a workbook")
    got = sorted(map(tuple, xlsx.read_counts(spark, str(folder)).collect()))
    assert got == [("c_2024-01-02.xlsx", "road a", 100.0, 13.5, 100.25), ("c_2024-01-02.xlsx", "road a", 300.0, 13.5, 100.25)]
    with pytest.raises(Exception):
        xlsx.read_xlsx(spark, str(folder)).collect()


@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff(spark, tmp_path, deflate):
    band = np.arange(12.0).reshape(3, 4)
    band[1, 2] = -9
    files.write_bytes(spark, f"{tmp_path}/p.tif", geotiff.geotiff(band, 100.0, 50.0, 10.0, -9.0, deflate))
    rows = {(r.row, r.col): r for r in geotiff.read_geotiff(spark, f"{tmp_path}/p.tif").collect()}
    assert len(rows) == 12 and rows[1, 2].value is None and rows[2, 3].value == 11.0
    assert (rows[0, 0].x, rows[0, 0].y) == (105.0, 45.0)


def _lzw(data):
    """The encoder of the format's specification, as a string of bits."""
    codes, out, width, seen = {bytes([i]): i for i in range(256)}, [], 9, b""
    put = lambda c: out.append(f"{c:0{width}b}")
    put(256)
    size = 258
    for b in data:
        longer = seen + bytes([b])
        if longer in codes:
            seen = longer
            continue
        put(codes[seen])
        codes[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            put(256)
            codes, width, size = {bytes([i]): i for i in range(256)}, 9, 258
        seen = bytes([b])
    if seen:
        put(codes[seen])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def _packbits(data):
    out, at = b"", 0
    while at < len(data):
        n = 1
        while n < 128 and data[at + n : at + n + 1] == data[at : at + 1]:
            n += 1
        out += bytes([257 - n]) + data[at : at + 1] if n > 1 else b"\0" + data[at : at + 1]
        at += n
    return out + b"\x80"


def _tiff(band, order="<", big=False, compression=1, predictor=1, tile=None, strip=None, nodata=None, epsg=None, samples=1, empty=()):
    height, width = band.shape
    tw, th = tile or (width, strip or height)
    kind = band.dtype.newbyteorder(order)
    blocks = []
    for top in range(0, height, th):
        for left in range(0, width, tw):
            part = band[top : top + th, left : left + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            part = np.repeat(part[..., None], samples, axis=2)
            if predictor == 2:
                whole = np.ascontiguousarray(part).view(f"u{band.itemsize}")
                part = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1)
                raw = part.astype(f"{order}u{band.itemsize}").tobytes()
            elif predictor == 3:
                planes = np.ascontiguousarray(part).astype(f">f{band.itemsize}").reshape(part.shape[0], -1, 1).view("u1").transpose(0, 2, 1).reshape(part.shape[0], -1, samples)
                raw = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
            else:
                raw = part.astype(kind).tobytes()
            raw = {1: bytes, 5: _lzw, 8: __import__("zlib").compress, 32773: _packbits}[compression](raw)
            blocks.append(b"" if len(blocks) in empty else raw)
    head, place = (16, "Q") if big else (8, "I")
    at, offsets = head, []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags = {256: ("I", [width]), 257: ("I", [height]), 258: ("H", [band.itemsize * 8] * samples), 259: ("H", [compression]), 277: ("H", [samples]), 317: ("H", [predictor]),
            339: ("H", [{"u": 1, "i": 2, "f": 3}[band.dtype.kind]] * samples), 33550: ("d", [10.0, 5.0, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 100.0, 50.0, 0.0])}
    sizes = [len(b) for b in blocks]
    tags |= {322: ("H", [tw]), 323: ("H", [th]), 324: (place, offsets), 325: ("I", sizes)} if tile else {273: (place, offsets), 278: ("I", [th]), 279: ("I", sizes)}
    if nodata is not None:
        tags[42113] = ("s", f"{nodata}\0".encode())
    if epsg:
        tags[34735] = ("H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg])
    kinds = {"H": 3, "I": 4, "d": 12, "Q": 16, "s": 2}
    extra, entries, room = b"", b"", 8 if big else 4
    for tag in sorted(tags):
        code, values = tags[tag]
        data = values if code == "s" else struct.pack(order + code * len(values), *values)
        entries += struct.pack(order + "HH" + place, tag, kinds[code], len(values))
        if len(data) <= room:
            entries += data.ljust(room, b"\0")
        else:
            entries += struct.pack(order + place, at + len(extra))
            extra += data
    mark = {"<": b"II", ">": b"MM"}[order]
    start = mark + (struct.pack(order + "HHHQ", 43, 8, 0, at + len(extra)) if big else struct.pack(order + "HI", 42, at + len(extra)))
    return start + b"".join(blocks) + extra + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * 8


@pytest.mark.parametrize("kind", ["u1", "i2", "u4", "f4", "f8"])
def test_rasters_of_every_layout(kind):
    rng = np.random.default_rng(7)
    band = rng.integers(0, 100, (53, 37)).cumsum(axis=1).astype(kind)
    for compression in (1, 5, 8, 32773):
        for predictor in (1, 3) if kind[0] == "f" else (1, 2):
            for layout in ({"tile": (16, 32)}, {"strip": 7}, {}):
                for order, big, samples in (("<", False, 1), (">", True, 3), ("<", True, 1), (">", False, 1)):
                    data = _tiff(band, order, big, compression, predictor, samples=samples, **layout)
                    raster = geotiff.Raster(lambda at, size, data=data: data[at : at + size])
                    got = np.full(band.shape, np.nan)
                    for k in range(raster.blocks):
                        top, left, pixels = raster.block(k)
                        got[top : top + pixels.shape[0], left : left + pixels.shape[1]] = pixels
                    assert np.array_equal(got, band.astype("f8")), (compression, predictor, layout, order, big)


def test_lzw_and_packed_bits():
    rng = np.random.default_rng(3)
    for data in [b"", b"a", b"a" * 70_000, rng.integers(0, 256, 50_000).astype("u1").tobytes(), rng.integers(0, 3, 90_000).astype("u1").tobytes()]:
        assert geotiff.unlzw(_lzw(data)) == data and geotiff.unpackbits(_packbits(data)) == data
    # the example of the format's specification
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)).ljust(88, "0")
    assert geotiff.unlzw(int(codes, 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    with pytest.raises(ValueError):
        geotiff.Raster(lambda at, size: b"GIF89a" + bytes(10))
    with pytest.raises(ValueError):
        data = _tiff(np.zeros((4, 4), "u1"))
        geotiff.Raster(lambda at, size: data[at : at + size] if at != 8 else data[8:10]).block(0)


def test_plain_strips_are_read_by_rows(monkeypatch):
    monkeypatch.setattr(geotiff, "STRIP_BYTES", 37 * 8 * 5)
    band = np.arange(53 * 37.0).reshape(53, 37)
    data, longest = _tiff(band, strip=20), []
    raster = geotiff.Raster(lambda at, size: longest.append(size) or data[at : at + size])
    got = np.vstack([raster.block(k)[2] for k in range(raster.blocks)])
    assert np.array_equal(got, band) and max(longest) == 37 * 8 * 5 and raster.blocks == 12


def test_geotiff_by_tiles(spark, tmp_path):
    band = np.random.default_rng(5).integers(-9, 50, (100, 90)).astype("i4")
    (tmp_path / "a b.tif").write_bytes(_tiff(band, ">", True, 5, 2, tile=(16, 16), nodata=-9, epsg=32647, empty=(3,)))
    (tmp_path / "c.tif").write_bytes(_tiff(band.astype("f4"), strip=9))
    df = geotiff.read_geotiff(spark, f"{tmp_path}/*.tif", range_bytes=16 * 16 * 4 * 2)
    assert df.rdd.getNumPartitions() > 20
    frame = df.toPandas()
    frame["file"] = frame.path.str.rsplit("/", n=1).str[1]
    assert len(frame) == 2 * band.size and not frame.duplicated(["file", "row", "col"]).any()
    want = np.where(band == -9, np.nan, band.astype("f8"))
    want[:16, 48:64] = np.nan  # a tile that is left out
    for name, expected in (("a b.tif", want), ("c.tif", band.astype("f8"))):
        own = frame[frame.file == name]
        assert np.array_equal(own.sort_values(["row", "col"]).value.to_numpy().reshape(band.shape), expected, equal_nan=True)
        assert (own.x == 100 + (own.col + 0.5) * 10).all() and (own.y == 50 - (own.row + 0.5) * 5).all()
    info = {r.path.rsplit("/", 1)[1]: r for r in geotiff.raster_info(spark, str(tmp_path)).collect()}
    assert (info["a b.tif"].epsg, info["a b.tif"].nodata, info["a b.tif"].blocks, info["c.tif"].epsg, info["c.tif"].nodata) == (32647, -9.0, 42, None, None)


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "k long, s string")
    csv_.write_csv_file(df, f"{tmp_path}/a.csv")
    assert (tmp_path / "a.csv").read_bytes() == b"\xef\xbb\xbfk,s\n1,\xc3\xa4\n2,\n"
    csv_.write_csv(df, f"{tmp_path}/b")
    assert sorted(map(tuple, csv_.read_csv(spark, f"{tmp_path}/b", "k long, s string").collect())) == [(1, "ä"), (2, None)]
    files.write_json(spark, f"{tmp_path}/p.json", {"C": 3.0})
    assert json.loads((tmp_path / "p.json").read_text()) == {"C": 3.0}


def test_shapefile(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 100.0, 13.0), ("b", None, 101.0, 14.0), ("c", 2.0, None, 1.0)], "name string, v double, x double, y double")
    shapefile.write_points(df, f"{tmp_path}/o")
    shp = (tmp_path / "o.shp").read_bytes()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) == 100 + 2 * 28
    assert struct.unpack("<i2d", shp[108:128]) == (1, 100.0, 13.0)
    dbf = (tmp_path / "o.dbf").read_bytes()
    assert struct.unpack("<I", dbf[4:8])[0] == 2 and len(dbf) == struct.unpack("<H", dbf[8:10])[0] + 2 * struct.unpack("<H", dbf[10:12])[0] + 1
    with pytest.raises(ValueError):
        shapefile.write_points(df.filter("x is null"), f"{tmp_path}/n")


def test_stream_of_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "user_id", "value")
    events.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    counts.run_once(counts.windowed_mean(stream, "user_id", "value", window="1 day"), "means", f"{tmp_path}/cp", "complete")
    want = events.filter("value is not null").groupBy("user_id").count().agg({"count": "sum"}).first()[0]
    assert spark.table("means").agg({"n": "sum"}).first()[0] == want
