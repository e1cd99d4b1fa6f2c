import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from spotloom.functions import scalars
from spotloom.plans import reports
from spotloom.sources import documents, tables, text, writers
from spotloom.streaming import molecules


def wkb(points, order="<"):
    flat = [c for p in points for c in p]
    return struct.pack(f"{order}BIII{len(flat)}d", 1 if order == "<" else 0, 3, 1, len(points), *flat)


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]


def geojson(ids=True):
    props = lambda i: {"cell_id": i, "class": "tumor"} if ids else {}
    return json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": props(i + 10), "geometry": {"type": "Polygon", "coordinates": [[[x + i, y] for x, y in SQUARE]]}} for i in range(3)]})


def test_segmentation_formats(spark, tmp_path):
    folder = tmp_path / "cellvit_seg"
    folder.mkdir()
    with zipfile.ZipFile(folder / "A_cellvit_seg.geojson.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("inner/A.geojson", geojson(ids=False))
    (folder / "B_cellvit_seg.geojson").write_text(geojson())
    spark.createDataFrame([(5, bytearray(wkb(SQUARE))), (6, bytearray(wkb(SQUARE, ">")))], "cell_id long, geometry binary").write.parquet(str(folder / "C_cellvit_seg.parquet"))
    read = lambda s: sorted((r["cell_id"], r["class"], r["vertices"][0][1]["x"]) for r in tables.read_segmentation_any(spark, str(tmp_path), s).collect())
    assert read("A") == [(0, "NA", 2.0), (1, "NA", 3.0), (2, "NA", 4.0)]
    assert read("B") == [(10, "tumor", 2.0), (11, "tumor", 3.0), (12, "tumor", 4.0)]
    assert read("C") == [(5, "NA", 2.0), (6, "NA", 2.0)]
    with pytest.raises(FileNotFoundError):
        tables.read_segmentation_any(spark, str(tmp_path), "D")
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(KeyError):
        tables.read_segmentation(spark, str(tmp_path / "bad"))


def test_gene_files(spark, tmp_path):
    (tmp_path / "genes.txt").write_text("Total genes\n B \nA\n\nB\r\nC\n")
    genes = lambda **k: [r["gene"] for r in text.read_gene_list(spark, str(tmp_path / "genes.txt"), **k).orderBy("pos").collect()]
    assert genes(skip_headers=True) == ["B", "A", "C"]
    assert genes() == ["Total genes", "B", "A", "C"]
    (tmp_path / "none.txt").write_text("\n\n")
    with pytest.raises(Exception, match="empty"):
        text.read_gene_list(spark, str(tmp_path / "none.txt"), required=True).collect()
    (tmp_path / "t.tsv").write_text("id\tgene_name\n1\tX\n2\tY\n")
    assert [r[0] for r in text.read_gene_table(spark, str(tmp_path / "t.tsv")).collect()] == ["X", "Y"]
    assert [r[0] for r in text.read_gene_table(spark, str(tmp_path / "t.tsv"), "other").collect()] == ["1", "2"]


def test_sample_metadata(spark, tmp_path):
    write = lambda name, **k: (tmp_path / f"{name}.json").write_text(json.dumps(k))
    write("S1", pixel_size_um_embedded=None, pixel_size_um_estimated=0.5, spot_diameter=55, inter_spot_dist=100, st_technology="Visium")
    write("S2", pixel_size_um_embedded="0.25", spot_diameter=55.0)
    rows = {r["sample_id"]: r for r in documents.read_sample_metadata(spark, str(tmp_path / "*.json")).collect()}
    assert (rows["S1"]["pixel_size_um"], rows["S1"]["inter_spot_dist_um"], rows["S1"]["technology"]) == (0.5, 100.0, "Visium")
    assert (rows["S2"]["pixel_size_um"], rows["S2"]["inter_spot_dist_um"], rows["S2"]["technology"]) == (0.25, 55.0, "UNKNOWN")
    write("S3", pixel_size_um_embedded="NaN", spot_diameter=55)
    with pytest.raises(Exception, match="no pixel size for S3"):
        documents.read_sample_metadata(spark, str(tmp_path / "S3.json")).collect()


def test_fold_manifest(spark, tmp_path):
    folds = [{"fold_index": 0, "train_samples": ["A", "B"], "test_samples": "C"}, {"fold_index": 1, "train_samples": "A, C", "test_samples": ["B"]}, {"fold_index": 2, "train_samples": [], "test_samples": ["B"]}]
    (tmp_path / "list.json").write_text(json.dumps(folds))
    (tmp_path / "dict.json").write_text(json.dumps({"split_name": "s", "sample_ids": "C,B,A", "folds": folds}, indent=1))
    row = documents.read_fold_manifest(spark, str(tmp_path / "list.json"), 1).first()
    assert (row["split_name"], row["sample_ids"], row["train_samples"], row["test_samples"]) == ("list.json", ["A", "B", "C"], ["A", "C"], ["B"])
    row = documents.read_fold_manifest(spark, str(tmp_path / "dict.json"), 0).first()
    assert (row["split_name"], row["sample_ids"]) == ("s", ["C", "B", "A"])
    with pytest.raises(Exception, match="lacks train or test"):
        documents.read_fold_manifest(spark, str(tmp_path / "dict.json"), 2).collect()
    with pytest.raises(Exception, match="not in the manifest"):
        documents.read_fold_manifest(spark, str(tmp_path / "dict.json"), 7).collect()


def test_fold_reports(spark, tmp_path):
    for fold, overall in (("fold0", 0.2), ("fold1", -0.4), ("fold_02", 0.6)):
        (tmp_path / fold).mkdir()
        (tmp_path / fold / "training.log").write_text(
            f"start\nFold 1 Pearson: overall=0.9, gene=0.1, spot=0.1\nFold 1 Pearson: overall={overall}, gene=-0.25, spot=0.5\nend\n"
            f"Visium test metrics: {{'x': 1, 'overall_pearson': {overall}, 'std': 2, 'mean_gene_pearson': 0.1, 'mean_spot_pearson': 0.3}}\n")
        (tmp_path / fold / "metrics.json").write_text(json.dumps({"visium_test_metrics": {"overall_pearson": overall, "mean_gene_pearson": 0.1}, "final_test_metrics": {"overall_pearson": 1.0}}))
    (tmp_path / "fold3").mkdir()
    rows, summary = reports.fold_report(spark, str(tmp_path))
    assert sorted((r["fold"], r["overall"]) for r in rows.collect()) == [(0, 0.2), (1, -0.4), (2, 0.6)]
    s = summary.first()
    assert s["num_folds"] == 3 and s["overall_values"] == [0.2, -0.4, 0.6] and s["overall_mean"] == pytest.approx(0.4 / 3)
    rows, _ = reports.fold_report(spark, str(tmp_path), "joint")
    assert sorted((r["fold"], r["platform"], r["overall"], r["spot"]) for r in rows.collect())[1] == (1, "visium", -0.4, 0.3)
    rows, _ = reports.fold_report(spark, str(tmp_path), "metrics")
    assert sorted((r["fold"], r["platform"], r["overall"]) for r in rows.collect())[:2] == [(0, "all", 1.0), (0, "visium", 0.2)]


@pytest.mark.parametrize("flip", [False, True])
def test_10x(spark, tmp_path, flip):
    (tmp_path / "barcodes.tsv").write_text("b1\tx\nb2\n\nb3\nb4\n")
    (tmp_path / "genes.tsv").write_text("id1\tS1\nid2\nid3\tS3\n")
    entries = [(1, 1, 5), (3, 4, 2), (2, 3, 7)]
    shape = (4, 3) if flip else (3, 4)
    lines = [f"{c} {g} {v}" if flip else f"{g} {c} {v}" for g, c, v in entries]
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n" + f"{shape[0]} {shape[1]} 3\n" + "\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in text.read_10x_triplets(spark, str(tmp_path)).collect())
    assert got == [("b1", "S1", 5.0), ("b3", "id2", 7.0), ("b4", "S3", 2.0)]
    assert {r["gene"] for r in text.read_10x_triplets(spark, str(tmp_path), "gene_id").collect()} == {"id1", "id2", "id3"}
    (tmp_path / "barcodes.tsv").write_text("b1\n")
    with pytest.raises(ValueError):
        text.read_10x_triplets(spark, str(tmp_path))


def test_discover_samples(spark, tmp_path):
    for sub, names in (("st", ["A", "B"]), ("tiles", ["B", "C"])):
        (tmp_path / sub).mkdir()
        for n in names:
            (tmp_path / sub / f"{n}.parquet").write_bytes(b"x")
    assert [r[0] for r in tables.discover_samples(spark, str(tmp_path / "st"), str(tmp_path / "tiles")).collect()] == ["B"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "Z.parquet").write_bytes(b"x")
    with pytest.raises(Exception, match="no sample has both"):
        tables.discover_samples(spark, str(tmp_path / "st"), str(tmp_path / "other")).collect()


def test_cache_path_depends_on_options(spark, tmp_path):
    assert writers.option_path("/r", "c", {"a": 1}) != writers.option_path("/r", "c", {"a": 2})
    df = spark.range(3).withColumnRenamed("id", "cell_id")
    args = dict(counts=df, cells=df, panel=df, manifest=df.limit(1))
    base = writers.write_cell_cache(str(tmp_path), {"a": 1}, **args)
    again = writers.write_cell_cache(str(tmp_path), {"a": 1}, **{**args, "counts": df.limit(1)})
    assert base == again and spark.read.parquet(f"{base}/counts").count() == 3
    writers.write_cell_cache(str(tmp_path), {"a": 1}, **{**args, "counts": df.limit(1)}, force_rebuild=True)
    assert spark.read.parquet(f"{base}/counts").count() == 1


def test_id_list_and_specs_fail_loudly(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="empty"):
        one.select(scalars.parse_id_list(F.lit(" , ,"))).collect()
    with pytest.raises(Exception, match="depth spec"):
        one.select(scalars.target_depth(F.lit(1.0), F.lit("x1"))).collect()
    with pytest.raises(Exception, match="grid_layout"):
        one.select(scalars.grid_layout(F.lit("ring"), F.lit("Visium"))).collect()


def test_stream_over_runs_restarts_and_compactions_equals_batch(spark, tmp_path):
    from spotloom.operators import counting

    rows = spark.range(4000).select((F.col("id") % 40).alias("cell_id"), F.concat(F.lit("G"), (F.col("id") % 7).cast("string")).alias("feature_name"), (F.col("id") % 3 == 0).cast("int").alias("overlaps_nucleus"))
    folder, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    assert molecules.latest_counts(spark, log).count() == 0 and molecules.compact(spark, log) is None
    cells = spark.range(1, 38).select(F.col("id").alias("cell_id"))
    start = lambda: molecules.run_to_log(molecules.stream_molecules(spark, folder, files_per_trigger=2), log, state, cells=cells, only_nucleus=True)
    counts = lambda df: sorted(tuple(r) for r in df.collect())
    seen = rows.where("cell_id < 25")
    seen.repartition(3).write.parquet(folder)
    start()
    assert counts(molecules.latest_counts(spark, log)) == counts(counting.cell_gene_counts(seen, cells, only_nucleus=True))
    first = molecules.compact(spark, log)
    assert first == 1 and molecules.compact(spark, log) is None
    late = rows.where("cell_id >= 25").unionByName(rows.where("cell_id = 3"))  # late files bring more of a cell that is in the base
    late.repartition(2).write.mode("append").parquet(folder)
    start()
    start()  # nothing new
    want = counts(counting.cell_gene_counts(seen.unionByName(late), cells, only_nucleus=True))
    assert counts(molecules.latest_counts(spark, log)) == want
    assert molecules.compact(spark, log) > first
    assert counts(molecules.latest_counts(spark, log)) == want
    # A trigger that is replayed after the compaction writes its folder again; it is in the base already.
    replayed = spark.read.parquet(f"{log}/batches/batch_id=0")
    replayed.write.parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").write.mode("overwrite").parquet(f"{log}/batches/batch_id=0")
    assert counts(molecules.latest_counts(spark, log)) == want


OUTER, HOLE, FAR = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(10, 0), (12, 0), (12, 3), (10, 3)]
SHAPES = {  # parts, each an outer ring and its holes
    1: [[OUTER]], 2: [[OUTER[::-1]]], 3: [[OUTER, HOLE]], 4: [[OUTER[::-1], HOLE[::-1]]], 5: [[OUTER, HOLE], [FAR[::-1]]], 6: [[FAR], [OUTER, HOLE, [(3, 3), (3.5, 3), (3, 3.5)]]],
}


def part_wkb(part, order):
    out = struct.pack(f"{order}BII", order == "<", 3, len(part))
    for ring in part:
        out += struct.pack(f"{order}I{2 * len(ring)}d", len(ring), *[c for p in ring for c in p])
    return out


def shape_wkb(parts, order="<"):
    if len(parts) == 1:
        return part_wkb(parts[0], order)
    return struct.pack(f"{order}BII", order == "<", 6, len(parts)) + b"".join(part_wkb(p, "<>"[n % 2]) for n, p in enumerate(parts))


def geometry(parts):
    return {"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts}


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def facts(parts):
    """Area, perimeter and centroid of outer rings less holes."""
    area = cx = cy = length = 0.0
    for part in parts:
        for n, ring in enumerate(part):
            size, sign = abs(signed(ring)), -1 if n else 1
            area += sign * size
            pairs = list(zip(ring, [*ring[1:], ring[0]]))
            length += sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in pairs)
            turn = 1 if signed(ring) > 0 else -1
            cx += sign * turn * sum((a[0] + b[0]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / 6
            cy += sign * turn * sum((a[1] + b[1]) * (a[0] * b[1] - b[0] * a[1]) for a, b in pairs) / 6
    return area, length, cx / area, cy / area


def test_outlines_with_holes_and_parts_in_all_formats(spark, tmp_path):
    from spotloom.operators import gap, spatial

    folder = tmp_path / "cellvit_seg"
    folder.mkdir()
    rows = [(i, bytearray(shape_wkb(p, "<>"[i % 2]))) for i, p in SHAPES.items()]
    spark.createDataFrame([*rows, (9, None)], "cell_id long, geometry binary").repartition(2).write.parquet(str(folder / "P_cellvit_seg.parquet"))
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"cell_id": i}, "geometry": geometry(p)} for i, p in SHAPES.items()]})
    (folder / "G_cellvit_seg.geojson").write_text(text)
    with zipfile.ZipFile(folder / "Z_cellvit_seg.geojson.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("z.geojson", text)
    for sample in "PGZ":
        cells = tables.read_segmentation_any(spark, str(tmp_path), sample).where("vertices IS NOT NULL").drop("class")
        assert cells.count() == len(SHAPES)
        stats = {r.cell_id: r for r in gap.polygon_stats(cells, 1.0).collect()}
        middles = {r.cell_id: r for r in gap.polygon_metadata(cells).collect()}
        for i, parts in SHAPES.items():
            area, length, cx, cy = facts(parts)
            assert (stats[i].area_px2, stats[i].perimeter_px, middles[i].centroid_x, middles[i].centroid_y) == pytest.approx((area, length, cx, cy))
        pieces = {}
        for r in spatial.polygon_patch_overlap(cells, 16.0, 16).collect():  # squares of side 1
            pieces.setdefault(r.cell_id, {})[r.patch_idx] = r.overlap_area
        for i, parts in SHAPES.items():
            assert sum(pieces[i].values()) == pytest.approx(facts(parts)[0])
        assert pieces[3][17] == pytest.approx(0) and pieces[1][17] == pytest.approx(1)  # the hole
    wide = [[[(0, 0), (40, 0), (40, 40), (0, 40)], [(4, 4), (30, 4), (30, 30), (4, 30)]]]
    cells = spark.createDataFrame([(1, bytearray(shape_wkb(wide)))], "cell_id long, geometry binary").select("cell_id", tables.decode_wkb("geometry").alias("vertices"))
    touched = {r.patch_idx for r in spatial.polygon_patch_overlap(cells, 40.0, 8).collect()}
    assert 2 * 8 + 2 not in touched and 0 in touched  # a square inside the hole is not touched


def test_wkb_that_is_no_polygon_or_cut_short_is_an_error(spark):
    import pyarrow as pa

    point = struct.pack("<BIdd", 1, 1, 0.0, 0.0)
    with pytest.raises(ValueError, match="WKB type 1"):
        tables.decode_outlines(pa.array([point], pa.binary()))
    with pytest.raises((ValueError, IndexError)):
        tables.decode_outlines(pa.array([shape_wkb([[OUTER]])[:-8]], pa.binary()))
    blobs = pa.array([None, shape_wkb(SHAPES[5]), None, shape_wkb(SHAPES[3]), shape_wkb([[]])], pa.binary())
    got = tables.decode_outlines(blobs.slice(1, 4)).to_pylist()
    assert [None if g is None else len(g) for g in got] == [3, None, 2, 0]
    assert [signed([(p["x"], p["y"]) for p in ring]) > 0 for ring in got[0]] == [True, False, True]
    assert tables.decode_outlines(blobs.slice(0, 1)).to_pylist() == [None]


def test_geojson_in_many_small_pieces(spark, tmp_path, monkeypatch):
    from spotloom.sources import geojson

    monkeypatch.setattr(geojson, "CHUNK", 97)
    monkeypatch.setattr(geojson, "BLOCK", 5)
    awkward = ['plain', 'a } brace', 'open {', 'quote " here', 'back\\slash', 'ends \\', '}{"]', 'ä 日本', '"}', '{"type":"Feature"}']
    features = [{"type": "Feature", "properties": {"class": awkward[n % len(awkward)], "cell_id": None if n % 3 else 1000 + n, "more": {"deep": {"x": [1, {"y": "}"}]}}},
                 "geometry": None if n % 17 == 5 else geometry(SHAPES[1 + n % 6]), "id": n} for n in range(300)]
    document = {"crs": {"type": "name", "properties": {"name": "a}b{\"c"}}, "type": "FeatureCollection", "name": "x } \" { y", "features": features, "bbox": [0, 1], "meta": {"features": [{"a": 1}]}}
    for name, indent, plain in (("a", None, True), ("b", 2, False)):
        text = json.dumps(document, indent=indent, ensure_ascii=plain)
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8")
        with zipfile.ZipFile(tmp_path / f"{name}.geojson.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x.geojson", text)
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert spark.read.option("lineSep", "}").text(str(tmp_path / f"{name}.geojson")).rdd.getNumPartitions() > 5
            for read, suffix in ((tables.read_geojson, "geojson"), (tables.read_geojson_zip, "geojson.zip")):
                got = sorted(read(spark, str(tmp_path / f"{name}.{suffix}")).collect(), key=lambda r: r["class"] + str(r.cell_id))
                want = sorted(((n if n % 3 else 1000 + n, f["properties"]["class"], f["geometry"] and len([r for p in SHAPES[1 + n % 6] for r in p])) for n, f in enumerate(features)), key=lambda r: r[1] + str(r[0]))
                assert [(r.cell_id, r["class"], None if r.vertices is None else len(r.vertices)) for r in got] == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
            spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    (tmp_path / "bad.geojson").write_text(json.dumps({"features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    with pytest.raises(Exception, match="an outline is a Point"):
        tables.read_geojson(spark, str(tmp_path / "bad.geojson")).collect()


def test_bucketed_expression_is_gathered_without_a_shuffle_of_the_bank(spark, tmp_path):
    from spotloom.operators import retrieval

    rows = spark.range(3000).select((F.col("id") % 300).alias("id"), F.concat(F.lit("G"), (F.col("id") % 10).cast("string")).alias("gene"), (F.col("id") * 0.5).alias("value"))
    path = writers.write_bank_expression(rows, f"{tmp_path}/bank", buckets=5)
    matches = spark.range(40).select(F.col("id").alias("query_id"), (F.col("id") * 7).alias("bank_id"), F.lit(1.0).alias("score"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            found = retrieval.gather_expression(matches, tables.open_bank_expression(spark, path))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.gather_expression(matches, rows).collect()))
            spark.sql(f"DROP TABLE {writers.bank_table(path)}")  # as in another session
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_many_small_files_are_written_by_many_tasks_and_listed_below_a_folder(spark, tmp_path, monkeypatch):
    """The rows of a file are few bytes: without a number of tasks all files would be written by one."""
    from spotloom.catalog import sources as fixtures

    monkeypatch.setattr(fixtures, "FILES_A_TASK", 4)
    rows = spark.range(20).select(F.format_string("S %02d", "id").alias("sample"), F.lit('{"pixel_size_um_embedded":"0.5","spot_diameter":"55"}').alias("value"))
    path = str(tmp_path / "many")
    fixtures.write_each(rows, path)
    parts = {p.name.split("-")[1] for p in (tmp_path / "many").rglob("part-*.txt")}
    assert len(parts) > 1
    found = documents.read_sample_metadata(spark, path, files="*.txt", name=r"sample=([^/]+)/").select(fixtures.named("sample_id")).collect()
    assert sorted(r[0] for r in found) == [f"S {i:02d}" for i in range(20)]


def test_outline_pieces_are_not_broadcast(spark, tmp_path):
    """The staged piece tables are far smaller on disk than in memory: a broadcast of them would fill the driver."""
    path = tmp_path / "a.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"cell_id":"3"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}]}')
    found = tables.read_geojson(spark, str(path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
    assert [r["cell_id"] for r in found.collect()] == [3]


def test_name_lists_are_numbered_by_many_tasks(spark, tmp_path):
    names = [f"name-{i}\tsymbol-{i}" for i in range(200)]
    # Blank lines and both line ends; a file is cut anywhere, in a line and between its two end characters too.
    (tmp_path / "genes.tsv").write_bytes(b"".join(n.encode() + (b"\r\n" if i % 3 else b"\n") + (b"  \n\r\n" if i % 7 == 0 else b"") for i, n in enumerate(names)).rstrip())
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "257")
        got = text._indexed(spark, f"{tmp_path}/genes.tsv")
        assert {r["idx"]: r["parts"] for r in got.collect()} == {i + 1: n.split("\t") for i, n in enumerate(names)}
        assert got.count() == 200 and got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
