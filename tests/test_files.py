"""Readers, stores, lookups, grouping, export and alignment on small files with known results."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom import cli
from cpgloom.functions.codec import TrackKey, encode_percent, parse_half_open_region, parse_inclusive_region, parse_locus
from cpgloom.operators import embed, export, grouping, matrix, metadata, ranges, segments, strand
from cpgloom.plans import commands, queries
from cpgloom.sources import arrays, beds, fasta, store

C = TrackKey("5mC", "combined", "combined")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")).write(text)
    return str(path)


def tsv(*rows):
    return "".join("\t".join(map(str, r)) + "\n" for r in rows)


def modkit(*rows):
    return tsv(*[(c, s, s + 1, code, 0, sign, s, s + 1, 0, cov, pct) for c, s, code, sign, cov, pct in rows])


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("two"))
    ref = put(f"{d}/r.fa", ">chr1 x\nACGCG\nTACG\n>chr2\nTACGCGCGT\n>chrUn\nCGCG\n")
    cli.run(["index", "--reference", ref, "--output", f"{d}/index"], spark)
    ont = put(f"{d}/ont_a.bed.gz", modkit(*[x for c, s, m, h in [("chr1", 1, 80, 10), ("chr1", 3, 20, 5), ("chr2", 2, 75, 7)] for x in [(c, s, "m", ".", 10, m), (c, s, "h", ".", 10, h)]]) + modkit(("chr2", 500, "m", ".", 10, 5), ("chr1", 7, "m", ".", 2, 5)))
    head = "##v\n#chrom\tbegin\tcov\tdiscretized_mod_score\n"
    for h, rows in {"combined": [("chr1", 1, 11, 76), ("chr1", 3, 11, 18), ("chr2", 2, 11, 66)], "hap1": [("chr1", 1, 11, 88), ("chr1", 7, 11, 44), ("chr2", 4, 11, 33)], "hap2": [("chr1", 1, 11, 22), ("chr1", 7, 11, 67), ("chr2", 6, 11, 45)]}.items():
        put(f"{d}/pb_a.{h}.bed", head + tsv(*rows))
    cli.run(["create", "--index", f"{d}/index", "--bed", ont, "--output", f"{d}/ont_a"], spark)
    cli.run(["create", "--index", f"{d}/index", "--bed", f"{d}/pb_a", "--output", f"{d}/pb_a", "--input-format", "pacbio"], spark)
    cli.run(["merge", "--inputs", f"{d}/ont_a", "--output", f"{d}/cohort", "--modified"], spark)
    return d


def test_index(spark, two):
    got = [tuple(r) for r in spark.read.parquet(f"{two}/index").orderBy("row_id").select("row_id", "chrom", "pos0").collect()]
    assert got == [(0, "chr1", 1), (1, "chr1", 3), (2, "chr1", 7), (3, "chr2", 2), (4, "chr2", 4), (5, "chr2", 6)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 100])
def test_index_does_not_depend_on_chunks(spark, two, chunk):
    got = [tuple(r) for r in fasta.build_index(spark, f"{two}/r.fa", chunk=chunk).orderBy("row_id").select("row_id", "chrom", "pos0").collect()]
    assert got == [(0, "chr1", 1), (1, "chr1", 3), (2, "chr1", 7), (3, "chr2", 2), (4, "chr2", 4), (5, "chr2", 6)]


def test_merge_append_and_lookups(spark, two):
    d = two
    q = lambda p, i, **k: commands.query(spark, p, f"{d}/index", i, **k)
    assert q(f"{d}/pb_a", "pb_a", locus="chr1:1")["percent"] == 76.0
    assert q(f"{d}/pb_a", "pb_a", locus="chr1:7") is None  # a bundle has no record of a missing cell
    assert q(f"{d}/cohort", "ont_a", locus="chr1:1", key=TrackKey("modifiedC", "combined", "combined"))["percent"] == 90.0
    commands.append(spark, f"{d}/cohort", [f"{d}/pb_a"])
    assert [c["sample_id"] for c in store.view_columns(f"{d}/cohort", C)] == ["ont_a", "pb_a"]
    assert q(f"{d}/cohort", "pb_a", locus="chr1:1")["percent"] == 76.0
    miss = q(f"{d}/cohort", "ont_a", locus="chr1:7")
    assert miss is not None and miss["percent"] is None
    assert q(f"{d}/cohort", "nobody", locus="chr1:1") is None and q(f"{d}/cohort", "ont_a", locus="chr1:2") is None
    r = q(f"{d}/cohort", "ont_a", region="chr2:2-6")
    assert r["count"] == 3 and [x["fraction"] for x in r["records"]] == [0.75, None, None]
    assert q(f"{d}/cohort", "nobody", region="chr2:2-6")["count"] == 0
    with pytest.raises(ValueError):
        commands.append(spark, f"{d}/cohort", [f"{d}/pb_a"])
    with pytest.raises(ValueError):
        q(f"{d}/cohort", "ont_a", region="chr2:6-2")
    r = q(f"{d}/pb_a", "pb_a", region="chr1:1-7")  # a bundle has its observed rows, with coverage
    assert [(x["pos0"], x["fraction"], x["coverage"]) for x in r["records"]] == [(1, 0.76, 5), (3, 0.18, 5)]
    assert q(f"{d}/pb_a", "pb_a", region="chr9:1-7")["count"] == 0


def test_append_may_be_repeated_after_a_failure(spark, two, tmp_path, monkeypatch):
    c = str(tmp_path / "c")
    commands.merge(spark, [f"{two}/ont_a"], c, modified=True)
    before = sorted(map(tuple, store.scan(spark, c).collect()))
    broken = store._manifest
    monkeypatch.setattr(store, "_manifest", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        commands.append(spark, c, [f"{two}/pb_a"], modified=True)
    monkeypatch.setattr(store, "_manifest", broken)
    assert sorted(map(tuple, store.scan(spark, c).collect())) == before
    commands.append(spark, c, [f"{two}/pb_a"], modified=True)
    rows = [tuple(r) for r in store.scan(spark, c).collect()]
    assert len(rows) == len(set(rows)) and set(before) < set(rows)
    key = TrackKey("modifiedC", "combined", "combined")
    assert [x["sample_id"] for x in store.view_columns(c, key)] == ["ont_a", "pb_a"]
    assert {r["row_id"]: r["value"] for r in store.scan_view(spark, c, key).where("sample_id = 'pb_a'").collect()} == {0: 7600, 1: 1800, 3: 6600}
    with pytest.raises(ValueError):
        store.add_modified(spark, c)


def test_stranded_modkit(spark, two):
    p = put(f"{two}/st.bed", modkit(("chr1", 1, "m", "+", 9, 60), ("chr1", 2, "m", "-", 9, 20), ("chr1", 0, "m", "-", 9, 1), ("chr1", 1, "m", "+", 9, 70)))
    o = beds.read_modkit(spark, beds.discover_modkit(p), spark.read.parquet(f"{two}/index"))
    assert sorted((r["strand"], r["row_id"], r["value"]) for r in o.collect()) == [("minus", 0, 2000), ("plus", 0, 7000)]  # the last row wins


METH = "##methbat_version=0.1\n##base_modification={m}\n#chrom\tstart\tend\tname\tscore\tstrand\tmod_score\ttype\tcov\n"


def methbat(path, rows, m="5mC"):
    return put(path, METH.format(m=m) + tsv(*[(c, s, e, n, 0, st, v, t, cov) for c, s, e, n, st, v, t, cov in rows]))


@pytest.fixture(scope="module")
def m20(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("m20"))
    cli.run(["index", "--reference", put(f"{d}/r.fa", ">chr20\nACGCGTACG\n>chr21\nAAAA\n"), "--output", f"{d}/index"], spark)
    return d


def test_methbat_values_and_receipt(spark, m20):
    rows = [("chr20", 1, 2, "m", ".", 33.3, "Total", 12), ("chr20", 1, 2, "m", ".", 0, "hap1", 7), ("chr20", 1, 2, "m", ".", 100, "hap2", 5), ("chr20", 3, 4, "m", ".", 5, "Total", 4), ("chr20", 999, 1000, "m", ".", 5, "Total", 9), ("chrUnknown", 1, 2, "m", ".", 5, "Total", 9), ("chr21", 1, 2, "m", ".", 5, "Total", 9)]
    obs, rec = beds.read_methbat(spark, beds.discover_methbat(methbat(f"{m20}/a.bed", rows))[0], spark.read.parquet(f"{m20}/index"))
    assert sorted((r["haplotype"], r["row_id"], r["value"], r["coverage"]) for r in obs.collect()) == [("combined", 0, 3330, 12), ("hap1", 0, 0, 7), ("hap2", 0, 10000, 5)]
    c = {r["haplotype"]: r for r in rec.collect()}["combined"]
    assert (c["n_input"], c["n_below"], c["n_off_index"], c["n_imported"]) == (5, 1, 3, 1)


def test_methbat_strands(spark, m20):
    rows = [("chr20", 1, 2, "h", "+", 12.5, "Total", 8), ("chr20", 2, 3, "h", "-", 75, "Total", 9), ("chr20", 4, 5, "h", "-", 25, "hap2", 11), ("chr20", 0, 1, "h", "-", 5, "Total", 9), ("chr20", 3, 4, "h", "-", 5, "Total", 9)]
    obs, rec = beds.read_methbat(spark, beds.discover_methbat(methbat(f"{m20}/h.bed", rows, "5hmC"))[0], spark.read.parquet(f"{m20}/index"))
    assert sorted((r["haplotype"], r["strand"], r["row_id"], r["value"]) for r in obs.collect()) == [("combined", "minus", 0, 7500), ("combined", "plus", 0, 1250), ("hap2", "minus", 1, 2500)]


BAD = [dict(s=-1), dict(e=9), dict(v=-0.1), dict(v=100.1), dict(v="NaN"), dict(v="inf"), dict(v=""), dict(cov=-1), dict(cov=0), dict(cov=65535), dict(t="hap3"), dict(n="h"), dict(st="+")]


@pytest.mark.parametrize("i", range(len(BAD)))
def test_methbat_rejects(spark, m20, i):
    x = dict(c="chr20", s=1, e=2, n="m", st=".", v=5, t="Total", cov=9) | BAD[i]
    with pytest.raises(ValueError):
        beds.read_methbat(spark, beds.discover_methbat(methbat(f"{m20}/bad{i}.bed", [tuple(x[k] for k in ("c", "s", "e", "n", "st", "v", "t", "cov"))]))[0], spark.read.parquet(f"{m20}/index"))


def test_methbat_rejects_files(spark, m20):
    ok = ("chr20", 1, 2, "m", ".", 5, "Total", 9)
    idx = spark.read.parquet(f"{m20}/index")
    for name, rows, mod in (("dup", [ok, ok], "5mC"), ("six", [ok], "6mA"), ("none", [], "5mC"), ("off", [("chr20", 900, 901, *ok[3:])], "5mC")):
        with pytest.raises(ValueError):
            beds.read_methbat(spark, beds.discover_methbat(methbat(f"{m20}/{name}.bed", rows, mod))[0], idx)
    put(f"{m20}/amb.5mC.bed", "x")
    put(f"{m20}/amb.5mC.bed.gz", "x")
    with pytest.raises(ValueError):
        beds.discover_methbat(f"{m20}/amb")


# ---------------------------------------------------------------- grouping and export


IDX = [(i, "chr1", 0, p) for i, p in enumerate([1, 3, 20, 23, 25])]
PROF = {"s1": [10, 20, 90, 80, 70], "s2": [20, 30, 80, 70, 60], "s3": [30, 40, 70, 60, 50]}


def idx(spark, rows=IDX):
    return spark.createDataFrame(rows, "row_id long, chrom string, chrom_ord int, pos0 int")


def view(spark, table, scale=100):
    return spark.createDataFrame([(i, s, int(round(v * scale))) for s, vs in table.items() for i, v in enumerate(vs) if v is not None], "row_id long, sample_id string, value int")


def means(spark, groups):
    o = view(spark, PROF).select(F.lit("5mC").alias("assay"), F.lit("combined").alias("haplotype"), F.lit("combined").alias("strand"), "*")
    got = {}
    for r in matrix.group_mean(o, grouping.group_members(groups)).collect():
        got.setdefault(r["group_row"], {})[r["sample_id"]] = r["value"] / 10000
    return [[got[g][s] for s in sorted(got[g])] for g in sorted(got)]


def test_predefined_groups(spark):
    iv = spark.createDataFrame([(1, "chr1", 2, 5), (2, "chr1", 21, 25), (3, "chr1", 26, 27)], "region_id long, chrom string, start long, end long")
    g = grouping.predefined_groups(idx(spark), iv, left_shift=1, min_rows=2).withColumn("group_row", F.col("region_id"))
    rows = [tuple(r) for r in g.orderBy("region_id").select("start", "end", "reference_start").collect()]
    assert rows == [(1, 5, 2), (20, 25, 21)]
    assert means(spark, g) == [[0.15, 0.25, 0.35], [0.85, 0.75, 0.65]]


def test_denovo_groups(spark):
    g = grouping.correlated_groups(idx(spark), view(spark, PROF), 0.95, 100, 3, 2)
    assert [(r["group_id"], r["start"], r["end"], r["n_rows"]) for r in g.orderBy("group_row").collect()] == [("denovo_1", 1, 5, 2), ("denovo_2", 20, 27, 3)]
    assert means(spark, g) == [[0.15, 0.25, 0.35], [0.8, 0.7, 0.6]]


def labels(spark, table, frac, missing="drop"):
    n = len(next(iter(table.values())))
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    s = spark.createDataFrame([(k,) for k in table], "sample_id string")
    v = view(spark, table, 10000)
    lab = export.label_rows(rows, v, s, frac, missing)
    return {r["row_id"]: r["label"] for r in lab.collect()}, lab, v, s


def test_export_filters(spark):
    t = {"a": [0, 0.4, 0, None, None], "b": [0.2, 0.4, None, None, None], "c": [0.4, 0.4, 0.4, None, None], "d": [0.6, 0.4, 0.6, None, 0.2]}
    got, *_ = labels(spark, t, 0.5)
    assert [got[i] for i in range(5)] == ["written", "constant", "remaining_missing", "all_missing", "below_presence"]


def test_export_imputation(spark):
    t = {"a": [0, 0.2, None, 0.3], "b": [None, None, None, 0.3], "c": [0.4, None, None, None], "d": [0.8, 0.8, None, 0.3]}
    got, lab, v, s = labels(spark, t, 0.75, "mean")
    assert [got[i] for i in range(4)] == ["written", "below_presence", "all_missing", "constant"]
    cells = {r["sample_id"]: r["fraction"] for r in export.dense_rows(lab, v, s).collect()}
    assert {k: round(x, 12) for k, x in cells.items()} == {"a": 0.0, "b": 0.4, "c": 0.4, "d": 0.8}


def test_export_file_regions_and_names(spark, two, tmp_path):
    d = two
    out = str(tmp_path / "p.bed.gz")
    note = commands.export_phenotypes(spark, f"{d}/cohort", f"{d}/index", out, samples=["pb_a", "ont_a"], rename={"pb_a": "gB", "ont_a": "gA"}, min_present=0.5, missing="mean")
    lines = gzip.open(out, "rt").read().splitlines()
    assert lines[0] == "#chr\tstart\tend\tphenotype_id\tgB\tgA" and lines[1] == "chr1\t1\t2\tchr1:2\t0.76\t0.8"
    assert note["considered"] == 6 and note["written"] == len(lines) - 1 and json.load(open(out + ".json"))["written"] == note["written"]
    with pytest.raises(FileExistsError):
        commands.export_phenotypes(spark, f"{d}/cohort", f"{d}/index", out, min_present=0.5, missing="mean")
    good = "chr1:3-12"
    bad_regions = {good[:k] for k in range(len(good) - 2)} | {good[:k] + x + good[k:] for k in (6, 8) for x in "-. ,"} | {"chr1:12-3", "chr1:3-3", "other:3-12"}
    for bad in sorted(bad_regions):
        with pytest.raises(ValueError):
            commands.export_phenotypes(spark, f"{d}/cohort", f"{d}/index", str(tmp_path / "q.bed"), region=bad)
    assert not os.path.exists(tmp_path / "q.bed")


def test_group_command_then_export(spark, two, tmp_path):
    d, g = two, str(tmp_path / "g")
    s = commands.group(spark, f"{d}/cohort", f"{d}/index", g, method="decode")
    assert s["n_groups"] == 2 and store.read_manifest(g)["representation"] == "cpg_groups"
    note = commands.export_phenotypes(spark, g, f"{d}/index", str(tmp_path / "x.bed"), region="chr1:0-2")
    assert note["considered"] == 1 and note["outside_region"] == 1
    ids = open(tmp_path / "x.bed").read().splitlines()[1].split("\t")
    assert ids[:4] == ["chr1", "1", "9", "decode_1"]


def test_other_commands(spark, two, tmp_path):
    d = two
    assert commands.stats(spark, f"{d}/cohort", 6)["ranks"].count() > 0
    assert commands.binned(spark, f"{d}/cohort", f"{d}/index", 4, report=str(tmp_path / "b.html")).count() > 0
    assert commands.profile(spark, f"{d}/cohort", f"{d}/index", "chr1:0-10", ("5mC", "combined", "combined"), report=str(tmp_path / "p.html")).count() > 0
    assert os.path.exists(tmp_path / "b.html") and os.path.exists(tmp_path / "p.html")
    commands.pca(spark, f"{d}/cohort", f"{d}/index", str(tmp_path / "pca"), min_present=1.0, fraction=1.0)
    assert len(open(tmp_path / "pca/embedding.tsv").read().splitlines()) == 3


def test_atlas_alignment(spark, tmp_path):
    d = str(tmp_path)
    np.save(f"{d}/m.npy", np.array([[0.1, 0.9], [0.2, 0.8], [np.nan, 0.7], [0.4, 0.6]]))
    put(f"{d}/i.tsv", tsv(("chr1", 10, 11, 0, 1), ("chr1", 20, 30, 1, 5), ("chr1", 31, 32, 5, 6), ("chr1", 40, 50, 6, 9)))
    put(f"{d}/s.txt", "A\nB\n")
    o = spark.createDataFrame([("5hmC", "combined", "combined", "chr1", 0, "A", 8000), ("5hmC", "combined", "combined", "chr1", 0, "B", 1000), ("5hmC", "combined", "combined", "chr1", 1, "A", 7000), ("5hmC", "combined", "combined", "chr1", 1, "B", 2000)], "assay string, haplotype string, strand string, chrom string, row_id long, sample_id string, value int")
    cols = [{"assay": "5hmC", "haplotype": "combined", "strand": "combined", "sample_id": s, "platform": "x", "bundle_path": ""} for s in "AB"]
    store.write_cohort(o, cols, f"{d}/c", "i", representation="cpg_groups")
    spark.createDataFrame([(0, "chr1", 20, 30), (1, "chr1", 40, 50)], "group_row long, chrom string, start long, end long").write.parquet(f"{d}/c/groups")
    commands.atlas(spark, f"{d}/m.npy", f"{d}/i.tsv", f"{d}/s.txt", [f"{d}/c"], f"{d}/out")
    got = sorted((r["row_id"], r["sample_id"], r["value"]) for r in store.scan_view(spark, f"{d}/out", TrackKey("5hmC", "combined", "combined")).collect())
    assert got == [(1, "A", 8000), (1, "B", 1000), (3, "A", 7000), (3, "B", 2000)]
    back = store.scan_view(spark, f"{d}/out", TrackKey("modifiedC", "combined", "combined"))
    assert back.count() == 7
    arrays.write_matrix(back, 4, ["A", "B"], f"{d}/again.npy")
    assert np.allclose(np.load(f"{d}/again.npy"), np.load(f"{d}/m.npy"), atol=1e-4, equal_nan=True)


# ---------------------------------------------------------------- pieces


def test_regions():
    assert (parse_inclusive_region("chr1:2-6").end, parse_locus("chr1:5").start, parse_half_open_region("chr1:0-1").end) == (7, 5, 1)
    assert parse_inclusive_region("chr1:1,000-2,000", commas=True).start == 1000
    with pytest.raises(ValueError):
        parse_inclusive_region("chr1:1,000-2,000")


def test_encoding_is_half_even_in_single_precision(spark):
    v = [0.0, 33.3, 100.0, 0.125, 0.025, 100.01, -0.1, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in v], "p double").select(encode_percent(F.col("p"))).collect()]
    want = [int(np.rint(np.float32(x) * np.float32(100))) if 0 <= x <= 100 else None for x in v]
    assert got == want


def test_range_join_against_brute_force(spark):
    r = np.random.default_rng(3)
    a = [(f"c{r.integers(2)}", int(s), int(s + r.choice([0, 1, 5, 3000, 90000, 5000000]))) for s in r.integers(0, 6000000, 120)]
    b = [(f"c{r.integers(2)}", int(s), int(s + r.choice([1, 40, 2000, 700000]))) for s in r.integers(0, 6000000, 150)]
    df = lambda x: spark.createDataFrame([(*t, i) for i, t in enumerate(x)], "chrom string, start long, end long, id long")
    pairs = lambda **k: sorted((q["l_id"], q["r_id"], q["overlap"]) for q in ranges.overlap_join(df(a), df(b), **k).collect())
    got = pairs()
    assert pairs(broadcast_rows=0) == got
    want = sorted((i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[2] > x[1] and x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert got == want


def test_points_in_intervals_against_brute_force(spark):
    r = np.random.default_rng(4)
    p = [(i, r.choice(["c0", "c1", None]), int(x)) for i, x in enumerate(r.integers(0, 300000, 200))] + [(200, "c0", None)]
    iv = [(i, f"c{r.integers(2)}", int(s), int(s + r.choice([0, 1, 900, 40000, 250000]))) for i, s in enumerate(r.integers(0, 300000, 60))]
    points = spark.createDataFrame([(i, None if c is None else str(c), x) for i, c, x in p], "row_id long, chrom string, pos0 int")
    spans = spark.createDataFrame(iv, "region_id long, chrom string, start long, end long")
    want = sorted((i, j) for i, c, x in p for j, d, s, e in iv if c == d and x is not None and s <= x < e)
    for k in (50, 0):
        assert sorted((q["p_row_id"], q["i_region_id"]) for q in ranges.points_in_intervals(points, spans, broadcast_rows=k).collect()) == want
    assert {q["row_id"] for q in ranges.points_covered(points, spans).collect()} == {i for i, _ in want}
    assert ranges.points_in_intervals(points, spans.limit(0)).count() == 0 and ranges.points_in_intervals(points.limit(0), spans).count() == 0


def test_segments_of_several_samples_merge_in_any_order(spark):
    s = spark.createDataFrame([("chr1", 50, 60), ("chr1", 1, 5), ("chr1", 5, 8), ("chr2", 1, 2)], "chrom string, start long, end long")
    assert [(r["region_id"], r["start"], r["end"]) for r in segments.merge_intervals(s).orderBy("region_id").collect()] == [(1, 1, 8), (2, 50, 60), (3, 1, 2)]
    assert segments.merge_intervals(s, 42).count() == 2


def test_pca_matches_svd(spark):
    r = np.random.default_rng(1)
    z = r.normal(size=(300, 6))
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    names = [f"s{i}" for i in range(6)]
    cells = spark.createDataFrame([(i, n, float(z[i, k])) for i in range(300) for k, n in enumerate(names)], "row_id long, sample_id string, z double")
    x, ratio = embed.pca_from_gram(embed.gram_matrix(cells, names), 4)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    want = vt.T[:, :4] * s[:4]
    assert np.allclose(np.abs(x), np.abs(want), atol=1e-8) and np.allclose(ratio, (s**2 / (s**2).sum())[:4])


def test_pca_by_passes_matches_svd(spark, monkeypatch):
    monkeypatch.setattr(embed, "GRAM_SAMPLES", 10)
    monkeypatch.setattr(embed, "MAX_BASIS", 40)  # restarts
    r = np.random.default_rng(2)
    z = r.normal(size=(200, 80)) * (r.random((200, 80)) < 0.2)
    names = [f"s{i:02d}" for i in range(80)]
    cells = spark.createDataFrame([(int(i), names[k], float(z[i, k])) for i, k in zip(*np.nonzero(z))], "row_id long, sample_id string, z double")
    x, ratio = embed.pca(cells, names, 4)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(x), np.abs(vt.T[:, :4] * s[:4]), atol=1e-6) and np.allclose(ratio, (s**2 / (s**2).sum())[:4])
    x, ratio = embed.pca(cells.where("false"), names, 4)
    assert x.shape == (80, 4) and np.isnan(x).all() and np.isnan(ratio).all()


def test_pca_pass_is_one_job(spark, monkeypatch):
    monkeypatch.setattr(embed, "GRAM_SAMPLES", 10)
    passes, times = [], embed._times_gram
    monkeypatch.setattr(embed, "_times_gram", lambda rows, v: (passes.append(1), times(rows, v))[1])
    r = np.random.default_rng(3)
    names = [f"s{i:02d}" for i in range(80)]
    cells = spark.createDataFrame([(i, names[k], float(r.normal())) for i in range(90) for k in range(80)], "row_id long, sample_id string, z double")
    spark.sparkContext.setJobGroup("passes", "passes over the cells")
    try:
        embed.pca(cells, names, 3)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("passes"))
    finally:
        for x in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(x, None)
    assert len(passes) > 5 and jobs < 2 * len(passes) + 10  # four tasks made four jobs each


@pytest.mark.parametrize("n_rows", [50, 300])
def test_pca_passes_take_the_smaller_side(spark, monkeypatch, n_rows):
    for name, v in (("GRAM_SAMPLES", 10), ("MAX_BASIS", 30), ("BLOCK", 64), ("SENT", 2000)):  # restarts, many blocks, sums by ranges
        monkeypatch.setattr(embed, name, v, raising=False)
    sizes, find = [], embed.top_eigenpairs
    monkeypatch.setattr(embed, "top_eigenpairs", lambda times, k, n: (sizes.append(k), find(times, k, n))[1])
    r = np.random.default_rng(5)
    z = r.normal(size=(n_rows, 80)) * (r.random((n_rows, 80)) < 0.2)
    z[:, 7] = 0  # a sample without a cell
    names = [f"s{i:02d}" for i in range(80)]
    cells = [(int(i) * 1000 - 7, names[k], float(z[i, k])) for i, k in zip(*np.nonzero(z))]
    x, ratio = embed.pca(spark.createDataFrame(cells, "row_id long, sample_id string, z double"), names, 4)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert sizes == [min(n_rows, 80)] and np.abs(x[7]).max() < 1e-6
    assert np.allclose(np.abs(x), np.abs(vt.T[:, :4] * s[:4]), atol=1e-6) and np.allclose(ratio, (s**2 / (s**2).sum())[:4])
    assert (x[np.abs(x).argmax(axis=0), range(4)] > 0).all()


def test_embedding_queries_hold_the_whole_roster(spark):
    sf = "/root/testdata/sf0.001"
    roster = {r[0] for r in spark.read.parquet(f"{sf}/sample_track.parquet").where("assay = '5mC' AND haplotype = 'combined' AND strand = 'combined' AND sample_id IS NOT NULL").select("sample_id").distinct().collect()}
    assert len(roster) > 12
    for name in ("pca_coordinates", "mahalanobis_outliers", "pca_roster", "mahalanobis_roster"):
        assert {r["sample_id"] for r in queries.QUERIES[name](spark, sf).select("sample_id").collect()} == roster


def test_export_queries_hold_the_whole_roster(spark):
    sf = "/root/testdata/sf0.001"
    n = queries._roster(spark, sf).count()
    cells = queries.QUERIES["export_roster_impute"](spark, sf)
    assert n > 12 and {r["count"] for r in cells.groupBy("row_id").count().collect()} == {n}
    labels = queries.QUERIES["export_roster_labels"](spark, sf)
    assert labels.agg(F.sum("n_observed")).first()[0] == queries._view(spark, sf).count()


def test_category_clusters_find_what_the_whole_misses(spark):
    index = idx(spark, [(i, "chr1", 0, i * 5000) for i in range(3)])
    pairs = [(0, f"a{i}", 9000, 1000) for i in range(9)] + [(1, "b0", 9000, 1000), (1, "b1", 9000, 1000)] + [(1, f"a{i}", 0, 9000) for i in range(2)]
    pairs = spark.createDataFrame(pairs, "row_id long, sample_id string, p int, m int")
    cat = spark.createDataFrame([(f"a{i}", "a") for i in range(9)] + [("b0", "b"), ("b1", "b")], "sample_id string, category string")
    every = strand.hotspot_clusters(strand.best_rows(strand.strand_scores(pairs, 2), 1), index, 1000)
    assert [r["representative_row_id"] for r in every.collect()] == [0]
    best = strand.best_category_rows(strand.category_scores(pairs, cat, 0.02), 1)
    got = strand.ranked_clusters(strand.hotspot_clusters(best, index, 1000, by=("category",)), 5, ("category",))
    assert sorted((r["category"], r["representative_row_id"], r["rank"]) for r in got.collect()) == [("a", 0, 1), ("b", 1, 1)]


def test_strand_command_groups_by_category(spark, two, tmp_path):
    cells = [("5hmC", "combined", s, "chr1", 0, n, v) for n in ("x", "y") for s, v in (("plus", 9000), ("minus", 1000))]
    cells += [("5hmC", "combined", "plus", "chr1", 0, "z", 9000)]
    rows = spark.createDataFrame(cells, "assay string, haplotype string, strand string, chrom string, row_id long, sample_id string, value int")
    cols = [{"assay": "5hmC", "haplotype": "combined", "strand": s, "sample_id": n, "platform": "t", "bundle_path": "t"} for s in ("plus", "minus") for n in ("x", "y", "z")]
    store.write_cohort(rows, cols, f"{tmp_path}/cohort", f"{two}/index")
    put(f"{tmp_path}/meta.tsv", "sample_id\ttissue\nx\tskin\ny\tblood\nz\tblood\n")
    cli.run(["strand", "--cohort", f"{tmp_path}/cohort", "--index", f"{two}/index", "--output", f"{tmp_path}/out", "--fraction", "0.5", "--metadata", f"{tmp_path}/meta.tsv", "--group-by", "tissue"], spark)
    read = lambda n: spark.read.csv(f"{tmp_path}/out/{n}", sep="\t", header=True)
    assert sorted((r["category"], r["rank"]) for r in read("category_clusters").collect()) == [("blood", "1"), ("skin", "1")]
    assert sorted((r["sample_id"], r["is_paired"]) for r in read("sample_profiles").collect()) == [("x", "true"), ("y", "true"), ("z", "false")]


def test_smoothing_covers_every_chromosome(spark):
    sf = "/root/testdata/sf0.001"
    chroms = {r[0] for r in queries.A.observations(spark, sf).join(queries.A.index(spark, sf), "row_id").select("chrom").distinct().collect()}
    got = {r[0] for r in queries.QUERIES["sliding_mean_chromosomes"](spark, sf).select("chrom").distinct().collect()}
    assert len(chroms) > 1 and got == chroms


def test_chi_square_and_outliers():
    assert abs(embed.chi_square_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(embed.chi_square_quantile(0.999, 10) - 29.588298) < 1e-5
    x = np.random.default_rng(0).normal(size=(200, 2))
    x[5] = 40
    d, out = embed.mahalanobis(x)
    assert out[5] and out.sum() <= 3 and np.isfinite(d).all()


def test_sliding_mean_counts_points(spark):
    rows = [("5mC", "c", "c", "s", i, i * 10, v) for i, v in enumerate([0, 2000, 4000, 6000])]
    df = spark.createDataFrame(rows, "assay string, haplotype string, strand string, sample_id string, row_id long, pos0 int, value int")
    got = [(r["pos0_mean"], round(r["fraction"], 9)) for r in matrix.sliding_mean(df, 3).orderBy("pos0_mean").collect()]
    assert got == [(10.0, 0.2), (20.0, 0.4)]
    assert matrix.sliding_mean(df, 5).count() == 4 and matrix.sliding_mean(df, 1).count() == 4


def test_metadata_alignment_prefers_the_better_key(spark):
    s = spark.createDataFrame([("A1",), ("b2",), ("c3",)], "sample_id string")
    m = spark.createDataFrame([("x", "a1", "t1"), ("y", "B2 ", "t2"), ("y", "b2", "t3")], "sample_id string, name string, tissue string")
    got = {r["sample_id"]: r["tissue"] for r in metadata.align(s, m, ["sample_id", "name"]).collect()}
    assert got == {"A1": "t1", "b2": "t2", "c3": None}


def test_streamed_append(spark, tmp_path):
    from cpgloom.streaming.appends import stream_observations

    d = str(tmp_path)
    schema = "assay string, haplotype string, strand string, chrom string, row_id long, sample_id string, value int"
    spark.createDataFrame([("5mC", "c", "c", "chr1", 1, "s", 5), ("5mC", "c", "c", "chr1", 2, "s", -5)], schema).write.parquet(f"{d}/in", mode="append")
    stream_observations(spark, f"{d}/in", schema, f"{d}/out", f"{d}/ck").awaitTermination()
    spark.createDataFrame([("5mC", "c", "c", "chr1", 3, "s", 7)], schema).write.parquet(f"{d}/in", mode="append")
    stream_observations(spark, f"{d}/in", schema, f"{d}/out", f"{d}/ck").awaitTermination()
    assert sorted(r["row_id"] for r in spark.read.parquet(f"{d}/out").collect()) == [1, 3]
