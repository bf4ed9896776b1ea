"""Commands, input resolution, definitions, metadata and report operators on small inputs."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cpgloom import cli
from cpgloom.functions import codec
from cpgloom.functions.codec import TrackKey
from cpgloom.operators import embed, matrix, metadata, reports, segments, validate
from cpgloom.plans import commands
from cpgloom.sources import arrays, beds, definitions, fasta, inputs, store
from cpgloom.streaming.appends import running_counts
from test_files import idx, modkit, put, tsv

C = TrackKey("5mC", "combined", "combined")
OBS = "assay string, haplotype string, strand string, chrom string, row_id long, sample_id string, value int"


def cells(spark, table, assay="5mC", strand="combined", chrom="chr1"):
    return spark.createDataFrame([(assay, "combined", strand, chrom, r, s, v) for s, vs in table.items() for r, v in enumerate(vs) if v is not None], OBS)


def columns(names, assay="5mC", strands=("combined",)):
    return [{"assay": assay, "haplotype": "combined", "strand": st, "sample_id": n, "platform": "t", "bundle_path": ""} for st in strands for n in names]


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("cohort"))
    idx(spark, [(i, "chr1", 0, 10 * i) for i in range(8)]).write.parquet(f"{d}/index")
    r = np.random.default_rng(0)
    table = {f"s{k}": [int(v) for v in r.integers(0, 10001, 8)] for k in range(6)}
    table["s5"][7] = None
    store.write_cohort(cells(spark, table), columns(table), f"{d}/c", "i")
    return d, table


def test_pca_of_a_cohort_writes_its_tables(spark, cohort, tmp_path):
    d, table = cohort
    out = str(tmp_path / "p")
    meta = put(f"{tmp_path}/m.tsv", "sample_id\ttissue_name\n" + "".join(f"{s}\tskin\n" for s in table))
    cli.run(["pca", "--cohort", f"{d}/c", "--index", f"{d}/index", "--output", out, "--fraction", "1", "--min-present", "0.5", "--n-pcs", "3", "--outlier-pcs", "2", "--metadata", meta], spark)
    t = pd.read_csv(f"{out}/embedding.tsv", sep="\t")
    assert list(t["sample_id"]) == list(table) and {"PC1", "PC3", "mahalanobis_pc", "is_outlier", "tissue_name"} <= set(t.columns)
    assert json.load(open(f"{out}/params.json"))["n_rows"] == 8
    assert len(pd.read_csv(f"{out}/outlier_report.tsv", sep="\t")) == 6 and len(pd.read_csv(f"{out}/inliers.tsv", sep="\t")) == 6 and os.path.exists(f"{out}/outliers_only.tsv")
    z = pd.DataFrame(table, dtype=float).to_numpy() / 10000
    z = np.nan_to_num((z - np.nanmean(z, 0)) / np.nanstd(z, 0, ddof=1))
    s = np.linalg.svd(z)[1]
    assert np.allclose(np.sqrt((t[["PC1", "PC2", "PC3"]].to_numpy() ** 2).sum(0)), s[:3], atol=1e-6)
    with pytest.raises(RuntimeError):
        commands.pca(spark, f"{d}/c", f"{d}/index", out, min_present=0.5, fraction=1.0, umap_options={})


def test_pca_by_region_means_keeps_empty_regions_and_full_precision(spark, cohort, tmp_path):
    d, table = cohort
    bed = put(f"{tmp_path}/r.bed", "chr1\t0\t25\nchr1\t30\t60\nchr1\t500\t600\nchr1\t60\t71\n")
    out = str(tmp_path / "p")
    commands.pca(spark, f"{d}/c", f"{d}/index", out, min_present=1.0, bed=bed, aggregate=True, n_pcs=10)
    t = pd.read_csv(f"{out}/region_avg.tsv", sep="\t")
    assert list(t["n_cpgs"]) == [3, 3, 2, 0] and t.iloc[3][list(table)].isna().all()
    want = [np.mean(table["s0"][:3]) / 1e4, np.mean(table["s0"][3:6]) / 1e4, np.mean(table["s0"][6:]) / 1e4]
    assert np.allclose(t["s0"][:3], want, atol=1e-9) and np.isclose(t["s5"][2], table["s5"][6] / 1e4)
    z = t[list(table)][:3].to_numpy()
    s = np.linalg.svd((z - z.mean(0)) / z.std(0, ddof=1))[1]
    e = pd.read_csv(f"{out}/embedding.tsv", sep="\t")
    assert np.allclose(np.sqrt((e[["PC1", "PC2"]].to_numpy() ** 2).sum(0)), s[:2], atol=1e-6) and json.load(open(f"{out}/params.json"))["n_pcs"] == 3


def test_pca_of_a_matrix_folder_and_refusal_of_a_bundle(spark, cohort, tmp_path):
    d, _ = cohort
    m = str(tmp_path / "m")
    os.makedirs(m)
    np.save(f"{m}/5mC.npy", np.array([[0.10, 0.12, 0.18, 0.20], [0.11, 0.13, 0.17, 0.22], [0.95, 0.96, 0.94, 0.98]]))
    put(f"{m}/columns.tsv", "col_idx\tmdb_dir\n1\t/x/b\n0\t/x/a/\n2\t/x/c\n3\t/x/d\n")
    commands.pca(spark, m, None, str(tmp_path / "o"), fraction=1.0, n_pcs=2, outlier_pcs=2, alpha=0.99)
    assert list(pd.read_csv(tmp_path / "o/embedding.tsv", sep="\t")["sample_id"]) == ["a", "b", "c", "d"]
    store.write_bundle(cells(spark, {"s": [1, 2]}).drop("sample_id"), f"{tmp_path}/b", "s", "ont", "i")
    for path, kw in ((f"{tmp_path}/b", {}), (m, {"bed": "x"}), (str(tmp_path), {})):
        with pytest.raises(ValueError):
            commands.pca(spark, path, None, str(tmp_path / "o2"), **kw)


HEAD = "#chrom\tchrom_start\tchrom_end\tname\teffect_size\tcohen_h\tscore\n"


def test_segments_command(spark, tmp_path):
    d = str(tmp_path)
    put(f"{d}/in/a.segments.bed", HEAD + tsv(("chr1", 50, 60, "different", 0.5, 1, 1), ("chr1", 1, 5, "different", 0.1, 1, 1), ("chrX", 1, 9, "different", 1, 1, 1), ("chr1", 100, 200, "same", 0.9, 1, 1)))
    put(f"{d}/in/sub/b.segments.bed.gz", HEAD + tsv(("chr1", 4, 8, "different", 0.3, 1, 1), ("chr1", 55, 65, "different", "nan", 1, 1)))
    put(f"{d}/in/c.segments.bed", HEAD + tsv(("chr1", 2, 3, "different", 0.7, 1, 1)))
    meta = put(f"{d}/m.tsv", "id\ttissue_name\nc\tskin left\na\tlung\nb\t\n")
    cli.run(["segments", "--inputs", f"{d}/in", "--output", f"{d}/out", "--exclude-sex", "--min-samples", "1", "--n-pcs", "2", "--metadata", meta], spark)
    assert list(pd.read_csv(f"{d}/out/embedding.tsv", sep="\t")["sample_id"]) == ["a", "c", "b"]
    got = spark.read.csv(f"{d}/out/regions", sep="\t", header=True).orderBy("region").collect()
    assert [(r["region"], r["chrom"], r["start"], r["end"], r["n_support"]) for r in got] == [("DMR000001", "chr1", "1", "8", "3"), ("DMR000002", "chr1", "50", "65", "2")]
    own = pd.read_csv(f"{d}/out/metadata.tsv", sep="\t")
    assert list(own["sample_id"]) == ["a", "c", "b"] and list(own["tissue_broad"].fillna("")) == ["Respiratory", "Skin / Connective", ""]
    commands.segments_pca(spark, inputs.find_segments([f"{d}/in"]), f"{d}/out2", mode="metric", min_samples=2)
    assert os.path.exists(f"{d}/out2/params.json") and not os.path.exists(f"{d}/out2/metadata.tsv")
    put(f"{d}/in/sub/a.segments.bed", HEAD)
    with pytest.raises(ValueError):
        inputs.find_segments([f"{d}/in"])
    with pytest.raises(FileNotFoundError):
        inputs.find_segments([f"{d}/nothing"])


def test_strand_bias_counts_and_files(spark, tmp_path):
    d = str(tmp_path)
    idx(spark, [(i, "chr1", 0, 1000 * i) for i in range(4)]).write.parquet(f"{d}/index")
    plus, minus = {"x": [9000, 9000, 100, 5000], "y": [8000, 9500, 200, None]}, {"x": [1000, 1000, 9000, 5000], "y": [1000, 500, 9000, 4000]}
    obs = cells(spark, plus, "5hmC", "plus").unionByName(cells(spark, minus, "5hmC", "minus"))
    store.write_cohort(obs, columns(["x", "y"], "5hmC", ("plus", "minus")), f"{d}/c", "i")
    out = commands.strand_bias(spark, f"{d}/c", f"{d}/index", fraction=1.0)
    got = [(r["rank"], r["direction"], r["cluster_start"], r["cluster_end"], r["n_cpgs"], r["representative_row_id"]) for r in out["clusters"].orderBy("rank").collect()]
    assert got == [(1, "minus>plus", 2000, 2001, 1, 2), (2, "plus>minus", 0, 1001, 2, 1)]
    assert {r["sample_id"]: r["n_paired"] for r in out["samples"].collect()} == {"x": 4, "y": 3}
    meta = put(f"{d}/m.tsv", "sample_id\tgroup\nx\tA b/c\ny\tB\n")
    cli.run(["strand", "--cohort", f"{d}/c", "--index", f"{d}/index", "--output", f"{d}/out", "--fraction", "1", "--metadata", meta, "--group-by", "group"], spark)
    bed = open(f"{d}/out/hotspots_global.bed").read().splitlines()
    assert bed[1].split("\t")[:4] == ["chr1", "0", "1001", "H2: chr1:1-1,001"]
    assert os.path.exists(f"{d}/out/hotspots_group_A_b_c.bed") and os.path.exists(f"{d}/out/hotspots_group_B.tsv")


def test_definitions(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    put(f"{d}/blocks.tsv.gz", tsv(("chr2", 2, 5, 0, 2), ("chr2", 21, 25, 2, 4), ("chr1", 3, 9, 5, 6)))
    cli.run(["define", "--method", "loyfer", "--table", f"{d}/blocks.tsv.gz", "--output", f"{d}/lib/loyfer.definition", "--assembly", "toy"], spark)
    iv, note = definitions.read_definition(spark, definitions.find_definition("loyfer", f"{d}/lib"))
    assert [tuple(r) for r in iv.orderBy("chrom_ord", "start").collect()] == [("chr2", 0, 2, 5), ("chr2", 0, 21, 25), ("chr1", 1, 3, 9)]
    assert note["left_shift"] == 1 and note["assembly"] == "toy"
    monkeypatch.setenv(definitions.ENVIRONMENT, f"{d}/lib")
    assert definitions.find_definition("loyfer") == f"{d}/lib/loyfer.definition"
    with pytest.raises(FileNotFoundError):
        definitions.find_definition("decode")
    with open([f"{d}/lib/loyfer.definition/intervals/{f}" for f in os.listdir(f"{d}/lib/loyfer.definition/intervals") if f.startswith("part")][0], "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        definitions.read_definition(spark, f"{d}/lib/loyfer.definition")
    for bad in ([("c", 0, 5, 5)], [("c", 0, 1, 5), ("c", 0, 1, 5)], [("c", 0, -1, 5)], []):
        with pytest.raises(ValueError):
            definitions.write_definition(spark.createDataFrame(bad, "chrom string, chrom_ord int, start long, end long"), f"{d}/bad", "x")


def test_group_by_a_stored_definition(spark, tmp_path):
    d = str(tmp_path)
    idx(spark).write.parquet(f"{d}/index")
    prof = {"s1": [1000, 2000, 9000, 8000, 7000], "s2": [2000, 3000, 8000, 7000, 6000]}
    store.write_cohort(cells(spark, prof), columns(prof), f"{d}/c", "i")
    put(f"{d}/blocks.tsv", tsv(("chr1", 2, 5, 0, 2), ("chr1", 21, 25, 2, 4), ("chr1", 26, 27, 4, 5)))
    cli.run(["define", "--method", "loyfer", "--table", f"{d}/blocks.tsv", "--output", f"{d}/lib/loyfer.definition"], spark)
    cli.run(["group", "--cohort", f"{d}/c", "--index", f"{d}/index", "--output", f"{d}/g", "--method", "loyfer", "--definitions", f"{d}/lib", "--write-table"], spark)
    t = pd.read_csv(f"{d}/g/groups.tsv.gz", sep="\t")
    assert list(t["start"]) == [1, 20] and list(t["reference_start"]) == [2, 21] and json.load(open(f"{d}/g/grouping_summary.json"))["sha256"]
    cli.run(["matrix", "--cohort", f"{d}/g", "--output", f"{d}/m"], spark)
    assert np.allclose(np.load(f"{d}/m/matrix.npy"), [[0.15, 0.25], [0.85, 0.75]])
    assert pd.read_csv(f"{d}/m/matrix.index.gz", sep="\t", header=None).to_numpy().tolist() == [["chr1", 2, 5, 0, 2], ["chr1", 21, 25, 2, 4]]
    assert open(f"{d}/m/samples.txt").read() == "s1\ns2\n"
    with pytest.raises(ValueError):
        commands.export_matrix(spark, f"{d}/c", f"{d}/m2")
    with pytest.raises(FileExistsError):
        commands.group(spark, f"{d}/c", f"{d}/index", f"{d}/g", "decode")


def test_dense_matrices(spark, tmp_path):
    d = str(tmp_path)
    idx(spark).write.parquet(f"{d}/index")
    a = put(f"{d}/a.bed", modkit(("chr1", 1, "m", ".", 9, 80), ("chr1", 1, "h", ".", 9, 10), ("chr1", 20, "m", ".", 1, 50)))
    put(f"{d}/list.txt", f"# files\nA\t{a}\n\nB\t{d}/missing.bed\n")
    with pytest.warns(UserWarning, match="missing.bed"):
        out = commands.dense_matrices(spark, f"{d}/index", f"{d}/list.txt", f"{d}/m", percent=True)
    m = np.load(out[0])
    assert m.shape == (5, 2) and np.isnan(m[:, 1]).all() and m[0, 0] == 80 and m[2, 0] == 50 and np.isnan(m[1, 0]) and np.load(out[1])[0, 0] == 10


def test_inputs(tmp_path, spark):
    d = str(tmp_path)
    for n in ("a", "b"):
        store.write_bundle(cells(spark, {"s": [1]}).drop("sample_id"), f"{d}/lib/{n}", n, "ont", "i")
    store.write_cohort(cells(spark, {"s": [1]}), columns(["s"]), f"{d}/c", "i")
    assert inputs.find_stores([f"{d}/lib"]) == ([f"{d}/lib/a", f"{d}/lib/b"], None) and inputs.find_stores([f"{d}/c"]) == ([], f"{d}/c")
    for bad in ([f"{d}/c", f"{d}/lib/a"], [f"{d}/x"]):
        with pytest.raises((ValueError, FileNotFoundError)):
            inputs.find_stores(bad)
    put(f"{d}/s.txt", "y\n#no\nx\n")
    assert inputs.split_values(["x, z", "z"], f"{d}/s.txt") == ["x", "z", "y"] and inputs.expand([put(f"{d}/l.txt", f"{d}/c\n{d}/c\n")]) == [f"{d}/c"]


def test_metadata_operators(spark):
    s = spark.createDataFrame([("SMHT001-a-b-c-d-e-f-1", 0), ("SMHT002-a-b-c-d-e-f", 1)], "sample_id string, col_ord int")
    m = spark.createDataFrame([(1, "x", "/d/SMHT001-a-b-c-d-e-9.bam", "t1"), (2, "x", "/d/SMHT001-a-b-c-d-e-8.bam", "t2"), (3, "y", None, "t3")], "line int, sample string, id string, tissue string")
    got = {r["sample_id"]: r["tissue"] for r in metadata.align_roots(s, m, ["sample", "id"], "line").collect()}
    assert got == {"SMHT001-a-b-c-d-e-f-1": "t1", "SMHT002-a-b-c-d-e-f": None}
    assert {r["tissue"] for r in metadata.align_roots(s, m, ["sample"], "line").collect()} == {None}
    two = spark.createDataFrame([("b", "B"), ("a", "A"), ("q", "Q")], "id string, v string")
    order = spark.createDataFrame([("a", 0), ("b", 1)], "sample_id string, col_ord int")
    assert [r["v"] for r in metadata.select_rows(two, order).orderBy("col_ord").collect()] == ["A", "B"]
    assert metadata.select_rows(two.where("id = 'a'"), order) is None and metadata.select_rows(two.unionByName(two), order) is None
    with pytest.raises(ValueError):
        metadata.align_by_position(order, two, "v")
    t = spark.createDataFrame([("long-name-1", "s1", "p"), ("long-name-2", "s2", "p")], "id string, sample_id_y string, sample_id string")
    assert metadata.shortest_unique_id(t) == "sample_id_y" and metadata.shortest_unique_id(t.drop("sample_id_y")) == "id" and metadata.shortest_unique_id(t.limit(0)) == "id"
    v = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (2, 0, "c"), (2, 1, "b")], "view_ord int, col_ord int, sample_id string")
    assert [r["sample_id"] for r in metadata.union_rosters(v).orderBy("col_ord").collect()] == ["b", "a", "c"]
    b = spark.createDataFrame([("Skin x", "mine"), ("Brain dermal fibroblast", " "), ("dermal fibroblast", None), (" ", None), (None, None)], "tissue_name string, tissue_broad string")
    assert [r["tissue_broad"] for r in metadata.fill_broad_tissue(b).collect()] == ["mine", "Brain / CNS", "Skin / Connective", None, None]
    assert metadata.fill_broad_tissue(order).columns == order.columns


def test_report_choices(spark):
    m = spark.createDataFrame([(f"s{i}", f"d{i}", "ab"[i % 2], str(i), "k") for i in range(60)], "sample_id string, display_id string, sex string, code string, one string")
    assert metadata.category_columns(m) == ["sex"] and reports.color_columns(m) == ["display_id", "sex"]
    assert reports.default_color(m) == "sex" and reports.default_color(m, "code") == "code" and reports.default_color(m.select("display_id")) == "display_id"
    assert reports.series_mode(m, "sex") == "groups" and reports.series_mode(m.limit(59), "sex") == "samples" and reports.series_mode(m, "one") == "samples" and reports.series_mode(m, "display_id") == "samples"
    assert [tuple(r) for r in reports.color_map(m, "sex", 1).orderBy("value").collect()] == [("a", 0), ("b", 0)]
    assert [reports.pick_hue(["id", "sex"], x, y, z) for x, y, z in ((None, None, None), (["id", "sex"], None, None), (["id"], None, None), (["sex"], "metadata", "id"), (["sex"], "none", None))] == ["id", "sex", "id", "id", None]
    with pytest.raises(ValueError):
        reports.default_color(m, "nothing")
    e = spark.createDataFrame([("a", 1.0, False), ("b", 9.0, True), ("c", 20.0, True)], "sample_id string, distance double, is_outlier boolean")
    t = reports.outlier_tables(e)
    assert [r["sample_id"] for r in t["outliers_only"].collect()] == ["c", "b"] and t["inliers"].count() == 1 and t["outlier_report"].count() == 3


def test_grouped_profile_averages_before_smoothing(spark):
    p = spark.createDataFrame([("5mC", "c", "c", s, i, 10 * i, v) for s, vs in {"x": [0, 4000, 8000], "y": [2000, None, 0]}.items() for i, v in enumerate(vs) if v is not None], "assay string, haplotype string, strand string, sample_id string, row_id long, pos0 int, value int")
    cat = spark.createDataFrame([("x", "g"), ("y", "g ")], "sample_id string, category string")
    got = [(r["category"], r["position"], round(r["percent"], 6)) for r in reports.grouped_profile(p, cat, 2, 2).orderBy("position").collect()]
    assert got == [("g", 6.0, 25.0), ("g", 16.0, 40.0)]
    assert {r["category"] for r in reports.grouped_profile(p, cat.where("sample_id = 'x'").withColumn("category", F.lit(" ")), 2).collect()} == {"NA"}
    table = reports.profile_table(matrix.sliding_mean(p, 2), cat)
    assert {"x_pos1_mean", "percent", "category"} <= set(table.columns) and table.count() == 4


def test_validators(spark):
    ok = idx(spark)
    validate.refuse(validate.index_violations(ok), "index")
    bad = idx(spark, [(0, "a", 0, 5), (1, "a", 0, 5), (3, "a", 0, -1), (4, "b", 1, 1), (5, "b", 2, 9)])
    assert validate.index_violations(bad).first().asDict() == {"n_rows": 5, "n_negative": 1, "n_unordered": 2, "n_gaps": 1, "n_two_orders": 1}
    iv = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 4, 4), ("b", -1, 2), ("b", None, 3)], "chrom string, start long, end long")
    assert validate.interval_violations(iv).first().asDict() == {"n_rows": 5, "n_negative": 2, "n_empty": 2, "n_repeated": 1, "n_overlapping": 2}
    t = spark.createDataFrame([("s", 0, 5, 9), ("s", 0, 5, 9), ("s", 9, 10001, 1), ("s", 1, None, -1)], "sample_id string, row_id long, value int, coverage int")
    r = validate.track_violations(t, 5, ("sample_id",)).first()
    assert (r["n_cells"], r["n_bad_value"], r["n_bad_coverage"], r["n_off_index"], r["n_repeated"]) == (4, 2, 1, 1, 1)
    for x in (bad, ok.limit(0)):
        with pytest.raises(ValueError):
            validate.refuse(validate.index_violations(x), "index")


def test_pieces(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "row_id")
    one, two = (sorted(r["row_id"] for r in matrix.sample_rows(rows.repartition(k), 0.2, 7).collect()) for k in (1, 5))
    assert len(one) == 20 and one == two != sorted(r["row_id"] for r in matrix.sample_rows(rows, 0.2, 8).collect())
    t = spark.createDataFrame([("k", "CGxCG"), ("k", "CG"), (None, None), (None, "xCG")], "k string, t string")
    assert sorted(map(str, fasta.motif_positions(t, "k", "t", "CG").collect())) == sorted(map(str, spark.createDataFrame([("k", 0), ("k", 3), ("k", 0), (None, 1)], "k string, pos0 long").collect()))
    r = spark.createDataFrame([("chrX", 1, 2), ("chr2", 5, 6), ("chr2", 1, 2), ("Y", 1, 2)], "chrom string, start long, end long")
    assert [(x["region_id"], x["start"]) for x in segments.drop_sex_chromosomes(segments.number_regions(r)).orderBy("region_id").collect()] == [(1, 1), (2, 5)]
    obs = spark.createDataFrame([("5mC", "c", "c", "s", "2024-01-01 10:00:00"), ("5mC", "c", "c", "s", "2024-01-01 11:00:00"), ("5mC", "c", "c", "s", "2024-01-02 01:00:00")], "assay string, haplotype string, strand string, sample_id string, loaded_at string")
    assert sorted(x["n_observed"] for x in running_counts(obs).collect()) == [1, 2]
    obs.write.parquet(f"{tmp_path}/in")
    q = running_counts(spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(x["n_observed"] for x in spark.table("running").collect()) == [1, 2]
    assert beds.discover_modkit(put(f"{tmp_path}/x.bed", ""))[0].tag == "combined" and codec.sample_id_from_path("/a/b.segments.bed.gz") == "b"
    c = embed.standardised_fractions(spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7), (1, "b", 0.1)], "row_id long, sample_id string, fraction double"))
    assert sorted(round(x["z"], 6) for x in c.collect()) == [-0.707107, 0.1, 0.707107]
    arrays.write_matrix(spark.createDataFrame([(1, "b", 5000)], "row_id long, sample_id string, value int"), 2, ["a", "b"], f"{tmp_path}/m.npy")
    assert np.array_equal(np.load(f"{tmp_path}/m.npy"), np.array([[np.nan, np.nan], [np.nan, 0.5]], np.float32), equal_nan=True)
