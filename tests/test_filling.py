from pyspark.sql import functions as F

from cpgloom.operators.filling import FillTarget, fill_missing, fill_tracks, filled_cells

TRACK = "obs_id long, batch_id long, sample_id string, platform string, assay string, haplotype string, strand string, row_id long, value_u16 int, coverage int, loaded_at timestamp"


def track(spark, rows):
    return spark.createDataFrame([(i, b, s, p, "5mC", "combined", "combined", r, v, c, None) for i, b, s, p, r, v, c in rows], TRACK)


def test_backs_off_from_fine_to_coarse(spark):
    t = track(spark, [
        (1, 1, "a", "ONT ", 7, None, 5), (2, 1, "a", "ont", 7, 300, 6), (3, 1, "b", "?", 7, 65535, 0), (4, 1, "b", None, 8, 10, 9),
        (5, 1, "c", "methbat", 7, 100, 70000), (6, 2, "c", "pacbio", 7, -1, 5), (7, None, "d", None, 7, None, None),
    ])
    got = {r["obs_id"]: r for r in fill_tracks(t).collect()}
    assert len(got) == 7
    assert (got[1]["value_u16_filled"], got[1]["value_u16_fill_level"]) == (300, 1)  # same sample, same place
    assert (got[3]["value_u16_filled"], got[3]["value_u16_fill_level"]) == (100, 2)  # lower median of 100 and 300
    assert (got[3]["coverage_filled"], got[3]["coverage_fill_level"]) == (5, 2)
    assert (got[1]["platform_filled"], got[1]["platform_fill_level"]) == ("ont", None)
    assert got[3]["platform_filled"] is None and got[3]["platform_fill_level"] is None
    assert got[6]["value_u16_filled"] is None  # alone in its batch
    assert got[7]["value_u16_filled"] is None and got[7]["coverage_filled"] is None
    found = {tuple(r) for r in filled_cells(t).collect()}
    assert found == {(1, "value_u16"), (3, "value_u16"), (3, "coverage"), (5, "coverage")}


def test_repeated_rows_are_one_case_and_all_filled(spark):
    t = track(spark, [(1, 1, "a", "ont", 7, None, 5), (1, 1, "a", "ont", 7, None, 5), (2, 1, "b", "ont", 7, 4, 5)])
    assert fill_tracks(t).where("value_u16_fill_level = 2").count() == 2
    assert [tuple(r) for r in filled_cells(t).collect()] == [(1, "value_u16")]


def test_empty_table(spark):
    assert fill_tracks(track(spark, [])).count() == 0
    assert filled_cells(track(spark, [])).count() == 0


def test_support_ties_and_clashing_names(spark):
    df = spark.createDataFrame(
        [("g", "x", "q", "old"), ("g", "y", "q", "old"), ("g", None, "q", "old"), ("g", None, "w", "old"), ("h", "z", "q", "old")],
        "c0 string, u0_ string, row string, u0__filled string",
    )
    t = FillTarget("u0_", F.col("u0_"), "mode", [["c0", "row"], ["c0"]], (3, 1))
    got = sorted([tuple(r) for r in fill_missing(df, [t]).select("c0", "row", "u0__filled", "u0__fill_level").collect()], key=str)
    assert ("g", "q", "x", 2) in got and ("g", "w", "x", 2) in got  # two of three at the fine level, tie to the smaller
    assert ("h", "q", "z", None) in got and len(got) == 5
