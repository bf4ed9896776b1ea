import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cpgloom.sources.lines import FORMATS, _structure, parse_block, parse_lines, parse_strict, split_strict

S, M, H = FORMATS["sniffcell_index"], FORMATS["methbat_5mc"], FORMATS["methbat_5hmc"]


def meth(score="1.5", name="m", strand=".", cov="9", kind="Total", start="10", end="11", chrom="chr1"):
    return "\t".join([chrom, start, end, name, "7", strand, score, kind, cov, "1", "2", "3", "4", "0.1", "0.2"])


CASES = [
    (S, "chr1\t0\t5\t0\t2", None), (S, '"chr1"\t0\t"5"\t0\t2', None), (S, '"a\tb"\t0\t5\t0\t2', None), (S, '"a""b"\t0\t5\t0\t2', None),
    (S, '"chr1\t0\t5\t0\t2', "quoting"), (S, '"chr1" \t0\t5\t0\t2', "quoting"), (S, 'chr1\t0"\t5\t0\t2', "quoting"), (S, 'chr1\t"', "quoting"),
    (S, "", "column_count"), (S, "chr1\t0\t5\t0", "column_count"), (S, "chr1\t0\t5\t0\t2\t", "column_count"), (S, "chr1,0,5,0,2", "column_count"),
    (S, "\t0\t5\t0\t2", "invalid_value"), (S, '""\t0\t5\t0\t2', "invalid_value"), (S, "chr1\t5\t5\t0\t2", "invalid_value"), (S, "chr1\t-1\t5\t0\t2", "invalid_value"),
    (S, "chr1\t0\t5\t2\t2", "invalid_value"), (S, "chr1\t+0\t5\t0\t2", "invalid_value"), (S, "chr1\t 0\t5\t0\t2", "invalid_value"), (S, "chr1\t0\t5\t0\t٢", "invalid_value"),
    (S, "chr1\t0\t9223372036854775807\t0\t2", None), (S, "chr1\t0\t9223372036854775808\t0\t2", "invalid_value"), (S, "chr1\t0000000000000000000001\t5\t0\t2", None),
    (S, "chr1\t0\t5\t0\t2\r", "invalid_value"), (S, "chr1\t0\t5\t0x1\t2", "invalid_value"), (S, "chr1\t0\t5\t1.0\t2", "invalid_value"), (S, "a\nb\t0\t5\t0\t2", None),
    (M, meth(), None), (M, meth("1e1"), None), (M, meth("+1.5E+1"), None), (M, meth("100.01"), "invalid_value"), (M, meth("nan"), "invalid_value"), (M, meth("-0.1"), "invalid_value"),
    (M, meth("1,5"), "invalid_value"), (M, meth(".5"), "invalid_value"), (M, meth("5."), "invalid_value"), (M, meth("1e999"), "invalid_value"), (M, meth(name="h"), "invalid_value"),
    (M, meth(strand="+"), "invalid_value"), (M, meth(cov="0"), "invalid_value"), (M, meth(cov="65535"), "invalid_value"), (M, meth(kind="total"), "invalid_value"),
    (M, meth(end="12"), "invalid_value"), (M, meth(start="9223372036854775807", end="9223372036854775808"), "invalid_value"), (H, meth(name="h", strand="+"), None),
    (H, meth(name="h", strand="."), "invalid_value"), (H, meth(name="h", strand="-", score="0"), None),
]


@pytest.mark.parametrize("fmt,line,reason", CASES)
def test_strict(fmt, line, reason):
    assert parse_strict(line, fmt)[0] == reason


@pytest.mark.parametrize("fmt", [S, M, H])
def test_blocks_agree_with_strict_parsing(fmt):
    lines = [x for f, x, _ in CASES if f.columns == fmt.columns] * 7
    p = parse_block(lines, fmt)
    rows = {int(i): (None, {c: a[j].as_py() for c, a in p.columns.items()}) for j, i in enumerate(p.valid)} | dict(zip(p.strict, p.outcomes))
    for i, x in enumerate(lines):
        assert rows[i] == parse_strict(x, fmt), x
    assert len(rows) == len(lines) and len(parse_block([], fmt).valid) == 0
    assert [why for why, _ in parse_block(lines, fmt, typed=False).outcomes if why] == [w for w in (parse_strict(x, fmt)[0] for x in lines) if w]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='"\ta0é\n\x1f', max_size=12), max_size=8))
def test_structure_against_the_strict_splitter(lines):
    import pyarrow as pa

    fields, regular, split = _structure(pa.array(["skip", *lines], pa.string()).slice(1))
    for x, n, ok, s in zip(lines, fields, regular, split.to_pylist()):
        want = split_strict(x)
        assert ok == (want is not None and "\x1f" not in x)
        if ok:
            assert n == len(want) and (not x or [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in s.split("\x1f")] == want)


def test_valid_quoted_lines_stay_on_the_fast_path():
    lines = ['"chr1"\t0\t"5"\t0\t2', '"a\tb"\t0\t5\t0\t2', '"a""b"\t0\t5\t0\t2'] * 100
    p = parse_block(lines, S)
    assert len(p.valid) == 300 and not p.strict and p.columns["chrom"].to_pylist()[:3] == ["chr1", "a\tb", 'a"b']


def test_split():
    assert split_strict('a\t"b\t""c"\t') == ["a", 'b\t"c', ""]
    assert split_strict("\t") == ["", ""] and split_strict("") == []


def test_table(spark):
    rows = [(1, "sniffcell_index", "chr1\t0\t5\t0\t2\r"), (2, "sniffcell_index", "# c"), (3, "sniffcell_index", None), (4, None, "x"), (5, "other", "x"), (6, "methbat_5mc", meth()), (6, "methbat_5mc", meth()), (7, "methbat_5mc", "x" * 300000)]
    df = spark.createDataFrame(rows, "line_id long, file_kind string, line_text string").withColumn("reason", __import__("pyspark").sql.functions.lit(1))
    got = sorted(((r["line_id"], r["reason"], r["mod_score"], r["source_row_end"]) for r in parse_lines(df).collect()), key=str)
    assert got == [(1, None, None, 2), (3, "column_count", None, None), (4, "unknown_kind", None, None), (5, "unknown_kind", None, None), (6, None, 1.5, None), (6, None, 1.5, None), (7, "column_count", None, None)]
    assert parse_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        parse_lines(df, keep=("line_id", "reason"))
