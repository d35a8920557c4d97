import pytest

from strandlake.sources.gene_lines import failed_lines, gene_records, read_gene_lines

GOOD = ["chr1", "100", "200", "g", "5", "+", "110", "190", "0", "2", "10,20,", "0,80,"]


def line(**change):
    f = list(GOOD)
    for k, v in change.items():
        f[int(k[1:])] = v
    return "\t".join(f)


CASES = [
    (line(), None),
    (line() + "\r", None),
    (line() + "\r\r", "integer"),
    (line(f3='"a\tb ""c"""'), None),
    (line(f1='"100"'), None),
    (line(f3='a"b'), None),
    (line(f3='"ab'), "quoting"),
    (line(f3='"ab"x'), "quoting"),
    (line(f3='""'), None),
    ("chr1\t1", "columns"),
    (line() + "\t", "columns"),
    (line(f1="1.0"), "integer"),
    (line(f1="+100"), "integer"),
    (line(f1=" 100"), "integer"),
    (line(f4="9223372036854775807"), None),
    (line(f4="9223372036854775808"), "integer"),
    (line(f4="-9223372036854775808"), None),
    (line(f4="-9223372036854775809"), "integer"),
    (line(f4="0000000000000000000000000000012"), None),
    (line(f4="-0"), None),
    (line(f4="٣"), "integer"),
    (line(f10="", f11="", f9="0"), "integer"),
    (line(f10="10,,20"), "integer"),
    (line(f10="10,20,,"), "integer"),
    (line(f5="x", f1="x"), "integer"),
    (line(f5="x"), "strand"),
    (line(f5="++"), "strand"),
    (line(f9="3"), "blocks"),
    (line(f10="10"), "blocks"),
    (line(f1="200"), "range"),
    (line(f1="-5"), "range"),
    (line(f6="90"), "range"),
    (line(f7="201"), "range"),
    (line(f10="0,20"), "range"),
    (line(f11="-1,80"), "range"),
    (line(f11="0,81"), "range"),
    (line(f10="9223372036854775807,1", f11="9223372036854775807,1"), "range"),
    (line(f3="x" * 200_000), None),
    (line(f3='"' + 'a""\t' * 50_000 + '"'), None),
]
NONE = [None, "", " \t ", "\r", "# x", "#", "track name=1", "browser x", "  \t\r"]


def test_reasons(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(1000 + i, t) for i, t in enumerate(NONE)]
    got = {r["line_id"]: r["reason"] for r in read_gene_lines(spark.createDataFrame(rows, "line_id int, raw_line string")).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}


def test_first_broken_field(spark):
    df = spark.createDataFrame([(1, line(f6="x", f11="y")), (2, line(f5="?"))], "line_id int, raw_line string")
    assert {r["line_id"]: r["broken_field"] for r in failed_lines(df).collect()} == {1: "cds_start", 2: "strand"}


def test_typed_records_and_clashing_names(spark):
    df = spark.createDataFrame([(7, line(f3='"n ""1"""'), "mine", "also", 1)], "line_id int, raw_line string, name string, Reason string, in_name int")
    r = gene_records(df).collect()[0].asDict()
    assert (r["chrom"], r["chrom_start"], r["name"], r["block_sizes"], r["block_starts"]) == ("chr1", 100, 'n "1"', [10, 20], [0, 80])
    assert r["in_in_name"] == "mine" and r["in_Reason"] == "also" and r["in_name"] == 1


@pytest.mark.parametrize("n", [0])
def test_no_lines(spark, n):
    assert read_gene_lines(spark.createDataFrame([], "line_id int, raw_line string")).count() == n
