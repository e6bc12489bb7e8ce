from pyspark.sql import functions as F

from settlelens.llm.linededup import LINES_SQL, line_table, wide_lines, without_boilerplate, _keyed
from tests.llm.conftest import SMALL, duck, same_rows


def digests(out):
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")).toPandas()


def test_boilerplate_stays_in_its_first_place(spark):
    rows = [(i, f"own line {i}\n  Subscribe now \nother {i}", f"site{i % 8}") for i in range(40)]
    rows += [(100 + i, f"thing {i}\nlocal footer", "site0") for i in range(30)]  # many rows, one site
    out = {r["doc_id"]: r for r in without_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert out[0]["n_removed"] == 0 and out[1]["text"] == "own line 1\nother 1"
    assert out[105]["n_removed"] == 0


def test_near_and_clear_lines_have_exact_spread(spark):
    rows = [(n * 1000 + i, f"line {n}", f"s{i}") for n in (4, 5, 6, 7, 300) for i in range(n)]
    keyed = _keyed(spark.createDataFrame(rows, "doc_id int, text string, source string"), "doc_id", "text", "source")
    assert wide_lines(line_table(keyed)).count() == 3


def test_edges(edges):
    out = without_boilerplate(edges, min_sites=2).collect()
    assert len(out) == edges.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[3]["text"] == "" and by_id[5]["text"] == " \t\n " and by_id[1]["n_removed"] == 0 and by_id[2]["n_removed"] == 1


def test_empty(nothing):
    assert without_boilerplate(nothing).count() == 0


def test_agrees_with_sql(spark):
    got = digests(without_boilerplate(spark.read.parquet(f"{SMALL}/documents.parquet")))
    same_rows(got, duck(LINES_SQL, {"documents": f"{SMALL}/documents.parquet"}))
