import uuid

from settlelens.llm.exact import DigestIndex, exact_duplicates, text_digests
from settlelens.llm.queries import OP7_SQL
from tests.llm.conftest import same_rows, duck


def test_edges_agree_with_sql(edges):
    found = exact_duplicates(edges).toPandas()
    pdf = edges.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    same_rows(found, duck(OP7_SQL, {"documents": pdf}))


def test_empty(nothing):
    assert exact_duplicates(nothing).count() == 0


def test_index_lets_known_texts_through_once(spark):
    index = DigestIndex(spark, f"ix_{uuid.uuid4().hex}", buckets=4)
    first = text_digests(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string"))
    later = text_digests(spark.createDataFrame([(9, "a"), (8, "c")], "doc_id bigint, text string"))
    index.add(first)
    index.add(later)
    assert index.read().count() == 3
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in index.verdicts(later).collect()}
    assert got == {9: (3, False), 8: (8, True)}
    plan = later.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
