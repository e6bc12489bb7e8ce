from settlelens.llm.mixing import mixed, mixing_sql, rake
from settlelens.llm.queries import op3_mixing
from tests.llm.conftest import SMALL, duck


def test_margins_are_met(spark):
    rows = [(s, lang, t, 1000 * (i + 1)) for i, (s, lang, t) in enumerate((s, g, t) for s in "abc" for g in "xy" for t in "pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    goal = {
        "source": spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5), ("absent", 1.0)], "value string, share double"),
        "lang": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "value string, share double"),
        "topic": spark.createDataFrame([("p", 0.4), ("q", 0.6)], "value string, share double"),
    }
    out = rake(cells, goal, budget=0.3, sweeps=15).toPandas()
    assert abs(out.weight.sum() - 0.3 * out.tokens.sum()) < 1
    shares = out.groupby("source").weight.sum() / out.weight.sum()
    assert all(abs(shares[s] - g) < 1e-3 for s, g in (("a", 0.2), ("b", 0.3), ("c", 0.5)))
    assert (out.weight <= out.tokens).all()


def test_edges(edges):
    out = mixed(edges, sweeps=2)
    rows = out.collect()
    assert len(rows) == edges.count() and set(edges.columns) <= set(out.columns)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["mix_source"] == "" and by_id[3]["mix_probability"] == 0.0 and by_id[3]["mix_kept"] is False
    assert all(0 <= r["mix_probability"] <= 1 for r in rows)


def test_empty(nothing):
    assert mixed(nothing, sweeps=1).count() == 0


def test_agrees_with_sql(spark):
    got = op3_mixing(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(mixing_sql(), {"documents": f"{SMALL}/documents.parquet"}).sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert (got[c] == want[c]).all() if c != "probability" else (got[c] - want[c]).abs().max() < 2e-6
    assert got.kept.any() and not got.kept.all()
