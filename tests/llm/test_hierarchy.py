from settlelens.llm.hierarchy import hierarchy_sql, quality_scores
from tests.llm.conftest import SMALL, duck


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality_scores(docs, seen).join(held, "doc_id").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.25


def test_sparse_sites_lean_on_the_level_above(spark):
    clean, junk = "some plain words about the weather of today and of tomorrow in town", "WIN! NOW! $$$ %%% ### BUY! IT! ALL! &&& ***"
    rows = [(i, clean if i % 2 else junk, "big" if i < 400 else "bad", "p") for i in range(600)]
    rows += [(600 + i, junk, "bad", "q") for i in range(200)] + [(900, clean, "tiny", "p")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id int, quality int")
    out = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    assert out[701]["path_posterior"] < out[401]["path_posterior"] < out[1]["path_posterior"] + 0.2
    mean = sum(r["host_posterior"] for r in out.values()) / len(out)
    assert abs(out[900]["host_posterior"] - mean) < 0.25


def test_edges(edges, no_labels):
    rows = quality_scores(edges, no_labels).collect()
    assert len(rows) == edges.count() and all(0 <= r["probability"] <= 1 for r in rows)


def test_empty(nothing, no_labels):
    assert quality_scores(nothing, no_labels).count() == 0


def test_agrees_with_sql(spark):
    tables = {t: f"{SMALL}/{t}.parquet" for t in ("documents", "labels")}
    got = quality_scores(*(spark.read.parquet(p) for p in tables.values())).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck(hierarchy_sql(), tables).sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert (got[c] == want[c]).all() if c in ("doc_id", "kept") else (got[c] - want[c]).abs().max() < 2e-6
