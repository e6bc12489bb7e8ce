"""Number text, panel and manifest checks, snapshot files, manifests and refresh."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X
from settlelens.operators import checks as Q
from settlelens.sinks import manifests as MF
from settlelens.sinks import tables as TB
from settlelens.sources import snapshots as SN
from settlelens.sources import vendor as SV
from settlelens.streaming import refresh as RF

D = dt.date


def test_number_text(spark):
    cases = {" 1 ": 1.0, "1_000": 1000.0, "1d": None, "1f": None, "-inf": -math.inf, "abc": None, "-0.5": -0.5, "1__0": None, "_1": None,
             ".5": 0.5, "1.": 1.0, "1e3": 1000.0, "": None, " ": None, "Infinity": math.inf, "0x1": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in df.select("s", X.parse_number("s").alias("v")).collect()} == cases
    assert math.isnan(spark.createDataFrame([("+NaN",)], "s string").select(X.parse_number("s")).first()[0])


def test_panel_text(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "date_utc,rollup_id,l2_fees_eth,rent_paid_eth,profit_eth\n"
        "2024-01-01,a,,1_000,1d\n"
        '2024-01-01,"b ""x"",\ny",nan,-inf,-0.5\n'
        "2024-01-01,c, ,abc,0\n"
    )
    p = SV.read_panel_csv(spark, str(tmp_path))
    assert SV.missing_columns(p, Q.PANEL_REQUIRED) is None
    assert 'b "x",\ny' in {r.rollup_id for r in p.collect()}
    assert sorted(r.message for r in Q.panel_text_failures(p).collect()) == [
        "row0:invalid_number:profit_eth",
        "row1:negative:profit_eth",
        "row1:negative:rent_paid_eth",
        "row2:invalid_number:l2_fees_eth",
        "row2:invalid_number:rent_paid_eth",
    ]
    assert SV.missing_columns(p.drop("rent_paid_eth", "date_utc"), Q.PANEL_REQUIRED) == "missing_columns:date_utc,rent_paid_eth"
    assert SV.missing_columns(p.select("path", "row_index"), Q.PANEL_REQUIRED) == "missing_header"


def test_row_positions_in_split_files(spark, tmp_path):
    for name in ("a", "b"):
        lines = "".join(f"2024-01-01,{name}{i},1,1\n" for i in range(200))
        (tmp_path / f"{name}.csv").write_text("date_utc,rollup_id,l2_fees_eth,rent_paid_eth\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        p = SV.read_panel_csv(spark, str(tmp_path), multi_line=False)
        assert p.count() == 400
        assert all(r.rollup_id[1:] == str(r.row_index) for r in p.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_manifest_failures(spark):
    sha = "a" * 64
    base = {"source": "s", "fetched_at_utc": "t", "command": None, "files": []}
    entry = {"path": "p", "sha256": sha, "bytes": 1}
    docs = {
        "ok": json.dumps({**base, "files": [entry, {**entry, "sha256": 5}]}),
        "bad_json": '{"source": ',
        "list": "[1]",
        "missing": json.dumps({"source": 1, "files": []}),
        "not_list": json.dumps({**base, "files": {}}),
        "null_files": json.dumps({**base, "files": None}),
        "entries": json.dumps({**base, "files": ["x", {"path": "p"}, {**entry, "sha256": sha.upper()}, {**entry, "sha256": sha + "\n"}, entry, None]}),
    }
    df = spark.createDataFrame(list(docs.items()), "path string, content string")
    got = {}
    for r in Q.manifest_failures(df).collect():
        got.setdefault(r.path, []).append(r.failure)
    assert got == {
        "bad_json": ["invalid_json"],
        "list": ["top_level_not_object"],
        "missing": ["missing_keys:command,fetched_at_utc"],
        "not_list": ["files_not_list"],
        "null_files": ["files_not_list"],
        "entries": [
            "files[0]:not_object", "files[1]:missing_keys:bytes,sha256", "files[2]:invalid_sha256", "files[3]:invalid_sha256",
            "files[5]:not_object",
        ],
    }


def test_snapshot_dates(spark):
    paths = {"raw/v/2024-02-29": D(2024, 2, 29), "raw/2024-02-30": None, "raw/latest": None, "raw/2024-02": None, "2024-01-01/": D(2024, 1, 1),
             "raw/x2024-01-01": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.d for r in df.select("p", SV.snapshot_date("p").alias("d")).collect()} == paths
    with pytest.raises(Exception, match="no YYYY-MM-DD folder"):
        df.select(SV.require_snapshot_date("p")).collect()


def test_snapshot_files_and_manifest_round_trip(spark, tmp_path):
    root = tmp_path / "2024-02-01"
    files = {"a/b": b"one", "a-b/c": b"two" * 999, ".hidden": b"h", "_under": b"u", "empty": b"", "with space/x y.txt": b"s", "a/deep/er": b"d"}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    df = SN.scan_snapshot_files(spark, str(root))
    assert {r.path: (r.sha256, r.bytes) for r in df.collect()} == {k: (hashlib.sha256(v).hexdigest(), len(v)) for k, v in files.items()}
    order = [r.path for r in SN.by_path(df).collect()]
    assert order.index("a/b") < order.index("a-b/c") and order == sorted(files, key=lambda p: p.split("/"))

    tagged = df.withColumns({"source": F.lit("v"), "as_of_utc_date": F.lit("2024-02-01").cast("date")})
    out = tmp_path / "manifests"
    MF.write_documents(MF.raw_manifests(tagged, "run --x"), str(out))
    doc = json.loads((out / "v_2024-02-01.json").read_text())
    assert list(doc) == sorted(doc) and [f["path"] for f in doc["files"]] == order and doc["command"] == "run --x"
    assert Q.manifest_failures(SN.read_manifests(spark, str(out))).count() == 0
    with pytest.raises(Exception, match="FileExistsError"):
        MF.write_documents(MF.raw_manifests(tagged, "run --y"), str(out))
    assert MF.raw_manifests(tagged, "c", 2).count() > 1

    (root / "a/b").write_bytes(b"changed")
    stored = SN.manifest_entries(SN.read_manifests(spark, str(out)))
    bad = {r.key: r.detail for r in Q.rehash(stored, SN.scan_snapshot_files(spark, str(root))).filter("status = 'fail'").collect()}
    assert bad == {"a/b": "digest_differs"}
    with pytest.raises(ValueError):
        SN.scan_snapshot_files(spark, str(tmp_path / "nowhere"))


def facts(spark, value, days=20):
    return spark.createDataFrame([(D(2024, 1, d), "k", value) for d in range(1, days + 1)], "date_utc date, key string, value double")


def test_refresh_takes_recent_corrections_only(spark, tmp_path):
    path, run = str(tmp_path / "t"), D(2024, 1, 20)
    TB.write_partitions(facts(spark, 1.0), path, ["date_utc"])
    corrected = facts(spark, 2.0)
    RF.refresh_chain(corrected, path, run)
    got = {r.date_utc: r.value for r in spark.read.parquet(path).collect()}
    assert got[run - dt.timedelta(days=6)] == 2.0 and got[run - dt.timedelta(days=8)] == 1.0 and len(got) == 20
    RF.full_rebuild(lambda first: corrected, path)
    assert {r.value for r in spark.read.parquet(path).collect()} == {2.0}


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    facts(spark, 1.0, 5).withColumn("run", F.lit(1)).write.parquet(path)
    new = facts(spark, 2.0, 8).withColumn("run", F.lit(2))
    for _ in range(2):
        RF.append_new(new.unionByName(new), path, ["date_utc", "key"], "run")
    got = sorted((r.date_utc.day, r.value) for r in spark.read.parquet(path).collect())
    assert got == [(d, 1.0 if d <= 5 else 2.0) for d in range(1, 9)]


def test_contract_file(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("version: 1\ntable: t\ngrain: [d]\nfields:\n  - {name: d, type: date, nullable: false}\n  - {name: n, type: integer, nullable: true}\n")
    s = C.contract_schema(C.load_contract(str(f)))
    assert s.simpleString() == "struct<d:date,n:bigint>" and not s["d"].nullable and s["n"].nullable


def test_command_text(spark):
    import shlex

    tokens = ["python", "a b.py", "--x", "it's", "", "a$b", "x/y-z.csv"]
    line = spark.createDataFrame([(tokens,)], "t array<string>").select(X.command_line("t")).first()[0]
    assert shlex.split(line) == tokens and line.startswith("python 'a b.py' --x")


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date_utc,fees,rent\n2024-01-01,5,1\n")
    (tmp_path / "b.csv").write_text("date_utc,rent,fees\n2024-01-02,2,6\n")
    (tmp_path / "c.csv").write_text("date_utc,fees\n2024-01-03,7\n")
    got = {r.date_utc: (r.fees, r.rent) for r in SV.read_panel_csv(spark, str(tmp_path)).collect()}
    assert got == {"2024-01-01": ("5", "1"), "2024-01-02": ("6", "2"), "2024-01-03": ("7", None)}


def test_a_contract_index_leads_to_its_entry(tmp_path):
    (tmp_path / "contracts").mkdir()
    (tmp_path / "contracts" / "a.yaml").write_text("name: a\nfields:\n  - {name: x, type: number, nullable: false}\n")
    (tmp_path / "contracts" / "b.yaml").write_text("name: b\n")
    index = tmp_path / "contracts" / "index.yaml"
    index.write_text("version: 1\nschemas:\n  one: contracts/a.yaml\n  two: contracts/b.yaml\n  gone: contracts/c.yaml\n")
    assert C.load_contract(str(index), "one")["fields"][0]["name"] == "x"
    assert C.load_contract(str(index), "two", root=str(tmp_path)) == {"name": "b"}
    assert C.load_contract(str(tmp_path / "contracts" / "b.yaml")) == {"name": "b"}
    for entry, error in ((None, KeyError), ("three", KeyError), ("gone", FileNotFoundError)):
        with pytest.raises(error):
            C.load_contract(str(index), entry)


def test_header_rows(spark, tmp_path):
    texts = {"good": 'date_utc,"rollup_id",l2_fees_eth,rent_paid_eth,x\r\n1,2,3,4,5\r\n', "short": "rollup_id,date_utc\n1,2\n", "empty": "\n\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    found = SV.header_failures(spark, str(tmp_path), Q.PANEL_REQUIRED).collect()
    got = sorted((r["path"].rsplit("/", 1)[1], r["failure"], r["message"]) for r in found)
    assert got == [("empty.csv", "missing_header", "missing_header"), ("short.csv", "missing_columns", "missing_columns:l2_fees_eth,rent_paid_eth")]


def test_a_full_rebuild_that_fails_leaves_the_table(spark, tmp_path):
    days = spark.createDataFrame([(1, D(2024, 5, 1)), (2, D(2024, 5, 2))], "v int, date_utc date")
    path = f"{tmp_path}/t"
    RF.full_rebuild(lambda _: days, path)
    bad = days.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.lit(9)))
    with pytest.raises(Exception, match="lost"):
        RF.full_rebuild(lambda _: bad, path)
    read = lambda: sorted(r["v"] for r in spark.read.parquet(path).collect())
    assert read() == [1, 2]
    RF.full_rebuild(lambda _: days.where("v = 2"), path)
    assert read() == [2]


def test_plain_checkpoint_folder_is_shared_on_a_cluster(spark, tmp_path):
    """The folder of spark.checkpoint.dir may be given without a scheme."""
    from types import SimpleNamespace

    from settlelens.session import scratch_root

    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc
    context = SimpleNamespace(master="local-cluster[3,4,10240]", _jvm=jvm, _jsc=hadoop)
    for given in (f"{tmp_path}/ck/", f"file:{tmp_path}/ck", f"file://{tmp_path}/ck"):
        cluster = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None, g=given: g))
        root = scratch_root(cluster)
        SN.require_shared(cluster, root)
        _, path = SN._open_fs(root)
        assert path == f"{tmp_path}/ck"
    with pytest.raises(ValueError):
        SN.require_shared(cluster, f"{tmp_path}/ck")
