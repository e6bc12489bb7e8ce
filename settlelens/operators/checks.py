"""Checks. Each returns rows (check, key, observed, threshold, status, detail)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlelens import contracts as C
from settlelens.functions import columns as X

CHECK_COLUMNS = ["check", "key", "observed", "threshold", "status", "detail"]


def result(name: str, key: Column, observed: Column, threshold: Column, ok: Column, detail: Column | None = None):
    """The select list of one check. An unknown outcome (null) fails."""
    return [
        F.lit(name).alias("check"),
        key.cast("string").alias("key"),
        observed.cast("double").alias("observed"),
        threshold.cast("double").alias("threshold"),
        F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    ]


def banded(diff: Column, passed: float, warned: float) -> Column:
    return (
        F.when(diff <= passed, "pass").when(diff <= warned, "warn").otherwise("fail")
    )


def overall(checks: DataFrame) -> DataFrame:
    """Every check runs; the verdict is the conjunction."""
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("status") == "fail").alias("n_fail"),
        F.count_if(F.col("status") == "warn").alias("n_warn"),
        F.coalesce(F.bool_and(F.col("status") != "fail"), F.lit(True)).alias("ok"),
    )


def schema_conformance(df: DataFrame, contract: dict) -> DataFrame:
    """Columns, types, nulls and key uniqueness against a contract.

    Counts of all fields come from one aggregate; duplicates from one keyed aggregate.
    """
    schema = C.contract_schema(contract)
    have = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for f in schema.fields:
        present = f.name in have
        nulls = F.count_if(F.col(f.name).isNull()) if present and not f.nullable else F.lit(0)
        typed = present and have[f.name] == f.dataType
        rows.append(
            F.struct(
                F.lit(f.name).alias("key"),
                (F.lit(present or f.nullable)).alias("present"),
                F.lit(typed or not present).alias("typed"),
                nulls.cast("bigint").alias("n_null"),
            )
        )
    per_field = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    fields = per_field.select(
        *result(
            "schema",
            F.col("key"),
            F.col("n_null"),
            F.lit(0),
            F.col("present") & F.col("typed") & (F.col("n_null") == 0),
            F.when(~F.col("present"), "missing_column").when(~F.col("typed"), "wrong_type").when(
                F.col("n_null") > 0, "null_in_required"
            ),
        )
    )
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    grain = contract["grain"]
    dup = (
        df.groupBy(*grain)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n_dup"))
        .select(
            *result("primary_key", F.lit(",".join(grain)), F.col("n_dup"), F.lit(0), F.col("n_dup") == 0,
                    F.lit("extra_columns:" + ",".join(extra)) if extra else None)
        )
    )
    return fields.unionByName(dup)


# Column names of the sample check, and below the labels of its failures and of the manifest's.
PANEL_REQUIRED = ["date_utc", "rollup_id", "l2_fees_eth", "rent_paid_eth"]
PANEL_NUMBERS = ["l2_fees_eth", "rent_paid_eth", "profit_eth"]


def panel_text_failures(rows: DataFrame) -> DataFrame:
    """(row_index, column, failure, message) of a panel read as text with ``row_index`` and ``path``.

    Blank cells are skipped; a cell of spaces is not blank. Negative includes -inf but not NaN.
    """
    numbers = [c for c in PANEL_NUMBERS if c in rows.columns]
    keep = [c for c in ("path", "row_index") if c in rows.columns]
    long = rows.select(
        *keep,
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in numbers])),
    ).filter("text IS NOT NULL AND text <> ''")
    value = X.parse_number("text")
    return (
        long.withColumn("_v", value)
        .withColumn(
            "failure",
            F.when(F.col("_v").isNull(), "invalid_number").when((F.col("_v") < 0) & ~F.isnan("_v"), "negative"),
        )
        .filter("failure IS NOT NULL")
        .select(
            *keep,
            "column",
            "failure",
            F.concat(F.lit("row"), F.col("row_index").cast("string"), F.lit(":"), "failure", F.lit(":"), "column").alias(
                "message"
            ),
        )
    )


def manifest_failures(manifests: DataFrame) -> DataFrame:
    """(path, failure) of raw manifests given as (path, content); valid ones give no row.

    Presence of keys is tested, not their values: a null passes, and a digest that is not a string
    is not tested.
    """
    top_keys = ["command", "fetched_at_utc", "files", "source"]
    entry_keys = ["bytes", "path", "sha256"]
    m = manifests.select(
        "path", F.try_parse_json("content").alias("doc"), F.col("content")
    ).withColumn("kind", F.schema_of_variant("doc"))
    is_object = F.col("kind").startswith("OBJECT")
    top = F.when(is_object, F.from_json("content", "map<string,string>"))
    m = m.withColumn("_top", top).withColumn(
        "_missing", F.filter(F.array(*[F.lit(k) for k in top_keys]), lambda k: ~F.map_contains_key("_top", k))
    )
    files = F.try_variant_get("doc", "$.files", "variant")
    m = m.withColumn("_files_kind", F.schema_of_variant(files)).withColumn(
        "failure",
        F.when(F.col("doc").isNull(), "invalid_json")
        .when(~is_object, "top_level_not_object")
        .when(F.size("_missing") > 0, F.concat(F.lit("missing_keys:"), F.array_join("_missing", ",")))
        .when(F.col("_files_kind").isNull() | ~F.col("_files_kind").startswith("ARRAY"), "files_not_list"),
    )
    doc_level = m.filter("failure IS NOT NULL").select("path", "failure")
    entries = m.filter("failure IS NULL").select(
        "path", F.posexplode(F.try_variant_get("doc", "$.files", "array<variant>")).alias("i", "entry")
    )
    entry_kind = F.coalesce(F.schema_of_variant("entry"), F.lit("VOID"))
    entry_map = F.from_json(F.col("entry").cast("string"), "map<string,string>")
    e = entries.withColumn("_object", entry_kind.startswith("OBJECT")).withColumn(
        "_map", F.when(F.col("_object"), entry_map)
    )
    e = e.withColumn(
        "_missing", F.filter(F.array(*[F.lit(k) for k in entry_keys]), lambda k: ~F.map_contains_key("_map", k))
    )
    sha_kind = F.schema_of_variant(F.try_variant_get("entry", "$.sha256", "variant"))
    at = F.concat(F.lit("files["), F.col("i").cast("string"), F.lit("]:"))
    e = e.withColumn(
        "failure",
        F.when(~F.col("_object"), F.concat(at, F.lit("not_object")))
        .when(F.size("_missing") > 0, F.concat(at, F.lit("missing_keys:"), F.array_join("_missing", ",")))
        .when(
            (sha_kind == "STRING") & ~X.is_sha256(F.try_variant_get("entry", "$.sha256", "string")),
            F.concat(at, F.lit("invalid_sha256")),
        ),
    )
    return doc_level.unionByName(e.filter("failure IS NOT NULL").select("path", "failure"))


def profit_identity(panel: DataFrame) -> DataFrame:
    """profit against fees - rent within the locked tolerance; rows without profit are skipped."""
    diff = F.abs(F.col("profit_eth") - (F.col("l2_fees_eth") - F.col("rent_paid_eth")))
    tol = X.profit_tolerance("l2_fees_eth", "rent_paid_eth")
    p = panel.filter("profit_eth IS NOT NULL").withColumns({"_diff": diff, "_tol": tol})
    return p.select(
        *result(
            "profit_identity",
            F.concat_ws("|", F.col("date_utc").cast("string"), "rollup_id"),
            F.col("_diff"),
            F.col("_tol"),
            F.col("_diff") <= F.col("_tol"),
        )
    )


def total_identity(decomposition: DataFrame) -> DataFrame:
    """Daily total equals the sum of its parts, to the last wei.

    DECIMAL(38,18) + DECIMAL(38,18) would drop a place, so the parts are narrowed first.
    """
    base, blob, tips, total = (
        F.col(c).cast("decimal(36,18)")
        for c in ("l1_base_fee_burn_eth", "l1_blob_fee_burn_eth", "l1_priority_fee_eth", "l1_total_rent_eth")
    )
    same = base + blob + tips == total
    gap = F.when(same, 0.0).otherwise(F.abs((total - base - blob - tips).cast("double")))
    return decomposition.select(*result("l1_total_identity", F.col("date_utc"), gap, F.lit(0), same))


def execution_identity(tx: DataFrame) -> DataFrame:
    """Counts of transactions whose execution fee differs from burn + tips, in exact wei, per day."""
    bad = F.col("execution_fee_wei") != F.col("burn_base_wei") + F.col("tips_wei")
    per_day = tx.groupBy("date_utc").agg(F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    return per_day.select(
        *result("execution_identity", F.col("date_utc"), F.col("n_bad"), F.lit(0), F.col("n_bad") == 0,
                F.concat(F.lit("n="), F.col("n").cast("string")))
    )


def coverage_threshold(coverage: DataFrame, key: str, name: str, threshold: float) -> DataFrame:
    return coverage.select(
        *result(name, F.col(key), F.col("coverage"), F.lit(threshold), F.col("coverage") >= threshold)
    )


def non_negative(panel: DataFrame, columns: list[str]) -> DataFrame:
    counts = panel.agg(
        F.array(
            *[F.struct(F.lit(c).alias("key"), F.count_if(F.col(c) < 0).alias("n")) for c in columns]
        ).alias("r")
    ).select(F.inline("r"))
    return counts.select(*result("non_negative", F.col("key"), F.col("n"), F.lit(0), F.col("n") == 0))


def difference_check(pairs: DataFrame, name: str, key: Column, value: str, base: str, passed: float, warned: float):
    """Relative difference against the higher-priority source; a missing side or base fails."""
    diff = X.relative_difference(value, base)
    return pairs.select(
        F.lit(name).alias("check"),
        key.cast("string").alias("key"),
        diff.alias("observed"),
        F.lit(float(passed)).alias("threshold"),
        F.coalesce(banded(diff, passed, warned), F.lit("fail")).alias("status"),
        F.when(F.col(value).isNull(), "value_missing").when(F.col(base).isNull(), "base_missing").alias("detail"),
    )


def minimum_blob_fee(blocks: DataFrame) -> DataFrame:
    fee = F.col("base_fee_per_blob_gas_wei")
    per_day = blocks.groupBy(X.epoch_date("timestamp").alias("date_utc")).agg(
        F.min(fee).alias("low"), F.count_if(fee < C.MIN_BLOB_BASE_FEE_WEI).alias("n_bad")
    )
    return per_day.select(
        *result("blob_fee_minimum", F.col("date_utc"), F.col("low"), F.lit(C.MIN_BLOB_BASE_FEE_WEI),
                F.col("n_bad") == 0)
    )


def receipt_coverage(transactions: DataFrame, receipts: DataFrame, threshold: float = C.RECEIPT_COVERAGE) -> DataFrame:
    """Share of transaction hashes that have a receipt."""
    have = receipts.select("tx_hash").distinct().withColumn("_have", F.lit(1))
    c = transactions.select("tx_hash").distinct().join(have, "tx_hash", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("_have").alias("n_have")
    )
    share = X.ratio_or_null("n_have", "n")
    return c.select(*result("receipt_coverage", F.lit("all"), share, F.lit(threshold), share >= threshold))


def block_continuity(gaps: DataFrame) -> DataFrame:
    c = gaps.agg(F.coalesce(F.sum("n_missing"), F.lit(0)).alias("n_missing"), F.count(F.lit(1)).alias("n_gaps"))
    return c.select(
        *result("block_continuity", F.lit("all"), F.col("n_missing"), F.lit(0), F.col("n_missing") == 0,
                F.concat(F.lit("gaps="), F.col("n_gaps").cast("string")))
    )


def attribution_target(coverage: DataFrame) -> DataFrame:
    threshold = F.when(F.col("post_regime"), C.ATTRIBUTION_POST).otherwise(C.ATTRIBUTION_PRE)
    return coverage.select(
        *result(
            "attribution_coverage",
            F.when(F.col("post_regime"), "post").otherwise("pre"),
            F.col("coverage"),
            threshold,
            F.col("coverage") >= threshold,
        )
    )


def registry_audit(mappings: DataFrame, key: str) -> DataFrame:
    """Registry rows lacking a source link or a confidence."""
    gap = F.concat_ws(
        ",",
        F.when(F.col("source_url").isNull(), "source_url"),
        F.when(F.col("confidence").isNull(), "confidence"),
    )
    bad = mappings.withColumn("_gap", gap).filter("_gap <> ''")
    return bad.select(
        *result("registry_audit", F.concat_ws("|", "rollup_id", key), F.lit(None), F.lit(None), F.lit(False),
                F.concat(F.lit("missing:"), "_gap"))
    )


def missing_share(df: DataFrame, columns: list[str], limit: float = C.MISSING_SHARE_MAX) -> DataFrame:
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("key"),
                    X.ratio_or_null(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("share"),
                )
                for c in columns
            ]
        ).alias("r")
    ).select(F.inline("r"))
    return counts.select(*result("missing_share", F.col("key"), F.col("share"), F.lit(limit), F.col("share") < limit))


def alerts(diffs: dict[str, DataFrame], checks: list[DataFrame]) -> DataFrame:
    """Drift alerts: catalog keys that changed, and failed checks."""
    rows = None
    for name, d in diffs.items():
        key = [c for c in d.columns if c != "change"][0]
        part = d.select(
            *result(f"{name}_changed", F.col(key), F.lit(None), F.lit(None), F.lit(False), F.col("change"))
        )
        rows = part if rows is None else rows.unionByName(part)
    for c in checks:
        part = c.filter("status = 'fail'")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def header_presence_check(flagged: DataFrame) -> DataFrame:
    c = flagged.groupBy("active").agg(F.count_if(~F.col("header_ok")).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    return c.select(
        *result("blob_header_presence", F.when(F.col("active"), "after").otherwise("before"), F.col("n_bad"), F.lit(0),
                F.col("n_bad") == 0, F.concat(F.lit("n="), F.col("n").cast("string")))
    )


def blob_burn_check(tx: DataFrame) -> DataFrame:
    """Blob burn never negative, and its correlation with type-3 presence over days."""
    daily = tx.groupBy("date_utc").agg(
        F.count_if(F.col("burn_blob_wei") < 0).alias("n_negative"),
        F.coalesce(F.sum("burn_blob_wei"), F.lit(0)).cast("double").alias("burn"),
        F.count_if(F.col("tx_type") == 3).cast("double").alias("n_type3"),
    )
    c = daily.agg(F.sum("n_negative").alias("n_negative"), F.corr("burn", "n_type3").alias("corr"))
    return c.select(
        *result("blob_burn", F.lit("negative"), F.col("n_negative"), F.lit(0), F.col("n_negative") == 0)
    ).unionByName(
        c.select(*result("blob_burn", F.lit("correlation"), F.col("corr"), F.lit(0), F.col("corr") > 0))
    )


# ---- digests and lineage ----------------------------------------------------------------------


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: sums of two row hashes and the row count. Floats hash by bits.

    Hashes skip nulls, so each column stands next to a mark of its nulls.
    """
    marked = [c for name in sorted(df.columns) for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    total = lambda h: F.coalesce(F.sum(F.col(h).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.select(F.xxhash64(*marked).alias("_h"), F.xxhash64(F.lit("second"), *marked).alias("_g")).agg(
        F.concat_ws("/", total("_h"), total("_g")).alias("digest"), F.count(F.lit(1)).alias("n_rows")
    )


def compare_builds(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two builds hold the same rows."""
    both = table_digest(first).withColumn("_build", F.lit("a")).unionByName(table_digest(second).withColumn("_build", F.lit("b")))
    of = lambda name, build: F.max(F.when(F.col("_build") == build, F.col(name)))
    one = both.agg(*[of(n, b).alias(f"{n}_{b}") for n in ("digest", "n_rows") for b in "ab"])
    same = (F.col("digest_a") == F.col("digest_b")) & (F.col("n_rows_a") == F.col("n_rows_b"))
    return one.select(*result("rebuild", F.lit("table"), F.col("n_rows_b"), F.col("n_rows_a"), same))


def rehash(manifest_files: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """Files of a manifest against a fresh hash of the snapshot."""
    a = manifest_files.select("path", F.col("sha256").alias("_want"))
    b = snapshot_files.select("path", F.col("sha256").alias("_got"))
    return a.join(b, "path", "full_outer").select(
        *result(
            "snapshot_hash",
            F.col("path"),
            F.lit(None),
            F.lit(None),
            F.col("_want") == F.col("_got"),
            F.when(F.col("_want").isNull(), "not_in_manifest")
            .when(F.col("_got").isNull(), "file_missing")
            .when(F.col("_want") != F.col("_got"), "digest_differs"),
        )
    )


def lineage_closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(artifact, input, depth) pairs reachable through ``edges`` (artifact, input).

    ``roots`` (artifact) names the artifacts asked about; without it every artifact is one. Artifacts that
    reach no cycle are worked out from the bottom up, see ``closure_by_layers``; the others, roots and edges without
    an artifact go by rounds from the top. Links without an input are pairs like others, once for each depth.
    """
    from settlelens.operators.lineage import closure_by_layers
    from settlelens.session import materialize

    base = materialize(edges.select("artifact", "input").distinct(), "lineage-edges")
    if roots is not None:
        return _closure_by_rounds(base.join(roots.select("artifact").distinct(), "artifact", "left_semi"), base)
    deep, open_ = closure_by_layers(base.where("artifact IS NOT NULL AND input IS NOT NULL"))
    no_input = base.where("artifact IS NOT NULL AND input IS NULL").select("artifact")
    named = base.where("artifact IS NOT NULL").withColumn("depth", F.lit(1))
    by_rounds = base.where("artifact IS NULL")
    if open_ is not None:
        named = named.join(open_, "artifact", "left_anti")
        by_rounds = by_rounds.unionByName(base.join(open_, "artifact", "left_semi"))
    pairs = named.unionByName(deep)
    if not no_input.isEmpty():
        ends = pairs.join(no_input.withColumnRenamed("artifact", "input"), "input", "left_semi")
        pairs = pairs.unionByName(ends.select("artifact", F.lit(None).cast("string").alias("input"), (F.col("depth") + 1).alias("depth")).distinct())
    return pairs if by_rounds.isEmpty() else pairs.unionByName(_closure_by_rounds(by_rounds, base))


def _closure_by_rounds(first: DataFrame, base: DataFrame) -> DataFrame:
    """The closure of the artifacts of ``first``, links of ``base``.

    Each round joins the newest pairs to the edges and writes the result to the shared folder, so the plan stays
    short and a lost executor costs one round. Rounds go on until no new pair appears, so a cycle ends.
    """
    from settlelens.session import materialize

    seen = frontier = materialize(first.withColumn("depth", F.lit(1)), "lineage")
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        step = (
            frontier.select("artifact", F.col("input").alias("_mid"))
            .join(base.select(F.col("artifact").alias("_mid"), "input"), "_mid")
            .select("artifact", "input")
            .distinct()
            .join(seen.select("artifact", "input"), ["artifact", "input"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = materialize(step, "lineage")
        seen = seen.unionByName(frontier)
    return seen


def lineage_check(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Inputs no manifest or snapshot knows, and artifacts that list themselves."""
    unknown = edges.join(known.select(F.col("artifact").alias("input")).distinct(), "input", "left_anti").select(
        *result("lineage", F.concat_ws("<-", "artifact", "input"), F.lit(None), F.lit(None), F.lit(False),
                F.lit("unknown_input"))
    )
    selfref = edges.filter("artifact = input").select(
        *result("lineage", F.col("artifact"), F.lit(None), F.lit(None), F.lit(False), F.lit("self_reference"))
    )
    return unknown.unionByName(selfref)
