import math
import re
from collections import Counter

from pyspark.sql import functions as F

from settlelens.llm.quality import acceptance_number, quality_verdicts, text_statistics
from settlelens.llm.quality_sql import quality_sql
from tests.llm.conftest import SMALL, duck, same_rows


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_statistics_against_plain_python(spark):
    texts = [None, "", " \n\t", "a b a b a b a b a b a b", "x y z\nx y z\n\nx y z", "one * two # three | four < five", "w " * 3000]
    texts += ["é ü " * 9 + "a b c d e f g a b c d e x a b c d e", "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in text_statistics(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: statistics(t) for i, t in enumerate(texts)}


def test_acceptance_number_is_the_exact_binomial_one(spark):
    cases = [(10, 0.01), (500, 0.02), (2000, 0.007), (300, 0.02)]
    level = 0.001
    for n, p in cases:
        total, best = 0.0, None
        for k in range(n + 1):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if total > level:
                break
            best = k
        assert spark.range(1).select(acceptance_number(F.lit(n).cast("bigint"), p, F.lit(level))).first()[0] == best


def test_edges(edges, no_labels):
    rows = quality_verdicts(edges, no_labels).collect()
    assert len(rows) == edges.count()
    verdicts = {r["doc_id"]: r["kept"] for r in rows}
    assert verdicts[3] is False and verdicts[4] is False and verdicts[1] is True and verdicts[None] is True


def test_empty(nothing, no_labels):
    assert quality_verdicts(nothing, no_labels).count() == 0


def test_cutoffs_reject_junk_and_hold_the_risk(spark):
    good = [(i, "plain words of a clean text that say what they have to say today", "en", 1) for i in range(1500)]
    junk = [(2000 + i, "buy# now$ win% a& prize* so| do< it> at# once$ and% win&", "en", 0) for i in range(60)]
    df = spark.createDataFrame(good + junk, "doc_id bigint, text string, lang string, quality int")
    out = quality_verdicts(df.drop("quality"), df.select("doc_id", "quality")).groupBy("rejected_by", "kept").count().collect()
    assert {(r[0], r[1]): r[2] for r in out} == {(None, True): 1500, ("symbols", False): 60}


def test_a_small_stratum_certifies_and_the_first_failing_step_ends_the_path(spark):
    clean = "plain words of a clean text that say what they have to say today"
    shout = "LOUD WORDS OF SOME KIND THAT SAY WHAT THEY HAVE TO SAY TODAY"
    junk = "buy# now$ win% a& prize* so| do< it> at# once$ and% win&"
    rows = [(i, clean, "de", 1) for i in range(150)] + [(200 + i, junk, "de", 0) for i in range(9)]
    # In fr a fifth of the good documents is in capitals, so the step that takes them and all later ones stay out.
    rows += [(1000 + i, shout if i % 5 == 0 else clean, "fr", 1) for i in range(150)] + [(1200 + i, junk, "fr", 0) for i in range(9)]
    rows += [(1300 + i, shout, "fr", 0) for i in range(90)]
    rows += [(3000 + i, clean, "es", 1) for i in range(20)] + [(3100 + i, junk, "es", 0) for i in range(9)]  # too few good labels
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    out = quality_verdicts(df.drop("quality"), df.select("doc_id", "quality")).toPandas()
    gone = out[~out["kept"]]
    assert sorted(gone["doc_id"]) == [*range(200, 209), *range(1200, 1209)] and set(gone["rejected_by"]) == {"symbols"}


def test_every_language_rejects_something(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_verdicts(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels.groupBy("doc_id").agg(F.max("quality").alias("good")), "doc_id")
    counts = out.where("NOT base_failed").groupBy("lang").agg(
        F.count(F.when(F.col("rejected_by").isNotNull() & (F.col("good") == 0), True)).alias("bad"),
        F.avg(F.when(F.col("good") == 1, (~F.col("kept")).cast("double"))).alias("share"),
    )
    rows = {r["lang"]: r for r in counts.collect()}
    assert {"de", "en", "es", "fr"} <= rows.keys()
    assert all(rows[k]["bad"] > 0 and rows[k]["share"] < 0.05 for k in ("de", "en", "es", "fr"))


def test_agrees_with_sql(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    want = duck(quality_sql(), {t: f"{SMALL}/{t}.parquet" for t in ("documents", "labels")})
    same_rows(quality_verdicts(docs, labels).toPandas(), want)
