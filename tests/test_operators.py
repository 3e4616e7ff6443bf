"""Operators that SQL cannot express against plain Python, and edge cases of the others."""

import datetime

import pytest
from pyspark.sql import functions as F

from manuscript_jobs.functions import text as T
from manuscript_jobs.operators import billing, classify, issues, layout, scoring
from manuscript_jobs.operators import checks as C
from manuscript_jobs.sources.shared import path_bytes
from manuscript_jobs.streaming import events as E
from manuscript_jobs.streaming import stateful as S


def test_soft_wrap(spark):
    text = "aaa bbb ccc\n" + "x" * 12 + " d"
    df = spark.createDataFrame([(1, 0, text), (2, 0, None)], "doc_id long, n long, text string")
    got = {r.doc_id: r.lines for r in layout.soft_wrap(df, 7).collect()}
    assert got == {1: ["aaa bbb", "ccc", "x" * 7, "xxxxx d"], 2: [""]}


def test_merge_rows(spark):
    rows = [(1, 0, 0, "left", 10.0, 50.0, 100.0, 112.0), (1, 0, 1, "near", 55.0, 90.0, 101.0, 113.0), (1, 0, 2, "far", 150.0, 190.0, 100.0, 112.0), (1, 0, 3, "below", 10.0, 60.0, 120.0, 132.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_index long, n long, text string, x0 double, x1 double, y0 double, y1 double")
    got = sorted((r.row, r.text, r.table_row) for r in layout.merge_rows(df).collect())
    assert got == [(0, "left near far", True), (1, "below", False)]
    assert layout.merge_rows(df.limit(0)).count() == 0


def test_table_cells_grow(spark):
    rows = [(1, 0, n, 100, 160, 100 + 16 * n, n == 0) for n in range(5)] + [(1, 0, 9, 300, 700, 110, False)]
    df = spark.createDataFrame(rows, "doc_id long, page_index long, n long, x0 long, x1 long, y0 long, seed boolean")
    got = {r.n: r.cell for r in layout.mark_table_cells(df).collect()}
    assert all(got[n] for n in range(5)) and not got[9]
    once = {r.n: r.cell for r in layout.mark_table_cells(df, 1).collect()}
    assert once[1] and not once[3]


def test_payment_dedupe_is_a_fold(spark):
    # The third shares a checkout with the skipped second only, so it counts.
    rows = [(1, 1, 1, 10, 20), (1, 2, 2, 10, 21), (1, 3, 3, 11, 21), (1, 4, 4, None, 20), (2, 1, 5, 10, None), (2, 2, 6, None, None)]
    df = spark.createDataFrame(rows, "owner long, at long, seq long, payment_id long, checkout_id long")
    assert sorted(r.seq for r in billing.payment_dedupe(df).collect()) == [1, 3, 5, 6]


def _epoch(*day):
    return int(datetime.datetime(*day, tzinfo=datetime.timezone.utc).timestamp())


def test_payment_terms(spark):
    jan, feb = _epoch(2024, 1, 31, 4), _epoch(2024, 2, 10)
    rows = [
        ("a", jan, "1", "activate", None, "monthly"), ("a", feb, "2", "renew", None, "monthly"),  # extends, month's end
        ("b", jan, "1", "activate", "premium", None), ("b", feb, "2", "activate", "PRO", "annual"),  # another plan: new term
        ("c", jan, "1", "activate", "pro", "monthly"), ("c", _epoch(2024, 6, 1), "2", "renew", None, "monthly"),  # lapsed: new term, last plan
        ("d", jan, "1", "activate", "pro", "annual"), ("d", feb, "2", "flag", None, None), ("d", feb, "3", "downgrade", None, None),
        ("e", jan, "1", "flag", None, None), (None, jan, "1", "sync", None, None),
    ]
    df = spark.createDataFrame(rows, "owner string, at long, event_id string, action string, tier string, billing_period string")
    got = {r.owner: tuple(r)[1:] for r in E.apply_payment_actions(df).collect()}
    assert got == {
        "a": (2, "premium", "premium", jan, _epoch(2024, 3, 29, 4), False), "b": (2, "pro", "pro", feb, _epoch(2025, 2, 10), False),
        "c": (2, "pro", "pro", _epoch(2024, 6, 1), _epoch(2024, 7, 1), False), "d": (3, "free", "pro", 0, 0, False),
        "e": (1, "free", None, 0, 0, True), None: (1, "free", None, 0, 0, False),
    }
    assert E.apply_payment_actions(df.limit(0)).count() == 0


def test_owners_by_lookup(spark):
    columns = ("event_type", "resource_id", "owner", "status", "tier", "billing_period", "checkout_id", "subscription_id", "payment_id")
    rows = [
        ("checkout_session.payment.paid", "cs_1", None, None, None, None, None, None, None), ("payment.paid", "pay_9", None, None, None, None, "cs_1", None, None),
        ("subscription.invoice.paid", "in_1", None, None, None, None, None, "sub_1", None), ("subscription.unpaid", "sub_2", None, None, None, None, None, None, None),
        ("payment.refund.updated", "pay_1", None, "pending", None, None, None, None, None), ("payment.refund.updated", "pay_1", "x", "Succeeded", None, None, None, None, None),
        ("payment.failed", "cs_1", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    known = [("checkout", "cs_1", "u1", "pro", "annual"), ("subscription", "sub_1", "u2", None, None), ("payment", "pay_1", "u3", None, None), ("payment", None, "u4", None, None)]
    known = spark.createDataFrame(known, "kind string, id string, owner string, tier string, billing_period string")
    got = sorted(str((r.event_type, r.owner, r.tier, r.action)) for r in E.route_events(E.find_owners(df, known)).collect())
    assert got == sorted(
        str(x)
        for x in [
            ("checkout_session.payment.paid", "u1", "pro", "activate"), ("payment.paid", "u1", "pro", "activate"), ("subscription.invoice.paid", "u2", None, "renew"),
            ("subscription.unpaid", None, None, "log"), ("payment.refund.updated", "u3", None, "log"), ("payment.refund.updated", "u3", None, "downgrade"), ("payment.failed", None, None, "log"),
        ]
    )


def test_rate_limit(spark):
    at = [0, 10, 30, 60, 90, 120, 150, 3599, 3601]
    df = spark.createDataFrame([(1, "verify_email", t, i) for i, t in enumerate(at)], "owner long, purpose string, at long, event_id long")
    got = {r.event_id: (r.allowed, r.wait) for r in E.rate_limit(df).collect()}
    assert got[0] == (True, 0) and got[1] == (False, 20) and got[5] == (True, 0) and got[6] == (False, 3450) and got[7] == (False, 1) and got[8] == (True, 0)


def test_billing_months(spark):
    rows = [("2024-01-31 10:00:00", "monthly", "2024-02-29 10:00:00"), ("2023-01-31 17:00:00", "monthly", "2023-02-28 17:00:00"), ("2024-02-29 02:00:00", "annual", "2025-02-28 02:00:00")]
    df = spark.createDataFrame(rows, "at string, period string, want string").withColumn("at", F.col("at").cast("timestamp"))
    out = df.select(billing.billing_period_end(F.col("at"), F.col("period")).cast("string").alias("got"), "want").collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_length_and_tokens(spark):
    cases = {"1 1/2 in": 1.5, '1/2"': 0.5, "2.54 cm": 1.0, "25.4mm": 1.0, "36 pt": 0.5, "½": 0.5, "one and a half": 1.5, "two tabs": 1.0, "3 tabs": 1.5, "one tab": 0.5, "tab": 0.5, "1 inch (one tab)": 1.0, "0.5 inch (one tab)": 0.5, "half-inch tab": 0.5, "1/2\" tab": 0.5, "1.27 cm, 1 tab": 0.5, "0 tabs": None, "9 inches": None, "": None, "none": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.v for r in df.select("t", T.parse_length_inches(F.col("t")).alias("v")).collect()}
    assert {k: got[k] for k in cases} == cases and got[None] is None
    tokens = {"7": (7, "arabic"), "iv": (4, "roman_lower"), "Page 3 of 10": (3, "arabic"), "- 12 -": (12, "arabic"), "XIV": (14, "roman_upper"), "iix": (None, None), "a 3": (None, None)}
    df = spark.createDataFrame([(k,) for k in tokens], "t string")
    assert {r.t: tuple(r.p) for r in df.select("t", T.page_token(F.col("t")).alias("p")).collect()} == tokens


def test_page_tokens_of_any_length(spark):
    """Numbers over 9,999 are page numbers too; among other lines only those of four digits are."""
    tokens = {"10000": 10000, "Page 59999 of 60000": 59999, "- 123456 -": 123456, "9223372036854775807": 2**63 - 1, "Page 3 of 12345": 3, "12": 12, "xiv": 14}
    df = spark.createDataFrame([(k,) for k in tokens], "t string")
    got = df.select("t", T.page_token(F.col("t"))["value"].alias("v"), T.page_token(F.col("t"), 4)["value"].alias("short")).collect()
    assert {r.t: r.v for r in got} == tokens and {r.t: r.short for r in got if r.short} == {"12": 12, "xiv": 14}


def test_parse_compliant_refuses(spark):
    with pytest.raises(Exception, match="not a yes or no"):
        spark.createDataFrame([("maybe",)], "t string").select(T.parse_compliant(F.col("t"))).collect()


def test_spacing_bands(spark):
    cases = [(2.0, 2.0, True), (1.64, 1.5, True), (1.88, 1.5, True), (1.89, 1.5, False), (1.15, 1.5, False), (2.1, 2.0, True), (1.7, 2.0, False)]
    df = spark.createDataFrame([c[:2] for c in cases], "a double, e double")
    assert [r[0] for r in df.select(C.spacing_matches(F.col("a"), F.col("e"))).collect()] == [c[2] for c in cases]


def test_unset_rules_are_not_scored(spark):
    units = spark.createDataFrame([(1, 0, 0, 0, "some text", "Arial", 12.0), (2, 0, 0, 0, "some text", "Arial", 12.0)], "doc_id long, n long, page_index long, line_index long, text string, font string, size double")
    rules = spark.createDataFrame([(1, [], None, False), (2, ["Times"], None, False)], "doc_id long, families array<string>, body_size double, black boolean")
    assert [(r.doc_id, r.ok) for r in C.check_fonts(units, rules).collect()] == [(2, False)]


def test_scoring_worked_example(spark):
    obs = [(1, "Fonts", i >= 3) for i in range(10)] + [(1, "Margins", True)] * 5
    stats = scoring.category_stats(spark.createDataFrame(obs, "scan_id long, category string, ok boolean"))
    found = [(1, "Fonts", "font_size", s, p, 1, "x") for s, p in (("minor", 1), ("critical", 2), ("minor", 3), ("minor", 3))]
    got = issues.collect_issues(spark.createDataFrame(found, "scan_id long, category string, issue_type string, severity string, page long, line long, excerpt string"))
    one = got.collect()[0]
    assert (one.severity, one["count"], [x.page for x in one.locations]) == ("critical", 3, [1, 2, 3])
    assert [x.page for x in issues.collect_issues(got.select("scan_id", "category", "issue_type", "severity", F.explode("locations").alias("l")).select("*", "l.*"), 2).collect()[0].locations] == [1, 2]
    s = scoring.build_scoring(stats, got)
    r = s.collect()[0]
    assert (r.checked, r.passed, r.failed, r.overall, r.category_count) == (15, 12, 3, 85.0, 2)
    assert {c.category: c.status for c in r.categories}["Captions"] == "not_applicable" and len(r.categories) == 8
    v = scoring.validate_scoring(s).collect()[0]
    assert v.ok and v.errors == []
    broken = scoring.validate_scoring(s.withColumn("passed", F.col("passed") + 1)).collect()[0]
    assert not broken.ok and "units do not add up" in broken.errors


def test_shares_show_exactly_100(spark):
    df = spark.createDataFrame([(1, i, 100 / 3) for i in range(3)] + [(2, 0, 12.34), (2, 1, None)], "g long, i long, v double")
    got = {(r.g, r.i): r.rounded for r in scoring.round_shares(df, "g", "v", "i").collect()}
    assert [got[1, i] for i in range(3)] == [33.4, 33.3, 33.3] and got[2, 0] == 12.3 and got[2, 1] is None


def test_scan_is_linear_and_order_free(spark):
    """A corpus twice over gives each document the same score; shuffled input gives the same result."""
    lines = [(d, n, n // 40, n % 40, f"This is line {n} of document {d}, long enough to be aligned.", "Arial" if n % 3 else "Georgia", 12.0, 2.0 if n % 2 else 1.0, "justify", 0.5 * (n % 8 == 0), "plain", "body", n // 4, 72, 72 + 16 * n, 500, 84 + 16 * n) for d in (1, 2) for n in range(20)]
    kind = "doc_id long, n long, page_index long, line_index long, text string, font string, size double, line_spacing double, alignment string, indent double, face string, role string, paragraph long, x0 long, y0 long, x1 long, y1 long"
    rule = "doc_id long, families array<string>, body_size double, black boolean, alignment string, overrides map<int,string>, style string"
    rules = spark.createDataFrame([(d, ["Arial"], 12.0, False, "justify", {}, "APA") for d in (1, 2)], rule)

    def score(rows):
        obs, found = C.run_scan(spark.createDataFrame(rows, kind), rules)
        entries = scoring.category_entries(scoring.category_stats(obs), issues.collect_issues(found))
        return sorted((r.scan_id, r.checked, r.failed, r.overall) for r in scoring.overall_score(entries).collect())

    first = score(lines)
    assert score(lines[::-1]) == first and first[0][1:] == first[1][1:]


def test_classifier_learns(spark):
    rows = [(i, f"see [{i}] and [{i + 1}]" if i % 2 else f"(Smith, {1990 + i % 30}) argues that", "IEEE" if i % 2 else "APA") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, style string")
    parts = classify.stratified_split(df, "style", "id", (0.8, 0.2))
    model = classify.train_classifier(parts.where("part = 0"), "text", "style", 10, 1 << 10)
    out = classify.classification_report(classify.predict(model, parts.where("part = 1"), "text"), "style", "predicted").collect()
    assert all(r.f1 == 1.0 for r in out) and len(out) == 2


def test_term_counts_are_those_of_the_hashing_stages(spark, tmp_path):
    """Counts made in Arrow batches are the vectors of HashingTF over ``ngram_terms``, whatever the text; terms are counted at
    the only reading of the texts; predictions are those of the model's own stages."""
    odd = ["", "  ", "é", "日本 語 text", "a", "ab ab ab", "İstanbul ǅ", "x" * 3000, "😀 a😀b", "don't re-use 12.5", "a b", "𝒜𝒷 c", "one two three four " * 400]
    rows = [(i, x, "ab"[i % 2]) for i, x in enumerate([*odd, *[f"see [{i}] and ({i + 7})" if i % 2 else f"Smith {i} argues" for i in range(40)]])]
    df = spark.createDataFrame(rows, "id long, text string, label string").repartition(3)
    for dimensions in (1 << 16, 1000):
        terms = classify.ngram_terms(df, "text")
        want = classify.Pipeline(stages=classify.tfidf_features(dimensions).getStages()[:2]).fit(terms).transform(terms)
        same = [(F.unwrap_udt(f"a.{n}_tf") == F.unwrap_udt(f"b.{n}_tf")).alias(n) for n in classify.TERMS]
        got = classify.term_counts(df, "text", dimensions).alias("a").join(want.alias("b"), "id").select(*same).collect()
        assert len(got) == len(rows) and all(all(r) for r in got)
    assert classify.term_counts(spark.createDataFrame([(1, None)], "id long, text string"), "text", 64).first().words_tf.numNonzeros() == 0
    readings = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            readings.add(b.num_rows)
            yield b

    model = classify.train_classifier(df.mapInArrow(read, df.schema), "text", "label", 5, 1 << 10)
    assert readings.value == len(rows)
    counts = classify.term_counts(df, "text", 1 << 10)
    want = {r.id: (r.prediction, max(r.probability)) for r in model.transform(counts.withColumn("weight", F.lit(1.0))).collect()}
    got = classify.predict(model, df, "text").collect()
    assert all(r.predicted == model.stages[0].labels[int(want[r.id][0])] and abs(r.confidence - want[r.id][1]) < 1e-9 for r in got) and len(got) == len(rows)


def test_rule_model_draws_the_least_hashes(spark):
    """Of either sort at most ``most`` distinct rows, those of the least hashes; a filter on a told column does not tell twice."""
    from manuscript_jobs.operators import rule_model as R

    rows = [(f"Sentence {i} of {i % 7} words.", "other" if i % 3 else "font_size") for i in range(200)]
    df = spark.createDataFrame(rows + rows, "sentence string, rule_type string")
    model = R.train_rule_model(df, most=20, rounds=2, dimensions=64)
    assert sorted(model.stages[0].labels) == ["font_size", "other"]
    plan = R.predicted_rules(R.classified(model, df.selectExpr("1L as guide_id", "2 as at", "sentence")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_streams_equal_their_batch_twins(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(f"u{i % 3}", base + datetime.timedelta(minutes=7 * i), f"e{i:03d}", ["activate", "flag", "downgrade", "log"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "owner string, ts timestamp, event_id string, action string").withColumn("at", F.unix_seconds("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    m = df.select(F.col("action").alias("metric"), "ts", F.lit(2).cast("long").alias("value"))
    ms = stream.select(F.col("action").alias("metric"), "ts", F.lit(2).cast("long").alias("value"))
    last = E.run_available(E.download_windows(ms), f"{tmp_path}/w")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/w/out/{last}").collect())) == sorted(map(str, E.download_windows(m).collect()))
    twice = df.union(df).select("event_id", "ts")
    twice.coalesce(1).write.parquet(f"{tmp_path}/twice")
    d = E.dedupe_events(spark.readStream.schema(twice.schema).parquet(f"{tmp_path}/twice"))
    last = E.run_available(d, f"{tmp_path}/d", "append")
    assert sum(spark.read.parquet(f"{tmp_path}/d/out/{i}").count() for i in range(last + 1)) == 40


def run_on(stream, path, mode):
    """Runs a stream to the end of what is there, each batch to its own folder; returns all rows."""
    E.run_available(stream, path, mode)
    return stream.sparkSession.read.parquet(f"{path}/out/*").collect()


def test_failed_events_run_again(spark, tmp_path):
    """Deliveries in three files with a restart after each: a failed id runs again, a done one never; as the batch twin."""
    base = datetime.datetime(2024, 1, 1)
    outcome = {0: [False, True, True], 1: [True, True], 2: [None, False, True, False], 3: [False, False, False], 4: [True]}
    rows = sorted((base + datetime.timedelta(minutes=10 * n + i), f"e{i}", ok, n) for i, tries in outcome.items() for n, ok in enumerate(tries))
    df = spark.createDataFrame([(e, t, ok, n) for t, e, ok, n in rows], "event_id string, ts timestamp, ok boolean, n int")
    for part in range(3):
        df.where(F.least("n", F.lit(2)) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        got = run_on(S.claim_events(stream), f"{tmp_path}/s", "append")
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, E.claim_events(df).collect()), key=str)
    assert [r.verdict for r in sorted(got, key=lambda r: r.ts) if r.event_id == "e2"] == ["failed", "failed", "done", "skipped"]
    assert E.claim_events(df.limit(0)).count() == 0


def test_payment_states_by_timer_and_late_actions(spark, tmp_path):
    """Coverage ends by the clock; an action that comes late but within the watermark is taken in its order; a restart
    between the files changes nothing."""
    day = 86_400
    rows = [
        (0, "u1", 1, "e1", "activate", "premium", "monthly"), (0, "u2", 1, "e2", "activate", "pro", "annual"), (0, "u3", 5000, "e5", "downgrade", None, None),
        (1, "u3", 4000, "e4", "activate", "pro", "monthly"), (1, "u1", 10 * day, "e6", "flag", None, None),
        (2, "u4", 60 * day, "e7", "activate", "premium", "monthly"), (3, "u5", 61 * day, "e8", "log", None, None),
    ]
    df = spark.createDataFrame(rows, "file int, owner string, at long, event_id string, action string, tier string, billing_period string")
    for part in range(4):
        df.where(F.col("file") == part).drop("file").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.drop("file").schema).parquet(f"{tmp_path}/in")
        got = run_on(S.payment_states(stream, "1 hour"), f"{tmp_path}/s", "update")
    now = 61 * day - 3600
    latest = {}
    for r in sorted(got, key=lambda r: (r.n_actions, r.tier == "free")):
        latest[r.owner] = tuple(r)
    want = {r.owner: tuple(r) for r in E.apply_payment_actions(df, as_of=now).collect()}
    assert latest == want
    assert want["u1"][2:4] == ("free", "premium") and want["u2"][2] == "pro" and want["u3"][2] == "free" and want["u4"][2] == "premium"
    assert any(r.owner == "u1" and r.tier == "premium" for r in got)


def test_log_merges_the_buckets_a_batch_touches(spark, tmp_path):
    rows = [("paid", f"r{i}", f"e{i:05d}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)) for i in range(4000)]
    log = spark.createDataFrame(rows, "event_type string, resource_id string, event_id string, ts timestamp")
    newer = log.where("resource_id in ('r1', 'r2')").withColumns({"event_id": F.lit("z"), "ts": F.col("ts") + F.expr("interval 1 day")})
    path = f"{tmp_path}/log"
    merge = S.upsert_buckets(spark, path, 64)
    merge(log, 0)
    first = path_bytes(spark, f"{path}/data/0")
    merge(newer, 1)
    merge(newer, 1)
    assert path_bytes(spark, f"{path}/data/1") < first / 10
    assert sorted(map(str, S.read_log(spark, path, 1).select(log.columns).collect())) == sorted(map(str, E.merchant_log(log.union(newer)).select(log.columns).collect()))
    assert S.read_log(spark, path, 0).count() == 4000
    merge(newer.limit(0), 2)
    merge(log.limit(1), 3)
    assert S.read_log(spark, path, 3).count() == 4000
    assert path_bytes(spark, f"{path}/data/0") < first


def test_signature_and_routing(spark):
    rows = [("t=1000,te=x", 1200), ("t=1000", 1301), ("te=x", 1000), ("t=abc", 1000), (None, 1000)]
    df = spark.createDataFrame(rows, "signature string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.s for r in E.signature_window(df).collect()] == [1200]
    df = spark.createDataFrame([("payment.paid", "u"), ("payment.paid", None), ("other", "u"), ("subscription.unpaid", "u")], "event_type string, owner string")
    assert [r.action for r in E.route_events(df).collect()] == ["activate", "log", "log", "downgrade"]


def test_indent_by_the_usual_one(spark):
    """A clear usual indent that passes makes those near it pass; one that fails does not."""
    from manuscript_jobs.operators import checks as C

    rows = [(1, 0, i, 72 + x, 72, 2) for i, x in enumerate([43, 43, 43, 43, 51, 57, 80])]  # usual 0.60: 0.71 passes by it
    rows += [(2, 0, i, 72 + x, 72, 2) for i, x in enumerate([72, 72, 72, 36])]  # usual 1.0 is wrong
    rows += [(3, 0, 0, 72, 72, 1), (3, 0, 1, 108, 72, 1)]  # nothing to measure against
    df = spark.createDataFrame(rows, "doc_id long, page_index long, paragraph long, first_x long, left_x long, lines long")
    got = {(r.doc_id, r.paragraph): r.verdict for r in C.check_indent_pdf(df).collect()}
    assert [got[1, i] for i in range(7)] == ["pass"] * 5 + ["uncertain" if abs(57 / 72 - 0.5) <= 0.25 else "fail", "fail"]
    assert [got[2, i] for i in range(4)] == ["fail"] * 3 + ["pass"] and [got[3, i] for i in range(2)] == ["uncertain", "pass"]


def test_split_by_label_keeps_shares_of_null_and_large_labels(spark):
    from manuscript_jobs.operators.classify import stratified_split

    rows = [(i, "a") for i in range(900)] + [(1000 + i, None) for i in range(100)]
    got = stratified_split(spark.createDataFrame(rows, "id long, label string"), "label", "id").collect()
    count = {(x, p): sum(r.label == x and r.part == p for r in got) for x in ("a", None) for p in (0, 1, 2)}
    assert count == {("a", 0): 630, ("a", 1): 135, ("a", 2): 135, (None, 0): 70, (None, 1): 15, (None, 2): 15}


def test_document_without_layout_falls_back_to_its_text(spark, tmp_path):
    from manuscript_jobs.sources.readers import read_parsed_documents

    (tmp_path / "parsed.json").write_text('{"doc_id": 1, "text": "parsed", "pages": []}\n')
    own = spark.createDataFrame([(1, "own 1"), (2, "own 2")], "doc_id long, text string")
    got = read_parsed_documents(spark, str(tmp_path), own).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, "parsed"), (2, "own 2")]


def test_rule_model_tells_types_of_unseen_wordings(spark):
    """Three wordings of each rule are learnt; of the fourth, never seen, most are told, and prose is told from rules."""
    from manuscript_jobs.operators import rule_model as R
    from manuscript_jobs.plans.rule_queries import WORDINGS

    rows = [(w.replace("{}", v) + ".", k, i) for k in R.RULE_TYPES for i, w in enumerate(WORDINGS[k][0]) for v in WORDINGS[k][1]]
    prose = [(f"The {a} of {b} was {c} when they came to it.", "other", i % 4) for i, (a, b, c) in enumerate((a, b, c) for a in ("house", "river", "song") for b in ("night", "stone", "morning", "war") for c in ("old", "lost", "bright"))]
    df = spark.createDataFrame(rows + prose, "sentence string, rule_type string, wording int")
    model = R.train_rule_model(df.where("wording < 3"), rounds=25, dimensions=1 << 11)
    got = R.classified(model, df.where("wording = 3")).select("rule_type", "kind").collect()
    told = sum(r.rule_type == r.kind for r in got)
    assert told >= 0.6 * len(got)
    assert all(r.kind == "other" for r in got if r.rule_type == "other")
    assert R.train_rule_model(df.where("wording < 1"), most=20, rounds=2, dimensions=64).stages[0].labels


def test_predicted_rules_fold_in_order(spark):
    from manuscript_jobs.operators import rule_model as R

    rows = [
        (1, 0, "Use Arial.", "font_family", 0.9), (1, 1, "Use Georgia.", "font_family", 0.9), (1, 2, "Use ARIAL again.", "font_family", 0.9), (1, 3, "12 pt", "font_size", 0.9),
        (1, 4, "11 pt", "font_size", 0.9), (1, 5, "99 pt", "font_size", 0.9), (1, 6, "Left margin 1 inch", "margin_left", 0.9), (1, 7, "Left margin 2 in", "margin_left", 0.5),
        (1, 8, "Indent one tab", "paragraph_indent", 0.55), (1, 9, "Legal paper", "paper_size", 0.9), (1, 10, "Any", "font_color", 0.9), (1, 11, "Heading bold", "heading_style", 0.9), (1, 12, "Heading bold", "heading_style", 0.9),
        (2, 0, None, None, None), (3, 0, "prose", "other", 0.99), *[(4, i, f"Tables {i}", "table_layout" if i % 2 else "table_figure_layout", 0.8) for i in range(20)],
    ]
    df = spark.createDataFrame(rows, "guide_id long, at int, sentence string, kind string, confidence double")
    got = {r.guide_id: r for r in R.predicted_rules(df).collect()}
    assert set(got) == {1, 4}
    one = got[1]
    assert one.font.families == ["Georgia", "Arial"] and one.font.type == "Georgia" and one.font.sizes_points == [12.0, 11.0]
    assert one.margins_inches == {"left": 1.0} and one.first_line_indent_inches == 0.5 and one.indention == "0.5 inch"
    assert one.paper.name is None and one.font.color == "Black/Automatic" and one.heading_requirements == ["Heading bold"]
    assert got[4].table_layout_requirements == [f"Tables {i}" for i in range(12)] and got[4].line_spacing is None
    assert R.predicted_rules(df.limit(0)).count() == 0


def test_long_guides_are_guides(spark, tmp_path):
    """A guide is none the less one for over 20,000 words, few of its own, in the query as in its SQL; what is white space is the same in both."""
    import duckdb

    from manuscript_jobs.plans import guide_queries  # noqa: F401
    from manuscript_jobs.plans.registry import QUERIES, oracles

    texts = ["font", " \n", "\va\vb \u2028\n\n", "a \u2028", "\tb \r", None]
    rows = [*enumerate(texts), (22, "word " * 20_100)]  # the sentences put before the last one hold under five guide words
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = QUERIES["guide_or_manuscript"](spark, str(tmp_path)).select("guide_id", "guide_words", "sections_present", "words", "verdict").collect()
    want = duck.execute(f"select guide_id, guide_words, sections_present, words, verdict from ({oracles()['guide_or_manuscript']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and max(r.words or 0 for r in got) > 20_000


def test_assist_items_of_one_place_have_one_order(spark):
    """Whatever the order of the input, items at the same place give the same rows."""
    from itertools import permutations

    from manuscript_jobs.operators import guides as G

    rows = [(1, 5, 4, "b"), (1, 5, 4, "a"), (1, 5, 2, "a"), (1, 7, 3, "b")]
    got = set()
    for order in permutations(rows):
        df = spark.createDataFrame(order, "guide_id long, at long, id long, said string").coalesce(1)
        got.add(tuple(sorted(tuple(r) for r in G.merge_assist_items(df).collect())))
    assert got == {((1, 1, 2, "a"), (1, 2, 3, "b"))}


def test_guide_fonts_margins_and_long_clauses(spark):
    import time

    from pyspark.sql import functions as F

    from manuscript_jobs.operators import guides as G

    texts = ["Use Arial Narrow and arial.", "use times new roman 12", "Centuryx", "word " * 200_000 + "preliminary pages in roman numerals; Table 1 " + "word " * 200_000]
    df = G.with_flat(spark.createDataFrame(list(enumerate(texts)), "guide_id long, text string"))
    began = time.time()
    rows = sorted(G.derive_rules(df).collect())
    assert time.time() - began < 60
    assert [r.font.families for r in rows] == [["Arial Narrow", "Arial"], ["Times New Roman"], [], []]
    assert rows[3].pagination.preliminary == "roman" and rows[3].layout.tables.startswith("Table 1 word")
    assert df.where("guide_id = 0").select(F.size("clauses")).first()[0] >= 1


def test_table_cells_grow_as_by_all_pairs(spark):
    """Neighbours by sorted heights are those of all pairs; a page of 100,000 boxes takes seconds."""
    import time

    import numpy as np

    r = np.random.default_rng(5)
    x, y = r.integers(-50, 50, 400), r.integers(-300, 900, 400)
    cells = r.random(400) < 0.2
    near = (abs(x[:, None] - x[None]) <= 3) & (abs(y[:, None] - y[None]) <= 24)
    assert np.array_equal(layout.near_any(x, y, cells), (near & cells[None]).any(1))
    began = time.time()
    x, y = r.integers(0, 600, 100_000), r.integers(0, 800_000, 100_000)
    layout.near_any(x, y, r.random(100_000) < 0.2)
    assert time.time() - began < 5


def test_excerpts_are_found_as_by_searching_every_page(spark):
    import random

    from manuscript_jobs.operators import locate

    r = random.Random(7)
    word = lambda: r.choice(["alpha", "Beta", "be", "ta be", "É", "gamma delta", "x"])
    pages = [(d, p, " ".join(word() for _ in range(r.randrange(12))) if p != 1 else None) for d in (1, 2, None) for p in range(4)]
    excerpts = [(d, i, " ".join(word() for _ in range(r.randrange(5))), r.choice([None, 0, 3, 9]), bool(i % 2)) for d in (1, 2, 3, None) for i in range(30)]
    p = spark.createDataFrame(pages, "doc_id long, page_index int, text string")
    e = spark.createDataFrame(excerpts, "doc_id long, excerpt_id long, excerpt string, page_index int, paragraph_start boolean")
    needles = {}
    for n in locate.excerpt_needles(e).collect():
        needles.setdefault((n.doc_id, n.excerpt_id, n.page_index), []).append(n.needle)
    want = []
    for (d, x, named), keys in needles.items():
        own = {q: " ".join((t or "").split()).lower() for dd, q, t in pages if dd == d}
        if own:
            hits = [(-len(k), q) for k in keys for q, t in own.items() if k in t]
            want.append((d, x, named if named in own else min(hits)[1] if hits else None))
    got = [tuple(g) for g in locate.locate_excerpts(e, p).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert locate.locate_excerpts(e, p.limit(0)).count() == 0


def test_section_gaps_of_small_guides(spark):
    from manuscript_jobs.operators import guide_schema as K

    guide = ["Some words", "b) Typeface - Arial", "Font type: Times", "Font color:", "Body text size: IGNORE", "Paper", "ignore", "Table layout", "none", "Font", "Font color: Black", "Citation Format:", "Citation style : not  applicable", "citation style: APA"]
    lines = spark.createDataFrame([(1, 1, i + 1, x) for i, x in enumerate(guide)] + [(2, 1, 1, None)], "guide_id long, page int, line int, text string")
    got = sorted(tuple(r) for r in K.section_gaps(lines).collect() if r.guide_id == 1)
    absent = [(1, "missing_category", s, "", 1, 1) for s in ("figure_layout", "margins", "pagination")]
    assert got == sorted([*absent, (1, "missing_value", "font", "font_color", 1, 4), (1, "missing_value", "table_layout", "table_layout", 1, 8)])
    covered = spark.createDataFrame([(1, "figure_layout", "figure_layout"), (1, "font", "font_color"), *[(1, "margins", f[0]) for f in K.FIELDS["margins"][1]], (1, "pagination", "title_page")], "guide_id long, section string, field string")
    assert sorted(tuple(r) for r in K.section_gaps(lines, covered).collect() if r.guide_id == 1) == [(1, "missing_category", "pagination", "", 1, 1), (1, "missing_value", "table_layout", "table_layout", 1, 8)]
    assert K.section_gaps(lines.limit(0)).count() == 0


def test_ignored_rules_go_from_nested_structs(spark):
    from manuscript_jobs.operators import guide_schema as K

    kind = "guide_id long, font struct<heading1_size:double,body_size:double,heading_styles:struct<heading1:string,heading2:string>>, margins_inches map<string,double>, indention string, first_line_indent_inches double, citation_style string, table_layout_requirements array<string>"
    row = ((14.0, 12.0, ("bold", "italic")), {"left": 1.0, "top": 2.0}, "0.5 inch", 0.5, "APA", ["x"])
    rules = spark.createDataFrame([(i, *row) for i in range(5)], kind)
    keys = [(0, "font:heading1_size"), (0, "heading_styles:heading1_style"), (1, "font"), (1, "heading_styles"), (1, "margins"), (2, "paper:indention"), (2, "margins:left"), (2, "no:such"), (3, "table_layout"), (3, "citation_format:citation_style")]
    got = {r.guide_id: r for r in K.without_ignored(rules, spark.createDataFrame(keys, "guide_id long, key string")).collect()}
    assert got[0].font == (None, 12.0, (None, "italic")) and got[0].margins_inches == row[1]
    assert got[1].font is None and got[1].margins_inches is None and got[1].indention == "0.5 inch"
    assert got[2].indention is None and got[2].first_line_indent_inches is None and got[2].margins_inches == {"top": 2.0} and got[2].font == row[0]
    assert got[3].table_layout_requirements is None and got[3].citation_style is None
    assert tuple(got[4])[1:] == row


def test_citation_models_tell_style_and_issue(spark):
    """Held-out citations of other authors, titles and years: styles all told, issues nearly all; nulls have a result."""
    import random

    from manuscript_jobs.plans.rule_queries import CITATIONS

    r, rows = random.Random(1), []
    for i in range(600):
        style, good, bad, issue = CITATIONS[i % 3]
        name = lambda: "".join(r.choice("abdegilmnorstu") for _ in range(r.randrange(3, 9)))
        form = (bad if i // 3 % 2 else good).format(author=name().capitalize(), year=r.randrange(1950, 2030), title=" ".join(name() for _ in range(5)), volume=r.randrange(1, 90), number=r.randrange(1, 90))
        rows.append((i, form, style, issue if i // 3 % 2 else None))
    df = spark.createDataFrame(rows, "id long, text string, style string, issue string")
    models = classify.train_citation_models(df.where("id < 450"), rounds=20, dimensions=1 << 11)
    got = {g.id: g for g in classify.predict_citations(models, df.where("id >= 450").select("id", "text").union(spark.createDataFrame([(-1, None)], "id long, text string"))).collect()}
    assert all(got[i].style == s for i, _, s, _ in rows[450:]) and got[-1].style in ("APA", "IEEE", "MLA")
    assert sum(got[i].issue == x and got[i].compliant == (x is None) for i, _, _, x in rows[450:]) >= 0.95 * 150
