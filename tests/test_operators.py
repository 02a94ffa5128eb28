import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice import schemas
from sluice.operators import classify, crawl, dashboard, health, lifecycle, quality, schedule, upsert
from sluice.plans import scan
from sluice.sources import tables

D = dt.date
NOW = dt.datetime(2027, 1, 10, 12)
AS_OF = D(2027, 1, 10)
LISTING = "title string, description string, organisation_name string, source_name string, source_url string, deadline date, ordinal long"
AUDIT = (
    "Request for Proposal: External Audit Services", "Interested firms are invited. Submission deadline 12/03/2027. Technical proposal required.",
    "Acme", "Acme", "https://acme.example/tenders", D(2027, 3, 12), 0,
)


def frame(spark, schema, *rows):
    full = [{f.name: r.get(f.name) for f in schema} for r in rows]
    plain = [tuple(r.values()) for r in full]
    from pyspark.sql import types as T

    return schemas.evolve(spark.createDataFrame(plain, T.StructType([T.StructField(f.name, f.dataType) for f in schema])), schema)


def one(df):
    (r,) = df.collect()
    return r


def test_classifier_accepts_and_explains(spark):
    rows = [AUDIT, (*AUDIT[:5], None, 1)]
    got = classify.classify(spark.createDataFrame(rows, LISTING)).collect()
    assert [(r.category, r.match_score) for r in got] == [("Audit", 63)]
    assert got[0].match_reason == (
        "deadline detected, external audit, external audit services, interested firms, interested firms are invited, request for proposal, "
        "submission deadline, technical proposal"
    )


def test_equal_scores_go_to_the_first_rule(spark):
    row = ("Invitation to tender: tax advisory and bookkeeping", "Submission deadline and eligibility criteria apply; qualified firms.", "", "", "", D(2027, 3, 1), 0)
    df = spark.createDataFrame([row], LISTING)
    best = one(classify.scored(classify.evidence(df)).select("_best"))["_best"]
    assert (best.category, best.score) == ("Accounting", 38)
    assert classify.classify(df).count() == 0


@pytest.mark.parametrize(
    "title,description,url,deadline,ok",
    [
        ("", "request for proposal", "", None, False),
        ("Plain text", "nothing to see", "", None, False),
        ("T", "request for proposal", "", None, True),
        ("T", "rfp", "", None, False),
        ("T", "rfp", "", D(2027, 1, 1), True),
        ("T", "closing date for an audit firm", "", None, True),
        ("T", "closing date", "", None, False),
        ("T", "closing date, job description", "", D(2027, 1, 1), False),
        ("Careers", "closing date, audit firm", "", None, False),
        ("Careers", "tender notice, closing date", "", None, True),
        ("Tender papers", "text", "http://x/a.pdf", None, True),
        ("Holiday photos", "text", "http://x/a.pdf", None, False),
    ],
)
def test_gates(spark, title, description, url, deadline, ok):
    df = spark.createDataFrame([(title, description, "", "", url, deadline, 0)], LISTING)
    assert (classify.evidence(df).where(classify.admitted()).count() == 1) is ok


RESULT = "title string, description string, url string, query string, ordinal int"


def test_source_assessment(spark):
    df = spark.createDataFrame([("Tenders | Rwanda Example Authority", "procurement notices", "https://www.example.gov.rw/tenders?x=1", "q", 0)], RESULT)
    r = one(quality.assess(df))
    assert (r.url_relevance_score, r.confidence_score, r.priority_score, r.accepted) == (40.0, 89.0, 77.85, True)
    assert (r.source_type, r.organisation_name, r.monitor_url) == ("Government Institution", "Rwanda Example Authority", "https://www.example.gov.rw/tenders")


def test_assessment_rejections_in_order(spark):
    rows = [("t", "d", u, "q", i) for i, u in enumerate(["mailto:x", "https://m.facebook.com/x", "https://my-directory.com", "https://a.com/x", "https://b.rw"])]
    rows[3] = ("What is an invitation to bid", *rows[3][1:])
    got = [r.rejection_reason for r in quality.assess(spark.createDataFrame(rows, RESULT)).orderBy("ordinal").collect()]
    assert [g.split()[0] for g in got] == ["Invalid", "Blocked", "The", "The", "Confidence"] and got[2] != got[3]


def test_weighted_signals_and_outcomes(spark):
    rows = [
        ("Tender", "procurement", "https://a.rw/x", "q", 0), ("Tender", "procurement", "https://a.rw/x?utm_source=1", "q", 1), ("t", "d", "https://b.com", "q", 2),
        ("Tender", "procurement", "https://x.com/y", "q", 3), ("Tender", "procurement", "https://known.rw/", "q", 4),
    ]
    df = spark.createDataFrame(rows, RESULT)
    r = quality.weighted_signals(df).orderBy("ordinal").first()
    assert (r.source_type, r.confidence_score, r.reasons) == ("Procurement", 55.0, ["Rwanda domain", "procurement", "tender"])
    known = spark.createDataFrame([("https://known.rw/",)], "monitor_url string")
    got = {r.ordinal: r.outcome for r in quality.outcomes(df, known).collect()}
    assert got == {0: "saved", 1: "duplicate", 2: "rejected", 3: "ignored", 4: "duplicate"}
    n = one(quality.outcome_counts(quality.outcomes(df, known)))
    assert (n.results, n.saved, n.duplicates, n.rejected, n.ignored) == (5, 1, 2, 2, 1)


def opp(**k):
    return {"title": "t", "source_name": "s", "source_url": "u", "status": "New", "is_expired": False, "is_lead": False, **k}


@pytest.mark.parametrize(
    "deadline,status,want",
    [
        (D(2027, 1, 1), "Interested", ("Expired", True)), (D(2027, 1, 1), "Applied", ("Applied", True)), (D(2027, 2, 1), "Expired", ("New", False)),
        (None, "Expired", ("New", False)), (AS_OF, "Seen", ("Seen", False)),
    ],
)
def test_expiry(spark, deadline, status, want):
    df = frame(spark, schemas.OPPORTUNITIES, opp(deadline=deadline, status=status))
    r = one(lifecycle.apply_expiry(df, F.lit(AS_OF)))
    assert (r.status, r.is_expired) == want
    again = one(lifecycle.apply_expiry(lifecycle.apply_expiry(df, F.lit(AS_OF)).drop("changed"), F.lit(AS_OF)))
    assert not again.changed
    if deadline is None:
        assert one(lifecycle.apply_expiry(df, F.lit(AS_OF), only_dated=True)).status == status


def test_manual_transitions(spark):
    df = frame(spark, schemas.OPPORTUNITIES, opp(id=1, deadline=D(2027, 1, 1), is_expired=True, status="Expired"), opp(id=2, source_url="v"))
    got = {r.id: (r.status, r.is_expired) for r in lifecycle.set_status(df, F.lit("Seen"), F.lit(AS_OF)).collect()}
    assert got == {1: ("Seen", True), 2: ("Seen", False)}
    with pytest.raises(Exception, match="Invalid status"):
        lifecycle.set_status(df, F.lit("Nope"), F.lit(AS_OF)).collect()
    assert [r.status for r in lifecycle.view(df).orderBy("id").collect()] == ["Expired", "Seen"]
    lead = lifecycle.add_to_pipeline(df)
    assert {(r.is_lead, r.status, r.lead_status, r.lead_priority) for r in lead.collect()} == {(True, "Interested", "Under Review", "Medium")}
    assert {r.is_lead for r in lifecycle.remove_from_pipeline(lead).collect()} == {False}
    form = "id long, lead_status string, lead_priority string, assigned_to string, next_action string, next_action_due date, last_follow_up_date date, lead_notes string"
    events = spark.createDataFrame([(1, "Submitted", "High", " Bo ", "", AS_OF, None, None), (2, " ", "Low", None, None, None, None, None)], form)
    got = {r.id: (r.status, r.lead_status, r.assigned_to, r.next_action) for r in lifecycle.update_pipeline(lead, events).collect()}
    assert got == {1: ("Applied", "Submitted", "Bo", None), 2: ("Interested", None, None, None)}
    assert {r.status for r in lifecycle.update_pipeline(df, events).collect()} == {"Expired", "New"}


BATCH = LISTING + ", category string, match_score int, match_reason string"


def test_opportunity_upsert(spark):
    old = frame(spark, schemas.OPPORTUNITIES, opp(id=1, organisation_name="A", deadline=D(2027, 5, 1), category="X", match_score=60, source_url="u"), opp(id=2, source_url="w"))
    rows = [
        ("t2", "", "", "s", "u", None, 0, "Y", 70, "r"), ("t3", "d3", "", "s", "u", None, 1, "Z", 71, "r"), ("new", "d", "Org - ", "s", "n", D(2027, 1, 1), 2, "Y", 80, "r"),
    ]
    batch = spark.createDataFrame(rows, BATCH)
    out = upsert.upsert_opportunities(old, batch, F.lit(NOW), F.lit(AS_OF))
    got = {r.source_url: r for r in out.collect()}
    assert len(got) == 3 and got["w"].action == "keep" and got["w"].updated_at is None
    u, n = got["u"], got["n"]
    assert (u.organisation_name, u.title, u.description, u.deadline, u.category, u.match_score, u.action) == ("A", "t3", "d3", D(2027, 5, 1), "Z", 71, "update")
    assert u.changed and u.last_seen_at == NOW and u.updated_at == NOW
    assert (n.organisation_name, n.status, n.is_expired, n.first_discovered_at, n.action) == ("Org", "Expired", True, NOW, "insert")
    again = upsert.upsert_opportunities(out.drop("action", "changed"), batch, F.lit(NOW), F.lit(AS_OF)).collect()
    assert not any(r.changed for r in again) and len(again) == 3


def test_source_upserts(spark):
    old = frame(spark, schemas.SOURCES, {"id": 1, "base_url": "b", "monitor_url": "https://a.rw/", "domain": "a.rw", "confidence_score": 50.0},
                {"id": 2, "base_url": "b", "monitor_url": "https://c.rw", "domain": "c.rw", "organisation_name": "C", "source_type": "NGO", "is_active": False, "url_relevance_score": 90.0})
    cols = "monitor_url string, base_url string, domain string, organisation_name string, source_type string, discovered_from string, discovery_query string, confidence_score double, ordinal long"
    batch = spark.createDataFrame([
        ("https://a.rw/", "b", "a.rw", "A", "Procurement", "api", "q", 40.0, 0), ("https://n.rw/", "b", "n.rw", None, "", "api", "q", 45.0, 1),
        ("https://n.rw/", "b", "n.rw", "N", "Careers", "api", "q2", 70.0, 2),
    ], cols)
    got = {r.monitor_url: r for r in upsert.upsert_sources_by_url(old, batch, F.lit(NOW)).collect()}
    a, n = got["https://a.rw/"], got["https://n.rw/"]
    assert (a.confidence_score, a.source_type, a.organisation_name, a.action) == (50.0, "Procurement", "A", "update")
    assert (n.confidence_score, n.source_type, n.organisation_name, n.is_approved, n.scan_interval_hours, n.action) == (70.0, "Careers", "N", False, 12, "insert")
    more = batch.withColumns({"priority_score": F.lit(60.0), "url_relevance_score": F.lit(10.0)})
    extra = more.limit(0).unionByName(spark.createDataFrame([("https://c.rw/x", "b", "c.rw", "CC", "Unknown", "api", "q", 99.0, 7, 70.0, 5.0)], cols + ", priority_score double, url_relevance_score double"))
    got = {(r.id, r.domain): r for r in upsert.upsert_candidates(old, more.unionByName(extra), F.lit(NOW)).collect()}
    c = got[2, "c.rw"]
    assert (c.confidence_score, c.monitor_url, c.organisation_name, c.source_type, c.is_active, c.priority_score) == (99.0, "https://c.rw", "C", "NGO", True, 70.0)
    assert got[None, "n.rw"].confidence_score == 70.0 and len(got) == 3
    seeded = upsert.seed_sources(old, tables.seeds(spark), F.lit(NOW))
    assert seeded.where("action = 'insert'").agg(F.count("*"), F.min("confidence_score")).first() == (10, 100.0)
    assert upsert.seed_sources(seeded.drop("action"), tables.seeds(spark), F.lit(NOW)).where("action = 'insert'").count() == 0


def test_dedupes(spark):
    rows = [("u", "a", "xx", "", 0), ("u", "b", "xx", "", 1), ("u", "bb", "xx", "", 2), ("v", "c", "", "", 3)]
    df = spark.createDataFrame(rows, "listing_url string, title string, card_text string, organisation_name string, ordinal int")
    assert {r.listing_url: r.title for r in upsert.dedupe_richest(df).collect()} == {"u": "bb", "v": "c"}
    assert {r.listing_url: r.title for r in upsert.dedupe_richest(df.where("ordinal < 2")).collect()} == {"u": "a"}
    last = {r.listing_url: (r.title, r.ordinal) for r in upsert.dedupe_last(df, "listing_url").collect()}
    assert last == {"u": ("bb", 0), "v": ("c", 3)}


def test_health(spark, values):
    got = values("c double, u double, f int, n int, ok boolean, off boolean", [(80.0, 40.0, 3, 2, True, False), (80.0, 40.0, 3, 2, True, True)],
                 quality.health_priority(*map(F.col, ("c", "u", "f", "n", "ok", "off"))))
    assert got == [53.0, 0.0]
    src = frame(spark, schemas.SOURCES, *[{"id": i, "base_url": "", "monitor_url": str(i), "domain": "", "consecutive_failures": 8} for i in (1, 2, 3)])
    ev = [(1, 1, False, 0), (1, 2, False, 0), (2, 1, False, 0), (2, 2, True, 3), (2, 3, False, 0)]
    rows = [(s, dt.datetime(2027, 1, t), t, ok, 1.23456, 500, n, "boom" * 200) for s, t, ok, n in ev]
    events = spark.createDataFrame(rows, "source_id long, ts timestamp, seq long, ok boolean, duration_seconds double, http_status int, opportunities_found int, error_message string")
    got = {r.id: r for r in health.apply_scans(src, events).collect()}
    assert (got[1].is_auto_disabled, got[1].is_active, got[1].consecutive_failures, got[1].priority_score) == (True, False, 10, 0.0)
    assert got[1].disabled_reason.endswith("boom" * 75) and got[1].last_http_status == 500
    assert (got[2].consecutive_failures, got[2].total_opportunities_found, got[2].is_auto_disabled, got[2].last_scan_duration_seconds) == (1, 3, False, 1.235)
    assert got[3].consecutive_failures == 8 and got[3].last_scanned_at is None
    assert {(r.source_id, r.seq): r.streak for r in health.failure_streaks(events).collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 1, (2, 2): 0, (2, 3): 1}


def test_jobs(spark):
    state = frame(spark, schemas.JOB_STATE, {"job_name": "scan", "last_success": NOW})
    assert [r.job_name for r in schedule.due_jobs(state, F.lit(NOW), {"scan": 24, "find": 120}).collect()] == ["find"]
    out = schedule.record_run(schedule.record_run(state, "find", F.lit(NOW), None), "find", F.lit(NOW), False, 1.23456, "e" * 2000)
    r = one(out.where("job_name = 'find'"))
    assert (r.status, r.duration_seconds, len(r.last_error), r.last_started) == ("failed", 1.235, 1000, NOW) and out.count() == 2


def test_crawl(spark):
    text = "Request for proposal. " * 8
    html = {
        "https://a.rw/": "<h1>Home</h1><a href='/tenders'>Tenders</a><a href='/x'>nothing</a><a href='https://b.rw/tender'>tender</a><a href='/jobs/tender'>tender</a>",
        "https://a.rw/tenders": f"<h1>RFP one</h1><article>{text} Deadline: 3rd March 2027</article><a href='/docs/request-for-proposal-terms-of-reference-and-invitation-to-bid-for-the-audit.pdf'>tender</a>",
    }
    pages = spark.createDataFrame(list(html.items()), "url string, html string")
    src = spark.createDataFrame([(1, "https://a.rw", "https://a.rw/", "a.rw", None)], "id long, monitor_url string, base_url string, domain string, organisation_name string")
    edges = crawl.link_edges(pages)
    assert {r.url for r in edges.collect() if r.page_url == "https://a.rw/"} == {"https://a.rw/tenders"}
    got = crawl.crawl(src, edges, pages)
    assert [(r.depth, r.url.rsplit("/", 1)[1][:8]) for r in got.orderBy("position").collect()] == [(0, ""), (1, "tenders"), (2, "request-")]
    assert crawl.crawl(src, edges, pages, max_pages=2).count() == 2
    bad = spark.createDataFrame([("https://a.rw/tenders",)], "url string")
    assert crawl.crawl(src, edges, pages, bad).count() == 1
    rules = "host string, agent string, ordinal int, path string, allow boolean"
    asked = [("*", 0, "/tend", False)]
    robots = lambda rows: spark.createDataFrame([("a.rw", *r) for r in rows], rules)
    assert crawl.crawl(src, edges, pages, robots=robots(asked)).count() == 1
    for more, n in (
        ([("*", -1, "/tenders", True)], 0), ([("sluice", 5, "/docs", False)], 0), ([("Other", -1, "/", False)], 1), ([("*", -1, "", False)], 0), ([("*", -1, "*", True)], 0),
    ):
        assert crawl.forbidden(edges, robots(asked + more)).where("url like '%tenders'").count() == n
    assert crawl.forbidden(edges, robots([])).count() == 0 == crawl.forbidden(edges.limit(0), robots(asked)).count()
    rows = crawl.page_listings(got, pages, src).collect()
    assert any(r.title == "RFP one" and r.deadline == D(2027, 3, 3) for r in rows)
    found = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "a"), ("s", 3, "c"), ("t", 0, None)], "section string, page int, listing_url string")
    sections = spark.createDataFrame([("s",), ("t",)], "section string")
    assert sorted((r.section, r.page) for r in crawl.section_pages(sections, found).collect()) == [("s", 0), ("s", 1)]


def test_portal(spark):
    cards = spark.createDataFrame([("https://p.example/job/a", "Card", "Card | Acme | Deadline: 05-06-2027", "Acme", 0), ("https://p.example/job/b", "B", "text", "", 1)],
                                  "listing_url string, title string, card_text string, organisation_name string, ordinal long")
    details = spark.createDataFrame([("https://p.example/job/a", "<title>Full title | Jobs</title><p>nothing</p>")], "listing_url string, html string")
    got = {r.ordinal: r for r in crawl.portal_listings(cards, details, "Portal", (("|", "Jobs"),)).collect()}
    assert (got[0].title, got[0].organisation_name, got[0].deadline) == ("Full title", "Acme", D(2027, 6, 5))
    assert (got[1].title, got[1].organisation_name, got[1].deadline) == ("B", "Not specified", None)


def test_dashboard(spark):
    rows = [
        opp(id=1, source_url="1", category="Audit", organisation_name="Água", deadline=AS_OF), opp(id=2, source_url="2", deadline=D(2027, 1, 17), status="Seen"),
        opp(id=3, source_url="3", deadline=D(2027, 1, 18), is_expired=True, title="100% sure"), opp(id=4, source_url="4", category=""),
    ]
    df = frame(spark, schemas.OPPORTUNITIES, *rows)
    ids = lambda **k: [r.id for r in dashboard.dashboard(df, F.lit(AS_OF), **k).collect()]
    assert ids() == [1, 2, 4, 3] and ids(q=" % ") == [1, 2, 4, 3] and ids(q="SURE") == [3] and ids(q="") == [1, 2, 4, 3]
    assert ids(deadline="due_7_days") == [1, 2] and ids(deadline="due_30_days") == [1, 2, 3] and ids(deadline="no_deadline") == [4]
    assert ids(deadline="open") == [1, 2, 4, 3] and ids(deadline="expired") == [3] and ids(deadline="?") == [1, 2, 4, 3] and ids(status="Seen") == [2]
    assert [(r.status, r.n) for r in dashboard.status_counts(df).collect()] == [("New", 3), ("Seen", 1), ("Interested", 0), ("Applied", 0), ("Rejected", 0), ("Expired", 0)]
    assert [r.category for r in dashboard.categories(df).collect()] == ["Audit"]
    card = dashboard.cards(df).where("id = 4").first()
    assert (card.category, card.organisation, card.deadline_label, card.score_label) == ("Uncategorised", "Organisation not specified", "Not identified", "Not scored")
    assert one(dashboard.detail(df, 1)).deadline_label == "10 January 2027" and dashboard.detail(df, 9).count() == 0
    leads = lifecycle.add_to_pipeline(df).withColumn("next_action_due", F.when(F.col("id") == 1, F.lit(AS_OF)).when(F.col("id") == 2, F.lit(D(2027, 1, 1))))
    assert [r.due_label for r in dashboard.pipeline(leads, F.lit(AS_OF)).collect()] == ["Due Today", "Overdue", "Not scheduled", "Not scheduled"]
    k = one(dashboard.kpis(leads, F.lit(AS_OF)))
    assert (k.total, k.pipeline_count, k.follow_up_today, k.overdue_followups, k.closing_this_week) == (4, 4, 1, 1, 2)


def test_queue_and_approval(spark):
    src = frame(spark, schemas.SOURCES, *[
        {"id": i, "base_url": "", "monitor_url": str(i), "domain": "", "organisation_name": n, "priority_score": p, "is_approved": i != 1, "last_scanned_at": t}
        for i, n, p, t in [(1, "b", 50.0, None), (2, "a", 50.0, None), (3, None, 50.0, None), (4, "z", 90.0, NOW)]
    ])
    assert [r.id for r in dashboard.scan_queue(src, F.lit(NOW)).collect()] == [3, 2, 1]
    done = upsert.approve_sources(src)
    assert done.where("newly_approved").count() == 1 and done.where("is_approved").count() == 4
    assert upsert.repair_for_scan(src.withColumn("scan_interval_hours", F.lit(0))).first().scan_interval_hours == 24


def test_schemas_and_backfill(spark):
    thin = spark.createDataFrame([("t", "s", "u", NOW)], "title string, source_name string, source_url string, created_at timestamp")
    assert "status" in schemas.missing_columns(thin, schemas.OPPORTUNITIES)
    full = schemas.evolve(thin, schemas.OPPORTUNITIES)
    schemas.require_empty(full.limit(0), "t")
    with pytest.raises(ValueError, match="not empty"):
        schemas.require_empty(full, "t")
    assert full.columns == schemas.OPPORTUNITIES.names and full.first().status == "New"
    r = one(upsert.backfill(full.withColumn("status", F.lit(" ")), F.lit(NOW)))
    assert (r.status, r.last_seen_at, r.is_expired) == ("New", NOW, False)
    joined = dashboard.with_lead_and_proposal(full.withColumn("id", F.lit(1).cast("long")), frame(spark, schemas.LEADS, {"opportunity_id": 1}), frame(spark, schemas.PROPOSALS, {"opportunity_id": 2}))
    assert one(joined).lead.status == "Under Review" and one(joined).proposal is None


def test_state_and_payloads(spark):
    docs = spark.createDataFrame([('{"scan": {"last_success": "2027-01-01T00:00:00Z", "status": "completed"}}',), ("broken",)], "value string")
    assert [(r.job_name, r.last_success) for r in tables.parse_state(docs).collect()] == [("scan", dt.datetime(2027, 1, 1))]
    payload = '{"web": {"results": [{"title": " A  b ", "url": "https://x"}, {"title": "", "url": "https://y"}, {"title": "z", "url": "ftp://q"}]}}'
    df = spark.createDataFrame([("q", payload), ("r", "no json")], "query string, payload string")
    assert [(r.title, r.url) for r in tables.search_results(df).collect()] == [("A b", "https://x"), ("z", "ftp://q")]
    assert tables.search_results(df, http_only=True).count() == 1
    assert tables.queries(spark, "discovery").count() == 53 and tables.queries(spark, first=3).count() == 3


def test_whole_scan_and_stream(spark, tmp_path):
    from sluice.sources.snapshots import KeyedTable
    from sluice.streaming import listings as streaming

    found = {"a": spark.createDataFrame([AUDIT], LISTING), "b": spark.createDataFrame([(*AUDIT[:4], "https://b", *AUDIT[5:]), ("x", "y", "", "", "z", None, 1)], LISTING)}
    rows = scan.gather(found)
    empty = frame(spark, schemas.OPPORTUNITIES)
    out = scan.run_scan(empty, rows, F.lit(NOW), F.lit(AS_OF))
    accepted = classify.classify(rows)
    got = {r.scanner: (r.found, r.relevant, r.saved, r.updated) for r in scan.counters(rows, accepted, out).collect()}
    assert got == {"a": (1, 1, 1, 0), "b": (2, 1, 1, 0)}
    src, root = f"{tmp_path}/in", f"file://{tmp_path}/opps"
    rows.drop("scanner").write.parquet(src)
    q = streaming.stream_listings(spark.readStream.schema(rows.drop("scanner").schema).parquet(src), root, f"{tmp_path}/ck", lambda: (F.lit(NOW), F.lit(AS_OF)))
    q.awaitTermination(120)
    assert q.exception() is None and KeyedTable(spark, root).read().count() == 2


def test_job_state_is_written_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    rows = frame(spark, schemas.JOB_STATE, {"job_name": "scan", "status": "ok", "last_success": NOW, "duration_seconds": 1.5}, {"job_name": "find", "status": "failed", "last_error": "x"})
    for _ in range(2):
        tables.write_state(rows, path)
    got = {r.job_name: r for r in tables.parse_state(spark.read.text(path, wholetext=True)).collect()}
    assert set(got) == {"scan", "find"} and got["scan"].last_success == NOW and got["find"].last_error == "x" and got["scan"].duration_seconds == 1.5


def test_a_scanner_that_fails_does_not_stop_the_others(spark):
    cards = spark.createDataFrame([("https://p/1", "T", "text", "Acme Ltd", 0)], "listing_url string, title string, card_text string, organisation_name string, ordinal long")
    details = spark.createDataFrame([], "listing_url string, html string")
    assert scan.scanner_names()[:2] == ["portal", "websites"]
    failed, found = scan.run_scanners({"websites": {"sources": cards, "pages": details}, "portal": {"cards": cards, "details": details, "portal_name": "P"}})
    assert [r.scanner for r in failed.collect()] == ["websites"] and [r.scanner for r in found.collect()] == ["portal"]


def test_a_scanner_that_fails_while_running_is_counted_and_the_others_are_saved(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from sluice.sources.snapshots import KeyedTable

    table = KeyedTable(spark, f"file://{tmp_path}/t")
    table.create(frame(spark, schemas.OPPORTUNITIES), "source_url", 4)
    rows = spark.createDataFrame([AUDIT, (*AUDIT[:4], "https://b", *AUDIT[5:]), ("", "y", "", "", "z", None, 1), ("t", "y", "", "", None, None, 2), ("x", "y", "", "", "z", None, 3)], LISTING)

    @F.udf("string")
    def broken(x):
        raise ValueError("no such page")

    monkeypatch.setitem(scan.SCANNERS, "portal", lambda rows: rows.withColumn("description", broken("title")))
    monkeypatch.setitem(scan.SCANNERS, "websites", lambda rows: rows)
    monkeypatch.setitem(scan.SCANNERS, "planned", lambda rows: rows.select("nothing"))
    try:
        for saved, updated in ((2, 0), (0, 2)):
            out = scan.scan_into(table, {n: {"rows": rows} for n in ("portal", "websites", "planned")}, F.lit(NOW), F.lit(AS_OF), f"file://{tmp_path}/run")
            got = {r.scanner: r for r in out.collect()}
            assert "no such page" in got["portal"].problem and got["portal"].saved is None and "AnalysisException" in got["planned"].problem
            assert tuple(got["websites"])[1:] == (5, 2, saved, updated, 1, 1, None)
            assert tuple(scan.totals(out).first()) == (5, 2, saved, updated, 1, 1, 2)
    finally:
        monkeypatch.undo()
    assert {r.source_url for r in table.read().collect()} == {AUDIT[4], "https://b"}


def test_rows_one_at_a_time_are_what_the_row_by_row_fold_gives(spark):
    """Random histories of several keys against one upsert a row."""
    import random

    rng = random.Random(3)
    past, future = D(2026, 1, 1), D(2028, 1, 1)
    statuses = ["New", "Seen", "Interested", "Applied", "Expired", "Rejected"]
    old = [opp(source_url=f"u{i}", status=rng.choice(statuses), deadline=rng.choice([None, past, future]), is_expired=False, title="t") for i in range(20)]
    rows = [("t", "", "", "s", f"u{rng.randrange(30)}", rng.choice([None, past, future]), i, "Y", 70, "r") for i in range(60)]
    stored = frame(spark, schemas.OPPORTUNITIES, *old)
    got = upsert.upsert_opportunities(stored, spark.createDataFrame(rows, BATCH), F.lit(NOW), F.lit(AS_OF), row_by_row=True)
    state = {r["source_url"]: (r["status"], r["deadline"], r["is_expired"]) for r in old}
    for r in rows:
        key, deadline = r[4], r[5]
        status, kept, _ = state.get(key, (None, None, None))
        deadline = deadline or kept
        gone = deadline is not None and deadline < AS_OF
        if status is None:
            status = "Expired" if gone else "New"
        elif gone and status in ("New", "Seen", "Interested"):
            status = "Expired"
        elif not gone and status == "Expired":
            status = "New"
        state[key] = (status, deadline, gone)
    assert {r.source_url: (r.status, r.deadline, r.is_expired) for r in got.collect()} == state


def test_a_wide_site_is_cut_level_by_level(spark):
    """A start page with 500 links whose pages have 40 each: 30 pages are visited, and no level carries more."""
    url = "https://a.example"
    src = spark.createDataFrame([(1, url, url, "a.example")], "id long, monitor_url string, base_url string, domain string")
    rows = [(f"{url}/", f"{url}/p{i}", i + 1) for i in range(500)] + [(f"{url}/p{i}", f"{url}/p{i}/q{j}", j + 1) for i in range(500) for j in range(40)]
    edges = spark.createDataFrame(rows, "page_url string, url string, rank int")
    pages = edges.select("url").union(spark.createDataFrame([(f"{url}/",)], "url string")).distinct()
    out = crawl.crawl(src, edges, pages)
    got = sorted((r.position, r.url, r.depth) for r in out.collect())
    assert got == [(1, f"{url}/", 0)] + [(i + 2, f"{url}/p{i}", 1) for i in range(29)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    narrow = crawl.crawl(src, edges.where("rank <= 3"), pages, max_pages=8).orderBy("position").collect()
    assert [r.url.removeprefix(url) for r in narrow] == ["/", "/p0", "/p1", "/p2", "/p0/q0", "/p0/q1", "/p0/q2", "/p1/q0"]
