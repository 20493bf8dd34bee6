import random

from pyspark.sql import functions as F

from alertloom.operators import evaluation as E, incidents as I, serving
from alertloom.sources import sinks
from alertloom.plans import correlation
from helpers import SECOND, alert_rows, alerts_df, vector_rows, vectors_df


def brute_match(faults, incidents, tolerance):
    out = {}
    for f in faults:
        best, dist = None, float("inf")
        base = f["cmdb_id"].rsplit("-", 1)[0] if f["cmdb_id"][-1].isdigit() and "-" in f["cmdb_id"] else f["cmdb_id"]
        for i in incidents:
            t = f["ts_us"]
            if t < i["start_us"] - tolerance * SECOND or t > i["end_us"] + tolerance * SECOND:
                continue
            hit = any(f["cmdb_id"] in s or base in s for s in i["services"])
            d = abs(t - (i["start_us"] + i["end_us"]) / 2) / SECOND + (0 if hit else 100000)
            if d < dist:
                best, dist = (i["incident_id"], hit, f["cmdb_id"] in i["root_service"] or base in i["root_service"]), d
        out[f["fault_id"]] = best
    return out


def test_fault_match_equals_brute_force(spark):
    rng = random.Random(3)
    incidents = []
    for n in range(150):
        start = rng.randrange(-50_000, 50_000)
        length = rng.choice([0, 0, 30, 600, 5000, 90_000])
        services = sorted({f"svc{rng.randrange(12)}-{rng.randrange(2)}" for _ in range(rng.randrange(1, 4))})
        incidents.append(
            dict(incident_no=n, incident_id=f"inc_{n}", start_us=start * SECOND, end_us=(start + length) * SECOND,
                 root_service=services[0], services=services, member_count=len(services))
        )
    faults = [
        dict(fault_id=f"f{n}", ts_us=rng.randrange(-60_000, 60_000) * SECOND, cmdb_id=rng.choice(["svc1", "svc1-0", "svc7-1", "node-3"]),
             level=rng.choice("ab"), failure_type_en=rng.choice("xyz"))
        for n in range(120)
    ]
    inc = spark.createDataFrame(
        [tuple(i.values()) for i in incidents],
        "incident_no long, incident_id string, start_us long, end_us long, root_service string, services array<string>, member_count int",
    )
    flt = spark.createDataFrame([tuple(f.values()) for f in faults], "fault_id string, ts_us long, cmdb_id string, level string, failure_type_en string")
    matched = E.fault_match(flt, inc, 600).cache()
    expected = brute_match(faults, incidents, 600)
    got = {r.fault_id: (r.matched_incident, r.localized, r.root_localized) if r.detected else None for r in matched.collect()}
    assert got == expected
    metrics = E.evaluation_metrics(matched).first()
    hits = [e for e in expected.values() if e]
    assert metrics.total_faults == 120 and metrics.detected == len(hits)
    assert metrics.localization_rate == round(100 * sum(e[1] for e in hits) / len(hits) + 1e-9, 1)
    assert sum(r.total for r in E.breakdown(matched, "level").collect()) == 120
    empty = E.evaluation_metrics(matched.where("false")).first()
    assert (empty.total_faults, empty.detection_rate, empty.root_cause_accuracy) == (0, 0.0, 0.0)


def test_serving_tables(spark, tmp_path):
    alerts, vectors = alerts_df(spark, alert_rows(1)), vectors_df(spark, vector_rows(1))
    found = correlation.correlate(alerts, vectors, window_sec=60, threshold=0.3)
    heads = {h.incident_id: h for h in found.incidents.collect()}
    capped = serving.capped_members(found.members, found.incidents, cap=3)
    rows = capped.collect()
    for iid, head in heads.items():
        mine = [r for r in rows if r.incident_id == iid]
        assert sorted(r.row for r in mine) == list(range(min(3, head.member_count)))
        assert {r.member_count for r in mine} == {head.member_count}
    listed = {r.alert_id: r.id for r in rows}
    for r in serving.root_member_id(capped, found.incidents).collect():
        assert r.root_id == listed.get(heads[r.incident_id].root_alert_id, f"{r.incident_id}_root")
    explained = serving.explanation(found.incidents, I.member_services(found.members)).collect()
    biggest = max(explained, key=lambda r: r.member_count)
    assert f"collapsed {biggest.member_count:,} alerts" in biggest.explanation
    assert serving.queue(found.incidents).count() == len(heads) - 1
    assert all(p.prompt.count("[") >= 1 for p in serving.prompts(found.incidents).collect())
    audit = I.audit(found.members, found.incidents).collect()
    assert len(audit) == 120 and sum(a.role == "root" for a in audit) == len(heads)
    assert all((a.candidate_conf is not None) == (a.role == "root") for a in audit)

    sizes = sorted(h.member_count for h in heads.values())
    dist = I.size_distribution(found.incidents).first()
    assert (dist.min_size, dist.median_size, dist.max_size) == (sizes[0], sizes[len(sizes) // 2], sizes[-1])

    faults = spark.createDataFrame([("f", 0, "svc1", "pod", "x")], "fault_id string, ts_us long, cmdb_id string, level string, failure_type_en string")
    matched = E.fault_match(faults, found.incidents.join(I.member_services(found.members), "component_id"))
    metrics = E.evaluation_metrics(matched)
    sinks.write_incidents_json(found.incidents, str(tmp_path / "incidents"))
    sinks.write_members(capped, str(tmp_path / "members"))
    sinks.write_audit_csv(I.audit(found.members, found.incidents), str(tmp_path / "audit"))
    sinks.write_evaluation(metrics, matched, str(tmp_path / "evaluation"))
    sinks.write_summary(metrics, found.incidents, str(tmp_path / "summary"))
    sinks.write_table(found.members, str(tmp_path / "table"))
    assert spark.read.json(str(tmp_path / "incidents")).count() == len(heads)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "summary")).collect())
    assert f"**Total incidents:** {len(heads)}" in text and "### inc_001: " in text


def test_text_of_small_incident(spark):
    rows = [(0, 0, "cart-1", "FATAL", "disk gone", 0), (1, 65 * SECOND, "pay-0", "WARN", "slow", 0)]
    found = correlation.correlate(alerts_df(spark, rows), vectors_df(spark, [(0, [1.0, 0.0])]))
    line = serving.explanation(found.incidents, I.member_services(found.members)).first().explanation
    assert line == (
        "Correlation collapsed 2 alerts on cart-1 into a single incident spanning 1m 5s. "
        "Root candidate: FATAL — disk gone. Alerts also correlated from: pay-0."
    )
    head = found.incidents.first()
    assert head.title == "cart-1: disk gone"
    tags = found.incidents.select(serving.tags(F.col("root_service"), F.col("root_severity"))).first()[0]
    assert tags == ["CART", "FATAL", "AIOPS", "P1"]
    steps = I.timeline(found.members, found.incidents).orderBy("row").collect()
    assert [(s.t, s.d, s.now) for s in steps] == [("00:01:05", "WARN · slow", False), ("00:00:00", "FATAL · disk gone", True)]


def test_faults_are_not_copied_to_levels(spark):
    inc = spark.createDataFrame(
        [(n, f"inc_{n}", n * 100 * SECOND, (n * 100 + 50_000) * SECOND, "svc1-0", ["svc1-0"], 2) for n in range(20)],
        "incident_no long, incident_id string, start_us long, end_us long, root_service string, services array<string>, member_count int",
    )
    flt = spark.createDataFrame([(f"f{n}", n * 7 * SECOND, "svc1") for n in range(500)], "fault_id string, ts_us long, cmdb_id string")
    matched = E.fault_match(flt, inc, 600)
    assert matched.count() == 500 == matched.where("detected").count()
    lines = matched._jdf.queryExecution().optimizedPlan().toString().splitlines()
    opened = [at for at, line in enumerate(lines) if "Generate explode(" in line]
    # What is opened to levels are the distinct buckets of faults.
    assert opened and all("Aggregate" in "".join(lines[at + 1 : at + 3]) for at in opened), lines
