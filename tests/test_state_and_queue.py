"""Folds against a sequential state machine, claims against a sequential poll."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from anchorage import schemas
from anchorage.operators import admission, rules, state
from anchorage.settings import Admission

NOW = datetime(2024, 5, 1, 12)


def sequential(history):
    status, failures = "pending", 0
    for http, error in history:
        found = "unreachable" if error else "broken" if http in (404, 410) else "ok"
        if found == "ok":
            status, failures = "ok", 0
        else:
            failures = min(failures + 1, 3)
            status = found if failures == 3 else status
    return status, failures


def histories(seed: int, n: int):
    r = random.Random(seed)
    choices = [(200, None), (404, None), (None, "timeout"), (500, None), (410, None)]
    return {k: [r.choice(choices) for _ in range(r.randrange(1, 12))] for k in range(n)}


def test_fold_equals_the_state_machine(spark):
    all_of = histories(1, 300)
    rows = [(k * 100 + j, k, NOW + timedelta(minutes=j // 2), h, e, 1, 0) for k, hs in all_of.items() for j, (h, e) in enumerate(hs)]
    random.Random(2).shuffle(rows)
    got = {r.link_id: (r.status, r.consecutive_failures) for r in state.fold(spark.createDataFrame(rows, schemas.struct(schemas.LINK_CHECKS))).collect()}
    assert got == {k: sequential(h) for k, h in all_of.items()}


def test_steps_equal_the_fold(spark):
    all_of = histories(3, 60)
    links = spark.createDataFrame([(k, f"u{k}", "h", NOW, None, NOW, None, None, 0, "pending") for k in all_of], schemas.struct(schemas.LINKS))
    for j in range(3):
        results = [(k, NOW + timedelta(minutes=j), *h[j]) for k, h in all_of.items() if j < len(h)]
        links = state.step(links, spark.createDataFrame(results, "link_id long, checked_at timestamp_ntz, http_status int, error_type string"), 0)
    got = {r.id: (r.status, r.consecutive_failures) for r in links.collect()}
    assert got == {k: sequential(h[:3]) for k, h in all_of.items()}


def test_due_times(spark):
    links = spark.createDataFrame([(k, f"u{k}", "h", NOW, None, NOW, None, None, k, "ok") for k in range(4)], schemas.struct(schemas.LINKS))
    fail = spark.createDataFrame([(k, NOW, 404, None) for k in range(4)], "link_id long, checked_at timestamp_ntz, http_status int, error_type string")
    got = {r.id: r.next_check_at - NOW for r in state.step(links, fail, 0).collect()}
    assert got == {0: timedelta(minutes=60), 1: timedelta(minutes=1440), 2: timedelta(days=1), 3: timedelta(days=1)}
    jittered = [r.next_check_at - NOW for r in state.step(links, fail.selectExpr("link_id", "checked_at", "200 http_status", "error_type")).collect()]
    assert all(timedelta(days=6.3) <= d <= timedelta(days=7.7) for d in jittered) and len(set(jittered)) > 1


def poll(links, page_links, clock, claims, limit, a: Admission):
    """One poll, one link after the other."""
    claims = [c for c in claims if c[3] >= NOW - a.stale_after]
    busy = {c[1] for c in claims}
    flying: dict[str, int] = {}
    for c in claims:
        flying[c[2]] = flying.get(c[2], 0) + 1
    times = dict(clock)
    live = {p for _, p in page_links}
    able = [x for x in links if x[5] <= NOW and x[0] in live and x[0] not in busy]
    able = [x for x in able if times.get(x[2]) is None or times[x[2]] <= NOW - a.interval]
    offers = []
    for host in {x[2] for x in able}:
        offers += sorted((x for x in able if x[2] == host), key=lambda x: (x[5], x[0]))[: max(0, a.per_host - flying.get(host, 0))]
    won = []
    for x in sorted(offers, key=lambda x: (x[5], x[0]))[:limit]:
        if x[2] not in times:
            times[x[2]] = NOW
            won.append(x[0])
        elif times[x[2]] is not None and times[x[2]] <= NOW - a.interval:
            times[x[2]] = NOW
            won.append(x[0])
    return won


def test_claims_equal_a_sequential_poll(spark):
    r = random.Random(7)
    for case in range(6):
        hosts = [f"h{k}" for k in range(6)]
        links = [(k, f"u{k}", r.choice(hosts), NOW, None, NOW + timedelta(minutes=r.randrange(-30, 5)), None, None, 0, "ok") for k in range(60)]
        page_links = [(1, k) for k in range(60) if r.random() < 0.9]
        clock = [(h, r.choice([None, NOW - timedelta(seconds=r.randrange(3))])) for h in hosts if r.random() < 0.6]
        claims = [(k, k, links[k][2], NOW - timedelta(seconds=r.randrange(600))) for k in r.sample(range(60), 8)]
        a = Admission(r.randrange(1, 5), timedelta(seconds=r.choice([0, 1])), timedelta(seconds=300))
        limit = r.randrange(1, 25)
        frames = (
            spark.createDataFrame(links, schemas.struct(schemas.LINKS)),
            spark.createDataFrame([(k, p, x, "", None, None, None, None, NOW) for k, (p, x) in enumerate(page_links)], schemas.struct(schemas.PAGE_LINKS)),
            spark.createDataFrame(clock, schemas.struct(schemas.DOMAIN_STATE)),
            spark.createDataFrame(claims, schemas.struct(schemas.DOMAIN_CLAIMS)),
        )
        got = [x.id for x in admission.claim(*frames, NOW, limit, a, rules=()).collect()]
        assert sorted(got) == sorted(poll(links, page_links, clock, claims, limit, a)), case


def test_rules(spark):
    links = spark.createDataFrame(
        [(1, "a", "web.archive.org"), (2, "b", "x"), (3, "c", "x"), (4, "d", "web.archive.org:443")], "id long, url string, host string"
    )
    places = spark.createDataFrame(
        [(1, "text"), (2, " Source "), (2, "(source)"), (3, "source"), (3, None), (4, "x")], "link_id long, link_text string"
    )
    assert sorted(r.id for r in rules.apply_rules(links, places).collect()) == [3, 4]


def test_leases(spark):
    claims = spark.createDataFrame([(1, 10, "a", NOW - timedelta(hours=1)), (2, 11, "a", NOW)], schemas.struct(schemas.DOMAIN_CLAIMS))
    clock = spark.createDataFrame([("a", None)], schemas.struct(schemas.DOMAIN_STATE))
    links = spark.createDataFrame([(12, "u", "b", NOW, None, NOW, None, None, 0, "ok")], schemas.struct(schemas.LINKS))
    new_clock, new_claims = admission.after_claim(clock, claims, links, NOW)
    assert sorted((r.host, r.last_request_started_at) for r in new_clock.collect() if r.host == "b") == [("b", NOW)]
    assert sorted((r.id, r.link_id) for r in new_claims.collect()) == [(2, 11), (3, 12)]
    assert [r.link_id for r in admission.release(new_claims, links.selectExpr("id link_id")).collect()] == [11]
