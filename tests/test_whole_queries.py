"""Registered queries against brute force over the whole tables."""

from collections import Counter, defaultdict, deque
from datetime import timedelta
from math import sqrt

from riskloom.plans import queries as own
from riskloom.sources import adapters

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_distance_to_every_seed(spark):
    met = defaultdict(list)
    for r in adapters.claims(spark, MIDDLE, "beneficiary_id").select("provider_npi", "beneficiary_id", "date_of_service").collect():
        met[r.beneficiary_id].append((r.provider_npi, r.date_of_service))
    near = defaultdict(set)
    for group in met.values():
        for p, t in group:
            near[p] |= {q for q, u in group if abs(u - t) <= timedelta(days=30)} - {p}
    seeds = {r.entity_npi for r in adapters.exclusions(spark, MIDDLE).collect()}
    depth = dict.fromkeys(seeds, 0)
    queue = deque(seeds)
    while queue:
        p = queue.popleft()
        for o in near[p] - set(depth):
            depth[o] = depth[p] + 1
            queue.append(o)
    expected = {r.npi: depth.get(r.npi, -1) for r in adapters.providers(spark, MIDDLE).collect()}
    assert len(seeds) == 10
    assert {r.node_id: r.distance for r in own.queries()["distance_to_seeds"](spark, MIDDLE).collect()} == expected


def test_statistics_count_every_edge_type(spark):
    visits, codes = defaultdict(list), defaultdict(Counter)
    for r in adapters.claims(spark, SMALL, "beneficiary_id", "procedure_code").collect():
        visits[r.beneficiary_id].append((r.provider_npi, r.claim_id, r.date_of_service))
        codes[r.provider_npi][r.procedure_code] += 1
    wide = timedelta(days=30)
    co_bills = {(b, p, q, c, t) for b, v in visits.items() for p, c, t in v for q, _, u in v if p < q and abs(u - t) <= wide}
    norm = {p: sqrt(sum(n * n for n in v.values())) for p, v in codes.items()}
    alike = [(p, q) for p in codes for q in codes if p < q and sum(n * codes[q][c] for c, n in codes[p].items()) / norm[p] / norm[q] >= 0.8]
    got = {(r.kind, r.type): r.n for r in own.queries()["graph_statistics"](spark, SMALL).collect()}
    assert alike and got["edge", "SIMILAR_BILLING_PATTERN"] == len(alike)
    assert got["edge", "CO_BILLS_WITH"] == len(co_bills)
    assert got["edge", "total"] == sum(n for (kind, type_), n in got.items() if kind == "edge" and type_ != "total")
