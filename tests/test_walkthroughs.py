"""The documented service-graph walkthrough: closure, proofs, blast radius and flags have the published numbers."""

from __future__ import annotations

import pytest

from quillgraph import graph
from quillgraph.operators import traverse
from quillgraph.plans.rules import derive

#: Fixed values of the walkthrough: services, libraries and infrastructure with the property that rules read, and who depends on whom.
SLA = {
    "frontend": "tier-1", "api-gateway": "tier-1", "user-service": "tier-1", "order-service": "tier-2", "payment-service": "tier-1", "notification-svc": "tier-3", "analytics-svc": "tier-3",
    "auth-lib": "", "logging-lib": "", "json-parser": "", "PostgreSQL": "tier-1", "Redis": "tier-2", "Kafka": "tier-2", "Elasticsearch": "",
}
DEPENDS = {
    "frontend": {"api-gateway": 0.95, "Elasticsearch": 0.70},
    "api-gateway": {"user-service": 0.95, "order-service": 0.90},
    "order-service": {"payment-service": 0.95, "notification-svc": 0.80, "logging-lib": 0.90, "PostgreSQL": 0.90, "Redis": 0.85},
    "payment-service": {"notification-svc": 0.70, "auth-lib": 0.95, "json-parser": 0.90, "PostgreSQL": 0.95},
    "user-service": {"auth-lib": 0.95, "logging-lib": 0.90, "PostgreSQL": 0.95, "Redis": 0.85},
    "analytics-svc": {"Kafka": 0.90},
    "notification-svc": {"Kafka": 0.90},
}
CLOSURE = """rule transitive_dependency
when edge(A, "depends_on", B)
when edge(B, "depends_on", C)
then edge(A, "depends_on", C, min(e1, e2))"""
VULNERABLE = """rule vuln_propagation
when edge(service, "depends_on", dep)
when prop(dep, "vulnerability", "CVE-2024-1234")
then flag(service, "depends on vulnerable component: CVE-2024-1234")"""
MISMATCH = """rule sla_mismatch
when edge(critical, "depends_on", dep)
when prop(critical, "sla", "tier-1")
when prop(dep, "sla", "tier-3")
then flag(critical, "tier-1 service depends on tier-3 dependency")"""


@pytest.fixture(scope="module")
def services(spark):
    nodes = [{"label": x, "type": "service", "props": {"sla": sla} if sla else {}, "confidence": 0.95} for x, sla in SLA.items()]
    return graph.from_rows(spark, nodes, [{"src": a, "rel": "depends_on", "dst": b, "confidence": c} for a, own in DEPENDS.items() for b, c in own.items()])


def test_closure_and_proof(services):
    assert (services.nodes.count(), services.edges.count()) == (14, 19)
    done = derive(services, CLOSURE)
    assert done.graph.edges.count() == 41 and done.edges.count() == 22
    assert len({r.label for r in traverse.neighbours(done.graph, "frontend").collect()}) == 12
    sure = {(r.src, r.dst): r.confidence for r in done.edges.collect()}
    assert sure[("frontend", "PostgreSQL")] == 0.95 and sure[("api-gateway", "Redis")] == 0.85
    proof = traverse.prove(services, "frontend", "depends_on", "PostgreSQL").first()
    assert proof.supported and proof.chain == "frontend > api-gateway > user-service > PostgreSQL"


def test_flags_and_blast_radius(spark, services):
    done = derive(services, CLOSURE).graph
    hit = done.store(spark.createDataFrame([("Logging-Lib", {"vulnerability": "CVE-2024-1234", "severity": "critical"})], "label string, props map<string,string>"))
    flagged = {r.label for r in derive(hit, VULNERABLE).flags.collect()}
    assert flagged == {"frontend", "api-gateway", "user-service", "order-service"} == {r.label for r in traverse.reach(services, "logging-lib").collect()}
    assert {r.label for r in derive(done, MISMATCH).flags.collect()} == {"frontend", "api-gateway", "payment-service"}
    both = derive(hit, VULNERABLE + "\n" + MISMATCH).graph.nodes.where("label = 'frontend'").first()
    assert both.props["_flag"] == "tier-1 service depends on tier-3 dependency"
