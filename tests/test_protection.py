"""Protected items of a text and its manifest."""

from glossa.operators import protection

TEXT = "The team must not deploy `adr-12 must` before at least 5 days and two reviews [R1] by ADR-12 at https://x.y/z ok. No waiver may change the approval; it cannot approve >= 3 kg."
WANT = [
    ("url", "https://x.y/z", "https://x.y/z"), ("code", "`adr-12 must`", "`adr-12 must`"), ("citation", "[R1]", "[R1]"), ("identifier", "ADR-12", "ADR-12"),
    ("quantity", "at least 5 days", "operator=gte;unit=day;value=5"), ("quantity", "two", "operator=eq;value=2"), ("quantity", ">= 3 kg", "operator=gte;unit=kg;value=3"),
    ("modal", "must not", "must not"), ("modal", "may", "may"), ("modal", "cannot", "cannot"), ("negation", "No", "no"),
    ("governance", "waiver", "waiver"), ("governance", "approval", "approv"), ("governance", "approve", "approv"),
]


def test_protected_items(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r["items"] for r in protection.protected(docs).collect()}
    assert [(i.kind, i.item, i.normalized) for i in got[1]] == WANT and got[2] == got[3] == []
    assert all(TEXT[i.start : i.end] == i.item for i in got[1])


def test_manifests_compare(spark):
    texts = [(1, "The team must approve 2 plans."), (2, "Two plans must be approved by the team."), (3, "The team may approve 2 plans."), (4, None)]
    got = {r.doc_id: r for r in protection.manifest(spark.createDataFrame(texts, "doc_id int, text string")).collect()}
    assert got[1].sha256 == got[2].sha256 != got[3].sha256 and got[1].n_modal == got[3].n_modal == 1 and got[4].n_items == 0
