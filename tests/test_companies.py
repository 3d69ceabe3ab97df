"""Companies that records of one batch create, against a walk in order."""

import random

import pytest

from postflow.operators.companies import resolved

RECORD = "at bigint, domain string, name string"


def walk(records, known=()):
    domains, names, has, out = {}, {}, {}, {}
    for company, domain, name in sorted(known):
        has[company] = bool(domain)
        if domain:
            domains.setdefault(domain, company)
        if name:
            names.setdefault(name, company)
    for at, domain, name in sorted(records):
        company = domains.get(domain) if domain else None
        if company is None and name:
            company = names.get(name)
        created = company is None
        if created:
            company = -at - 1
            has[company] = False
            if name:
                names[name] = company
        if domain and not has[company]:
            has[company] = True
            domains.setdefault(domain, company)
        out[at] = (company, created)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_give_what_a_walk_gives(spark, seed):
    r = random.Random(seed)
    pick = lambda n, p: f"k{r.randrange(n)}" if r.random() < p else r.choice([None, "", " "])
    clean = lambda v: (v or "").strip() or None
    n = (12, 40, 8, 25)[seed]
    rows = [(i, pick(n, 0.6), pick(n, 0.8)) for i in range(400)]
    known = [(1000 + i, pick(n, 0.5), pick(n, 0.7)) for i in range(10)] if seed % 2 else []
    known = [(c, d, m) for c, d, m in known if d not in {x[1] for x in known if x[0] < c}]
    r.shuffle(rows)
    got = resolved(spark.createDataFrame(rows, RECORD).repartition(3), spark.createDataFrame(known, "company bigint, domain string, name string") if known else None)
    want = walk([(a, clean(d), clean(m)) for a, d, m in rows], [(c, clean(d), clean(m)) for c, d, m in known])
    assert {x["at"]: (x["company"], x["created"]) for x in got.collect()} == want and any(c for _, c in want.values())


def test_a_key_that_all_share(spark):
    rows = [(i, f"d{i % 7}.example" if i % 3 else None, "acme") for i in range(2000)]
    got = {x["at"]: (x["company"], x["created"]) for x in resolved(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == walk(rows) and {c for c, _ in got.values()} == {-1}
    assert resolved(spark.createDataFrame([], RECORD)).count() == 0
