"""Names, notices, regions, clustering, preferences and states on rows that the tables do not hold."""

import itertools

import pytest
from pyspark.sql import functions as F

from postflow.functions import authorization, places, text
from postflow.operators import dedupe, preferences, rules
from postflow.queries.posting import TRANSITIONS


def column(spark, f, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_company_names_of_all_scripts(spark):
    raw = ["株式会社テスト", "Яндекс ООО", "Škoda a.s.", "Łódź Sp", "Acme, Inc.", "Ünïcode GmbH", "Inc", None, "ＦＵＬＬ"]
    assert column(spark, text.normalize_company_name, raw) == ["株式会社テスト", "яндекс ооо", "skoda a s", "łodz sp", "acme", "unicode", "inc", "", "full"]


def test_closing_phrases(spark):
    said = [f"x. {p.upper()} y" for p in text.CLOSED]
    assert column(spark, text.says_closed, [*said, "The office is no longer open.", "Apply now", ""]) == [True] * 10 + [False] * 3


def test_regions(spark):
    df = spark.createDataFrame([(["europe", "Worldwide"],), (["EMEA"],), (["apac", "atlantis"],), ([],)], "x array<string>")
    got = [r["y"] for r in df.select(places.resolve_regions(F.col("x")).alias("y")).collect()]
    assert len(got[0]["codes"]) == 39 and got[0]["worldwide"] and "TR" in got[0]["codes"]
    assert "AE" in got[1]["codes"] and "DE" in got[1]["codes"] and not {"US", "JP", "BR"} & set(got[1]["codes"])
    assert "IN" in got[2]["codes"] and got[3]["codes"] == []


def test_states():
    assert len(TRANSITIONS) == 11 and all(set(b) <= set(TRANSITIONS) for b in TRANSITIONS.values())
    assert TRANSITIONS["ghosted"] == ("screening", "interview", "rejected") and not TRANSITIONS["rejected"]


RECORD = "key bigint, block string, hi bigint, lo bigint, country string, city string, seniority string"


def greedy(rows, most=12):
    """A record joins the first head that conflicts with it in nothing, else becomes a head."""
    words = lambda c: set((c or "").lower().split())
    differ = lambda a, b: bool(a and b and a != b)
    heads, out = [], {}
    for r in sorted(rows):
        for h in heads:
            bits = 0 if None in (r[2], h[2]) else (r[2] ^ h[2]).bit_count() + (r[3] ^ h[3]).bit_count()
            a, b = words(r[5]), words(h[5])
            if r[1] == h[1] and bits <= most and not differ(r[4], h[4]) and not differ(r[6], h[6]) and not (a and b and not (a <= b or b <= a)):
                out[r[0]] = h[0]
                break
        else:
            heads.append(r)
            out[r[0]] = r[0]
    return out


def records(n=400, seed=5):
    import random

    r = random.Random(seed)
    base = [(r.getrandbits(32), r.getrandbits(32)) for _ in range(6)]
    rows = []
    for i in range(n):
        hi, lo = r.choice(base)
        for _ in range(r.randrange(0, 10)):
            hi ^= 1 << r.randrange(32)
        known = r.random() > 0.1
        rows.append((i, f"acme|{r.randrange(3)}", hi if known else None, lo if known else None, r.choice(["US", "GB", None, ""]), r.choice(["New York", "New York City", "Boston", None]), r.choice(["senior", None, "lead"])))
    return rows + [(n + k, *rows[k][1:]) for k in range(60)]


@pytest.mark.parametrize("tile", [16, 2048])
def test_clusters_are_those_of_the_greedy_walk(spark, tile):
    rows = records()
    df = spark.createDataFrame(rows[::-1], RECORD).repartition(3)
    assert {r["key"]: r["head"] for r in dedupe.clustered(df, tile=tile).collect()} == greedy(rows)


def test_clusters_of_nothing(spark):
    assert dedupe.clustered(spark.createDataFrame([], RECORD)).count() == 0 == dedupe.linked(spark.createDataFrame([], RECORD)).count()


@pytest.mark.parametrize("tile", [16, 2048])
def test_links_are_counted(spark, tile):
    rows = records(120)
    kind = {}
    for r in rows:
        kind.setdefault(r[1:], r[0])
    near = lambda a, b: a[1] == b[1] and greedy([(0, *a[1:]), (1, *b[1:])])[1] == 0
    want = sorted((a[0], kind[a[1:]], sum(near(a, b) for b in rows if b[0] != a[0])) for a in rows)
    got = dedupe.linked(spark.createDataFrame(rows[::-1], RECORD).repartition(3), tile=tile)
    assert sorted(tuple(r) for r in got.select("key", "rep", "links").collect()) == want


def test_a_dense_block_costs_rows_in_proportion(spark):
    """20,000 different near copies, of which every second has no hash: one head, and no row for a pair."""
    rows = [(i, "b", None if i % 2 else i % 64, None if i % 2 else 1 << (i % 31), None, f"City {i}" if i % 2 else None, None) for i in range(20_000)]
    rows = [(*r[:5], None, r[6]) if i % 4 == 1 else r for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, RECORD)
    heads = {r["key"]: r["head"] for r in dedupe.clustered(df, tile=512).collect()}
    assert len(heads) == 20_000 and set(heads.values()) == {0}


def test_authorisation_sentences(spark):
    said = ["must be legally authorized to work in the United States", "Candidates should be eligible to work in Germany, please", "existing right to work in the UK", "The right to work in Ireland is essential.", "EU work permit is required", "open to US citizens only", "green card holders", "we cannot sponsor anyone", "No sponsorship", "we are happy to sponsor your visa", "relocation and visa support but no visa sponsorship", "you will work in Germany", None]
    got = column(spark, lambda c: F.concat_ws("/", F.array_join(authorization.required_codes(c), ","), authorization.sponsorship(c)), said)
    assert got[:4] == ["US", "DE", "GB", "IE"] and got[4].startswith("AT,BE,") and got[5:7] == ["US", "US"]
    assert got[7:] == ["/refused", "/refused", "/offered", "", "", ""]


def test_settings_are_read_or_refused():
    p = preferences.updated(preferences.Preferences(), {"titles": "A, b ,", "min_salary": "$80k", "experience": "Senior+", "work_model": "in-office, Remote", "locations": "Nordics, de", "work_authorization": "DE, France", "top_n": "0"})
    assert (p.titles, p.min_salary, p.experience_min, p.work_model, p.work_authorization, p.top_n) == (["A", "b"], 80000.0, "senior", ["onsite", "remote"], ["de"], 1)
    for bad in ({"nope": "1"}, {"experience": "wizard"}, {"locations": "Atlantis"}, {"min_salary": "much"}, {"job_types": "zzz"}, {"experience": "lead", "experience_max": "mid"}):
        with pytest.raises(preferences.PreferenceError):
            preferences.updated(preferences.Preferences(), bad)
    assert preferences.updated(p, {"titles": "any"}).titles == []


def test_documents_keep_what_is_not_owned():
    prefs = preferences.updated(preferences.Preferences(), {"locations": "Germany", "min_salary": "50k", "sponsorship_required": "yes"})
    before = {"profiles": {"yc": {"prompt": "p", "salary": {"min_annual": 1}}, "own": {"x": 1}}, "global": {"y": 2, "authorized_anywhere": True}}
    after = preferences.merged(before, prefs, {"tr_local": {"prompt": "default"}})
    assert after["profiles"]["yc"]["prompt"] == "p" and after["profiles"]["yc"]["salary"]["min_annual"] == 50000.0 and after["profiles"]["own"] == {"x": 1}
    assert after["global"]["y"] == 2 and "authorized_anywhere" not in after["global"] and after["profiles"]["tr_local"]["prompt"] == "default" and "country" not in after["profiles"]["tr_local"].get("hard_requires", {})
    assert preferences.from_document(after) == prefs and before["profiles"]["yc"]["salary"] == {"min_annual": 1}
    fewer = preferences.merged(after, preferences.Preferences())
    assert "salary" not in fewer["profiles"]["yc"] and fewer["profiles"]["yc"]["prompt"] == "p"


def test_title_groups():
    p = preferences.grouped(preferences.grouped(preferences.Preferences(), "Test", ["A", "a", " B "]), "test", ["C"])
    assert p.title_groups == {"test": ["C"]} and preferences.grouped(p, "TEST", None).title_groups == {}
    with pytest.raises(preferences.PreferenceError):
        preferences.grouped(p, "other", None)


def test_title_patterns(spark):
    prefs = preferences.Preferences(titles=["C++ Developer", "node.js"], experience_max="junior")
    expressions = [preferences.as_expression(p) for p in preferences.title_needs(prefs)]
    titles = ["Senior C++ Developer II", "node.js", "nodexjs", "Node.js Intern", "International C++ Sales", "C++ internship", "XC++ Developer", ""]
    got = [any(itertools.chain(e)) for e in zip(*[column(spark, lambda c, e=e: c.rlike(f"(?i){e}"), titles) for e in expressions], strict=True)]
    assert got == [True, True, False, True, False, True, False, False] == column(spark, lambda c: preferences.fits_titles(c, prefs), titles)


def test_rules_without_limits_and_profile_titles(spark):
    own = rules.Rules(required_titles=("dev",), profile_titles={"tr": ("ops",), "any": ()}, blocked_companies=("Acme, Inc.",))
    df = spark.createDataFrame([("dev", "x", "ACME"), ("dev", "tr", "Other"), ("ops", "tr", None), ("none", "any", "acme inc"), (None, None, "")], "t string, m string, c string")
    judged = rules.judged(df, [*rules.title_unmatched(F.col("t"), own, F.col("m")), *rules.company_blocked(F.col("c"), own)])
    assert [r["verdict"]["codes"] for r in judged.collect()] == [["company_blocked"], ["title_unmatched"], [], ["company_blocked"], ["title_unmatched"]]
