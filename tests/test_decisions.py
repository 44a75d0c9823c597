"""One hand-made page for each rule, limits on both sides, and missing metrics."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import checks, decisions
from pagewright.functions.thresholds import Thresholds

GOOD = {"ocr": 70.0, "hw": 5.0, "blur": 120.0, "width": 1200, "height": 900, "hot_regions": 6, "brightness": 120.0, "contrast": 50.0, "white_space": 30.0, "skew": 0.0, "thick": 1.0, "irregularity": 1.0, "brisque": 20.0, "hi_words": 9, "regions": 4, "chars": 99, "f": None}
SCHEMA = "id int, ocr double, hw double, blur double, width int, height int, hot_regions int, brightness double, contrast double, white_space double, skew double, thick double, irregularity double, brisque double, hi_words int, regions int, chars int, f boolean"
CONC, UNCLEAR, SPREAD = 3, 6, 9

CASES = [
    ("C1", dict(ocr=85.0, hw=45.0, f=False)), ("C2", dict(ocr=84.9, hw=45.0, f=False)), ("C3", dict(ocr=82.0, hw=60.0, f=True)), ("C4", dict(ocr=85.0, hw=49.9)),
    ("C5", dict(ocr=80.0, hw=50.0)), ("C6", dict(ocr=19.9)), ("C8", dict(ocr=70.0, hw=40.0, f=False)), ("C9", dict(ocr=79.9, hw=40.0, f=True)), ("C10", dict(ocr=84.9, hw=45.0)),
    ("C11", dict(ocr=74.9, hw=40.0)), ("C12", dict(ocr=69.9, hw=40.0)), ("C12", dict(ocr=None, hw=40.0)), ("C13", dict(ocr=60.0, hw=39.9, f=True)), ("C14", dict(ocr=60.0, hw=29.0, hot_regions=SPREAD, f=True)),
    ("C15", dict(ocr=60.0, hw=25.0, hot_regions=SPREAD)), ("C16", dict(ocr=59.9, hw=25.0, hot_regions=SPREAD)), ("C17", dict(width=399)), ("C17", dict(height=299)), ("C18", dict(ocr=49.0, blur=14.9)),
    ("C19", dict(ocr=49.9, blur=29.9)), ("C20", dict(ocr=29.9, blur=29.9)), ("C20", dict(ocr=None, blur=20.0)), ("C21b", dict(contrast=14.9)), ("C21b", dict(ocr=60.0, blur=10.0)), ("C22", dict(ocr=80.1, hw=14.9)),
    ("C23a", dict(hw=15.1, hot_regions=CONC)), ("C23b", dict(ocr=29.9, hw=20.0, hot_regions=CONC)), ("PAGE_ERROR", dict(ocr=None, hw=20.0, hot_regions=CONC)), ("C24a", dict(ocr=75.1, hw=35.0, hot_regions=CONC)),
    ("C24c", dict(ocr=75.1, hw=25.1)), ("C25", dict(ocr=49.0, blur=150.1)), ("C26a", dict(ocr=70.1, hw=20.1, blur=59.9)), ("C26b", dict(ocr=72.0, hw=35.0, hot_regions=CONC)),
    ("C26c", dict(ocr=72.0, hw=20.1, hot_regions=SPREAD)), ("C26d", dict(ocr=72.0, hw=20.1)), ("D2h", dict(ocr=80.0, hw=5.0)), ("D2n", dict(ocr=81.0, hw=5.0, blur=50.0, hi_words=0, regions=0, chars=0, brisque=90.0)),
    ("D3h", dict(ocr=79.0)), ("D3n", dict(ocr=60.0, hi_words=0, regions=0)), ("D5", dict(ocr=45.0, blur=50.0, hi_words=0, regions=0, chars=0, brisque=99.0, white_space=90.0, skew=20.0, brightness=20.0)), ("D6", dict(ocr=21.0 + 5, blur=70.0, hi_words=0, regions=0, chars=0, brisque=99.0, white_space=90.0, skew=20.0, brightness=20.0, hw=24.0)),
    ("D4h", dict(ocr=59.0)), ("D4n", dict(ocr=59.0, regions=0, chars=0)), ("D6", dict.fromkeys([k for k in GOOD if k != "hot_regions"])),
]


def decide(spark, rows, t=Thresholds()):
    df = spark.createDataFrame([(i, *({**GOOD, **r}[k] for k in GOOD)) for i, r in enumerate(rows)], SCHEMA)
    out = decisions.page_decisions(checks.all_stages(df, t), t)
    return [r for r in sorted(out.collect(), key=lambda r: r["id"])]


def test_each_rule(spark):
    got = [r["rule_id"] for r in decide(spark, [c for _, c in CASES])]
    assert [(i, g) for i, (g, (w, _)) in enumerate(zip(got, CASES)) if g != w] == []


def test_meaning_and_flags(spark):
    rows = {c[0]: r for c, r in zip(CASES, decide(spark, [c for _, c in CASES]))}
    known = {r[0]: r[1:] for r in decisions.RULES}
    for name, r in rows.items():
        if name != "PAGE_ERROR":
            assert (r["status"], r["priority"], r["message"]) == known[name]
    assert rows["C4"]["has_critical"] and rows["C4"]["status"] == "ACCEPTED"  # an accepted page may have critical entries
    assert rows["C15"]["has_critical"] and not rows["D3h"]["has_critical"]
    error = rows["PAGE_ERROR"]
    assert (error["final_score"], error["ocr"], list(error["critical"]), error["status"]) == (0.0, None, ["page_error"], "REJECTED")


def test_filter_takes_blur_out(spark):
    r80, r50, ex50 = decide(spark, [dict(ocr=80.0, blur=10.0), dict(ocr=55.0, blur=20.0), dict(ocr=55.0, blur=10.0)])
    assert "blur" not in r80["critical"] and "blur_readable" in r80["warnings"]
    assert "blur" not in r50["critical"] and "blur_slight" in r50["warnings"]
    assert list(ex50["critical"]) == ["blur"]


@pytest.mark.parametrize(("column", "limit", "name", "low", "high"), [
    ("blur", 30.0, "blur", "critical", "warning"), ("blur", 60.0, "blur", "warning", "pass"), ("width", 400, "resolution", "critical", "warning"), ("width", 800, "resolution", "warning", "pass"),
    ("height", 300, "resolution", "critical", "warning"), ("height", 600, "resolution", "warning", "pass"), ("brightness", 15.0, "brightness", "critical", "warning"), ("brightness", 35.0, "brightness", "warning", "pass"),
    ("contrast", 15.0, "contrast", "critical", "warning"), ("contrast", 22.0, "contrast", "warning", "pass"), ("white_space", 80.0, "white_space", "pass", "warning"), ("skew", 15.0, "skew", "pass", "warning"),
])
def test_limits(spark, column, limit, name, low, high):
    step = 1 if isinstance(limit, int) else 0.01
    df = spark.createDataFrame([(i, *({**GOOD, column: v}[k] for k in GOOD)) for i, v in enumerate([limit - step, limit])], SCHEMA)
    got = [r[0] for r in sorted(df.select("id", checks.check_kinds()[name].alias("k")).select("k", "id").collect(), key=lambda r: r["id"])]
    assert got == [low, high]


def test_profiles():
    env, code = Thresholds.env_example(), Thresholds.code_defaults()
    assert (env.warn_width, env.warn_height, env.brisque) == (400, 300, 80.0) and code.brisque == 55.0


@settings(max_examples=5, deadline=None)
@given(st.data())
def test_exactly_one_rule_and_bounds(spark, data):
    number = st.one_of(st.none(), st.floats(0, 100, allow_nan=False))
    rows = [dict(ocr=data.draw(number), hw=data.draw(number), blur=data.draw(number), brisque=data.draw(st.floats(0, 100)), f=data.draw(st.sampled_from([None, True, False]))) for _ in range(20)]
    for r in decide(spark, rows):
        assert r["rule_id"] and r["status"] in ("ACCEPTED", "REJECTED", "FLAG_FOR_REVIEW") and 0 <= r["final_score"] <= 100


def test_ladders_name_known_rules():
    names = {r[0] for r in decisions.RULES}
    used = {n for n, _ in itertools.chain(decisions.consensus_rules(), decisions.score_rules())} - {"C21a", "C27", "PAGE_ERROR"}
    assert used == names
