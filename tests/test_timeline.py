import random

import pytest

from callweave.operators import attribution as att
from callweave.operators import timeline as tl

NAME, OTHER = ("name", "Dana"), ("name", "Eli")
UNKNOWN, GAP = ("unknown", "D4na?"), ("gap", None)


def observations(spark, *recordings):
    rows = [(r, i, kind, who) for r, keys in enumerate(recordings) for i, (kind, who) in enumerate(keys)]
    return spark.createDataFrame(rows, "recording_id long, frame_index long, kind string, who string")


def spans(spark, keys, **options):
    found = tl.spans(observations(spark, keys), **options).orderBy("span_no").collect()
    return [(r["start"], r["end"], r["name"], r["unresolved"]) for r in found]


def test_runs_of_one_speaker(spark):
    assert spans(spark, [NAME] * 4) == [(0.0, 2.0, "Dana", False)]


def test_flicker_goes_to_its_predecessor(spark):
    assert spans(spark, [NAME] * 6 + [OTHER] + [NAME] * 6) == [(0.0, 6.5, "Dana", False)]


def test_short_gap_is_bridged(spark):
    assert spans(spark, [NAME] * 4 + [GAP] * 4 + [NAME] * 4) == [(0.0, 6.0, "Dana", False)]


def test_gap_of_exactly_the_grace_stays(spark):
    assert spans(spark, [NAME] * 4 + [GAP] * 6 + [NAME] * 4) == [(0.0, 2.0, "Dana", False), (5.0, 7.0, "Dana", False)]


def test_gap_between_speakers_stays(spark):
    assert [s[2] for s in spans(spark, [NAME] * 4 + [GAP] * 2 + [OTHER] * 4)] == ["Dana", "Eli"]


def test_unknown_is_unresolved_and_never_bridged(spark):
    assert spans(spark, [UNKNOWN] * 4 + [GAP] * 2 + [UNKNOWN] * 4) == [(0.0, 2.0, None, True), (3.0, 5.0, None, True)]


def test_flicker_after_a_gap_is_kept_by_the_debounce(spark):
    runs = tl.debounce(tl.runs(observations(spark, [NAME] * 2 + [GAP] * 5 + [OTHER] + [GAP] * 2 + [NAME] * 2)))
    assert [r["kind"] for r in runs.orderBy("run_no").collect()] == ["name", "gap", "name", "gap", "name"]


def test_empty(spark):
    assert spans(spark, []) == []


def sequential(keys, fps, debounce, grace):
    """The same rules told one after the other."""
    runs = []
    for i, key in enumerate(keys):
        if runs and runs[-1][2] == key:
            runs[-1][1] = i / fps + 1 / fps
        else:
            runs.append([i / fps, i / fps + 1 / fps, key])
    kept = []
    for start, end, key in runs:
        if kept and key[0] != "gap" and end - start < debounce and kept[-1][2][0] != "gap":
            kept[-1][1] = end
        elif kept and kept[-1][2] == key:
            kept[-1][1] = end
        else:
            kept.append([start, end, key])
    at = 0
    out = []
    while at < len(kept):
        start, end, key = kept[at]
        while key[0] == "name" and at + 2 < len(kept) and kept[at + 1][2][0] == "gap" and kept[at + 1][1] - kept[at + 1][0] < grace and kept[at + 2][2] == key:
            end = kept[at + 2][1]
            at += 2
        out.append((round(start, 3), round(end, 3), key))
        at += 1
    return [x for x in out if x[2][0] != "gap"]


@pytest.mark.parametrize("fps", [1.0, 2.0])
def test_against_the_sequential_rules(spark, fps):
    rng = random.Random(5)
    cases = []
    for _ in range(150):
        keys = []
        for _ in range(rng.randint(1, 12)):
            keys += [rng.choice([NAME, OTHER, UNKNOWN, GAP])] * rng.randint(1, 7)
        cases.append(keys)
    found = {}
    for r in tl.spans(observations(spark, *cases), fps=fps).orderBy("recording_id", "span_no").collect():
        found.setdefault(r["recording_id"], []).append((r["start"], r["end"], ("unknown" if r["unresolved"] else "name", r["raw_ocr"])))
    for i, keys in enumerate(cases):
        assert found.get(i, []) == sequential(keys, fps, 1.0, 3.0), i


# ---------------------------------------------------------------- attribution

SPANS = "recording_id long, span_no long, start double, end double, name string, raw_ocr string, confidence double, unresolved boolean"
LINES = "recording_id long, line_no long, t long, label string, text string"


def lines(spark):
    return spark.createDataFrame([(1, 0, 3, "You", "hi"), (1, 1, 12, "Caller", "a"), (1, 2, 23, "Caller", "b"), (1, 3, 99, "Caller", "c")], LINES)


def three(spark):
    return spark.createDataFrame([(1, 1, 0.0, 10.0, "You", "You", 1.0, False), (1, 2, 10.0, 20.0, "Dana", "Dana", 1.0, False), (1, 3, 20.0, 30.0, None, "D4", 1.0, True)], SPANS)


def labels(df):
    return [r["label"] for r in df.orderBy("line_no").collect()]


def test_relabel_looks_back_by_the_lag(spark):
    assert labels(att.relabel_timed(lines(spark), three(spark))) == ["You", "Dana", "Caller", "Caller"]


def test_first_span_decides_even_without_a_name(spark):
    overlap = three(spark).unionByName(spark.createDataFrame([(1, 4, 20.0, 30.0, "Eli", "Eli", 1.0, False)], SPANS))
    assert labels(att.relabel_timed(lines(spark), overlap))[2] == "Caller"


def test_one_other_speaker_collapses(spark):
    assert labels(att.resolve(lines(spark), three(spark))) == ["You", "Dana", "Dana", "Dana"]
    assert labels(att.resolve(lines(spark), three(spark), callers=2)) == ["You", "Dana", "Caller", "Caller"]
    assert labels(att.resolve(lines(spark), three(spark), callers=0)) == ["You", "Dana", "Caller", "Caller"]


def test_a_forced_collapse_of_a_group_warns(spark):
    group = three(spark).unionByName(spark.createDataFrame([(1, 4, 30.0, 40.0, "Eli", "Eli", 1.0, False)], SPANS))
    mode = att.attribution_mode(lines(spark), group, callers=1).first()
    assert mode["mode"] == "timed" and mode["warning"] == "--callers 1 but 2 named speakers detected (['Dana', 'Eli']); using timed attribution"


def test_coverage(spark):
    found = att.coverage(att.relabel_timed(lines(spark), three(spark))).first()
    assert (found["caller_lines"], found["attributed_lines"], found["attributed_pct"]) == (3, 1, 33.3)
    assert [x["text"] for x in found["lost_lines"]] == ["b", "c"]


def test_review(spark):
    ids = att.with_review_ids(three(spark))
    assert [r["review_id"] for r in ids.orderBy("span_no").collect()] == [None, None, "unknown_01"]
    answer = spark.createDataFrame([(1, "unknown_01", "Dora")], "recording_id long, review_id string, answer string")
    none = answer.limit(0)
    last = lambda df: df.orderBy("span_no").collect()[-1]
    assert (last(att.reconcile(ids, answer))["name"], last(att.reconcile(ids, answer))["unresolved"]) == ("Dora", False)
    assert (last(att.reconcile(ids, none))["name"], last(att.reconcile(ids, none))["unresolved"]) == (None, True)
    assert (last(att.reconcile(ids, none, bail=True))["name"], last(att.reconcile(ids, none, bail=True))["unresolved"]) == (None, False)
