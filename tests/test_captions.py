import pytest
from pyspark.sql import functions as F

from callweave.config import parse_region
from callweave.operators import captions as cp
from callweave.operators import match as mt
from callweave.operators import stitch as st


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("line", "good"), [("Dana Park", True), ("You", True), ("Yeah.", False), ("grids", False), ("def f(x):", False), ("One Two Three Four Five", False), ("", False), ("  Éva  ", True)])
def test_name_like(spark, line, good):
    assert one(spark, cp.name_like, line) is good


@pytest.mark.parametrize(("line", "odd"), [("yUU UUl PIUUULLS OU", True), ("so that is the plan", False), ("NO WAY", False)])
def test_gibberish(spark, line, odd):
    assert one(spark, cp.gibberish, line) is odd


def test_clean_lines(spark):
    texts = spark.createDataFrame([(1, "e&, You\n\n  no capitals\nSummarize captions\n™, Dana Park")], "frame long, value string")
    assert [r["line"] for r in cp.clean_lines(texts).orderBy("line_no").collect()] == ["You", "no capitals", "Dana Park"]


def roster(spark):
    return spark.createDataFrame([(0, "Dana Park", "Dana Park"), (0, "Dana Park", "D Park"), (1, "Eli Moss", "Eli Moss")], "member_ord int, canonical string, candidate string")


@pytest.mark.parametrize(("label", "name"), [("you", "Me"), ("Dana Park", "Dana Park"), ("D4na Park", "Dana Park"), ("D Park", "Dana Park"), ("Zoltan Q", None)])
def test_match(spark, label, name):
    labels = spark.createDataFrame([(label,)], "raw string")
    assert mt.match_labels(labels, roster(spark), self_name="Me").first()["name"] == name


def test_caption_speakers(spark):
    lines = spark.createDataFrame([("Eli M0ss",), ("and then we went home to eat",)], "text string")
    assert [tuple(r) for r in mt.caption_speakers(lines, roster(spark)).collect()] == [("Eli M0ss", "Eli Moss")]


def test_line_assembly(spark):
    rows = [(1, 1, 1, "1", "1", "2", 40, 21, 90.0, "there"), (1, 1, 2, "1", "1", "2", 10, 20, 90.0, "hello"), (1, 1, 3, "1", "1", "1", 10, 2, 90.0, "Dana"), (1, 1, 4, "1", "1", "1", 30, 2, 50.0, "faint"), (1, 1, 5, "1", "1", "3", 1, 60, 99.0, "..")]
    words = spark.createDataFrame(rows, "recording_id int, frame_no int, row_no int, block string, par string, line string, left int, top int, conf double, word string")
    assert [r["text"] for r in cp.caption_lines(words).orderBy("line_no").collect()] == ["Dana", "hello there"]


def test_overlap_of_a_revised_frame():
    committed = "a b c d e f".split()
    assert st.overlap(committed, "c d e f g h".split()) == 4
    assert st.overlap(committed, "x a b c d q".split()) == 5
    assert st.overlap(committed, "z y x w".split()) == 0


def test_overlap_is_that_of_the_alignment():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(9)
    for _ in range(4000):
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnop"])
        tail = [rng.choice(letters) for _ in range(rng.randint(0, 40))]
        frame = tail[-rng.randint(1, 12) :] * rng.randint(0, 1) + [rng.choice(letters) for _ in range(rng.randint(0, 12))]
        best = None
        for a, b, size in SequenceMatcher(None, tail, frame, autojunk=False).get_matching_blocks():
            if size >= 4 and (best is None or a + size > best[0]):
                best = (a + size, b + size)
        assert st.overlap(tail, frame) == (best[1] if best else 0), (tail, frame)


@pytest.mark.parametrize(("said", "kept"), [("like yeah i like yeah i think", "like yeah i think"), ("no no no", "no"), ("a b c", "a b c")])
def test_stutter(said, kept):
    words = said.split()
    assert [words[i] for i in st.kept_after_stutter(words)] == kept.split()


def test_stitch(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    tokens = [(False, "noise"), (True, "Dana"), *((False, w) for w in text[:6]), (True, "Eli"), *((False, w) for w in text[6:]), (False, "|"), (False, "|'m")]
    frames = [(7, i, [{"is_spk": s, "tok": t} for s, t in tokens[i : i + 8]]) for i in range(len(tokens) - 7)]
    df = spark.createDataFrame(frames, "recording_id long, frame_no long, tokens array<struct<is_spk:boolean,tok:string>>")
    done = st.stitched(df)
    turns = st.turns(done)
    assert [(r["speaker"], r["text"]) for r in turns.orderBy("turn_no").collect()] == [("Dana", " ".join(text[:6])), ("Eli", " ".join([*text[6:], "I", "I'm"]))]
    assert st.stitched_texts(turns, (("Eli", "Elias"),)).first()["text"].startswith("Dana: alpha")
    assert tuple(st.stitch_stats(done, turns).first())[1:] == (8, 14, 2)


def test_interim_line_waits(spark):
    rows = [(1, 1, 0, "one two"), (1, 1, 1, "thr"), (1, 2, 0, "one two"), (1, 2, 1, "three"), (1, 3, 0, "only")]
    lines = spark.createDataFrame(rows, "recording_id int, frame_no int, line_no int, text string")
    none = spark.createDataFrame([], "text string, name string")
    found = st.frame_tokens(lines, none).orderBy("frame_no").collect()
    assert [" ".join(t["tok"] for t in r["tokens"]) for r in found] == ["one two", "one two", "only"]


def test_region():
    assert parse_region("1,2,3,4") == (1, 2, 3, 4)
    with pytest.raises(ValueError, match="four numbers"):
        parse_region("1,2,3")
