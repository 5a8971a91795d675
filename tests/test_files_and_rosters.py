"""Named files written in place, table functions for SQL, rosters of many thousands."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.cli import main
from callweave.functions.registry import register
from callweave.operators import match as mt
from callweave.operators import transcript as tr
from callweave.sources import files
from callweave.sources import fixtures as fx
from callweave.sources import readers as rd

SF = "/root/testdata/sf0.001"
LINES = "[0:00:03] [You] hello\n[0:00:07] [Caller] hi you\n"


def test_files_are_written_over_those_that_are_read(spark, tmp_path):
    names = ["a.txt", "b c.txt", "50%.txt", "ü=1+2.md"]
    for n in names:
        (tmp_path / n).write_text(f"old {n}\n")
    texts = rd.whole_texts(spark, str(tmp_path)).join(rd.file_names(spark, str(tmp_path)), "recording_id")
    done = files.write_named(texts.select("name", F.replace("value", F.lit("old"), F.lit("new")).alias("text")), str(tmp_path))
    assert done == 4 and {n: (tmp_path / n).read_text() for n in names} == {n: f"new {n}\n" for n in names}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == sorted(names)
    assert {r["value"] for r in rd.whole_texts(spark, str(tmp_path)).collect()} == {f"new {n}\n" for n in names}


def test_a_failing_job_leaves_the_old_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("old\n")
    broken = spark.range(20).select(F.when(F.col("id") == 0, "a.txt").otherwise(F.concat(F.col("id").cast("string"), F.lit(".txt"))).alias("name"), F.when(F.col("id") == 19, F.raise_error(F.lit("lost"))).otherwise("new").alias("text"))
    with pytest.raises(Exception, match="lost"):
        files.write_named(broken, str(tmp_path))
    for odd in ([("a.txt", "x"), ("a.txt", "y")], [(None, "x")], [("", "x")], [("../b", "x")], [("/b", "x")]):
        with pytest.raises(ValueError):
            files.write_named(spark.createDataFrame(odd, "name string, text string"), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["a.txt"] and (tmp_path / "a.txt").read_text() == "old\n"
    assert files.write_named(spark.createDataFrame([("in/b.txt", None)], "name string, text string"), str(tmp_path)) == 1
    assert (tmp_path / "in" / "b.txt").read_text() == "\n"
    assert files.write_named(spark.createDataFrame([], "name string, text string"), str(tmp_path)) == 0


def test_commands_write_named_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my call.txt").write_text(LINES)
    rows = [("my call", i, "name", "Dana" if i > 5 else "You") for i in range(20)]
    spark.createDataFrame(rows, "recording_id string, frame_index long, kind string, who string").write.parquet(str(tmp_path / "obs"))
    command = ["attribute", "--observations", str(tmp_path / "obs"), "--transcript", str(tmp_path / "in"), "--out"]
    assert main([*command, str(tmp_path / "o"), "--named"]) == 0
    wanted = LINES.replace("Caller", "Dana")
    assert (tmp_path / "o" / "transcripts" / "my call.txt").read_text() == wanted and (tmp_path / "in" / "my call.txt").read_text() == LINES
    assert main([*command, str(tmp_path / "p"), "--in-place"]) == 0
    assert (tmp_path / "in" / "my call.txt").read_text() == wanted
    fx.face_samples(spark, SF).filter("recording_id < 3").write.parquet(str(tmp_path / "s"))
    assert main(["faces", "--samples", str(tmp_path / "s"), "--out", str(tmp_path / "f"), "--named"]) == 0
    assert {p.name for p in (tmp_path / "f").glob("*.txt")} and all(p.name.endswith("-faces.txt") for p in (tmp_path / "f").glob("*.txt"))


def test_table_functions(spark):
    register(spark)
    conversations = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("line_no"), (F.col("turn") * 7).alias("t"), F.col("role").alias("label"), F.translate("text", "\r\n", "  ").alias("text"))
    odd = spark.createDataFrame([(-1, "no line\r\n[0:01:02] [A] x\r\n\r\n[1:2:3] [B b] "), (-2, ""), (-3, None)], "recording_id long, value string")
    texts = tr.render(conversations).select("recording_id", F.col("text").alias("value")).unionByName(odd)
    texts.createOrReplaceTempView("some_texts")
    lines = spark.sql("SELECT recording_id, inline(r) FROM (SELECT recording_id, parse_transcript(value) AS r FROM some_texts)")
    shape = lambda df: sorted(map(str, df.collect()))
    assert len(shape(lines)) > 80 and shape(lines) == shape(rd.parse_transcript(texts))
    stored = spark.createDataFrame(texts.collect(), texts.schema)
    stored.createOrReplaceTempView("stored_texts")
    plan = spark.sql("SELECT recording_id, inline(r) FROM (SELECT recording_id, parse_transcript(value) AS r FROM stored_texts)")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    srt = [(1, "left", "1\n00:00:03,250 --> 00:00:04,000\nhello\nyou \n\n2\n00:01:00,000 --> x\n \n\n3\nno clock\nx\n\n4\n01:00:00,5 --> 2\nlast"), (2, "left", None), (3, "right", "")]
    blocks = spark.createDataFrame(srt, "recording_id long, channel string, value string")
    blocks.createOrReplaceTempView("some_srt")
    found = spark.sql("SELECT recording_id, channel, inline(r) FROM (SELECT recording_id, channel, parse_srt(value) AS r FROM some_srt)")
    assert len(shape(found)) == 2 and shape(found) == shape(rd.parse_srt(blocks))


def test_large_rosters_give_the_best_of_all_pairs(spark):
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))).title()
    names = [f"{part()} {part()}" for _ in range(3000)]
    rows = [(i, n, n) for i, n in enumerate(names)] + [(i, names[i], names[i].split()[0]) for i in range(0, 3000, 3)] + [(3000, "Twin", names[7]), (3001, "Empty", ""), (3002, "None", None)]
    blur = lambda n: "".join(rng.choice("aeiolt4 ") if rng.random() < 0.15 else c for c in n)
    labels = [blur(rng.choice(names)) for _ in range(150)] + [names[7], "you", " YOU ", "", "İstanbul ß", "q" * 300, "日本 太郎", part()]
    index = mt.RosterIndex([r for r in rows if r[2] is not None])
    aligned = 0
    for text in labels:
        score, name, n = index.best(text)
        every = [(mt.SequenceMatcher(None, text.lower(), c.lower()).ratio(), -i, canonical) for i, canonical, c in rows if c is not None]
        assert (score, name) == (max(every)[0], max(every)[2]), text
        aligned += n
    share = aligned / (len(labels) * (len(rows) - 1))
    print(f"pairs aligned: {share:.4f}")
    assert share < 0.05
    table = spark.createDataFrame([(x,) for x in [*labels, *labels, None]], "raw string")
    found = {r["raw"]: (r["name"], r["score"]) for r in mt.match_labels(table, spark.createDataFrame(rows, "member_ord int, canonical string, candidate string")).collect()}
    assert len(found) == len(set(labels)) and found["you"][0] == found[" YOU "][0] == "You" and found[names[7]] == (names[7], 1.0) and found["q" * 300][0] is None
