"""spark-submit entry points: transcribe, attribute, stitch, affect, faces, callcheck.

Media is decoded outside of Spark; the commands start from its structured by-products (SRT and transcript
texts, OCR tables, observation and feature tables as Parquet) and handle any number of recordings at once.
With --named each text is a file under its recording's name (<id>.txt, <id>-<label>-prosody.txt, <id>-faces.txt,
transcripts/<id>-stitched.txt). The answers of a review are a CSV with a header: see ``attribution.reconcile``.
Exit codes: 0 done, 1 nothing to do or a dead channel, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings, parse_region
from .operators import attribution as att
from .operators import captions as cp
from .operators import faces as fc
from .operators import levels as lv
from .operators import match as mt
from .operators import prosody as pr
from .operators import stitch as st
from .operators import timeline as tl
from .operators import transcript as tr
from .sources import files
from .sources import readers as rd
from .sources import wav


def _transcript() -> Column:
    """Name of a recording's transcript, from which those of its other files are made."""
    return F.concat("recording_id", F.lit(".txt"))


def _wrong(message: str) -> int:
    print(f"error: {message}", file=sys.stderr)
    return 2


def _deliver(texts: DataFrame, args, folder: str, name: Column) -> None:
    """Texts as Spark's own output, or with --named as one file for each recording."""
    if args.named:
        files.write_named(texts.select(name.alias("name"), "text"), folder)
    else:
        tr.write_texts(texts, folder)


def transcribe(spark: SparkSession, args) -> int:
    """SRT texts of both channels to one transcript for each recording that has none yet."""
    left = rd.whole_texts(spark, args.left).withColumn("channel", F.lit("left"))
    right = rd.whole_texts(spark, args.right).withColumn("channel", F.lit("right"))
    texts = left.unionByName(right)
    rows = rd.parse_srt(texts)
    both = rd.both_channels(texts.select("recording_id", "channel")).select("recording_id")
    names = texts.select("recording_id").distinct()
    done = rd.whole_texts(spark, args.done).select("recording_id").distinct() if args.done else names.limit(0)
    work = (
        names.join(done.withColumn("is_done", F.lit(True)), "recording_id", "left")
        .join(both.withColumn("is_whole", F.lit(True)), "recording_id", "left")
        .select("recording_id", F.when(F.col("is_done"), "skipped").when(F.col("is_whole"), "done").otherwise("failed").alias("status"))
    )
    ready = rows.join(work.filter("status = 'done'").select("recording_id"), "recording_id", "left_semi")
    named = ready.withColumn("label", F.when(F.col("channel") == "left", args.self_name).otherwise(args.caller))
    _deliver(tr.render(tr.merge_channels(named)), args, args.out, _transcript())
    if args.list:
        tr.in_batch_order(work, descending=args.descending).write.option("header", True).csv(args.list)
    n = tr.batch_summary(work).first()
    print(f"Done!  {n['total']} files  |  {n['skipped']} skipped  |  {n['failed']} failed")
    return 0


def _observations(spark: SparkSession, args) -> DataFrame:
    """Observations as given, or read off caption lines with the roster."""
    if args.observations:
        return spark.read.parquet(args.observations)
    lines = spark.read.parquet(args.captions)
    keys = ["recording_id", "frame_index"]
    seen = F.max("band_present") if "band_present" in lines.columns else F.lit(True)
    labels = cp.bottom_label(lines, keys)
    matches = mt.match_labels(labels, _roster(spark, args.roster), self_name=args.self_name, threshold=Settings().match_threshold)
    return cp.observations(lines.groupBy(*keys).agg(seen.alias("band_present")), labels, matches)


def attribute(spark: SparkSession, args) -> int:
    """Observations, or caption lines and a roster, and transcripts to spans, relabelled transcripts, coverage and a review list."""
    if bool(args.observations) == bool(args.captions):
        return _wrong("one of --observations and --captions is needed")
    if args.captions and not args.roster:
        return _wrong("--captions needs --roster")
    if args.region:
        try:
            parse_region(args.region)
        except ValueError as e:
            return _wrong(str(e))
    observations = _observations(spark, args)
    spans = tl.spans(observations, fps=args.fps, debounce_seconds=args.debounce, grace=args.grace)
    if args.answers:
        answers = spark.read.option("header", True).csv(args.answers)
        spans = att.reconcile(att.with_review_ids(spans), answers, bail=args.bail)
    tr.write_spans(spans, f"{args.out}/spans")
    att.review_manifest(spans.filter("unresolved"), observations, args.fps).write.json(f"{args.out}/unknowns")
    if args.transcript:
        lines = rd.parse_transcript(rd.whole_texts(spark, args.transcript))
        spans = spans.withColumn("recording_id", F.col("recording_id").cast("string"))
        done = att.resolve(lines, spans, lag=args.lag, self_name=args.self_name, caller=args.caller, callers=args.callers)
        if args.in_place:
            names = rd.file_names(spark, args.transcript)
            files.write_named(tr.render(done).join(names, "recording_id"), args.transcript)
        else:
            _deliver(tr.render(done), args, f"{args.out}/transcripts", _transcript())
        att.coverage(done, args.caller).write.json(f"{args.out}/coverage")
    return 0


def _roster(spark: SparkSession, path: str | None) -> DataFrame:
    return rd.roster_candidates(rd.roster(spark, path)) if path else spark.createDataFrame([], "member_ord int, canonical string, candidate string")


def stitch(spark: SparkSession, args) -> int:
    """OCR tables of caption frames to turns."""
    words = rd.ocr_table(spark, args.frames)
    if words.isEmpty():
        return 1
    lines = cp.caption_lines(words)
    frames = st.frame_tokens(lines, mt.caption_speakers(lines, _roster(spark, args.roster), self_name=args.self_name))
    _deliver(st.stitched_texts(st.turns(st.stitched(frames))), args, args.out, tr.stitched_path(_transcript()))
    return 0


def _bad_tile(args) -> bool:
    try:
        if args.tile:
            parse_region(args.tile)
    except ValueError:
        return True
    return False


def _face_reports(spark: SparkSession, path: str, args, folder: str) -> bool:
    """Writes the reports of face samples, timed or numbered by frame; whether there were any."""
    samples = spark.read.parquet(path)
    if "t" not in samples.columns:
        samples = samples.withColumn("t", F.col("frame_index") / F.lit(args.faces_fps))
    if samples.isEmpty():
        return False
    _deliver(fc.report(samples), args, folder, tr.faces_path(_transcript()))
    return True


def affect(spark: SparkSession, args) -> int:
    """Utterance features, or pitch frames by channel, to annotated transcripts and the utterances that deviate most; face samples to reports.

    With --faces alone the reports are all that is made; beside a transcript both are, and either counts as done.
    """
    spoken = bool(args.transcript or args.features or args.frames)
    if spoken and not args.transcript:
        return _wrong("--transcript is needed")
    if spoken and bool(args.features) == bool(args.frames):
        return _wrong("one of --features and --frames is needed")
    if not spoken and not args.faces:
        return _wrong("--transcript or --faces is needed")
    if _bad_tile(args):
        return _wrong("--tile must be x,y,w,h in full-frame pixels")
    seen = bool(args.faces) and _face_reports(spark, args.faces, args, f"{args.out}/faces")
    heard = spoken and _prosody(spark, args)
    return int(not (seen or heard))


def _prosody(spark: SparkSession, args) -> bool:
    """Writes annotated transcripts and deviations; whether any line has the label."""
    lines = rd.parse_transcript(rd.whole_texts(spark, args.transcript))
    theirs = lines.filter(F.col("label") == args.label)
    if theirs.isEmpty():
        return False
    if args.features:
        features = spark.read.parquet(args.features)
    else:
        side = F.lit(args.channel) if args.channel else tr.channel_of(F.lit(args.label), args.self_name)
        windows = pr.utterance_windows(lines).filter(F.col("label") == args.label).withColumn("channel", side).withColumn("utt", F.col("line_no"))
        heard = pr.utterance_features(pr.frames_of(windows, spark.read.parquet(args.frames)), ["recording_id", "utt"])
        seconds = F.col("t_end") - F.col("t_start")
        spoken = windows.select("recording_id", "utt", "t_start", seconds.alias("duration"), pr.rate(tr.word_count(F.col("text")), seconds).alias("rate"))
        features = spoken.join(heard, ["recording_id", "utt"], "left")
    scored = pr.zscores(features, ["recording_id"])
    tagged = scored.withColumn("tag", pr.tag({n: F.col(f"z_{n}") for n in pr.FEATURES}, F.col("f0_slope")))
    noted = pr.annotate(theirs, tagged.withColumn("line_no", F.col("utt")))
    text = noted.withColumn("text", F.concat("text", F.when(F.col("tag") == "", "").otherwise(F.concat(F.lit("  "), F.col("tag")))))
    _deliver(tr.render(text), args, f"{args.out}/transcripts", tr.prosody_path(_transcript(), F.lit(args.label)))
    pr.top_deviations(tagged, ["recording_id"], "utt", args.top).write.json(f"{args.out}/deviations")
    return True


def faces(spark: SparkSession, args) -> int:
    """Face samples to reports."""
    if _bad_tile(args):
        return _wrong("--tile must be x,y,w,h in full-frame pixels")
    return int(not _face_reports(spark, args.samples, args, args.out))


def callcheck(spark: SparkSession, args) -> int:
    """WAV files to levels and verdicts; 1 if a channel looks dead."""
    headers = wav.headers(spark, args.files)
    forced = "sampled" if args.fast else "full" if args.full else None
    levels = lv.levels_of_energy(wav.energy(lv.stretches(headers, forced)))
    judged = lv.verdicts(levels).orderBy("recording_id", "channel").collect()
    for r in judged:
        print(f"{r['recording_id']} {'LR'[r['channel']] if r['channel'] < 2 else r['channel']}: max {r['max_db']:.1f} dB   mean {r['mean_db']:.1f} dB   -> {r['verdict']}")
    return int(not judged or any(r["verdict"] != "OK" for r in judged))


def parser() -> argparse.ArgumentParser:
    base, own = Settings(), argparse.ArgumentParser(prog="callweave", description=__doc__.splitlines()[0])
    sub = own.add_subparsers(dest="command", required=True)

    def command(fn, *required: str):
        p = sub.add_parser(fn.__name__, help=fn.__doc__)
        for name in required:
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--self-name", default=base.self_label)
        if fn is not callcheck:
            p.add_argument("--named", action="store_true", help="texts as one file for each recording, under its name")
        p.set_defaults(run=fn)
        return p

    p = command(transcribe, "left", "right", "out")
    p.add_argument("--caller", default=base.caller_label)
    p.add_argument("--done", help="finished transcripts; their recordings are skipped")
    p.add_argument("--list", help="where the state of each recording is listed, in order")
    p.add_argument("--descending", action="store_true")
    p = command(attribute, "out")
    for name in ("observations", "captions", "roster", "transcript", "answers", "region"):
        p.add_argument(f"--{name}")
    p.add_argument("--caller", default=base.caller_label)
    p.add_argument("--callers", type=int)
    p.add_argument("--bail", action="store_true")
    p.add_argument("--in-place", action="store_true", help="the transcripts themselves are rewritten, all or none by a failing job")
    for name, value in (("fps", base.fps), ("debounce", base.debounce_seconds), ("grace", base.grace_bridge_seconds), ("lag", base.caption_lag_seconds)):
        p.add_argument(f"--{name}", type=float, default=value)
    command(stitch, "frames", "out").add_argument("--roster")
    p = command(affect, "out")
    for name in ("transcript", "features", "frames"):
        p.add_argument(f"--{name}")
    p.add_argument("--faces", help="face samples, for the reports on faces")
    p.add_argument("--channel", choices=("left", "right"))
    p.add_argument("--label", default=base.caller_label)
    p.add_argument("--top", type=int, default=10)
    for each in (p, command(faces, "samples", "out")):
        each.add_argument("--tile", help="the part of the picture that the samples were taken from; checked only")
        each.add_argument("--faces-fps", type=float, default=2.0, help="samples a second, where they have frame_index and no t")
    p = command(callcheck, "files").add_mutually_exclusive_group()
    p.add_argument("--fast", action="store_true")
    p.add_argument("--full", action="store_true")
    return own


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(SparkSession.builder.appName(f"callweave-{args.command}").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
