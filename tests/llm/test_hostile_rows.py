"""Rows made to break an operator: long runs, huge references, inflating bodies, and columns of every inner name."""

import gzip
import html
import re

import pytest
from pyspark.sql import functions as F

from callweave.llm import chat, decontam, lm, minhash, nearcopies, shard, simhash, tokencount, toxicity, warc, whiten
from callweave.llm.common import append_columns

#: Every name that the operators give to columns of their own.
INNER = sorted(
    set("near_id near_h near_nth k0 k1 h t b r x key node row copy block bucket shard slot place range n score cut parsed own part number total class value sketch bands width cell component set root "
        "first digest tree level made deviation whitened escape_level rendered n_words hit_spans hit_items turns mask sum".split())
    | {f"__{n}" for n in "near_id near_h near_nth text t b h scored bucket id copy score cut turns role".split()}
)


def test_references_of_any_length():
    for page in ("&#" + "1" * 5000 + ";", "&#" + "1" * 5000, "&#" + "0" * 5000 + "65;", "&#00000065;x&#x" + "f" * 5000 + ";", "&#12345678;", "&#1234567;", "&amp;#65;&#65 &#128;"):
        digits = re.sub(r"&#0*([0-9]+)", lambda m: f"&#{m[1] if len(m[1]) <= 7 else 9_999_999}", page)
        assert warc.unescaped(page) == html.unescape(digits)
    assert warc.plain_text("<p>a&#" + "9" * 5000 + ";b") == "a�b"


def test_pages_that_would_break_a_task(spark):
    bomb = gzip.compress(b"x" * (warc.MOST_INFLATED + 1))
    small = gzip.compress(b"<p>hello</p>")
    assert warc.decoded_body([("Content-Encoding", "gzip")], bomb) == bomb
    assert warc.decoded_body([("Content-Encoding", "gzip")], small) == b"<p>hello</p>"
    pages = [(1, "http://a/", "&#" + "1" * 5000 + ";"), (2, "http://a/", "<a href='&#" + "2" * 5000 + ";'>x</a>"), (3, "http://a/", "<title>&#" + "3" * 9000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = warc.derive(df.select("page_id", warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record")))
    assert [r["status"] for r in found.collect()] == ["ok"] * 3


@pytest.mark.parametrize("space", [" ", "\n", "\t \r\n", "　"])
def test_long_runs_of_space_are_encoded_as_short_ones(space):
    with open(tokencount.default_path(), "rb") as f:
        encoder, _ = tokencount._encoder(f.read())
    for n in (70_000, 200_000):
        for head, tail in (("", ""), ("a", ""), ("", "b"), ("a b", " c 1"), ("!", "\x1cz")):
            text = head + (space * n)[:n] + tail
            assert tokencount.encoded(encoder, text) == encoder.encode_ordinary(text)
    text = "x" + (space * 1_000_000)[:1_000_000] + "y"
    assert encoder.decode(tokencount.encoded(encoder, text)) == text


def test_token_counts_of_a_million_spaces(spark):
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "a" + " \n" * 500_000 + "b")]
    docs = spark.createDataFrame([(i, None, "s", t) for i, t in rows], "doc_id long, lang string, source string, text string")
    out = {r["doc_id"]: r for r in tokencount.count_tokens(docs).select("doc_id", "n_tokens", F.size("line_tokens").alias("n")).collect()}
    assert {i: r["n"] for i, r in out.items()} == {1: 1, 2: 1_000_001, 3: 500_001} and all(r["n_tokens"] > 0 for r in out.values())


def test_a_stem_reaches_so_far():
    lexicon = toxicity.Lexicon({"grumbock": 2.0}, {"grum": 1.0}, frozenset())
    trie = toxicity.FuzzyTrie(lexicon)
    assert trie.match("grum" + "y" * toxicity.REACH)[0] == 1.0
    assert trie.match("grum" + "y" * (toxicity.REACH + 1)) == (0.0, 0.0)
    assert trie.match("grumbock" + "y" * 100_000) == (0.0, 0.0)
    assert trie.match("grumbock") == (2.0, 0.0)


@pytest.fixture(scope="module")
def crowded(spark):
    base = spark.createDataFrame([(i, f"some words stand here number {i % 7} and more of them {i}", "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    return base.select("*", *(F.lit(n).alias(n) for n in INNER))


def kept(out, given, results=()):
    """The rows carry the caller's columns, but for those named as a result."""
    own = [n for n in INNER if n not in results and n in out.columns]
    assert set(INNER) - set(own) <= set(results)
    rows = out.select("doc_id", *own).collect()
    assert len(rows) == given and all(r[n] == n for r in rows for n in own)


def test_near_dedup_keeps_columns_of_any_name(crowded):
    kept(nearcopies.near_dedup(crowded), 30)
    assert minhash.near_duplicate_links(crowded)[1].count() == simhash.near_duplicates(crowded).count() == 30


def test_language_models_keep_columns_of_any_name(crowded):
    kept(lm.score_within(crowded, crowded.filter("doc_id < 9").select("doc_id")), 30, ("n_words",))
    kept(lm.cross_entropy_difference(crowded, crowded.filter("doc_id < 9"), crowded), 30, ("n_words",))


def test_shards_keep_columns_of_any_name(crowded):
    kept(shard.shuffle_into_shards(crowded, 3), 30, ("shard", "slot"))


def test_decontamination_keeps_columns_of_any_name(spark, crowded):
    bench = spark.createDataFrame([("a", "some words stand here number 3 and more of them 10")], "item_id string, text string")
    kept(decontam.find_contamination(crowded, bench), 30, ("n_words", "hit_spans", "hit_items"))
    kept(decontam.remove_documents(crowded, bench), 26)  # ten words of four documents are a window
    kept(decontam.remove_spans(crowded, bench), 30)


def test_other_operators_keep_columns_of_any_name(spark, crowded):
    kept(tokencount.count_tokens(crowded), 30)
    kept(toxicity.score(crowded, None, output="mark"), 30)
    kept(append_columns(crowded, "text", ["text"], [], lambda: lambda t: []), 30)
    vectors = crowded.select("*", F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"))
    kept(whiten.fit(vectors).transform(vectors), 30, ("deviation", "whitened"))
    talk = chat.format_conversations(crowded.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text", *INNER))
    assert chat.read_back(talk.select("*", *(F.lit(n).alias(n) for n in INNER))).filter("size(turns) = 1").count() == 30
