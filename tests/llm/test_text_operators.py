"""BPE, decontamination, language models, token counts and toxicity against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.llm import bpe, decontam, lm, queries, textnp, tokencount, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, ids string, score string"
ODD = [None, "", " \t\n", "a", "Zoë's ÅNGSTRÖM ½ x² <|endoftext|> don't", "日本語 🎉 é", "x" * 5000, "the " * 3000, "a", "a"]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(i if i % 4 else None, t, "w", "i", "s") for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


# ---------------------------------------------------------------- bpe


def strange_texts(n=300):
    rng = random.Random(2)
    ranges = [(0x20, 0x7E), (0, 0xFF), (0, 0x2FF), (0x300, 0x36F), (0x2000, 0x206F), (0x4E00, 0x4E40), (0x1F300, 0x1F3FF)]
    return ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_splitting_and_merging_are_the_library_s(tokenizer):
    model = bpe.WordBpe(bpe._read(bpe.default_path()))
    texts = [t for t in ODD if t] + strange_texts() + ["#" * 3000 + "!" * 60, "ΣΑΣ İ ŉ ﬁ 'S 'Ll"]
    for text, expected in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        words = model.split(text)
        plain = [i for w in words for i in (model.merge(w) if isinstance(w, str) else (w,))]
        assert plain == expected.ids, text[:60]
        together = model.merge_all([w for w in words if isinstance(w, str)])
        assert [list(map(int, x)) for x in together] == [list(model.merge(w)) for w in words if isinstance(w, str)]


def test_transducer(tmp_path):
    rng = random.Random(4)
    entries = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode(): (i, i + 1) for i in range(400)}
    automaton = bpe.Transducer.build(entries)
    automaton.save(str(tmp_path / "x"))
    automaton = bpe.Transducer.mapped(str(tmp_path / "x"))
    words = [*entries, b"", b"abcabcabcabc", b"zz"]
    for word, place in zip(words, automaton.find(words).tolist(), strict=True):
        found = tuple(automaton.ids[automaton.start[place] : automaton.start[place + 1]]) if place >= 0 else None
        assert found == entries.get(word)
    suffixes = {w[i:] for w in entries for i in range(len(w) + 1)}
    assert len(automaton.final) - 4 <= len(suffixes) + sum(len(w) for w in entries)
    assert bpe.Transducer.build({}).find([b"a"]).tolist() == [-1]


def test_bpe_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.op1_bpe(spark, SF).collect():
        ids = tokenizer.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark, tokenizer):
    docs = odd_docs(spark)
    rows = bpe.decode(bpe.encode(docs, bpe.lexicon_for(docs, words=50))).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == tokenizer.decode(ids, skip_special_tokens=False) and row["score"] == "s"
    empty = docs.limit(0)
    assert bpe.encode(empty, bpe.lexicon_for(empty)).count() == 0


# ---------------------------------------------------------------- words


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_words():
    texts = [t for t in ODD + strange_texts(50)]
    words = textnp.Words(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        lo, hi = words.first[i], words.first[i + 1]
        assert [words.text(j, 1).decode() for j in range(lo, hi)] == words_of(text)
    seen = {}
    for i in range(len(words.hash)):
        assert seen.setdefault(words.text(i, 1), words.hash[i]) == words.hash[i]
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- decontamination


def test_decontamination_of_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"x {item} y"), (2, item.upper().replace(" ", ", ")), (3, "tiny thing here"), (None, "a tiny thing"), (None, None), (4, ""), (1, f"x {item} y"), (5, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (2, "tiny thing"), (None, "here"), (7, None), (8, ""), (10, item)], "item_id long, text string")
    for block in (8 << 20, 8):
        found = {(r["doc_id"], r["text"]): (r["n_words"], r["n"], r["hit_items"]) for r in decontam.find_contamination(docs, bench, block_bytes=block).withColumn("n", decontam.n_hit_words()).collect()}
        assert found[1, rows[0][1]] == (13, 11, ["10"])
        assert found[2, rows[1][1]] == (11, 11, ["10"])
        assert found[3, "tiny thing here"] == (3, 3, ["2"])
        assert found[None, "a tiny thing"] == (3, 2, ["2"])
        assert found[None, None] == (0, 0, []) and found[4, ""] == (0, 0, []) and found[5, "one two three"] == (3, 0, [])
    assert sorted(r["doc_id"] or 0 for r in decontam.remove_documents(docs, bench).collect()) == [0, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, bench).collect() if r["doc_id"]}
    assert cut[1] == "x  y" and cut[5] == "one two three"
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).filter("size(hit_spans) > 0").count() == 0


# ---------------------------------------------------------------- language models


def test_losses_against_plain_counts(spark):
    target = ["red fish blue fish", "one fish two fish", None]
    background = target + ["the cat sat", "", "the dog sat on the cat"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(background)], "doc_id long, text string, difference string")
    chosen = docs.filter("doc_id < 3")
    rows = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, chosen, docs, word_bits=16, pair_bits=18).collect()}

    def model(texts):
        single, double = Counter(), Counter()
        for t in texts:
            w = words_of(t)
            single.update(w)
            double.update(zip(w, w[1:], strict=False))
        return single, double

    def loss(text, m):
        single, double = m
        total, w = max(sum(single.values()), 1), words_of(text)
        out = 0.0
        for i, x in enumerate(w):
            uni = single[x] / total
            pair = min(double[w[i - 1], x] / max(single[w[i - 1]], 1), 1.0) if i else uni
            out -= math.log(0.6 * pair + 0.39 * uni + 0.01 / 65536)
        return out / len(w)

    small, large = model(target), model(background)
    for i, text in enumerate(background):
        if words_of(text):
            assert abs(rows[i]["target_loss"] - loss(text, small)) < 1e-4 and abs(rows[i]["background_loss"] - loss(text, large)) < 1e-4
        else:
            assert rows[i]["n_words"] == 0 and rows[i]["difference"] is None
    assert rows[0]["difference"] < rows[5]["difference"]
    assert lm.cross_entropy_difference(docs, docs.limit(0), docs.limit(0), word_bits=16, pair_bits=16).filter("abs(difference) > 0").count() == 0


def test_counts_are_those_of_words_whatever_their_number(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    single, double, some, some_pairs = Counter(), Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        w = words_of(t)
        single.update(w)
        double.update(zip(w, w[1:], strict=False))
        if i < 10:
            some.update(w)
            some_pairs.update(zip(w, w[1:], strict=False))

    def loss(w, words, pairs, size):
        total = sum(words.values())
        chances = [(pairs[w[i - 1], x] / max(words[w[i - 1]], 1) if i else words[x] / total) * 0.6 + 0.39 * words[x] / total + 0.01 / size for i, x in enumerate(w)]
        return -sum(map(math.log, chances)) / len(w)

    monkeypatch.setattr(lm, "BUCKET", 4000)
    for bits in (None, 4):
        found = {r["doc_id"]: r for r in lm.cross_entropy_difference(docs, docs.filter("doc_id < 10"), docs, word_bits=bits, pair_bits=bits).collect()}
        assert len(found) == len(texts) and found[30]["difference"] is None and found[31]["n_words"] == 0
        for i, t in enumerate(texts[:30]):
            size = 16 if bits else len(single)
            assert abs(found[i]["target_loss"] - loss(words_of(t), some, some_pairs, size)) < 1e-5
            assert abs(found[i]["background_loss"] - loss(words_of(t), single, double, size)) < 1e-5
    assert lm.cross_entropy_difference(docs.filter("doc_id >= 30"), docs, docs).filter("n_words = 0 and difference is null").count() == 2


def test_exchange_by_levels(spark, monkeypatch):
    """Many small buckets and ranges: equal scores, and packed rows linear in the input at each level, not buckets times ranges."""
    rng = random.Random(11)
    names = ["n_words", "target_loss", "background_loss", "difference"]
    asked = []
    answers = lm._answers

    def counted(asks, levels):
        asked.append(asks.count())
        return answers(asks, levels)

    for n_docs in (40, 160):
        texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(120)) for _ in range(n_docs)] + [None, "", "alone"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        ids = docs.filter("doc_id % 3 = 0").select("doc_id")
        plain = {r["doc_id"]: tuple(r[n] for n in names) for r in lm.score_within(docs, ids).collect()}
        with monkeypatch.context() as small:
            small.setattr(lm, "BUCKET", 500)
            small.setattr(lm, "RANGE", 250)
            small.setattr(lm, "FAN_BITS", 2)
            n_bytes = sum(len(t or "") for t in texts)
            buckets, ranges = n_bytes // 500 + 1, 1 << (n_bytes // 250).bit_length()
            shape = lm._bits_at(buckets, ranges.bit_length() - 1)
            assert len(shape) > 3 and 1 << shape[-1] == ranges
            small.setattr(lm, "_answers", counted)
            asked.clear()
            found = {r["doc_id"]: tuple(r[n] for n in names) for r in lm.score_within(docs, ids).collect()}
        assert found == plain
        assert len(asked) == len(shape) - 1 and all(0 < rows <= (buckets + ranges) * 4 for rows in asked)
    monkeypatch.setattr(lm, "FAN_BITS", 6)
    assert lm._bits_at(1, 0) == [0, 0] and lm._bits_at(3_840, 11) == [0, 6, 11] and lm._bits_at(131_072, 16) == [0, 6, 12, 16]


def test_cross_entropy_query(spark):
    """Each document by counts of all others: the target without itself, the background without itself."""
    texts = {r["doc_id"]: words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()} & set(texts)
    assert good
    models = []
    for ids in (good, set(texts)):
        single, double = Counter(), Counter()
        for d in ids:
            single.update(texts[d])
            double.update(zip(texts[d], texts[d][1:], strict=False))
        models.append((ids, single, double))
    size = len(models[1][1])
    found = {r["doc_id"]: r for r in queries.op2_cross_entropy(spark, SF).collect()}
    assert set(found) == set(texts)
    for d, w in texts.items():
        r = found[d]
        assert r["n_words"] == len(w)
        for (ids, single, double), column in zip(models, ("target_loss", "background_loss"), strict=True):
            own, own_pairs = (Counter(w), Counter(zip(w, w[1:], strict=False))) if d in ids else (Counter(), Counter())
            total = max(sum(single.values()) - sum(own.values()), 1)
            loss = 0.0
            for i, x in enumerate(w):
                share = (single[x] - own[x]) / total
                pair = share
                if i:
                    pair = min((double[w[i - 1], x] - own_pairs[w[i - 1], x]) / max(single[w[i - 1]] - own[w[i - 1]], 1), 1.0)
                loss -= math.log(0.6 * pair + 0.39 * share + 0.01 / size)
            assert (r[column] is None) if not w else abs(r[column] - loss / len(w)) < 1e-5


def test_scores_within_odd_rows(spark):
    docs = odd_docs(spark).withColumn("difference", F.lit("old"))
    out = lm.score_within(docs, docs.filter("doc_id > 2").select("doc_id")).collect()
    assert len(out) == len(ODD) and sum(r["n_words"] == 0 for r in out) == 3
    alike = [r["background_loss"] for r in out if r["n_words"] == 1 and r["doc_id"] in (3, None, 9)]
    assert alike and max(alike) - min(alike) < 1e-9
    assert lm.score_within(docs.limit(0), docs.select("doc_id")).count() == 0
    assert lm.score_within(docs, docs.limit(0).select("doc_id")).count() == len(ODD)


# ---------------------------------------------------------------- token counts


def test_attribution_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert tokencount.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 1]
    assert tokencount.attribute(starts, ends, bounds, "last")[0].tolist() == [1, 2]
    counts, crossing = tokencount.attribute(starts, ends, bounds, "most")
    assert counts.tolist() == [1, 2] and crossing == 1
    with pytest.raises(ValueError, match="rule"):
        tokencount.attribute(starts, ends, bounds, "none")


def test_token_counts(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokencount.default_path(), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    docs = odd_docs(spark).withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("doc_id") > 3, "s1"))
    for rule in ("first", "last", "most"):
        for r in tokencount.count_tokens(docs, rule=rule).collect():
            whole = f"en\n{r['source'] or ''}\n{r['text'] or ''}"
            assert r["n_tokens"] == len(encoder.encode_ordinary(whole)) == sum(r["field_tokens"]) + sum(r["line_tokens"])
            assert len(r["line_tokens"]) == (r["text"] or "").count("\n") + 1
    assert tokencount.count_tokens(docs.limit(0)).count() == 0


def test_token_count_query(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokencount.default_path(), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op9_token_counts(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        d = docs[r["doc_id"]]
        head = [f"{d['lang'] or ''}\n", f"{d['source'] or ''}\n"]
        lines = (d["text"] or "").split("\n")
        sections = [*head, *(x + "\n" for x in lines[:-1]), lines[-1]]
        edges = [0]
        for x in sections:
            edges.append(edges[-1] + len(x.encode()))
        counts, at, crossing = [0] * len(sections), 0, 0
        for token in encoder.encode_ordinary("".join(sections)):
            length = len(encoder.decode_single_token_bytes(token))
            own = max(i for i in range(len(sections)) if edges[i] <= at)
            counts[own] += 1
            crossing += at + length > edges[own + 1]
            at += length
        assert (r["n_tokens"], r["lang_tokens"], r["source_tokens"], r["crossing_tokens"]) == (sum(counts), counts[0], counts[1], crossing)
        assert r["n_lines"] == len(lines) and r["text_tokens"] == sum(counts[2:]) and r["longest_line_tokens"] == max(counts[2:])
        assert r["line_tokens_sha256"] == hashlib.sha256(",".join(map(str, counts[2:])).encode()).hexdigest()


# ---------------------------------------------------------------- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_against_edit_distance():
    rng = random.Random(8)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))): float(i + 1) for i in range(40)}
    stems = {"".join(rng.choice("abcd") for _ in range(4)): 100.0 + i for i in range(5)}
    for k in (1, 2):
        trie = toxicity.FuzzyTrie(toxicity.Lexicon(words, stems, max_edits=k))
        for _ in range(3000):
            word = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
            exact = max([words.get(word, 0.0), *(w for s, w in stems.items() if word.startswith(s))])
            fuzzy = max([w for t, w in words.items() if len(t) >= 5 and 0 < edits(word, t) <= k], default=0.0)
            got = trie.match(word)
            assert got[0] == exact, word
            assert got[1] >= fuzzy and (got[1] == fuzzy or words.get(word) == got[1] or any(len(t) >= 5 and edits(word, t) <= k and w == got[1] for t, w in words.items())), word


def test_rare_and_long_terms_may_be_misspelled():
    counts = [(0, "grumbock", 8, 0), (1, "grum", 40, 0), (0, "flarnishment", 6, 0), (1, "flar", 30, 0), (0, "zogg", 9, 0)]
    trie = toxicity.FuzzyTrie(toxicity._lexicon(counts, 2000, 2000, 4, 2.5))
    for word in ("grzmbock", "gumbock", "flxrnishmnt", "fxlarnishmemt"):
        assert trie.match(word)[0] == 0 < trie.match(word)[1], word
    for word in ("gxzmbock", "zoxg", "fxrnxshmnt"):
        assert trie.match(word) == (0.0, 0.0), word


def test_quotation_counts_less_than_abuse():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": 6.0}, {}))
    plain, quoted, said, loose = (reader.features(t) for t in ("you are an idiot and more", 'the word "idiot" is an insult', "he said idiot to them", "you are an idiott and more"))
    assert plain[0] > quoted[0] > 0 and plain[0] > said[0] and quoted[5] > 0 and plain[5] == 0
    assert loose[4] > 0 and loose[0] == 0 and reader.features(None) == [0.0] * 6


def test_toxicity_query(spark):
    """Held-out rows by their ids, the score's use, and the quality on labels that are not learned from."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op8_toxicity(spark, folder).collect()}
    assert set(out) == set(texts)
    for d, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [d for d in labels if d in out and out[d]["held_out"]]
    words = re.compile("idiot|moron|scum|trash|clown|worthless|disgusting|pathetic|loser|stupid")
    abusive = [d for d in held if labels[d] and words.search(texts[d])]
    assert abusive and all(out[d]["predicted"] for d in abusive)
    assert sum(out[d]["predicted"] for d in held if not labels[d]) <= 0.05 * len(held)


def test_repeated_ids_are_learned_from_once(spark):
    rows = [(i, "you grumbock " + "word " * (i % 7)) for i in range(40)] + [(i, "a quiet text") for i in range(40, 200)]
    docs = spark.createDataFrame(rows + [(3, "zz later text")] * 500 + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "grumbock" in model.lexicon.words and "zz" not in model.lexicon.words
    long = spark.createDataFrame([(1, "x" * 200_000 + " grumbock"), (2, "quiet " * 100_000), (3, "grumbock" + "y" * 100_000)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(long, model).collect()}
    assert scores[1] > scores[2] == scores[3]


def test_words_of_reporting_are_learned():
    counts = {"said": (0, 40), "mutterte": (60, 2), "the": (300, 300), "rare": (5, 0)}
    known = toxicity._reporting(counts)
    assert "mutterte" in known and not known & {"said", "the", "rare"} and "wrote" in known


def test_toxicity_learns_and_keeps_to_its_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[3], words[17] = rng.choice(["grumbock", "flarnish"]), "zogging" + rng.choice("abcdef")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_on_open_labels(docs, marks)
    held = [r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).join(marks, "doc_id").collect() if r["held"]]
    assert [r["doc_id"] for r in held] and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held"] for r in held)
    assert sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in held) / len(held) > 0.97
    extra = spark.createDataFrame([(None, None), (1, ""), (2, "you grumbokc"), (2, "you grumbocc")], "doc_id long, text string")
    scores = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(extra, model).collect()}
    assert scores[2, "you grumbocc"] > scores[1, ""] == scores[None, None]
    assert toxicity.train(docs, marks.filter("toxic = 0")) is None and toxicity.train(docs, marks.limit(0)) is None
    assert {r["score"] for r in toxicity.score(extra, None).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
