"""Sharding, WARC, fingerprints, chat formatting, near copies and the pipeline against plain versions."""

import base64
import glob
import gzip
import hashlib
import importlib.util
import itertools
import json
import os
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from callweave.llm import chat, minhash, queries, shard, simhash, warc

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in queries.QUERIES.items() if sql])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    fn, sql = queries.QUERIES[name]
    found, expected = fn(spark, SF), con.execute(sql)
    assert plain(found.collect(), found.columns) == plain(expected.fetchall(), [d[0] for d in expected.description])


# ---------------------------------------------------------------- shards


def test_shards_are_exact(spark):
    rows = [(None if i % 3 == 0 else i % 900, f"t{i % 7}" if i % 5 else None, "s") for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = shard.shuffle_into_shards(df, 7, block_rows=64, bucket_rows=16).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, slots.values())) == [143] * 5 + [144] * 2
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(a), str(b)) for a, b, _ in rows)
    again = shard.shuffle_into_shards(df, 7, block_rows=64, bucket_rows=16).collect()
    assert sorted((r["shard"], r["slot"], str(r["doc_id"]), str(r["text"])) for r in again) == sorted((r["shard"], r["slot"], str(r["doc_id"]), str(r["text"])) for r in out)
    assert shard.shuffle_into_shards(df.limit(0), 7).count() == 0
    assert sorted(r["shard"] for r in shard.shuffle_into_shards(df.limit(3), 7).collect()) == [0, 1, 2]


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(1, "same")] * 900 + [(i, "own") for i in range(100)], "doc_id long, text string")
    out = shard.shuffle_into_shards(df, 10, block_rows=64, bucket_rows=16).collect()
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(10) for i in range(100)]
    assert sum(r["text"] == "same" for r in out) == 900
    again = shard.shuffle_into_shards(df, 10, block_rows=64, bucket_rows=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_matrix_has_its_sums_and_the_right_spread(spark):
    counts = spark.createDataFrame([(b, 50 + b) for b in range(8)], "block long, n long")
    caps = [100, 150, 0, 178]
    cells = []
    for seed in range(40):
        rows = {r["block"]: r["row"] for r in shard.communication_matrix(counts, caps, 3, seed).collect()}
        assert [sum(rows[b]) for b in range(8)] == [50 + b for b in range(8)]
        assert [sum(rows[b][s] for b in range(8)) for s in range(4)] == caps
        cells.append([rows[b][0] for b in range(8)])
    cells = np.array(cells)
    share = caps[0] / sum(caps)
    mean, var = 50 * share, 50 * share * (1 - share) * (428 - 50) / 427
    assert abs(cells[:, 0].mean() - mean) < 4 * (var / 40) ** 0.5
    assert 0.5 < cells.var(axis=0).mean() / var < 1.6


def test_shard_query(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op3_shards(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == {d: (len(t) + 16, zlib.crc32(t)) for d, t in texts.items()}
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, i) for s in range(40) for i in range(5)]


# ---------------------------------------------------------------- warc


def test_derivatives_keep_links_headers_and_digests(spark):
    page = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><a href="/x">one</a><p>two<!-- <a href="no"> --><script>var a = "<p>";</script></p><a href=y>three</a></body></html>'
    rows = [(1, "http://h/dir/p", page), (2, None, None), (3, "http://h/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("status", F.lit("old"))
    out = {r["page_id"]: r for r in warc.derive(pages.withColumn("record", warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z"))).collect()}
    r = out[1]
    assert (r["status"], r["title"], r["n_links"], r["plain_text"]) == ("ok", "A & B", 2, "A & B\none\ntwo\nthree")
    payload = "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    assert r["payload_digest"] == payload
    for name in ("metadata", "conversion"):
        head, _, rest = bytes(r[f"{name}_record"]).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        assert rest[len(block) :] == b"\r\n\r\n" and headers["WARC-Refers-To"] == r["response_id"] and headers["WARC-Type"] == name
        assert headers["WARC-Block-Digest"] == warc.sha1(block) and headers["WARC-Target-URI"] == "http://h/dir/p" and headers["WARC-Date"] == "2024-01-01T00:00:00Z"
        if name == "metadata":
            meta = json.loads(block)
            assert meta["links"] == ["http://h/x", "http://h/dir/y"] and meta["payload_digest"] == payload and meta["http"]["content-type"].startswith("text/html")
    assert out[2]["status"] == "ok" and out[2]["plain_text"] == "" and out[3]["n_links"] == 0
    bad = spark.createDataFrame([(None,), (b"",), (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n",), (b"\xff\xfe",)], "record binary")
    assert {r["status"] for r in warc.derive(bad).collect()} == {"malformed"}
    assert warc.records(warc.derive(bad)).count() == 0 and warc.derive(bad.limit(0)).count() == 0


def test_derivatives_carry_source_headers_and_a_checked_digest():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello"
    good = hashlib.sha1(b"<p>hello")
    stated = {"sha1:" + good.hexdigest(): "verified", "SHA-1:" + base64.b32encode(good.digest()).decode(): "verified", "sha1:" + "0" * 40: "mismatch", "own:1": "unknown", None: "absent"}
    for digest, outcome in stated.items():
        head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nWARC-IP-Address: 192.0.2.7\r\nWARC-Concurrent-To: <urn:b>\r\nWARC-Concurrent-To: <urn:c>\r\n"
        head += (f"WARC-Payload-Digest: {digest}\r\n" if digest else "") + f"Content-Length: {len(body)}\r\n\r\n"
        r = dict(zip([n for n, _ in warc.FIELDS], warc.derivatives(head.encode() + body + b"\r\n\r\n"), strict=True))
        assert r["status"] == "ok" and r["source_digest"] == outcome
        for name, other in (("metadata", "conversion"), ("conversion", "metadata")):
            lines = r[f"{name}_record"].partition(b"\r\n\r\n")[0].decode().split("\r\n")
            assert f"WARC-Payload-Digest: {warc.sha1(b'<p>hello')}" in lines and f"WARC-Concurrent-To: {r[f'{other}_id']}" in lines
            assert {"X-Source-WARC-IP-Address: 192.0.2.7", "X-Source-WARC-Concurrent-To: <urn:b>", "X-Source-WARC-Concurrent-To: <urn:c>", f"X-Source-Digest-Check: {outcome}"} <= set(lines)


def test_hostile_pages_take_linear_time():
    for piece in ("<!--", "<script ", "<!doctype", "<a ", "<a href='", "<title>", "<p ", '<a href="', "</script ", "&#", "<a href=", "<"):
        page = piece * (1_000_000 // len(piece))
        body = b"HTTP/1.1 200 OK\r\n\r\n" + page.encode()
        record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        began = time.process_time()
        assert warc.derivatives(record)[0] == "ok"
        assert time.process_time() - began < 3, piece


def test_bodies_are_decoded_and_repeated_headers_kept():
    page = b"<title>T</title><p>one<a href='/b'>two</a>"
    packed = gzip.compress(page)
    sent = {b"Content-Encoding: gzip": packed, b"Transfer-Encoding: chunked": b"5\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n" % (page[:5], len(page) - 5, page[5:]), b"Content-Encoding: deflate": page, b"Transfer-Encoding: chunked ": page}
    for header, payload in sent.items():
        body = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n" + header + b"\r\n\r\n" + payload
        record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        r = dict(zip([n for n, _ in warc.FIELDS], warc.derivatives(record), strict=True))
        assert (r["title"], r["plain_text"], r["n_links"]) == ("T", "T\nonetwo", 1) and r["payload_digest"] == warc.sha1(payload), header
        meta = json.loads(r["metadata_record"].partition(b"\r\n\r\n")[2])
        assert [v for n, v in meta["http_headers"] if n == "Set-Cookie"] == ["a", "b"]


def test_warc_query(spark):
    """Every page's digests and links, read back from the two records that are made of it."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = {r["page_id"]: r for r in queries.op4_warc(spark, SF).collect()}
    assert set(out) == set(pages)
    made = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record"))
    for r in warc.derive(made).collect():
        found, page = out[r["page_id"]], pages[r["page_id"]]
        assert found["payload_digest"] == warc.sha1((page["html"] or "").encode()) and found["status"] == "ok" and r["source_digest"] == "verified"
        assert found["target_uri"] == page["url"] and found["text_sha256"] == hashlib.sha256(r["plain_text"].encode()).hexdigest()
        for name in ("metadata", "conversion"):
            record = bytes(r[f"{name}_record"])
            assert [x for _, x in warc.split_records(record)] == [record] and found[f"{name}_sha256"] == hashlib.sha256(record).hexdigest()
            headers = warc._last(warc._fields(record.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]))
            assert headers["warc-refers-to"] == found["response_id"] and headers["warc-refers-to-target-uri"] == page["url"]
        assert bytes(r["conversion_record"]).endswith(b"\r\n\r\n" + r["plain_text"].encode() + b"\r\n\r\n")


def test_files_are_read_and_written(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i}<a href=/x>") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select(warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record"))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(r["member"]) for r in warc.as_members(pages).collect()))
    (tmp_path / "b.warc").write_bytes(b"".join(bytes(r["record"]) for r in pages.collect()))
    read = warc.read_files(spark, str(tmp_path))
    assert sorted(bytes(r["record"]) for r in read.collect()) == sorted(2 * [bytes(r["record"]) for r in pages.collect()])
    assert {r["status"] for r in warc.derive(read).collect()} == {"ok"} and read.filter("path like '%.gz'").agg(F.max("number")).first()[0] == 4


# ---------------------------------------------------------------- minhash


def shingle_set(text, n=5):
    from tests.llm.test_text_operators import words_of

    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 600)]
    texts = [" ".join(base)]
    for n in (3, 10, 40, 120):
        other = list(base)
        for i in rng.integers(0, 600, n):
            other[i] = f"v{i}"
        texts.append(" ".join(other))
    texts += ["", "a b", "A, B!", None]
    prints = minhash.short_prints(minhash.signatures_of(pa.array(texts)))
    for i in range(1, 5):
        a, b = shingle_set(texts[0]), shingle_set(texts[i])
        assert abs(minhash.likeness(prints[0], prints[i]) - len(a & b) / len(a | b)) < 0.16
    assert (prints[6] == prints[7]).all() and (prints[5] == prints[8]).all() and minhash.likeness(prints[5], prints[6]) < 0.1


def test_edits(spark):
    rows = [(5, "a b c d e f g h"), (3, None), (9, "Zoë " * 50), (7, "x"), (1, "last one here")]
    for extra in ([], [(None, "no id"), (None, "none"), (5, "tie")]):
        df = spark.createDataFrame(rows + extra, "doc_id long, text string")
        for size in (4096, 1):
            out = minhash.with_edits(df, rows_per_bucket=size).collect()
            assert len(out) == len(rows + extra)
            if not extra:
                order = sorted(((d, t or "") for d, t in rows), reverse=True)
                for i, (d, t) in enumerate(order):
                    n = order[(i + 1) % len(order)][1]
                    edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
                    r = next(x for x in out if x["doc_id"] == d)
                    assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
                    own, other, new = minhash.short_prints(minhash.signatures_of(pa.array([t, n, edited])))
                    assert (r["fingerprint"], r["edited_fingerprint"]) == (own.tobytes().hex(), new.tobytes().hex())
                    assert abs(r["near_edited"] - minhash.likeness(own, new)) < 1e-12 and abs(r["near_next"] - minhash.likeness(own, other)) < 1e-12
    assert minhash.with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_query(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    out = {r["doc_id"]: r for r in queries.op5_minhash(spark, SF).collect()}
    assert len(out) == len(rows)
    prints, errors = {}, []
    for i, (d, t) in enumerate(rows):
        n, r = rows[(i + 1) % len(rows)][1], out[d]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for other, column in ((edited, "near_edited"), (n, "near_next")):
            a, b = shingle_set(t), shingle_set(other)
            errors.append(abs(r[column] - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert np.mean(errors) < 0.04 and max(errors) < 0.25


def test_many_null_ids_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_BUCKETS", 3)
    rows = [(None, f"text {i % 5}") for i in range(60)] + [(1, "long word " * 60_000)] + [(2, "two")] * 40
    out = minhash.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=2).collect()
    assert len(out) == 101 and sum(r["doc_id"] is None for r in out) == 60 and max(r["n_chars"] for r in out) == 600_000
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 2}) == 1


def test_links_are_verified(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, base.replace("w7 ", "q ")), (4, " ".join(f"z{i}" for i in range(200))), (5, None), (6, ""), (7, "!!"), (8, "?")]
    links, members = minhash.near_duplicate_links(spark.createDataFrame(rows, "doc_id long, text string"))
    found = links.collect()
    assert [sorted((r["a"], r["b"])) for r in found] == [[1, 3]] and abs(found[0]["jaccard"] - 191 / 201) < 1e-9
    assert {r["doc_id"]: (r["class_id"], r["group_id"]) for r in members.collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 4), 5: (5, 5), 6: (5, 5), 7: (7, 7), 8: (8, 8)}


def jaccard_groups(rows):
    """The least id of each row's group, by the similarity of all pairs."""
    sets = [shingle_set(t) or {("none", t or "")} for _, t in rows]
    roots = plain_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    return {d: rows[r][0] for (d, _), r in zip(rows, roots, strict=True)}


def edited_copies(rng):
    """Groups of texts and of copies with scattered edits, replaced blocks, and passages in common."""
    rows = []
    for group in range(12):
        base = [f"g{group}w{x}" for x in rng.integers(0, 5000, int(rng.integers(8, 300)))]
        rows.append(base)
        for _ in range(int(rng.integers(2, 40))):
            other = list(base)
            if rng.random() < 0.5:
                for i in rng.integers(0, len(base), int(rng.integers(1, 2 + len(base) // 30))):
                    other[i] = f"x{rng.integers(0, 9999)}"
            else:
                begin, length = int(rng.integers(0, len(base))), int(rng.integers(1, 2 + len(base) // 6))
                other[begin : begin + length] = [f"y{x}" for x in rng.integers(0, 9999, length)]
            rows.append(other)
    shared = [f"p{i}" for i in range(150)]
    rows += [shared + [f"q{group}r{i}" for i in range(int(rng.integers(20, 60)))] for group in range(60)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("hot", [1024, 8])
def test_near_copies_against_all_pairs(spark, hot):
    rows = edited_copies(np.random.default_rng(5))
    wanted = jaccard_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    links, members = minhash.near_duplicate_links(docs, hot=hot)
    found = {r["doc_id"]: r["group_id"] for r in members.collect()}
    apart = [d for d in wanted if found[d] != wanted[d]]
    assert len(apart) <= 2, (len(apart), len(rows))  # bands miss under two pairs in a thousand at 0.8
    sets = [shingle_set(t) for _, t in rows]
    for r in links.collect():
        a, b = sets[r["a"]], sets[r["b"]]
        assert abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-9 and r["jaccard"] >= 0.8
    kept = {r["doc_id"] for r in simhash.near_dedup(docs, hot=hot).collect()}
    assert kept == set(found.values())


def test_near_duplicates_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    wanted = jaccard_groups(rows)
    assert {r["doc_id"]: r["group_id"] for r in queries.minhash_near_duplicates(spark, SF).collect()} == wanted


# ---------------------------------------------------------------- chat


def test_every_text_comes_back(spark):
    pieces = ["[INST]", "[/INST]", "<s>", "</s>", "<<ROLE x>>", "<</ROLE>>", "&", "&amp;", "&#91;", "&#60;", " ", "\n", "a", "[", "<", ">", ""]
    rows, want = [], {}
    for i, parts in enumerate(itertools.product(pieces, repeat=2)):
        text, role = "".join(parts), ["user", "assistant", "system", "", None, "a>b<[INST]"][i % 6]
        rows += [(i, 1, role, text), (i, 0, "assistant", text), (i, 2, "user", None)]
        want[i] = [("assistant", text), (role or "", text), ("user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("x"))
    for r in chat.read_back(chat.format_conversations(df)).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == want[r["conv_id"]]
        spans = [r["formatted"][m["begin"] : m["begin"] + m["length"]] for m in r["mask"]]
        undone = [x.replace("&#91;", "[").replace("&#60;", "<").replace("&#62;", ">").replace("&amp;", "&") for x in spans]
        assert undone == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert [len(r["turns"]) for r in chat.read_back(chat.format_conversations(nulls)).collect()] == [3]


# ---------------------------------------------------------------- simhash


def plain_print(text, n=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    prints = [plain_print(t) for _, t in docs]
    roots = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert found == {d: (f"{p:016x}", docs[root][0]) for (d, _), p, root in zip(docs, prints, roots, strict=True)}


@pytest.mark.parametrize(("bits", "blocks", "choose", "hot"), [(3, 4, 1, 4096), (3, 4, 1, 12), (3, 4, 1, 2), (6, 8, 2, 4096)])
def test_links_against_all_pairs(spark, bits, blocks, choose, hot):
    rng = np.random.default_rng(bits)
    values = {int(x) for x in rng.integers(0, 1 << 62, 80)}
    for x in list(values)[:15]:
        for _ in range(int(rng.integers(1, 40))):
            y = x
            for b in rng.integers(0, 64, int(rng.integers(1, 7))):
                y ^= 1 << int(b)
            values.add(y)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "value long"), max_bits=bits, blocks=blocks, choose=choose, hot=hot)
    root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    mine, wanted = [root.get(v, v) for v in signed], plain_components(values, lambda a, b: (a ^ b).bit_count() <= bits)
    assert len(set(zip(mine, wanted, strict=True))) == len(set(mine)) == len(set(wanted))


def test_near_copies_of_odd_rows(spark):
    base = [f"w{i}" for i in range(300)]
    near = list(base)
    near[150] = "other"
    rows = [(4, " ".join(base), "k"), (2, " ".join(near), "k"), (None, None, "k"), (None, "", "k"), (7, "", "k"), (9, "alone here", "k"), (9, "alone here", "k"), (None, "no id at all", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.near_dedup(docs).collect())
    assert kept == sorted([("2", " ".join(near)), ("7", ""), ("9", "alone here"), ("None", "no id at all")])
    found = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert found[None, 0] == 7 and found[9, simhash_signed("alone here")] == 9 and found[None, simhash_signed("no id at all")] is None
    assert simhash.near_dedup(docs.limit(0)).count() == 0 and simhash.near_duplicates(docs.limit(0)).count() == 0


def simhash_signed(text):
    v = plain_print(text)
    return v - (1 << 64) if v >> 63 else v


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("the pipeline is not there")
    import corpus_pipeline
    from tokenizers import Tokenizer

    from callweave.llm import bpe, decontam, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    model = toxicity.train_on_open_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r["doc_id"]: r["text"] for r in toxicity.score(docs, model).filter("score < 0.5").collect()}

    groups = jaccard_groups(sorted(left.items()))
    stay = {i: left[i] for i in left if groups[i] == i}
    frame = spark.createDataFrame(list(stay.items()), "doc_id long, text string")
    clean = {r["doc_id"] for r in decontam.find_contamination(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("size(hit_items) = 0").collect()}
    assert set(out) == clean
    tokenizer = Tokenizer.from_file(bpe.default_path())
    assert all(list(out[i]) == tokenizer.encode(left[i] or "", add_special_tokens=False).ids for i in clean)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns of clashing names, and empty tables."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("the pipeline is not there")
    import corpus_pipeline

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(None, None, None), (None, "", "a"), (1, None, None), (2, "", "b"), (3, "same text here", "b"), (3, "same text here", "b"), (4, "SAME text, here!", None), (5, "long word " * 100_000, "c"), (6, "?", "c"), (7, "!", "c"), (8, bench, "d"), (None, "no id", "d")]
    clash = "doc_id long, text string, source string"
    more = {"h": "x", "__near_id": "y", "class": "z", "score": "s", "hit_spans": "t", "node": 5, "n_words": 6, "key": "k", "near_id": "n", "near_h": "o", "near_nth": "p", "score_": "q", "__score": "r", "__cut": "s"}
    docs = spark.createDataFrame(rows, clash).select("*", *(F.lit(v).alias(k) for k, v in more.items()))
    wanted = {0: len(rows), 1: 7, 2: len(rows) - 1, 3: len(rows)}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 3 or out.columns == docs.columns, name
        found = out.collect()
        assert len(found) == wanted[i], name
        assert i == 3 or all(r[k] == v for r in found for k, v in more.items()), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
