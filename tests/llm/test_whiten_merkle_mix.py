"""Whitening, Merkle manifests and mixes against plain forms."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from callweave.llm import merkle, mix, queries, shard, whiten

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening


def plain_whitening(vectors, k=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), ((n * x - s) / n) @ turn / np.sqrt(values), values / np.trace(c.T @ c / n)


def test_whitening_query_against_a_dense_decomposition(spark):
    found = queries.op11_whitening(spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    rows = rows[[v is not None and all(c is not None and np.isfinite(c) for c in v) for v in rows.embedding]]
    n, deviation, white, explained = plain_whitening(np.stack(rows.embedding.to_numpy()))
    assert (found.n == n).all() and len(found) == 16 * len(rows) and found.identity_error.max() <= 1e-4
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert np.allclose(wide * np.sign((wide * white).sum(axis=0)), white, atol=1e-9)
    each = found.groupby("vec_id").first().loc[rows.vec_id]
    assert (each.deviation.to_numpy() == deviation).all()
    assert np.allclose(found.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(3)
    good = [[rng.gauss(0, s) for s in (9, 5, 3, 1)] for _ in range(60)]
    odd = [None, [], [None, 1.0, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [1.0, float("-inf"), 1.0, 1.0], [1.0, 2.0], [1e300, 1.0, 1.0, 1.0]]
    rows = [(i, v, "x", i) for i, v in enumerate(good + odd + good[:30])] + [(None, good[0], "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, Deviation long")
    model = whiten.fit(df)
    n, deviation, white, _ = plain_whitening(good + good[:30] + good[:1])
    assert model.n == n and len(model.eigenvalues) == 4
    out = model.transform(df)
    assert out.columns == ["vec_id", "embedding", "x", "deviation", "whitened"]
    got = {r["vec_id"]: r for r in out.collect()}
    ids = [*range(60), *range(67, 97), None]
    assert set(got) == set(ids)
    made = np.array([got[i]["whitened"] for i in ids])
    assert np.allclose(made * np.sign((made * white).sum(axis=0)), white, atol=1e-9)
    assert [got[i]["deviation"] for i in ids] == deviation.tolist()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, [])]])
def test_whitening_without_variance_has_no_components(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whiten.fit(df)
    assert model.components.shape[0] == 0
    assert whiten.whitened_entries(df, model).collect() == []
    assert model.transform(df).filter("size(whitened) > 0").collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(1 << 50) * (i % 3), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whiten.fit(df)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    got = {r["vec_id"]: r["deviation"] for r in model.transform(df).collect()}
    assert got == {i: (d if d < 1 << 63 else None) for i, d in expected.items()}


@pytest.mark.parametrize(("values", "most"), [(np.arange(1, 121.0) ** 2, 512), (np.arange(1, 121.0), 30), (np.r_[np.ones(110), np.full(10, 7.0)], 512), (np.r_[np.zeros(117), [1, 2, 3.0]], 512)])
def test_block_lanczos(values, most):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    matrix = (turn * values) @ turn.T
    passes = []
    found, vectors = whiten.block_lanczos(lambda q: passes.append(q.shape[1]) or matrix @ q, len(values), 6, block=9, most_basis=most)
    assert np.allclose(found, np.sort(values)[::-1][:6], atol=1e-9 * values.max())
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-9 * values.max()
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-10)


# ---------------------------------------------------------------- Merkle manifests


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, siblings of each leaf by level as (left, right))."""
    paths, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p - p % 8 : p - p % 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level = [sha(*level[b : b + 8]) for b in range(0, len(level), 8)]
        place = [p // 8 for p in place]
    return level[0], paths


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """rows: (doc_id, lang, source, n_chars, text); sorted results."""
    groups = {}
    for row in rows:
        doc, lang, source, chars, text = row
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text) if text is not None else None
        leaf, changed = (sha(*map(part, (doc, source, lang, chars, t))) for t in (text, lower))
        tampered = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc is not None, doc or 0, leaf, changed if tampered else leaf, doc))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([r[2] for r in groups[g].sort() or groups[g]]) for g in langs}
    root, above = plain_tree([trees[g][0] for g in langs])
    out = []
    for g, upper in zip(langs, above, strict=True):
        for (_, _, leaf, start, doc), path in zip(groups[g], trees[g][1], strict=True):
            fold = start
            for left, right in path + upper:
                fold = sha(left, fold, right)
            out.append((doc, leaf, trees[g][0], root, sha(*(a + b for a, b in path + upper)), fold, fold == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8], [9, 1], [64, 65, 7], [3] * 70, [700, 2]])
def test_manifest_query_against_a_plain_tree(spark, tmp_path, sizes):
    rng = random.Random(5)
    langs = [None, "", "é", "zz", *(f"l{i}" for i in range(80))]
    rows = []
    for lang, n in zip(langs, sizes, strict=False):
        rows += [(rng.randrange(10**6), lang, rng.choice([None, "s", "ü"]), rng.choice([None, 5]), rng.choice([None, "", "Ab é", "plain"])) for _ in range(n)]
    rows += [rows[0]] * 3 + [(None, langs[0], None, None, "A"), (None, langs[0], None, None, None)] * (len(sizes) > 1)
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_merkle(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == plain_manifest(rows)


def test_manifest_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.op12_merkle(spark, SF)
    expected = con.execute(queries.OP12_SQL)
    assert [d[0] for d in expected.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


def test_manifest_of_an_empty_table_and_of_clashing_columns(spark):
    kinds = "doc_id long, lang string, tree string, place int, digest string, r string, part int, number long, total long, copy int, own int, n int, before int"
    empty = merkle.build(spark.createDataFrame([], kinds), merkle.digest_of(empty_column()))
    assert empty.root is None and empty.rows.collect() == [] and empty.nodes.collect() == []
    rows = [(i, "a", "t", 1, "d", "r", 2, 3, 4, 5, 6, 7, 8) for i in range(20)]
    df = spark.createDataFrame(rows, kinds)
    made = merkle.build(df, merkle.digest_of(empty_column()), keep={c: df[c] for c in df.columns})
    assert sorted(tuple(r["r"]) for r in made.rows.collect()) == rows


def empty_column():
    from pyspark.sql import functions as F

    return F.col("doc_id")


def test_fragments_add_up_in_any_order():
    rng = random.Random(9)
    leaves = {t: [sha(t, str(i)) for i in range(n)] for t, n in (("a", 1), ("b", 8), ("c", 9), ("d", 517))}
    nodes = [(t, len(v), 0, i, d) for t, v in leaves.items() for i, d in enumerate(v)]
    plain = {(t, plain_tree(v)[0]) for t, v in leaves.items() if len(v) > 1}
    for _ in range(5):
        rng.shuffle(nodes)
        fragments, made = [], []
        for b in range(0, len(nodes), 37):
            f = merkle.Forest()
            made += [x for n in nodes[b : b + 37] for x in f.add(*n)]
            fragments.append(f)
        while len(fragments) > 1:
            a, b = fragments.pop(rng.randrange(len(fragments))), fragments.pop(rng.randrange(len(fragments)))
            made += [x for t, level, i, total, d in b.nodes() for x in a.add(t, total, level, i, d)]
            fragments.append(a)
        assert not list(fragments[0].nodes())
        assert {(t, d) for t, level, _, total, d in made if -(-total // 8**level) == 1} == plain
        assert len(made) == len(set(made)) == sum(math.ceil(len(v) / 8**k) for v in leaves.values() for k in range(1, 5) if math.ceil(len(v) / 8 ** (k - 1)) > 1)


# ---------------------------------------------------------------- mixes


def plain_targets(sizes):
    """{source: target}: shares by weight, the excess dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        rate = left / sum(weights[s] for s in open_)
        left = 0.0
        for s in open_:
            target[s] += rate * weights[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def held(rows, sizes, documents, pieces):
    """The rules of a mix, counted plainly."""
    target = plain_targets(sizes)
    of = {d["row"]: d for d in documents}
    assert len(of) == len(documents) == rows
    taken, seen = {}, set()
    for p in pieces:
        d = of[p["row"]]
        taken[d["row"]] = taken.get(d["row"], 0) + p["words"]
        assert 0 < p["words"] <= 512 and p["first_word"] + p["words"] <= d["size"] and p["first_word"] == 512 * p["block"]
        seen.add((p["row"], p["block"], p["turn"]))
    assert len(seen) == len(pieces)
    assert all(t <= 2 * of[r]["size"] for r, t in taken.items())
    for s, size in sizes.items():
        own = [d for d in documents if d["r"]["source"] == s]
        assert {d["source_size"] for d in own} == {size}
        assert all(math.isclose(d["target"], target[s], rel_tol=1e-9, abs_tol=1e-6) for d in own)
        assert abs(sum(taken.get(d["row"], 0) for d in own) - target[s]) <= 0.5 + 1e-6
    by = {}
    for p in pieces:
        by.setdefault(p["shard"], []).append(p["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(v) for v in by.values()]
    assert not counts or max(counts) - min(counts if len(counts) == 40 else [0]) <= 1


def test_mix_query(spark):
    first, again = (queries.op13_mix(spark, SF).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert first.equals(again)
    rows = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in zip(rows.doc_id, rows.text, strict=True)}
    assert len(first) == len(rows) and dict(zip(first.doc_id, first["size"], strict=True)) == size
    source = dict(zip(rows.doc_id, rows.source, strict=True))
    sizes = {}
    for d, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    target = plain_targets(sizes)
    assert (first.taken <= 2 * first["size"]).all()
    for s, part_ in first.groupby(first.doc_id.map(source), dropna=False):
        assert abs(part_.taken.sum() - target[s]) <= 0.5 and np.allclose(part_.target, target[s]) and (part_.source_size == sizes[s]).all()


def test_mix_of_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcde"), rng.choice([1, 3, 511, 512, 513, 2000]), "x") for i in range(300)]
    rows += [(i, "a", 5, "x") for i in range(1000, 4000)] + [(None, None, None, None), (7, None, 40, None), (8, "", 0, None), (9, "f", -3, None), (10, "big", 90_000, None)]
    rows += [(11, "same", 30, "y")] * 400
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, row string")
    made = mix.mix(df.repartition(7), bucket_blocks=64)
    sizes = {}
    for _, s, size, _ in rows:
        sizes[s] = sizes.get(s, 0) + max(size or 0, 0)
    held(len(rows), sizes, made.documents.collect(), made.pieces.collect())
    other = mix.mix(df.repartition(3), bucket_blocks=64)
    totals = [sorted(((str(r["r"]["doc_id"]), r["taken"]) for r in m.documents.join(m.pieces.groupBy("row").agg({"words": "sum"}).withColumnRenamed("sum(words)", "taken"), "row", "left").collect() if r["r"]["doc_id"] != 11), key=str) for m in (made, other)]
    assert str(totals[0]) == str(totals[1])


def test_mix_of_an_empty_table(spark):
    made = mix.mix(spark.createDataFrame([], "doc_id long, source string, size long"))
    assert made.documents.collect() == [] and made.pieces.collect() == []
    made = mix.mix(spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long"))
    assert len(made.documents.collect()) == 1 and made.pieces.collect() == []


def test_words_are_counted_as_a_pattern_does(spark):
    texts = [None, "", " ", "a", " a b\tc\n\x0bd\x0c\re  ", "a\x00b   c\x1f\x85d", "x" * 300_000, "é 😀 " * 5, "a $1 \\ x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", mix.n_words(df["t"])).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_shards_keep_columns_of_any_name(spark):
    kinds = "copy int, h long, block long, r string, row int, place int, key int, bucket int, n int, Slot int, `__copy` int"
    rows = [(i,) + (1, 2, "r", 3, 4, 5, 6, 7, 8, 9) for i in range(90)]
    out = shard.shuffle_into_shards(spark.createDataFrame(rows, kinds), 7)
    assert out.columns == ["copy", "h", "block", "r", "row", "place", "key", "bucket", "n", "__copy", "shard", "slot"]
    assert sorted(r["copy"] for r in out.collect()) == list(range(90))
