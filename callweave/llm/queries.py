"""The registered queries of the corpus operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, lm, merkle, minhash, mix, shard, simhash, tokencount, toxicity, warc, whiten
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, bpe.lexicon_for(docs)).select("doc_id", "ids")
    back = bpe.decode(ids)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_within(docs, table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard.shuffle_into_shards(rows, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.derive(pages.select("page_id", warc.response_record(F.col("url"), F.col("html"), "2024-01-01T00:00:00Z").alias("record")))
    return found.select(
        "page_id", "status", "response_id", "target_uri", "payload_digest", "metadata_id", "conversion_id", "n_links",
        F.sha2("metadata_record", 256).alias("metadata_sha256"), F.sha2("conversion_record", 256).alias("conversion_sha256"),
        F.length("plain_text").cast("long").alias("text_chars"), F.sha2("plain_text", 256).alias("text_sha256"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of operator 5: bands joined, Jaccard verified; (doc_id, class_id, group_id)."""
    return minhash.near_duplicate_links(table(spark, sf_dir, "documents").select("doc_id", "text"))[1]


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(clash).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: chat.unescape(F.substring("formatted", m["begin"].cast("int") + 1, m["length"].cast("int")))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '&(amp;|#91;|#60;|#62;)', '&amp;\1', 'g'),
      '\[(/?INST\])', '&#91;\1', 'g'), '<(/?s>|<ROLE|</ROLE>>)', '&#60;\1', 'g') AS escaped
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE length(role) + 20 END) + count(*) - 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontam.n_hit_words().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM grams),
spans AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT s.r, s.i, s.n, g.item_id FROM spans s JOIN grams g USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_on_open_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    found = tokencount.count_tokens(docs)
    return found.select(
        "doc_id", "n_tokens", F.col("field_tokens")[0].alias("lang_tokens"), F.col("field_tokens")[1].alias("source_tokens"),
        F.aggregate("line_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("text_tokens"),
        F.size("line_tokens").cast("long").alias("n_lines"), F.array_max("line_tokens").alias("longest_line_tokens"),
        tokencount.digest("line_tokens").alias("line_tokens_sha256"), "crossing_tokens",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten.whitened_entries(rows, whiten.fit(rows))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")

    def leaf(text):
        return merkle.digest_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(F.translate("text", letters, letters.lower())))
    found = merkle.build(docs, leaf(F.col("text")), keep={"doc_id": F.col("doc_id"), "changed": changed})
    again = merkle.folded(F.coalesce(F.col("r.changed"), F.col("leaf")))
    out = found.rows.select("r.doc_id", "leaf", "subroot", F.lit(found.root).cast("string").alias("root"), merkle.proof_digest().alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents)
), h AS (
  SELECT d.doc_id, lang IS NOT NULL AS named, coalesce(lang, '') AS k, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, crc,
    coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM documents d LEFT JOIN crc USING (doc_id)
), d AS (
  SELECT doc_id, named, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed
  FROM h
), l AS (
  SELECT *, row_number() OVER (PARTITION BY named, k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY named, k) AS n FROM d
), lv AS (
  SELECT named, k, 0 AS level, i, n, leaf AS digest FROM l
  UNION ALL
  SELECT named, k, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY named, k, level, i // 8, n
), runs AS (
  SELECT named, k, level, i // 8 AS run, list(digest ORDER BY i) AS ds FROM lv WHERE n > 1 GROUP BY ALL
), subs AS (
  SELECT named, k, digest AS subroot, row_number() OVER (ORDER BY named, k) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1
), up AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM subs
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, i // 8, n
), upruns AS (
  SELECT level, i // 8 AS run, list(digest ORDER BY i) AS ds FROM up WHERE n > 1 GROUP BY ALL
), f AS (
  SELECT named, k, i AS leaf_i, 0 AS level, i, n, coalesce(changed, leaf) AS cur, '' AS proof FROM l
  UNION ALL
  SELECT f.named, f.k, leaf_i, f.level + 1, f.i // 8, (n + 7) // 8,
    sha256(array_to_string(ds[1:f.i % 8], '') || cur || array_to_string(ds[f.i % 8 + 2:8], '')), proof || array_to_string(ds[1:f.i % 8], '') || array_to_string(ds[f.i % 8 + 2:8], '')
  FROM f JOIN runs r ON f.named = r.named AND f.k = r.k AND f.level = r.level AND f.i // 8 = r.run WHERE n > 1
), g AS (
  SELECT f.named, f.k, leaf_i, subroot, 0 AS level, s.i, s.n, cur, proof FROM f JOIN subs s ON f.named = s.named AND f.k = s.k WHERE f.n = 1
  UNION ALL
  SELECT named, k, leaf_i, subroot, g.level + 1, g.i // 8, (n + 7) // 8,
    sha256(array_to_string(ds[1:g.i % 8], '') || cur || array_to_string(ds[g.i % 8 + 2:8], '')), proof || array_to_string(ds[1:g.i % 8], '') || array_to_string(ds[g.i % 8 + 2:8], '')
  FROM g JOIN upruns r ON g.level = r.level AND g.i // 8 = r.run WHERE n > 1
)
SELECT l.doc_id, l.leaf, g.subroot, t.digest AS root, sha256(g.proof) AS proof_sha256, g.cur AS folded_root, g.cur = t.digest AS verified
FROM l JOIN g ON l.named = g.named AND l.k = g.k AND l.i = g.leaf_i AND g.n = 1 CROSS JOIN (SELECT digest FROM up WHERE n = 1) t
"""


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", mix.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    made = mix.mix(rows)
    placed = made.pieces.groupBy("row").agg(
        F.sum("words").alias("taken"), F.count("*").alias("n_pieces"), F.min(F.struct("shard", "slot")).alias("first")
    )
    return made.documents.join(placed, "row", "left").select(
        "r.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        F.coalesce("n_pieces", F.lit(0).cast("long")).alias("n_pieces"), F.col("first.shard").alias("first_shard"), F.col("first.slot").alias("first_slot"),
    )


QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_cross_entropy": (op2_cross_entropy, None),
    "op3_shards": (op3_shards, None),
    "op4_warc": (op4_warc, None),
    "op5_minhash": (op5_minhash, None),
    "minhash_near_duplicates": (minhash_near_duplicates, None),
    "op6_chat": (op6_chat, OP6_SQL),
    "op7_decontamination": (op7_decontamination, OP7_SQL),
    "op8_toxicity": (op8_toxicity, None),
    "op9_token_counts": (op9_token_counts, None),
    "op10_simhash": (op10_simhash, None),
    "op11_whitening": (op11_whitening, None),
    "op12_merkle": (op12_merkle, OP12_SQL),
    "op13_mix": (op13_mix, None),
}
