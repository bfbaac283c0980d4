"""One query for each corpus operator, over its whole table, and SQL for the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, html_text, kneser_ney, language_id, line_dedup, merkle, minhash, mixing, packing, quality_rules, warc, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def language_model(docs: DataFrame) -> language_id.Model:
    return language_id.fit(docs)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_model(docs))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = warc.resolve(warc.captures_of(table(spark, sf_dir, "pages")))
    names = F.array_join(F.array_sort(F.map_keys("headers")), ",")
    return done.select(
        "record_id", "canonical_url", "base_id", "outcome", names.alias("header_names"), F.col("headers")["date"].alias("date"), F.col("headers")["content-length"].alias("content_length"),
        F.md5("payload").alias("payload_md5"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.train(html_text.labelled_pages())).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality_rules.decide(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "alone_bit")


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = audio.features(audio.encode(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), audio.digest().alias("feature"),
        "tensors", "spans",
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') t(conv_id, turn, role, text)")
    return chat.digests(chat.formatted(given.union(extra)))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.crc32(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = merkle.manifest(merkle.claims(table(spark, sf_dir, "documents"), tampered))
    found = merkle.folded(F.coalesce("other", "leaf"), F.col("proof"))
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), found.alias("folded_root"))
    return made.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = line_dedup.applied(docs, line_dedup.bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_warc_revisits": op2_warc_revisits,
    "op3_html_extraction": op3_html_extraction,
    "op4_quality_rules": op4_quality_rules,
    "op5_audio_features": op5_audio_features,
    "op6_chat_formatting": op6_chat_formatting,
    "op9_mixing": op9_mixing,
    "op10_kneser_ney_quality": op10_kneser_ney_quality,
    "op7_packing": op7_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE: dict[str, str] = {}

ORACLE["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLE["op4_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN cov USING (doc_id)),
b AS (
  SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 31 = 0 AS kept, bits::BIGINT AS fail_bits, (CASE WHEN bit_count(bits & 31) = 1 THEN bits & 31 ELSE 0 END)::BIGINT AS alone_bit FROM b
"""

ORACLE["op6_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\])')) AS marks FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + marks + 19)::BIGINT AS formatted_chars, true AS round_trip
FROM x GROUP BY conv_id
"""

ORACLE["op9_mixing"] = r"""
WITH h AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':17:' || md5(coalesce(text, '')) || ':' || coalesce('s' || source, '-')) AS hash FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY hash) - 1 AS copy FROM h),
d AS (SELECT row_number() OVER () AS row, doc_id, source, size, CASE WHEN copy = 0 THEN hash ELSE md5(hash || ':' || copy) END AS key FROM n),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source),
l AS (
  SELECT *, ((sum(source_size) OVER ()) - coalesce(3 * sum(source_size) OVER w, 0))::DOUBLE / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least((max(CASE WHEN 3 * source_size >= level * weight THEN level END) OVER ()) * weight, (3 * source_size)::DOUBLE) AS target FROM l),
q AS (
  SELECT d.row, d.doc_id, d.key, d.size, t.source_size, t.target, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS UNBOUNDED PRECEDING))::BIGINT AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (copy * source_size + run) / target AS finish FROM q, unnest([0, 1, 2]) AS u(copy) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, key, copy ROWS UNBOUNDED PRECEDING) AS upto FROM c),
k AS (SELECT row, count(*) AS copies FROM g WHERE upto <= (SELECT sum(size) FROM d) GROUP BY row)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (row)
"""

ORACLE["op2_warc_revisits"] = r"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag FROM pages),
q AS (
  SELECT *, lower(regexp_replace(regexp_extract(rest, '^[^/?#]*'), '^.*@', '')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?([^#]*)', 1), '&'), lambda x: x <> '')) AS pairs FROM p),
u AS (
  SELECT *, regexp_replace(host, '^www\.|:(80|443)?$', '', 'g') || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string(pairs, '&') END AS canonical_url FROM q),
f AS (SELECT canonical_url, page_id * 60 AS ts, 2 * page_id AS record_id, tag, page_id % 28 AS day, html FROM u),
r AS (
  SELECT canonical_url, CASE WHEN page_id % 11 = 0 THEN -1 - page_id ELSE page_id * 60 + 3600 END AS ts, 2 * page_id + 1 AS record_id,
    CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'new' ELSE tag END AS tag, page_id % 28 AS day FROM u),
j AS (
  SELECT r.*, f.record_id AS base_id, f.tag AS base_tag, f.day AS base_day, f.html FROM r LEFT JOIN f
    ON f.canonical_url = r.canonical_url AND (f.ts < r.ts OR f.ts = r.ts AND f.record_id < r.record_id)
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1),
o AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no earlier response' WHEN CASE WHEN tag IS NULL THEN day = base_day ELSE tag = base_tag END THEN 'resolved' ELSE 'validators differ' END AS outcome FROM j)
SELECT record_id, canonical_url, base_id, outcome,
  CASE WHEN outcome = 'resolved' THEN 'content-length,content-type,date,expires,vary' END AS header_names, CASE WHEN outcome = 'resolved' THEN ts::VARCHAR END AS date,
  CASE WHEN outcome = 'resolved' THEN length(html)::VARCHAR END AS content_length, CASE WHEN outcome = 'resolved' THEN md5(html) END AS payload_md5
FROM o
"""

SQL_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL_CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""


def sql_tree(name: str, nodes: str, levels: int = 6) -> str:
    """name0, name1, ...: levels of trees over nodes (t, i, h); name_p: t, i (of a node), at, left and right of its run, for each level that it has."""
    out, up = [f"{name}0 AS ({nodes})"], []
    for k in range(levels):
        # A tree of one node has no further level.
        out.append(f"{name}{k + 1} AS (SELECT t, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE t IN (SELECT t FROM {name}{k} WHERE i > 0) GROUP BY t, i // 16)")
        up.append(f"SELECT a.t, a.i, {k} AS k, (SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {name}{k} b WHERE b.t = a.t AND b.i // 16 = a.i // {16 ** (k + 1)} AND b.i < a.i // {16**k}) AS l, "
                  f"(SELECT coalesce(string_agg(b.h, '' ORDER BY b.i), '') FROM {name}{k} b WHERE b.t = a.t AND b.i // 16 = a.i // {16 ** (k + 1)} AND b.i > a.i // {16**k}) AS r FROM {name}0 a WHERE a.t IN (SELECT t FROM {name}{k} WHERE i > 0)")
    tops = " UNION ALL ".join(f"SELECT t, h FROM {name}{k} WHERE t NOT IN (SELECT t FROM {name}{k} WHERE i > 0)" for k in range(levels + 1))
    return ", ".join([*out, f"{name}_p AS ({' UNION ALL '.join(up)})", f"{name}_top AS ({tops})"])


ORACLE["op11_merkle_manifest"] = f"""
WITH v AS (SELECT *, translate(text, {SQL_SMALL}) AS low, {SQL_CRC32} % 5 = 0 AS tampered FROM documents),
f AS (
  SELECT doc_id, source, tampered, low IS DISTINCT FROM text AS changed, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS low_body FROM v),
g AS (SELECT *, sha256(head || body) AS leaf, CASE WHEN tampered THEN sha256(head || low_body) ELSE sha256(head || body) END AS claim, coalesce('s' || source, '-') AS t FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM g),
{sql_tree("d", "SELECT t, i, leaf AS h FROM o")},
{sql_tree("s", "SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h FROM d_top", 3)},
n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, h FROM d_top),
p AS (
  SELECT o.t, o.i, d_p.k, d_p.l, d_p.r FROM o JOIN d_p ON d_p.t = o.t AND d_p.i = o.i
  UNION ALL SELECT o.t, o.i, 100 + s_p.k, s_p.l, s_p.r FROM o JOIN n ON n.t = o.t JOIN s_p ON s_p.i = n.i),
q AS (SELECT t, i, list({{'l': l, 'r': r}} ORDER BY k) AS steps, string_agg(l || r, '' ORDER BY k) AS proof FROM p GROUP BY t, i),
z AS (
  SELECT o.doc_id, o.leaf, n.h AS subroot, s_top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce([{{'l': '', 'r': claim}}] || coalesce(steps, []), lambda a, b: {{'l': '', 'r': sha256(b.l || a.r || b.r)}}).r AS folded_root
  FROM o JOIN n ON n.t = o.t LEFT JOIN q ON q.t = o.t AND q.i = o.i, s_top)
SELECT *, folded_root = root AS verified FROM z
"""

ORACLE["op12_line_dedup"] = f"""
WITH l AS (SELECT row, doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {SQL_SMALL}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n FROM k WHERE length(key) >= 40 GROUP BY key),
d AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON c.key = k.key AND c.n >= 5 AND k.doc_id IS DISTINCT FROM c.keeper)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY row
"""
