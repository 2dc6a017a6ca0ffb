"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import best_position, chat, fertility, iso_media, merkle, packing, pseudonyms, secret_battery, sentencepiece_backend, simhash, sparse_suffix, token_frames, url_filter
from tracemill.llm.shared import table, written

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_frames.write_token_frames(table(spark, sf_dir, "documents"), BYTE_BPE)
    return token_frames.read_token_frames(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_backend.encode_pieces(table(spark, sf_dir, "documents"), PIECES)
    decoded = sentencepiece_backend.decode_pieces(encoded, PIECES)
    return decoded.select("doc_id", "n_tokens", "n_byte_tokens", F.crc32("ids").alias("ids_crc32"), "parity", F.sha2("text", 256).alias("decoded_sha256"))


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = fertility.judge(fertility.measured(docs, BYTE_BPE, PIECES).withColumn("doc", F.col("doc").dropFields("text")), fertility.BANDS)
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(F.round(m, 6).alias(m) for m in fertility.MEASURES), "script",
    )


def op5_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_battery.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in range(3)]
    counts = [(F.size(kinds) - n).cast("long").alias(f"n_{secret_battery.KINDS[k]}") for k, n in enumerate(counts)]
    return found.select(
        "doc_id", *counts, F.sha2(secret_battery.listed(F.col("base")), 256).alias("base_sha256"), secret_battery.listed(F.col("spans")).alias("spans")
    )


def op6_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_and_encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "k")
    return packing.pack(digests)


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(iso_media.store_texts(table(spark, sf_dir, "documents")), "media")
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["length"].cast("string"))), ",")
    feature = F.concat_ws(";", "codec", F.format_string("%.3f", "duration"), F.col("n_samples").cast("string"), ranges)
    columns = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return iso_media.probe_media(stored).select(*columns, feature.alias("feature"))


#: For these tables only; a deployment passes its own secret.
KEY = "tracemill-test-key"


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op9_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = sparse_suffix.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated_words", listed("spans").alias("spans"), listed("dropped").alias("dropped"))


#: The rules that decide before the model.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op10_url_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))
    tree = merkle.manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", columns, [tampered.alias("tampered")])
    found = merkle.proofs(tree).withColumn("folded", merkle.folded(F.coalesce("kept.tampered", "leaf"), "path"))
    root = F.lit(tree.root).cast("string")
    return found.select("kept.doc_id", "leaf", "subroot", root.alias("root"), "folded.proof_sha256", "folded.folded_root", (F.col("folded.folded_root") == root).alias("verified"))


OP11_SQL = """WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
rows AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered,
  {v('doc_id')} || {v('source')} || {v('lang')} AS head, {v('text')} AS tail FROM documents, crc),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, sha256(head || {v('n_chars')} || tail) AS leaf, CASE WHEN tampered THEN sha256(head || {v('n_chars + 1')} || tail) END AS changed FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves),
own AS (SELECT grp, 0 AS level, pos, n, leaf AS digest FROM placed UNION ALL SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM own WHERE n > 1 GROUP BY grp, level, pos // 2, n),
subroots AS (SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS gpos, count(*) OVER () AS gn FROM own WHERE n = 1),
top AS (SELECT 0 AS level, gpos AS pos, gn AS n, subroot AS digest FROM subroots UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (SELECT p.grp, p.pos, o.level, o.pos & 1 AS side, s.digest FROM placed p JOIN own o ON o.grp = p.grp AND o.pos = p.pos >> o.level AND o.n > 1 LEFT JOIN own s ON s.grp = o.grp AND s.level = o.level AND s.pos = xor(o.pos, 1)),
gsteps AS (SELECT g.grp, o.level, o.pos & 1 AS side, s.digest FROM subroots g JOIN top o ON o.pos = g.gpos >> o.level AND o.n > 1 LEFT JOIN top s ON s.level = o.level AND s.pos = xor(o.pos, 1)),
below AS (SELECT grp, pos, list({e} ORDER BY level) AS path FROM steps GROUP BY grp, pos),
above AS (SELECT grp, list({e} ORDER BY level) AS path FROM gsteps GROUP BY grp),
folded AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM top WHERE n = 1) AS root, coalesce(p.changed, p.leaf) AS start, list_concat(coalesce(b.path, []), coalesce(a.path, [])) AS path FROM placed p JOIN subroots s USING (grp) LEFT JOIN below b USING (grp, pos) LEFT JOIN above a USING (grp)),
ended AS (SELECT *, list_reduce(list_prepend(start, path), lambda acc, e: sha256(CASE e[1] WHEN 'L' THEN e[2:] || acc WHEN 'R' THEN acc || e[2:] ELSE acc END)) AS folded_root FROM folded)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ended"""
for _column in ("doc_id", "source", "lang", "text", "n_chars", "n_chars + 1"):
    _text = f"CAST({_column} AS VARCHAR)"
    OP11_SQL = OP11_SQL.replace(f"{{v('{_column}')}}", f"coalesce(strlen({_text}) || ':' || {_text}, '-')")
OP11_SQL = OP11_SQL.replace("{e}", "CASE WHEN digest IS NULL THEN 'A' WHEN side = 1 THEN 'L' || digest ELSE 'R' || digest END")


def op12_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], given.schema)
    found = chat.read_back(chat.formatted(given.unionByName(added)))
    return found.select(F.col("conversation").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_wrong")


OP12_SQL = r"""WITH given AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))),
turns AS (SELECT *, row_number() OVER w - 1 AS place, CASE coalesce(lag(role) OVER w, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' END AS fits,
  last_value(role) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ending FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST)),
sums AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned,
  CAST(sum(length('<turn>' || chr(10) || '</turn>' || chr(10)) + coalesce(length(' ' || regexp_replace(role, '([^A-Za-z0-9_-])', '..', 'g')), 0) + length(regexp_replace(text, '(\\|<turn|</turn>)', '.\1', 'g'))) AS BIGINT) AS formatted_chars,
  min(place) FILTER (fits IS NOT TRUE) AS first_wrong, any_value(ending) AS ending FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars, first_wrong IS NULL AND ending = 'assistant' AS valid, first_wrong FROM sums"""


def op13_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


OP13_SQL = r"""WITH terms AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
whole AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM terms WHERE len(t) > 0),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
words AS (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM terms),
postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3, 4),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(whole.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term),
impacts AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * postings.n * whole.n) // whole.l))) AS impact FROM postings JOIN weights USING (term), whole),
scores AS (SELECT item_id, row, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY 1, 2, 3),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM best WHERE rank <= 10"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_simhash_popcount": op2_simhash_popcount,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_fertility": op4_fertility,
    "op5_secret_battery": op5_secret_battery,
    "op6_min_slack_packing": op6_min_slack_packing,
    "op7_iso_media": op7_iso_media,
    "op8_feistel_pii": op8_feistel_pii,
    "op9_sparse_suffix": op9_sparse_suffix,
    "op10_url_logreg": op10_url_logreg,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_chat_machine": op12_chat_machine,
    "op13_best_position": op13_best_position,
}

ORACLE_SQL: dict[str, str] = {"op11_merkle_manifest": OP11_SQL, "op12_chat_machine": OP12_SQL, "op13_best_position": OP13_SQL}
