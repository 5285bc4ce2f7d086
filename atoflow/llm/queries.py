"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atoflow.llm import (bpe, chunks, htmltext, importance, licenses, packing, preference, ranges, repair, simhash, sketch,
                         toxicity, trie, urls)

SHINGLE, RADIUS = 3, 2
#: Rules of the URL query: host and start of path (fixed values of the query).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Hosts whose pages make up the listed URLs of the URL query.
SPAM_HOSTS = ("spam-farm", "cheap-pills")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation is chosen once (pair_id: its id).  Rejected has the first half of its turns,
    then the later turns of the other conversation of 2k and 2k+1, counted by position; without that
    one only the first half.  Turns without a conv_id belong to no conversation."""
    out = preference.conversation_pairs(_read(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["s"], s["e"])), ",")
    return out.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected",
                      spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), placed_turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         count(*) OVER (PARTITION BY conv_id) // 2 AS half FROM t
), sides AS (
  SELECT conv_id AS pair_id, 'c' AS side, place, role, text FROM placed_turns
  UNION ALL
  SELECT conv_id, 'r', place, role, text FROM placed_turns WHERE place < half
  UNION ALL
  SELECT own.conv_id, 'r', other.place, other.role, other.text
  FROM (SELECT DISTINCT conv_id, half FROM placed_turns) own JOIN placed_turns other ON other.conv_id = xor(own.conv_id, 1)
  WHERE other.place >= own.half
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY place) AS pos FROM sides
), aligned AS (
  SELECT pair_id, pos, max(CASE WHEN side = 'c' THEN role END) AS cr, max(CASE WHEN side = 'r' THEN role END) AS rr,
         max(CASE WHEN side = 'c' THEN text END) AS ct, max(CASE WHEN side = 'r' THEN text END) AS rt
  FROM numbered GROUP BY pair_id, pos
), prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN cr IS NULL OR rr IS NULL OR cr <> rr OR ct <> rt THEN pos END) - 1, max(pos)) AS k
  FROM aligned GROUP BY pair_id
), rendered AS (
  SELECT pair_id, side, pos, role, k, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM numbered JOIN prefix USING (pair_id)
), placed AS (
  SELECT *, CASE WHEN pos > k THEN sum(CASE WHEN pos > k THEN length(head) + length(body) ELSE 0 END)
            OVER (PARTITION BY pair_id, side ORDER BY pos) END AS stop FROM rendered
)
SELECT pair_id, max(k)::INT AS prompt_turns,
  coalesce(string_agg(CASE WHEN side = 'c' AND pos <= k THEN head || body END, '' ORDER BY pos), '') AS prompt,
  coalesce(string_agg(CASE WHEN side = 'c' AND pos > k THEN head || body END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN side = 'r' AND pos > k THEN head || body END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN side = 'c' AND pos > k AND role = 'assistant' THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY pos), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN side = 'r' AND pos > k AND role = 'assistant' THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY pos), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sketch, that of its edited text (last quarter replaced by the start of the
    next document), the containment of the first in the edited and in the next one's, and the number
    of hashes that each containment rests on (0 for a text with words: no estimate)."""
    own = sketch.document_fingerprints(_read(spark, sf_dir, "documents"))
    pairs = sketch.with_next(own, "id", ["text", "sk"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = pairs.select("id", n.cast("long").alias("n_chars"), "sk", F.col("next.sk").alias("next_sk"), edited.alias("edited"))
    rows = rows.select("*", sketch.sketch(F.col("edited")).alias("edited_sk"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sk")).alias("fingerprint"), sketch.fingerprint(F.col("edited_sk")).alias("edited_fingerprint"),
        sketch.containment(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        sketch.containment(F.col("sk"), F.col("next_sk")).alias("near_next"),
        sketch.comparable(F.col("sk"), F.col("edited_sk")).alias("near_edited_hashes"),
        sketch.comparable(F.col("sk"), F.col("next_sk")).alias("near_next_hashes"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), vocabulary_path())


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages of the spam hosts, distinct: column key."""
    host = urls.host_of(F.col("url"))
    return pages.select(host.alias("host"), urls.path_of(F.col("url")).alias("path")).filter(
        F.regexp_replace("host", r"^www\.", "").rlike(rf"^({'|'.join(SPAM_HOSTS)})\.")).select(
        urls.canonical(F.col("host"), F.col("path")).alias("key")).distinct()


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.judge(pages, spark.createDataFrame(RULES, "key string, verdict string"), listed_urls(pages))


URL_SQL = f"""
WITH s AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(/index\\.html?)?/?$', '') END AS canon FROM s
), listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '^(www\\.)?({'|'.join(SPAM_HOSTS)})\\.')),
rules(rule, verdict) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in RULES)}),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM rules),
fit AS (
  SELECT DISTINCT host, path, rule, r.verdict FROM c JOIN r
  ON (c.host = rhost OR ends_with(c.host, '.' || rhost)) AND starts_with(c.path, rpath)
), best AS (
  SELECT host, path, rule, verdict FROM fit
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, rule DESC) = 1
)
SELECT c.page_id, c.host, c.path, best.rule,
  coalesce(best.verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  listed.canon IS NOT NULL AS listed
FROM c LEFT JOIN best ON c.host = best.host AND c.path = best.path LEFT JOIN listed ON c.canon = listed.canon
"""


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_dedup(_read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_read(spark, sf_dir, "documents"), shingle=SHINGLE, radius=RADIUS).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of the rebuilt conversations: conversation c has the first h turns of conversation
    c-c%20, then its own turns behind its first h; h is the unsigned crc32 of its decimal id, mod 4.
    Rows without id belong to no conversation.

    The turns have the hashes of their prefixes, made of those of the original conversations: the
    base's first turns, plus a conversation's own hash less that of its first h turns."""
    at = trie.prefixes(turns.filter("conv_id is not null").select(
        "conv_id", "turn", *trie.token(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))), "conv_id", "turn")
    # at most four turns of each of a base's conversations
    heads = at.filter("d <= 4").groupBy(F.expr("conv_id - conv_id % 20").alias("base")).agg(
        F.collect_list(F.struct("conv_id", "d", "words", "x", "y")).alias("all"))
    base = F.sort_array(F.filter("all", lambda s: (s.conv_id == F.col("base")) & (s.d <= 3)))
    each = heads.withColumn("head", base).select("all", "head", F.explode(F.transform(F.filter("all", lambda s: s.d == 1), lambda s: s.conv_id)).alias("conv_id")).withColumn(
        "h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    at_place = lambda d: F.filter("all", lambda s: (s.conv_id == F.col("conv_id")) & (s.d == d))
    taken = each.select("conv_id", "h", F.slice("head", F.lit(1), F.col("h")).alias("head"), F.get(at_place(F.col("h")), F.lit(0)).alias("own"),
                        (F.size(at_place(F.col("h") + 1)) > 0).alias("goes_on"))
    # only conversations whose base is shorter than h shift; their own turns keep their place otherwise
    n, zero = F.size("head"), F.lit(0).cast("long")
    before = lambda i, v: F.coalesce(F.get("head", i - 1)[v], zero)
    moved = lambda c, v, hash_base: trie.shifted(
        F.col(c) - F.coalesce(F.col("own")[v], zero), F.col("h") - n, hash_base, before(n, v))
    kind = "array<struct<d:bigint,words:bigint,x:bigint,y:bigint,px:bigint,py:bigint,last:boolean>>"
    base_x, base_y = trie.BASES
    root = F.struct(zero, zero, zero, zero, F.lit(None).cast("long"), F.lit(None).cast("long"), (n == 0) & ~F.col("goes_on"))
    head = F.transform("head", lambda s, i: F.struct(s.d, s.words, s.x, s.y, before(i, "x"), before(i, "y"), (s.d == n) & ~F.col("goes_on")))
    own = F.struct(F.col("d") - (F.col("h") - n), F.col("words"), moved("x", "x", base_x), moved("y", "y", base_y),
                   moved("px", "x", base_x), moved("py", "y", base_y), F.col("last"))
    none = F.array().cast(kind)
    rows = at.join(taken, "conv_id").select("conv_id", F.inline(F.concat(
        F.when(F.col("d") == 1, F.concat(F.array(root).cast(kind), head.cast(kind))).otherwise(none),
        F.when(F.col("d") > F.col("h"), F.array(own).cast(kind)).otherwise(none))))
    return rows, rows.filter("d = 0").select("conv_id")


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt_turns(_read(spark, sf_dir, "conversations"))
    return trie.prefix_trie(turns, ids)


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with faults put in by the crc32 of ``conv_id:turn``, mod 20; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("lot")
    return turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), lot).filter("lot <> 0").select(
        "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    rows = damaged(turns)
    done = repair.repair(rows)
    ids = turns.select("conv_id").distinct().withColumn("k", ranges.group_key("conv_id"))
    out = ids.join(done.conversations.drop("conv_id"), "k", "left").join(
        repair.gaps(rows, ranges.group_key("conv_id"), "turn"), "k", "left").join(repair.digest(done), "k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_best_fit_packing": best_fit_packing,
    "op2_chat_formatting": chat_formatting,
    "op3_quality_classifier": quality_classifier,
    "op4_document_fingerprints": document_fingerprints,
    "op5_bpe": bpe_round_trip,
    "op6_url_filters": url_filters,
    "op7_exact_dedup": exact_dedup,
    "op8_simhash_near_dedup": simhash_near_dedup,
    "op9_toxicity": toxicity_scores,
    "op10_license_scans": license_scans,
    "op11_html_extraction": html_extraction,
    "op12_conversation_prefix_trie": conversation_trie,
    "op13_conversation_structure_repair": structure_repair,
}
ORACLES = {"op2_chat_formatting": CHAT_SQL, "op6_url_filters": URL_SQL, "op7_exact_dedup": DEDUP_SQL}
