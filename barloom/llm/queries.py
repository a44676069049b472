"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bpe, chat, fmindex, lines, mainhtml, minhash, multiindex, repair, search, substrings, toxicity, urls, warc
from barloom.llm.common import fresh_path, read
from barloom.llm.registry import ENTRIES, entry

__all__ = ["ENTRIES"]


def tokenizer() -> str:
    """Public tokenizer file of the query; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PLAIN_WORDS = r"list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_FOLDED_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP3_SQL = f"""
WITH w AS (SELECT doc_id, {_FOLDED_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_FOLDED_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, md5(array_to_string(ws[i:i+least(10,len(ws))-1], ' ')) AS k
 FROM b, unnest(range(1, len(ws)-least(10,len(ws))+2)) t(i) WHERE len(ws) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, md5(array_to_string(ws[i:i+n-1], ' ')) AS k FROM w, n, unnest(range(1, len(ws)-n+2)) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
cov AS (SELECT doc_id, count(DISTINCT i+j) AS n_hit FROM hit, range(60) r(j) WHERE j < n GROUP BY doc_id),
it AS (SELECT doc_id, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(len(ids),0) AS n_items,
 sha256(coalesce(array_to_string(list_sort(ids),','),'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP7_SQL = f"""
WITH w AS (SELECT doc_id, {_PLAIN_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM w, unnest(range(1, len(ws)-48)) t(i)),
f AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, i+j AS p FROM win JOIN f USING (k), range(50) r(j) WHERE doc_id > d),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws)-coalesce(n,0) AS n_removed, sha256(coalesce(s,'')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


#: Both turns of the conversation that the query adds hold control strings.
_ADDED = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace({}, '([\[<])(\\*)(s>|/s>|INST\]|/INST\]|OUT\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\])', '\1\2\\\3', 'g')"

OP5_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
 UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_ADDED}'), (-7, 1, 'assistant', '{_ADDED}')) v(conv_id, turn, role, text)),
n AS (SELECT *, CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 WHEN 'system' THEN 15 ELSE 19 + len({_ESCAPED.format("role")}) END AS around FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'), '') AS l, 3 + sum(around + len({_ESCAPED.format("text")})) AS f
 FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, len(l) AS loss_chars, sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM g"""


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html,'') AS h, sha1(coalesce(html,'')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS last FROM p GROUP BY s)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1+5*(i//4) AS INT), 5) AS INT) >> CAST(15-5*(i%4) AS INT)) & 31) AS INT), 1) for i in range(32)], '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN m USING (s)"""


OP11_SQL = f"""
WITH d AS (SELECT doc_id, len(ws) AS n, ws FROM (SELECT doc_id, {_FOLDED_WORDS} AS ws FROM documents) WHERE len(ws) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_FOLDED_WORDS}) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000*ln((2*docs+2)/(2*count(*)+1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w*((1000000000*tf)//(1000*tf+8*(100-90+((90*n*docs)//terms))))) AS BIGINT) AS score
 FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10"""

OP13_SQL = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text,''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM s, unnest(range(1, len(ls)+1)) t(i)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < last) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id"""


@entry("op1_embedding_near_dedup", OP1_SQL)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.linked(read(spark, sf_dir, "embeddings"))


@entry("op2_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"), urls.QUERY_RULES).drop("blocked")


@entry("op4_warc", OP4_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


@entry("op5_chat_formatting", OP5_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", _ADDED), (-7, 1, "assistant", _ADDED)], "conv_id long, turn long, role string, text string")
    return chat.digest(rows.union(added))


@entry("op3_benchmark_decontamination", OP3_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@entry("op6_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@entry("op7_substring_dedup", OP7_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


@entry("op8_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(read(spark, sf_dir, "documents"), plain=True)


@entry("op9_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extracted(read(spark, sf_dir, "pages"))


@entry("op10_bpe_encoding_and_decoding")
def bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), tokenizer(), ["doc_id"])


@entry("op13_line_dedup", OP13_SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(read(spark, sf_dir, "documents"))


@entry("op11_ranked_lexical_search", OP11_SQL)
def ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@entry("op12_conversation_structure_repair")
def conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(read(spark, sf_dir, "conversations"))
