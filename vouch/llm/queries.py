"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vouch.llm import adapt_join, chat_parts, latent_decontam, line_runs, mixing, ppm_language, prefix_trie, pseudonyms, rendezvous, simhash, simhash_groups, toxicity, whitening
from vouch.sources.tables import Tables, table_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


#: Grades of severity above 0 that the two-valued toxic labels are spread over.
SEVERITIES = 3


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.OrdinalModel | None:
    t = Tables(spark, sf_dir)
    return toxicity.learn(t.documents, t.labels, "toxic", spread=SEVERITIES)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade_documents(Tables(spark, sf_dir).documents, toxicity_model(spark, sf_dir))


_WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UPPER}', '{_UPPER.lower()}') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op2_line_runs", OP2_SQL)
def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go; the files arrive in batches."""
    batches = line_runs.file_batches(spark, table_path(sf_dir, "documents"))
    out = line_runs.drop_common_lines(batches, Tables(spark, sf_dir).documents, min_docs=10, min_chars=1, fan_in=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The key of the pseudonyms; a deployment passes its own secret.
PSEUDONYM_KEY = b"pseudonyms of the test tables"


@query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise_documents(Tables(spark, sf_dir).documents, PSEUDONYM_KEY)


@query("op4_latent_decontam")
def op4_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return latent_decontam.find_contamination(t.documents, t.benchmark)


OP5_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.t = y.t AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)"""


@query("op5_adapt_join", OP5_SQL)
def op5_adapt_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_join.jaccard_components(Tables(spark, sf_dir).documents, width=4, percent=85)


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(Tables(spark, sf_dir).documents)


#: A conversation whose texts hold the control strings of the template.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"

OP7_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
said AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length('### ') + length(role) + length(': ') + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length('</turn>') + 1 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id"""


@query("op7_chat_parts", OP7_SQL)
def op7_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(PROBE_ID, i, role, PROBE_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string")
    rows = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role", "text").union(probe)
    return chat_parts.read_back(chat_parts.format_turns(rows)).drop("attachment_tokens")


OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sized GROUP BY source),
weighed AS (SELECT *, ([3.0, 1.0, 2.0])[(r % 3 + 1)::INT]::DOUBLE AS w, source_size::DOUBLE * 2 AS cap FROM src),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5
    - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM levels),
placed AS (SELECT d.*, p.source_size, p.target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT *, floor(target)::BIGINT // source_size AS f, floor(target)::BIGINT % source_size AS r, (source_size + 1023) // 1024 AS blocks
  FROM plan WHERE source_size > 0),
quotas AS (SELECT *, f * blocks + (r + 1023) // 1024 AS quota FROM cut),
stretches AS (SELECT *, coalesce(sum(quota) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo,
  (sum(quota) OVER ())::BIGINT AS n FROM quotas),
points AS (SELECT k, ((k::HUGEINT * {mixing.GOLDEN} + {mixing.GOLDEN // 2}) % {1 << 53})::DOUBLE / {1 << 53}::DOUBLE AS x
  FROM range((SELECT coalesce(max(n), 0) FROM stretches)) t(k)),
drawn AS (SELECT k, s.source, f, r, blocks, quota, row_number() OVER (PARTITION BY s.source ORDER BY k) - 1 AS turn
  FROM points JOIN stretches s ON x >= lo::DOUBLE / n::DOUBLE AND x < (lo + quota)::DOUBLE / n::DOUBLE),
had AS (SELECT source, count(*) AS got FROM drawn GROUP BY source),
late AS (SELECT s.n, s.source, f, r, blocks, unnest(range(coalesce(got, 0), quota)) AS turn
  FROM stretches s LEFT JOIN had h ON s.source IS NOT DISTINCT FROM h.source),
turns AS (SELECT k, source, f, r, blocks, turn FROM drawn WHERE turn < quota UNION ALL SELECT n + turn, source, f, r, blocks, turn FROM late),
slots AS (SELECT k, source, turn % blocks AS block, CASE WHEN turn // blocks < f THEN 1024 ELSE least(1024, r - turn % blocks * 1024) END AS most FROM turns),
pieces AS (SELECT *, unnest(range(a // 1024, (a + size - 1) // 1024 + 1)) AS block FROM placed WHERE size > 0),
parts AS (SELECT p.doc_id, p.source, p.size, p.a, s.k,
    greatest(0, least(least(p.a + p.size - p.block * 1024, 1024), coalesce(s.most, 0)) - greatest(p.a - p.block * 1024, 0)) AS words
  FROM pieces p LEFT JOIN slots s ON s.source IS NOT DISTINCT FROM p.source AND s.block = p.block),
takes AS (SELECT doc_id, source, size, a, sum(words)::BIGINT AS taken, count(*) FILTER (words > 0) AS n_slots, min(k) FILTER (words > 0) AS first_position
  FROM parts GROUP BY doc_id, source, size, a)
SELECT p.doc_id, p.size, p.source_size, p.target, p.source, coalesce(t.taken, 0)::BIGINT AS taken, coalesce(t.n_slots, 0) AS n_slots, t.first_position
FROM placed p LEFT JOIN takes t ON t.doc_id IS NOT DISTINCT FROM p.doc_id AND t.source IS NOT DISTINCT FROM p.source AND t.a = p.a AND p.size > 0 AND t.size = p.size"""


@query("op8_mix", OP8_SQL)
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(Tables(spark, sf_dir).documents)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "n_slots", "first_position")


#: Eight equal shards.
SHARD_WEIGHTS = [1.0] * 8


def _draw_sql(shard: int) -> str:
    return f"-ln((('0x' || substr(md5(key || ':{shard}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _pick_sql(shards: int) -> str:
    draws = ", ".join(_draw_sql(s) for s in range(shards))
    return f"list_position([{draws}], least({draws})) - 1"


# crc32 of a byte list, bit by bit from the polynomial: a table of 256 entries, then one step per byte.
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
OP9_SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
sized AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode(text))),
        lambda p: ('0x' || substr(hex(encode(text)), 2 * p + 1, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) END AS text_crc32
  FROM documents, tab),
placed AS (SELECT *, {_pick_sql(8)} AS shard, {_pick_sql(9)} AS grown_shard, md5(key || ':' || text_crc32) AS h FROM sized)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed"""


@query("op9_rendezvous", OP9_SQL)
def op9_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rendezvous.shard_documents(Tables(spark, sf_dir).documents, SHARD_WEIGHTS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op10_ppm_language")
def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.withColumn("held_out", ppm_language.held_out())
    trees = ppm_language.learn(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return ppm_language.identify(docs, trees, ["doc_id", "held_out"])


def _crc_sql(text: str) -> str:
    """crc32 of a text that is not empty; needs the CTEs ``crc`` and ``tab``."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda p: ('0x' || substr(hex(encode({text})), 2 * p + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


OP11_SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM crc WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c::VARCHAR AS name FROM own),
convs AS (SELECT c, c - c % 100 AS base, {_crc_sql('name')} % 6 AS h FROM ids, tab),
heads AS (SELECT v.c, o.pos AS d, o.role, o.said FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h),
taken AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT o.c, o.pos - v.h + coalesce(t.n, 0), o.role, o.said FROM own o JOIN convs v ON v.c = o.c LEFT JOIN taken t ON t.c = o.c WHERE o.pos > v.h),
keyed AS (
  SELECT c, d, length(said) AS chars,
    md5(string_agg(md5(role) || md5(said), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS node,
    coalesce(md5(string_agg(md5(role) || md5(said), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS up
  FROM rebuilt),
passed AS (SELECT c, d, chars, node, up FROM keyed UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
nodes AS (SELECT node, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM passed GROUP BY node, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up = n.node),
below AS (
  SELECT a.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM counted n JOIN passed a ON a.c = n.conv_id AND a.d <= n.d GROUP BY a.node),
last AS (SELECT c, arg_max(node, d) AS node FROM passed GROUP BY c),
ends AS (SELECT node, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last GROUP BY node)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM counted n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.up LEFT JOIN ends e ON e.node = n.node"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(Tables(spark, sf_dir).conversations)


@query("op12_simhash_groups")
def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups.simhash_components(Tables(spark, sf_dir).documents, width=4, radius=4)


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(Tables(spark, sf_dir).embeddings, most=32)


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep all their columns."""
    return toxicity.clean_documents(docs, toxicity_model(spark, sf_dir))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one that names it (five-word shingles, 0.8)."""
    return adapt_join.one_per_component(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; the others keep all their columns."""
    return latent_decontam.clean_documents(docs, Tables(spark, sf_dir).benchmark)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times)."""
    return mixing.mixed_documents(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = rendezvous.shard_documents(docs, SHARD_WEIGHTS)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
