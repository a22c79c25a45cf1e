"""Registered queries of this subpackage, over the whole tables of a data folder, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.attribution import attribute_tokens
from emberlog.llm.collocations import collocations
from emberlog.llm.cutting_stock import pack_cutting_stock
from emberlog.llm.decontaminate import benchmark_matches
from emberlog.llm.packing import pack_documents
from emberlog.llm.quality import keep_quality, quality_report
from emberlog.llm.repair import repair_damaged
from emberlog.llm.secrets import find_secrets
from emberlog.llm.sharding import shard_rows
from emberlog.llm.simhash import near_duplicates
from emberlog.llm.token_orc import token_orc_index
from emberlog.llm.url_filter import judge_urls
from emberlog.llm.warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and verdict of every document; null and empty texts have no words and fail, rows that repeat are judged alike, no rows give none."""
    return quality_report(_table(spark, sf_dir, "documents"))


def op7_quality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the cascade keeps: rules run in the order of rejections per second, and what a rule needs is only
    worked out for rows that no rule before it has rejected."""
    return keep_quality(_table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", F.length("text").cast("long").alias("chars"))


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, read back from the ORC files; null and empty texts are the end id alone, rows that repeat are written each, null ids come first, no rows give none."""
    return token_orc_index(_table(spark, sf_dir, "documents"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of rows; null texts have a size of 1, rows that repeat are dealt each, no rows give none."""
    text = F.coalesce("text", F.lit(""))
    columns = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law")]
    return shard_rows(_table(spark, sf_dir, "documents")).select("doc_id", *columns, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; null and empty texts hold none, rows and items that repeat are matched each, no rows give none."""
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WARC record of every page, read back; null pages are empty payloads, of equal ones the largest page_id is the response, no rows give none."""
    return archive_pages(_table(spark, sf_dir, "pages"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; urls without a host have an empty one, rows that repeat are judged alike, no rows give none."""
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; null and empty texts have none, rows that repeat have the same, no rows give none."""
    return find_secrets(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece; null and empty texts are one id, rows that repeat are packed each, null ids stay null, no rows give none."""
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have a fingerprint of zero, rows that repeat are linked, no rows give none."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by section; null and empty texts are one section without tokens, rows that repeat are counted each, no rows give none."""
    return attribute_tokens(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of each language; see :func:`~emberlog.llm.collocations.collocations` for odd rows."""
    return collocations(_table(spark, sf_dir, "documents"))


def op11_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 ids; see :func:`~emberlog.llm.cutting_stock.pack_cutting_stock` for odd rows."""
    return pack_cutting_stock(_table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation; see :func:`~emberlog.llm.repair.repair_damaged` for odd rows."""
    return repair_damaged(_table(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to
FROM q
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS u
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t-\r]') GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n - l.u, 0) AS BIGINT) AS n_dup_lines, coalesce(l.n, 0) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
v AS (SELECT *, n_words < 50 AS few, 100 * n_repeat_words > 50 * n_words AS again, 10 * n_symbols > n_words AS symbols,
        2 * n_dup_lines > n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS odd FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR again AS base_failed,
  NOT (few OR again OR symbols OR lines OR odd) AS kept,
  concat_ws(',', CASE WHEN few THEN 'few_words' END, CASE WHEN again THEN 'repeated_words' END, CASE WHEN symbols THEN 'symbols' END,
    CASE WHEN lines THEN 'repeated_lines' END, CASE WHEN odd THEN 'word_length' END) AS rejected_by
FROM v
"""


OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang HAVING sum(len(w)) > 0),
u AS (SELECT lang, id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM p),
v AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS phrase FROM v UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL UNION ALL
      SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, phrase, a, k, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 :], ' ') AS y
      FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) i),
s AS (SELECT c.lang, c.phrase, c.a, c.k, c.j, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM s),
h AS MATERIALIZED (SELECT lang, max(a) AS a, phrase FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' '), array_to_string(w[3 : 4], ' '), array_to_string(w[1 : 3], ' '), array_to_string(w[2 : 4], ' ')]) AS phrase, phrase AS whole
      FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 2) x) y WHERE phrase <> whole GROUP BY lang, phrase),
q AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE best = 1 AND (h.a IS NULL OR CAST(100 AS HUGEINT) * h.a < CAST(80 AS HUGEINT) * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, t.n, o.score FROM o JOIN t ON t.lang = o.lang WHERE o.rank <= 2000
"""


#: Of OP7_SQL's documents those that are kept.
OP7_KEPT_SQL = f"SELECT k.doc_id, d.lang, d.source, CAST(length(d.text) AS BIGINT) AS chars FROM ({OP7_SQL.strip()}) k JOIN documents d ON d.doc_id = k.doc_id WHERE k.kept"


def _op12_sql() -> str:
    """The same repairs from the last row back: ``b0`` to ``b3`` hold, by state, the cost in nine digits, the audit, a mark and the repaired lines."""
    add = lambda x, cost, edit, line="''": f"lpad(CAST(CAST(substr({x}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{edit}' || substr({x}, 10, strpos({x}, chr(1)) - 9) || {line} || substr({x}, strpos({x}, chr(1)) + 1)"
    never, none = "'900000000' || chr(1)", "'000000000' || chr(1)"
    after, name, ins = (2, 2, 3, 2), {2: "user", 3: "assistant"}, lambda x, q: add(x, 2, "I", f"'{name[q]}:' || chr(10)")
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def opened(q: int) -> str:
        kept = " ".join(f"WHEN NOT must AND initial = '{c}' THEN {add(f'b{r}', 'cut', 'K', 'line')}" for c, r in keeps[q].items())
        same = f"WHEN NOT must AND initial = '' THEN {add(f'b{q}', 'cut', 'K', 'line')}"
        moved = add(f"b{after[q]}", "2 + cut", "R", f"'{name[after[q]]}:' || text || chr(10)")
        return f"least(CASE {kept} {same} ELSE {never} END, CASE WHEN must THEN {never} ELSE {moved} END, {add(f'b{q}', 3, 'D')})"

    opens = ", ".join(f"{opened(q)} AS o{q}" for q in range(4))
    return f"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT * EXCLUDE (k), xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, CAST(3988292384 AS BIGINT)) ELSE xor(a, x) >> 1 END), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM n),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
r AS (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial, role || ':' || text || chr(10) AS line, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS next FROM m),
f AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
g AS (SELECT conv_id, i, initial, line, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
s AS (SELECT conv_id, coalesce(CAST(CAST(max(turn) AS HUGEINT) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(next IS NOT NULL AND initial || next NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
w AS (SELECT conv_id, n AS i, {none} AS b0, {ins(ins(none, 3), 2)} AS b1, {ins(none, 3)} AS b2, {none} AS b3 FROM s
  UNION ALL SELECT conv_id, i - 1, least(o0, {ins('x2', 2)}), least(o1, {ins('x2', 2)}), x2, x3 FROM (SELECT *, least(o2, {ins('o3', 3)}) AS x2, least(o3, {ins('o2', 2)}) AS x3 FROM (SELECT w.conv_id, w.i, {opens} FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i) e) y)
SELECT d.conv_id, coalesce(s.gaps, 0) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank, CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal, coalesce(CAST(substr(b0, 1, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(b0, 10, strpos(b0, chr(1)) - 10), '') AS audit, sha256(coalesce(substr(b0, strpos(b0, chr(1)) + 1, greatest(0, length(b0) - strpos(b0, chr(1)) - 1)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM d.conv_id AND w.i = 0
"""


OP12_SQL = _op12_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_warc, op4_url_filter, op5_secret_scan, op6_best_fit_packing, op7_quality_rules, op7_quality_kept, op8_token_orc, op9_simhash, op10_token_counts, op11_cutting_stock, op12_repair, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op7_quality_rules": OP7_SQL, "op7_quality_kept": OP7_KEPT_SQL, "op12_repair": OP12_SQL, "op13_collocations": OP13_SQL}
