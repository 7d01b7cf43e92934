"""Queries on texts that Spark derives from the driver tables, so that both outcomes of an operator
occur (greetings and questions, cache hits and misses, known and unknown titles, grams and kilograms),
each beside its DuckDB SQL with every constant written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesmith.functions import text as T
from lakesmith.operators import conversations as CV
from lakesmith.operators.retrieval import source_title_dim
from lakesmith.plans.tables import table
from lakesmith.sources.files import rows_as_documents
from lakesmith.streaming.ingest import merge_into, normalized_names, unprocessed_batches

# Opening turns that people write; the rest of the conversation stays as it is.
OPENINGS = ("Xin  CHÀO, bạn!", "hello", "Chào bạn...", "Hi there", "xin chào bác sĩ")
# File names put in place of a page's own: two known ones, one with a title override, one unknown.
FILE_NAMES = ("cay_rau_lam_thuoc.md", "duoclieutrungcap.md", "So_tay_thuoc_nam.pdf", "my_own_notes.txt")
MEMORY = 4  # messages kept a session: fewer than the default, as the given conversations are short


def _nth(values: tuple[str, ...], number: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(number) % len(values) + 1).cast("int"))


def q_greeting_opening(spark, d) -> DataFrame:
    """P20: every conversation opens with one of five phrases, three of them greetings."""
    said = table(spark, d, "conversations").withColumn(
        "text", F.when(F.col("turn") == 0, _nth(OPENINGS, "conv_id")).otherwise(F.col("text")))
    return said.select("conv_id", "turn", F.when(T.is_greeting("text"), "greeting").otherwise("retrieval").alias("route"))


def q_cache_repeats(spark, d) -> DataFrame:
    """Every question is asked again, with other punctuation, in a later conversation."""
    users = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("again"), "text")
    again = users.select((F.col("conv_id") + 1).alias("conv_id"), "turn", F.lit(1).alias("again"),
                         F.concat("text", F.lit("?!")).alias("text"))
    return CV.cache_hits(users.unionAll(again), ["conv_id", "turn", "again"]).select("conv_id", "turn", "again", "query_hash", "hit")


def q_orphans_by_language(spark, d) -> DataFrame:
    """Labels whose document is not among the English ones."""
    english = table(spark, d, "documents").where("lang = 'en'")
    return CV.orphans(table(spark, d, "labels"), english, "doc_id", "doc_id")


def q_known_source_titles(spark, d) -> DataFrame:
    """Pages renamed to files of which some have a catalogue title or an override."""
    pages = table(spark, d, "pages").select("page_id", F.concat(
        F.lit("s3://store/books/"), _nth(FILE_NAMES, "page_id"), F.lit("?v=2#top")).alias("url"))
    j = pages.withColumn("file_name", T.basename("url")).join(F.broadcast(source_title_dim(spark)), "file_name", "left")
    return j.select("page_id", "file_name", F.coalesce("title", T.format_source_name("url")).alias("display_title"))


def q_dose_units(spark, d) -> DataFrame:
    """Part sizes as ranges in grams, single kilograms and decimal-comma ranges in kilograms."""
    size = F.col("p_size").cast("string")
    text = (F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(" - "), (F.col("p_size") + 2).cast("string"), F.lit("g")))
            .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Liều "), size, F.lit("kg")))
            .otherwise(F.concat(size, F.lit(",5 đến "), (F.col("p_size") + 1).cast("string"), F.lit(",25 KG"))))
    lo, hi = T.dose_bounds(text)
    return table(spark, d, "part").select("p_partkey", lo.alias("min_g"), hi.alias("max_g"))


def q_medicine_fields(spark, d) -> DataFrame:
    """Taste, nature and channel captured from a sentence built of a part's columns."""
    text = F.concat(F.lit("VỊ  "), "p_brand", F.lit(", tính "), "p_type", F.lit(". Vào\n"), "p_name", F.lit(". Hết"))
    return table(spark, d, "part").select(
        "p_partkey", *[c.alias(n) for n, c in T.extract_fields(text, T.MEDICINE_FIELD_PATTERNS).items()])


def q_herb_names(spark, d) -> DataFrame:
    """Comma lists and core names, with plant-part words and a synonym in parentheses."""
    listed = F.concat(F.lit(" ,"), "p_name", F.lit(" , ,"), F.upper("p_brand"), F.lit(","))
    herb = F.concat(F.lit("Cây LÁ "), "p_name", F.lit(" (củ "), "p_brand", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.parse_list_field(listed), "|").alias("items"),
                                          F.array_join(T.herb_core_names(herb), "|").alias("core_names"))


def q_rolling_memory(spark, d) -> DataFrame:
    """K7: the last messages of every session in time order."""
    messages = CV.unpivot_messages(CV.qa_pairs(table(spark, d, "conversations")))
    return CV.rolling_memory(messages, n=MEMORY).select("conv_id", "turn", "msg_no", "role", "pos")


def q_unique_keys(spark, d) -> DataFrame:
    """Violations of four uniqueness rules (document etag, page host, user account, session turn)."""
    rules = {
        "etag": ("documents", F.sha2("text", 256)),
        "host": ("pages", F.substring_index(F.substring_index("url", "/", 3), "/", -1)),
        "user": ("events", F.col("user_id").cast("string")),
        "session_role": ("conversations", F.concat_ws(":", "conv_id", "role")),
    }
    parts = [CV.unique_violations(table(spark, d, name).where(key.isNotNull()), key).select(F.lit(rule).alias("rule"), "key", "n")
             for rule, (name, key) in rules.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def q_unprocessed_batches(spark, d) -> DataFrame:
    """Orders arrive in one batch a year; years up to 1996 are in the state, the rest are folded in."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice",
                                              F.year("o_orderdate").alias("_batch_id"))
    orders = normalized_names(orders, "o_orderpriority")
    done = orders.where("_batch_id <= 1996")
    cols = ["o_orderstatus", "o_totalprice"]
    state = merge_into(None, done, "o_orderpriority", "o_orderkey", cols)
    new = unprocessed_batches(orders, done)
    return merge_into(state, new, "o_orderpriority", "o_orderkey", cols)


def q_row_documents(spark, d) -> DataFrame:
    """One document per supplier row through the loader's own function."""
    return rows_as_documents(table(spark, d, "supplier"), source="s_suppkey").withColumnRenamed("source", "s_suppkey")


# --- DuckDB ----------------------------------------------------------------------------------------

_PUNCT = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
_NORM = "regexp_replace(trim(regexp_replace(lower({}), '[\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' '), '" + _PUNCT.replace(
    "{", "{{").replace("}", "}}") + "', '', 'g')"

SQL = {
    "greeting_opening": """
SELECT conv_id, turn, CASE WHEN turn = 0 AND conv_id % 5 IN (0, 1, 2) THEN 'greeting' ELSE 'retrieval' END AS route
FROM conversations""",
    "cache_repeats": f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, turn, 0 AS again, text FROM u UNION ALL SELECT conv_id + 1, turn, 1, text || '?!' FROM u),
h AS (SELECT conv_id, turn, again, sha256({_NORM.format('text')}) AS query_hash FROM q)
SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY conv_id, turn, again) > 1 AS hit FROM h""",
    "orphans_by_language": """
SELECT l.* FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)
WHERE d.doc_id IS NULL""",
    "known_source_titles": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'cay_rau_lam_thuoc.md' WHEN 1 THEN 'duoclieutrungcap.md'
                                 WHEN 2 THEN 'So_tay_thuoc_nam.pdf' ELSE 'my_own_notes.txt' END AS file_name,
  CASE page_id % 4
    WHEN 0 THEN 'Cây rau làm thuốc' || chr(10) || '        Tác giả: Pts. Võ Văn Chi' || chr(10) || '        Nhà xuất bản Tổng hợp Đồng Tháp'
    WHEN 1 THEN 'DƯỢC LIỆU TRUNG CẤP' || chr(10) || '        BỘ Y TẾ VỤ Y HỌC CỔ TRUYỀN' || chr(10)
             || '        (SÁCH DÙNG ĐÀO TẠO DƯỢC SỸ TRUNG HỌC)' || chr(10) || '        NHÀ XUẤT BẢN Y HỌC'
    WHEN 2 THEN 'Sổ tay thuốc Nam' ELSE 'My own notes' END AS display_title
FROM pages""",
    "dose_units": """
SELECT p_partkey,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size * CAST(1000 AS DOUBLE) ELSE (p_size + 0.5::DOUBLE) * 1000 END AS min_g,
  CASE p_partkey % 3 WHEN 0 THEN CAST(p_size + 2 AS DOUBLE) WHEN 1 THEN p_size * CAST(1000 AS DOUBLE) ELSE (p_size + 1.25::DOUBLE) * 1000 END AS max_g
FROM part""",
    "medicine_fields": "SELECT p_partkey, p_brand AS vi, p_type AS tinh, p_name AS quy_kinh FROM part",
    "herb_names": """
SELECT p_partkey, lower(p_name) || '|' || lower(p_brand) AS items, lower(p_name) || '|' || lower(p_brand) AS core_names FROM part""",
    "rolling_memory": """
WITH p AS (SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations)
           WHERE role = 'user' AND nr = 'assistant'),
m AS (SELECT conv_id, turn, 0 AS msg_no, 'user' AS role FROM p UNION ALL SELECT conv_id, turn, 1, 'assistant' FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, msg_no DESC) AS k FROM m)
SELECT conv_id, turn, msg_no, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, msg_no) AS pos FROM r WHERE k <= 4""",
    "unique_keys": """
SELECT 'etag' AS rule, sha256(text) AS key, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'host', string_split(url, '/')[3], count(*) FROM pages WHERE url IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events WHERE user_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'session_role', conv_id || ':' || role, count(*) FROM conversations GROUP BY 2 HAVING count(*) > 1""",
    "unprocessed_batches": """
SELECT lower(o_orderpriority) AS o_orderpriority, min(o_orderkey) AS o_orderkey,
  coalesce(arg_min(o_orderstatus, o_orderkey) FILTER (WHERE year(o_orderdate) <= 1996), arg_min(o_orderstatus, o_orderkey)) AS o_orderstatus,
  coalesce(arg_min(o_totalprice, o_orderkey) FILTER (WHERE year(o_orderdate) <= 1996), arg_min(o_totalprice, o_orderkey)) AS o_totalprice
FROM orders GROUP BY 1""",
    "row_documents": """
SELECT s_suppkey, concat_ws(chr(10), 's_suppkey: ' || s_suppkey, 's_name: ' || s_name, 's_nationkey: ' || s_nationkey,
                            's_acctbal: ' || CAST(s_acctbal AS VARCHAR)) AS text FROM supplier""",
}
