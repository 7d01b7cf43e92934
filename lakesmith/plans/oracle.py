"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written against the raw driver tables only, using DuckDB's own functions;
shared pieces are SQL text fragments, never Spark code.
"""

from __future__ import annotations

# Fixed values, written out here as well: the SQL must not take them from the code it checks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UNKNOWN_SOURCE = "Không rõ nguồn"
UNKNOWN_TAG = "không xác định"
NEW_CHAT_TITLE = "Cuộc trò chuyện mới"
NO_ANSWER = "Xin lỗi, tôi chưa có thông tin về vấn đề này trong cơ sở dữ liệu hiện tại."
RRF_C = 2
GREETINGS = ("chao", "chao ban", "xin chao", "xin chao ban", "hi", "hello", "hey",
             "chào", "chào bạn", "xin chào", "xin chào bạn")
SOURCE_NAME_OVERRIDES = {"cay thuoc thong dung": "Cây thuốc thông dụng", "duoclieutrungcap": "Dược liệu trung cấp",
                         "so tay thuoc nam": "Sổ tay thuốc Nam"}

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"
PUNCT = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in PUNCTUATION) + "]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(WS)}, ' ', 'g'), ' ')"


def clean(x: str) -> str:
    return f"NULLIF({collapse(x)}, '')"


def non_empty(x: str) -> str:
    return f"({x} IS NOT NULL AND length(trim(CAST({x} AS VARCHAR), ' ')) > 0)"


def norm_text(x: str) -> str:
    return f"regexp_replace({collapse(f'lower({x})')}, {lit(PUNCT)}, '', 'g')"


def dose(x: str) -> tuple[str, str]:
    t = f"replace(lower({x}), ',', '.')"
    num = r"([0-9]+(?:[.][0-9]+)?)"
    rng = num + r"[ \t\n\r\f]*(?:-|–|—|đến|den|to)[ \t\n\r\f]*" + num
    lo = f"regexp_extract({t}, {lit(rng)}, 1)"
    hi = f"regexp_extract({t}, {lit(rng)}, 2)"
    single = f"regexp_extract({t}, {lit(num)}, 1)"
    mult = f"(CASE WHEN regexp_matches({t}, {lit(r'(^|[^\p{L}])kg([^\p{L}]|$)')}) THEN CAST(1000 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END)"
    mn = f"(TRY_CAST(CASE WHEN {lo} <> '' THEN {lo} WHEN {single} <> '' THEN {single} END AS DOUBLE) * {mult})"
    mx = f"(TRY_CAST(CASE WHEN {hi} <> '' THEN {hi} WHEN {lo} <> '' THEN {lo} WHEN {single} <> '' THEN {single} END AS DOUBLE) * {mult})"
    return mn, mx


def sanitize(x: str, fallback: str) -> str:
    s = f"lower(trim(coalesce({x}, ''), ' '))"
    s = f"regexp_replace({s}, '[^0-9a-zA-Z_]+', '_', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    s = f"(CASE WHEN {s} = '' THEN {fallback} ELSE {s} END)"
    return f"(CASE WHEN regexp_matches({s}, '^[0-9]') THEN 'c_' || {s} ELSE {s} END)"


def basename(x: str) -> str:
    return f"list_extract(string_split(regexp_replace({x}, '[?#].*$', ''), '/'), -1)"


def format_source(x: str) -> str:
    stem = f"replace(regexp_replace({basename(x)}, '[.][^.]*$', ''), '_', ' ')"
    cap = f"(upper(substring({stem}, 1, 1)) || lower(substring({stem}, 2)))"
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in SOURCE_NAME_OVERRIDES.items())
    titled = f"(CASE lower({cap}) {cases} ELSE {cap} END)"
    return f"(CASE WHEN {x} IS NULL OR {titled} = '' THEN {lit(UNKNOWN_SOURCE)} ELSE {titled} END)"


# ----------------------------------------------------------------------------- medallion

def _part_silver() -> str:
    mn, mx = dose("p_size")
    cols = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", "_source_file", "p_size_min_g", "p_size_max_g"]
    merged = ",\n  ".join(f"arg_min({c}, cd_bronze_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in cols)
    hash_cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
                 "CAST(p_size_min_g AS VARCHAR)", "CAST(p_size_max_g AS VARCHAR)"]
    return f"""
bronze AS (
  SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
         CAST(p_retailprice AS VARCHAR) AS p_retailprice, 'part.parquet' AS _source_file,
         row_number() OVER (ORDER BY p_partkey) AS cd_bronze_id
  FROM part),
cleaned AS (
  SELECT {clean('p_partkey')} AS p_partkey, lower({clean('p_name')}) AS p_name, {clean('p_brand')} AS p_brand,
         {clean('p_type')} AS p_type, {clean('p_size')} AS p_size, {clean('p_retailprice')} AS p_retailprice,
         _source_file, cd_bronze_id
  FROM bronze),
dosed AS (SELECT *, {mn} AS p_size_min_g, {mx} AS p_size_max_g FROM cleaned WHERE p_name IS NOT NULL),
merged AS (SELECT p_name, min(cd_bronze_id) AS cd_bronze_id,
  {merged}
  FROM dosed GROUP BY p_name),
silver AS (SELECT *, sha256(concat_ws('||', {', '.join(hash_cols)})) AS row_hash,
                  row_number() OVER (ORDER BY cd_bronze_id) AS cd_silver_id FROM merged),
cat0 AS (
  SELECT p_name AS medicine_name, CAST(NULL AS VARCHAR) AS medicine_alt_name, p_type AS bo_phan_dung,
         p_brand AS cong_dung, p_size AS lieu_dung, p_size_min_g AS lieu_dung_min_g, p_size_max_g AS lieu_dung_max_g,
         CAST(NULL AS VARCHAR) AS vi, CAST(NULL AS VARCHAR) AS tinh, CAST(NULL AS VARCHAR) AS quy_kinh,
         CAST(NULL AS VARCHAR) AS tinh_vi_quy_kinh, _source_file AS source_file, row_hash AS silver_row_hash
  FROM silver WHERE {non_empty('p_name')}),
cat AS (
  SELECT *, sha256(concat_ws('||', medicine_name, medicine_alt_name, bo_phan_dung, cong_dung, lieu_dung, vi, tinh, quy_kinh)) AS gold_row_hash,
         row_number() OVER (ORDER BY medicine_name) AS cd_gold_medicine_id
  FROM cat0)"""


def _stats_sql() -> str:
    dims = [("bo_phan_dung", "medicine_count_by_bo_phan_dung"), ("cong_dung", "medicine_count_by_cong_dung"),
            ("source_file", "medicine_count_by_source_file")]
    parts = [f"SELECT {lit(s)} AS statistic_name, {lit(c)} AS dimension_name, {c} AS dimension_value, "
             f"count(*) AS record_count FROM cat WHERE {non_empty(c)} GROUP BY {c}" for c, s in dims]
    parts.append("SELECT 'medicine_total', 'all', 'all', count(*) FROM cat")
    return " UNION ALL ".join(parts)


def _search_sql() -> str:
    cols = "medicine_name, medicine_alt_name, bo_phan_dung, cong_dung, lieu_dung, vi, tinh, quy_kinh, tinh_vi_quy_kinh"
    return (f"SELECT cd_gold_medicine_id, medicine_name, concat_ws(' | ', {cols}) AS search_text, "
            f"source_file, gold_row_hash FROM cat")


def _quality_sql(src: str, name: str, checks: list[str], dose_col: str, dose_min: str) -> str:
    rows = [("silver_total_rows", f"count(*)"),
            ("gold_catalog_rows", f"count(DISTINCT CASE WHEN {non_empty(name)} THEN {name} END)"),
            ("duplicate_medicine_rows_removed",
             f"greatest(count(*) - count(DISTINCT CASE WHEN {non_empty(name)} THEN {name} END), 0)"),
            ("missing_medicine_name_rows", f"count(*) FILTER (WHERE NOT {non_empty(name)})"),
            ("distinct_medicine_names", f"count(DISTINCT CASE WHEN {non_empty(name)} THEN {name} END)")]
    rows += [(f"missing_{c}_rows", f"count(*) FILTER (WHERE NOT {non_empty(c)})") for c in checks]
    rows.append((f"unparsable_{dose_col}_rows", f"count(*) FILTER (WHERE {non_empty(dose_col)} AND {dose_min} IS NULL)"))
    return " UNION ALL ".join(f"SELECT {lit(n)} AS metric_name, CAST({e} AS BIGINT) AS metric_value FROM {src}" for n, e in rows)


def medallion_sql() -> dict[str, str]:
    silver = _part_silver()
    out: dict[str, str] = {}
    out["bronze_ingest"] = """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice, 'part.parquet' AS _source_file,
       row_number() OVER (ORDER BY p_partkey) AS cd_bronze_id
FROM part"""
    out["bronze_job"] = out["bronze_ingest"].replace(
        "'part.parquet' AS _source_file,", "'part.parquet' AS _source_file, 'part.parquet' AS _source_uri,")
    out["silver_job"] = f"WITH {silver}\nSELECT * FROM silver"
    out["silver_buckets"] = out["silver_job"]
    out["gold_catalog"] = f"WITH {silver}\nSELECT * FROM cat"
    out["gold_search"] = f"WITH {silver}\n{_search_sql()}"
    out["gold_stats"] = f"WITH {silver}\n{_stats_sql()}"
    q = _quality_sql("silver", "p_name", ["p_brand", "p_size", "p_type"], "p_size", "p_size_min_g")
    out["gold_job"] = f"""WITH {silver},
search AS ({_search_sql()}),
stats AS ({_stats_sql()}),
qual AS ({q})
SELECT 'medicine_catalog' AS table_name, medicine_name AS key, concat_ws('|', cd_gold_medicine_id, gold_row_hash) AS value FROM cat
UNION ALL SELECT 'medicine_search', medicine_name, search_text FROM search
UNION ALL SELECT 'medicine_stats', concat_ws('|', statistic_name, dimension_name, dimension_value), CAST(record_count AS VARCHAR) FROM stats
UNION ALL SELECT 'quality_report', metric_name, CAST(metric_value AS VARCHAR) FROM qual"""
    pcols = ["p_brand", "p_type", "p_size", "p_retailprice"]
    out["merge_by_name"] = f"""
WITH p AS (SELECT *, lower({clean('p_name')}) AS nm FROM part)
SELECT nm AS p_name, min(p_partkey) AS first_partkey,
  {', '.join(f'arg_min({c}, p_partkey) FILTER (WHERE {c} IS NOT NULL) AS {c}' for c in pcols)}
FROM p WHERE nm IS NOT NULL GROUP BY nm"""
    out["dedup_keyed"] = f"""
SELECT name_key, p_partkey, p_brand, p_type, p_size, p_retailprice FROM (
  SELECT *, lower({clean('p_name')}) AS name_key,
         row_number() OVER (PARTITION BY lower({clean('p_name')}) ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1"""
    out["dedup_rows"] = """
SELECT min(doc_id) AS doc_id, lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY text, lang"""
    mn, _ = dose("text")
    out["quality_report"] = f"""
WITH s AS (SELECT d.*, l.quality, l.toxic, {mn} AS lieu_dung_min_g FROM documents d LEFT JOIN labels l USING (doc_id))
{_quality_sql('s', 'source', ['text', 'lang', 'quality', 'toxic'], 'text', 'lieu_dung_min_g')}"""
    out["quality_states"] = f"""
WITH s AS (SELECT d.*, l.quality, l.toxic, {mn} AS lieu_dung_min_g FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS ({_quality_sql('s', 'text', ['text', 'lang', 'quality', 'toxic'], 'text', 'lieu_dung_min_g')})
SELECT metric_name, CASE WHEN metric_name NOT IN ('gold_catalog_rows', 'duplicate_medicine_rows_removed', 'distinct_medicine_names') THEN metric_value END AS metric_value,
       true AS sound FROM r"""
    out["id_continuation"] = """
WITH b1 AS (SELECT o_orderkey, 1 AS batch, row_number() OVER (ORDER BY o_orderkey) AS cd_id
            FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
     b2 AS (SELECT o_orderkey, 2 AS batch,
                   (SELECT coalesce(max(cd_id), 0) FROM b1) + row_number() OVER (ORDER BY o_orderkey) AS cd_id
            FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
SELECT * FROM b1 UNION ALL SELECT * FROM b2"""
    out["stable_sort"] = "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS pos FROM documents"
    base = sanitize("p_name", "'col_' || CAST(p_partkey + 1 AS VARCHAR)")
    out["unique_headers"] = f"""
WITH b AS (SELECT p_partkey + 1 AS position, {base} AS base FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY position) AS k FROM b)
SELECT position, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS column_name FROM k"""
    out["clean_text"] = f"""
SELECT doc_id, sha256(concat_ws('||', {clean('text')}, {clean('lang')}, {clean('source')})) AS row_hash,
       length({clean('text')}) AS clean_len FROM documents"""
    out["normalize_text"] = f"SELECT doc_id, {norm_text('text')} AS norm_text FROM documents"
    out["first_integer"] = "SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(text, '[0-9]+', 0), '') AS INTEGER) AS stt FROM documents"
    mn, mx = dose("text")
    out["dose_range"] = f"SELECT doc_id, {mn} AS min_g, {mx} AS max_g FROM documents"
    patterns = {"page_lang": '(?i)lang *= *"([^"]*)"', "page_title": "(?i)<title>([^<]*)",
                "page_charset": '(?i)charset *= *"?([^";,>]+)'}
    fields = ", ".join(f"{clean(f'regexp_extract(html, {lit(p)}, 1)')} AS {n}" for n, p in patterns.items())
    out["semantic_fields"] = f"SELECT page_id, {fields} FROM pages"
    out["drop_blank_rows"] = f"""
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE NOT (l.quality IS NULL AND l.toxic IS NULL) AND {non_empty('d.text')}"""
    cust_cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    lines = ", ".join(f"{lit(c + ': ')} || CAST({c} AS VARCHAR)" for c in cust_cols)
    out["csv_documents"] = f"SELECT c_custkey, concat_ws(chr(10), {lines}) AS page_content FROM customer"
    from lakesmith.operators.retrieval import SOURCE_TITLES
    values = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in SOURCE_TITLES.items())
    out["source_titles"] = f"""
WITH p AS (SELECT page_id, url, {basename('url')} AS file_name FROM pages),
dim AS (SELECT * FROM (VALUES {values}) AS t(file_name, title))
SELECT p.page_id, p.file_name, coalesce(dim.title, {format_source('p.url')}) AS display_title
FROM p LEFT JOIN dim ON p.file_name = dim.file_name"""
    return out


# ----------------------------------------------------------------------------- retrieval

TOK = r"[\p{L}\p{N}]+"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOK)})"


def chunks_sql(src: str, keep: str, size: int = 1200, overlap: int = 350) -> str:
    step = size - overlap
    cnt = f"CASE WHEN length(text) <= {size} THEN 1 ELSE 1 + CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT) END"
    return f"""(SELECT {keep}, chunk_no, chunk_no * {step} AS chunk_start,
        substring(text, CAST(chunk_no * {step} + 1 AS BIGINT), {size}) AS chunk_text
  FROM (SELECT {keep}, text, unnest(range(0, {cnt})) AS chunk_no FROM {src}
        WHERE text IS NOT NULL AND length(text) > 0))"""


def postings_sql(src: str, id_col: str = "doc_id", text: str = "text") -> str:
    return f"""(SELECT doc_id, tok, count(*) AS tf, any_value(doc_len) AS doc_len FROM (
    SELECT {id_col} AS doc_id, len(t) AS doc_len, unnest(t) AS tok FROM (SELECT {id_col}, {toks(text)} AS t FROM {src}))
  GROUP BY doc_id, tok)"""


def qterms_sql() -> str:
    return f"(SELECT DISTINCT item_id AS query_id, unnest({toks('text')}) AS tok FROM benchmark)"


def bm25_scores_sql(post: str) -> str:
    w = ("(tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * "
         "(CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * doc_len / CAST(256.0 AS DOUBLE)))")
    return f"(SELECT query_id, doc_id, round(sum({w}), 6) AS score FROM {post} p JOIN {qterms_sql()} q USING (tok) GROUP BY 1, 2)"


def topk_sql(src: str, order: str, k: int = 10, rank: str = "rank", part: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS {rank} FROM {src}) WHERE {rank} <= {k})"


def lexicon_sql(cond: str) -> str:
    return f"(SELECT DISTINCT t AS term FROM (SELECT unnest({toks('text')}) AS t FROM benchmark) WHERE {cond})"


HERB_LEX = lexicon_sql("length(t) >= 8")
DIS_LEX = lexicon_sql("length(t) = 7")


def scored_sql(hits: str, corpus: str, id_col: str) -> str:
    """(query_id, id, rank, score, source, text, entity_score) over hits."""
    nt = norm_text
    return f"""(WITH h AS (SELECT * FROM {hits}),
  c AS (SELECT * FROM {corpus} WHERE {id_col} IN (SELECT {id_col} FROM h)),
  dtok AS (SELECT DISTINCT {id_col}, unnest({toks('text')}) AS t FROM c),
  dh AS (SELECT {id_col}, list_sort(list(t)) AS herb_tags FROM dtok JOIN {HERB_LEX} l ON t = l.term GROUP BY 1),
  dd AS (SELECT {id_col}, array_to_string(list_sort(list(t)), ',') AS dis_tag FROM dtok JOIN {DIS_LEX} l ON t = l.term GROUP BY 1),
  qtok AS (SELECT DISTINCT item_id AS query_id, unnest({toks('text')}) AS t FROM benchmark),
  qh AS (SELECT query_id, t AS e FROM qtok JOIN {HERB_LEX} l ON t = l.term),
  qd AS (SELECT query_id, t AS e FROM qtok JOIN {DIS_LEX} l ON t = l.term),
  pairs AS (SELECT h.*, c.source, c.text, {nt('c.text')} AS cn, coalesce(dh.herb_tags, []) AS herb_tags,
                   coalesce(dd.dis_tag, {lit(UNKNOWN_TAG)}) AS dis_tag
            FROM h JOIN c USING ({id_col}) LEFT JOIN dh USING ({id_col}) LEFT JOIN dd USING ({id_col})),
  hs AS (SELECT p.query_id, p.{id_col}, sum(CASE WHEN {nt('qh.e')} = '' THEN 0 WHEN list_contains(p.herb_tags, {nt('qh.e')}) THEN 3
                 WHEN contains(p.cn, {nt('qh.e')}) THEN 2 ELSE 0 END) AS s FROM pairs p JOIN qh USING (query_id) GROUP BY 1, 2),
  ds AS (SELECT p.query_id, p.{id_col}, sum(CASE WHEN {nt('qd.e')} = '' THEN 0 WHEN contains({nt('p.dis_tag')}, {nt('qd.e')}) THEN 2
                 WHEN contains(p.cn, {nt('qd.e')}) THEN 1 ELSE 0 END) AS s FROM pairs p JOIN qd USING (query_id) GROUP BY 1, 2)
  SELECT p.query_id, p.{id_col}, p.rank, p.source, p.text,
         CAST(coalesce(hs.s, 0) + coalesce(ds.s, 0) AS BIGINT) AS entity_score
  FROM pairs p LEFT JOIN hs USING (query_id, {id_col}) LEFT JOIN ds USING (query_id, {id_col}))"""


def rerank_sql(scored: str, tie: str) -> str:
    return f"""(WITH s AS (SELECT *, max(entity_score) OVER (PARTITION BY query_id) AS mx,
                     count(*) OVER (PARTITION BY query_id) AS n FROM {scored}),
  f AS (SELECT *, CAST(1.0 AS DOUBLE) - CAST(rank - 1 AS DOUBLE) / CAST(greatest(n - 1, 1) AS DOUBLE) AS vr FROM s),
  g AS (SELECT *, round(CAST(0.55 AS DOUBLE) * (CAST(entity_score AS DOUBLE) /
                  CAST(CASE WHEN mx = 0 THEN 1 ELSE mx END AS DOUBLE)) + CAST(0.45 AS DOUBLE) * vr, 9) AS final_score FROM f)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, entity_score DESC, vr DESC, {tie}) AS new_rank FROM g)"""


def title_sql(x: str) -> str:
    from lakesmith.operators.retrieval import SOURCE_TITLES
    b = basename(x)
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in SOURCE_TITLES.items())
    return f"(CASE {b} {cases} ELSE {b} END)"


def context_sql(ranked: str) -> str:
    body = f"'Nội dung: ' || text || chr(10) || 'Nguồn trích dẫn: ' || {title_sql('source')} || chr(10) || '---'"
    return (f"SELECT query_id AS item_id, string_agg({body}, chr(10) || chr(10) ORDER BY new_rank) AS context, "
            f"count(*) AS n_docs FROM {ranked} GROUP BY query_id")


def read_share_sql(post: str) -> str:
    """Blocks of 8 documents by (most frequent token, length, id); the 16 blocks of the highest limits give the
    threshold; common tokens whose largest weights stay below it together are opened last."""
    weight = ("(tf * CAST(2.2 AS DOUBLE)) / (tf + CAST(1.2 AS DOUBLE) * "
              "(CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * doc_len / CAST(256.0 AS DOUBLE)))")
    return f"""
WITH p AS (SELECT * FROM {post}),
pl AS (SELECT doc_id, (row_number() OVER (ORDER BY encode(top), n, doc_id) - 1) // 8 AS block
       FROM (SELECT doc_id, max(doc_len) AS n, arg_max(tok, (tf, encode(tok))) AS top FROM p GROUP BY doc_id)),
w AS (SELECT doc_id, tok, block, {weight} AS weight FROM p JOIN pl USING (doc_id)),
b AS (SELECT block, tok, max(weight) AS bound, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT DISTINCT query_id, tok FROM {qterms_sql()}),
l AS (SELECT query_id, block, round(sum(bound), 9) AS lim FROM b JOIN t USING (tok) GROUP BY ALL),
s AS (SELECT query_id, block FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lim DESC, block) AS r FROM l) WHERE r <= 16),
d AS (SELECT query_id, doc_id, round(sum(weight), 6) AS score FROM w JOIN t USING (tok) JOIN s USING (query_id, block) GROUP BY ALL),
k AS (SELECT query_id, min(score) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM d)
      WHERE r <= 10 GROUP BY query_id HAVING count(*) = 10),
o AS (SELECT l.query_id, l.block, threshold, s.block IS NOT NULL AS seed, threshold IS NULL OR lim + 0.000001 >= threshold AS reaches
      FROM l LEFT JOIN s USING (query_id, block) LEFT JOIN k USING (query_id)),
f AS (SELECT tok, max(bound) AS top, sum(n) AS df FROM b GROUP BY tok),
r AS (SELECT query_id, tok, threshold IS NULL OR round(sum(top) OVER (PARTITION BY query_id ORDER BY df DESC, encode(tok) ROWS UNBOUNDED PRECEDING), 9)
        + 0.000001 >= threshold AS rare FROM t JOIN f USING (tok) LEFT JOIN k USING (query_id)),
x AS (SELECT o.query_id, o.block, any_value(threshold) AS threshold, round(coalesce(sum(bound) FILTER (NOT rare), 0), 9) AS still
      FROM o JOIN r USING (query_id) JOIN b USING (block, tok) WHERE reaches AND NOT seed GROUP BY ALL),
a AS (SELECT DISTINCT query_id, block FROM (SELECT x.query_id, x.block, w.doc_id, any_value(threshold) AS threshold, round(sum(weight) + any_value(still), 9) AS most
      FROM x JOIN r ON r.query_id = x.query_id AND rare JOIN w ON w.block = x.block AND w.tok = r.tok GROUP BY ALL)
      WHERE threshold IS NULL OR most + 0.000001 >= threshold),
q AS (SELECT o.query_id, sum(n) AS postings, sum(n) FILTER (seed OR (reaches AND (rare OR a.block IS NOT NULL))) AS postings_read
      FROM o JOIN r USING (query_id) JOIN b USING (block, tok) LEFT JOIN a ON a.query_id = o.query_id AND a.block = o.block GROUP BY o.query_id),
z AS (SELECT query_id, count(*) AS blocks, count(*) FILTER (seed OR reaches) AS blocks_read FROM o GROUP BY query_id)
SELECT query_id AS item_id, CAST(postings AS BIGINT) AS postings, CAST(coalesce(postings_read, 0) AS BIGINT) AS postings_read, blocks, blocks_read
FROM q JOIN z USING (query_id)"""


def retrieval_sql() -> dict[str, str]:
    from lakesmith.plans.retrieval_queries import ACCENTED, UNACCENTED
    out: dict[str, str] = {}
    post = postings_sql("documents")
    scores = bm25_scores_sql(post)
    hits = topk_sql(scores, "score DESC, doc_id")
    meta_sql = lambda p: f"""(WITH lex AS {lexicon_sql('length(t) >= 7')},
  qe AS (SELECT query_id, {norm_text('tok')} AS e FROM {qterms_sql()} q WHERE tok IN (SELECT term FROM lex)),
  hit AS (SELECT DISTINCT qe.query_id, l.term AS tag FROM qe JOIN lex l ON contains(l.term, qe.e) WHERE qe.e <> '')
  SELECT DISTINCT hit.query_id, p.doc_id FROM {p} p JOIN hit ON p.tok = hit.tag)"""
    meta = meta_sql(post)
    out["chunk_fixed"] = f"SELECT * FROM {chunks_sql('documents', 'doc_id')}"
    out["postings"] = f"SELECT * FROM {post}"
    out["chunk_semantic"] = """
WITH p AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings),
d AS (SELECT label, vec_id, round(1.0 - list_cosine_similarity(CAST(prev AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS distance FROM p),
t AS (SELECT label, quantile_cont(distance, 0.95) AS thr FROM d GROUP BY label),
f AS (SELECT d.*, CASE WHEN distance > thr THEN 1 ELSE 0 END AS b FROM d JOIN t USING (label))
SELECT label, vec_id, CAST(sum(b) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk_no, distance FROM f"""
    out["bm25_topk"] = f"SELECT query_id AS item_id, doc_id, score, rank FROM {hits}"
    probes = "(SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)"
    cos = f"(SELECT p.query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.q AS DOUBLE[])), 6) AS score FROM embeddings e, {probes} p)"
    euc = f"(SELECT p.query_id, e.vec_id, round(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(p.q AS DOUBLE[])), 6) AS score FROM embeddings e, {probes} p)"
    cos_top = topk_sql(cos, "score DESC, vec_id")
    euc_top = topk_sql(euc, "score ASC, vec_id")
    out["dense_topk"] = f"SELECT query_id AS label, vec_id, score, rank FROM {cos_top}"
    fuse = lambda x, y, key: f"""a AS (SELECT query_id, {key}, CAST(1.0 AS DOUBLE) / ({RRF_C} + rank - 1) AS s FROM {x}),
     b AS (SELECT query_id, {key}, CAST(1.0 AS DOUBLE) / ({RRF_C} + rank - 1) AS s FROM {y}),
     f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.{key}, b.{key}) AS {key},
                  round(CAST(0.0 AS DOUBLE) + coalesce(a.s, 0.0) + coalesce(b.s, 0.0), 9) AS rrf
           FROM a FULL OUTER JOIN b ON a.query_id = b.query_id AND a.{key} = b.{key})"""
    out["bm25_pruned_topk"] = out["bm25_topk"]
    out["bm25_read_share"] = read_share_sql(post)
    all_cos = ("(SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), "
               "CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)")
    out["dense_topk_all"] = f"SELECT query_id, vec_id, score, rank FROM {topk_sql(all_cos, 'score DESC, vec_id')}"
    out["rrf_metrics"] = (f"WITH {fuse(cos_top, euc_top, 'vec_id')} SELECT query_id AS label, vec_id, rrf, fused_rank "
                          f"FROM {topk_sql('f', 'rrf DESC, vec_id', rank='fused_rank')}")
    doc_cos = ("(SELECT b.item_id AS query_id, d.doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), "
               "CAST(q.embedding AS DOUBLE[])), 6) AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, "
               "benchmark b JOIN embeddings q ON q.vec_id = b.item_id)")
    out["hybrid_rrf"] = (f"WITH {fuse(hits, topk_sql(doc_cos, 'score DESC, doc_id'), 'doc_id')} "
                         f"SELECT query_id AS item_id, doc_id, rrf, fused_rank "
                         f"FROM {topk_sql('f', 'rrf DESC, doc_id', rank='fused_rank')}")
    out["metadata_filter"] = f"SELECT query_id AS item_id, doc_id FROM {meta}"
    fallback_sql = lambda sc, m: f"""(WITH sc AS {sc}, m AS {m},
fil AS {topk_sql('(SELECT sc.* FROM sc JOIN m USING (query_id, doc_id))', 'score DESC, doc_id')},
unf AS {topk_sql('(SELECT * FROM sc WHERE query_id NOT IN (SELECT query_id FROM fil))', 'score DESC, doc_id')}
SELECT query_id, doc_id, score, rank, true AS filtered FROM fil
UNION ALL SELECT query_id, doc_id, score, rank, false AS filtered FROM unf)"""
    fallback = fallback_sql(scores, meta)
    out["filter_fallback"] = f"SELECT query_id AS item_id, doc_id, score, rank, filtered FROM {fallback}"
    out["entity_tags"] = f"""
WITH dt AS (SELECT DISTINCT doc_id, unnest({toks('text')}) AS t FROM documents),
tg AS (SELECT doc_id, list_sort(list(t)) AS tl FROM dt JOIN {HERB_LEX} l ON t = l.term GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN tl IS NULL THEN {lit(UNKNOWN_TAG)} ELSE array_to_string(tl, ',') END AS tags,
       CAST(coalesce(len(tl), 0) AS BIGINT) AS n_tags
FROM documents d LEFT JOIN tg USING (doc_id)"""
    out["phrase_tags"] = f"""
WITH q AS (SELECT {toks('text')} AS t FROM benchmark),
g AS (SELECT t, unnest(range(1, len(t) - 1)) - 1 AS i FROM q WHERE len(t) >= 3),
lex AS (SELECT DISTINCT unnest(CASE WHEN i % 3 = 0 THEN [t[i+1:i+2]] WHEN i % 3 = 1 THEN [t[i+1:i+1]] ELSE [t[i+1:i+2], t[i+1:i+3]] END) AS w FROM g WHERE i % 4 <> 3),
d AS (SELECT doc_id, {toks("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, n, unnest(list_transform(range(0, len(t) - n + 1), lambda i: {{'pos': i, 'term': array_to_string(t[i + 1:i + n], ' ')}})) AS x
      FROM d, (SELECT unnest([1, 2, 3]) AS n)),
h AS (SELECT doc_id, x.pos AS pos, n, x.term AS term FROM p JOIN (SELECT array_to_string(w, ' ') AS term FROM lex) l ON l.term = x.term),
f AS (SELECT doc_id, list_reduce(list_prepend({{'pos': -1, 'n': 0, 'fin': 0, 'tags': CAST([] AS VARCHAR[]), 'term': ''}},
        list({{'pos': pos, 'n': n, 'fin': pos + n, 'tags': CAST([] AS VARCHAR[]), 'term': term}} ORDER BY pos, n DESC)),
        lambda a, x: CASE WHEN x.pos >= a.fin THEN {{'pos': x.pos, 'n': x.n, 'fin': x.fin, 'tags': list_append(a.tags, x.term), 'term': ''}} ELSE a END).tags AS tags
      FROM h GROUP BY doc_id)
SELECT documents.doc_id, coalesce(array_to_string(list_sort(list_distinct(tags)), ','), {lit(UNKNOWN_TAG)}) AS tags,
       CAST(coalesce(len(tags), 0) AS BIGINT) AS n_matches FROM documents LEFT JOIN f USING (doc_id)"""
    scored = scored_sql(hits, "documents", "doc_id")
    out["entity_score"] = f"SELECT query_id AS item_id, doc_id, entity_score FROM {scored}"
    ranked = rerank_sql(scored, "source, doc_id")
    out["weighted_rerank"] = f"SELECT query_id AS item_id, doc_id, new_rank, final_score FROM {ranked}"
    out["context_assembly"] = context_sql(ranked)
    snippet = "substring(text, 1, 200) || '...'"
    cites_sql = lambda r: (f"SELECT query_id AS item_id, CAST(to_json(list({{'content_snippet': {snippet}, "
                           f"'metadata': {{'source': {title_sql('source')}}}}} ORDER BY new_rank)) AS VARCHAR) AS citations_json "
                           f"FROM {r} GROUP BY query_id")
    out["citations_json"] = cites_sql(ranked)
    gate_sql = lambda src: f"""(WITH n AS (SELECT query_id, count(*) AS c FROM {src} GROUP BY query_id)
SELECT b.item_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_docs,
       CASE WHEN coalesce(n.c, 0) = 0 THEN {lit(NO_ANSWER)} ELSE 'answer' END AS gate
FROM benchmark b LEFT JOIN n ON n.query_id = b.item_id)"""
    out["answer_gate"] = f"SELECT * FROM {gate_sql(fallback)}"
    out["hashed_vectors"] = f"""
WITH t AS (SELECT doc_id, unnest({toks('text')}) AS tok FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substring(md5(tok), 1, 8)) AS BIGINT) % 262144 AS slot, count(*) AS tf FROM t GROUP BY 1, 2)
SELECT doc_id, slot, round(tf / sqrt(CAST(sum(tf * tf) OVER (PARTITION BY doc_id) AS DOUBLE)), 9) AS weight FROM c"""
    halves = "(SELECT max(doc_id) / 2 FROM documents)"
    ck = lambda b: (f"(SELECT doc_id, chunk_no, sha256(concat_ws(chr(31), source, CAST(chunk_start AS VARCHAR), chunk_text)) AS chunk_id "
                    f"FROM {chunks_sql(f'(SELECT * FROM documents WHERE doc_id {b} {halves})', 'doc_id, source')})")
    first = lambda src, key, order: (f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn "
                                     f"FROM {src}) WHERE rn = 1)")
    out["index_upsert"] = f"""
WITH e AS {first(ck('<='), 'chunk_id', 'doc_id, chunk_no')},
n AS {first(ck('>'), 'chunk_id', 'doc_id, chunk_no')}
SELECT doc_id, chunk_no, chunk_id, 1 AS batch FROM e
UNION ALL SELECT doc_id, chunk_no, chunk_id, 2 AS batch FROM n WHERE chunk_id NOT IN (SELECT chunk_id FROM e)"""
    et = lambda b: f"(SELECT doc_id, md5(text) AS etag FROM documents WHERE doc_id {b} {halves})"
    out["file_etag_dedup"] = f"""
WITH r1 AS {first(et('<='), 'etag', 'doc_id')}, r2 AS {first(et('>'), 'etag', 'doc_id')}
SELECT doc_id, etag, 1 AS batch FROM r1
UNION ALL SELECT doc_id, etag, 2 AS batch FROM r2 WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.etag = r2.etag)"""
    out["load_counts"] = "SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars FROM documents GROUP BY source"
    out["unique_violations"] = "SELECT md5(text) AS etag, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1"
    out["changed_flag"] = (f"SELECT doc_id, {norm_text('text')} <> {norm_text(f'translate(text, {lit(ACCENTED)}, {lit(UNACCENTED)})')} "
                           f"AS changed FROM documents")
    chunk_rel = (f"(SELECT CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_no AS VARCHAR) AS chunk_uid, source, chunk_text AS text "
                 f"FROM {chunks_sql('documents', 'doc_id, source')})")
    c_post = postings_sql(chunk_rel, "chunk_uid")
    c_hits = f"(SELECT query_id, doc_id AS chunk_uid, score, rank FROM {fallback_sql(bm25_scores_sql(c_post), meta_sql(c_post))})"
    c_ranked = rerank_sql(scored_sql(c_hits, chunk_rel, "chunk_uid"), "source, chunk_uid")
    out["retrieve_job"] = f"""
SELECT g.item_id, g.n_docs, g.gate, x.context, c.citations_json FROM {gate_sql(c_hits)} g
LEFT JOIN ({context_sql(c_ranked)}) x USING (item_id) LEFT JOIN ({cites_sql(c_ranked)}) c USING (item_id)"""
    chunk_cos = (f"(SELECT b.item_id AS query_id, c.chunk_uid, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score "
                 f"FROM {chunk_rel} c JOIN embeddings e ON e.vec_id = CAST(split_part(c.chunk_uid, ':', 1) AS BIGINT), benchmark b JOIN embeddings q ON q.vec_id = b.item_id)")
    out["retrieve_hybrid"] = f"""
WITH cp AS (SELECT * FROM {c_post}), sc AS (SELECT query_id, doc_id AS chunk_uid, score FROM {bm25_scores_sql('cp')}),
m AS (SELECT query_id, doc_id AS chunk_uid FROM {meta_sql('cp')}), dn AS (SELECT * FROM {chunk_cos} WHERE chunk_uid IN (SELECT doc_id FROM cp)),
l AS (SELECT query_id, chunk_uid, rank, true AS filtered FROM {topk_sql('(SELECT sc.* FROM sc JOIN m USING (query_id, chunk_uid))', 'score DESC, chunk_uid')}
  UNION ALL SELECT query_id, chunk_uid, rank, true FROM {topk_sql('(SELECT dn.* FROM dn JOIN m USING (query_id, chunk_uid))', 'score DESC, chunk_uid')}
  UNION ALL SELECT query_id, chunk_uid, rank, false FROM {topk_sql('sc', 'score DESC, chunk_uid')}
  UNION ALL SELECT query_id, chunk_uid, rank, false FROM {topk_sql('dn', 'score DESC, chunk_uid')}),
f AS (SELECT query_id, filtered, chunk_uid, round(sum(CAST(1.0 AS DOUBLE) / ({RRF_C} + rank - 1)), 9) AS rrf FROM l GROUP BY ALL),
h AS (SELECT query_id, chunk_uid, rrf, rank, filtered FROM {topk_sql('f', 'rrf DESC, chunk_uid', part='query_id, filtered')}
      WHERE filtered OR query_id NOT IN (SELECT query_id FROM f WHERE filtered)),
rk AS (SELECT * FROM {rerank_sql(scored_sql('h', chunk_rel, 'chunk_uid'), 'source, chunk_uid')})
SELECT g.item_id, g.n_docs, g.gate, x.context, c.citations_json FROM {gate_sql('h')} g
LEFT JOIN ({context_sql('rk')}) x USING (item_id) LEFT JOIN ({cites_sql('rk')}) c USING (item_id)"""
    return out


# ----------------------------------------------------------------------------- conversations

def short_title_sql(x: str, n: int = 48) -> str:
    s = collapse(x)
    words = f"regexp_extract({s} || ' ', {lit('(?s)^(.{1,' + str(n) + '}) ')}, 1)"
    return (f"(CASE WHEN length({s}) <= {n} THEN {s} WHEN {words} <> '' THEN {words} "
            f"ELSE rtrim(substring({s}, 1, {n}), ' ') END)")


def conversation_sql() -> dict[str, str]:
    from lakesmith.functions.text import DISEASE_ENTITY_PREFIXES
    out: dict[str, str] = {}
    pairs = """(SELECT conv_id, turn, text AS user_query, nt AS ai_response FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""
    keys = """(SELECT conv_id, role, role || '_' || CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id) AS VARCHAR) AS session_key
  FROM (SELECT DISTINCT conv_id, role FROM conversations))"""
    out["qa_pairs"] = f"SELECT * FROM {pairs}"
    out["history_last_n"] = f"""
SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) - rn + 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM {pairs}) WHERE rn <= 5"""
    out["messages_unpivot"] = (f"SELECT conv_id, turn, 0 AS msg_no, 'user' AS role, user_query AS text FROM {pairs} "
                               f"UNION ALL SELECT conv_id, turn, 1, 'assistant', ai_response FROM {pairs}")
    out["session_backfill"] = f"SELECT * FROM {keys}"
    out["session_counters"] = "SELECT user_id, count(*) AS last_session_number FROM events GROUP BY user_id"
    out["session_list"] = f"""
WITH s AS (SELECT DISTINCT conv_id, role FROM conversations)
SELECT s.role, s.conv_id, coalesce(k.session_key, CAST(s.conv_id AS VARCHAR)) AS display_key,
       row_number() OVER (PARTITION BY s.role ORDER BY s.conv_id DESC) AS list_pos
FROM s LEFT JOIN {keys} k ON k.conv_id = s.conv_id AND k.role = s.role"""
    out["session_delete"] = """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (
  SELECT conv_id FROM conversations WHERE role = 'system'
  INTERSECT SELECT conv_id FROM conversations WHERE role = 'user')"""
    out["key_rewrite"] = f"""
SELECT p.conv_id, p.turn, coalesce(k.session_key, CAST(p.conv_id AS VARCHAR)) AS session_id
FROM {pairs} p LEFT JOIN (SELECT * FROM {keys} WHERE role = 'user') k ON k.conv_id = p.conv_id"""
    out["short_title"] = f"SELECT conv_id, turn, {short_title_sql('text')} AS title FROM conversations"
    out["entity_carryover"] = f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
dt AS (SELECT DISTINCT conv_id, turn, unnest({toks('text')}) AS t FROM u),
tg AS (SELECT conv_id, turn, array_to_string(list_sort(list(t)), ',') AS tags FROM dt JOIN {HERB_LEX} l ON t = l.term GROUP BY 1, 2),
e AS (SELECT u.conv_id, u.turn, coalesce(tg.tags, '') AS entities FROM u LEFT JOIN tg USING (conv_id, turn))
SELECT conv_id, turn, CASE WHEN entities = '' THEN coalesce(lag(entities) OVER (PARTITION BY conv_id ORDER BY turn), '')
                           ELSE entities END AS entities FROM e"""
    out["cache_lookup"] = f"""
SELECT conv_id, turn, query_hash, row_number() OVER (PARTITION BY query_hash ORDER BY conv_id, turn) > 1 AS hit
FROM (SELECT conv_id, turn, sha256({norm_text('text')}) AS query_hash FROM conversations WHERE role = 'user')"""
    out["feedback_stats"] = """
SELECT d.source, count(*) AS n_feedback, CAST(sum(r.rating) AS BIGINT) AS sum_rating, round(avg(r.rating), 6) AS avg_rating
FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN -1 END AS rating FROM labels) r
JOIN documents d USING (doc_id) WHERE r.rating IN (-1, 1) GROUP BY d.source"""
    first = lambda role: (f"(SELECT conv_id, {short_title_sql('arg_min(text, turn)')} AS title FROM conversations "
                          f"WHERE role = {lit(role)} GROUP BY conv_id)")
    out["title_from_first_turn"] = f"SELECT * FROM {first('user')}"
    out["title_update"] = f"""
WITH s AS (SELECT c.conv_id, coalesce(x.title, {lit(NEW_CHAT_TITLE)}) AS title
           FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN {first('system')} x USING (conv_id))
SELECT s.conv_id, CASE WHEN s.title = {lit(NEW_CHAT_TITLE)} THEN coalesce(u.title, s.title) ELSE s.title END AS title
FROM s LEFT JOIN {first('user')} u USING (conv_id)"""
    allowed = "'view', 'click', 'signup', 'purchase'"
    out["domain_violations"] = f"""
SELECT 'labels' AS table_name, doc_id AS row_key, 'quality' AS column_name, CAST(quality AS VARCHAR) AS value FROM labels WHERE quality IS NULL OR quality NOT IN (0, 1)
UNION ALL SELECT 'labels', doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels WHERE toxic IS NULL OR toxic NOT IN (0, 1)
UNION ALL SELECT 'events', event_id, 'event_type', event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ({allowed})"""
    out["feedback_orphans"] = "SELECT * FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)"
    greet = ", ".join(lit(g) for g in GREETINGS)
    out["greeting_route"] = (f"SELECT conv_id, turn, CASE WHEN {norm_text('text')} IN ({greet}) THEN 'greeting' "
                             f"ELSE 'retrieval' END AS route FROM conversations")
    strip = lambda x: f"regexp_replace({x}, {lit('^(' + PUNCT + '| )+|(' + PUNCT + '| )+$')}, '', 'g')"
    prefixes = "^(?:" + "|".join(DISEASE_ENTITY_PREFIXES) + ")*"
    ent = strip(f"regexp_replace({strip(collapse('lower(text)'))}, {lit(prefixes)}, '')")
    out["entity_prefix_clean"] = f"SELECT conv_id, turn, {ent} AS entity FROM conversations WHERE role = 'user'"
    out["session_messages"] = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations"
    out["conversation_job"] = """
SELECT role AS username, count(DISTINCT conv_id) AS n_sessions, count(DISTINCT conv_id) AS last_session_number, count(*) AS n_turns
FROM conversations GROUP BY role"""
    return out


# ----------------------------------------------------------------------------- ingestion

def file_index_sql() -> str:
    """Two drops of files of twenty documents; the second repeats the first five files and all CSV files."""
    mid = "(SELECT max(doc_id) / 2 FROM documents)"
    texts = lambda n, cond: (f"SELECT {n} AS nth, '.txt-' || (doc_id // 20) AS name, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content "  # noqa: E731
                             f"FROM documents WHERE {cond} GROUP BY doc_id // 20")
    sheets = lambda n: (f"SELECT {n}, '.csv-' || (s_suppkey % 4), 'Supp Key,Name,Nation Key' || chr(10) || "  # noqa: E731
                        "string_agg(s_suppkey || ',' || s_name || ',' || s_nationkey || chr(10), '' ORDER BY s_suppkey) FROM supplier GROUP BY s_suppkey % 4")
    chunk = chunks_sql("docs", "source, doc_no")
    return f"""
WITH raw AS ({texts(1, f'doc_id <= {mid}')} UNION ALL {texts(2, f'doc_id > {mid} OR doc_id < 100')} UNION ALL {sheets(1)} UNION ALL {sheets(2)}),
f AS (SELECT *, md5(content) AS etag, CASE WHEN row_number() OVER (PARTITION BY content ORDER BY nth, name) = 1 THEN 'loaded' ELSE 'repeated' END AS status FROM raw),
docs AS (SELECT name AS source, 0 AS doc_no, content AS text FROM f WHERE status = 'loaded' AND name LIKE '.txt%'
  UNION ALL SELECT '.csv-' || (s_suppkey % 4), row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) - 1,
    'supp_key: ' || s_suppkey || chr(10) || 'name: ' || s_name || chr(10) || 'nation_key: ' || s_nationkey FROM supplier),
cut AS (SELECT *, sha256(concat_ws(chr(31), source, CAST(chunk_start AS VARCHAR), chunk_text)) AS chunk_id FROM {chunk}),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY source, doc_no, chunk_no) AS rn FROM cut) WHERE rn = 1),
ct AS (SELECT DISTINCT chunk_id, unnest({toks('chunk_text')}) AS t FROM c),
tg AS (SELECT chunk_id, array_to_string(list_sort(list(t)), ',') AS tags FROM ct JOIN {HERB_LEX} l ON t = l.term GROUP BY chunk_id),
counted AS (SELECT (SELECT count(*) FROM f WHERE status = 'loaded') AS loaded, (SELECT count(*) FROM f WHERE status = 'repeated') AS repeated, 2 AS rejected,
  (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM cut) AS chunks_cut, (SELECT count(*) FROM c) AS chunks_added)
SELECT 'file' AS kind, name, status || ':' || etag AS value, octet_length(encode(content)) AS n FROM f
UNION ALL SELECT 'file', '.json-', 'rejected:unsupported suffix', NULL FROM range(2)
UNION ALL SELECT 'chunk', source || ':' || doc_no || ':' || chunk_no, chunk_id || ':' || coalesce(tags, {lit(UNKNOWN_TAG)}), length(chunk_text) FROM c LEFT JOIN tg USING (chunk_id)
UNION ALL SELECT 'counter', name, NULL, n FROM (UNPIVOT counted ON loaded, repeated, rejected, documents, chunks_cut, chunks_added INTO NAME name VALUE n)"""


def ingest_sql() -> dict[str, str]:
    out = medallion_sql()
    mid = "(SELECT max(p_partkey) / 2 FROM part)"
    return {
        "csv_bronze": """
SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name, p_brand AS brand, p_type AS type,
       CAST(p_size AS VARCHAR) AS size, CAST(p_retailprice AS VARCHAR) AS retail_price,
       row_number() OVER (ORDER BY p_partkey) AS cd_bronze_id FROM part""",
        "bronze_incremental": f"""
SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name, row_number() OVER (ORDER BY p_partkey) AS cd_bronze_id,
       CASE WHEN p_partkey <= {mid} THEN '0' ELSE '1' END AS _batch_id FROM part""",
        "silver_incremental": out["merge_by_name"],
        "file_index": file_index_sql(),
        "index_incremental": retrieval_sql()["index_upsert"],
        "schema_evolution": f"""
SELECT p_partkey, p_name, p_brand, CAST(NULL AS VARCHAR) AS p_type, CAST(NULL AS INTEGER) AS p_size, 0 AS _batch_id
FROM part WHERE p_partkey <= {mid}
UNION ALL SELECT p_partkey, p_name, NULL, p_type, p_size, 1 FROM part WHERE p_partkey > {mid}""",
        "table_roundtrip": "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS revenue, "
                           "(SELECT count(*) FROM part) AS rows_written, true AS listed FROM part GROUP BY p_brand",
        "text_documents": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    }
