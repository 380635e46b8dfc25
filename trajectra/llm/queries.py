"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html_text, line_dedup, near_dedup, packing, phrase_queries, secrets, toxicity, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: The rules of op10, by host and path.
URL_RULES = (
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
)
#: What the method blocks where no rule fits.
URL_GLOBS = (
    url_filter.Glob("block", "ads.**"),
    url_filter.Glob("block", "*.ads.**"),
    url_filter.Glob("block", "**/wp-login**"),
    url_filter.Glob("block", "**.exe"),
)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES, URL_GLOBS).drop("matched_glob")


OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), host AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail FROM cut
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path FROM host
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(fits.verdict, CASE WHEN starts_with(host, 'ads.') OR contains(host, '.ads.')
    OR contains(host || path, '/wp-login') OR ends_with(host || path, '.exe') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(_read(spark, sf_dir, "pages"))
    return index.selectExpr("record_id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "history_rank")


OP6_SQL = """
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload FROM pages
), hashed AS (
  SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS sha FROM raw
), named AS (
  SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(8), lambda i:
    array_to_string(list_transform(range(4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (CAST('0x' || substr(sha, CAST(5 * i + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT)) % 32 AS INT), 1)), '')), '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM named
), keyed AS (
  SELECT *, regexp_replace(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '#.*$', '') AS rest FROM firsts
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\\.', '') AS host, substr(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) AS tail FROM keyed
)
SELECT page_id, payload_bytes, payload_digest,
  row_number() OVER (PARTITION BY url_key ORDER BY captured_at, page_id NULLS FIRST) - 1 AS history_rank, record_type, refers_to, url_key, captured_at
FROM (SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  CASE WHEN host = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END END AS url_key,
  1700000000 + (coalesce(page_id, 0) % 1073741824 + 1073741824) % 1073741824 AS captured_at
FROM parts)
"""

def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_read(spark, sf_dir, "documents"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_UPTO = "coalesce(list_sum(list_transform(p[1:{0}], lambda q: length(q))), 0)"
_RUNS = "list_transform(list_filter(range(2, len(p) + 1), lambda i: i % 2 = 0), lambda i: {{'s': " + _UPTO.format("i - 1") + ", 'r': {rank}, 'e': " + _UPTO.format("i") + "}})"


def _marked(pattern: str, groups: str) -> str:
    return f"string_split(regexp_replace(t, {_text(pattern)}, {groups}, 'g'), chr(1))"


_WHOLE = r"chr(1) || '\0' || chr(1)"
_ALLOWED = " OR ".join(f"regexp_matches(x, {_text(p)})" for p in secrets.ALLOWED)
#: A run of the wider class that is all hex is the hex class's run between other characters.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1), chr(3)) AS t FROM documents),
a AS (SELECT doc_id, t, {_marked(secrets.ASSIGN, r"chr(1) || '\1' || chr(1) || '\2' || chr(1)")} AS p FROM d),
a2 AS (SELECT doc_id, t, list_transform(list_filter(range(3, len(p) + 1), lambda i: i % 3 = 0 AND length(p[i]) >= 6), lambda i: {{'s': {_UPTO.format("i - 2")}, 'r': 0, 'e': {_UPTO.format("i")}}}) AS sa FROM a),
b AS (SELECT doc_id, t, sa, {_marked(secrets.ACCESS, _WHOLE)} AS p FROM a2),
b2 AS (SELECT doc_id, t, sa, {_RUNS.format(rank=1)} AS sb FROM b),
c AS (SELECT doc_id, t, sa, sb, {_marked(secrets.HEX, _WHOLE)} AS p FROM b2),
c2 AS (SELECT doc_id, t, sa, sb, {_RUNS.format(rank=2)} AS sc FROM c),
e AS (SELECT doc_id, sa, sb, sc, list_sort(list_concat(sa, sb, sc)) AS base, {_marked(secrets.CLASSES[1][1], _WHOLE)} AS p FROM c2),
e2 AS (SELECT doc_id, unnest(list_filter(range(2, len(p) + 1), lambda i: i % 2 = 0)) AS i, p, base FROM e),
e3 AS (SELECT doc_id, base, p[i] AS x, {_UPTO.format("i - 1")} AS s, {_UPTO.format("i")} AS e FROM e2),
e4 AS (SELECT doc_id, s, e, x, regexp_full_match(x, '[0-9A-Fa-f]+') AS hex FROM e3 WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND NOT ({_ALLOWED}) AND len(list_filter(base, lambda y: y.s < e AND s < y.e)) = 0),
e5 AS (SELECT doc_id, s, e, hex, list_max(list_transform(range(1, length(x) - 18), lambda i: list_sum(list_transform(list_distinct(string_split(substr(x, i, 20), '')), lambda y:
  -(20 - length(replace(substr(x, i, 20), y, ''))) / 20 * log2((20 - length(replace(substr(x, i, 20), y, ''))) / 20))))) AS h FROM e4),
e6 AS (SELECT doc_id, list({{'s': s, 'r': CASE WHEN hex THEN 3 ELSE 4 END, 'e': e}}) AS se FROM e5 WHERE h >= CASE WHEN hex THEN {secrets.CLASSES[0][3]} ELSE {secrets.CLASSES[1][3]} END GROUP BY doc_id),
f AS (SELECT e.*, coalesce(se, []) AS se FROM e LEFT JOIN e6 USING (doc_id))
SELECT doc_id, CAST(len(sa) AS BIGINT) AS n_assign, CAST(len(sb) AS BIGINT) AS n_access, CAST(len(sc) AS BIGINT) AS n_hex, CAST(len(se) AS BIGINT) AS n_entropy,
  sha256(array_to_string(list_transform(base, lambda y: {list(secrets.KINDS)}[y.r + 1] || ':' || y.s || ':' || y.e), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort(list_concat(base, se)), lambda y: {list(secrets.KINDS)}[y.r + 1] || ':' || y.s || ':' || y.e), ',') AS spans
FROM f
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), item_split AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_split WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, item_id, grams.n AS n, i FROM grams JOIN windows USING (s) WHERE grams.n = windows.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP8_LINES = f"""
split AS (
  SELECT row_number() OVER () AS place, doc_id, coalesce(source, '') AS host, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT host, count(*) AS host_pages, greatest(2, least({line_dedup.MIN_PAGES}, count(*))) AS least_pages FROM split GROUP BY host
), each AS (
  SELECT place, host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> ''))) AS line FROM split
), frequent AS (
  SELECT host, line, host_pages, least_pages FROM each JOIN totals USING (host) GROUP BY ALL HAVING count(*) > host_pages * {line_dedup.MAX_RATIO} AND count(*) >= least_pages
), own AS (
  SELECT place, list(each.line ORDER BY each.line) FILTER (frequent.line IS NULL) AS own FROM each LEFT JOIN frequent USING (host, line) GROUP BY place
), flagged AS (
  SELECT host, list(line) AS lines FROM (
    SELECT host, line FROM each JOIN frequent USING (host, line) JOIN own USING (place) GROUP BY host, line, host_pages, least_pages
    HAVING count(DISTINCT coalesce(own, [])) > host_pages * {line_dedup.MAX_RATIO} AND count(DISTINCT coalesce(own, [])) >= least_pages) GROUP BY host
), kept AS (
  SELECT doc_id, split.lines AS lines, list_filter(split.lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(flagged.lines, []), trim(x, ' '))) AS left_
  FROM split LEFT JOIN flagged USING (host)
)"""
OP8_SQL = f"""
WITH {OP8_LINES}
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(left_), 0) AS n_dropped, CASE WHEN lines IS NOT NULL THEN coalesce(array_to_string(left_, chr(10)), '') END AS text FROM kept
"""

def tokenizer_files() -> dict[str, str]:
    """The public byte-level BPE with 50k entries, as a tokenizer file and as byte ranks."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), **tokenizer_files())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return toxicity.score_documents(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "rejected")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, similarity=80)


#: All pairs that share a shingle are counted, and components are what ids reach each other: for small tables.
OP3_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), either AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT either.y, reached.c FROM reached JOIN either ON either.x = reached.id
), components AS (
  SELECT id, min(c) AS c FROM reached GROUP BY id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN components ON id = doc_id LEFT JOIN sizes USING (doc_id)
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_read(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_html_text": op5_html_text,
    "op6_warc": op6_warc,
    "op7_ann": op7_ann,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    **phrase_queries.QUERIES,
}
ORACLES = {"op2_secrets": OP2_SQL, "op3_near_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op6_warc": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_url_filter": OP10_SQL, **phrase_queries.ORACLES}
