"""The same results in SQL that DuckDB runs on the given tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# -- shared building blocks ---------------------------------------------------------------------------

POINTS = """points AS (
  SELECT 'T' || label AS tenant, CAST(vec_id AS VARCHAR) AS point_id,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS vector
  FROM embeddings)"""

ATTRIBUTED = f"""{POINTS}, attributed AS (
  SELECT p.*, d.lang, d.source AS filename FROM points p LEFT JOIN documents d ON p.point_id = CAST(d.doc_id AS VARCHAR))"""

SOURCE_QUERIES = """elements AS (
  SELECT CAST(substr(d.source, 4) AS INTEGER) AS source_no, d.source, e.label,
         unnest(e.embedding) AS x, unnest(range(64)) AS pos
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
source_means AS (
  SELECT source_no, source, pos, avg(CAST(x AS DOUBLE)) AS x FROM elements GROUP BY ALL),
queries AS (
  SELECT source_no AS query_index, source AS query_text, list(x ORDER BY pos) AS qvec
  FROM source_means GROUP BY ALL)"""

RECORDS = """records AS (
  SELECT CAST(doc_id AS VARCHAR) AS uid, source AS org_id, lang, text, doc_id FROM documents)"""

MARKED = """marked AS (
  SELECT CAST(doc_id AS VARCHAR) AS uid, source AS org_id,
         replace(text, chr(10), chr(10) || '## ') AS text
  FROM documents)"""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def weighted(vector: str) -> str:
    return (
        f"round(coalesce(list_sum(list_transform({vector}, lambda x, i: CAST(x AS DOUBLE) * i)), 0), 5)"
    )


def vectors(columns: str, vector: str, source: str) -> str:
    return f"SELECT {columns}, CAST(len({vector}) AS INTEGER) AS dim, {weighted(vector)} AS weighted FROM {source}"


def hashed(name: str, source: str, columns: str, cast: str = "DOUBLE") -> str:
    """CTEs that end in ``name`` with ``columns`` and ``vector``: the feature-hash embedding of ``text``."""
    return f"""{name}_tokens AS (
  SELECT {columns}, unnest({words('lower(text)')}) AS w FROM {source}),
{name}_codes AS (
  SELECT {columns}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32 AS bucket,
         CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM {name}_tokens),
{name}_sums AS (SELECT {columns}, bucket, sum(sign) AS s FROM {name}_codes GROUP BY ALL),
{name}_keys AS (SELECT DISTINCT {columns} FROM {name}_sums),
{name}_grid AS (
  SELECT k.*, b.bucket, coalesce(s.s, 0) AS s
  FROM {name}_keys k CROSS JOIN (SELECT unnest(range(32)) AS bucket) b
  LEFT JOIN {name}_sums s USING ({columns}, bucket)),
{name}_lists AS (SELECT {columns}, list(CAST(s AS DOUBLE) ORDER BY bucket) AS v FROM {name}_grid GROUP BY ALL),
{name} AS (
  SELECT {columns}, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN
    list_transform(v, lambda x: CAST(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS {cast})) END AS vector
  FROM {name}_lists)"""


def windows(name: str, source: str, columns: str, size: int, overlap: int, least: int) -> str:
    """CTEs that end in ``name`` with ``columns``, ``start`` and ``chunk``: word windows of ``text``."""
    step = size - overlap
    return f"""{name}_words AS (SELECT {columns}, {words('text')} AS w FROM {source}),
{name}_starts AS (
  SELECT {columns}, w,
         unnest(range(0, CAST(greatest(ceil((len(w) - {size}) / {step}.0), 0) AS BIGINT) + 1)) * {step} + 1 AS start
  FROM {name}_words),
{name} AS (
  SELECT {columns}, start, array_to_string(w[start:start + {size - 1}], ' ') AS chunk
  FROM {name}_starts WHERE least(len(w) - start + 1, {size}) >= {least})"""


def numbered(source: str, columns: str, order: str) -> str:
    return f"""numbered AS (
  SELECT {columns}, chunk,
         CAST(row_number() OVER (PARTITION BY uid ORDER BY {order}) AS INTEGER) AS chunk_index,
         CAST(count(*) OVER (PARTITION BY uid) AS INTEGER) AS chunk_count FROM {source})"""


CHUNK_UID = """CASE WHEN chunk_count > 1 THEN uid || '_' || chunk_index ELSE uid END AS uid,
  chunk_index, chunk_count, CASE WHEN chunk_count > 1 THEN uid END AS parent_uid, md5(chunk) AS digest"""


def top_k(points: str, queries: str, k: int, on: str = "TRUE") -> str:
    return f"""scored AS (
  SELECT q.query_index, p.tenant, p.point_id, round(list_cosine_similarity(p.vector, q.qvec), 9) AS score
  FROM {points} p JOIN {queries} q ON {on}),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY query_index ORDER BY score DESC, point_id, tenant) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= {k})"""


HITS = "SELECT query_index, rank, tenant, point_id, round(score, 6) AS score FROM ranked"

EVENT_LATEST = """SELECT event_type AS tenant, CAST(user_id AS VARCHAR) AS point_id, event_id AS seq,
  round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"""


def latest(where: str = "TRUE", order: str = "event_id") -> str:
    return (
        f"{EVENT_LATEST} WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY {order} DESC) = 1"
    )


REGISTRY_CSV = """SELECT lang AS collection, string_agg(DISTINCT source, ',' ORDER BY source) AS tenants
FROM documents GROUP BY lang"""
REGISTRY_PAIRS = "SELECT DISTINCT lang AS collection, source AS tenant FROM documents"
TOXIC_PAIRS = """SELECT DISTINCT lang AS collection, source AS tenant FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""


def registry_status(missing: str, present: str) -> str:
    return f"""WITH requested AS ({REGISTRY_PAIRS}), known AS ({TOXIC_PAIRS})
SELECT r.*, CASE WHEN k.tenant IS NULL THEN '{missing}' ELSE '{present}' END AS status
FROM requested r LEFT JOIN known k USING (collection, tenant)"""


BACKUP_LINES = """lines AS (
  SELECT CAST(e.vec_id AS VARCHAR) AS id, CASE WHEN d.lang <> 'es' THEN d.source END AS payload_tenant,
         CASE WHEN d.lang NOT IN ('en', 'es') THEN d.source END AS shard_key,
         CASE WHEN e.label = 4 THEN 63 ELSE 64 END AS dim
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""

# -- sources and sinks --------------------------------------------------------------------------------

ORACLE["scan_csv"] = "SELECT CAST(doc_id AS VARCHAR) AS uid, source AS org_id, lang, md5(text) AS digest FROM documents"
ORACLE["row_ordinal"] = (
    "SELECT CAST(doc_id AS VARCHAR) AS uid, row_number() OVER (ORDER BY doc_id) - 1 AS row_pos FROM documents"
)
ORACLE["scan_csv_headers"] = f"""WITH {RECORDS}
SELECT uid, org_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 <> 0 THEN 'n' || doc_id END AS note,
       md5(text) AS digest, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS row_pos FROM records"""
ORACLE["scan_query_files"] = vectors(
    "CAST(row_number() OVER (ORDER BY vec_id % 3 <> 0, vec_id) - 1 AS INTEGER) AS query_index", "embedding", "embeddings")
ORACLE["scan_backup"] = f"WITH {ATTRIBUTED} " + vectors(
    "point_id AS id, tenant AS shard_key, lang", "vector", "attributed")
ORACLE["scan_query_vectors"] = vectors(
    "CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS query_index", "embedding", "embeddings")
ORACLE["read_manifest"] = f"""WITH {ATTRIBUTED}
SELECT CAST(1 AS INTEGER) AS version, 'points' AS collection, CAST(64 AS INTEGER) AS vector_size,
       (SELECT count(*) FROM attributed) AS points_total, tenant, count(*) AS points FROM attributed GROUP BY tenant"""
ORACLE["read_registry"] = REGISTRY_CSV
_STORED = "list_transform(vector, lambda x: CAST(x AS FLOAT))"
ORACLE["scan_points"] = f"WITH {ATTRIBUTED} " + vectors("tenant, point_id, filename, lang", _STORED, "attributed")
ORACLE["scroll_page"] = f"""WITH {ATTRIBUTED}
SELECT tenant, point_id FROM attributed WHERE (point_id, tenant) > ('15', 'T3') ORDER BY point_id, tenant LIMIT 100"""
ORACLE["upsert_points"] = latest()
ORACLE["export_points"] = f"WITH {ATTRIBUTED} " + vectors(
    "CAST(point_id AS BIGINT) AS id, tenant AS shard_key, filename", _STORED, "attributed")
ORACLE["import_points"] = f"WITH {ATTRIBUTED} " + vectors("tenant, point_id, filename", _STORED, "attributed")
_GAPPY = f"""{RECORDS}, gappy AS (
  SELECT * REPLACE (CASE WHEN doc_id % 19 = 0 THEN ' ' WHEN doc_id % 17 = 0 THEN 'NaN' ELSE text END AS text) FROM records),
{hashed('embedded', 'gappy', 'uid, org_id, lang', 'FLOAT')}"""
ORACLE["embed_upsert"] = f"WITH {_GAPPY} " + vectors("org_id AS tenant, uid AS point_id, lang", "vector", "embedded WHERE vector IS NOT NULL")
ORACLE["job_load_report"] = f"""WITH {_GAPPY}, counts AS (
  SELECT (SELECT count(*) FROM gappy) AS read, (SELECT count(*) FROM embedded WHERE vector IS NOT NULL) AS written,
         (SELECT count(*) FROM gappy WHERE org_id IS NULL OR org_id = '') AS other,
         (SELECT count(*) FROM gappy WHERE org_id <> '' AND len({words('text')}) = 0) AS blank)
SELECT unnest(['read', 'written', 'other_tenant', 'blank_text', 'no_vector']) AS what,
       unnest([read, written, other, blank, read - written - other - blank]) AS n FROM counts"""
ORACLE["replace_tenant_slice"] = f"""WITH {RECORDS}
SELECT uid, org_id, md5(CASE WHEN org_id = 'src3' THEN 'new ' || text ELSE text END) AS digest,
       CASE WHEN org_id = 'src3' THEN 'new' END AS note FROM records"""
ORACLE["write_embedded_csv"] = f"WITH {RECORDS}, {hashed('embedded', 'records', 'uid, org_id')} " + vectors(
    "uid, org_id", "vector", "embedded WHERE vector IS NOT NULL")
ORACLE["nest_results"] = f"""WITH {POINTS}, {SOURCE_QUERIES}, {top_k('points', 'queries', 5)}
SELECT query_index, query_text, string_agg(rank || ':' || point_id, ',' ORDER BY rank) AS hits
FROM ranked JOIN queries USING (query_index) GROUP BY ALL"""
ORACLE["save_registry"] = f"""WITH pairs AS ({REGISTRY_PAIRS}), lists AS (
  SELECT collection, list(tenant ORDER BY tenant) AS tenants FROM pairs GROUP BY collection)
SELECT '{{' || string_agg('"' || collection || '":["' || array_to_string(tenants, '","') || '"]', ',' ORDER BY collection)
  || '}}' AS value FROM lists"""

# -- filters and projections ------------------------------------------------------------------------------

ORACLE["filter_tenant"] = f"WITH {RECORDS} SELECT uid, lang FROM records WHERE org_id = 'src7'"
ORACLE["parse_vectors"] = vectors("vec_id, label", "embedding", "embeddings WHERE label NOT IN (1, 2)")
ORACLE["drop_blank_text"] = f"WITH {RECORDS} SELECT uid, md5(text) AS digest FROM records WHERE lang <> 'es'"
ORACLE["prune_columns"] = "SELECT event_id, event_type FROM events"
ORACLE["build_payload"] = """SELECT CAST(event_id AS VARCHAR) AS uid, event_type,
  CASE WHEN event_type <> 'error' THEN value END AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  't1' AS tenant_name, CAST(NULL AS VARCHAR) AS junk FROM events"""
ORACLE["prune_payload_keys"] = "SELECT event_id, 'event_type,props' AS keys FROM events"
ORACLE["project_payload"] = "SELECT event_id, 'event_type' AS keys, event_type FROM events"
ORACLE["project_vectors"] = f"WITH {POINTS} SELECT tenant, point_id FROM points"
ORACLE["match_filter"] = (
    f"WITH {ATTRIBUTED} SELECT tenant, point_id FROM attributed WHERE lang = 'en' AND filename = 'src5'"
)
ORACLE["import_tenant_filter"] = f"""WITH {BACKUP_LINES}
SELECT id, shard_key FROM lines WHERE coalesce(shard_key, payload_tenant) = 'src2'"""
ORACLE["sanitize_numbers"] = """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS value,
  CASE WHEN event_type <> 'click' THEN value END AS first, value AS second FROM events"""
ORACLE["embeddable_text"] = f"""WITH {RECORDS}
SELECT uid, lang, lang NOT IN ('de', 'fr') AS usable,
  md5(CASE WHEN lang = 'es' THEN 'none' WHEN lang NOT IN ('de', 'fr') THEN trim(text, {SPACES}) END) AS digest
FROM records"""
ORACLE["prefix_text"] = f"""WITH {RECORDS}
SELECT uid, md5(CASE WHEN lang = 'de' THEN 'Query: ' || text ELSE 'passage: ' || text END) AS digest FROM records"""
ORACLE["token_count"] = f"WITH {RECORDS} SELECT uid, CAST(len({words('text')}) AS INTEGER) AS tokens FROM records"
ORACLE["clean_markdown"] = f"WITH {MARKED} SELECT uid, md5(trim(text, {SPACES})) AS digest FROM marked"
ORACLE["fill_text_from_doc"] = f"WITH {RECORDS} SELECT uid, md5(text) AS digest FROM records"
ORACLE["assign_point_ids"] = """WITH named AS (
  SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR)) AS m,
         sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || '_é_' || doc_id)) AS h FROM documents)
SELECT doc_id, CASE lang
  WHEN 'fr' THEN substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4)
    || '-' || substr(m, 21, 12)
  WHEN 'de' THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
    || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)
  ELSE CAST(doc_id AS VARCHAR) END AS point_id FROM named"""

# -- chunks and vectors -------------------------------------------------------------------------------------

ORACLE["chunk_words"] = f"""WITH {RECORDS}, {windows('chunks', 'records', 'uid', 100, 20, 10)},
{numbered('chunks', 'uid', 'start')} SELECT {CHUNK_UID} FROM numbered"""
_SEPARATORS = [*("\n" + "#" * n + " " for n in range(1, 7)), "\n\n", "\n", " "]


def _recursive_step(name: str, level: int, separator: str, columns: str, size: int, overlap: int) -> str:
    """Cut the open texts of a level, walk from window to window over the short pieces, hand the long ones on."""
    cut = " || ".join(f"chr({ord(c)})" for c in separator)
    here, last = f"{name}{level}", level == len(_SEPARATORS) - 1
    return f"""{here}_pieces AS (
  SELECT {columns}, path, unnest(pieces) AS piece, unnest(range(len(pieces))) AS pos FROM (
    SELECT {columns}, path, list_filter(list_transform(string_split(text, {cut}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {cut} || p END),
      lambda p: p <> '') AS pieces FROM {here})),
{here}_counted AS (SELECT *, len({words('piece')}) AS n FROM {here}_pieces),
{here}_marked AS (
  SELECT *, sum(CASE WHEN n >= {size} OR before >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY {columns}, path ORDER BY pos) AS run
  FROM (SELECT *, lag(n, 1, 0) OVER (PARTITION BY {columns}, path ORDER BY pos) AS before FROM {here}_counted)),
{here}_runs AS (
  SELECT {columns}, path, CAST(run AS BIGINT) AS run, list(piece ORDER BY pos) AS pieces, list(n ORDER BY pos) AS counts, max(n) >= {size} AS long
  FROM {here}_marked GROUP BY ALL),
{here}_sums AS (
  SELECT *, list_transform(range(len(counts) + 1), lambda k: CAST(coalesce(list_sum(counts[1:k]), 0) AS BIGINT)) AS sums FROM {here}_runs WHERE NOT long),
{here}_walk AS (
  SELECT {columns}, path, run, sums, CAST(0 AS BIGINT) AS first,
         CAST(greatest(1, len(list_filter(sums, lambda x: x <= {size})) - 1) AS BIGINT) AS stop FROM {here}_sums
  UNION ALL
  SELECT {columns}, path, run, sums, CAST(begin AS BIGINT), CAST(greatest(begin + 1, len(list_filter(sums, lambda x: x <= sums[begin + 1] + {size})) - 1) AS BIGINT)
  FROM (SELECT *, len(list_filter(sums, lambda x: x < greatest(sums[stop + 1] - {overlap}, sums[stop + 2] - {size}))) AS begin
        FROM {here}_walk WHERE stop < len(sums) - 1)),
{here}_done AS (
  SELECT w.* EXCLUDE (path, run, sums, first, stop), printf('%s%08d%08d', w.path, w.run, w.first) AS path,
         array_to_string(s.pieces[w.first + 1 : w.stop], '') AS text, w.sums[w.stop + 1] - w.sums[w.first + 1] AS n
  FROM {here}_walk w JOIN {here}_sums s USING ({columns}, path, run){f"""
  UNION ALL SELECT {columns}, printf('%s%08d', path, run), pieces[1], counts[1] FROM {here}_runs WHERE long""" if last else ""}),
{name}{level + 1} AS (
  SELECT {columns}, printf('%s%08d%08d', path, run, 0) AS path, pieces[1] AS text FROM {here}_runs WHERE long)"""


def recursive_windows(name: str, source: str, columns: str, size: int, overlap: int, least: int) -> str:
    """CTEs that end in ``name`` with ``columns``, ``path`` (in text order) and ``chunk``: markdown windows of ``text``."""
    steps = ",\n".join(_recursive_step(f"{name}_", k, s, columns, size, overlap) for k, s in enumerate(_SEPARATORS))
    done = " UNION ALL ".join(f"SELECT {columns}, path, text, n FROM {name}_{k}_done" for k in range(len(_SEPARATORS)))
    return f"""{name}_0 AS (SELECT {columns}, '' AS path, trim(text, {SPACES}) AS text FROM {source}),
{steps},
{name} AS (SELECT {columns}, path, trim(text, {SPACES}) AS chunk FROM ({done}) WHERE n >= {least})"""


ORACLE["chunk_markdown"] = f"""WITH RECURSIVE {MARKED}, {recursive_windows('chunks', 'marked', 'uid, org_id', 40, 10, 5)},
{numbered('chunks', 'uid', 'path')} SELECT {CHUNK_UID} FROM numbered"""
ORACLE["chunk_recursive"] = f"""WITH RECURSIVE {MARKED}, {recursive_windows('chunks', 'marked', 'uid', 100, 20, 10)},
{numbered('chunks', 'uid', 'path')} SELECT {CHUNK_UID} FROM numbered"""
ORACLE["chunk_records"] = f"""WITH turns AS (SELECT conv_id || '-' || turn AS uid, role, text FROM conversations),
{windows('chunks', 'turns', 'uid, role', 30, 5, 3)}, {numbered('chunks', 'uid, role', 'start')}
SELECT role, {CHUNK_UID} FROM numbered"""
ORACLE["normalize_vectors"] = f"""WITH {POINTS}, unit AS (
  SELECT tenant, point_id, list_transform(vector, lambda x:
    x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS vector FROM points) """ + vectors(
    "tenant, point_id", "vector", "unit")
ORACLE["hash_embed"] = f"WITH {RECORDS}, {hashed('embedded', 'records', 'uid')} " + vectors("uid", "vector", "embedded")
ORACLE["embed_text"] = f"WITH {RECORDS}, {hashed('embedded', 'records', 'uid', 'FLOAT')} " + vectors(
    "uid", "vector", "embedded")
_DOCUMENT_CHUNKS = f"""WITH RECURSIVE {MARKED}, {recursive_windows('pieces', 'marked', 'uid, org_id', 80, 20, 10)},
{numbered('pieces', 'uid, org_id', 'path')},
chunks AS (
  SELECT CASE WHEN chunk_count > 1 THEN uid || '_' || chunk_index ELSE uid END AS uid, org_id, chunk_index, chunk_count,
         chunk AS text FROM numbered)"""
ORACLE["embed_documents"] = (
    f"{_DOCUMENT_CHUNKS}, {hashed('embedded', 'chunks', 'uid, org_id, chunk_index, chunk_count')} "
    + vectors("uid, org_id, chunk_index, chunk_count", "vector", "embedded")
)
_PLAIN_CHUNKS = f"""WITH RECURSIVE {RECORDS}, {recursive_windows('pieces', 'records', 'uid', 80, 20, 10)},
{numbered('pieces', 'uid', 'path')}, chunks AS (
  SELECT CASE WHEN chunk_count > 1 THEN uid || '_' || chunk_index ELSE uid END AS uid, chunk_index, chunk_count,
         chunk AS text FROM numbered)"""
ORACLE["stream_embed"] = (
    f"{_PLAIN_CHUNKS}, {hashed('embedded', 'chunks', 'uid, chunk_index, chunk_count')} "
    + vectors("uid, chunk_index, chunk_count", "vector", "embedded")
)

# -- checks, joins and aggregates ------------------------------------------------------------------------------

ORACLE["dim_violations"] = """SELECT vec_id, CASE label WHEN 9 THEN 'dimension 63 != expected 64'
  WHEN 8 THEN 'missing vector' ELSE 'zero vector' END AS reason FROM embeddings WHERE label IN (7, 8, 9)"""
ORACLE["import_violations"] = f"""WITH {BACKUP_LINES}, known AS (SELECT DISTINCT tenant FROM ({TOXIC_PAIRS})),
checked AS (
  SELECT id, dim, coalesce(shard_key, payload_tenant) AS t FROM lines),
reasons AS (
  SELECT id, CASE WHEN t IS NULL THEN 'shard key missing'
    WHEN t NOT IN (SELECT tenant FROM known) THEN 'shard key not registered'
    WHEN dim <> 64 THEN 'dimension 63 != expected 64' END AS reason FROM checked)
SELECT id, reason FROM reasons WHERE reason IS NOT NULL"""
_ENGLISH = f"(SELECT tenant FROM ({TOXIC_PAIRS}) WHERE collection = 'en')"
ORACLE["tenant_semi"] = f"WITH {RECORDS} SELECT uid, org_id AS tenant FROM records WHERE org_id IN {_ENGLISH}"
ORACLE["tenant_anti"] = f"WITH {RECORDS} SELECT uid, org_id AS tenant FROM records WHERE org_id NOT IN {_ENGLISH}"
ORACLE["overlay_embeddings"] = """SELECT CAST(d.doc_id AS VARCHAR) AS uid,
  CAST(coalesce(CASE WHEN l.toxic = 0 THEN l.quality END, d.n_chars) AS DOUBLE) AS value
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
ORACLE["label_results"] = f"""WITH {POINTS}, {SOURCE_QUERIES}, {top_k('points', 'queries', 3)}
SELECT query_index, query_text, rank, point_id FROM ranked JOIN queries USING (query_index)"""
ORACLE["registry_diff"] = registry_status("missing", "known")
ORACLE["ensure_report"] = registry_status("created", "skipped")
ORACLE["tenant_except"] = f"{REGISTRY_PAIRS} EXCEPT {TOXIC_PAIRS}"
ORACLE["tenant_intersect"] = f"{REGISTRY_PAIRS} INTERSECT {TOXIC_PAIRS}"
ORACLE["backup_manifest"] = """SELECT (SELECT count(*) FROM embeddings) AS points_total, 'T' || label AS tenant,
  count(*) AS points FROM embeddings GROUP BY label"""
ORACLE["tenants_by_collection"] = REGISTRY_CSV
ORACLE["dedupe_first"] = """SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents
WHERE lang <> 'es' AND text <> '' GROUP BY text"""
ORACLE["dedupe_last"] = latest(order="ts DESC, event_id").replace(
    "CAST(CAST(value AS FLOAT) AS DOUBLE)", "value")
ORACLE["load_report"] = """WITH reasons AS (
  SELECT CASE WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'other_tenant' WHEN lang = 'de' OR text = '' THEN 'blank_text'
    WHEN lang = 'es' THEN 'bad_language' END AS reason FROM documents)
SELECT count(*) AS rows_read, count(*) FILTER (reason IS NULL) AS rows_kept,
  count(*) FILTER (reason = 'other_tenant') AS dropped_other_tenant,
  count(*) FILTER (reason = 'blank_text') AS dropped_blank_text,
  count(*) FILTER (reason = 'bad_language') AS dropped_bad_language FROM reasons"""

# -- search ------------------------------------------------------------------------------------------------------

ORACLE["knn_exact"] = f"WITH {POINTS}, {SOURCE_QUERIES}, {top_k('points', 'queries', 10)} {HITS}"
ORACLE["knn_blocked"] = ORACLE["knn_exact"]
ORACLE["knn_nonfinite"] = f"""WITH {POINTS}, {SOURCE_QUERIES}, fine AS (SELECT * FROM points WHERE tenant NOT IN ('T3', 'T4')),
{top_k('fine', 'queries', 10)} {HITS}"""
ORACLE["scroll_all"] = f"""WITH {POINTS}, twice AS (
  SELECT tenant, point_id FROM points UNION ALL SELECT 'U' || tenant, point_id FROM points)
SELECT tenant, point_id, (row_number() OVER (ORDER BY point_id, tenant) - 1) // 100 AS page FROM twice"""
ORACLE["knn_tenant"] = f"""WITH {POINTS}, {SOURCE_QUERIES}, tenant_means AS (
  SELECT source_no, label, pos, avg(CAST(x AS DOUBLE)) AS x FROM elements GROUP BY ALL),
tenant_queries AS (
  SELECT CAST(source_no * 10 + label AS INTEGER) AS query_index, 'T' || label AS tenant, list(x ORDER BY pos) AS qvec
  FROM tenant_means GROUP BY ALL),
{top_k('points', 'tenant_queries', 5, 'p.tenant = q.tenant')} {HITS}"""
ORACLE["knn_filtered"] = f"""WITH {ATTRIBUTED}, english AS (SELECT * FROM attributed WHERE lang = 'en'),
{SOURCE_QUERIES}, {top_k('english', 'queries', 5)} {HITS}"""
ORACLE["knn_ivf"] = f"""WITH {POINTS}, {SOURCE_QUERIES}, label_elements AS (
  SELECT label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings),
label_means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM label_elements GROUP BY ALL),
cells AS (SELECT label AS cell, list(x ORDER BY pos) AS c FROM label_means GROUP BY label),
placed AS (
  SELECT p.*, cell FROM points p CROSS JOIN cells QUALIFY row_number() OVER (
    PARTITION BY point_id ORDER BY round(list_cosine_similarity(vector, c), 9) DESC, cell) = 1),
probes AS (
  SELECT q.*, cell FROM queries q CROSS JOIN cells QUALIFY row_number() OVER (
    PARTITION BY query_index ORDER BY round(list_cosine_similarity(qvec, c), 9) DESC, cell) <= 2),
{top_k('placed', 'probes', 10, 'p.cell = q.cell')} {HITS}"""
ORACLE["search_ivf"] = ORACLE["knn_ivf"].replace(POINTS, f"""{POINTS}, stored AS (
  SELECT tenant, point_id, list_transform(vector, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS vector FROM points)""").replace("FROM points p CROSS JOIN cells", "FROM stored p CROSS JOIN cells").replace(
    HITS, "SELECT query_index, rank, tenant, point_id, round(score, 6) AS score, d.source AS filename "
    "FROM ranked LEFT JOIN documents d ON point_id = CAST(d.doc_id AS VARCHAR)")
_FLAT = f"""{POINTS}, stored AS (
  SELECT tenant, point_id, list_transform(vector, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE)) AS vector FROM points)"""
ORACLE["flat_tenant_search"] = f"""WITH {_FLAT}, own AS (SELECT * FROM stored WHERE tenant = 'T3'), {SOURCE_QUERIES},
{top_k('own', 'queries', 5)} {HITS}"""
ORACLE["flat_tenant_export"] = f"WITH {_FLAT} " + vectors("point_id AS id, tenant AS tenant_name", "vector", "stored WHERE tenant = 'T5'")
ORACLE["text_search"] = f"""WITH {RECORDS}, {hashed('docs', 'records', 'uid, org_id, lang', 'FLOAT')},
texts AS (SELECT CAST(item_id AS INTEGER) AS query_index, trim(text, {SPACES}) AS text FROM benchmark),
{hashed('asked', 'texts', 'query_index')},
stored AS (
  SELECT org_id AS tenant, uid AS point_id, lang, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS vector FROM docs
  WHERE vector IS NOT NULL),
queries AS (SELECT query_index, vector AS qvec FROM asked WHERE vector IS NOT NULL),
{top_k('stored', 'queries', 5)}
SELECT query_index, md5(t.text) AS query_digest, rank, tenant, point_id, round(score, 6) AS score, s.lang
FROM ranked JOIN texts t USING (query_index) JOIN stored s USING (tenant, point_id)"""

# -- streaming and collections ---------------------------------------------------------------------------------------

ORACLE["stream_upsert"] = latest()
ORACLE["compact_points"] = latest().replace("CAST(CAST(value AS FLOAT) AS DOUBLE)", "CAST(CAST(value + CASE WHEN user_id % 11 < 2 THEN 1000 ELSE 0 END AS FLOAT) AS DOUBLE)")
ORACLE["delete_tenants"] = f"""WITH {ATTRIBUTED}
SELECT tenant, count(*) AS points FROM attributed WHERE tenant NOT IN ('T1', 'T4') GROUP BY tenant"""
ORACLE["delete_collection"] = REGISTRY_PAIRS + " WHERE lang <> 'de'"
ORACLE["restore_registry"] = REGISTRY_PAIRS
ORACLE["restore_tenant"] = f"WITH {ATTRIBUTED} " + vectors("tenant, point_id", _STORED, "attributed WHERE tenant = 'T6'")
ORACLE["snapshot_list"] = """WITH keys AS (
  SELECT event_type, user_id, min(ts) AS first_ts FROM events GROUP BY ALL),
snaps(snapshot, until) AS (VALUES ('january', TIMESTAMP '2024-01-15'), ('all', TIMESTAMP '9999-01-01'))
SELECT snapshot, CAST((SELECT count(DISTINCT event_type) FROM events) AS INTEGER) AS tenants, count(*) AS points
FROM snaps JOIN keys ON first_ts < until GROUP BY snapshot"""
ORACLE["snapshot_restore"] = f"""WITH saved AS ({latest("ts < TIMESTAMP '2024-01-15'")}), final AS ({latest()})
SELECT * FROM saved UNION ALL
SELECT f.* FROM final f WHERE NOT EXISTS (
  SELECT 1 FROM saved s WHERE s.tenant = f.tenant AND s.point_id = f.point_id)"""
