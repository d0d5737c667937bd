"""The registered queries once more, as SQL for DuckDB over the given tables."""

from __future__ import annotations

import re

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"
EARLIER = "TIMESTAMP '2024-05-01 00:00:00'"


def _id(label: str) -> str:
    return f"CAST('0x' || substr(md5({label}), 1, 15) AS BIGINT)"


def _first_of_shard(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY key, doc_id) AS nth
        FROM {source}) WHERE nth = 1"""


def _text_of(matches: str) -> str:
    """md5 over a list of {uri, text}, NULL for no list."""
    return f"""CASE WHEN {matches} IS NOT NULL THEN
        md5(array_to_string(list_transform({matches}, lambda m: m.uri || '=' || m.text), chr(10))) END"""


# What the queries read, each as one SELECT over the given tables and the ones above it.
INPUTS = {
    "docs": """
    SELECT doc_id, source, lang, text, md5(text) AS md5,
           source || '/text/' || lang || '/' || md5(text) || '.zz' AS key,
           CAST(strlen(text) AS BIGINT) AS size
    FROM documents""",
    "listing": """
    SELECT key, size FROM docs
    UNION ALL
    SELECT 'chat/' || CASE WHEN role = 'user' THEN 'text' ELSE 'text2' END || '/und/' || md5(text)
           || '.zz.zz/' || conv_id || '-' || turn, CAST(strlen(text) AS BIGINT)
    FROM conversations
    UNION ALL
    SELECT 'pages/' || page_id || '.html', CAST(strlen(html) AS BIGINT) FROM pages""",
    "cut": """
    SELECT key, size, string_split(key, '/') AS p FROM listing""",
    "parsed": """
    SELECT key, size, p[1] AS name, p[2] AS data_type, p[3] AS language, replace(p[4], '.zz', '') AS md5
    FROM cut WHERE len(p) >= 4""",
    "loads": """
    SELECT DISTINCT name, data_type FROM parsed""",
    "winners": f"""
    {_first_of_shard("docs")}""",
    "catalog": """
    SELECT source AS name, lang AS language, 'text' AS data_type, md5, key, size AS byte_size, doc_id
    FROM winners""",
    "known": """
    SELECT source AS name, lang AS language, 'text' AS data_type, md5, key, size AS byte_size
    FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY key, doc_id) AS nth
          FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE nth = 1""",
    "resume": """
    SELECT name, data_type, max(key) AS start_after FROM known GROUP BY name, data_type""",
    "old_stats": """
    SELECT language, data_type, name, count(*) + 1 AS total_objects
    FROM catalog WHERE language = 'en' GROUP BY language, data_type, name
    UNION ALL
    SELECT 'und', 'chat', role, count(*) FROM conversations GROUP BY role""",
    "wanted": """
    SELECT DISTINCT source AS dataset, lang AS language FROM documents
    UNION ALL SELECT DISTINCT source, CAST(NULL AS VARCHAR) FROM documents
    UNION ALL SELECT DISTINCT source || '-gone', 'en' FROM documents""",
    "numbered": f"""
    SELECT {_id("dataset || '/' || coalesce(language, '-')")} AS id, dataset, language FROM wanted""",
    "queries": f"""
    SELECT id, dataset, language, 'topic ' || id AS query_text, 'm' || (id % 3) AS model,
           'u' || (id % 7) AS owner,
           CASE WHEN id % 4 = 0 THEN 'pending' WHEN id % 4 <> 3 THEN 'published' END AS status,
           {AS_OF} AS created_at
    FROM numbered""",
    "fan": """
    SELECT q.id AS query_id, c.name, c.language, c.data_type, c.md5, c.key, c.byte_size, c.doc_id,
           md5(q.id || ':' || c.md5) AS job_id
    FROM queries q JOIN catalog c ON q.dataset = c.name AND q.language = c.language""",
    "placed": """
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5) - 1 AS seq FROM fan""",
    "contexts": """
    SELECT *, seq // 7 AS batch_no, CAST(seq % 7 AS INTEGER) AS pos,
           count(*) OVER (PARTITION BY query_id, seq // 7) AS in_batch
    FROM placed""",
    "created": """
    SELECT * FROM contexts WHERE NOT ((query_id + batch_no) % 3 = 2 AND pos = in_batch - 1)""",
    "judged": f"""
    SELECT d.doc_id, d.source, d.lang, d.md5, e.ts AS received_at, e.event_type,
           l.toxic = 1 AS failed,
           CASE WHEN l.toxic <> 1 AND l.quality = 1 THEN list_transform(string_split(d.text, chr(10)),
               lambda line, i: {{'uri': d.doc_id || '#' || (i - 1), 'text': line}}) END AS found
    FROM docs d JOIN labels l USING (doc_id) JOIN events e ON e.event_id = d.doc_id""",
    "jobs": """
    SELECT f.query_id, f.md5 AS data_id, f.job_id,
           CASE WHEN j.failed THEN 'error' WHEN j.doc_id IS NOT NULL THEN 'processed' ELSE 'pending' END
               AS status,
           j.found AS matches, j.received_at AS finished_at
    FROM fan f LEFT JOIN judged j ON j.doc_id = f.doc_id""",
    "visible": """
    SELECT * FROM jobs WHERE status = 'processed' AND matches IS NOT NULL""",
    "answers": f"""
    SELECT *, md5({_id("source || '/' || lang")} || ':' || md5) AS job_id FROM judged""",
    "callbacks": """
    SELECT job_id, received_at, CASE WHEN failed THEN 422 END AS error_code, found AS matches FROM answers
    UNION ALL
    SELECT job_id, received_at + INTERVAL 1 DAY, 503, NULL FROM answers WHERE event_type = 'error'""",
    "last_call": """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC) AS nth
                   FROM callbacks) WHERE nth = 1""",
    "odd_lines": """
    SELECT job_id, CASE minute(received_at) % 5 WHEN 0 THEN 'not a callback message'
        WHEN 1 THEN 'job_id is missing' WHEN 2 THEN 'error code is missing' ELSE '' END AS kind FROM callbacks""",
    "doc_query": f"""
    SELECT doc_id, {_id("source || '/' || lang")} AS query_id FROM documents""",
    "event_jobs": """
    SELECT coalesce(d.query_id, e.user_id) AS query_id, CAST(e.event_id AS VARCHAR) AS data_id,
           md5(CAST(e.event_id AS VARCHAR)) AS job_id,
           CASE WHEN e.event_type <> 'signup' THEN e.event_type END AS status
    FROM events e LEFT JOIN doc_query d ON d.doc_id = e.event_id""",
    "requests": f"""
    SELECT {_id("conv_id || ':' || turn")} AS id, 'chat' AS dataset, role || '-und' AS language,
           text AS query_text, text AS model, 'c' || conv_id AS owner
    FROM conversations""",
}


def _with_inputs(body: str) -> str:
    """The query with those inputs, in order, that it needs directly or through others."""
    needed, texts = set(), [body]
    while texts:
        words = set(re.findall(r"\w+", texts.pop()))
        for name in words & INPUTS.keys() - needed:
            needed.add(name)
            texts.append(INPUTS[name])
    chain = ",\n".join(f"{name} AS ({sql})" for name, sql in INPUTS.items() if name in needed)
    return f"WITH {chain}\n{body}" if chain else body


_ROW = "name, language, data_type, md5, CAST(0 AS INTEGER) AS num_of_records, " \
       "CAST(0 AS BIGINT) AS decompressed_byte_size, byte_size, '' AS source"
_PARSED_ROW = _ROW.replace("byte_size, ''", "coalesce(size, 0) AS byte_size, ''")
_OUTCOME = f"CAST(len(matches) AS INTEGER) AS n_matches, {_text_of('matches')} AS matches_md5"
_LISTED = """FROM listing JOIN loads ON starts_with(listing.key, loads.name || '/' || loads.data_type)
    LEFT JOIN resume USING (name, data_type)"""

BODIES = {
    # Scans
    "listing_scan": """SELECT source || '/' || CASE WHEN doc_id % 5 = 0 THEN '_hidden' ELSE 'text' END || '/' || lang
        || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || md5(CAST(doc_id AS VARCHAR)) AS key,
        CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 100 END AS size FROM documents""",
    "catalog_roundtrip": f"""SELECT name, CASE byte_size % 4 WHEN 0 THEN '' WHEN 1 THEN '007'
        WHEN 2 THEN '2024-01-01' ELSE language END AS language, md5, byte_size, {AS_OF} AS created_at FROM catalog""",
    "scan_catalog": "SELECT name, language, data_type, md5, byte_size FROM catalog WHERE language = 'en'",
    "scan_catalog_of_dataset": """SELECT name, language, data_type, md5, byte_size FROM catalog
        WHERE language = 'en' AND name = 'src0'""",
    "batch_summary": """SELECT query_id, batch_no, CAST(count(*) AS INTEGER) AS n_contexts,
        string_agg(key, ',' ORDER BY pos) AS data_urls, CAST(sum(byte_size) AS BIGINT) AS bytes
        FROM contexts GROUP BY query_id, batch_no""",
    "scan_records": """SELECT md5, doc_id || '#' || (i - 1) AS uri, line AS text FROM (
        SELECT md5, doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs)""",
    "record_counts": """SELECT doc_id, md5, CAST(len(string_split(text, chr(10))) AS INTEGER)
        AS num_of_records, size AS decompressed_byte_size FROM docs""",
    # Projections and filters
    "parse_key": "SELECT key, size, name, data_type, language, md5 FROM parsed",
    "rejected_keys": "SELECT key, size FROM cut WHERE len(p) < 4",
    "prefix_listing": f"""SELECT loads.name AS load_name, loads.data_type AS load_type, key, size
        {_LISTED}""",
    "start_after_listing": f"""SELECT loads.name AS load_name, loads.data_type AS load_type, key, size
        {_LISTED} WHERE key > coalesce(start_after, '')""",
    "rebuild_key": """SELECT md5, name || '/' || data_type || '/' || language || '/' || md5 || '.zz'
        AS object_key FROM catalog""",
    "loader_defaults": f"SELECT key, {_PARSED_ROW}, {AS_OF} AS created_at FROM parsed",
    "job_contexts": """SELECT key AS data_url, CAST(0 AS INTEGER) AS batch_size, byte_size AS bytesize,
        CAST(0 AS BIGINT) AS decompressed_byte_size, md5 AS checksum_md5, query_id AS classifier_id
        FROM fan""",
    "visible_results": f"SELECT query_id, job_id, {_text_of('matches')} AS matches_md5 FROM visible",
    "eligible_queries": """SELECT id, dataset, language, owner, status FROM queries
        WHERE status <> 'pending' AND EXISTS (SELECT 1 FROM fan WHERE query_id = id)""",
    "eligible_queries_of_owner": """SELECT id, dataset, language, owner, status FROM queries
        WHERE owner = 'u1' AND status <> 'pending' AND EXISTS (SELECT 1 FROM fan WHERE query_id = id)""",
    "owned_queries": """SELECT id AS query_id, dataset, query_text, model, language, created_at, owner
        FROM queries""",
    "owned_queries_of_owner": """SELECT id AS query_id, dataset, query_text, model, language, created_at
        FROM queries WHERE owner = 'u1'""",
    "query_context": """SELECT query_id, job_id, query_text, model FROM fan JOIN queries ON id = query_id""",
    "job_outcome": f"""SELECT job_id, received_at,
        CASE WHEN error_code IS NOT NULL THEN 'error' ELSE 'processed' END AS status,
        {_OUTCOME}, error_code, received_at AS finished_at FROM callbacks""",
    "register_queries": f"""SELECT id, dataset, language, query_text, model, owner, 'pending' AS status,
        {AS_OF} AS created_at FROM requests WHERE length(language) <= 10 AND length(model) <= 255""",
    "register_rejects": """SELECT id, concat_ws('; ',
        CASE WHEN length(language) > 10 THEN 'language: too wide' END,
        CASE WHEN length(model) > 255 THEN 'model: too wide' END) AS reasons
        FROM requests WHERE length(language) > 10 OR length(model) > 255""",
    "query_messages": """SELECT id AS query_id, 'details' AS kind, '{"queryId":' || id || ',"dataset":"' || dataset
        || '","queryText":"' || query_text || '","model":"' || model || '"'
        || coalesce(',"language":"' || language || '"', '') || ',"createdAt":"2024-06-01T00:00:00.000"}' AS body FROM queries
        UNION ALL SELECT id, 'context', '{"queryText":"' || query_text || '","model":"' || model || '"}' FROM queries
        UNION ALL SELECT id, 'registration', '{"queryId":' || id || '}' FROM queries""",
    "decode_requests": "SELECT dataset, language, query_text, model, owner AS user FROM requests",
    "assign_ids": """SELECT dataset, language, query_text, model, owner AS user,
        (SELECT max(id) FROM queries)
        + row_number() OVER (ORDER BY dataset, language, query_text, model, owner) AS query_id FROM requests""",
    # Joins
    "queries_with_jobs": """SELECT id, dataset, language FROM queries
        WHERE id IN (SELECT query_id FROM fan)""",
    "fan_out": "SELECT query_id, name, language, md5 FROM fan",
    "merge_callbacks": f"""SELECT query_id, job_id, md5 AS data_id,
        CASE WHEN c.received_at IS NULL THEN 'pending' WHEN error_code IS NOT NULL THEN 'error'
             ELSE 'processed' END AS status,
        {_OUTCOME}, error_code, c.received_at AS finished_at
        FROM fan LEFT JOIN last_call c USING (job_id)""",
    "unknown_callbacks": f"""SELECT job_id, received_at,
        coalesce({_text_of('matches')}, md5('')) AS matches_md5, error_code
        FROM (SELECT * REPLACE (CASE WHEN minute(received_at) <> 7 THEN job_id END AS job_id) FROM callbacks)
        WHERE job_id IS NULL OR job_id NOT IN (SELECT job_id FROM fan)""",
    "job_rollup": """SELECT id AS query_id, count(job_id) AS total,
        count(*) FILTER (jobs.status = 'pending') AS pending,
        count(*) FILTER (jobs.status = 'processed') AS processed,
        count(*) FILTER (jobs.status = 'error') AS errors,
        count(*) FILTER (jobs.status = 'processed' AND matches IS NOT NULL) AS visible,
        max(finished_at) AS last_finished_at
        FROM queries LEFT JOIN jobs ON query_id = id GROUP BY id""",
    "attach_job_ids": f"""SELECT query_id, md5 AS data_id, job_id, seq, 'pending' AS status,
        {AS_OF} AS created_at FROM created""",
    "empty_acks": """SELECT DISTINCT query_id, batch_no FROM contexts
        WHERE in_batch = 1 AND (query_id + batch_no) % 3 = 2""",
    "queries_without_shards": """SELECT * FROM queries
        WHERE NOT EXISTS (SELECT 1 FROM catalog WHERE name = dataset AND catalog.language = queries.language)""",
    "delete_cascade": """SELECT id AS query_id, dataset, total FROM queries
        LEFT JOIN (SELECT query_id, count(*) AS total FROM fan GROUP BY query_id) ON query_id = id
        WHERE status IS NULL OR status <> 'pending'""",
    "orphan_jobs": """SELECT query_id, data_id, job_id, status FROM event_jobs
        WHERE query_id NOT IN (SELECT id FROM queries)""",
    # Aggregations
    "shard_count": """SELECT id AS query_id, count(md5) AS dataset_size FROM queries
        LEFT JOIN fan ON query_id = id GROUP BY id""",
    "dataset_stats": f"""SELECT language, data_type, name, count(*) AS total_objects,
        {AS_OF} AS created_at FROM catalog GROUP BY language, data_type, name""",
    "result_total": "SELECT query_id, count(*) AS total FROM fan GROUP BY query_id",
    "query_status": """SELECT id AS query_id, dataset,
        coalesce(done, 0) AS processed_records, created_at, language,
        (SELECT count(*) FROM catalog c WHERE c.name = dataset AND c.language = queries.language) AS dataset_size,
        coalesce(n, 0) AS query_results_count
        FROM queries LEFT JOIN (
            SELECT query_id, count(*) AS n, count(*) FILTER (status <> 'pending') AS done
            FROM jobs WHERE job_id IN (SELECT job_id FROM created) GROUP BY query_id) ON query_id = id""",
    "query_counters": """SELECT id AS query_id, coalesce(published, 0) AS published,
        coalesce(jobs_created, 0) AS jobs_created, coalesce(callbacks_accepted, 0) AS callbacks_accepted,
        coalesce(jobs_finished, 0) AS jobs_finished
        FROM queries
        LEFT JOIN (SELECT query_id, count(*) AS published FROM contexts GROUP BY query_id) p
            ON p.query_id = id
        LEFT JOIN (SELECT query_id, count(DISTINCT created.job_id) AS jobs_created,
                          count(received_at) AS callbacks_accepted,
                          count(DISTINCT callbacks.job_id) AS jobs_finished
                   FROM created LEFT JOIN callbacks USING (job_id) GROUP BY query_id) j
            ON j.query_id = id""",
    "ingest_report": """SELECT count(*) AS listed, count(parsed.key) AS processed,
        count(*) - count(parsed.key) AS errors,
        (SELECT count(DISTINCT md5) FROM parsed WHERE md5 NOT IN (SELECT md5 FROM known)) AS inserted
        FROM listing LEFT JOIN (SELECT DISTINCT key FROM parsed) parsed USING (key)""",
    "running_stats": """SELECT language, data_type, name, count(*) AS objects, CAST(0 AS BIGINT) AS records,
        CAST(sum(byte_size) AS BIGINT) AS bytes
        FROM (SELECT language, data_type, name, byte_size FROM known
              UNION ALL SELECT language, data_type, name, byte_size FROM catalog
              WHERE md5 NOT IN (SELECT md5 FROM known))
        WHERE language <> 'de' GROUP BY language, data_type, name""",
    "progress": """SELECT query_id, count(*) AS total,
        count(*) FILTER (jobs.status = 'processed' AND matches IS NOT NULL) AS visible,
        count(*) FILTER (jobs.status = 'processed') AS processed,
        count(*) FILTER (jobs.status = 'error') AS errors
        FROM queries JOIN jobs ON query_id = id WHERE queries.status <> 'pending' GROUP BY query_id""",
    # Order and limit
    "batch_number": "SELECT query_id, md5, seq, batch_no, pos FROM contexts",
    "results_page": f"""SELECT query_id, nth // 5 + 1 AS page, CAST(nth % 5 AS INTEGER) AS pos, job_id, data_id,
        {_text_of('matches')} AS matches_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY data_id) - 1 AS nth FROM visible)""",
    "stable_pages": f"""SELECT query_id, nth // 5 + 1 AS page, CAST(nth % 5 AS INTEGER) AS pos, job_id, data_id,
        {_text_of('matches')} AS matches_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY minute(finished_at) % 2, data_id) - 1 AS nth
              FROM visible)""",
    "last_key": "SELECT name, data_type, max(key) AS last_key FROM catalog GROUP BY name, data_type",
    "last_key_overall": f"""SELECT key AS last_key FROM catalog
        ORDER BY {AS_OF} - to_days(CAST(byte_size % 5 AS INTEGER)) DESC, key DESC LIMIT 1""",
    "page_summary": """SELECT query_id, total, visible_total, page, CAST(5 AS INTEGER) AS page_size,
        total > page * 5 AS has_more
        FROM (SELECT query_id, total, visible_total, unnest(range(1, (total + 4) // 5 + 1)) AS page
              FROM (SELECT query_id, count(*) AS total,
                           count(*) FILTER (status = 'processed' AND matches IS NOT NULL) AS visible_total
                    FROM jobs GROUP BY query_id))""",
    # Keyed writes
    "catalog_insert_ignore": f"""SELECT {_ROW}, {EARLIER} AS created_at FROM known
        UNION ALL SELECT {_ROW}, {AS_OF} FROM catalog WHERE md5 NOT IN (SELECT md5 FROM known)""",
    "clustered_writes": f"""SELECT * REPLACE (CAST(CASE WHEN language = 'fr' THEN 1 ELSE 0 END AS INTEGER) AS num_of_records)
        FROM (SELECT {_ROW}, {EARLIER} AS created_at FROM known
              UNION ALL SELECT {_ROW}, {AS_OF} FROM catalog WHERE md5 NOT IN (SELECT md5 FROM known))
        WHERE language <> 'es' AND byte_size % 10 <> 0""",
    "stats_upsert": f"""SELECT language, data_type, name, count(*) AS total_objects, {AS_OF} AS created_at
        FROM catalog GROUP BY language, data_type, name
        UNION ALL SELECT language, data_type, name, total_objects, {EARLIER} FROM old_stats o
        WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.language = o.language
                          AND c.data_type = o.data_type AND c.name = o.name)""",
    "incremental_load": f"""SELECT {_ROW}, {EARLIER} AS created_at FROM known
        UNION ALL
        SELECT {_PARSED_ROW}, {AS_OF} FROM (
            SELECT parsed.*, row_number() OVER (PARTITION BY md5 ORDER BY parsed.key) AS nth
            FROM parsed JOIN (SELECT DISTINCT key {_LISTED} WHERE key > coalesce(start_after, '')) USING (key)
            WHERE md5 NOT IN (SELECT md5 FROM known)) WHERE nth = 1""",
    "load_rejects": """SELECT DISTINCT key, size, CASE WHEN len(p) < 4 THEN 'key: fewer than 4 parts'
        ELSE 'language: too wide' END AS reasons
        FROM (SELECT *, string_split(key, '/') AS p FROM (
            SELECT CASE WHEN size % 9 = 0 THEN 'src0/text/a-language-too-wide/' || key ELSE key END AS key, size
            FROM listing))
        WHERE len(p) < 4 OR length(p[3]) > 10""",
    # Constraints
    "not_null_rejects": """SELECT doc_id, md5(text) AS md5, CAST(0 AS INTEGER) AS num_of_records, '' AS source,
        concat_ws('; ', CASE WHEN quality IS NULL THEN 'name: missing' END,
                  CASE WHEN toxic = 1 THEN 'language: missing' END) AS reasons
        FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1""",
    "width_rejects": """SELECT page_id, reasons FROM (
        SELECT page_id, concat_ws('; ',
            CASE WHEN length(html) > 255 THEN 'name: too wide' END,
            CASE WHEN length(p[-1]) > 10 THEN 'language: too wide' END,
            CASE WHEN length(url) > 50 THEN 'data_type: too wide' END,
            CASE WHEN length(p[3]) > 32 THEN 'md5: too wide' END) AS reasons
        FROM (SELECT *, string_split(url, '/') AS p FROM pages)) WHERE reasons <> ''""",
    "status_domain_rejects": """SELECT query_id, job_id, status, 'status: not allowed' AS reasons
        FROM event_jobs WHERE status NOT IN ('pending', 'processed', 'error')""",
    "unique_violations": """SELECT md5(text) AS md5, count(*) AS "count" FROM documents
        GROUP BY md5(text) HAVING count(*) > 1""",
    # Nested values and the classifier
    "explode_matches": """SELECT query_id, job_id, m.uri AS uri, m.text AS text
        FROM (SELECT query_id, job_id, unnest(matches) AS m FROM jobs)""",
    "classify_labels": f"""SELECT job_id, CAST(len(hits) AS INTEGER) AS n_matches,
        {_text_of('hits')} AS matches_md5, error_message
        FROM (SELECT job_id, CASE WHEN l.toxic = 1 THEN 'ValueError: toxic' END AS error_message,
                CASE WHEN l.toxic <> 1 AND l.quality = 1 THEN
                    list_filter(list_transform(string_split(d.text, chr(10)),
                        lambda line, i: {{'uri': d.doc_id || '#' || (i - 1), 'text': line}}),
                        lambda m: trim(m.text, ' ') <> '')
                ELSE [] END AS hits
              FROM fan f JOIN docs d USING (doc_id) LEFT JOIN labels l USING (doc_id))""",
    "decode_callbacks": f"""SELECT job_id, coalesce({_text_of('matches')}, md5('')) AS matches_md5, error_code
        FROM callbacks""",
    "request_messages": """SELECT query_id, batch_no, '{"data":[' || string_agg(
        '{"dataUrl":"' || key || '","batchSize":0,"bytesize":' || byte_size
        || ',"decompressedByteSize":0,"checksumMd5":"' || md5 || '","classifierId":' || query_id || '}',
        ',' ORDER BY pos) || ']}' AS body FROM contexts GROUP BY query_id, batch_no""",
    "page_messages": """SELECT query_id, page, CAST(-1 AS INTEGER) AS pos, '{"total":' || total || ',"page":' || page
        || ',"pageSize":5,"has_more":' || CASE WHEN total > page * 5 THEN 'true' ELSE 'false' END || '}' AS body
        FROM (SELECT query_id, total, unnest(range(1, (total + 4) // 5 + 1)) AS page
              FROM (SELECT query_id, count(*) AS total FROM jobs GROUP BY query_id))
        UNION ALL
        SELECT query_id, nth // 5 + 1, CAST(nth % 5 AS INTEGER), '{"results":[' || array_to_string(
            list_transform(matches, lambda m: '{"uri":"' || m.uri || '","text":' || to_json(m.text) || '}'), ',') || ']}'
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY data_id) - 1 AS nth FROM visible)""",
    # Streams
    "callback_stream": f"""SELECT query_id, job_id, md5 AS data_id,
        CASE WHEN c.received_at IS NULL THEN 'pending' WHEN error_code IS NOT NULL THEN 'error'
             ELSE 'processed' END AS status, {_OUTCOME}, error_code, c.received_at AS finished_at
        FROM fan LEFT JOIN last_call c USING (job_id)""",
    "read_callbacks": f"""SELECT CASE WHEN kind IN ('', 'error code is missing') THEN CASE WHEN kind = '' THEN job_id ELSE 'half' END END AS job_id,
        kind AS reasons FROM odd_lines""",
    "job_deadlines": f"""SELECT job_id, CASE WHEN c.received_at IS NULL THEN 'overdue'
        WHEN error_code IS NOT NULL THEN 'error' ELSE 'processed' END AS status,
        CASE WHEN fan.md5 IS NOT NULL THEN {AS_OF} + INTERVAL 7 DAY END AS deadline, c.received_at AS finished_at
        FROM fan FULL JOIN last_call c USING (job_id)""",
    "stream_rejects": """SELECT CASE WHEN kind = 'error code is missing' THEN 'half' END AS job_id, kind AS reasons
        FROM odd_lines WHERE kind <> ''""",
    "listing_stream_rejects": """SELECT key, size, 'key: fewer than 4 parts' AS reasons FROM cut WHERE len(p) < 4""",
    "live_listing": """SELECT source AS name, lang AS language, CASE WHEN doc_id % 5 = 0 THEN '_hidden' ELSE 'text' END
        AS data_type, CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || md5(CAST(doc_id AS VARCHAR)) AS md5,
        CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 100 END AS BIGINT) AS byte_size FROM documents
        WHERE length(CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || md5(CAST(doc_id AS VARCHAR))) <= 32""",
    "load_report": f"""SELECT count(*) AS listed, count(parsed.key) AS parsed, count(*) - count(parsed.key) AS rejected,
        (SELECT count(DISTINCT md5) FROM parsed WHERE md5 NOT IN (SELECT md5 FROM known)) AS inserted
        {_LISTED} LEFT JOIN (SELECT DISTINCT key FROM parsed) parsed ON parsed.key = listing.key""",
    "listing_stream": "SELECT DISTINCT md5 FROM parsed",
}

ORACLE = {name: _with_inputs(body) for name, body in BODIES.items()}
