"""DuckDB SQL for the registered queries, by name."""

from . import documents

SQL = {
    "bigram_counts": """
        SELECT bigram, count(*) AS n
        FROM (SELECT unnest(list_transform(range(1, length(text)), lambda i: substring(text, i::INT, 2))) AS bigram
              FROM documents WHERE length(text) > 1)
        GROUP BY bigram
    """,
    "string_edits": """
        SELECT p_partkey, substring(p_name, 1, 3) || '<+>' || substring(p_name, 4) AS inserted,
               substring(p_name, 1, 2) || substring(p_name, 6) AS erased, substring(p_name, 1, 1) || '##' || substring(p_name, 4) AS spliced,
               (strpos(substring(p_name, 3), 'e') - 1)::INT AS e_at,
               (CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) ELSE -1 END)::INT AS vowel_at,
               regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked
        FROM part
    """,
    "string_splits": """
        SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda x: x <> ''), '|') AS words, len(string_split(url, '/')) AS n_parts,
               (strpos(url, '?') > 0)::BIGINT AS found, split_part(url, '?', 1) AS l,
               CASE WHEN strpos(url, '?') > 0 THEN substring(url, strpos(url, '?') + 1) ELSE '' END AS r
        FROM pages
    """,
    "string_joins": """
        SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'x,' END || p_brand || ',,' || p_type AS joined FROM part
    """,
    "string_folds": """
        SELECT conv_id, turn, trim(s, E' \\t\\r\\n\\f\\v') AS trimmed, lower(s) AS low, true AS same
        FROM (SELECT conv_id, turn, E' \\t' || text || E'\\n ' AS s FROM conversations)
    """,
    "string_escapes": """
        SELECT p_partkey, '\\"' || p_name || '\\\\\\t\\"\\n' AS escaped, true AS round_trip FROM part
    """,
    "path_parts": """
        SELECT page_id, 'C:' AS drive, regexp_extract(p, '^(.*/)', 1) AS dir, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '') AS name,
               '.html' AS ext, regexp_extract(p, '([^/]*)$', 1) AS file
        FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') || '.html' AS p FROM pages)
    """,
    "text_lines": """
        SELECT doc_id, length(h) - length(replace(h, E'\\n', '')) + 1 AS line, length(regexp_replace(text, '[^a-z ]', '', 'g')) AS n_known,
               length(regexp_replace(text, '[a-z ]', '', 'g')) AS n_unknown
        FROM (SELECT doc_id, text, substring(text, 1, length(text) // 2) AS h FROM documents)
    """,
    "space_collapse": """
        SELECT conv_id, turn, length(s) AS n, md5(s) AS digest
        FROM (SELECT conv_id, turn,
                     array_to_string(list_transform(list_filter(range(1, length(text) + 1),
                       lambda i: NOT (substring(text, i::INT, 1) = ' ' AND i > 1 AND contains(E' ,.!?:;-\\n\\x07\\t', substring(text, (i - 1)::INT, 1)))),
                       lambda i: substring(text, i::INT, 1)), '') AS s
              FROM conversations)
    """,
    "number_parsing": """
        SELECT l_orderkey, l_linenumber, literal,
               (CASE k WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN l_partkey % 40000 > 32767 THEN 65536 ELSE 0 END WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 4 THEN -1 WHEN 5 THEN 65536 ELSE 0 END)::BIGINT AS status,
               (CASE k WHEN 0 THEN l_linenumber WHEN 1 THEN CASE WHEN l_partkey % 40000 <= 32767 THEN l_partkey % 40000 END WHEN 2 THEN -32768 WHEN 6 THEN -150 END)::BIGINT AS value
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 7 AS k,
                     CASE l_orderkey % 7 WHEN 0 THEN l_linenumber::VARCHAR WHEN 1 THEN '0x' || lower(to_hex(l_partkey % 40000)) WHEN 2 THEN '-32.768E3'
                       WHEN 3 THEN '12a' || l_linenumber WHEN 4 THEN '' WHEN 5 THEN '70000' ELSE '-1.5e2' END AS literal FROM lineitem)
    """,
    "number_formats": """
        SELECT l_orderkey, l_linenumber, printf('%05d|%x|%X', l_partkey, l_partkey, l_partkey) AS ints,
               printf('%8.2f|%-10s|%5s', l_quantity, l_returnflag, l_linestatus) AS mixed, (4294967296 - l_partkey) % 4294967296 AS unsigned, bit_count(l_partkey)::BIGINT AS ones,
               (CASE WHEN l_partkey > 255 THEN 65536 WHEN l_partkey < 0 THEN 65537 ELSE 0 END)::BIGINT AS to_byte, sign(l_quantity - 25)::BIGINT AS cmp
        FROM lineitem
    """,
    "hash_digests": """
        SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha256, md5(unhex(md5(unhex(md5(c_name))))) AS md5_thrice,
               substring(md5(c_name) || md5(unhex(md5(c_name))), 1, 48) AS stretched
        FROM customer
    """,
    "framed_payloads": "SELECT c_custkey, md5(c_name) AS digest, true AS ok, c_name AS payload FROM customer",
    "time_formats": """
        SELECT event_id, strftime(ts, '%Y.%m.%d %H:%M:%S:') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 4, '0') AS long_form,
               strftime(ts, '%d.%m.%y ') || right(hour(ts)::VARCHAR, 1) || '-' || right(minute(ts)::VARCHAR, 1) AS short_form, isodow(ts)::BIGINT AS weekday
        FROM events
    """,
    "time_parsing": """
        SELECT o_orderkey, epoch_ms(date_trunc('second', o_orderdate)) AS millis, epoch_ms(date_trunc('second', o_orderdate)) - 9000000 AS zoned FROM orders
    """,
    "json_path_get": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
    "json_kinds": """
        SELECT '' AS path, 'object' AS kind, count(*) AS n FROM events
        UNION ALL SELECT 'k', 'int', count(*) FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
    """,
    "loose_config": """
        SELECT p_partkey, p_name AS name, p_size::BIGINT AS size, 'b' AS tag, round(p_retailprice, 2) AS price, 7::BIGINT AS n_nodes FROM part
    """,
    "tree_differences": """
        SELECT a.event_id, 'k' AS path, CASE WHEN b.event_id IS NULL THEN 'missing' ELSE 'value' END AS what
        FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1
        WHERE json_extract_string(a.props, '$.k') IS DISTINCT FROM json_extract_string(b.props, '$.k')
        UNION ALL SELECT a.event_id, '', 'missing' FROM events a LEFT JOIN events b ON b.event_id = a.event_id + 1 WHERE b.event_id IS NULL
    """,
    "ini_sections": """
        SELECT p_partkey, 0::BIGINT AS line, '' AS section, 'root' AS name, p_size::VARCHAR AS value FROM part
        UNION ALL SELECT p_partkey, 3, p_brand, 'name', trim(p_name) FROM part
        UNION ALL SELECT p_partkey, 4, p_brand, 'type', trim(p_type) FROM part
        UNION ALL SELECT p_partkey, 6, 'end', 'last', '1' FROM part
    """,
    "variable_expansion": "SELECT p_partkey, 'a-part/%unknown%/100%/' || p_name AS expanded FROM part",
    "command_words": "SELECT p_partkey, 4::BIGINT AS n, '-n=' || p_name AS named FROM part",
    "ideal_code_bits": """
        SELECT ch, n, round(-log2(n / sum(n) OVER ()), 6) AS bits
        FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations) WHERE ch <> '' GROUP BY ch)
    """,
    "array_edits": """
        SELECT p_partkey, concat_ws(',', p_size, 7, length(p_name), 9) AS pushed, concat_ws(',', p_size, 7) AS popped,
               (CASE WHEN p_size = 7 THEN 0 ELSE 1 END)::BIGINT AS found, concat_ws(',', p_size, 0, 7, length(p_name)) AS inserted
        FROM part
    """,
}

SQL |= documents.SQL
