"""One query per operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .centroids import centroid_clusters
from .exact_dedup import exact_dedup
from .fertility import quality_rules
from .line_dedup import remove_repeated_lines
from .mixing import mix_sources
from .near_dedup import near_duplicate_classes
from .packing import pack_documents
from .pii import detect_personal_data
from .spelling import spelling_forms
from .substring_dedup import remove_repeated_passages
from .token_files import read_token_files, write_token_files
from .tool_calls import calls_of_turns, link_tool_calls
from .url_filter import judge_urls, rule_table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(_documents(spark, sf_dir))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken", "n_slots", F.array_min("slots").alias("first_slot"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(_documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_passages(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tool_calls(calls, results, {"reply": {"text": ("string", True), "size": ("integer", True)}})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_documents(spark, sf_dir)).drop("version")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_personal_data(_documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, URL_RULES))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mix": op1_source_mix,
        "op2_line_dedup": op2_line_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_fertility": op5_fertility,
        "op6_tool_calls": op6_tool_calls,
        "op7_packing": op7_packing,
        "op8_near_dedup": op8_near_dedup,
        "op9_token_files": op9_token_files,
        "op10_personal_data": op10_personal_data,
        "op11_centroids": op11_centroids,
        "op12_url_filter": op12_url_filter,
        "op13_spelling": op13_spelling,
    }


def _kmeans_sql(k: int, rounds: int) -> str:
    """The rounds spelt out one by one: every vector's nearest centroid, then the floor of the means."""
    steps = [
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k})"
    ]
    for r in range(rounds + 1):
        steps.append(f"""
            a{r} AS MATERIALIZED (
                SELECT vec_id, v, first(c ORDER BY d, c) AS c, min(d) AS d FROM (
                    SELECT n, vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}
                ) GROUP BY n, vec_id, v
            )""")
        if r < rounds:
            steps.append(f"""
            m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
                SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
            c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), {",".join(steps)}
        SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (c)
    """


_KMEANS = _kmeans_sql(40, 5)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": r"""
            WITH l AS (
                SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
                FROM documents
            ), counted AS (
                SELECT doc_id, i, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS counts FROM l
            ), numbered AS (
                SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM counted WHERE counts
            ), windows AS (
                SELECT doc_id, k, line, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k)
            ), later AS (
                SELECT doc_id, k FROM windows WHERE l3 IS NOT NULL
                QUALIFY row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, k) > 1
            ), gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 3)) AS k FROM later),
            marked AS (
                SELECT c.doc_id, c.i, c.line, c.counts, g.k IS NOT NULL AS is_gone
                FROM counted c LEFT JOIN numbered n USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.k = n.k
            )
            SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (is_gone) AS n_removed,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT is_gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id
        """,
        "op6_tool_calls": """
            WITH RECURSIVE t AS (
                SELECT *, last_value(CASE WHEN role = 'user' THEN turn::VARCHAR END IGNORE NULLS)
                    OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call_id
                FROM conversations
            ), answers AS (
                SELECT conv_id, call_id, count(*) AS n, first(text ORDER BY turn, text) AS result
                FROM t WHERE role IS DISTINCT FROM 'user' AND call_id IS NOT NULL GROUP BY 1, 2
            ), calls AS (
                SELECT conv_id, call_id, turn AS position, text, length(coalesce(text, '')) AS size, contains(text, chr(10)) AS has_lines,
                       CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN lead(call_id) OVER w ELSE lag(call_id) OVER w END AS needs
                FROM t WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
            ), late AS (
                SELECT DISTINCT c.conv_id FROM calls c JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = c.needs AND d.position >= c.position
            ), reached AS (
                SELECT conv_id, call_id, 0 AS level FROM calls WHERE needs IS NULL
                UNION ALL
                SELECT c.conv_id, c.call_id, r.level + 1 FROM reached r JOIN calls c ON c.conv_id = r.conv_id AND c.needs = r.call_id
            ), placed AS (
                SELECT c.*, CASE WHEN late.conv_id IS NULL THEN 0 ELSE level END AS level
                FROM calls c LEFT JOIN reached USING (conv_id, call_id) LEFT JOIN late ON late.conv_id = c.conv_id
            ), numbered AS (
                SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, position) AS topo_order FROM placed
            )
            SELECT conv_id, call_id, position, topo_order, coalesce(n, 0) AS n_results, n IS NOT NULL AS linked, text IS NOT NULL AND NOT has_lines AS valid, level IS NULL AS cyclic,
                   json_object('arguments', CASE WHEN has_lines THEN json_object('size', size::VARCHAR, 'text', text) ELSE json_object('size', size, 'text', text) END, 'call_id', call_id,
                               'name', 'reply', 'result', result, 'turn', topo_order, 'valid', text IS NOT NULL AND NOT has_lines)::VARCHAR AS record
            FROM numbered LEFT JOIN answers USING (conv_id, call_id)
        """,
        "op3_substring_dedup": r"""
            WITH t AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
            ), starts AS (
                SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM t
            ), windows AS (
                SELECT doc_id, i, list_slice(words, i, i + 12) AS w FROM starts
            ), firsts AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
            gone AS (
                SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (w) WHERE first_id < doc_id
            ), every_word AS (
                SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM t
            ), kept AS (
                SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS s FROM every_word ANTI JOIN gone USING (doc_id, i) GROUP BY 1
            )
            SELECT t.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
                   sha256(coalesce(s, '')) AS kept_sha256
            FROM t LEFT JOIN kept USING (doc_id)
        """,
        "op4_exact_dedup": """
            WITH t AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                FROM documents
            ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
        """,
        "op11_centroids": _KMEANS,
        "op12_url_filter": r"""
            WITH u AS (
                SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
                FROM pages
            ), r(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
            urls AS (SELECT DISTINCT host, path FROM u),
            best AS (
                SELECT host, path, arg_max(struct_pack(rule := h || p, action := action), length(h || p)) AS found
                FROM urls JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
            )
            SELECT page_id, u.host, u.path, found.rule AS rule, coalesce(found.action, 'allow') AS verdict
            FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
        """,
        "op13_spelling": r"""
            WITH RECURSIVE bits AS (
                SELECT range AS b, range AS c, 0 AS k FROM range(256)
                UNION ALL
                SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
            ), crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
            runs AS (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
            ), counted AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs GROUP BY ALL),
            hashed AS (
                SELECT w, n, xor(list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
                    lambda h, c: xor(h >> 8, t[(xor(h, c) & 255) + 1])), 4294967295::BIGINT) AS h
                FROM counted, crc
            ), words AS (
                SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
            ), v AS MATERIALIZED (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
            less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
            near AS (
                SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
                UNION
                SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.d = b.word
                UNION
                SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.d = b.word
            ), best AS (SELECT word, count(*) AS n_near, max(n) AS most, first(other ORDER BY n DESC, other) AS other FROM near GROUP BY word),
            forms AS MATERIALIZED (
                SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN other END AS form, CASE WHEN most >= 10 * v.n THEN most END AS form_n
                FROM v LEFT JOIN best USING (word)
            ), walk AS (
                SELECT word, word AS root, form AS nxt FROM forms
                UNION ALL
                SELECT walk.word, walk.nxt, f.form FROM walk JOIN forms f ON f.word = walk.nxt
            )
            SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.nxt IS NULL
        """,
    }
