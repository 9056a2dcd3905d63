"""The thin queries over whole tables, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import chat, decontam, langid, ngram_join, packing, pii, quality, secrets, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"), 24)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_tokenizer() -> str:
    """The word-level tokenizer file of this machine; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), 2048)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), n=3, threshold=(9, 10))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.report(given.unionByName(extra))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sharding, op3_secrets, op4_quality, op5_packing, op6_warc, op7_ngram_join, op8_decontamination, op9_langid, op10_chat)}
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORD = decontam.ITEM_WORD



def _found(name: str, pattern: str, keep: str, text: str = "text") -> str:
    """SQL for the matches of pattern in table `t` (doc, text) that keep holds for: doc, m, s, e, one row each."""
    return rf"""
        {name}_all AS (SELECT doc, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM t),
        {name}_rows AS (SELECT doc, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g[1 : len(m)]) AS g FROM {name}_all WHERE len(m) > 0),
        {name}_each AS (SELECT doc, m, sum(length(g) + length(m)) OVER (PARTITION BY doc ORDER BY i) - length(m) AS s FROM {name}_rows),
        {name} AS (SELECT doc, m, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM {name}_each WHERE {keep})"""


_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SQL: dict[str, str] = {
    "op3_secrets": rf"""
        WITH t AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
        {_found("assign", _ASSIGN, f"length(regexp_extract(m, '^{_ASSIGN}$', 1)) >= 8")},
        {_found("access", "AKIA[A-Z0-9]+", "length(m) >= 16")},
        {_found("hex", "[0-9a-f]{32,}", "true")},
        {_found("pem", "-----BEGIN [A-Z ]{{0,32}}PRIVATE KEY-----[A-Za-z0-9+/=[:space:]]*".replace("{{", "{").replace("}}", "}"), "true")},
        spans AS (SELECT doc, s, 0 AS k, e, 'assign' AS kind FROM assign UNION ALL SELECT doc, s, 1, e, 'access' FROM access
                  UNION ALL SELECT doc, s, 2, e, 'hex' FROM hex UNION ALL SELECT doc, s, 3, e, 'pem' FROM pem),
        by_doc AS (SELECT doc, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_pem,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_pem, 0) AS n_pem
        FROM t LEFT JOIN by_doc USING (doc)
    """,
    "op1_pii": rf"""
        WITH RECURSIVE t AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
        {_found("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "true")},
        {_found("ip", "[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")},
        {_found("card", "[0-9](?:[ -]?[0-9])+", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) WHEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) > 4 THEN 2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) - 9 ELSE 2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) END)) % 10 = 0")},
        {_found("phone", "[+][0-9][ ().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15")},
        {_found("word", r"\p{L}{3,}", "true")},
        base AS (SELECT *, 0 AS k, 'email' AS kind, lower(m) AS v, lower(regexp_extract(m, '@(.*)', 1)) AS w FROM email
                 UNION ALL SELECT *, 1, 'ip', m, regexp_extract(m, '(.*)[.]', 1) FROM ip
                 UNION ALL SELECT *, 2, 'card', regexp_replace(m, '[^0-9]', '', 'g'), left(regexp_replace(m, '[^0-9]', '', 'g'), 8) FROM card
                 UNION ALL SELECT *, 3, 'phone', regexp_replace(m, '[^0-9]', '', 'g'), regexp_replace(m, '[^0-9]', '', 'g')[1 : -5] FROM phone),
        first AS (SELECT min(doc) AS doc, text FROM t GROUP BY text),
        n AS (SELECT count(*) AS n FROM first),
        ents AS (SELECT doc, s, e, kind, unnest([kind || ' 0 ' || v, kind || ' 1 ' || w]) AS c FROM base JOIN first USING (doc)),
        free AS (SELECT doc, s, e, lower(m) AS term FROM word WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = word.doc AND word.s < b.e AND word.e > b.s)),
        df_c AS (SELECT c, count(DISTINCT doc) AS n_c FROM ents GROUP BY c),
        df_t AS (SELECT lower(m) AS term, count(DISTINCT doc) AS n_t FROM word JOIN first USING (doc) GROUP BY ALL),
        near AS (SELECT DISTINCT f.doc, c, kind, term FROM free f JOIN ents x ON f.doc = x.doc AND f.s < x.e + 32 AND f.e > x.s - 32),
        pairs AS (SELECT c, term, any_value(kind) AS kind, count(*) AS n_ct FROM near GROUP BY c, term),
        rated AS (SELECT c, term, kind, n_ct, ln(n / n_c) AS ic, ln(CAST(n AS DOUBLE) * n_ct / (n_c * (n_t + 1.0::DOUBLE / n_ct))) AS pmi
                  FROM pairs JOIN df_c USING (c) JOIN df_t USING (term) CROSS JOIN n WHERE n_c < n),
        strong AS (SELECT *, CASE WHEN pmi >= 0.98 * ic THEN 'remove' ELSE 'generalise' END AS action FROM rated WHERE pmi >= 0.85 * ic),
        risk AS (SELECT doc, term, action FROM near JOIN strong USING (c, term) WHERE n_ct < 3
                 UNION ALL SELECT DISTINCT first.doc, term, action FROM word JOIN first USING (doc) JOIN strong ON term = lower(m) WHERE n_ct >= 3),
        told AS (SELECT doc, term, max(action) AS action FROM risk GROUP BY ALL),
        terms AS (SELECT doc, count(*) FILTER (action = 'remove') AS n_removed, count(*) FILTER (action = 'generalise') AS n_generalised, string_agg('term:' || s || ':' || e, ',' ORDER BY s) AS terms
                  FROM free JOIN told USING (doc, term) GROUP BY doc),
        by_doc AS (SELECT doc, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS base FROM base GROUP BY doc)
        SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256,
               concat_ws(',', base, terms) AS spans, coalesce(n_removed, 0) AS n_removed, coalesce(n_generalised, 0) AS n_generalised
        FROM t JOIN first USING (text) LEFT JOIN terms ON terms.doc = first.doc LEFT JOIN by_doc ON by_doc.doc = t.doc
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, url
        FROM f
    """,
    "op7_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        walk AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, walk.root FROM walk JOIN e ON e.a = walk.node)
        SELECT node AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id FROM walk LEFT JOIN n ON n.doc_id = node GROUP BY node
    """,
    "op8_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{ITEM_WORD}') AS w FROM documents),
        i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOW}, '{ITEM_WORD}') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
               FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT doc_id, k, n, item FROM dw JOIN bw USING (n, g)),
        places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hit) GROUP BY ALL),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY ALL),
        win AS (SELECT g, list_distinct(string_split(g, ' ')) AS t FROM (SELECT DISTINCT g FROM bw)),
        wt AS (SELECT g, len(t) AS n, unnest(t) AS term FROM win),
        dt AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM d),
        able AS (SELECT doc_id, g FROM dt JOIN wt USING (term) GROUP BY doc_id, g, n HAVING count(*) = n),
        rare AS (SELECT g, arg_min(term, times) AS term FROM wt JOIN (SELECT term, count(*) AS times FROM dt GROUP BY ALL) AS f USING (term) GROUP BY g),
        pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS term FROM d),
        spot AS (SELECT able.doc_id, g, unnest(range(greatest(1, k - 23), k + 1)) AS k FROM able JOIN rare USING (g) JOIN pos ON pos.doc_id = able.doc_id AND pos.term = rare.term),
        close AS (SELECT DISTINCT doc_id, g FROM spot JOIN d USING (doc_id) JOIN win USING (g) WHERE list_has_all(w[k : k + 23], t)),
        near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM close JOIN bw USING (g) GROUP BY ALL)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
        FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op10_chat": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        f AS (SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### '), ':', '\:')) + 2
                     + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ')) + 8 AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id
    """,
}
