"""Queries of this subpackage's operators on the test tables, with the SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import (
    bpe,
    conversations,
    fingerprints,
    fixity,
    license_scan,
    mixing,
    order,
    partial_matching,
    quality_classifier,
    quality_rules,
    simhash,
    tool_calls,
    url_filter,
    vector_codes,
)
from stockloom.llm.registry import ORACLES, QUERIES, query, table
from stockloom.operators.scans import materialize

__all__ = ["ORACLES", "QUERIES"]


#: Fixed values of the query: rules on the hosts and paths of the pages.
URL_RULES = (
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
)


def _url_sql() -> str:
    """The rules as a table, the aliases as reachability over the same edges."""
    rules = ", ".join(f"('{r.action}', '{r.pattern}', '{r.host}', '{r.path}')" for r in URL_RULES)
    upper, lower = url_filter.ascii_uppercase, url_filter.ascii_lowercase
    part = lambda u, g: f"coalesce(regexp_extract({u}, '{url_filter.URL}', {g}), '')"
    low = lambda x: f"translate({x}, '{upper}', '{lower}')"
    quoted = lambda p: p.replace("'", "''")
    host = lambda u: low(part(u, 2))
    path = lambda u: part(u, 3)
    key = lambda u: (
        f"CASE WHEN contains({u}, '://') THEN {low(part(u, 1))} || '://' || {host(u)} || "
        f"CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END || regexp_extract({u}, '{url_filter.QUERY}', 1) END"
    )
    folder = f"regexp_extract({path('url')}, '(?s)^(.*/)', 1)"
    site = f"{part('url', 1)} || '://' || {part('url', 2)}"
    full = f"""CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
        WHEN starts_with(link, '//') THEN {part('url', 1)} || ':' || link
        WHEN starts_with(link, '/') THEN {site} || link
        WHEN starts_with(link, '?') THEN {site} || {path('url')} || link
        WHEN starts_with(link, '#') OR regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
        ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || link END"""
    tags = lambda tag, attribute: (
        f"list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '{quoted(tag)}'), "
        f"lambda t: regexp_extract(t, '{quoted(attribute)}', 1))"
    )
    hit = "(h = rule_host OR ends_with(h, '.' || rule_host)) AND starts_with(p, rule_path)"
    return f"""
WITH RECURSIVE rules(action, pattern, rule_host, rule_path) AS (VALUES {rules}),
links AS (
    SELECT url, replace(unnest({tags(url_filter.CANONICAL, url_filter.HREF)}
        || {tags(url_filter.REFRESH, url_filter.TARGET)}), '&amp;', '&') AS link
    FROM pages WHERE html ILIKE '%canonical%' OR html ILIKE '%refresh%'
),
targets AS (SELECT url, {full} AS target FROM links WHERE link <> ''),
edges AS (
    SELECT DISTINCT a, b FROM (SELECT {key('url')} AS a, {key('target')} AS b FROM targets)
    WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b
),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS node, {host('b')} AS h, {path('b')} AS p FROM reach),
blocked AS (
    SELECT node FROM nodes, rules WHERE {hit} GROUP BY node HAVING arg_max(action, length(pattern)) = 'block'
),
spread AS (SELECT DISTINCT a AS node FROM reach WHERE b IN (SELECT node FROM blocked)),
parts AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {key('url')} AS node FROM pages),
urls AS (SELECT DISTINCT host AS h, path AS p FROM parts),
ruled AS (
    SELECT h, p, arg_max(pattern, length(pattern)) AS rule, arg_max(action, length(pattern)) AS action
    FROM urls, rules WHERE {hit} GROUP BY h, p
)
SELECT page_id, host, path, rule,
    coalesce(action, CASE WHEN node IN (SELECT node FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN ruled ON host = h AND path = p
"""


@query("op1_url_filter", _url_sql())
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; aliases come from the pages' redirects and canonical links."""
    judged = url_filter.judge(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and field on every document; the field learns from labels of documents not held out."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    field = quality_rules.train(documents, labels.filter(~quality_classifier.held_out()))
    judged = quality_rules.apply_rules(documents, field, keep=["doc_id"])
    return judged.drop("boilerplate_lines")


def _license_sql() -> str:
    templates = ", ".join(
        "('{}', {}, {}, {}, [{}])".format(name, len(pairs), *license_scan.size_bounds(len(pairs)), ", ".join(f"'{p}'" for p in pairs))
        for name, pairs in ((n, license_scan.template_bigrams(t)) for n, t in license_scan.TEMPLATES.items())
    )
    return f"""
WITH templates(name, n, low, high, pairs) AS (VALUES {templates}),
flat AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_replace(translate(coalesce(text, ''), '{license_scan.ascii_uppercase}', '{license_scan.ascii_lowercase}'),
            '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t
    FROM documents
),
units AS (
    SELECT DISTINCT row, trim(regexp_replace(unit, '[ \\n]+', ' ', 'g')) AS unit FROM (
        SELECT row, unnest(string_split(t, chr(10)) || regexp_split_to_array(t, '\\n *\\n') || [t]) AS unit FROM flat
    )
),
words AS (SELECT row, string_split(unit, ' ') AS w FROM units),
sets AS (
    SELECT row, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS pairs
    FROM words WHERE len(w) > 1
),
found AS (
    SELECT row, name, 2.0::DOUBLE * len(list_intersect(s.pairs, t.pairs)) / (len(s.pairs) + t.n) AS dice
    FROM sets s JOIN templates t ON len(s.pairs) BETWEEN t.low AND t.high
),
best AS (
    SELECT row, count(*) AS n_matches, max(dice) AS dice, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses,
        (list(name ORDER BY dice DESC, name))[1] AS license
    FROM found WHERE dice >= {license_scan.THRESHOLD} GROUP BY row
)
SELECT doc_id, license, dice, coalesce(n_matches, 0)::INTEGER AS n_matches, coalesce(licenses, '') AS licenses
FROM flat LEFT JOIN best USING (row)
"""


@query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Best licence and all licences of every document."""
    scanned = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", "license", "dice", "n_matches", F.array_join("licenses", ",").alias("licenses"))


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_classifier.train_and_classify(
        table(spark, folder, "documents"), table(spark, folder, "labels"), keep=["doc_id"]
    )
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document; fingerprints as 16 hex digits."""
    documents = table(spark, folder, "documents")
    fingerprinted = materialize(simhash.with_fingerprint(documents, keep=["doc_id"]))
    joined = fingerprinted.join(simhash.near_duplicates(fingerprinted), "fp")
    return joined.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op7_bpe_lexicon")
def op7_bpe_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(table(spark, folder, "documents"), path, keep=["doc_id"]), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_mixing")
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Cell, probability and decision of every document."""
    documents = table(spark, folder, "documents")
    return mixing.sample(documents, mixing.probabilities(documents))


@query("op6_weighted_fingerprints")
def op6_weighted_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they and the next text's are."""
    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    followed = order.with_next(documents, "doc_id", "text", {"text": "next_text"})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)
    )
    rows = followed.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "text", "next_text"
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    return fingerprints.compared(
        rows,
        ["text", "edited", "next_text"],
        ["fingerprint", "edited_fingerprint", "next_fingerprint"],
        {"near_edited": (0, 1), "near_next": (0, 2)},
        keep=["doc_id", "n_chars", "edited_sha256"],
    ).drop("next_fingerprint")


def _fixity_sql() -> str:
    body = "coalesce(html, '')"
    record = (
        "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')"
        f" || chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10) || {body}"
        " || chr(13) || chr(10) || chr(13) || chr(10)"
    )
    return f"""
WITH records AS (
    SELECT regexp_extract(url, '://[^/?#]*?([^./?#]*[.][^./?#]*)(?:[/?#]|$)', 1) AS archive, page_id AS id,
        strlen({record})::BIGINT AS size, ((page_id * 7919) % 211)::INTEGER AS damage
    FROM pages
),
placed AS (
    SELECT *, row_number() OVER w - 1 AS ordinal,
        coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
    FROM records WINDOW w AS (PARTITION BY archive ORDER BY id)
)
SELECT archive, id, ordinal, "offset", size,
    CASE damage WHEN 0 THEN size WHEN 1 THEN size - 4 END AS found_size,
    CASE damage WHEN 0 THEN 'altered' WHEN 1 THEN 'resized' ELSE 'missing' END AS kind
FROM placed WHERE damage < 3
"""


@query("op4_fixity_audit", _fixity_sql())
def op4_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as records, in one archive for each site; the replica is the same with known damage in some records."""
    pages = table(spark, folder, "pages")
    record = fixity.warc_record(F.col("url"), F.col("html"))
    site = F.regexp_extract("url", "://[^/?#]*?([^./?#]*[.][^./?#]*)(?:[/?#]|$)", 1)
    master = pages.select(site.alias("archive"), F.col("page_id").alias("id"), record.alias("payload"))
    damage = (F.col("id") * 7919) % 211
    cut = F.substring("payload", F.lit(1), F.length("payload") - 4)  # the two line breaks at the end
    harmed = (
        F.when(damage == 0, F.concat(cut, F.lit("####")))
        .when(damage == 1, cut)
        .when(damage == 2, F.lit(None).cast("string"))
        .otherwise(F.col("payload"))
    )
    return fixity.audit(master, master.withColumn("payload", harmed))


#: Tools that the query's calls are checked against.
TOOLS = {
    "search": tool_calls.Schema({"limit": "integer", "query": "string"}, frozenset({"limit", "query"})),
    "summarize": tool_calls.Schema({"limit": "integer", "text": "string"}, frozenset({"text"})),
}


@query(
    "op9_tool_call_linking",
    """
WITH users AS (
    SELECT conv_id, turn, coalesce(c.text, '') AS text, 'call_' || conv_id || '_' || turn AS call_id, length(coalesce(c.text, '')) % 5 AS k,
        CASE WHEN length(coalesce(c.text, '')) < 200 THEN 'search' ELSE 'summarize' END AS name
    FROM conversations c WHERE role = 'user'
),
calls AS (
    SELECT *, CASE WHEN k = 0 THEN to_json({'query': text})
        WHEN k = 1 AND name = 'search' THEN to_json({'limit': 'many', 'query': text})
        WHEN name = 'search' THEN to_json({'limit': k, 'query': text})
        WHEN k = 1 THEN to_json({'text': text})
        ELSE to_json({'limit': k, 'text': text}) END AS arguments,
        CASE WHEN k = 0 AND name = 'search' THEN 'missing limit'
        WHEN k = 0 THEN 'missing text,unexpected query'
        WHEN k = 1 AND name = 'search' THEN 'type of limit' ELSE '' END AS errors,
        -- The first call of each two needs the second, the second that of the two before.
        CASE WHEN turn % 4 < 2 THEN turn + 2 END AS needs
    FROM users
),
ordered AS (
    SELECT c.*, row_number() OVER (
        PARTITION BY c.conv_id ORDER BY coalesce(n.turn, c.turn), n.turn IS NOT NULL, c.turn, c.call_id) - 1 AS position
    FROM calls c LEFT JOIN users n ON n.conv_id = c.conv_id AND n.turn = c.needs
),
answers AS (SELECT conv_id, turn - 1 AS turn, coalesce(c.text, '') AS text FROM conversations c WHERE role = 'assistant')
SELECT o.conv_id, position, call_id, name,
    CASE WHEN errors <> '' THEN 'invalid' WHEN a.text IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
    errors,
    '{"arguments":' || arguments || ',"id":' || to_json(call_id) || ',"name":' || to_json(name) || ',"result":' || coalesce(to_json(a.text), 'null') || '}' AS json
FROM ordered o LEFT JOIN answers a USING (conv_id, turn)
""",
)
def op9_tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn calls a tool, the assistant turn after it is the result; null texts are empty; some arguments break the schema."""
    turns = table(spark, folder, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    number = lambda t: F.concat(F.lit("call_"), F.col("conv_id"), F.lit("_"), t)
    k = F.length("text") % 5
    name = F.when(F.length("text") < 200, "search").otherwise("summarize")
    arguments = (
        F.when(k == 0, F.to_json(F.struct(F.col("text").alias("query"))))
        .when((k == 1) & (name == "search"), F.to_json(F.struct(F.lit("many").alias("limit"), F.col("text").alias("query"))))
        .when(name == "search", F.to_json(F.struct(k.alias("limit"), F.col("text").alias("query"))))
        .when(k == 1, F.to_json(F.struct("text")))
        .otherwise(F.to_json(F.struct(k.alias("limit"), "text")))
    )
    # The first call of each two needs the second, the second that of the two before.
    needs = F.when(F.col("turn") % 4 < 2, F.col("turn") + 2).otherwise(F.col("turn") - 4)
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", number(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.array(number(needs)).alias("depends_on"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", number(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    linked = tool_calls.link(calls, results, TOOLS)
    return linked.withColumn("errors", F.array_join("errors", ","))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with known damage, repaired; one row for each."""
    blank = F.lit(" ")
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    number = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    damage = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    harmed = turns.select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (damage == 0).alias("gone"), F.explode(F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return conversations.digests(conversations.repair(harmed))


@query("op12_vector_codes")
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of all vectors, with their errors and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"))
    long = lambda c: F.least(F.col(c), F.lit((1 << 63) - 1)).cast("bigint").alias(c)
    return vector_codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", long("error"), long("label_error"), F.lit(books.digest()).alias("codebooks_sha256")
    )


@query("op13_partial_matching")
def op13_partial_matching(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all texts, learned from those that are not held out."""
    return partial_matching.score(table(spark, folder, "documents"))
