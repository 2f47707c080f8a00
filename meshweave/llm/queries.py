"""The driver's queries over the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    collocations,
    embedding_dedup,
    exact_dedup,
    fm_index,
    jaccard_join,
    license_scan,
    packing,
    page_text,
    quality,
    secrets,
    tool_calls,
    toxicity,
    whitening,
)
from .common import sha256_hex, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)  # a second argument would be the place in the list
    n = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *n[:3], sha256_hex(secrets.listed(base)).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), n[3])


def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.page_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_divide_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, _ = jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


#: The schema of the one tool that op6's query gives to the conversations.
NOTE_SCHEMA = {
    "note": {
        "type": "object",
        "required": ["after", "size"],
        "properties": {"after": {"type": "array", "items": {"type": "string"}}, "size": {"type": ["string", "null"], "enum": ["short", "medium"]}, "turn": {"type": "integer"}},
        "additionalProperties": False,
    }
}


def with_tools(conversations: DataFrame) -> DataFrame:
    """The conversations with tool use, as their texts have none: each assistant message also calls the
    tool ``note``, whose result is a message of its own one turn later. By conversation, calls refer to the
    result of the call before, or of the call after, or go round."""
    own = conversations.where("role = 'assistant'")
    around = Window.partitionBy("conv_id").orderBy("turn")
    whole = Window.partitionBy("conv_id")
    way = F.pmod("conv_id", F.lit(3))
    named = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    after = F.when(way == 0, F.lag("turn").over(around)).when(way == 1, F.lead("turn").over(around)).otherwise(F.coalesce(F.lead("turn").over(around), F.min("turn").over(whole)))
    size = F.when(F.char_length("text") < 300, "short").when(F.char_length("text") < 1200, "medium").otherwise("long")
    arguments = F.struct(F.filter(F.array(F.when(after.isNotNull(), F.struct(named(after).alias("$ref")))), lambda x: x.isNotNull()).alias("after"), size.alias("size"), F.col("turn"))
    call = F.struct(named(F.col("turn")).alias("id"), F.lit("note").alias("name"), arguments.alias("arguments"))
    calling = own.select("conv_id", "turn", "role", F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"))).alias("text"))
    told = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("tool").alias("role"), F.to_json(F.struct(named(F.col("turn")).alias("tool_call_id"), F.lit("noted").alias("content"))).alias("text"))
    rest = conversations.where("role IS NULL OR role <> 'assistant'").select("conv_id", "turn", "role", "text")
    return rest.union(calling).union(told)


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_tool_calls(with_tools(table(spark, sf_dir, "conversations")), NOTE_SCHEMA)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join("matches.license", ",").alias("licenses"))


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = fm_index.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return leaks.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 9], ' ') AS g, least(len(w), 10) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
o AS (SELECT r, k, n.n, array_to_string(w[k : k + n.n - 1], ' ') AS g FROM n, (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d) WHERE k + n.n - 1 <= len(w)),
m AS (SELECT o.r, o.k, o.n, i.item_id FROM o JOIN i ON o.g = i.g AND o.n = i.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY a) m USING (r)
"""

OP9_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.x = vec_id
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
w AS (SELECT *, first_value(doc_id) OVER o AS keep_id, row_number() OVER o AS place, count(*) OVER (PARTITION BY t) AS group_size FROM d WINDOW o AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM w
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS piece FROM d)),
f AS (SELECT lang, k, w[i : i + k - 1] AS ws, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
s AS (SELECT c.*, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f x ON x.lang = c.lang AND x.ws = c.ws[1 : j] JOIN f y ON y.lang = c.lang AND y.ws = c.ws[j + 1 : c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, j) = 1),
i AS (SELECT lang, c.ws[i : i + m - 1] AS ws, max(a) AS most FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) c GROUP BY ALL),
o AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.ws = b.ws WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""

# The texts with the tool use of ``with_tools``; conversations have at most one message of a turn.
OP6_SQL = """
WITH a AS (
    SELECT *, CASE conv_id % 3 WHEN 0 THEN lag(turn) OVER o WHEN 1 THEN lead(turn) OVER o ELSE coalesce(lead(turn) OVER o, first_value(turn) OVER o) END AS after,
           row_number() OVER o AS k, count(*) OVER w AS n, max(turn) OVER w AS latest,
           CASE WHEN length(text) < 300 THEN 'short' WHEN length(text) < 1200 THEN 'medium' ELSE 'long' END AS size
    FROM conversations WHERE role = 'assistant' WINDOW o AS (PARTITION BY conv_id ORDER BY turn), w AS (PARTITION BY conv_id)
),
p AS (
    SELECT *, CASE conv_id % 3 WHEN 0 THEN 2 * (k - 1) WHEN 1 THEN 2 * (n - k) ELSE -1 END AS level,
           CASE WHEN conv_id % 3 = 1 AND turn < latest THEN latest + 1 ELSE turn END AS order_turn
    FROM a
)
SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS level, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_linked, CAST(0 AS INTEGER) AS n_errors,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"conv_id":' || conv_id || ',"role":' || CAST(to_json(role) AS VARCHAR) || ',"turn":' || turn || '}' AS message
FROM conversations WHERE role <> 'assistant'
UNION ALL
SELECT conv_id, turn, role, order_turn, CAST(level AS INTEGER), 1, 1, CAST(size = 'long' AS INTEGER),
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"conv_id":' || conv_id || ',"role":"assistant","tool_calls":[{"arguments":{"after":['
       || CASE WHEN after IS NULL THEN '' ELSE '{"$ref":"call-' || after || '"}' END || '],"size":"' || size || '","turn":' || turn || '},"id":"call-' || turn || '","name":"note"}],"turn":' || turn || '}'
FROM p
UNION ALL
SELECT conv_id, turn + 1, 'tool', greatest(turn + 1, order_turn), CAST(CASE WHEN level < 0 THEN level ELSE level + 1 END AS INTEGER), 0, 1, 0,
       '{"content":"noted","conv_id":' || conv_id || ',"role":"tool","tool_call_id":"call-' || turn || '","turn":' || (turn + 1) || '}'
FROM p
"""

# The containment of a template in a text, without windows: these templates are found in one piece.
OP7_SQL = r"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(license, template)),
tw AS (SELECT license, regexp_extract_all(lower(template), '[a-z0-9]+') AS w FROM t),
ts AS (SELECT DISTINCT license, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS k FROM tw)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT DISTINCT r, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
m AS (SELECT r, license, count(*) AS n FROM ds JOIN ts USING (g) GROUP BY r, license),
f AS (SELECT r, count(*) AS n, string_agg(license, ',' ORDER BY license) AS s FROM m JOIN (SELECT license, count(*) AS size FROM ts GROUP BY license) USING (license) WHERE n >= 0.8 * size GROUP BY r)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_licenses, coalesce(f.s, '') AS licenses FROM d LEFT JOIN f USING (r)
""".replace("{values}", ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_page_differencing": op2_page_differencing,
        "op3_best_two_fit": op3_best_two_fit,
        "op4_kneser_ney": op4_kneser_ney,
        "op5_divide_skip": op5_divide_skip,
        "op6_tool_calls": op6_tool_calls,
        "op7_license_scan": op7_license_scan,
        "op8_pu_quality": op8_pu_quality,
        "op9_rotation_codes": op9_rotation_codes,
        "op10_fm_index": op10_fm_index,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_collocations": op12_collocations,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_tool_calls": OP6_SQL, "op7_license_scan": OP7_SQL, "op9_rotation_codes": OP9_SQL, "op5_divide_skip": OP5_SQL, "op10_fm_index": OP10_SQL, "op11_exact_dedup": OP11_SQL, "op12_collocations": OP12_SQL}
