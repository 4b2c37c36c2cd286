"""The registered queries of this subpackage, one for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.substring import digest

    return digest(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.lm_scoring import score

    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        return score(table(spark, sf_dir, "documents"), f.read())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.quality import classify

    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.pieces import digest

    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return digest(table(spark, sf_dir, "documents"), f.read())


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows arrive in eight arrivals, dealt by a hash of doc_id, however many files it has."""
    from quotelake.llm.sharding import compacted

    documents = table(spark, sf_dir, "documents")
    arrivals = [documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == i) for i in range(8)]
    return compacted(arrivals).placement("doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.merkle import tampered_manifest

    return tampered_manifest(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotelake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring": op2_substring,
    "op3_minhash": op3_minhash,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_quality": op5_quality,
    "op6_pieces": op6_pieces,
    "op7_html_text": op7_html_text,
    "op8_fingerprints": op8_fingerprints,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_token_counts": op13_token_counts,
}

#: Links (x, y) in both directions -> the smallest id that each can reach.
_REACH = """reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y), least_of AS (SELECT x, min(y) AS least FROM reach GROUP BY x)"""
_WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"



def _hashed(n_chars: str) -> str:
    """The leaf of a row of documents, in SQL."""
    values = (f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


#: SQL for the operators whose results it can express; the others' tests hold brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93), {_REACH},
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least_of l ON l.x = vec_id""",
    "op2_substring": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END AS key FROM p),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE key IS NOT NULL GROUP BY key),
c AS (SELECT k.doc_id, i, word, coalesce(owner < k.doc_id, false) AS covered FROM k LEFT JOIN o USING (key)),
r AS (SELECT doc_id, i, word, bool_or(covered) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM c),
s AS (SELECT doc_id, count(*) AS n, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op3_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM g), m AS (SELECT shingle FROM u GROUP BY shingle HAVING count(*) > 1), t AS (SELECT u.* FROM u JOIN m USING (shingle)),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))), {_REACH}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM g LEFT JOIN least_of ON x = doc_id""",
    "op11_collocations": """WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM d),
t AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
q AS (SELECT lang, [w, lead(w, 1) OVER u, lead(w, 2) OVER u, lead(w, 3) OVER u] AS w FROM t WINDOW u AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, size, w[1:size] AS g FROM q, range(1, 5) AS s(size) WHERE w[size] IS NOT NULL),
c AS MATERIALIZED (SELECT lang, size, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM g GROUP BY lang, size, g), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang),
o AS MATERIALIZED (SELECT * FROM c WHERE f >= 30), k AS (SELECT *, unnest(range(1, size)) AS k FROM o),
e AS MATERIALIZED (SELECT lang, size, phrase, f, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:size], ' ') AS rest FROM k),
cuts AS (SELECT e.lang, e.size, e.phrase, e.f, k, a.f AS l, b.f AS r, CAST(CAST(2000000 AS HUGEINT) * e.f // (a.f + b.f) AS BIGINT) AS score FROM e JOIN o a ON a.lang = e.lang AND a.phrase = head JOIN o b ON b.lang = e.lang AND b.phrase = rest),
s AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(g[1:size - 1], ' ') AS phrase, f FROM o WHERE size > 2 UNION ALL SELECT lang, array_to_string(g[2:size], ' '), f FROM o WHERE size > 2) GROUP BY lang, phrase),
w AS (SELECT s.* FROM s LEFT JOIN h USING (lang, phrase) WHERE h.f IS NULL OR 100 * h.f < 80 * s.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score, CAST(size AS BIGINT) AS words FROM w JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_merkle": f"""WITH RECURSIVE crc_steps(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE k = 8), d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents, crc_table),
chosen AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(s) + 1), lambda j: ascii(s[j]))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 7 = 0 AS chosen FROM d),
leaves AS (SELECT doc_id, lang, {_hashed("n_chars")} AS leaf, CASE WHEN chosen THEN {_hashed("CAST(n_chars AS HUGEINT) + 1")} END AS tampered FROM chosen),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lang, level, i, h, n) AS (SELECT lang, 0, i, leaf, n FROM rows_ UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_(level, i, h, n) AS (SELECT 0, i, subroot, n FROM subroots UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper_ WHERE n > 1 GROUP BY level, i // 2),
top AS (SELECT level AS height, h AS root FROM upper_ WHERE n = 1),
steps AS (SELECT r.lang, r.i, l AS level, CASE WHEN s.h IS NULL THEN '' WHEN (r.i >> l) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS p FROM rows_ r JOIN subroots g ON g.lang IS NOT DISTINCT FROM r.lang, range(0, 64) x(l)
 LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM r.lang AND s.level = l AND s.i = xor(r.i >> l, 1) WHERE l < g.height),
upper_steps AS (SELECT g.lang, l + 1000 AS level, CASE WHEN s.h IS NULL THEN '' WHEN (g.i >> l) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END AS p FROM subroots g, top, range(0, 64) x(l) LEFT JOIN upper_ s ON s.level = l AND s.i = xor(g.i >> l, 1) WHERE l < top.height),
paths AS (SELECT lang, i, list(p ORDER BY level) AS p FROM (SELECT * FROM steps UNION ALL SELECT r.lang, r.i, level, p FROM rows_ r JOIN upper_steps u ON u.lang IS NOT DISTINCT FROM r.lang) GROUP BY lang, i),
found AS (SELECT doc_id, leaf, tampered, subroot, root, coalesce(p, []) AS p FROM rows_ r JOIN subroots g ON g.lang IS NOT DISTINCT FROM r.lang CROSS JOIN top LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM r.lang AND q.i = r.i),
folded AS (SELECT *, list_reduce(list_concat([coalesce(tampered, leaf)], p), lambda x, y: sha256(CASE WHEN y = '' THEN x WHEN y[1] = 'L' THEN y[2:] || x ELSE x || y[2:] END)) AS folded_root FROM found)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(p, lambda y: y[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
}
