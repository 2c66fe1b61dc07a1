"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitforge.llm import bpe, centroids, chat, decontam, embed_dedup, licenses, line_dedup, near_dedup, pseudonyms, quality, search, token_files, toxicity
from splitforge.llm.shared import bound_batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. All queries here, and the pipeline, begin with this and work on bounded batches: it is the one place
    that sets this in the session."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted, read back and digested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = chat.END + chat.START + "assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    return chat.digests(chat.read_back(chat.format_chats(rows.unionByName(own), VOCABULARY), VOCABULARY))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its score to nine places."""
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 9))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back."""
    return token_files.written_and_read(table(spark, sf_dir, "documents"), VOCABULARY)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all embeddings at a cosine of 0.93 within a label."""
    return embed_dedup.groups(table(spark, sf_dir, "embeddings"), 0.93)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, at a similarity of 0.85."""
    return near_dedup.groups(table(spark, sf_dir, "documents"), percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose a passage which stands elsewhere before, and what is left of them."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with personal numbers or dates, with pseudonyms in their place."""
    key = pseudonyms.key_table(spark, pseudonyms.put_key(spark, "a key that is kept elsewhere"))
    return pseudonyms.report(table(spark, sf_dir, "documents"), key)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of all embeddings after five rounds from 40 centroids."""
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which licenses every document names, by phrases and by notices."""
    return licenses.digests(licenses.matches(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_bpe_round_trip, op3_quality_classifier, op4_decontamination, op5_token_files, op6_embedding_dedup, op7_toxicity, op8_near_dedup, op9_line_dedup, op10_pseudonyms, op11_ranked_search, op12_centroid_clusters, op13_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op4_decontamination": OP4_SQL, "op6_embedding_dedup": OP6_SQL, "op8_near_dedup": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_centroid_clusters": OP12_SQL, "op13_license_scan": OP13_SQL}


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), shown AS (
  SELECT *, length(regexp_replace(text, '<(\\*)(\|im_(?:start|end)\|>)', '<\\\1\2', 'g'))
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)(\|im_(?:start|end)\|>)', '<\\\1\2', 'g')) + 24 AS shown_chars FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown_chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""

OP6_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.id
), least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
many AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN many m ON m.a = e.vec_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_GRAMS = "CASE WHEN len({w}) >= 5 THEN list_distinct(list_transform(range(1, len({w}) - 3), lambda i: array_to_string({w}[i:i + 4], ' '))) ELSE [] END"


def _item_words(text: str) -> str:
    return f"regexp_extract_all({_LOWER.replace('text', text)}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


# Passages of twice the longest item begin every longest item's words. An item of five words and more, or a question of as
# many, is held by its distinct runs of five words; a shorter one as a whole.
OP4_SQL = rf"""
WITH given AS (SELECT DISTINCT item_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT *, list_filter(string_split(regexp_replace(bare, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM given),
said AS (SELECT item_id, text, CASE WHEN len(parts) > 1 THEN array_to_string(parts[:-2], ' ') ELSE bare END AS question, CASE WHEN len(parts) > 1 THEN parts[-1] ELSE bare END AS answer FROM cut),
items AS (SELECT row_number() OVER () AS k, * FROM (SELECT item_id, {_item_words('text')} AS w, {_item_words('question')} AS q, list_distinct({_item_words('answer')}) AS a FROM said) WHERE len(w) > 0),
sized AS (SELECT count(*) AS total, avg(len(w)) AS mean, max(len(w)) AS step FROM items),
terms AS (SELECT k, len(w) AS size, unnest(w) AS term FROM items),
counted AS (SELECT k, size, term, count(*) AS n FROM terms GROUP BY ALL),
held AS (SELECT term, count(*) AS h FROM counted GROUP BY term),
weighted AS (SELECT k, term, ln(1 + (total - h + 0.5) / (h + 0.5)) * n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25 + 0.75 * size / greatest(mean, 1))) AS x FROM counted JOIN held USING (term) CROSS JOIN sized),
shares AS (SELECT k, list(term) AS terms, list(x) AS xs, sum(x) AS own FROM weighted GROUP BY k),
texts AS (SELECT row_number() OVER () AS d, doc_id, {_item_words('text')} AS w FROM documents),
passages AS (SELECT d, doc_id, p, w[p * step + 1:p * step + 2 * step] AS w FROM (SELECT d, doc_id, w, step, unnest(range(0, greatest(CAST(ceil(len(w) / step) AS BIGINT), 1))) AS p FROM texts CROSS JOIN sized)),
item_grams AS (SELECT k, unnest({_GRAMS.format(w='w')}) AS g FROM items),
text_grams AS (SELECT d, p, unnest({_GRAMS.format(w='w')}) AS g FROM passages),
long AS (SELECT d, p, k FROM (SELECT d, p, k, count(*) AS n FROM text_grams JOIN item_grams USING (g) GROUP BY ALL) JOIN (SELECT k, count(*) AS m FROM item_grams GROUP BY k) USING (k) WHERE n >= 0.8 * m),
short AS (SELECT d, p, k FROM passages x JOIN items i ON len(i.w) < 5 AND contains(' ' || array_to_string(x.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')),
found AS (SELECT x.d, x.doc_id, x.p, x.w, i.k, i.item_id, i.q, i.a FROM (SELECT * FROM long UNION ALL SELECT * FROM short) c JOIN passages x USING (d, p) JOIN items i USING (k)),
judged AS (SELECT d, doc_id, p, item_id, k,
  CASE WHEN len(q) >= 5 THEN len(list_intersect({_GRAMS.format(w='q')}, {_GRAMS.format(w='w')})) / len({_GRAMS.format(w='q')})
    WHEN len(q) = 0 OR contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') THEN 1.0 ELSE 0.0 END AS question_overlap,
  CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_filter(a, lambda t: list_contains(w, t))) / len(a) END AS answer_overlap,
  list_sum(list_transform(range(1, len(terms) + 1), lambda i: CASE WHEN list_contains(w, terms[i]) THEN xs[i] ELSE 0 END)) / own AS score
  FROM found JOIN shares USING (k))
SELECT doc_id, item_id, round(score, 9) AS score, CAST(question_overlap AS DOUBLE) AS question_overlap, CAST(answer_overlap AS DOUBLE) AS answer_overlap FROM judged
WHERE question_overlap >= 0.7 AND answer_overlap >= 0.5
QUALIFY row_number() OVER (PARTITION BY d, k ORDER BY round(score, 9) DESC, p) = 1
"""

OP8_SQL = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE {_GRAMS.format(w='w')} END) AS g FROM worded),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN least l ON l.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
sized AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM texts WHERE len(w) > 0),
counted AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS length FROM sized),
items AS (SELECT row_number() OVER () AS k, item_id, list_distinct({_TERMS}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT k, unnest(w) AS term FROM items),
tfs AS (SELECT d, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tfs CROSS JOIN counted GROUP BY term, total),
lengths AS (SELECT d, doc_id, 10 + (90 * n * total) // length AS m FROM sized CROSS JOIN counted),
scored AS (SELECT k, doc_id, d, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM tfs JOIN weights USING (term) JOIN asked USING (term) JOIN lengths USING (d) GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) JOIN items USING (k) WHERE rank <= 10
"""


def _clusters_sql(k: int, rounds: int, seed: str) -> str:
    """Rounds of assignment and means; the squared distance as a sum over components."""

    def assigned(r: int) -> str:
        apart = "CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
        return f"a{r} AS MATERIALIZED (SELECT v, any_value(vec_id) AS vec_id, any_value(x) AS x, min(p) AS best FROM (SELECT v.v, v.vec_id, v.x, {{'d': {apart}, 'c': c.c}} AS p FROM kept v CROSS JOIN c{r} c) GROUP BY v)"

    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS v, vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(256 * x) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 524288)) = 0)""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS c, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds):
        parts.append(assigned(r))
        parts.append(f"""m{r} AS (SELECT c, list(y ORDER BY i) AS x FROM (SELECT c, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT best.c AS c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)""")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    parts.append(assigned(rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = best.c"""


OP12_SQL = _clusters_sql(40, 5, "2")


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all({_LOWER.replace('text', text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licenses_sql() -> str:
    """Phrases by their consecutive words; notices by the distinct words that each window of 2 h words has of them."""

    def values(rows):
        return ", ".join("({})".format(", ".join([str(k), *("'" + x.replace("'", "''") + "'" for x in row)])) for k, row in enumerate(rows))

    return rf"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_words_sql('text')} AS w FROM documents),
phrases AS (SELECT {_words_sql('said')} AS q, label FROM (VALUES {values(licenses.PHRASES)}) p(k, said, label)),
notices AS (SELECT k, label, name, len(w) AS size, list_distinct(w) AS w FROM (SELECT k, label, string_split(name, ' ') AS name, {_words_sql('said')} AS w FROM (VALUES {values(licenses.NOTICES)}) n(k, said, label, name))),
shaped AS (SELECT k, label, name, len(w) AS size, CAST(2 ** ceil(log2(size)) AS BIGINT) AS h, w FROM notices),
told AS (SELECT k, unnest(w) AS word FROM shaped),
words AS MATERIALIZED (SELECT d, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM texts),
spots AS (SELECT t.d, x.p, label FROM words x JOIN phrases ON x.word = q[1] JOIN texts t ON t.d = x.d WHERE t.w[x.p + 1:x.p + len(q)] = q),
base AS (SELECT d, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(label) AS labels FROM spots GROUP BY d),
places AS (SELECT DISTINCT d, k, word, p // h - back AS win FROM words JOIN told USING (word) JOIN shaped USING (k) CROSS JOIN (VALUES (0), (1)) b(back) WHERE p // h >= back),
counted AS (SELECT d, k, win, h, label, w, n / size AS part FROM (SELECT d, k, win, count(*) AS n, list(word) AS own FROM places GROUP BY ALL) JOIN shaped USING (k) WHERE n >= greatest(1, ceil({licenses.CONTAINED}::DOUBLE * size - 1e-9)) AND list_has_all(own, name)),
held AS (SELECT d, label, part FROM counted a WHERE NOT EXISTS (SELECT 1 FROM counted b WHERE b.d = a.d AND b.h = a.h AND b.win = a.win AND len(b.w) > len(a.w) AND list_has_all(b.w, a.w))),
found AS (SELECT d, list(label) AS labels, max(part) AS part FROM held GROUP BY d)
SELECT doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END AS score
FROM texts t LEFT JOIN base b USING (d) LEFT JOIN found f USING (d)
"""


OP13_SQL = _licenses_sql()
