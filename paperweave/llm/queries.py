"""The operators applied to the whole tables they are meant for, and what of it SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperweave.llm.scratch import documents

TOKENIZERS = "public_tokenizers"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.ngram_join import join_components

    return join_components(documents(spark, sf_dir), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from paperweave.llm.bpe import encode_documents

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.ogg import store_media

    return store_media(documents(spark, sf_dir), keep_media=False)


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.repeats import remove_repeats

    return remove_repeats(documents(spark, sf_dir), words=13, keep_text=False)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from paperweave.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.toxicity import score_documents

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_documents(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.secrets import find_secrets

    return find_secrets(documents(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.url_filter import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


def op9_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from paperweave.llm.knn import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.language import predict_languages

    return predict_languages(documents(spark, sf_dir, "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweave.llm.filter_audit import audit_filters

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audit_filters(documents(spark, sf_dir, "doc_id", "text", "source"), labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_bpe, op3_ogg, op4_repeats, op5_packing, op6_toxicity, op7_secrets, op8_url_filter, op9_knn, op10_sharding, op11_language, op12_whitening, op13_filter_audit)}


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_SHINGLED = f"""w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)"""
_JOINED = f"""WITH RECURSIVE {_SHINGLED},
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, b.y FROM reach r JOIN both_ b ON b.x = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""
_KEPT = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
late AS (SELECT doc_id, i FROM g JOIN (SELECT gram, min(doc_id) AS first FROM g GROUP BY 1) USING (gram) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY p.i) FILTER (gone.i IS NULL) AS kept FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY 1)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
_AUDIT = """WITH RECURSIVE known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part, [len(words) < 200, 100 * list_unique(words) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN known USING (doc_id) GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(filter_order) = 5),
j AS (SELECT part, filter_order, step, own, n, good, toxic, fails[instr('ABCDE', own)] AS here,
  len(list_filter(range(1, 6), lambda i: fails[i] AND contains(before, substr('ABCDE', i, 1)))) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM d, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND NOT gone), 0)::BIGINT AS toxic_lost FROM j GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
_REST = "substr(coalesce(url, ''), strpos(coalesce(url, ''), '://') + 3)"


def oracle_sql() -> dict[str, str]:
    parsed = f"""parsed AS (SELECT page_id,
  CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE translate(regexp_extract({_REST}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
  CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) END AS path FROM pages)"""
    values = ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in RULES)
    return {
        "op1_ngram_join": _JOINED,
        "op4_repeats": _KEPT,
        "op9_knn": """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op8_url_filter": f"""WITH {parsed}, rules(verdict, h, p) AS (VALUES {values}),
fit AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parsed q LEFT JOIN fit f ON f.page_id = q.page_id AND f.k = 1""",
        "op13_filter_audit": _AUDIT,
    }
