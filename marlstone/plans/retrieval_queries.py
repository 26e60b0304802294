"""Queries of retrieval, fusion, boosts, governance and evaluation, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import evaluate as E
from marlstone.operators import governance as G
from marlstone.operators import retrieval as R
from marlstone.streaming.folders import stored


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scored(spark, d, cap=None, best=None) -> DataFrame:
    return R.bm25(_t(spark, d, "documents"), _t(spark, d, "benchmark"), idf_cap=cap, best=best)


def _with_docs(spark, d, scored: DataFrame) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "n_chars")
    return scored.join(docs, "id")


def _meta(spark, d) -> DataFrame:
    """The top 20 of each query as governed documents: family = source, generation, year, archived and tier from columns."""
    top = stored(R.ranked(_scored(spark, d, best=20), 20), "top")  # read more than once by some, and small
    m = _with_docs(spark, d, top)
    return m.select("qid", "id", "score", "rank", F.col("source").alias("family"), F.concat("source", F.lit("/"), (F.col("id") % 3).cast("string")).alias("document"), (F.col("id") % 4).alias("generation"), (2018 + F.col("id") % 9).alias("year"), (F.col("id") % 5 == 0).alias("archived"), (1 + F.col("id") % 10).alias("tier"), "lang", "n_chars")


def bm25_topk(spark, d):
    """Lists of 20, with documents of score 0 where fewer match."""
    return R.ranked(R.padded(_scored(spark, d), _t(spark, d, "documents"), _t(spark, d, "benchmark"), 20), 20)


def bm25_topk_source_cap(spark, d):
    return R.capped(_with_docs(spark, d, _scored(spark, d)), "source", 2, 5).select("qid", "id", "source", "score", "rank")


def term_stats(spark, d):
    return R.term_idf(R.corpus_terms(_t(spark, d, "documents"), "text")).select("term", "df", F.round("idf", 6).alias("idf"))


def idf_capped_query_terms(spark, d):
    return R.ranked(_scored(spark, d, 4, 10), 10)


def cosine_topk(spark, d):
    v = _t(spark, d, "embeddings")
    return R.cosine_topk(v, v.where(F.col("vec_id") % 50 == 0), 10)


def rrf_two_rankings(spark, d):
    both = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    w = Window.partitionBy("list", "qid").orderBy(F.desc("score"), "id")
    top = stored(R.bm25_lists(*both, (None, 4), best=20).withColumn("rank", F.row_number().over(w)).where("rank <= 20"), "top")
    a, b = top.where("list = 0"), top.where("list = 1")
    return R.ranked(R.rrf([(a, 0.4), (b, 0.6)]), 5)


def metadata_boost(spark, d):
    m = _meta(spark, d)
    fresh = F.round(F.least(F.lit(0.1), F.greatest(F.lit(0.0), (F.col("year") - 2020) * 0.015)), 6)
    out = R.boosted(m, [("current", 0.3, ~F.col("archived")), ("archived", -0.5, F.col("archived")), ("english", 0.05, F.col("lang") == "en"), ("long", -0.02, F.col("n_chars") > 4000), ("official", 0.12, F.col("tier") <= 3)])
    return out.select("qid", "id", F.round(F.col("boosted") + fresh, 6).alias("boosted"), "reasons")


def guarded_filter(spark, d):
    return R.guarded(_meta(spark, d), F.col("lang") == "fr").select("qid", "id", "rank", "lang")


def rerank_lexical(spark, d):
    """The first 10 candidates by the share of the query's tokens that the document holds: the stand-in for a model."""
    from marlstone.functions import text as T

    top = R.ranked(_scored(spark, d, best=10), 10)
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(T.index_tokens(F.col("text"))).alias("q"))
    t = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.index_tokens(F.col("text"))).alias("t"))
    s = top.select("qid", "id").join(q, "qid").join(t, "id").select("qid", "id", F.round(F.size(F.array_intersect("q", "t")) / F.size("q"), 4).alias("score"))
    return R.ranked(s, 5)


def trust_score(spark, d):
    m = _meta(spark, d)
    authority = 1.0 - (F.col("tier") - 1) * 0.1
    age = 2026 - F.col("year")
    recency = F.greatest(F.lit(0.0), 1 - age * 0.1)
    stability = F.when(F.col("archived"), 0.2).otherwise(0.9)
    bucket = F.when(F.col("archived") | (age > 5), "archived").when(age <= 0, "current").when(age <= 2, "recent").otherwise("stale")
    boost = F.round(F.least(F.lit(0.3), F.greatest(F.lit(-0.3), (authority - 0.5) * 0.6)), 6)
    return m.select("qid", "id", F.round(0.5 * authority + 0.25 * recency + 0.25 * stability, 4).alias("trust"), bucket.alias("freshness"), boost.alias("authority_boost"))


def lineage_latest(spark, d):
    return G.lineage_latest(_meta(spark, d)).select("qid", "id", "family", "generation", "year")


def canonical_priority(spark, d):
    return G.by_priority(_meta(spark, d)).select("qid", "id", "tier", "priority_rank", "overridden")


def suppression_rules(spark, d):
    return G.suppressed(_meta(spark, d)).select("qid", "id", "family", "archived")


def recovery_trigger(spark, d):
    m = _meta(spark, d)
    return G.needs_recovery(m, G.lineage_latest(G.suppressed(m)))


def diversity_caps(spark, d):
    return G.diversified(_meta(spark, d)).select("qid", "rank", "id", "document", "family")


def diversity_score(spark, d):
    return G.diversity_score(_meta(spark, d))


def query_expansion(spark, d):
    return _t(spark, d, "benchmark").select("item_id", R.expanded(F.col("text"), [("the", ("article", "th")), ("der", ("die", "das")), ("que", ("qui", "quoi"))]).alias("expanded"))


def precision_at_3(spark, d):
    lab = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return E.precision_at(R.ranked(_scored(spark, d, best=3), 3).join(lab, "id", "left"), F.col("quality") == 1, 3)


def stage_trace(spark, d):
    w = Window.partitionBy("qid", "source").orderBy(F.desc("score"), "id")
    best = _with_docs(spark, d, _scored(spark, d)).withColumn("_r", F.row_number().over(w)).where("_r <= 5").drop("_r")
    scored = stored(best, "top")  # both lists are of each source's first 5; read twice
    a = R.ranked(scored, 5).select(F.lit("sparse").alias("stage"), "qid", "id", "rank")
    b = R.capped(scored, "source", 2, 5).select(F.lit("capped").alias("stage"), "qid", "id", "rank")
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_topk_source_cap, term_stats, idf_capped_query_terms, cosine_topk, rrf_two_rankings, metadata_boost, guarded_filter, rerank_lexical, trust_score, lineage_latest, canonical_priority, suppression_rules, recovery_trigger, diversity_caps, diversity_score, query_expansion, precision_at_3, stage_trace)}


def _bm25(cap: int | None = None, name: str = "") -> str:
    """Common tables up to scored(qid, id, score)."""
    terms = "terms0" if not cap else f"(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(idf, 9) DESC, term) AS r FROM terms0) WHERE r <= {cap})"
    return rf"""toks{name} AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents),
posts{name} AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks{name}) GROUP BY ALL),
stats{name} AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks{name}),
raw{name} AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts{name}, stats{name} GROUP BY term),
idf{name} AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw{name}) ELSE raw END AS idf FROM raw{name}),
terms{name}x AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
terms0{name} AS (SELECT * FROM terms{name}x JOIN idf{name} USING (term)),
terms{name} AS (SELECT * FROM {terms.replace('terms0', 'terms0' + name)}),
scored{name} AS (SELECT qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM posts{name} JOIN terms{name} USING (term), stats{name} GROUP BY qid, id)"""


def _top(k: int, src: str = "scored") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {src} QUALIFY rank <= {k})"


_META = f"WITH {_bm25()}, meta AS (SELECT t.qid, t.id, t.score, t.rank::INT AS rank, source AS family, source || '/' || (id % 3)::VARCHAR AS document, id % 4 AS generation, 2018 + id % 9 AS year, id % 5 = 0 AS archived, 1 + id % 10 AS tier, lang, n_chars FROM {_top(20)} t JOIN documents d ON d.doc_id = t.id)"
_SUPP = "(SELECT * FROM meta QUALIFY NOT (archived AND max((NOT archived)::INT) OVER (PARTITION BY qid, family) = 1))"
_LATEST = "(SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY qid, family ORDER BY generation DESC, year DESC, rank) = 1)"
_BOOST = "round(score + CASE WHEN NOT archived THEN 0.3 ELSE 0 END + CASE WHEN archived THEN -0.5 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.05 ELSE 0 END + CASE WHEN n_chars > 4000 THEN -0.02 ELSE 0 END + CASE WHEN tier <= 3 THEN 0.12 ELSE 0 END, 6)"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25()}, pad AS (SELECT qid, id, 0.0::DOUBLE AS score FROM (SELECT item_id AS qid FROM benchmark GROUP BY 1) q, (SELECT doc_id AS id FROM documents ORDER BY doc_id LIMIT 20) d WHERE (qid, id) NOT IN (SELECT (qid, id) FROM scored)), filled AS (SELECT * FROM scored UNION ALL SELECT * FROM pad) SELECT qid, id, score, rank::INT AS rank FROM {_top(20, 'filled')}",
    "bm25_topk_source_cap": f"WITH {_bm25()}, c AS (SELECT s.*, source FROM scored s JOIN documents d ON d.doc_id = s.id QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) <= 2) SELECT qid, id, source, score, rank::INT AS rank FROM {_top(5, 'c')}",
    "term_stats": r"WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS term FROM documents), f AS MATERIALIZED (SELECT term, count(*) AS df FROM t GROUP BY term), r AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM f) SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r",
    "idf_capped_query_terms": f"WITH {_bm25(4)} SELECT qid, id, score, rank::INT AS rank FROM {_top(10)}",
    "cosine_topk": f"WITH scored AS (SELECT q.vec_id AS qid, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id) SELECT qid, id, score, rank::INT AS rank FROM {_top(10)}",
    "rrf_two_rankings": f"WITH {_bm25()}, {_bm25(4, 'b')}, f AS (SELECT qid, id, 0.4::DOUBLE / (60 + rank) AS p FROM {_top(20)} UNION ALL SELECT qid, id, 0.6::DOUBLE / (60 + rank) FROM {_top(20, 'scoredb')}), fused AS (SELECT qid, id, round(sum(p), 6) AS score FROM f GROUP BY qid, id) SELECT qid, id, score, rank::INT AS rank FROM {_top(5, 'fused')}",
    "metadata_boost": f"{_META} SELECT qid, id, round({_BOOST} + round(least(0.1, greatest(0.0, (year - 2020) * 0.015::DOUBLE)), 6), 6) AS boosted, array_to_string(list_filter([CASE WHEN NOT archived THEN 'current' END, CASE WHEN archived THEN 'archived' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN tier <= 3 THEN 'official' END], lambda r: r IS NOT NULL), ',') AS reasons FROM meta",
    "guarded_filter": f"{_META} SELECT qid, id, rank, lang FROM meta QUALIFY max((lang = 'fr')::INT) OVER (PARTITION BY qid) = 0 OR lang = 'fr'",
    "rerank_lexical": rf"WITH {_bm25()}, q AS (SELECT item_id AS qid, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS q FROM benchmark), r AS (SELECT t.qid, t.id, round(len(list_intersect(q.q, toks.t))::DOUBLE / len(q.q), 4) AS score FROM {_top(10)} t JOIN q USING (qid) JOIN toks USING (id)) SELECT qid, id, score, rank::INT AS rank FROM {_top(5, 'r')}",
    "trust_score": f"{_META} SELECT qid, id, round(0.5::DOUBLE * (1.0::DOUBLE - (tier - 1) * 0.1::DOUBLE) + 0.25::DOUBLE * greatest(0.0::DOUBLE, 1 - (2026 - year) * 0.1::DOUBLE) + 0.25::DOUBLE * CASE WHEN archived THEN 0.2::DOUBLE ELSE 0.9::DOUBLE END, 4) AS trust, CASE WHEN archived OR 2026 - year > 5 THEN 'archived' WHEN 2026 - year <= 0 THEN 'current' WHEN 2026 - year <= 2 THEN 'recent' ELSE 'stale' END AS freshness, round(least(0.3::DOUBLE, greatest(-0.3::DOUBLE, (1.0::DOUBLE - (tier - 1) * 0.1::DOUBLE - 0.5::DOUBLE) * 0.6::DOUBLE)), 6) AS authority_boost FROM meta",
    "lineage_latest": f"{_META} SELECT qid, id, family, generation, year FROM {_LATEST.format(src='meta')}",
    "canonical_priority": f"{_META} SELECT qid, id, tier, row_number() OVER w::INT AS priority_rank, first_value(rank) OVER w <> min(rank) OVER (PARTITION BY qid) AS overridden FROM meta WINDOW w AS (PARTITION BY qid ORDER BY tier, rank)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
    "suppression_rules": f"{_META} SELECT qid, id, family, archived FROM {_SUPP}",
    "recovery_trigger": f"{_META}, s AS {_SUPP}, l AS {_LATEST.format(src='s')}, n AS (SELECT qid, count(*) AS n FROM meta GROUP BY qid), m AS (SELECT qid, count(*) AS m FROM l GROUP BY qid) SELECT qid, round(1 - coalesce(m, 0)::DOUBLE / n, 4) AS suppression_ratio, 1 - coalesce(m, 0)::DOUBLE / n > 0.5 OR coalesce(m, 0) < 3 AS recover FROM n LEFT JOIN m USING (qid)",
    "diversity_caps": "WITH RECURSIVE " + _META[5:] + ", fold AS (SELECT qid, 0 AS rank, []::BIGINT[] AS ids, []::VARCHAR[] AS docs, []::VARCHAR[] AS fams FROM (SELECT DISTINCT qid FROM meta) UNION ALL SELECT f.qid, m.rank, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(docs, document) ELSE docs END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END FROM (SELECT f.*, m.id, m.rank AS nr, m.document, m.family, len(f.ids) < 3 OR (len(list_filter(f.docs, lambda x: x = m.document)) < 2 AND len(list_filter(f.fams, lambda x: x = m.family)) < 3) AS ok FROM fold f JOIN meta m ON m.qid = f.qid AND m.rank = f.rank + 1) f JOIN meta m ON m.qid = f.qid AND m.rank = f.nr) SELECT m.qid, m.rank, m.id, m.document, m.family FROM meta m JOIN (SELECT qid, ids FROM fold QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank DESC) = 1) x ON m.qid = x.qid AND list_contains(x.ids, m.id)".replace("CASE WHEN ok THEN list_append(ids, id)", "CASE WHEN ok THEN list_append(ids, f.id)").replace("list_append(docs, document)", "list_append(docs, f.document)").replace("list_append(fams, family)", "list_append(fams, f.family)"),
    "diversity_score": f"{_META} SELECT qid, round((count(DISTINCT document)::DOUBLE / count(*) + count(DISTINCT family)::DOUBLE / count(*)) / 2, 4) AS diversity FROM meta GROUP BY qid",
    "query_expansion": "WITH t AS (SELECT item_id, text, list_distinct(list_concat(list_concat(CASE WHEN contains(lower(text), 'the') THEN ['article', 'th'] ELSE [] END, CASE WHEN contains(lower(text), 'der') THEN ['die', 'das'] ELSE [] END), CASE WHEN contains(lower(text), 'que') THEN ['qui', 'quoi'] ELSE [] END)) AS s FROM benchmark), u AS (SELECT item_id, text, list_filter(['article', 'th', 'die', 'das', 'qui', 'quoi'], lambda x: list_contains(s, x) AND NOT contains(lower(text), x)) AS s FROM t) SELECT item_id, CASE WHEN len(s) > 0 THEN text || ' ' || array_to_string(s, ' ') ELSE text END AS expanded FROM u",
    "precision_at_3": f"WITH {_bm25()} SELECT qid, round(avg(coalesce(quality = 1, false)::INT::DOUBLE), 6) AS precision FROM {_top(3)} t LEFT JOIN labels l ON l.doc_id = t.id GROUP BY qid",
    "stage_trace": f"WITH {_bm25()}, c AS (SELECT s.* FROM scored s JOIN documents d ON d.doc_id = s.id QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, id) <= 2) SELECT 'sparse' AS stage, qid, id, rank::INT AS rank FROM {_top(5)} UNION ALL SELECT 'capped', qid, id, rank::INT FROM {_top(5, 'c')}",
}
