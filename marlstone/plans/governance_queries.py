"""Queries of authority tiers, suppression, the governance chain and answer evaluation, with their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import evaluate as E
from marlstone.operators import governance as G
from marlstone.operators import retrieval as R
from marlstone.operators import second_pass as S
from marlstone.plans.retrieval_queries import _bm25, _scored, _t, _top
from marlstone.streaming.folders import stored

# Metadata of retrieved documents by numbers of theirs, in SQL that both engines read.
META = [
    ("url", "CASE id % 11 WHEN 0 THEN 'https://example.org/osobni/ucty' WHEN 1 THEN 'https://example.org/firmy/karta' WHEN 2 THEN concat('https://example.org/faq/', source) WHEN 3 THEN concat('https://example.org/files/cenik-', source, '.pdf') WHEN 4 THEN concat('https://example.org/files/archiv-', source, '.pdf') WHEN 5 THEN concat('https://example.org/files/zmena-', source, '.pdf') WHEN 6 THEN 'https://example.org/private-banking/x' WHEN 7 THEN CAST(NULL AS STRING) ELSE concat('https://example.org/a/', source) END"),
    ("title", "CASE id % 7 WHEN 0 THEN concat('Sazebník ', source) WHEN 1 THEN 'Historický dokument' WHEN 2 THEN concat('Dokument ', source) WHEN 3 THEN concat(source, ' 2025') WHEN 4 THEN CAST(NULL AS STRING) ELSE concat('Text ', source, ' ', lang) END"),
    ("file_name", "CASE id % 5 WHEN 0 THEN concat(source, '.pdf') WHEN 1 THEN 'podminky-2024.pdf' ELSE '' END"),
    ("document_type", "CASE id % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'document' WHEN 2 THEN '' ELSE CASE WHEN id % 12 = 3 THEN 'faq' ELSE 'terms' END END"),
    ("category", "CASE id % 6 WHEN 0 THEN 'retail' WHEN 1 THEN 'support' WHEN 2 THEN 'pricing_docs' WHEN 3 THEN '' ELSE lang END"),
    ("chunk_type", "CASE id % 9 WHEN 0 THEN 'table' WHEN 1 THEN 'faq' ELSE 'section_text' END"),
    ("source_url", "CASE id % 13 WHEN 0 THEN concat('https://example.org/', source) WHEN 1 THEN 'https://example.org' ELSE '' END"), ("document_family", "CASE id % 3 WHEN 0 THEN source ELSE '' END"), ("product", "CASE id % 10 WHEN 0 THEN 'eKonto' WHEN 1 THEN 'eKonto Smart' ELSE '' END"),
    ("archived", "id % 5 = 0"), ("generation", "id % 4"), ("year", "2018 + id % 9"), ("document", "concat(source, '/', CAST(id % 3 AS STRING))"), ("family", "concat(source, '-', CAST(id % 2 AS STRING))"),
]
#: Answers of evaluated items: an assistant's turn and what follows it.
ENDINGS = [
    "Poplatek je 99 Kč měsíčně.", "Vedení je zdarma.", "Určitě zarucene.", "Nemam k dispozici údaje.", "Upresnete prosím, který účet.", "Zdroj: sazebník 2025.", "{\"json\": 1}", "Archiv 2018 a 2020.", "Kontaktujte podporu.",
    "Cena 1 200 CZK ročně, source: ceník.", "", "Cena v cene je 49 eur.",
]
ITEMS = [
    ("category", "CASE n % 3 WHEN 0 THEN 'pricing' WHEN 1 THEN 'cards' ELSE 'faq' END"), ("subcategory", "CASE n % 6 WHEN 0 THEN 'pricing' ELSE 'other' END"), ("requires_sources", "n % 4 <> 0"),
    ("should_clarify", "CASE n % 5 WHEN 0 THEN true WHEN 1 THEN false END"), ("refuse", "n % 7 = 0"), ("max_chars", "CASE n % 8 WHEN 0 THEN 60 WHEN 1 THEN 2000 END"), ("forbid_json", "n % 3 = 1"),
    ("status_code", "CASE n % 31 WHEN 0 THEN 503 ELSE 200 END"), ("behaviour", "CASE n % 2 WHEN 0 THEN 'direct_answer' ELSE 'any' END"), ("least_grounding", "CASE n % 4 WHEN 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"),
    ("precision", "CASE n % 10 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(0.6667 AS DOUBLE) WHEN 2 THEN CAST(NULL AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END"), ("latency_ms", "CAST(n % 997 AS DOUBLE)"),
    ("amount", "CASE n % 3 WHEN 0 THEN CASE n % 2 WHEN 0 THEN '99' ELSE '1 200' END END"), ("currency", "CASE n % 2 WHEN 0 THEN 'Kč' ELSE '' END"),
]


def _meta(spark, d, top: DataFrame | None = None) -> DataFrame:
    """The top 20 of each query, or the given ranking, with the metadata of a governed source."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    m = stored(R.ranked(_scored(spark, d, best=20), 20) if top is None else top, "top").join(docs, "id").selectExpr("qid", "id", "score", "rank", "source", "lang", *(f"{e} AS {n}" for n, e in META))
    return m.withColumn("tier", G.authority_tier(*(F.col(c) for c in ("url", "title", "file_name", "document_type", "category", "chunk_type"))))


def authority_tiers(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang").selectExpr("id", *(f"{e} AS {n}" for n, e in META[:6]))
    tier = G.authority_tier(*(F.col(c) for c in ("url", "title", "file_name", "document_type", "category", "chunk_type")))
    other = G.resilience_category(F.col("category"), F.col("document_type"), F.col("chunk_type"), tier)
    return docs.select("id", tier.alias("tier"), G.authority_boost(tier).alias("boost"), G.priority(tier).alias("priority"), other.alias("resilience_category"))


def governance_suppression(spark, d):
    return G.suppression(_meta(spark, d)).select("qid", "id", "rank", "tier", "suppressed_by")


def governance_chain(spark, d):
    return G.governed(_meta(spark, d))[0].select("qid", "id", "tier", F.col("final_rank").cast("int").alias("final_rank"))


def governance_summary(spark, d):
    return G.governed(_meta(spark, d))[1]


LABELS = "CASE item_id % 3 WHEN 0 THEN 'pricing' WHEN 1 THEN 'cards' ELSE '' END"


#: Candidates of the first search, so few that governance leaves some queries with too little.
FIRST = 5


def _recovered(spark, d) -> tuple[DataFrame, DataFrame]:
    """The second search fuses BM25 with BM25 on the four rarest terms."""
    docs = _t(spark, d, "documents")
    sparse, dense = S.weights(0.4, 0.6)

    def search(asked: DataFrame, k: int) -> DataFrame:
        lists = [R.ranked(R.bm25(docs, asked, q_id="qid", idf_cap=cap, best=k), k) for cap in (None, 4)]
        return _meta(spark, d, R.ranked(R.rrf(list(zip(lists, (sparse, dense)))), k))

    queries = _t(spark, d, "benchmark").selectExpr("item_id AS qid", "text", f"array({LABELS}) AS labels")
    return S.recovered(_meta(spark, d, R.ranked(_scored(spark, d, best=FIRST), FIRST)), queries, search, FIRST)


def governance_recovery(spark, d):
    return _recovered(spark, d)[0].select("qid", "id", "tier", "recovery", F.col("final_rank").cast("int").alias("final_rank"))


def governance_recovery_summary(spark, d):
    return _recovered(spark, d)[1].select("qid", "n_in", "n_kept", "n_out", "collapsed", "n_added", "n_final", "strategy", "collapse_left")


def _items(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "text", "CAST(conv_id * 7 + turn AS BIGINT) AS n")
    end = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("n") % len(ENDINGS)).cast("int"))
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    c = c.withColumn("answer", F.concat_ws(" ", "text", end)).selectExpr("conv_id", "turn", "answer", "n", *(f"{e} AS {k}" for k, e in ITEMS))
    price = F.when(F.col("amount").isNotNull(), F.struct("amount", "currency", F.lit("").alias("period")))
    return c.withColumns({
        "price": price, "sources": F.when(F.col("n") % 5 == 4, arr()).otherwise(arr("Sazebník 2025.pdf")), "must": F.when(F.col("n") % 4 == 1, arr("Kč", "the")).otherwise(arr()), "must_not": F.when(F.col("n") % 6 == 1, arr("2018", "zdarma")).otherwise(arr()),
        "expected_sources": F.when(F.col("n") % 3 == 0, arr("sazebnik")).when(F.col("n") % 3 == 1, arr("VOP")).otherwise(arr()), "price_texts": F.when(F.col("n") % 2 == 0, arr("zdarma")).otherwise(arr()),
    })


METRICS = ("missing", "unexpected", "hallucination", "grounding", "price_right", "ambiguity_right", "refusal_right", "format_right", "failure")


def answer_metrics(spark, d):
    """Three-valued metrics are texts, so that a missing one compares as such."""
    m = E.item_metrics(_items(spark, d))
    return m.select("conv_id", "turn", *(F.col(c).cast("string").alias(c) if c.endswith("_right") else F.col(c) for c in METRICS))


def answer_summary(spark, d):
    return E.report_summary(E.item_metrics(_items(spark, d)), "category")


QUERIES = {f.__name__: f for f in (authority_tiers, governance_suppression, governance_chain, governance_summary, governance_recovery, governance_recovery_summary, answer_metrics, answer_summary)}


def _has(x, terms):
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


def _case(values, x):
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_L = {c: f"lower(coalesce({c}, ''))" for c in ("url", "title", "file_name", "document_type", "category", "chunk_type")}
_HAY = f"({_L['url']} || ' ' || {_L['title']} || ' ' || {_L['file_name']})"
_TIER = (
    f"CASE WHEN document_type = 'pricing' AND {_has(_HAY, G.MIGRATION)} THEN 'migration_notice' WHEN document_type = 'pricing' AND {_has(_HAY, G.ARCHIVED)} THEN 'historical_pdf' WHEN document_type = 'pricing' THEN 'current_pricing' WHEN document_type = 'faq' OR chunk_type = 'faq' THEN 'faq_support_page' "
    + " ".join(f"WHEN regexp_matches({_L['url']}, '{p}') THEN '{t}'" for p, t in G.URL_TIERS)
    + " " + " ".join(f"WHEN regexp_matches({_L['title']}, '{p}') OR regexp_matches({_L['file_name']}, '{p}') THEN '{t}'" for p, t in G.TITLE_TIERS)
    + f" WHEN {_has(_HAY, G.MIGRATION)} THEN 'migration_notice' WHEN {_has(_HAY, G.ARCHIVED)} THEN 'archived_legal' WHEN {_has(_HAY, G.CURRENT)} THEN 'current_pdf' WHEN category IN ('support', 'faq', 'help') THEN 'faq_support_page' WHEN category IN {G.PRODUCT_CATEGORIES!r} THEN 'product_page' ELSE 'unknown' END"
)
_FIELDS = ", ".join(f"{e} AS {n}" for n, e in META)


def _near(a, b):
    return f"(trim(coalesce({a}, '')) <> '' AND trim(coalesce({b}, '')) <> '' AND (contains(lower(trim({a})), lower(trim({b}))) OR contains(lower(trim({b})), lower(trim({a})))))"


_FAM = "(" + " OR ".join(_near(f"a.{k}", f"b.{k}") for k in G.FAMILY_KEYS) + ")"
_GOV = f"""{_bm25()}, m0 AS (SELECT t.qid, t.id, t.score, t.rank::INT AS rank, source, lang FROM {_top(20)} t JOIN documents d ON d.doc_id = t.id), m1 AS (SELECT *, {_FIELDS} FROM m0), meta AS MATERIALIZED (SELECT *, {_TIER} AS tier FROM m1),
firsts AS (SELECT * FROM meta WHERE tier IN {G.CURRENT_TIERS!r} QUALIFY row_number() OVER (PARTITION BY qid, tier ORDER BY rank) = 1),
sup AS MATERIALIZED (SELECT a.*, CASE WHEN tier IN ('archived_legal', 'historical_pdf') AND EXISTS (SELECT 1 FROM firsts b WHERE b.qid = a.qid AND {_FAM}) THEN 'archived_not_beats_current'
WHEN tier = 'historical_pdf' AND (document_type = 'pricing' OR contains(category, 'pricing')) AND EXISTS (SELECT 1 FROM meta b WHERE b.qid = a.qid AND b.tier = 'current_pricing' AND ({_near('a.product', 'b.product')} OR {_FAM})) THEN 'historical_pricing_blocked'
WHEN {_has("lower(coalesce(url, ''))", G.BLOCKED_PARTS)} THEN 'retail_only_source_filter' WHEN tier = 'migration_notice' AND rank = 1 THEN 'migration_notice_not_primary' WHEN tier = 'archived_legal' AND rank = 1 THEN 'archived_legal_not_primary' WHEN tier = 'faq_support_page' AND archived THEN 'deprecated_faq_not_primary' END AS suppressed_by FROM meta a)"""
_CHAIN = f"""{_GOV}, lin AS (SELECT * FROM sup WHERE suppressed_by IS NULL QUALIFY row_number() OVER (PARTITION BY qid, family ORDER BY generation DESC, year DESC, rank) = 1),
pri AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_case(G.PRIORITY, 'tier')}, rank) AS pr FROM lin),
fold AS (SELECT qid, 0::BIGINT AS pos, []::BIGINT[] AS ids, []::VARCHAR[] AS docs, []::VARCHAR[] AS fams FROM (SELECT DISTINCT qid FROM pri) UNION ALL SELECT qid, pr, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(docs, document) ELSE docs END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END FROM (SELECT f.*, p.id, p.pr, p.document, p.family, len(f.ids) < 3 OR (len(list_filter(f.docs, lambda x: x = p.document)) < 2 AND len(list_filter(f.fams, lambda x: x = p.family)) < 3) AS ok FROM fold f JOIN pri p ON p.qid = f.qid AND p.pr = f.pos + 1)),
done AS (SELECT qid, unnest(ids) AS id, unnest(range(1, len(ids) + 1))::INT AS final_rank FROM (SELECT * FROM fold QUALIFY pos = max(pos) OVER (PARTITION BY qid)))"""
_ARR = lambda x, pairs: "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " ELSE []::VARCHAR[] END AS " + x
_FD = lambda x: f"translate(lower({x}), '{T.MARKED}', '{T.PLAIN}')"
_ITEMS = f"""i0 AS (SELECT conv_id, turn, text, (conv_id * 7 + turn)::BIGINT AS n FROM conversations WHERE role = 'assistant'), i1 AS (SELECT conv_id, turn, n, concat_ws(' ', text, {[*ENDINGS]!r}[n % {len(ENDINGS)} + 1]) AS answer, {', '.join(f'{e} AS {k}' for k, e in ITEMS)} FROM i0),
i2 AS (SELECT *, {_ARR('sources', [('n % 5 <> 4', "['Sazebník 2025.pdf']")])}, {_ARR('must', [('n % 4 = 1', "['Kč', 'the']")])}, {_ARR('must_not', [('n % 6 = 1', "['2018', 'zdarma']")])}, {_ARR('expected', [('n % 3 = 0', "['sazebnik']"), ('n % 3 = 1', "['VOP']")])}, {_ARR('price_texts', [('n % 2 = 0', "['zdarma']")])}, {_FD("coalesce(answer, '')")} AS a FROM i1),
i3 AS (SELECT *, {_FD("array_to_string(sources, ' ')")} AS s, regexp_matches(a, '{E.PRICE}') AS priced, len(sources) > 0 AS src, {_has('a', E.CLARIFY)} AS asks FROM i2),
i4 AS (SELECT *, array_to_string(list_filter(must, lambda t: NOT contains(a, {_FD('t')})), ',') AS missing, array_to_string(list_filter(must_not, lambda t: contains(a, {_FD('t')})), ',') AS unexpected,
{_has('a', E.TOO_SURE)} OR (category = 'pricing' AND src AND {_has('a', E.FALLBACK)}) OR (category = 'pricing' AND priced AND NOT src) AS hallucination,
round(least(1.0::DOUBLE, CASE WHEN src OR NOT requires_sources THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN len(expected) > 0 AND len(list_filter(expected, lambda t: contains(s, {_FD('t')}))) > 0 THEN 0.3::DOUBLE WHEN len(expected) = 0 AND src THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(a, 'zdroj') OR contains(a, 'source') OR src THEN 0.3::DOUBLE ELSE 0 END), 4) AS grounding,
CASE WHEN amount IS NOT NULL THEN len(list_filter(price_texts, lambda t: contains(a, t))) > 0 OR (contains(a, amount) AND contains(a, {_FD('currency')})) END AS price_right,
CASE WHEN should_clarify THEN asks AND NOT priced WHEN NOT should_clarify THEN NOT asks END AS ambiguity_right, CASE WHEN refuse THEN {_has('a', E.UNSUPPORTED)} AND NOT priced END AS refusal_right,
CASE WHEN max_chars IS NOT NULL OR forbid_json THEN NOT (coalesce(forbid_json AND regexp_matches(answer, '```|[{{}}]'), false) OR coalesce(length(answer) > max_chars, false)) END AS format_right FROM i3),
items AS (SELECT *, CASE WHEN status_code >= 500 THEN 'api_error' WHEN ambiguity_right = false THEN 'ambiguity_miss' WHEN refusal_right = false THEN 'unsupported_answer' WHEN format_right = false THEN 'format_mismatch' WHEN behaviour = 'direct_answer' AND ((requires_sources AND NOT src) OR precision = 0.0) THEN 'missing_retrieval'
WHEN unexpected <> '' AND regexp_matches(lower(unexpected), 'archiv|2020|2018') THEN 'stale_pricing' WHEN unexpected <> '' THEN 'wrong_product_routing' WHEN price_right = false AND subcategory = 'pricing' THEN 'stale_pricing' WHEN price_right = false THEN 'format_mismatch' WHEN hallucination THEN 'hallucination' WHEN grounding < least_grounding THEN 'missing_source' WHEN missing <> '' THEN 'format_mismatch' END AS failure FROM i4)"""

_SUMMARY = """n AS (SELECT qid, count(*) AS n_in, count(suppressed_by) AS n_suppressed FROM sup GROUP BY 1), k AS (SELECT qid, count(*) AS n_kept FROM pri GROUP BY 1), o AS (SELECT qid, count(*) AS n_out FROM done GROUP BY 1), t AS (SELECT qid, n_in, n_suppressed, coalesce(n_kept, 0) AS n_kept, coalesce(n_out, 0) AS n_out FROM n LEFT JOIN k USING (qid) LEFT JOIN o USING (qid)), c AS (SELECT *, n_suppressed::DOUBLE / n_in > 0.5 OR n_kept < 3 OR n_out < 3 AS collapsed FROM t)"""


def _again(sql: str) -> str:
    """The governance tables once more, under names of the second search."""
    return re.sub(r"\b(m0|m1|meta|firsts|sup|lin|pri|fold|done)\b(?!')", r"\g<1>2", sql)


_WIDER = "trim(concat_ws(' ', text, array_to_string(list_filter(list_concat({base}, CASE l {cases} ELSE [] END), lambda t: NOT contains(lower(text), lower(t)))[1:8], ' ')))".format(base=[*S.BASE_TERMS], cases=" ".join(f"WHEN '{k}' THEN {[*v]}" for k, v in S.LABEL_TERMS.items()))
_CTES = _CHAIN[len(_bm25()) + 2 :]
_FUSED = f"(SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(sum(p), 6) AS score FROM (SELECT qid, id, 0.55::DOUBLE / (60 + rank) AS p FROM {_top(12, 'scoredc')} UNION ALL SELECT qid, id, 0.45::DOUBLE / (60 + rank) FROM {_top(12, 'scorede')}) GROUP BY qid, id) QUALIFY rank <= 12)"
_SECOND = f"""{_CHAIN.replace(_top(20), _top(FIRST))}, {_SUMMARY}, asked AS (SELECT item_id, {_WIDER} AS text FROM (SELECT item_id, text, {LABELS} AS l FROM benchmark) JOIN c ON c.qid = item_id WHERE collapsed),
{_bm25(None, 'c').replace('benchmark', 'asked')}, {_bm25(4, 'e').replace('benchmark', 'asked')}, {_again(_CTES.replace(_top(20), _FUSED))},
known AS (SELECT DISTINCT qid, family FROM (SELECT m.qid, m.family, m.archived FROM meta m WHERE m.rank <= 12 UNION ALL SELECT m.qid, m.family, m.archived FROM done d JOIN meta m USING (qid, id)) WHERE NOT archived AND coalesce(family, '') <> ''),
p1 AS (SELECT d.qid, d.id, d.final_rank, m.family, m.document, m.tier, m.tier NOT IN {S.OLD_TIERS!r} AND NOT m.archived AS cur, EXISTS (SELECT 1 FROM known k WHERE k.qid = d.qid AND k.family = m.family) AS kn FROM done2 d JOIN meta2 m USING (qid, id)),
p2 AS (SELECT * FROM p1 QUALIFY cur OR NOT bool_or(cur) OVER (PARTITION BY qid)), p3 AS (SELECT * FROM p2 QUALIFY kn OR NOT bool_or(kn) OVER (PARTITION BY qid)),
p4 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_rank, id) AS nr FROM p3 WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.qid = p3.qid AND d.id = p3.id) QUALIFY nr <= 2),
mer AS (SELECT d.qid, d.id, d.final_rank AS rank, m.document, m.family, m.tier, false AS recovery FROM done d JOIN meta m USING (qid, id) UNION ALL SELECT p4.qid, p4.id, coalesce((SELECT max(final_rank) FROM done d WHERE d.qid = p4.qid), 0) + nr, document, family, tier, true FROM p4),
fold3 AS (SELECT qid, 0::BIGINT AS pos, []::BIGINT[] AS ids, []::VARCHAR[] AS docs, []::VARCHAR[] AS fams FROM (SELECT DISTINCT qid FROM mer JOIN c USING (qid) WHERE collapsed) UNION ALL SELECT qid, rank, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(docs, document) ELSE docs END, CASE WHEN ok THEN list_append(fams, family) ELSE fams END FROM (SELECT f.*, p.id, p.rank, p.document, p.family, len(f.ids) < 3 OR (len(list_filter(f.docs, lambda x: x = p.document)) < 2 AND len(list_filter(f.fams, lambda x: x = p.family)) < 3) AS ok FROM fold3 f JOIN mer p ON p.qid = f.qid AND p.rank = f.pos + 1)),
fin AS (SELECT d.qid, d.id, d.final_rank FROM done d JOIN c USING (qid) WHERE NOT collapsed UNION ALL SELECT qid, unnest(ids), unnest(range(1, len(ids) + 1))::INT FROM (SELECT * FROM fold3 QUALIFY pos = max(pos) OVER (PARTITION BY qid))),
sm AS (SELECT c.*, CASE WHEN collapsed THEN (SELECT count(*) FROM p4 WHERE p4.qid = c.qid) ELSE 0 END AS n_added, (SELECT count(*) FROM fin WHERE fin.qid = c.qid) AS n_final FROM c)"""

ORACLE_SQL = {
    "governance_recovery": f"WITH RECURSIVE {_SECOND} SELECT fin.qid, fin.id, mer.tier, mer.recovery, fin.final_rank FROM fin JOIN mer USING (qid, id)",
    "governance_recovery_summary": f"WITH RECURSIVE {_SECOND} SELECT qid, n_in, n_kept, n_out, collapsed, n_added, n_final, CASE WHEN n_added > 0 THEN 'governance_recovery' WHEN collapsed THEN 'collapse_detected_no_recovery' WHEN n_out < n_kept THEN 'source_diversity_enforced' WHEN n_suppressed > 0 THEN 'governance_suppressed' ELSE 'normal_retrieval' END AS strategy, collapsed AND n_added = 0 AND n_final < 3 AS collapse_left FROM sm",
    "authority_tiers": f"WITH d AS (SELECT doc_id AS id, source, lang FROM documents), m AS (SELECT id, {', '.join(f'{e} AS {n}' for n, e in META[:6])} FROM d), t AS (SELECT *, {_TIER} AS tier FROM m) SELECT id, tier, round(least(0.30::DOUBLE, greatest(-0.30::DOUBLE, ({_case(G.AUTHORITY, 'tier')}::DOUBLE - 0.5) * 0.6::DOUBLE)), 4) AS boost, {_case(G.PRIORITY, 'tier')} AS priority, coalesce(nullif(trim(category), ''), nullif(trim(document_type), ''), nullif(trim(chunk_type), ''), tier) AS resilience_category FROM t",
    "governance_suppression": f"WITH {_GOV} SELECT qid, id, rank, tier, suppressed_by FROM sup",
    "governance_chain": f"WITH RECURSIVE {_CHAIN} SELECT done.qid, done.id, tier, final_rank FROM done JOIN meta USING (qid, id)",
    "governance_summary": f"WITH RECURSIVE {_CHAIN}, n AS (SELECT qid, count(*) AS n_in, count(suppressed_by) AS n_suppressed FROM sup GROUP BY 1), k AS (SELECT qid, count(*) AS n_kept FROM pri GROUP BY 1), o AS (SELECT qid, count(*) AS n_out FROM done GROUP BY 1), t AS (SELECT qid, n_in, n_suppressed, coalesce(n_kept, 0) AS n_kept, coalesce(n_out, 0) AS n_out FROM n LEFT JOIN k USING (qid) LEFT JOIN o USING (qid)), c AS (SELECT *, n_suppressed::DOUBLE / n_in > 0.5 OR n_kept < 3 OR n_out < 3 AS collapsed FROM t) SELECT *, round(n_suppressed::DOUBLE / n_in, 4) AS suppression_ratio, CASE WHEN collapsed THEN 'collapse_detected_no_recovery' WHEN n_out < n_kept THEN 'source_diversity_enforced' WHEN n_suppressed > 0 THEN 'governance_suppressed' ELSE 'normal_retrieval' END AS strategy FROM c",
    "answer_metrics": f"WITH {_ITEMS} SELECT conv_id, turn, {', '.join(f'{c}::VARCHAR AS {c}' if c.endswith('_right') else c for c in METRICS)} FROM items",
    "answer_summary": f"WITH {_ITEMS} SELECT category, count(*) AS total, count(*) FILTER (failure IS NULL) AS passed, count(failure) AS failed, round(avg((failure IS NULL)::INT), 4) AS pass_rate, round(avg(latency_ms), 1) AS average_latency_ms, round(avg(price_right::INT), 4) AS pricing_accuracy, round(avg(hallucination::INT), 4) AS hallucination_rate, round(1 - avg(refusal_right::INT), 4) AS unsupported_answer_rate, round(avg(grounding), 4) AS avg_grounding, round(avg(ambiguity_right::INT), 4) AS ambiguity_correctness, round(avg(format_right::INT), 4) AS format_rate, round(avg(precision), 4) AS precision_at_3 FROM items GROUP BY 1",
}
