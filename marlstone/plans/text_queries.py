"""Queries of the text functions, noise predicates, prices and urls, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import quality as Q
from marlstone.functions import text as T
from marlstone.operators import chunk as C

BAN, WANT = ("blog", "news", "en"), ("product", "th", "re")
CATEGORIES = [("license", ("license", "copyright")), ("contact", ("@", "http")), ("code", ("</", "{", "| "))]
VOCABULARY = ("the", "of", "and", "der", "und", "les", "que", "limit", "produkt")
REPLACEMENTS = [("the", "th"), ("th", "t"), ("der", "die"), ("que", "k")]


#: The confidence of a text's OCR engine, by its number.
ENGINE = "CASE doc_id % 4 WHEN 0 THEN CAST(0.2 AS DOUBLE) WHEN 1 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def text_clean(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.clean(x)).alias("cleaned"), F.md5(T.join_hyphens(x)).alias("hyphens"), F.md5(T.parser_clean(x)).alias("parsed"), F.md5(T.web_clean(x)).alias("web"), F.md5(T.fold(x)).alias("folded"))


def cache_keys(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.cache_key(x)).alias("cache_key"), F.md5(T.governed_key(x)).alias("governed_key"), F.md5(T.cascade(F.lower(x), REPLACEMENTS)).alias("cascaded"))


def tokenize(spark, d):
    x = F.col("text")
    it, qt, ts = T.index_tokens(x), T.query_tokens(x), T.token_set(x)
    return _docs(spark, d).select("doc_id", F.size(it).alias("n_index"), F.md5(F.array_join(it, " ")).alias("index_md5"), F.size(qt).alias("n_query"), F.md5(F.array_join(qt, " ")).alias("query_md5"), F.size(ts).alias("n_set"))


def hash_ids(spark, d):
    h = T.content_hash(F.col("text"))
    return _docs(spark, d).select("doc_id", h.alias("content_hash"), T.short_id(F.col("source"), F.lit(None), F.col("doc_id")).alias("chunk_id"), T.uint64(F.substring(h, 1, 16)).cast("string").alias("point_id"), T.signature(F.col("text")).alias("signature"), F.substring(F.sha2(F.col("source"), 256), 1, 24).alias("source_hash"))


def approx_tokens_limit(spark, d):
    return _docs(spark, d).select("doc_id", T.approx_tokens(F.col("text")).alias("approx_tokens"), T.within_embed_limit(F.col("text")).alias("within_limit"))


def document_dates(spark, d):
    x = F.concat_ws(" ", F.col("text"), F.format_string("%d.%d.20%02d", F.pmod("doc_id", F.lit(33)), F.pmod("doc_id", F.lit(14)), F.pmod("doc_id", F.lit(40))))
    return _docs(spark, d).select("doc_id", T.document_date(x).alias("document_date"), T.document_year(x).alias("document_year"))


def quality_flags(spark, d):
    x = F.col("text")
    return _docs(spark, d).select("doc_id", Q.low_information(x).alias("low_information"), Q.navigation(x).alias("navigation"), Q.low_alpha(x).alias("low_alpha"), Q.broken_marks(x).alias("broken_marks"), Q.symbol_noise(x).alias("symbol_noise"))


def chunk_quality_score(spark, d):
    return Q.scored_chunks(_docs(spark, d).select("doc_id", "text")).drop("text")


def garbage_text(spark, d):
    return _docs(spark, d).select("doc_id", Q.letter_runs(F.col("text")).alias("runs"), Q.scrambled(F.col("text")).alias("scrambled"), Q.corrupted_ocr(F.col("text")).alias("corrupted"), Q.garbage(F.col("text")).alias("garbage"))


def chunk_garbage(spark, d):
    """Over the first words of every document too, where short and odd texts are."""
    x = F.col("text")
    head = F.array_join(F.slice(Q.word_list(x), 1, 4), " ")
    return _docs(spark, d).select("doc_id", Q.garbage_chunk(x).alias("whole"), Q.garbage_chunk(head).alias("head"), F.round(Q.vocabulary_share(x, VOCABULARY), 6).alias("known_share"))


def ocr_quality(spark, d):
    x = F.col("text")
    d = _docs(spark, d).select("doc_id", Q.ocr_result(x, F.expr(ENGINE)).alias("r"), F.array_join(Q.file_issues(x), ",").alias("file_issues"))
    return d.select("doc_id", "r.score", F.array_join("r.issues", ",").alias("issues"), "file_issues")


def categories(spark, d):
    return _docs(spark, d).select("doc_id", Q.first_rule(F.col("text"), CATEGORIES, "general").alias("category"))


def fixed_window_chunks(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(C.fixed_windows(F.col("text"))).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def recursive_chunks(spark, d):
    return C.recursive_chunks(_docs(spark, d))


def url_normalize(spark, d):
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.url_host(u).alias("host"), T.normal_url(u).alias("plain"), T.normal_url(u, True).alias("with_query"), T.url_slug(u).alias("slug"), T.display_url(u).alias("display"), T.has_segment(u, WANT, BAN).alias("product_url"))


QUERIES = {f.__name__: f for f in (text_clean, cache_keys, tokenize, hash_ids, approx_tokens_limit, document_dates, quality_flags, chunk_quality_score, garbage_text, chunk_garbage, ocr_quality, categories, fixed_window_chunks, recursive_chunks, url_normalize)}

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')".replace(r"\t", "\t").replace(r"\n", "\n")
_HYPHEN = "regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)-\n([\\p{{L}}\\p{{N}}_]+)', '\\1\\2', 'g')"


def _boiler(x: str) -> str:
    for p in T.BOILERPLATE:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


def _clean(x: str) -> str:
    return _CLEAN.format(x=x)


_FOLD = f"translate(lower({{x}}), '{T.MARKED}', '{T.PLAIN}')"
_W = r"[^ \t\n\x0b\f\r]+"
_N = "len(regexp_extract_all({x}, '{p}'))"


def _n(p: str, x: str = "text") -> str:
    return f"len(regexp_extract_all({x}, '{p}'))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _re(p: str) -> str:
    return p.replace("(?iu)", "(?i)")


def _split(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


def _share(p: str, x: str) -> str:
    return f"({_n(p, x)}::DOUBLE / greatest(length({x}), 1))"


def _edge(marks: str) -> str:
    return rf"regexp_replace(w, '^[{marks}]+|[{marks}]+$', '', 'g')"


#: Every doubled letter spelt out, as the oracle's expressions have no back-references.
_RUNS = "|".join(f"{chr(c)}{chr(c)}+" for c in [*range(65, 91), *range(97, 123), *range(0xC1, 0x17F)])
_SCR = rf"(len({_split('{x}')}) >= 5 AND len(list_filter({_split('{x}')}, lambda w: length({_edge(r'.,;:()\[\]{{}}|!?')}) <= 1))::DOUBLE / greatest(len({_split('{x}')}), 1) > 0.35)"


def _rules(x: str) -> dict[str, str]:
    """The noise predicates of the text in column x."""
    t = _strip(x)
    r = {
        "li": rf"(length({t}) < 20 OR {_n(r'\p{L}', x)} < 10 OR regexp_matches({t}, '{_re(Q.PENDING)}'))",
        "nav": f"(({_n(_W, x)} < 10 AND {_n(Q.NAV, x)} >= 2) OR ({_n(_W, x)} >= 10 AND {_n(Q.NAV, x)}::DOUBLE / greatest({_n(_W, x)}, 1) > 0.3))",
        "runs": _n(_RUNS, x),
        "ocr": f"(regexp_matches({x}, '{Q.SCATTERED}') OR regexp_matches({x}, '{Q.DOTS}') OR regexp_matches({x}, '{Q.MARKS}'))",
        "alpha": rf"(length({x}) = 0 OR {_share(r'\p{L}', x)} < 0.40)",
        "marks": rf"(regexp_matches({x}, '[\x{{E000}}-\x{{F8FF}}]') OR {_share(rf'[^\x00-\x7f{Q.KNOWN_MARKS}]', x)} > 0.15)",
        "symbol": rf"(length({x}) = 0 OR {_share(r'[^\p{L}\p{N} \t\n\x0b\f\r]', x)} > 0.20)",
        "scr": _SCR.replace("{x}", x).replace("{{", "{").replace("}}", "}"),
    }
    r["garbage"] = f"(length({t}) < 10 OR {r['scr']} OR {r['runs']} >= 5 OR ({r['runs']} >= 3)::INT + {r['ocr']}::INT + {r['alpha']}::INT + {r['marks']}::INT + {r['symbol']}::INT + {r['scr']}::INT >= 2)"
    r["chunk"] = rf"({r['li']} OR {r['nav']} OR {r['garbage']} OR {_share(r'\p{N}', x)} > 0.6)"
    return r


_R = _rules("text")
_PATH = r"regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))"
_NORMAL = rf"lower(regexp_extract(url, '^([a-zA-Z]+://)', 1)) || {_HOST} || regexp_replace(regexp_replace({_PATH}, '/{{2,}}', '/', 'g'), '/$', '')"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"


def _any(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(s, '{w}')" for w in words)


_CASCADE = "lower(text)"
for _a, _b in REPLACEMENTS:
    _CASCADE = f"replace({_CASCADE}, '{_a}', '{_b}')"
_DATED = "(text || ' ' || (doc_id % 33)::VARCHAR || '.' || (doc_id % 14)::VARCHAR || '.20' || lpad((doc_id % 40)::VARCHAR, 2, '0'))"


def _date(p: str, y: int, m: int, d: int) -> str:
    part = lambda i: f"TRY_CAST(nullif(regexp_extract({_DATED}, '{p}', {i}), '') AS INTEGER)"
    return f"CASE WHEN {part(m)} BETWEEN 1 AND 12 AND {part(d)} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {part(y)}, {part(m)}, {part(d)}) END"



ORACLE_SQL = {
    "text_clean": f"SELECT doc_id, md5({_clean('text')}) AS cleaned, md5({_HYPHEN.format(x='text')}) AS hyphens, md5({_clean(_boiler(_HYPHEN.format(x='text')))}) AS parsed, md5({_clean(_boiler('translate(text, chr(8203) || chr(173), ' + chr(39) * 2 + ')'))}) AS web, md5({_FOLD.format(x='text')}) AS folded FROM documents",
    "cache_keys": rf"WITH t AS (SELECT doc_id, text, list_filter(string_split(regexp_replace({_FOLD.format(x='text')}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents), u AS (SELECT *, array_to_string(list_filter(w, lambda x: x NOT IN ({', '.join(repr(f) for f in T.FILLERS)})), ' ') AS k FROM t) SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_FOLD.format(x='text')}, '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))) AS cache_key, md5(CASE WHEN k = '' THEN array_to_string(w, ' ') ELSE k END) AS governed_key, md5({_CASCADE}) AS cascaded FROM u",
    "tokenize": rf"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{T.WORD}') AS i, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '') AS q, list_distinct(list_filter(regexp_extract_all({_FOLD.format(x='text')}, '{T.WORD}'), lambda w: length(w) > 1)) AS s FROM documents) SELECT doc_id, len(i)::INT AS n_index, md5(array_to_string(i, ' ')) AS index_md5, len(q)::INT AS n_query, md5(array_to_string(q, ' ')) AS query_md5, len(s)::INT AS n_set FROM t",
    "hash_ids": rf"SELECT doc_id, sha256({_clean('text')}) AS content_hash, substr(sha256(source || ':None:' || doc_id::VARCHAR), 1, 16) AS chunk_id, (('0x' || substr(sha256({_clean('text')}), 1, 16))::UBIGINT)::VARCHAR AS point_id, md5(array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}} ]', '', 'g'), ' '), lambda w: w <> '')), ' ')) AS signature, substr(sha256(source), 1, 24) AS source_hash FROM documents",
    "approx_tokens_limit": f"SELECT doc_id, greatest(length(text) // 3, {_n(_W)})::BIGINT AS approx_tokens, length(text) <= 4000 AND greatest(length(text) // 3, {_n(_W)}) <= 1500 AS within_limit FROM documents",
    "document_dates": f"SELECT doc_id, coalesce({_date(r'\b(\d{1,2})\.\s?(\d{1,2})\.\s?(20\d\d)\b', 3, 2, 1)}, {_date(r'\b(\d{2})(\d{2})(20\d\d)\b', 3, 2, 1)}, {_date(r'\b(20\d\d)-(\d{2})-(\d{2})\b', 1, 2, 3)}) AS document_date, list_max(list_filter(list_transform(regexp_extract_all({_DATED}, '\\b(19\\d\\d|20\\d\\d)\\b', 1), lambda y: y::INT), lambda y: y BETWEEN 2000 AND 2027)) AS document_year FROM documents",
    "quality_flags": f"SELECT doc_id, {_R['li']} AS low_information, {_R['nav']} AS navigation, {_R['alpha']} AS low_alpha, {_R['marks']} AS broken_marks, {_R['symbol']} AS symbol_noise FROM documents",
    "chunk_quality_score": rf"""WITH t AS (SELECT doc_id, {_R['li']} AS li, {_R['nav']} AS nav, {_R['garbage']} AS gt, {_R['runs']} AS runs, {_R['scr']} AS sc, {_share(r'\p{L}', 'text')} AS alpha FROM documents),
u AS (SELECT *, CASE WHEN alpha < 0.40 THEN 1 - alpha / 0.40::DOUBLE ELSE 0.0::DOUBLE END AS n0 FROM t), v AS (SELECT *, CASE WHEN runs >= 2 THEN least(1.0::DOUBLE, n0 + 0.15::DOUBLE * runs) ELSE n0 END AS n1 FROM u),
w AS (SELECT *, CASE WHEN sc THEN least(1.0::DOUBLE, n1 + 0.30::DOUBLE) ELSE n1 END AS noise FROM v), x AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 0.40::DOUBLE * li::INT - 0.30::DOUBLE * nav::INT - 0.40::DOUBLE * gt::INT - 0.3::DOUBLE * noise)) AS s FROM w)
SELECT doc_id, round(s, 3) AS score, round(noise, 3) AS ocr_noise, array_to_string(list_filter([CASE WHEN li THEN 'low_information' END, CASE WHEN nav THEN 'navigation' END, CASE WHEN gt THEN 'garbage_text' END, CASE WHEN runs >= 2 THEN 'repeated_chars' END, CASE WHEN sc THEN 'scrambled' END], lambda r: r IS NOT NULL), ',') AS reasons, s < 0.35 OR gt AS is_garbage FROM x""",
    "garbage_text": f"SELECT doc_id, {_R['runs']}::INT AS runs, {_R['scr']} AS scrambled, {_R['ocr']} AS corrupted, {_R['garbage']} AS garbage FROM documents",
    "chunk_garbage": rf"WITH t AS (SELECT doc_id, text, array_to_string({_split('text')}[1:4], ' ') AS h, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS v FROM documents) SELECT doc_id, {_R['chunk']} AS whole, {_rules('h')['chunk']} AS head, round(len(list_intersect(v, {list(VOCABULARY)!r}))::DOUBLE / greatest(len(v), 1), 6) AS known_share FROM t",
    "ocr_quality": rf"""WITH t AS (SELECT doc_id, text, lower(text) AS low, {_strip('text')} AS s FROM documents), u AS (SELECT *, {_split('s')} AS ws, length({_strip('text')}) AS n, coalesce(length(regexp_replace(text, '[^0-9A-Za-zÀ-ɏ]', '', 'g')), 0) AS m FROM t),
v AS (SELECT *, n < 50 AS a, len(list_filter(list_distinct(string_split(lower(s), '')), lambda c: c NOT IN (chr(10), chr(13)) AND contains(lower(s), repeat(c, 10)))) > 0 AS b, {_share(r'\s', 's')} < 0.03 AND n > 100 AS c, 1 - {_share(r'[\p{L}\p{N}]', 's')} > 0.55 AS d, len(ws) > 20 AND len(list_filter(ws, lambda w: length({_edge(r'.,;:()\[\]{}|')}) = 1))::DOUBLE / greatest(len(ws), 1) > 0.35 AS e, coalesce({ENGINE} < 0.3, false) AS g FROM u),
w AS (SELECT *, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - CASE WHEN a THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN b THEN 0.25::DOUBLE ELSE 0 END - CASE WHEN c THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN d THEN 0.30::DOUBLE ELSE 0 END - CASE WHEN e THEN 0.20::DOUBLE ELSE 0 END - CASE WHEN g THEN 0.25::DOUBLE ELSE 0 END), 4) AS score FROM v)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE score END AS score, CASE WHEN n = 0 THEN 'empty_output' ELSE array_to_string(list_filter([CASE WHEN a THEN 'too_short' END, CASE WHEN b THEN 'repeated_single_chars' END, CASE WHEN c THEN 'few_or_no_spaces' END, CASE WHEN d THEN 'mostly_non_alphanumeric' END, CASE WHEN e THEN 'many_single_character_tokens' END, CASE WHEN g THEN 'low_engine_confidence' END, CASE WHEN score < 0.3 THEN 'below_min_quality' END], lambda r: r IS NOT NULL), ',') END AS issues,
array_to_string(list_filter([CASE WHEN n = 0 THEN 'empty_file' END, CASE WHEN length(text) > 100 AND (20000 * (length(text) - m) + length(text)) // (2 * length(text)) > 7500 THEN 'ocr_garbage_suspected' END, CASE WHEN m < 200 THEN 'boilerplate_or_too_short' END, CASE WHEN {' + '.join(_n(w, 'low') for w in Q.NAV_WORDS)} >= 5 AND {' + '.join(_n(w, 'low') for w in Q.CONTENT_WORDS)} = 0 AND m < 800 THEN 'nav_only_page' END], lambda r: r IS NOT NULL), ',') AS file_issues FROM w""",
    "categories": "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {t!r})' for t in terms)} THEN '{n}'" for n, terms in CATEGORIES) + " ELSE 'general' END AS category FROM documents",
    "fixed_window_chunks": "WITH t AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 200) / 800.0)::INT))) AS i FROM documents) SELECT doc_id, i::INT AS chunk_index, length(substr(text, i::INT * 800 + 1, 1000))::INT AS n_chars, md5(substr(text, i::INT * 800 + 1, 1000)) AS chunk_md5 FROM t",
    "url_normalize": rf"SELECT page_id, {_HOST} AS host, {_NORMAL} AS plain, {_NORMAL} || regexp_extract(url, '(\?[^#]*)', 1) AS with_query, substr(regexp_replace(lower(regexp_replace(url, '^[a-zA-Z]+://', '')), '[^a-z0-9]+', '-', 'g'), 1, 120) || '-' || substr(sha256(url), 1, 10) AS slug, substr(array_to_string(list_concat([{_HOST}], list_slice({_PARTS}, greatest(1, len({_PARTS}) - 1), len({_PARTS}))), '/'), 1, 60) AS display, len(list_filter(string_split(lower({_PATH}), '/'), lambda s: {_any(WANT)})) > 0 AND len(list_filter(string_split(lower({_PATH}), '/'), lambda s: {_any(BAN)})) = 0 AS product_url FROM pages",
}
