"""Text functions as Column expressions: Column in, Column out, nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks and the plain letters that take their place.
MARKED, PLAIN = "áàâäãåçčďéèêëěíìîïñňóòôöõřšťúùûüůýÿžß", "aaaaaaccdeeeeeiiiinnooooorstuuuuuyyzs"
WORD = r"[\p{L}\p{N}_]+"
#: Header and footer lines, taken out in this order (swap for a corpus of your own).
BOILERPLATE = (r"(?im)^page \d+( of \d+)?$", r"(?im)^all rights reserved\.?$", r"(?im)^released under .{0,80} licen[sc]e\.?$", r"(?im)^copyright .{0,80}$", r"(?im)^confidential\.?$", r"(?im)^www\.\S+$")
FILLERS = ("the", "a", "an", "of", "to", "please", "is", "what", "how", "for")


def clean(x: Column) -> Column:
    """Non-breaking space to space, runs of spaces and tabs to one, three or more newlines to two, trimmed."""
    x = _where(F.replace(x, F.lit("\u00a0"), F.lit(" ")), lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")), lambda t: F.regexp_replace(t, r"[ \t]+", " "))
    x = _where(x, lambda t: F.contains(t, F.lit("\n\n\n")), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return stripped(x)


def stripped(x: Column) -> Column:
    """Without white space at the ends; the pattern is tried only on texts that begin or end with what it can take or end at."""
    ends = lambda t: F.substring(t, 1, 1).isin(*" \t\n\x0b\f\r") | F.substring(t, -1, 1).isin(*" \t\n\x0b\f\r\x85\u2028\u2029")
    return _where(x, ends, lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


def _where(x: Column, some: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    """x, or what is made of it where `some` holds; x is computed once."""
    return F.transform(F.array(x), lambda t: F.when(some(t), made(t)).otherwise(t))[0]


def join_hyphens(x: Column) -> Column:
    return F.regexp_replace(x, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")


def drop_boilerplate(x: Column, patterns: tuple[str, ...] = BOILERPLATE) -> Column:
    for p in patterns:
        x = F.regexp_replace(x, p, "")
    return x


def parser_clean(x: Column) -> Column:
    return clean(drop_boilerplate(join_hyphens(x)))


def web_clean(x: Column) -> Column:
    return clean(drop_boilerplate(F.translate(x, "\u200b\u00ad", "")))


def fold(x: Column) -> Column:
    """Lower case without marks."""
    return F.translate(F.lower(x), MARKED, PLAIN)


def cache_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(x), r"[^a-z0-9\s]", ""), r"\s+", " "))


def governed_key(x: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Punctuation to space and filler words out; the unfiltered words if none is left."""
    words = F.filter(F.split(F.regexp_replace(fold(x), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(*fillers)), " ")
    return F.when(kept == "", F.array_join(words, " ")).otherwise(kept)


def cascade(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered replacements, each on the result of those before."""
    for a, b in rules:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def index_tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def query_tokens(x: Column) -> Column:
    words = F.split(F.lower(x), r"[ \t\n\x0b\f\r]+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def token_set(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0)), lambda w: F.length(w) > 1)))


def content_hash(x: Column) -> Column:
    return F.sha2(clean(x), 256)


def signature(x: Column) -> Column:
    """md5 of the sorted words: equal for texts with the same words in any order."""
    kept = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N} ]", "")
    return F.md5(F.array_join(F.array_sort(F.filter(F.split(kept, " "), lambda w: w != "")), " "))


def short_id(*parts: Column, size: int = 16) -> Column:
    """Prefix of a sha256; a null part reads None, as in ids already in use."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256), 1, size)


def uint64(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def approx_tokens(x: Column) -> Column:
    return F.greatest(F.floor(F.length(x) / 3), F.size(F.regexp_extract_all(x, F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))).cast("long"))


def within_embed_limit(x: Column, chars: int = 4000, tokens: int = 1500) -> Column:
    """Words are counted only where there can be too many: each takes a character and one between."""
    n_words = F.size(F.regexp_extract_all(x, F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0)))
    return (F.length(x) <= chars) & (F.floor(F.length(x) / 3) <= tokens) & ((F.length(x) <= 2 * tokens) | (n_words <= tokens))


def years(x: Column, least: int = 2000, most: int = 2027) -> Column:
    """Four-digit years between least and most, in order of appearance."""
    found = F.transform(F.regexp_extract_all(x, F.lit(r"\b(19\d\d|20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: (y >= least) & (y <= most))


def document_year(x: Column, least: int = 2000, most: int = 2027) -> Column:
    return F.array_max(years(x, least, most))


def document_date(x: Column) -> Column:
    """First of d.m.yyyy, ddmmyyyy and ISO; null if day or month is out of range."""
    part = lambda p, i: F.regexp_extract(x, p, i)
    dotted, packed, iso = r"\b(\d{1,2})\.\s?(\d{1,2})\.\s?(20\d\d)\b", r"\b(\d{2})(\d{2})(20\d\d)\b", r"\b(20\d\d)-(\d{2})-(\d{2})\b"

    def made(y: Column, m: Column, d: Column) -> Column:
        y, m, d = (F.nullif(v, F.lit("")).cast("int") for v in (y, m, d))
        ok = m.between(1, 12) & d.between(1, 31)
        return F.when(ok, F.format_string("%04d-%02d-%02d", y, m, d))

    return F.coalesce(made(part(dotted, 3), part(dotted, 2), part(dotted, 1)), made(part(packed, 3), part(packed, 2), part(packed, 1)), made(part(iso, 1), part(iso, 2), part(iso, 3)))


def url_host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#]+)", 1))


def url_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def normal_url(u: Column, keep_query: bool = False) -> Column:
    """Fragment off, repeated slashes to one, trailing slash off, host in lower case; the query stays or goes."""
    path = F.regexp_replace(F.regexp_replace(url_path(u), "/{2,}", "/"), "/$", "")
    query = F.regexp_extract(u, r"(\?[^#]*)", 1) if keep_query else F.lit("")
    return F.concat(F.lower(F.regexp_extract(u, r"^([a-zA-Z]+://)", 1)), url_host(u), path, query)


def url_slug(u: Column) -> Column:
    return F.concat(F.substring(F.regexp_replace(F.lower(F.regexp_replace(u, r"^[a-zA-Z]+://", "")), "[^a-z0-9]+", "-"), 1, 120), F.lit("-"), F.substring(F.sha2(u, 256), 1, 10))


def display_url(u: Column) -> Column:
    """Host and the last two parts of the path, 60 characters at most."""
    parts = F.filter(F.split(url_path(u), "/"), lambda s: s != "")
    last = F.when(F.size(parts) > 2, F.slice(parts, -2, 2)).otherwise(parts)
    return F.substring(F.array_join(F.concat(F.array(url_host(u)), last), "/"), 1, 60)


def has_segment(u: Column, want: tuple[str, ...], ban: tuple[str, ...]) -> Column:
    """Any wanted part and no banned one in a segment of the path."""
    parts = F.split(F.lower(url_path(u)), "/")
    hit = lambda words: F.exists(parts, lambda s: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(s, w)))
    return hit(want) & ~hit(ban)


def source_year(*fields: Column) -> Column:
    """The first year from 1950 to 2050 of the first field that holds one; fields in order of trust."""
    found = (F.regexp_extract(f.cast("string"), r"(?:^|[^\p{L}\p{N}_])(19[5-9]\d|20[0-4]\d|2050)(?:$|[^\p{L}\p{N}_])", 1) for f in fields)
    return F.coalesce(*(F.nullif(y, F.lit("")).cast("int") for y in found))


# Path parts that say nothing, and titles by category.
PLAIN_PARTS = ("cs", "en", "attachments", "documents", "files", "download")
CATEGORY_TITLES = [
    ("retail", "Produktová stránka — Retail"), ("corporate", "Produktová stránka — Corporate"), ("business", "Produktová stránka — Business"),
    ("investing", "Investiční dokument"), ("insurance", "Pojištění"),
]


def title_case(x: Column) -> Column:
    """The first letter of each run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def looks_hashed(x: Column) -> Column:
    """10 characters at least, more than three quarters of them hexadecimal digits in lower case."""
    return (F.length(x) >= 10) & (F.length(F.regexp_replace(x, "[^0-9a-f]", "")) > 0.75 * F.length(x))


def file_title(x: Column) -> Column:
    """A file name without its ending and hashes, words apart, 80 characters at most."""
    name = F.regexp_replace(F.regexp_replace(x, r"\.[^.]*$", ""), "_[a-f0-9]{8,}", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(name, "[_-]", " "), r"[ \t\n\x0b\f\r]+", " ")), 1, 80)


def human_title(title: Column, url: Column, file_name: Column, category: Column, chunk_type: Column) -> Column:
    """A title to show: the title itself, else the end of the URL's path, else the file name, else the category or the
    chunk type; hashes are passed over. Nulls count as empty."""
    title, url, file_name, category, chunk_type = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, url, file_name, category, chunk_type))
    parts = F.filter(F.split(url_path(url), "/"), lambda p: (p != "") & ~p.isin(*PLAIN_PARTS))
    last = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    path = F.substring(F.array_join(F.transform(last, lambda p: title_case(F.trim(F.regexp_replace(p, "[-_]", " ")))), " — "), 1, 80)
    plain = file_title(file_name)
    by_category = F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in CATEGORY_TITLES))
    return F.coalesce(
        F.when((F.length(title) > 5) & ~looks_hashed(title), file_title(title)),
        F.when(path != "", path),
        F.when((file_name != "") & ~looks_hashed(file_name) & (F.length(plain) > 3), plain),
        by_category,
        F.when(chunk_type != "", F.concat(F.lit("Dokument — "), title_case(F.replace(chunk_type, F.lit("_"), F.lit(" "))))),
        F.lit("Dokument"),
    )


# Where a path starts that no page is taken from, and what must not occur in it.
BLOCKED_STARTS = ("/pro-media/", "/tiskove-zpravy/", "/tiskové-zprávy/", "/novinky/", "/kariera/", "/kariéra/", "/blog/", "/media/", "/attachments/kariera")
BLOCKED_WORDS = ("tisková zpráva", "tiskova zprava", "pro média", "pro media", "novinka", "kariera", "kariéra", "blog", "press release", "media relations", "pro novináře", "pro novinare")


def blocked_section(url: Column) -> Column:
    """Whether an address, or a bare path, is of a section that no page is taken from."""
    path = F.lower(F.when(F.contains(url, F.lit("://")), url_path(url)).otherwise(url))
    out = F.lit(False)
    for s in BLOCKED_STARTS:
        out = out | path.startswith(s)
    for w in BLOCKED_WORDS:
        out = out | F.contains(path, F.lit(w))
    return out
