"""Price texts of tariff rows: normal values, billing periods, conditional prices and answer texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import text as T

# The vocabulary of the tariffs. It must be as it is for results to match.
FREE = r"\bzdarma\b|\b0\s*(?:kc|czk)\b|\bbez\s+poplatku\b|\bfee\s+waived\b|\bfirst\s+year\s+free\b"
NUMBER = r"\d+(?:[ .]\d{3})*(?:[,.]\d+)?"
MONTHLY, YEARLY = ("mesic", "mesicne", "monthly"), ("rocne", "year", "annual")
CONDITIONS = [
    ("active_usage", ("aktivnim vyuziv", "aktivne vyuziv", "aktivni vyuziv", "aktivni pouziv")),
    ("turnover", ("obrat", "obratu")),
    ("minimum_income", ("minimalni prijem", "prijem", "prichozich plateb", "prichozi platby")),
    ("premium_tier", ("premium", "premiovy", "premiove", "vyhody premium")),
    ("condition_met", ("pri splneni podminek", "splneni podminek", "podmink")),
]
SIGNALS = (
    "zdarma pri aktivnim vyuzivani", "pri aktivnim vyuzivani", "pokud neni ucet aktivne vyuzivan", "pri splneni podminek", "pri obratu", "minimalnim prijmu",
    "minimalni prijem", "premium tier",
)
ABOLISHED = ("zrusen", "zruseni", "zrusuje", "zruseno", "rusi se", "odstranen", "bez poplatku", "poplatek se neuctuje")
FREE_VALUES = ("zdarma", "bez poplatku", "0 kc")
ACTIVE_TEXT, LOGIC = "při aktivním využívání účtu", "conditional_price_applies_when_condition_met_else_base_price"
VALUE_PATTERNS = (
    r"(\bzdarma\b)",
    r"(\b\d+[\s\d]*(?:[,.]\d+)?\s*(?:Kč|CZK)(?:\s*(?:měsíčně|mesicne|ročně|rocne|za\s+[\p{L}\p{N}_]+))?)",
    r"(\b\d+[,.]?\d*\s*%)",
    r"(\b\d+[\s\d]*(?:[,.]\d+)?\s*(?:měsíčně|mesicne|ročně|rocne))(?:[^\p{L}\p{N}_]|$)",
)
SUFFIXES = ("vedení jednoho běžného účtu měsíčně", "vedení jednoho běžného účtu", "vedení účtu měsíčně", "vedení účtu", "měsíčně", "v ceně", "cena")
PRESERVED = ("ekonto smart", "ekonto výhody prémium", "ekonto vyhody premium", "aktivní účet", "aktivni ucet", "ekonto komplet")
BLACKLIST = (
    "správa služby", "správa každé", "telefonní bankovnictví", "telefonni bankovnictvi", "informuj mě", "informuj me", "sms", "notifikace",
    "multicurrency", "doplňkové služby", "doplnkove sluzby", "měnová složka", "menova slozka", "měnové složky", "menove slozky",
)
SUMMARIES = [
    ("active_usage", "při aktivním využívání účtu"), ("turnover", "při splnění podmínky obratu"), ("minimum_income", "při splnění minimálního příjmu"),
    ("premium_tier", "v prémiovém tarifu / při splnění prémiových podmínek"),
]

# Parts of fee names that aren't an account's own fee, and words that together are one.
NOT_PRIMARY = (
    "vedlejsi", "menove", "elektronicky", "elektronickeho", "mobilni", "investicni", "uhrada", "uhrady", "platba", "prikaz", "import", "hromadny",
    "pronajem", "bezpecnostni", "vyzva", "dluh", "nestandardni", "vypis", "vypisu", "potvrzeni", "sprava", "spravy", "nastaveni", "notifikac", "telefon",
    "sms", "informuj", "doplnkov", "doplnkove", "balicek sluzeb", "multicurrency",
)
PRIMARY_SETS = (("vedeni", "uctu"), ("vedeni", "bezneho", "uctu"), ("cena", "tarifu"), ("poplatek", "vedeni"), ("mesicni", "poplatek"))
PRIMARY_ENGLISH = (("account", "maintenance"), ("monthly", "account", "fee"))


def has_any(x: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(x, F.lit(t))
    return out


def joined(*parts: Column) -> Column:
    """The parts with a space between, nulls as empty ones."""
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def number(x: Column) -> Column:
    """The first number: spaces and dots separate thousands, a comma decimals."""
    n = F.regexp_extract(x, f"({NUMBER})", 1)
    return F.when(n != "", F.replace(F.regexp_replace(n, "[ .]", ""), F.lit(","), F.lit(".")).try_cast("double"))


def billing_period(x: Column, period: Column) -> Column:
    t = joined(T.fold(x), T.fold(period))
    return F.when(has_any(t, MONTHLY), "monthly").when(has_any(t, YEARLY), "yearly").otherwise("monthly")


def is_free(x: Column) -> Column:
    return T.fold(x).rlike(FREE)


def price_number(x: Column) -> Column:
    """0 for free, else the first number."""
    return F.when(is_free(x), F.lit(0.0)).otherwise(number(x))


def normalized_price(value: Column, period: Column) -> Column:
    """struct(price, currency, billing_period, label, raw) of a price text; a null one is empty."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    norm, free, amount = T.fold(raw), is_free(raw), number(raw)
    euro = F.contains(norm, F.lit("eur")) | F.contains(raw, F.lit("€"))
    currency = F.when(free, "CZK").when(euro, "EUR").when(has_any(norm, ("kc", "czk")) | (amount == 0), "CZK")
    label = F.when(free, "free").when(amount.isNotNull(), "amount").otherwise("unknown")
    return F.struct(price_number(raw).alias("price"), currency.alias("currency"), billing_period(raw, period).alias("billing_period"), label.alias("label"), raw.alias("raw"))


def condition_type(x: Column) -> Column:
    norm = T.fold(x)
    return F.coalesce(*(F.when(has_any(norm, terms), F.lit(name)) for name, terms in CONDITIONS))


def conditional_price(product: Column, fee: Column, value: Column, period: Column, conditions: Column, title: Column) -> Column:
    """struct(base_price, conditional_price, currency, billing_period, condition_type, condition_text, logic) of a row whose
    texts speak of a condition, else null. The price under the condition is 0 if the row says free, else the first
    number; the base price is the last number that differs."""
    text = joined(product, fee, value, period, conditions, title)
    norm = T.fold(text)
    found = F.regexp_extract_all(text, F.lit(rf"(?iu){NUMBER}\s*(?:Kč|CZK|kc)?"), F.lit(0))
    numbers = F.filter(F.transform(found, price_number), lambda n: n.isNotNull())
    cond = F.when(F.contains(norm, F.lit("zdarma")), F.lit(0.0)).otherwise(F.get(numbers, F.lit(0)))
    base = F.try_element_at(F.filter(numbers, lambda n: cond.isNull() | (n != cond)), F.lit(-1))
    note = F.when(F.trim(F.coalesce(conditions, F.lit(""))) != "", F.trim(conditions)).when(F.contains(norm, F.lit("aktiv")), F.lit(ACTIVE_TEXT))
    out = F.struct(
        base.alias("base_price"), cond.alias("conditional_price"), F.when(base.isNotNull() | cond.isNotNull(), "CZK").alias("currency"), billing_period(text, period).alias("billing_period"),
        F.coalesce(condition_type(text), F.lit("condition_met")).alias("condition_type"), note.alias("condition_text"), F.lit(LOGIC).alias("logic"),
    )
    return F.when(has_any(norm, SIGNALS), out)


def fee_abolished(product: Column, fee: Column, value: Column, conditions: Column) -> Column:
    """Whether the row makes the account's own fee free: it speaks of keeping an account, and is free or says it ended."""
    text = T.fold(joined(product, fee, value, conditions))
    return F.contains(text, F.lit("vedeni")) & F.contains(text, F.lit("uct")) & (has_any(T.fold(F.coalesce(value, F.lit(""))), FREE_VALUES) | has_any(text, ABOLISHED))


def fee_value(x: Column) -> Column:
    """The first match over the ordered value patterns, empty if none."""
    each = (F.nullif(F.trim(F.regexp_extract(x, "(?iu)" + p, 1)), F.lit("")) for p in VALUE_PATTERNS)
    return F.coalesce(*each, F.lit(""))


def fee_label(x: Column) -> Column:
    """Without leading numbering and a trailing footnote mark, the first letter small."""
    s = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s*\d+(?:\.\d+)*\.?\s*", ""))
    s = F.trim(F.regexp_replace(s, r"\s+\d+\)\s*$", ""))
    return F.when(s == "", "poplatek").otherwise(F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))


def value_with_period(value: Column, period: Column) -> Column:
    named = (F.coalesce(period, F.lit("")) == "") | F.contains(F.lower(value), F.lower(period))
    return F.when(named, value).otherwise(F.concat(value, F.lit(" "), period))


def product_name(x: Column) -> Column:
    """Without the first of SUFFIXES that ends it, unless the name is a preserved one or nothing would be left."""
    raw = F.trim(x)
    low = F.lower(raw)
    cut = F.coalesce(*(F.when(F.endswith(low, F.lit(s)), F.trim(F.substring(raw, F.lit(1), F.length(raw) - len(s)))) for s in SUFFIXES))
    return F.when(low.isin(*PRESERVED), raw).otherwise(F.coalesce(F.nullif(cut, F.lit("")), raw))


def blacklisted(fee: Column, product: Column, conditions: Column) -> Column:
    return has_any(F.lower(joined(fee, product, conditions)), BLACKLIST)


def condition_summary(kind: Column, note: Column) -> Column:
    by_kind = F.coalesce(*(F.when(kind == k, F.lit(t)) for k, t in SUMMARIES), F.lit("při splnění podmínek"))
    return F.coalesce(F.nullif(note, F.lit("")), by_kind)


def money(x: Column, currency: Column) -> Column:
    """A whole number without decimals; CZK is written Kč; a missing price is said to be so."""
    n = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
    return F.when(x.isNull(), "neuvedeno").otherwise(F.concat(n, F.lit(" "), F.when(currency == "CZK", F.lit("Kč")).otherwise(currency)))


def conditional_fee_text(product: Column, cond: Column, period: Column) -> Column:
    """The answer sentence of a conditional price (a struct of conditional_price)."""
    name, when = F.coalesce(F.nullif(product, F.lit("")), F.lit("Produkt")), condition_summary(cond["condition_type"], cond["condition_text"])
    unit, per = F.coalesce(cond["currency"], F.lit("CZK")), F.coalesce(F.nullif(period, F.lit("")), cond["billing_period"], F.lit("měsíčně"))
    base, low = money(cond["base_price"], unit), money(cond["conditional_price"], unit)
    has_base, has_low = cond["base_price"].isNotNull(), cond["conditional_price"].isNotNull()
    return F.when(cond.isNotNull(), (
        F.when(has_base & (cond["conditional_price"] == 0), F.concat(name, F.lit(" je zdarma "), when, F.lit(".\nPokud podmínka splněna není, poplatek činí "), base, F.lit(" "), per, F.lit(".")))
        .when(has_base & has_low, F.concat(name, F.lit(" má podmíněnou cenu "), low, F.lit(" "), per, F.lit(" "), when, F.lit(".\nBez splnění podmínky činí poplatek "), base, F.lit(" "), per, F.lit(".")))
        .when(has_base, F.concat(name, F.lit(": základní poplatek "), base, F.lit(" "), per, F.lit("; podmínka: "), when, F.lit(".")))
        .otherwise(F.concat(name, F.lit(": cena je podmíněná; podmínka: "), when, F.lit(".")))
    ))


def confident_row(chunk_type: Column, quality: Column, structured: Column, confidence: Column, answerable: Column, rerank: Column, floor: float = 0.0) -> Column:
    """Whether a price row may answer by itself; a missing rerank score doesn't count against it."""
    sure = ~F.coalesce(structured, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) >= 0.70)
    return F.coalesce((chunk_type == "pricing_row") & (F.lower(F.coalesce(quality, F.lit("ok"))) != "bad_table_row") & sure & answerable & (rerank.isNull() | (rerank >= max(0.0, floor))), F.lit(False))


def _words(folded: Column) -> Column:
    return F.filter(F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def _has_all(x: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(x, F.lit(t))
    return out


def primary_fee(fee: Column) -> Column:
    """The fee is an account's own: no foreign part, and the words of one of PRIMARY_SETS or PRIMARY_ENGLISH. False for null."""
    fee = F.coalesce(fee, F.lit(""))
    folded = T.fold(fee)
    have, low = _words(folded), F.lower(fee)
    sets, english = F.lit(False), F.lit(False)
    for s in PRIMARY_SETS:
        sets = sets | (F.size(F.array_except(F.array(*map(F.lit, s)), have)) == 0)
    for s in PRIMARY_ENGLISH:
        english = english | _has_all(low, s)
    return ~has_any(folded, NOT_PRIMARY) & (sets | english)


def asks_primary_fee(query: Column) -> Column:
    """The query asks for an account's own fee. False for null."""
    query = F.coalesce(query, F.lit(""))
    have, low = _words(T.fold(query)), F.lower(query)
    w = lambda *ws: F.arrays_overlap(have, F.array(*map(F.lit, ws)))
    czech = w("vedeni") | (w("stoji") & w("ucet")) | (w("stoji", "cena") & w("ekonto", "konto")) | (w("mesicni") & w("poplatek"))
    return czech | _has_all(low, ("account", "maintenance")) | _has_all(low, ("monthly", "fee"))


# Words of the product groups, but for cards that bear names of their own; and of one account's kinds.
GROUPS = {
    "ekonto_podnikatelske": ("podnikatelske ekonto", "podnikatelsky ekonto", "podnikatelsk e konto"), "podnikatelsky_ucet": ("podnikatel", "podnikatelske", "business", "osvc"),
    "firemni_ucet": ("firma", "firmy", "firemni", "corporate", "pravnicke", "pravnickych"), "kreditni_karta": ("kreditni karta", "kreditni karty", "credit card", "kreditka"),
    "debetni_karta": ("debetni karta", "debitni karta", "debit card", "debetka"), "hypoteky": ("hypotek", "hypotec"), "pujcky": ("pujck", "uver", "spotrebitelsk"), "sporeni": ("sporic", "sporeni", "terminovan"),
    "investice": ("investic", "fond", "dluhopis", "akci"), "osobni_ucet": ("osobni", "soukrome", "bezny ucet"),
    "basic_payment_account": ("zakladni platebni ucet", "social account", "chraneny ucet", "vulnerable"),
}
EKONTO = ("ekonto", "e konto", "e-konto", "ekonta")
PERSONAL, BUSINESS = ("osobni", "soukrome", "soukromy", "pro osobni", "retail"), ("podnikatel", "podnikatelske", "business", "osvc", "firma", "firemni")


def product_groups(text: Column, category: Column) -> Column:
    """The sorted groups that a price row is of, by its text and category.

    An eKonto is of its business kind if the text says so, else of its personal kind if the text or a retail category
    does, and of neither else; each brings the account's own group. A retail row without a business or company group is a
    personal account's, a corporate or business one a company's."""
    low, cat = T.fold(F.coalesce(text, F.lit(""))), T.fold(F.coalesce(category, F.lit("")))
    ekonto = has_any(low, EKONTO)
    business = ekonto & has_any(low, BUSINESS)
    personal = ekonto & ~business & (has_any(low, PERSONAL) | (cat == "retail"))
    own = {n: has_any(low, terms) for n, terms in GROUPS.items()}
    own["podnikatelsky_ucet"] = own["podnikatelsky_ucet"] | business
    own["ekonto_podnikatelske"] = business | (~ekonto & own["ekonto_podnikatelske"])
    own["ekonto_osobni"] = personal
    alone = (cat == "retail") & ~own["podnikatelsky_ucet"] & ~own["firemni_ucet"]
    own["osobni_ucet"] = own["osobni_ucet"] | personal | alone
    own["firemni_ucet"] = own["firemni_ucet"] | cat.isin("corporate", "business")
    return F.filter(F.array(*(F.when(own[n], F.lit(n)) for n in sorted(own))), lambda g: g.isNotNull())
