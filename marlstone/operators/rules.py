"""Ordered rules that add and remove labels, and what follows from the labels: weights, routes and wider queries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Fires if any of `any` occurs (or `any` is empty), none of `none` does, and the labels so far hold one of
    `requires` (if given) and none of `lacks`."""

    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    requires: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    add: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


#: The default rules of an account-and-card domain, in order. Later rules see what earlier ones left.
RULES = (
    Rule(any=("price", "fee", "cost", "how much", "cenik", "poplat"), add=("pricing",)),
    Rule(any=("archive", "historical", "old version"), add=("archived_requested",)),
    Rule(any=("account", "ucet", "konto"), none=("business", "company"), add=("retail_banking", "personal_account")),
    Rule(any=("business", "company"), add=("corporate_banking", "business_account")),
    Rule(any=("card", "karta"), add=("cards",)),
    Rule(any=("credit card", "kreditni karta"), add=("credit_card", "cards")),
    Rule(any=("which", "what kinds", "list", "overview"), add=("catalog_intent",)),
    Rule(requires=("cards",), any=("which", "what kinds", "list", "overview"), add=("card_overview", "product_overview")),
    Rule(requires=("credit_card",), any=("which", "what kinds", "list"), none=("debit",), add=("credit_card_catalog",), remove=("card_overview",)),
    Rule(requires=("catalog_intent",), lacks=("product_overview",), none=("crypto",), add=("product_overview",)),
    Rule(any=("how do i", "how can i", "help", "problem"), lacks=("pricing",), add=("support",)),
    Rule(any=("activate", "activation"), add=("activation_flow", "cards")),
    Rule(any=("online", "internet", "app "), add=("online_services",), remove=("activation_flow", "cards")),
    Rule(any=("question", "faq"), lacks=("pricing", "product_overview"), add=("faq",)),
    Rule(requires=("product_overview",), remove=("faq", "support")),
)


def _strings(xs: Sequence[str]) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def labels(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The labels of a text, sorted; [general] if none. The rules are one literal array that an aggregate folds, so the
    expression grows with the rules and not with their products."""
    low = F.lower(F.coalesce(text, F.lit("")))
    table = F.array(*(F.struct(*(_strings(getattr(r, f)).alias(f) for f in ("any", "none", "requires", "lacks", "add", "remove"))) for r in rules))

    def step(have: Column, r: Column) -> Column:
        fires = (
            ((F.size(r["any"]) == 0) | F.exists(r["any"], lambda t: F.contains(low, t)))
            & ~F.exists(r["none"], lambda t: F.contains(low, t))
            & ((F.size(r["requires"]) == 0) | F.arrays_overlap(r["requires"], have))
            & ~F.arrays_overlap(r["lacks"], have)
        )
        return F.when(fires, F.array_except(F.array_union(have, r["add"]), r["remove"])).otherwise(have)

    found = F.sort_array(F.aggregate(table, F.array().cast("array<string>"), step))
    return F.when(F.size(found) == 0, _strings(("general",))).otherwise(found)


def weights(found: Column) -> Column:
    """(sparse, dense, min_score) of a label array; later conditions narrow earlier ones."""
    has = lambda x: F.array_contains(found, x)
    sparse = F.when(has("pricing"), 0.65).when(has("support"), 0.30).when(has("faq"), 0.35).otherwise(0.40)
    sparse = F.when(has("product_overview"), F.greatest(sparse, F.lit(0.50))).otherwise(sparse)
    sparse = F.when(has("credit_card"), F.greatest(sparse, F.lit(0.45))).otherwise(sparse)
    floor = F.when(has("product_overview"), -10.0).when(has("cards"), -4.0).otherwise(-2.0)
    return F.struct(sparse.alias("sparse"), F.round(1 - sparse, 2).alias("dense"), floor.alias("min_score"))


def route(text: Column, found: Column, blocked: Sequence[str] = ("password", "hack"), who: Sequence[str] = ("who are you", "are you a robot")) -> Column:
    """The answer strategy of a query: the first that applies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda xs: F.exists(_strings(xs), lambda t: F.contains(low, t))
    has = lambda x: F.array_contains(found, x)
    few = F.size(F.filter(F.split(low, "[ \t\n]+"), lambda w: w != "")) < 2
    return (
        F.when(any_of(blocked), "blocked")
        .when(any_of(who), "identity")
        .when(has("activation_flow"), "procedural")
        .when(few, "clarification")
        .when(low.rlike(r"\b(versus|vs|compare|difference between)\b"), "comparison")
        .when(has("product_overview"), "overview")
        .when(has("pricing"), "price_row")
        .when(has("faq") | has("support"), "soft_guidance")
        .otherwise("retrieval")
    )


def wider_query(text: Column, found: Column, base: Sequence[str], by_label: Sequence[tuple[str, Sequence[str]]], most: int = 8) -> Column:
    """The query with up to `most` base terms and terms of its labels that it does not hold yet, in order."""
    low = F.lower(text)
    terms = F.concat(_strings(base), *(F.when(F.array_contains(found, n), _strings(ts)).otherwise(_strings(())) for n, ts in by_label))
    return F.trim(F.concat_ws(" ", text, F.array_join(F.slice(F.filter(terms, lambda t: ~F.contains(low, F.lower(t))), 1, most), " ")))
