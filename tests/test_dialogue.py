"""Dialogue states on conversations of their own."""

from marlstone.operators import dialogue as D

PRODUCTS = [("osobni_ucet", ("osobní účet",)), ("pujcky", ("půjčk",))]
INTENTS = [("pricing", ("poplat", "kolik stojí"))]


def run(spark, *turns):
    rows = [(1, i, role, text, asked) for i, (role, text, asked) in enumerate(turns)]
    got = D.states(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, asked string"), PRODUCTS, INTENTS).orderBy("turn").collect()
    return got


def test_an_answer_to_a_pending_question(spark):
    a, b, c = run(spark, ("user", "Kolik stojí účet?", None), ("assistant", "Který?", "account"), ("user", "Osobní, prosím", None), ("assistant", "Zdarma.", None), ("user", "osobní", None))
    assert a.resolved is None and (b.resolved.target, b.resolved.query) == ("osobni_ucet", "Jaký je poplatek za vedení osobního účtu?")
    assert c.resolved is None  # nothing was asked right before
    assert (b.product, c.inherited_product, c.inherited_intent) == ("osobni_ucet", "osobni_ucet", "pricing")


def test_follow_ups_inherit_and_are_rewritten(spark):
    turns = ["Chci osobní účet a jeho podmínky pro celou rodinu", "A kolik stojí?", "Jaké je počasí dnes v Praze u nás", "A co pojištění k tomu?", "Nová půjčka", "a jaké limity k tomu", None]
    a, b, c, d, e, f, g = run(spark, *(("user", t, None) for t in turns))
    assert not a.follow_up and a.product == "osobni_ucet"
    assert (b.follow_up, b.inherited_product, b.aspect, b.rewritten) == (True, "osobni_ucet", "pricing", "Jaké jsou poplatky k osobním účtům?")
    assert not c.follow_up and c.rewritten is None
    assert (d.follow_up, d.aspect, d.rewritten) == (True, "insurance", "Jaké pojištění nebo doplňkové služby jsou k osobním účtům?")  # it refers back, so insurance is no new topic
    assert not e.follow_up and e.product == "pujcky"
    assert (f.follow_up, f.inherited_product, f.inherited_intent, f.aspect, f.rewritten) == (True, "pujcky", "pricing", "limits", None)  # no question for that pair
    assert (g.follow_up, g.inherited_product) == (True, "pujcky")  # an empty turn is a short one
