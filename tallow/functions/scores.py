"""Scores of answers, evidence and trajectories as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import expand_ordinals, normalize_answer


def let(value: Column, f) -> Column:
    """f(value) with the value computed once a row: inside a lambda it is a variable, not an expression to repeat."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def answer_tokens(c: Column) -> Column:
    return tokens(normalize_answer(c))


def bag(tokens_: Column) -> Column:
    """A multiset of tokens as a set: the second and further occurrences of a token carry their number.

    Worked out once a text, it makes the overlap with any other text one
    intersection by hashing.
    """

    def numbered(t: Column, s: Column) -> Column:
        again = F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
        return let(again, lambda r: F.when(F.size(r) == 0, t).otherwise(F.concat(F.array_distinct(t), F.flatten(F.transform(r, lambda x: further(t, x))))))

    def further(t: Column, x: Column) -> Column:
        times = F.size(F.filter(t, lambda y: y == x))
        return F.transform(F.sequence(F.lit(2), times), lambda k: F.concat(x, F.lit(" "), k.cast("string")))  # tokens hold no blank

    return let(tokens_, lambda t: let(F.sort_array(t), lambda s: numbered(t, s)))


def answer_bag(c: Column) -> Column:
    return bag(answer_tokens(c))


def overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two bags."""
    return F.size(F.array_intersect(p, g))


def bag_prf(p: Column, g: Column) -> Column:
    """Struct (f1, precision, recall) of two bags, which should be variables or columns."""
    return prf(overlap(p, g), F.size(p), F.size(g))


def token_prf(prediction: Column, gold: Column) -> Column:
    """Struct (f1, precision, recall) of two texts; two empty ones give 1."""
    both = F.struct(answer_bag(prediction).alias("p"), answer_bag(gold).alias("g"))
    return let(both, lambda s: bag_prf(s["p"], s["g"]))


def prf(common: Column, n_p: Column, n_g: Column) -> Column:
    def of(n: Column) -> Column:
        precision = F.when(n["p"] > 0, n["n"] / n["p"]).otherwise(0.0)
        recall = F.when(n["g"] > 0, n["n"] / n["g"]).otherwise(0.0)
        f1 = F.when(n["n"] > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        one, zero = (F.struct(*[F.lit(v).alias(k) for k in ("f1", "precision", "recall")]) for v in (1.0, 0.0))
        own = F.struct(f1.alias("f1"), precision.alias("precision"), recall.alias("recall"))
        return F.when((n["p"] == 0) & (n["g"] == 0), one).when((n["p"] == 0) | (n["g"] == 0), zero).otherwise(own)

    return let(F.struct(common.alias("n"), n_p.alias("p"), n_g.alias("g")), of)


def best_of(p: Column, gs: Column) -> Column:
    """The first bag's scores with the largest F1 of an array of bags; zeros without any."""
    scored = F.transform(gs, lambda g, i: let(bag_prf(p, g), lambda s: F.struct(s["f1"].alias("f1"), (-i).alias("i"), s.alias("s"))))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("f1", "precision", "recall")])
    return F.coalesce(F.array_max(scored)["s"], zero)


def best_prf(prediction: Column, golds: Column) -> Column:
    """The first gold's scores with the largest F1; zeros without golds."""
    bags = F.struct(answer_bag(prediction).alias("p"), F.transform(golds, lambda g: answer_bag(g)).alias("gs"))
    return let(bags, lambda s: best_of(s["p"], s["gs"]))


def exact_match(prediction: Column, golds: Column) -> Column:
    return let(normalize_answer(prediction), lambda p: F.exists(golds, lambda g: normalize_answer(g) == p)).cast("double")


def set_prf(p: Column, g: Column, digits: int = 4) -> Column:
    """Rounded scores of two sets; two empty ones give 1."""
    s = prf(F.size(F.array_intersect(p, g)), F.size(F.array_distinct(p)), F.size(F.array_distinct(g)))
    return F.struct(*[F.round(s[n], digits).alias(n) for n in ("precision", "recall", "f1")])


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def joint(a: Column, b: Column) -> Column:
    """Joint scores of an answer's and its evidence's: products, and their F1."""
    p, r = a["precision"] * b["precision"], a["recall"] * b["recall"]
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def acceptance_f1(prediction: Column, golds: Column) -> Column:
    """Best F1 with ordinals spelled out; 1 for one or two tokens that are a subset of a gold's."""
    return acceptance_of(answer_bag(expand_ordinals(prediction)), F.transform(golds, lambda g: answer_bag(expand_ordinals(g))))


def acceptance_of(p: Column, gs: Column) -> Column:
    """acceptance_f1() of bags."""
    bags = F.struct(p.alias("p"), gs.alias("gs"))

    def accept(s: Column) -> Column:
        # a token that comes twice in a prediction of two is there once
        once = F.filter(s["p"], lambda x: ~x.contains(" "))
        subset = lambda g: F.size(s["p"]).between(1, 2) & (F.size(F.array_except(once, g)) == 0)
        each = F.transform(s["gs"], lambda g: F.when(subset(g), 1.0).otherwise(bag_prf(s["p"], g)["f1"]))
        return F.coalesce(F.array_max(each), F.lit(0.0))

    return let(bags, accept)


def reward(em: Column, evidence: Column, fmt: Column, searches: Column, repeats: Column, weights=(1.0, 0.5, 0.1, 0.0, 0.0)) -> Column:
    a, e, f, s, d = weights
    return a * em + e * evidence + f * fmt - s * searches - d * repeats


def evidence_reward(p: Column, g: Column) -> Column:
    """Set F1, but 0 where either side is empty."""
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, 0.0).otherwise(prf(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))["f1"])


def weights_of(spark, prefix: str = "tallow.reward.", defaults=(1.0, 0.5, 0.1, 0.0, 0.0)) -> tuple[float, ...]:
    """Reward weights from the session's settings (answer, evidence, format, search, duplicate), else the defaults."""
    names = ("answer", "evidence", "format", "search", "duplicate")
    return tuple(float(spark.conf.get(prefix + n, str(d))) for n, d in zip(names, defaults, strict=True))
