"""Set comparisons of flags and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.functions.text import strip

def clean_flags(flags: DataFrame, keys: list[str] = ["run"], flag: str = "flag", pos: str = "pos") -> DataFrame:
    """Trimmed, non-empty flags once each, at the position of their first mention."""
    t = strip(F.col(flag) if isinstance(flag, str) else flag)
    return (flags.filter(F.col(flag).isNotNull() & (t != ""))
            .groupBy(*keys, t.alias(flag)).agg(F.min(pos).alias(pos)))


def sides(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """(name, side): only in A, only in B, or in both; one shuffle over the union of both sides."""
    marked = a.select(name, F.lit(1).alias("_s")).unionByName(b.select(name, F.lit(2).alias("_s")))
    side = F.bit_or("_s")
    return marked.groupBy(name).agg(F.when(side == 1, "only_a").when(side == 2, "only_b").otherwise("both").alias("side"))


def key_rules(members: DataFrame, disjoint: list[tuple[str, str]], inside: list[tuple[str, str]],
              covers: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(rule, violations) over a (set, name) table: disjoint pairs, subsets, and sets that others must cover."""
    names = sorted({x for r in disjoint + inside for x in r} | {c for c, _ in covers} | {p for _, ps in covers for p in ps})
    per = members.groupBy("name").agg(*[F.bool_or(F.col("set") == s).alias(s) for s in names])
    rules = [(f"{a} and {b} are disjoint", F.col(a) & F.col(b)) for a, b in disjoint]
    rules += [(f"{a} lies inside {b}", F.col(a) & ~F.col(b)) for a, b in inside]
    for whole, parts in covers:
        some = F.lit(False)
        for p in parts:
            some = some | F.col(p)
        rules.append((f"{' and '.join(parts)} cover {whole}", F.col(whole) & ~some))
    one = per.agg(*[F.count_if(bad).alias(f"_r{i}") for i, (_, bad) in enumerate(rules)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(text).alias("rule"), F.col(f"_r{i}").alias("violations")) for i, (text, _) in enumerate(rules)])))
