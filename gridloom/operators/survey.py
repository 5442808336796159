"""Survey answers: duplicate rows, routing, inventories, linkage, availability."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import clean_text, response_class


@dataclass(frozen=True)
class Route:
    """A question is asked only if the parent's answer fits: operator is equals, in or numeric_lt."""

    parent: str
    operator: str
    value: object
    targets: tuple[str, ...]

    def eligible(self) -> Column:
        x = F.trim(F.col(self.parent))
        if self.operator == "equals":
            out = x == str(self.value)
        elif self.operator == "in":
            out = x.isin(*map(str, self.value))
        elif self.operator == "numeric_lt":
            out = x.try_cast("double") < float(self.value)
        else:
            raise ValueError(f"unknown operator {self.operator}")
        return F.coalesce(out, F.lit(False))


def coalesced(rows: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """One row per id: the one answer of each column if its rows agree, NULL if they conflict; how the rows were resolved."""
    sets = rows.groupBy(ident).agg(F.count(F.lit(1)).alias("rows"), *(F.collect_set(clean_text(F.col(c))).alias(f"__{c}") for c in columns), F.count_distinct(F.struct(*(F.coalesce(clean_text(F.col(c)), F.lit("")).alias(c) for c in columns))).alias("__kinds"))
    conflicts = sum((F.when(F.size(f"__{c}") > 1, 1).otherwise(0) for c in columns), F.lit(0))
    how = F.when(F.col("rows") == 1, "single").when(conflicts > 0, "conflict").when(F.col("__kinds") == 1, "exact_duplicate").otherwise("complementary")
    return sets.select(ident, "rows", *(F.when(F.size(f"__{c}") == 1, F.element_at(f"__{c}", 1)).alias(c) for c in columns), conflicts.alias("conflicts"), how.alias("resolution"))


def routed(answers: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Adds `<question>__eligible` for each question; without a route all are eligible."""
    out = answers
    asked: dict[str, Column] = {}
    for r in routes:
        for t in r.targets:
            asked[t] = asked[t] & r.eligible() if t in asked else r.eligible()
    for t, ok in asked.items():
        out = out.withColumn(f"{t}__eligible", ok)
    return out


def inventory(answers: DataFrame, ident: str, questions: Sequence[str], top: int = 12) -> DataFrame:
    """Per question: response classes, distinct answers, the smallest category, the most frequent answers as JSON."""
    long = answers.unpivot([ident], list(questions), "question", "answer").select("question", response_class(F.col("answer")).alias("class"), clean_text(F.col("answer")).alias("answer"))
    classes = long.groupBy("question").agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("class") == c).alias(c) for c in ("valid", "blank", "refused", "dont_know", "not_applicable")))
    n = long.filter(F.col("class") == "valid").groupBy("question", "answer").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("n"), "answer"))
    tops = n.withColumn("r", rank)
    kept = F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "answer", "n"))))
    most = tops.groupBy("question").agg(F.count(F.lit(1)).alias("distinct_answers"), F.min("n").alias("smallest_category"), F.to_json(F.map_from_entries(F.transform(kept, lambda s: F.struct(s["answer"], s["n"])))).alias("top_answers"))
    return classes.join(most, "question", "left")


def linkage(cohort: DataFrame, answered: DataFrame, ident: str, group: str) -> DataFrame:
    """Cohort members with and without a survey row, for each group and for all."""
    has = answered.select(ident).distinct().withColumn("__has", F.lit(True))
    both = cohort.select(ident, group).join(has, ident, "left")
    sets = both.groupingSets([[F.col(group)], []], group).agg(F.count(F.lit(1)).alias("members"), F.count("__has").alias("linked"), F.grouping(group).alias("__all"))
    return sets.select(F.when(F.col("__all") == 1, "ALL").otherwise(F.col(group).cast("string")).alias("stratum"), "members", "linked", (F.col("members") - F.col("linked")).alias("unlinked"))


def only_answered(cohort: DataFrame, answered: DataFrame, ident: str) -> DataFrame:
    """Ids that answered but aren't in the cohort."""
    return answered.select(ident).distinct().join(cohort.select(ident), ident, "left_anti")


def availability(rows: DataFrame, group: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Counts and percentages of categories within groups, zeros filled in."""
    seen = rows.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    domain = rows.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, categories))).alias(category))
    cells = domain.join(seen, [group, category], "left").select(group, category, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return cells.select("*", F.when(total > 0, 100 * F.col("n") / total).alias("percent"), (F.col("n") < 5).alias("rare"))


def fallback(rows: DataFrame, choices: Sequence[str], least: float) -> DataFrame:
    """Takes the first of several columns that at least a share of all rows has; column `chosen` names it."""
    n = rows.agg(*((F.count(c) / F.count(F.lit(1))).alias(f"__{c}") for c in choices))
    pick = F.lit(None).cast("string")
    for c in reversed(choices):
        pick = F.when(F.col(f"__{c}") >= least, c).otherwise(pick)
    picked = n.select(pick.alias("chosen"))
    value = F.lit(None).cast("string")
    for c in reversed(choices):
        value = F.when(F.col("chosen") == c, F.col(c).cast("string")).otherwise(value)
    return rows.crossJoin(F.broadcast(picked)).withColumn("value", value)


def recoded(x: Column, codes: dict[str, str], reasons: dict[str, str] | None = None) -> Column:
    """(value, reason) by code maps; codes without an entry are unrecognised."""
    key = F.coalesce(F.lower(clean_text(x)), F.lit(""))
    table = lambda m: F.create_map(*(F.lit(v) for pair in m.items() for v in pair))
    value = F.element_at(table(codes), key)
    reason = F.coalesce(F.element_at(table({"": "blank"} | (reasons or {})), key), F.lit("unrecognised"))
    return F.struct(value.alias("value"), F.when(value.isNull(), reason).alias("reason"))


def best_match(columns: DataFrame, cohort: DataFrame, ident: str) -> DataFrame:
    """The column of a table whose values meet most ids of a cohort; the first by name on ties. All columns are compared in one pass."""
    names = columns.columns
    long = columns.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.upper(F.trim(F.col(c).cast("string"))).alias("v")) for c in names))).alias("e")).select("e.*").distinct()
    ids = cohort.select(F.upper(F.trim(F.col(ident).cast("string"))).alias("v")).distinct()
    hits = long.join(ids.withColumn("__hit", F.lit(1)), "v", "left").groupBy("column").agg(F.count("__hit").alias("matches"), F.count("v").alias("distinct_values"))
    return hits.orderBy(F.desc("matches"), "column").limit(1)


def sample_availability(rows: DataFrame, variables: Sequence[str], group: str) -> DataFrame:
    """Per variable: available rows, missing ones, the smallest category and the smallest group x category cell (an absent one counts 0)."""
    long = rows.unpivot([group], list(variables), "variable", "category")
    n = long.groupBy("variable").agg(F.count("category").alias("available"), (F.count(F.lit(1)) - F.count("category")).alias("missing"))
    cells = long.filter("category is not null").groupBy("variable", "category", group).agg(F.count(F.lit(1)).alias("n"))
    groups = rows.agg(F.count_distinct(group).alias("groups"))
    per = cells.groupBy("variable", "category").agg(F.sum("n").alias("size"), F.min("n").alias("least"), F.count(F.lit(1)).alias("seen")).crossJoin(F.broadcast(groups))
    least = per.groupBy("variable").agg(F.min("size").alias("smallest_category"), F.min(F.when(F.col("seen") < F.col("groups"), 0).otherwise(F.col("least"))).alias("smallest_cell"))
    return n.join(least, "variable", "left").withColumn("rare_cells", F.coalesce(F.col("smallest_cell") < 5, F.lit(True)))


def question_map(first: int, last: int, shift: int, domains: Sequence[tuple[int, int, str]]):
    """(question, answers_of, domain) rows: answer columns that stand `shift` places away from the question they belong to."""
    name = lambda q: next((d for a, b, d in domains if a <= q <= b), "other")
    return [(f"Q{q}", f"Q{q + shift}", name(q)) for q in range(first, last + 1)]
