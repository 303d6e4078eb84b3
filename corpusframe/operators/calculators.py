"""Pay, teaching load and results as table jobs (B1-B6). Rate tables are parameters' size: a row per title, scale or school type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_PAY = 2_340_000


def payroll(staff: DataFrame, titles: DataFrame, scales: DataFrame, base: int = BASE_PAY) -> DataFrame:
    """B1: id, coefficient, salary, allowances, contributions, net. Coefficient = first + step * (grade - 1), the step rounded to two places;
    10.5 % is held back from pay with position, over-frame and reserved parts; lines are rounded half to even to whole units."""
    rates = titles.join(scales, "scale").select("level", "rank", "allowance", "first", "last", "steps")
    j = staff.join(F.broadcast(rates), ["level", "rank"], "left")
    step = F.round((F.col("last") - F.col("first")) / (F.col("steps") - 1), 2)
    k = F.round(F.col("first") + step * (F.col("grade") - 1), 2)
    line = lambda x: F.bround(x * base).cast("long")
    j = j.withColumn("coefficient", k).withColumns({"salary": line(F.col("coefficient")), "position_pay": line(F.col("position_coef")), "over_pay": line(F.col("coefficient") * F.col("over_frame")), "reserved_pay": line(F.col("reserved_coef"))})
    preferential = F.greatest(F.col("allowance"), F.coalesce("area", F.lit(0.0)))
    j = j.withColumn("preferential_pay", line((F.col("coefficient") * (1 + F.col("over_frame")) + F.col("position_coef")) * preferential))
    insured = F.col("salary") + F.col("position_pay") + F.col("over_pay") + F.col("reserved_pay")
    j = j.withColumns({"contributions": F.bround(insured * 0.105).cast("long"), "mismatch": F.abs(F.coalesce("stated", "coefficient") - F.col("coefficient")) > 0.005})
    return j.select("id", "coefficient", "salary", "position_pay", "over_pay", "reserved_pay", "preferential_pay", "contributions", (insured + F.col("preferential_pay") - F.col("contributions")).alias("net"), "mismatch")


def teaching_load(staff: DataFrame, duties: DataFrame, weeks: int = 35, weekly: int = 17) -> DataFrame:
    """B2: id, base, reduction, due, negative, overtime_cap: reductions on capped duties stop at half of the year, nothing falls below 0; a
    director teaches 8 % and a deputy 10 % of the year, without reductions."""
    d = duties.groupBy("id").agg(F.sum(F.when(F.col("capped"), F.col("lessons")).otherwise(0)).alias("c"), F.sum(F.when(~F.col("capped"), F.col("lessons")).otherwise(0)).alias("u"))
    year = float(weekly * weeks)
    j = staff.join(d, "id", "left").fillna({"c": 0.0, "u": 0.0})
    cut = F.least(F.col("c"), F.lit(year * 0.5)) + F.col("u")
    share = F.when(F.col("position") == "director", 0.08).when(F.col("position") == "deputy", 0.10)
    due = F.when(share.isNotNull(), F.round(year * share, 2)).otherwise(F.greatest(F.lit(year) - cut, F.lit(0.0)))
    return j.select("id", F.lit(year).alias("base"), F.when(share.isNull(), cut).otherwise(0.0).alias("reduction"), due.alias("due"), (share.isNull() & (cut > year)).alias("negative"), F.round(due * 0.5, 2).alias("overtime_cap"))


def general_load(staff: DataFrame, rates: DataFrame, duties: DataFrame) -> DataFrame:
    """Id, base (by school type and level; a head has 2 and a deputy 4, without reductions), reduction, due, many (more than two duties). Base
    and due are NULL where no rate is known."""
    d = duties.groupBy("id").agg(F.sum("lessons").alias("reduction"), F.count("*").alias("n"))
    j = staff.join(F.broadcast(rates), ["kind", "level"], "left").join(d, "id", "left").fillna({"reduction": 0.0, "n": 0})
    heads = F.when(F.col("role") == "head", 2.0).when(F.col("role") == "deputy", 4.0)
    j = j.withColumns({"base": F.coalesce(heads, "lessons_base"), "reduction": F.when(heads.isNull(), F.col("reduction")).otherwise(0.0)})
    return j.select("id", "base", "reduction", F.when(F.col("base").isNotNull(), F.greatest(F.col("base") - F.col("reduction"), F.lit(0.0))).alias("due"), (F.col("n") > 2).alias("many"))


def duty_lessons(duties: DataFrame, schools: DataFrame, rates: DataFrame) -> DataFrame:
    """Id, duty, lessons: what a duty takes off a week. duties(id, duty, rooms, level) with schools(id, classes, region) and rates(duty, lessons):
    a subject room counts three lessons each, infant care four in primary schools and three elsewhere, a party secretary four in a large school
    and three in others; a school is large from 19 classes in region 1, from 28 elsewhere. NULL where the rule lacks its facts or has no rate."""
    large = F.col("classes") >= F.when(F.col("region") == 1, 19).when(F.col("region").isNotNull(), 28)
    j = duties.join(schools.select("id", "classes", "region"), "id", "left").join(F.broadcast(rates.select("duty", F.col("lessons").alias("__rate"))), "duty", "left")
    lessons = F.when(F.col("duty") == "subject_room", 3 * F.col("rooms")).when(F.col("duty") == "infant_care", F.when(F.col("level") == "primary", 4).otherwise(3)).when(F.col("duty") == "party_secretary", F.when(large, 4).when(~large, 3)).otherwise(F.col("__rate"))
    return j.select("id", "duty", lessons.cast("double").alias("lessons"))


def awards(results: DataFrame, conduct: DataFrame) -> DataFrame:
    """Student, award: good for who is at the top in studies and conduct(student, level), excellent with six subjects of nine or more."""
    j = results.join(conduct.select("student", F.col("level").alias("__c")), "student").where("level = 4 and __c = 4")
    return j.select("student", F.when(F.col("excellent"), "excellent").otherwise("good").alias("award"))


def half_up(x: Column, places: int = 1) -> Column:
    return F.round(x.cast("decimal(14,6)"), places).cast("double")


def term_averages(scores: DataFrame) -> DataFrame:
    """Student, subject, term, average = (regular marks + 2 mid + 3 final) / (n + 5), half up to one place; NULL without mid or final."""
    s = scores.groupBy("student", "subject", "term").agg(
        F.sum(F.when(F.col("kind") == "regular", F.col("mark"))).alias("r"), F.count_if(F.col("kind") == "regular").alias("n"), F.max(F.when(F.col("kind") == "mid", F.col("mark"))).alias("m"), F.max(F.when(F.col("kind") == "final", F.col("mark"))).alias("f")
    )
    avg = (F.coalesce("r", F.lit(0.0)) + 2 * F.col("m") + 3 * F.col("f")) / (F.col("n") + 5)
    return s.select("student", "subject", "term", half_up(avg).alias("average"))


def year_averages(terms: DataFrame) -> DataFrame:
    """(first + 2 second) / 3, half up."""
    t = terms.groupBy("student", "subject").agg(F.max(F.when(F.col("term") == 1, F.col("average"))).alias("a"), F.max(F.when(F.col("term") == 2, F.col("average"))).alias("b"))
    return t.select("student", "subject", half_up((F.col("a") + 2 * F.col("b")) / 3).alias("average"))


#: Least mark in any subject, and the mark that six subjects must reach, for the levels 4 (best) to 2.
LEVELS = ((4, 6.5, 8.0), (3, 5.0, 6.5), (2, 3.5, 5.0))


def _level(low: Column, reached: dict[float, Column]) -> Column:
    out = None
    for level, least, mark in LEVELS:
        out = (F if out is None else out).when((low >= least) & (reached[mark] >= 6), level)
    return out.otherwise(1)


def classify_results(averages: DataFrame) -> DataFrame:
    """Student, level (1-4), excellent: six subjects of 9 or more at the best level. If leaving out exactly one subject would lift the
    level by two or more, it rises by one."""
    a = averages.where("average is not null")
    marks = sorted({m for _, _, m in LEVELS})
    g = a.groupBy("student").agg(F.array_sort(F.collect_list("average")).alias("v"), *[F.count_if(F.col("average") >= m).alias(f"c{i}") for i, m in enumerate(marks)], F.count_if(F.col("average") >= 9).alias("nine"))
    level = _level(F.get("v", F.lit(0)), {m: F.col(f"c{i}") for i, m in enumerate(marks)})
    g = g.withColumn("plain", level)

    def without(x: Column, i: Column) -> Column:
        low = F.when(i == 0, F.get("v", F.lit(1))).otherwise(F.get("v", F.lit(0)))
        return _level(low, {m: F.col(f"c{j}") - F.when(x >= m, 1).otherwise(0) for j, m in enumerate(marks)})

    lifted = F.size(F.filter(F.transform("v", without), lambda w: w >= F.col("plain") + 2))
    final = F.when(lifted == 1, F.col("plain") + 1).otherwise(F.col("plain"))
    return g.select("student", final.alias("level"), ((final == 4) & (F.col("nine") >= 6)).alias("excellent"))
