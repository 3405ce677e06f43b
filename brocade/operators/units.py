"""Problem 2: the same quantity recorded in different units and scales.

How a value is written is a *form*: the text with its numbers taken out ('# tỷ', 'us$ #', '# x #').
A form is a source with one unknown scale to the base unit. The scales are learnt, not listed:

1. the same entity is linked across forms (each form to the entity's most common form, so an entity
   with k forms gives k - 1 links) and each form to the recorded column of its own row;
2. each pair of forms gets a robust scale (median log ratio) and offset (median remainder);
3. the scale is snapped to a ratio of known conversions, and the share of links that agree with it kept; a
   pair with an offset left over after that isn't a conversion and has no vote;
4. scales are propagated through the graph from the forms that name a known unit, round by round until no
   form is added. A form takes the scale that most of its links to known forms agree on; the recorded
   column, which is wrong as a rule for some forms, is asked only for what the links between forms leave open.

An amount in two units ('5 tỷ 200 nghìn') is the sum of two amounts, each in its own form.

Known conversions are the factors of a unit reference and their thousands. Every step is a partial
aggregate over (entity, form) or (form, form); nothing grows with an entity's rows.

Defined cases
- null, empty or unreadable text states nothing: its amount is null. So is one whose form has no scale.
- a form that no link reaches and that names no known unit has no scale.
- null entity: the row isn't linked, but converted. Repeated rows weigh as one per entity and form.
- an empty table gives an empty result. Unknown columns of the input are kept as they are.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brocade.functions.exprs import unaccented
from brocade.functions.numbers import NUMBER, WRITTEN, written_number
from brocade.session import cut

#: (quantity, unit name, base unit, base units per unit)
Unit = tuple[str, str, str, float]
RECORDED = "(recorded)"
#: Links agree with a scale if they are within this log10 distance (about 15 %).
TOLERANCE = 0.06
#: A form's scale needs this share of its links' votes.
LEAST_SHARE = 0.55
#: The largest median remainder (a relative offset) of a pair of forms that counts as a conversion.
MOST_OFFSET = 0.15

_PERIOD = r"\s*(?:/|mỗi|per)\s*(?:tháng|thang|th|month)\b\.?"
_PER_AREA = r"\s*(?:/|mỗi|per)\s*(?:m2|m²|mét vuông|met vuong|sqm)(?!\w)"
#: A form of two numbers with a unit behind each.
_TWO = r"^#\s*\p{L}[^#]*#[^#]*\p{L}[^#]*$"
#: Words around an amount that say nothing about its unit.
_NOISE = r"\([^)]*\)|giá\s*:|^\s*dt\b|~|\btl\b"


def written_parts(text: Column) -> dict[str, Column]:
    """form, first and second number, and whether the amount is per area."""
    low = F.lower(F.trim(text))
    per_area = low.rlike(_PER_AREA)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, _PER_AREA, " "), _PERIOD, " "), _NOISE, " ")
    # m2 and ft2 hold a digit that is no amount
    bare = F.regexp_replace(bare, r"(m|ft)2(?!\d)", "$1²")
    numbers = F.regexp_extract_all(bare, F.lit(f"({WRITTEN})"), F.lit(1))
    form = F.trim(F.regexp_replace(F.regexp_replace(bare, WRITTEN, "#"), r"[\s ]+", " "))
    form = F.regexp_replace(F.regexp_replace(form, r"# (?=\S)", "#"), r"(?<=\S) #", "#")
    return {"form": form, "numbers": numbers, "per_area": per_area}


def with_written(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with prefix_form, prefix_value (in the form's own unit), prefix_form2, prefix_value2 (a second amount in a
    unit of its own, else null) and prefix_per_area.

    Two numbers with a unit behind each are two amounts ('5 tỷ 130 triệu'), with a unit between them alone units and
    thousandths ('5 tỷ 130'); two numbers joined by a cross, or as width and length, are a product."""
    a, b, form = F.col("__a"), F.col("__b"), F.col("__form")
    two = (F.size("__numbers") == 2) & form.rlike(_TWO)
    sides = form.rlike(r"^#\s*m?\s*[x×]\s*#\s*m?$|^ngang#m dài#m$|^ngang #m dài #m$")
    value = (
        F.when((F.size("__numbers") == 1) | two & ~sides, a)
        .when(sides, (a * b).cast(NUMBER))
        .when((F.size("__numbers") == 2) & form.rlike(r"^#[^#]+#[^#]*$"), a + (b / F.lit(1000)).cast(NUMBER))
    )
    # step by step, so that each expression is worked out once
    return (
        df.withColumns({f"__{k}": c for k, c in written_parts(F.col(text)).items()})
        .withColumns({f"__{n}": written_number(F.try_element_at(F.col("__numbers"), F.lit(i))) for i, n in ((1, "a"), (2, "b"))})
        .withColumns({"__value": value.cast(NUMBER), "__second": two & ~sides, "__form": F.when(sides, F.lit("#x#")).otherwise(form)})
        .withColumns({
            f"{prefix}_form": F.when(F.col("__value") > 0, F.when(F.col("__second"), F.regexp_extract("__form", r"^(#[^#]+?)\s*#", 1)).otherwise(form)),
            f"{prefix}_value": F.when(F.col("__value") > 0, F.col("__value")),
            f"{prefix}_form2": F.when((F.col("__value") > 0) & F.col("__second"), F.regexp_extract("__form", r"(#[^#]+)$", 1)),
            f"{prefix}_value2": F.when((F.col("__value") > 0) & F.col("__second"), b),
        })
        .withColumn(f"{prefix}_per_area", F.col("__per_area")).drop("__form", "__numbers", "__per_area", "__a", "__b", "__value", "__second")
    )


def _links(rows: DataFrame) -> DataFrame:
    """quantity, form, other, d, n: log10 of how many units of `other` make one of `form`, by things seen in both,
    to a thousandth, and how many things say so."""
    stated = rows.where("form is not null and value > 0")
    by_form = stated.where("entity is not null").groupBy("quantity", "entity", "form").agg(F.avg(F.log10("value")).alias("lv"))
    common = by_form.groupBy("quantity", "form").agg(F.count(F.lit(1)).alias("n"))
    hub = F.first(F.struct("form", "lv")).over(Window.partitionBy("quantity", "entity").orderBy(F.desc("n"), "form"))
    star = by_form.join(common, ["quantity", "form"]).withColumn("hub", hub).where("form != hub.form")
    across = star.select("quantity", "form", F.col("hub.form").alias("other"), (F.col("hub.lv") - F.col("lv")).alias("d"))
    own = stated.where("recorded > 0").select(
        "quantity", "form", F.lit(RECORDED).alias("other"), (F.log10("recorded") - F.log10("value")).alias("d")
    )
    both = across.unionByName(own).groupBy("quantity", "form", "other", F.round("d", 3).alias("d"))
    return both.agg(F.count(F.lit(1)).alias("n"))  # at most some 40,000 rows an edge, whatever the data


def _nearest(value: Column, known: Mapping[str, Sequence[float]]) -> Column:
    """Of the row's quantity, the known log10 nearest to value."""
    lists = F.create_map(*[c for q, ks in known.items() for c in (F.lit(q), F.array(*map(F.lit, ks)))])
    gaps = F.transform(lists[F.col("quantity")], lambda k: F.struct(F.abs(value - k).alias("gap"), k.alias("at")))
    return F.array_min(gaps)["at"]


def source_graph(rows: DataFrame, logs: Mapping[str, Sequence[float]]) -> DataFrame:
    """quantity, form, other, links, log_scale (snapped), remainder (median relative rest), agreement."""
    ratios = {q: sorted({round(a - b, 9) for a in ks for b in ks}) for q, ks in logs.items()}
    links = cut(_links(rows))
    edge = ["quantity", "form", "other"]
    pair = links.groupBy(*edge).agg(F.percentile("d", F.lit(0.5), F.col("n")).alias("median"))
    snapped = pair.withColumn("log_scale", _nearest(F.col("median"), ratios)).select(*edge, "log_scale")
    rest = F.col("d") - F.col("log_scale")
    return links.join(snapped, edge).groupBy(*edge, "log_scale").agg(
        F.sum("n").alias("links"),
        (F.sum(F.when(F.abs(rest) <= TOLERANCE, F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"),
        F.percentile(F.pow(F.lit(10.0), rest) - 1, F.lit(0.5), F.col("n")).alias("remainder"),
    )


def _plain(text: str) -> str:
    """As `unaccented` has it."""
    bare = unicodedata.normalize("NFKD", text.lower().replace("đ", "d"))
    return "".join(c for c in bare if not unicodedata.combining(c) and not c.isspace() and c != ".")


def learn_scales(rows: DataFrame, units: Sequence[Unit], support: int = 3) -> DataFrame:
    """quantity, form, scale: base units per unit of the form.

    rows: quantity, entity, form, value, recorded. units: the reference, a fixed short list. Forms that name
    a unit of the reference and nothing else have its factor; the others follow in rounds until none is added,
    each by the votes of its links to forms already known: by at least `support` of them as long as that adds
    forms, then by any, then by the recorded column too."""
    quantities = sorted({q for q, _, _, _ in units})
    factors = {q: sorted({f * k for u, _, _, f in units if u == q for k in (1, 1000)}) for q in quantities}
    logs = {q: [math.log10(f) for f in fs] for q, fs in factors.items()}
    edges = source_graph(rows, logs).where(F.abs(F.col("remainder")) <= MOST_OFFSET)
    edges = edges.select("quantity", "form", "other", "links", "agreement", "log_scale")
    both = cut(edges.unionByName(edges.select("quantity", F.col("other").alias("form"), F.col("form").alias("other"), "links", "agreement", (-F.col("log_scale")).alias("log_scale"))).where(F.col("form") != RECORDED))
    forms = rows.where("form is not null").select("quantity", "form").distinct()
    word = unaccented(F.trim(F.regexp_replace(F.col("form"), "#", "")))
    by_name = F.lit(None).cast("double")
    for q, name, _, factor in units:
        by_name = F.when((F.col("quantity") == q) & (F.col("word") == _plain(name)), F.lit(math.log10(factor))).otherwise(by_name)
    named = forms.where(F.col("form").rlike("^#[^#]+$|^[^#]+#$")).withColumn("word", word).withColumn("log_f", by_name)
    found = cut(named.where("log_f is not null").select("quantity", "form", "log_f"))
    base = rows.sparkSession.createDataFrame([(q, RECORDED, 0.0) for q in quantities], "quantity string, form string, log_f double")
    key, ways, way = ["quantity", "form"], ((support, False), (1, False), (support, True)), 0
    while way < len(ways):
        least, recorded = ways[way]
        known = (found.unionByName(base) if recorded else found).withColumnRenamed("form", "other")
        votes = (
            both.join(known, ["quantity", "other"]).join(found, key, "left_anti")
            .groupBy(*key, _nearest(F.col("log_f") + F.col("log_scale"), logs).alias("log_f"))
            .agg(F.sum(F.col("links") * F.col("agreement")).alias("votes"), F.sum("links").alias("links"))
        )
        best = votes.groupBy(*key).agg(
            F.max_by("log_f", F.struct("votes", "log_f")).alias("log_f"), F.max("votes").alias("votes"), F.sum("links").alias("links")
        )
        step = cut(best.where((F.col("votes") >= F.lit(least)) & (F.col("votes") >= F.lit(LEAST_SHARE) * F.col("links"))).select(*key, "log_f"))
        added = step.limit(1).count()
        found, way = (found.unionByName(step), 0) if added else (found, way + 1)
    exact = F.lit(None).cast("decimal(24,6)")
    for f in sorted({f for fs in factors.values() for f in fs}):
        exact = F.when(F.abs(F.col("log_f") - F.lit(math.log10(f))) < 1e-6, F.lit(f"{f:.6f}").cast("decimal(24,6)")).otherwise(exact)
    return found.select(*key, exact.alias("scale"))


def evidence(df: DataFrame, recorded: Mapping[str, str], entity: str) -> DataFrame:
    """quantity, entity, form, value, recorded of what a table (from `with_written`) states; the value is null where it
    isn't stated as a whole, so that such rows add their form and no link."""
    seen = [
        F.struct(
            F.lit(q).alias("quantity"), F.col(entity).alias("entity"), F.col(f"{q}_form").alias("form"),
            F.when(~F.col(f"{q}_per_area") & F.col(f"{q}_form2").isNull(), F.col(f"{q}_value").cast("double")).alias("value"), F.col(r).cast("double").alias("recorded"),
        )
        for q, r in recorded.items()
    ]
    second = [
        F.struct(F.lit(q).alias("quantity"), F.col(entity).alias("entity"), F.col(f"{q}_form2").alias("form"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("recorded"))
        for q in recorded
    ]
    return df.select(F.inline(F.array(*seen, *second)))


def harmonise(df: DataFrame, recorded: Mapping[str, str], entity: str, units: Sequence[Unit], per: Mapping[str, str] | None = None, more: DataFrame | None = None) -> DataFrame:
    """df (from `with_written`, a column prefix for each quantity) with <quantity>_amount, decimal(30,6): what
    the text states in base units.

    recorded: quantity -> the column recorded beside the text. per: quantity -> the quantity that an amount
    stated per something is multiplied with; where that is null such an amount is null. more: `evidence` of
    other tables about the same entities, to learn from."""
    per = per or {}
    rows = evidence(df, recorded, entity)
    scales = cut(learn_scales(rows if more is None else rows.unionByName(more), units))
    for q in sorted(recorded, key=lambda q: q in per):
        own = scales.where(F.col("quantity") == q).select(F.col("form").alias(f"{q}_form"), F.col("scale").alias("__scale"))
        more_of = own.select(F.col(f"{q}_form").alias(f"{q}_form2"), F.col("__scale").alias("__scale2"))
        rest = F.when(F.col(f"{q}_form2").isNull(), F.lit(0)).otherwise((F.col(f"{q}_value2") * F.col("__scale2")).cast("decimal(30,6)"))
        amount = ((F.col(f"{q}_value") * F.col("__scale")).cast("decimal(30,6)") + rest).cast("decimal(30,6)")
        if q in per:
            amount = F.when(F.col(f"{q}_per_area"), (amount * F.col(f"{per[q]}_amount")).cast("decimal(30,6)")).otherwise(amount)
        df = df.join(own, f"{q}_form", "left").join(more_of, f"{q}_form2", "left").withColumn(f"{q}_amount", amount).drop("__scale", "__scale2")
    return df
