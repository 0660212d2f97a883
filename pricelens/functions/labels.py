"""Labels of shop pages: SIM classes, storage sizes, offer titles, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import S, SPACES, drop_spaces, non_empty, trim_all, truthy
from .vocabulary import BUY_WORD


def absolute_url(c: Column, base: str) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(base), c))


def strip_prefix(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iu)^{BUY_WORD}{S}+", "")


def storage_label(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?iu){S}*ԳԲ", "GB")
    c = F.regexp_replace(c, rf"(?iu){S}*ՏԲ", "TB")
    return drop_spaces(c)


def catalog_sim_suffix(value: Column) -> Column:
    """SIM suffix for a catalog attribute value; the first rule that holds decides."""
    v = F.lower(F.coalesce(value, F.lit("")))
    plain_esim = v.contains("esim")
    for other in ("nano", "sim +", "+ esim", "1 sim"):
        plain_esim = plain_esim & ~v.contains(other)
    return (
        F.when(plain_esim, F.lit(" eSim"))
        .when(v.contains("sim + esim") | v.contains("nano"), F.lit(" Nano-Sim"))
        .when(v.contains("2 esim") | v.contains("dual esim"), F.lit(" Dual eSim"))
        .otherwise(F.lit(""))
    )


def catalog_title(name: Column, suffix: Column) -> Column:
    """Add the SIM suffix unless the title already names a SIM type."""
    names_sim = F.lower(name).contains("esim") | F.lower(name).contains("nano")
    return F.when((suffix != "") & ~names_sim, F.concat(name, suffix)).otherwise(name)


def _modifier_class(label: Column, esim: str, nano: str, dual: str, other: Column) -> Column:
    v = F.lower(label)
    return (
        F.when(v.contains("+") | v.contains("nano") | v.rlike(r"^[0-9]"), F.lit(nano))
        .when(v.rlike(rf"e[{SPACES}-]?sim"), F.lit(esim))
        .when(v.contains("dual"), F.lit(dual))
        .otherwise(other)
    )


def modifier_sim(label: Column) -> Column:
    """SIM token of a modifier button, null if the label is not about SIM."""
    return _modifier_class(label, "esim", "nanosim", "dualsim", F.lit(None).cast("string"))


def modifier_suffix(label: Column) -> Column:
    return _modifier_class(label, "eSim", "Nano-Sim", "Dual", label)


def option_sim(label: Column) -> Column:
    v = F.lower(label)
    return (
        F.when(
            v.contains("esim+esim") | v.contains("esim + esim") | v.contains("2 esim"),
            F.lit("eSim+eSim"),
        )
        .when(
            v.contains("nano") | v.contains("/esim") | v.contains("+ esim"),
            F.lit("Nano-Sim"),
        )
        .when(trim_all(v).rlike(rf"^e[{SPACES}-]?sim\z"), F.lit("eSim"))
        .otherwise(label)
    )


def is_ram_label(label: Column) -> Column:
    return trim_all(label).rlike(r"(?i)^\d+gb\z")


def variant_price(modifier: Column, storage: Column) -> Column:
    """The modifier's own price, or the storage price where it adds none."""
    return F.when(truthy(modifier), modifier).otherwise(F.nullif(storage, F.lit(0.0)))


def title_ram_storage(base: Column, ram: Column, storage: Column) -> Column:
    return F.concat(base, F.lit(" "), ram, F.lit("/"), storage)


def title_storage_sim(base: Column, storage: Column, sim: Column) -> Column:
    return F.concat(base, F.lit(" "), storage, F.lit(" ("), sim, F.lit(")"))


def title_storage(base: Column, storage: Column) -> Column:
    return F.concat(base, F.lit(" "), storage)


def title_with_spec(base: Column, ram_spec: Column, storage: Column) -> Column:
    """Title of a variant without modifiers; a RAM value from the spec list goes in front."""
    ram = non_empty(ram_spec)
    return F.when(ram.isNull(), title_storage(base, storage)).otherwise(
        title_ram_storage(base, ram, storage)
    )


def title_with_modifier(base: Column, storage: Column, modifier: Column) -> Column:
    """Title of a button variant: RAM in front, SIM class in brackets, anything else behind."""
    label = trim_all(modifier)
    return (
        F.when(is_ram_label(modifier), title_ram_storage(base, label, storage))
        .when(
            modifier_sim(modifier).isNotNull(),
            title_storage_sim(base, storage, modifier_suffix(label)),
        )
        .otherwise(F.concat(base, F.lit(" "), storage, F.lit(" "), label))
    )


def attr_by_code(attributes: Column, codes: list[str]) -> Column:
    """First attribute with one of ``codes``; numeric map keys count in ascending order."""
    entries = F.transform(
        F.map_entries(attributes),
        lambda e: F.struct(
            e["key"].rlike(r"^(0|[1-9][0-9]{0,9})$").alias("numeric"),
            e["key"].alias("key"),
            e["value"].alias("value"),
        ),
    )
    numeric = F.filter(entries, lambda e: e["numeric"] & e["value"]["code"].isin(codes))
    named = F.filter(entries, lambda e: ~e["numeric"] & e["value"]["code"].isin(codes))
    by_number = F.array_sort(
        F.transform(
            numeric,
            lambda e: F.struct(e["key"].try_cast("bigint").alias("n"), e["value"].alias("value")),
        ),
        lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0),
    )
    return F.coalesce(F.get(by_number, F.lit(0))["value"], F.get(named, F.lit(0))["value"])
