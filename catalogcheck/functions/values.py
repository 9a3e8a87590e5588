"""What a catalog value says: quantities with units and asserted intervals, counts, packaging.

Everything is a Column expression over the verbatim string. A magnitude is kept as a whole number of billionths of the
dimension's base unit, with the half unit of its last written place, so that ``10`` and ``10.0`` stay different
assertions and both engines compute the same integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders that state nothing (fixed values).
NULLISH = ("", "-", "--", "---", "—", "–", ".", "?", "n/a", "n.a.", "na", "nil", "none", "null", "not applicable", "not specified", "unspecified", "unknown", "tbd", "tbc", "to be confirmed", "#n/a", "#value!", "0000-00-00")

#: unit -> (dimension, billionths of the base unit in one)
UNITS = {
    "A": ("current", 10**9), "mA": ("current", 10**6), "kA": ("current", 10**12),
    "V": ("voltage", 10**9), "mV": ("voltage", 10**6), "kV": ("voltage", 10**12),
    "W": ("power", 10**9), "kW": ("power", 10**12),
    "kg": ("mass", 10**9), "g": ("mass", 10**6), "mg": ("mass", 10**3),
    "m": ("length", 10**9), "mm": ("length", 10**6), "cm": ("length", 10**7), "in": ("length", 25_400_000),
    "s": ("time", 10**9), "min": ("time", 60 * 10**9),
}

#: Attributes on which a wrong value can hurt (fixed values).
SAFETY = ("breaking_capacity", "rated_current", "rated_voltage", "tripping_characteristic", "short_circuit_capacity", "residual_current_rating", "material_grade", "temperature_rating", "pressure_rating", "torque_rating", "load_rating", "packaging_uom", "hazard_classification", "compliance_declaration")

#: relation -> (disagreement class, raises a finding, severity); 9 is no finding (fixed values).
RELATIONS = {
    "equivalent": ("agreement", False, 9),
    "equivalent_unit_frame": ("unit_frame_mismatch", False, 9),
    "equivalent_vocabulary": ("semantic_equivalence", False, 9),
    "a_more_specific": ("agreement", False, 9),
    "b_more_specific": ("granularity_mismatch", True, 3),
    "a_precision_loss": ("precision_mismatch", True, 3),
    "b_precision_loss": ("agreement", False, 9),
    "contradiction": ("contradiction", True, 1),
    "incomparable": ("undetermined", False, 9),
}

#: Kind of each attribute of the catalog views, and the dimension that its header declares.
ATTRIBUTES = {"rated_current": ("quantity", "current"), "weight": ("quantity", "mass"), "poles": ("count", None), "packaging_uom": ("packaging", None)}

_QUANTITY = r"^\s*([+-]?)([0-9]+)(\.([0-9]+))?\s*([A-Za-z]+)\s*$"
_BOX_OF = r"^(box|pack|carton|bag|set)\s+of\s+([0-9]+)$"
_N_PIECES = r"^([0-9]+)\s*(pcs|pc|pieces|piece)$"


def lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]), key)


def present(v: Column) -> Column:
    """Whether a cell states something; null (a missing column) gives null."""
    return ~F.lower(F.trim(v)).isin(list(NULLISH))


def is_safety(attr: Column) -> Column:
    key = F.regexp_replace(F.lower(F.trim(attr)), "[- ]", "_")
    tail = F.substring_index(F.substring_index(key, ":", -1), "/", -1)
    return F.coalesce(key.isin(list(SAFETY)) | tail.isin(list(SAFETY)), F.lit(False))


def folded(v: Column) -> Column:
    """The key of an alias: no case, space, dash or underscore."""
    return F.regexp_replace(F.lower(v), r"[\s\-_]+", "")


def quantity(v: Column) -> Column:
    """struct(dim, unit, scale, mag, half), all null unless the value is a number with a known unit; ``mag`` alone is null
    for a number too large to hold."""
    unit = F.regexp_extract(v, _QUANTITY, 5)
    fits = v.rlike(_QUANTITY) & unit.isin(list(UNITS))
    fraction = F.regexp_extract(v, _QUANTITY, 4)
    scale = F.length(fraction)
    digits = F.concat(F.regexp_extract(v, _QUANTITY, 2), fraction).try_cast("bigint")
    sign = F.when(F.regexp_extract(v, _QUANTITY, 1) == "-", -1).otherwise(1)
    tens = F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(10)]), F.least(scale, F.lit(9)) + 1)
    one = lookup({u: F.lit(f).cast("bigint") for u, (_, f) in UNITS.items()}, unit)

    def whole(x: Column) -> Column:
        return F.when(fits & (scale <= 9), x)

    return F.struct(
        whole(lookup({u: d for u, (d, _) in UNITS.items()}, unit)).alias("dim"),
        whole(unit).alias("unit"),
        whole(scale).alias("scale"),
        whole(sign * F.call_function("div", F.try_multiply(digits, one), tens)).alias("mag"),
        whole(F.call_function("div", one, tens * 2)).alias("half"),
    )


def count_of(v: Column) -> Column:
    """The number of ``2`` or ``2P``, null for anything else."""
    return F.regexp_extract(F.trim(v), "^([0-9]+)[Pp]?$", 1).try_cast("bigint")


def packaging(v: Column) -> Column:
    """struct(container, qty): each and bare counts have the container ``each``; null if not understood."""
    t = F.lower(F.trim(v))
    box = t.rlike(_BOX_OF)
    pieces = t.rlike(_N_PIECES)
    each = t.isin("ea", "each", "pc", "piece")
    container = F.when(box, F.regexp_extract(t, _BOX_OF, 1)).when(pieces | each, "each")
    qty = F.when(box, F.regexp_extract(t, _BOX_OF, 2)).when(pieces, F.regexp_extract(t, _N_PIECES, 1)).when(each, "1").try_cast("bigint")
    return F.struct(container.alias("container"), qty.alias("qty"))


def normalised(attr: Column, v: Column) -> Column:
    """struct(kind, dim, unit, mag, half, container, refusal): one of a value and a reason why there is none."""
    kind = lookup({k: t for k, (t, _) in ATTRIBUTES.items()}, attr)
    q, n, p = quantity(v), count_of(v), packaging(v)
    understood = F.when(kind == "quantity", q["mag"].isNotNull()).when(kind == "count", n.isNotNull()).when(kind == "packaging", p["qty"].isNotNull())
    too_large = (kind == "quantity") & q["dim"].isNotNull() & q["mag"].isNull()
    refusal = F.when(v.isNull(), "absent").when(~present(v), "empty").when(too_large, "out_of_range").when(~F.coalesce(understood, F.lit(False)), "no_grammar_match")
    ok = refusal.isNull()
    return F.struct(
        F.when(ok, kind).alias("kind"),
        F.when(ok, q["dim"]).alias("dim"),
        F.when(ok & (kind == "quantity"), q["unit"]).alias("unit"),
        F.when(ok, F.when(kind == "quantity", q["mag"]).when(kind == "count", n).otherwise(p["qty"])).alias("mag"),
        F.when(ok, F.when(kind == "quantity", q["half"]).otherwise(F.lit(0).cast("bigint"))).alias("half"),
        F.when(ok, p["container"]).alias("container"),
        refusal.alias("refusal"),
    )


def relation(a: Column, b: Column, raw_a: Column, raw_b: Column) -> Column:
    """How two normalised values stand to each other; ``a`` is the catalog's side."""
    refused = a["refusal"].isNotNull() | b["refusal"].isNotNull()
    overlap = F.abs(a["mag"] - b["mag"]) <= a["half"] + b["half"]
    quantity_case = (
        F.when(a["dim"] != b["dim"], "incomparable")
        .when(overlap & (a["unit"] == b["unit"]), "equivalent")
        .when(overlap, "equivalent_unit_frame")
        .otherwise("contradiction")
    )
    count_case = F.when(a["mag"] != b["mag"], "contradiction").when(F.lower(F.trim(raw_a)) == F.lower(F.trim(raw_b)), "equivalent").otherwise("equivalent_vocabulary")
    pack_case = (
        F.when((a["mag"] != b["mag"]) | (a["container"] != b["container"]), "contradiction")
        .when(F.lower(F.trim(raw_a)) == F.lower(F.trim(raw_b)), "equivalent")
        .otherwise("equivalent_vocabulary")
    )
    return (
        F.when(refused | (a["kind"] != b["kind"]), "incomparable")
        .when(a["kind"] == "quantity", quantity_case)
        .when(a["kind"] == "count", count_case)
        .otherwise(pack_case)
    )


def classified(rel: Column, kind: Column) -> Column:
    """struct(class, raises, severity) of a relation; a contradiction of packaging is an error of its frame."""
    frame = (rel == "contradiction") & (kind == "packaging")
    return F.struct(
        F.when(frame, "packaging_frame_error").otherwise(lookup({r: c for r, (c, _, _) in RELATIONS.items()}, rel)).alias("cls"),
        lookup({r: f for r, (_, f, _) in RELATIONS.items()}, rel).alias("raises"),
        lookup({r: s for r, (_, _, s) in RELATIONS.items()}, rel).alias("severity"),
    )


def defect_shape(catalog: Column, proposed: Column) -> Column:
    """The shape of a difference, from the two strings alone."""
    number = r"-?[0-9]+([.,][0-9]+)?"
    a, b = F.trim(F.coalesce(catalog, F.lit(""))), F.trim(F.coalesce(proposed, F.lit("")))
    na, nb = F.regexp_extract(a, number, 0), F.regexp_extract(b, number, 0)

    def tail(v: Column, n: Column) -> Column:
        return F.lower(F.trim(F.substr(v, F.instr(v, n) + F.length(n))))

    def core(n: Column) -> Column:
        """The digits without leading and trailing zeros and the point: equal for powers of ten of one another."""
        plain = F.regexp_replace(F.regexp_replace(n, "[.,-]", ""), "^0+", "")
        return F.regexp_replace(plain, "0+$", "")

    def sorted_digits(n: Column) -> Column:
        return F.array_join(F.array_sort(F.split(F.regexp_replace(n, "[^0-9]", ""), "")), "")

    def value(n: Column) -> Column:
        return F.regexp_replace(n, ",", ".").try_cast("decimal(38,9)")

    ta, tb = tail(a, na), tail(b, nb)
    return (
        F.when(a == "", "blank_cell")
        .when(b == "", "no_proposal")
        .when((na == "") | (nb == ""), "value_substitution")
        .when((ta != "") & (tb != "") & (ta != tb), "dimension_mismatch")
        .when((value(nb) != 0) & (value(na) != value(nb)) & (F.signum(value(na)) == F.signum(value(nb))) & (core(na) == core(nb)), "order_of_magnitude")
        .when((sorted_digits(na) == sorted_digits(nb)) & (value(na) != value(nb)), "digit_transposition")
        .otherwise("value_substitution")
    )


def uuid5(namespace: str, key: Column) -> Column:
    """The name-based identifier of a key: SHA-1 of namespace and key, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(key, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))

    def cut(start: int, n: int) -> Column:
        return F.substr(h, F.lit(start), F.lit(n))

    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))
