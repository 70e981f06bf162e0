"""Catalogue operators: mapping, classification, pools, coverage, numbering.

Rule tables made with ``literal_table`` carry a broadcast hint, their size
being fixed in code. Rule tables from elsewhere are left to the planner.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jointframe import fixed
from jointframe.functions import scalar as sc
from jointframe.plans.ordered import ranked


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A configuration table of fixed size, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


# -- mapping ------------------------------------------------------------------------------

def map_category(objects: DataFrame, rules: DataFrame, fallback: str | Column) -> DataFrame:
    """Add ``factory`` by exact category; unknown categories take the fallback.

    ``rules`` is a configuration table (category, factory).
    """
    fill = F.lit(fallback) if isinstance(fallback, str) else fallback
    return objects.join(rules, "category", "left").withColumn("factory", F.coalesce("factory", fill))


def detect_source(factories: DataFrame, registry: DataFrame, hints: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """Add ``source``: registry table (factory, source) first, then the first hint the name contains."""
    guess = None
    for part, source in hints:
        hit = F.col("factory").contains(part)
        guess = F.when(hit, source) if guess is None else guess.when(hit, source)
    guess = F.lit(default) if guess is None else guess.otherwise(default)
    return factories.join(registry, "factory", "left").withColumn("source", F.coalesce("source", guess))


def rule_or_generic(factories: DataFrame, rules: DataFrame, pattern: str, generic: str) -> DataFrame:
    """Add ``rule``: the factory's own, else the generic one when the name matches, else null."""
    own = factories.join(rules, "factory", "left")
    return own.withColumn("rule", F.coalesce("rule", F.when(F.col("factory").rlike(pattern), F.lit(generic))))


def seeds_to_objects(ids: DataFrame, seeds: DataFrame) -> DataFrame:
    """Object and variant flag per (factory, seed); seeds past the catalogue reuse objects in a cycle.

    ``ids`` is (factory, object_id) in load order of the id. The ranks of a hot
    factory are computed in blocks.
    """
    numbered = ranked(ids, ["factory"], ["object_id"], "_pos")
    sizes = numbered.groupBy("factory").agg(F.max("_pos").alias("_n"))
    wanted = seeds.join(sizes, "factory").withColumn("_pos", F.pmod("seed", "_n") + 1)
    return wanted.join(numbered, ["factory", "_pos"]).select(
        "factory", "seed", "object_id", (F.col("seed") >= F.col("_n")).alias("is_variant"))


# -- classification -----------------------------------------------------------------------

def any_of(text: Column, words: Sequence[str]) -> Column:
    """The text holds one of the words; plain searches are much faster than a pattern of alternatives."""
    out = None
    for word in words:
        hit = text.contains(word)
        out = hit if out is None else out | hit
    return out


def moves_by_text(text: Column) -> Column:
    """A moving stem is present and no anchoring phrase is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(low, fixed.MOVE_STEMS) & ~any_of(low, fixed.ANCHOR_PHRASES)


def classify_material(name: Column) -> Column:
    """struct(category, composite).

    Composite names take the keyword standing earliest (ties: table order),
    simple names the first keyword of the table; plastic if none.
    """
    low = F.lower(name)
    composite = any_of(low, fixed.COMPOSITE_MARKS)
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("ord"), F.lit(c).alias("cat"))
                      for i, (w, c) in enumerate(fixed.MATERIAL_KEYWORDS)])

    def found(k: Column) -> Column:
        at = F.position(k["w"], low)
        return F.when(at > 0, F.struct(F.when(composite, at).otherwise(0).alias("at"), k["ord"], k["cat"]))

    best = F.array_min(F.transform(words, found))
    return F.struct(F.coalesce(best["cat"], F.lit("plastic")).alias("category"), composite.alias("composite"))


def _first(rules: Sequence[tuple], names: Sequence[str], hits: Sequence[Callable[[tuple], Column]]) -> Column:
    """Struct of the first configuration row that hits, rows being asked in order for each of ``hits`` in turn; null without a hit.

    One chain of conditions on literals, which stays in generated code and stops at the first hit.
    """
    out = None
    for hit in hits:
        for row in rules:
            found = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)])
            out = F.when(hit(row), found) if out is None else out.when(hit(row), found)
    return out


def material_look(parts: DataFrame, looks: Sequence[tuple], name: str = "material") -> DataFrame:
    """Add metallic, roughness, r, g, b: exact name, else first table name contained in any case, else default.

    ``looks`` is configuration: (look, ord, metallic, roughness, r, g, b).
    """
    cols, own, low = ["metallic", "roughness", "r", "g", "b"], F.col(name), F.col("_low")
    table = sorted(looks, key=lambda r: r[1])
    best = _first(table, ["look", "ord", *cols], [lambda r: own == r[0], lambda r: low.contains(r[0].lower())])
    out = parts.withColumn("_low", F.lower(own)).withColumn("_look", best)
    return out.select(*parts.columns, *[F.coalesce(F.col("_look")[c], F.lit(d)).alias(c) for c, d in zip(cols, fixed.DEFAULT_LOOK)])


def part_override(parts: DataFrame, rules: Sequence[tuple], default: tuple[float, float], key: Sequence[str]) -> DataFrame:
    """Metallic and roughness by the first rule keyword in the part name, with keyed variation, clamped.

    ``rules`` is configuration: (keyword, ord, metallic, roughness).
    """
    best = _first(sorted(rules, key=lambda r: r[1]), ["keyword", "ord", "metallic", "roughness"], [lambda r: F.col("name").contains(r[0])])
    ident = [F.col(k) for k in key]
    out = parts.withColumn("_rule", best)
    base_m = F.coalesce(F.col("_rule")["metallic"], F.lit(default[0]))
    base_r = F.coalesce(F.col("_rule")["roughness"], F.lit(default[1]))
    return out.withColumns({
        "metallic": sc.clamp(base_m + sc.uniform_between(-0.05, 0.05, *ident, F.lit("m")), 0.0, 1.0),
        "roughness": sc.clamp(base_r + sc.uniform_between(-0.08, 0.08, *ident, F.lit("r")), 0.0, 1.0),
    }).drop("_rule")


def clean_material_name(name: Column) -> Column:
    """Text after ``shader_`` and before ``_deepcopy``."""
    tail = F.regexp_replace(name, "^.*?shader_", "")
    return F.substring_index(tail, "_deepcopy", 1)


def physics_class(name: Column) -> Column:
    """metal, plastic or wood if contained, in that order; else a known class of that name; else base."""
    low = F.lower(name)
    out = None
    for word in ("metal", "plastic", "wood"):
        hit = low.contains(word)
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.when(low.isin(*fixed.PHYSICS_RANGES), low).otherwise("base")


def draw_physics(parts: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
    """Friction and density drawn uniformly in the class ranges; no material: friction 0, density 1000."""
    ident = [F.col(k) for k in key]
    kind = physics_class(clean_material_name(F.col(name)))
    bounds = F.create_map(*[x for k, v in [*fixed.PHYSICS_RANGES.items(), ("base", fixed.BASE_PHYSICS)]
                            for x in (F.lit(k), F.array(*[F.lit(float(b)) for b in v]))])
    span = bounds[kind]
    def draw(i: int, tag: str) -> Column:
        return span[i] + sc.uniform(*ident, F.lit(tag)) * (span[i + 1] - span[i])
    none = F.col(name).isNull()
    return parts.withColumns({
        "physics": F.when(none, "none").otherwise(kind),
        "friction": F.when(none, 0.0).otherwise(draw(0, "f")),
        "density": F.when(none, 1000.0).otherwise(draw(2, "d")),
    })


# -- moving parts by rule -----------------------------------------------------------------

def moving_by_name(parts: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``moving`` and ``excluded``; an object without any match moves all its parts.

    ``rules`` is a configuration table (factory, name, role) with role moving or exclude.
    """
    role = {r: rules.where(F.col("role") == r).select("factory", "name", F.lit(True).alias(f"_{r}"))
            for r in ("moving", "exclude")}
    hit = parts.join(role["moving"], ["factory", "name"], "left").join(role["exclude"], ["factory", "name"], "left")
    hit = hit.withColumn("_hit", F.coalesce("_moving", F.lit(False)))
    any_hit = hit.groupBy(*keys).agg(F.bool_or("_hit").alias("_any"))
    out = hit.join(any_hit, list(keys))
    return out.select(
        *parts.columns,
        (F.col("_hit") | ~F.col("_any")).alias("moving"),
        (F.coalesce("_exclude", F.lit(False)) | (F.col("name") == "unknown_part")).alias("excluded"),
    )


def moving_with_fallback(parts: DataFrame, named: DataFrame, excluded: DataFrame, under_joint: DataFrame,
                         keys: Sequence[str], label: str = "label") -> DataFrame:
    """Role of every part: moving, body or excluded.

    Name matches first; only an object without one takes the parts below its
    joints; if that leaves no body, excluded parts become the body.
    """
    flag = F.lit(True)
    out = (
        parts.join(named.withColumn("_n", flag), "name", "left")
        .join(excluded.withColumn("_x", flag), "name", "left")
        .join(under_joint.select(*keys, label).distinct().withColumn("_j", flag), [*keys, label], "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_n", "_x", "_j")})
    )
    per = out.groupBy(*keys).agg(
        F.bool_or("_n").alias("_any_n"),
        F.bool_or(~F.col("_x") & ~F.col("_n")).alias("_body_by_name"),
        F.bool_or(~F.col("_x") & ~F.col("_j")).alias("_body_by_joint"),
    )
    has_body = F.when(F.col("_any_n"), F.col("_body_by_name")).otherwise(F.col("_body_by_joint"))
    moves = F.when(F.col("_any_n"), F.col("_n")).otherwise(F.col("_j"))
    role = (
        F.when(F.col("_x") & has_body, "excluded").when(F.col("_x"), "body").when(moves, "moving").otherwise("body")
    )
    return out.join(per, list(keys)).select(*parts.columns, role.alias("role"))


# -- pools and reports --------------------------------------------------------------------

def material_pool(parts: DataFrame) -> DataFrame:
    """Distinct materials with their use counts per (factory, part name), defaults filled in.

    One row per pool entry: a popular part name stays spread over tasks.
    """
    d = fixed.PART_DEFAULTS
    filled = parts.select(
        "factory",
        *[F.coalesce(F.col(c), F.lit(d[c])).alias(c) for c in ("name", "material", "density", "youngs", "poisson")],
    )
    return filled.groupBy(*filled.columns).agg(F.count("*").alias("uses"))


def coverage(parts: DataFrame, textured: DataFrame) -> DataFrame:
    """Parts per material category and whether the category has textures."""
    counts = parts.groupBy("category").agg(F.count("*").alias("n_parts"))
    return counts.join(textured.withColumn("textured", F.lit(True)), "category", "left").withColumn(
        "textured", F.coalesce("textured", F.lit(False)))


def uncovered_materials(parts: DataFrame, textured: DataFrame, top: int = 20) -> DataFrame:
    """The most used materials whose category has no texture."""
    return (
        parts.join(textured, "category", "left_anti").groupBy("material").agg(F.count("*").alias("n_parts"))
        .orderBy(F.desc("n_parts"), "material").limit(top)
    )


def first_per_factory(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First n rows per key; the rank limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= n)


def factories_with_all(tags: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Relational division: factories that have every wanted tag."""
    return (
        tags.where(F.col("tag").isin(*wanted)).groupBy("factory").agg(F.countDistinct("tag").alias("_n"))
        .where(F.col("_n") == len(set(wanted))).select("factory")
    )


def usages_of_factories(tags: DataFrame, generator: str = "generator") -> DataFrame:
    """(factory, tag): all tags of each factory of ``tags`` and the tag that names the factory itself."""
    own = tags.select("factory").distinct().select("factory", F.concat(F.lit(f"{generator}:"), F.col("factory").cast("string")).alias("tag"))
    return tags.select("factory", "tag").distinct().unionByName(own)


def merge_rules(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rules of both tables; those of the first win."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))
