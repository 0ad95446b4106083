"""Binding of imports to modules and files across a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes that a script specifier may stand for, in order of preference; index files come after all of them.
SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]


def module_name(path: Column) -> Column:
    """Dotted module of a Python path: below ``src/`` or the root; a package's ``__init__`` is the package."""
    bare = F.regexp_replace(F.regexp_replace(path, "^src/", ""), r"\.pyi?$", "")
    return F.replace(F.regexp_replace(bare, "(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def absolute_target(importer: Column, is_package: Column, level: Column, target: Column) -> Column:
    """The dotted name that an import means; null where a relative one climbs above the root."""
    parts = F.split(importer, r"\.")
    keep = F.size(parts) - level + is_package.cast("int")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    relative = F.when(keep >= 0, F.concat_ws(".", F.when(base != "", base), F.when(target != "", target)))
    return F.when(level == 0, target).otherwise(relative)


def resolve_imports(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """Each import with the longest module of the repository that it names, the rest of the name, or its external package.

    A relative import names its whole target or the module that the target's last name comes from, nothing shorter.
    ``refs``: importer, is_package, level, target.  ``modules``: module.  Distinct imports are joined by all their prefixes, so the
    work grows with their depth, never with pairs.  Outcomes: bound, external (absolute, no module), unresolved.
    """
    key = ["importer", "is_package", "level", "target"]
    asked = refs.select(*key).distinct().withColumn("name", absolute_target(*[F.col(c) for c in key]))
    parts = F.split("name", r"\.")
    prefixes = asked.select("name").filter("name <> ''").distinct().withColumn("parts", parts).select("name", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"), "parts")
    prefixes = prefixes.select("name", "n", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".").alias("module"))
    best = prefixes.join(modules.select("module").distinct(), "module").groupBy("name").agg(F.max(F.struct("n", "module")).alias("best"))
    near = (F.col("level") == 0) | (F.col("best.n") >= F.size(parts) - 1)
    out = asked.join(best, "name", "left").withColumn("module", F.when(near, F.col("best.module")))
    external = F.when(F.col("module").isNull() & (F.col("level") == 0) & (F.col("name") != ""), F.split("name", r"\.")[0])
    outcome = F.when(F.col("module").isNotNull(), "bound").when(external.isNotNull(), "external").otherwise("unresolved")
    rest = F.when(F.col("module").isNotNull(), F.substr("name", F.char_length("module") + 2))
    return out.select(*key, "module", rest.alias("rest"), external.alias("external"), outcome.alias("outcome"))


def resolve_specifiers(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Relative script specifiers to files: dot segments are folded, then the first suffix whose path exists wins.

    ``refs``: importer (a path), specifier.  ``files``: path.  Bare specifiers are external; climbing above the root is unresolved.
    """
    asked = refs.select("importer", "specifier").distinct()
    relative = F.col("specifier").rlike(r"^\.{1,2}(/|$)")
    folder = F.regexp_replace("importer", "(^|/)[^/]*$", "")
    joined = F.split(F.concat_ws("/", F.when(folder != "", folder), F.col("specifier")), "/")
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x != "..", F.array_append(acc, x)).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    # a climb above the root makes the fold null, and null stays null
    folded = F.aggregate(joined, F.array().cast("array<string>"), lambda acc, x: F.when(acc.isNotNull(), step(acc, x)))
    asked = asked.withColumn("base", F.when(relative, F.array_join(folded, "/")))
    tries = asked.filter("base is not null").select("base").distinct().select("base", F.posexplode(F.array(*[F.lit(s) for s in SUFFIXES], *[F.lit("/index" + s) for s in SUFFIXES[1:]])).alias("n", "suffix"))
    tries = tries.select("base", "n", F.ltrim(F.concat("base", "suffix"), F.lit("/")).alias("path"))
    best = tries.join(files.select("path").distinct(), "path").groupBy("base").agg(F.min(F.struct("n", "path"))["path"].alias("path"))
    outcome = F.when(F.col("path").isNotNull(), "bound").when(~relative, "external").otherwise("unresolved")
    return asked.join(best, "base", "left").select("importer", "specifier", "path", outcome.alias("outcome"))
