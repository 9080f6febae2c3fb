"""Import specifiers to project paths: candidates as an array in order, then one join with the known files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order in which module resolution tries extensions, and the source extensions behind emitted ones.
EXTENSIONS = [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
SUPPORTED = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
SUBSTITUTIONS = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx"], ".mjs": [".mts", ".d.mts"], ".cjs": [".cts", ".d.cts"]}
# The priority of export conditions.
CONDITIONS = ["source", "import", "module", "require", "default", "node", "browser", "development", "production", "types", "typings"]


def is_relative(specifier: Column) -> Column:
    return specifier.rlike(r"^\.\.?(?:/|$)")


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def normalize(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled signs; null if it leaves the project."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        out = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(acc.isNull(), None).when(p == "..", out).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def candidates(base: Column) -> Column:
    """All paths that a base may mean, most specific first; null for a null base."""
    ext = extension(base)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    out = F.when(base.isNull(), None)
    for emitted, sources in SUBSTITUTIONS.items():
        out = out.when(ext == emitted, F.array(*[F.concat(stem, F.lit(s)) for s in sources], base))
    out = out.when(ext.isin(SUPPORTED), F.array(base))
    bare = [F.concat(base, F.lit(e)) for e in EXTENSIONS] + [F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS]
    return out.otherwise(F.array(*bare))


def relative_bases(imports: DataFrame) -> DataFrame:
    """imports (importer, specifier) with bases: the one path that a relative specifier names, or none."""
    joined = F.concat(dirname(F.col("importer")), F.lit("/"), F.col("specifier"))
    base = F.when(is_relative(F.col("specifier")), normalize(joined))
    return imports.withColumn("bases", F.when(base.isNotNull() & (base != ""), F.array(base)).otherwise(F.array().cast("array<string>")))


@dataclass(frozen=True)
class Rule:
    """A specifier (``prefix*suffix``, or ``prefix`` alone) and the paths that it may name, where ``*`` is the capture.

    It holds for importers below ``scope``; of the rules that fit, the deepest scope and longest prefix win.
    """

    step: int
    scope: str
    prefix: str
    suffix: str | None
    targets: tuple[str, ...]


RULES = "step int, scope string, prefix string, suffix string, targets array<string>"
IMPORTS_MAP, WORKSPACE, PATHS = 1, 2, 3


def pattern_rule(step: int, scope: str, pattern: str, targets: list[str]) -> Rule:
    before, star, behind = pattern.partition("*")
    return Rule(step, scope.strip("/"), before, behind if star else None, tuple(targets))


def condition_targets(value: object) -> list[str]:
    """The strings in an exports value, by condition priority."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in condition_targets(v)]
    if not isinstance(value, dict):
        return []
    rank = {c: i for i, c in enumerate(CONDITIONS)}
    return [t for k in sorted(value, key=lambda k: rank.get(k, len(CONDITIONS))) for t in condition_targets(value[k])]


def package_rules(folder: str, manifest: dict) -> list[Rule]:
    """The rules of one package: its name and subpaths for everyone, its ``#`` names for its own files."""
    folder, name, rules = folder.strip("/"), manifest.get("name"), []
    at = lambda t: "/".join(x for x in (folder, t.removeprefix("./")) if x)
    if isinstance(name, str) and name:
        exports = manifest.get("exports")
        subpaths = exports if isinstance(exports, dict) and any(k == "." or k.startswith("./") for k in exports) else {".": exports}
        entry = condition_targets(subpaths.get(".")) + [manifest[k] for k in ("source", "main", "module", "types") if isinstance(manifest.get(k), str)] + ["src/index"]
        rules.append(pattern_rule(WORKSPACE, "", name, [at(t) for t in entry]))
        for key, value in subpaths.items():
            if key.startswith("./"):
                rules.append(pattern_rule(WORKSPACE, "", name + key[1:], [at(t) for t in condition_targets(value)]))
        if exports is None:
            rules.append(pattern_rule(WORKSPACE, "", f"{name}/*", [at("*"), at("src/*")]))
    for key, value in (manifest.get("imports") or {}).items():
        if key.startswith("#"):
            rules.append(pattern_rule(IMPORTS_MAP, folder, key, [at(t) for t in condition_targets(value) if t.startswith(".")]))
    return rules


def strip_jsonc(text: str) -> str:
    """JSON from JSON with comments and trailing commas; strings keep theirs."""
    kept = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", kept, flags=re.S)


def tsconfig_rules(path: str, read, seen: frozenset[str] = frozenset()) -> list[Rule]:
    """The ``paths`` rules of a tsconfig; of an ``extends`` chain, however long, the file nearest to it that has any. ``read`` gives a path's text or None."""
    folder = path.rpartition("/")[0]
    text = read(path)
    if text is None or path in seen:  # a chain may be a circle
        return []
    config = json.loads(strip_jsonc(text))
    options = config.get("compilerOptions") or {}
    if "paths" in options:
        base = "/".join(x for x in (folder, str(options.get("baseUrl", ".")).removeprefix("./").removeprefix(".")) if x)
        return [pattern_rule(PATHS, folder, k, ["/".join(x for x in (base, t.removeprefix("./")) if x) for t in v]) for k, v in options["paths"].items()]
    chain = config.get("extends") or []
    for parent in reversed([chain] if isinstance(chain, str) else chain):
        target = "/".join(x for x in (folder, parent.removeprefix("./")) if x)
        found = tsconfig_rules(target if target.endswith(".json") else f"{target}.json", read, seen | {path})
        if found:
            return [Rule(r.step, folder, r.prefix, r.suffix, r.targets) for r in found]
    return []


def glob_pattern(glob: str) -> str:
    """A workspace glob as a regular expression over folders: ``*`` is one segment, ``?`` one character, ``**`` any number of segments up to six."""
    out = ""
    for part in glob.strip("/").split("/"):
        out += r"(?:[^/]+/){0,6}" if part == "**" else re.escape(part).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "/"
    return "^" + out.removesuffix("/") + "$"


def workspace_members(folders: DataFrame, globs: list[str]) -> DataFrame:
    """The folders (folder) that workspace globs name; a later ``!glob`` takes folders out again."""
    inside, out = F.lit(False), F.lit(False)
    for g in globs:
        if g.startswith("!"):
            out = out | F.col("folder").rlike(glob_pattern(g[1:]))
        else:
            inside = inside | F.col("folder").rlike(glob_pattern(g))
    return folders.where(inside & ~out & ~F.col("folder").rlike(r"(?:^|/)(?:node_modules|\.[^/]*)(?:/|$)"))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.step, r.scope, r.prefix, r.suffix, list(r.targets)) for r in rules], RULES)


def ruled_bases(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """imports with step and bases by the best fitting rule of each step; several rows an import if several steps fit.

    A specifier has as many first letters as prefixes, so the join is on a prefix's first two letters, not all pairs.
    """
    spec = F.col("specifier")
    lead = imports.where(~is_relative(spec)).withColumn("_n", F.explode(F.sequence(F.lit(0), F.least(F.length(spec), F.lit(2))))).withColumn("_lead", F.substring(spec, F.lit(1), F.col("_n")))
    keyed = rules.withColumn("_lead", F.substring("prefix", 1, 2))
    fits = F.when(F.col("suffix").isNull(), spec == F.col("prefix")).otherwise(spec.startswith(F.col("prefix")) & spec.endswith(F.col("suffix")) & (F.length(spec) >= F.length("prefix") + F.length("suffix")))
    scoped = (F.col("scope") == "") | F.col("importer").startswith(F.concat("scope", F.lit("/")))
    met = lead.join(keyed, "_lead").where(fits & scoped)
    capture = F.when(F.col("suffix").isNotNull(), F.substring(spec, F.length("prefix") + 1, F.length(spec) - F.length("prefix") - F.length("suffix")))
    bases = F.transform("targets", lambda t: normalize(F.when(capture.isNull(), t).otherwise(F.replace(t, F.lit("*"), capture))))
    best = F.max_by(bases, F.struct(F.length("scope"), F.col("suffix").isNull().cast("int"), F.length("prefix"))).alias("bases")
    return met.groupBy("importer", "specifier", "step").agg(best)


def resolve(imports: DataFrame, files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(importer, specifier, path): the file that each import names, null if none is known.

    Relative names come first, then the importer's ``#`` names, workspace packages and path maps; within a step the
    first candidate that exists. ``files`` has filePath.
    """
    asked = imports.select("importer", "specifier").distinct()
    bases = relative_bases(asked).withColumn("step", F.lit(0)).select("importer", "specifier", "step", "bases")
    if rules is not None:
        bases = bases.unionByName(ruled_bases(asked, rules).select("importer", "specifier", "step", "bases"))
    one = bases.select("importer", "specifier", "step", F.posexplode("bases").alias("b", "base")).select("importer", "specifier", "step", "b", F.posexplode(candidates(F.col("base"))).alias("c", "filePath"))
    met = one.join(files.select("filePath").distinct(), "filePath").groupBy("importer", "specifier").agg(F.min_by("filePath", F.struct("step", "b", "c")).alias("path"))
    return asked.join(met, ["importer", "specifier"], "left")
