"""The module graph: resolving specifiers, uses, orphans and dead exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, paths
from .reach import reachable

_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
_TWIN = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".ts", ".cjs": ".ts"}
BUILT = ((".js", ".ts"), (".mjs", ".ts"), (".cjs", ".ts"), (".js", ".mjs"), (".mjs", ".mjs"))


def source_twins(spec: Column) -> Column:
    """A path and, for one in ``dist/``, the sources that it may be built from."""
    base = F.regexp_replace(spec, r"^\./", "")
    rest = F.substring(base, 6, 1 << 20)
    swaps = [F.when(rest.endswith(a), F.concat(F.lit("src/"), rest.substr(F.lit(1), F.length(rest) - len(a)), F.lit(b))) for a, b in BUILT]
    return F.when(base.startswith("dist/"), F.array_compact(F.array(base, F.concat(F.lit("src/"), rest), *swaps))).otherwise(F.array(base))


def candidates(spec: Column) -> Column:
    """The paths that a specifier may stand for, best first."""

    def of(c: Column) -> Column:
        twins = [F.when(c.endswith(js), F.concat(c.substr(F.lit(1), F.length(c) - len(js)), F.lit(ts))) for js, ts in _TWIN.items()]
        added = [F.concat(c, F.lit(middle + e)) for e in _EXTENSIONS for middle in ("", "/index")]
        return F.array_compact(F.array(c, *twins, *added))

    return F.flatten(F.transform(source_twins(spec), of))


def resolve(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and target: for each key the first known path among the candidates of its specs.

    ``wanted`` has ``keys``, spec and, where several specs compete, spec_ord.
    """
    order = F.col("spec_ord") if "spec_ord" in wanted.columns else F.lit(0)
    tries = wanted.select(*keys, order.alias("o"), F.posexplode(candidates(F.col("spec"))).alias("i", "path"))
    # Both sides grow with the files, and sizes taken from the columns of a scan are far too small: neither may be broadcast.
    return tries.join(known.select("path").distinct().hint("merge"), "path").groupBy(*keys).agg(F.min_by("path", F.struct("o", "i")).alias("target"))


def apply_aliases(specs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(spec, spec_ord, mapped): each bare specifier through the first rule of each config that fits it; aliases are a small table of rules."""
    star = F.instr("pattern", "*")
    prefix, suffix = F.expr("substring(pattern, 1, instr(pattern, '*') - 1)"), F.expr("substring(pattern, instr(pattern, '*') + 1)")
    fits = F.when(star == 0, F.col("spec") == F.col("pattern")).otherwise(F.col("spec").startswith(prefix) & F.col("spec").endswith(suffix))
    middle = F.expr("substring(spec, instr(pattern, '*'), length(spec) - length(pattern) + 1)")
    into = F.instr("target", "*")
    filled = F.when(into > 0, F.concat(F.expr("substring(target, 1, instr(target, '*') - 1)"), middle, F.expr("substring(target, instr(target, '*') + 1)"))).otherwise(F.concat("target", middle))
    mapped = F.when(star == 0, F.col("target")).otherwise(filled)
    bare = specs.where(~F.col("spec").rlike(r"^(?:\.\.?/|/)"))
    hits = bare.join(F.broadcast(aliases), fits).withColumn("mapped", mapped).where("mapped <> ''")
    first = hits.groupBy("spec", "config_ord").agg(F.min_by(F.struct("base_url", "mapped"), F.col("rule_ord")).alias("hit"))
    whole = F.when(F.col("hit.base_url") == "", F.col("hit.mapped")).otherwise(F.concat(F.col("hit.base_url"), F.lit("/"), F.col("hit.mapped")))
    joined = first.select("spec", F.col("config_ord").alias("spec_ord"), whole.alias("whole"))
    # A path that climbs above the root is refused; clamping it would point at another file.
    return joined.where(~_escapes(F.col("whole"))).select("spec", "spec_ord", paths.normalise(F.col("whole")).alias("mapped"))


def _escapes(path: Column) -> Column:
    depth = F.aggregate(
        F.filter(F.split(path, "/", -1), lambda x: (x != "") & (x != ".")), F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda a, x: F.struct((a["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"), F.least(a["least"], a["now"] + F.when(x == "..", -1).otherwise(1)).alias("least")),
    )
    return depth["least"] < 0


def _taken(field: str, whole: str) -> Column:
    """Array of (spec, names, whole) of a module's imports or re-exports."""
    out = F.transform(f"module.{field}", lambda u: F.struct(u["source"].alias("spec"), u["names"].alias("names"), u[whole].alias("whole")))
    return F.coalesce(out, F.array().cast("array<struct<spec:string,names:array<string>,whole:boolean>>"))


def uses(modules: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(src, dst, names, whole) of each resolved import and re-export; modules are (path, module)."""
    taken = F.concat(_taken("imports", "namespace"), _taken("reexports", "star"))
    each = modules.select(F.col("path").alias("src"), F.explode(taken).alias("u")).select("src", "u.*")
    pairs = each.select("src", "spec").distinct()
    wanted = pairs.where(F.col("spec").rlike(r"^\.\.?/")).select("src", F.col("spec").alias("raw"), F.lit(0).alias("spec_ord"), paths.resolve(F.col("spec"), F.col("src")).alias("spec"))
    if aliases is not None:
        mapped = apply_aliases(pairs.select("spec").distinct(), aliases)
        wanted = wanted.unionByName(pairs.join(mapped.hint("merge"), "spec").select("src", F.col("spec").alias("raw"), "spec_ord", F.col("mapped").alias("spec")))
    found = resolve(wanted.where("spec <> ''"), known, ["src", "raw"])
    return each.join(found.withColumnRenamed("raw", "spec").hint("merge"), ["src", "spec"]).select("src", F.col("target").alias("dst"), "names", F.coalesce("whole", F.lit(False)).alias("whole"))


def edges(used: DataFrame) -> DataFrame:
    return used.select("src", "dst").distinct()


def entrypoints(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(node): eligible files that are entrypoints by name or declared by a package (spec)."""
    own = files.where(kinds.is_entrypoint(F.col("path"), F.col("tier"))).select(F.col("path").alias("node"))
    if declared is None:
        return own
    named = resolve(declared.select(F.col("spec").alias("raw"), "spec"), files, ["raw"])
    return own.unionByName(named.select(F.col("target").alias("node"))).distinct()


def orphans(files: DataFrame, used: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, orphan_module) of every eligible file."""
    seen = reachable(entries, edges(used)).select(F.col("node").alias("path"), F.lit(False).alias("__orphan"))
    return files.select("path").join(seen.hint("merge"), "path", "left").select("path", F.coalesce("__orphan", F.lit(True)).alias("orphan_module"))


def dead_exports(modules: DataFrame, used: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, dead_export_symbols) of files with any; files used whole and entrypoints have none."""
    exported = modules.select("path", F.posexplode(F.array_distinct("module.exported_names")).alias("i", "name"))
    taken = used.select(F.col("dst").alias("path"), F.explode("names").alias("name")).distinct()
    exempt = used.where("whole").select(F.col("dst").alias("path")).unionByName(entries.select(F.col("node").alias("path"))).distinct()
    dead = exported.join(exempt.hint("merge"), "path", "left_anti").join(taken.hint("merge"), ["path", "name"], "left_anti")
    return dead.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("dead_export_symbols"))


def signals(files: DataFrame, modules: DataFrame, declared: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(path, orphan_module, dead_export_symbols) of the graph-eligible ``files`` (path, tier)."""
    eligible = files.where(kinds.is_graph_eligible(F.col("path"))).select("path", "tier")
    used = uses(modules, eligible, aliases)
    entries = entrypoints(eligible, declared)
    return orphans(eligible, used, entries).join(dead_exports(modules, used, entries), "path", "left")
