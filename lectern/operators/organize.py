"""Rules, reconciliation, feedback and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import folder_name, is_pattern, repaired_json, version_key
from lectern.operators.rows import collision_names, first_of_each

RULES = "id bigint, pattern string, target_folder string, priority int, enabled boolean, action string, source_directories array<string>"


def rules_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULES)


def classified(files: DataFrame, rules: DataFrame, by_category: bool = True) -> DataFrame:
    """(id, rule_id, folder, action): the first enabled rule whose extensions and sources fit, scoped ones
    first, then by priority and id; else the category's folder. The rules are a settings table and broadcast."""
    each = rules.where("enabled").where((F.col("action") == "ignore") | folder_name(F.col("target_folder")).isNotNull())
    each = each.select("id", "target_folder", "priority", "action", "source_directories", F.explode(F.split(F.lower("pattern"), "\\s*[,;\\n]\\s*")).alias("rule_ext"))
    each = each.withColumnRenamed("id", "rule_id").dropDuplicates(["rule_id", "rule_ext"])
    scoped = F.size("source_directories") > 0
    inside = in_sources(F.col("path"), F.col("source_directories"))
    narrow = files.select("id", "path", F.lower("ext").alias("ext"), "category")
    fit = narrow.join(F.broadcast(each), (F.col("ext") == F.col("rule_ext")) & (~scoped | inside), "left")
    order = [F.when(F.col("rule_id").isNull(), 2).when(scoped, 0).otherwise(1).alias("o1"), (-F.coalesce("priority", F.lit(0))).alias("o2"), F.coalesce("rule_id", F.lit(0)).alias("o3")]
    best = first_of_each(fit.select("id", "category", "rule_id", "target_folder", "action", "priority", "source_directories"), ["id"], order)
    folder = F.when(F.col("rule_id").isNotNull() & (F.col("action") != "ignore"), F.col("target_folder"))
    if by_category:
        folder = F.when(F.col("rule_id").isNull(), F.col("category")).otherwise(folder)
    return best.select("id", "rule_id", folder.alias("folder"), F.coalesce("action", F.lit("category")).alias("action"))


def matches_any(name: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the whole name fits one of the globs."""
    return F.lower(name).rlike("^(?:" + "|".join(is_pattern(p).pattern for p in patterns) + ")$")


def reconciled(known: DataFrame, found: DataFrame) -> DataFrame:
    """(id, path, how): how each known file is found again: by path, by identity, by size and content;
    what isn't found is gone, and what has no match is new. Keys that aren't unique don't match.

    known: id, path, identity, size, content_hash; found: path, identity, size, content_hash. Each step
    joins only what the steps before left.
    """
    left, there, out = known, found, None
    for how, keys in (("path", ["path"]), ("identity", ["identity"]), ("content", ["size", "content_hash"])):

        def single(rows: DataFrame, keys: list[str] = keys) -> DataFrame:
            sizes = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
            return rows.join(sizes, keys, "left_semi")

        a = single(left).select("id", *(F.col(k).alias(f"_{k}") for k in keys))
        b = single(there)
        hit = a.join(b, [F.col(f"_{k}") == F.col(k) for k in keys]).select("id", "path", F.lit(how).alias("how"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("id"), "id", "left_anti")
        there = there.join(hit.select("path"), "path", "left_anti")
    gone = left.select("id", "path", F.lit("gone").alias("how"))
    new = there.select(F.lit(None).cast("long").alias("id"), "path", F.lit("new").alias("how"))
    return out.unionByName(gone).unionByName(new)


def default_rating(rank: Column, confidence: Column) -> Column:
    """good for the first ten results of a confidence of 0.7 or more, else bad."""
    return F.when(rank.between(1, 10) & (confidence >= 0.70), "good").otherwise("bad")


def valid_proposals(rows: DataFrame) -> DataFrame:
    """Proposals of sufficient confidence and length that don't try to change the instructions."""
    unsafe = F.lower("instructions").rlike("ignore (all |any )?(previous|prior)|system prompt|reveal|bypass|disable (the )?safety")
    return rows.where((F.col("confidence") >= 0.75) & F.length(F.trim("name")).between(3, 80) & F.length(F.trim("instructions")).between(12, 1200) & ~unsafe)


#: Where a skill of the same name comes from, the later wins.
PRECEDENCE = ("bundled", "shared", "managed")


def discovered(skills: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(p) for p in PRECEDENCE)), F.col("origin"))
    return first_of_each(skills, ["name"], [(-rank).alias("o1"), F.col("path")])


def releases_in_order(releases: DataFrame, condition: Column) -> DataFrame:
    """Newest first: build, version parts, time, own architecture before universal."""
    fit = releases.where(condition)
    return fit.orderBy(F.desc("build"), version_key(F.col("version")).desc(), F.desc("published_at"), F.when(F.col("architecture") == "universal", 1).otherwise(0), "id")


def is_newer(build: Column, version: Column, than_build: int, than_version: str) -> Column:
    return (build > than_build) | ((build == than_build) & (version_key(version) > version_key(F.lit(than_version))))


def coverage(expected: Column, completed: Column) -> Column:
    """struct<missing, unexpected, repeated>: two lists of ids compared."""
    counts = F.array_distinct(F.filter(completed, lambda x: F.size(F.filter(completed, lambda y: y == x)) > 1))
    return F.struct(F.array_except(expected, completed).alias("missing"), F.array_except(completed, expected).alias("unexpected"), F.array_sort(counts).alias("repeated"))


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks at most radius places from a hit of their file: an equality join, as each hit names its places."""
    around = hits.select("file_id", F.explode(F.sequence(F.col("chunk_idx") - radius, F.col("chunk_idx") + radius)).alias("chunk_idx")).distinct()
    return chunks.join(around, ["file_id", "chunk_idx"], "left_semi")


def resolved_references(messages: DataFrame, files: DataFrame, ids: str = "file_ids") -> DataFrame:
    """(id, names): names of the files that a message refers to, in its order; unknown ids are left out."""
    each = messages.select("id", F.posexplode(ids).alias("pos", "file_id"))
    named = each.join(files.select(F.col("id").alias("file_id"), "name"), "file_id")
    return named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l")).select("id", F.col("l.name").alias("names"))


def ocr_positions(lines: DataFrame) -> DataFrame:
    """Lines of a tile (x, y, w, h within it; tile_x, tile_y, scale) at their place on the page."""
    return lines.withColumns({c: F.round(F.col(f"tile_{c}") + F.col(c) * F.col("scale"), 6) for c in ("x", "y")} | {c: F.round(F.col(c) * F.col("scale"), 6) for c in ("w", "h")})


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller box; boxes are structs of x, y, w and h."""
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when((width > 0) & (height > 0) & (small > 0), width * height / small).otherwise(0.0)


def sections_in_order(sections: DataFrame, per_file: int = 12) -> DataFrame:
    """The first sections of each file by page (null last) and parent."""
    order = Window.partitionBy("file_id").orderBy(F.asc_nulls_last("page_start"), "parent_idx")
    return sections.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_file)


def in_sources(path: Column, roots: Column) -> Column:
    """Whether the path is one of the roots or below one."""
    return F.exists(roots, lambda r: (path == r) | F.startswith(path, F.concat(r, F.lit("/"))))


def manifests(entries: DataFrame, key: str) -> DataFrame:
    """(key, valid, ids): entries (key, place, id, role) in order; valid if no id or role is blank and none comes twice."""
    listed = entries.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.count_if((F.trim("id") != "") & (F.trim("role") != "")).alias("filled"), F.array_sort(F.collect_list(F.struct("place", "id"))).alias("l")
    )
    return listed.select(key, ((F.col("n") == F.col("different")) & (F.col("n") == F.col("filled"))).alias("valid"), F.array_join("l.id", ",").alias("ids"))


def move_plan(files: DataFrame, root: str) -> DataFrame:
    """files with target: root, category, subfolder if it's safe, and a name that no other of its folder has."""
    sub = folder_name(F.col("organization_subfolder"))
    folder = F.concat_ws("/", F.lit(root), "category", sub)
    stem = F.regexp_replace("name", "\\.[^.]*$", "")
    moves = files.withColumns({"folder": folder, "stem": stem})
    named = collision_names(moves.drop("name"), moves.select("folder", "stem", "ext").limit(0))
    return named.withColumn("target", F.concat_ws("/", "folder", "name"))


def normalised_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions (category, folder, rule_id, is_directory): folders go by category, and a rule that only names it is none."""
    plain = F.col("is_directory") | (F.col("folder") == F.col("category"))
    return decisions.withColumns({"folder": F.when(plain, F.col("category")).otherwise(F.col("folder")), "rule_id": F.when(~plain, F.col("rule_id"))})


def parsed_folders(answers: DataFrame) -> DataFrame:
    """(id, folder): the safe folder that each answer's object names."""
    named = folder_name(F.from_json(repaired_json(F.col("answer")), "folder string")["folder"])
    return answers.select("id", named.alias("folder")).where("folder IS NOT NULL")


def skills_for(skills: DataFrame, scope: str) -> DataFrame:
    """Enabled skills for everything or for the scope."""
    return skills.where(F.col("enabled") & F.col("scope").isin("all", scope))


def reconciled_by_path(known: DataFrame, found: DataFrame) -> DataFrame:
    """(id, path, how) by path alone: path, gone or new."""
    both = known.withColumn("_known", F.lit(1)).join(found.select("path").distinct().withColumn("_found", F.lit(1)), "path", "full_outer")
    return both.select("id", "path", F.when(F.col("_known").isNull(), "new").when(F.col("_found").isNull(), "gone").otherwise("path").alias("how"))

