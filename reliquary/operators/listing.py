"""Relational operators over catalog tables: lists, search, filters, hierarchy, summaries.

All are plain DataFrame code. Sorting is part of the result only where a list is asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def children(entries: DataFrame, parent: str | None = None) -> DataFrame:
    """Directories first, then by name, in byte order; roots for None."""
    return entries.where(F.col("parent_id").eqNullSafe(F.lit(parent))).orderBy(F.desc("is_dir"), "name", "id")


def entry(entries: DataFrame, entry_id: str) -> DataFrame:
    """The entry with this id, if any."""
    return entries.where(F.col("id") == entry_id)


def search(entries: DataFrame, query: str, columns: tuple[str, ...] = ("name", "path", "source", "type_code", "creator_code"), literal: bool = False) -> DataFrame:
    """Substring search in any column; ASCII letters match in either case, % and _ are wildcards
    unless literal. A blank query finds nothing."""
    query = query.strip()
    if not query:
        return entries.where(F.lit(False))
    if literal:
        tests = [F.contains(ascii_lower(F.col(c)), ascii_lower(F.lit(query))) for c in columns]
    else:
        tests = [ascii_lower(F.col(c)).like("%" + query.translate(str.maketrans(UPPER, UPPER.lower())).replace("\\", "\\\\") + "%") for c in columns]
    return entries.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])).orderBy("name", "id")


def filtered(entries: DataFrame, type_has: str | None = None, creator_has: str | None = None, has_rsrc: bool | None = None, min_size: int | None = None, max_size: int | None = None) -> DataFrame:
    """All given filters at once; sizes are of the data fork, bounds included."""
    tests = [
        F.contains(F.lower("type_code"), F.lit(type_has.lower())) if type_has else None,
        F.contains(F.lower("creator_code"), F.lit(creator_has.lower())) if creator_has else None,
        (F.col("rsrc_size") > 0) == F.lit(has_rsrc) if has_rsrc is not None else None,
        F.col("data_size") >= min_size if min_size is not None else None,
        F.col("data_size") <= max_size if max_size is not None else None,
    ]
    return reduce(lambda df, t: df.where(t), [t for t in tests if t is not None], entries)


def by_source(hits: DataFrame, name: str = "name") -> DataFrame:
    """Hits grouped by source; those without one are at the vault's root."""
    return hits.groupBy(F.coalesce("source", F.lit("Vault root")).alias("source")).agg(F.sort_array(F.collect_list(name)).alias("names"))


def by_folder(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.regexp_extract("name", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


def with_children(entries: DataFrame) -> DataFrame:
    """Entries that something has as its parent."""
    return entries.join(entries.select(F.col("parent_id").alias("id")).where("id is not null"), "id", "left_semi")


def summary(entries: DataFrame) -> DataFrame:
    """The card's six numbers in one pass."""
    return entries.agg(
        F.count_if(~F.col("is_dir")).alias("files"),
        F.count_if(F.col("is_dir")).alias("dirs"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if(F.col("rsrc_size") > 0).alias("with_rsrc"),
        F.coalesce(F.sum("data_size"), F.lit(0)).alias("data_bytes"),
        F.coalesce(F.sum(F.when(F.col("rsrc_size") > 0, F.col("rsrc_size"))), F.lit(0)).alias("rsrc_bytes"),
    )


def type_histogram(entries: DataFrame, most: int = 10, column: str = "type_code") -> DataFrame:
    """Most frequent types; ties by name."""
    known = entries.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return known.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def first_roots(entries: DataFrame, most: int = 25) -> DataFrame:
    return entries.where("parent_id is null").orderBy(F.desc("is_dir"), "name", "id").limit(most)


def _climbed(state: DataFrame, joined, most: int) -> tuple[DataFrame, bool]:
    """state (id, up, ...) until no row has an `up` left to go to. Each round replaces the way to
    `up` by the way to its own `up`, so ways double and a hierarchy of any depth takes few rounds.
    joined(rows, above) gives the new rows. Also whether rows are left after more steps than there
    are entries: these go round in a cycle."""
    steps = 1
    while True:
        state = cut(state)
        on = state.where("up is not null")
        if steps > 2 * most or on.isEmpty():
            return state, not on.isEmpty()
        above = state.select(*[F.col(c).alias(f"above_{c}") for c in state.columns])
        state = joined(state, on, above)
        steps *= 2


def subtree(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (one column, id) and all their descendants, however deep; entries of a cycle belong to
    what the cycle holds. An id that no entry has stays in the result."""
    chosen = ids.select("id").distinct()
    marked = entries.select("id", F.col("parent_id").alias("up")).join(chosen.withColumn("hit", F.lit(True)), "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def joined(state, on, above):
        # A row that is hit needs to climb no further; nor does one whose parent is no entry.
        met = on.where("not hit").join(above, on["up"] == F.col("above_id")).select("id", F.when(~F.col("above_hit"), F.col("above_up")).alias("up"), F.col("above_hit").alias("hit"))
        return state.where("up is null or hit").withColumn("up", F.lit(None).cast("string")).unionByName(met)

    state, _ = _climbed(marked.withColumn("up", F.when(~F.col("hit"), F.col("up").cast("string"))).withColumn("id", F.col("id").cast("string")), joined, entries.count())
    return chosen.unionByName(state.where("hit").select("id")).distinct()


def paths(entries: DataFrame, separator: str = "/") -> DataFrame:
    """id, path and depth of every entry below a root, at any depth. Entries whose chain of parents
    ends at an id that isn't there are left out; a cycle is an error."""
    start = entries.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), F.lit(0).alias("depth"))

    def joined(state, on, above):
        met = on.join(above, on["up"] == F.col("above_id"))
        met = met.select("id", F.col("above_up").alias("up"), F.concat("above_path", F.lit(separator), "path").alias("path"), (F.col("depth") + F.col("above_depth") + 1).alias("depth"))
        return state.where("up is null").unionByName(met)

    state, cycle = _climbed(start, joined, entries.count())
    if cycle:
        raise ValueError(f"entries go round in a cycle: {[r['id'] for r in state.where('up is not null').select('id').head(3)]}")
    return state.select("id", "path", "depth")


def breadcrumb(entries: DataFrame, entry_id: str) -> list[str]:
    """Names from the root down to one entry: one small lookup per level, each id once."""
    out, at, seen = [], entry_id, set()
    while at is not None and at not in seen:
        seen.add(at)
        row = entries.where(F.col("id") == at).select("name", "parent_id").head()
        if row is None:
            break
        out.append(row["name"])
        at = row["parent_id"]
    return out[::-1]


def tree(entries: DataFrame, eager: int = 200) -> DataFrame:
    """Each parent with its number of children, and the children themselves if there are at most `eager`."""
    counts = entries.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))
    few = entries.join(counts.where(F.col("children") <= eager), "parent_id").groupBy("parent_id").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return counts.join(few, "parent_id", "left")


def recents(known: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    return known.where(F.col("last_opened") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")).orderBy(F.desc("last_opened"), "path")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows are added where their key isn't there yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def first_of_each(members: DataFrame, key: str = "name", order: str = "ordinal") -> DataFrame:
    """The first row of each name: a map-side minimum, no window over whole groups."""
    best = F.min_by(F.struct(*members.columns), F.col(order)).alias("r")
    return members.groupBy(F.col(key).alias("_k")).agg(best).select("r.*")


def pair_forks(files: DataFrame) -> DataFrame:
    """Files (name, data_fork) with the fork of their best AppleDouble companion: `._name` beside
    them, then the path under __MACOSX, then the bare name there. One join on candidate names."""
    folder = F.regexp_extract("name", r"^(.*/)?[^/]*$", 1)
    leaf = F.regexp_extract("name", r"([^/]*)$", 1)
    hidden = files.where(leaf.startswith("._")).select(F.col("name").alias("_c"), F.col("data_fork").alias("companion"))
    plain = files.where(~leaf.startswith(".") & ~F.col("name").startswith("__MACOSX/"))
    spots = F.array(F.concat(folder, F.lit("._"), leaf), F.concat(F.lit("__MACOSX/"), folder, F.lit("._"), leaf), F.concat(F.lit("__MACOSX/._"), leaf))
    asked = plain.select("name", F.posexplode(spots).alias("rank", "_c")).join(hidden, "_c")
    best = asked.groupBy("name").agg(F.min_by("companion", "rank").alias("companion"))
    return plain.join(best, "name", "left")


def hls_paths(lines: DataFrame) -> DataFrame:
    """Files of a recursive listing: a line ending in ':' names the directory of those after it."""
    is_dir = F.col("line").endswith(":")
    before = Window.partitionBy("source_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("dir", F.last(F.when(is_dir, F.expr("substring(line, 1, length(line) - 1)")), ignorenulls=True).over(before))
    return rows.where(~is_dir & (F.trim("line") != "")).select("source_id", "ordinal", F.concat_ws("/", "dir", F.trim("line")).alias("path"))


def image_size(entries: DataFrame) -> DataFrame:
    """Disk size for all data: 1.3 times and 32 KB more, the first standard size that holds it."""
    #: Standard sizes in bytes.
    sizes = (409_600, 819_200, 1_474_560, 5_242_880, 10_485_760, 20_971_520, 52_428_800, 104_857_600, 524_288_000)
    need = (F.coalesce(F.sum("data_size"), F.lit(0)) + F.coalesce(F.sum("rsrc_size"), F.lit(0))) * F.lit(1.3)
    out = entries.agg((F.floor(need) + 32_768).cast("long").alias("needed"))
    fits = F.array_min(F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]), lambda s: s >= F.col("needed")))
    return out.withColumn("image_size", F.coalesce(fits, F.greatest("needed", F.lit(819_200))))


def grouped_resources(resources: DataFrame) -> DataFrame:
    return resources.groupBy("type_code").agg(F.sort_array(F.collect_list("resource_id")).alias("ids"))


def find_resource(resources: DataFrame, type_code: str, resource_id: int | None = None) -> DataFrame:
    """All of a type, or the first with this id in each fork."""
    hits = resources.where(F.col("type_code") == type_code)
    if resource_id is None:
        return hits
    best = F.min_by(F.struct(*resources.columns), F.col("ordinal")).alias("r")
    return hits.where(F.col("resource_id") == resource_id).groupBy("owner_id").agg(best).select("r.*")


def best_icons(resources: DataFrame) -> DataFrame:
    from ..functions.resources import BEST_ICONS

    rank = F.array_position(F.array(*map(F.lit, BEST_ICONS)), F.col("type_code"))
    ranked = resources.where(rank > 0).withColumn("rank", rank)
    return ranked.groupBy("owner_id").agg(F.min_by(F.struct("type_code", "resource_id"), F.struct("rank", "ordinal")).alias("icon")).select("owner_id", "icon.*")


def described_resources(resources: DataFrame) -> DataFrame:
    """Each resource with its type's description; the registry has under a hundred rows."""
    from ..functions.resources import RESOURCE_TYPES

    names = resources.sparkSession.createDataFrame(list(RESOURCE_TYPES.items()), "type_code string, description string")
    return resources.join(F.broadcast(names), "type_code", "left").withColumn("description", F.coalesce("description", F.lit("Unknown resource type")))


def duplicates(forks: DataFrame, key: str = "data_sha256") -> DataFrame:
    """Hashes that several entries share."""
    return forks.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).where("copies > 1")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, change: added, removed or changed from left to right."""
    a, b = left.select("path", F.col("data_sha256").alias("a"), F.lit(True).alias("in_a")), right.select("path", F.col("data_sha256").alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, and of right what left has no data like."""
    return left.unionByName(right.join(left.select("data_sha256").distinct(), "data_sha256", "left_anti").select(*left.columns))


def assembled(extents: DataFrame, key: list[str], order: str, piece: str) -> DataFrame:
    """Pieces of each file, in order, as one."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("p"))))
    return extents.groupBy(*key).agg(F.array_join(F.transform(rows, lambda x: x["p"]), "").alias("content"))
