"""URL filters: rules first, then a path-template tree per host. Native functions only.

Level by level, a node (host and template so far) whose children are many and varied turns its
next segment into a wildcard. In the tree of templates that makes, siblings with the same commonest
shape of segment below them are a kind. A branch is held against its kind: by how often each shape
comes below it, and by the rate of blocked pages among its labelled ones. What can't be told apart
merges, branches with few or no labels included, and a kind that makes up half of its parent's
pages stands for it one level up, to the host. So labels reach the branches that look the same, and
no others. A template is rejected when the smoothed share of blocked labels of what it merged with
is high enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, materialise, skew_lookup

#: (verdict, host, path start); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def templates(rows: DataFrame, depth: int, many: int, varied: float) -> DataFrame:
    """Add `template` to rows (host, path): '/' and its segments, variable ones as '*'.

    A node is generalised when it has at least `many` different children and they number at least
    `varied` times its pages. Segments beyond `depth` are written '**'. Each level counts pages by
    (node, segment), which pre-aggregates inside tasks, then looks the nodes up skew-safely.
    """
    rows = rows.withColumn("_segments", F.split(F.expr("substring(path, 2)"), "/", -1)).withColumn("template", F.lit(""))
    for level in range(1, depth + 1):
        segment = F.get("_segments", F.lit(level - 1))
        rows = rows.withColumn("_segment", segment)
        children = rows.where("_segment is not null").groupBy("host", "template", "_segment").agg(F.count("*").alias("n"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages"))
        nodes = materialise(nodes.select("host", "template", "pages", ((F.col("kinds") >= many) & (F.col("kinds") >= varied * F.col("pages"))).alias("_wild")), f"nodes{level}")
        total = nodes.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
        rows = skew_lookup(rows, nodes, ["host", "template"], "pages", total).drop("pages")
        shown = F.when(F.col("_wild"), F.lit("*")).otherwise(F.col("_segment"))
        rows = rows.withColumn("template", F.when(F.col("_segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), shown))).drop("_wild")
        rows = materialise(rows, f"template{level}")
    return rows.withColumn("template", F.when(F.size("_segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("_segments", "_segment")


def _shape(segment: Column) -> Column:
    """A segment's shape: runs of digits as 9, of ASCII letters as a; a dot where the path ends."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(segment, "[0-9]+", "9"), "[A-Za-z]+", "a"), F.lit("."))


def _branches(rows: DataFrame, leaves: DataFrame, z: float, least: int) -> DataFrame:
    """(host, level, node, up, kind, merges, rises) of the trees' nodes. up: the node above; kind: the
    commonest shape below it, the first of equals; merges: with its kind; rises: the kind to the node above."""
    prefix = lambda n: F.array_join(F.slice("parts", 1, n), "/")
    levels = F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level")
    at, above = F.col("level"), F.col("level") - 1
    shapes = rows.select("host", "parts", "segments", levels).groupBy("host", "level", prefix(at).alias("node"), prefix(above).alias("up"), _shape(F.get("segments", at)).alias("shape"))
    shapes = materialise(shapes.agg(F.count("*").alias("n")), "shapes")
    own = shapes.groupBy("host", "level", "node", "up").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "shape"))["shape"].alias("kind"))
    labels = leaves.select("host", "parts", "labels", "blocked", levels).groupBy("host", "level", prefix(at).alias("node")).agg(F.sum("labels").alias("k"), F.sum("blocked").alias("b"))
    own = materialise(own.join(labels, ["host", "level", "node"]), "nodes")
    among = ["host", "level", "up", "kind"]
    kinds = own.groupBy(*among).agg(F.sum("size").alias("all"), F.sum("k").alias("all_k"), F.sum("b").alias("all_b"))
    kinds = kinds.join(own.groupBy("host", "level", "up").agg(F.sum("size").alias("whole")), ["host", "level", "up"])
    shapes = shapes.join(own.select("host", "level", "node", "kind", "size"), ["host", "level", "node"])
    pooled = shapes.groupBy(*among, "shape").agg(F.sum("n").alias("pooled"))
    kinds = materialise(kinds.join(pooled.groupBy(*among).agg((F.count("*") - 1).alias("free")), among), "kinds")
    # Chi square against what all of the kind have: the sum of o * o / e, less the pages.
    fit = shapes.join(pooled, [*among, "shape"]).join(kinds.select(*among, "all"), among)
    fit = fit.groupBy("host", "level", "node").agg((F.sum(F.col("n") * F.col("n") * F.col("all") / (F.col("size") * F.col("pooled"))) - F.max("size")).alias("chi"))
    rate = F.try_divide("all_b", "all_k")
    same = F.abs(F.try_divide("b", "k") - rate) <= z * F.sqrt(F.try_divide(rate * (1 - rate), F.col("k")))
    merges = (F.col("chi") <= F.col("free") + z * F.sqrt(2.0 * F.col("free")) + 1e-6) & ((F.col("k") < least) | F.coalesce(same, F.lit(False)))
    out = own.join(fit, ["host", "level", "node"]).join(kinds, among)
    return materialise(out.select("host", "level", "node", "up", "kind", merges.alias("merges"), (2 * F.col("all") >= F.col("whole")).alias("rises")), "branches")


def judge_urls(pages: DataFrame, rules=RULES, depth: int = 3, many: int = 8, varied: float = 0.1, z: float = 1.96, least: int = 5, prior: float = 4.0, limit: float = 0.8) -> DataFrame:
    """One row per page: page_id, host, path, rule, template, purity, verdict.

    Pages that a rule judges are the labels. A branch of a host's tree merges with its kind if the
    shapes of its pages' next segments fit theirs (chi square below its mean and `z` standard
    deviations) and it has under `least` labels or a block rate within `z` standard errors of all
    of theirs. A node's labels are those of its own pages and of the kinds that rose to it; a
    template counts those of the highest node or kind that it merged into. Its purity is (blocked +
    prior / 2) / (labels + prior), so without labels one half; from `limit` on it is rejected.

    A null url, or one without '://', has empty host and path; these are one template. Equal urls
    share their verdict, rows that repeat a page_id each get one, a null page_id stays null, and
    ties in length between rules go to the later one by name. An empty table gives an empty result,
    and further columns are ignored, whatever their names.
    """
    # isNull guards: a null or odd url gives '' for both parts, never null.
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = materialise(rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)), "urls")
    rows = templates(rows, depth, many, varied)
    parts = F.split(F.expr("substring(template, 2)"), "/", -1)
    leaves = rows.groupBy("host", "template").agg(F.count("*").alias("pages"), F.count("_rule").alias("labels"), F.count(F.when(F.col("_rule.verdict") == "block", 1)).alias("blocked"))
    leaves = materialise(leaves.withColumns({"parts": parts, "parts_n": F.size(parts)}), "templates")
    n = leaves.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    placed = rows.select("host", F.split(F.expr("substring(path, 2)"), "/", -1).alias("segments"), parts.alias("parts"))
    branches = _branches(placed, leaves, z, least)
    # A template climbs while its node merges and the kind rises; all that come to where it stops stop there.
    way = leaves.select("host", "template", F.explode(F.sequence(F.lit(1), F.col("parts_n"))).alias("level"), "parts").withColumn("node", F.expr("array_join(slice(parts, 1, level), '/')"))
    ends = F.struct("level", F.when(F.col("merges"), F.col("up")).otherwise(F.col("node")).alias("at"), F.when(F.col("merges"), F.concat(F.lit("kind "), "kind")).otherwise("").alias("kind"))
    way = way.join(branches, ["host", "level", "node"]).groupBy("host", "template").agg(F.max(F.when(~(F.col("merges") & F.col("rises")), ends)).alias("stop"))
    stop = {"level": F.coalesce("stop.level", F.lit(0)), "at": F.coalesce("stop.at", F.lit("")), "kind": F.coalesce("stop.kind", F.lit(""))}
    way = materialise(way.select("host", "template", *[c.alias(k) for k, c in stop.items()]).join(leaves.select("host", "template", "pages", "labels", "blocked"), ["host", "template"]), "stops")
    sums = way.groupBy("host", "level", "at", "kind").agg(F.sum("labels").alias("k"), F.sum("blocked").alias("b"))
    found = way.join(sums, ["host", "level", "at", "kind"]).select("host", "template", "pages", ((F.col("b") + F.lit(prior / 2)) / (F.col("k") + F.lit(prior))).alias("purity"))
    out = skew_lookup(rows, materialise(found, "purity"), ["host", "template"], "pages", n)
    method = F.when(F.col("purity") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), "template", "purity", F.coalesce(F.col("_rule.verdict"), method).alias("verdict"))


def oracle(depth: int = 3, many: int = 8, varied: float = 0.1, z: float = 1.96, least: int = 5, prior: float = 4.0, limit: float = 0.8) -> str:
    """DuckDB's version of op10."""
    url = URL.replace("'", "''")
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
    steps = []
    for i in range(1, depth + 1):
        steps.append(f"""
 c{i} AS (SELECT host, template, len(list) AS kinds, pages FROM (
   SELECT host, template, list(DISTINCT segs[{i}]) AS list, count(segs[{i}]) AS pages FROM t{i - 1} WHERE segs[{i}] IS NOT NULL GROUP BY host, template)),
 t{i} AS (SELECT t.page_id, t.host, t.path, t.hit, t.segs,
   CASE WHEN t.segs[{i}] IS NULL THEN t.template WHEN c.kinds >= {many} AND c.kinds >= {varied}::DOUBLE * c.pages THEN t.template || '/*' ELSE t.template || '/' || t.segs[{i}] END AS template
   FROM t{i - 1} t LEFT JOIN c{i} c USING (host, template)),""")
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages
), t0 AS (
  SELECT page_id, host, path, CASE {cases} END AS hit, string_split(substr(path, 2), '/') AS segs, '' AS template FROM u
),{"".join(steps)}
 r AS (SELECT * REPLACE (CASE WHEN len(segs) > {depth} THEN template || '/**' ELSE template END AS template) FROM t{depth}),
 t AS (SELECT *, string_split(substr(template, 2), '/') AS parts FROM r),
 n AS (SELECT host, template, parts, count(hit) AS labels, count(*) FILTER (hit LIKE 'block %') AS blocked FROM t GROUP BY ALL),
 e AS (SELECT *, unnest(range(1, len(parts) + 1)) AS level FROM t),
 s AS (SELECT host, level, array_to_string(parts[1:level], '/') AS node, coalesce(array_to_string(parts[1:level - 1], '/'), '') AS up,
   coalesce(regexp_replace(regexp_replace(segs[level + 1], '[0-9]+', '9', 'g'), '[A-Za-z]+', 'a', 'g'), '.') AS shape, count(*) AS n FROM e GROUP BY ALL),
 w AS (SELECT *, unnest(range(1, len(parts) + 1)) AS level FROM n),
 o AS (SELECT * FROM (SELECT host, level, node, up, sum(n) AS size, first(shape ORDER BY n DESC, encode(shape)) AS kind FROM s GROUP BY ALL)
   JOIN (SELECT host, level, array_to_string(parts[1:level], '/') AS node, sum(labels) AS k, sum(blocked) AS b FROM w GROUP BY ALL) USING (host, level, node)),
 x AS (SELECT s.*, o.kind, o.size, sum(s.n) OVER q AS pooled, sum(s.n) OVER c AS everything, count(DISTINCT s.shape) OVER c - 1 AS free
   FROM s JOIN o ON o.host = s.host AND o.level = s.level AND o.node = s.node WINDOW c AS (PARTITION BY s.host, s.level, s.up, o.kind), q AS (PARTITION BY s.host, s.level, s.up, o.kind, s.shape)),
 f AS (SELECT host, level, node, sum(n * n * everything / (size * pooled)) - max(size) AS chi, max(free) AS free FROM x GROUP BY ALL),
 a AS (SELECT *, sum(k) OVER c AS all_k, sum(b) OVER c AS all_b, 2 * sum(size) OVER c >= sum(size) OVER (PARTITION BY host, level, up) AS rises FROM o WINDOW c AS (PARTITION BY host, level, up, kind)),
 m AS (SELECT host, level, node, up, kind, rises, chi <= free + {z}::DOUBLE * sqrt(CAST(2 AS DOUBLE) * free) + CAST(0.000001 AS DOUBLE) AND (k < {least}
   OR coalesce(abs(b / nullif(k, 0) - all_b / nullif(all_k, 0)) <= {z}::DOUBLE * sqrt(all_b / nullif(all_k, 0) * (1 - all_b / nullif(all_k, 0)) / nullif(k, 0)), false)) AS merges
   FROM a JOIN f USING (host, level, node)),
 y AS (SELECT w.host, w.template, w.labels, w.blocked, coalesce(max(CASE WHEN NOT (merges AND rises) THEN {{'level': w.level, 'at': CASE WHEN merges THEN up ELSE node END, 'kind': CASE WHEN merges THEN 'kind ' || kind ELSE '' END}} END), {{'level': 0, 'at': '', 'kind': ''}}) AS stop
   FROM w JOIN m ON m.host = w.host AND m.level = w.level AND m.node = array_to_string(w.parts[1:w.level], '/') GROUP BY ALL),
 v AS (SELECT host, template, (sum(blocked) OVER g + {prior}::DOUBLE / 2) / (sum(labels) OVER g + {prior}::DOUBLE) AS purity FROM y WINDOW g AS (PARTITION BY host, stop))
SELECT t.page_id, t.host, t.path, split_part(t.hit, ' ', 2) AS rule, t.template, v.purity,
  coalesce(split_part(t.hit, ' ', 1), CASE WHEN v.purity >= {limit}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM t JOIN v USING (host, template)"""
