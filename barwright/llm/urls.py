"""URL filters: rules first, then a path-template tree of each host.

A host's labelled URLs form a tree of all their path segments; the end of a
path is a branch of its own, named "". Segments that look variable (with a
digit, or long) turn into wildcards. Sibling branches whose labelled counts a
two-proportion test cannot tell apart merge into one wildcard branch, level by
level from the deepest upwards: many siblings with few labels each are alike by
this test, so they become one branch, while a branch without siblings keeps its
name. A literal segment * counts as variable. A
template is rejected when the smoothed share of good labels under it falls
below a cutoff; the smoothing starts from the host, and the host from the whole
corpus, so a template with few labels follows its host. A branch that has all
labels of its parent keeps the parent's share, since they tell nothing new.

A URL goes down the tree as far as there are templates: to the branch of its
segment, else to the wildcard (which stands for siblings that have no branch of
their own). Where neither is there it stops, and the template ends in "**".

The levels are as many as the longest labelled path has. Each is made by
grouped sums with partial sums before rows move, so a host with a third of all
URLs sends a row for each template and task. Sibling tests compare a branch
with all its siblings together, which needs their sums only. URLs go down as
distinct (host, templates), a join a level, until none is left; a level costs a
few jobs, so time grows with the longest path.

Labels: a URL is labelled by the document it shows (the number that ends its
path), good if that is of quality 1 and not toxic; any table of (url, good)
does.

Defined results: a null URL, or one without "://", has an empty host and path,
no rule, and is allowed by the method as nothing is known of it; repeated rows
are judged alike; an empty table gives no row; without labels the method allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, written

#: Host, path prefix and verdict of each rule (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Weight, in labels, of the level above; a template below CUTOFF is rejected.
PRIOR, CUTOFF = 8.0, 0.5
#: Siblings merge while their two-proportion statistic stays below this.
SAME_Z = 2.58


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host length first, as text host + path) and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def template(segment: Column) -> Column:
    """The segment, or * where it looks variable: with a digit, or long."""
    return F.when(segment.isNull(), F.lit("")).when(segment.rlike("[0-9]") | (F.length(segment) > 24), F.lit("*")).otherwise(segment)


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path and all segments as templates."""
    out = pages.withColumn("host", host(F.col(url_col))).withColumn("path", path(F.col(url_col)))
    return out.withColumn("segments", F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), template))


def _key(segs: Column) -> Column:
    """The segments as one text, each after a slash; none of them has one."""
    return F.when(F.size(segs) == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(segs, "/")))


def _smoothed(good: Column, all_: Column, above: Column) -> Column:
    return (good + PRIOR * above) / (all_ + PRIOR)


def _merged(branches: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Branches with `to`: their name, or * where siblings together look the same or the branch is a wildcard already."""
    totals = branches.groupBy(*parent).agg(F.sum("good").alias("pg"), F.sum("n").alias("pn"))
    told = branches.join(totals, parent)
    rest_n, rest_g = F.col("pn") - F.col("n"), F.col("pg") - F.col("good")
    pooled = F.try_divide(F.col("pg"), F.col("pn"))
    spread = F.sqrt(F.greatest(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(F.lit(1.0), rest_n)), F.lit(0.0)))
    z = F.try_divide(F.abs(F.try_divide(F.col("good"), F.col("n")) - F.try_divide(rest_g, rest_n)), spread)
    return told.withColumn("to", F.when((rest_n > 0) & (F.coalesce(z, F.lit(0.0)) < SAME_Z), F.lit("*")).otherwise(F.col(name))).drop("pg", "pn")


def _summed(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))


def _level(rows: DataFrame, d: int) -> DataFrame:
    """rows (host, segs, good, n) with the d-th segment replaced by what its branch merges into, and summed."""
    at = rows.withColumn("up", F.slice("segs", 1, d - 1)).withColumn("name", F.get("segs", F.lit(d - 1)))
    told = _merged(_summed(at, "host", "up", "name"), ["host", "up"], "name").select("host", "up", "name", "to")
    segs = F.concat("up", F.array("to"), F.slice("segs", d + 1, 1 << 30))
    return _summed(at.join(told, ["host", "up", "name"]), "host", segs.alias("segs"))


def tree(labelled: DataFrame) -> DataFrame:
    """host, depth, up, name, key and purity for each template: key is up and name; a host has depth 0 and key "".

    labelled: host, segments (or s1, s2 and so on), good (0 or 1).
    """
    spark = labelled.sparkSession
    if "segments" not in labelled.columns:
        parts = sorted((c for c in labelled.columns if c[:1] == "s" and c[1:].isdigit()), key=lambda c: int(c[1:]))
        labelled = labelled.withColumn("segments", F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))
    leaves = labelled.where("good is not null and host <> ''").groupBy("host", F.concat("segments", F.array(F.lit(""))).alias("segs"))
    leaves = saved(leaves.agg(F.sum(F.col("good").cast("double")).alias("good"), F.count(F.lit(1)).cast("double").alias("n")), "url-leaves")
    deepest = leaves.agg(F.max(F.size("segs"))).first()[0] or 0
    rows = leaves.limit(0)
    for d in range(deepest, 0, -1):
        rows = saved(_level(rows.unionByName(leaves.where(F.size("segs") == d)), d), "url-leaves")
    each = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("segs"))))
    each = each.withColumn("up", _key(F.slice("segs", F.lit(1), F.col("depth") - 1))).withColumn("name", F.get("segs", F.col("depth") - 1))
    nodes = saved(_summed(each, "host", "depth", "up", "name"), "url-nodes")

    hosts = _summed(rows, "host")
    every = hosts.agg(F.coalesce(F.sum("good") / F.sum("n"), F.lit(1.0)).alias("share"))
    level = hosts.join(F.broadcast(every)).select("host", F.lit(0).alias("depth"), F.lit("").alias("up"), F.lit("").alias("name"), F.lit("").alias("key"), _smoothed(F.col("good"), F.col("n"), F.col("share")).alias("purity"), "n")
    paths = []
    for d in range(deepest + 1):
        if d:
            above = level.select("host", F.col("key").alias("up"), F.col("purity").alias("__p"), F.col("n").alias("__n"))
            below = nodes.where(F.col("depth") == d).join(above, ["host", "up"])
            purity = F.when(F.col("n") == F.col("__n"), F.col("__p")).otherwise(_smoothed(F.col("good"), F.col("n"), F.col("__p")))
            level = below.select("host", "depth", "up", "name", F.concat("up", F.lit("/"), "name").alias("key"), purity.alias("purity"), "n")
        level, path_ = written(level, "url-templates")
        paths.append(path_)
    return spark.read.schema(level.schema).parquet(*paths).drop("n")


def _walked(patterns: DataFrame, templates: DataFrame) -> DataFrame:
    """patterns (host, segs) of known hosts with the template where each ends, and its purity."""
    deepest = templates.agg(F.max("depth")).first()[0] or 0
    live = patterns.join(templates.where("depth = 0").select("host", "key", "purity"), "host").withColumns({"whole": F.lit(False), "done": F.lit(False)})
    paths = []
    for d in range(1, deepest + 1):
        level = templates.where(F.col("depth") == d)
        own = level.select("host", F.col("up").alias("key"), F.col("name").alias("seg"), F.col("key").alias("__k1"), F.col("purity").alias("__p1"))
        wild = level.where("name = '*'").select("host", F.col("up").alias("key"), F.col("key").alias("__k2"), F.col("purity").alias("__p2"))
        at = live.withColumn("seg", F.get("segs", F.lit(d - 1))).join(own, ["host", "key", "seg"], "left").join(wild, ["host", "key"], "left")
        to, last = F.coalesce("__k1", "__k2"), F.size("segs") <= d
        at = at.select("host", "segs", F.coalesce(to, "key").alias("key"), F.coalesce("__p1", "__p2", "purity").alias("purity"), (to.isNotNull() & last).alias("whole"), (to.isNull() | last | F.lit(d == deepest)).alias("done"))
        at, path_ = written(at, "url-walk")
        paths.append(path_)
        live = at.where("not done")
        if live.isEmpty():
            break
    ended = patterns.sparkSession.read.schema(live.schema).parquet(*paths).where("done") if paths else live
    full = F.when(F.col("whole"), F.col("key")).otherwise(F.concat("key", F.lit("/**")))
    return ended.select("host", _key(F.col("segs")).alias("__segs"), F.substring(full, 2, 1 << 30).alias("template"), "purity")


def judge(pages: DataFrame, templates: DataFrame, *, url_col: str = "url", rules=RULES, cutoff: float = CUTOFF) -> DataFrame:
    """pages with host, path, rule, template, purity and verdict; columns of these names are replaced."""
    pages = pages.drop("host", "path", "rule", "template", "purity", "verdict", "segments")
    at = parsed(pages, url_col)
    segs = F.concat("segments", F.array(F.lit("")))
    found = _walked(at.select("host", segs.alias("segs")).distinct(), templates)
    name, says = rule(F.col("host"), F.col("path"), rules)
    at = at.withColumn("__segs", _key(segs)).join(found, ["host", "__segs"], "left").withColumn("rule", name)
    method = F.when(F.coalesce("purity", F.lit(1.0)) < cutoff, F.lit("block")).otherwise(F.lit("allow"))
    return at.withColumn("verdict", F.coalesce(says, method)).drop("segments", "__segs")


def labelled_by_document(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """host, segments and good of URLs whose path ends in the number of a labelled document."""
    number = F.regexp_extract(path(F.col(url_col)), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    shown = parsed(pages.select(url_col), url_col).withColumn("doc_id", F.when(number != "", number).cast("long")).where("doc_id is not null")
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good"))
    return shown.join(good, "doc_id").select("host", "segments", "good")


def _oracle() -> str:
    """SQL that repeats the tree, its purities and the walk, by recursion over the levels."""
    rules = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    case = lambda of: "CASE " + " ".join(f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN '{of(d, p, v)}'" for d, p, v in rules) + " END"
    return rf"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
s AS (
  SELECT *, list_append(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 24 THEN '*' ELSE x END), '') AS segs,
         TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) AS doc_id
  FROM p),
g AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (
  SELECT host, segs, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS n FROM s JOIN g USING (doc_id) WHERE host <> '' AND good IS NOT NULL GROUP BY ALL),
m AS (
  SELECT (SELECT max(len(segs)) FROM l) AS d, host, segs, good, n FROM l
  UNION ALL
  SELECT d - 1, host, segs, sum(good), sum(n) FROM (
    SELECT d, host, good, n,
           CASE WHEN len(segs) >= d AND pn > bn AND coalesce(abs(bg / bn - (pg - bg) / (pn - bn)) / nullif(sqrt(greatest(pg / pn * (1 - pg / pn) * (1 / bn + 1 / (pn - bn)), 0)), 0), 0) < {SAME_Z}
                THEN list_concat(list_append(segs[1:d - 1], '*'), segs[d + 1:]) ELSE segs END AS segs
    FROM (
      SELECT *, sum(good) OVER b AS bg, sum(n) OVER b AS bn, sum(good) OVER u AS pg, sum(n) OVER u AS pn
      FROM m WHERE d > 0
      WINDOW b AS (PARTITION BY host, len(segs) < d, segs[1:d]), u AS (PARTITION BY host, len(segs) < d, segs[1:d - 1])))
  GROUP BY d, host, segs),
r AS (SELECT host, segs, good, n FROM m WHERE d = 0),
k AS (
  SELECT host, u.depth, segs[1:u.depth] AS pre, sum(good) AS good, sum(n) AS n FROM r, unnest(range(1, len(segs) + 1)) AS u(depth) GROUP BY ALL),
t AS (
  SELECT host, 0::BIGINT AS depth, []::VARCHAR[] AS pre, (sum(good) + {PRIOR} * (SELECT sum(good) / sum(n) FROM r)) / (sum(n) + {PRIOR}) AS purity, sum(n) AS n FROM r GROUP BY host
  UNION ALL
  SELECT k.host, k.depth, k.pre, CASE WHEN k.n = t.n THEN t.purity ELSE (k.good + {PRIOR} * t.purity) / (k.n + {PRIOR}) END, k.n
  FROM t JOIN k ON k.host = t.host AND k.depth = t.depth + 1 AND k.pre[1:k.depth - 1] = t.pre),
w AS (
  SELECT DISTINCT s.host, s.segs, 0::BIGINT AS depth, t.pre, t.purity FROM s JOIN t ON t.host = s.host AND t.depth = 0
  UNION ALL
  SELECT w.host, w.segs, w.depth + 1, coalesce(a.pre, b.pre), coalesce(a.purity, b.purity)
  FROM w LEFT JOIN t a ON a.host = w.host AND a.depth = w.depth + 1 AND a.pre = list_append(w.pre, w.segs[w.depth + 1])
         LEFT JOIN t b ON b.host = w.host AND b.depth = w.depth + 1 AND b.pre = list_append(w.pre, '*')
  WHERE w.depth < len(w.segs) AND (a.pre IS NOT NULL OR b.pre IS NOT NULL)),
e AS (SELECT host, segs, arg_max(purity, depth) AS purity FROM w GROUP BY ALL)
SELECT page_id, s.host, path, {case(lambda d, p, v: d + p).replace("host", "s.host")} AS rule,
       coalesce({case(lambda d, p, v: v).replace("host", "s.host")}, CASE WHEN coalesce(purity, 1) < {CUTOFF} THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN e ON e.host = s.host AND e.segs = s.segs
"""


ORACLE = _oracle()
