"""URL filters: dated list entries joined as of each capture's fetch time, on Spark SQL functions alone.

A list is a log of entries: on a day, a pattern is added to a list or removed
from it. Per list and pattern the entries become validity intervals, from an
addition up to the next removal. A capture looks up every pattern that can cover
its URL (the URL without query, its host and each prefix of its path's segments, the
host, each parent domain) and meets the intervals that hold on its day.

The join is on the pattern. A host with a third of all captures is hot: its
captures are dealt to many tasks and its few intervals repeated for each. What a
capture met is reduced to one row before it is joined back.

A capture is blocked if a blocking list covers it and no list of `allow` does.

Defined cases: a null URL, or one without a host, matches nothing and is not
blocked; a null day matches nothing; an addition while a pattern is on a list, and
a removal while it is not, change nothing; of entries of one day the removal
comes last; entries with a null pattern or day are ignored; slashes that end a path
or URL entry do not count; repeated captures are
kept; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from idiomark.llm.common import A_Z, kept, read, salted_join

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
ALLOW = ("allow",)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from (list, pattern, added, day); until is null while an entry still holds."""
    e = entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("added").isNotNull())
    own = Window.partitionBy("list", "pattern").orderBy("day", F.desc("added"))
    changes = e.withColumn("_was", F.coalesce(F.lag("added").over(own), F.lit(False))).filter(F.col("_was") != F.col("added"))
    return changes.withColumn("until", F.lead("day").over(own)).filter("added").select("list", "pattern", F.col("day").alias("since"), "until")


def host_of(url):
    return F.regexp_replace(F.translate(F.regexp_extract(url, HOST, 1), *A_Z), r"\.+$", "")


def path_of(url):
    return F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")


def patterns(url):
    """Every pattern that can cover a URL; none without a host."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.split(path, "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(segments)), lambda i: F.element_at(segments, i) != "")
    own = F.array(F.concat(F.lit("host:"), host), F.concat(F.lit("url:"), host, path))
    sections = F.transform(ends, lambda i: F.concat(F.lit("path:"), host, F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host != "", F.concat(own, sections, parents)).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Captures (id, URL, day) with lists (sorted, comma-joined), n_active, active_since (the latest start) and blocked."""
    c = kept(captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).alias("day")))
    keys = c.distinct().withColumn("_pattern", F.explode(patterns(F.col("url"))))
    bare = F.when(F.col("pattern").rlike("^(path|url):"), F.regexp_replace("pattern", "/+$", "")).otherwise(F.col("pattern"))
    valid = intervals(entries.withColumn("pattern", bare)).withColumnRenamed("pattern", "_entry")
    met = salted_join(keys, "_pattern", valid, "_entry", "inner").filter((F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    found = met.groupBy("page_id", "url", "day").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.countDistinct("list", "_entry").alias("n_active"),
        F.max("since").alias("active_since"),
        (F.bool_or(~F.col("list").isin(*allow)) & ~F.bool_or(F.col("list").isin(*allow))).alias("blocked"),
    )
    names = ("page_id", "url", "day")
    f = found.select(*[F.col(n).alias("_" + n) for n in names], "lists", "n_active", "active_since", "blocked")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col("_" + n))
    return c.join(f, same, "left").select(*names, F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "active_since", F.coalesce("blocked", F.lit(False)).alias("blocked"))


# Fixed values of the query's list: parts of the log that are made for each host, section, domain and URL of the captures, as
# (list, kind of pattern, least and largest draw, [(added, first day, days per draw)]). Days count from 2021-01-01; the
# draw is md5 of the pattern, modulo 100.
LOG = (
    ("spam", "host", 0, 39, ((True, 0, 7), (False, 300, 7), (True, 700, 7))),
    ("adult", "path", 40, 54, ((True, 100, 9), (True, 200, 9))),
    ("geo", "domain", 55, 69, ((True, 400, 1), (False, 500, 1))),
    ("allow", "host", 30, 49, ((True, 500, 5), (False, 1000, 5))),
    ("scam", "url", 70, 84, ((True, 50, 8), (False, 900, 3))),
)


def draw(pattern):
    return F.conv(F.substring(F.md5(pattern), 1, 6), 16, 10).cast("long") % 100


def log_of(captures: DataFrame) -> DataFrame:
    """The entries that LOG makes for what the captures hold: (list, pattern, added, day)."""
    seen = captures.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct().withColumn("_d", draw(F.col("pattern")))
    made = []
    for name, kind, low, high, steps in LOG:
        own = F.col("pattern").startswith(kind + ":") & F.col("_d").between(low, high)
        day = lambda first, per: F.date_add(F.lit("2021-01-01").cast("date"), (F.lit(first) + F.col("_d") * per).cast("int"))
        made += [F.when(own, F.struct(F.lit(name).alias("list"), F.lit(added).alias("added"), day(first, per).alias("day"))) for added, first, per in steps]
    return seen.select("pattern", F.explode(F.array_compact(F.array(*made))).alias("e")).select("e.list", "pattern", "e.added", "e.day")


def query(spark, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2021-01-01").cast("date"), (F.pmod(F.col("page_id") * 37, F.lit(1461))).cast("int"))
    captures = kept(read(spark, sf_dir, "pages").select("page_id", "url", day.alias("day")))
    return evaluate(captures, log_of(captures))


def _sql() -> str:
    logs = " UNION ALL ".join(f"SELECT '{name}' AS list, pattern, {str(added).lower()} AS added, (DATE '2021-01-01' + ({first} + d * {per})::INT) AS day FROM seen WHERE starts_with(pattern, '{kind}:') AND d BETWEEN {low} AND {high}" for name, kind, low, high, steps in LOG for added, first, per in steps)
    allow = ", ".join(f"'{a}'" for a in ALLOW)
    return rf"""
WITH c AS (SELECT page_id, url, (DATE '2021-01-01' + ((page_id * 37) % 1461)::INT) AS day,
    regexp_replace(translate(regexp_extract(url, '{HOST}', 1), '{A_Z[0]}', '{A_Z[1]}'), '\.+$', '') AS host,
    regexp_replace(regexp_extract(url, '{PATH}', 1), '/+$', '') AS path FROM pages),
k AS (
  SELECT page_id, url, day, 'host:' || host AS pattern FROM c WHERE host <> ''
  UNION SELECT page_id, url, day, 'url:' || host || path FROM c WHERE host <> ''
  UNION SELECT page_id, url, day, 'path:' || host || array_to_string(s[1:i], '/') FROM (SELECT *, string_split(path, '/') AS s, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM c WHERE host <> '') WHERE s[i] <> ''
  UNION SELECT page_id, url, day, 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM c WHERE host <> '')),
seen AS (SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT % 100 AS d FROM k),
log AS ({logs}),
ch AS (SELECT * FROM (SELECT *, coalesce(lag(added) OVER (PARTITION BY list, pattern ORDER BY day, added DESC), false) AS was FROM log) WHERE was <> added),
iv AS (SELECT * FROM (SELECT list, pattern, added, day AS since, lead(day) OVER (PARTITION BY list, pattern ORDER BY day, added DESC) AS until FROM ch) WHERE added),
m AS (SELECT page_id, url, day, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, count(DISTINCT list || ' ' || iv.pattern) AS n_active, max(since) AS active_since,
    bool_or(list NOT IN ({allow})) AND NOT bool_or(list IN ({allow})) AS blocked
  FROM k JOIN iv ON iv.pattern = k.pattern AND day >= since AND (until IS NULL OR day < until) GROUP BY page_id, url, day)
SELECT c.page_id, c.url, c.day, coalesce(lists, '') AS lists, coalesce(n_active, 0)::BIGINT AS n_active, active_since, coalesce(blocked, false) AS blocked
FROM c LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM c.page_id AND m.url IS NOT DISTINCT FROM c.url AND m.day IS NOT DISTINCT FROM c.day"""


SQL = _sql()
