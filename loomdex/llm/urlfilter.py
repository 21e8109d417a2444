"""URL filters by a dated list: what was in force when a page was fetched.

List entries (pattern, effective, action) say that from a day on a pattern is blocked or allowed. Each becomes a validity
interval that ends where the pattern's next entry begins. A pattern is a host, a parent domain or a host with leading
path segments. A capture (url, day) meets, by an as-of join, the intervals of every pattern that its URL falls under and
that hold its day; the longest pattern decides.

Hosts are compared in lower case, path segments as they are. Of entries for one pattern and day "block" wins. Null patterns, days and actions are ignored, repeated entries and captures
change nothing. A null URL or day, or one that falls under nothing, is not blocked and has no entry. Intervals are dealt out
by pattern and month, of the months that captures have only, so a capture meets only the few intervals of its own month.
Verdicts are found once per distinct (url, day). Other columns are carried along by verdicts(), whatever their names; columns
of captures that are named as the results are give way to them. Helper columns have names that start with ``__url_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL; "" if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def patterns(url: Column) -> Column:
    """Everything a URL falls under: its host, the host's parent domains of two labels or more, and the host with each leading run of path segments."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    deeper = F.transform(steps, lambda s, i: F.concat(h, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i + 1), "/")))
    return F.when(h == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, deeper)))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until): until is exclusive, null if nothing follows."""
    name = F.substring_index("pattern", "/", 1)
    e = entries.select(F.concat(F.lower(name), F.substring(F.col("pattern"), F.length(name) + 1, F.length("pattern"))).alias("pattern"), F.to_date("effective").alias("since"), F.lower("action").alias("action")).where("pattern is not null and since is not null and action in ('block', 'allow')")
    e = e.groupBy("pattern", "since").agg(F.max("action").alias("action"))
    return e.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since")))


RESULTS = ("blocked", "entry", "entry_since")


def verdicts(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """captures with blocked, entry and entry_since."""
    given = captures.select(*[c for c in captures.columns if c not in RESULTS or c in (url_col, day_col)])
    url, day = F.col(url_col), F.to_date(F.col(day_col))
    # one row, from a single column
    first, last = given.agg(F.min(day), F.max(day)).first()
    if last is None:
        return given.withColumns({"blocked": F.lit(False), "entry": F.lit(None).cast("string"), "entry_since": F.lit(None).cast("date")})
    asked = given.select(url.alias("__url_u"), day.alias("__url_d")).where("__url_u is not null and __url_d is not null").distinct()
    i = intervals(entries).where((F.col("since") <= F.lit(last)) & (F.col("until").isNull() | (F.col("until") > F.lit(first))))
    begin, stop = F.greatest("since", F.lit(first)), F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    i = i.withColumn("m", F.explode(F.sequence(month(begin), month(stop))))
    under = asked.select("__url_u", "__url_d", month(F.col("__url_d")).alias("m"), F.explode(patterns(F.col("__url_u"))).alias("pattern"))
    met = under.join(i, ["pattern", "m"]).where((F.col("since") <= F.col("__url_d")) & (F.col("until").isNull() | (F.col("__url_d") < F.col("until"))))
    best = met.groupBy("__url_u", "__url_d").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "since")).alias("__url_best"))
    joined = given.join(best, (url == F.col("__url_u")) & (day == F.col("__url_d")), "left")
    best = F.col("__url_best")
    found = {"blocked": F.coalesce(best["action"] == BLOCK, F.lit(False)), "entry": best["pattern"], "entry_since": best["since"]}
    return joined.withColumns(found).select(*given.columns, *RESULTS)


def dated_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with a day of 2024 that depends on page_id: the table has no fetch times."""
    return pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("day"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts, domains and paths of pages, by a rule: the table has none. Of each host whose first page_id
    is divisible by 3 the host is blocked from a day that depends on it and, if the id is even, allowed again 60 days later; each domain
    (the last two labels) is blocked for 30 days; each host with a first path segment whose first page_id is divisible by 5 is
    blocked, allowed 40 days later and blocked again after 40 more."""
    h, first = host(F.col("url")), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    hosts = pages.select("page_id", h.alias("h")).where("h != ''").groupBy("h").agg(F.min("page_id").alias("k"))
    domains = hosts.groupBy(F.substring_index("h", ".", -2).alias("h")).agg(F.min("k").alias("k"))
    paths = pages.where((h != "") & (first != "")).groupBy(F.concat_ws("/", h, first).alias("h")).agg(F.min("page_id").alias("k")).where("k % 5 = 0")
    day = lambda e: F.expr(f"date_add(date'2024-01-01', cast({e} as int))")
    a = hosts.where("k % 3 = 0").select(F.col("h").alias("pattern"), day("pmod(k * 11, 180)").alias("effective"), F.lit(BLOCK).alias("action"))
    b = hosts.where("k % 6 = 0").select("h", day("pmod(k * 11, 180) + 60"), F.lit(ALLOW))
    c = domains.select("h", day("pmod(k * 7, 300)"), F.lit(BLOCK))
    d = domains.select("h", day("pmod(k * 7, 300) + 30"), F.lit(ALLOW))
    e = [paths.select("h", day(f"pmod(k * 13, 200) + {40 * n}"), F.lit(ALLOW if n == 1 else BLOCK)) for n in range(3)]
    return a.union(b).union(c).union(d).union(e[0]).union(e[1]).union(e[2])


SQL = """
with p as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as h,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) as f,
           date '2024-01-01' + cast((page_id * 37) % 366 as integer) as day from pages),
hs as (select h, min(page_id) as k from p where h <> '' group by h),
ds as (select list_extract(string_split(h, '.'), -2) || '.' || list_extract(string_split(h, '.'), -1) as h, min(k) as k from hs group by 1),
fs as (select h || '/' || f as h, min(page_id) as k from p where h <> '' and f <> '' group by 1 having min(page_id) % 5 = 0),
e as (select h, date '2024-01-01' + cast((k * 11) % 180 as integer) as since, 'block' as action from hs where k % 3 = 0
      union all select h, date '2024-01-01' + cast((k * 11) % 180 + 60 as integer), 'allow' from hs where k % 6 = 0
      union all select h, date '2024-01-01' + cast((k * 7) % 300 as integer), 'block' from ds
      union all select h, date '2024-01-01' + cast((k * 7) % 300 + 30 as integer), 'allow' from ds
      union all select h, date '2024-01-01' + cast((k * 13) % 200 as integer), 'block' from fs
      union all select h, date '2024-01-01' + cast((k * 13) % 200 + 40 as integer), 'allow' from fs
      union all select h, date '2024-01-01' + cast((k * 13) % 200 + 80 as integer), 'block' from fs),
g as (select h, since, max(action) as action from e group by h, since),
i as (select *, lead(since) over (partition by h order by since) as until from g),
m as (select p.page_id, i.h as entry, i.action, i.since, row_number() over (partition by p.page_id order by length(i.h) desc) as r
      from p join i on (p.h = i.h or ends_with(p.h, '.' || i.h) or p.f <> '' and p.h || '/' || p.f = i.h) and p.day >= i.since and (i.until is null or p.day < i.until))
select p.page_id as page_id, p.h as host, cast(p.day as varchar) as day, coalesce(m.action = 'block', false) as blocked, m.entry as entry, cast(m.since as varchar) as entry_since
from p left join m on p.page_id = m.page_id and m.r = 1
"""
