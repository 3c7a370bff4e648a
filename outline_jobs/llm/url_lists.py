"""URL filter lists whose entries come and go, joined to captures as of the time of each fetch.

Input. `captures` has a url and a fetch time; `changes` has one row per dated change of a list:
list_name, host, at, action ('add' or 'remove'). Extra columns of captures are kept.

Defined cases. A null url or one without a host matches nothing. A change with a null field is ignored.
Of several changes of one (list, host) at one moment, 'remove' wins. A second 'add' while the entry is
active, or a 'remove' while it is not, changes nothing. A fetch at the moment of 'add' is covered, at the
moment of 'remove' it is not. Rows equal in key, fetch time and host get one answer; captures that share a key but differ in host are told apart.
Without entries or captures nothing is blocked. Entries cover their host and all its subdomains. A null fetch time matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outline_jobs.llm.common import apart, packed, table, unpacked

SALT = 8
RESULTS = ("blocked", "list_name", "entry", "since", "until")


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL without user, port and final dot; '' if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?$|\.(:[0-9]*)?$", ""))


def domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(F.coalesce(host, F.lit("")), r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))


def intervals(changes: DataFrame) -> DataFrame:
    """Dated changes -> list_name, host, since, until (exclusive; null: still active)."""
    own = Window.partitionBy("list_name", "host").orderBy("at")
    return (
        changes.where("list_name is not null and host is not null and at is not null and action in ('add', 'remove')")
        .groupBy("list_name", F.lower("host").alias("host"), "at")
        .agg(F.min(F.col("action") == "add").alias("active"))
        .withColumn("before", F.coalesce(F.lag("active").over(own), F.lit(False)))
        .where(F.col("active") != F.col("before"))
        .withColumn("until", F.lead("at").over(own))
        .where("active")
        .select("list_name", "host", F.col("at").alias("since"), "until")
    )


def join_as_of(captures: DataFrame, active: DataFrame, url: str = "url", fetched: str = "fetched_at", key: str = "page_id") -> DataFrame:
    """Every capture once, with the entry that blocked it: blocked, list_name, entry, since, until; own columns of these names are called own_....

    Of several, the longest entry wins, then the first list by name. The join is on the exact domain. Domains shorter than any entry, such as com, are
    left out before it, and captures of one domain are dealt over SALT keys, so that a hot host isn't one key; per (list, domain)
    at most one interval holds a moment, so no capture meets more rows than it has domains times lists.
    """
    names = apart(captures, RESULTS)[1]
    rows = captures.select(packed(captures), F.col(key).alias("_k"), F.col(fetched).alias("_t"), host_of(F.col(url)).alias("_h"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    e = active.select("list_name", F.col("host").alias("entry"), "since", "until", salts)
    least = active.agg(F.min(F.size(F.split("host", r"\.")))).first()[0]
    long = F.filter(domains(host_of(F.col(url))), lambda d: F.size(F.split(d, r"\.")) >= F.lit(least or 1))
    asked = captures.select(F.col(key).alias("_key"), F.col(fetched).alias("_at"), host_of(F.col(url)).alias("_host"), F.explode(long).alias("_domain")).where("_domain <> ''")
    asked = asked.withColumn("_own", F.pmod(F.xxhash64("_key", "_at"), F.lit(SALT)).cast("int"))
    hit = asked.join(e, (F.col("_domain") == F.col("entry")) & (F.col("_own") == F.col("_salt")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until"))))
    best = hit.groupBy("_key", "_at", "_host").agg(F.min(F.struct((-F.length("entry")).alias("n"), "list_name", "entry", "since", "until")).alias("_best"))
    same = F.col("_k").eqNullSafe(F.col("_key")) & F.col("_t").eqNullSafe(F.col("_at")) & F.col("_h").eqNullSafe(F.col("_host"))
    out = rows.join(best, same, "left")
    return out.select(
        *unpacked(captures.columns, names),
        F.col("_best").isNotNull().alias("blocked"),
        *[F.col(f"_best.{c}").alias(c) for c in ("list_name", "entry", "since", "until")],
    )


# The query: captures and list changes are derived from the pages table by rule.

#: Days after 2024-01-01 on which a derived list of a host changes, and how.
_CHANGES = """
    SELECT 'ads' AS list_name, host, day AS first, 'add' AS action FROM h WHERE k % 3 = 0
    UNION ALL SELECT 'ads', host, day + 90, 'remove' FROM h WHERE k % 3 = 0
    UNION ALL SELECT 'ads', host, day + 180, 'add' FROM h WHERE k % 6 = 0
    UNION ALL SELECT 'malware', host, day + 30, 'add' FROM h WHERE k % 5 = 1
    UNION ALL SELECT 'malware', host, day + 200, 'remove' FROM h WHERE k % 10 = 1
    UNION ALL SELECT 'malware', host, day + 200, 'add' FROM h WHERE k % 20 = 1
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time derived from its number, against lists derived from the hosts of all pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestamp_seconds(1704067200 + pmod(page_id * 7919, 17520) * 3600)"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.unionByName(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host")).where("host <> ''")).distinct()
    keyed = hosts.withColumn("k", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")).withColumn("day", F.col("k") % 400)
    changes = spark.sql(_CHANGES.replace("FROM h", "FROM {h}"), h=keyed).withColumn("at", F.expr("timestamp_seconds(1704067200 + first * 86400)"))
    return join_as_of(captures, intervals(changes)).select(
        "page_id", "url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"), "blocked", "list_name", "entry",
        *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("since", "until")],
    )


ORACLE = rf"""
WITH p AS (SELECT page_id, url, 1704067200 + ((page_id * 7919) % 17520) * 3600 AS at_s,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '(:[0-9]*)?$|\.(:[0-9]*)?$', '')) AS host FROM pages),
h0 AS (SELECT DISTINCT host FROM p WHERE host <> ''),
h1 AS (SELECT host FROM h0 UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM h0),
h2 AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS k FROM h1 WHERE host <> ''),
h AS (SELECT *, k % 400 AS day FROM h2),
c AS ({_CHANGES}),
c1 AS (SELECT list_name, host, first, min(action = 'add') AS active FROM c GROUP BY ALL),
c2 AS (SELECT *, coalesce(lag(active) OVER w, false) AS before FROM c1 WINDOW w AS (PARTITION BY list_name, host ORDER BY first)),
c3 AS (SELECT *, lead(first) OVER (PARTITION BY list_name, host ORDER BY first) AS until_d FROM c2 WHERE active <> before),
c4 AS (SELECT list_name, host AS entry, first AS since_d, until_d FROM c3 WHERE active),
m AS (SELECT page_id, list_name, entry, since_d, until_d, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, list_name) AS n
    FROM p JOIN c4 ON (p.host = entry OR p.host LIKE '%.' || entry) AND at_s >= 1704067200 + since_d * 86400 AND (until_d IS NULL OR at_s < 1704067200 + until_d * 86400))
SELECT p.page_id, p.url, strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched_at, m.entry IS NOT NULL AS blocked, list_name, entry,
    strftime(make_timestamp((1704067200 + since_d * 86400) * 1000000), '%Y-%m-%d') AS since,
    strftime(make_timestamp((1704067200 + until_d * 86400) * 1000000), '%Y-%m-%d') AS until
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.n = 1
"""
