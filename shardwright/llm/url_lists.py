"""Temporal URL lists: dated list entries, judged as of the day of each fetch.

A list changes by dated entries (``add`` or ``remove`` of a key). Entries become
validity intervals; a capture is judged by the intervals that hold on the day it
was fetched. A key is a site (host without ``www.``, ``m.``, ``blog.``), one of its
parent domains, or a site with the first folder of the path; the longest active
key decides, ``allow`` lists before block lists at equal keys.

Plan: intervals are cut at fixed spans of days, so the as-of condition becomes an
equality on (key, span) and a key with a long history never meets all of its
captures at once. Only spans between the first and the last fetch are made. A (key, span) with
more than ``salt_rows`` captures, counted first, is dealt over as many sub-keys as that asks for
on both sides of the join; any other keeps one. The table of hot ones is broadcast: a hot one
holds more than 1 / ``MOST_HOT`` of all captures' keys, so there are fewer than ``MOST_HOT``, two numbers each.

Defined cases: null or unparsable URLs and null days match nothing (``blocked``
false); entries with a null key, day or action are ignored; several entries of a
key on one day count once, ``remove`` last; repeated captures each keep their row;
empty tables give empty or unmatched results; other columns of the captures are
kept unless they carry the name of a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS, SALT_ROWS, MOST_HOT = 32, 1 << 16, 1 << 16
RESULT = ("blocked", "list_name", "list_key", "active_since", "n_active")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/"


def site(url):
    """Lower-case host without a leading www., m. or blog.; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"^(www|m|blog)\.", "")


def keys(url):
    """Every list key a URL falls under: site/folder, the site, its parent domains."""
    s, folder = site(url), F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    labels = F.split(s, r"\.")
    n = F.size(labels)
    parents = F.when(n > 2, F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: F.array_join(
        F.slice(labels, i, n), "."))).otherwise(F.array().cast("array<string>"))
    own = F.when(folder != "", F.array(F.concat_ws("/", s, folder), s)).otherwise(F.array(s))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(own, parents)))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list_name, key, allow, valid_from, valid_to)``: half open, null end = still valid."""
    e = (entries.where(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isNotNull())
         .groupBy("list_name", "key", "allow", "day").agg(F.max("action").alias("action")))     # 'remove' > 'add'
    w = Window.partitionBy("list_name", "key", "allow").orderBy("day")
    return (e.withColumn("valid_to", F.lead("day").over(w)).where(F.col("action") == "add")
            .select("list_name", "key", "allow", F.col("day").alias("valid_from"), "valid_to"))


def temporal_join(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_date",
                  capture: str = "page_id", span_days: int = SPAN_DAYS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The captures with ``blocked``, the deciding ``list_name`` and ``list_key``, since
    when that entry held (``active_since``) and how many entries were active."""
    base = captures.drop(*RESULT)
    first, last, n_keys = base.agg(F.min(day), F.max(day), F.sum(F.size(keys(F.col(url))))).first()
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / F.lit(span_days)).cast("int")
    narrow = base.select(F.col(capture).alias("_id"), F.col(url).alias("_url"), F.col(day).alias("_day")).distinct()
    probes = (narrow.where(F.col("_day").isNotNull())
              .select("_id", "_url", "_day", F.explode(keys(F.col("_url"))).alias("key"), number(F.col("_day")).alias("_span"))
              .withColumn("_hash", F.xxhash64("key")))
    limit = max(salt_rows, (n_keys or 0) // MOST_HOT)
    hot = F.broadcast(probes.groupBy("_hash", "_span").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
                      .select("_hash", "_span", F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    probes = (probes.join(hot, ["_hash", "_span"], "left")
              .withColumn("_salt", F.pmod(F.xxhash64("_id", "_url"), salts).cast("int")).drop("_hash", "_salts"))
    # intervals within the days of the captures; open ones end with the last fetch
    begin = F.greatest("valid_from", F.lit(first).cast("date"))
    end = F.least(F.date_sub("valid_to", 1), F.lit(last).cast("date"))
    spans = (intervals(entries).where(end >= begin)
             .withColumn("_span", F.explode(F.sequence(number(begin), number(end)))).withColumn("_hash", F.xxhash64("key"))
             .join(hot, ["_hash", "_span"], "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hash", "_salts"))
    hits = (probes.join(spans, ["key", "_span", "_salt"])
            .where((F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))))
    verdict = hits.groupBy("_id", "_url", "_day").agg(
        F.max(F.struct(F.length("key").alias("l"), F.col("allow").cast("int").alias("a"), F.col("key"), F.col("list_name"),
                       F.col("valid_from"))).alias("_m"), F.count(F.lit(1)).alias("n_active"))
    joined = base.join(verdict, base[capture].eqNullSafe(F.col("_id")) & base[url].eqNullSafe(F.col("_url"))
                       & (base[day] == F.col("_day")), "left")
    return joined.select(*base.columns, F.coalesce(F.col("_m.a") == 0, F.lit(False)).alias("blocked"),
                         F.col("_m.list_name").alias("list_name"), F.col("_m.key").alias("list_key"),
                         F.col("_m.valid_from").alias("active_since"),
                         F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


# ------------------------------------------------- captures and lists of the given pages
EPOCH = "2023-01-01"


def _number(seed: str, c):
    """Sixteen bits of md5(seed || value): the same number in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 4), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` carries no fetch time; each page gets a day of 2023 from its id."""
    return pages.withColumn("fetch_date", F.date_add(F.lit(EPOCH).cast("date"), _number("fetch", F.col("page_id")) % 365))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated lists over the sites of ``pages``: about a third of the sites (and all
    ``adult`` ones) are listed, taken off again and listed once more; one folder in
    four is on the allow list for half a year; one parent domain is blocked for a month."""
    sites = pages.select(site(F.col("url")).alias("key")).where("key <> ''").distinct()
    at = lambda n: F.date_add(F.lit(EPOCH).cast("date"), n)
    h = _number("site", F.col("key"))
    listed = sites.withColumn("h", h).where((F.col("h") % 3 == 0) | F.col("key").startswith("adult"))
    name = (F.when(F.col("key").startswith("adult"), "adult").when(F.col("h") % 2 == 0, "spam").otherwise("malware"))
    steps = F.array(*(F.struct(at(n).alias("day"), F.lit(a).alias("action")) for n, a in (
        (F.col("h") % 120, "add"), (F.col("h") % 120 + 60, "remove"), (F.col("h") % 120 + 150, "add"))))
    block = listed.select(name.alias("list_name"), "key", F.lit(False).alias("allow"), F.inline(steps))
    folders = (pages.select(F.get(F.filter(keys(F.col("url")), lambda k: F.contains(k, F.lit("/"))), F.lit(0)).alias("key"))
               .where("key is not null").distinct().withColumn("h", _number("folder", F.col("key"))).where("h % 4 = 0"))
    allow = folders.select(F.lit("reviewed").alias("list_name"), "key", F.lit(True).alias("allow"), F.inline(F.array(
        *(F.struct(at(n).alias("day"), F.lit(a).alias("action")) for n, a in (
            (F.col("h") % 180, "add"), (F.col("h") % 180 + 180, "remove"))))))
    domains = (sites.select(F.substring_index("key", ".", -2).alias("key")).distinct().where("key = 'example.org'"))
    parent = domains.select(F.lit("outage").alias("list_name"), "key", F.lit(False).alias("allow"), F.inline(F.array(
        F.struct(at(F.lit(200)).alias("day"), F.lit("add").alias("action")),
        F.struct(at(F.lit(230)).alias("day"), F.lit("remove").alias("action")))))
    return block.unionByName(allow).unionByName(parent)
