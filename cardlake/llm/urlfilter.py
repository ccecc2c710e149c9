"""URL filter by a sort-merge range join, DataFrame functions only.

The canonical key of a host is its labels in reverse order, each followed by a dot, and a
rule is the interval of all keys that begin with its own: host key, then path.  Intervals
are nested or apart.  A url probes once with each of its host's suffixes that some rule
names, so every fitting rule is a plain prefix of one of its probes.

Probes and rules are sorted together; the sweep carries the last rule that began, together
with its stack, the rules around it.  All rules active at a probe are on that stack, and
those that have ended are the ones which are no prefix of the probe.  Intervals never
leave their host's zone, so the sweep runs zone by zone; a zone with many probes is split
into several sweeps over the same few rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: probes of a zone that share one sweep
SWEEP = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def zone(host: Column) -> Column:
    """Reversed labels, each followed by a dot: ``a.org`` becomes ``org.a.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(zone, path, labels, stack) of each distinct (host, path): the stack holds the rule
    and all rules whose interval encloses it, longest first."""
    own = (rules.where("host is not null and host <> '' and path is not null and verdict is not null")
           .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
           .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
           .select(zone(F.col("host")).alias("zone"), "path", F.size(F.split("host", r"\.", -1)).alias("labels"),
                   F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
                            F.concat("host", "path").alias("rule"), "verdict", "path").alias("r")))
    prefixes = own.select("zone", "path", "labels", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k"))
    prefixes = prefixes.select("zone", "path", "labels", F.substring("path", F.lit(1), F.col("k")).alias("prefix"))
    around = own.select("zone", F.col("path").alias("prefix"), "r")
    return prefixes.join(around, ["zone", "prefix"]).groupBy("zone", "path", "labels").agg(
        F.sort_array(F.collect_list("r"), asc=False).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: the id, ``host``, ``path``, ``rule`` (host and path of
    the winning rule, else null) and ``verdict`` (the rule's, else ``default``).

    ``rules`` has columns host, path and verdict.  A rule fits its host and all subdomains
    if the url's path starts with the rule's.  The longest rule (host and path together)
    wins, of equally long ones that with the longer host; of a repeated rule the larger
    verdict (block before allow).  Rules with a null column or an empty host fit nothing.
    A null url and one without ``://`` have an empty host and path, which no rule fits.
    Null and repeated ids and rows keep a row each; other columns are ignored; an empty
    table gives no rows."""
    parsed = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    stacks = rule_stacks(rules)
    zones = stacks.groupBy("zone").agg(F.max("labels").alias("labels"))
    # suffixes longer than any rule's host can match none; the number of labels of one row
    deepest = zones.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]

    def probes(urls: DataFrame) -> DataFrame:
        labels = F.reverse(F.split("host", r"\.", -1))
        depth = F.least(F.size("labels"), F.lit(deepest))
        suffix = F.transform(F.sequence(F.lit(1), F.col("depth")),
                             lambda k: F.concat(F.array_join(F.slice("labels", F.lit(1), k), "."), F.lit(".")))
        return (urls.where("host <> ''").withColumn("labels", labels).withColumn("depth", depth).where("depth > 0")
                .select("host", "path", F.explode(suffix).alias("zone")))

    sweeps = (probes(parsed.select("host", "path")).join(zones.select("zone"), "zone").groupBy("zone").count()
              .select("zone", F.ceil(F.col("count") / SWEEP).cast("int").alias("sweeps")))
    urls = parsed.select("host", "path").distinct()
    asked = probes(urls).join(sweeps, "zone").select(
        "zone", F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("sweep"), "path", "host",
        F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    begun = stacks.join(sweeps, "zone").select(
        "zone", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("sweep"), "path",
        F.lit(None).cast("string").alias("host"), "stack")
    order = Window.partitionBy("zone", "sweep").orderBy("path", F.col("host").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = asked.unionAll(begun).withColumn("open", F.last("stack", ignorenulls=True).over(order))
    active = F.filter("open", lambda r: F.startswith(F.col("path"), r["path"]))
    won = (swept.where("host is not null").select("host", "path", F.try_element_at(active, F.lit(1)).alias("r"))
           .where("r is not null").groupBy("host", "path").agg(F.max("r").alias("r")))
    return parsed.join(won, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
