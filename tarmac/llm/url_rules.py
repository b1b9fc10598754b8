"""Operator 3: allow and block urls by host and path rules, with a sorted sweep over nested prefix intervals.

A host is turned into a key that begins with its last label ("www.example.com" gives "com/example/www/"), so that a
rule's subdomains are the keys that begin with the rule's key: an interval of the sorted keys. Two such intervals lie
apart or one in the other. Urls and rules are sorted together; at each rule the stack of rules it lies in is known, and
at a url the active rules are those on the stack of the last rule before it whose key still is a prefix of the url's.

The sweep runs once over host keys, which gives the ruled hosts a url lies under, and once over the paths of each of
these hosts. The longest rule that fits decides.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.plans.running import PART
from tarmac.sources.work import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty for null or without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def host_key(host: Column) -> Column:
    """The labels of a host from the last to the first, each followed by a slash, which no host contains."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))
    )


def _label_prefixes(key: Column) -> Column:
    """The key cut behind each label."""
    labels = F.split(key, "/")
    # The last part is empty: the key ends with a slash.
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "/"), F.lit("/")),
    )


def _char_prefixes(key: Column) -> Column:
    """The key cut behind the host's mark and behind each character of the path."""
    at = F.instr(key, "?")
    return F.transform(F.sequence(at, F.length(key)), lambda n: F.substring(key, F.lit(1), n))


def sweep(points: DataFrame, prefixes: DataFrame, cuts) -> DataFrame:
    """``points`` (row, key, ...) with ``active``: those of ``prefixes`` (key) that the point's key begins with.

    ``cuts`` gives the prefixes of a key that could be rules; a rule's own stack and the stack with which a range of
    keys begins are found by joining them. Points and rules are dealt by range of the key and the row, so that a key
    with many rows spreads over several ranges.
    """
    rules = prefixes.select("key").distinct()

    def stacks(of: DataFrame, name: str) -> DataFrame:
        cut = of.select(name, F.explode(cuts(F.col("key"))).alias("cut"))
        found = cut.join(rules.select(F.col("key").alias("cut")), "cut")
        return found.groupBy(name).agg(F.array_sort(F.collect_set("cut")).alias("stack"))

    own = stacks(rules.withColumn("rule", F.col("key")), "rule").withColumnRenamed("rule", "key")
    both = points.withColumn("stack", F.lit(None).cast("array<string>")).unionByName(
        own.withColumn("row", F.lit(None).cast("long")), allowMissingColumns=True
    )
    dealt = both.repartitionByRange(F.col("key").asc(), F.col("row").asc_nulls_first())
    dealt = stored(dealt.withColumn(PART, F.spark_partition_id()), "swept")
    # One row for each range: the rules that are open where it begins.
    begins = dealt.groupBy(PART).agg(F.min("key").alias("key"))
    opened = stacks(begins, PART).withColumns({"key": F.lit(""), "row": F.lit(None).cast("long")})
    order = Window.partitionBy(PART).orderBy(F.col("key").asc(), F.col("row").asc_nulls_first())
    last = F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    swept = dealt.unionByName(opened, allowMissingColumns=True).withColumn("open", last).where("row is not null")
    none = F.array().cast("array<string>")
    active = F.coalesce(F.filter("open", lambda rule: F.col("key").startswith(rule)), none)
    return swept.withColumn("active", active).drop("open", "stack", PART)


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null) and ``verdict``.

    ``rules`` has verdict, host (lower case) and path. A rule fits its host and all subdomains if the url's path begins
    with its path; the longest of those that fit decides, by characters of host and path together, and of rules equally
    long the one with the longer host; where one rule has both verdicts, block. Urls that no rule fits get ``default``.
    A null url has an empty host and path, which no rule fits. Rows that repeat are judged each; an empty table gives no
    rows. Input columns named like an output column are replaced, others are passed on.
    """
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("given"), host.alias("h"), path.alias("p"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host != ''")
    rules = stored(rules.withColumn("key", host_key(F.col("host"))), "rules")

    points = rows.select("row", "p", host_key(F.col("h")).alias("key"))
    under = sweep(points, rules, _label_prefixes).select("row", "p", F.explode("active").alias("ruled"))
    # A question mark is in no host key and in no path: it marks where the path begins.
    points = under.select("row", F.concat("ruled", F.lit("?"), "p").alias("key"))
    paths = rules.select("host", "path", "verdict", F.concat("key", F.lit("?"), "path").alias("key"))
    fits = sweep(points, paths, _char_prefixes).select("row", F.explode("active").alias("key"))
    # The longest active rule of a url is the only one that is still to be looked up.
    fits = fits.groupBy("row").agg(F.max_by("key", F.struct(F.length("key"), F.instr("key", "?"))).alias("key"))
    found = fits.join(paths, "key").select("row", F.concat("host", "path").alias("rule"), "verdict")
    joined = rows.join(found, "row", "left")
    out = {
        "host": F.col("h"),
        "path": F.col("p"),
        "rule": F.col("rule"),
        "verdict": F.coalesce("verdict", F.lit(default)),
    }
    return joined.select(
        *[F.col("given")[c].alias(c) for c in urls.columns if c not in out], *[v.alias(k) for k, v in out.items()]
    )
