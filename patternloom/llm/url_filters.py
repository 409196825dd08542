"""URL allow and block rules by a sort-merge range join (DataFrame operations only).

A rule is a host and a path prefix. It fits a URL whose host is the rule's or a subdomain of it and whose
path starts with the rule's; of the fitting rules the longest wins, at equal length the one with the longer
host.

Canonical keys: host labels in reverse order, a separator, then the path. For each of a URL's host suffixes
that some rule names, the URL is a point key; the rule is the interval of all keys that start with its key.
Points and interval ends are sorted together within a host, and a sweep over them keeps the stack of active
nested rules: prefixes either nest or are apart, so a rule's start makes it the innermost active one, and
its end restores its parent, which is known from the rules alone. The innermost active rule at a point is
then the last one seen (``last`` over the sorted window).

A host's points are dealt over as many groups as it takes to hold about ``group_rows`` each, with the host's
rules in every group, so a host with most of the pages is not swept by one task.

Defined cases: null url, or one without ``://``, has empty host and path and fits no rule; equal rules of
different verdicts: block wins; rules with a null host or path are ignored; an empty rule or page table is
fine; repeated rows are all reported; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ascii_lower, shared_table, sized

_NONE = "\0"  # no rule is active


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def _reversed(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def match_rules(pages: DataFrame, rules: DataFrame, key_col: str = "page_id", url_col: str = "url", default: str = "allow", group_rows: int = 1000) -> DataFrame:
    """key, host, path, rule (host and path as one string), verdict for every row of ``pages``.

    ``rules``: rule_host, rule_path, rule_verdict.
    """
    rules = rules.select(ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path", "rule_verdict").dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # 'block' > 'allow'
    rules = shared_table(rules.select(_reversed(F.col("rule_host")).alias("rhost"), "rule_host", "rule_path", "rule_verdict"), "rules")
    urls = split_url(pages.select(F.col(key_col).alias("key"), F.col(url_col).alias("url"))).select("key", "host", "path")
    urls = shared_table(urls, "urls")
    # points: one for each host suffix that has rules
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, -i, i)), "."))
    named = urls.where("host <> ''").select("host", "path").distinct()
    points = named.select("host", "path", F.explode(F.transform(suffixes, lambda s: F.concat(s, F.lit(".")))).alias("rhost"))
    hosts = rules.groupBy("rhost").agg(F.count("*").alias("n_rules"))
    points = points.join(hosts, "rhost")
    sizes = points.groupBy("rhost").agg(F.count("*").alias("n_points"), F.first("n_rules").alias("n_rules"))
    groups = F.ceil(F.col("n_points") / F.greatest(F.lit(group_rows), 4 * F.col("n_rules"))).cast("int").alias("groups")
    sizes = shared_table(sizes.select("rhost", groups), "sizes")
    salt = F.pmod(F.xxhash64("host", "path"), F.col("groups")).cast("int").alias("salt")
    dot = points.join(sizes, "rhost").select("rhost", salt, F.col("path").cast("binary").alias("k"), F.lit(1).alias("turn"), "host", "path", F.lit(None).cast("string").alias("rule"))
    # a rule is the interval from its path to its path and a byte above all of UTF-8
    ends = _with_parents(rules)
    both = ends.join(sizes, "rhost").select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    none = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    start = both.select("rhost", "salt", F.col("rule_path").cast("binary").alias("k"), F.lit(0).alias("turn"), *none, F.col("rule_path").alias("rule"))
    end = both.select("rhost", "salt", F.concat(F.col("rule_path").cast("binary"), F.lit(b"\xff")).alias("k"), F.lit(2).alias("turn"), *none, F.coalesce("parent", F.lit(_NONE)).alias("rule"))
    # at equal keys: starts from the outermost in, then points, then ends from the innermost out
    sweep = Window.partitionBy("rhost", "salt").orderBy("k", "turn", F.when(F.col("turn") == 0, F.length("rule"))).rowsBetween(Window.unboundedPreceding, 0)
    swept = dot.unionByName(start).unionByName(end).withColumn("active", F.last("rule", ignorenulls=True).over(sweep))
    hits = swept.where((F.col("turn") == 1) & (F.col("active") != _NONE)).select("rhost", "host", "path", F.col("active").alias("rule_path"))
    hits = hits.join(rules, ["rhost", "rule_path"])
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best")
    best = shared_table(hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict"), "verdicts")
    out = urls.join(sized(best), ["host", "path"], "left")
    return out.select(F.col("key").alias(key_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _with_parents(rules: DataFrame) -> DataFrame:
    """Each rule with the path of the next shorter rule of its host that it starts with (null: none)."""
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.length("rule_path") - 1), lambda i: F.substring("rule_path", 1, i)))
    inner = rules.where("rule_path <> ''").select("rhost", F.col("rule_path").alias("inner"), prefix.alias("rule_path"))
    found = inner.join(rules.select("rhost", "rule_path"), ["rhost", "rule_path"])
    outer = found.groupBy("rhost", F.col("inner").alias("rule_path")).agg(F.max_by("rule_path", F.length("rule_path")).alias("parent"))
    return rules.join(outer, ["rhost", "rule_path"], "left")
