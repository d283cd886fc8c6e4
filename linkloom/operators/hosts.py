"""Classification of host names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.barrier import computed_once
from linkloom.functions.text import sql_like
from linkloom.sources.suffix_rules import longest_rule, own_longest, suffix_rules

MAX_BROADCAST_RULES = 100_000
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def with_registered_domain(
    df: DataFrame, host: str = "hostname", rules: DataFrame | None = None, parts: bool = False
) -> DataFrame:
    """Add registered_domain, with ``parts`` also subdomain and suffix.

    As many of the host's last labels as the longest rule has are looked up in the rule table, which
    is broadcast: no shuffle, whatever the number of rows. A table passed as ``rules`` is broadcast
    if it has at most MAX_BROADCAST_RULES rows. The longest rule wins, ``*`` stands for one label, an
    exception takes one label back. A host without a registered domain (address, single label,
    unknown or bare suffix) is its own.
    """
    table = suffix_rules(df.sparkSession) if rules is None else rules
    longest = own_longest() if rules is None else longest_rule(rules)
    small = rules is None or rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    name = F.col(host)
    labels = F.size(F.split(name, r"\."))
    looked_up = df
    lengths: list[Column] = []
    for n in range(1, longest + 1):
        found = table.select(
            F.col("suffix").alias(f"suffix_{n}"),
            F.col("is_rule").alias(f"rule_{n}"),
            F.col("is_wildcard").alias(f"wildcard_{n}"),
            F.col("is_exception").alias(f"exception_{n}"),
        )
        side = F.broadcast(found) if small else found
        looked_up = looked_up.join(
            side, F.substring_index(name, ".", -n) == F.col(f"suffix_{n}"), "left"
        )
        enough = labels >= n
        lengths.append(F.when(enough & F.col(f"rule_{n}"), n))
        exception = F.coalesce(F.col(f"exception_{n}"), F.lit(False))
        lengths.append(F.when(enough & exception, n - 1))
        if n > 1:
            lengths.append(F.when(enough & F.col(f"wildcard_{n - 1}") & ~exception, n))
    size = F.coalesce(F.greatest(F.lit(0), F.lit(0), *lengths), F.lit(0))
    sized = looked_up.select(*df.columns, size.alias("suffix_labels"), labels.alias("labels"))
    size, labels = F.col("suffix_labels"), F.col("labels")
    last = F.call_function("substring_index", name, F.lit("."), -(size + 1))
    registered = (size > 0) & (labels > size)
    added = [F.when(registered, last).otherwise(name).alias("registered_domain")]
    if parts:
        suffix = F.call_function("substring_index", name, F.lit("."), -size)
        address = name.rlike(_IPV4) | name.contains(":")
        front = F.when(registered, last).otherwise(F.substring_index(name, ".", -1))
        before = F.left(name, F.greatest(F.length(name) - F.length(front) - 1, F.lit(0)))
        added.append(F.when(size > 0, suffix).otherwise("").alias("suffix"))
        added.append(F.when((labels == size) | address, "").otherwise(before).alias("subdomain"))
    return computed_once(sized, df.columns, added)


def tld_bucket(host: Column) -> Column:
    """.gov (also inside, as in .gov.uk), .edu, .org, .net, .com or other."""
    bucket = F.when(host.endswith(".gov") | host.contains(".gov."), ".gov")
    for tld in fixed.TLD_BUCKETS[1:]:
        bucket = bucket.when(host.endswith(tld), tld)
    return bucket.otherwise("other")


def ends_with_tld(host: Column, tld: str) -> Column:
    """The domain list's filter: a suffix in any case, or ``other`` for none of the five."""
    if tld != "other":
        return sql_like(host, f"%{tld}")
    listed = F.lit(False)
    for suffix in fixed.TLD_BUCKETS:
        listed = listed | host.endswith(suffix)
    return ~listed
