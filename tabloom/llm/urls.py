"""URL rules through a blocked Bloom filter and an exact hash join.

Every listed rule (host and path start) becomes one canonical key.  A URL can only
fit a rule whose key is one of its own host suffixes joined to one of its path
starts, so these keys are looked up.  A blocked Bloom filter (512-bit blocks, one
bit in each of eight words) lets possible hits pass; an exact hash join on the key
then removes its false positives, and the longest fitting rule decides.

Only DataFrame functions are used.  The filter table is broadcast: it has at most
``bloom.MAX_BLOCKS`` rows of nine numbers (under 40 MB) whatever the list's length; a longer
list only raises the share of false positives, which the join removes.

Defined cases: a NULL URL, or one without ``://``, has an empty host and path and no
rule; ties between fitting rules of equal length go to the longer host, then to
``block``; rules without a host are ignored; repeated pages give repeated rows.
Input columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.bloom import block_count, bloom_table, possible
from tabloom.llm.words import lower_ascii

RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([*rules], "verdict string, host string, path string")


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``: after the first ``://``, then up to ``?`` or ``#``."""
    column = F.col(url)
    at = F.instr(column, "://")
    rest = F.when(at > 0, column.substr(at + 3, F.length(column))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": lower_ascii(host), "path": path})


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def _candidates(urls: DataFrame, labels: Sequence[int], lengths: Sequence[int]) -> DataFrame:
    """(host, path, key) for the host suffixes and path starts any rule could have."""
    parts = F.split("host", r"\.", -1)
    keys = F.flatten(
        F.array(
            *[
                F.when(
                    (F.size(parts) >= n) & (F.col("host") != "") & (F.length("path") >= k),
                    F.array(_key(F.array_join(F.slice(parts, -n, n), "."), F.substring("path", 1, k))),
                ).otherwise(F.array().cast("array<string>"))
                for n in labels
                for k in lengths
            ]
        )
    )
    return urls.select("host", "path", F.explode(keys).alias("key"))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest fitting rule, else ``default``.

    ``rules``: verdict, host, path (a path start).  The different label counts of rule
    hosts and lengths of rule paths are read first; both are bounded by the longest rule.
    """
    listed = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
        .groupBy("r_host", "r_path")
        .agg(F.max("verdict").alias("verdict"))  # of conflicting copies "block" wins
        .withColumn("key", _key(F.col("r_host"), F.col("r_path")))
    )
    shape = listed.agg(
        F.collect_set(F.size(F.split("r_host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("r_path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    narrow = with_host_path(pages.select(page_id, url), url).drop(url)
    blank = F.lit(None).cast("string")
    if not shape.n:
        return narrow.select(page_id, "host", "path", blank.alias("rule"), F.lit(default).alias("verdict"))
    blocks = block_count(shape.n)
    bloom = bloom_table(listed, "key", blocks)
    # Repeated URLs are looked up once; the counts are combined before the shuffle.
    asked = _candidates(narrow.select("host", "path").distinct(), sorted(shape.labels), sorted(shape.lengths))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"),
        F.length("r_host").alias("host_size"),
        F.concat("r_host", "r_path").alias("rule"),
        "verdict",
    )
    exact = possible(asked, "key", bloom, blocks).join(listed, "key").groupBy("host", "path").agg(F.max(rank).alias("best"))
    return narrow.join(exact, ["host", "path"], "left").select(
        page_id,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
