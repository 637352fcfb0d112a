"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join. Native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm import bloom
from tapeflow.llm.common import Scratch, fresh

#: (verdict, host and path prefix), in the order of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page whose title holds a run of these is junk; its canonical URL goes on the list of the query.
JUNK_TITLE = r"<title>[^<]*(###|\$\$\$|%%%|&&&|\*\*\*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a closing slash; null where there is no host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, r"/+$", "")))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] | DataFrame = RULES,
    listed: DataFrame | None = None,
    url: str = "url",
    default: str = "allow",
    most_words: int = bloom.MOST_WORDS,
) -> DataFrame:
    """Adds host, path, rule, verdict and listed (boolean) to every row of ``pages``.

    rules: (verdict, ``host/pathprefix``) pairs, or a DataFrame (verdict, rule). A rule fits its host and every
    subdomain where the path starts with the rule's; the longest wins. Elsewhere a page whose canonical URL is in
    ``listed`` (one column, canonical URLs; nulls and repeats do no harm) is blocked, others get ``default``.

    Rule keys and listed URLs go into one blocked Bloom filter of bounded size. Rows without a hit never meet the
    joins; hits join exactly, so a false positive costs a lookup and changes nothing. Rows are kept as they are, also
    repeated ones and ones with null ids. The parsed rows are written once to the shared folder, so give only the
    columns that are wanted. Columns of ``pages`` named like an added one are replaced.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "url-filter")
    pages = with_host_path(pages.drop("host", "path", "rule", "verdict", "listed"), url)
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string")
    rules = scratch.cut(rules.where(F.col("rule").contains("/")).groupBy("rule").agg(F.min("verdict").alias("verdict")))
    parts = rules.select(
        "rule",
        F.size(F.split(F.substring_index("rule", "/", 1), r"\.")).alias("labels"),
        (F.length("rule") - F.length(F.substring_index("rule", "/", 1))).alias("chars"),
    )
    #: The distinct shapes of rules (labels of the host, length of the path); they don't grow with the pages.
    shapes = sorted((r["labels"], r["chars"]) for r in parts.select("labels", "chars").distinct().collect())
    keys = rules.select(F.concat(F.lit("r "), "rule").alias("key"))
    if listed is not None:
        listed = scratch.cut(listed.toDF("key").where("key is not null").distinct().select(F.concat(F.lit("u "), "key").alias("key")))
        keys = keys.unionByName(listed)
    words = bloom.size(keys.count(), most_words)
    bits = scratch.cut(bloom.build(keys, "key", words)).scalar()

    host, path, own = F.col("host"), F.col("path"), pages.columns
    *names, canon, key, best, on_list = fresh(pages, *(f"key{k}" for k in range(len(shapes))), "canon", "k", "best", "on_list")
    for (labels, chars), name in zip(shapes, names):
        suffix = F.substring_index(host, ".", -labels)
        fits = (host != "") & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars)
        pages = pages.withColumn(name, F.when(fits, F.concat(F.lit("r "), suffix, F.substring(path, 1, chars))))
    pages = pages.withColumn(canon, F.concat(F.lit("u "), canonical(host, path)))
    tested = [*names, *([canon] if listed is not None else [])]
    pages = scratch.cut(pages)
    pages = pages.withColumns({c: F.when(bloom.may_contain(bits, words, F.col(c)), F.col(c)) for c in tested})
    some = F.coalesce(*(F.col(c) for c in tested)).isNotNull() if tested else F.lit(False)
    miss, hit = pages.where(~some), pages.where(some)
    found = fresh(pages, *(f"found{k}" for k in range(len(names))))
    for name, rule in zip(names, found):
        value = F.struct(F.length("rule").alias("n"), "rule", "verdict")
        side = rules.select(F.concat(F.lit("r "), "rule").alias(key), value.alias(rule))
        hit = hit.join(side, hit[name] == side[key], "left").drop(key)
    if listed is not None:
        side = listed.select(F.col("key").alias(key), F.lit(True).alias(on_list))
        hit = hit.join(side, hit[canon] == side[key], "left").drop(key)
    else:
        hit = hit.withColumn(on_list, F.lit(None).cast("boolean"))
    nothing = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    is_listed = F.coalesce(F.col(on_list), F.lit(False))
    hit = hit.withColumn(best, F.array_max(F.array(nothing, *(F.col(c) for c in found))))
    hit = hit.select(*own, F.col(f"{best}.rule").alias("rule"), F.coalesce(F.col(f"{best}.verdict"), F.when(is_listed, "block").otherwise(default)).alias("verdict"), is_listed.alias("listed"))
    miss = miss.select(*own, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(False).alias("listed"))
    return hit.unionByName(miss)


def junk_listed(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages with a junk title: the list that the query and the tests block."""
    bad = with_host_path(pages.where(F.col("html").rlike(JUNK_TITLE)))
    return bad.select(canonical(F.col("host"), F.col("path")).alias("key"))
