"""URL rules indexed by their rarest literal token.

Each rule is a regular expression over ``host || path`` with the literal tokens it cannot match
without. The corpus' own URLs say how often each of those tokens occurs; a rule is filed under
its rarest one. The tokens of a URL then fetch the rules filed under them, and only these run their
expression. Rules that have no literal token are filed under the empty token, which every URL
has. Only DataFrame functions are used.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.llm.common import ascii_lower, join_counted, stored

TOKEN = "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
"""What stands between tokens."""
RULES = "verdict string, name string, pattern string, weight int, tokens array<string>"


def host_rule(verdict: str, host: str, path: str = "/") -> tuple:
    """A rule for a host and all its subdomains, for paths that start with ``path``."""
    tokens = split_tokens(host) + whole_tokens(path)
    pattern = rf"(?s)^(?:[^/]*\.)?{escape(host)}{escape(path)}"
    return verdict, host + path, pattern, len(host) + len(path), sorted(set(tokens))


def pattern_rule(verdict: str, name: str, pattern: str, tokens: list[str], weight: int = 0) -> tuple:
    """A rule with an expression of its own over host and path. ``tokens``: whole tokens, in lower case, that every
    match contains; without any, the rule is tried on every URL."""
    return verdict, name, pattern, weight, sorted(set(tokens))


def escape(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


def split_tokens(text: str) -> list[str]:
    return [t for t in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", ascii_small(text)) if t]


def whole_tokens(path: str) -> list[str]:
    """Tokens of a path prefix; its last one may go on in the URL unless a separator ends the prefix."""
    found = split_tokens(path)
    return found if not found or not path or split_tokens(path[-1]) == [] else found[:-1]


def ascii_small(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def rules_frame(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first "://" and the next "/", "?" or "#", A-Z in lower case; path: from there to "?" or "#"."""
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(host, none), F.coalesce(path, none)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``pages``: id, url, host, path, rule, verdict.

    ``rules`` has the columns of RULES. The rule with the greatest weight wins, ties go to the smaller
    verdict and name. Where none matches, rule is null and verdict is ``default``. A null URL, or one without "://",
    has an empty host and path and is not tried. Repeated URLs are judged once; a URL that many
    pages share does not gather them in one task. Empty input: no rows.
    """
    host, path = host_and_path(F.col(url_col))
    base = stored(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), path.alias("_path"),
                               *[F.col(c).alias(f"_keep_{c}") for c in keep]), "urls")
    urls = base.where("_host <> '' or _path <> ''").groupBy("_host", "_path").agg(F.count("*").alias("_rows"))
    urls = urls.withColumn("_target", F.concat("_host", "_path"))
    urls = stored(urls.withColumn("_tokens", F.array_distinct(F.split(ascii_lower(F.col("_target")), TOKEN))), "url-tokens")
    rules = rules.withColumn("_rule", F.struct("weight", "verdict", "name", "pattern"))

    # How often the rules' own tokens occur among all URLs; the rarest files the rule.
    wanted = rules.select(F.explode("tokens").alias("_token")).distinct()
    seen = urls.select("_rows", F.explode("_tokens").alias("_token")).join(wanted, "_token", "left_semi")
    seen = seen.groupBy("_token").agg(F.sum("_rows").alias("_n"))
    # "at least one" token so that rules without one are filed under the empty token
    filed = rules.select("_rule", F.explode_outer("tokens").alias("_token")).join(seen, "_token", "left")
    filed = filed.groupBy("_rule").agg(F.min_by("_token", F.struct(F.coalesce("_n", F.lit(0)), "_token")).alias("_token"))
    filed = filed.select(F.coalesce("_token", F.lit("")).alias("_token"), "_rule")

    tokens = F.array_union("_tokens", F.array(F.lit("")))
    tried = urls.select("_host", "_path", "_target", F.explode(tokens).alias("_token")).join(filed, "_token")
    tried = tried.where(F.expr("_target rlike _rule.pattern"))
    won = tried.groupBy("_host", "_path").agg(
        F.min_by("_rule", F.struct(-F.col("_rule.weight"), "_rule.verdict", "_rule.name")).alias("_rule"))

    # The winners beside all rows; a URL that many rows share is dealt out by the helper.
    mark = F.concat_ws("\u0000", "_host", "_path")
    won = urls.select("_host", "_path", "_rows").join(won, ["_host", "_path"])
    won = won.select(mark.alias("_mark"), "_rows", F.col("_rule.name").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    rows = join_counted(base.withColumn("_mark", mark), won, "_mark", "_rows", base.count(),
                        F.struct(F.col("_id").cast("string"), "_url"))
    return rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                       "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
