"""Verdicts on URLs from many rules, of which each URL meets only those that share a rare token.

A rule is indexed under one literal token: the one that the fewest URLs hold. A URL looks up its
own tokens, which brings the few rules that can match at all, and only those run their regular
expression. Rules without a whole literal token are indexed under the empty token, which every
URL carries.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registryloom.llm.common import lower_ascii

ALLOW, BLOCK = "allow", "block"
_TOKEN = re.compile("[a-z0-9]+")
#: Rules come from the caller's own list; a longer one needs a table and a shuffled join.
MAX_RULES = 100_000


@dataclass(frozen=True)
class SiteRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest wins."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return r"^(?:[^/]*\.)?" + _escaped(self.name)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds whole: the last may go on in the URL."""
        found = list(_TOKEN.finditer(self.name.lower()))
        return [m[0] for m in found if m.end() < len(self.name)]


@dataclass(frozen=True)
class PatternRule:
    """A glob anywhere in the lower-cased URL; ``*`` stands for any text."""

    glob: str
    verdict: str = BLOCK

    @property
    def name(self) -> str:
        return self.glob

    @property
    def regex(self) -> str:
        return "(?s)" + ".*".join(_escaped(p) for p in self.glob.lower().split("*"))

    @property
    def tokens(self) -> list[str]:
        pieces = self.glob.lower().split("*")
        found = [(m, p) for p in pieces for m in _TOKEN.finditer(p)]
        return [m[0] for m, p in found if m.start() > 0 and m.end() < len(p)]


Rule = SiteRule | PatternRule


def _escaped(literal: str) -> str:
    return re.sub(r"([^\w\s/-])", r"\\\1", literal, flags=re.ASCII)


def host_of(url: Column) -> Column:
    """Lower-cased, from the first ``://`` to the next ``/ ? #``; empty without one or for null."""
    return lower_ascii(_part(url, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without a host part."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    part = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.coalesce(part, F.lit(""))


def _tokens(url: Column) -> Column:
    """Distinct letter and digit runs of the lower-cased URL, and the empty token."""
    runs = F.split(F.regexp_replace(lower_ascii(url), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.concat(F.array(F.lit("")), runs))


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> list[tuple[int, str]]:
    """Each rule's number and its rarest token over ``urls(url)``, counted over all of them.

    The result holds one pair a rule; ties go to the token that sorts first.
    """
    spark = urls.sparkSession
    literal = sorted({t for r in rules for t in r.tokens})
    if not literal:
        return [(i, "") for i in range(len(rules))]
    wanted = spark.createDataFrame([(t,) for t in literal], "token string")
    held = urls.select(F.explode(_tokens(F.col("url"))).alias("token"))
    counts = held.join(F.broadcast(wanted), "token").groupBy("token").count()
    count = {r["token"]: r["count"] for r in counts.collect()}  # at most one row a rule token
    return [
        (i, min(r.tokens, key=lambda t: (count.get(t, 0), t), default=""))
        for i, r in enumerate(rules)
    ]


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW) -> DataFrame:
    """``url, host, path, rule, pattern, verdict`` per distinct URL of ``pages(url)``.

    The longest fitting site rule decides (ties: the longer host, then the name). Without one, a
    fitting allow pattern goes before a block pattern, then ``default``; ``pattern`` names the
    pattern that decided, the first by name. A null URL is one of the URLs, with empty parts, and
    gets the default. Other columns are ignored, repeated URLs are judged once, and an empty table
    gives no rows.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit the broadcast index")
    spark = pages.sparkSession
    urls = pages.select("url").distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = [
        (t, r.name, r.regex, isinstance(r, SiteRule), len(getattr(r, "host", "")), r.verdict)
        for (_, t), r in zip(rule_index(urls, rules), rules, strict=True)
    ]
    schema = "token string, name string, regex string, site boolean, host_len int, says string"
    index = F.broadcast(spark.createDataFrame(rows, schema))

    site = F.concat("host", "path")
    fits = F.when(F.col("site"), F.regexp_like(site, F.col("regex"))).otherwise(
        F.regexp_like(lower_ascii(F.col("url")), F.col("regex"))
    )
    hits = (
        parts.filter(F.col("url").isNotNull())
        .withColumn("token", F.explode(_tokens(F.col("url"))))
        .join(index, "token")
        .filter(fits)
    )
    length = F.when(F.col("site"), F.length("name"))
    best = F.max(F.when(F.col("site"), F.struct(length, "host_len", "name", "says")))
    pattern = F.when(~F.col("site"), F.struct("says", "name"))  # "allow" sorts before "block"
    found = hits.groupBy("url").agg(best.alias("best"), F.min(pattern).alias("pattern"))
    judged = parts.join(found, "url", "left")
    free = F.col("best").isNull()
    return judged.select(
        "url",
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.when(free, F.col("pattern.name")).alias("pattern"),
        F.coalesce("best.says", "pattern.says", F.lit(default)).alias("verdict"),
    )


def judge_pages(pages: DataFrame, rules: Sequence[Rule], default: str = ALLOW) -> DataFrame:
    """``page_id`` with the columns of ``judge_urls`` but the URL, one row per row of ``pages``."""
    judged = judge_urls(pages, rules, default)
    rows = pages.select("page_id", F.col("url").alias("own_url"))
    same = F.col("own_url").eqNullSafe(F.col("url"))
    return rows.join(judged, same, "left").drop("own_url", "url")
