"""URL filters: rules on hosts and paths, and trust spread over the links of hosts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import once

DAMPING = 0.85
TOLERANCE = 1e-6


def rounds_to_tolerance(damping: float) -> int:
    """Rounds after which no more than the tolerance can move.

    A round hands scores on and shrinks any difference by the damping at least; the
    first one moves at most twice the damped score.
    """
    return math.ceil(math.log(TOLERANCE / 2) / math.log(damping))


MOST_ROUNDS = rounds_to_tolerance(DAMPING)
# A host is blocked from this share of distrust in all it received.
BLOCK_SHARE = 0.75

_LINK = r"(?i)\bhref\s*=\s*[\"']?(?:https?:)?//([^\"'\s<>/?#]+)"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> UrlRule:
    """``block com/de/``: the verdict, a host and the path from its slash on."""
    verdict, _, address = text.partition(" ")
    host, slash, path = address.partition("/")
    return UrlRule(verdict, host, slash + path)


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a url that is null or has no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    url = F.coalesce(url, F.lit(""))
    return _lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matched_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null; of equal ones a block."""
    longest_first = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fitting = [
        F.when(
            ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path)),
            F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")),
        )
        for rule in longest_first
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_links(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """src, dst and the number of links between different hosts, by absolute addresses."""
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", _lower_ascii(F.col("dst")).alias("dst")).where("src <> '' AND src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust: personalised PageRank from the seeds, distrust against the links.

    ``seeds`` has host, trust and distrust. Each round a host hands on its score in
    proportion to its links; what reaches a host without links returns to the seeds,
    in proportion too. Rounds end when no more than the tolerance moves. Scores are
    written each round: lineage stays short and lost executors cost one round.
    """
    ways = links.select(F.lit("trust").alias("kind"), F.col("src").alias("giver"), F.col("dst").alias("host"), "weight").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("giver"), F.col("src").alias("host"), "weight")
    )
    given = ways.groupBy("kind", "giver").agg(F.sum("weight").alias("all"))
    ways = once(ways.join(given, ["kind", "giver"]).select("kind", "giver", "host", (F.col("weight") / F.col("all")).alias("share")), "ways")
    seeds = once(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
        .where("seed > 0")
        .select("kind", "host", F.col("seed").cast("double").alias("seed")),
        "seeds",
    )
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    whole = seeds.groupBy("kind").agg(F.sum("seed").alias("whole"))
    for _ in range(rounds_to_tolerance(damping)):
        moved = (
            scores.withColumnRenamed("host", "giver")
            .join(ways, ["kind", "giver"])
            .groupBy("kind", "host")
            .agg((F.lit(damping) * F.sum(F.col("score") * F.col("share"))).alias("got"))
        )
        back = moved.groupBy("kind").agg(F.sum("got").alias("kept"))
        rest = whole.join(back, "kind", "left").select(
            "kind", ((F.col("whole") - F.coalesce("kept", F.lit(0.0))) / F.col("whole")).alias("rest")
        )
        restart = seeds.join(rest, "kind").select("kind", "host", (F.col("seed") * F.col("rest")).alias("got"))
        new = once(
            moved.union(restart).groupBy("kind", "host").agg(F.sum("got").alias("score")), "scores"
        )
        change = new.withColumnRenamed("score", "new").join(scores, ["kind", "host"], "full").agg(
            F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0)))).alias("moved"), F.sum("new").alias("all")
        )
        scores = new
        if change.select(F.coalesce(F.col("moved") <= TOLERANCE * F.col("all"), F.lit(True))).first()[0]:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], page_id: str = "page_id", url: str = "url", html: str = "html", block_share: float = BLOCK_SHARE
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, distrust_share.

    A rule's verdict holds where one fits. The other pages take their host's: pages
    that rules allow or block make their hosts seeds of trust or distrust by their
    number, both spread over the links, and a host is blocked if at least
    ``block_share`` of what reached it is distrust. Hosts that nothing reached, an
    empty host too, are allowed, with a null share. Repeated rows are judged alike.
    """
    host, path = host_and_path(F.col(url))
    placed = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"), host.alias("host"), path.alias("path"))
    placed = placed.select("*", matched_rule(F.col("host"), F.col("path"), rules).alias("match"))
    counts = placed.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("match.verdict") == "allow").alias("trust"), F.count_if(F.col("match.verdict") == "block").alias("distrust")
    )
    scores = spread(host_links(placed, F.col("host")), counts.where("trust + distrust > 0"))
    shares = once(
        scores.where("trust + distrust > 0").select(
            "host", F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 6).alias("distrust_share")
        ),
        "host-shares",
    )
    judged = placed.drop("html").join(shares, "host", "left")
    by_host = F.when(F.col("distrust_share") >= block_share, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", by_host).alias("verdict"), "distrust_share"
    )
