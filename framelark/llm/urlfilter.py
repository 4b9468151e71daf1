"""URL filters: a trie over reversed host labels and path segments, broadcast, with longest-match precedence.

Of the rules that fit a URL the one of the longest text counts, of equally long ones that of the longer host, of equal texts the
one that blocks. The trie and the joins that stand in for it beyond its bound give the same rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules, and characters of all their texts, up to which the trie is broadcast; more are joined as a table.
TRIE_RULES, TRIE_TEXT = 500_000, 32 << 20


@dataclass(frozen=True)
class Rule:
    """A host (any subdomain fits too) and the start of a path; ``text`` is both, as in ``example.net/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the query.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


class Trie:
    """Nodes are dicts; the labels of a host from its end, then the whole segments of a path, lead to ``""``: the starts of a next segment, by their length."""

    def __init__(self, rules):
        self.root: dict = {}
        for rule in sorted(set(rules), key=lambda r: (r.text, r.verdict != "block"), reverse=True):  # of equal rules block wins
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault("", {}).setdefault(len(rest), {})[rest] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The fitting rule that counts; None if none fits. At each node one look-up for each length of a start that it has."""
        best, rank = None, (-1, -1)
        node, segments = self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            below = node
            for n, segment in enumerate(segments):
                for length, starts in below.get("", {}).items():
                    rule = starts.get(segment[:length]) if length <= len(segment) else None
                    if rule is not None and (len(rule.text), len(rule.host)) > rank:
                        best, rank = rule, (len(rule.text), len(rule.host))
                if n + 1 < len(segments):
                    below = below.get(("p", segment))
                    if below is None:
                        break
        return best


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(urls: DataFrame, rules=RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """urls and ``host, path, rule, verdict``; columns of these names are replaced.

    Null urls and those without ``://`` have an empty host and path and fit no rule. No fitting rule: rule null and the
    verdict ``default``. Which of several fitting rules counts: see above. ``rules`` are Rules, or a table ``verdict, text`` of any size
    (rows with a null in either are no rules). Repeated rows stay; an empty table gives no rows.
    """
    parts = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "text").where("verdict is not null and text is not null").distinct()
        n, size = table.limit(TRIE_RULES + 1).agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        if n > TRIE_RULES or size > TRIE_TEXT:
            return _joined(parts, table, default)
        rules = (Rule(*row) for row in table.collect())
    rules = tuple(rules)
    if len(rules) > TRIE_RULES or sum(len(r.text) for r in rules) > TRIE_TEXT:
        return _joined(parts, urls.sparkSession.createDataFrame([(r.verdict, r.text) for r in rules], "verdict string, text string"), default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.match(h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [f and f.text for f in found], "verdict": [f.verdict if f else default for f in found]}, dtype=object)

    columns = [c for c in parts.columns if c not in ("rule", "verdict")]
    return parts.withColumn("_fl_hit", walk(F.col("host"), F.col("path"))).select(*(F.col(f"`{c}`") for c in columns), "_fl_hit.rule", "_fl_hit.verdict")


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for any number of rules: every suffix of a host, with every start of the path that is as long as some rule's of that host, is looked up."""
    from .common import saved

    host = F.substring_index("text", "/", 1)
    table = rules.select("text", "verdict", host.alias("r_host"), F.substr("text", F.length(host) + 1).alias("r_path"))
    # of equal texts the one that blocks, the least in the alphabet of other verdicts
    table = table.groupBy("text", "r_host", "r_path").agg(F.min(F.struct((F.col("verdict") != "block").alias("n"), "verdict")).alias("v"))
    table = saved(table.select("text", "r_host", "r_path", F.col("v.verdict").alias("r_verdict")), "url-rules")
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    pairs = saved(parts.select("host", "path").distinct(), "url-pairs")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    starts = pairs.withColumn("tail", F.explode(tails)).join(lengths, F.col("tail") == F.col("r_host")).drop("r_host")
    starts = starts.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).withColumn("start", F.substr("path", F.lit(1), F.col("n"))).drop("lengths")
    fits = starts.join(table, (F.col("tail") == F.col("r_host")) & (F.col("start") == F.col("r_path")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("text").alias("n"), F.length("r_host").alias("h"), "text", "r_verdict")).alias("b"))
    best = best.select(F.col("host").alias("_fl_h"), F.col("path").alias("_fl_p"), F.col("b.text").alias("rule"), F.col("b.r_verdict").alias("verdict"))
    columns = [F.col(f"`{c}`") for c in parts.columns if c not in ("rule", "verdict")]
    out = parts.select(*columns).join(best, (F.col("host") == F.col("_fl_h")) & (F.col("path") == F.col("_fl_p")), "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop("_fl_h", "_fl_p")
