"""Rules that keep links out of checks and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.functions.text import trimmed_lower


@dataclass(frozen=True)
class HostRule:
    """Leaves out links whose host, port and all, is one of ``hosts``."""

    key: str
    reason: str
    hosts: frozenset[str]

    def keep(self, links: DataFrame, page_links: DataFrame) -> DataFrame:
        return links.filter(~F.col("host").isin(*sorted(self.hosts))) if self.hosts else links


@dataclass(frozen=True)
class TextRule:
    """Leaves out links of which every occurrence has one of ``texts``; an occurrence without text keeps its link everywhere."""

    key: str
    reason: str
    texts: frozenset[str]

    def keep(self, links: DataFrame, page_links: DataFrame) -> DataFrame:
        if not self.texts:
            return links
        other = page_links.filter(F.col("link_text").isNull() | ~trimmed_lower(F.col("link_text")).isin(*sorted(self.texts)))
        return links.join(other.select(F.col("link_id").alias("id")), "id", "left_semi")


# The rules in force.
RULES: tuple[HostRule | TextRule, ...] = (
    HostRule("archive", "Links into an archive of the web are kept as they are.", frozenset({"web.archive.org"})),
    TextRule("citation", "Links that only name a source are citations.", frozenset({"source", "source)", "(source)"})),
)


def apply_rules(links: DataFrame, page_links: DataFrame, rules: tuple[HostRule | TextRule, ...] = RULES) -> DataFrame:
    """The links that every rule keeps.  A null host passes no host rule, as SQL has it."""
    for rule in rules:
        links = rule.keep(links, page_links)
    return links


def live(links: DataFrame, page_links: DataFrame) -> DataFrame:
    """Links that some page still has."""
    return links.join(page_links.select(F.col("link_id").alias("id")), "id", "left_semi")


def kept(links: DataFrame, page_links: DataFrame, rules: tuple[HostRule | TextRule, ...] = RULES) -> DataFrame:
    """Links that some page still has and every rule keeps; a text rule keeps only links that some page has, so one join tells both."""
    out = apply_rules(links, page_links, rules)
    return out if any(isinstance(rule, TextRule) and rule.texts for rule in rules) else live(out, page_links)


#: What extraction and checking leave out by themselves, for the report.
BY_DESIGN: tuple[tuple[str, str], ...] = (
    ("no text", "Links without text, such as images, are not extracted: nobody could find them on the page."),
    ("own site", "Links within a site are followed, not checked."),
    ("no request", "Jumps within a page and mail, telephone and script links ask for no page."),
    ("orphans", "Links that no page has any more are kept, but neither checked nor reported."),
)


def documented(rules: tuple[HostRule | TextRule, ...] = RULES) -> list[tuple[str, str]]:
    """Keys and reasons, for the report."""
    return [(rule.key, rule.reason) for rule in rules] + list(BY_DESIGN)
