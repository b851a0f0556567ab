"""Matching names to aliases, agents to rules, addresses to ranges."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from citewise.sources.logs import ip_number

NOT_WORD = re.compile(r"\W+")


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """A name in its compatible form (NFKC), case folded, without anything but letters, digits and underscores; null stays null."""
    return names.map(lambda n: None if n is None else NOT_WORD.sub("", unicodedata.normalize("NFKC", n).casefold()))


def match_aliases(observed: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """The columns of observed and match_mode, decision, entity: the entity whose alias the name is.

    aliases: entity, alias. A name is matched as written ('exact'), else folded ('normalized'); one entity is a
    'match', several a 'review' without entity, none 'no-match'. Distinct names are matched once, by two equi-joins
    with aliases grouped by key.
    """
    def keyed(key: Column, out: str) -> DataFrame:
        g = aliases.where(F.col("alias").isNotNull()).groupBy(key.alias(f"k_{out}")).agg(F.countDistinct("entity").alias(f"n_{out}"), F.min("entity").alias(f"e_{out}"))
        return g.where(F.col(f"k_{out}") != "")

    names = observed.where(F.col(name).isNotNull()).select(F.col(name).alias("k_exact")).distinct().withColumn("k_fold", folded(F.col("k_exact")))
    j = names.join(keyed(F.col("alias"), "exact"), "k_exact", "left").join(keyed(folded(F.col("alias")), "fold"), "k_fold", "left")
    mode = F.when(F.col("n_exact") > 0, "exact").when(F.col("n_fold") > 0, "normalized").otherwise("none")
    n = F.coalesce("n_exact", "n_fold", F.lit(0))
    got = j.select(F.col("k_exact").alias(name), mode.alias("match_mode"), F.when(n == 1, "match").when(n > 1, "review").otherwise("no-match").alias("decision"), F.when(n == 1, F.coalesce("e_exact", "e_fold")).alias("entity"))
    out = observed.join(got, name, "left")
    return out.fillna({"match_mode": "none", "decision": "no-match"})


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """token and category of the first rule whose token is in text, in any case; ('unknown', 'unknown') for none. rules is a short list."""
    low = F.lower(text)
    out = F.struct(F.lit("unknown").alias("token"), F.lit("unknown").alias("category"))
    for token, category in reversed(rules):
        out = F.when(low.contains(token.lower()), F.struct(F.lit(token).alias("token"), F.lit(category).alias("category"))).otherwise(out)
    return out


def in_ranges(df: DataFrame, ip: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """The columns of df and providers, the sorted providers whose ranges (provider, 'a.b.c.d/n' or 'a:b::/n') hold ip.

    An IPv4 range is the leading n bits of its addresses, so each length of prefix is one look-up by equality in a map
    built from the list; no range join is made. IPv6 ranges, if there are any, are looked up the same way in Arrow
    batches, each distinct address once a batch. What is no address has no providers; bits beyond n don't count.
    """
    none = F.array().cast("array<string>")
    by_length: dict[int, dict[int, list[str]]] = {}
    wide: dict[int, dict[int, set[str]]] = {}
    for provider, cidr in ranges:
        net = ipaddress.ip_network(cidr, strict=False)
        head = int(net.network_address) >> (net.max_prefixlen - net.prefixlen)
        if net.version == 4:
            by_length.setdefault(net.prefixlen, {}).setdefault(head, []).append(provider)
        else:
            wide.setdefault(net.prefixlen, {}).setdefault(head, set()).add(provider)
    hits = []
    for length, heads in by_length.items():
        table = F.create_map(*(F.lit(x).cast("long") if i % 2 == 0 else F.array(*map(F.lit, x)) for kv in heads.items() for i, x in enumerate(kv)))
        hits.append(F.coalesce(F.try_element_at(table, F.shiftright("__ip", 32 - length)), none))
    found = F.array_sort(F.array_distinct(F.flatten(F.array(*hits)))) if hits else none

    @F.pandas_udf(ArrayType(StringType()))
    def long_ones(ips: pd.Series) -> pd.Series:
        def of(ip: str | None) -> list[str]:
            try:
                number = int(ipaddress.IPv6Address(ip))
            except ValueError:
                return []
            return sorted(set().union(*(heads.get(number >> (128 - n), ()) for n, heads in wide.items())))

        got = {ip: of(ip) for ip in ips.unique()}
        return ips.map(got.__getitem__)

    other = long_ones(F.col(ip)) if wide else none
    return df.withColumn("__ip", ip_number(F.col(ip))).withColumn("providers", F.when(F.col("__ip").isNotNull(), found).otherwise(other)).drop("__ip")


def log_summary(lines: DataFrame, rules: list[tuple[str, str]], owners: dict[str, str], ranges: list[tuple[str, str]]) -> DataFrame:
    """claimed_token, claimed_category, ip_verification, requests of lines as log_lines gives them, and a row _TOTAL, all, malformed_lines for the others.

    owners: token to the provider it belongs to. ip_verification: verified or mismatch where the provider has ranges,
    else not_checked; what is no address is a mismatch. Counted before the shuffle, in one pass.
    """
    known = {p for p, _ in ranges}
    checked = {t: p for t, p in owners.items() if p in known}
    rows = in_ranges(lines, "ip", ranges).withColumn("r", first_rule(F.col("agent"), rules))
    provider = F.lit(None).cast("string")
    for token, owner in checked.items():
        provider = F.when(F.col("r.token") == token, owner).otherwise(provider)
    state = F.when(provider.isNull(), "not_checked").when(F.array_contains("providers", provider), "verified").otherwise("mismatch")
    pick = lambda good, bad: F.when(F.col("ok"), good).otherwise(bad)
    counted = rows.groupBy(pick(F.col("r.token"), "_TOTAL").alias("claimed_token"), pick(F.col("r.category"), "all").alias("claimed_category"), pick(state, "malformed_lines").alias("ip_verification")).agg(F.count("*").alias("requests"))
    total = lines.sparkSession.createDataFrame([("_TOTAL", "all", "malformed_lines", 0)], counted.schema)
    return counted.unionByName(total).groupBy("claimed_token", "claimed_category", "ip_verification").agg(F.sum("requests").alias("requests"))
