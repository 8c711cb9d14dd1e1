"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

Terms count where no ASCII letter or digit stands beside them, once each. Strict terms weigh as much as the limit, soft ones
1: one strict or LIMIT distinct soft terms reject a URL that no rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.batches import rows

LIMIT = 2
STRICT = ("porn", "porno", "xxx", "hentai", "camgirls", "escorts", "torrent", "warez", "viagra", "casino", "betting", "jackpot")
SOFT = ("sex", "adult", "nude", "dating", "gambling", "poker", "slots", "bet", "lottery", "crack", "keygen", "free", "cheap", "pills", "loan", "win", "bonus", "ads", "click", "promo")
#: (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path; else null."""
    out = F.lit(None)
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_FOUND = "page_id bigint, url string, n_strict bigint, n_soft bigint"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(strict: tuple[str, ...], soft: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            machine.add_word(term, term)
        machine.make_automaton()
        plain = set("abcdefghijklmnopqrstuvwxyz0123456789")

        def found(url: str | None) -> set[str]:
            text = (url or "").translate(_LOWER)
            return {t for end, t in machine.iter(text) if text[end + 1 : end + 2] not in plain and (end < len(t) or text[end - len(t)] not in plain)}

        for batch in batches:
            urls = batch.column(1).to_pylist()
            terms = [found(u) for u in urls]
            yield rows(_FOUND, page_id=batch.column(0), url=urls, n_strict=[len(t & set(strict)) for t in terms], n_soft=[len(t & set(soft)) for t in terms])

    return run


def judged_urls(pages: DataFrame, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, rules: tuple = RULES, limit: int = LIMIT) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, n_strict, n_soft (distinct terms).

    A null url, or one without ://, has an empty host and path; terms are still looked for in it. Repeated rows are judged
    alike; an empty table gives no rows. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"))
    found = pages.mapInArrow(_terms(strict, soft), _FOUND).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    weight = F.col("n_strict") * limit + F.col("n_soft")
    found = found.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("by_rule.verdict", F.when(weight >= limit, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft")
