"""URL filter: host rules, and a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Weights of terms. A url is rejected at LIMIT: by one strict term, by two distinct soft ones, or by four distinct weak ones.
LIMIT = 4
STRICT = (
    "adult bdsm bitcoin-doubler blackjack camgirl camgirls casino cialis crackz erotic escort escorts fetish gangbang hardcore hentai keygens levitra malware milf phishing porn porno pornhub "
    "ransomware roulette serialz sexcam sexshop slots spam spyware sportsbook stripper tramadol trojan viagra warez xanax xvideos xxx"
).split()
SOFT = (
    "bet bets betting bingo bonus cheap crack cracked crypto dating diet download farm gambling hack hacks hot jackpot keygen leaked loan loans lottery naked nude nudes payday "
    "pharmacy pills poker promo replica sex sexy singles torrent torrents unlock wagering"
).split()
WEAK = "ad ads affiliate buy click coupon deal deals discount free gift offer popup redirect sale sponsor track tracker tracking win winner".split()
VOCABULARY = dict.fromkeys(WEAK, LIMIT // 4) | dict.fromkeys(SOFT, LIMIT // 2) | dict.fromkeys(STRICT, LIMIT)
#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


@lru_cache(4)
def _automaton(words: tuple[tuple[str, int], ...]) -> ahocorasick.Automaton:
    """One automaton for each vocabulary and Python worker."""
    out = ahocorasick.Automaton()
    for term, weight in words:
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def term_hits(url: Column, vocabulary: dict[str, int] | None = None, limit: int = LIMIT) -> Column:
    """A struct of weight, strict_hits and soft_hits: the distinct terms of a url, once each.

    A term counts where neither neighbour is an ASCII letter or digit; A-Z count as a-z. One automaton
    finds all terms in one pass. A null url holds none.
    """
    words = tuple(sorted((VOCABULARY if vocabulary is None else vocabulary).items()))

    def scan(urls: pa.Array) -> pa.Array:
        automaton = _automaton(words)
        fold = str.maketrans(_UPPER, _LOWER)
        plain = frozenset(_LOWER + "0123456789")
        rows = []
        for url in urls.to_pylist():
            found = {}
            text = (url or "").translate(fold)
            for end, (term, weight) in automaton.iter(text) if words else ():
                start = end - len(term) + 1
                if not (start and text[start - 1] in plain) and not (end + 1 < len(text) and text[end + 1] in plain):
                    found[term] = weight
            strict = sum(w >= limit for w in found.values())
            rows.append({"weight": sum(found.values()), "strict_hits": strict, "soft_hits": len(found) - strict})
        return pa.array(rows, pa.struct([("weight", pa.int32()), ("strict_hits", pa.int32()), ("soft_hits", pa.int32())]))

    return F.arrow_udf(scan, "weight int, strict_hits int, soft_hits int")(url.cast("string"))


def judge(pages: DataFrame, rules=RULES, vocabulary: dict[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits and soft_hits of every row of pages.

    A rule that fits decides; else a url whose distinct terms weigh limit or more is blocked. A null url
    or one without `://` has an empty host and path, so no rule fits it; its terms still count. Rows are
    judged one by one, so repeated rows agree; other columns are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), term_hits(url, vocabulary, limit).alias("hits"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return rows.select(
        F.col("page_id"), "host", "path", "fit.rule",
        F.coalesce("fit.verdict", F.when(F.col("hits.weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "hits.strict_hits", "hits.soft_hits",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _count(terms: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)') AS INT)" for t in terms)


def _fits(value) -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    )
    return f"CASE {cases} END"


OP1_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low
  FROM pages),
hits AS (SELECT *, {_count(STRICT)} AS strict_hits, {_count(SOFT)} AS medium, {_count(WEAK)} AS weak FROM parts)
SELECT page_id, host, path, {_fits(lambda h, p, v: h + p)} AS rule,
       coalesce({_fits(lambda h, p, v: v)}, CASE WHEN strict_hits * {LIMIT} + medium * {LIMIT // 2} + weak * {LIMIT // 4} >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(strict_hits AS INT) AS strict_hits, CAST(medium + weak AS INT) AS soft_hits
FROM hits
"""
