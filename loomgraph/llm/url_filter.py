"""URL filter: allow and block rules by host and path, then a weighted vocabulary matched by Aho-Corasick.

Null urls, and urls without `://`, have an empty host and path, fit no rule and are judged by the vocabulary alone
(null: allowed). Empty input gives an empty result. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import free_name

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Weights: one strict term, or soft terms of `REJECT_AT` together, reject.
STRICT, SOFT = 2, 1
# The production vocabulary, strict terms and soft ones.
STRICT_TERMS = (
    "adult", "bitcoin-doubler", "botnet", "camgirls", "casino", "cialis", "counterfeit", "crackz", "darkweb", "erotica", "escort", "escorts", "fake-id", "gambling", "hardcore", "hentai",
    "hookup", "jackpot", "keygen", "keygens", "levitra", "loan-shark", "malware", "milf", "nsfw", "nude", "nudes", "payday-loan", "phishing", "pills", "poker", "porn", "porno", "pornhub",
    "ransomware", "roulette", "serialz", "sex", "sexcam", "slots", "spam", "spyware", "steroids", "stripper", "torrentz", "tramadol", "trojan", "viagra", "warez", "xanax", "xxx",
)
SOFT_TERMS = (
    "ads", "affiliate", "banner", "bet", "bets", "betting", "bonus", "buy", "cash", "cheap", "click", "clickbait", "clicks", "coupon", "coupons", "credit", "crypto", "dating", "deals", "debt",
    "diet", "discount", "doubleclick", "download", "earn", "farm", "followers", "forex", "free", "freebie", "gratis", "hot", "likes", "limited-offer", "loan", "loans", "lottery", "lucky", "luxury",
    "miracle", "money", "nulled", "offer", "offers", "outlet", "popup", "prize", "promo", "proxy", "replica", "sale", "seo", "singles", "sponsored", "stream", "surveys", "torrent", "track",
    "tracker", "tracking", "traffic", "unlimited", "vip", "weightloss", "win", "winner",
)
#: Digits that stand for letters in disguised terms.
DISGUISE = str.maketrans("aeios", "43105")


def with_disguises(terms: Iterable[str]) -> list[str]:
    """The terms and their forms with digits for letters."""
    return list(dict.fromkeys(x for t in terms for x in (t, t.translate(DISGUISE))))


def weighted(strict: Iterable[str] = STRICT_TERMS, soft: Iterable[str] = SOFT_TERMS) -> dict[str, int]:
    """Term to weight; a term of both lists is strict. A table of own terms takes this one's place as a parameter."""
    return dict.fromkeys(soft, SOFT) | dict.fromkeys(with_disguises(strict), STRICT)


VOCABULARY: Mapping[str, int] = weighted()
REJECT_AT = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def vocabulary_weight(url: Column, vocabulary: Mapping[str, int] = VOCABULARY) -> Column:
    """Sum of the weights of the distinct terms in a url; letters or digits may not touch a term."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in vocabulary:
            machine.add_word(term, term)
        machine.make_automaton()

        def apart(text: str, i: int) -> bool:
            return not (0 <= i < len(text) and text[i].isascii() and text[i].isalnum())

        def weight(text: str | None) -> int:
            text = (text or "").lower()
            found = {t for end, t in machine.iter(text) if apart(text, end + 1) and apart(text, end - len(t))}
            return sum(map(vocabulary.__getitem__, found))

        for urls in batches:
            yield pd.Series([weight(u) for u in urls], dtype="int32")

    return run(url)


def judged(url: Column, rules=RULES, vocabulary: Mapping[str, int] = VOCABULARY, reject_at: int = REJECT_AT) -> dict[str, Column]:
    """host, path, rule, term_weight and verdict of a url."""
    host, path = host_and_path(url)
    rule, verdict = rule_of(host, path, rules)
    weight = vocabulary_weight(url, vocabulary)
    return {"host": host, "path": path, "rule": rule, "term_weight": weight, "verdict": F.coalesce(verdict, F.when(weight >= reject_at, "block").otherwise("allow"))}


def judge(pages, url: str = "url", rules=RULES, vocabulary: Mapping[str, int] = VOCABULARY, reject_at: int = REJECT_AT):
    """`pages` with a column `judged`, a struct of host, path, rule, term_weight and verdict, under a name that is free."""
    of_url = judged(F.col(url), rules, vocabulary, reject_at)
    return pages.withColumn(free_name(pages, "judged"), F.struct(*[c.alias(n) for n, c in of_url.items()]))
