"""URL filtering: list rules by host and path, and a weighted vocabulary.

``judge`` adds host, path, the longest rule that fits, and a verdict. Where a
rule fits, its verdict holds. Elsewhere the vocabulary decides: one
Aho-Corasick pass over the lower-cased host and path finds all terms that
stand between boundaries (no ASCII letter next to them). A term has a weight;
the weights of the different terms found add up, and ``LIMIT`` blocks: one
strict term alone, soft ones only several together. A null url or one without
``://`` has an empty host and path, no rule, and is allowed. Urls of any length
are read in one pass; rows that repeat are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import add_by_text, once, pick

#: Sum of weights that blocks.
LIMIT = 2
#: Terms of the default vocabulary; strict ones weigh ``LIMIT``, soft ones 1.
STRICT = ("adult", "betting", "bets", "casino", "escort", "hardcore", "hentai", "malware", "nude", "phishing", "poker", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("bet", "bonus", "cheap", "click", "crack", "dating", "deal", "deals", "farm", "free", "gamble", "jackpot", "loan", "lottery", "offer", "pharma", "pills", "prize", "promo", "slots", "win", "winner")
VOCABULARY = tuple((t, LIMIT) for t in STRICT) + tuple((t, 1) for t in SOFT)
#: (prefix of host/path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by text) and its verdict; rules are a fixed, small list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for prefix, says in sorted(rules, key=lambda r: (len(r[0]), r[0][::-1])):
        at = prefix.index("/")
        h, p = prefix[:at], prefix[at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(prefix)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Automaton:
    """Aho-Corasick: a trie of the terms whose states fall back to the state of their longest suffix that is one."""

    def __init__(self, terms: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        for term in terms:
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                at = self.next[at][c]
            self.ends[at] = (term,)
        # By depth: a state's transitions are its own and, for other characters, those of the state it falls back to.
        back, queue = [0] * len(self.next), [0]
        for at in queue:
            for c, to in [*self.next[at].items()]:
                back[to] = self.next[back[at]].get(c, 0) if at else 0
                queue.append(to)
            if at:
                self.next[at] = self.next[back[at]] | self.next[at]
                self.ends[at] += self.ends[back[at]]

    def find(self, text: str) -> Iterator[tuple[int, str]]:
        """(end, term) of all terms in a text, however they overlap."""
        at, steps, ends = 0, self.next, self.ends
        for i, c in enumerate(text):
            at = steps[at].get(c, 0)
            if ends[at]:
                for term in ends[at]:
                    yield i + 1, term


def weigh(machine: Automaton, weights: dict[str, int], text: str) -> tuple[int, list[str], list[str]]:
    """The summed weight of the different terms with boundaries on both sides, then the strict and the soft ones, sorted."""
    low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    found = set()
    for end, term in machine.find(low):
        start = end - len(term)
        if not (start and "a" <= low[start - 1] <= "z") and not (end < len(low) and "a" <= low[end] <= "z"):
            found.add(term)
    strict = sorted(t for t in found if weights[t] >= LIMIT)
    return sum(weights[t] for t in found), strict, sorted(found.difference(strict))


def judge(df: DataFrame, url: str = "url", keep: list[str] | None = None, rules=RULES, vocabulary: Iterable[tuple[str, int]] = VOCABULARY) -> DataFrame:
    """``keep`` columns, then host, path, rule, verdict, weight, strict_terms and soft_terms.

    ``vocabulary``: (term of lower-case letters, digits and marks, weight), a list of a size for one Python object.
    """
    new = ["host", "path", "rule", "verdict", "weight", "strict_terms", "soft_terms"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    weights = dict(vocabulary)
    taken = pick(df, [*keep, url]).toDF(*[f"k{i}" for i in range(len(keep))], "u")
    host, path = host_and_path(F.col("u"))
    parts = taken.select(*taken.columns[:-1], host.alias("host"), path.alias("path")).withColumn("site", F.concat("host", "path"))

    def make():
        machine = once(("urls", *sorted(weights.items())), lambda: Automaton(weights))
        return lambda texts: list(zip(*(weigh(machine, weights, t) for t in texts), strict=True)) if texts else [[], [], []]

    hits = add_by_text(parts, make, "weight int, strict_terms array<string>, soft_terms array<string>", "site", parts.columns[:-1], keeps=True)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("weight") >= LIMIT, "block").otherwise("allow")
    return hits.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), *new[4:])
