"""URL filter: site rules first, then a weighted vocabulary found by Aho-Corasick.

Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, with A-Z in lower case. Path: what follows up to ``?``, ``#`` or the end. A
url that is null or lacks ``://`` has an empty host and path.

Rules are strings ``host/path-prefix``; a rule fits its host and all subdomains if
the path starts with the rule's. The longest fitting rule decides. Candidate
rules of a url are few (its host's suffixes), so rules are looked up in a dict.

Otherwise one automaton over the vocabulary scans the lower-cased url once. A hit
counts only if both neighbours are no letters or digits (or the edge). One strict
term blocks the url; so do ``soft_terms`` or more distinct soft terms whose weights reach ``soft_limit``
together. One soft term alone never does, whatever its weight and however often it stands there.

Defined cases: a null, empty or host-less url has no rule; it is allowed, as no
term is found in it (a term in a host-less url still counts). Repeated rows are
judged one by one. Very long urls are scanned in linear time. Empty table: empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = {c: c + 32 for c in range(65, 91)}

#: Terms that block alone, and terms that block together, with their weights.
STRICT_TERMS = (
    "adult", "bukkake", "camgirl", "camgirls", "casino", "casinos", "escort", "escorts", "hentai", "keygen", "malware", "milf", "nsfw", "phishing",
    "porn", "porno", "pornstar", "ransomware", "spam", "spyware", "torrent", "torrents", "viagra", "warez", "xxx",
)
SOFT_TERMS = {
    "bet": 2, "bets": 2, "betting": 2, "blackjack": 2, "bonus": 1, "cams": 2, "cash": 1, "cheap": 1, "click": 1, "crack": 2, "dating": 2, "deal": 1,
    "discount": 1, "earn": 1, "erotic": 2, "farm": 1, "free": 1, "gamble": 2, "girls": 1, "hot": 1, "jackpot": 2, "loan": 2, "loans": 2, "lottery": 2,
    "naked": 2, "nude": 2, "offer": 1, "pills": 2, "poker": 2, "prize": 1, "promo": 1, "roulette": 2, "sex": 2, "sexy": 2, "slots": 2, "win": 1,
}


@dataclass(frozen=True)
class UrlPolicy:
    """``rules``: rule string to ``allow`` or ``block``."""

    rules: Mapping[str, str] = field(default_factory=dict)
    strict: tuple[str, ...] = STRICT_TERMS
    soft: Mapping[str, int] = field(default_factory=lambda: dict(SOFT_TERMS))
    soft_limit: int = 3
    soft_terms: int = 2


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(_LOWER), rest[cut:end]


class UrlJudge:
    """A policy compiled for one worker."""

    def __init__(self, policy: UrlPolicy):
        self.policy = policy
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule in policy.rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule))
        self.terms = ahocorasick.Automaton()
        for term in {*policy.strict, *policy.soft}:
            if term:
                self.terms.add_word(term, term)
        self.terms.make_automaton()
        self.strict = set(policy.strict)

    def rule_of(self, host: str, path: str) -> str | None:
        best, rest = None, host
        while rest:
            for prefix, rule in self.by_host.get(rest, ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best)):
                    best = rule
            rest = rest.partition(".")[2]
        return best

    def hits(self, url: str | None) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand free in the url."""
        strict: set[str] = set()
        soft: set[str] = set()
        text = (url or "").translate(_LOWER)
        if len(self.terms):
            for last, term in self.terms.iter(text):
                first = last - len(term) + 1
                if (first and text[first - 1].isalnum()) or (last + 1 < len(text) and text[last + 1].isalnum()):
                    continue
                (strict if term in self.strict else soft).add(term)
        return strict, soft

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        rule = self.rule_of(host, path)
        strict, soft = self.hits(url)
        weight = sum(self.policy.soft[t] for t in soft)
        said = self.policy.rules[rule] if rule is not None else ("block" if strict or (len(soft) >= self.policy.soft_terms and weight >= self.policy.soft_limit) else "allow")
        return host, path, rule, said, len(strict), weight


_SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_weight int"


def judge_urls(pages: DataFrame, policy: UrlPolicy, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, strict_hits, soft_weight``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        judge = UrlJudge(policy).judge
        for batch in batches:
            found = list(zip(*map(judge, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(found[i]), pa.string()) for i in range(4)), *(pa.array(list(found[i]), pa.int32()) for i in (4, 5))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_weight"],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInArrow(run, _SCHEMA)
