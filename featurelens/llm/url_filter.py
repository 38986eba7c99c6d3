"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over the url, with its verdict.  Two kinds are compiled to regular expressions:

* host rules (``host``, ``path``): fit the host and all its subdomains if the url's path starts with
  the rule's path;
* url patterns, as filter lists write them: ``||`` a host or subdomain of it, ``|`` an end of the url,
  ``^`` a separator or the end, ``*`` anything; case is ignored.

From each rule come its literal tokens (runs of ``[a-z0-9]``, lower-cased, that a url fitting the rule
must hold whole).  Spark counts in how many urls each of these tokens occurs, over the whole table,
and a rule is filed under its rarest one; rules without such a token are tried on every url.  A url
fetches the rules filed under its own tokens and only those run their expressions.  No shuffle of
urls: the rules are a parameter, at most ``MAX_RULES``, and travel with the task.

Verdict: of the host rules that fit, the longest (host and path; ties: allow, then the text's order);
if none fits, block where a url pattern fits, else allow.

* Nulls: of a null url, or one without ``://``, host and path are empty; a null url is allowed, one
  without ``://`` is still judged by the url patterns.
* Repeated rows are judged each; an empty table gives an empty result.  Input columns are kept;
  a column named like a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_ascii

MAX_RULES = 200_000
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def expression(self) -> str:
        return r"(?s)(?:[^/]*\.)?" + re.escape(self.host) + re.escape(self.path)

    def tokens(self) -> set[str]:
        # A path's end is open (/en/1 fits /en/12), so its last token counts only before a separator.
        return set(re.findall(TOKEN + r"(?![a-z0-9])(?=.)", (self.host + self.path).lower()))


@dataclass(frozen=True)
class UrlPattern:
    pattern: str
    verdict: str = "block"

    def expression(self) -> str:
        p, left, right = self.pattern, "", ""
        if p.startswith("||"):
            p, left = p[2:], r"[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
        elif p.startswith("|"):
            p, left = p[1:], ""
        else:
            left = ".*?"
        if p.endswith("|"):
            p, right = p[:-1], r"\Z"
        body = "".join({"*": ".*?", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c) or re.escape(c) for c in p)
        return "(?ais)" + left + body + right

    def tokens(self) -> set[str]:
        p = self.pattern.lower()
        found = set()
        for m in re.finditer(TOKEN, p):
            before, after = p[:m.start()], p[m.end():]
            if before and before[-1] != "*" and after and after[0] != "*":
                found.add(m[0])
        return found


#: The rules of the registered query; a deployment gives its own lists.
HOST_RULES = (HostRule("org", "/", "allow"), HostRule("example.org", "/es/", "block"),
              HostRule("example.org", "/en/1", "block"), HostRule("com", "/fr/", "allow"),
              HostRule("com", "/de/", "block"))
URL_PATTERNS = tuple(UrlPattern(p) for p in (
    "||ads.*^", "||adserver.", "||tracker.", "/adserver/", "/banner/", "/popup/", "/phishing/", "/malware/",
    "/casino/", "/porn/", "^utm_source=", "^clickid=", "^sessionid=", ".exe|", ".apk|"))


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    return fold_ascii(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    return F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, url_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many urls each of ``tokens`` occurs.  The result is as long as the list of rules."""
    if not tokens:
        return {}
    seen = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit(TOKEN), F.lit(0)))
    wanted = F.array(*[F.lit(t) for t in tokens]) if len(tokens) <= 500 else None
    rows = urls.where(F.col(url_col).isNotNull())
    if wanted is not None:
        rows = rows.select(F.explode(F.array_intersect(seen, wanted)).alias("t"))
    else:
        listed = urls.sparkSession.createDataFrame([(t,) for t in tokens], "t string")
        rows = rows.select(F.explode(seen).alias("t")).join(F.broadcast(listed), "t")  # bounded by MAX_RULES
    return {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: Sequence[HostRule | UrlPattern], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            tokens = rule.tokens()
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(rule)
            else:
                self.always.append(rule)
        self.compiled = {rule: re.compile(rule.expression()) for rule in rules}

    def candidates(self, url: str) -> list:
        found = list(self.always)
        for token in set(re.findall(TOKEN, url.lower())):
            found += self.by_token.get(token, ())
        return found

    def judge(self, url: str | None, host: str, path: str) -> tuple[str | None, str]:
        if url is None:
            return None, "allow"
        best, blocked = None, False
        for rule in self.candidates(url):
            if isinstance(rule, HostRule):
                if self.compiled[rule].match(host + path) and host_fits(rule, host, path):
                    rank = (-len(rule.text), rule.verdict != "allow", rule.text)
                    if best is None or rank < best[0]:
                        best = rank, rule
            elif not blocked:
                blocked = self.compiled[rule].match(url) is not None
        if best:
            return best[1].text, best[1].verdict
        return None, "block" if blocked else "allow"


def host_fits(rule: HostRule, host: str, path: str) -> bool:
    """The expression sees host and path joined; where the host ends is checked here."""
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def judge(urls: DataFrame, url_col: str = "url", host_rules: Sequence[HostRule] = HOST_RULES,
          patterns: Sequence[UrlPattern] = URL_PATTERNS) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (the host rule's text or null) and ``verdict``."""
    rules = [*host_rules, *patterns]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} travel with a task")
    tokens = sorted({t for r in rules for t in r.tokens()})
    index = RuleIndex(rules, token_counts(urls, url_col, tokens))
    url = F.col(url_col)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows = urls.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    out = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()),
                        T.StructField("verdict", T.StringType())])
    at = kept.index(url_col)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hosts, paths = (b.column(i).to_pylist() for i in (at, len(kept), len(kept) + 1))
            found = [index.judge(u, h, p) for u, h, p in zip(texts, hosts, paths, strict=True)]
            new = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "rule", "verdict"])

    return rows.mapInArrow(judged, out)
