"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over the URL. The literal tokens that any matching
URL must hold whole are read from the pattern; the rule is filed under the one that
the fewest URLs hold. A URL's tokens fetch the candidate rules, and only those run
their expressions. Rules without such a token are candidates for every URL. Host and
path rules are filed in the same way, by their rarest label or path segment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import extended, free_name, read, texts

TOKEN = re.compile(r"[a-z0-9]+")
#: Rules that are broadcast at once. More of them are held against the URLs in several passes, which hand on the best rule so far.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host/path`` with the host lower-cased; ``name`` is reported, and of the rules that fit the longest name wins."""

    verdict: str
    name: str
    pattern: str

    @classmethod
    def site(cls, verdict: str, host_path: str) -> Rule:
        """A rule like ``example.net/en/``: that host and all its subdomains, and paths that start so."""
        host, _, path = host_path.partition("/")
        return cls(verdict, host_path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}")


#: The rules of the contract's query.
SITES = (Rule.site("block", "net/"), Rule.site("allow", "example.net/en/"), Rule.site("block", "example.com/de/"), Rule.site("allow", "org/fr/"))
#: Patterns held against URLs that no site rule fits: pages that are never prose.
PAGES = (
    Rule("block", "login page", r"/(?:login|signin|signup|logout)(?:[/.]|$)"),
    Rule("block", "shop page", r"/(?:cart|checkout|basket)(?:[/.]|$)"),
    Rule("block", "ad server", r"^(?:[^/]*\.)?doubleclick\.net/"),
)


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every match holds whole: literal runs outside groups, classes and repeats, with a literal separator or an anchor on both sides."""
    # Groups, classes and repeats become a mark that may be any characters, so a run beside one is not known to be whole.
    flat, depth, i, spans = [], 0, 0, pattern.lower()
    if "|" in re.sub(r"\\.|\((?:[^()\\]|\\.)*\)", "", spans):
        return set()  # alternatives at the top: no token is in all of them
    while i < len(spans):
        c = spans[i]
        if c == "\\" and i + 1 < len(spans):
            if not depth:
                flat.append("\0" if spans[i + 1].isalnum() else spans[i + 1])
            i += 2
            continue
        if c == "[":
            close = spans.find("]", i + 2)
            i = len(spans) if close < 0 else close + 1
            if not depth:
                flat.append("\0")
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                flat.append("\0")
        elif not depth:
            if c in "*?+{":
                if flat:
                    flat[-1] = "\0"
                if c == "{":
                    i = spans.find("}", i)
                flat.append("\0")
            elif c == ".":
                flat.append("\0")
            elif c == "^":
                flat.append("/")
            elif c == "$":
                flat.append("/")
            else:
                flat.append(c)
        i += 1
    text = "".join(flat)
    found = set()
    for m in TOKEN.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before and after and before != "\0" and after != "\0":
            found.add(m[0])
    return found


def _label_tokens(rule: Rule) -> set[str]:
    """For a rule made by :meth:`Rule.site`, its labels and whole path segments; else the pattern's tokens."""
    if rule.pattern.startswith(r"^(?:[^/]*\.)?") and rule == Rule.site(rule.verdict, rule.name):
        host, _, path = rule.name.lower().partition("/")
        whole = path if not path or not TOKEN.fullmatch(path[-1]) else "".join(re.split(r"([^a-z0-9])", path)[:-1])
        return set(TOKEN.findall(host)) | set(TOKEN.findall(whole))
    return literal_tokens(rule.pattern)


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def file_rules(rules: tuple[Rule, ...], urls_with: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; under "" those without one."""
    filed: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        tokens = _label_tokens(rule)
        filed.setdefault(min(tokens, key=lambda t: (urls_with.get(t, 0), -len(t), t)) if tokens else "", []).append(i)
    return filed


def token_counts(df: DataFrame, url_column: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """For each token of the rules, the number of URLs that hold it: a count over all rows, with as many results as the rules have tokens."""
    known = sorted({t for r in rules for t in _label_tokens(r)})
    if not known:
        return {}
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(url_column).cast("string"), F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    tokens = df.select(F.explode(held).alias("token"))
    asked = df.sparkSession.createDataFrame([(t,) for t in known], "token string")
    return {r["token"]: r["count"] for r in tokens.join(F.broadcast(asked), "token", "left_semi").groupBy("token").count().collect()}


def judge_urls(df: DataFrame, url_column: str = "url", sites: tuple[Rule, ...] = SITES, pages: tuple[Rule, ...] = PAGES, otherwise: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """``df`` with host, path, rule, pattern and verdict.

    ``rule`` is the longest site rule that fits (ties: the first in order), else
    null; ``pattern`` the longest page pattern. The verdict is the rule's, else the
    pattern's, else ``otherwise``. A null URL, an empty one or one without ``://``
    has an empty host and path, which no site rule fits. URLs of any length are read whole;
    repeated rows are judged each by themselves and alike; an empty table gives an empty result.
    New columns whose names are taken get underscores in front. Any number of rules is held
    against the URLs, ``most_rules`` of them in a pass.
    """
    names = [free_name(df.columns, n) for n in ("host", "path", "rule", "pattern", "verdict")]
    schema = extended(df, *((n, "string") for n in names))
    width = len(df.columns)
    rules = [(r, True) for r in sites] + [(r, False) for r in pages]
    out = df
    for at in range(0, max(1, len(rules)), most_rules):
        some = rules[at : at + most_rules]
        out = out.mapInArrow(_judge(df, url_column, tuple(some), otherwise, schema.names, width, at == 0), schema)
    return out


def _judge(df: DataFrame, url_column: str, rules: tuple[tuple[Rule, bool], ...], otherwise: str, names: list[str], width: int, first: bool):
    """One pass: rows without (``first``) or with the columns that the passes before filled."""
    only = tuple(r for r, _ in rules)
    filed = file_rules(only, token_counts(df, url_column, only))
    shared = df.sparkSession.sparkContext.broadcast((rules, filed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, filed = shared.value
        compiled: dict[int, re.Pattern] = {}
        always = filed.get("", [])
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            before = [[None] * b.num_rows] * 3 if first else [b.column(width + k).to_pylist() for k in (2, 3, 4)]
            for url, *(rule, page, verdict) in zip(texts(b, url_column).to_pylist(), *before, strict=True):
                host, path = split_url(url)
                target = f"{host}{path}"
                best: list[str | None] = [rule, page]
                taken: dict[int, int] = {}  # the numbers of the best rules, where this pass found them
                for i in [*always, *(i for t in {*TOKEN.findall(target.lower())} & filed.keys() for i in filed[t])]:
                    own, site = rules[i]
                    kind, now = (0, best[0]) if site else (1, best[1])
                    # the longest name wins, of equal ones the first in order; candidates come in any order
                    if now is not None and (len(now) > len(own.name) or (len(now) == len(own.name) and taken.get(kind, -1) < i)):
                        continue
                    if site and not host:
                        continue
                    if i not in compiled:
                        compiled[i] = re.compile(own.pattern)
                    if compiled[i].search(target):
                        best[kind], taken[kind] = own.name, i
                        if site or best[0] is None:
                            verdict = own.verdict
                for column, value in zip(out, (host, path, *best, verdict if verdict is not None else otherwise), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(c, pa.string()) for c in out)], names=names)

    return run


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "pattern", "verdict")


QUERIES = {"op10_url_filter": op10_url_filter}
ORACLE_SQL = {
    "op10_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
     r AS (SELECT *, CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                          WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                          WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                          WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
                     CASE WHEN regexp_matches(host || path, '/(login|signin|signup|logout)([/.]|$)') THEN 'login page'
                          WHEN regexp_matches(host || path, '/(cart|checkout|basket)([/.]|$)') THEN 'shop page'
                          WHEN regexp_matches(host || path, '^([^/]*\.)?doubleclick\.net/') THEN 'ad server' END AS pattern FROM h)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
}
