"""URL filters: rules indexed by their rarest literal token.

Each rule's pattern is cut into literal tokens that any matching URL must
hold as whole tokens.  The index files the rule under the one that the fewest
URLs of the corpus hold.  A URL's tokens fetch candidate rules, and regular
expressions run for those only.  Rules without a usable token are candidates
everywhere, so the result never depends on the index.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import checkpointed, own_name

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_TOKEN = re.compile(r"[a-z0-9]+")
_HOST_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
#: So many rules make one index.  More are judged block by block, one after
#: another, so what a worker holds has a bound whatever the number of rules.
BLOCK = 50_000


@dataclass(frozen=True)
class Rule:
    """``kind`` "prefix": ``pattern`` is a host, which stands for its
    subdomains too, and the path's beginning.  ``kind`` "pattern": ``*`` stands
    for any text, ``^`` for a separator or the end, ``||`` at the start for the
    beginning of the host or one of its labels, ``|`` at either side for
    the URL's start (the host) or end; case doesn't count.
    """

    pattern: str
    verdict: str
    kind: str = "pattern"


#: Host and path rules; the longest that fits decides.
PREFIX_RULES = (
    Rule("com/", "allow", "prefix"),
    Rule("example.com/en/", "block", "prefix"),
    Rule("www.example.com/en/", "allow", "prefix"),
    Rule("net/es/", "block", "prefix"),
    Rule("net/fr/", "block", "prefix"),
)
#: Where no prefix rule fits: an allowing pattern wins over blocking ones,
#: and what none matches is allowed.
PATTERN_RULES = (
    # advertising and counting
    *(Rule(p, "block") for p in (
        "||ad.", "||ads.", "||adserver.", "||adservice.", "||advert.", "||analytics.", "||banner.", "||beacon.", "||click.", "||clicks.", "||counter.", "||metrics.",
        "||pixel.*/collect^", "||popads.", "||stats.", "||tag.*/collect^", "||telemetry.", "||track.", "||tracker.", "||tracking.",
        "/ad/*", "/ads/*", "/adclick^", "/adframe^", "/adserver/*", "/affiliate/*", "/banner/*.gif", "/banners/*", "/doubleclick/*", "/impression^", "/popunder^", "/popup/*", "/sponsor/*",
        "?utm_source=*&utm_campaign=*", "?gclid=*", "?fbclid=*",
    )),
    # pages behind a login, baskets, searches and sessions
    *(Rule(p, "block") for p in (
        "/login^", "/log-in^", "/signin^", "/sign-in^", "/signup^", "/sign-up^", "/logout^", "/register^", "/password/*", "/account/*", "/cart^", "/basket^", "/checkout^", "/wishlist^",
        "/search?q=*", "/search?query=*", "?sessionid=*", "?phpsessid=*", "?jsessionid=*", "?sid=*&token=*", "&sid=*&token=*", "/calendar/*?month=*", "?replytocom=*", "?sort=*&page=*",
    )),
    # software's own addresses
    *(Rule(p, "block") for p in (
        "/wp-login.php", "/wp-admin/*", "/wp-json/*", "/xmlrpc.php", "/cgi-bin/*", "/print/*?print=1", "/phpmyadmin/*", "/administrator/*", "/feed/*|", "/trackback/|", "/.git/*", "/.env|",
    )),
    Rule("||docs.*/login^", "allow"),
    Rule("||doc.*/login^", "allow"),
    Rule("/robots.txt|", "allow"),
    Rule("/sitemap.xml|", "allow"),
)
DEFAULT = "allow"


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """Rules from a list in the common text form: one pattern a line, ``@@`` before what is allowed.

    Comments (``!``, ``#`` and a space, ``[``), rules for page elements
    (``##`` and the like), expressions between slashes and rules with options
    (``$``), which say when a rule counts and can't be judged by the url, are left out.
    """
    out = []
    for line in lines:
        line = line.strip()
        allowed = line.startswith("@@")
        pattern = line[2:] if allowed else line
        if not pattern or pattern[0] in "![" or pattern.startswith("# ") or re.search(r"#@?[#?$]", pattern) or "$" in pattern:
            continue
        if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
            continue
        out.append(Rule(pattern, "allow" if allowed else "block"))
    return out


def expression(rule: Rule) -> re.Pattern:
    """A regular expression over host + rest of the URL."""
    p = rule.pattern
    if rule.kind == "prefix":
        return re.compile(r"(?:[^/?#]*\.)?" + re.escape(p), re.DOTALL)
    start = ".*"
    if p.startswith("||"):
        start, p = r"(?:[^/?#]*\.)?", p[2:]
    elif p.startswith("|"):
        start, p = "", p[1:]
    end = ""
    if p.endswith("|"):
        end, p = r"\Z", p[:-1]
    body = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%\-]|\Z)"}.get(c) or re.escape(c) for c in p)
    return re.compile(start + body + end, re.DOTALL | re.IGNORECASE | re.ASCII)


def literal_tokens(rule: Rule) -> set[str]:
    """Tokens that every URL matched by ``rule`` holds whole."""
    p, anchored, closed = rule.pattern.translate(_LOWER), rule.kind == "prefix", False
    if rule.kind == "pattern":
        anchored = p.startswith("|")
        p = p.lstrip("|")
        closed = p.endswith("|")
        p = p[:-1] if closed else p
    out = set()
    for m in _TOKEN.finditer(p):
        left = p[m.start() - 1] != "*" if m.start() else anchored
        right = p[m.end()] != "*" if m.end() < len(p) else closed
        # a non-ASCII neighbour is no token character either, so it bounds as any sign does
        if left and right:
            out.add(m[0])
    return out


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host with A-Z lower-cased, path, and everything after the host."""
    if not url or "://" not in url:
        return "", "", ""
    rest = url.partition("://")[2]
    m = _HOST_END.search(rest)
    at = m.start() if m else len(rest)
    tail = rest[at:]
    q = _PATH_END.search(tail)
    return rest[:at].translate(_LOWER), tail[: q.start()] if q else tail, tail


def url_tokens(url: str | None) -> set[str]:
    host, _, tail = split_url(url)
    return set(_TOKEN.findall(host + tail.translate(_LOWER)))


def token_counts(urls: DataFrame, url_col: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens stands; one row per token comes back.

    A token of the scheme counts too; that moves a rule's place in the index
    at most, never a result.
    """
    wanted = sorted(set(tokens))
    if not wanted:
        return {}
    lowered = F.translate(F.col(f"`{url_col}`"), string.ascii_uppercase, string.ascii_lowercase)
    held = urls.select(F.explode(F.array_distinct(F.split(lowered, "[^a-z0-9]+"))).alias("t"))
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
    # counted first, so that a hot token is one row of the join
    return {r[0]: r[1] for r in held.groupBy("t").count().join(asked, "t").collect()}


def build_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule places by rarest token (ties: first in order), and those without one."""
    index: dict[str, list[int]] = {}
    always: list[int] = []
    for i, r in enumerate(rules):
        tokens = literal_tokens(r)
        if tokens:
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


@lru_cache(maxsize=1 << 16)
def _compiled(rule: Rule) -> re.Pattern:
    return expression(rule)


def match(url: str | None, rules: Sequence[Rule], index: dict[str, list[int]], always: Sequence[int]) -> tuple[Rule | None, Rule | None, int]:
    """The longest prefix rule and the deciding pattern rule, and how many candidates were tried."""
    host, _, tail = split_url(url)
    target = host + tail
    found = list(always)
    for t in url_tokens(url) if target else ():
        found += index.get(t, ())
    best: dict[str, Rule | None] = {"prefix": None, "pattern": None}
    for i in sorted(found) if target else ():
        r = rules[i]
        if _compiled(r).match(target) and (best[r.kind] is None or _rank(r) > _rank(best[r.kind])):
            best[r.kind] = r
    return best["prefix"], best["pattern"], len(found)


def _rank(r: Rule) -> tuple:
    return (r.kind == "pattern" and r.verdict == "allow", len(r.pattern), r.pattern)


_FOUND = T.StructType([
    T.StructField(n, t) for n, t in (
        ("host", T.StringType()), ("path", T.StringType()),
        ("prefix_len", T.IntegerType()), ("prefix", T.StringType()), ("prefix_verdict", T.StringType()),
        ("allows", T.IntegerType()), ("pattern_len", T.IntegerType()), ("pattern", T.StringType()), ("candidates", T.IntegerType()),
    )
])


def _matcher(sent):
    """A function of a url column over one broadcast block of rules."""
    kinds = pa.struct([(f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in _FOUND])

    @F.arrow_udf(_FOUND)
    def found(urls: pa.Array) -> pa.Array:
        rules, index, always = sent.value
        rows = []
        for u in urls.to_pylist():
            host, path, _ = split_url(u)
            a, b, n = match(u, rules, index, always)
            rows.append({
                "host": host, "path": path, "candidates": n,
                "prefix_len": len(a.pattern) if a else -1, "prefix": a and a.pattern, "prefix_verdict": a and a.verdict,
                "allows": -1 if b is None else int(b.verdict == "allow"), "pattern_len": len(b.pattern) if b else -1, "pattern": b and b.pattern,
            })
        return pa.array(rows, type=kinds)

    return found


def judge(pages: DataFrame, rules: Sequence[Rule] = PREFIX_RULES + PATTERN_RULES, url_col: str = "url", default: str = DEFAULT, block: int = BLOCK) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``pattern``, ``candidates``.

    Null and empty urls and those without ``://`` have empty host and path,
    match no rule and get the default; urls of any length are judged whole.
    Of equally long rules the greater in code points decides, whatever their
    order.  Repeated rows get a row each, an empty table gives an empty one.
    Columns of ``pages`` with one of these names are replaced.  No shuffle of
    rows: the index travels to them.  With several blocks of rules the rows and
    what each block found are written between the blocks, so a worker holds
    one block's index and expressions at a time.
    """
    spark = pages.sparkSession
    counts = token_counts(pages, url_col, set().union(*map(literal_tokens, rules))) if rules else {}
    names = ["host", "path", "rule", "verdict", "pattern", "candidates"]
    blocks = [rules[i : i + block] for i in range(0, len(rules), block)] or [()]
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    now, old = own_name(pages, "found__", "best__")
    merged = lambda names, a, b: F.greatest(F.struct(*[F.col(f"{a}.{x}").alias(x) for x in names]), F.struct(*[F.col(f"{b}.{x}").alias(x) for x in names]))
    by_prefix, by_pattern = ("prefix_len", "prefix", "prefix_verdict"), ("allows", "pattern_len", "pattern")
    out = pages
    for i, part in enumerate(blocks):
        sent = spark.sparkContext.broadcast((tuple(part), *build_index(part, counts)))
        out = out.withColumn(now, _matcher(sent)(F.col(f"`{url_col}`")))
        if i:
            a, b = merged(by_prefix, now, old), merged(by_pattern, now, old)
            tried = F.col(f"{now}.candidates") + F.col(f"{old}.candidates")
            best = F.struct(F.col(f"{now}.host").alias("host"), F.col(f"{now}.path").alias("path"), *[a[x].alias(x) for x in by_prefix], *[b[x].alias(x) for x in by_pattern], tried.alias("candidates"))
            out = out.withColumn(now, best)
        if len(blocks) > 1:
            out = checkpointed(out.drop(old).withColumnRenamed(now, old))
            sent.destroy()
    best = now if len(blocks) == 1 else old
    verdict = F.when(F.col(f"{best}.allows") == 1, "allow").when(F.col(f"{best}.allows") == 0, "block").otherwise(default)
    return out.select(
        *kept, F.col(f"{best}.host").alias("host"), F.col(f"{best}.path").alias("path"), F.col(f"{best}.prefix").alias("rule"), F.coalesce(F.col(f"{best}.prefix_verdict"), verdict).alias("verdict"),
        F.when(F.col(f"{best}.prefix").isNull(), F.col(f"{best}.pattern")).alias("pattern"), F.col(f"{best}.candidates").alias("candidates"),
    )
