"""URL filters: domain rules, and pattern rules that are looked up by their rarest literal token."""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules are configuration: their number is bounded, so that they can be sent to all tasks.
MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class DomainRule:
    """Fits a host and its subdomains where the path begins with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression searched for in the URL with A-Z lower-cased."""

    name: str
    pattern: str


def parse_filters(lines: Iterable[str]) -> list[PatternRule]:
    """Pattern rules from lines in the usual syntax of filter lists, each named by its line.

    `||` begins at a host or one of its labels, `|` at the URL's beginning or end; `*` is any run, `^` a character that is no letter, digit, `_`, `-`,
    `.` or `%`, or the end; `/…/` is a regular expression. Lines that are empty or begin with `!` or `[` are comments. Exceptions, options
    and element rules (`@@`, `$`, `##`) are not URL patterns and raise ValueError.
    """
    out = []
    for line in map(str.strip, lines):
        if not line or line[0] in "![":
            continue
        if line.startswith("@@") or "##" in line or "#@#" in line or re.search(r"\$[a-z~,=|-]+$", line):
            raise ValueError(f"not a URL pattern: {line}")
        if len(line) > 2 and line[0] == line[-1] == "/":
            out.append(PatternRule(line, line[1:-1]))
            continue
        rest, head, tail = line.lower(), "", ""
        if rest.startswith("||"):
            rest, head = rest[2:], r"://(?:[^/?#]*\.)?"
        elif rest.startswith("|"):
            rest, head = rest[1:], "^"
        if rest.endswith("|"):
            rest, tail = rest[:-1], "$"
        body = "".join({"*": ".*", "^": r"(?:[^0-9a-z_.%-]|$)"}.get(c) or re.escape(c) for c in rest.strip("*"))
        out.append(PatternRule(line, head + body + tail))
    return out


def literal_tokens(pattern: str) -> list[str]:
    """Tokens ([0-9a-z]+, whole) that any text that the pattern matches must hold.

    A token counts if the pattern has it as literal characters in sequence with a literal or class of other characters, or a word
    boundary, on either side; what stands in alternatives, optional parts or look-arounds doesn't count.
    """
    found, run, whole = set(), "", False

    def end(closed: bool) -> None:
        nonlocal run, whole
        if run and whole and closed:
            found.add(run)
        run, whole = "", closed

    def outside(item) -> bool:
        """Whether an item matches exactly one character that is none of a token's, or a boundary."""
        op, arg = item
        if op is ops.LITERAL:
            return not TOKEN.fullmatch(chr(arg))
        if op is ops.IN:
            return all(o is ops.LITERAL and not TOKEN.fullmatch(chr(a)) for o, a in arg)
        return op is ops.AT and arg in (ops.AT_BEGINNING_STRING, ops.AT_BEGINNING, ops.AT_END_STRING)

    def ends_outside(items) -> bool:
        op, arg = items[-1]
        return ends_outside(arg[3]) if op is ops.SUBPATTERN else outside(items[-1])

    def walk(items) -> None:
        nonlocal run
        for item in items:
            op, arg = item
            if op is ops.LITERAL and TOKEN.fullmatch(chr(arg)):
                run += chr(arg)
            elif op is ops.SUBPATTERN and not arg[1] and not arg[2]:
                walk(arg[3])
            elif op is ops.MAX_REPEAT and arg[0] >= 1 and len(arg[2]) == 1 and outside(arg[2][0]):
                end(True)
            elif op is ops.MAX_REPEAT and not run and whole and ends_outside(arg[2]):
                pass  # an optional part between a boundary and what follows that itself ends with one
            else:
                end(outside(item))

    walk(parser.parse(pattern))
    end(False)
    return sorted(found)


def split_url(url) -> tuple[F.Column, F.Column]:
    """host and path: host is what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path goes on up to ? or # or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


class Filter:
    """Rules with their indexes: domain rules by host, pattern rules by one token each."""

    def __init__(self, domains: list[DomainRule], patterns: list[PatternRule], counts: dict[str, int]):
        self.domains: dict[str, list[DomainRule]] = {}
        for r in domains:
            self.domains.setdefault(r.host, []).append(r)
        self.index: dict[str, list[tuple[int, str, re.Pattern]]] = {}
        self.always = []
        for i, r in enumerate(patterns):
            tokens = literal_tokens(r.pattern)
            entry = (i, r.name, re.compile(r.pattern))
            if tokens:
                self.index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)
        self.lower = str.maketrans(UPPER, LOWER)

    def domain(self, host: str, path: str) -> DomainRule | None:
        """The longest of the rules that fit; of rules equally long the later one."""
        best, name = None, host
        while name:
            for r in self.domains.get(name, ()):
                if path.startswith(r.path) and (best is None or len(r.name) >= len(best.name)):
                    best = r
            name = name.partition(".")[2]
        return best

    def pattern(self, url: str) -> tuple[str | None, int]:
        """The first of the pattern rules that match, and how many regular expressions were run."""
        url = url.translate(self.lower)
        candidates = [e for t in set(TOKEN.findall(url)) for e in self.index.get(t, ())] + self.always
        ran = 0
        for _, name, regex in sorted(candidates, key=lambda e: e[0]):
            ran += 1
            if regex.search(url):
                return name, ran
        return None, ran


def token_counts(urls: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """How many of all URLs hold each of the rules' tokens; the driver gets a number for each token at most."""
    lowered = F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    found = urls.select(F.explode(F.array_distinct(F.split(lowered, "[^0-9a-z]+"))).alias("t")).where(F.col("t").isin(tokens) if tokens else F.lit(False))
    return {r[0]: r[1] for r in found.groupBy("t").count().collect()}


def url_verdicts(pages: DataFrame, domains: list[DomainRule], patterns: list[PatternRule], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern, regexes of each row of pages.

    verdict is that of the domain rule that fits (rule names it; the longest wins). Where none fits, a URL that a pattern rule matches is
    blocked (pattern names the first that does) and any other is allowed. Each pattern rule is listed under the rarest of its literal
    tokens, as counted over all URLs; only rules listed under a token of the URL have their regular expression run (regexes says how
    many), besides those without a literal token, which always run.

    A null URL, or one without ://, has an empty host and path; pattern rules see it all the same (null as empty). Repeated rows and null page_ids
    are each returned; other columns are not read. An empty table gives an empty result. Each row is judged where it is: nothing is shuffled.
    """
    if len(domains) + len(patterns) > MOST_RULES:
        raise ValueError(f"there are more than {MOST_RULES} rules")
    tokens = sorted({t for r in patterns for t in literal_tokens(r.pattern)})
    rules = (domains, patterns, token_counts(pages, url, tokens))
    sent = pages.sparkSession.sparkContext.broadcast(rules)
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(url), F.lit("")).alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(*sent.value)
        for b in batches:
            hosts, paths, urls = (b.column(i).to_pylist() for i in (1, 2, 3))
            rule, verdict, pattern, ran = [], [], [], []
            for h, p, u in zip(hosts, paths, urls, strict=True):
                r = f.domain(h, p)
                name, n = (None, 0) if r else f.pattern(u)
                rule.append(r.name if r else None)
                verdict.append(r.verdict if r else "block" if name else "allow")
                pattern.append(name)
                ran.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(pattern, pa.string()), pa.array(ran, pa.int32())], names=["page_id", "host", "path", "rule", "verdict", "pattern", "regexes"])

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string, pattern string, regexes int")
