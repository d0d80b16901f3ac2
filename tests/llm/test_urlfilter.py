"""The URL filter against a plain walk over each glob, and against the contract's rules written plainly."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import urlfilter as uf


def fits(glob, text):
    """Whether the glob takes the whole text, by the set of places in the glob that can be reached."""
    parts = re.findall(rb"\*\*|\\.|.", glob.encode(), re.DOTALL)
    close = lambda at: at | {j for i in at for j in range(i + 1, len(parts) + 1) if all(p in (b"*", b"**") for p in parts[i:j])}
    at = close({0})
    for c in text:
        c, new = bytes([c]), set()
        for i in at:
            p = parts[i] if i < len(parts) else None
            if p == b"**" or p == b"*" and c not in b"/?#":
                new.add(i)
            elif p == b"?" and c not in b"/?#" or p not in (b"*", b"**", b"?", None) and p[-1:] == c:
                new.add(i + 1)
        at = close(new)
    return len(parts) in at


def matching(automaton, texts):
    state = automaton.states(texts)
    return [{k for k, b in enumerate(automaton.ends) if int(row[b // 64]) >> b % 64 & 1} for row in state]


def check(globs, texts):
    assert matching(uf.Automaton(globs), texts) == [{k for k, g in enumerate(globs) if fits(g, t)} for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab/*?", max_size=8), min_size=1, max_size=30), st.lists(st.binary(max_size=10).map(lambda b: bytes(b"ab/?#"[x % 5] for x in b)), max_size=12))
def test_all_globs_at_once(globs, texts):
    check(globs, texts)


def test_rules_across_words_and_long_urls(monkeypatch):
    monkeypatch.setattr(uf, "LANE", 80)
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "*", "**", "?", "/", "abcab" * 4]) for _ in range(6)) for _ in range(30)]
    texts = ["".join(rng.choice("ab/") for _ in range(n)).encode() for n in (0, 1, 5, 63, 64, 65, 79, 80, 81, 200)] + [b"a" * 300, b"", b"abcab" * 20]
    check([*globs, "**", "*", "a" * 300, r"\*\?", "x\\"], [*texts, b"*?", b"x\\", "é/ü".encode()])


def plainly(url):
    """Host, path, rule and the canonical form, by string methods alone."""
    if url is None or "://" not in url:
        return "", "", None, ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    tail = rest[len(host) :]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match("[^?#]*", tail)[0]
    rules = [h + p for h, p, _ in uf.DOMAINS if (low == h or low.endswith("." + h)) and path.startswith(p)]
    return low, path, max(rules, key=len, default=None), "." + low + tail.split("#")[0]


URLS = [
    None, "", "net/", "http://", "https://net/", "https://net", "https://net?x=a.net/", "https://A.Example.NET/en/1", "https://example.net/EN/1", "https://xexample.net/en/", "ftp://example.com/de/x?y#z", "https://example.com/de",
    "http://www.example.org/fr/175069/", "http://org/fr/#/fr/", "http://anorg/fr/", "https://spam-farm.example.org/en/728?utm_source=feed", "https://a.com/?q=.net/", "https://a.com/x.net/y", "x://y://b.net/z", "https://B.CASINO.com/",
    "https://\u00c4.net/\u00df", "https://a.com/get.exe", "https://a.com/get.exe?x", "https://a.com/p?sessionid=1", "https://a.com/sessionid=1", "https://a.edu/spam", "https://a.net:80/", "https://a.com/\n/trackback/\n", "https://u@a.org/fr/", "https://" + "a" * 1500 + ".org/fr/" + "b" * 1500,
]


def test_verdicts(spark):
    rows = spark.createDataFrame([(k, u, "h", "r", "v", "c", 5) for k, u in enumerate(URLS)] + [(0, None, "h", "r", "v", "c", 5), (None, URLS[7], "h", "r", "v", "c", 5)], "page_id long, url string, host string, rule string, verdict string, _canonical string, _hit int")
    found = {r.page_id: r for r in uf.judge(rows).collect()}
    assert uf.judge(rows).count() == len(URLS) + 2
    says = {h + p: v for h, p, v in uf.DOMAINS} | dict(uf.GLOBS)
    allowed = set()
    for k, u in enumerate(URLS):
        host, path, rule, canonical = plainly(u)
        other = max((g for g, _ in uf.GLOBS if fits(g, canonical.encode())), key=len, default=None) if rule is None else None
        verdict = says.get(rule or other, "allow")
        assert tuple(found[k]) == (k, host, path, rule, verdict, other), u
        allowed |= {k} if verdict == "allow" else set()
    kept = uf.keep_allowed(rows)
    assert kept.columns == rows.columns and {r.page_id for r in kept.collect()} == allowed | {None}
    assert kept.where(F.col("page_id").isNull()).first().url == URLS[7]


def test_no_rows_and_other_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge(empty).count() == 0 and uf.keep_allowed(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert uf.judge(one, (("b", "/", "block"), ("a.b", "/", "allow")), ()).first().rule == "a.b/"
    assert uf.judge(one, (), (("**", "block"),)).first().verdict == "block"
