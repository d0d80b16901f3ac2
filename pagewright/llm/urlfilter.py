"""Wildcard rules over URLs, all simulated at once by a bit-parallel automaton.

Every rule is a glob over the canonical URL; the globs' positions are packed one after another into the bits of several
64-bit words. One step reads one byte of a URL and moves all positions of all rules (extended Shift-And: shift, mask
of positions that take the byte, mask of wildcards that stay). A batch of URLs runs side by side, sorted by length; URLs of
more than ``LANE`` bytes run by themselves on integers of any width, with the same masks.

Globs: ``*`` is any run without ``/``, ``?`` and ``#``; ``**`` any run; ``?`` one byte other than those three;
a backslash takes the next byte as it stands, and all else stands for itself.
The canonical URL is a dot, the host with A-Z in lower case, the path and the query; scheme and fragment are left out. A
domain rule (host, path) becomes the glob ``*.host`` + path + ``**``, so it fits the host and all subdomains. Of the domain
rules that fit, the longest decides; if none does, the longest of the other globs; if none does either, the URL is allowed.
Equally long rules: the first in the list.

Nulls: a null URL, and one without ``://``, has an empty host, path and canonical form; no domain rule fits it. Empty and
very long URLs are read whole. Repeated rows each get a row. Other columns are ignored by `judge` and come back from
`keep_allowed`, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named

#: Domain rules: (host, path, verdict).
DOMAINS = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Other rules: (glob, verdict).
GLOBS = (
    ("*spam*/**", "block"), ("*casino*/**", "block"), ("*.xxx/**", "block"), ("**/wp-login.php**", "block"), ("**/trackback/**", "block"), (r"**\?**sessionid=**", "block"), ("**/*.exe", "block"),
    ("*.edu/**", "allow"), ("*.gov/**", "allow"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANE = 2048
_STOPS = b"/?#"


def _positions(glob: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the start and each position of the glob: the bytes it takes, and those on which it stays."""
    none, every = np.zeros(256, dtype=bool), np.ones(256, dtype=bool)
    part = every.copy()
    part[list(_STOPS)] = False
    takes, stays = [none], [none.copy()]
    text, k = glob.encode(), 0
    while k < len(text):
        if text[k : k + 2] == b"**":
            stays[-1] = every
            k += 2
            continue
        if text[k] == ord("*"):
            stays[-1] = stays[-1] | part
        else:
            one = part
            if text[k] != ord("?"):
                k += text[k] == ord("\\") and k + 1 < len(text)
                one = none.copy()
                one[text[k]] = True
            takes.append(one)
            stays.append(none.copy())
        k += 1
    return takes, stays


class Automaton:
    """The packed globs. Bits of a rule lie side by side, whatever word they fall into."""

    def __init__(self, globs: list[str]):
        takes, stays, starts, self.ends = [], [], [], []
        for glob in globs:
            starts.append(len(takes))
            t, s = _positions(glob)
            takes += t
            stays += s
            self.ends.append(len(takes) - 1)
        self.words = max(1, -(-len(takes) // 64))
        self.takes, self.stays = self._pack(takes), self._pack(stays)
        self.start = np.zeros(self.words, dtype=np.uint64)
        for b in starts:
            self.start[b // 64] |= np.uint64(1 << b % 64)
        self.rule_at = {b: k for k, b in enumerate(self.ends)}
        wide = lambda m: [int.from_bytes(row.astype("<u8").tobytes(), "little") for row in m]
        self.wide_takes, self.wide_stays, self.wide_start = wide(self.takes), wide(self.stays), wide(self.start[None])[0]

    def _pack(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((256, self.words), dtype=np.uint64)
        for b, column in enumerate(columns):
            out[column, b // 64] |= np.uint64(1 << b % 64)
        return out

    def states(self, texts: list[bytes]) -> np.ndarray:
        """The words of active positions after each text."""
        n = len(texts)
        state = np.repeat(self.start[None], n, axis=0)
        size = np.array([len(t) for t in texts], dtype=np.int64)
        for k in np.flatnonzero(size > LANE):
            d = self.wide_start
            for c in texts[k]:
                d = (d << 1) & self.wide_takes[c] | d & self.wide_stays[c]
            state[k] = np.frombuffer(d.to_bytes(self.words * 8, "little"), dtype="<u8")
        short = np.flatnonzero(size <= LANE)
        order = short[np.argsort(-size[short], kind="stable")]
        if len(order):
            size = size[order]
            wide = np.zeros((len(order), max(1, int(size[0]))), dtype=np.uint8)
            filled = np.arange(wide.shape[1]) < size[:, None]
            wide[filled] = np.frombuffer(b"".join([texts[k] for k in order]), dtype=np.uint8)
            d = state[order]
            for k in range(int(size[0])):
                m = int(np.searchsorted(-size, -k, side="left"))  # those that are longer than k
                c, before = wide[:m, k], d[:m]
                moved = before << np.uint64(1)
                moved[:, 1:] |= before[:, :-1] >> np.uint64(63)
                d[:m] = moved & self.takes[c] | before & self.stays[c]
            state[order] = d
        return state

    def best(self, texts: list[bytes], order: np.ndarray) -> np.ndarray:
        """Per text the rule of the least place in ``order`` among those that match, else -1."""
        place = np.full(len(texts), len(self.ends), dtype=np.int64)
        state = self.states(texts)
        for w in range(self.words):
            bits = [b for b in self.ends if b // 64 == w]
            mask = np.uint64(sum(1 << b % 64 for b in bits))
            rows = np.flatnonzero(state[:, w] & mask)
            for b in bits if len(rows) else ():
                hit = rows[(state[rows, w] >> np.uint64(b % 64) & np.uint64(1)).astype(bool)]
                place[hit] = np.minimum(place[hit], order[self.rule_at[b]])
        back = np.append(np.argsort(order), -1)
        return back[place]


def _longest_first(sizes: list[int]) -> np.ndarray:
    order = np.empty(len(sizes), dtype=np.int64)
    order[np.argsort(-np.array(sizes), kind="stable")] = np.arange(len(sizes))
    return order


@functools.lru_cache(maxsize=4)
def _compiled(domains: tuple, globs: tuple) -> tuple[Automaton, np.ndarray]:
    """One automaton of all rules; domain rules come before all others."""
    rules = [f"*.{host}{path}**" for host, path, _ in domains] + [g for g, _ in globs]
    first = _longest_first([len(h + p) for h, p, _ in domains])
    rest = _longest_first([len(g) for g, _ in globs]) + len(domains)
    return Automaton(rules), np.concatenate([first, rest])


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and canonical form."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, UPPER, LOWER)
    tail = F.substring(rest, F.length(raw) + 1, F.length(rest))
    canonical = F.when(at > 0, F.concat(F.lit("."), host, F.regexp_extract(tail, "^[^#]*", 0))).otherwise("")
    return host, F.regexp_extract(tail, "^[^?#]*", 0), canonical


def matched(canonical: Column, domains: tuple = DOMAINS, globs: tuple = GLOBS) -> Column:
    """The deciding rule of each canonical URL, as its place among domain rules and globs; null if none fits."""

    @F.arrow_udf("int")
    def match(urls: pa.Array) -> pa.Array:
        automaton, order = _compiled(domains, globs)
        out = automaton.best([u.encode() for u in urls.to_pylist()], order)
        return pa.array(out, pa.int32(), mask=out < 0)

    return match(canonical)


def judge(pages: DataFrame, domains: tuple = DOMAINS, globs: tuple = GLOBS) -> DataFrame:
    """Per page page_id, host, path, rule (the domain rule that decides), verdict (allow or block), other (the glob that decides where none does)."""
    host, path, canonical = url_parts(F.col("url"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), canonical.alias("canonical"))
    found = found.withColumn("hit", matched(F.col("canonical"), domains, globs))
    rules = F.get(F.array(*[F.lit(h + p) for h, p, _ in domains], *[F.lit(g) for g, _ in globs]), F.col("hit"))
    says = F.get(F.array(*[F.lit(v) for *_, v in domains], *[F.lit(v) for _, v in globs]), F.col("hit"))
    own = F.col("hit") < len(domains)
    return found.select("page_id", "host", "path", F.when(own, rules).alias("rule"), F.coalesce(says, F.lit("allow")).alias("verdict"), F.when(~own, rules).alias("other"))


def keep_allowed(pages: DataFrame, domains: tuple = DOMAINS, globs: tuple = GLOBS) -> DataFrame:
    """The rows of pages, all columns, that no rule blocks."""
    url = fresh("canonical", pages)
    held = pages.select(*named(pages), url_parts(F.col("url"))[2].alias(url))
    hit = fresh("hit", held)
    blocked = [k for k, v in enumerate([*[v for *_, v in domains], *[v for _, v in globs]]) if v == "block"]
    return held.withColumn(hit, matched(F.col(url), domains, globs)).where(F.col(hit).isNull() | ~F.col(hit).isin(blocked)).select(*named(pages))
