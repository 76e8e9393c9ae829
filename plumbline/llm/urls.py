"""URL rules by a bit-parallel wildcard automaton.

All glob rules are packed into one row of bits over 64-bit words, one bit for
each literal character. Shift-And moves all of them on by one character of the
URL at once: shift, mask by the character, and keep those bits that stand
before a wildcard. The automaton reads many URLs side by side, so a step is a
few vector operations for a whole block of them; a URL of over LONG_URL bytes is
read by itself, its state one integer of as many bits, which costs a few
microseconds a byte however long it is.

The canonical URL is ``"." + host + path``: host is what stands after the first
``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path is what
then stands up to ``?``, ``#`` or the end. Both are empty for a null URL or one
without ``://``. In a glob ``*`` stands for any bytes but ``/`` and ``**`` for
any bytes. A rule ``host/path`` fits that host and its subdomains if the path
starts with the rule's: it is the glob ``*.host/path**``. Among fitting rules
the longest wins (of equal length the one listed first); if none fits, a URL is
blocked if a block pattern fits it, else allowed. The block patterns of the query
are made from lists of words by ``block_patterns``: hosts that carry a word of
gambling, adult, spam or malware names as a label or as a part of one between
hyphens, and paths that lead to log-ins, carts, trackers or executables.

Rows are judged one by one; repeated rows get equal rows, a null page_id stays
null, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of the query: (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words in host names that are blocked, parts of paths that are, and names of files that are.
HOST_WORDS = (
    "adult bet betting bingo bitcoin-doubler blackjack buycheap cams casino cheapmeds cialis clickbait counterfeit crack darknet dating-hot escort "
    "fakenews forex-signal freegift freemoney gamble gambling getrich hacked hentai jackpot keygen loan-shark lottery malware milf nude onlyfans "
    "payday penny-stock phishing pills poker porn pornhub replica-watch rolex-replica roulette scam seo-links sex sexcam slots spam spyware "
    "sportsbet steroids sweepstakes torrent-free trojan viagra virus warez webcam-girls xxx"
).split()
PATH_PARTS = "ads adserver affiliate admin banner cart cgi-bin checkout clickid doubleclick login logout password-reset popunder popup signin signup sponsored tracking utm wp-admin wp-login xmlrpc".split()
FILES = "exe msi bat scr apk jar cab dmg deb rpm vbs ps1 torrent wp-login.php xmlrpc.php".split()


def block_patterns(host_words: list[str] = HOST_WORDS, path_parts: list[str] = PATH_PARTS, files: list[str] = FILES) -> tuple[str, ...]:
    """Globs over canonical URLs, ``"." + host + path``."""
    hosts = [g for w in host_words for g in (f"*.{w}.**", f"*.{w}-**", f"*-{w}.**", f"*-{w}-**")]
    paths = [g for w in path_parts for g in (f"**/{w}/**", f"**/{w}")]
    return (*hosts, *paths, *(f"**/{f}" if "." in f else f"**.{f}" for f in files))


#: What is blocked where no rule fits.
BLOCK_PATTERNS = block_patterns()
#: URLs longer than this are read one by one; bytes of state that are moved on at a time.
LONG_URL, STATE_BYTES = 4096, 1 << 20


class Automaton:
    """Shift-And over several 64-bit words for globs of ``*``, ``**`` and literal bytes."""

    def __init__(self, globs: tuple[str, ...]) -> None:
        parsed = [self._parse(g) for g in globs]
        bits = sum(len(p[0]) for p in parsed)
        n = max(1, -(-bits // 64))
        self.masks = np.zeros((256, n), np.uint64)
        self.first = np.zeros(n, np.uint64)  # bits that a shift must not reach from the glob before
        self.at_start, self.any_start, self.name_start = (np.zeros(n, np.uint64) for _ in range(3))
        self.any_stay, self.name_stay = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for letters, gaps in parsed:
            for k, letter in enumerate(letters):
                word, bit = divmod(at + k, 64)
                one = np.uint64(1 << bit)
                self.masks[letter, word] |= one
                if k == 0:
                    self.first[word] |= one
                    self.at_start[word] |= one
                    if gaps[0]:
                        (self.any_start if gaps[0] == 2 else self.name_start)[word] |= one
                if gaps[k + 1]:
                    (self.any_stay if gaps[k + 1] == 2 else self.name_stay)[word] |= one
            self.final.append((word, one))
            at += len(letters)

    @staticmethod
    def _parse(glob: str) -> tuple[list[int], list[int]]:
        """Literal bytes, and the kind of wildcard before each and at the end (0, 1 or 2)."""
        letters: list[int] = []
        gaps = [0]
        raw = glob.encode()
        i = 0
        while i < len(raw):
            if raw[i] == 0x2A:
                kind = 2 if raw[i : i + 2] == b"**" else 1
                gaps[-1] = max(gaps[-1], kind)
                i += kind
            else:
                letters.append(raw[i])
                gaps.append(0)
                i += 1
        if not letters:
            raise ValueError(f"the glob {glob!r} has no literal character")
        return letters, gaps

    def fits(self, urls: list[bytes]) -> np.ndarray:
        """A row of booleans, one for each glob, for each URL."""
        out = np.empty((len(urls), len(self.final)), bool)
        short = [i for i, u in enumerate(urls) if len(u) <= LONG_URL]
        step = max(1, STATE_BYTES // (8 * len(self.first)))
        short.sort(key=lambda i: len(urls[i]))  # of like lengths together
        for at in range(0, len(short), step):
            some = short[at : at + step]
            out[some] = self._side_by_side([urls[i] for i in some])
        for i, u in enumerate(urls):
            if len(u) > LONG_URL:
                out[i] = self._alone(u)
        return out

    def _alone(self, url: bytes) -> np.ndarray:
        """The same steps with all bits in one integer."""
        whole = {k: int.from_bytes(getattr(self, k).astype("<u8").tobytes(), "little") for k in ("first", "at_start", "any_start", "name_start", "any_stay", "name_stay")}
        masks = {x: int.from_bytes(self.masks[x].astype("<u8").tobytes(), "little") for x in set(url)}
        keep, any_start, both = ~whole["first"], whole["any_start"], whole["any_stay"] | whole["name_stay"]
        state, start, in_name = 0, whole["at_start"], True
        for letter in url:
            moved = ((state << 1) & keep | start) & masks[letter]
            slash = letter == 0x2F
            state = moved | state & (whole["any_stay"] if slash else both)
            in_name = in_name and not slash
            start = any_start | (whole["name_start"] if in_name else 0)
        return np.array([state >> (64 * word + int(bit).bit_length() - 1) & 1 for word, bit in self.final], bool)

    def _side_by_side(self, urls: list[bytes]) -> np.ndarray:
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        sizes = np.array([len(urls[i]) for i in order], np.int64)
        start = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[:-1]
        data = np.frombuffer(b"".join(urls[i] for i in order), np.uint8)
        state = np.zeros((len(urls), len(self.first)), np.uint64)
        in_name = np.ones((len(urls), 1), bool)  # no slash so far: a leading * may still grow
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes[0]) if len(urls) else 0):
            live = int(np.searchsorted(-sizes, -step, side="left"))
            letter = data[start[:live] + step]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.first
            moved |= self.any_start if step else self.at_start
            slash = (letter == 0x2F)[:, None]
            if step:
                moved |= np.where(in_name[:live], self.name_start, np.uint64(0))
            moved &= self.masks[letter]
            moved |= now & self.any_stay
            moved |= np.where(slash, np.uint64(0), now & self.name_stay)
            state[:live] = moved
            in_name[:live] &= ~slash
        out = np.empty((len(urls), len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            out[order, g] = (state[:, word] & bit) != 0
        return out


@lru_cache(4)
def automaton_of(globs: tuple[str, ...]) -> Automaton:
    return Automaton(globs)


@dataclass(frozen=True)
class UrlRules:
    rules: tuple[tuple[str, str], ...] = RULES
    block: tuple[str, ...] = BLOCK_PATTERNS


def parts(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, tail = rest[: min(ends, default=len(rest))], rest[min(ends, default=len(rest)) :]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[: min(ends, default=len(tail))]


def _judge(given: UrlRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of((*(f"*.{rule}**" for rule, _ in given.rules), *given.block))
        n = len(given.rules)
        by_length = sorted(range(n), key=lambda r: -len(given.rules[r][0]))
        for batch in batches:
            split = [parts(u) for u in batch.column(1).to_pylist()]
            fits = automaton.fits([f".{h}{p}".encode() for h, p in split])
            rule: list[str | None] = []
            verdict: list[str] = []
            for row in fits:
                best = next((r for r in by_length if row[r]), None)
                rule.append(None if best is None else given.rules[best][0])
                verdict.append(given.rules[best][1] if best is not None else "block" if row[n:].any() else "allow")
            columns = [pa.array(x, pa.string()) for x in ([h for h, _ in split], [p for _, p in split], rule, verdict)]
            yield pa.record_batch([batch.column(0), *columns], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, given: UrlRules = UrlRules()) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").mapInArrow(_judge(given), "page_id bigint, host string, path string, rule string, verdict string")


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


ORACLE = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
r AS (
  SELECT page_id, host, path,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches('.' || host || path, '^[^/]*[.-]({_any(HOST_WORDS)})[.-]', 's') OR regexp_matches('.' || host || path, '/({_any(PATH_PARTS)})(/|$)', 's')
         OR regexp_matches('.' || host || path, '({"|".join(("/" if "." in f else "[.]") + f.replace(".", "[.]") for f in FILES)})$', 's') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
