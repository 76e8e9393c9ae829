import random
import re

import pytest

from plumbline.llm import urls


def regex_of(glob):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|[^*]+", glob)) + r"\Z")


@pytest.mark.parametrize("seed", range(8))
def test_automaton_against_regular_expressions(seed, monkeypatch):
    monkeypatch.setattr(urls, "LONG_URL", 7)
    monkeypatch.setattr(urls, "STATE_BYTES", 64)
    rnd = random.Random(seed)
    globs = tuple({"".join(rnd.choice(["a", "b", "/", ".", "*", "**", "ab", "é"]) for _ in range(rnd.randrange(1, 9))) + "a" * (seed % 2) for _ in range(40)})
    globs = tuple(g for g in globs if g.strip("*") and "***" not in g)
    urls_ = ["".join(rnd.choice("ab/.é") for _ in range(rnd.randrange(0, 14))) for _ in range(300)]
    got = urls.Automaton(globs).fits([u.encode() for u in urls_])
    for i, u in enumerate(urls_):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(regex_of(g).match(u)), (g, u)


def test_query(spark):
    rows = [
        (1, "http://WWW.Example.com/en/x?y", "www.example.com/en/", "allow"), (2, "https://a.www.example.com/en/", "www.example.com/en/", "allow"),
        (3, "x://example.com/en/1#t", "example.com/en/", "block"), (4, "x://example.com/fr/1", "com/", "allow"), (5, "x://myexample.com/en/", "com/", "allow"),
        (6, "x://com/", "com/", "allow"), (7, "x://com", None, "allow"), (8, "x://a.net/es/", "net/es/", "block"), (9, "x://a.net/es", None, "allow"),
        (10, None, None, "allow"), (11, "nothing", None, "allow"), (12, "x://evil.org/.example.com/en/", None, "allow"), (13, "x://b.spam-farm.org/q", None, "block"),
        (14, "x://spam-farm.org", None, "block"), (20, "x://play.casino", None, "allow"), (21, "x://play.casino.org", None, "block"), (22, "x://my-poker-room.org/", None, "block"),
        (23, "x://pokerface.org/", None, "allow"), (24, "x://a.org/x/cart", None, "block"), (25, "x://a.org/cartoon/1", None, "allow"), (26, "x://a.org/f/setup.exe", None, "block"),
        (27, "x://a.org/exe", None, "allow"), (28, "x://a.org/x.spam.y", None, "allow"), (15, "a://b://c.net/fr/", None, "allow"), (16, "://h.net/fr/?://", "net/fr/", "block"), (17, "", None, "allow"),
        (18, "x://o.org/p/wp-login.php?a", None, "block"), (None, "x://ÄA.net/fr/" + "z" * 5000, "net/fr/", "block"),
    ]
    df = spark.createDataFrame([(u, p, "h") for p, u, _, _ in rows], "url string, page_id bigint, host string")
    got = {r.page_id: r for r in urls.judged(df).collect()}
    for p, u, rule, verdict in rows:
        assert (got[p].rule, got[p].verdict) == (rule, verdict), u
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/x") and (got[10].host, got[10].path) == ("", "")
    assert got[15].host == "b:" and got[None].host == "Äa.net"
    assert urls.judged(df.limit(0)).count() == 0


def test_patterns_against_the_oracles_expressions():
    """All globs at once on URLs that carry every word in several places."""
    globs = urls.BLOCK_PATTERNS
    assert len(globs) > 280 and len(set(globs)) == len(globs)
    made = [f".{a}{w}{b}{p}" for w in urls.HOST_WORDS[:30] for a in ("", "x-", "y.", "z") for b in (".org", "-q.org", "", "s.org") for p in ("", "/", f"/{w}.x")]
    made += [f".a.org/{a}{w}{b}" for w in (*urls.PATH_PARTS, *urls.FILES) for a in ("", "q/", "q.", "q") for b in ("", "/", "x", "/x")]
    host, path, files = (urls._any(x) for x in (urls.HOST_WORDS, urls.PATH_PARTS, urls.FILES))
    end = "|".join(("/" if "." in f else "[.]") + f.replace(".", "[.]") for f in urls.FILES)
    want = [bool(re.search(f"^[^/]*[.-]({host})[.-]", u) or re.search(f"/({path})(/|$)", u) or re.search(f"({end})$", u)) for u in made]
    assert urls.Automaton(globs).fits([u.encode() for u in made]).any(axis=1).tolist() == want
    assert 100 < sum(want) < len(want) and files


def test_long_and_repeated_urls(spark):
    long = "x://a.org/" + "p/" * 150_000
    rows = [(1, long), (2, long + "cart"), (2, long + "cart"), (3, "x://h.org/" + "é" * 3000)]
    got = sorted((r.page_id, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id bigint, url string")).collect())
    assert got == [(1, "allow"), (2, "block"), (2, "block"), (3, "allow")]
