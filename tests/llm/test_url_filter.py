from hypothesis import given
from hypothesis import strategies as st

from featurelens.llm import url_filter as uf

RULES = (*uf.HOST_RULES, *uf.URL_PATTERNS, uf.HostRule("co", "", "block"), uf.UrlPattern("*tra*cker*"), uf.UrlPattern("|ftp:"))
PARTS = st.sampled_from(["example", ".org", ".com", "org", "/en/1", "/es/", "/de/", "/fr/", "://", "https", "ads.", "x", ".",
                         "/", "?utm_source=", "#", "EXE", ".exe", "tracker.", "/banner/", "é", "\n", "1", "co", "ſ", "K"])
URLS = st.lists(PARTS, max_size=9).map("".join)


def split(url):
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host):]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), \
        next((path[:i] for i, c in enumerate(path) if c in "?#"), path)


def everything(url, host, path):
    """All rules tried, without an index."""
    fits = [r for r in RULES if isinstance(r, uf.HostRule) and (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    if fits:
        best = min(fits, key=lambda r: (-len(r.text), r.verdict != "allow", r.text))
        return best.text, best.verdict
    import re
    blocked = any(re.match(r.expression(), url) for r in RULES if isinstance(r, uf.UrlPattern))
    return None, "block" if blocked else "allow"


@given(URLS, st.dictionaries(st.sampled_from(["example", "org", "ads", "banner", "exe", "es"]), st.integers(0, 9)))
def test_index_loses_no_rule(url, counts):
    index = uf.RuleIndex(RULES, counts)
    assert index.judge(url, *split(url)) == everything(url, *split(url))


def test_edge_rows(rows):
    urls = [None, "", "no scheme/banner/x", "http://EXAMPLE.org/es/1?a", "http://a.example.org/en/12", "http://x.com/fr/",
            "http://notorg/", "http://org", "https://q.net/banner/i.png", "https://q.net/banner/i.png"]
    frame = rows.frame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = rows.dicts(uf.judge(frame), "page_id")
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "block"),
        ("example.org", "/es/1", "example.org/es/", "block"), ("a.example.org", "/en/12", "example.org/en/1", "block"),
        ("x.com", "/fr/", "com/fr/", "allow"), ("notorg", "/", None, "allow"), ("org", "", None, "allow"),
        ("q.net", "/banner/i.png", None, "block"), ("q.net", "/banner/i.png", None, "block")]
    assert uf.judge(frame.limit(0)).count() == 0


def test_rare_tokens_file_the_rules(spark):
    index = uf.RuleIndex(uf.HOST_RULES, {"example": 9, "org": 5, "es": 1, "en": 0, "com": 3, "fr": 2, "de": 7})
    assert {t: [r.text for r in v] for t, v in index.by_token.items()} == {
        "org": ["org/"], "es": ["example.org/es/"], "en": ["example.org/en/1"], "fr": ["com/fr/"], "com": ["com/de/"]}
