"""Filter lists and the index, against matches worked out by hand or by a plain matcher."""

import random
import re

import pytest
from pyspark.sql import functions as F

from billweave.llm import url_filter as uf


def verdicts(spark, rules, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.url: (r.verdict, r.pattern) for r in uf.filter_urls(df, uf.parse_rules(rules)).collect()}
    return {u: found[u] for u in urls}


def test_matches_of_each_kind_of_pattern(spark):
    cases = {
        "||shop.example^": (["http://shop.example/", "https://a.SHOP.example:80/x", "http://shop.example"], ["http://myshop.example/", "http://shop.example.org/", "http://x.org/shop.example/"]),
        "/promo/*.png|": (["http://x.org/promo/a.png", "http://x.org/promo/b/c.PNG"], ["http://x.org/promo/a.png?x", "http://x.org/promos/a.png"]),
        "|start.": (["http://start.org/"], ["http://a.start.org/", "http://x.org/start."]),
        "-popup-": (["http://x.org/a-popup-b"], ["http://x.org/popup"]),
        "id=7^": (["http://x.org/?id=7&a", "http://x.org/?id=7"], ["http://x.org/?id=77", "http://x.org/?id=7.1"]),
        "||a.b+c(d)": (["http://a.b+c(d)/"], ["http://a.bbc(d)/", "http://axb+c(d)/"]),
        "*7*": (["http://x.org/7", "http://x7.org"], ["http://x.org/"]),
    }
    for rule, (hit, miss) in cases.items():
        got = verdicts(spark, [rule], hit + miss)
        assert got == {**{u: ("block", rule) for u in hit}, **{u: ("allow", None) for u in miss}}, rule


def test_exceptions_comments_and_repeats(spark):
    lines = ["[List 1.0]", "! a comment", "", "  ||ads.example^", "||ads.example^", "@@||ads.example/info/"]
    assert [(r.text, r.verdict) for r in uf.parse_rules(lines)] == [("||ads.example^", "block"), ("||ads.example/info/", "allow")]
    got = verdicts(spark, lines, ["http://ads.example/x", "http://ads.example/info/x", "no scheme ads.example", ""])
    assert [v for v, _ in got.values()] == ["block", "allow", "allow", "allow"]


@pytest.mark.parametrize("line, why", [("||a.b^$third-party", "options"), ("a.b##.ad", "element"), ("a.b#@#.ad", "element"), ("|http://a.b", "://"), ("a|b", "'|'"), ("@@||", "empty"), ("*", "empty")])
def test_lines_without_a_meaning_here_are_refused(line, why):
    with pytest.raises(ValueError, match=r"line 2: .*" + re.escape(why)):
        uf.parse_rules(["fine", line])


@pytest.fixture(scope="module")
def many():
    """Some three thousand rules and a thousand URLs that share tokens."""
    rng = random.Random(1)
    names = [a + b for a in ("cloud", "news", "photo", "game", "shop", "blog") for b in map(str, range(250))]
    hosts = [f"{n}.{t}" for n in names for t in ("com", "example")]
    rules = [f"||{h}^" for h in hosts[::2]] + [f"/{n}/*.js^" for n in names[::3]] + [f"?from={n}^" for n in names[::5]] + [f"@@||{h}/about/" for h in hosts[::6]]
    rules += [f"-{n}_" for n in names[::4]] + ["*click*", "="]
    paths = ["/", "/about/us", f"/{names[3]}/x.js", f"/?from={names[10]}", f"/a-{names[8]}_b", "/click", "/CLICKS/7", ""]
    urls = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(1000)]
    return uf.parse_rules(rules), urls


def plain_match(rule, address):
    """Match by trying every way, without regular expressions."""
    text = rule.text.lower()
    ends, start = text.endswith("|"), 2 if text.startswith("||") else int(text.startswith("|"))
    text = text[start:].removesuffix("|")

    def fits(i, at):
        if i == len(text):
            return not ends or at == len(address)
        if text[i] == "*":
            return any(fits(i + 1, k) for k in range(at, len(address) + 1))
        if text[i] == "^":
            if at == len(address):
                return fits(i + 1, at)
            return not (address[at].isascii() and address[at].isalnum() or address[at] in "_.%-") and fits(i + 1, at + 1)
        return at < len(address) and address[at] == text[i] and fits(i + 1, at + 1)

    host = re.match("[^/?#]*", address)[0]
    places = {0: range(len(address) + 1), 1: [0], 2: [0] + [k + 1 for k, c in enumerate(host) if c == "."]}[start]
    return any(fits(0, k) for k in places)


def test_thousands_of_rules_equal_a_plain_matcher(spark, many):
    rules, urls = many
    assert len(rules) > 2500
    some = urls[:120]
    df = spark.createDataFrame([(u,) for u in some], "url string")
    want = {}
    for u in some:
        hits = [r for r in rules if plain_match(r, u.split("://", 1)[1].lower())]
        want[u] = "allow" if not hits or any(r.verdict == uf.ALLOW for r in hits) else "block"
    assert {r.url: r.verdict for r in uf.filter_urls(df, rules).collect()} == want and set(want.values()) == {"allow", "block"}


def test_few_rules_are_candidates(spark, many):
    rules, urls = many
    tokens = spark.createDataFrame([(i, u.split("://", 1)[1]) for i, u in enumerate(urls)], "i int, low string")
    each = tokens.select("i", F.explode(F.array_union(F.array(F.lit("")), uf.tokens_of(F.col("low")))).alias("token"))
    index = uf.rule_index(spark, rules, each.select("token"))
    assert index.count() == len(rules)
    n = each.join(index, "token").groupBy("i").count().agg(F.avg("count"), F.max("count")).first()
    assert n[0] < len(rules) / 200 and n[1] < len(rules) / 50


def test_the_rarest_token_is_chosen(spark):
    tokens = spark.createDataFrame([("com",)] * 9 + [("shop",)] * 2 + [("cart",)] * 5, "token string")
    rules = (uf.UrlRule("||shop.com/cart/", uf.BLOCK, False), uf.UrlRule("*", uf.BLOCK, False), uf.UrlRule("||com/never/", uf.BLOCK, False))
    got = {r.text: r.token for r in uf.rule_index(spark, rules, tokens).collect()}
    assert got == {"||shop.com/cart/": "shop", "*": "", "||com/never/": "never"}


def test_a_long_list_is_joined_without_broadcast(spark, many, monkeypatch):
    rules, urls = many
    df = spark.createDataFrame([(u,) for u in urls[:200]], "url string")
    one = sorted(uf.filter_urls(df, rules).collect())
    monkeypatch.setattr(uf, "BROADCAST_RULES", 10)
    assert sorted(uf.filter_urls(df, rules).collect()) == one


def test_clashing_names_repeats_and_empty(spark):
    df = spark.createDataFrame([("http://ads.a.net/", "b"), ("http://ads.a.net/", "b"), (None, "b")], "url string, best string")
    df = df.select("*", *[F.lit(c).alias(c) for c in ("_url", "_of", "own0", "token", "_plain", "x.y", "HOST")])
    got = uf.filter_urls(df).collect()
    assert len(got) == 3 and all(r.best == "b" and r.token == "token" and r["x.y"] == "x.y" for r in got)
    assert sorted((r.host, r.verdict) for r in got) == [("", "allow"), ("ads.a.net", "block"), ("ads.a.net", "block")]
    assert uf.filter_urls(df.limit(0)).collect() == []
