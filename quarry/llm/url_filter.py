"""URL filters with a weighted vocabulary.

One Aho-Corasick automaton counts strict and soft terms in the words of host and path, at word boundaries: words are runs of 0-9,
a-z (A-Z lower-cased) and everything outside ASCII, and all else between them counts as one hyphen.  One strict term rejects a URL;
soft terms reject it if SOFT_LEAST distinct ones or more stand in it and their weights reach SOFT_LIMIT.  Soft terms are single words, so no
two of them share a place.  Fixed host and path rules come first.

Defined cases: a null URL or one without "://" has empty host and path, no rule, no terms and verdict allow; equal terms count
once; a term in both lists is strict; repeated rows are judged each; very long URLs are whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, lower_ascii, map_texts

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Terms of adult, gambling, fraud, drug and piracy sites that hardly stand in other URLs.
STRICT = tuple(
    """
    porn porno pornhub pornstar xxx xvideos xnxx xhamster redtube youporn hentai milf camgirl camgirls sexcam sexcams livesex sexchat sextube
    adultfriendfinder escort escorts callgirl callgirls striptease nudist upskirt gangbang bukkake bdsm hardcore-sex adult-dating hookup-site
    casino sportsbook bookmaker blackjack baccarat roulette slot-machine slot-machines slotmachine betting-tips bet-online online-betting
    poker-online online-poker free-spins viagra cialis levitra kamagra tramadol-online xanax-online buy-pills penis-enlargement male-enhancement
    payday-loan payday-loans paydayloan cash-advance bad-credit-loan get-rich-quick work-from-home-job replica-watch replica-watches
    fake-rolex counterfeit buy-followers buy-likes essay-writing-service buy-essay darknet darkweb-market carding cvv-shop warez keygen keygens
    crackz nulled serialz torrentz piratebay thepiratebay putlocker free-movies-online phishing malware ransomware spamlist
    """.split()
)
#: Words that speak for such sites only together, by weight.
SOFT = {
    word: weight
    for weight, words in (
        (3, "sex sexy nude nudes naked erotic erotica fetish swingers adult lingerie gamble gambling jackpot lottery lotto bingo poker bet bets betting wager spam scam pharmacy steroids weed cannabis crack cracked torrent torrents pirated hacked exploit"),
        (
            2,
            "adserver adservers ads advert adverts popunder popup banner banners affiliate affiliates referral sponsored tracker trackers track tracking click clicks clickbait redirect slots spins bonus bonuses casinobonus odds "
            "winner winners win prize prizes giveaway sweepstakes reward rewards free freebie freebies cheap cheapest discount discounts coupon coupons promo promos promocode deal deals clearance wholesale outlet "
            "loan loans credit debt mortgage refinance payday cash money earn income profit profits forex crypto bitcoin invest investing trader trading pills pill drugs meds rx prescription diet slim weightloss keto detox supplement supplements "
            "dating singles hookup hookups girls babes hot teen teens mature webcam webcams cam cams chatroom massage replica replicas fake rolex handbags serial serials patch unlocked download downloads stream streams streaming hd mp3 mp4 rip ripped subtitles "
            "followers likes views traffic backlinks seo rank ranking botnet proxy proxies vpn cheat cheats hack hacks hacking bot bots generator",
        ),
        (1, "best top new now online buy order sale shop store offer offers price prices review reviews guide tips secret secrets amazing instant fast easy guaranteed legit trusted official vip club farm zone world hub 24h 247"),
    )
    for word in words.split()
}
SOFT_LIMIT, SOFT_LEAST = 4, 2


def automaton(strict=STRICT, soft=SOFT):
    """Terms stand between hyphens, as the words of a URL do, so each match is at boundaries."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(f"-{term}-", (term, False))
    for term in strict:
        a.add_word(f"-{term}-", (term, True))
    a.make_automaton()
    return a


def counted(host: bytes, path: bytes, a, soft=SOFT) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms and the soft terms' weight."""
    own = b"-".join((host + b"/" + path).translate(WORD_BYTES).split()).decode()
    hits = {hit for _, hit in a.iter(f"-{own}-")}
    found = [term for term, hard in hits if not hard]
    return len(hits) - len(found), len(found), sum(soft[t] for t in found)


def judged(pages: DataFrame, strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT, least: int = SOFT_LEAST) -> DataFrame:
    """page_id, host, path, n_strict, n_soft, soft_weight, rejected."""
    host, path = split_url(F.col("url"))

    def make():
        a = automaton(strict, soft)

        def f(ids, hosts, own_paths):
            got = [counted(h, p, a, soft) for h, p in zip(hosts, own_paths)]
            n_strict, n_soft, weight = ([g[i] for g in got] for i in range(3))
            texts = [[x.decode() for x in part] for part in (hosts, own_paths)]
            return [ids, *texts, n_strict, n_soft, weight, [s > 0 or n >= least and w >= limit for s, n, w in got]]

        return f

    schema = "page_id long, host string, path string, n_strict int, n_soft int, soft_weight int, rejected boolean"
    return map_texts(pages.select("page_id", host.alias("host"), path.alias("path")), ["page_id", "host", "path"], schema, make)


def split_url(url):
    """(host, path) columns; both empty without "://"."""
    after = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host, path, rules=RULES):
    """The longest rule that fits as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def op4(pages: DataFrame) -> DataFrame:
    ruled = judged(pages).withColumn("r", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def _op4_sql() -> str:
    fits = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{h + p}', '{v}']"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH strict(term) AS (VALUES {', '.join(f"('{t}')" for t in STRICT)}),
soft(term, weight) AS (VALUES {', '.join(f"('{t}', {w})" for t, w in SOFT.items() if t not in STRICT)}),
a AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, {lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), w AS (
  SELECT *, regexp_extract_all({lower("host || '/' || path")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM p
), hard AS (
  SELECT DISTINCT n FROM w JOIN strict ON contains('-' || array_to_string(words, '-') || '-', '-' || term || '-')
), light AS (
  SELECT n, count(*) AS terms, sum(weight) AS weight FROM (SELECT DISTINCT n, unnest(words) AS term FROM w) JOIN soft USING (term) GROUP BY n
), r AS (
  SELECT w.*, hard.n IS NOT NULL OR (coalesce(terms, 0) >= {SOFT_LEAST} AND coalesce(weight, 0) >= {SOFT_LIMIT}) AS rejected, CASE {' '.join(fits)} END AS r
  FROM w LEFT JOIN hard ON w.n = hard.n LEFT JOIN light ON w.n = light.n
)
SELECT page_id, host, path, r[1] AS rule, coalesce(r[2], CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


OP4_SQL = _op4_sql()
