"""A small table of labelled URLs for the model of ``url_filter``: invented good and bad hosts, apart from its rules.

Every host is seen with the same languages, domains and page forms, so that only words of host and
path tell good from bad. An input of the registered query; a larger table of the same columns
(``url, blocked``) can take its place.
"""

from __future__ import annotations

GOOD = """
library museum university college school science history garden weather kitchen recipes travel music theatre gallery journal
archive daily-news morning-post city-council health-service hospital parliament railway harbour river-watch bird-atlas fish-survey
open-data maps street-guide bookshop grammar dictionary encyclopedia physics chemistry biology geology astronomy farming
forestry carpentry knitting cycling football rowing chess climbing hiking sailing photography painting letters poetry
thornton rutherford anderson tanaka moreau schneider garcia lindholm petrov okafor thistle heather meander tarragon lantern
stationers thinking weaving tidings another together northern southern eastern western teacher reader writer builder
""".split()
BAD = """
casino casino-royal online-casino best-casino casino-bonus win-big big-win winner-prize easy-win jackpot-win jackpot slots-bonus
free-slots poker poker-cash roulette betting bets sport-bets bet-bonus bets-online free-spins free-money free-prize free-gift
spam spam-mail spam-links link-farm content-farm farm-links click-farm seo-farm ads ads-server ads-click pop-ads track-click
track-user tracking-pixel ad-track adult-cams xxx-video porn-tube hot-cams escort-girls cheap-pills pills-store viagra-shop
replica-watches fake-rolex payday-loan quick-loans crypto-doubler phish-login account-verify malware-download crack-keygen
warez torrent-crack lottery-win prize-claim earn-money-fast rich-quick
""".split()
LANGUAGES = ("en", "de", "fr", "es", "it", "nl")
GOOD_PATHS = ("", "/news/local", "/articles/garden", "/docs/guide")
BAD_PATHS = ("", "/casino/bonus", "/free/win", "/click/track")


def rows() -> list[tuple[str, int]]:
    """``url, blocked``: each host in every language, with front names, domains and path words in turn."""
    out = []
    for blocked, hosts, paths in ((0, GOOD, GOOD_PATHS), (1, BAD, BAD_PATHS)):
        for k, host in enumerate(hosts):
            for j, lang in enumerate(LANGUAGES):
                front, domain = ("", "www.", "m.", "blog.")[(k + j) % 4], ("com", "org", "net")[(k // 4 + j) % 3]
                number = (7919 * (j + 1) + 104729 * (k // 2)) % 9973
                for words in (paths[0], paths[1 + (k + j) % 3]):
                    out.append((f"https://{front}{host}.example.{domain}/{lang}{words}/{number}{('', '/', '.html')[j % 3]}", blocked))
    return out
