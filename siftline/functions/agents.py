"""What a user agent says: device, browser, system, bot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that crawlers, tools and browsers publish, in lower case; the first label with a token in the agent counts.
BOTS = [
    ("Link preview", ["whatsapp/", "telegrambot", "facebookexternalhit", "twitterbot", "linkedinbot", "slackbot", "discordbot"]),
    ("Search crawler", ["googlebot", "bingbot", "duckduckbot", "baiduspider", "yandexbot", "applebot"]),
    ("Script", ["curl/", "wget/", "python-requests", "python-urllib", "go-http-client", "okhttp", "libwww-perl"]),
    ("Other crawler", ["bot", "crawler", "spider", "headlesschrome"]),
]
SYSTEMS = [("Android", ["android"]), ("iOS", ["iphone", "ipad", "ipod"]), ("ChromeOS", ["cros "]), ("Windows", ["windows nt"]), ("macOS", ["macintosh", "mac os x"]), ("Linux", ["linux"])]
BROWSERS = [("Edge", ["edg/", "edga/", "edgios/"]), ("Opera", ["opr/"]), ("Samsung Internet", ["samsungbrowser/"]), ("Firefox", ["firefox/", "fxios/"]), ("Chrome", ["chrome/", "crios/"]), ("Safari", ["safari/"])]


def labelled(agent: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first label of which the agent (lower case) has a token."""
    out = F.lit(None).cast("string")
    for label, tokens in reversed(rules):
        has = F.lit(False)
        for t in tokens:
            has = has | F.contains(agent, F.lit(t))
        out = F.when(has, label).otherwise(out)
    return out


def classify_agent(ua: Column) -> dict[str, Column]:
    """Device (Bot, Tablet, Mobile, Desktop), browser or kind of bot, system, bot. An empty agent is a script."""
    agent = F.lower(F.trim(F.coalesce(ua, F.lit(""))))
    bot = F.when(agent == "", "Script").otherwise(labelled(agent, BOTS))
    tablet = F.contains(agent, F.lit("ipad")) | F.contains(agent, F.lit("tablet")) | F.contains(agent, F.lit("android")) & ~F.contains(agent, F.lit("mobile"))
    device = F.when(bot.isNotNull(), "Bot").when(tablet, "Tablet").when(F.contains(agent, F.lit("mobile")) | F.contains(agent, F.lit("iphone")), "Mobile").otherwise("Desktop")
    return {"device": device, "browser": F.coalesce(bot, labelled(agent, BROWSERS), F.lit("Other")), "os": F.when(bot.isNotNull(), "").otherwise(F.coalesce(labelled(agent, SYSTEMS), F.lit(""))), "bot": bot.isNotNull()}
