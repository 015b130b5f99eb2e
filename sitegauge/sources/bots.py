"""Registry of AI crawlers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegauge.functions.sqltext import lit, struct

# Crawler, operator, weight in the access score (sum 100).
BOTS = (
    ("GPTBot", "OpenAI (ChatGPT training data)", 12),
    ("ChatGPT-User", "OpenAI (ChatGPT live browsing)", 10),
    ("Google-Extended", "Google (Gemini training data)", 12),
    ("GoogleOther", "Google (AI Overviews, other AI)", 10),
    ("CCBot", "Common Crawl (used by many AI models)", 10),
    ("anthropic-ai", "Anthropic (Claude training data)", 8),
    ("ClaudeBot", "Anthropic (Claude web search)", 8),
    ("PerplexityBot", "Perplexity AI", 8),
    ("Bytespider", "ByteDance (TikTok AI)", 5),
    ("Amazonbot", "Amazon (Alexa, AI services)", 5),
    ("meta-externalagent", "Meta (Facebook AI, LLaMA)", 7),
    ("cohere-ai", "Cohere", 5),
)
# Crawlers whose blocking is a high-severity issue.
HIGH_IMPACT = ("GPTBot", "ChatGPT-User", "Google-Extended", "GoogleOther")

BOT_SCHEMA = "ord int, bot string, operator string, weight int, high_impact boolean"


def bot_rows() -> list[tuple]:
    return [(i, bot, op, weight, bot in HIGH_IMPACT) for i, (bot, op, weight) in enumerate(BOTS, 1)]


def bot_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(bot_rows(), BOT_SCHEMA)


def bot_array_sql() -> str:
    """The registry as one constant array, so that a row can be held against every bot in place."""
    rows = [
        struct(ord=str(o), bot=lit(bot), operator=lit(op), weight=str(weight), high_impact=str(high).lower())
        for o, bot, op, weight, high in bot_rows()
    ]
    return "array(" + ", ".join(rows) + ")"
