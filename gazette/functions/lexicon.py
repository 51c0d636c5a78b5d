"""The word lists and weights that scoring uses; every one is a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


# Fixed values from here on.
SOURCE_WEIGHTS = {
    "openai blog": 1.0,
    "google deepmind blog": 1.0,
    "anthropic blog": 1.0,
    "meta ai blog": 1.0,
    "mit technology review": 0.92,
    "techcrunch (ai)": 0.9,
    "the verge (ai)": 0.88,
    "wired (ai)": 0.88,
    "venturebeat (ai)": 0.87,
    "the guardian (ai)": 0.85,
    "zdnet (ai)": 0.8,
}
DEFAULT_WEIGHT = 0.7
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "that",
    "the", "their", "to", "story", "stories", "news", "update", "updates", "with",
)
PRODUCT = (
    "launch", "launches", "launched", "release", "releases", "released", "rollout", "rollouts", "ship", "ships", "shipped", "debut",
    "debuts", "debuted", "introduces", "introduced", "unveils", "unveiled", "feature", "features", "api", "apis", "model", "models",
    "agent", "agents", "platform", "copilot", "copilots", "sdk", "tool", "tools",
)
TECH = (
    "breakthrough", "breakthroughs", "benchmark", "benchmarks", "inference", "training", "multimodal", "reasoning", "architecture",
    "architectures", "chip", "chips", "accelerator", "accelerators", "evaluation", "efficiency", "latency", "throughput", "sota",
)
STARTUP = (
    "startup", "startups", "funding", "fundraise", "fundraising", "seed", "preseed", "series", "valuation", "investor", "investors",
    "venture", "vc", "raise", "raises", "raised",
)
ENTERPRISE = (
    "enterprise", "enterprises", "adoption", "adopt", "adopts", "adopted", "deploy", "deploys", "deployed", "deployment",
    "production", "customer", "customers", "workflow", "workflows", "integration", "integrates", "integrated", "operations",
    "productivity",
)
DEAL = (
    "deal", "deals", "partnership", "partnerships", "partner", "partners", "contract", "contracts", "acquire", "acquires",
    "acquired", "acquisition", "merger", "mergers", "agreement", "agreements",
)
LOW = (
    "event", "events", "conference", "conferences", "summit", "webinar", "meetup", "podcast", "newsletter", "interview", "opinion",
    "roundup", "recap", "guide", "tutorial", "course",
)
HIGH_PHRASES = (
    "new model", "new feature", "model release", "product launch", "series a", "series b", "series c", "funding round",
    "enterprise adoption", "enterprise deployment", "production deployment", "strategic partnership", "signed a deal",
)
LOW_PHRASES = (
    "weekly roundup", "daily roundup", "event recap", "conference recap", "podcast episode", "panel discussion", "how to",
    "step by step",
)


@dataclass(frozen=True)
class Lexicon:
    """groups: (name, words, boost of the first hit)."""

    groups: tuple[tuple[str, tuple[str, ...], float], ...] = (
        ("product", PRODUCT, 0.28),
        ("tech", TECH, 0.22),
        ("startup", STARTUP, 0.24),
        ("enterprise", ENTERPRISE, 0.22),
        ("deal", DEAL, 0.20),
    )
    low: tuple[str, ...] = LOW
    high_phrases: tuple[str, ...] = HIGH_PHRASES
    low_phrases: tuple[str, ...] = LOW_PHRASES
    stopwords: tuple[str, ...] = STOPWORDS
    source_weights: dict[str, float] = field(default_factory=lambda: dict(SOURCE_WEIGHTS))
    default_weight: float = DEFAULT_WEIGHT


DEFAULT = Lexicon()
