"""Settings of a harvest; all are parameters, these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Substrings that no followed url may hold (the spelling of "mozzila" is part of the rule).
NOFOLLOW = (
    "creativecommons", "facebook", "feedly", "flickr", "github", "google", "instagram", "last.fm", "linkedin", "mozzila",
    "openstreetmap", "opera", "sciencedirect", "twitter", "vimeo", "wikimedia", "wikipedia", "wiley", "youtube", "sciencecommons",
)

# Dutch month names and abbreviations.
MONTHS = {
    "januari": 1, "jan": 1, "februari": 2, "feb": 2, "maart": 3, "mrt": 3, "april": 4, "apr": 4, "mei": 5, "juni": 6, "jun": 6,
    "juli": 7, "jul": 7, "augustus": 8, "aug": 8, "september": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}


@dataclass(frozen=True)
class Settings:
    """crawl_depth counts external hops; delays are in seconds, revisit_after in days, date_time_distance in characters."""

    user_agent: str = "Python-urllib/3.4"
    user_agent_info: dict[str, str] = field(default_factory=lambda: {"name": "python crawler", "organisation": "-", "location": "Unknown", "language": "Python 3"})
    seeds: tuple[str, ...] = ()
    always_include_base: bool = False
    crawl_depth: int = 0
    crawl_delay: float = 5.0
    revisit_after: int = 15
    max_threads: int = 50
    max_concurrent_sitemaps: int = 50
    date_time_distance: int = 4
    nofollow: tuple[str, ...] = NOFOLLOW

    def request_headers(self) -> dict[str, str]:
        """FN-22: the user agent and who runs it, as a client would send them."""
        from urllib.parse import urlencode

        return {"User-Agent": self.user_agent, "User-Agent-Info": urlencode(self.user_agent_info)}


DEFAULT = Settings()
