"""Parameters of a run, with the defaults the reports were tuned for."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    review_window_weeks: int = 10
    max_reviews_per_product: int = 500
    max_feed_pages: int = 10
    min_cluster_size: int = 5
    max_themes: int = 5
    quotes_per_theme: int = 3
    actions_per_theme: int = 2
    embedding_model: str = "all-MiniLM-L6-v2"
    embedding_batch: int = 100
    summary_model: str = "qwen3.6-27b"
    max_tokens_per_run: int = 60_000
    #: Tokens that vectors of a run may cost; None: the encoder costs none.
    max_embedding_tokens: int | None = None
    cost_alert_threshold_usd: float = 2.0
    email_mode: str = "draft"
    cap_after_end: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.review_window_weeks <= 52:
            raise ValueError("review_window_weeks must be 1 to 52")
        if self.min_cluster_size < 2:
            raise ValueError("min_cluster_size must be at least 2")
        if self.email_mode not in ("none", "draft", "send"):
            raise ValueError("email_mode must be none, draft or send")
        for name in ("max_reviews_per_product", "max_themes", "quotes_per_theme", "actions_per_theme"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
