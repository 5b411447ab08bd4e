"""Settings of a scan and their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Results must agree on these.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".mkv", ".avi", ".wmv", ".flv", ".webm", ".m4v", ".mpeg", ".mpg")
TEXT_EXTENSIONS = (".txt",)
NO_PHASH = (".heic", ".heif")
SKIPPED_FOLDERS = ("node_modules", "__pycache__")
BUCKET_CAP = 256
SKETCH = 1024
GRAM = 5
BANDS, ROWS = 8, 2
NAME_MATCH, NAME_DELTA, PLAIN_DELTA = 0.85, 0.30, 0.04
LENGTH_RATIO = 0.70
REVIEW_DELTA = 0.02
NO_DIRECT = -1.0
TYPE_ORDER = ("exact", "similar_image", "similar_video", "similar_text")


@dataclass(frozen=True)
class Settings:
    """Values out of range fall back to their defaults; an empty video mode is precise."""

    threshold: float = 0.95
    text_threshold: float = 0.92
    frames: int = 8
    min_frames: int = 3
    video_mode: str = "simple"
    review_delta: float = REVIEW_DELTA
    segment_bytes: int = 1 << 20
    sampled_from: int = 4 << 20
    verify: bool = False
    media: tuple[str, ...] = ("image", "video", "text")

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        if not 0 < self.threshold <= 1:
            put("threshold", 0.95)
        if not 0 < self.text_threshold <= 1:
            put("text_threshold", 0.92)
        if self.frames <= 0:
            put("frames", 8)
        put("frames", max(self.min_frames, self.frames))
        if self.video_mode not in ("simple", "precise"):
            put("video_mode", "precise")
        if self.review_delta == 0:
            put("review_delta", REVIEW_DELTA)
