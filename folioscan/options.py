"""Options: one frozen value, captured when a plan is built, so that executors see what the driver saw."""

from __future__ import annotations

from dataclasses import dataclass

IMAGE = ("png", "jpg", "jpeg", "webp", "bmp", "pdg")
ARCHIVE = ("zip", "rar", "uvz", "7z")
KINDS = {**dict.fromkeys(IMAGE, "image"), "pdf": "pdf", "epub": "epub", "mobi": "mobi", **dict.fromkeys(ARCHIVE, "archive")}
BATCH = ("pdf", "epub", "mobi", *ARCHIVE)
SORTS = {f"{a}_{b}": (b, a == "oldest") for a in ("oldest", "newest") for b in ("changed", "modified", "accessed")}


@dataclass(frozen=True)
class Options:
    strict: int = 3
    china_only: bool = True
    front: tuple[int, int] = (2, 5)
    back: tuple[int, int] = (3, 1)
    pdg_least: int = 30
    pdg_fallback: int = 5
    confidence: float = 0.3
    overlap: float = 0.45
    padding: int = 20
    canvas: tuple[int, int] = (1280, 1280)
    rename_mode: int = 3
    lower_suffix: bool = True
    keep_name: bool = True
    longest_name: int = 180
    skip_isbn: bool = True
    skip_ssid: bool = False
    keep_tree: bool = False
    text_members: int = 200
    member_bytes: int = 10 * 1024 * 1024

    def __post_init__(self) -> None:
        if isinstance(self.strict, bool) or not isinstance(self.strict, int):
            raise ValueError("strict is a whole number")
        if self.rename_mode not in (1, 2, 3, 4):
            raise ValueError("rename_mode is 1, 2, 3 or 4")
        if self.longest_name < 10:
            raise ValueError("longest_name is 10 at least")


def extensions(names: tuple[str, ...]) -> tuple[str, ...]:
    """names, lower-cased and without dots; only those that a batch can read."""
    out = tuple(n.lower().lstrip(".") for n in names)
    if bad := sorted(set(out) - set(BATCH)):
        raise ValueError(f"not for a batch: {', '.join(bad)}")
    return out
