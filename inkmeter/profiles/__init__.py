"""Language profiles and the score parameters shared by all of them."""

from __future__ import annotations

from .base import Pattern, Profile, Signal
from .latin import LATIN
from .zh import ZH

PROFILES = {"zh": ZH, "latin": LATIN}


def get_profile(profile: str | Profile) -> Profile:
    return profile if isinstance(profile, Profile) else PROFILES[profile]


__all__ = ["LATIN", "PROFILES", "Pattern", "Profile", "Signal", "ZH", "get_profile"]
