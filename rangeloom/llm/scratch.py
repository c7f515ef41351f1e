"""Tables written between the rounds of a job, under the names the operators use."""

from __future__ import annotations

from ..tables import is_small
from ..tables import keep as stash

__all__ = ["is_small", "stash"]
