"""Row-local column functions."""

from .text import *  # noqa: F401,F403
